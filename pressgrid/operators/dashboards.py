"""Usage and content dashboards."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .. import constants as K
from .articles import has_listed_category
from .ordering import exact_percentiles


def session_funnel(events: DataFrame, steps: list[str] = K.FUNNEL_STEPS) -> DataFrame:
    """Distinct sessions per step and audience, one row per step.

    Sessions are made distinct once per (step, session, membership) with map-side
    combine; no twelve-fold expansion of the log as COUNT(DISTINCT) x 12 would need.
    """
    marks = (events.where(F.col("event_type").isin(steps) & F.col("session_id").isNotNull())
             .groupBy("event_type", "session_id")
             .agg(F.max(F.col("user_id").isNotNull().cast("int")).alias("member"),
                  F.max(F.col("user_id").isNull().cast("int")).alias("guest")))
    counts = marks.groupBy("event_type").agg(F.count("*").alias("overall"), F.sum("member").alias("member"),
                                             F.sum("guest").alias("guest"))
    every = events.sparkSession.createDataFrame([(i, s) for i, s in enumerate(steps)], "step_no int, event_type string")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c)
    return every.join(counts, "event_type", "left").select("step_no", F.col("event_type").alias("step"),
                                                           zero("overall"), zero("member"), zero("guest"))


def half_up(value: Column) -> Column:
    return F.floor(value + 0.5)


def funnel_percentages(funnel: DataFrame) -> DataFrame:
    """Bar width per step and audience: share of the first step, rounded half up, at least 2."""
    audiences = ["overall", "member", "guest"]
    base = funnel.where("step_no = 0").select(*[F.greatest(F.col(a), F.lit(1)).alias(f"base_{a}") for a in audiences],
                                              F.lit(1).alias("one"))
    pct = [F.greatest(half_up(F.col(a) / F.col(f"base_{a}") * 100), F.lit(2)).cast("bigint").alias(f"{a}_pct")
           for a in audiences]
    return (funnel.withColumn("one", F.lit(1)).join(F.broadcast(base), "one").select("step_no", "step", *pct))


def daily_active_sessions(events: DataFrame, days: int = 14, latest: bool = False) -> DataFrame:
    """Distinct sessions per day.  The earliest days as the dashboard shows them, or the latest ones."""
    day = F.substring("created_at", 1, 10)
    per_day = (events.where("created_at is not null and created_at <> '' and session_id is not null")
               .select(day.alias("day"), "session_id").distinct().groupBy("day").agg(F.count("*").alias("sessions")))
    picked = per_day.orderBy(F.col("day").desc() if latest else F.col("day").asc()).limit(days)
    return picked.select("day", F.substring("day", 6, 5).alias("label"), "sessions")


def top_viewed_articles(events: DataFrame, articles: DataFrame, limit: int = 10) -> DataFrame:
    """Views, trust-panel opens and feedback per article.

    Counts are combined per article id before the join, so a hot article is one row.
    Events of deleted articles form one group under a default title.
    """
    hits = lambda t: F.sum((F.col("event_type") == t).cast("bigint"))
    counts = (events.where("article_id is not null and article_id <> ''").groupBy("article_id")
              .agg(hits("view_article_detail").alias("v"), hits("open_trust_modal").alias("t"),
                   hits("click_feedback").alias("f")))
    known = articles.select(F.col("article_id").alias("known_id"), "title")
    joined = counts.join(known, F.col("article_id") == F.col("known_id"), "left")
    return (joined.groupBy("known_id", "title").agg(F.sum("v").alias("view_cnt"), F.sum("t").alias("trust_cnt"),
                                                    F.sum("f").alias("feedback_cnt"))
            .where("view_cnt > 0").orderBy(F.col("view_cnt").desc(), F.col("known_id").asc_nulls_last()).limit(limit)
            .select(F.coalesce("title", F.lit(K.DELETED_TITLE)).alias("title"), "view_cnt", "trust_cnt", "feedback_cnt"))


def _recent(events: DataFrame, as_of: str, days: int) -> DataFrame:
    days = max(1, min(90, days))
    since = F.date_format(F.date_sub(F.lit(as_of).cast("date"), days), "yyyy-MM-dd")
    return events.where(F.substring("created_at", 1, 10) >= since)


def _surface(events: DataFrame) -> DataFrame:
    return events.where(F.get_json_object("event_data", "$.source") == K.RECOMMENDATION_SURFACE)


def recommendation_funnel(events: DataFrame, as_of: str, days: int = 14) -> DataFrame:
    """Impression events, shown items, clicks and click-through rate of the recommendation surface."""
    rows = _surface(_recent(events, as_of, days).where(F.col("event_type").isin("impression", "click_article")))
    shown = F.col("event_type") == "impression"
    size = F.coalesce(F.size(F.from_json(F.get_json_object("event_data", "$.articles"), "array<string>")), F.lit(0))
    agg = rows.agg(F.count(F.when(shown, 1)).alias("impression_events"),
                   F.coalesce(F.sum(F.when(shown, size)), F.lit(0)).cast("bigint").alias("impression_items"),
                   F.count(F.when(~shown, 1)).alias("clicks"))
    return agg.withColumn("ctr", F.when(F.col("impression_items") > 0,
                                        F.round(F.col("clicks") / F.col("impression_items"), 4)))


def clicks_by_rec_source(events: DataFrame, as_of: str, days: int = 14) -> DataFrame:
    rows = _surface(_recent(events, as_of, days).where("event_type = 'click_article'"))
    source = F.coalesce(F.get_json_object("event_data", "$.rec_source"), F.lit("unknown"))
    return (rows.groupBy(source.alias("rec_source")).agg(F.count("*").alias("clicks"))
            .orderBy(F.col("clicks").desc(), "rec_source"))


def web_vitals_percentiles(events: DataFrame, as_of: str, hours: int = 24, exact: bool = True) -> DataFrame:
    """Page-speed percentiles per path over the last hours.

    ``percentile`` keeps one counter per distinct value and is merged map-side: bounded for times in
    milliseconds.  The layout shift is a continuous number, its percentile comes from positions over
    ranges.  ``exact=False`` uses the sketch for all.
    """
    field = lambda name, kind: F.get_json_object("event_data", f"$.{name}").cast(kind)
    rows = (events.where("event_type = 'client_performance'")
            .where(F.col("created_at") >= F.date_format(F.lit(as_of).cast("timestamp") - F.make_dt_interval(hours=F.lit(hours)), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))
            .select(F.get_json_object("event_data", "$.path").alias("path"), field("lcp_ms", "int").alias("lcp"),
                    field("cls", "double").alias("cls"), field("max_event_ms", "int").alias("inp"))
            .where("lcp is not null"))
    p = (lambda c, q: F.percentile(c, q)) if exact else (lambda c, q: F.percentile_approx(c, q, 10000).cast("double"))
    aggs = [p("lcp", 0.5).alias("lcp_p50"), p("lcp", 0.75).alias("lcp_p75"), p("lcp", 0.95).alias("lcp_p95"), p("inp", 0.75).alias("inp_p75"),
            F.count("*").alias("sample_count")]
    if not exact:
        return rows.groupBy("path").agg(*aggs, p("cls", 0.75).alias("cls_p75"))
    shift = exact_percentiles(rows, ["path"], "cls", {"cls_p75": 0.75})
    return rows.groupBy("path").agg(*aggs).join(shift, "path", "left")


def category_stats(articles: DataFrame, today: str) -> DataFrame:
    """Total, not analysed and published today per category, zero-filled to the fixed categories."""
    order = K.CATEGORY_DISPLAY_ORDER
    counts = (articles.where(has_listed_category(F.col("category"))).groupBy("category")
              .agg(F.count("article_id").alias("total"),
                   F.sum(F.coalesce((F.col("trust_score") == 0).cast("bigint"), F.lit(0))).alias("unanalyzed"),
                   F.sum(F.coalesce(F.startswith("published_at", F.lit(today)).cast("bigint"), F.lit(0))).alias("today_articles")))
    fixed = articles.sparkSession.createDataFrame([(c, i) for i, c in enumerate(order)], "category string, place int")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c)
    return (counts.join(F.broadcast(fixed), "category", "full_outer")
            .select("category", F.coalesce("place", F.lit(999)).alias("place"), zero("total"), zero("unanalyzed"),
                    zero("today_articles")).orderBy("place", "category"))


def missing_categories(articles: DataFrame) -> DataFrame:
    fixed = articles.sparkSession.createDataFrame([(c,) for c in K.CATEGORY_DISPLAY_ORDER], "category string")
    have = articles.where(has_listed_category(F.col("category"))).select("category").distinct()
    return fixed.join(have, "category", "left_anti").select(
        "category", *[F.lit(0).cast("bigint").alias(c) for c in ("total", "unanalyzed", "today_articles")])


def category_analysis_rate(stats: DataFrame) -> DataFrame:
    rate = F.when(F.col("total") > 0, (F.col("total") - F.col("unanalyzed")) / F.col("total") * 100).otherwise(0.0)
    return (stats.where(~F.col("category").isin(K.RATE_HIDDEN_CATEGORIES))
            .select("category", "total", "today_articles", half_up(rate).cast("bigint").alias("analyzed_pct")))


def source_list(articles: DataFrame) -> DataFrame:
    return articles.where("source is not null").select("source").distinct()


def article_totals(articles: DataFrame) -> DataFrame:
    return articles.agg(F.count("*").alias("total_articles"),
                        F.sum(F.coalesce((F.col("trust_score") == 0).cast("bigint"), F.lit(0))).alias("unanalyzed_count"))


def article_count(articles: DataFrame, category: str | None = None) -> DataFrame:
    if category:
        articles = articles.where(F.col("category") == category)
    return articles.agg(F.count("*").alias("n"))


def feedback_counts(feedback: DataFrame) -> DataFrame:
    return feedback.groupBy("feedback_type").agg(F.count("*").alias("n"))


def feedback_with_titles(feedback: DataFrame, articles: DataFrame) -> DataFrame:
    titles = articles.select("article_id", F.col("title").alias("article_title"))
    return (feedback.join(titles, "article_id")
            .select("feedback_id", "article_id", "article_title", "feedback_type", "created_at")
            .orderBy(F.col("created_at").desc(), "feedback_id"))


def recent_search_terms(searches: DataFrame, limit: int = 10) -> DataFrame:
    """The latest distinct terms per user.  Distinct by (user, term) first; the window only ranks those."""
    from pyspark.sql import Window as W
    last = (searches.select("user_id", F.trim("term").alias("term"), "created_at").where("user_id is not null and term <> ''")
            .groupBy("user_id", "term").agg(F.max("created_at").alias("last_at")))
    w = W.partitionBy("user_id").orderBy(F.col("last_at").desc(), "term")
    return last.withColumn("position", F.row_number().over(w)).where(F.col("position") <= limit)


def feedback_summary(articles: DataFrame, feedback: DataFrame) -> DataFrame:
    """Total, agreeing votes and agree rate per article (articles without votes keep a zero)."""
    votes = feedback.groupBy("article_id").agg(F.count("*").alias("n"),
                                               F.sum((F.col("feedback_type") == "like").cast("bigint")).alias("agree"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint")
    rate = F.round(F.coalesce(F.col("agree") / F.col("n"), F.lit(0.0)) * 100, 1)
    return articles.select("article_id", "title", "trust_verdict", "trust_score").join(votes, "article_id", "left").select(
        "article_id", "title", "trust_verdict", "trust_score", zero("n").alias("total_feedback"),
        zero("agree").alias("agree_count"), rate.alias("agree_rate"))


def agree_rate_by_verdict(summary: DataFrame) -> DataFrame:
    return (summary.groupBy("trust_verdict").agg(F.sum("total_feedback").alias("total_feedback"),
                                                 F.sum("agree_count").alias("agree_count"))
            .where("total_feedback > 0")
            .withColumn("agree_rate", F.round(F.col("agree_count") / F.col("total_feedback"), 4)))


def criteria_flag_counts(flags: DataFrame) -> DataFrame:
    """How often each criterion was disputed; input has an array column ``criteria_flags``."""
    return flags.select(F.explode("criteria_flags").alias("criterion")).groupBy("criterion").agg(F.count("*").alias("n"))


def low_agreement_articles(summary: DataFrame, limit: int = 10, min_votes: int = 1) -> DataFrame:
    return (summary.where(F.col("total_feedback") >= min_votes).orderBy("agree_rate", "article_id").limit(limit)
            .select("article_id", "title", "trust_verdict", "agree_rate"))


def trust_score_histogram(articles: DataFrame) -> DataFrame:
    """Ten-point buckets (100 belongs to the last one) with the share and the spread of all scores."""
    scored = articles.where("trust_score is not null")
    buckets = scored.groupBy(F.least(F.floor(F.col("trust_score") / 10), F.lit(9)).cast("int").alias("bucket")).agg(
        F.count("*").alias("n"))
    overall = scored.agg(F.stddev_samp("trust_score").alias("score_stddev"),
                         F.avg(F.col("trust_score").between(40, 70).cast("double")).alias("share_40_70"))
    return (buckets.withColumn("one", F.lit(1)).join(F.broadcast(overall.withColumn("one", F.lit(1))), "one")
            .select("bucket", "n", F.round("score_stddev", 6).alias("score_stddev"), F.round("share_40_70", 6).alias("share_40_70")))
