"""Queries: lists, pages, filters, table updates and dashboards."""
from __future__ import annotations

from pyspark.sql import functions as F

from .. import constants as K
from ..functions import payload as P
from ..operators import articles as A, dashboards as D, merges as M, sketches as SK
from ..schemas import LIST_COLUMNS, article_response
from ..sources import views as V
from .oracle_views import lst
from .registry import SAME, query

LIST = ", ".join(LIST_COLUMNS)
NEWEST = "ORDER BY published_at DESC, article_id"


@query("read_articles", f"SELECT article_id, title, source, url, published_at, trust_score, trust_verdict, category, length(full_text) AS chars FROM articles")
def _(spark, d):
    return V.articles(spark, d).select("article_id", "title", "source", "url", "published_at", "trust_score", "trust_verdict",
                                       "category", F.char_length("full_text").cast("bigint").alias("chars"))


@query("article_list_page", f"SELECT {LIST} FROM articles {NEWEST} LIMIT 20 OFFSET 40")
def _(spark, d):
    return A.list_page(V.articles(spark, d), 3, 20)


@query("article_list_page_by_category", f"SELECT {LIST} FROM articles WHERE category = '경제' {NEWEST} LIMIT 9 OFFSET 9")
def _(spark, d):
    return A.list_page(V.articles(spark, d), 2, 9, "경제")


@query("article_by_id", f"SELECT {LIST}, full_text FROM articles WHERE article_id = '17'")
def _(spark, d):
    return A.by_id(V.articles(spark, d), "17").select(*LIST_COLUMNS, "full_text")


@query("trust_by_id", """SELECT article_id, coalesce(trust_score, 0) AS trust_score, coalesce(trust_verdict, '') AS trust_verdict,
  '' AS trust_reason, '' AS trust_per_criteria FROM articles WHERE article_id = '13'""")
def _(spark, d):
    none = F.lit(None).cast("string")
    rows = V.articles(spark, d).withColumns({"trust_reason": none, "trust_per_criteria": none})
    return A.trust_by_id(rows, "13")


@query("articles_without_trust", "SELECT article_id, published_at FROM articles WHERE trust_score = 0")
def _(spark, d):
    return A.without_trust(V.articles(spark, d)).select("article_id", "published_at")


@query("articles_needing_keywords", """SELECT article_id FROM articles WHERE keywords IS NULL OR trim(keywords) IN ('', '[]')
  OR NOT json_valid(keywords) OR (json_type(keywords) = 'ARRAY' AND json_array_length(keywords) > 3)""")
def _(spark, d):
    return A.needing_keywords(V.articles(spark, d)).select("article_id")


@query("articles_for_stats", "SELECT article_id, source, category, published_at, trust_score FROM articles")
def _(spark, d):
    return A.for_stats(V.articles(spark, d))


_CLICKED = "SELECT DISTINCT article_id FROM event_log WHERE article_id IS NOT NULL AND event_type IN (" + lst(K.CLICKED_EVENTS)[1:-1] + ")"


@query("latest_excluding", f"SELECT {LIST} FROM articles WHERE article_id NOT IN ({_CLICKED}) {NEWEST} LIMIT 10")
def _(spark, d):
    return A.latest_excluding(V.articles(spark, d), _clicked(spark, d), 10)


@query("latest_by_categories", f"SELECT {LIST} FROM articles WHERE category IN ('정치', '세계') AND article_id NOT IN ({_CLICKED}) {NEWEST} LIMIT 10")
def _(spark, d):
    return A.latest_excluding(V.articles(spark, d), _clicked(spark, d), 10, ["정치", "세계"])


def _clicked(spark, d):
    e = V.event_log(spark, d)
    return e.where(F.col("article_id").isNotNull() & F.col("event_type").isin(K.CLICKED_EVENTS)).select("article_id").distinct()


@query("clicked_distinct", _CLICKED)
def _(spark, d):
    return _clicked(spark, d)


@query("valid_category_filter", "SELECT article_id, category FROM articles WHERE category IS NOT NULL AND category NOT IN ('미분류', '일반')")
def _(spark, d):
    return V.articles(spark, d).where(A.has_listed_category(F.col("category"))).select("article_id", "category")


@query("short_text_skip", "SELECT article_id, length(title) AS chars FROM articles WHERE length(trim(title)) >= 10")
def _(spark, d):
    return V.articles(spark, d).where(A.long_enough(F.col("title"), 10)).select(
        "article_id", F.char_length("title").cast("bigint").alias("chars"))


@query("date_range_filter", """SELECT article_id, published_at FROM articles
  WHERE category IS NULL OR published_at BETWEEN '2024-01-05 00:00' AND '2024-01-20 00:00'""")
def _(spark, d):
    rows = V.articles(spark, d)
    date = F.when(F.col("category").isNotNull(), F.col("published_at"))
    return rows.where(A.inside_dates(date, F.lit("2024-01-05 00:00"), F.lit("2024-01-20 00:00"))).select("article_id", "published_at")


@query("article_response", """SELECT article_id, coalesce(title, '') AS title, coalesce(source, '') AS source, url, published_at,
  coalesce(summary_text, '') AS summary_text, coalesce(keywords, '[]') AS keywords, coalesce(trust_score, 0) AS trust_score,
  coalesce(trust_verdict, '') AS trust_verdict, coalesce(category, '') AS category, CAST(-1 AS DOUBLE) AS score FROM articles""")
def _(spark, d):
    return article_response(V.articles(spark, d)).withColumn("score", F.coalesce("score", F.lit(-1.0)))


@query("top_pick", f"""SELECT article_id, trust_score FROM (SELECT article_id, coalesce(trust_score, 0) AS trust_score, published_at FROM articles {NEWEST} LIMIT 20)
  ORDER BY trust_score DESC, published_at DESC, article_id LIMIT 1""")
def _(spark, d):
    return A.top_pick(A.list_page(V.articles(spark, d), 1, 20)).select("article_id", F.coalesce("trust_score", F.lit(0)).alias("trust_score"))


@query("page_without_top_pick", f"""SELECT article_id FROM (SELECT article_id, coalesce(trust_score, 0) AS t, published_at FROM articles {NEWEST} LIMIT 20)
  ORDER BY t DESC, published_at DESC, article_id OFFSET 1""")
def _(spark, d):
    page = A.list_page(V.articles(spark, d), 1, 20)
    return A.without_top_pick(page, A.top_pick(page)).select("article_id")


@query("shuffle_sample", f"""SELECT article_id FROM (SELECT article_id, published_at FROM articles {NEWEST} LIMIT 20)
  ORDER BY sha256('7|' || article_id), article_id LIMIT 5""")
def _(spark, d):
    return A.shuffle_sample(A.list_page(V.articles(spark, d), 1, 20), 5, "7").select("article_id")


@query("head_total", f"SELECT article_id, published_at FROM articles {NEWEST} LIMIT 50")
def _(spark, d):
    return A.head_total(V.articles(spark, d).select("article_id", "published_at"), 50, A.newest_first())


# ---- dashboards ----------------------------------------------------------------------

_FUNNEL = """SELECT step_no, step, count(DISTINCT session_id) AS overall,
  count(DISTINCT CASE WHEN user_id IS NOT NULL THEN session_id END) AS member, count(DISTINCT CASE WHEN user_id IS NULL THEN session_id END) AS guest
  FROM (VALUES (0, 'visit_main'), (1, 'view_article_detail'), (2, 'open_trust_modal'), (3, 'click_feedback')) s(step_no, step)
  LEFT JOIN event_log ON event_type = step GROUP BY step_no, step"""


@query("session_funnel", _FUNNEL.replace("count(DISTINCT CASE WHEN user_id IS NULL THEN session_id END)", "count(DISTINCT CASE WHEN user_id IS NULL AND log_id IS NOT NULL THEN session_id END)"))
def session_funnel_query(spark, d):
    return D.session_funnel(V.event_log(spark, d))


@query("funnel_percentages", """SELECT f.step_no, f.step,
  CAST(greatest(floor(f.overall / CAST(greatest(b.overall, 1) AS DOUBLE) * 100 + 0.5), 2) AS BIGINT) AS overall_pct,
  CAST(greatest(floor(f.member / CAST(greatest(b.member, 1) AS DOUBLE) * 100 + 0.5), 2) AS BIGINT) AS member_pct,
  CAST(greatest(floor(f.guest / CAST(greatest(b.guest, 1) AS DOUBLE) * 100 + 0.5), 2) AS BIGINT) AS guest_pct
  FROM funnel_rows f, funnel_rows b WHERE b.step_no = 0""", {"funnel_rows": _FUNNEL})
def _(spark, d):
    return D.funnel_percentages(D.session_funnel(V.event_log(spark, d)))


def _das(order):
    return f"""SELECT day, substr(day, 6, 5) AS label, sessions FROM (SELECT substr(created_at, 1, 10) AS day, count(DISTINCT session_id) AS sessions
      FROM event_log WHERE created_at IS NOT NULL AND created_at <> '' GROUP BY 1) ORDER BY day {order} LIMIT 14"""


@query("daily_active_sessions", _das("ASC"))
def _(spark, d):
    return D.daily_active_sessions(V.event_log(spark, d))


@query("daily_active_sessions_latest", _das("DESC"))
def _(spark, d):
    return D.daily_active_sessions(V.event_log(spark, d), latest=True)


_RETIRED = """SELECT log_id, event_type, article_id FROM event_log
  UNION ALL SELECT 'r' || page_id, CASE WHEN page_id % 3 = 0 THEN 'open_trust_modal' ELSE 'view_article_detail' END, 'p' || page_id FROM pages"""


def _with_retired(spark, d):
    """The log, and events on articles that are not in the table any more: the given web pages, whose ids no article has."""
    page = F.col("page_id").cast("string")
    retired = V.table(spark, d, "pages").select(F.concat(F.lit("r"), page).alias("log_id"),
                                                F.when(F.col("page_id") % 3 == 0, "open_trust_modal").otherwise("view_article_detail").alias("event_type"),
                                                F.concat(F.lit("p"), page).alias("article_id"))
    return V.event_log(spark, d).select("log_id", "event_type", "article_id").unionByName(retired)


@query("top_viewed_articles", f"""SELECT coalesce(a.title, '{K.DELETED_TITLE}') AS title,
  count(CASE WHEN e.event_type = 'view_article_detail' THEN 1 END) AS view_cnt, count(CASE WHEN e.event_type = 'open_trust_modal' THEN 1 END) AS trust_cnt,
  count(CASE WHEN e.event_type = 'click_feedback' THEN 1 END) AS feedback_cnt
  FROM ({_RETIRED}) e LEFT JOIN articles a ON e.article_id = a.article_id WHERE e.article_id IS NOT NULL AND e.article_id <> ''
  GROUP BY a.article_id, a.title HAVING count(CASE WHEN e.event_type = 'view_article_detail' THEN 1 END) > 0
  ORDER BY view_cnt DESC, a.article_id NULLS LAST LIMIT 10""")
def _(spark, d):
    return D.top_viewed_articles(_with_retired(spark, d), V.articles(spark, d))


@query("events_left_article", f"""SELECT e.log_id, e.event_type, e.article_id, a.title FROM ({_RETIRED}) e
  LEFT JOIN articles a ON e.article_id = a.article_id WHERE e.article_id IS NOT NULL""")
def _(spark, d):
    a = V.articles(spark, d).select("article_id", "title")
    return _with_retired(spark, d).where("article_id is not null").join(a, "article_id", "left")


AS_OF = "2024-01-31"


@query("recommendation_funnel", """SELECT count(CASE WHEN event_type = 'impression' THEN 1 END) AS impression_events,
  CAST(coalesce(sum(CASE WHEN event_type = 'impression' THEN json_array_length(event_data, '$.articles') END), 0) AS BIGINT) AS impression_items,
  count(CASE WHEN event_type = 'click_article' THEN 1 END) AS clicks,
  round(count(CASE WHEN event_type = 'click_article' THEN 1 END) / CAST(sum(CASE WHEN event_type = 'impression' THEN json_array_length(event_data, '$.articles') END) AS DOUBLE), 4) AS ctr
  FROM event_log WHERE event_type IN ('impression', 'click_article') AND json_extract_string(event_data, '$.source') = 'personalized_recommendation'
  AND substr(created_at, 1, 10) >= '2024-01-17'""")
def _(spark, d):
    return D.recommendation_funnel(V.event_log(spark, d), AS_OF, 14)


@query("clicks_by_rec_source", """SELECT coalesce(json_extract_string(event_data, '$.rec_source'), 'unknown') AS rec_source, count(*) AS clicks
  FROM event_log WHERE event_type = 'click_article' AND json_extract_string(event_data, '$.source') = 'personalized_recommendation'
  AND substr(created_at, 1, 10) >= '2024-01-17' GROUP BY 1""")
def _(spark, d):
    return D.clicks_by_rec_source(V.event_log(spark, d), AS_OF, 14)


@query("web_vitals_percentiles", """SELECT path, quantile_cont(lcp_ms, 0.5) AS lcp_p50, quantile_cont(lcp_ms, 0.75) AS lcp_p75, quantile_cont(lcp_ms, 0.95) AS lcp_p95,
  quantile_cont(cls, 0.75) AS cls_p75, quantile_cont(max_event_ms, 0.75) AS inp_p75, count(*) AS sample_count
  FROM performance_log WHERE lcp_ms IS NOT NULL AND CAST(created_at AS TIMESTAMP) >= TIMESTAMP '2024-01-31' - INTERVAL 480 HOUR GROUP BY path""")
def _(spark, d):
    return D.web_vitals_percentiles(V.performance_log(spark, d), AS_OF, 480)


# Estimates, so no SQL: tests/test_sketches.py holds them against the exact forms.
@query("session_funnel_sketch")
def _(spark, d):
    return SK.funnel_estimate(SK.session_sketches(V.event_log(spark, d)))


@query("daily_active_sessions_sketch")
def _(spark, d):
    return SK.active_sessions_estimate(SK.session_sketches(V.event_log(spark, d)))


@query("web_vitals_sketch")
def _(spark, d):
    return SK.vitals_estimate(SK.speed_sketches(V.performance_log(spark, d)))


_CATS = f"""SELECT c.category, c.place, count(a.article_id) AS total, count(CASE WHEN a.trust_score = 0 THEN 1 END) AS unanalyzed,
  count(CASE WHEN starts_with(a.published_at, '2024-01-09') THEN 1 END) AS today_articles
  FROM (SELECT unnest({lst(K.CATEGORY_DISPLAY_ORDER)}) AS category, unnest([0, 1, 2, 3, 4, 5, 6, 7]) AS place) c LEFT JOIN articles a ON a.category = c.category GROUP BY 1, 2"""


@query("category_stats", _CATS)
def _(spark, d):
    return D.category_stats(V.articles(spark, d), "2024-01-09")


@query("category_analysis_rate", """SELECT category, total, today_articles, CAST(floor(CASE WHEN total > 0 THEN (total - unanalyzed) / CAST(total AS DOUBLE) * 100 ELSE 0 END + 0.5) AS BIGINT) AS analyzed_pct
  FROM cats WHERE category NOT IN ('연예', '스포츠')""", {"cats": _CATS})
def _(spark, d):
    return D.category_analysis_rate(D.category_stats(V.articles(spark, d), "2024-01-09"))


@query("missing_categories", f"""SELECT category, 0 AS total, 0 AS unanalyzed, 0 AS today_articles FROM (SELECT unnest({lst(K.CATEGORY_DISPLAY_ORDER)}) AS category)
  WHERE category NOT IN (SELECT category FROM articles WHERE category IS NOT NULL)""")
def _(spark, d):
    return D.missing_categories(V.articles(spark, d))


@query("source_list", "SELECT DISTINCT source FROM articles WHERE source IS NOT NULL")
def _(spark, d):
    return D.source_list(V.articles(spark, d))


@query("source_list_and_totals", "SELECT count(*) AS total_articles, count(CASE WHEN trust_score = 0 THEN 1 END) AS unanalyzed_count FROM articles")
def _(spark, d):
    return D.article_totals(V.articles(spark, d))


@query("article_count", "SELECT count(*) AS n FROM articles WHERE category = '사회'")
def _(spark, d):
    return D.article_count(V.articles(spark, d), "사회")


@query("feedback_counts", "SELECT feedback_type, count(*) AS n FROM feedback GROUP BY 1")
def _(spark, d):
    return D.feedback_counts(V.feedback(spark, d))


@query("feedback_article_join", """SELECT feedback_id, f.article_id, a.title AS article_title, feedback_type, created_at
  FROM feedback f JOIN articles a ON f.article_id = a.article_id""")
def _(spark, d):
    return D.feedback_with_titles(V.feedback(spark, d), V.articles(spark, d))


@query("recent_search_terms", """SELECT * FROM (SELECT user_id, trim(term) AS term, max(created_at) AS last_at,
  row_number() OVER (PARTITION BY user_id ORDER BY max(created_at) DESC, trim(term)) AS position FROM search_log GROUP BY 1, 2) WHERE position <= 10""")
def _(spark, d):
    return D.recent_search_terms(V.search_log(spark, d))


_SUMMARY = """SELECT a.article_id, title, trust_verdict, trust_score, count(f.feedback_id) AS total_feedback,
  CAST(coalesce(sum(CASE WHEN feedback_type = 'like' THEN 1 ELSE 0 END), 0) AS BIGINT) AS agree_count,
  round(coalesce(sum(CASE WHEN feedback_type = 'like' THEN 1 ELSE 0 END) / CAST(nullif(count(f.feedback_id), 0) AS DOUBLE), CAST(0 AS DOUBLE)) * 100, 1) AS agree_rate
  FROM articles a LEFT JOIN feedback f ON a.article_id = f.article_id GROUP BY 1, 2, 3, 4"""


def _summary(spark, d):
    return D.feedback_summary(V.articles(spark, d), V.feedback(spark, d))


@query("feedback_summary", _SUMMARY)
def _(spark, d):
    return _summary(spark, d)


@query("agree_rate_by_verdict", """SELECT trust_verdict, CAST(sum(total_feedback) AS BIGINT) AS total_feedback, CAST(sum(agree_count) AS BIGINT) AS agree_count,
  round(sum(agree_count) / CAST(sum(total_feedback) AS DOUBLE), 4) AS agree_rate FROM summary_rows GROUP BY 1 HAVING sum(total_feedback) > 0""", {"summary_rows": _SUMMARY})
def _(spark, d):
    return D.agree_rate_by_verdict(_summary(spark, d))


@query("low_agreement_articles", "SELECT article_id, title, trust_verdict, agree_rate FROM summary_rows WHERE total_feedback >= 1 ORDER BY agree_rate, article_id LIMIT 10", {"summary_rows": _SUMMARY})
def _(spark, d):
    return D.low_agreement_articles(_summary(spark, d))


_C = lst(K.CRITERIA)


@query("criteria_flag_counts", f"""SELECT criterion, count(*) AS n FROM (SELECT unnest(list_distinct([{_C}[CAST(article_id AS INTEGER) % 5 + 1], {_C}[CAST(feedback_id AS BIGINT) % 5 + 1]])) AS criterion
  FROM feedback WHERE feedback_type = 'dislike') GROUP BY 1""")
def _(spark, d):
    pick = lambda c: F.element_at(F.array(*[F.lit(x) for x in K.CRITERIA]), (F.col(c).cast("bigint") % 5).cast("int") + 1)
    flags = V.feedback(spark, d).where("feedback_type = 'dislike'").select(
        F.array_distinct(F.array(pick("article_id"), pick("feedback_id"))).alias("criteria_flags"))
    return D.criteria_flag_counts(flags)


@query("trust_score_histogram", """SELECT bucket, n, round(s, 6) AS score_stddev, round(p, 6) AS share_40_70 FROM
  (SELECT CAST(least(trust_score // 10, 9) AS INTEGER) AS bucket, count(*) AS n FROM articles WHERE trust_score IS NOT NULL GROUP BY 1),
  (SELECT stddev_samp(trust_score) AS s, avg(CASE WHEN trust_score BETWEEN 40 AND 70 THEN 1.0 ELSE 0.0 END) AS p FROM articles WHERE trust_score IS NOT NULL)""")
def _(spark, d):
    return D.trust_score_histogram(V.articles(spark, d))


# ---- table updates -------------------------------------------------------------------

def _incoming(spark, d):
    """Re-delivered French articles plus as many new ones, with changed text and new vectors."""
    a = V.articles(spark, d).where("lang = 'fr'")
    changed = a.withColumns({"title": F.concat(F.lit("new "), "title"), "embed_summary": F.lit("[9]")})
    return changed.unionByName(changed.withColumn("article_id", F.concat(F.lit("n"), "article_id")))


@query("upsert_articles", """SELECT coalesce(a.article_id, inc.article_id) AS article_id, CASE WHEN inc.article_id IS NOT NULL THEN inc.title ELSE a.title END AS title,
  CASE WHEN a.article_id IS NOT NULL THEN '[1]' ELSE '[9]' END AS embed_summary FROM articles a FULL JOIN inc ON a.article_id = inc.article_id""",
       {"inc": """SELECT article_id, 'new ' || title AS title FROM articles WHERE lang = 'fr'
  UNION ALL SELECT 'n' || article_id, 'new ' || title FROM articles WHERE lang = 'fr'"""})
def _(spark, d):
    stored = V.articles(spark, d).drop("lang").withColumn("embed_summary", F.lit("[1]"))
    return M.upsert_articles(stored, _incoming(spark, d)).select("article_id", "title", "embed_summary")


@query("upsert_chunks", """SELECT chunk_id, article_id, CASE WHEN CAST(chunk_id AS INTEGER) % 3 = 0 THEN 'edited' ELSE chunk_text END AS chunk_text FROM chunks
  UNION ALL SELECT 'n' || chunk_id, 'x', 'edited' FROM chunks WHERE CAST(chunk_id AS INTEGER) % 3 = 0""")
def _(spark, d):
    c = V.chunks(spark, d)
    edit = c.where(F.col("chunk_id").cast("int") % 3 == 0).withColumns({"chunk_text": F.lit("edited"), "article_id": F.lit("x")})
    new = edit.withColumn("chunk_id", F.concat(F.lit("n"), "chunk_id"))
    return M.upsert_chunks(c, edit.unionByName(new)).select("chunk_id", "article_id", "chunk_text")


@query("insert_if_absent", """SELECT article_id, title FROM articles UNION ALL SELECT 'n' || article_id, 'new ' || title FROM articles WHERE lang = 'fr'""")
def _(spark, d):
    return M.insert_if_absent(V.articles(spark, d).select("article_id", "title"), _incoming(spark, d), "article_id")


@query("update_trust", """SELECT a.article_id, CASE WHEN t.article_id IS NOT NULL THEN t.score ELSE a.trust_score END AS trust_score,
  CASE WHEN t.article_id IS NOT NULL THEN t.verdict ELSE a.trust_verdict END AS trust_verdict
  FROM articles a LEFT JOIN (SELECT * FROM trust_rows) t ON a.article_id = t.article_id AND a.trust_score = 0""")
def _(spark, d):
    from ..plans import trust as T
    todo = A.without_trust(V.articles(spark, d)).select("article_id")
    scores = T.score_trust_table(V.answers(spark, d).join(todo, "article_id", "left_semi")).select(
        "article_id", F.col("score").alias("trust_score"), F.col("verdict").alias("trust_verdict"),
        F.col("reason").alias("trust_reason"), F.to_json("per_criteria").alias("trust_per_criteria"))
    none = F.lit(None).cast("string")
    stored = V.articles(spark, d).withColumns({"trust_reason": none, "trust_per_criteria": none})
    return M.update_trust(stored, scores).select("article_id", "trust_score", "trust_verdict")


@query("update_learned_embedding", """SELECT a.article_id, round(coalesce(list_sum(l.learned_embedding), CAST(0 AS DOUBLE)), 6) AS vector_sum
  FROM articles a LEFT JOIN learned_vectors l ON a.article_id = l.article_id AND CAST(l.article_id AS INTEGER) % 10 <> 0""")
def _(spark, d):
    stored = V.articles(spark, d).select("article_id", F.lit(None).cast("array<double>").alias("learned_embedding"))
    v = V.learned_vectors(spark, d).withColumn("learned_embedding", F.when(F.col("article_id").cast("int") % 10 != 0, F.col("learned_embedding")))
    out = M.update_learned_embedding(stored, v)
    return out.select("article_id", F.round(F.coalesce(F.aggregate("learned_embedding", F.lit(0.0), lambda s, x: s + x), F.lit(0.0)), 6).alias("vector_sum"))


@query("reset_trust", "SELECT article_id, 0 AS trust_score, 'unanalyzed' AS trust_verdict FROM articles")
def _(spark, d):
    return M.reset_trust(V.articles(spark, d)).select("article_id", "trust_score", "trust_verdict")


@query("delete_cascade", """SELECT 'articles' AS part, count(*) AS n FROM articles WHERE coalesce(lang, '') <> 'fr'
  UNION ALL SELECT 'chunks', count(*) FROM chunks WHERE article_id NOT IN (SELECT article_id FROM articles WHERE lang = 'fr')
  UNION ALL SELECT 'feedback', count(*) FROM feedback WHERE article_id NOT IN (SELECT article_id FROM articles WHERE lang = 'fr')""")
def _(spark, d):
    a = V.articles(spark, d)
    left = M.delete_cascade({"articles": a, "chunks": V.chunks(spark, d), "feedback": V.feedback(spark, d)}, a.where("lang = 'fr'"))
    parts = [t.agg(F.lit(n).alias("part"), F.count("*").alias("n")) for n, t in left.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("delete_without_keywords", """SELECT count(*) FILTER (keywords IS NULL OR keywords IN ('', '[]')) AS deleted,
  count(*) FILTER (NOT (keywords IS NULL OR keywords IN ('', '[]'))) AS kept FROM articles""")
def _(spark, d):
    a = V.articles(spark, d)
    gone = M.without_keywords(a)
    left = M.delete_cascade({"articles": a}, gone)["articles"]
    return gone.agg(F.count("*").alias("deleted"), F.lit(1).alias("one")).join(
        left.agg(F.count("*").alias("kept"), F.lit(1).alias("one")), "one").drop("one")


@query("replace_feedback", """SELECT feedback_id, article_id, user_id, feedback_type, created_at FROM (SELECT *, row_number() OVER (PARTITION BY article_id, user_id ORDER BY created_at DESC, feedback_id DESC) AS n FROM feedback) WHERE n = 1""")
def _(spark, d):
    raw = V.feedback(spark, d).drop("user_id").withColumnRenamed("raw_user_id", "user_id")
    return M.replace_feedback(raw, V.users(spark, d))


@query("user_exists_semi", "SELECT feedback_id, user_id FROM feedback")
def _(spark, d):
    raw = V.feedback(spark, d).drop("user_id").withColumnRenamed("raw_user_id", "user_id")
    return M.safe_users(raw, V.users(spark, d)).select("feedback_id", "user_id")


@query("append_event", """SELECT log_id, session_id, event_type, article_id, created_at, user_id,
  '{"api_key": "[REDACTED]", "nested": {"Token": "[REDACTED]", "n": [' || length(log_id) || ', "ok"]}, "payload": ' || replace(replace(event_data, '":', '": '), ',"', ', "') || '}' AS event_data
  FROM (SELECT * REPLACE (replace(event_data, '},{', '}, {') AS event_data) FROM event_log)""")
def _(spark, d):
    return M.prepare_events(V.raw_events(spark, d), V.users(spark, d)).select(
        "log_id", "session_id", "event_type", "article_id", "event_data", "created_at", "user_id")


@query("append_event_log", """SELECT CASE WHEN CAST(log_id AS BIGINT) % 3 = 0 THEN 'new' ELSE log_id END AS log_id, session_id, event_type, article_id,
  CASE WHEN CAST(log_id AS BIGINT) % 7 = 0 THEN '2024-05-01T00:00:00.000000' ELSE created_at END AS created_at, user_id FROM event_log""")
def _(spark, d):
    """Every third event comes without an id, every seventh without a time; half of them are sent twice."""
    from ..session import new_path
    n = F.col("log_id").cast("bigint")
    raw = V.raw_events(spark, d).withColumns({"created_at": F.when(n % 7 != 0, F.col("created_at")), "part": n % 2, "log_id": F.when(n % 3 != 0, F.col("log_id"))}).drop("event_time")
    path, at, users = new_path(spark, "event-log"), F.lit("2024-05-01").cast("timestamp"), V.users(spark, d)
    M.append_events(raw.where("part = 0").drop("part"), users, path, at)
    M.append_events(raw.where("part = 1 or (part = 0 and log_id is not null)").drop("part"), users, path, at)
    log = spark.read.parquet(path)
    return log.select(F.when(F.col("log_id").startswith("e-"), "new").otherwise(F.col("log_id")).alias("log_id"), "session_id", "event_type", "article_id", "created_at", "user_id")


@query("normalize_impression", """SELECT log_id, article_id AS item_id, position FROM shown""")
def _(spark, d):
    e = V.event_log(spark, d).where("event_type = 'impression'")
    return M.normalize_impressions(e).select("log_id", F.inline("items")).select("log_id", F.col("article_id").alias("item_id"), "position")


@query("impression_ids", "SELECT log_id, string_agg(article_id, ',' ORDER BY position) AS ids FROM shown GROUP BY log_id")
def _(spark, d):
    e = V.event_log(spark, d).where("event_type = 'impression'")
    return e.select("log_id", F.array_join(P.impression_ids(F.col("event_data")), ",").alias("ids"))


@query("impression_negatives", """SELECT article_id, created_at, log_id, position FROM shown WHERE user_id = '7' AND article_id NOT IN (SELECT article_id FROM event_log
  WHERE article_id IS NOT NULL AND user_id = '7' AND event_type IN (""" + lst(K.CLICKED_EVENTS)[1:-1] + """)) ORDER BY created_at DESC, log_id, position LIMIT 20""")
def _(spark, d):
    from ..plans import history as H
    return H.impression_negatives(V.event_log(spark, d), user_id="7", limit=20)


# ---- saved tables ----------------------------------------------------------------------

def _log_by_day(spark, d):
    """The whole event table, appended in two halves to a log by day."""
    from ..operators.event_log import EventLog
    from ..session import new_path
    raw = V.raw_events(spark, d).drop("event_time")
    users, half = V.users(spark, d), F.col("log_id").cast("bigint") % 2
    log = EventLog(spark, new_path(spark, "event-log"), M.prepare_events(raw, users).schema)
    log.append(raw.where(half == 0), users)
    log.append(raw, users)
    return log


@query("event_log_by_day", """SELECT substr(created_at, 1, 10) AS day, event_type, count(*) AS events, count(DISTINCT log_id) AS ids, count(user_id) AS with_user
  FROM event_log WHERE substr(created_at, 1, 10) >= '2024-01-17' GROUP BY 1, 2""")
def _(spark, d):
    log = _log_by_day(spark, d).read(since="2024-01-17")
    return log.groupBy(F.substring("created_at", 1, 10).alias("day"), "event_type").agg(
        F.count("*").alias("events"), F.count_distinct("log_id").alias("ids"), F.count("user_id").alias("with_user"))


def _in_buckets(rows, key):
    from ..operators.bucketed import create_table
    from ..session import new_path
    return create_table(rows, new_path(rows.sparkSession, "buckets"), key)


@query("upsert_articles_in_buckets", *SAME["upsert_articles"])
def _(spark, d):
    table = _in_buckets(V.articles(spark, d).drop("lang").withColumn("embed_summary", F.lit("[1]")), "article_id")
    table.upsert(_incoming(spark, d).select("article_id", "title", "embed_summary"), keep=M.KEEP_ON_CONFLICT)
    return table.read().select("article_id", "title", "embed_summary")


@query("upsert_chunks_in_buckets", *SAME["upsert_chunks"])
def _(spark, d):
    c = V.chunks(spark, d)
    edit = c.where(F.col("chunk_id").cast("int") % 3 == 0).withColumns({"chunk_text": F.lit("edited"), "article_id": F.lit("x")})
    table = _in_buckets(c, "chunk_id")
    table.upsert_chunks(edit.unionByName(edit.withColumn("chunk_id", F.concat(F.lit("n"), "chunk_id"))))
    return table.read().select("chunk_id", "article_id", "chunk_text")


@query("delete_cascade_in_buckets", *SAME["delete_cascade"])
def _(spark, d):
    from ..operators.bucketed import delete_cascade
    a = V.articles(spark, d)
    tables = {"articles": _in_buckets(a.select("article_id", "title", "lang"), "article_id"), "chunks": _in_buckets(V.chunks(spark, d).select("chunk_id", "article_id"), "article_id"),
              "feedback": _in_buckets(V.feedback(spark, d), "article_id")}
    delete_cascade(tables, a.where("lang = 'fr'").select("article_id"))
    parts = [t.read().agg(F.lit(n).alias("part"), F.count("*").alias("n")) for n, t in tables.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])
