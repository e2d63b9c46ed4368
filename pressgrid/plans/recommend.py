"""Recommendations for a table of requests (request_id, session_id, user_id).

Every stage is a table keyed by request.  Per request the state is bounded (at most 40
history rows, 3 x limit candidates), so windows and arrays per request stay small; the
"newest articles" every request may need are one bounded list that is broadcast.
"""
from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .. import constants as K
from ..functions import vectors as X
from ..functions.text import descending_text
from ..operators.vector_index import VectorIndex
from ..operators.vector_topk import cosine_topk
from ..session import write_once
from . import encoders as E, search as S
from .history import recent_history

MAX_HISTORY = 2 * K.HISTORY_SIZE


def merged_history(requests: DataFrame, events: DataFrame, feedback: DataFrame, articles: DataFrame, strict: bool = True) -> DataFrame:
    """(request_id, src, pos, article_id, category, hpos): session history, then user history, first
    occurrence per article.  ``src`` is 0 for the session and 1 for the user."""
    return merge_histories(both_histories(requests, events, feedback, articles, strict))


def merge_histories(raw: DataFrame) -> DataFrame:
    first = W.partitionBy("request_id", "article_id").orderBy("src", "pos")
    order = W.partitionBy("request_id").orderBy("src", "pos")
    # one shuffle serves both windows
    return (raw.repartition("request_id").withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
            .withColumn("hpos", F.row_number().over(order)))


def both_histories(requests, events, feedback, articles, strict: bool = True) -> DataFrame:
    s = recent_history(events, feedback, articles, "session_id", strict=strict).withColumnRenamed("subject", "session_id")
    u = recent_history(events, feedback, articles, "user_id").withColumnRenamed("subject", "user_id")
    cols = ["request_id", "src", "pos", "article_id", "category"]
    return (requests.join(s, "session_id").withColumn("src", F.lit(0)).select(*cols)
            .unionByName(requests.join(u, "user_id").withColumn("src", F.lit(1)).select(*cols)))


def profile_vectors(histories: DataFrame, vectors: DataFrame, dim: int = 64) -> DataFrame:
    """(request_id, profile): session and user profile blended 0.65 / 0.35; all-zero profiles dropped."""
    both = E.recency_weighted_sides(histories, vectors, "request_id", "src", F.col("pos") - 1, dim)
    out = both.select("request_id", X.blend_vectors(F.col("s"), F.col("u"), K.SHORT_TERM_WEIGHT).alias("profile"))
    return out.where(X.has_length(F.col("profile")))


def _without_excluded(rows: DataFrame, history: DataFrame) -> DataFrame:
    """Rows without the reads that must not come back, the five newest; a request's rows stay in one partition."""
    read = history.where(F.col("hpos") <= K.RECENT_EXCLUDED).groupBy("request_id").agg(F.collect_set("article_id").alias("_read"))
    return rows.join(read, "request_id", "left").where(~F.coalesce(F.array_contains("_read", F.col("article_id")), F.lit(False))).drop("_read")


def profile_candidates(profiles: DataFrame, chunks: DataFrame, articles: DataFrame, history: DataFrame, limit: int, index: VectorIndex | None = None) -> DataFrame:
    """(request_id, article_id, score): semantic search from the profile, 3 x limit, newest reads removed; one profile a request."""
    found = S.semantic_search(profiles.select(F.col("request_id").alias("query_id"), F.col("profile").alias("query_vector")),
                              chunks, articles, limit * 3, K.RELEVANCE_FLOOR, index=index, unique=True)
    rows = found.select(F.col("query_id").alias("request_id"), "article_id", "score")
    return _without_excluded(rows, history)


def encoder_candidates(user_vectors: DataFrame, learned: DataFrame, history: DataFrame, limit: int, index: VectorIndex | None = None) -> DataFrame:
    """(request_id, article_id, score, rank): learned-space top 2 x limit outside the newest reads; one vector a request."""
    hits = cosine_topk(user_vectors.select(F.col("request_id").alias("qid"), F.col("user_vector").alias("qvec")),
                       index or S.learned_rows(learned),
                       limit * 2 + K.RECENT_EXCLUDED, unique=True)
    rows = hits.select(F.col("qid").alias("request_id"), F.col("cid").alias("article_id"), "score")
    w = W.partitionBy("request_id").orderBy(F.col("score").desc(), "article_id")
    return (_without_excluded(rows, history)
            .withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit * 2))


def category_recency_weights(history: DataFrame, by: list[str], age: Column) -> DataFrame:
    """(by, category, weight): sum of 0.5^(age / 5) over the latest 20 reads."""
    return (history.withColumn("_age", age).where(F.col("_age") < K.HISTORY_SIZE)
            .groupBy(*by, F.coalesce("category", F.lit("unknown")).alias("category"))
            .agg(F.sum(F.pow(F.lit(0.5), F.col("_age") / K.RECENCY_HALF_LIFE)).alias("weight")))


def minmax(value: Column, w) -> Column:
    low, high = F.min(value).over(w), F.max(value).over(w)
    return F.when(high - low <= 1e-12, F.lit(0.0)).otherwise((value - low) / (high - low))


def freshness_rank(by: list[str]) -> Column:
    """Index of the date text among the distinct sorted date texts of the set."""
    return F.dense_rank().over(W.partitionBy(*by).orderBy("published_at")) - 1


def rerank_components(rows: DataFrame, weights: DataFrame | None, by: list[str]) -> DataFrame:
    """Adds min-maxed semantic, category, trust and freshness components per set.

    ``rows``: by, article_id, score, category, trust_score, published_at.
    """
    cat = F.coalesce("category", F.lit("unknown"))
    r = rows.withColumn("category", cat)
    if weights is not None:  # else the rows carry their category's weight
        r = r.join(weights, [*by, "category"], "left")
    r = r.withColumn("weight", F.coalesce("weight", F.lit(0.0)))
    r = r.withColumns({"published_at": F.coalesce("published_at", F.lit("")),
                       "_sem": F.coalesce(F.col("score").cast("double"), F.lit(0.0)),
                       "_tru": F.coalesce(F.col("trust_score").cast("double"), F.lit(0.0)) / 100.0})
    w = W.partitionBy(*by)
    r = r.withColumn("_fr", freshness_rank(by).cast("double"))
    return r.withColumns({"semantic": minmax(F.col("_sem"), w), "interest": minmax(F.col("weight"), w),
                          "trust": minmax(F.col("_tru"), w), "freshness": minmax(F.col("_fr"), w),
                          "set_size": F.count("*").over(w)}).drop("_sem", "_tru", "_fr", "weight")


def rerank_hybrid(rows: DataFrame, weights: DataFrame | None, by: list[str]) -> DataFrame:
    """Adds ``rank_score`` and the position ``pos`` (score desc, article id desc)."""
    a, b, c, d = K.RERANK_WEIGHTS
    score = F.round(F.col("semantic") * a + F.col("interest") * b + F.col("trust") * c + F.col("freshness") * d, 9)
    r = rerank_components(rows, weights, by).withColumn("rank_score", score)
    order = W.partitionBy(*by).orderBy(F.col("rank_score").desc(), F.col("article_id").desc())
    return r.withColumn("pos", F.row_number().over(order))


def category_cap(limit: int) -> int:
    return max(2, math.ceil(limit * K.MAX_CATEGORY_SHARE))


def diversify(rows: DataFrame, by: list[str], limit: int) -> DataFrame:
    """Reorders ``pos``: rows within the category share first, the overflow after them."""
    if limit <= 2:
        return rows
    inside = W.partitionBy(*by, F.coalesce("category", F.lit("unknown"))).orderBy("pos")
    over = (F.row_number().over(inside) > category_cap(limit)).cast("int")
    order = W.partitionBy(*by).orderBy("_over", "pos")
    return rows.withColumn("_over", over).withColumn("pos", F.row_number().over(order)).drop("_over")


def is_low_trust(score: Column) -> Column:
    """Analysed and below the threshold; 0 and null are not analysed, hence not low."""
    s = F.coalesce(score, F.lit(0))
    return (s > 0) & (s < K.LOW_TRUST_BELOW)


def trust_guardrail(rows: DataFrame, by: list[str]) -> DataFrame:
    order = W.partitionBy(*by).orderBy(is_low_trust(F.col("trust_score")).cast("int"), "pos")
    return rows.withColumn("pos", F.row_number().over(order))


_ITEM = "struct<article_id: string, category: string, rec_source: string, rec_score: double>"


def _item(source: Column, score: Column) -> Column:
    return F.struct(F.col("article_id"), F.col("category"), source.alias("rec_source"), score.cast("double").alias("rec_score"))


def _as_list(rows: DataFrame, source: str, limit: int, score: Column) -> DataFrame:
    """(request_id, items): at most ``limit`` items per request in ``pos`` order."""
    kept = rows.where(F.col("pos") <= limit).withColumn("_i", F.struct("pos", _item(F.lit(source), score).alias("i")))
    return kept.groupBy("request_id").agg(F.transform(F.array_sort(F.collect_list("_i")), lambda s: s["i"]).alias("items"))


def newest_list(articles: DataFrame, size: int) -> DataFrame:
    """One row: the ``size`` newest articles as an ordered array."""
    top = articles.select("article_id", "category", "published_at").orderBy(F.col("published_at").desc(), "article_id").limit(size)
    key = F.struct("published_at", "article_id", "category")
    newest = lambda a, b: (F.when(a["published_at"] > b["published_at"], -1).when(a["published_at"] < b["published_at"], 1)
                           .when(a["article_id"] < b["article_id"], -1).when(a["article_id"] > b["article_id"], 1).otherwise(0))
    return top.agg(F.array_sort(F.collect_list(key), newest).alias("newest")).withColumn("_o", F.lit(1))


def _plain(items: Column, source: str) -> Column:
    return F.transform(items, lambda a: F.struct(a["article_id"].alias("article_id"), a["category"].alias("category"),
                                                 F.lit(source).alias("rec_source"), F.lit(None).cast("double").alias("rec_score")))


def _ids(items: Column) -> Column:
    return F.transform(items, lambda a: a["article_id"])


#: Rows up to which the newest articles of all categories are broadcast.
BROADCAST_ROWS = 100_000


def category_fallback(histories: DataFrame, articles: DataFrame, limit: int) -> DataFrame:
    """(request_id, article_id, category, trust_score, pos): newest unread articles of the read categories.

    Per category only the newest limit + 40 rows can matter (a history has at most 40 rows), so
    the join is against a small table.
    """
    newest = W.partitionBy("category").orderBy(F.col("published_at").desc(), "article_id")
    top = (articles.where("category is not null").select("article_id", "category", "published_at", "trust_score")
           .withColumn("_n", F.row_number().over(newest)).where(F.col("_n") <= limit + MAX_HISTORY).drop("_n"))
    # in ascending order the newest come first, rows without a date last
    key = F.struct(F.col("published_at").isNull().alias("undated"), descending_text(F.col("published_at")).alias("newest"), "article_id", "category", "published_at", "trust_score")
    top = write_once(top.groupBy("category").agg(F.array_sort(F.collect_list(key)).alias("newest")), "newest")
    if top.agg(F.coalesce(F.sum(F.size("newest")), F.lit(0))).first()[0] <= BROADCAST_ROWS:
        # a handful of categories are hot keys: requests stay where they are
        top = F.broadcast(top)
    # a request stays one row: its reads are taken out of the lists, and only limit articles are left of each
    wanted = histories.groupBy("request_id").agg(F.collect_set("article_id").alias("read"), F.collect_set("category").alias("categories"))
    rows = wanted.select("request_id", "read", F.explode("categories").alias("category")).join(top, "category")
    unread = F.slice(F.filter("newest", lambda a: ~F.coalesce(F.array_contains("read", a["article_id"]), F.lit(False))), 1, limit)
    found = rows.select("request_id", unread.alias("unread")).groupBy("request_id").agg(F.flatten(F.collect_list("unread")).alias("found"))
    out = found.select("request_id", F.posexplode(F.slice(F.array_sort("found"), 1, limit)).alias("p", "a"))
    return out.select("request_id", "a.article_id", "a.category", "a.published_at", "a.trust_score", (F.col("p") + 1).alias("pos"))


def latest_fallback(requests: DataFrame, history: DataFrame, articles: DataFrame, limit: int) -> DataFrame:
    """(request_id, pos, article_id): newest articles the request has not read."""
    read = history.groupBy("request_id").agg(F.collect_set("article_id").alias("read"))
    base = requests.select("request_id").join(read, "request_id", "left").withColumn("read", F.coalesce("read", F.array().cast("array<string>")))
    out = base.withColumn("_o", F.lit(1)).join(F.broadcast(newest_list(articles, limit + MAX_HISTORY)), "_o")
    fresh = F.slice(F.filter("newest", lambda a: ~F.array_contains("read", a["article_id"])), 1, limit)
    return out.select("request_id", F.posexplode(_ids(fresh)).alias("p", "article_id")).select("request_id", (F.col("p") + 1).alias("pos"), "article_id")


def _with_articles(rows: DataFrame, articles: DataFrame, index: VectorIndex | None = None) -> DataFrame:
    """Rows with the columns of their articles; ``index``: they are units of it, so where it has few they come to the rows."""
    shown = articles.select("article_id", "category", "trust_score", "published_at")
    if index is not None and index.units.sum() <= BROADCAST_ROWS:
        shown = write_once(shown.join(index.vectors.select(F.col("unit").alias("article_id")).distinct(), "article_id", "left_semi"), "shown")
        if shown.count() <= BROADCAST_ROWS:
            shown = F.broadcast(shown)
    return rows.join(shown, "article_id")


def ranked_profile(requests, events, feedback, articles, vectors, chunks, limit: int, dim: int = 64, strict: bool = True, index: VectorIndex | None = None):
    """(history, reranked profile candidates) of all requests."""
    # at most 40 rows per request; read by several stages, so written once
    raw = write_once(both_histories(requests, events, feedback, articles, strict))
    history = merge_histories(raw)
    cand = profile_candidates(profile_vectors(raw, vectors, dim), chunks, articles, history, limit, index)
    # a request's weights are one row, so candidates are dealt by request once, for all that follows
    weights = category_recency_weights(history, ["request_id"], F.col("hpos") - 1).groupBy("request_id").agg(
        F.map_from_entries(F.collect_list(F.struct("category", "weight"))).alias("_weights"))
    rows = _with_articles(cand, articles, index).join(weights, "request_id", "left")
    rows = rows.withColumn("weight", F.col("_weights")[F.coalesce("category", F.lit("unknown"))]).drop("_weights")
    return history, rerank_hybrid(rows, None, ["request_id"])


def recommend(requests: DataFrame, events: DataFrame, feedback: DataFrame, articles: DataFrame, vectors: DataFrame,
              chunks: DataFrame, limit: int = 10, user_vectors: DataFrame | None = None, learned: DataFrame | None = None,
              dim: int = 64, strict: bool = True, index: VectorIndex | None = None, learned_index: VectorIndex | None = None) -> DataFrame:
    """(request_id, pos, article_id, rec_source, rec_score) for every request.

    encoder (when ``user_vectors`` and ``learned`` are given) -> profile -> category -> latest.
    Encoder and profile lists are diversified, guarded, cut, filled and get an explore slot.
    ``index`` and ``learned_index``: saved indexes of the known chunks and of the learned vectors.
    """
    history, profiled = ranked_profile(requests, events, feedback, articles, vectors, chunks, limit, dim, strict, index)
    rows = profiled.withColumn("_src", F.lit("profile"))
    if user_vectors is not None and learned is not None:
        enc = _with_articles(encoder_candidates(user_vectors, learned, history, limit, learned_index), articles).withColumn("pos", F.col("rank"))
        cols = ["request_id", "article_id", "category", "trust_score", "score", "pos"]
        enc = enc.select(*cols, F.lit("encoder").alias("_src"))
        rows = enc.unionByName(rows.join(enc.select("request_id").distinct(), "request_id", "left_anti").select(*cols, "_src"))
    by = ["request_id"]
    ordered = write_once(trust_guardrail(diversify(rows, by, limit), by).where(F.col("pos") <= limit)
                          .select("request_id", "pos", "article_id", "category", "score", "_src"))
    source = ordered.groupBy("request_id").agg(F.first("_src").alias("src"))
    main = _as_list(ordered, "", limit, F.round("score", 4)).join(source, "request_id")
    main = main.select("request_id", F.transform("items", lambda i: i.withField("rec_source", F.col("src"))).alias("items"))

    left = history.join(main.select("request_id"), "request_id", "left_anti")
    fallback = _as_list(trust_guardrail(category_fallback(left, articles, limit), by), "category", limit, F.lit(None))
    fallback = fallback.withColumnRenamed("items", "fallback")

    hist = history.groupBy("request_id").agg(F.array_sort(F.collect_list(F.struct("hpos", "article_id", "category"))).alias("hist"))
    base = (requests.select("request_id").join(hist, "request_id", "left").join(main, "request_id", "left").join(fallback, "request_id", "left")
            .withColumn("hist", F.coalesce("hist", F.expr("cast(array() as array<struct<hpos:int,article_id:string,category:string>>)")))
            .withColumn("_o", F.lit(1)).join(F.broadcast(newest_list(articles, 2 * limit + MAX_HISTORY + K.EXPLORE_POOL)), "_o"))
    no_items = F.expr(f"cast(array() as array<{_ITEM}>)")
    personal = F.coalesce("items", "fallback", no_items)
    read5 = _ids(F.slice("hist", 1, K.RECENT_EXCLUDED))
    base = base.withColumns({"list": personal, "read5": read5, "read_all": _ids(F.col("hist")), "main": F.col("items").isNotNull()})
    # what a lambda looks names up in is made once a request, not once an article
    without = lambda names: X.let(names, lambda known: F.filter("newest", lambda a: ~F.array_contains(known, a["article_id"])))
    filler = without(F.concat(_ids(F.col("list")), F.col("read5")))
    base = base.withColumn("filled", F.slice(F.concat("list", _plain(filler, "latest")), 1, limit))
    latest = _plain(without(F.col("read_all")), "latest")
    base = base.withColumn("out", F.when(F.size("list") > 0, F.col("filled")).otherwise(F.slice(latest, 1, limit)))
    seen_categories = F.transform(F.filter("hist", lambda h: h["category"].isNotNull()), lambda h: h["category"])
    unseen = F.slice(without(F.concat(_ids(F.col("out")), F.col("read_all"))), 1, K.EXPLORE_POOL)
    outside = X.let(seen_categories, lambda seen: F.filter(unseen, lambda a: ~F.array_contains(seen, F.coalesce(a["category"], F.lit("unknown")))))
    base = base.withColumn("explore", F.slice(_plain(outside, "explore"), 1, 1))
    explored = F.when(F.col("main") & (F.lit(limit) >= K.EXPLORE_MIN_LIMIT) & (F.size("out") >= limit) & (F.size("explore") > 0),
                      F.concat(F.slice("out", 1, limit - 1), F.col("explore"))).otherwise(F.col("out"))
    return base.select("request_id", F.posexplode(explored).alias("p", "i")).select(
        "request_id", (F.col("p") + 1).alias("pos"), "i.article_id", "i.rec_source", "i.rec_score")
