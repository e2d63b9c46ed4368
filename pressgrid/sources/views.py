"""Adapters: the tables of the data model, derived from the given parquet tables.

Each adapter is a lazy projection of one table, so filters and column pruning reach the
parquet scan.  ``catalog/oracle_views.py`` states the same definitions in SQL.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .. import constants as K
from ..functions import vectors as X

# Outlet shown for source number n (twenty sources).
OUTLETS = ["연합뉴스", "조선일보 경제", "머니투데이", "유튜브", "지역소식", "미상", "KBS", "한겨레", "뉴시스 사회", "티스토리",
           "중앙일보", "YTN 사이언스", "매일경제", "네이버 블로그 글", "동네신문", "SBS", "경향신문", "이데일리", "페이스북", "무명매체"]
VECTOR_DIM = 64
LABEL_BOOST = 1.6


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(values: list[str], index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), index.cast("int") + 1)


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    i = F.col("doc_id")
    lines = F.split("text", "\n")
    hours = (i % 87600).cast("int")
    score = (F.when(i % 11 == 0, F.lit(0)).when(i % 13 == 0, F.lit(None).cast("int"))
             .otherwise(((i * 37) % 101).cast("int")))
    keywords = (F.when(i % 6 == 0, F.lit(None).cast("string")).when(i % 6 == 1, "").when(i % 6 == 2, "[]")
                .when(i % 6 == 3, '["정치 > 국회 > 홍길동", "경제"]')
                .when(i % 6 == 4, '["a > b", "c", "d > e > f", "g"]').otherwise("not json"))
    return d.select(
        i.cast("string").alias("article_id"),
        F.get(lines, F.lit(0)).alias("title"),
        _pick(OUTLETS, F.substring("source", 4, 10).cast("int") % 20).alias("source"),
        F.concat(F.lit("https://news.example/"), i).alias("url"),
        F.date_format(F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
                      + F.make_dt_interval(F.lit(0), hours, F.lit(0), F.lit(0)), "yyyy-MM-dd HH:mm").alias("published_at"),
        F.col("text").alias("full_text"),
        F.get(lines, F.lit(1)).alias("summary_text"),
        keywords.alias("keywords"),
        score.alias("trust_score"),
        F.when(i % 11 == 0, "").when(score >= 70, "likely_true").when(score >= 40, "uncertain")
         .when(score.isNotNull(), "likely_false").otherwise("unanalyzed").alias("trust_verdict"),
        F.when(i % 17 == 0, F.lit(None).cast("string")).when(i % 19 == 0, "일반")
         .otherwise(_pick(K.CATEGORY_DISPLAY_ORDER, i % 8)).alias("category"),
        F.col("lang"),
    )


def article_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(article_id, embedding): unit vector plus a boost on the label's dimension, so labels form clusters."""
    e = table(spark, sf_dir, "embeddings")
    v = F.col("embedding").cast("array<double>")
    boosted = X.let(X.norm(v), lambda n: F.transform(v, lambda x, j: x / n + F.when(j == F.col("label"), LABEL_BOOST).otherwise(0.0)))
    return e.select(F.col("vec_id").cast("string").alias("article_id"), boosted.alias("embedding"))


def learned_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(article_id, learned_embedding): the mirrored article vector."""
    return article_vectors(spark, sf_dir).select("article_id", F.reverse("embedding").alias("learned_embedding"))


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(chunk_id, article_id, embedding): four neighbouring vectors belong to one article."""
    v = article_vectors(spark, sf_dir)
    n = F.col("article_id").cast("long")
    return v.select(F.col("article_id").alias("chunk_id"), F.floor(n / 4).cast("string").alias("article_id"),
                    F.concat(F.lit("chunk "), F.col("article_id")).alias("chunk_text"), "embedding")


def _k() -> Column:
    return F.get_json_object("props", "$.k").cast("int")


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_event_log(table(spark, sf_dir, "events"))


def as_event_log(e: DataFrame) -> DataFrame:
    """Event rows, batch or streaming, in the shape of the log; ``ts`` is kept as ``event_time``."""
    e, k, u = e.withColumn("_k", _k()), F.col("_k"), F.col("user_id")  # a column, so the payload is read once a row
    kind = (F.when(F.col("event_type") == "view", "view_article_detail").when(F.col("event_type") == "click", "click_article")
            .when(F.col("event_type") == "purchase", "click_feedback").when(F.col("event_type") == "signup", "visit_main")
            .otherwise("impression"))
    surface = F.when(k % 2 == 0, K.RECOMMENDATION_SURFACE).otherwise("main")
    item = lambda j: F.concat(F.lit('{"article_id":"'), (k + j) % 100, F.lit(f'","position":{j}}}'))
    shown = F.concat(F.lit('{"source":"'), surface, F.lit('","articles":['),
                     F.concat_ws(",", *[item(j) for j in range(5)]), F.lit("]}"))
    tagged = F.concat(F.lit('{"source":"'), surface, F.lit('","rec_source":"'),
                      _pick(["encoder", "profile", "category", "latest"], k % 4), F.lit('"}'))
    untagged = F.concat(F.lit('{"source":"'), surface, F.lit('"}'))
    return e.select(
        F.col("event_id").cast("string").alias("log_id"),
        F.concat(u, F.lit("-"), F.date_format("ts", "yyyyMMdd")).alias("session_id"),
        kind.alias("event_type"),
        F.when(kind != "impression", k.cast("string")).alias("article_id"),
        F.when(kind == "impression", shown).when((kind == "click_article") & (k % 5 != 0), tagged)
         .otherwise(untagged).alias("event_data"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("created_at"),
        F.when(u % 5 != 0, u.cast("string")).alias("user_id"), F.col("ts").cast("timestamp").alias("event_time"),
    )


def raw_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events before the user check and redaction (``user_id`` may name nobody)."""
    return as_raw_events(event_log(spark, sf_dir))


def as_raw_events(e: DataFrame) -> DataFrame:
    secret = F.concat(F.lit('{"api_key":"x","nested":{"Token":"y","n":['), F.length("log_id"), F.lit(',"ok"]},"payload":'),
                      F.col("event_data"), F.lit("}"))
    return e.withColumn("user_id", F.regexp_extract("session_id", "^([0-9]+)-", 1)).withColumn("event_data", secret)


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_log(spark, sf_dir).where("user_id is not null").select("user_id").distinct()


def feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").where("event_type = 'purchase'").withColumn("_k", _k())
    k, u = F.col("_k"), F.col("user_id")
    return e.select(
        F.col("event_id").cast("string").alias("feedback_id"), k.cast("string").alias("article_id"),
        F.when(u % 5 != 0, u.cast("string")).alias("user_id"), u.cast("string").alias("raw_user_id"),
        F.when(k % 2 == 0, "like").otherwise("dislike").alias("feedback_type"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("created_at"))


def performance_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page-speed events: one per given event, path = its type."""
    return as_performance_log(table(spark, sf_dir, "events"))


def as_performance_log(e: DataFrame) -> DataFrame:
    v = F.col("value")
    return e.select(F.lit("client_performance").alias("event_type"),
                    F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("created_at"),
                    F.to_json(F.struct(F.concat(F.lit("/"), "event_type").alias("path"),
                                       F.floor(v * 10).alias("lcp_ms"), (F.floor(v) / 100).alias("cls"),
                                       F.floor(v * 3).alias("max_event_ms"))).alias("event_data"),
                    F.col("ts").cast("timestamp").alias("event_time"))


def search_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search events: one per given event, the term comes from the payload key."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("user_id").cast("string").alias("user_id"), F.lit("execute_search").alias("event_type"),
                    F.concat(F.lit(" q"), _k() % 25, F.lit(" ")).alias("term"),
                    F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("created_at"))


def search_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, query, query_vector): every benchmark text, with the vector of the same number."""
    b = table(spark, sf_dir, "benchmark")
    v = article_vectors(spark, sf_dir).select(F.col("article_id").cast("long").alias("item_id"),
                                              F.col("embedding").alias("query_vector"))
    return b.join(v, "item_id", "left").select(F.col("item_id").cast("string").alias("query_id"),
                                               F.col("text").alias("query"), "query_vector")


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(article_id, title, source, full_text, <criterion>: array<struct<answer, reason>>) model answers.

    Every 29th article has no answer at all (a failed call).
    """
    i = F.col("article_id").cast("long")
    a = articles(spark, sf_dir)
    q = 0
    cols = []
    for name, count in K.QUESTION_COUNTS.items():
        items = []
        for j in range(count):
            word = _pick(["yes", "no", "uncertain"], (i * 7 + (q + j) * 13 + F.floor(i / (q + j + 2))) % 3)
            items.append(F.struct(word.alias("answer"), F.concat(F.lit(f"Q{j + 1} "), word).alias("reason")))
        q += count
        cols.append(F.when(i % 29 != 0, F.array(*items)).alias(name))
    return a.select("article_id", "title", "source", "full_text", *cols)


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(article_id, label): 0, 0.25, 0.75 or 1 from the two given marks."""
    d = table(spark, sf_dir, "labels")
    return d.select(F.col("doc_id").cast("string").alias("article_id"),
                    (F.col("quality") * 0.75 + (1 - F.col("toxic")) * 0.25).alias("label"))
