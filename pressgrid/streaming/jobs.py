"""Structured Streaming jobs over behaviour events.

All inputs carry ``event_time``.  Sinks and checkpoints live in the shared folder.
"""
from __future__ import annotations

from bisect import bisect_right

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from .. import constants as K
from ..functions import arrow, payload as P
from ..session import new_path

#: Hash buckets of (subject, article) that positive_dedupe keeps its state in.
DEDUPE_BUCKETS = 1024
#: Rows of a bucket that are put in order together.
FOLD_ROWS = 1 << 18


def run_append(stream: DataFrame, name: str, partition_by: list[str] = ()) -> DataFrame:
    """Drain what is available into a parquet table and read it back."""
    spark = stream.sparkSession
    path = new_path(spark, name)
    w = stream.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", path + "-cp")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def run_update(stream: DataFrame, name: str) -> DataFrame:
    """Drain an update-mode query; every batch is one folder, so a repeated batch overwrites itself.

    The result holds every update with its batch_id; latest() keeps the last of each key.
    """
    spark = stream.sparkSession
    path = new_path(spark, name)

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    (stream.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", path + "-cp")
     .trigger(availableNow=True).start().awaitTermination())
    return spark.read.option("basePath", path).parquet(path)


def latest(updates: DataFrame, keys: list[str]) -> DataFrame:
    """The last update of each key: windows that are still open included."""
    rest = [c for c in updates.columns if c not in keys and c != "batch_id"]
    last = F.max_by(F.struct(*rest), F.col("batch_id")).alias("_l")
    return updates.groupBy(*keys).agg(last).select(*keys, "_l.*")


def event_log_sink(events: DataFrame) -> DataFrame:
    """Redacted events, ready to append."""
    return events.withColumn("event_data", arrow.redact_json("event_data"))


def impression_items(events: DataFrame) -> DataFrame:
    """(session_id, context, article_id, position, event_time) of shown items."""
    context = F.coalesce(F.get_json_object("event_data", "$.context_key"), F.get_json_object("event_data", "$.source"), F.lit("main"))
    return (events.where("event_type = 'impression'")
            .select("session_id", context.alias("context"), "event_time", F.inline(P.impression_items(F.col("event_data")))))


def impression_dedupe(items: DataFrame, delay: str = "1 day") -> DataFrame:
    """A (session, context, article, position) is passed on once; state expires with the watermark."""
    return items.withWatermark("event_time", delay).dropDuplicatesWithinWatermark(["session_id", "context", "article_id", "position"])


def _keep_spaced(seconds: float, memory: float, most: int = FOLD_ROWS):
    def fold(frames: list[pd.DataFrame], known: dict) -> pd.DataFrame:
        rows = pd.concat(frames) if len(frames) > 1 else frames[0]
        rows = rows.sort_values(["event_time", "created_at"], kind="stable")
        out = []
        times = (rows["event_time"].astype("int64") / _units(rows["event_time"])).tolist()
        for subject, article, t, when in zip(rows["subject"], rows["article_id"], times, rows["created_at"]):
            kept = known.setdefault((subject, article), [])
            at = bisect_right(kept, t)
            # the kept row before decides, so a late row is not taken for a repeat of a later one
            if not at or t - kept[at - 1] > seconds:
                kept.insert(at, t)
                out.append((subject, article, when))
        for key, kept in known.items():
            if kept[0] < kept[-1] - memory:
                known[key] = kept[bisect_right(kept, kept[-1] - memory) - 1:]
        return pd.DataFrame(out, columns=["subject", "article_id", "created_at"])

    def keep(key, frames, state: GroupState):
        known = {(s, a): list(k) for s, a, k in zip(*state.get)} if state.exists else {}
        if not state.hasTimedOut:
            held, n = [], 0
            for rows in frames:  # in time order as a whole; a bucket of very many rows is worked off in parts
                held.append(rows)
                n += len(rows)
                if n >= most:
                    yield fold(held, known)
                    held, n = [], 0
            if held:
                yield fold(held, known)
        watermark = state.getCurrentWatermarkMs()
        known = {k: kept for k, kept in known.items() if (kept[-1] + memory) * 1000 >= watermark}
        if known:
            state.update(([s for s, _ in known], [a for _, a in known], list(known.values())))
            state.setTimeoutTimestamp(max(int((min(kept[-1] for kept in known.values()) + memory) * 1000), watermark + 1))
        elif state.exists:
            state.remove()
    return keep


def _units(times: pd.Series) -> float:
    return {"ns": 1e9, "us": 1e6, "ms": 1e3, "s": 1.0}[getattr(times.dtype, "unit", "ns")]


def positive_dedupe(events: DataFrame, seconds: float = 30.0, delay: str = "1 hour", memory: float = 3600.0, buckets: int = DEDUPE_BUCKETS) -> DataFrame:
    """Repeats of an article within ``seconds`` of the kept one before it are dropped.

    Late rows up to ``delay`` behind the newest are decided at their own time: the state of a (subject,
    article) is the kept times of the last ``memory`` seconds and expires with the watermark.  Most pairs
    have a single row, so the state lies in hash buckets of pairs: one call of Python for each bucket, not for
    each pair.  A checkpoint keeps its number of ``buckets``.
    """
    rows = events.withWatermark("event_time", delay).where(F.col("event_type").isin(K.POSITIVE_EVENTS) & (F.col("article_id") != "")).select(
        P.subject_key(F.col("user_id"), F.col("session_id")).alias("subject"), "article_id", "created_at", "event_time")
    bucket = F.pmod(F.xxhash64("subject", "article_id"), F.lit(buckets)).cast("int").alias("bucket")
    return rows.select(bucket, "*").groupBy("bucket").applyInPandasWithState(
        _keep_spaced(seconds, memory), "subject string, article_id string, created_at string",
        "subject array<string>, article_id array<string>, kept array<array<double>>", "append",
        GroupStateTimeout.EventTimeTimeout)


def recommendation_ctr(events: DataFrame, delay: str = "1 hour", span: str = "1 day") -> DataFrame:
    """Shown items and clicks of the recommendation surface per day, the clicks also by recommendation source.

    Clicks without a source count as 'unknown', impressions have none; ctr_by_source() forms the rates.
    """
    on_surface = F.get_json_object("event_data", "$.source") == K.RECOMMENDATION_SURFACE
    rows = events.where(F.col("event_type").isin("impression", "click_article") & on_surface)
    shown = F.when(F.col("event_type") == "impression", F.size(P.impression_ids(F.col("event_data")))).otherwise(0)
    clicks = (F.col("event_type") == "click_article").cast("int")
    source = F.when(F.col("event_type") == "click_article", F.coalesce(F.get_json_object("event_data", "$.rec_source"), F.lit("unknown")))
    out = rows.withColumn("rec_source", source).withWatermark("event_time", delay).groupBy(F.window("event_time", span).alias("w"), "rec_source").agg(
        F.sum(shown).alias("impression_items"), F.sum(clicks).alias("clicks"))
    return out.select(F.col("w.start").alias("starts_at"), "rec_source", "impression_items", "clicks")


def ctr_by_source(cells: DataFrame) -> DataFrame:
    """Cells of recommendation_ctr to (starts_at, rec_source, impression_items, clicks, ctr).

    A day's shown items belong to the surface: they are the base of every source, and of the row 'all'.
    """
    day = cells.groupBy("starts_at").agg(F.sum("impression_items").alias("impression_items"), F.sum("clicks").alias("clicks"))
    rows = day.withColumn("rec_source", F.lit("all")).unionByName(
        cells.where("rec_source is not null").select("starts_at", "rec_source", "clicks").join(day.drop("clicks"), "starts_at"))
    return rows.withColumn("ctr", F.when(F.col("impression_items") > 0, F.round(F.col("clicks") / F.col("impression_items"), 4)))


def web_vitals(events: DataFrame, delay: str = "1 hour", span: str = "24 hours", slide: str = "6 hours", accuracy: int = 10000) -> DataFrame:
    """Page-speed percentiles per path over sliding windows."""
    field = lambda n, k: F.get_json_object("event_data", f"$.{n}").cast(k)
    rows = events.where("event_type = 'client_performance'").select(
        "event_time", F.get_json_object("event_data", "$.path").alias("path"), field("lcp_ms", "int").alias("lcp"),
        field("cls", "double").alias("cls"), field("max_event_ms", "int").alias("inp")).where("lcp is not null")
    p = lambda c, q: F.percentile_approx(c, q, accuracy)
    return (rows.withWatermark("event_time", delay).groupBy(F.window("event_time", span, slide).alias("w"), "path")
            .agg(p("lcp", 0.5).alias("lcp_p50"), p("lcp", 0.75).alias("lcp_p75"), p("lcp", 0.95).alias("lcp_p95"),
                 p("cls", 0.75).alias("cls_p75"), p("inp", 0.75).alias("inp_p75"), F.count("*").alias("sample_count"))
            .select(F.col("w.start").alias("starts_at"), "path", "lcp_p50", "lcp_p75", "lcp_p95", "cls_p75", "inp_p75", "sample_count"))


def latest_state(updates: DataFrame) -> DataFrame:
    """The rows of each subject's last update; updates write a subject's list in full."""
    last = updates.groupBy("subject").agg(F.max("batch_id").alias("batch_id"))
    return updates.join(last, ["subject", "batch_id"], "left_semi").drop("batch_id")


def read_events(spark: SparkSession, folder: str, file_name: str) -> DataFrame:
    """A file stream over one of the given tables."""
    schema = spark.read.parquet(f"{folder}/{file_name}").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", file_name).parquet(folder)
