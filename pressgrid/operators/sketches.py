"""Dashboard numbers from sketches kept by day: distinct sessions and page-speed percentiles.

The log is read once, when a day is sketched.  Any range of days is then a merge of small rows: a sketch has a fixed
size whatever the day held, equal values of different days count once, and a late day is sketched again and replaced.
Distinct counts: HyperLogLog with 2 ^ ``lg_k`` registers, relative standard error 1.04 / sqrt(2 ^ lg_k) at most
(1.6 per cent at 12).  Percentiles: KLL; with ``k`` = 200 the rank is off by 1.65 per cent at most with 99 per cent confidence.
The exact forms in ``dashboards`` stay the default.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .. import constants as K
from .event_log import day_of

LG_K, KLL_K = 12, 200


def session_sketches(events: DataFrame, lg_k: int = LG_K) -> DataFrame:
    """(day, event_type, member, sessions): a sketch of the sessions of a day, step and audience.  Rows without a session count nowhere."""
    return (events.where(F.col("session_id").isNotNull())
            .groupBy(day_of(F.col("created_at")).alias("day"), "event_type", F.col("user_id").isNotNull().alias("member"))
            .agg(F.hll_sketch_agg(F.col("session_id").cast("string"), lg_k).alias("sessions")))


def _between(sketches: DataFrame, since: str | None, until: str | None) -> DataFrame:
    """Days since .. until; events without a time belong to no range with a bound."""
    if since is not None or until is not None:
        sketches = sketches.where("day <> 'none'")
    if since is not None:
        sketches = sketches.where(F.col("day") >= since)
    if until is not None:
        sketches = sketches.where(F.col("day") <= until)
    return sketches


def _distinct(sketch: Column) -> Column:
    return F.coalesce(F.hll_sketch_estimate(F.hll_union_agg(sketch)), F.lit(0)).cast("bigint")


def funnel_estimate(sketches: DataFrame, since: str | None = None, until: str | None = None, steps: list[str] = K.FUNNEL_STEPS) -> DataFrame:
    """Rows of ``dashboards.session_funnel`` over the days since .. until (both included), estimated; steps without events are 0."""
    some = _between(sketches, since, until).where(F.col("event_type").isin(steps))
    one = lambda member: F.when(F.col("member") == member, F.col("sessions"))
    counts = some.groupBy("event_type").agg(_distinct(F.col("sessions")).alias("overall"), _distinct(one(True)).alias("member"),
                                            _distinct(one(False)).alias("guest"))
    every = sketches.sparkSession.createDataFrame([(i, s) for i, s in enumerate(steps)], "step_no int, event_type string")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c)
    return every.join(counts, "event_type", "left").select("step_no", F.col("event_type").alias("step"), zero("overall"), zero("member"), zero("guest"))


def active_sessions_estimate(sketches: DataFrame, since: str | None = None, until: str | None = None) -> DataFrame:
    """(day, sessions): distinct sessions of every dated day, estimated."""
    dated = _between(sketches, since, until).where("day not in ('none', '')")
    return dated.groupBy("day").agg(_distinct(F.col("sessions")).alias("sessions"))


def speed_sketches(events: DataFrame, k: int = KLL_K) -> DataFrame:
    """(day, path, lcp, cls, inp, sample_count): sketches of the page speeds of a day and path; events without a paint time are left out."""
    field = lambda name, kind: F.get_json_object("event_data", f"$.{name}").cast(kind).cast("double")
    rows = events.where("event_type = 'client_performance'").select(
        day_of(F.col("created_at")).alias("day"), F.get_json_object("event_data", "$.path").alias("path"),
        field("lcp_ms", "int").alias("lcp"), field("cls", "double").alias("cls"), field("max_event_ms", "int").alias("inp"))
    sketch = lambda c: F.kll_sketch_agg_double(c, F.lit(k)).alias(c)
    return rows.where("lcp is not null").groupBy("day", "path").agg(sketch("lcp"), sketch("cls"), sketch("inp"), F.count("*").alias("sample_count"))


def vitals_estimate(sketches: DataFrame, since: str | None = None, until: str | None = None) -> DataFrame:
    """Percentiles of ``dashboards.web_vitals_percentiles`` per path over whole days, estimated; null where nothing was measured."""
    merged = _between(sketches, since, until).groupBy("path").agg(*[F.kll_merge_agg_double(c).alias(c) for c in ("lcp", "cls", "inp")],
                                                                 F.sum("sample_count").alias("sample_count"))

    def at(c: str, q: float) -> Column:
        return F.when(F.kll_sketch_get_n_double(c) > 0, F.kll_sketch_get_quantile_double(F.col(c), F.lit(q)))
    return merged.select("path", at("lcp", 0.5).alias("lcp_p50"), at("lcp", 0.75).alias("lcp_p75"), at("lcp", 0.95).alias("lcp_p95"),
                         at("cls", 0.75).alias("cls_p75"), at("inp", 0.75).alias("inp_p75"), "sample_count")


def save_days(sketches: DataFrame, path: str) -> None:
    """Write sketches in folders by day; the days they hold are replaced, the others stay."""
    sketches.repartition("day").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path)


def read_days(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    """Saved sketches; ``like`` gives the schema.  A range of days reads its own folders only."""
    return spark.read.schema(like.schema).parquet(path).select(*like.columns)
