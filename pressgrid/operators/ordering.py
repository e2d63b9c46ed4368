"""Ranks and running totals over a whole table without one sorted partition.

A table-wide order is cut into ranges by ``repartitionByRange``; the ranges are written once, so that
every later read sees the same ones.  Each range is sorted on its own; a range's offset is the total
of the ranges before it, and there is one total for each group and range.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from ..session import default_parts, write_once


def ranged(df: DataFrame, keys: list[str], parts: int | None = None) -> DataFrame:
    """df with ``_r``, the number of the range of the keys that a row is in; equal keys share a range."""
    parts = parts or default_parts(df.sparkSession)
    return write_once(df.repartitionByRange(parts, *keys).withColumn("_r", F.spark_partition_id()), "ranges")


def running_total(values: DataFrame, by: list[str], key: str, weight: str, parts: int | None = None) -> DataFrame:
    """(by, key, n, upto) for distinct (by, key): ``upto`` is the total weight up to and including the key."""
    sums = values.groupBy(*by, key).agg(F.sum(weight).alias("n"))
    cut = ranged(sums, [*by, key], parts)
    totals = cut.groupBy(*by, "_r").agg(F.sum("n").alias("_t"))
    before = W.partitionBy(*by).orderBy("_r").rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select(*by, "_r", F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_off"))
    inside = W.partitionBy(*by, "_r").orderBy(key).rowsBetween(W.unboundedPreceding, 0)
    run = cut.withColumn("_in", F.sum("n").over(inside)).join(offsets, [*by, "_r"])
    return run.select(*by, key, "n", (F.col("_in") + F.col("_off")).alias("upto"))


def average_ranks(values: DataFrame, by: list[str], key: str, weight: str) -> DataFrame:
    """(by, key, avg_rank): ties share the mean of their positions."""
    run = running_total(values, by, key, weight)
    return run.select(*by, key, (F.col("upto") - (F.col("n") - 1) / 2).alias("avg_rank"))


def dense_order(values: DataFrame, key: str) -> DataFrame:
    """(key, place): position of each distinct value in ascending order, from 0."""
    one = values.select(key).where(F.col(key).isNotNull()).distinct().withColumn("_w", F.lit(1))
    return running_total(one, [], key, "_w").select(key, (F.col("upto") - 1).alias("place"))


def positions(rows: DataFrame, by: list[str], key: str, name: str) -> DataFrame:
    """Adds the 0-based position of every row inside its group, in the order of a unique key.

    The group is cut into ranges of the key, so a group that holds most rows is spread out.
    """
    cut = ranged(rows, [*by, key])
    totals = cut.groupBy(*by, "_r").agg(F.count("*").alias("_t"))
    before = W.partitionBy(*by).orderBy("_r").rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select(*[F.col(c).alias(f"_b{i}") for i, c in enumerate(by)], F.col("_r").alias("_r2"),
                            F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_off"))
    inside = W.partitionBy(*by, "_r").orderBy(key)
    on = [F.col("_r") == F.col("_r2")] + [F.col(c).eqNullSafe(F.col(f"_b{i}")) for i, c in enumerate(by)]
    joined = cut.withColumn("_in", F.row_number().over(inside)).join(offsets, on)
    return joined.withColumn(name, F.col("_in") + F.col("_off") - 1).select(*rows.columns, name)


def exact_percentiles(rows: DataFrame, by: list[str], key: str, shares: dict[str, float]) -> DataFrame:
    """(by, one column for each share): interpolated percentiles from positions over ranges.

    Unlike an aggregate that keeps every distinct value of a group, no task holds a whole group.
    """
    run = running_total(rows.select(*by, key).where(F.col(key).isNotNull()).withColumn("_w", F.lit(1)), by, key, "_w")
    size = run.groupBy(*by).agg(F.max("upto").alias("_n"))
    placed = run.join(F.broadcast(size) if not by else size, by if by else F.lit(True))
    at = {n: (F.col("_n") - 1) * F.lit(q) for n, q in shares.items()}
    value = lambda place: F.min(F.when(F.col("upto") > place, F.col(key)))
    ends = placed.groupBy(*by, "_n").agg(*[c for n, a in at.items() for c in (value(F.floor(a)).alias(f"_lo_{n}"), value(F.ceil(a)).alias(f"_hi_{n}"))])
    return ends.select(*by, *[(F.col(f"_lo_{n}") + (F.col(f"_hi_{n}") - F.col(f"_lo_{n}")) * (a - F.floor(a))).alias(n) for n, a in at.items()])
