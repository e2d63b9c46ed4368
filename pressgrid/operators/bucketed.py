"""Keyed tables in hash buckets: an update reads and replaces the buckets of its keys only.

A table is a folder with one Parquet folder for each bucket of the key.  An update joins the incoming rows with the
stored rows of their buckets, writes the outcome beside the table and then replaces these buckets (dynamic partition
overwrite); the files of all other buckets stay as they are.  A repeated update gives the same table.
"""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import delete, drop_written, write_once
from . import merges as M

BUCKETS = 64


def bucket_of(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(buckets)).cast("int")


class BucketTable:
    """A table in a folder, by hash of a key column; rows of one key lie in one bucket."""

    def __init__(self, spark: SparkSession, path: str, key: str, schema, buckets: int = BUCKETS):
        self.spark, self.path, self.key, self.schema, self.buckets = spark, path, key, schema, buckets

    def read(self, of: list[int] | None = None) -> DataFrame:
        stored = self.spark.read.schema(self.schema).parquet(self.path)
        stored = stored if of is None else stored.where(F.col("_bucket").isin(of))
        return stored.select(*self.schema.names)

    def _store(self, rows: DataFrame, mode: str) -> None:
        (rows.select(*self.schema.names).withColumn("_bucket", bucket_of(self.key, self.buckets)).repartition("_bucket")
         .write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy("_bucket").parquet(self.path))

    def change(self, incoming: DataFrame, work: Callable[[DataFrame, DataFrame], DataFrame]) -> list[int]:
        """Replace the buckets of the incoming keys by work(stored rows, incoming rows); returns the numbers of these buckets."""
        new = write_once(incoming, "incoming")
        touched = sorted(r[0] for r in new.select(bucket_of(self.key, self.buckets)).distinct().collect())  # at most one a bucket
        if touched:
            after = write_once(work(self.read(touched), new), "buckets")
            self._store(after, "overwrite")
            left = {r[0] for r in after.select(bucket_of(self.key, self.buckets)).distinct().collect()}
            for b in set(touched) - left:  # an overwrite leaves a bucket alone that has no rows any more
                delete(self.spark, f"{self.path}/_bucket={b}")
            drop_written(after)
        drop_written(new)
        return touched

    # --- the updates of the data model ---

    def upsert(self, incoming: DataFrame, keep: list[str] = (), order: str | None = None) -> list[int]:
        return self.change(incoming, lambda old, new: M.upsert(old, new, self.key, keep, order))

    def upsert_articles(self, incoming: DataFrame) -> list[int]:
        return self.change(incoming, lambda old, new: M.upsert_articles(old, new))

    def upsert_chunks(self, incoming: DataFrame) -> list[int]:
        return self.change(incoming, M.upsert_chunks)

    def update_trust(self, scores: DataFrame) -> list[int]:
        return self.change(scores, M.update_trust)

    def delete(self, ids: DataFrame) -> list[int]:
        """Drop the rows whose key is in ids (a column of the key's name)."""
        return self.change(ids.select(self.key).distinct(), lambda old, new: old.join(new, self.key, "left_anti"))

    def replace_feedback(self, votes: DataFrame, users: DataFrame) -> list[int]:
        """New votes of a table kept by article: the last one of each article and user stays."""
        names = self.schema.names
        return self.change(votes, lambda old, new: M.replace_feedback(old.unionByName(new.select(*names)), users).select(*names))


def create_table(rows: DataFrame, path: str, key: str, buckets: int = BUCKETS) -> BucketTable:
    table = BucketTable(rows.sparkSession, path, key, rows.schema, buckets)
    table._store(rows, "errorifexists")
    return table


def delete_cascade(tables: dict[str, BucketTable], ids: DataFrame) -> dict[str, list[int]]:
    """Drop article ids from tables kept by article_id; returns the buckets replaced in each."""
    return {name: t.delete(ids) for name, t in tables.items()}
