"""An event log kept in folders by day: appended in place, read by range of days, compacted day by day."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..session import drop_written, write_once
from . import merges as M

#: Text bytes of a file that compaction aims at.
FILE_BYTES = 256 << 20


def day_of(created_at: Column) -> Column:
    """The first ten characters of the time; the log orders days as text, and an event without a time has a day of its own."""
    return F.coalesce(F.substring(created_at, 1, 10), F.lit("none"))


class EventLog:
    """The log below a path; schema: its columns without the day."""

    def __init__(self, spark: SparkSession, path: str, schema):
        self.spark, self.path, self.schema = spark, path, schema

    def _files(self):
        where = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return where, where.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def exists(self) -> bool:
        where, files = self._files()
        return files.exists(where)

    def read(self, since: str | None = None, until: str | None = None) -> DataFrame:
        """Events of the days since .. until (both included); other days' folders are not read."""
        log = self.spark.read.schema(T.StructType([*self.schema.fields, T.StructField("day", T.StringType())])).parquet(self.path)
        if since is not None:
            log = log.where(F.col("day") >= since)
        if until is not None:
            log = log.where(F.col("day") <= until)
        return log.select(*self.schema.names)

    def append(self, events: DataFrame, users: DataFrame, at: Column | None = None, id_col: str = "log_id") -> None:
        """Append prepared events (see merges.new_events); an id that its day has already is not appended again.

        Only the days of the new events are read for that.
        """
        rows = write_once(M.new_events(events, users, at, id_col).select(*self.schema.names).withColumn("day", day_of(F.col("created_at"))), "events")
        if self.exists():
            days = [r.day for r in rows.select("day").distinct().collect()]  # one value a day
            have = self.spark.read.schema(T.StructType([*self.schema.fields, T.StructField("day", T.StringType())])).parquet(self.path).where(F.col("day").isin(days)).select("day", id_col)
            fresh = rows.join(have, ["day", id_col], "left_anti")
        else:
            fresh = rows
        fresh.repartition("day").write.mode("append").partitionBy("day").parquet(self.path)
        drop_written(rows)

    def compact(self, day: str, file_bytes: int = FILE_BYTES) -> int:
        """Rewrite one day as few files; returns their number.  A day is replaced whole, so a repeated call does no harm."""
        where, files = self._files()
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(where, f"day={day}")
        n = max(1, -(-files.getContentSummary(folder).getLength() // file_bytes))
        rows = write_once(self.read(day, day).withColumn("day", F.lit(day)), "day")
        rows.repartition(n).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(self.path)
        drop_written(rows)
        return n
