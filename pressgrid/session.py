"""Session and shared-folder helpers."""
from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    """Folder for streaming checkpoints and written intermediates.

    The cluster names it in ``spark.checkpoint.dir``; where that is unset, a folder in the session's
    warehouse serves, which executors share as well.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    return (configured or spark.conf.get("spark.sql.warehouse.dir") + "/_work").rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder; what is there when the process ends is deleted."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if not _written:
        atexit.register(_delete_all)
    _written[path] = spark
    return path


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder that new_path() named and nothing reads any more."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    _written.pop(path, None)


def _delete_all() -> None:
    for path, spark in list(_written.items()):
        try:
            delete(spark, path)
            delete(spark, path + "-cp")
        except Exception:  # the driver's virtual machine may be gone already
            return


def write_once(df: DataFrame, name: str = "table") -> DataFrame:
    """Write an intermediate that is read several times and read it back: columnar, pruned, without lineage."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_at = path
    return out


def drop_written(*frames: DataFrame) -> None:
    """Delete the files of write_once() frames."""
    for df in frames:
        delete(df.sparkSession, df.written_at)


def default_parts(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))
