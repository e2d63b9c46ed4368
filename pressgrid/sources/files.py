"""Readers and writers for JSON-lines and CSV files."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

_BAD = "_bad"


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """(good rows, bad lines): one JSON object per line; blank lines are skipped, broken ones kept apart."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    full = T.StructType([*schema.fields, T.StructField(_BAD, T.StringType())])
    parsed = lines.select(F.from_json("value", full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _BAD}).alias("r"))
    good = parsed.where(f"r.{_BAD} is null").select(*[F.col(f"r.`{f.name}`") for f in schema.fields])
    return good, parsed.where(f"r.{_BAD} is not null").select(F.col(f"r.{_BAD}").alias("line"))


def read_jsonl_strict(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Like ``read_jsonl``, but a broken line fails the job."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    return lines.select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("r")).select("r.*")


def read_csv_strings(spark: SparkSession, path: str) -> DataFrame:
    """All columns as text, nulls as ''; a trust_score column becomes an integer, unreadable values 0.

    A byte-order mark in front of the first header is dropped.
    """
    df = spark.read.options(header=True, multiLine=True, escape='"', encoding="UTF-8", ignoreLeadingWhiteSpace=False,
                            ignoreTrailingWhiteSpace=False).csv(path)
    df = df.toDF(*[c.lstrip("﻿") for c in df.columns]).na.fill("")
    if "trust_score" in df.columns:
        df = df.withColumn("trust_score", F.coalesce(F.col("trust_score").try_cast("double").try_cast("int"), F.lit(0)))
    return df


def write_csv(df: DataFrame, path: str) -> None:
    keep_spaces = {"ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    df.write.mode("overwrite").options(header=True, escape='"', quoteAll=True, emptyValue="", **keep_spaces).csv(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    """Overwrite a keyed result cache."""
    df.write.mode("overwrite").json(path)


def append_jsonl_resume(df: DataFrame, path: str, key: str, schema: T.StructType) -> None:
    """Append only the rows whose key the output does not hold yet, so a restarted job goes on."""
    done, _ = read_jsonl(df.sparkSession, path, schema)
    df.join(done.select(key), key, "left_anti").write.mode("append").json(path)


def export_tables(tables: dict[str, DataFrame], folder: str, fmt: str = "parquet") -> dict[str, str]:
    """Write every table below a folder and return the paths; vectors stay in the array column."""
    paths = {}
    for name, df in tables.items():
        paths[name] = f"{folder}/{name}"
        df.write.mode("overwrite").format(fmt).save(paths[name])
    return paths


def report_tables_csv(tables: dict[str, DataFrame], folder: str) -> dict[str, str]:
    """Write every table that has a row as CSV."""
    paths = {}
    for name, df in tables.items():
        if not df.isEmpty():
            paths[name] = f"{folder}/{name}"
            write_csv(df, paths[name])
    return paths


def chunks_with_vectors(chunks: DataFrame, vectors: DataFrame, key: str = "row_idx") -> DataFrame:
    """Pair a chunk table with a vector table by row number; different counts are an error."""
    n, m = chunks.count(), vectors.count()
    if n != m:
        raise ValueError(f"{n} chunks but {m} vectors")
    return chunks.join(vectors, key)
