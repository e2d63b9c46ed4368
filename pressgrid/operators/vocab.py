"""Category codes."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import vectors as X
from .ordering import dense_order


def category_vocab(articles: DataFrame) -> DataFrame:
    """(category, code): sorted distinct categories; 'unknown' is code 0 when no row has it."""
    names = articles.select(F.coalesce("category", F.lit("unknown")).alias("category")).distinct()
    has = names.agg(F.max((F.col("category") == "unknown").cast("int")).alias("has")).withColumn("_o", F.lit(1))
    ranked = dense_order(names, "category").withColumn("_o", F.lit(1)).join(F.broadcast(has), "_o")
    shift = F.coalesce(1 - F.col("has"), F.lit(1))
    listed = ranked.select("category", (F.col("place") + shift).cast("int").alias("code"))
    absent = has.where("coalesce(has, 0) = 0").select(F.lit("unknown").alias("category"), F.lit(0).alias("code"))
    return listed.unionByName(absent)


def one_hot_categories(articles: DataFrame, vocab: DataFrame) -> DataFrame:
    size = vocab.agg(F.count("*").cast("int").alias("size")).withColumn("_o", F.lit(1))
    coded = vocab.withColumn("_o", F.lit(1)).join(F.broadcast(size), "_o").drop("_o")
    return (articles.withColumn("category", F.coalesce("category", F.lit("unknown"))).join(coded, "category")
            .withColumn("one_hot", X.one_hot(F.col("code"), F.col("size"))))
