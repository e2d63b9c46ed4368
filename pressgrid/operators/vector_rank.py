"""Rank of each article's own chunks among all articles, by best chunk."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import vectors as X
from ..session import new_path
from .vector_index import BLOCK_ROWS, SCORE_DIGITS, VectorIndex, create


def chunk_units(chunks: DataFrame) -> DataFrame:
    """Index rows of chunks (chunk_id, article_id, embedding); the chunks of an article are one unit."""
    return chunks.select(F.col("chunk_id").alias("cid"), F.col("article_id").alias("ckey"), F.col("embedding").alias("cvec"))


def better_articles(queries: DataFrame, chunks: DataFrame, index: VectorIndex | None = None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(article_id, rank) for ``queries`` (article_id, vector) against ``chunks`` (chunk_id, article_id, embedding).

    A query's own score is its floor: cells of the index that lie wholly below it are left out,
    cells wholly above it are counted without a visit.
    """
    q = queries.select(F.col("article_id").alias("qid"), F.col("vector").alias("qvec"))
    own = q.join(chunks.select(F.col("article_id").alias("qid"), "embedding"), "qid").groupBy("qid").agg(
        F.round(F.max(X.cosine(F.col("qvec"), F.col("embedding"))), SCORE_DIGITS).alias("own"))
    index = index or create(chunk_units(chunks), new_path(queries.sparkSession, "index"))
    better = index.count_above(q.join(own, "qid"), block_rows)
    return better.select(F.col("qid").alias("article_id"), (F.col("better") + 1).alias("rank"))
