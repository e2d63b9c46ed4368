"""Exact cosine top-k of a query table against a vector table, by an index of its own or a saved one."""
from __future__ import annotations

from pyspark.sql import DataFrame

from ..session import new_path
from .vector_index import BLOCK_ROWS, VectorIndex, create


def cosine_topk(queries: DataFrame, corpus: DataFrame | VectorIndex, k: int, min_score: float | None = None,
                block_rows: int = BLOCK_ROWS, pivot_count: int | None = None, unique: bool = False) -> DataFrame:
    """(qid, cid, score, rank): the k best rows with score >= min_score, ties by cid.

    ``queries`` has qid and qvec, ``corpus`` cid and cvec, or is an index.  When both also have qkey / ckey,
    rows with equal keys never match.  ``unique``: no qid repeats.
    """
    index = corpus if isinstance(corpus, VectorIndex) else create(corpus, new_path(queries.sparkSession, "index"), pivot_count, block_rows)
    return index.topk(queries, k, min_score, block_rows, unique)
