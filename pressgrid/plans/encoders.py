"""Batch scoring of the two attention encoders with NumPy inside tasks.

Weights are a small dictionary of arrays, shipped once per executor as a broadcast variable; more than
MAX_WEIGHT_BYTES of them are refused.  Without weights the fallback is the normalised base vector.
"""
from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from .. import constants as K
from ..functions import vectors as X
from ..session import write_once

VECTOR = T.ArrayType(T.DoubleType())


#: What a model may take of every executor's memory.
MAX_WEIGHT_BYTES = 256 << 20


def _shared(spark, weights: dict):
    size = sum(np.asarray(v).nbytes for v in weights.values())
    if size > MAX_WEIGHT_BYTES:
        raise ValueError(f"the weights take {size} bytes, more than the {MAX_WEIGHT_BYTES} that are broadcast")
    return spark.sparkContext.broadcast(weights)


def _unit(m: np.ndarray) -> np.ndarray:
    return m / np.maximum(np.linalg.norm(m, axis=-1, keepdims=True), 1e-12)


def _softmax(x: np.ndarray, axis: int) -> np.ndarray:
    e = np.exp(x - x.max(axis=axis, keepdims=True))
    return e / e.sum(axis=axis, keepdims=True)


def news_vector(w: dict, title: np.ndarray, summary: np.ndarray, onehot: np.ndarray) -> np.ndarray:
    """Attention over the title, summary and category views (batch x 3 x dim), then unit length."""
    views = np.stack([title, summary, onehot @ w["category_w"].T + w["category_b"]], axis=1)
    logits = np.tanh(views @ w["view_w1"].T + w["view_b1"]) @ w["view_w2"].T + w["view_b2"]
    return _unit((views * _softmax(logits, 1)).sum(axis=1))


def user_vectors(w: dict, seqs: np.ndarray, heads: int = 8) -> np.ndarray:
    """Self-attention, residual layer norm and additive pooling over reading sequences of one length (batch x n x dim)."""
    batch, n, dim = seqs.shape
    part = dim // heads
    q, k, v = np.split(seqs @ w["in_w"].T + w["in_b"], 3, axis=2)
    split = lambda m: m.reshape(batch, n, heads, part).transpose(0, 2, 1, 3)
    att = _softmax(split(q) @ split(k).transpose(0, 1, 3, 2) / np.sqrt(part), 3) @ split(v)
    att = att.transpose(0, 2, 1, 3).reshape(batch, n, dim) @ w["out_w"].T + w["out_b"]
    h = seqs + att
    h = (h - h.mean(axis=2, keepdims=True)) / np.sqrt(h.var(axis=2, keepdims=True) + 1e-5) * w["norm_w"] + w["norm_b"]
    scores = np.tanh(h @ w["pool_w"].T + w["pool_b"]) @ w["pool_q"].T
    return _unit((h * _softmax(scores, 1)).sum(axis=1))


def user_vector(w: dict, seq: np.ndarray, heads: int = 8) -> np.ndarray:
    return user_vectors(w, seq[None], heads)[0]


def encode_articles(articles: DataFrame, weights: dict | None = None, dim: int = 64) -> DataFrame:
    """(article_id, vector).  Input: article_id, embedding, and optionally learned_embedding,
    title_embedding and one_hot."""
    zeros = F.array_repeat(F.lit(0.0), dim)
    if weights is None:
        base = [F.col(c) for c in ("learned_embedding", "embedding") if c in articles.columns]
        return articles.select("article_id", X.l2_normalize(F.coalesce(*base, zeros)).alias("vector"))
    shared = _shared(articles.sparkSession, weights)
    summary = F.coalesce("embedding", zeros)
    title = F.coalesce("title_embedding", summary) if "title_embedding" in articles.columns else summary

    @F.pandas_udf(VECTOR)
    def encode(t: pd.Series, s: pd.Series, c: pd.Series) -> pd.Series:
        stack = lambda x: np.stack([np.asarray(v, dtype=np.float64) for v in x])
        return pd.Series(list(news_vector(shared.value, stack(t), stack(s), stack(c))), dtype=object)

    return articles.select("article_id", encode(title, summary, "one_hot").alias("vector"))


#: Rows of one block of groups.
BLOCK_ROWS = 1 << 16


def _with_vectors(rows: DataFrame, by: list[str], vectors: DataFrame, work, schema, written: bool = False) -> DataFrame:
    """work over the rows of whole groups and the vectors (article_id, vector) they name.

    Groups are dealt to blocks of some BLOCK_ROWS rows, and a block gets each vector it needs once, not once a row.
    ``written``: the rows are read from a written table, so reading them twice is cheap.
    """
    rows = rows if written else write_once(rows, "groups")
    block = F.pmod(F.xxhash64(*by), F.lit(max(1, math.ceil(rows.count() / BLOCK_ROWS)))).cast("int").alias("_block")
    rows = rows.select(block, "*")
    named = rows.select(F.col("_block").alias("_at"), F.col("article_id").alias("article_id")).distinct().join(vectors, "article_id")
    return rows.groupBy("_block").cogroup(named.groupBy("_at")).applyInPandas(work, schema)


def _matched(rows: pd.DataFrame, vectors: pd.DataFrame, by: list[str], order: str, how: str) -> tuple[pd.DataFrame, np.ndarray]:
    """Rows joined with the places of their vectors, group by group, and where the groups start."""
    placed = rows.merge(pd.DataFrame({"article_id": vectors["article_id"], "_v": np.arange(len(vectors))}), "inner" if how == "inner" else "left", "article_id")
    placed = placed.assign(_g=placed.groupby(by, dropna=False, sort=False).ngroup()).sort_values(["_g", order], kind="stable")
    return placed, np.flatnonzero(np.diff(placed["_g"].to_numpy(), prepend=-1))


def _stacked(vectors: pd.Series, dim: int) -> np.ndarray:
    return np.stack([np.asarray(v, dtype=np.float64) for v in vectors]) if len(vectors) else np.zeros((0, dim))


def _pooled(dim: int, subject: str, weights):
    def pool(_key, rows: pd.DataFrame, vectors: pd.DataFrame) -> pd.DataFrame:
        if not len(rows):
            return pd.DataFrame({subject: pd.Series([], dtype=object), "user_vector": pd.Series([], dtype=object)})
        placed, start = _matched(rows, vectors, [subject], "_back", "left")
        # a read without a vector counts as zeros
        known = np.concatenate([_stacked(vectors["vector"], dim), np.zeros((1, dim))])
        at = placed["_v"].fillna(len(known) - 1).to_numpy().astype(np.int64)
        size = np.diff(np.append(start, len(placed)))
        out = np.empty(len(start), dtype=object)
        # sequences of one length are one product; there are at most HISTORY_SIZE lengths
        for n in np.unique(size):
            some = np.flatnonzero(size == n)
            seqs = known[at[start[some][:, None] + np.arange(n)]]
            if weights is None:
                mean = seqs.mean(axis=1)
                length = np.linalg.norm(mean, axis=1, keepdims=True)
                done = mean / np.where(length > 0, length, 1.0)
            else:
                done = user_vectors(weights.value, seqs)
            for i, row in zip(some, done):
                out[i] = row
        return pd.DataFrame({subject: placed[subject].to_numpy()[start], "user_vector": pd.Series(out, dtype=object)})
    return pool


def encode_users(history: DataFrame, vectors: DataFrame, subject: str, weights: dict | None = None, dim: int = 64) -> DataFrame:
    """(subject, user_vector) from the latest 20 rows of a history (article_id, hpos = 1 for the newest).

    A subject's sequence is at most 20 vectors.
    """
    known = vectors.select("article_id", F.coalesce("vector", F.array_repeat(F.lit(0.0), dim)).alias("vector"))
    rows = history.where(F.col("hpos") <= K.HISTORY_SIZE).select(subject, "article_id", (-F.col("hpos")).alias("_back"))
    shared = None if weights is None else _shared(history.sparkSession, weights)
    schema = T.StructType([rows.schema[subject], T.StructField("user_vector", VECTOR)])
    return _with_vectors(rows, [subject], known, _pooled(dim, subject, shared), schema, hasattr(history, "written_at"))


def _mean(dim: int, by: list[str], columns: list[str]):
    def mean(_key, rows: pd.DataFrame, vectors: pd.DataFrame) -> pd.DataFrame:
        placed, start = _matched(rows, vectors, by, "_age", "inner")
        if not len(placed):
            return rows.iloc[:0][by].assign(profile=pd.Series([], dtype=object))[columns]
        w = placed["w"].to_numpy()
        total = np.add.reduceat(w[:, None] * _stacked(vectors["embedding"], dim)[placed["_v"].to_numpy()], start, axis=0)
        first = placed.iloc[start][by].reset_index(drop=True)
        return first.assign(profile=pd.Series(list(total / np.add.reduceat(w, start)[:, None]), dtype=object))[columns]
    return mean


def _weighted(history: DataFrame, by: list[str], age: Column) -> DataFrame:
    w = F.pow(F.lit(0.5), F.col("_age") / K.RECENCY_HALF_LIFE)
    return history.withColumn("_age", age).where(F.col("_age") < K.HISTORY_SIZE).select(*by, "article_id", "_age", w.alias("w"))


def recency_weighted_vector(history: DataFrame, vectors: DataFrame, by: list[str], age: Column, dim: int = 64) -> DataFrame:
    """(by, profile): mean vector with weight 0.5^(age / 5) over the rows that have a vector.

    ``history`` holds at most 20 rows per group.
    """
    rows = _weighted(history, by, age)
    known = vectors.where(F.col("embedding").isNotNull()).select("article_id", "embedding")
    schema = T.StructType([*[rows.schema[c] for c in by], T.StructField("profile", VECTOR)])
    return _with_vectors(rows, by, known, _mean(dim, by, schema.names), schema, hasattr(history, "written_at"))


def recency_weighted_sides(history: DataFrame, vectors: DataFrame, by: str, side: str, age: Column, dim: int = 64) -> DataFrame:
    """(by, s, u): recency_weighted_vector of the rows of side 0 and of side 1 in one row, zeros for a side without vectors."""
    mean = _mean(dim, [by, side], [by, side, "profile"])

    def both(key, rows: pd.DataFrame, vectors: pd.DataFrame) -> pd.DataFrame:
        per = mean(key, rows, vectors)
        of = per.groupby(by, dropna=False, sort=False).ngroup().to_numpy()
        out, profile = np.zeros((2, of.max(initial=-1) + 1, dim)), _stacked(per["profile"], dim)
        for n in (0, 1):
            here = per[side].to_numpy() == n
            out[n, of[here]] = profile[here]
        first = per.iloc[np.unique(of, return_index=True)[1]][[by]].reset_index(drop=True)
        return first.assign(s=pd.Series(list(out[0]), dtype=object), u=pd.Series(list(out[1]), dtype=object))

    rows = _weighted(history, [by, side], age)
    known = vectors.where(F.col("embedding").isNotNull()).select("article_id", "embedding")
    schema = T.StructType([rows.schema[by], T.StructField("s", VECTOR), T.StructField("u", VECTOR)])
    return _with_vectors(rows, [by], known, both, schema, hasattr(history, "written_at"))
