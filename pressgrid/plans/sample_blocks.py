"""Samples met with the articles they name, a block of samples at a time.

A sample stays one row with its reads and its candidates; a block of BLOCK_SAMPLES of them gets each article it names
once, with its columns and its vector, so neither reads nor vectors travel once a row.  Samples of one id share a block.
"""
from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from .. import constants as K
from ..session import write_once

BLOCK_SAMPLES = 4096

#: What the vector of an article row is for: both, candidates only, profiles only.
BOTH, SHOWN, READ = 0, 1, 2


def _met(samples: DataFrame, articles: DataFrame, lists: dict[str, Column], work: Callable, schema: T.StructType) -> DataFrame:
    """work over blocks of samples (sample_id, lists) and the rows of articles that they name."""
    rows = write_once(samples.select("sample_id", *[c.alias(n) for n, c in lists.items()]), "samples")
    block = F.pmod(F.xxhash64("sample_id"), F.lit(max(1, math.ceil(rows.count() / BLOCK_SAMPLES)))).cast("int").alias("_block")
    rows = rows.select(block, "*")
    named = rows.select(F.col("_block").alias("_at"), F.explode(F.array_distinct(F.concat(*lists))).alias("article_id")).distinct().join(articles, "article_id")
    return rows.groupBy("_block").cogroup(named.groupBy("_at")).applyInArrow(work, schema)


def _flat(column: pa.ChunkedArray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The items of a list column, the row and the place of each."""
    size = column.combine_chunks().value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(size)), size)
    return column.combine_chunks().flatten(), row, np.arange(len(row)) - (np.cumsum(size) - size)[row]


class _Articles:
    """Where the rows of an article are in a table."""

    def __init__(self, table: pa.Table, rows: np.ndarray):
        self.names = pd.Index(table["article_id"].to_pandas().iloc[rows].unique())
        code = self.names.get_indexer(table["article_id"].to_pandas().iloc[rows])
        self.order = rows[np.argsort(code, kind="stable")]
        self.count = np.bincount(code, minlength=len(self.names)) if len(rows) else np.zeros(0, dtype=np.int64)
        self.start = np.cumsum(self.count) - self.count

    def join(self, items: pa.Array, keep: bool) -> tuple[np.ndarray, np.ndarray]:
        """(item, row of the table): one for each pair; with ``keep`` an item without a row comes once, with row -1."""
        code = self.names.get_indexer(items.to_pandas())
        if not len(self.names):
            return (np.arange(len(items)), np.full(len(items), -1)) if keep else (np.zeros(0, dtype=np.int64),) * 2
        found = np.where(code >= 0, self.count[code], 0)
        size = np.maximum(found, 1) if keep else found
        item = np.repeat(np.arange(len(code)), size)
        at = (self.start[code] - (np.cumsum(size) - size))[item] + np.arange(len(item))
        return item, np.where(found[item] > 0, self.order[np.where(found[item] > 0, at, 0)], -1)

    def has(self, items: pa.Array) -> np.ndarray:
        return self.names.get_indexer(items.to_pandas()) >= 0


def _codes(samples: pa.Table) -> np.ndarray:
    return pd.factorize(samples["sample_id"].to_pandas(), use_na_sentinel=False)[0]


def _matrix(column: pa.Array) -> np.ndarray:
    return np.stack([np.asarray(v, dtype=np.float64) for v in column.to_pandas()]) if len(column) else np.zeros((0, 1))


def _reads(samples: pa.Table) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The reads of all samples, their sample's code and their age: 0 is the latest."""
    items, row, place = _flat(samples["history"])
    size = np.bincount(row, minlength=len(samples))
    return items, _codes(samples)[row], size[row] - 1 - place


def _profiles(samples: pa.Table, vectors: np.ndarray, known: _Articles, skip_unknown: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(profile, whether there is one, whether a read has a vector) by sample code: means with weight 0.5^(age / 5) over the reads that have a vector."""
    items, code, age = _reads(samples)
    if skip_unknown:  # the age counts known reads only
        item = np.flatnonzero(known.has(items))
        item = item[np.lexsort((age[item], code[item]))]
        first = np.flatnonzero(np.diff(code[item], prepend=-1))
        age = age.copy()
        age[item] = np.arange(len(item)) - np.repeat(first, np.diff(np.append(first, len(item))))
    item, row = known.join(items, keep=False)
    item, row = item[age[item] < K.HISTORY_SIZE], row[age[item] < K.HISTORY_SIZE]
    order = np.argsort(code[item], kind="stable")
    item, row = item[order], row[order]
    out, read = np.zeros((len(samples), vectors.shape[1])), np.zeros(len(samples), dtype=bool)
    start = np.flatnonzero(np.diff(code[item], prepend=-1))
    read[code[item[start]]] = True
    if len(start):
        w = np.power(0.5, age[item] / K.RECENCY_HALF_LIFE)
        out[code[item[start]]] = np.add.reduceat(w[:, None] * vectors[row], start, axis=0) / np.add.reduceat(w, start)[:, None]
    return out, (out != 0).any(axis=1), read


def _scored(columns: list[str], skip_unknown: bool, schema: pa.Schema):
    def score(samples: pa.Table, articles: pa.Table) -> pa.Table:
        use = articles["_use"].to_numpy()
        filled = articles["embedding"].combine_chunks().is_valid().to_numpy(zero_copy_only=False)
        place = np.where(filled, np.cumsum(filled) - 1, -1)
        vectors = _matrix(articles["embedding"].combine_chunks().drop_null())
        read = _Articles(articles, np.flatnonzero((use != SHOWN) & filled))
        # rows of read are rows of the table; vectors holds the filled ones only
        read.order = place[read.order]
        profile, has_profile, has_read = _profiles(samples, vectors, read, skip_unknown)
        items, row, cpos = _flat(samples["shown"])
        item, at = _Articles(articles, np.flatnonzero(use != READ)).join(items, keep=True)
        code = _codes(samples)[row[item]]
        vec = np.where(at >= 0, place[at] if len(place) else -1, -1)
        both = np.flatnonzero((vec >= 0) & has_profile[code])
        cosine = np.zeros(len(item))
        norm = lambda m: np.sqrt((m * m).sum(axis=1))
        a, b = profile[code[both]], vectors[vec[both]]
        length = norm(profile)[code[both]] * norm(vectors)[vec[both]]
        cosine[both] = np.where(length > 0, (a * b).sum(axis=1) / np.where(length > 0, length, 1.0), 0.0)
        scored = np.zeros(len(item), dtype=bool)
        scored[both] = True
        whole = np.bincount(code, weights=vec < 0, minlength=len(samples)) == 0
        take = pa.array(at, mask=at < 0)
        out = {"sample_id": samples["sample_id"].combine_chunks().take(pa.array(row[item])), "cpos": pa.array(cpos[item], pa.int32()), "article_id": items.take(pa.array(item)),
               **{c: articles[c].combine_chunks().take(take) for c in columns}, "cosine": pa.array(cosine, mask=~scored),
               "has_vector": pa.array(vec >= 0), "has_profile": pa.array(has_profile[code]), "whole": pa.array(whole[code]),
               "has_read": pa.array(has_read[code])}
        return pa.table([out[f.name].cast(f.type) for f in schema], schema=schema)
    return score


def scored_candidates(samples: DataFrame, articles: DataFrame, columns: list[str], skip_unknown: bool) -> DataFrame:
    """(sample_id, cpos, article_id, columns, cosine, has_vector, has_profile, whole, has_read), a row for each candidate and article row.

    ``articles``: article_id, columns, embedding, _use.  The cosine to the profile of the reads is null where a side is missing;
    ``whole``: all candidates of the sample have a vector, ``has_read``: one of its reads has one.  ``skip_unknown``: reads without a vector do not count for the age.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    added = T._parse_datatype_string("cosine double, has_vector boolean, has_profile boolean, whole boolean, has_read boolean")
    own = [samples.schema["sample_id"], T.StructField("cpos", T.IntegerType()), T.StructField("article_id", T.StringType())]
    schema = T.StructType([*own, *[articles.schema[c] for c in columns], *added])
    lists = {"history": F.col("history"), "shown": F.concat(F.array("positive"), "negatives")}
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in schema])
    return _met(samples, articles.select("article_id", *columns, "embedding", "_use"), lists, _scored(columns, skip_unknown, to_arrow_schema(schema)), schema)


def _weighed(schema: pa.Schema, known: bool):
    def weigh(samples: pa.Table, articles: pa.Table) -> pa.Table:
        items, code, age = _reads(samples)
        item, at = _Articles(articles, np.arange(len(articles))).join(items, keep=not known)
        item, at = item[age[item] < K.HISTORY_SIZE], at[age[item] < K.HISTORY_SIZE]
        category = articles["category"].combine_chunks().take(pa.array(at, mask=at < 0)).fill_null("unknown")
        names, of = np.unique(category.to_pandas().to_numpy().astype(str), return_inverse=True)
        cell, to = np.unique(code[item] * max(1, len(names)) + of, return_inverse=True)
        weight = np.bincount(to, weights=np.power(0.5, age[item] / K.RECENCY_HALF_LIFE), minlength=len(cell))
        ids = samples["sample_id"].combine_chunks()
        first = np.unique(_codes(samples), return_index=True)[1]
        out = [ids.take(pa.array(first[cell // max(1, len(names))])), pa.array(names[cell % max(1, len(names))].astype(object), pa.string()), pa.array(weight)]
        return pa.table([c.cast(f.type) for c, f in zip(out, schema)], schema=schema)
    return weigh


def category_weights(samples: DataFrame, articles: DataFrame, known: bool = False) -> DataFrame:
    """(sample_id, category, weight): sum of 0.5^(age / 5) over the latest 20 reads; ``articles``: article_id, category.

    Reads without an article count as unknown, with ``known`` not at all.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    schema = T.StructType([T.StructField("sample_id", T.StringType()), T.StructField("category", T.StringType()), T.StructField("weight", T.DoubleType())])
    return _met(samples, articles.select("article_id", "category"), {"history": F.col("history")}, _weighed(to_arrow_schema(schema), known), schema)
