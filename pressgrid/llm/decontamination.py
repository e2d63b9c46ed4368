"""Benchmark decontamination by a prefix-filtered set join.

Every window of an item (``window`` consecutive words; a shorter item is one window) is a set of
word shingles.  Containment of a window needs all of its shingles, so one of them, the rarest, is
a sufficient prefix: a document without it cannot hold the window.  Rarity is the number of
documents that hold a shingle, counted over all documents.  The join looks each document shingle
up among the prefix shingles, bounds the place where the window would have to begin (positional
bound) and end (length bound) inside the document, and compares the words of the window one by one.

The items are joined in blocks of bounded bytes.  The index of one block is what a task holds and
what is sent to it; the documents pass all blocks in one stage, without a shuffle.
"""
from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .arrays import ALNUM, LOWER, add_columns, pieces_of, runs, span_hashes, sums, text_bytes, text_of, tidy

WINDOW = 10
SHINGLE = 2
#: Bytes of item text whose index is sent to the tasks at once.
BLOCK_BYTES = 8 << 20

SCHEMA = "n_words long, n_hit long, item_ids array<long>, hit_spans array<struct<start: long, end: long>>"


def _words(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    data, offsets = text_bytes(column)
    data = LOWER[data]
    starts, ends, first = runs(data, offsets, ALNUM)
    return span_hashes(data, starts, ends), first


class ItemBlock:
    """Distinct windows of some items, their words as numbers, their shingles, and who has them."""

    def __init__(self, ids: list, texts: pa.Array, window: int):
        hashes, first = _words(texts)
        self.vocab, words = np.unique(hashes, return_inverse=True)
        rows: dict[tuple, set] = {}
        for k, item in enumerate(ids):
            own = words[first[k]:first[k + 1]].tolist()
            for i in range(max(len(own) - window, 0) + 1 if own else 0):
                rows.setdefault(tuple(own[i:i + window]), set()).add(item)
        self.windows = list(rows)
        self.items = [sorted(x for x in v if x is not None) for v in rows.values()]
        self.width = window
        shingles = [[self._key(w, i) for i in range(max(len(w) - SHINGLE, 0) + 1)] for w in self.windows]
        self.shingles = np.unique(np.array([s for own in shingles for s in own], np.int64))
        self._own = shingles
        #: One bit for the low 16 bits of each word's hash: most document words are ruled out by it.
        self.maybe = np.zeros(1 << 16, bool)
        self.maybe[(self.vocab & np.uint64(0xFFFF)).astype(np.int64)] = True

    def _key(self, words: tuple, i: int) -> int:
        """Number of the shingle at i; a window of one word has a shingle of one word."""
        n = len(self.vocab) + 1
        return (words[i] + 1) * n + (words[i + 1] + 1 if len(words) > 1 else 0)

    def order(self, found_in: np.ndarray) -> None:
        """Choose the prefix of every window; found_in: documents that hold each shingle."""
        rarity = dict(zip(self.shingles.tolist(), found_in.tolist()))
        best = [min(range(len(own)), key=lambda i: (rarity[own[i]], own[i], i)) for own in self._own]
        keys = np.array([own[i] for own, i in zip(self._own, best)], np.int64)
        by = np.argsort(keys, kind="stable")
        self.prefix, begin = np.unique(keys[by], return_index=True)
        self.begin = np.append(begin, len(by))
        self.window_of, self.place = by, np.array(best, np.int64)[by]
        self.length = np.array([len(w) for w in self.windows], np.int64)
        self.words = np.full((len(self.windows), self.width), -1, np.int64)
        for k, w in enumerate(self.windows):
            self.words[k, :len(w)] = w
        self._own = None

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        out = np.full(len(hashes), -1, np.int64)
        if len(self.vocab):
            at = np.flatnonzero(self.maybe[(hashes & np.uint64(0xFFFF)).astype(np.int64)])
            slot = np.minimum(np.searchsorted(self.vocab, hashes[at]), len(self.vocab) - 1)
            same = self.vocab[slot] == hashes[at]
            out[at[same]] = slot[same]
        return out

    def known(self, numbers: np.ndarray, doc: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the document words where a shingle of keys begins, and its index in keys."""
        n = len(self.vocab) + 1
        one = np.flatnonzero(numbers >= 0)
        two = one[(one + 1 < len(numbers))]
        two = two[(numbers[two + 1] >= 0) & (doc[two + 1] == doc[two])]
        places = np.concatenate((one, two))
        key = np.concatenate(((numbers[one] + 1) * n, (numbers[two] + 1) * n + numbers[two + 1] + 1))
        if not len(keys) or not len(key):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        slot = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
        same = keys[slot] == key
        return places[same], slot[same]

    def matches(self, hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, window) of every occurrence."""
        doc, numbers = text_of(first), self.numbers(hashes)
        places, slot = self.known(numbers, doc, self.prefix)
        n = self.begin[slot + 1] - self.begin[slot]
        post = np.repeat(self.begin[slot] - np.concatenate(([0], np.cumsum(n)[:-1])) if len(n) else n, n) + np.arange(n.sum())
        at, w = np.repeat(places, n) - self.place[post], self.window_of[post]
        own = np.repeat(doc[places], n)
        fits = (at >= first[own]) & (at + self.length[w] <= first[own + 1])
        at, w = at[fits], w[fits]
        for j in range(self.width):
            longer = self.length[w] > j
            same = ~longer
            same[longer] = numbers[at[longer] + j] == self.words[w[longer], j]
            at, w = at[same], w[same]
        return at, w


def _found_in(docs: DataFrame, block, n: int) -> np.ndarray:
    """In how many documents each of the block's n shingles occurs."""
    def count(batches):
        own, total = block.value, np.zeros(n, np.int64)
        for batch in batches:
            for part in pieces_of(batch, "_input_text"):
                hashes, first = _words(part.column(0))
                doc = text_of(first)
                places, slot = own.known(own.numbers(hashes), doc, own.shingles)
                total += np.bincount(np.unique(doc[places] * n + slot) % n, minlength=n)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["shingle", "docs"])

    rows = docs.mapInArrow(count, "shingle long, docs long").groupBy("shingle").agg(F.sum("docs").alias("docs")).toPandas()
    out = np.zeros(n, np.int64)
    out[rows["shingle"].to_numpy(np.int64)] = rows["docs"].to_numpy(np.int64)
    return out


def _scan(block, schema: str):
    def make():
        own = block.value

        def work(column: pa.Array) -> list:
            hashes, first = _words(column)
            at, w = own.matches(hashes, first)
            doc = text_of(first)
            spans: list[list] = [[] for _ in range(len(first) - 1)]
            items: list[set] = [set() for _ in range(len(first) - 1)]
            covered = np.zeros(len(hashes) + 1, np.int64)
            np.add.at(covered, at, 1)
            np.add.at(covered, at + own.length[w], -1)
            hit = np.cumsum(covered)[:-1] > 0
            for d, k in set(zip(doc[at].tolist(), w.tolist())):
                items[d].update(own.items[k])
            edge = np.flatnonzero(hit & np.concatenate(([True], ~hit[:-1] | (doc[1:] != doc[:-1])))[:len(hit)]) if len(hit) else []
            last = np.flatnonzero(hit & np.concatenate((~hit[1:] | (doc[1:] != doc[:-1]), [True]))[:len(hit)]) if len(hit) else []
            for a, b in zip(edge, last):
                d = int(doc[a])
                spans[d].append({"start": int(a - first[d]), "end": int(b - first[d] + 1)})
            return [np.diff(first).astype(np.int64), sums(hit, first), pa.array([sorted(x) for x in items], pa.list_(pa.int64())),
                    pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))]
        return work
    return make


def contaminated_words(docs: DataFrame, items: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES,
                       keep: list[str] | None = None, text: str = "text") -> DataFrame:
    """Documents with n_words, n_hit, item_ids (of items with occurring windows) and hit_spans (word ranges).

    Null or wordless texts have no words and no hits; wordless items have no windows.  An item
    without an id still marks words, its id is not listed.  Repeated rows and items count once
    per row and per id.  Without items every document is clean.  Columns of docs that have one of
    the new names give way.
    """
    docs, items = tidy(docs), tidy(items)
    spark = docs.sparkSession
    items = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(size / block_bytes))
    numbered = items.withColumn("_block", F.pmod(F.xxhash64("text"), F.lit(blocks)))
    texts = docs.select(F.col(f"`{text}`").cast("string").alias("_input_text"))
    out = None
    for b in range(blocks):
        rows = numbered.where(F.col("_block") == b).select("item_id", "text").distinct().sort("item_id", "text").toArrow()
        block = ItemBlock(rows["item_id"].to_pylist(), rows["text"].combine_chunks(), window)
        n = len(block.shingles)
        block.order(_found_in(texts, spark.sparkContext.broadcast(block), n) if n else np.zeros(0, np.int64))
        sent = spark.sparkContext.broadcast(block)
        if out is None:
            out = add_columns(docs, SCHEMA, _scan(sent, SCHEMA), text, _with(keep, text, docs) if blocks > 1 else keep)
            continue
        before = ["item_ids", "hit_spans"]
        again = add_columns(out.withColumnsRenamed({c: f"_{c}" for c in before}), SCHEMA, _scan(sent, SCHEMA), text)
        out = (again.withColumns({"item_ids": F.array_sort(F.array_union("item_ids", "_item_ids")), "hit_spans": _merged("hit_spans", "_hit_spans")})
               .withColumn("n_hit", F.aggregate("hit_spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])).drop("_item_ids", "_hit_spans"))
    if blocks > 1 and keep is not None and text not in keep:
        out = out.drop(text)
    return out


def _with(keep: list[str] | None, text: str, docs: DataFrame) -> list[str] | None:
    return None if keep is None else [*keep, *([] if text in keep else [text])]


def _merged(a: str, b: str) -> Column:
    """Union of two lists of word ranges as disjoint ranges."""
    joined = F.array_sort(F.concat(a, b))
    start = F.array().cast("array<struct<start: bigint, end: bigint>>")

    def add(acc: Column, s: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        grown = F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"))))
        return F.when((F.size(acc) > 0) & (s["start"] <= last["end"]), grown).otherwise(F.concat(acc, F.array(s)))
    return F.aggregate(joined, start, add)


def clean_documents(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """Documents without any benchmark window, with their own columns."""
    docs = tidy(docs)
    own = [c for c in docs.columns]
    marked = contaminated_words(docs.select(*[F.col(f"`{c}`").alias(f"in_{c}") for c in own]), items, text="in_text", **options)
    return marked.where("n_hit = 0").select(*[F.col(f"`in_{c}`").alias(c) for c in own])


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    out = contaminated_words(docs.select("doc_id", "text"), items, keep=["doc_id"])
    ids = F.array_sort(F.transform("item_ids", lambda x: x.cast("string")))
    return out.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"),
                      F.sha2(F.concat_ws(",", ids), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


_UPPER, _LOWERED = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SPLIT = f"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWERED}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
SQL = f"""
WITH d AS (SELECT doc_id, {_SPLIT} AS w FROM documents),
i AS (SELECT item_id, {_SPLIT} AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, array_to_string(list_slice(w, p, p + 9), ' ') AS g, least(len(w), 10) AS n
        FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS p FROM i WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM win),
dw AS (SELECT doc_id, p, n, array_to_string(list_slice(w, p, p + n - 1), ' ') AS g
       FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, sizes WHERE len(w) >= n)),
m AS (SELECT doc_id, p, dw.n, item_id FROM dw JOIN win ON dw.g = win.g AND dw.n = win.n),
hits AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM m) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids
        FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM m) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hits USING (doc_id) LEFT JOIN its USING (doc_id)"""

QUERIES = {"op5_decontamination": op5_decontamination}
ORACLES = {"op5_decontamination": SQL}
