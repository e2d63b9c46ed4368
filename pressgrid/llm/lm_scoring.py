"""LM scoring: cross-entropy difference of matched target and background bigram models.

Both models are bigram models with additive smoothing over one vocabulary, the distinct words of
all documents.  The background model counts every document, the target model the documents named
as targets.  ``score`` is the target loss minus the background loss per token (lower: closer to the
target); the counts of the scored document itself are left out of both models, so a target does
not score well for having been counted.

    loss(w | h) = ln(c(h) + alpha * V) - ln(c(h, w) + alpha)

splits into one term for each bigram and one for each history, so every term can be computed where
the counts of its key are: a chunk of documents sends its (key, document, count) entries to the shard
of the key, which totals the key over the corpus and returns the sums of each document.  Nothing is
sampled, cut off or broadcast but the heavy keys: those with over HEAVY of the tokens of some chunk
and half as much of the corpus.  There can be no more than 4 / HEAVY of them; they are counted in a scan of
their own and never reach a shard, so no shard is hot.

Keys are 64-bit hashes; a shard tells its keys apart by 56 of the bits, besides those that name it.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import shards
from .arrays import LOWER, SPACED, forget, mix, parts, pieces_of, runs, saved, span_hashes, text_bytes, text_of, tidy

ALPHA = 0.05
HEAVY = 1 / 1024
#: Targets up to this number are broadcast as ids, more are joined by a shuffle.
BROADCAST_TARGETS = 2_000_000

_START = np.uint64(0x5851F42D4C957F2D)
_ENTRY = (["<u1", "<i4", "<u4", "<u1"], [False, True, True, True])
_SUMS = (["<i4", "<f8"], [True, False])
#: Shares of a shard's keys that are sorted one after another, and entries that are worked off at once.
PASSES, STEP = 8, 1 << 18
#: Low bytes of a key that travel to its shard.
KEY_BYTES = 7


def _chunks(batches, ids: bool = False):
    """(rows, word hashes, first word of each text)."""
    for batch in batches:
        for part in pieces_of(batch, "text"):
            data, offsets = text_bytes(part.column("text"))
            data = LOWER[data]
            starts, ends, first = runs(data, offsets, SPACED)
            yield part, span_hashes(data, starts, ends), first, offsets


def _keys(words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(history, bigram) key of every token."""
    before = np.concatenate(([_START], words[:-1])) if len(words) else words
    opens = first[:-1][np.diff(first) > 0]
    before[opens] = _START
    return mix(before), mix(before * np.uint64(0xD6E8FEB86659FD93) + words)


def _survey(n_shards: int):
    """Distinct words of each chunk by shard, and its frequent keys."""
    def run(batches):
        for _, words, first, _ in _chunks(batches):
            distinct = np.unique(words)
            order, cuts = shards.by_shard((distinct % np.uint64(n_shards)).astype(np.int64))
            heavy = []
            for key in _keys(words, first):
                k, n = np.unique(key, return_counts=True)
                heavy += list(zip(k[n > HEAVY * len(words)].view(np.int64).tolist(), n[n > HEAVY * len(words)].tolist()))
            names = ["shard", "words", "tokens", "heavy"]
            yield shards.rows(names, [[s for s, _, _ in cuts] + [0], [distinct[order[a:b]].tobytes() for _, a, b in cuts] + [None],
                                      [0] * len(cuts) + [len(words)], [None] * len(cuts) + [[{"key": a, "n": b} for a, b in heavy]]],
                              [pa.int32(), pa.binary(), pa.int64(), pa.list_(pa.struct([("key", pa.int64()), ("n", pa.int64())]))])
    return run


def _distinct(batches):
    for _, got in shards.each_shard(batches, ["words"]):
        blobs = [np.frombuffer(b, "<u8") for b in got["words"]]
        yield pa.RecordBatch.from_arrays([pa.array([len(np.unique(np.concatenate(blobs)))])], names=["n"])


def _place(sorted_keys: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Index in sorted_keys, -1 if not there."""
    if not len(sorted_keys):
        return np.full(len(keys), -1)
    at = np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)
    return np.where(sorted_keys[at] == keys, at, -1)


def _count_heavy(heavy: np.ndarray):
    def run(batches):
        total = np.zeros((2, len(heavy)), np.int64)
        for part, words, first, _ in _chunks(batches):
            target = part.column("target").to_numpy(zero_copy_only=False).astype(bool)[text_of(first)]
            for key in _keys(words, first):
                at = _place(heavy, key)
                total[0] += np.bincount(at[at >= 0], minlength=len(heavy))
                total[1] += np.bincount(at[(at >= 0) & target], minlength=len(heavy))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(heavy))), pa.array(total[0]), pa.array(total[1])], names=["key", "b", "t"])
    return run


def _losses(kind: np.ndarray, n: np.ndarray, cb: np.ndarray, ct: np.ndarray, target: np.ndarray, alpha: float, vocab: int) -> tuple[np.ndarray, np.ndarray]:
    """(target, background) terms of entries; kind 0 is a history, 1 a bigram; own counts are left out."""
    add = np.where(kind == 0, alpha * vocab, alpha)
    sign = np.where(kind == 0, 1.0, -1.0) * n
    return sign * np.log(ct - n * target + add), sign * np.log(cb - n + add)


def _entries(n_shards: int, heavy, alpha: float, vocab: int):
    names = ["shard", "chunk", "entries", "ids", "tokens", "sums"]
    types = [pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary()]

    def run(batches):
        import xxhash
        keys, cb, ct = heavy.value
        for part, words, first, offsets in _chunks(batches):
            docs = part.num_rows
            target = part.column("target").to_numpy(zero_copy_only=False).astype(bool)
            doc = text_of(first)
            ids, nulls = part.column("id").fill_null(0).to_numpy(), part.column("id").is_null().to_numpy(zero_copy_only=False)
            # the row numbers make the name unique even where chunks repeat each other
            row = part.column("row").to_numpy()
            chunk = xxhash.xxh64_intdigest(ids.tobytes() + row.tobytes() + words.tobytes()) >> 1
            key, own, kind, count = [], [], [], []
            for k, v in enumerate(_keys(words, first)):
                salted = mix(v ^ mix(doc.astype(np.uint64)))
                _, at, n = np.unique(salted, return_index=True, return_counts=True)
                key.append(v[at]); own.append(doc[at]); kind.append(np.full(len(at), k, np.uint8)); count.append(n)
            key, own, kind, count = (np.concatenate(x) for x in (key, own, kind, count))
            place = _place(keys, key)
            hot = place >= 0
            lt, lb = _losses(kind[hot], count[hot], cb[place[hot]], ct[place[hot]], target[own[hot]], alpha, vocab)
            sums = np.stack([np.bincount(own[hot], lt, docs), np.bincount(own[hot], lb, docs)])
            key, own, kind, count = (x[~hot] for x in (key, own, kind, count))
            by_doc = np.argsort(own, kind="stable")
            key, own, kind, count = (x[by_doc] for x in (key, own, kind, count))
            order, cuts = shards.by_shard(((key >> np.uint64(41)) % np.uint64(n_shards)).astype(np.int64))
            mark = kind | (target[own].astype(np.uint8) << 1)
            blobs = [shards.pack([shards.low_bytes(key[order[a:b]], KEY_BYTES), own[order[a:b]].astype(np.int32), count[order[a:b]].astype(np.uint32), mark[order[a:b]]], _ENTRY[1]) for _, a, b in cuts]
            m = len(cuts)
            yield shards.rows(names, [[s for s, _, _ in cuts] + [int(chunk % n_shards)], [chunk] * (m + 1), blobs + [None],
                                      [None] * m + [ids.tobytes() + nulls.tobytes()], [None] * m + [np.diff(first).astype(np.int64).tobytes()], [None] * m + [sums.tobytes()]], types)
    return run


def _shard_losses(key: np.ndarray, n: np.ndarray, mark: np.ndarray, alpha: float, vocab: int) -> np.ndarray:
    """(target, background) terms of a shard's entries, worked off in runs of STEP entries by key."""
    key = (key << np.uint64(1)) | (mark & 1)
    order = np.argsort(key).astype(np.uint32)
    ranked = key[order]
    head = np.flatnonzero(np.concatenate(([True], ranked[1:] != ranked[:-1])))
    out = np.empty((2, len(n)))
    at = 0
    while at < len(head):
        to = max(at + 1, int(np.searchsorted(head, head[at] + STEP)))
        a, b = head[at], head[to] if to < len(head) else len(n)
        some, own = order[a:b], head[at:to] - a
        count, target = n[some].astype(np.int64), (mark[some] >> 1).astype(np.int64)
        size = np.diff(np.append(own, b - a))
        cb, ct = np.repeat(np.add.reduceat(count, own), size), np.repeat(np.add.reduceat(count * target, own), size)
        out[0, some], out[1, some] = _losses(mark[some] & 1, count, cb, ct, target, alpha, vocab)
        at = to
    return out


def _total(alpha: float, vocab: int):
    names = ["chunk", "shard", "ids", "tokens", "sums"]
    types = [pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]

    def run(batches):
        for shard, got in shards.each_shard(batches, ["chunk", "entries", "ids", "tokens", "sums"]):
            meta = [k for k, x in enumerate(got["ids"]) if x is not None]
            if meta:
                yield shards.rows(names, [[got["chunk"][k] for k in meta], [-1] * len(meta)] + [[bytes(got[c][k]) for k in meta] for c in ("ids", "tokens", "sums")], types)
            some = [k for k, e in enumerate(got["entries"]) if e is not None]
            if not some:
                continue
            chunks = [got["chunk"][k] for k in some]
            blobs = [got["entries"][k] for k in some]
            del got
            doc = [shards.unpack(b, *_ENTRY)[1] for b in blobs]
            bound = np.cumsum([0] + [len(x) for x in doc])
            doc, terms = np.concatenate(doc), np.empty((2, bound[-1]))
            for part in range(PASSES):  # a share of the keys at a time, so that sorting them takes little memory
                place, key, n, mark = [], [], [], []
                for at, blob in zip(bound.tolist(), blobs):
                    low, _, count, kind = shards.unpack(blob, *_ENTRY)
                    own = np.flatnonzero(low[::KEY_BYTES] % PASSES == part)
                    place.append(own + at)
                    key.append(shards.from_low_bytes(low.reshape(-1, KEY_BYTES)[own].reshape(-1), KEY_BYTES))
                    n.append(count[own])
                    mark.append(kind[own])
                place = np.concatenate(place)
                terms[:, place] = _shard_losses(np.concatenate(key), np.concatenate(n), np.concatenate(mark), alpha, vocab)
            del blobs
            for a in range(0, len(chunks), 64):
                back = []
                for k in range(a, min(a + 64, len(chunks))):
                    own = doc[bound[k]:bound[k + 1]]
                    first = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
                    sums = np.add.reduceat(terms[:, bound[k]:bound[k + 1]], first, axis=1)
                    back.append(shards.pack([own[first], sums.reshape(-1)], _SUMS[1]))
                yield shards.rows(names, [chunks[a:a + 64], [shard] * len(back), [None] * len(back), [None] * len(back), back], types)
    return run


def _gather(table):
    rows = sorted(table.to_pylist(), key=lambda r: r["shard"])
    meta = rows[0]
    tokens = np.frombuffer(meta["tokens"], np.int64)
    n = len(tokens)
    ids = np.frombuffer(meta["ids"][:8 * n], np.int64)
    null = np.frombuffer(meta["ids"][8 * n:], np.bool_)
    total = np.frombuffer(meta["sums"], np.float64).reshape(2, n).copy()
    for r in rows[1:]:
        doc, sums = shards.unpack(r["sums"], *_SUMS)
        total[:, doc] += sums.reshape(2, -1)
    with np.errstate(divide="ignore", invalid="ignore"):
        lt, lb = total / tokens
    empty = tokens == 0
    return pa.table({"doc_id": pa.array(ids, mask=null), "n_tokens": pa.array(tokens), "loss_target": pa.array(lt, mask=empty),
                     "loss_background": pa.array(lb, mask=empty), "score": pa.array(lt - lb, mask=empty)})


def cross_entropy_difference(docs: DataFrame, targets: DataFrame, alpha: float = ALPHA, broadcast_targets: int = BROADCAST_TARGETS,
                             text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, n_tokens, loss_target, loss_background, score) of every document; targets: table of target ids.

    A text without words (null, empty) has null losses.  A row without an id is scored and counts as
    background.  Repeated rows are documents of their own; repeated target ids count once.  Without
    targets the target model is the smoothing alone.  No documents, no rows.
    """
    docs, spark = tidy(docs), docs.sparkSession
    n = parts(spark)
    named = tidy(targets).select(F.col(f"`{id_col}`").cast("long").alias("id")).where("id is not null").distinct().withColumn("target", F.lit(True))
    if named.count() <= broadcast_targets:
        named = F.broadcast(named)
    source = (docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text}`").cast("string").alias("text"))
              .join(named, "id", "left").withColumns({"target": F.coalesce("target", F.lit(False)), "row": F.monotonically_increasing_id()}))
    survey = saved(docs.select(F.col(f"`{text}`").cast("string").alias("text")).mapInArrow(_survey(n), "shard int, words binary, tokens long, heavy array<struct<key: long, n: long>>"), "survey")
    vocab = survey.where("words is not null").select("shard", "words").repartition(n, "shard").sortWithinPartitions("shard").mapInArrow(_distinct, "n long").agg(F.sum("n")).first()[0] or 1
    tokens = survey.agg(F.sum("tokens")).first()[0] or 0
    common = survey.select(F.explode("heavy").alias("h")).groupBy("h.key").agg(F.sum("h.n").alias("n")).where(F.col("n") > HEAVY / 2 * tokens).select("key").toArrow()
    heavy = np.sort(common["key"].to_numpy().view(np.uint64))
    forget(survey)
    counts = source.mapInArrow(_count_heavy(heavy), "key long, b long, t long").groupBy("key").agg(F.sum("b").alias("b"), F.sum("t").alias("t")).toArrow().sort_by("key")
    heavy_counts = (heavy, counts["b"].to_numpy(), counts["t"].to_numpy()) if len(heavy) else (heavy, np.zeros(0, np.int64), np.zeros(0, np.int64))
    sent = source.mapInArrow(_entries(n, spark.sparkContext.broadcast(heavy_counts), alpha, vocab),
                             "shard int, chunk long, entries binary, ids binary, tokens binary, sums binary")
    back = (sent.repartitionById(n, F.col("shard")).sortWithinPartitions("shard")
            .mapInArrow(_total(alpha, vocab), "chunk long, shard int, ids binary, tokens binary, sums binary"))
    return back.groupBy("chunk").applyInArrow(_gather, "doc_id long, n_tokens long, loss_target double, loss_background double, score double")


def op1_cross_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    out = cross_entropy_difference(docs.select("doc_id", "text"), labels.where("quality = 1 and toxic = 0").select("doc_id"))
    return out.select("doc_id", "n_tokens", *[F.round(c, 6).alias(c) for c in ("loss_target", "loss_background", "score")])


_UPPER, _LOWERED = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SQL = f"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWERED}'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
tg AS (SELECT DISTINCT doc_id FROM labels WHERE quality = 1 AND toxic = 0),
tok AS (SELECT doc_id, w[p] AS w, CASE WHEN p > 1 THEN w[p - 1] ELSE ' ' END AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS p FROM d)),
v AS (SELECT count(DISTINCT w) * {ALPHA}::DOUBLE AS av FROM tok),
k AS (SELECT doc_id, 0 AS kind, h AS k, count(*) AS n FROM tok GROUP BY ALL UNION ALL SELECT doc_id, 1, h || ' ' || w, count(*) FROM tok GROUP BY ALL),
kt AS (SELECT k.*, CASE WHEN tg.doc_id IS NULL THEN 0 ELSE n END AS nt FROM k LEFT JOIN tg USING (doc_id)),
c AS (SELECT *, sum(n) OVER (PARTITION BY kind, k) - n AS cb, sum(nt) OVER (PARTITION BY kind, k) - nt AS ct FROM kt),
s AS (SELECT doc_id, sum(CASE kind WHEN 0 THEN n * ln(ct + av) ELSE -n * ln(ct + {ALPHA}::DOUBLE) END) AS lt,
             sum(CASE kind WHEN 0 THEN n * ln(cb + av) ELSE -n * ln(cb + {ALPHA}::DOUBLE) END) AS lb FROM c, v GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_tokens, round(lt / len(w), 6) AS loss_target, round(lb / len(w), 6) AS loss_background,
       round((lt - lb) / len(w), 6) AS score FROM d LEFT JOIN s USING (doc_id)"""

QUERIES = {"op1_cross_entropy": op1_cross_entropy}
ORACLES = {"op1_cross_entropy": SQL}
