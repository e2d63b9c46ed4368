"""Substring deduplication by relative Lempel-Ziv parsing.

Every document is parsed against references taken from all documents: a factor is a run of words
that copies a run which starts earlier (smaller doc_id, or the same document before).  A word in a
window of ``window`` words that also starts earlier is a duplicate.

Index.  The reference index is cut into blocks by anchors.  The anchor of a window is its k-gram with
the smallest hash, so equal windows have equal anchors at equal places; consecutive windows mostly
share theirs, and one index entry (anchor, document, place, window hashes) serves a run of windows.
A chunk of documents first factors itself, so of a sequence that repeats in it only the first start
goes on; every other entry goes to the block of its anchor.  There, entries of anchors that occur once
are dropped and each remaining window finds the earliest start of its sequence.

Parse.  A document's windows come back as runs that copy from one place.  In order of their start
they are joined greedily while the copied place moves on with them; where one ends, the windows
across its boundary have been looked up like all others, so no duplicate span is lost between two
factors.

Words and windows are compared by 64-bit hashes, windows of one anchor by the 64 bits of the anchor
and 40 of their own.
"""
from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from . import shards
from .arrays import SPACED, _power, gram_hashes, mix, parts, pieces_of, runs, span_hashes, text_bytes, text_of, tidy

WINDOW = 20
ANCHOR = 5
SCHEMA = "n_words long, n_removed long, kept_text string, factors array<struct<start: long, length: long, ref_doc: long, ref_start: long>>"
NO_ID = -(1 << 63)

_RUN = "shard int, entries binary, found binary"
_ENTRY = (["<i8", "<u2", "<i4", "<u1", "<u8", "<u1"], [True, False, True, True, False, False])
_FOUND = (["<i8", "<u2", "<i4", "<i4", "<i8", "<i4"], [True, False, True, True, True, True])


def _anchors(g: np.ndarray, width: int) -> np.ndarray:
    """Place of the smallest of the ``width`` values from each place on, the leftmost of equals."""
    at, span = np.arange(len(g)), 1
    while span < width:
        step = min(span, width - span)
        left, right = at[:len(at) - step], at[step:]
        at = np.where(g[left] <= g[right], left, right)
        span += step
    return at


def _breaks(*columns: tuple[np.ndarray, int]) -> np.ndarray:
    """Where a run starts: a column does not follow its predecessor by its step."""
    n = len(columns[0][0])
    new = np.zeros(n, bool)
    if n:
        new[0] = True
    for c, step in columns:
        new[1:] |= c[1:] != c[:-1] + step
    return np.flatnonzero(new)


def _first_starts(key: np.ndarray, doc: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(is a duplicate, earliest doc, earliest place) of each entry among those with its key."""
    order = np.lexsort((place, doc, key))
    ranked = key[order]
    head = np.flatnonzero(np.concatenate(([True], ranked[1:] != ranked[:-1]))) if len(ranked) else np.zeros(0, np.int64)
    size = np.diff(np.append(head, len(ranked)))
    first = np.empty(len(key), np.int64)
    first[order] = np.repeat(order[head], size)
    return (doc[first] != doc) | (place[first] != place), doc[first], place[first]


def _found_runs(doc, tag, place, ref_doc, ref_place) -> list[np.ndarray]:
    """Consecutive duplicate windows that copy consecutive windows: one run."""
    at = _breaks((doc, 0), (tag, 0), (place, 1), (ref_doc, 0), (ref_place, 1))
    n = np.diff(np.append(at, len(doc)))
    return [doc[at], tag[at], place[at].astype(np.int32), n.astype(np.int32), ref_doc[at], ref_place[at].astype(np.int32)]


def _index(window: int, anchor: int, blocks: int):
    def run(batches):
        for batch in batches:
            for part in pieces_of(batch, "text"):
                data, offsets = text_bytes(part.column("text"))
                ids = part.column("key").to_numpy()
                tags = part.column("tag").to_numpy().astype(np.uint16)
                starts, ends, first = runs(data, offsets, SPACED)
                words = span_hashes(data, starts, ends)
                n = len(words) - window + 1
                if n <= 0:
                    continue
                doc = text_of(first)
                own = np.flatnonzero(np.arange(n) + window <= first[doc[:n] + 1])
                g = gram_hashes(words, anchor)
                at = _anchors(g, window - anchor + 1)[own]
                total = np.zeros(len(words) + 1, np.uint64)
                np.cumsum(words * _power("up", len(words)), out=total[1:])
                seq = mix((total[own + window] - total[own]) * _power("down", len(words))[own])
                head = g[at]
                d, place = ids[doc[own]], own - first[doc[own]]
                tag = tags[doc[own]]
                # sequences that repeat inside the chunk: only the first start goes on
                _, which, count = np.unique(head, return_inverse=True, return_counts=True)
                again = np.flatnonzero(count[which] > 1)
                dup, rd, rp = _first_starts(seq[again], d[again], place[again])
                gone = again[dup]
                found = _found_runs(d[gone], tag[gone], place[gone], rd[dup], rp[dup])
                stay = np.ones(len(own), bool)
                stay[gone] = False
                own, at, seq, head, d, place, tag = (x[stay] for x in (own, at, seq, head, d, place, tag))
                begin = _breaks((at, 0), (own, 1), (doc[own], 0))
                size = np.diff(np.append(begin, len(own)))
                block = ((head[begin] >> np.uint64(20)) % np.uint64(blocks)).astype(np.int64)
                order, cuts = shards.by_shard(block)
                bound = np.concatenate(([0], np.cumsum(size[order])))
                flat = np.repeat(begin[order] - bound[:-1], size[order]) + np.arange(bound[-1])
                entry = [d[begin][order], tag[begin][order], place[begin][order].astype(np.int32), size[order].astype(np.uint8), head[begin][order]]
                out = {s: [shards.pack([x[a:b] for x in entry] + [shards.low_bytes(seq[flat[bound[a]:bound[b]]], 5)], _ENTRY[1]), None] for s, a, b in cuts}
                if len(found[0]):
                    # already found: any block hands them on, dealt by document
                    order, cuts = shards.by_shard((mix(found[0].astype(np.uint64)) % np.uint64(blocks)).astype(np.int64))
                    for s, a, b in cuts:
                        out.setdefault(s, [None, None])[1] = shards.pack([x[order][a:b] for x in found], _FOUND[1])
                yield shards.rows(["shard", "entries", "found"], [list(out), [v[0] for v in out.values()], [v[1] for v in out.values()]], [pa.int32(), pa.binary(), pa.binary()])
    return run


def _resolve(batches):
    names = ["key", "tag", "start", "n", "ref_doc", "ref_start"]

    def batch_of(cols: list[np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c.astype(t)) for c, t in zip(cols, (np.int64, np.int32, np.int32, np.int32, np.int64, np.int32))], names=names)

    for _, got in shards.each_shard(batches, ["entries", "found"]):
        for blob in got["found"]:
            if blob is not None:
                yield batch_of(shards.unpack(blob, *_FOUND))
        entries = [shards.unpack(b, *_ENTRY) for b in got["entries"] if b is not None]
        if not entries:
            continue
        d, tag, place, size, head = (np.concatenate([e[i] for e in entries]) for i in range(5))
        seq = np.concatenate([shards.from_low_bytes(e[5], 5) for e in entries])
        _, which, count = np.unique(head, return_inverse=True, return_counts=True)
        size = size.astype(np.int64)
        begin = np.cumsum(size) - size
        some = np.flatnonzero(count[which] > 1)
        n = size[some]
        row = np.repeat(some, n)
        step = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        key = mix(head[row] ^ mix(seq[begin[row] + step]))
        dd, pp = d[row], place[row].astype(np.int64) + step
        dup, rd, rp = _first_starts(key, dd, pp)
        yield batch_of(_found_runs(dd[dup], tag[row][dup], pp[dup], rd[dup], rp[dup]))


def parse(found: list[dict], window: int) -> list[dict]:
    """Greedy factors from the runs of one document."""
    factors: list[dict] = []
    for r in sorted(found, key=lambda r: (r["start"], -r["n"], r["ref_doc"], r["ref_start"])):
        last = factors[-1] if factors else None
        if last and r["ref_doc"] == last["ref_doc"] and r["ref_start"] - r["start"] == last["ref_start"] - last["start"] and r["start"] <= last["start"] + last["length"]:
            last["length"] = max(last["length"], r["start"] + r["n"] + window - 1 - last["start"])
        else:
            factors.append({"start": r["start"], "length": r["n"] + window - 1, "ref_doc": r["ref_doc"], "ref_start": r["ref_start"]})
    return factors


def _strip(window: int, names: list[str], inner: pa.DataType):
    def run(batches):
        for batch in batches:
            for part in pieces_of(batch, "text"):
                n_words, n_removed, kept, factors = [], [], [], []
                for text, found in zip(part.column("text").to_pylist(), part.column("found").to_pylist()):
                    words = (text or "").encode().split()
                    own = parse(found or [], window)
                    left, at = [], 0
                    for f in own:
                        left += words[at:max(f["start"], at)]
                        at = max(at, f["start"] + f["length"])
                    left += words[at:]
                    n_words.append(len(words))
                    n_removed.append(len(words) - len(left))
                    kept.append(b" ".join(left).decode())
                    factors.append(own)
                stay = [part.column(i) for i in range(part.num_columns - 2)]
                yield pa.RecordBatch.from_arrays(stay + [pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string()), pa.array(factors, inner)], names=names)
    return run


def without_repeats(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, keep: list[str] | None = None, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Documents with n_words, n_removed, kept_text (kept words joined by a blank) and their factors.

    Null has no words.  A null id counts as the smallest one.  Rows that repeat an id and a text are one
    document and get the same result; rows that repeat an id with another text are told apart by a
    16-bit checksum of the text.  Columns of docs that have a new name give way.
    """
    docs, out = tidy(docs), StructType.fromDDL(SCHEMA)
    stay = [c for c in (docs.columns if keep is None else keep) if c.lower() not in {f.name for f in out}]
    n = parts(docs.sparkSession)
    key = F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(NO_ID)).alias("key")
    tag = F.pmod(F.xxhash64(F.col(f"`{text}`").cast("string")), F.lit(1 << 16)).cast("int").alias("tag")
    body = F.col(f"`{text}`").cast("string").alias("text")
    sent = docs.select(key, tag, body).mapInArrow(_index(window, anchor, 4 * n), _RUN)
    found = (sent.repartition(n, "shard").sortWithinPartitions("shard")
             .mapInArrow(_resolve, "key long, tag int, start int, n int, ref_doc long, ref_start int")
             .groupBy("key", "tag").agg(F.collect_list(F.struct("start", "n", "ref_doc", "ref_start")).alias("found")))
    own = docs.select(*[F.col(f"`{c}`").alias(f"in{i}") for i, c in enumerate(stay)], key, tag, body)
    both = own.join(found, ["key", "tag"], "left").select(*[f"in{i}" for i in range(len(stay))], "text", "found")
    schema = StructType([docs.schema[c] for c in stay] + list(out))
    inner = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "ref_doc", "ref_start")]))
    return both.mapInArrow(_strip(window, schema.names, inner), schema)


def op3_rlz_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = without_repeats(docs, keep=["doc_id"])
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, p, md5(array_to_string(list_slice(w, p, p + 19), ' ')) AS g
        FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS p FROM d WHERE len(w) >= 20)),
dup AS (SELECT doc_id, p FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY g ORDER BY doc_id, p) AS r FROM win) WHERE r > 1),
gone AS (SELECT DISTINCT doc_id, q FROM (SELECT doc_id, unnest(range(p, p + 20)) AS q FROM dup)),
word AS (SELECT doc_id, unnest(w) AS t, unnest(range(1, len(w) + 1)) AS q FROM d),
kept AS (SELECT doc_id, count(*) AS n, string_agg(t, ' ' ORDER BY q) AS s FROM word ANTI JOIN gone USING (doc_id, q) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(s, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)"""

QUERIES = {"op3_rlz_dedup": op3_rlz_dedup}
ORACLES = {"op3_rlz_dedup": SQL}
