"""Quality rules: zstandard ratio bands over whole documents and fixed chunks, by length.

``ratio`` is raw bytes by compressed bytes.  Repetitive text compresses too well, random or encoded
text hardly at all; how well natural text compresses depends on its length, so every length class
has its own limits.  A document is kept if its whole ratio lies inside its band and at most
``max_bad_chunks`` of its fixed chunks lie outside the band of their length.  Base rules on word
counts and repeated 3-word windows come first.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, functions as F

from .arrays import NOT_NEWLINE, SPACED, add_columns, gram_hashes, mix, runs, span_hashes, sums, text_bytes, text_of, tidy

LEVEL = 3
CHUNK = 4096
#: (least bytes, lowest ratio, highest ratio); texts shorter than the first class are not judged by ratio.
#: The lowest are fitted_bands() of the documents that labels calls good in check_l: other corpora need bands of their own.
BANDS = ((256, 1.293, 2.8), (512, 1.418, 2.8), (768, 1.496, 2.8), (1024, 1.614, 3.5), (1536, 1.721, 3.5), (2048, 1.767, 3.5), (4096, 1.933, 4.5),
         (8192, 2.122, 4.5), (16384, 2.225, 4.5), (32768, 2.288, 6.0))
MAX_BAD_CHUNKS = 0.34

_SYMBOL = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", np.uint8))
SCHEMA = ("n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, ratio double, "
          "n_chunks long, n_bad_chunks long, base_failed boolean, kept boolean")


def _counts(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    n = len(offsets) - 1
    starts, ends, first = runs(data, offsets, SPACED)
    doc = text_of(first)
    words = np.diff(first)
    letters = SPACED[data] & ((data & 0xC0) != 0x80)

    lines, line_ends, first_line = runs(data, offsets, NOT_NEWLINE)
    worded = np.searchsorted(starts, line_ends) > np.searchsorted(starts, lines)
    line_doc = text_of(first_line)[worded]
    line = mix(span_hashes(data, lines[worded], line_ends[worded]) ^ mix(line_doc.astype(np.uint64)))
    distinct, at = np.unique(line, return_index=True)
    dup_lines = np.bincount(line_doc, minlength=n) - np.bincount(line_doc[at], minlength=n)

    grams = gram_hashes(span_hashes(data, starts, ends), 3)
    inside = np.arange(len(grams)) + 3 <= first[doc[:len(grams)] + 1]
    where = np.flatnonzero(inside)
    own = mix(grams[where] ^ mix(doc[where].astype(np.uint64)))
    order = np.argsort(own)
    ranked = own[order]
    same = ranked[1:] == ranked[:-1]
    twice = np.zeros(len(own), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(len(doc), bool)
    for j in range(3):
        covered[where[twice] + j] = True
    return [words, sums(letters, offsets), sums(_SYMBOL[data], offsets), dup_lines, sums(covered, first)]


def band(size: int, bands: tuple) -> tuple[float, float]:
    """(lowest, highest) ratio of texts of that many bytes."""
    limits = (0.0, float("inf"))
    for least, low, high in bands:
        if size >= least:
            limits = (low, high)
    return limits


def _make(level: int, chunk: int, bands: tuple, max_bad: float):
    def make():
        press = zstandard.ZstdCompressor(level=level)

        def ratio(raw) -> float:
            return len(raw) / len(press.compress(raw)) if len(raw) else 0.0

        def work(column: pa.Array) -> list:
            data, offsets = text_bytes(column)
            words, chars, symbols, dups, repeats = (x.astype(np.int64) for x in _counts(data, offsets))
            raw, n = memoryview(np.ascontiguousarray(data)), len(column)
            ratios, chunks, bad = np.zeros(n), np.zeros(n, np.int64), np.zeros(n, np.int64)
            fits = np.zeros(n, bool)
            for k in range(n):
                a, b = int(offsets[k]), int(offsets[k + 1])
                ratios[k] = ratio(raw[a:b])
                low, high = band(b - a, bands)
                inside = low <= ratios[k] <= high
                if b - a > chunk:
                    for p in range(a, b, chunk):
                        q = min(p + chunk, b)
                        low, high = band(q - p, bands)
                        chunks[k] += 1
                        bad[k] += not low <= ratio(raw[p:q]) <= high
                fits[k] = inside and bad[k] <= max_bad * chunks[k]
            failed = (words < 50) | (100 * repeats > 50 * words)
            return [words, chars, symbols, dups, repeats, ratios, chunks, bad, failed, fits & ~failed]
        return work
    return make


def quality(docs: DataFrame, level: int = LEVEL, chunk: int = CHUNK, bands: tuple = BANDS, max_bad_chunks: float = MAX_BAD_CHUNKS,
            keep: list[str] | None = None, text: str = "text") -> DataFrame:
    """Documents with the base counts, whole ratio, chunk counts, base_failed and kept.

    Null is the empty text: no words, ratio 0, base_failed, not kept.  Every row is judged by its own
    text, so repeated rows get the same verdict.  Columns of docs that have a new name give way.
    """
    return add_columns(docs, SCHEMA, _make(level, chunk, bands, max_bad_chunks), text, keep)


def good_documents(docs: DataFrame, **options) -> DataFrame:
    """Documents that pass, with their own columns."""
    docs = tidy(docs)
    inner = docs.select(*[F.col(f"`{c}`").alias(f"in_{c}") for c in docs.columns])
    passed = quality(inner, text="in_text", **options).where("kept")
    return passed.select(*[F.col(f"`in_{c}`").alias(c) for c in docs.columns])


def fitted_bands(docs: DataFrame, bands: tuple = BANDS, margin: float = 0.01, held_out: int = 5, id_col: str = "doc_id",
                 text: str = "text", **options) -> tuple[tuple, int, int]:
    """(bands, held-out texts, held-out texts that they reject): lowest ratios from documents that are known to be good.

    A class's lowest ratio is the least one of its texts, less the margin, cut to three decimals.  Texts that the base
    rules fail take no part, nor does the part of ids that crc32 leaves for the report (one in held_out; a null id is
    never held out).  A class without texts has the limit of the class below it, 0 in the first; the highest ratios stay.
    """
    inner = tidy(docs).select(F.col(f"`{id_col}`").cast("string").alias("in_id"), F.col(f"`{text}`").cast("string").alias("in_text"))
    inner = inner.withColumn("in_bytes", F.octet_length("in_text"))
    held = F.coalesce(F.crc32(F.col("in_id").cast("binary")) % held_out == 0, F.lit(False))
    measured = quality(inner, text="in_text", keep=["in_id", "in_bytes"], **options).where("not base_failed")
    size = F.lit(0)
    for least, _, _ in bands:
        size = F.when(F.col("in_bytes") >= least, least).otherwise(size)
    lowest = dict(measured.where(~held).groupBy(size.alias("size")).agg(F.min("ratio")).collect())  # one row a class
    new, limit = [], 0.0
    for least, _, high in bands:
        if least in lowest:
            limit = int(lowest[least] * (1 - margin) * 1000) / 1000
        new.append((least, limit, high))
    judged = quality(inner.where(held), text="in_text", bands=tuple(new), **options).where("not base_failed")
    n, bad = judged.agg(F.count("*"), F.count(F.when(~F.col("kept"), 1))).first()
    return tuple(new), n, bad


def op7_compression_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return quality(docs, keep=["doc_id"])


QUERIES = {"op7_compression_bands": op7_compression_bands}
ORACLES: dict[str, str] = {}
