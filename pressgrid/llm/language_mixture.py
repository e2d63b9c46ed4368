"""Language identification by multilingual mixture inference.

Each language is a distribution over character trigrams of padded words, counted over all training
documents.  A document is a mixture of languages: expectation-maximisation over its words, each with
its trigram likelihood in every language, estimates the proportions to a tolerance.  The language set is the one
of the nested sets of leading languages, up to all of them, with the best penalised likelihood; each further language
costs ``PENALTY`` times the logarithm of the number of words.  The prediction is the leading language of
the set, the score its proportion in it.

The model is a table of languages times hashed trigrams, so what is collected and broadcast is
bounded by ``BUCKETS`` numbers a language, whatever the size of the corpus.
"""
from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .arrays import add_columns, mix, pieces_of, runs, text_bytes, text_of, tidy

BUCKETS = 1 << 17
SMOOTHING = 0.5
PENALTY = 2.0
#: Rounds go on until the log likelihood of a text is at most this below its maximum.
GAP = 0.01
#: No share of a set falls below this; a set's rounds start at no less than that.
LEAST_SHARE, START_SHARE = 1e-12, 1e-3
UNKNOWN = "und"
SCHEMA = "lang_pred string, score double, languages array<struct<lang: string, share: double>>"


@cache
def _letters() -> tuple[np.ndarray, np.ndarray]:
    """(is a letter, lower case where that is one character) of every code point."""
    chars = [chr(i) for i in range(0x110000)]
    lower = [c.lower() for c in chars]
    return np.array([c.isalpha() for c in chars]), np.array([ord(b if len(b) == 1 else a) for a, b in zip(chars, lower)], np.uint32)


def trigrams(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket of each letter with its neighbours, bounds of the words, bounds of the texts in words)."""
    data, offsets = text_bytes(column)
    points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    begins = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))[offsets]
    is_letter, lower = _letters()
    starts, ends, first = runs(points, begins, is_letter)
    size = ends - starts
    bound = np.concatenate(([0], np.cumsum(size)))
    cur = lower[points[np.repeat(starts - bound[:-1], size) + np.arange(bound[-1])]].astype(np.uint64)
    before, after = np.zeros(len(cur), np.uint64), np.zeros(len(cur), np.uint64)
    if len(cur):
        before[1:], after[:-1] = cur[:-1], cur[1:]
        before[bound[:-1]] = 0
        after[bound[1:] - 1] = 0
    return (mix((before << np.uint64(42)) | (cur << np.uint64(21)) | after) % np.uint64(BUCKETS)).astype(np.int64), bound, first


def train(docs: DataFrame, text: str = "text", lang: str = "lang") -> tuple[list[str], np.ndarray]:
    """(languages, log probabilities[language, bucket]) from documents with a language."""
    source = tidy(docs).select(F.col(f"`{lang}`").cast("string").alias("lang"), F.col(f"`{text}`").cast("string").alias("text")).where("lang is not null")

    def count(batches):
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            for part in pieces_of(batch, "text"):
                grams, bound, first = trigrams(part.column("text"))
                coded = part.column("lang").dictionary_encode()
                code = np.repeat(np.repeat(coded.indices.to_numpy(), np.diff(first)), np.diff(bound))
                for k, name in enumerate(coded.dictionary.to_pylist()):
                    total.setdefault(name, np.zeros(BUCKETS, np.int64))
                    total[name] += np.bincount(grams[code == k], minlength=BUCKETS)
        for name, n in total.items():
            some = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(some), pa.string()), pa.array(some), pa.array(n[some])], names=["lang", "bucket", "n"])

    table = source.mapInArrow(count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    names = sorted(set(table["lang"].to_pylist()))
    place = {x: k for k, x in enumerate(names)}
    counts = np.zeros((len(names), BUCKETS))
    counts[[place[x] for x in table["lang"].to_pylist()], table["bucket"].to_numpy()] = table["n"].to_numpy()
    return names, np.log((counts + SMOOTHING) / (counts.sum(axis=1, keepdims=True) + SMOOTHING * BUCKETS)) if names else counts


def _rises(share: np.ndarray, like: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Factor by which the next round multiplies each share[text, language]; every text has words."""
    like = like / (share[text_of(first)] * like).sum(axis=1, keepdims=True)
    return np.add.reduceat(like, first[:-1], axis=0) / np.diff(first)[:, None]


def _some(texts: np.ndarray, like: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words and bounds of the texts marked."""
    n = np.diff(first)
    return like[np.repeat(texts, n)], np.concatenate(([0], np.cumsum(n[texts])))


def _converged(share: np.ndarray, like: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Shares whose log likelihood is at most GAP below the best one over the languages that have a share.

    The best is never more than n * log(largest rise) above: the mean of a logarithm is below the
    logarithm of the mean.  Texts that are there leave the rounds.
    """
    share, left, inside = share.copy(), np.arange(len(share)), share > 0
    while len(left):
        now, own = share[left], inside[left]
        rise = np.where(own, _rises(now, like, first), 0)
        more = np.diff(first) * np.log(rise.max(axis=1)) > GAP
        now = np.where(own, np.maximum(now * rise, LEAST_SHARE), 0)
        share[left] = now / now.sum(axis=1, keepdims=True)
        if not more.all():
            like, first = _some(more, like, first)
            left = left[more]
    return share


def _log_likelihood(share: np.ndarray, like: np.ndarray, first: np.ndarray) -> np.ndarray:
    return np.add.reduceat(np.log((share[text_of(first)] * like).sum(axis=1)), first[:-1])


def mixtures(fit: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(shares[text, language] within the chosen set, size of the set); fit: log likelihood[word, language].

    Sets grow until the likelihood of all languages together, less the price of the next set, is not
    above the best value so far; then no larger set can be.
    """
    texts, langs = len(first) - 1, fit.shape[1]
    chosen, size = np.zeros((texts, langs)), np.ones(texts, int)
    chosen[:, 0] = 1
    worded = np.diff(first) > 0
    if not worded.any():
        return chosen, size
    like = np.exp(np.maximum(fit - fit.max(axis=1, keepdims=True), -600))  # never 0
    first = np.concatenate(([0], np.cumsum(np.diff(first)[worded])))
    n = np.diff(first)
    price = PENALTY * np.log(n + 1)
    share = _converged(np.full((len(n), langs), 1 / langs), like, first)
    bound = _log_likelihood(share, like, first) + n * np.log(np.maximum(_rises(share, like, first).max(axis=1), 1))
    rank = np.argsort(np.argsort(-share, axis=1, kind="stable"), axis=1)
    best, count, top = share.copy(), np.zeros(len(n), int), np.full(len(n), -np.inf)
    left = np.arange(len(n))
    for k in range(1, langs + 1):
        more = top[left] < bound[left] - k * price[left]
        if not more.any():
            break
        like, first = _some(more, like, first)
        left = left[more]
        own = np.where(rank[left] < k, np.maximum(share[left], START_SHARE), 0)
        own = _converged(own / own.sum(axis=1, keepdims=True), like, first)
        value = _log_likelihood(own, like, first) - k * price[left]
        better = value > top[left]
        best[left[better]], count[left[better]], top[left[better]] = own[better], k, value[better]
    chosen[worded], size[worded] = best, count
    return chosen, size


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray], keep: list[str] | None = None, text: str = "text") -> DataFrame:
    """Documents with lang_pred, score and languages (the set with its shares, leading language first).

    A null text, one without letters, or an untrained model gives ``und``, 0 and no languages.
    """
    names, table = model
    sent = docs.sparkSession.sparkContext.broadcast(table.astype(np.float32).T.copy())
    entry = pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())]))

    def make():
        logs = sent.value

        def work(column: pa.Array) -> list:
            grams, bound, first = trigrams(column)
            worded = np.diff(first) > 0
            if not names:
                return [pa.array([UNKNOWN] * len(column)), np.zeros(len(column)), pa.array([[]] * len(column), entry)]
            fit = np.add.reduceat(logs[grams], bound[:-1], axis=0).astype(np.float64) if len(bound) > 1 else np.zeros((0, len(names)))
            share, _ = mixtures(fit, first)
            lead = share.argmax(axis=1)
            score = np.where(worded, np.clip(share[np.arange(len(column)), lead], 0, 1), 0.0)
            sets = [[{"lang": names[j], "share": float(row[j])} for j in np.argsort(-row, kind="stable") if row[j] > 0] if w else [] for row, w in zip(share, worded)]
            return [pa.array([names[j] if w else UNKNOWN for j, w in zip(lead, worded)]), score, pa.array(sets, entry)]
        return work
    return add_columns(docs, SCHEMA, make, text, keep)


def op10_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    held = F.col("held_out")
    docs = docs.withColumn("held_out", F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False)))
    model = train(docs.where(~held & F.col("doc_id").isNotNull()))
    return predict(docs, model, keep=["doc_id", "held_out"]).select("doc_id", "held_out", "lang_pred", "score", "languages")


QUERIES = {"op10_language_mixture": op10_language_mixture}
ORACLES: dict[str, str] = {}
