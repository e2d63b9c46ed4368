"""Toxicity by class-conditional Kneser-Ney models.

Two bigram models, of toxic and of ordinary texts, give every text the mean over its words of

    ln P(word | word before, toxic) - ln P(word | word before, ordinary).

Each model is interpolated Kneser-Ney: discounted pairs back off to the class's continuation counts,
discounted too, and these to continuation counts that both classes share.  Everything is counted in texts (a pair by
the texts that hold it, the contexts of a word are the texts it continues), so neither a long nor a
repetitive text weighs more than another.  The discount of a count grows with its square root, its standard
error: a difference that chance explains is discounted to nothing, and such rare expressions take the shared
estimate in both classes.  A word's ratio is bounded by ``LIMIT`` and drawn towards 0 by ``MARGIN``, because
small differences that go through a whole text, such as those between languages, would otherwise add up.  A monotone
curve through the labelled texts (pooled adjacent violators) turns the mean into a probability.

Texts never meet their own counts: the labelled texts are dealt into folds by a hash of the text, and a text
is scored, whoever it belongs to, by the models of the folds it is not in.  So the curve is fitted on
honest values, and a mislabelled text does not confirm its label.

The classifier is fitted on a bounded sample of the labelled rows: of each class as many, by a hash of id and
label, as make about ``SAMPLE_BYTES`` of text and ``SAMPLE_ROWS`` rows.  The curve uses all of them, the counts
of the ordinary class only as many bytes as there are toxic ones, because models of different sizes differ in what they
leave to unseen words.  Equal texts of a class count once.  What is collected and broadcast is bounded by
the sample.  Words are runs of letters and digits, A-Z lower-cased, known by 64-bit hashes.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from .arrays import ALNUM, LOWER, forget, mix, pieces_of, runs, saved, span_hashes, text_bytes, text_of, tidy

SAMPLE_BYTES = 16 << 20
SAMPLE_ROWS = 200_000
#: Discounts in standard errors of a count: of pairs, of words; the least discount, and that of the shared counts.
PAIR_ERRORS, WORD_ERRORS, DISCOUNT = 4.0, 2.0, 0.75
LIMIT, MARGIN = 3.0, 0.5
#: Text bytes that one vectorised step works on.
STEP_BYTES = 1 << 20
THRESHOLD = 0.3
FOLDS = 4

_START = np.uint64(0x3C6EF372FE94F82B)


# --- words ----------------------------------------------------------------------------------------

def tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word, word before, bounds of the texts)."""
    data, offsets = text_bytes(column)
    starts, ends, first = runs(data, offsets, ALNUM)
    words = span_hashes(LOWER[data], starts, ends)
    before = np.concatenate(([_START], words[:-1])) if len(words) else words
    before[first[:-1][np.diff(first) > 0]] = _START
    return words, before, first


def pair_keys(before: np.ndarray, words: np.ndarray) -> np.ndarray:
    return mix(before * np.uint64(0xD6E8FEB86659FD93) + words)


def fold_of(text: Column) -> Column:
    return F.pmod(F.xxhash64(text), F.lit(FOLDS)).cast("int")


# --- sample and counts ----------------------------------------------------------------------------

def labelled_sample(docs: DataFrame, labels: DataFrame, sample_bytes: int = SAMPLE_BYTES, sample_rows: int = SAMPLE_ROWS) -> tuple[DataFrame, list[float]]:
    """((toxic, text, fold, counted) of the sample, share of each class that is in it); docs: (id, text), labels: (id, toxic).

    Only ids and lengths are shuffled; the ids of the sample, some ``sample_rows`` a class at most, are
    broadcast to fetch its texts.  An id with several labels is toxic if one of them says so.
    """
    marks = labels.where("id is not null and toxic is not null").groupBy("id").agg(F.max("toxic").alias("toxic"))
    sizes = docs.where("text <> ''").select("id", F.octet_length("text").alias("size")).join(marks, "id")
    sizes = saved(sizes.withColumn("at", F.pmod(F.xxhash64("id", "toxic"), F.lit(1 << 30)) / (1 << 30)), "sizes")
    whole = {int(r.toxic): r for r in sizes.groupBy("toxic").agg(F.count("*").alias("n"), F.sum("size").alias("size")).collect()}
    share, size = [1.0, 1.0], [0.0, 0.0]
    for c, r in whole.items():
        share[c] = min(1.0, sample_bytes / r.size, sample_rows / r.n)
        size[c] = share[c] * r.size
    ids = sizes.where(F.col("at") < F.when(F.col("toxic") == 1, share[1]).otherwise(share[0])).select("id", "toxic").distinct()
    sample = docs.join(F.broadcast(ids), "id").groupBy("toxic", F.xxhash64("text").alias("h")).agg(F.first("text").alias("text"))
    counted = (F.col("toxic") == 1) | (F.pmod(F.xxhash64("h"), F.lit(1 << 30)) < int((1 << 30) * min(1.0, size[1] / max(size[0], 1))))
    out = saved(sample.select("toxic", "text", fold_of(F.col("text")).alias("fold"), counted.alias("counted")), "sample")
    forget(sizes)
    return out, share


def count_texts(sample: DataFrame) -> DataFrame:
    """(before, word, n0, n1, ...): texts that hold the pair, n[fold * 2 + class]; with a null before, texts that hold the word."""
    def count(batches):
        for batch in batches:
            for part in pieces_of(batch, "text", STEP_BYTES):
                words, before, first = tokens(part.column("text"))
                text = text_of(first)
                place = part.column("fold").to_numpy() * 2 + part.column("toxic").to_numpy()
                for pairs in (True, False):
                    keys = mix((pair_keys(before, words) if pairs else words) ^ mix(text.astype(np.uint64)))
                    at = np.unique(keys, return_index=True)[1]
                    if pairs:
                        ahead = pa.array(before[at].view(np.int64))
                    yield pa.RecordBatch.from_arrays([ahead if pairs else pa.nulls(len(at), pa.int64()), pa.array(words[at].view(np.int64)), pa.array(place[text[at]].astype(np.int32))],
                                                     names=["before", "word", "place"])
    found = sample.where("counted").select("toxic", "fold", "text").mapInArrow(count, "before long, word long, place int")
    return found.groupBy("before", "word").agg(*[F.count(F.when(F.col("place") == p, 1)).alias(f"n{p}") for p in range(FOLDS * 2)])


# --- Kneser-Ney -----------------------------------------------------------------------------------

def kept(counts: np.ndarray, errors: float) -> np.ndarray:
    """Discounted counts."""
    return np.maximum(counts - np.maximum(errors * np.sqrt(counts), DISCOUNT), 0)


def kneser_ney(words: np.ndarray, texts: np.ndarray, pairs: tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray],
               pair_errors: float = PAIR_ERRORS, word_errors: float = WORD_ERRORS) -> dict[str, np.ndarray]:
    """What the two classes' models have that the shared counts do not.

    texts[word, class] counts the texts of distinct words; pairs: (word before, word, count of the pair, count of
    the word before as such, each [pair, class]) of at least the pairs that are left something.  A word that is not in the
    result has the share ``left`` of its shared probability, a history that is not there leaves everything to shorter ones.
    """
    seen = texts.sum(axis=1) > 0
    words, texts = words[seen], texts[seen].astype(np.float64)
    number = np.maximum(texts.sum(axis=0), 1)
    own = kept(texts, word_errors)
    left = 1 - own.sum(axis=0) / number
    shared = np.maximum(texts.sum(axis=1) - DISCOUNT, 0)
    everything = max(texts.sum(), 1)
    low = shared / everything + (1 - shared.sum() / everything) / (len(words) + 1)
    some = own.any(axis=1)
    before, word, counts, total = pairs
    more = kept(counts.astype(np.float64), pair_errors) / np.maximum(total, 1)
    held = more.any(axis=1)
    before, word, more = before[held], word[held], more[held]
    histories, at = np.unique(before, return_inverse=True)
    rest = 1 - np.stack([np.bincount(at, more[:, c], len(histories)) for c in (0, 1)], axis=1)
    keys = pair_keys(before, word)
    order, up = np.argsort(keys), np.argsort(words[some])
    return {"words": words[some][up], "p_words": (own[some] / number + left * low[some, None])[up], "left": left,
            "pairs": keys[order], "p_pairs": more[order], "histories": histories, "rest": rest}


def _found(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Index of each key in the sorted table, the table's length where it is not there."""
    at = np.searchsorted(table, keys)
    return np.where(table[np.minimum(at, max(len(table) - 1, 0))] == keys, at, len(table)) if len(table) else np.zeros(len(keys), np.int64)


def log_ratios(model: dict[str, np.ndarray], before: np.ndarray, words: np.ndarray) -> np.ndarray:
    """ln P(word | before, toxic) - ln P(word | before, ordinary) of each word, bounded and drawn towards 0."""
    def of(table: str, values: str, missing, keys: np.ndarray) -> np.ndarray:
        distinct, at = np.unique(keys, return_inverse=True)
        return np.concatenate([model[values].reshape(-1, 2), np.broadcast_to(np.asarray(missing, float), (1, 2))])[_found(model[table], distinct)][at]
    # a word without an entry has no pair either, so its shared probability cancels out
    p = of("words", "p_words", model["left"], words) * of("histories", "rest", 1, before) + of("pairs", "p_pairs", 0, pair_keys(before, words))
    ratio = np.clip(np.log(p[:, 1] / p[:, 0]), -LIMIT, LIMIT)
    return np.sign(ratio) * np.maximum(np.abs(ratio) - MARGIN, 0)


def train(sample: DataFrame, pair_errors: float = PAIR_ERRORS, word_errors: float = WORD_ERRORS) -> list[dict[str, np.ndarray]]:
    """The models by which texts of each fold are scored: those of the other folds' texts."""
    table = saved(count_texts(sample), "counts")
    names = [f"n{p}" for p in range(FOLDS * 2)]
    by_class = [sum((F.col(f"n{f * 2 + c}") for f in range(1, FOLDS)), F.col(f"n{c}")) for c in (0, 1)]
    pairs = table.where("before is not null")
    # fewer texts than that are discounted to nothing in every fold
    often = pairs.where(F.greatest(*by_class) > pair_errors ** 2)
    total = pairs.groupBy("before").agg(*[F.sum(n).alias(f"t_{n}") for n in names])
    some, words = often.join(total, "before").toArrow(), table.where("before is null").select("word", *names).toArrow()
    split = lambda t, mark: np.stack([t[mark + n].to_numpy() for n in names], axis=1).reshape(-1, FOLDS, 2)
    key = lambda t, c: t[c].to_numpy().view(np.uint64)
    texts, counts, totals = split(words, ""), split(some, ""), split(some, "t_")
    without = lambda x, f: x.sum(axis=1) - x[:, f]
    out = [kneser_ney(key(words, "word"), without(texts, f), (key(some, "before"), key(some, "word"), without(counts, f), without(totals, f)), pair_errors, word_errors)
           for f in range(FOLDS)]
    forget(table)
    return out


def mean_ratios(docs: DataFrame, models: list[dict[str, np.ndarray]], keep: list[str], text: str = "text", curve: list[tuple[float, float]] | None = None) -> DataFrame:
    """Columns in keep with ``n_words``, ``ratio``, the mean log ratio of the words (0 without words), and ``score``, its place on the curve."""
    sent = docs.sparkSession.sparkContext.broadcast((models, curve or [(0.0, 0.5)]))
    source = docs.select(*[F.col(f"`{c}`") for c in keep], F.coalesce(fold_of(F.col(f"`{text}`").cast("string")), F.lit(0)).alias("_fold"), F.col(f"`{text}`").cast("string").alias("_text"))

    def score(batches):
        tables, knots = sent.value
        x, y = np.array(knots).T
        for batch in batches:
            for part in pieces_of(batch, "_text", STEP_BYTES):
                words, before, first = tokens(part.column("_text"))
                fold = part.column("_fold").to_numpy()[text_of(first)]
                ratio = np.zeros(len(words))
                for f, model in enumerate(tables):
                    own = fold == f
                    ratio[own] = log_ratios(model, before[own], words[own])
                n = np.diff(first)
                total = np.add.reduceat(np.append(ratio, 0.0), first[:-1]) if len(n) else np.zeros(0)
                mean = np.where(n > 0, total / np.maximum(n, 1), 0.0)
                yield pa.RecordBatch.from_arrays([*[part.column(i) for i in range(len(keep))], pa.array(n.astype(np.int64)), pa.array(mean), pa.array(np.interp(mean, x, y))],
                                                 names=[*keep, "n_words", "ratio", "score"])

    out = StructType([*source.select(*[F.col(f"`{c}`") for c in keep]).schema, *StructType.fromDDL("n_words long, ratio double, score double")])
    return source.mapInArrow(score, out)


# --- probabilities --------------------------------------------------------------------------------

def monotone(x: np.ndarray, toxic: np.ndarray, all_: np.ndarray) -> list[tuple[float, float]]:
    """Knots of the rising curve nearest to the shares toxic / all_ of points in ascending order of x; half a toxic and half another text temper each."""
    blocks: list[list[float]] = []
    for a, t, n in zip(x, toxic, all_):
        blocks.append([a * n, t, n])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            last = blocks.pop()
            blocks[-1] = [u + v for u, v in zip(blocks[-1], last)]
    base = sum(b[1] for b in blocks) / sum(b[2] for b in blocks)
    return [(s / n, (t + base) / (n + 1)) for s, t, n in blocks]


def calibrate(scored: DataFrame, share: list[float]) -> list[tuple[float, float]]:
    """Curve from (toxic, ratio) rows, counted in cells that widen away from 0; classes weigh as much as before sampling."""
    cell = (F.signum("ratio") * F.floor(32 * F.log1p(F.abs("ratio") * 10_000))).cast("int")
    cells = scored.groupBy(cell.alias("cell")).agg(F.avg("ratio").alias("x"), F.count("*").alias("n"), F.sum("toxic").alias("t")).orderBy("cell").collect()
    x, n, t = (np.array([float(r[c]) for r in cells]) for c in ("x", "n", "t"))
    if not 0 < t.sum() < n.sum():
        return []
    return monotone(x, t / share[1], t / share[1] + (n - t) / share[0])


def toxicity(docs: DataFrame, train_docs: DataFrame, labels: DataFrame, keep: list[str] | None = None, text: str = "text", id_col: str = "doc_id",
             label: str = "toxic", threshold: float = THRESHOLD, sample_bytes: int = SAMPLE_BYTES, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Documents with n_words, ratio, score and predicted, learned from train_docs and labels (id, 0 or 1).

    A score depends on the text alone.  Texts without words, null ones too, have ratio 0 and the
    score of that ratio; without labels of both classes every score is 0.5 and predicted 0.  Rows without id or
    label are not learned from; equal texts of a class are learned from once.  Repeated rows get equal results;
    an empty table gives an empty result; columns of docs with the new names give way.
    """
    docs = tidy(docs)
    new = ("n_words", "ratio", "score", "predicted", "_fold", "_text")
    stay = [c for c in (docs.columns if keep is None else keep) if c.lower() not in new]
    source = tidy(train_docs).select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text}`").cast("string").alias("text"))
    marks = tidy(labels).select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label}`").cast("int").alias("toxic")).where("toxic in (0, 1)")
    sample, share = labelled_sample(source, marks, sample_bytes, sample_rows)
    models = train(sample)
    curve = calibrate(mean_ratios(sample, models, ["toxic"]), share)
    forget(sample)
    out = mean_ratios(docs, models, stay, text, curve)
    return out.withColumn("predicted", ((F.col("score") >= threshold) & F.lit(bool(curve))).cast("int"))


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    docs = docs.withColumn("held_out", held)
    out = toxicity(docs, docs.where("not held_out"), labels, keep=["doc_id", "held_out"])
    return out.select("doc_id", "held_out", "score", "predicted", "n_words", "ratio")


QUERIES = {"op12_toxicity": op12_toxicity}
ORACLES: dict[str, str] = {}
