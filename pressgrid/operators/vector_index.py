"""A saved vector index: cells around centroids, exact cosine searches over them.

``create`` fits centroids (spherical k-means over a bounded sample; the sample only decides how well cells
separate) and writes two tables: the vectors, partitioned by groups of cells and sorted by cell, and one row for each
cell with its centroid, its radius and its numbers of vectors and units.  ``open_index`` reads them back; a search fits
nothing.  ``add`` puts new vectors into their cells: the widened cells are written first, as a new
generation, so a search never trusts a radius that is too small.

All searches rest on the triangle inequality between angles: a vector of a cell is no nearer to a query than
angle(query, centroid) - radius, and no farther than angle(query, centroid) + radius.

* ``topk``: every query looks into one block of its nearest cell; the k-th score found there is a floor that
  its final k-th score cannot fall below, and then it only travels to cells that can reach the floor.
* ``within``: all pairs from a score on; no rank and no bound on the number of matches.
* ``count_above``: how many units have a vector above a query's own score: cells wholly below are left out, cells
  wholly above are counted without a visit.

Cells and the queries that reach them are salted into blocks of ``block_rows``: a task multiplies one query
block and one vector block as two matrices.  How many blocks a cell has comes from the cell table by a join.
"""
from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F, types as T

from ..functions import vectors as X
from ..session import new_path, write_once
from .vector_sent import SentVectors, fits

SCORE_DIGITS = 9
#: Numbers in the sample that the centroids are fitted on; there are at most a quarter as many centroids as sampled vectors.
SAMPLE_NUMBERS = 1 << 22
ROUNDS = 6
#: Folders of the vector table.
PARTS = 64
BLOCK_ROWS = 2048
#: Vectors of neighbouring cells, and queries, that meet in one task when units are counted: what is shuffled falls with it.
WIDE_ROWS = 16384
#: Rows with a vector that a task makes at once, and angles that it measures at once.
SENT_ROWS = 4096
ANGLES = 1 << 21
#: Cell tables up to this number of rows are broadcast.
BROADCAST_CELLS = 200_000

HITS = "qid string, cid string, score double"
VECTORS = "cid string, unit string, cvec array<double>, ccell int, part int"


def matrix(column: pd.Series) -> np.ndarray:
    """Unit rows."""
    m = np.stack([np.asarray(v, dtype=np.float64) for v in column])
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def usable(df: DataFrame, vec: str) -> DataFrame:
    return df.where(F.col(vec).isNotNull() & X.has_length(F.col(vec)))


def fit_centroids(c: DataFrame, cells: int) -> np.ndarray:
    """Unit centroids, at most cells, of a repeatable sample of at most SAMPLE_NUMBERS numbers; c: (cid, cvec), not empty."""
    dim = c.select(F.size("cvec")).first()[0]
    most = max(4, SAMPLE_NUMBERS // dim)
    cells = max(1, min(cells, most // 4))
    rows = c.orderBy(F.xxhash64("cid"), "cid").limit(min(64 * cells, most)).select("cvec").collect()
    points = matrix(pd.Series([r["cvec"] for r in rows]))
    centres = points[:cells]
    for _ in range(ROUNDS if cells > 1 else 0):
        near = (points @ centres.T).argmax(axis=1)
        total = np.zeros_like(centres)
        np.add.at(total, near, points)
        size = np.linalg.norm(total, axis=1, keepdims=True)
        centres = np.where(size > 1e-9, total / np.maximum(size, 1e-9), centres)
    return centres


def _angles(vectors: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(vectors @ centres.T, -1.0, 1.0))


def _nearest(df: DataFrame, vec: str, sent, among: np.ndarray) -> DataFrame:
    """Adds ccell, the nearest of the centroids in ``among``."""
    def assign(batches):
        for b in batches:
            if len(b):
                yield b.assign(ccell=among[_angles(matrix(b[vec]), sent.value[among]).argmin(axis=1)].astype("int32"))

    return df.mapInPandas(assign, T.StructType([*df.schema.fields, T.StructField("ccell", T.IntegerType())]))


def _placed(rows: DataFrame, sent, cells: int) -> DataFrame:
    """(cid, unit, cvec, ccell, angle, part): vectors in the cell of their unit's mean direction."""
    if rows.select(F.col("cid") != F.col("unit")).where("(cid <> unit)").limit(1).count():
        mean = rows.select("unit", F.posexplode(X.l2_normalize(F.col("cvec")))).groupBy("unit", "pos").agg(F.sum("col").alias("x"))
        mean = mean.groupBy("unit").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"]).alias("lead"))
        # opposite vectors have no mean: the unit goes to the first cell
        mean = mean.withColumn("lead", F.when(X.has_length(F.col("lead")), F.col("lead")).otherwise(F.transform("lead", lambda x: F.lit(1.0))))
        named = rows.join(_nearest(mean, "lead", sent, np.arange(cells)).select("unit", "ccell"), "unit")
    else:
        named = _nearest(rows, "cvec", sent, np.arange(cells))

    def measure(batches):
        for b in batches:
            if len(b):
                sims = (matrix(b["cvec"]) * sent.value[b["ccell"].to_numpy()]).sum(axis=1)
                yield b.assign(angle=np.arccos(np.clip(sims, -1.0, 1.0)))

    named = named.select("cid", "unit", "cvec", "ccell")
    return named.mapInPandas(measure, T.StructType([*named.schema.fields, T.StructField("angle", T.DoubleType())])).withColumn("part", F.pmod("ccell", F.lit(PARTS)))


def _cell_stats(placed: DataFrame) -> DataFrame:
    return placed.groupBy("ccell").agg(F.count("*").alias("n"), F.count_distinct("unit").alias("units"), F.max("angle").alias("radius"))


def complete_folders(spark: SparkSession, path: str) -> list[str]:
    """Complete tables below path."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = where.getFileSystem(spark._jsc.hadoopConfiguration())
    found = [s.getPath() for s in files.listStatus(where)]
    return [p.getName() for p in found if files.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]


class VectorIndex:
    """An index in a folder; see create() and open_index()."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.generation = max(int(n.split("-")[1]) for n in complete_folders(spark, path) if n.startswith("cells-"))
        self.cells = spark.read.parquet(f"{path}/cells-{self.generation}")
        self.vectors = spark.read.schema(VECTORS).parquet(f"{path}/vectors")
        rows = self.cells.orderBy("ccell").collect()  # at most a quarter of the sample
        self.centres = np.array([r.centre for r in rows])
        self.radius = np.array([-10.0 if r.radius is None else r.radius for r in rows])
        self.count, self.units = np.array([r.n for r in rows]), np.array([r.units for r in rows])
        self._sent = self._vectors = None

    def sent_vectors(self) -> SentVectors | None:
        """The vectors as they are sent to tasks, None where they are too many."""
        if self._vectors is None and fits(self):
            self._vectors = SentVectors(self)
        return self._vectors

    def sent(self):
        if self._sent is None:
            self._sent = self.spark.sparkContext.broadcast(self.centres)
        return self._sent

    # --- writing ---

    def add(self, corpus: DataFrame) -> "VectorIndex":
        """The index with further vectors; units that are there already would be split, so they must be new."""
        rows = _rows_of(corpus)
        placed = write_once(_placed(rows, self.sent(), len(self.centres)), "added")
        new = _cell_stats(placed).withColumnsRenamed({"n": "n2", "units": "u2", "radius": "r2"})
        cells = self.cells.join(new, "ccell", "left").select(
            "ccell", "centre", (F.col("n") + F.coalesce("n2", F.lit(0))).alias("n"), (F.col("units") + F.coalesce("u2", F.lit(0))).alias("units"),
            F.greatest("radius", "r2").alias("radius"))
        cells.coalesce(1).write.parquet(f"{self.path}/cells-{self.generation + 1}")
        _write_vectors(placed, f"{self.path}/vectors")
        return VectorIndex(self.spark, self.path)

    # --- searching ---

    def _layout(self, asked: DataFrame, block_rows: int) -> DataFrame:
        """(part, ccell, blocks, groups) of the cells that queries ask for; one row a cell."""
        upto = lambda n: F.greatest(F.lit(1), F.ceil(F.col(n) / block_rows)).cast("int")
        out = self.cells.select("ccell", "n").join(asked.groupBy("ccell").agg(F.count("*").alias("q")), "ccell")
        out = out.select(F.pmod("ccell", F.lit(PARTS)).alias("part"), "ccell", upto("n").alias("blocks"), upto("q").alias("groups"))
        return F.broadcast(out) if len(self.centres) <= BROADCAST_CELLS else out

    def _meet(self, queries: DataFrame, work: Callable, schema: str, columns: list[str], block_rows: int, first_block: bool = False, by: str = "cid") -> DataFrame:
        """Results of work over query blocks and vector blocks, dealt by a column; queries: (qid, qvec, ccell, further columns)."""
        layout = self._layout(queries, block_rows)
        salt = lambda col, n: F.pmod(F.xxhash64(col, F.lit(7)), F.col(n)).cast("int")
        each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        keys = ["ccell", "qsub", "csub"]
        q = queries.join(layout.drop("part"), "ccell").withColumn("qsub", salt("qid", "groups"))
        q = q.withColumn("csub", F.lit(0) if first_block else each("blocks")).select(*keys, "qid", "qvec", *columns)
        c = self.vectors.join(layout, ["part", "ccell"]).withColumn("csub", salt(by, "blocks"))
        c = (c.where("csub = 0") if first_block else c).withColumn("qsub", each("groups")).select(*keys, "cid", "unit", "cvec")
        return q.groupBy(*keys).cogroup(c.groupBy(*keys)).applyInPandas(work, schema)

    def _routed(self, queries: DataFrame) -> DataFrame:
        """One row for each query and cell that can hold a match at its floor; made in pieces, as every query may reach every cell."""
        sent, radius = self.sent(), self.radius
        step = max(1, ANGLES // len(self.centres))

        def route(batches):
            for batch in batches:
                for at in range(0, len(batch), step):
                    b = batch.iloc[at:at + step]
                    reach = np.arccos(np.clip(b["floor"].to_numpy() - 10.0 ** -SCORE_DIGITS, -1.0, 1.0))
                    row, cell = np.nonzero(_angles(matrix(b["qvec"]), sent.value) - radius <= reach[:, None] + 1e-9)
                    for part in range(0, len(row), SENT_ROWS):
                        yield b.iloc[row[part:part + SENT_ROWS]].assign(ccell=cell[part:part + SENT_ROWS].astype("int32"))

        return write_once(queries.mapInPandas(route, T.StructType([*queries.schema.fields, T.StructField("ccell", T.IntegerType())])), "routes")

    def best_units(self, queries: DataFrame, k: int, units: int, min_score: float | None = None) -> DataFrame | None:
        """(qid, unit, cid, score, rank): of the k best vectors the best of each unit, the first ``units`` units; qid has no repeats.

        None where the vectors are too many to be sent.
        """
        q, more = _queries_of(queries, min_score)
        sent = self.sent_vectors()
        return sent and sent.best_units(q, k, units, bool(more))

    def topk(self, queries: DataFrame, k: int, min_score: float | None = None, block_rows: int = BLOCK_ROWS, unique: bool = False) -> DataFrame:
        """(qid, cid, score, rank): the k best vectors with score >= min_score, ties by cid; queries: (qid, qvec).

        With a qkey, vectors of the unit of that name never match.  ``unique``: no qid repeats, so where the vectors can be sent a
        query's hits are complete where they are found.
        """
        q, more = _queries_of(queries, min_score)
        if unique and (sent := self.sent_vectors()):
            return sent.topk(q, k, bool(more))
        filled = np.flatnonzero(self.count)
        if not len(filled):
            return self.spark.createDataFrame([], HITS + ", rank int")
        work = _best_of_block(k, "qkey" in more)
        if len(filled) > 1 and k <= block_rows:
            first = write_once(_nearest(q, "qvec", self.sent(), filled), "queries")
            # every query comes back once, with its floor: no hit of the first block is dealt out
            q = self._meet(first, _kth_of_block(k, bool(more), q.columns), q.schema, ["floor", *more], block_rows, first_block=True)
        hits = self._meet(self._routed(q), work, HITS, ["floor", *more], block_rows)
        w = W.partitionBy("qid").orderBy(F.col("score").desc(), F.col("cid").asc())
        return hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)

    def within(self, queries: DataFrame, min_score: float, block_rows: int = BLOCK_ROWS) -> DataFrame:
        """(qid, cid, score): all vectors with score >= min_score."""
        q, more = _queries_of(queries, min_score)
        if not len(self.centres):
            return self.spark.createDataFrame([], HITS)
        return self._meet(self._routed(q), _best_of_block(None, "qkey" in more), HITS, ["floor", *more], block_rows)

    def count_above(self, queries: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
        """(qid, better): units with a vector of a higher score than the query's own, or of the same score and a later name.

        queries: (qid, qvec, own), own at SCORE_DIGITS.  A unit lies in one cell and one
        block, so no unit counts twice; a block holds block_rows vectors and at least one whole unit.

        Neighbouring cells form areas of some WIDE_ROWS vectors: a query travels to an area once, with the cells to visit there,
        and an area to each WIDE_ROWS queries.
        """
        q = usable(queries, "qvec").select(F.col("qid").cast("string").alias("qid"), "qvec", "own")
        if not len(self.centres):
            return q.select("qid", F.lit(0).cast("long").alias("better"))
        sent, radius, units = self.sent(), self.radius, self.units
        area = self._areas(max(block_rows, WIDE_ROWS))
        order = np.argsort(area, kind="stable")

        def sort_out(batches):
            slack = 2 * 10.0 ** -SCORE_DIGITS
            step = max(1, ANGLES // len(units))
            for batch in batches:
                for at in range(0, len(batch), step):
                    b = batch.iloc[at:at + step]
                    angle, own = _angles(matrix(b["qvec"]), sent.value), b["own"].to_numpy()[:, None]
                    filled = units > 0
                    highest, lowest = np.cos(np.maximum(angle - radius, 0)), np.cos(np.minimum(angle + np.maximum(radius, 0), np.pi))
                    above = filled & (lowest > own + slack)
                    visit = filled & ~above & (highest >= own - slack)
                    cells = [order[v].astype("int32") for v in visit[:, order]]
                    parts = [np.split(v, np.flatnonzero(np.diff(area[v])) + 1) if len(v) else [] for v in cells]
                    yield b.assign(sure=(above * units).sum(axis=1).astype("int64"), visit=parts)

        visits = T.ArrayType(T.ArrayType(T.IntegerType()))
        sorted_out = write_once(q.mapInPandas(sort_out, T.StructType([*q.schema.fields, T.StructField("sure", T.LongType()), T.StructField("visit", visits)])), "bounds")
        self.visits = sorted_out.agg(F.sum(F.size(F.flatten("visit"))).alias("visits"))
        where = self.spark.createDataFrame([(c, int(a)) for c, a in enumerate(area)], "ccell int, area int")
        where = F.broadcast(where) if len(area) <= BROADCAST_CELLS else where
        asked = sorted_out.select("qid", "qvec", "own", F.explode("visit").alias("cells")).withColumn("ccell", F.col("cells")[0]).join(where, "ccell").drop("ccell")
        met = self._meet_areas(asked, where, max(block_rows, WIDE_ROWS), block_rows)
        return sorted_out.select("qid", F.col("sure").alias("better")).unionByName(met).groupBy("qid").agg(F.sum("better").alias("better"))

    def _areas(self, rows: int) -> np.ndarray:
        """The area of each cell: neighbouring cells of together at most ``rows`` vectors; a larger cell is an area of its own."""
        seeds = self.centres[:max(1, math.ceil(self.count.sum() / rows))]
        out, area, filled = np.zeros(len(self.count), dtype=np.int64), 0, 0
        for c in np.argsort((self.centres @ seeds.T).argmax(axis=1), kind="stable"):
            if filled and filled + self.count[c] > rows:
                area, filled = area + 1, 0
            out[c], filled = area, filled + self.count[c]
        return out

    def _meet_areas(self, asked: DataFrame, where: DataFrame, wide: int, block_rows: int) -> DataFrame:
        """(qid, better) over areas and the queries that reach them; asked: (qid, qvec, own, cells, area)."""
        upto = lambda n: F.greatest(F.lit(1), F.ceil(F.col(n) / wide)).cast("int")
        size = self.cells.select("ccell", "n").join(where, "ccell").groupBy("area").agg(F.sum("n").alias("n"))
        layout = size.join(asked.groupBy("area").agg(F.count("*").alias("q")), "area").select("area", upto("n").alias("blocks"), upto("q").alias("groups"))
        layout = write_once(layout, "areas")
        layout = F.broadcast(layout) if len(self.centres) <= BROADCAST_CELLS else layout
        salt = lambda col, n: F.pmod(F.xxhash64(col, F.lit(7)), F.col(n)).cast("int")
        each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        keys = ["area", "qsub", "csub"]
        q = asked.join(layout, "area").withColumn("qsub", salt("qid", "groups")).withColumn("csub", each("blocks")).select(*keys, "qid", "qvec", "own", "cells")
        c = self.vectors.join(where, "ccell").join(layout, "area").withColumn("csub", salt("unit", "blocks"))
        c = c.withColumn("qsub", each("groups")).select(*[F.col(k).alias(k) for k in keys], "unit", "ccell", "cvec")
        return q.groupBy(*keys).cogroup(c.groupBy(*keys)).applyInPandas(_count_units(block_rows), "qid string, better long")


def _rows_of(corpus: DataFrame) -> DataFrame:
    """(cid, unit, cvec); without a ckey a vector is a unit of its own."""
    name = lambda c: F.col(c).cast("string")
    return usable(corpus, "cvec").select(name("cid").alias("cid"), name("ckey" if "ckey" in corpus.columns else "cid").alias("unit"), F.col("cvec").cast("array<double>").alias("cvec"))


def _queries_of(queries: DataFrame, min_score: float | None) -> tuple[DataFrame, list[str]]:
    more = ["qkey"] if "qkey" in queries.columns else []
    floor = F.lit(float(-2.0 if min_score is None else min_score))
    return usable(queries, "qvec").select(F.col("qid").cast("string").alias("qid"), "qvec", floor.alias("floor"), *[F.col(c).cast("string").alias(c) for c in more]), more


def _write_vectors(placed: DataFrame, path: str) -> None:
    placed.select("cid", "unit", "cvec", "ccell", "part").repartition("part").sortWithinPartitions("ccell").write.mode("append").partitionBy("part").parquet(path)


def create(corpus: DataFrame, path: str, cells: int | None = None, block_rows: int = BLOCK_ROWS) -> VectorIndex:
    """An index of corpus (cid, cvec) in a new folder; with a ckey, rows with the same ckey are one unit and share a cell.

    Vectors that are null or have no length are left out; an empty corpus gives an index without cells.
    """
    spark, rows = corpus.sparkSession, _rows_of(corpus)
    total = rows.count()
    if total:
        centres = fit_centroids(rows, min(total, cells or max(math.ceil(total / block_rows), math.ceil(math.sqrt(total) / 2))))
    else:
        centres = np.zeros((0, 0))
    sent = spark.sparkContext.broadcast(centres)
    placed = write_once(_placed(rows, sent, len(centres)), "placed") if total else rows.select("*", F.lit(0).alias("ccell"), F.lit(0.0).alias("angle"), F.lit(0).alias("part"))
    _write_vectors(placed, f"{path}/vectors")
    named = spark.createDataFrame([(k, c.tolist()) for k, c in enumerate(centres)], "ccell int, centre array<double>")
    table = named.join(_cell_stats(placed), "ccell", "left").select("ccell", "centre", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("units", F.lit(0)).alias("units"), "radius")
    table.coalesce(1).write.parquet(f"{path}/cells-0")
    return VectorIndex(spark, path)


def open_index(spark: SparkSession, path: str) -> VectorIndex:
    return VectorIndex(spark, path)


_kept: dict[tuple, object] = {}


def _fingerprint(spark: SparkSession, path: str) -> tuple:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = where.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(where, True)
    out = []
    while files.hasNext():
        f = files.next()
        out.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return tuple(sorted(out))


def kept(spark: SparkSession, name: str, sources: list[str], build: Callable[[str], object]):
    """What build(path) made of these source files under that name in this session; built when it is first asked for or the files have changed."""
    key = (spark.sparkContext.applicationId, name, *[_fingerprint(spark, s) for s in sources])
    if key not in _kept:
        _kept[key] = build(new_path(spark, f"index-{name}"))
    return _kept[key]


def kept_index(spark: SparkSession, name: str, sources: list[str], corpus: Callable[[], DataFrame], cells: int | None = None) -> VectorIndex:
    """The session's vector index of that name over these source files."""
    return kept(spark, name, sources, lambda path: create(corpus(), path, cells))


# --- blocks ---------------------------------------------------------------------------------------

def _hits(qid, cid, score) -> pd.DataFrame:
    return pd.DataFrame({"qid": pd.Series(qid, dtype=object), "cid": pd.Series(cid, dtype=object), "score": pd.Series(score, dtype="float64")})


def _best_of_block(k: int | None, exclude: bool) -> Callable:
    def best(_key, q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        if len(q) == 0 or len(c) == 0:
            return _hits([], [], [])
        c = c.iloc[np.argsort(c["cid"].to_numpy().astype(str), kind="stable")]
        scores = np.round(matrix(q["qvec"]) @ matrix(c["cvec"]).T, SCORE_DIGITS)
        good = scores >= q["floor"].to_numpy()[:, None] - 1e-12
        if exclude:
            good &= q["qkey"].to_numpy()[:, None] != c["unit"].to_numpy()[None, :]
        n = len(c)
        if k is None or n <= k:
            rows, cols = np.nonzero(good)
        else:
            # one integer a pair: the score, then the place in the order of ids
            rank = np.where(good, np.rint(scores * 10 ** SCORE_DIGITS).astype(np.int64) * n + np.arange(n - 1, -1, -1), -(1 << 62))
            top = np.argpartition(-rank, k - 1, axis=1)[:, :k]
            rows, at = np.nonzero(np.take_along_axis(good, top, axis=1))
            cols = top[rows, at]
        return _hits(q["qid"].to_numpy()[rows], c["cid"].to_numpy()[cols], scores[rows, cols])
    return best


def _kth_of_block(k: int, exclude: bool, columns: list[str]) -> Callable:
    """The queries, their floor raised to the k-th score found in the block."""
    def kth(_key, q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        if len(q) and len(c) >= k:
            scores = np.round(matrix(q["qvec"]) @ matrix(c["cvec"]).T, SCORE_DIGITS)
            if exclude:
                scores[q["qkey"].to_numpy()[:, None] == c["unit"].to_numpy()[None, :]] = -3.0
            low = np.partition(scores, len(c) - k, axis=1)[:, len(c) - k]
            q = q.assign(floor=np.maximum(q["floor"].to_numpy(), low))
        return q[columns]
    return kth


def _count_units(step: int) -> Callable:
    """How many units of a block beat each query's own score, in the cells the query visits; a unit's vectors share a cell and a block."""
    def beaten(q: np.ndarray, own: np.ndarray, ids: np.ndarray, c: np.ndarray, start: np.ndarray, names: np.ndarray) -> np.ndarray:
        best = np.maximum.reduceat(np.round(q @ c.T, SCORE_DIGITS), start, axis=1)
        return ((best > own[:, None]) | ((best == own[:, None]) & (names[None, :] > ids[:, None]))).sum(axis=1)

    def count(_key, q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        if len(q) == 0 or len(c) == 0:
            return pd.DataFrame({"qid": pd.Series([], dtype=object), "better": pd.Series([], dtype="int64")})
        better = np.zeros(len(q), dtype=np.int64)
        asked, own, ids = matrix(q["qvec"]), q["own"].to_numpy(), q["qid"].to_numpy().astype(str)
        cells = np.concatenate([np.asarray(v) for v in q["cells"]])
        of = np.repeat(np.arange(len(q)), q["cells"].map(len).to_numpy())
        c = c.sort_values(["ccell", "unit"], kind="stable")
        at, unit, vectors = c["ccell"].to_numpy(), c["unit"].to_numpy().astype(str), matrix(c["cvec"])
        for cell in np.unique(at):
            lo, hi = np.searchsorted(at, cell), np.searchsorted(at, cell, "right")
            start = np.flatnonzero(np.concatenate([[True], unit[lo + 1:hi] != unit[lo:hi - 1]]))
            rows = of[cells == cell]
            # at most block_rows scores a side at once, cut between units
            cut = [0]
            for s in start[1:]:
                if s - cut[-1] >= step:
                    cut.append(int(s))
            for a, b in zip(cut, [*cut[1:], hi - lo]):
                inside = start[(start >= a) & (start < b)]
                for r in range(0, len(rows), step):
                    some = rows[r:r + step]
                    better[some] += beaten(asked[some], own[some], ids[some], vectors[lo + a:lo + b], inside - a, unit[lo + inside])
        return pd.DataFrame({"qid": q["qid"].to_numpy(), "better": better})
    return count
