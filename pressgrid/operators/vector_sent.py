"""Top-k searches over an index whose vectors are sent to the tasks: for many queries over fewer vectors.

The vectors lie in slabs of at most SLAB_BYTES, each a broadcast variable; a task holds one slab at a time and takes its queries
in pieces of QUERY_ROWS.  So neither a query nor a hit is shuffled, and what leaves a task is the final list of each query.
Neighbouring cells form blocks.  A query's nearest block gives it a floor, then the blocks follow that can reach the floor; the scores of
one product are cut by the floor at once.  The order of hits is one integer a hit: query, score, place of the id.
"""
from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

#: Bytes of vectors, and vectors, up to which an index is sent; bytes of one slab.
SENT_BYTES = 1 << 29
SENT_VECTORS = 1 << 20
SLAB_BYTES = 1 << 25
#: Queries of a piece, vectors of a block and of one product, hits that wait before they are cut to the best k.
QUERY_ROWS = 1024
LOOK_ROWS = 4096
WAITING = 1 << 22
#: Pairs that are scored one by one at once.
PAIRS = 1 << 15

SCORE_BITS = 31
ONE = 10 ** 9


def _unit_rows(m: np.ndarray) -> np.ndarray:
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def _rows(column: pa.Array) -> np.ndarray:
    """The lists of a column as rows of a matrix, at unit length."""
    return _unit_rows(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1))


def fits(index) -> bool:
    return 0 < index.count.sum() <= SENT_VECTORS and index.count.sum() * index.centres.shape[1] * 8 <= SENT_BYTES


class SentVectors:
    """The vectors of an index as broadcast slabs, with their names."""

    def __init__(self, index):
        spark, dim = index.spark, index.centres.shape[1]
        area = index._areas(LOOK_ROWS)
        room = max(1, SLAB_BYTES // (8 * dim))
        # areas in a row share a slab; one that is larger than a slab is dealt over several
        placed, slab, filled = [], 0, 0
        for a in range(int(area.max()) + 1):
            n = int(index.count[area == a].sum())
            if filled and filled + n > room:
                slab, filled = slab + 1, 0
            pieces = max(1, -(-n // room))
            placed += [(int(c), a, slab, pieces) for c in np.flatnonzero(area == a)]
            slab, filled = (slab, filled + n) if pieces == 1 else (slab + pieces, 0)
        where = F.broadcast(spark.createDataFrame(placed, "ccell int, area int, slab int, pieces int"))
        rows = index.vectors.join(where, "ccell").select((F.col("slab") + F.pmod(F.xxhash64("cid"), F.col("pieces")).cast("int")).alias("slab"), "area", "cid", "unit", "cvec")
        packed = rows.groupBy("slab").applyInArrow(_packed, "slab int, area binary, cid array<string>, unit array<string>, cvec binary")
        slabs = [(np.frombuffer(r.area, np.int32), pa.array(r.cid, pa.string()), pa.array(r.unit, pa.string()), spark.sparkContext.broadcast(np.frombuffer(r.cvec).reshape(-1, dim)))
                 for r in packed.toLocalIterator()]
        cid, unit = (pa.concat_arrays([s[k] for s in slabs]) for k in (1, 2))
        order = pc.sort_indices(cid, null_placement="at_start").to_numpy()
        number = np.empty(len(order), dtype=np.int64)
        number[order] = np.arange(len(order))
        units = pc.unique(unit)
        units = units.take(pc.sort_indices(units, null_placement="at_start"))
        self.unnamed = cid.null_count
        self.bits = max(1, len(order).bit_length())
        #: (slab, first row, end, area, numbers in the order of ids)
        self.blocks, at = [], 0
        for s, (areas, *_) in enumerate(slabs):
            cut = [0, *(np.flatnonzero(np.diff(areas)) + 1).tolist(), len(areas)]
            self.blocks += [(s, lo, hi, int(areas[lo]), number[at + lo:at + hi]) for lo, hi in zip(cut, cut[1:])]
            at += len(areas)
        self.slabs = [s[3] for s in slabs]
        send = spark.sparkContext.broadcast
        self.names = send((cid.take(pa.array(order)), units, pc.index_in(unit.take(pa.array(order)), units).to_numpy().astype(np.int64)))
        self.layout = send((self.blocks, area, index.centres, index.radius, index.count > 0))

    def search(self, queries: DataFrame, k: int, exclude: bool, finish: Callable, schema: str) -> DataFrame:
        """finish() of the k best hits of each query; queries: (qid, qvec, floor, and qkey: vectors of the unit of that name never match)."""
        slabs, names, layout, bits = self.slabs, self.names, self.layout, self.bits

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, QUERY_ROWS):
                    piece = batch.slice(at, QUERY_ROWS)
                    key = pc.index_in(piece.column("qkey"), names.value[1]).fill_null(-1).to_numpy().astype(np.int64) if exclude else None
                    best = _best(_rows(piece.column("qvec")), piece.column("floor").to_numpy().copy(), key, k, slabs, layout.value, names.value[2], bits)
                    yield finish(piece.column("qid"), names.value, *best)

        return queries.mapInArrow(work, schema)

    def topk(self, queries: DataFrame, k: int, exclude: bool) -> DataFrame:
        def finish(qid, names, row, score, number):
            return pa.RecordBatch.from_arrays([qid.take(pa.array(row)), names[0].take(pa.array(number)), pa.array(score), pa.array(_place(row) + 1, pa.int32())],
                                              ["qid", "cid", "score", "rank"])
        return self.search(queries, k, exclude, finish, "qid string, cid string, score double, rank int")

    def best_units(self, queries: DataFrame, k: int, units: int, exclude: bool) -> DataFrame:
        unnamed = self.unnamed

        def finish(qid, names, row, score, number):
            named = number >= unnamed
            row, score, number = row[named], score[named], number[named]
            unit = names[2][number]
            # hits are in order, so the first of a unit is its best
            _, first = np.unique(row * len(names[1]) + unit, return_index=True)
            first = first[np.lexsort((unit[first], -score[first], row[first]))]
            first = first[_place(row[first]) < units]
            row, score, number, unit = row[first], score[first], number[first], unit[first]
            return pa.RecordBatch.from_arrays([qid.take(pa.array(row)), names[1].take(pa.array(unit)), names[0].take(pa.array(number)), pa.array(score), pa.array(_place(row) + 1, pa.int32())],
                                              ["qid", "unit", "cid", "score", "rank"])
        return self.search(queries, k, exclude, finish, "qid string, unit string, cid string, score double, rank int")


def _packed(table: pa.Table) -> pa.Table:
    """One row of a slab: its vectors by area, at unit length."""
    table = table.sort_by("area").combine_chunks()
    one = lambda column: pa.ListArray.from_arrays([0, table.num_rows], table.column(column).combine_chunks().cast(pa.string()))
    return pa.table({"slab": pa.array([table.column("slab")[0].as_py()], pa.int32()), "area": pa.array([table.column("area").to_numpy().astype(np.int32).tobytes()], pa.binary()),
                     "cid": one("cid"), "unit": one("unit"), "cvec": pa.array([_rows(table.column("cvec").combine_chunks()).tobytes()], pa.binary())})


def _place(row: np.ndarray) -> np.ndarray:
    """The place of each item among those of its row; rows in order."""
    start = np.flatnonzero(np.diff(row, prepend=-1))
    return np.arange(len(row)) - np.repeat(start, np.diff(np.append(start, len(row))))


class _Slabs:
    """One slab at a time."""

    def __init__(self, slabs: list):
        self.slabs, self.at = slabs, None

    def __getitem__(self, s: int) -> np.ndarray:
        if self.at not in (None, s):
            self.slabs[self.at].__dict__.pop("_value", None)
        self.at = s
        return self.slabs[s].value


def _reaching(q: np.ndarray, c: np.ndarray, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, score) of the pairs that reach the row's floor, some just below it included.

    A product in single precision leaves out what cannot reach it by the bound of its error; the few pairs left are scored in double.
    """
    slack = (q.shape[1] + 16) * 2.0 ** -23 + 1e-9
    at = np.flatnonzero((q.astype(np.float32) @ c.T.astype(np.float32) >= (floor - slack).astype(np.float32)[:, None]).ravel())
    if len(at) > len(q) * len(c) // 16:
        scores = (q @ c.T).ravel()
        at = np.flatnonzero((scores.reshape(len(q), -1) >= floor[:, None] - 1e-9).ravel())
        return at // len(c), at % len(c), scores[at]
    row, column = np.divmod(at, len(c))
    return row, column, np.concatenate([np.zeros(0), *[np.einsum("ij,ij->i", q[row[i:i + PAIRS]], c[column[i:i + PAIRS]]) for i in range(0, len(at), PAIRS)]])


def _best(q: np.ndarray, floor: np.ndarray, key: np.ndarray | None, k: int, slabs: list, layout: tuple, unit_of: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, score, number) of the k best vectors of each query, best first."""
    blocks, area, centres, radius, filled = layout
    held = _Slabs(slabs)
    angle = np.arccos(np.clip(q @ centres.T, -1.0, 1.0))
    near = area[np.where(filled, angle, 9.0).argmin(axis=1)]
    looked = set()
    for s, lo, hi, a, number in blocks:
        rows = np.flatnonzero(near == a)
        if a in looked or not len(rows) or hi - lo < k:
            continue
        looked.add(a)
        end = min(hi, lo + max(LOOK_ROWS, k))
        scores = q[rows] @ held[s][lo:end].T
        if key is not None:
            scores[unit_of[number[:end - lo]][None, :] == key[rows][:, None]] = -3.0
        low = np.partition(scores, end - lo - k, axis=1)[:, end - lo - k]
        floor[rows] = np.maximum(floor[rows], np.round(low, 9))
    found, waiting = [], 0

    def cut() -> np.ndarray:
        keys = np.sort(np.concatenate(found)) if found else np.zeros(0, np.int64)
        row = keys >> (bits + SCORE_BITS)
        place = _place(row)
        last = keys[place == k - 1]
        at = last >> (bits + SCORE_BITS)
        floor[at] = np.maximum(floor[at], (ONE - ((last >> bits) & ((1 << SCORE_BITS) - 1))) / ONE)
        return keys[place < k]

    for s, lo, hi, a, number in blocks:
        cells = area == a
        reach = np.arccos(np.clip(floor - 1e-9, -1.0, 1.0)) + 1e-9
        rows = np.flatnonzero((angle[:, cells] - radius[cells] <= reach[:, None]).any(axis=1))
        for at in range(lo, hi, LOOK_ROWS) if len(rows) else ():
            r, c, score = _reaching(q[rows], held[s][at:min(hi, at + LOOK_ROWS)], floor[rows])
            score, r, n = np.round(score, 9), rows[r], number[at - lo + c]
            good = score >= floor[r] - 1e-12
            if key is not None:
                good &= unit_of[n] != key[r]
            r, n, score = r[good], n[good], score[good]
            found.append((r.astype(np.int64) << (bits + SCORE_BITS)) | ((ONE - np.rint(score * ONE).astype(np.int64)) << bits) | n)
            waiting += len(n)
            if waiting > WAITING:
                found = [cut()]
                waiting = len(found[0])
    keys = cut()
    score = (ONE - ((keys >> bits) & ((1 << SCORE_BITS) - 1))) / ONE
    return keys >> (bits + SCORE_BITS), score, keys & ((1 << bits) - 1)
