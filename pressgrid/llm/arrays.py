"""Helpers of the operators: word arrays over Arrow text columns, column-adding maps, written intermediates."""
from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from ..session import drop_written, write_once

#: Text bytes that one vectorised step works on; a longer document is a step of its own.
CHUNK_BYTES = 3 << 20
#: The same for maps that work row by row, where larger steps gain nothing.
MAP_BYTES = 1 << 20

_ALL = np.arange(256)
#: Bytes of words that white space (blank and the controls 9 to 13) separates.
SPACED = ~((_ALL == 0x20) | ((_ALL >= 9) & (_ALL <= 13)))
#: Bytes of words made of ASCII letters, digits and everything beyond ASCII.
ALNUM = ((_ALL >= 0x30) & (_ALL <= 0x39)) | ((_ALL >= 0x61) & (_ALL <= 0x7A)) | ((_ALL >= 0x41) & (_ALL <= 0x5A)) | (_ALL >= 0x80)
NOT_NEWLINE = _ALL != 0x0A
#: Maps A-Z to a-z and leaves every other byte.
LOWER = np.where((_ALL >= 0x41) & (_ALL <= 0x5A), _ALL + 32, _ALL).astype(np.uint8)
LOWER_BYTES = LOWER.tobytes()


# --- sessions and intermediates -------------------------------------------------------------------

#: An intermediate written once below the shared folder and read back (survives lost executors), and its removal.
saved, forget = write_once, drop_written


def parts(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def tidy(df: DataFrame) -> DataFrame:
    """Of columns whose names clash without regard to case, the first stays."""
    names = [c.lower() for c in df.columns]
    if len(set(names)) == len(names):
        return df
    plain = df.toDF(*[f"_{i}" for i in range(len(names))])
    return plain.select(*[F.col(f"_{i}").alias(c) for i, c in enumerate(df.columns) if names.index(c.lower()) == i])


# --- text columns as arrays -----------------------------------------------------------------------

def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(UTF-8 bytes, int64 offsets) of a string column, without a copy; null is empty."""
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type)
    _, ends, data = column.buffers()
    if ends is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offsets = np.frombuffer(ends, np.int64 if wide else np.int32)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0]:offsets[-1]], offsets - offsets[0]


def pieces_of(batch: pa.RecordBatch, column: str, size: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows with about so many bytes of text each."""
    _, offsets = text_bytes(batch.column(column))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, side="right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def runs(data: np.ndarray, offsets: np.ndarray, kept: np.ndarray, cuts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of kept bytes inside each text: (starts, ends, index of each text's first run); cuts: flags of places that end a run."""
    inside = kept[data]
    before, after = np.concatenate(([False], inside)), np.concatenate((inside, [False]))
    cut = np.zeros(len(data) + 1, bool) if cuts is None else cuts.copy()
    cut[offsets] = True
    starts = np.flatnonzero(after & (~before | cut))
    ends = np.flatnonzero(before & (~after | cut))
    return starts, ends, np.searchsorted(starts, offsets)


_STEP = 0x9E3779B97F4A7C15
_BYTE = np.random.default_rng(20240229).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: dict[str, np.ndarray] = {}


def _power(kind: str, n: int) -> np.ndarray:
    have = _powers.get(kind)
    if have is None or len(have) < n:
        base = _STEP if kind == "up" else pow(_STEP, -1, 1 << 64)
        have = np.full(max(n, 1 << 16), base, np.uint64)
        have[0] = 1
        have = np.cumprod(have, dtype=np.uint64)
        if n <= CHUNK_BYTES + (1 << 20):
            _powers[kind] = have
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every input bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte span, by prefix sums of a polynomial modulo 2**64."""
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * _power("up", len(data)), out=total[1:])
    return mix((total[ends] - total[starts]) * _power("down", len(data) + 1)[starts] + (ends - starts).astype(np.uint64))


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n values from each place on; the last n - 1 places have none."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    out = words[: len(words) - n + 1].copy()
    for j in range(1, n):
        out *= np.uint64(0xD6E8FEB86659FD93)
        out += words[j: len(words) - n + 1 + j]
    return mix(out)


def text_of(first: np.ndarray) -> np.ndarray:
    """The text of each run, from the index of each text's first run."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum of the values between neighbouring bounds, 0 where there are none."""
    total = np.concatenate(([0], np.cumsum(values, dtype=np.int64)))
    return total[bounds[1:]] - total[bounds[:-1]]


# --- maps -----------------------------------------------------------------------------------------

def release() -> None:
    """Give freed memory back to the system: a worker goes on to other stages, beside others of its executor."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # the GNU library has it
    if trim:
        trim(0)


def add_columns(docs: DataFrame, schema: str, make: Callable[[], Callable[[pa.Array], list]], text: str = "text",
                keep: list[str] | None = None) -> DataFrame:
    """Rows of docs with columns computed from the text, in Arrow batches.

    ``make()`` is called once in each task and returns a function from a text column to one array
    for each column of the schema.  Of the columns of docs, those in keep stay (all by default);
    a column of docs with the name of a new one gives way.
    """
    docs, new = tidy(docs), StructType.fromDDL(schema)
    taken = {f.name.lower() for f in new}
    stay = [c for c in (docs.columns if keep is None else keep) if c.lower() not in taken]
    source = docs.select(*[F.col(f"`{c}`") for c in stay], F.col(f"`{text}`").cast("string").alias("_input_text"))
    out = StructType([f for f in source.schema if f.name != "_input_text"] + list(new))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            for part in pieces_of(batch, "_input_text", MAP_BYTES):
                done = work(part.column("_input_text"))
                yield pa.RecordBatch.from_arrays([part.column(i) for i in range(len(stay))] + [pa.array(x) if isinstance(x, np.ndarray) else x for x in done], names=out.names)
                del done, part
            release()

    return source.mapInArrow(run, out)
