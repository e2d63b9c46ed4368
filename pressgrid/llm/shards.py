"""Binary rows that carry many numbers to the shard of their key: a chunk of documents sends one row to each shard."""
from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
import zstandard

_press, _open = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def low_bytes(values: np.ndarray, n: int) -> np.ndarray:
    """The n low bytes of 64-bit values, as a flat byte array."""
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :n]).reshape(-1)


def from_low_bytes(raw: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros((len(raw) // n, 8), np.uint8)
    out[:, :n] = raw.reshape(-1, n)
    return out.reshape(-1).view("<u8")


def pack(arrays: list[np.ndarray], squeeze: list[bool]) -> bytes:
    """Arrays in one blob; those marked are differenced by bytes and compressed."""
    out = []
    for a, s in zip(arrays, squeeze):
        raw = np.ascontiguousarray(a)
        raw = _press.compress(np.ascontiguousarray(raw.view(np.uint8).reshape(len(raw), -1).T).tobytes()) if s and len(raw) else raw.tobytes()
        out += [struct.pack("<I", len(raw)), raw]
    return b"".join(out)


def unpack(blob: bytes | memoryview, dtypes: list[str], squeeze: list[bool]) -> list[np.ndarray]:
    out, at = [], 0
    for kind, s in zip(dtypes, squeeze):
        n = struct.unpack_from("<I", blob, at)[0]
        raw = blob[at + 4:at + 4 + n]
        at += 4 + n
        if s and n:
            width = np.dtype(kind).itemsize
            raw = np.ascontiguousarray(np.frombuffer(_open.decompress(raw), np.uint8).reshape(width, -1).T).tobytes()
        out.append(np.frombuffer(raw, kind))
    return out


def by_shard(shard: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """(stable order by shard, [(shard, from, to)] of the shards that have rows)."""
    order = np.argsort(shard, kind="stable")
    ranked = shard[order]
    begin = np.flatnonzero(np.concatenate(([True], ranked[1:] != ranked[:-1]))) if len(ranked) else np.zeros(0, np.int64)
    return order, list(zip(ranked[begin].tolist(), begin.tolist(), np.append(begin[1:], len(ranked)).tolist()))


def each_shard(batches, columns: list[str]):
    """Over rows sorted by ``shard``: (shard, {column: list of its values}), one shard at a time.

    Blobs are views of the batches they came in, not copies.
    """
    now, rows = None, {c: [] for c in columns}
    for batch in batches:
        shard = batch.column("shard").to_numpy()
        starts = np.flatnonzero(np.concatenate(([True], shard[1:] != shard[:-1]))) if len(shard) else []
        for a, b in zip(starts, [*starts[1:], len(shard)]):
            if now is not None and shard[a] != now:
                yield now, rows
                rows = {c: [] for c in columns}
            now = int(shard[a])
            for c in columns:
                part = batch.column(c).slice(a, b - a)
                rows[c] += [memoryview(x.as_buffer()) if x.is_valid else None for x in part] if pa.types.is_binary(part.type) or pa.types.is_large_binary(part.type) else part.to_pylist()
    if now is not None:
        yield now, rows


def rows(names: list[str], values: list[list], types: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, types)], names=names)
