"""Best-fit packing by hierarchical residual packing.

Documents become token sequences with an end mark; only those longer than a sequence are cut.  The
pieces are dealt to groups of about ``group_items`` at random.  Every group packs best-fit
decreasing, emits its (nearly) full bins, and keeps the underfull ones; these become items
themselves, ``fan_in`` groups merge into one and pack again, until one group is left or no two bins
fit together any more.  A bin holds at most ``capacity`` pieces, so rows stay bounded, and no
group ever gathers more than the underfull bins of the groups below it.
"""
from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from .arrays import LOWER, MAP_BYTES, SPACED, forget, parts, pieces_of, release, runs, saved, span_hashes, text_bytes, tidy

CAPACITY = 4096
END_ID = 1
#: Bins at least this full are emitted in every round, the others travel on.
FULL = 0.995
GROUP_ITEMS = 8192
FAN_IN = 8
#: Words whose tokens a worker keeps; the store is emptied when it is full.
CACHED_WORDS = 400_000

PIECE = "piece int, start long, length long, ids_crc32 long"


def tokenizer_path() -> str:
    import public_tokenizers
    return str(public_tokenizers.path("word_bpe_49k.json"))


# classes of bytes: white space, letter, digit, other ASCII, apostrophe, part of any other character
_SPACE, _LETTER, _DIGIT, _OTHER, _APOSTROPHE, _UNKNOWN = range(6)
_CLASS = np.full(256, _UNKNOWN, np.uint8)
_CLASS[:128] = _OTHER
_CLASS[~SPACED] = _SPACE
_CLASS[ord("'")] = _APOSTROPHE
_CLASS[48:58] = _DIGIT
_CLASS[65:91] = _CLASS[97:123] = _LETTER
#: Neighbouring classes between which the tokenizer always starts a new piece.
_PARTS = np.zeros((6, 6), bool)
_PARTS[_DIGIT, 1:5] = _PARTS[1:5, _DIGIT] = True
_PARTS[_LETTER, [_OTHER, _APOSTROPHE]] = _PARTS[_OTHER, _LETTER] = True


#: The signs for times and divided by, and a capital whose small form is more than one letter.
_NO_LETTERS = np.array([0xC397, 0xC3B7, 0xC4B0], np.uint16)


def cuts(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Flags of the places inside words where a new piece always starts, and of bytes that may take part in several pieces.

    Letters of ASCII and of U+00C0 to U+023F count as such; next to any other character nothing is cut.
    """
    kind = _CLASS[data]
    lead = np.flatnonzero((data[:-1] >= 0xC3) & (data[:-1] <= 0xC8))
    pair = data[lead].astype(np.uint16) << 8 | data[lead + 1]
    lead = lead[~np.isin(pair, _NO_LETTERS)]
    kind[lead] = kind[lead + 1] = _LETTER
    out = np.zeros(len(data) + 1, bool)
    out[1:-1] = _PARTS.reshape(-1)[kind[:-1] * np.uint8(6) + kind[1:]]
    return out, kind >= _APOSTROPHE


class WordTokens:
    """Token ids of texts by way of parts of their words.

    The tokenizer lowers case and its pieces cross neither white space nor the places of cuts(), so a
    text's ids are those of its parts in a row; each distinct part is encoded once while it stays in the store.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        self.encoder = Tokenizer.from_file(path)
        names = self.encoder.get_vocab(with_added_tokens=True)
        #: Tokens that end a piece.
        self.is_end = np.zeros(max(names.values()) + 1, bool)
        self.is_end[[k for name, k in names.items() if name.endswith("</w>")]] = True
        self.clear()

    def clear(self) -> None:
        self.slot: dict[int, int] = {}
        self.begin, self.size = np.zeros(1, np.int64), np.zeros(1, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def _sizes(self, words: list[str], single: bool) -> tuple[list[int], np.ndarray]:
        """(ids of the words in a row, how many each has); single: every word is one piece of the tokenizer."""
        text = " ".join(words)
        if single:
            ids = self.encoder.encode_batch_fast([text], add_special_tokens=False)[0].ids
            stop = np.flatnonzero(self.is_end[ids])
            if len(stop) == len(words) and stop[-1] == len(ids) - 1:
                return ids, np.diff(stop, prepend=-1)
        place = np.cumsum([0] + [len(w) + 1 for w in words])
        encoded = self.encoder.encode(text, add_special_tokens=False)
        at = np.fromiter((a for a, _ in encoded.offsets), np.int64, len(encoded.ids))
        return encoded.ids, np.bincount(np.searchsorted(place, at, side="right") - 1, minlength=len(words))

    def learn(self, hashes: list[int], words: list[str], single: np.ndarray) -> None:
        for kind in (True, False):
            some = np.flatnonzero(single == kind).tolist()
            if not some:
                continue
            ids, size = self._sizes([words[k] for k in some], kind)
            n = len(self.slot)
            self.slot.update(zip([hashes[k] for k in some], range(n, n + len(some))))
            begin = len(self.ids) + np.cumsum(size) - size
            self.begin, self.size = np.concatenate((self.begin[:n], begin, [0])), np.concatenate((self.size[:n], size, [0]))
            self.ids = np.concatenate((self.ids, np.array(ids, np.uint32)))

    def encode(self, column: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, each followed by end_id; bounds of the texts)."""
        data, offsets = text_bytes(column)
        # the tokenizer's own marks are found before case is lowered and would be cut: such texts go by whole words
        plain = len(data) > 1 and bool(((data[:-1] == ord("<")) & (data[1:] == ord("|"))).any())
        if not plain:
            data = LOWER[data]
        places, mixed = (None, np.ones(len(data), bool)) if plain or not len(data) else cuts(data)
        starts, ends, first = runs(data, offsets, SPACED, places)
        distinct, at, which = np.unique(span_hashes(data, starts, ends), return_index=True, return_inverse=True)
        keys = distinct.tolist()
        if len(self.slot) + len(keys) > CACHED_WORDS:
            self.clear()
        new = [k for k, h in enumerate(keys) if h not in self.slot]
        if new:
            raw, place = data.tobytes(), at[new]
            bound = np.concatenate(([0], np.cumsum(mixed)))
            a, b = starts[place], ends[place]
            self.learn([keys[k] for k in new], [raw[x:y].decode() for x, y in zip(a.tolist(), b.tolist())], bound[a] == bound[b])
        slots = np.fromiter(map(self.slot.__getitem__, keys), np.int64, len(keys))
        words = np.insert(slots[which], first[1:], len(self.slot)) if len(which) else np.full(len(first) - 1, len(self.slot))
        end_slot = words == len(self.slot)
        size = np.where(end_slot, 1, self.size[np.minimum(words, len(self.size) - 1)])
        begin = np.where(end_slot, len(self.ids), self.begin[np.minimum(words, len(self.begin) - 1)])
        stop = np.cumsum(size)
        pool = np.append(self.ids, np.uint32(end_id))
        ids = pool[np.repeat(begin - (stop - size), size) + np.arange(stop[-1] if len(stop) else 0)]
        bounds = np.concatenate(([0], stop[np.flatnonzero(end_slot)])) if len(stop) else np.zeros(len(first), np.int64)
        return ids, bounds


#: Tokenizers of a worker, loaded once; their parts of words go at the end of each task.
_workers: dict[str, WordTokens] = {}


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, keep: list[str] | None = None,
           with_ids: bool = False, text: str = "text") -> DataFrame:
    """One row for each piece of a document: the columns in keep, PIECE, and the token ids if asked for."""
    docs = tidy(docs)
    new = StructType.fromDDL(PIECE + (", ids array<int>" if with_ids else ""))
    taken = {f.name for f in new}
    stay = [c for c in (docs.columns if keep is None else keep) if c.lower() not in taken]
    source = docs.select(*[F.col(f"`{c}`") for c in stay], F.col(f"`{text}`").cast("string").alias("_input_text"))
    out = StructType([f for f in source.schema if f.name != "_input_text"] + list(new))

    def run(batches):
        own = _workers.setdefault(tokenizer, WordTokens(tokenizer)) if tokenizer not in _workers else _workers[tokenizer]
        try:
            for batch in batches:
                for part in pieces_of(batch, "_input_text", MAP_BYTES):
                    ids, bounds = own.encode(part.column("_input_text"), end_id)
                    total = np.diff(bounds)
                    n = -(-total // capacity)
                    row = np.repeat(np.arange(len(total)), n)
                    piece = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                    start = piece * capacity
                    length = np.minimum(total[row] - start, capacity)
                    raw = ids.astype("<u4")
                    begin = bounds[row] + start
                    crc = np.array([zlib.crc32(raw[a:a + k]) for a, k in zip(begin.tolist(), length.tolist())], np.int64)
                    kept = [part.column(i).take(pa.array(row)) for i in range(len(stay))]
                    more = [pa.ListArray.from_arrays(pa.array(np.append(begin, len(ids)).astype(np.int32)), pa.array(ids.astype(np.int32)))] if with_ids else []
                    yield pa.RecordBatch.from_arrays(kept + [pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc)] + more, names=out.names)
        finally:  # the worker goes on to other stages
            own.clear()
            release()

    return source.mapInArrow(run, out)


def best_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Items in decreasing order (ties by place) into the open bin with the least room that suffices."""
    order = sorted(range(len(lengths)), key=lambda i: (-lengths[i], i))
    bins: list[list[int]] = []
    with_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0
    for i in order:
        n = lengths[i]
        above = rooms >> n
        if above:
            room = n + (above & -above).bit_length() - 1
            b = with_room[room].pop()
            if not with_room[room]:
                rooms ^= 1 << room
            bins[b].append(i)
        else:
            room, b = capacity, len(bins)
            bins.append([i])
        room -= n
        if room:
            with_room[room].append(b)
            rooms |= 1 << room
    return bins


def _pack_group(capacity: int, full: int, round_no: int):
    def run(key, table):
        table = table.combine_chunks()
        by = pc.sort_indices(table, sort_keys=[("fill", "descending"), ("mark", "ascending")])
        table = table.take(by).combine_chunks()
        fills = table["fill"].to_pylist()
        bins = best_fit(fills, capacity)
        members = table["members"].combine_chunks()
        at, values = members.offsets.to_numpy(), members.values
        flat = np.concatenate([np.arange(at[i], at[i + 1]) for b in bins for i in b])
        count = [sum(int(at[i + 1] - at[i]) for i in b) for b in bins]
        fill = [sum(fills[i] for i in b) for b in bins]
        group = key[0].as_py()
        bin_id = [(round_no << 56) | (group << 28) | k for k in range(len(bins))]
        packed = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(count))).astype(np.int32)), values.take(pa.array(flat)))
        return pa.table({"group": pa.array([group] * len(bins), pa.int64()), "bin": pa.array(bin_id, pa.int64()), "fill": pa.array(fill, pa.int64()),
                         "full": pa.array([f >= full for f in fill]), "members": packed})
    return run


def _places(batches):
    """Bins to one row for each member, with its gapless offset."""
    for batch in batches:
        members = batch.column("members")
        n = pc.list_value_length(members).to_numpy(zero_copy_only=False).astype(np.int64)
        flat = members.flatten()
        length = flat.field("length").to_numpy(zero_copy_only=False)
        stop = np.cumsum(length)
        base = np.concatenate(([0], stop))[np.concatenate(([0], np.cumsum(n)[:-1]))] if len(n) else np.zeros(0, np.int64)
        cols = [flat.field(i) for i in range(flat.type.num_fields)]
        yield pa.RecordBatch.from_arrays(cols + [pa.array(np.repeat(batch.column("bin").to_numpy(), n)), pa.array(stop - length - np.repeat(base, n))],
                                         names=[flat.type.field(i).name for i in range(flat.type.num_fields)] + ["sequence_id", "offset"])


def pack(items: DataFrame, capacity: int = CAPACITY, full: float = FULL, group_items: int = GROUP_ITEMS, fan_in: int = FAN_IN) -> DataFrame:
    """Items with a ``length`` of 1 to capacity, with ``sequence_id`` and ``offset``; every row is placed once.

    Repeated rows are items of their own; ties in length go by a hash of the row.  No items, no rows.
    """
    spark, cols = items.sparkSession, items.columns
    row = F.struct(*[F.col(f"`{c}`") for c in cols])
    todo = saved(items.select(F.col("length").cast("long").alias("fill"), F.xxhash64(row).alias("mark"), F.array(row).alias("members")), "items")
    n = todo.count()
    groups, level, done, inner = max(1, math.ceil(n / group_items)), 0, [], todo.schema["members"]
    schema = StructType.fromDDL("group long, bin long, fill long, full boolean").add(inner)
    if not n:
        return items.withColumns({"sequence_id": F.lit(0).cast("long"), "offset": F.lit(0).cast("long")})
    dealt = todo.withColumn("group", F.pmod("mark", F.lit(groups)))
    while True:
        packed = saved(dealt.groupBy("group").applyInArrow(_pack_group(capacity, math.ceil(full * capacity), level), schema), "bins")
        if level == 0:
            forget(todo)
        rest = packed.where("not full")
        # two bins can only meet if the emptiest one fits to another; one group has tried all
        smallest = [r["fill"] for r in rest.select("fill").orderBy("fill").limit(2).collect()]
        merged = max(math.ceil(groups / fan_in), math.ceil(rest.count() / group_items))
        if groups == 1 or sum(smallest) > capacity or len(smallest) < 2 or merged >= groups:
            done.append(packed.select("bin", "members"))
            break
        done.append(packed.where("full").select("bin", "members"))
        dealt = rest.select("fill", F.col("bin").alias("mark"), "members", F.pmod(F.xxhash64("bin"), F.lit(merged)).alias("group"))
        groups, level = merged, level + 1
    bins = done[0]
    for more in done[1:]:
        bins = bins.unionByName(more)
    out = StructType(list(items.schema) + list(StructType.fromDDL("sequence_id long, offset long")))
    return bins.mapInArrow(_places, out)


def packed_documents(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID,
                     keep: list[str] | None = None, with_ids: bool = False, text: str = "text", **options) -> DataFrame:
    """Pieces of all documents with their places: columns in keep, PIECE, (ids,) sequence_id, offset.

    A null or empty text is the end mark alone.  Columns of docs that have a new name give way.
    """
    new = {"sequence_id", "offset"}
    stay = [c for c in (tidy(docs).columns if keep is None else keep) if c.lower() not in new and (keep is not None or c != text)]
    return pack(pieces(docs, tokenizer or tokenizer_path(), capacity, end_id, stay, with_ids, text), capacity, **options)


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return packed_documents(docs, keep=["doc_id"])


QUERIES = {"op8_best_fit_packing": op8_best_fit_packing}
ORACLES: dict[str, str] = {}
