"""SimHash near-duplicates with bit-sliced comparison.

Fingerprints: 64 majority bits over XXH64 of the word shingles.  Equal fingerprints are folded into
one node before anything is compared.

Candidates, without loss: two fingerprints within radius r differ in at most r of b bit blocks, so
they agree on at least b - r whole blocks.  Every choice of b - r blocks is a key; b grows with the
number of fingerprints so that a key keeps its selectivity (5 blocks up to 262,144, then 6,
7, 8).  A key with more than TILE fingerprints is cut into tiles that several tasks compare.

Comparison: the fingerprints of a key are stored vertically, 64 of them in one word for each bit
plane.  A query is compared with 64 at a time: every plane is XORed with the query's bit and added
to carry-save counters; (query, word) blocks in which every lane is beyond the radius are abandoned
every eight planes.  A task reports a spanning forest of its links, never all pairs; the components
follow by alternating star contraction.
"""
from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from .arrays import LOWER_BYTES, add_columns, forget, parts, saved, text_bytes, tidy

SHINGLE = 4
RADIUS = 4
SEED = 42
#: Fingerprints of one key that a task compares with each other.
TILE = 8192
#: (query, word) blocks that are compared at once.
STEP = 1 << 15


# --- fingerprints ---------------------------------------------------------------------------------

def _fingerprint(raw: bytes, shingle: int, digest=xxhash.xxh64_intdigest) -> int:
    words = raw.translate(LOWER_BYTES).split()
    if not words:
        return 0
    n = max(len(words) - shingle + 1, 1)
    flat = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = [0, *(ends[: n - 1] + 1).tolist()]
    hashes = np.array([digest(flat[a:b], SEED) for a, b in zip(starts, ends[-n:].tolist())], np.uint64)
    ones = np.zeros(64, np.int64)
    for a in range(0, n, 1 << 16):
        ones += np.unpackbits(hashes[a:a + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, keep: list[str] | None = None, text: str = "text") -> DataFrame:
    """Documents with ``fp``, the fingerprint as a signed long; a text without words has 0."""
    def make():
        def work(column: pa.Array) -> list:
            data, offsets = text_bytes(column)
            raw = data.tobytes()
            out = np.array([_fingerprint(raw[a:b], shingle) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())], np.uint64)
            return [out.view(np.int64)]
        return work
    return add_columns(docs, "fp long", make, text, keep)


# --- bit-sliced links -----------------------------------------------------------------------------

def bit_planes(fps: np.ndarray, groups: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(planes[64, words], first word of each group, valid lanes of each word); groups: sizes of runs of fps."""
    words = -(-groups // 64)
    first = np.concatenate(([0], np.cumsum(words)))
    row = np.arange(len(fps)) - np.repeat(np.cumsum(groups) - groups, groups)
    lane = np.repeat(first[:-1] * 64, groups) + row
    flat = np.zeros(first[-1] * 64, np.uint64)
    flat[lane] = fps
    used = np.zeros(first[-1] * 64, np.uint8)
    used[lane] = 1
    bits = np.unpackbits(flat.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    planes = np.packbits(bits.reshape(first[-1], 64, 64).transpose(2, 0, 1).reshape(64, -1), axis=1, bitorder="little")
    return np.ascontiguousarray(planes).view("<u8"), first, np.packbits(used, bitorder="little").view("<u8")


def within(planes: np.ndarray, valid: np.ndarray, query: np.ndarray, word: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the blocks (query[i], word[i]) those with a lane within the radius: (block, lanes as bits)."""
    block, q, w = np.arange(len(query)), query, word
    width = radius.bit_length()
    count = [np.zeros(len(q), np.uint64) for _ in range(width)]
    beyond = ~valid[w]
    for p in range(64):
        carry = planes[p, w] ^ (np.uint64(0) - ((q >> np.uint64(p)) & np.uint64(1)))
        for c in count:
            both = c & carry
            c ^= carry
            carry = both
        beyond |= carry
        if p % 8 == 7:
            # count > radius, compared bit by bit from the top
            above, equal = np.zeros(len(q), np.uint64), ~np.zeros(len(q), np.uint64)
            for k in range(width - 1, -1, -1):
                if radius >> k & 1:
                    equal &= count[k]
                else:
                    above |= equal & count[k]
                    equal &= ~count[k]
            beyond |= above
            left = np.flatnonzero(~beyond)
            if len(left) < len(q):
                block, q, w, beyond = block[left], q[left], w[left], beyond[left]
                count = [c[left] for c in count]
            if not len(left):
                break
    return block, ~beyond


def _forest(n: int, pairs) -> np.ndarray:
    """Smallest reachable index of each of n places; pairs: iterable of (a, b) arrays."""
    label = np.arange(n)

    def root(x: np.ndarray) -> np.ndarray:
        while True:
            up = label[x]
            if (up == x).all():
                return x
            x = up
    for a, b in pairs:
        while True:
            ra, rb = root(a), root(b)
            apart = ra != rb
            if not apart.any():
                break
            a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
            np.minimum.at(label, np.maximum(ra, rb), np.minimum(ra, rb))
    return root(label)


def _linked(fps: np.ndarray, sizes: np.ndarray, left: np.ndarray, right: np.ndarray, radius: int) -> np.ndarray:
    """Root of each row; rows of a group are consecutive, left rows query right rows."""
    planes, first, valid = bit_planes(fps, sizes)
    group = np.repeat(np.arange(len(sizes)), sizes)
    start = np.cumsum(sizes) - sizes
    lane_row = np.full(first[-1] * 64, -1)
    lane_row[np.repeat(first[:-1] * 64 - start, sizes) + np.arange(len(fps))] = np.arange(len(fps))
    rights = np.zeros(first[-1] * 64, np.uint8)
    rights[lane_row >= 0] = right[lane_row[lane_row >= 0]]
    valid = valid & np.packbits(rights, bitorder="little").view("<u8")
    asks = np.flatnonzero(left)
    n_words = (first[1:] - first[:-1])[group[asks]]
    bound = np.concatenate(([0], np.cumsum(n_words)))

    def pairs():
        at = 0
        while at < len(asks):
            to = max(at + 1, int(np.searchsorted(bound, bound[at] + STEP, side="right")) - 1)
            some, n = asks[at:to], n_words[at:to]
            row = np.repeat(some, n)
            word = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[:-1][group[some]], n)
            block, lanes = within(planes, valid, fps[row], word, radius)
            if len(block):
                k, lane = np.nonzero(np.unpackbits(lanes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
                a, b = row[block[k]], lane_row[word[block[k]] * 64 + lane]
                yield a[a != b], b[a != b]
            at = to
    return _forest(len(fps), pairs())


def _compare(radius: int):
    """Over rows sorted by group: (later node, earlier node) of a spanning forest of each group's links."""
    def run(batches):
        rest, names = None, ["high", "low"]

        def done(rows: pa.Table):
            key = rows["group"].to_numpy()
            change = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
            sizes = np.diff(np.append(change, len(key)))
            company = np.repeat(sizes > 1, sizes)
            sizes = sizes[sizes > 1]
            side, node, fps = (rows[c].to_numpy()[company] for c in ("side", "node", "fp"))
            root = _linked(fps.view(np.uint64), sizes, (side & 1) > 0, (side & 2) > 0, radius) if len(sizes) else np.zeros(0, np.int64)
            some = np.flatnonzero(root != np.arange(len(root)))
            a, b = node[some], node[root[some]]
            return pa.RecordBatch.from_arrays([pa.array(np.maximum(a, b)), pa.array(np.minimum(a, b))], names=names)

        for batch in batches:
            rows = pa.Table.from_batches([batch])
            if rest is not None:
                rows = pa.concat_tables([rest, rows])
            key = rows["group"].to_numpy()
            cut = int(np.searchsorted(key, key[-1])) if len(key) else 0
            rest = rows.slice(cut)
            if cut:
                yield done(rows.slice(0, cut).combine_chunks())
        if rest is not None and rest.num_rows:
            yield done(rest.combine_chunks())
    return run


def block_masks(n: int, radius: int) -> list[int]:
    """Bit masks of which two fingerprints within the radius share at least one."""
    blocks = radius + 1
    while blocks < radius + 4 and n > 64 << ((blocks - radius) * 64 // blocks):
        blocks += 1
    edges = [64 * k // blocks for k in range(blocks + 1)]
    masks = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:])]
    return [sum(c) for c in combinations(masks, blocks - radius)]


def links(nodes: DataFrame, n: int, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """(high, low) edges of a graph over nodes (fp, node; distinct fp) whose components are those of all links."""
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    masks = F.array(*[F.lit(signed(m)) for m in block_masks(n, radius)])
    keyed = nodes.select("fp", "node", F.posexplode(masks)).select("fp", "node", F.xxhash64("pos", F.col("fp").bitwiseAND(F.col("col"))).alias("group"))
    large = keyed.groupBy("group").count().where(F.col("count") > tile).select("group", F.ceil(F.col("count") / tile).cast("int").alias("tiles"))
    one = keyed.join(large, "group", "left")
    own = F.pmod(F.xxhash64("fp", F.lit(1)), F.col("tiles")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))
    small = one.where("tiles is null").select("group", "fp", "node", F.lit(3).alias("side"))
    cut = one.where("tiles is not null").withColumn("own", own).withColumn("other", other)
    tiles = cut.select(F.xxhash64("group", F.least("own", "other"), F.greatest("own", "other")).alias("group"), "fp", "node",
                       F.when(F.col("own") == F.col("other"), 3).when(F.col("own") < F.col("other"), 1).otherwise(2).alias("side"))
    dealt = small.unionByName(tiles).repartition(parts(nodes.sparkSession), "group").sortWithinPartitions("group")
    return dealt.mapInArrow(_compare(radius), "high long, low long").distinct()


# --- components -----------------------------------------------------------------------------------

def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of edges (high, low); component is the smallest reachable node.

    Alternating large and small stars; a round is written to the shared folder and the one before
    it deleted.  A star's smallest neighbour is an aggregate, so no neighbourhood is gathered.
    """
    now, before = saved(edges, "edges"), None
    while True:
        both = now.unionByName(now.select(F.col("low").alias("high"), F.col("high").alias("low")))
        least = both.groupBy(F.col("high").alias("of")).agg(F.min(F.least("low", "high")).alias("m"))
        large = now.join(least, F.col("low") == F.col("of")).select("high", F.col("m").alias("low")).distinct()
        small = large.groupBy(F.col("high").alias("of")).agg(F.min("low").alias("m"))
        turned = large.join(small, F.col("high") == F.col("of"))
        grown = turned.select(F.col("high"), F.col("m").alias("low")).unionByName(
            turned.where("low <> m").select(F.col("low").alias("high"), F.col("m").alias("low"))).distinct()
        after = saved(grown, "edges")
        check = lambda df: df.agg(F.count("*"), F.sum(F.xxhash64("high", "low").cast("decimal(38,0)"))).first()
        same = check(now) == check(after)
        forget(now)
        now = after
        if same:
            return now.select(F.col("high").alias("node"), F.col("low").alias("component"))


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, tile: int = TILE,
                    keep: list[str] | None = None, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Columns in keep and the id, with ``fp``, ``component_id`` (the smallest linked id) and ``component_key`` (its name, never null).

    A null or wordless text has fingerprint 0 and is linked like any other.  A null id counts as the
    largest: it names a component only where no member has an id, and then component_id is null.
    Repeated rows and ids keep their rows.  An empty table gives an empty result.
    """
    stay = [c for c in keep or [] if c.lower() not in ("fp", "component_id", "component_key")]
    prints = saved(fingerprints(docs, shingle, list(dict.fromkeys([id_col, *stay])), text), "prints")
    nodes = saved(prints.where(F.col(f"`{id_col}`").isNotNull()).groupBy("fp").agg(F.min(F.col(f"`{id_col}`")).alias("node"))
                  .unionByName(prints.where(F.col(f"`{id_col}`").isNull()).select("fp", F.lit(None).cast("long").alias("node")))
                  .groupBy("fp").agg(F.min("node").alias("node")), "nodes")
    n = nodes.count()
    # a fingerprint that only rows without an id have takes part under a name of its own, beyond all ids
    nameless = F.coalesce("node", F.lit((1 << 62)) + F.pmod("fp", F.lit(1 << 61)))
    named = nodes.select("fp", nameless.alias("node"), F.col("node").isNull().alias("nameless"))
    joined = components(links(named.select("fp", "node"), n, radius, tile))
    label = named.join(joined, "node", "left").select("fp", F.coalesce("component", "node").alias("component_key"))
    blank = named.where("nameless").select(F.col("node").alias("component_key"), F.lit(True).alias("blank"))
    label = (label.join(blank, "component_key", "left")
             .select("fp", "component_key", F.when(F.col("blank").isNull(), F.col("component_key")).alias("component_id")))
    return prints.join(label, "fp")


def one_of_each(docs: DataFrame, text: str = "text", id_col: str = "doc_id", **options) -> DataFrame:
    """One row of each component, with the columns of docs: that with the smallest id (ids before nulls, then by a hash of the text).

    Of rows that repeat id and text one stays.
    """
    docs = tidy(docs)
    named = docs.withColumns({"_near_id": F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(-(1 << 63))), "_near_hash": F.xxhash64(F.col(f"`{text}`").cast("string"))})
    marked = near_duplicates(named.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text}`").alias("text"), "_near_id", "_near_hash"), keep=["_near_id", "_near_hash"], **options)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("blank"), "_near_id", "_near_hash"))
    kept = marked.groupBy("component_key").agg(first.alias("f")).select("f._near_id", "f._near_hash")
    return named.join(kept, ["_near_id", "_near_hash"], "left_semi").dropDuplicates(["_near_id", "_near_hash"]).drop("_near_id", "_near_hash")


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = near_duplicates(docs)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


QUERIES = {"op9_simhash": op9_simhash}
ORACLES: dict[str, str] = {}
