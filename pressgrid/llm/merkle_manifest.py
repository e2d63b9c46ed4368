"""Merkle manifest of a dataset with incremental witnesses.

Every row is a leaf.  The leaves of a group, in order, form a tree of runs of three; the group's
subroot is its last node.  The subroots, in order of their groups, form a tree of the same kind, whose
last node is the root of the dataset.  A leaf's witness is the path to the root: for each level the
digests left and right of its ancestor, enough to fold a leaf to the root without any other row.

Leaves are appended one after another (``Appender``): a run of three completes a node, which gives every
leaf below its members one more step of witness, and is itself appended one level higher; subtrees not yet
complete stay open with partial witnesses.  A group is cut into aligned blocks of 3**HEIGHT leaves, so
a task appends a bounded block whatever the size of the group; the roots of the blocks are written and
are the leaves of the next round.  On the way back each block's own path is dealt to the block, in front of
its rows, and continues the paths inside: a round moves digests, never witnesses.
"""
from __future__ import annotations

from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from ..operators.ordering import positions
from .arrays import forget, parts, saved, tidy

RUN = 3
#: Levels of a block: 3**8 = 6,561 leaves.
HEIGHT = 8
PATH = "array<struct<before: string, after: string>>"
COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]


# --- leaves ---------------------------------------------------------------------------------------

def field(value: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_digest(*values: Column) -> Column:
    return F.sha2(F.concat(*[field(v) for v in values]), 256)


def tampered_text(doc_id: Column, text: Column) -> Column:
    """The text without line feeds where 2 divides crc32 of the id; else, and for null ids, the text."""
    return F.when(F.crc32(doc_id.cast("string").cast("binary")) % 2 == 0, F.replace(text, F.lit("\n"), F.lit(""))).otherwise(text)


# --- appending ------------------------------------------------------------------------------------

def parent(digests: list[str]) -> str:
    return sha256("".join(digests).encode()).hexdigest()


class Appender:
    """Open subtrees of one block, and the witness of each of its leaves so far."""

    def __init__(self, height: int = HEIGHT):
        self.height, self.open, self.paths = height, [[] for _ in range(height + 1)], []

    def append(self, digest: str) -> None:
        n = len(self.paths)
        self.paths.append([])
        self._push(0, (digest, n, n + 1))

    def _push(self, level: int, node: tuple[str, int, int]) -> None:
        self.open[level].append(node)
        if len(self.open[level]) == RUN and level < self.height:
            self._complete(level)

    def _complete(self, level: int) -> None:
        run, self.open[level] = self.open[level], []
        digests = [d for d, _, _ in run]
        for k, (_, a, b) in enumerate(run):
            step = ("".join(digests[:k]), "".join(digests[k + 1:]))
            for path in self.paths[a:b]:
                path.append(step)
        self._push(level + 1, (parent(digests), run[0][1], run[-1][2]))

    def close(self, alone: bool) -> str:
        """The block's root; runs left open end as they are.  alone: the block is its whole group, so its tree ends with its last node."""
        for level in range(self.height):
            if alone and len(self.open[level]) == 1 and not any(self.open[level + 1:]):
                return self.open[level][0][0]
            if self.open[level]:
                self._complete(level)
        return self.open[self.height][0][0]


def _blocks(batches, columns: list[str]):
    """(group, block, rows) of runs of rows, in the order they come; rows: lists of the columns."""
    now, rows = None, []
    for batch in batches:
        for row in zip(*[batch.column(c).to_pylist() for c in ("grp", "block", *columns)]):
            if now is not None and row[:2] != now:
                yield *now, rows
                rows = []
            now = row[:2]
            rows.append(row[2:])
    if now is not None:
        yield *now, rows


def _close_blocks(height: int, size: int):
    def run(batches):
        out = []
        for grp, block, rows in _blocks(batches, ["digest"]):
            tree = Appender(height)
            for (digest,) in rows:
                tree.append(digest)
            out.append((grp, block, tree.close(block == 0 and len(rows) < size)))
            if len(out) == 4096:
                yield _roots_batch(out)
                out = []
        yield _roots_batch(out)
    return run


def _roots_batch(out: list[tuple]) -> pa.RecordBatch:
    grp, block, root = zip(*out) if out else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(grp, pa.string()), pa.array(block, pa.int64()), pa.array(root, pa.string())], names=["grp", "pos", "digest"])


def path_array(paths: list[list[tuple[str, str]]]) -> pa.Array:
    ends = [0]
    for p in paths:
        ends.append(ends[-1] + len(p))
    both = [pa.array([s[k] for p in paths for s in p], pa.string()) for k in (0, 1)]
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(both, names=["before", "after"]))


def _attach(height: int, size: int, keep: list[str]):
    def run(batches):
        kinds, out, paths = {}, [], []

        def noted():
            for batch in batches:
                kinds.update({f.name: f.type for f in batch.schema})
                yield batch

        def done() -> pa.RecordBatch:
            names = ["grp", "pos", "subroot", *keep]
            columns = [pa.array([r[i] for r in out], kinds[c]) for i, c in enumerate(names)]
            return pa.RecordBatch.from_arrays([*columns, path_array(paths)], names=[*names, "path"])

        for grp, block, rows in _blocks(noted(), ["pos", "digest", "path", "subroot", *keep]):
            if rows[0][0] is not None:
                raise ValueError("a block without a path")
            above, subroot = [(s["before"], s["after"]) for s in rows[0][2]], rows[0][3]
            tree = Appender(height)
            for row in rows[1:]:
                tree.append(row[1])
            tree.close(block == 0 and len(rows) - 1 < size)
            out += [(grp, row[0], subroot, *row[4:]) for row in rows[1:]]
            paths += [p + above for p in tree.paths]
            if len(out) >= 4096:
                yield done()
                out, paths = [], []
        if out:
            yield done()
    return run


def _dealt(rows: DataFrame, height: int) -> DataFrame:
    """Rows in their blocks, in order; a row without a position comes first."""
    return rows.repartition(parts(rows.sparkSession), "grp", "block").sortWithinPartitions("grp", "block", F.asc_nulls_first("pos"))


def _block(height: int) -> Column:
    return F.floor(F.col("pos") / F.lit(RUN ** height)).cast("long")


def rounds(nodes: DataFrame, height: int = HEIGHT) -> list[DataFrame]:
    """Tables (grp, pos, digest) from the leaves up to one node a group; nodes: the leaves, positions from 0."""
    out = [nodes]
    while out[-1].where("pos > 0").limit(1).count():
        dealt = _dealt(out[-1].select("grp", _block(height).alias("block"), "pos", "digest"), height)
        out.append(saved(dealt.mapInArrow(_close_blocks(height, RUN ** height), "grp string, pos long, digest string"), "nodes"))
    return out


def paths_down(tables: list[DataFrame], top: DataFrame, height: int = HEIGHT) -> DataFrame:
    """(grp, pos, subroot, further columns, path) of the nodes of the first table; top: (grp, pos, subroot, path) of the nodes of the last one."""
    if len(tables) == 1:
        return tables[0].join(top.select(F.col("grp").alias("g"), "subroot", "path"), F.col("grp").eqNullSafe(F.col("g"))).drop("g", "digest")
    path = top
    for nodes in reversed(tables[:-1]):
        more = [f for f in nodes.schema if f.name not in ("grp", "pos", "digest")]
        null = lambda kind: F.lit(None).cast(kind)
        below = nodes.select("grp", _block(height).alias("block"), "pos", "digest", null(PATH).alias("path"), null("string").alias("subroot"), *[f.name for f in more])
        first = path.select("grp", F.col("pos").alias("block"), null("long").alias("pos"), null("string").alias("digest"), "path", "subroot", *[null(f.dataType).alias(f.name) for f in more])
        out = StructType([StructField("grp", StringType()), StructField("pos", LongType()), StructField("subroot", StringType()), *more])
        path = _dealt(below.unionByName(first), height).mapInArrow(_attach(height, RUN ** height, [f.name for f in more]), out.add("path", ArrayType(StructType().add("before", "string").add("after", "string"))))
    return path


# --- manifest -------------------------------------------------------------------------------------

def manifest(docs: DataFrame, columns: list[str] = COLUMNS, order: str = "doc_id", group: str = "source", extra: dict[str, Column] | None = None,
             height: int = HEIGHT) -> DataFrame:
    """(order, leaf, the extra columns, subroot, root, path) of every row.

    The digests cover the named columns, a null as ``-``.  Leaves of a group ascend by order (nulls
    first), rows with the same order by their digests, so repeated rows are leaves of their own and the
    root does not depend on where rows lie.  A null group is a group of its own, the first.  A single leaf is
    its group's subroot, a single subroot the root, each with an empty path.  An empty table gives an
    empty result.  Columns that are not named, clashing ones too, are not read.
    """
    docs = tidy(docs)
    names = list(extra or {})
    hashed = saved(docs.select(F.col(f"`{group}`").cast("string").alias("grp"), F.col(f"`{order}`").alias("ord"),
                               leaf_digest(*[F.col(f"`{c}`") for c in columns]).alias("digest"), *[(extra or {})[n].alias(f"x_{n}") for n in names]).withColumn("leaf", F.col("digest")), "leaves")
    keyed = hashed.withColumn("key", F.struct("ord", "digest", *[f"x_{n}" for n in names]))
    placed = saved(positions(keyed, ["grp"], "key", "pos").drop("key"), "placed")
    inside = rounds(placed, height)
    # subroots: positions among the groups, one tree over all
    subroots = saved(positions(inside[-1].select("grp", F.col("digest").alias("subroot")).withColumn("key", F.struct("grp")), [], "key", "place").drop("key"), "subroots")
    across = rounds(subroots.select(F.lit("").alias("grp"), F.col("place").alias("pos"), F.col("subroot").alias("digest")), height)
    root = across[-1].select(F.col("digest").alias("root"))
    empty = across[-1].select("grp", "pos", F.lit("").alias("subroot"), F.array().cast(PATH).alias("path"))
    upper = paths_down(across, empty, height).select(F.col("pos").alias("place"), "path").join(subroots, "place")
    rows = paths_down(inside, upper.select("grp", F.lit(0).cast("long").alias("pos"), "subroot", "path"), height)
    forget(hashed)
    return rows.crossJoin(F.broadcast(root)).select(  # the root is one row
        F.col("ord").alias(order), "leaf", *[F.col(f"x_{n}").alias(n) for n in names], "subroot", "root", "path")


def proof_digest(path: Column) -> Column:
    """Digest of a path's siblings, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["before"], s["after"])), ""), 256)


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and a path lead to."""
    return F.aggregate(path, leaf, lambda h, s: F.sha2(F.concat(s["before"], h, s["after"]), 256))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*COLUMNS)
    other = tampered_text(F.col("doc_id"), F.col("text"))
    changed = F.when(~other.eqNullSafe(F.col("text")), leaf_digest(*[F.col(c) if c != "text" else other for c in COLUMNS]))
    rows = manifest(docs, extra={"tampered": changed})
    back = rows.withColumn("folded_root", folded(F.coalesce("tampered", "leaf"), F.col("path")))
    return back.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"), "folded_root",
                       (F.col("folded_root") == F.col("root")).alias("verified"))


QUERIES = {"op13_merkle_manifest": op13_merkle_manifest}
ORACLES: dict[str, str] = {}
