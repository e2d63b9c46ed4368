"""Spelling variant grouping by a relational trie frontier.

Words are counted over all documents; words one edit apart (a code point inserted, deleted or
replaced) are neighbours, and a rare word's form is its most frequent neighbour, if that is
``RATIO`` times as frequent.

The trie is a table of edges (level, node, label, child, end), where a node is named by the hash of its
prefix and ``end`` is the word that ends at the child.  The frontier is a table of states (word, position,
node, edits).  Each level joins the frontier with the edges of the level: a state either follows the
edge whose label its word goes on with, or, as long as it has no edit, spends its edit on another edge of
its node.  States that reach the end of a word with one edit are neighbours.  A pair is found from
one side only (a letter replaced by a larger one, a letter deleted) and mirrored afterwards.

Words enter the trie in the middle: of two words one edit apart, either the first half of one or its second half
is left whole, so a word starts at the node of its first half, and its reversal at the node of its
second half in the trie of the reversed words.  So no state ever stands near the root, where all words
would meet on a few nodes.  Labels have one code point up to depth ``SINGLE``; beyond it they grow with the depth,
so a very long word costs a number of levels that grows with its logarithm.

Nodes are 64-bit hashes; two prefixes that share one can only add candidates, and every candidate is compared by
value with the word before it counts.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .arrays import forget, saved, tidy

MIN_LENGTH, MIN_COUNT, RATIO = 6, 5, 5
RUN = "[A-Za-z\\u00C0-\\u00FF]+"
#: One run in so many loses a code point in op11_spelling_variants.
SLIP = 199
SINGLE = 12

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


# --- words ----------------------------------------------------------------------------------------

def ascii_lower(text: Column) -> Column:
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))


def slipped(doc_id: Column, run: Column, slip: int = SLIP) -> Column:
    """The run, or where ``slip`` divides crc32 of ``<doc_id>:<run>`` the run without one code point; a null id loses none."""
    h = F.crc32(F.concat(doc_id.cast("string"), F.lit(":"), run).cast("binary"))
    at = F.pmod(h, F.length(run)).cast("int")
    return F.when(F.pmod(h, F.lit(slip)) == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))).otherwise(run)


def vocabulary(docs: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, slip: int | None = None,
               text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(word, n): lower-cased runs of letters of min_length code points or more, found min_count times or more."""
    source = tidy(docs).select(F.col(f"`{id_col}`").alias("id"), F.explode(F.regexp_extract_all(F.col(f"`{text}`").cast("string"), F.lit(RUN), F.lit(0))).alias("run"))
    # a run can lose one code point at most, so shorter ones leave before anything is computed from them
    runs = source.where(F.length("run") >= min_length).select("id", ascii_lower(F.col("run")).alias("run"))
    words = runs.select((slipped(F.col("id"), F.col("run"), slip) if slip else F.col("run")).alias("word")).where(F.length("word") >= min_length)
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= min_count)


# --- trie -----------------------------------------------------------------------------------------

def depths(first: int, longest: int, single: int = SINGLE) -> list[int]:
    """Depths of the trie's nodes: one apart up to single, then further and further apart."""
    out = [first]
    while out[-1] < longest:
        out.append(out[-1] + (1 if out[-1] < single else max(2, out[-1] // 3)))
    return out


def _node(text: Column, depth: int) -> Column:
    return F.xxhash64("back", F.substring(text, 1, depth))


def both_ways(words: DataFrame) -> DataFrame:
    """(back, text, n): every word and its reversal."""
    return words.select(F.explode(F.array(F.struct(F.lit(False).alias("back"), F.col("word").alias("text")),
                                          F.struct(F.lit(True).alias("back"), F.reverse("word").alias("text")))).alias("w"), "n").select("w.*", "n")


def trie_edges(texts: DataFrame, at: list[int]) -> DataFrame:
    """(level, node, label, child, end, end_n): edges between the depths in at, and the word that ends at the child."""
    def edge(k: int) -> Column:
        ends = F.length("text") <= at[k + 1]
        return F.when(F.length("text") > at[k], F.struct(
            F.lit(k).alias("level"), _node(F.col("text"), at[k]).alias("node"), F.substring("text", at[k] + 1, at[k + 1] - at[k]).alias("label"),
            _node(F.col("text"), at[k + 1]).alias("child"), F.when(ends, F.col("text")).alias("end"), F.when(ends, F.col("n")).alias("end_n")))
    rows = texts.select(F.explode(F.array_compact(F.array(*[edge(k) for k in range(len(at) - 1)]))).alias("e")).select("e.*")
    return rows.groupBy("level", "node", "label", "child").agg(F.max("end").alias("end"), F.max("end_n").alias("end_n"))


def _starts(texts: DataFrame, at: list[int], level: int) -> DataFrame:
    """States of the texts that enter at this level: the deepest node inside the half that stays whole."""
    half = F.when(F.col("back"), F.length("text") - F.floor(F.length("text") / 2)).otherwise(F.floor(F.length("text") / 2))
    here = (half >= at[level]) & (half < at[level + 1]) if level + 1 < len(at) else half >= at[level]
    return texts.where(here).select("back", "text", "n", F.lit(at[level]).alias("pos"), _node(F.col("text"), at[level]).alias("node"), F.lit(0).alias("edits"))


def _shared(a: Column, b: Column) -> Column:
    """Length of the common prefix; a is not empty."""
    return F.size(F.filter(F.sequence(F.lit(1), F.length(a)), lambda j: F.substring(a, F.lit(1), j) == F.substring(b, F.lit(1), j)))


def step(frontier: DataFrame, edges: DataFrame, stride: int) -> DataFrame:
    """States after one level, with the word that ends at their node."""
    ahead = F.substring(F.col("text"), F.col("pos") + 1, F.length("text"))
    follow = frontier.withColumn("label", F.substring(F.col("text"), F.col("pos") + 1, F.lit(stride))).join(edges, ["node", "label"])
    followed = follow.select("back", "text", "n", (F.col("pos") + F.length("label")).alias("pos"), F.col("child").alias("node"), "edits", "end", "end_n")
    other = frontier.where("edits = 0").withColumn("rest", ahead).join(edges, "node").where(F.col("label") != F.substring(F.col("rest"), F.lit(1), F.lit(stride)))
    size, same = F.length("label"), F.lit(0) if stride == 1 else _shared(F.col("label"), F.col("rest"))
    other = other.withColumns({"size": size, "same": same})
    label, rest, n, i, pos = F.col("label"), F.col("rest"), F.col("size"), F.col("same"), F.col("pos")
    inside = (i < n) & (i < F.length(rest))
    to = lambda ok, place, edits: F.when(ok, F.struct(place.cast("int").alias("to"), F.lit(edits).alias("spent")))
    moves = [to(inside & (F.substring(label, i + 1, F.lit(1)) > F.substring(rest, i + 1, F.lit(1)))
                & (F.substring(label, i + 2, n) == F.substring(rest, i + 2, n - i - 1)), pos + n, 1),
             to(inside & (F.substring(label, i + 1, n) == F.substring(rest, i + 2, n - i)), pos + n + 1, 1)]
    if stride > 1:
        moves.append(to((i == n) & (F.length(rest) == n + 1), pos + n, 0))
    edited = other.withColumn("move", F.explode(F.array_compact(F.array(*moves))))
    return followed.unionByName(edited.select("back", "text", "n", F.col("move.to").alias("pos"), F.col("child").alias("node"), F.col("move.spent").alias("edits"), "end", "end_n"))


def neighbours(words: DataFrame, min_length: int = MIN_LENGTH) -> DataFrame:
    """(word, n, near, near_n): all ordered pairs of words one edit apart; words: distinct (word, n) of min_length code points or more.

    Every level's frontier is written to the shared folder; all go once the pairs are written.
    """
    texts = both_ways(words)
    longest = words.agg(F.max(F.length("word"))).first()[0] or 0
    at = depths(max(min_length // 2, 0), longest)
    if not longest:
        return words.limit(0).select("word", "n", F.col("word").alias("near"), F.col("n").alias("near_n"))
    edges = saved(trie_edges(texts, at), "trie")
    left, turned = F.length("text") - F.col("pos"), lambda c: F.when(F.col("back"), F.reverse(c)).otherwise(F.col(c))
    hit = F.col("end").isNotNull() & (F.col("edits") + left == 1) & (F.levenshtein("text", "end") == 1)
    walked, found, moved = [], [], None
    for level in range(len(at) - 1):
        frontier = _starts(texts, at, level)
        if moved is not None:
            frontier = frontier.unionByName(moved)
        walked.append(saved(step(frontier, edges.where(F.col("level") == level).drop("level"), at[level + 1] - at[level]), "frontier"))
        found.append(walked[-1].where(hit).select(turned("text").alias("word"), "n", turned("end").alias("near"), F.col("end_n").alias("near_n")))
        moved = walked[-1].where(left > 0).drop("end", "end_n")
    one = found[0]
    for more in found[1:]:
        one = one.unionByName(more)
    pairs = saved(one.distinct(), "pairs")
    forget(edges, *walked)
    return pairs.unionByName(pairs.select(F.col("near").alias("word"), F.col("near_n").alias("n"), F.col("word").alias("near"), F.col("n").alias("near_n")))


# --- forms ----------------------------------------------------------------------------------------

def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of (word, form): the last word of the chain of forms, by doubling; a form is always more frequent, so chains end."""
    now = saved(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        after = saved(now.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        forget(now)
        now = after.drop("moved")
        now.written_at = after.written_at
        if after.where("moved").isEmpty():
            return now


def spelling_variants(docs: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, ratio: int = RATIO, slip: int | None = None,
                      text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(word, n, n_near, form, form_n, root) of every word of the vocabulary.

    Null and empty texts have no words; repeated rows count as often as they occur; an empty table
    gives an empty result; other columns are not read.  Of neighbours with the same count the
    smallest in code-point order is the form.
    """
    words = saved(vocabulary(docs, min_length, min_count, slip, text, id_col), "words")
    near = neighbours(words, min_length)
    best = near.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("b"))
    enough = -F.col("b.less") >= ratio * F.col("n")
    joined = saved(words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(enough, F.col("b.near")).alias("form"), F.when(enough, -F.col("b.less")).alias("form_n")), "variants")
    last = roots(joined.where("form is not null").select("word", "form"))
    return joined.join(last, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return spelling_variants(docs, slip=SLIP)


QUERIES = {"op11_spelling_variants": op11_spelling_variants}
ORACLES: dict[str, str] = {}
