"""Line deduplication by site-relative frequency.

For every site, a line's ratio is the number of the site's pages that hold it by the number of the
site's pages.  Pages of a site with the same text count once, in both numbers, so that copies of a page
do not turn its text into boilerplate.  Lines with a ratio above ``max_ratio`` are dropped from every page
of the site.  In small sites, where one chance repeat is a large share, the ratio has to be higher: at least
``min_pages`` pages must hold a line, or all pages of a site that has fewer (two at least).

Lines are compared without surrounding blanks and by their MD5; blank lines are never dropped.  Only
digests are shuffled; they are made distinct for each page first, so a hot site or line is spread over its
pages and then added up from partial counts.  A site has at most (lines of an average page) / max_ratio
lines to drop, so its list is bounded.  The lists are written and measured: up to ``BROADCAST_BYTES`` they
go to every executor and no text is shuffled; above, texts are joined by site, and a site's texts
are dealt to as many parts as its pages ask for.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .arrays import saved, tidy

MAX_RATIO = 0.05
MIN_PAGES = 5
#: Lists of all sites up to this size are broadcast.
BROADCAST_BYTES = 64_000_000
#: Pages of a site that one part of the join by site takes.
PART_PAGES = 20_000


def _key(line: Column) -> Column:
    return F.unhex(F.md5(F.trim(line)))


def boilerplate(docs: DataFrame, max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """(site, drop): digests of the lines to drop from each site; docs: (site, text)."""
    pages = docs.where("text is not null").select("site", F.md5("text").alias("page"), F.split("text", "\n").alias("lines"))
    total = pages.select("site", "page").distinct().groupBy("site").agg(F.count("*").alias("pages"))
    keys = F.array_distinct(F.transform(F.filter("lines", lambda x: F.trim(x) != ""), _key))
    held = pages.select("site", "page", F.explode(keys).alias("line")).distinct().groupBy("site", "line").agg(F.count("*").alias("held")).where("held >= 2")
    common = held.join(total, held["site"].eqNullSafe(total["site"])).where(
        (F.col("held") > F.col("pages") * max_ratio) & (F.col("held") >= F.least("pages", F.lit(min_pages))))
    return common.groupBy(held["site"]).agg(F.collect_list("line").alias("drop"))


def _with_lists(inner: DataFrame, drops: DataFrame, site: str, broadcast_bytes: int, part_pages: int) -> DataFrame:
    """inner with the list of its site, null where there is none."""
    lists = drops.select(F.col("site").alias("_site"), "drop")
    size = drops.agg(F.sum(16 * F.size("drop") + F.coalesce(F.length("site"), F.lit(0)) + 64).alias("n")).first()["n"] or 0
    if size <= broadcast_bytes:
        return inner.join(F.broadcast(lists), inner[site].eqNullSafe(lists["_site"]), "left")
    # sites of several parts: at most one for part_pages rows of the input
    parts = inner.groupBy(F.col(site).alias("_large")).agg(F.ceil(F.count("*") / part_pages).cast("int").alias("_parts")).where("_parts > 1")
    parts = saved(parts, "site_parts")
    dealt = lists.join(F.broadcast(parts), F.col("_site").eqNullSafe(F.col("_large")), "left").select(
        "_site", "drop", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1)).alias("_list_part"))
    # parts go by the row's place, so the copies of one page are spread as well
    salted = inner.join(F.broadcast(parts), F.col(site).eqNullSafe(F.col("_large")), "left").withColumn(
        "_part", F.pmod(F.monotonically_increasing_id(), F.coalesce("_parts", F.lit(1))).cast("int"))
    return salted.join(dealt, F.col(site).eqNullSafe(F.col("_site")) & (F.col("_part") == F.col("_list_part")), "left")


def without_boilerplate(docs: DataFrame, max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES, site: str = "source", text: str = "text",
                        broadcast_bytes: int = BROADCAST_BYTES, part_pages: int = PART_PAGES) -> DataFrame:
    """Documents with their text without boilerplate lines, and ``n_lines``, ``n_dropped`` (a column of that name gives way).

    The other lines stay as they are, in order.  A null text stays null with no lines; a null site is a
    site of its own.  Repeated rows get the same result.  A site with a single different page keeps all.
    """
    docs = tidy(docs)
    own = [c for c in docs.columns if c.lower() not in ("n_lines", "n_dropped")]
    inner = docs.select(*[F.col(f"`{c}`").alias(f"in_{c}") for c in own])
    drops = saved(boilerplate(docs.select(F.col(f"`{site}`").alias("site"), F.col(f"`{text}`").alias("text")), max_ratio, min_pages), "boilerplate")
    joined = _with_lists(inner, drops, f"in_{site}", broadcast_bytes, part_pages)
    lines = F.split(f"in_{text}", "\n")
    left = F.when(F.col("drop").isNull(), lines).otherwise(F.filter(lines, lambda x: (F.trim(x) == "") | ~F.array_contains("drop", _key(x))))
    done = joined.withColumns({"_lines": F.size(lines).cast("long"), "_left": left})
    return done.select(*[(F.array_join("_left", "\n") if c == text else F.col(f"in_{c}")).alias(c) for c in own],
                       F.when(F.col(f"in_{text}").isNull(), 0).otherwise(F.col("_lines")).cast("long").alias("n_lines"),
                       F.when(F.col(f"in_{text}").isNull(), 0).otherwise(F.col("_lines") - F.size("_left")).cast("long").alias("n_dropped"))


def op6_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    out = without_boilerplate(docs)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("text_sha256"))


SQL = f"""
WITH l AS (SELECT doc_id, source, md5(text) AS page, string_split(text, chr(10)) AS w FROM documents WHERE text IS NOT NULL),
e AS (SELECT doc_id, source, page, unnest(w) AS line, unnest(range(1, len(w) + 1)) AS p FROM l),
t AS (SELECT source, count(DISTINCT page) AS pages FROM l GROUP BY source),
h AS (SELECT source, trim(line, ' ') AS k, count(DISTINCT page) AS held FROM e WHERE trim(line, ' ') <> '' GROUP BY ALL),
b AS (SELECT h.source, k FROM h JOIN t ON h.source IS NOT DISTINCT FROM t.source WHERE held >= 2 AND held >= least(pages, {MIN_PAGES}) AND held > pages * {MAX_RATIO}::DOUBLE),
k AS (SELECT doc_id, count(*) AS n, string_agg(line, chr(10) ORDER BY p) AS s
      FROM e WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.source IS NOT DISTINCT FROM e.source AND b.k = trim(e.line, ' ')) GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(len(w), 0) AS BIGINT) AS n_lines, CAST(coalesce(len(w), 0) - coalesce(n, 0) AS BIGINT) AS n_dropped,
       CASE WHEN d.text IS NULL THEN NULL ELSE sha256(coalesce(s, '')) END AS text_sha256
FROM documents d LEFT JOIN l USING (doc_id) LEFT JOIN k USING (doc_id)"""

QUERIES = {"op6_line_frequency": op6_line_frequency}
ORACLES = {"op6_line_frequency": SQL}
