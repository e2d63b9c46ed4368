"""A saved inverted index: postings in buckets of terms, changed articles as generations.

Folders: ``postings`` (term, article_id, tf, dl) and ``counts`` (term, df), both by generation and bucket of the term;
``gone`` (article_id), by generation, the articles whose earlier postings no longer hold; ``numbers-N``, one
row with the corpus numbers after generation N.  ``counts`` and the numbers are sums, so a generation adds what
it changes and nothing is counted again.  The numbers are written last: a generation without them was
never finished and is not read, and update() overwrites it.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import text as T
from ..session import write_once
from .vector_index import complete_folders

BUCKETS = 64
POSTINGS = "term string, article_id string, tf long, dl int, generation int, bucket int"
COUNTS = "term string, df long, generation int, bucket int"


def bucket_of(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def article_terms(articles: DataFrame) -> DataFrame:
    """(term, article_id, tf, dl) of title and body."""
    body = F.concat(F.coalesce("title", F.lit("")), F.lit(" "), F.coalesce("full_text", F.lit("")))
    words = articles.select("article_id", T.tokenize_ko(body).alias("toks")).select("article_id", F.size("toks").alias("dl"), F.explode("toks").alias("term"))
    return words.groupBy("term", "article_id").agg(F.count("*").alias("tf"), F.first("dl").alias("dl"))


def raw_idf(docs: Column, df: Column) -> Column:
    return F.log(docs - df + 0.5) - F.log(df + 0.5)


class Postings:
    """An index in a folder; see create_postings() and open_postings()."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.generation = max(int(n.split("-")[1]) for n in complete_folders(spark, path) if n.startswith("numbers-"))
        #: documents with a term, their length in all, mean idf of the vocabulary (negative values included)
        self.docs, self.length, mean = spark.read.parquet(f"{path}/numbers-{self.generation}").first()
        self.avgdl, self.mean_idf = (self.length / self.docs if self.docs else 0.0), mean or 0.0

    def _table(self, name: str, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}").where(F.col("generation") <= self.generation)

    def _live(self, postings: DataFrame) -> DataFrame:
        if not self.generation:
            return postings
        gone = self._table("gone", "article_id string, generation int").groupBy("article_id").agg(F.max("generation").alias("since"))
        return postings.join(gone, "article_id", "left").where("since is null or generation >= since").drop("since")

    def postings(self, terms: DataFrame | None = None) -> DataFrame:
        """(term, article_id, tf, dl) of the asked terms (all without terms); only their buckets are read."""
        found = self._table("postings", POSTINGS)
        if terms is not None:
            asked = terms.select("term").distinct().withColumn("bucket", bucket_of(F.col("term")))
            buckets = [r.bucket for r in asked.select("bucket").distinct().collect()]  # at most BUCKETS
            found = found.where(F.col("bucket").isin(buckets)).join(asked, ["bucket", "term"], "left_semi")
        return self._live(found).select("term", "article_id", "tf", "dl")

    def counts(self) -> DataFrame:
        """(term, df) of the vocabulary."""
        return self._table("counts", COUNTS).groupBy("term").agg(F.sum("df").alias("df")).where("df > 0")

    def _write(self, postings: DataFrame, counts: DataFrame, generation: int, docs: int, length: int) -> "Postings":
        put = lambda df, name: (df.withColumn("bucket", bucket_of(F.col("term"))).repartition("bucket").sortWithinPartitions("term")
                                .write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/{name}/generation={generation}"))
        put(postings.select("term", "article_id", "tf", "dl"), "postings")
        put(counts, "counts")
        self.generation = generation
        one = self.counts().agg(F.avg(raw_idf(F.lit(docs), F.col("df"))).alias("mean"))
        one.select(F.lit(docs).cast("long").alias("docs"), F.lit(length).cast("long").alias("length"), "mean").write.parquet(f"{self.path}/numbers-{generation}")
        return Postings(self.spark, self.path)

    def update(self, changed: DataFrame, deleted: DataFrame | None = None) -> "Postings":
        """The index after articles were added or changed, and others (article_id) deleted; equals one built anew."""
        generation = self.generation + 1
        ids = changed.select("article_id") if deleted is None else changed.select("article_id").unionByName(deleted.select("article_id"))
        ids = write_once(ids.distinct(), "changed")
        old = write_once(self.postings().join(ids, "article_id", "left_semi"), "old")
        new = write_once(article_terms(changed), "new")
        size = lambda t: t.groupBy("article_id").agg(F.first("dl").alias("dl")).agg(F.count("*"), F.coalesce(F.sum("dl"), F.lit(0))).first()
        (n_old, l_old), (n_new, l_new) = size(old), size(new)
        change = new.select("term", F.lit(1).alias("d")).unionByName(old.select("term", F.lit(-1).alias("d")))
        ids.write.mode("overwrite").parquet(f"{self.path}/gone/generation={generation}")
        return self._write(new, change.groupBy("term").agg(F.sum("d").alias("df")).where("df <> 0"), generation, self.docs - n_old + n_new, self.length - l_old + l_new)


def create_postings(articles: DataFrame, path: str) -> Postings:
    """An index of articles (article_id, title, full_text) in a new folder."""
    spark = articles.sparkSession
    new = write_once(article_terms(articles), "postings")
    docs, length = new.groupBy("article_id").agg(F.first("dl").alias("dl")).agg(F.count("*"), F.coalesce(F.sum("dl"), F.lit(0))).first()
    empty = Postings.__new__(Postings)
    empty.spark, empty.path, empty.generation = spark, path, 0
    return empty._write(new, new.groupBy("term").agg(F.count("*").alias("df")), 0, docs, length)


def open_postings(spark: SparkSession, path: str) -> Postings:
    return Postings(spark, path)


def compact(index: Postings, path: str) -> Postings:
    """The same index in a new folder, as one generation."""
    live = index.postings()
    out = Postings.__new__(Postings)
    out.spark, out.path, out.generation = index.spark, path, 0
    return out._write(live, index.counts(), 0, index.docs, index.length)
