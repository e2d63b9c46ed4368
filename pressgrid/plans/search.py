"""Semantic, lexical and hybrid search for a table of queries."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from .. import constants as K
from ..functions import text as T
from ..operators.postings import Postings, raw_idf
from ..operators.vector_index import VectorIndex, create
from ..operators.vector_rank import chunk_units
from ..operators.vector_topk import cosine_topk
from ..session import new_path, write_once


def _best_chunks(hits: DataFrame, chunks: DataFrame, limit: int) -> DataFrame:
    """Best chunk per (query, article), then the top ``limit`` articles per query."""
    rows = hits.join(chunks.select(F.col("chunk_id").alias("cid"), "article_id"), "cid")
    per_article = W.partitionBy("qid", "article_id").orderBy(F.col("score").desc(), "cid")
    best = rows.withColumn("_n", F.row_number().over(per_article)).where("_n = 1")
    per_query = W.partitionBy("qid").orderBy(F.col("score").desc(), "article_id")
    return (best.withColumn("rank", F.row_number().over(per_query)).where(F.col("rank") <= limit)
            .select(F.col("qid").alias("query_id"), "article_id", F.col("cid").alias("chunk_id"), "score", "rank"))


def known_chunks(chunks: DataFrame, articles: DataFrame) -> DataFrame:
    """Index rows of the chunks of known articles; the chunks of an article are one unit."""
    return chunk_units(chunks.join(articles.select("article_id"), "article_id", "left_semi"))


def semantic_search(queries: DataFrame, chunks: DataFrame, articles: DataFrame, limit: int = 10,
                    min_score: float = K.SEMANTIC_MIN_SCORE, overfetch: int = K.OVERFETCH, index: VectorIndex | None = None, unique: bool = False) -> DataFrame:
    """(query_id, article_id, chunk_id, score, rank) from ``queries`` (query_id, query_vector).

    Chunks of unknown articles never match.  The top limit x overfetch chunks are de-duplicated
    per article, so fewer than ``limit`` articles can come back.  ``index``: a saved index of known_chunks().
    ``unique``: no query_id repeats.
    """
    asked = queries.select(F.col("query_id").alias("qid"), F.col("query_vector").alias("qvec"))
    return _articles_of(asked, chunks, articles, limit, min_score, overfetch, index, unique).withColumnRenamed("qid", "query_id")


def _articles_of(asked: DataFrame, chunks: DataFrame, articles: DataFrame, limit: int, min_score: float, overfetch: int, index: VectorIndex | None, unique: bool) -> DataFrame:
    """(qid, article_id, chunk_id, score, rank); where the index is sent to the queries, only these rows leave a task."""
    index = index or create(known_chunks(chunks, articles), new_path(asked.sparkSession, "index"))
    best = index.best_units(asked, limit * overfetch, limit, min_score) if unique else None
    if best is not None:
        return best.select("qid", F.col("unit").alias("article_id"), F.col("cid").alias("chunk_id"), "score", "rank")
    return _best_chunks(cosine_topk(asked, index, limit * overfetch, min_score), chunks, limit).withColumnRenamed("query_id", "qid")


def related_articles(vectors: DataFrame, chunks: DataFrame, articles: DataFrame, limit: int = 5,
                     min_score: float = K.RELATED_MIN_SCORE, index: VectorIndex | None = None) -> DataFrame:
    """Related articles of every article that has a vector; its own chunks never count."""
    if not 1 <= limit <= 20:
        raise ValueError("limit must be between 1 and 20")
    asked = vectors.select(F.col("article_id").alias("qid"), F.col("embedding").alias("qvec"), F.col("article_id").alias("qkey"))
    unique = vectors.groupBy("article_id").count().where("count > 1").isEmpty()
    return _articles_of(asked, chunks, articles, limit, min_score, K.OVERFETCH, index, unique).withColumnRenamed("qid", "for_article_id")


def learned_rows(learned: DataFrame) -> DataFrame:
    return learned.select(F.col("article_id").alias("cid"), F.col("learned_embedding").alias("cvec"))


def learned_topk(queries: DataFrame, learned: DataFrame, limit: int, index: VectorIndex | None = None) -> DataFrame:
    """Top articles in the learned space, no floor.  ``queries``: (query_id, query_vector)."""
    hits = cosine_topk(queries.select(F.col("query_id").alias("qid"), F.col("query_vector").alias("qvec")), index or learned_rows(learned), limit)
    return hits.select(F.col("qid").alias("query_id"), F.col("cid").alias("article_id"), "score", "rank")


#: Terms of a query whose posting lists are met before the others are looked up.
FIRST_TERMS = 3


# ---- BM25 ----------------------------------------------------------------------------

def bm25_corpus_stats(index: Postings) -> tuple[DataFrame, DataFrame]:
    """(term, df, idf) and the one-row corpus stats (docs, avgdl, mean_idf), from the index's counts; no posting is read.

    Negative idf values are replaced by a quarter of the mean idf; the mean runs over the
    whole vocabulary, negative values included.
    """
    raw = raw_idf(F.lit(index.docs), F.col("df"))
    terms = index.counts().select("term", "df", F.when(raw < 0, index.mean_idf * K.BM25_FLOOR).otherwise(raw).alias("idf"))
    return terms, index.spark.createDataFrame([(index.docs, index.avgdl, index.mean_idf)], "docs long, avgdl double, mean_idf double")


def bm25_search(queries: DataFrame, index: Postings, limit: int = 10) -> DataFrame:
    """(query_id, article_id, bm25_score, rank): documents with every query term, relative to the best one.

    Only the buckets of asked terms are read, and what the terms weigh comes from the index's counts.  Candidates hold each
    of a query's FIRST_TERMS rarest terms; the other terms are then looked up among the postings of the candidates
    only, so a common word never pulls its whole posting list through a shuffle.
    """
    docs, avgdl, mean = index.docs, index.avgdl, index.mean_idf
    asked = write_once(queries.select("query_id", F.explode(T.tokenize_ko(F.col("query"))).alias("term"))
                       .groupBy("query_id", "term").agg(F.count("*").alias("times")), "asked")
    raw = raw_idf(F.lit(docs), F.col("df"))
    terms = index.counts().join(asked.select("term").distinct(), "term", "left_semi").withColumn("idf", F.when(raw < 0, mean * K.BM25_FLOOR).otherwise(raw))
    weighted = write_once(asked.join(terms, "term", "left"), "terms")
    plan = weighted.groupBy("query_id").agg(F.count("*").alias("n_terms"), F.max(F.col("df").isNull().cast("int")).alias("unknown")).where("unknown = 0")
    order = W.partitionBy("query_id").orderBy("df", "term")
    first = write_once(weighted.join(plan.drop("unknown"), "query_id").withColumn("_n", F.row_number().over(order))
                       .where(F.col("_n") <= FIRST_TERMS).select("query_id", "n_terms", "term"), "first")
    cand = write_once(first.join(index.postings(first).select("term", "article_id"), "term").groupBy("query_id", "article_id")
                      .agg(F.count("*").alias("hit"), F.first("n_terms").alias("n_terms"))
                      .where(F.col("hit") == F.least("n_terms", F.lit(FIRST_TERMS))).drop("hit"), "candidates")
    mine = (index.postings(weighted.join(cand.select("query_id").distinct(), "query_id", "left_semi"))
            .join(cand.select("article_id").distinct(), "article_id", "left_semi"))
    part = cand.join(weighted.select("query_id", "term", "times", "idf"), "query_id").join(mine, ["article_id", "term"])
    tf, k1, b = F.col("tf"), K.BM25_K1, K.BM25_B
    gain = F.col("times") * F.col("idf") * (tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("dl") / F.lit(avgdl))))
    full = (part.groupBy("query_id", "article_id").agg(F.sum(gain).alias("raw"), F.count("*").alias("hit"), F.first("n_terms").alias("n_terms"))
            .where("hit = n_terms"))
    best = F.max("raw").over(W.partitionBy("query_id"))
    scaled = full.withColumn("best", best).select("query_id", "article_id", F.round(
        F.when(F.col("best") > 0, F.col("raw") / F.col("best")).otherwise(F.col("raw")), 9).alias("bm25_score"))
    w = W.partitionBy("query_id").orderBy(F.col("bm25_score").desc(), "article_id")
    return (scaled.where(F.col("bm25_score") >= K.BM25_MIN_SCORE).withColumn("rank", F.row_number().over(w))
            .where(F.col("rank") <= limit))


# ---- fusion --------------------------------------------------------------------------

def rrf_fusion(semantic: DataFrame, lexical: DataFrame, limit: int, rrf_k: int = K.RRF_K) -> DataFrame:
    """Reciprocal-rank fusion of two ranked lists per query; the score is relative to the best row."""
    s = semantic.select("query_id", "article_id", F.col("score").alias("semantic_score"), F.col("rank").alias("s_rank"))
    l = lexical.select("query_id", "article_id", "bm25_score", F.col("rank").alias("l_rank"))
    both = s.join(l, ["query_id", "article_id"], "full_outer")
    part = lambda c: F.coalesce(1.0 / (rrf_k + F.col(c)), F.lit(0.0))
    fused = both.select("query_id", "article_id", F.coalesce("semantic_score", F.lit(0.0)).alias("semantic_score"),
                        F.coalesce("bm25_score", F.lit(0.0)).alias("bm25_score"), (part("s_rank") + part("l_rank")).alias("rrf_score"))
    w = W.partitionBy("query_id").orderBy(F.col("rrf_score").desc(), "article_id")
    top = fused.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)
    # at most ``limit`` rows per query are left here
    best = F.max("rrf_score").over(W.partitionBy("query_id"))
    return top.withColumn("score", F.col("rrf_score") / best)


def hybrid_search(queries: DataFrame, chunks: DataFrame, articles: DataFrame, postings: Postings, limit: int = 10,
                  min_semantic_score: float = K.SEMANTIC_MIN_SCORE, index: VectorIndex | None = None) -> DataFrame:
    semantic = semantic_search(queries, chunks, articles, limit * 2, min_semantic_score, index=index)
    return rrf_fusion(semantic, bm25_search(queries, postings, limit * 2), limit)


def result_gate(results: DataFrame) -> DataFrame:
    """A fused score alone is not enough: one of the two absolute scores must be good as well."""
    return results.where((F.col("score") >= K.GATE_SCORE)
                         & ((F.col("semantic_score") >= K.GATE_SEMANTIC) | (F.col("bm25_score") >= K.GATE_BM25)))


def page(results: DataFrame, number: int, size: int = 9) -> DataFrame:
    """One page per query of an already ranked result."""
    return results.where(F.col("rank").between((number - 1) * size + 1, number * size))


def best_candidate_match(rows: DataFrame, candidates: DataFrame, min_score: float = 0.10, outlet_bonus: float = 0.2) -> DataFrame:
    """The candidate title closest to each query, with a bonus for the outlet; weak matches are dropped.

    ``rows``: (id, search_query, outlet); ``candidates``: (id, pos, title, url).  An aggregate
    with a max over structs; ties go to the first candidate.
    """
    j = rows.select("id", "search_query", "outlet").join(candidates, "id")
    named = (F.col("outlet") != "") & F.contains(F.concat(F.coalesce("title", F.lit("")), F.coalesce("url", F.lit(""))), F.col("outlet"))
    score = T.jaccard_alnum(F.col("search_query"), F.col("title")) + F.when(named, outlet_bonus).otherwise(0.0)
    best = j.groupBy("id").agg(F.max(F.struct(F.round(score, 9).alias("score"), (-F.col("pos")).alias("neg_pos"), "title", "url")).alias("b"))
    return best.select("id", F.col("b.title").alias("title"), F.col("b.url").alias("url"), F.col("b.score").alias("sim")).where(
        F.col("sim") >= min_score)
