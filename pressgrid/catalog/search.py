"""Queries: search and similarity."""
from __future__ import annotations

from pyspark.sql import functions as F

from .. import constants as K
from ..operators import near_dup as N
from ..operators.postings import create_postings
from ..operators.vector_index import kept, kept_index
from ..operators.vector_rank import chunk_units
from ..operators.vector_topk import cosine_topk
from ..plans import search as S
from ..sources import views as V
from .oracle_views import greedy_sql
from .registry import query
from .texts import ALNUM, CLASSIFIED, KO, WORDS, fact_check_rows, jac

COS = "round(list_cosine_similarity({0}, {1}), 9)"


def semantic_sql(limit: int, min_score: float) -> dict[str, str]:
    return {
        "sem_hits": f"""SELECT * FROM (SELECT query_id, c.chunk_id, c.article_id, {COS.format('query_vector', 'embedding')} AS score,
          row_number() OVER (PARTITION BY query_id ORDER BY {COS.format('query_vector', 'embedding')} DESC, c.chunk_id) AS n
          FROM search_queries q, chunks c WHERE c.article_id IN (SELECT article_id FROM articles) AND {COS.format('query_vector', 'embedding')} >= {min_score}) WHERE n <= {limit * 5}""",
        "sem": f"""SELECT query_id, article_id, chunk_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, article_id) AS rank FROM (
          SELECT *, row_number() OVER (PARTITION BY query_id, article_id ORDER BY score DESC, chunk_id) AS best FROM sem_hits) WHERE best = 1) WHERE rank <= {limit}"""}


def bm25_sql(limit: int) -> dict[str, str]:
    return {
        "toks": f"SELECT article_id, {KO.format('body')} AS t FROM (SELECT article_id, coalesce(title, '') || ' ' || coalesce(full_text, '') AS body FROM articles)",
        "posts": "SELECT article_id, term, count(*) AS tf, any_value(dl) AS dl FROM (SELECT article_id, unnest(t) AS term, len(t) AS dl FROM toks) GROUP BY article_id, term",
        "corpus": "SELECT count(*) AS docs, avg(len(t)) AS avgdl FROM toks",
        "rawidf": "SELECT term, df, ln(docs - df + 0.5) - ln(df + 0.5) AS r FROM (SELECT term, count(*) AS df FROM posts GROUP BY term), corpus",
        "idfs": "SELECT term, df, CASE WHEN r < 0 THEN (SELECT avg(r) FROM rawidf) * 0.25 ELSE r END AS idf FROM rawidf",
        "qterms": f"SELECT query_id, term, count(*) AS times FROM (SELECT query_id, unnest({KO.format('query')}) AS term FROM search_queries) GROUP BY 1, 2",
        "qfull": """SELECT query_id, article_id, sum(times * idf * (tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * dl / avgdl)))) AS raw FROM qterms q JOIN posts p ON q.term = p.term JOIN idfs i ON i.term = q.term, corpus
          GROUP BY 1, 2 HAVING count(*) = (SELECT count(*) FROM qterms z WHERE z.query_id = q.query_id)""",
        "lex": f"""SELECT query_id, article_id, bm25_score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY bm25_score DESC, article_id) AS rank FROM (
          SELECT query_id, article_id, round(CASE WHEN max(raw) OVER (PARTITION BY query_id) > 0 THEN raw / max(raw) OVER (PARTITION BY query_id) ELSE raw END, 9) AS bm25_score FROM qfull)
          WHERE bm25_score >= 0.3) WHERE rank <= {limit}"""}


HYBRID = {**semantic_sql(20, 0.5), **bm25_sql(20),
    "fused": """SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf_score DESC, article_id) AS rank FROM (
      SELECT coalesce(s.query_id, l.query_id) AS query_id, coalesce(s.article_id, l.article_id) AS article_id, coalesce(s.score, 0) AS semantic_score, coalesce(bm25_score, 0) AS bm25_score,
      coalesce(1 / CAST(60 + s.rank AS DOUBLE), 0) + coalesce(1 / CAST(60 + l.rank AS DOUBLE), 0) AS rrf_score FROM sem s FULL JOIN lex l ON s.query_id = l.query_id AND s.article_id = l.article_id)""",
    "hybrid": "SELECT *, rrf_score / max(rrf_score) OVER (PARTITION BY query_id) AS score FROM fused WHERE rank <= 10"}
_R6 = "round({0}, 6) AS {0}"
HCOLS = "query_id, article_id, rank, semantic_score, bm25_score, " + ", ".join(_R6.format(c) for c in ("rrf_score", "score"))


def r6(df, *cols):
    return df.withColumns({c: F.round(c, 6) for c in cols})


def chunk_index(spark, d):
    """The session's index of the chunks of known articles."""
    return kept_index(spark, "chunks", [f"{d}/documents.parquet", f"{d}/embeddings.parquet"], lambda: S.known_chunks(V.chunks(spark, d), V.articles(spark, d)))


def learned_index(spark, d):
    return kept_index(spark, "learned", [f"{d}/embeddings.parquet"], lambda: S.learned_rows(V.learned_vectors(spark, d)))


def postings(spark, d):
    """The session's inverted index of all articles."""
    return kept(spark, "postings", [f"{d}/documents.parquet"], lambda path: create_postings(V.articles(spark, d), path))


def semantic(spark, d, *args):
    return S.semantic_search(V.search_queries(spark, d), V.chunks(spark, d), V.articles(spark, d), *args, index=chunk_index(spark, d))


def hybrid(spark, d):
    a = V.articles(spark, d)
    return S.hybrid_search(V.search_queries(spark, d), V.chunks(spark, d), a, postings(spark, d), index=chunk_index(spark, d))


def hybrid_out(df):
    return r6(df, "rrf_score", "score").select(
        "query_id", "article_id", "rank", "semantic_score", "bm25_score", "rrf_score", "score")


@query("semantic_search", "SELECT query_id, article_id, chunk_id, score, rank FROM sem", semantic_sql(10, 0.5))
def _(spark, d):
    return semantic(spark, d)


def all_chunks_index(spark, d):
    """The session's index of all chunks, those of unknown articles too."""
    return kept_index(spark, "all_chunks", [f"{d}/documents.parquet", f"{d}/embeddings.parquet"], lambda: chunk_units(V.chunks(spark, d)))


@query("min_similarity_filter", f"SELECT query_id, chunk_id, s AS score FROM (SELECT query_id, chunk_id, {COS.format('query_vector', 'embedding')} AS s FROM search_queries, chunks WHERE query_vector IS NOT NULL) WHERE s >= 0.7")
def _(spark, d):
    q = V.search_queries(spark, d).select(F.col("query_id").alias("qid"), F.col("query_vector").alias("qvec"))
    return all_chunks_index(spark, d).within(q, 0.7).select(F.col("qid").alias("query_id"), F.col("cid").alias("chunk_id"), "score")


@query("chunk_article_join", "SELECT s.query_id, s.article_id, a.title, a.source, a.published_at, coalesce(a.trust_score, 0) AS trust_score FROM sem s JOIN articles a ON s.article_id = a.article_id", semantic_sql(10, 0.5))
def _(spark, d):
    a = V.articles(spark, d)
    top = semantic(spark, d)
    shown = a.select("article_id", "title", "source", "published_at", F.coalesce("trust_score", F.lit(0)).alias("trust_score"))
    return top.select("query_id", "article_id").join(shown, "article_id")


@query("best_chunk_per_article", "SELECT query_id, article_id, chunk_id, rank FROM sem", semantic_sql(10, 0.6))
def _(spark, d):
    s = semantic(spark, d, 10, 0.6)
    return s.select("query_id", "article_id", "chunk_id", "rank")


@query("bm25_corpus_stats", "SELECT term, df, round(idf, 6) AS idf FROM idfs", bm25_sql(10))
def _(spark, d):
    return r6(S.bm25_corpus_stats(postings(spark, d))[0], "idf")


@query("bm25_search", "SELECT query_id, article_id, bm25_score, rank FROM lex", bm25_sql(10))
def _(spark, d):
    return S.bm25_search(V.search_queries(spark, d), postings(spark, d))


@query("rrf_rank", "SELECT query_id, article_id, 's' AS list, rank FROM sem UNION ALL SELECT query_id, article_id, 'l', rank FROM lex", {**semantic_sql(20, 0.5), **bm25_sql(20)})
def _(spark, d):
    a, q = V.articles(spark, d), V.search_queries(spark, d)
    s = semantic(spark, d, 20).select("query_id", "article_id", F.lit("s").alias("list"), "rank")
    l = S.bm25_search(q, postings(spark, d), 20).select("query_id", "article_id", F.lit("l").alias("list"), "rank")
    return s.unionByName(l)


@query("rrf_outer_fusion", f"SELECT query_id, article_id, {_R6.format('rrf_score')} FROM fused WHERE rank <= 10", HYBRID)
def _(spark, d):
    return r6(hybrid(spark, d), "rrf_score").select("query_id", "article_id", "rrf_score")


@query("hybrid_search", f"SELECT {HCOLS} FROM hybrid", HYBRID)
def _(spark, d):
    return hybrid_out(hybrid(spark, d))


@query("search_api_query", f"SELECT {HCOLS} FROM hybrid WHERE score >= 0.6 AND (semantic_score >= 0.55 OR bm25_score >= 0.5)", HYBRID)
def _(spark, d):
    return hybrid_out(S.result_gate(hybrid(spark, d)))


@query("search_result_gate", "SELECT query_id, count(*) AS n FROM hybrid WHERE score >= 0.6 AND (semantic_score >= 0.55 OR bm25_score >= 0.5) GROUP BY query_id", HYBRID)
def _(spark, d):
    return S.result_gate(hybrid(spark, d)).groupBy("query_id").agg(F.count("*").alias("n"))


@query("search_page", "SELECT query_id, article_id, rank FROM hybrid WHERE rank BETWEEN 10 AND 18", HYBRID)
def _(spark, d):
    return S.page(hybrid(spark, d), 2).select("query_id", "article_id", "rank")


def related_sql(limit: int, min_score: float) -> dict[str, str]:
    return {"rel_hits": f"""SELECT * FROM (SELECT v.article_id AS for_article_id, c.chunk_id, c.article_id, {COS.format('v.embedding', 'c.embedding')} AS score,
          row_number() OVER (PARTITION BY v.article_id ORDER BY {COS.format('v.embedding', 'c.embedding')} DESC, c.chunk_id) AS n
          FROM article_vectors v, chunks c WHERE v.article_id <> c.article_id AND c.article_id IN (SELECT article_id FROM articles) AND {COS.format('v.embedding', 'c.embedding')} >= {min_score}) WHERE n <= {limit * 5}""",
        "rel": f"""SELECT for_article_id, article_id, chunk_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY for_article_id ORDER BY score DESC, article_id) AS rank FROM (
          SELECT *, row_number() OVER (PARTITION BY for_article_id, article_id ORDER BY score DESC, chunk_id) AS best FROM rel_hits) WHERE best = 1) WHERE rank <= {limit}"""}


@query("related_articles", "SELECT for_article_id, article_id, chunk_id, score, rank FROM rel", related_sql(5, K.RELATED_MIN_SCORE))
def _(spark, d):
    return S.related_articles(V.article_vectors(spark, d), V.chunks(spark, d), V.articles(spark, d), index=chunk_index(spark, d))


@query("vector_topk", f"""SELECT query_id, chunk_id, score, rank FROM (SELECT query_id, chunk_id, {COS.format('query_vector', 'embedding')} AS score,
  row_number() OVER (PARTITION BY query_id ORDER BY {COS.format('query_vector', 'embedding')} DESC, chunk_id) AS rank FROM search_queries, chunks WHERE query_vector IS NOT NULL) WHERE rank <= 10""")
def _(spark, d):
    q = V.search_queries(spark, d).select(F.col("query_id").alias("qid"), F.col("query_vector").alias("qvec"))
    return cosine_topk(q, all_chunks_index(spark, d), 10).select(F.col("qid").alias("query_id"), F.col("cid").alias("chunk_id"), "score", "rank")


@query("vector_topk_join", f"""SELECT qid, cid, score, rank FROM (SELECT a.article_id AS qid, b.article_id AS cid, {COS.format('a.embedding', 'b.embedding')} AS score,
  row_number() OVER (PARTITION BY a.article_id ORDER BY {COS.format('a.embedding', 'b.embedding')} DESC, b.article_id) AS rank FROM article_vectors a, article_vectors b
  WHERE {COS.format('a.embedding', 'b.embedding')} >= 0.7) WHERE rank <= 3""")
def _(spark, d):
    v = V.article_vectors(spark, d)
    return cosine_topk(v.select(F.col("article_id").alias("qid"), F.col("embedding").alias("qvec")),
                       v.select(F.col("article_id").alias("cid"), F.col("embedding").alias("cvec")), 3, 0.7, pivot_count=16)


@query("learned_vector_topk", f"""SELECT query_id, article_id, score, rank FROM (SELECT query_id, article_id, {COS.format('query_vector', 'learned_embedding')} AS score,
  row_number() OVER (PARTITION BY query_id ORDER BY {COS.format('query_vector', 'learned_embedding')} DESC, article_id) AS rank FROM search_queries, learned_vectors WHERE query_vector IS NOT NULL) WHERE rank <= 10""")
def _(spark, d):
    return S.learned_topk(V.search_queries(spark, d), V.learned_vectors(spark, d), 10, learned_index(spark, d))


# ---- near duplicates -------------------------------------------------------------------

@query("near_duplicate_pairs_low_threshold", """SELECT a.f[2] AS earlier, b.f[2] AS later, round(len(list_intersect(a.toks, b.toks)) / CAST(len(list_distinct(list_concat(a.toks, b.toks))) AS DOUBLE), 6) AS similarity
  FROM wreps a JOIN wreps b ON a.f < b.f WHERE len(list_intersect(a.toks, b.toks)) / CAST(len(list_distinct(list_concat(a.toks, b.toks))) AS DOUBLE) >= 0.4""", {
    "wsets": f"SELECT article_id, published_at, list_sort({WORDS.format('title')}) AS toks FROM articles",
    "wreps": "SELECT min((published_at, article_id)) AS f, toks FROM wsets WHERE len(toks) > 0 GROUP BY toks"})
def _(spark, d):
    return r6(N.near_duplicate_pairs(V.articles(spark, d), "article_id", F.col("title"), [F.col("published_at")], 0.4), "similarity")



SETS = {"sets": f"SELECT article_id, published_at, list_sort({WORDS.format('title')}) AS toks FROM articles",
        "reps": "SELECT DISTINCT (published_at, article_id) AS f, toks FROM sets WHERE len(toks) > 0"}


@query("near_duplicate_pairs", """SELECT a.f[2] AS earlier, b.f[2] AS later, round(len(list_intersect(a.toks, b.toks)) / CAST(len(list_distinct(list_concat(a.toks, b.toks))) AS DOUBLE), 6) AS similarity
  FROM reps a JOIN reps b ON a.f < b.f WHERE len(list_intersect(a.toks, b.toks)) / CAST(len(list_distinct(list_concat(a.toks, b.toks))) AS DOUBLE) >= 0.7""", SETS)
def _(spark, d):
    return r6(N.all_pairs(V.articles(spark, d), "article_id", F.col("title"), [F.col("published_at")], 0.7), "similarity")


@query("greedy_near_dup_in_store", "SELECT id AS article_id FROM store_drop", greedy_sql("store", f"SELECT article_id AS id, dense_rank() OVER (ORDER BY coalesce(published_at, '') DESC) AS k, list_sort({WORDS.format('title')}) AS toks FROM articles", 0.8))
def _(spark, d):
    from ..plans import ingest as G
    return G.near_dup_in_store(V.articles(spark, d))


@query("greedy_near_dup_in_batch", "SELECT id AS article_id FROM batch_drop", greedy_sql("batch", f"SELECT article_id AS id, -length(full_text) AS k, list_sort({WORDS.format('title')}) AS toks FROM articles", 0.7))
def _(spark, d):
    from ..plans import ingest as G
    return G.near_dup_in_batch(V.articles(spark, d).withColumnRenamed("full_text", "content"))


@query("title_similarity_anti_join", f"""SELECT article_id FROM articles n WHERE lang <> 'en' AND NOT EXISTS (SELECT 1 FROM (SELECT DISTINCT {WORDS.format('title')} AS t FROM articles WHERE lang = 'en') o
  WHERE len(list_distinct(list_concat({WORDS.format('n.title')}, o.t))) > 0 AND len(list_intersect({WORDS.format('n.title')}, o.t)) / CAST(len(list_distinct(list_concat({WORDS.format('n.title')}, o.t))) AS DOUBLE) >= 0.8)""")
def _(spark, d):
    a = V.articles(spark, d)
    new, old = a.where("lang <> 'en'"), a.where("lang = 'en'")
    hit = N.similar_to_stored(new, "article_id", F.col("title"), old, F.col("title"), 0.8)
    return new.select("article_id").join(hit.withColumnRenamed("id", "article_id"), "article_id", "left_anti")


@query("best_candidate_match", f"""SELECT id, title, url, score AS sim FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, pos) AS n FROM (
  SELECT c.article_id AS id, p.pos, a.title, a.url, round({jac(ALNUM.format('c.search_query'), ALNUM.format('a.title')).replace(', 6)', ', 12)')} + CASE WHEN c.outlet <> '' AND contains(coalesce(a.title, '') || coalesce(a.url, ''), c.outlet) THEN CAST(0.2 AS DOUBLE) ELSE 0 END, 9) AS score
  FROM classified c, (SELECT unnest([0, 1, 2, 3, 4]) AS pos) p JOIN articles a ON CAST(a.article_id AS BIGINT) = CAST(c.article_id AS BIGINT) + p.pos)) WHERE n = 1 AND score >= 0.10""", {"classified": CLASSIFIED})
def _(spark, d):
    rows = fact_check_rows(spark, d).withColumnRenamed("article_id", "id")
    near = rows.select("id", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("pos")).withColumn("article_id", (F.col("id").cast("bigint") + F.col("pos")).cast("string"))
    cand = near.join(V.articles(spark, d).select("article_id", "title", "url"), "article_id").select("id", "pos", "title", "url")
    return S.best_candidate_match(rows, cand)
