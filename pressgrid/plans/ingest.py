"""Raw pages to curated articles."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import arrow, text as T
from ..functions.vectors import let
from ..operators.near_dup import greedy_dropped, similar_to_stored
from ..session import write_once


def clean_bodies(rows: DataFrame, column: str) -> DataFrame:
    return rows.withColumn(column, arrow.clean_news_body(column))


def blank_title_chunks(chunks: DataFrame) -> DataFrame:
    """Title-only chunks show no text.  The pattern's underscore is a wildcard, as in the stored statement."""
    return chunks.withColumn("chunk_text", F.when(F.col("chunk_id").like("%_title"), "").otherwise(F.col("chunk_text")))


def near_dup_in_store(articles: DataFrame, threshold: float = 0.8) -> DataFrame:
    """(article_id): stored rows to delete; newest first, later similar titles go."""
    order = [T.descending_text(F.coalesce("published_at", F.lit("")))]
    return greedy_dropped(articles, "article_id", F.coalesce("title", F.lit("")), order, threshold).withColumnRenamed("id", "article_id")


def near_dup_in_batch(articles: DataFrame, threshold: float = 0.7) -> DataFrame:
    """(article_id): batch rows to drop; longest body first."""
    order = [-F.char_length("content")]
    return greedy_dropped(articles, "article_id", F.coalesce("title", F.lit("")), order, threshold).withColumnRenamed("id", "article_id")


# ---- raw rows to curated articles ---------------------------------------------------------

def quality_filter(rows: DataFrame, min_chars: int = 100) -> DataFrame:
    return rows.where((F.char_length("content") >= min_chars) & ~F.contains(F.coalesce("reporter", F.lit("")), F.lit("?")))


def best_title_per_content(rows: DataFrame, id_col: str) -> DataFrame:
    """One row per identical body: the longest title.

    Bodies are grouped by digest with a max over (length, id), combined map-side, so neither the
    bodies nor a large group of copies are shuffled.
    """
    best = F.max_by(F.col(id_col), F.struct(F.char_length("title"), F.col(id_col))).alias(id_col)
    winners = rows.groupBy(F.sha2("content", 256).alias("_digest")).agg(best).select(id_col)
    return rows.join(winners, id_col, "left_semi")


def ingest_clean_dedupe(raw: DataFrame, stored: DataFrame, id_col: str = "article_id") -> DataFrame:
    """Curated rows: cleaned bodies, one row per body, no near-duplicate titles inside the batch
    (0.7, longest body wins) or against the stored titles (0.8), byline with its job title."""
    clean = raw.withColumn("content", arrow.clean_news_body("content")).where(F.char_length("content") >= 100)
    clean = clean.withColumn("title", T.clean_title(F.col("title")))
    clean = write_once(clean.withColumn("_chars", F.char_length("content")))
    # the bodies are written once; what follows decides over ids, titles and lengths
    rows = write_once(quality_filter(best_title_per_content(clean, id_col)).select(id_col, "title", "_chars"), "titles")
    order, title = [-F.col("_chars")], F.coalesce("title", F.lit(""))
    batch = greedy_dropped(rows, id_col, title, order, 0.7).withColumnRenamed("id", id_col)
    kept = write_once(rows.join(batch, id_col, "left_anti").select(id_col, "title"), "titles")
    known = similar_to_stored(kept, id_col, title, stored, F.coalesce("title", F.lit("")), 0.8).withColumnRenamed("id", id_col)
    new = kept.select(id_col).join(known, id_col, "left_anti")
    return quality_filter(clean).drop("_chars").join(new, id_col, "left_semi").withColumn("reporter", T.reporter_suffix(F.col("reporter")))


def chunk_documents(articles: DataFrame, text: str = "full_text") -> DataFrame:
    """(chunk_id, article_id, chunk_text, context_text): chunks '<id>_<n>' plus one empty title chunk per article.

    Bodies under ten characters are skipped.
    """
    rows = articles.where(F.char_length(F.trim(F.col(text))) >= 10)
    prefix = lambda c: T.contextual_prefix(F.coalesce("title", F.lit("")), F.coalesce("source", F.lit("미상")), F.coalesce("category", F.lit("일반")), c)
    body = rows.select("article_id", "title", "source", "category", F.posexplode(arrow.chunk_array(text)).alias("n", "chunk_text"))
    body = body.select(F.concat_ws("_", "article_id", "n").alias("chunk_id"), "article_id", "chunk_text", prefix(F.col("chunk_text")).alias("context_text"))
    return body.unionByName(title_chunks(rows))


def title_chunks(articles: DataFrame) -> DataFrame:
    return articles.select(F.concat("article_id", F.lit("_title")).alias("chunk_id"), "article_id", F.lit("").alias("chunk_text"),
                           F.concat(F.lit("[제목] "), F.coalesce("title", F.lit(""))).alias("context_text"))


def extractive_highlights(articles: DataFrame, min_chars: int = 300) -> DataFrame:
    """(article_id, place, sentence): sentences that share most words with the summary.

    Everything happens inside the row, so nothing is exploded or shuffled until the result.
    """
    rows = articles.where((F.char_length("full_text") >= min_chars) & (F.coalesce("summary_text", F.lit("")) != ""))
    rows = rows.select("article_id", F.char_length("full_text").alias("len"), T.split_sentences(F.col("full_text")).alias("s"),
                       T.summary_words(F.col("summary_text")).alias("kw")).where(F.size("kw") > 0)

    def score(sentence, i):
        def counted(words):
            hits = F.size(F.filter(words, lambda w: F.array_contains("kw", w)))
            return F.struct(hits.alias("hits"), F.size(words).alias("all"))
        return let(let(T.highlight_words(sentence), counted), lambda c: F.struct(
            (-c["hits"]).alias("h"), (-F.round(F.when(c["all"] > 0, c["hits"] / c["all"]).otherwise(0.0), 9)).alias("d"),
            i.alias("i"), sentence.alias("t")))

    n = F.least(F.lit(6), F.greatest(F.lit(1), F.ceil(F.col("len") / 600))).cast("int")
    top = F.slice(F.array_sort(F.filter(F.transform("s", score), lambda x: x["h"] <= -2)), F.lit(1), n)
    return rows.select("article_id", F.posexplode(top).alias("p", "x")).select(
        "article_id", (F.col("p") + 1).alias("place"), F.col("x.t").alias("sentence"), (-F.col("x.h")).alias("matches"))


# ---- evaluation sets ------------------------------------------------------------------------

def eval_sample_filter(rows: DataFrame, min_len: int = 300, min_sim: float = 0.3) -> DataFrame:
    return rows.where((F.char_length("text") >= min_len) & (F.col("sim").isNull() | (F.col("sim") >= min_sim)))


def stratified_sample(rows: DataFrame, group: str, per_group: int, id_col: str, seed: str = "42") -> DataFrame:
    """Up to ``per_group`` rows per group in a repeatable hash order."""
    order = F.sha2(F.concat(F.lit(seed), F.lit("|"), F.col(id_col)), 256)
    w = W.partitionBy(group).orderBy(order, F.col(id_col))
    return rows.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= per_group).drop("_n")


def build_eval_set(rows: DataFrame, per_class: int = 20, min_len: int = 300, min_sim: float = 0.3, seed: str = "42") -> DataFrame:
    """Filtered, grouped by label, sampled and put in a repeatable random order."""
    picked = stratified_sample(eval_sample_filter(rows, min_len, min_sim).withColumn("label_group", T.label_group(F.col("label"))),
                               "label_group", per_class, "id", seed)
    order = F.sha2(F.concat(F.lit(seed), F.lit("#"), F.col("id")), 256)
    source = F.when(F.col("source") != "", F.col("source")).alias("source")
    return picked.select("id", "text", source, "label", "label_group").orderBy(order, "id")


def label_distribution(rows: DataFrame) -> DataFrame:
    return rows.groupBy(T.label_group(F.col("label")).alias("label_group")).agg(F.count("*").alias("n"))
