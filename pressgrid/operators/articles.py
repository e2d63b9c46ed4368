"""Projections, filters and pages over the article table."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .. import constants as K
from ..functions import payload as P
from ..schemas import LIST_COLUMNS



def newest_first() -> list[Column]:
    """Newest by date text, article id as the last key so that pages never overlap."""
    return [F.col("published_at").desc(), F.col("article_id").asc()]


def list_page(articles: DataFrame, page: int, size: int, category: str | None = None) -> DataFrame:
    if category is not None:
        articles = articles.where(F.col("category") == category)
    return articles.select(*LIST_COLUMNS).orderBy(*newest_first()).offset((page - 1) * size).limit(size)


def by_id(articles: DataFrame, article_id: str) -> DataFrame:
    return articles.where(F.col("article_id") == article_id)


def trust_by_id(articles: DataFrame, article_id: str) -> DataFrame:
    text = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    return by_id(articles, article_id).select(
        "article_id", F.coalesce("trust_score", F.lit(0)).alias("trust_score"),
        text("trust_verdict"), text("trust_reason"), text("trust_per_criteria"))


def without_trust(articles: DataFrame, retry_failed: bool = False) -> DataFrame:
    """Rows never analysed (score 0).  Failed rows (null) only with ``retry_failed``."""
    never = F.col("trust_score") == 0
    return articles.where(never | F.col("trust_score").isNull() if retry_failed else never)


def needing_keywords(articles: DataFrame) -> DataFrame:
    return articles.where(P.needs_keywords(F.col("keywords")))


def for_stats(articles: DataFrame) -> DataFrame:
    return articles.select("article_id", "source", "category", "published_at", "trust_score")


def latest_excluding(articles: DataFrame, excluded: DataFrame, limit: int, categories: list[str] | None = None) -> DataFrame:
    """Newest articles whose id is not in ``excluded``; an empty category list gives no row."""
    if categories is not None:
        articles = articles.where(F.col("category").isin(categories) if categories else F.lit(False))
    kept = articles.select(*LIST_COLUMNS).join(excluded.select("article_id").distinct(), "article_id", "left_anti")
    return kept.orderBy(*newest_first()).limit(limit)


def has_listed_category(category: Column) -> Column:
    return category.isNotNull() & ~category.isin(K.UNSORTED_CATEGORIES)


def long_enough(text: Column, chars: int) -> Column:
    return F.char_length(F.trim(text)) >= chars


def inside_dates(date: Column, start: Column, end: Column) -> Column:
    """Unknown dates pass."""
    return date.isNull() | date.between(start, end)


def top_pick(first_page: DataFrame) -> DataFrame:
    """The most trusted article of the first page, ties by page order."""
    return first_page.orderBy(F.coalesce("trust_score", F.lit(0)).desc(), *newest_first()).limit(1)


def without_top_pick(rows: DataFrame, pick: DataFrame) -> DataFrame:
    return rows.join(pick.select("article_id"), "article_id", "left_anti")


def shuffle_sample(rows: DataFrame, size: int, seed: str) -> DataFrame:
    """Repeatable random rows: ordered by the hash of seed and id."""
    order = F.sha2(F.concat(F.lit(seed), F.lit("|"), F.col("article_id")), 256)
    return rows.orderBy(order, "article_id").limit(size)


def head_total(rows: DataFrame, total: int | None, order: list[Column]) -> DataFrame:
    """Cap an ingest at ``total`` rows; no cap when it is None."""
    return rows if total is None else rows.orderBy(*order).limit(total)
