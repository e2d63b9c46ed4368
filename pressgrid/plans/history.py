"""Reading histories and impressions."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from .. import constants as K
from ..functions import payload as P


def positive_events(events: DataFrame, feedback: DataFrame) -> DataFrame:
    """Positive log events and likes as (session_id, user_id, article_id, created_at, event_key)."""
    seen = (events.where(F.col("article_id").isNotNull() & F.col("event_type").isin(K.POSITIVE_EVENTS))
            .select("session_id", "user_id", "article_id", "created_at", F.concat(F.lit("e"), "log_id").alias("event_key")))
    liked = (feedback.where("feedback_type = 'like'")
             .select(F.lit(None).cast("string").alias("session_id"), "user_id", "article_id", "created_at",
                     F.concat(F.lit("f"), "feedback_id").alias("event_key")))
    return seen.unionByName(liked)


def recent_history(events: DataFrame, feedback: DataFrame, articles: DataFrame, scope: str, limit: int = K.HISTORY_SIZE,
                   strict: bool = True) -> DataFrame:
    """Latest positives per session or per user: (subject, article_id, category, created_at, pos), newest first.

    The limit applies before any de-duplication.  In session scope the log knows no likes of
    that session: ``strict`` leaves likes out; ``strict=False`` gives every session the latest
    likes of all users, as the original statement does (``limit`` rows at most, so bounded).
    """
    known = articles.select("article_id", "category")
    rows = positive_events(events, feedback).where(F.col(scope).isNotNull())
    if scope == "session_id" and not strict:
        likes = (positive_events(events.limit(0), feedback).join(known.select("article_id"), "article_id", "left_semi")
                 .orderBy(F.col("created_at").desc(), "event_key").limit(limit))
        every = rows.select("session_id").distinct().withColumn("_o", F.lit(1))
        spread = every.join(F.broadcast(likes.drop("session_id").withColumn("_o", F.lit(1))), "_o").drop("_o")
        rows = rows.unionByName(spread.select(*rows.columns))
    rows = rows.join(known, "article_id").withColumnRenamed(scope, "subject")
    newest = W.partitionBy("subject").orderBy(F.col("created_at").desc(), F.col("event_key").asc())
    return (rows.withColumn("pos", F.row_number().over(newest)).where(F.col("pos") <= limit)
            .select("subject", "article_id", "category", "created_at", "pos"))


def impression_negatives(events: DataFrame, user_id: str | None = None, session_id: str | None = None,
                         limit: int = 20) -> DataFrame:
    """Latest shown items never clicked in the same scope; a missing scope value means no filter."""
    if user_id is not None:
        events = events.where(F.col("user_id") == user_id)
    if session_id is not None:
        events = events.where(F.col("session_id") == session_id)
    clicked = events.where(F.col("article_id").isNotNull() & F.col("event_type").isin(K.CLICKED_EVENTS)).select("article_id").distinct()
    shown = (events.where("event_type = 'impression'")
             .select("log_id", "created_at", F.inline(P.impression_items(F.col("event_data"))))
             .where("article_id is not null"))
    return (shown.join(clicked, "article_id", "left_anti")
            .orderBy(F.col("created_at").desc(), "log_id", "position").limit(limit)
            .select("article_id", "created_at", "log_id", "position"))
