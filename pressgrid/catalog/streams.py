"""Queries: streaming jobs, each drained over the whole event table."""
from __future__ import annotations

from pyspark.sql import functions as F

from .. import constants as K
from ..sources import views as V
from ..streaming import jobs as J, stateful as S
from .oracle_views import lst
from .registry import query
from .replay import POS


def log(spark, d):
    return V.as_event_log(J.read_events(spark, d, "events.parquet"))


ISO = "yyyy-MM-dd'T'HH:mm:ss.SSS"


@query("stream_event_log", """SELECT log_id, session_id, event_type, article_id, created_at,
  '{"api_key": "[REDACTED]", "nested": {"Token": "[REDACTED]", "n": [' || length(log_id) || ', "ok"]}, "payload": ' || replace(replace(replace(event_data, '},{', '}, {'), '":', '": '), ',"', ', "') || '}' AS event_data FROM event_log""")
def _(spark, d):
    out = J.run_append(J.event_log_sink(V.as_raw_events(log(spark, d))), "event-log")
    return out.select("log_id", "session_id", "event_type", "article_id", "created_at", "event_data")


CTX = "CASE WHEN k0 % 2 = 0 THEN 'personalized_recommendation' ELSE 'main' END"


@query("stream_impression_dedupe", f"SELECT DISTINCT session_id, {CTX} AS context, article_id, position FROM shown")
def _(spark, d):
    return J.run_append(J.impression_dedupe(J.impression_items(log(spark, d))), "impressions").drop("event_time")


_SESS = {
    "imptimes": f"SELECT session_id, {CTX} AS context, article_id, position, date_trunc('millisecond', CAST(created_at AS TIMESTAMP)) AS ms, CAST(created_at AS TIMESTAMP) AS t FROM shown",
    "gaps": "SELECT *, sum(CASE WHEN prev IS NULL OR t - prev >= INTERVAL 350 MILLISECOND THEN 1 ELSE 0 END) OVER (PARTITION BY session_id, context ORDER BY t, position) AS grp FROM (SELECT *, lag(t) OVER (PARTITION BY session_id, context ORDER BY t, position) AS prev FROM imptimes)",
    "sess": "SELECT session_id, context, min(t) AS t0, max(t) + INTERVAL 350 MILLISECOND AS t1, count(DISTINCT (article_id, position)) AS n FROM gaps GROUP BY session_id, context, grp"}


@query("stream_impression_batches", """SELECT session_id, context, strftime(t0, '%Y-%m-%dT%H:%M:%S.%g') AS opened_at, n AS items FROM sess""", _SESS)
def _(spark, d):
    with S.rocksdb_state(spark):
        updates = J.run_update(S.impression_batches(J.impression_items(log(spark, d))), "batches")
    out = S.settled(updates)
    return out.select("session_id", "context", F.date_format("opened_at", ISO).alias("opened_at"), F.size("articles").cast("bigint").alias("items"))


@query("stream_positive_dedupe", "SELECT subject, article_id, created_at FROM escan WHERE keep", {
    "epos": f"""SELECT *, epoch_us(CAST(created_at AS TIMESTAMP)) / CAST(1000000 AS DOUBLE) AS t, row_number() OVER (PARTITION BY subject, article_id ORDER BY created_at) AS rn FROM (
      SELECT CASE WHEN user_id IS NOT NULL THEN 'user:' || user_id ELSE 'session:' || session_id END AS subject, article_id, created_at FROM event_log WHERE event_type IN ({POS}) AND article_id <> '')""",
    "escan": """/*RECURSIVE_CTE*/SELECT subject, article_id, created_at, rn, t AS last, true AS keep FROM epos WHERE rn = 1
      UNION ALL SELECT p.subject, p.article_id, p.created_at, p.rn, CASE WHEN p.t - s.last > 30 THEN p.t ELSE s.last END, p.t - s.last > 30
      FROM escan s JOIN epos p ON p.subject = s.subject AND p.article_id = s.article_id AND p.rn = s.rn + 1"""})
def _(spark, d):
    return J.run_append(J.positive_dedupe(log(spark, d)), "positives")


@query("stream_recommendation_ctr", """SELECT day, rec_source, CAST(items AS BIGINT) AS impression_items, CAST(clicks AS BIGINT) AS clicks, CASE WHEN items > 0 THEN round(clicks / CAST(items AS DOUBLE), 4) END AS ctr FROM (
  SELECT day, 'all' AS rec_source, items, clicks FROM day_ctr
  UNION ALL SELECT s.day, s.rec_source, items, s.clicks FROM (SELECT day, rec_source, count(*) AS clicks FROM rec_events WHERE event_type = 'click_article' GROUP BY ALL) s JOIN day_ctr USING (day))""", {
    "rec_events": """SELECT substr(created_at, 1, 10) AS day, event_type, coalesce(json_extract_string(event_data, '$.rec_source'), 'unknown') AS rec_source FROM event_log
      WHERE event_type IN ('impression', 'click_article') AND json_extract_string(event_data, '$.source') = 'personalized_recommendation'""",
    "day_ctr": "SELECT day, sum(CASE WHEN event_type = 'impression' THEN 5 ELSE 0 END) AS items, count(*) FILTER (event_type = 'click_article') AS clicks FROM rec_events GROUP BY day"})
def _(spark, d):
    cells = J.latest(J.run_update(J.recommendation_ctr(log(spark, d)), "ctr"), ["starts_at", "rec_source"])
    return J.ctr_by_source(cells).select(F.date_format("starts_at", "yyyy-MM-dd").alias("day"), "rec_source", "impression_items", "clicks", "ctr")


@query("stream_web_vitals", """SELECT strftime(s, '%Y-%m-%dT%H:%M:%S.%g') AS starts_at, path, quantile_disc(lcp_ms, 0.5) AS lcp_p50, quantile_disc(lcp_ms, 0.75) AS lcp_p75, quantile_disc(lcp_ms, 0.95) AS lcp_p95,
  quantile_disc(cls, 0.75) AS cls_p75, quantile_disc(max_event_ms, 0.75) AS inp_p75, count(*) AS sample_count FROM slides GROUP BY s, path""", {
    "slides": """SELECT path, lcp_ms, cls, max_event_ms, time_bucket(INTERVAL 6 HOUR, t, TIMESTAMP '2000-01-01') - to_hours(6 * j) AS s
      FROM (SELECT *, CAST(created_at AS TIMESTAMP) AS t FROM performance_log), (SELECT unnest([0, 1, 2, 3]) AS j)"""})
def _(spark, d):
    updates = J.run_update(J.web_vitals(V.as_performance_log(J.read_events(spark, d, "events.parquet"))), "vitals")
    return J.latest(updates, ["starts_at", "path"]).withColumn("starts_at", F.date_format("starts_at", ISO))


@query("stream_history_state", f"""SELECT subject, article_id, created_at, pos FROM (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY created_at DESC, article_id DESC) AS pos FROM (
  SELECT CASE WHEN user_id IS NOT NULL THEN 'user:' || user_id ELSE 'session:' || session_id END AS subject, article_id, created_at FROM event_log WHERE event_type IN ({POS}) AND article_id <> '')) WHERE pos <= 20""")
def _(spark, d):
    with S.rocksdb_state(spark):
        out = J.run_update(S.history_state(log(spark, d)), "history")
    return J.latest_state(out).select("subject", "article_id", "created_at", "pos")
