"""Queries: recommendation stages for every session of the event log."""
from __future__ import annotations

from pyspark.sql import functions as F

from .. import constants as K
from ..plans import encoders as E, history as H, recommend as R
from ..session import write_once
from ..sources import views as V
from .oracle_views import lst
from .registry import query
from .search import chunk_index, learned_index

LIMIT = 10
POS = lst(K.POSITIVE_EVENTS)[1:-1]


def requests(spark, d):
    return V.event_log(spark, d).groupBy("session_id").agg(F.max("user_id").alias("user_id")).select(
        F.col("session_id").alias("request_id"), "session_id", "user_id")


def parts(spark, d):
    return requests(spark, d), V.event_log(spark, d), V.feedback(spark, d), V.articles(spark, d)


def r6(df, *cols):
    return df.withColumns({c: F.round(c, 6) for c in cols})


_HIST = lambda scope: f"""SELECT subject, article_id, category, created_at, pos FROM (SELECT {scope} AS subject, p.article_id, category, created_at,
  row_number() OVER (PARTITION BY {scope} ORDER BY created_at DESC, event_key) AS pos FROM positives p JOIN articles a ON a.article_id = p.article_id WHERE {scope} IS NOT NULL) WHERE pos <= 20"""
RV = {
    "requests": "SELECT session_id AS request_id, session_id, max(user_id) AS user_id FROM event_log GROUP BY session_id",
    "positives": f"""SELECT session_id, user_id, article_id, created_at, 'e' || log_id AS event_key FROM event_log WHERE article_id IS NOT NULL AND event_type IN ({POS})
      UNION ALL SELECT NULL, user_id, article_id, created_at, 'f' || feedback_id FROM feedback WHERE feedback_type = 'like'""",
    "shist": _HIST("session_id"), "uhist": _HIST("user_id"),
    "bothhist": """SELECT request_id, 0 AS src, pos, article_id, category FROM requests r JOIN shist s ON r.session_id = s.subject
      UNION ALL SELECT request_id, 1, pos, article_id, category FROM requests r JOIN uhist u ON r.user_id = u.subject""",
    "hist": """SELECT request_id, src, pos, article_id, category, row_number() OVER (PARTITION BY request_id ORDER BY src, pos) AS hpos FROM (
      SELECT *, row_number() OVER (PARTITION BY request_id, article_id ORDER BY src, pos) AS n FROM bothhist) WHERE n = 1""",
    "dimsum": """SELECT request_id, src, i, sum(power(0.5, (pos - 1) / CAST(5 AS DOUBLE)) * embedding[i]) / sum(power(0.5, (pos - 1) / CAST(5 AS DOUBLE))) AS x
      FROM bothhist h JOIN article_vectors v ON h.article_id = v.article_id, (SELECT unnest(range(1, 65)) AS i) GROUP BY 1, 2, 3""",
    "prof_src": "SELECT request_id, src, list(x ORDER BY i) AS p FROM dimsum GROUP BY 1, 2",
    "profiles": """SELECT coalesce(s.request_id, u.request_id) AS request_id, CASE WHEN u.p IS NULL THEN s.p WHEN s.p IS NULL THEN u.p
      ELSE list_transform(list_zip(s.p, u.p), lambda z: z[1] * 0.65 + z[2] * (1 - 0.65)) END AS profile
      FROM (SELECT * FROM prof_src WHERE src = 0) s FULL JOIN (SELECT * FROM prof_src WHERE src = 1) u ON s.request_id = u.request_id""",
    "chits": """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY score DESC, chunk_id) AS n FROM (
      SELECT request_id, chunk_id, c.article_id, round(list_cosine_similarity(profile, embedding), 9) AS score FROM profiles, chunks c
      WHERE c.article_id IN (SELECT article_id FROM articles)) WHERE score >= 0.35) WHERE n <= 150""",
    "cbest": """SELECT request_id, article_id, score FROM (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY score DESC, article_id) AS rk FROM (
      SELECT *, row_number() OVER (PARTITION BY request_id, article_id ORDER BY score DESC, chunk_id) AS b FROM chits) WHERE b = 1) WHERE rk <= 30""",
    "cand": "SELECT * FROM cbest c WHERE NOT EXISTS (SELECT 1 FROM hist h WHERE h.request_id = c.request_id AND h.article_id = c.article_id AND h.hpos <= 5)",
    "catw": "SELECT request_id, coalesce(category, 'unknown') AS category, sum(power(0.5, (hpos - 1) / CAST(5 AS DOUBLE))) AS weight FROM hist WHERE hpos <= 20 GROUP BY 1, 2",
    "comp": """SELECT c.request_id, c.article_id, c.score, coalesce(a.category, 'unknown') AS category, a.trust_score, coalesce(a.published_at, '') AS published_at, coalesce(w.weight, CAST(0 AS DOUBLE)) AS w,
      coalesce(a.trust_score, 0) / CAST(100 AS DOUBLE) AS t, CAST(dense_rank() OVER (PARTITION BY c.request_id ORDER BY coalesce(a.published_at, '')) - 1 AS DOUBLE) AS f
      FROM cand c JOIN articles a ON a.article_id = c.article_id LEFT JOIN catw w ON w.request_id = c.request_id AND w.category = coalesce(a.category, 'unknown')""",
    "reranked": """SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY rank_score DESC, article_id DESC) AS pos FROM (SELECT request_id, article_id, score, category, trust_score, published_at,
      round(0.1 * {0} + 0.6 * {1} + 0.1 * {2} + 0.2 * {3}, 9) AS rank_score FROM comp)""".format(*[
        f"(CASE WHEN max({c}) OVER (PARTITION BY request_id) - min({c}) OVER (PARTITION BY request_id) <= 1e-12 THEN CAST(0 AS DOUBLE) ELSE ({c} - min({c}) OVER (PARTITION BY request_id)) / (max({c}) OVER (PARTITION BY request_id) - min({c}) OVER (PARTITION BY request_id)) END)" for c in ("score", "w", "t", "f")]),
    "diverse": "SELECT * REPLACE (row_number() OVER (PARTITION BY request_id ORDER BY CASE WHEN cpos > 6 THEN 1 ELSE 0 END, pos) AS pos) FROM (SELECT *, row_number() OVER (PARTITION BY request_id, category ORDER BY pos) AS cpos FROM reranked)",
    "guarded": "SELECT * REPLACE (row_number() OVER (PARTITION BY request_id ORDER BY CASE WHEN trust_score > 0 AND trust_score < 40 THEN 1 ELSE 0 END, pos) AS pos) FROM diverse",
    "main_rows": "SELECT request_id, pos, article_id, 'profile' AS rec_source, round(score, 4) AS rec_score FROM guarded WHERE pos <= 10",
    "catfall": """SELECT * FROM (SELECT h.request_id, a.article_id, a.category, a.trust_score, row_number() OVER (PARTITION BY h.request_id ORDER BY a.published_at DESC, a.article_id) AS pos
      FROM (SELECT DISTINCT request_id, category FROM hist WHERE category IS NOT NULL AND request_id NOT IN (SELECT request_id FROM main_rows)) h JOIN articles a ON a.category = h.category
      WHERE NOT EXISTS (SELECT 1 FROM hist z WHERE z.request_id = h.request_id AND z.article_id = a.article_id)) WHERE pos <= 10""",
    "cat_rows": "SELECT request_id, row_number() OVER (PARTITION BY request_id ORDER BY CASE WHEN trust_score > 0 AND trust_score < 40 THEN 1 ELSE 0 END, pos) AS pos, article_id, 'category' AS rec_source, CAST(NULL AS DOUBLE) AS rec_score FROM catfall",
    "personal": "SELECT * FROM main_rows UNION ALL SELECT * FROM cat_rows",
    "newest": "SELECT article_id, category, row_number() OVER (ORDER BY published_at DESC, article_id) AS npos FROM articles",
    "fill": """SELECT request_id, 100 + npos AS pos, article_id, 'latest' AS rec_source, CAST(NULL AS DOUBLE) AS rec_score FROM (SELECT DISTINCT request_id FROM personal) q, newest n WHERE npos <= 70
      AND NOT EXISTS (SELECT 1 FROM personal p WHERE p.request_id = q.request_id AND p.article_id = n.article_id) AND NOT EXISTS (SELECT 1 FROM hist h WHERE h.request_id = q.request_id AND h.hpos <= 5 AND h.article_id = n.article_id)""",
    "lat": """SELECT request_id, npos AS pos, article_id, 'latest' AS rec_source, CAST(NULL AS DOUBLE) AS rec_score FROM requests q, newest n WHERE npos <= 70 AND request_id NOT IN (SELECT request_id FROM personal)
      AND NOT EXISTS (SELECT 1 FROM hist h WHERE h.request_id = q.request_id AND h.article_id = n.article_id)""",
    "outrows": """SELECT * FROM (SELECT request_id, row_number() OVER (PARTITION BY request_id ORDER BY pos) AS pos, article_id, rec_source, rec_score FROM (
      SELECT * FROM personal UNION ALL SELECT * FROM fill UNION ALL SELECT * FROM lat)) WHERE pos <= 10""",
    "unseen": """SELECT * FROM (SELECT q.request_id, n.article_id, n.category, row_number() OVER (PARTITION BY q.request_id ORDER BY npos) AS u FROM (SELECT DISTINCT request_id FROM main_rows) q, newest n WHERE npos <= 70
      AND NOT EXISTS (SELECT 1 FROM outrows o WHERE o.request_id = q.request_id AND o.article_id = n.article_id) AND NOT EXISTS (SELECT 1 FROM hist h WHERE h.request_id = q.request_id AND h.article_id = n.article_id)) WHERE u <= 10""",
    "explore": """SELECT request_id, arg_min(article_id, u) AS article_id FROM unseen x WHERE NOT EXISTS (SELECT 1 FROM hist h WHERE h.request_id = x.request_id AND h.category = coalesce(x.category, 'unknown')) GROUP BY request_id""",
    "recs": """SELECT o.request_id, o.pos, CASE WHEN o.pos = 10 AND e.article_id IS NOT NULL THEN e.article_id ELSE o.article_id END AS article_id,
      CASE WHEN o.pos = 10 AND e.article_id IS NOT NULL THEN 'explore' ELSE rec_source END AS rec_source, CASE WHEN o.pos = 10 AND e.article_id IS NOT NULL THEN NULL ELSE rec_score END AS rec_score
      FROM outrows o LEFT JOIN explore e ON o.request_id = e.request_id""",
}


@query("positive_events_union", "SELECT user_id, article_id, created_at, event_key FROM positives", RV)
def _(spark, d):
    return H.positive_events(V.event_log(spark, d), V.feedback(spark, d)).select("user_id", "article_id", "created_at", "event_key")


@query("recent_history", "SELECT subject, article_id, created_at, pos FROM uhist", RV)
def _(spark, d):
    _, e, f, a = parts(spark, d)
    return H.recent_history(e, f, a, "user_id").select("subject", "article_id", "created_at", "pos")


@query("history_article_join", "SELECT subject, article_id, category, pos FROM shist", RV)
def _(spark, d):
    _, e, f, a = parts(spark, d)
    return H.recent_history(e, f, a, "session_id").select("subject", "article_id", "category", "pos")


@query("recent_history_unscoped_likes", """SELECT subject, article_id, pos FROM (SELECT subject, article_id, row_number() OVER (PARTITION BY subject ORDER BY created_at DESC, event_key) AS pos FROM (
  SELECT session_id AS subject, p.article_id, created_at, event_key FROM positives p JOIN articles a ON a.article_id = p.article_id WHERE session_id IS NOT NULL
  UNION ALL SELECT s.session_id, l.article_id, l.created_at, l.event_key FROM (SELECT DISTINCT session_id FROM positives WHERE session_id IS NOT NULL) s,
  (SELECT p.* FROM positives p JOIN articles a ON a.article_id = p.article_id WHERE event_key LIKE 'f%') l)) WHERE pos <= 20""", RV)
def _(spark, d):
    _, e, f, a = parts(spark, d)
    return H.recent_history(e, f, a, "session_id", strict=False).select("subject", "article_id", "pos")


@query("merged_history", "SELECT request_id, article_id, hpos FROM hist", RV)
def _(spark, d):
    return R.merged_history(*parts(spark, d)).select("request_id", "article_id", "hpos")


@query("history_dedupe_first", "SELECT request_id, count(*) AS n, max(hpos) AS last_pos FROM hist GROUP BY request_id", RV)
def _(spark, d):
    return R.merged_history(*parts(spark, d)).groupBy("request_id").agg(F.count("*").alias("n"), F.max("hpos").alias("last_pos"))


_TOTAL = "round(list_sum({0}), 6) AS total, round({0}[1], 6) AS first"


def totals(df, key, col):
    return df.select(*key, F.round(F.aggregate(col, F.lit(0.0), lambda s, x: s + x), 6).alias("total"), F.round(F.col(col)[0], 6).alias("first"))


@query("recency_weighted_vector", f"SELECT request_id, src, {_TOTAL.format('p')} FROM prof_src", RV)
def _(spark, d):
    raw = R.both_histories(*parts(spark, d))
    return totals(E.recency_weighted_vector(raw, V.article_vectors(spark, d), ["request_id", "src"], F.col("pos") - 1), ["request_id", "src"], "profile")


@query("profile_vectors", f"SELECT request_id, {_TOTAL.format('profile')} FROM profiles", RV)
def _(spark, d):
    return totals(R.profile_vectors(R.both_histories(*parts(spark, d)), V.article_vectors(spark, d)), ["request_id"], "profile")


@query("profile_candidates", "SELECT request_id, article_id, score FROM cand", RV)
def _(spark, d):
    p = parts(spark, d)
    raw = write_once(R.both_histories(*p))
    prof = R.profile_vectors(raw, V.article_vectors(spark, d))
    return R.profile_candidates(prof, V.chunks(spark, d), p[3], R.merge_histories(raw), LIMIT, chunk_index(spark, d))


@query("category_recency_weights", "SELECT request_id, category, round(weight, 6) AS weight FROM catw", RV)
def _(spark, d):
    h = R.merged_history(*parts(spark, d))
    return r6(R.category_recency_weights(h, ["request_id"], F.col("hpos") - 1), "weight")


def _ranked(spark, d):
    return R.ranked_profile(*parts(spark, d), V.article_vectors(spark, d), V.chunks(spark, d), LIMIT, index=chunk_index(spark, d))[1]


@query("rerank_hybrid", "SELECT request_id, article_id, rank_score, pos FROM reranked", RV)
def _(spark, d):
    return _ranked(spark, d).select("request_id", "article_id", "rank_score", "pos")


@query("minmax_scale", "SELECT request_id, article_id, round(CASE WHEN max(score) OVER w - min(score) OVER w <= 1e-12 THEN 0 ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END, 6) AS semantic FROM cand WINDOW w AS (PARTITION BY request_id)", RV)
def _(spark, d):
    return r6(_ranked(spark, d), "semantic").select("request_id", "article_id", "semantic")


@query("freshness_rank", "SELECT c.request_id, c.article_id, dense_rank() OVER (PARTITION BY c.request_id ORDER BY a.published_at) - 1 AS freshness FROM cand c JOIN articles a ON a.article_id = c.article_id", RV)
def _(spark, d):
    rows = _ranked(spark, d).select("request_id", "article_id", "published_at")
    return rows.withColumn("freshness", R.freshness_rank(["request_id"])).drop("published_at")


@query("diversify", "SELECT request_id, article_id, pos FROM diverse", RV)
def _(spark, d):
    return R.diversify(_ranked(spark, d), ["request_id"], LIMIT).select("request_id", "article_id", "pos")


@query("category_cap_position", "SELECT request_id, category, max(cpos) AS n FROM diverse GROUP BY 1, 2", RV)
def _(spark, d):
    return R.diversify(_ranked(spark, d), ["request_id"], LIMIT).groupBy("request_id", "category").agg(F.count("*").alias("n"))


@query("trust_guardrail", "SELECT request_id, article_id, pos FROM guarded", RV)
def _(spark, d):
    return R.trust_guardrail(R.diversify(_ranked(spark, d), ["request_id"], LIMIT), ["request_id"]).select("request_id", "article_id", "pos")


@query("category_fallback", """SELECT request_id, article_id, pos FROM (SELECT h.request_id, a.article_id, row_number() OVER (PARTITION BY h.request_id ORDER BY a.published_at DESC, a.article_id) AS pos
  FROM (SELECT DISTINCT request_id, category FROM hist WHERE category IS NOT NULL) h JOIN articles a ON a.category = h.category
  WHERE NOT EXISTS (SELECT 1 FROM hist z WHERE z.request_id = h.request_id AND z.article_id = a.article_id)) WHERE pos <= 10""", RV)
def _(spark, d):
    p = parts(spark, d)
    return R.category_fallback(R.merged_history(*p), p[3], LIMIT).select("request_id", "article_id", "pos")


@query("latest_fallback", """SELECT request_id, pos, article_id FROM (SELECT request_id, article_id, row_number() OVER (PARTITION BY request_id ORDER BY npos) AS pos FROM requests q, newest n WHERE npos <= 70
  AND NOT EXISTS (SELECT 1 FROM hist h WHERE h.request_id = q.request_id AND h.article_id = n.article_id)) WHERE pos <= 10""", RV)
def _(spark, d):
    p = parts(spark, d)
    return R.latest_fallback(p[0], R.merged_history(*p), p[3], LIMIT)


def _recs(spark, d):
    return R.recommend(*parts(spark, d), V.article_vectors(spark, d), V.chunks(spark, d), LIMIT, index=chunk_index(spark, d))


@query("recommend", "SELECT request_id, pos, article_id, rec_source, coalesce(rec_score, -1) AS rec_score FROM recs", RV)
def _(spark, d):
    return _recs(spark, d).withColumn("rec_score", F.coalesce("rec_score", F.lit(-1.0)))


@query("explore_slot", "SELECT request_id, article_id FROM recs WHERE rec_source = 'explore'", RV)
def _(spark, d):
    return _recs(spark, d).where("rec_source = 'explore'").select("request_id", "article_id")


@query("fill_to_limit", "SELECT rec_source, count(*) AS n, count(DISTINCT request_id) AS requests FROM recs GROUP BY 1", RV)
def _(spark, d):
    return _recs(spark, d).groupBy("rec_source").agg(F.count("*").alias("n"), F.countDistinct("request_id").alias("requests"))


# ---- encoders --------------------------------------------------------------------------

EV = {**RV,
    "base_vectors": "SELECT article_id, list_transform(learned_embedding, lambda x: x / sqrt(list_dot_product(learned_embedding, learned_embedding))) AS v FROM learned_vectors",
    "user_dims": "SELECT request_id, i, avg(coalesce(v[i], CAST(0 AS DOUBLE))) AS x FROM hist h LEFT JOIN base_vectors b ON h.article_id = b.article_id, (SELECT unnest(range(1, 65)) AS i) WHERE hpos <= 20 GROUP BY 1, 2",
    "user_vecs": "SELECT request_id, list_transform(p, lambda x: x / sqrt(list_dot_product(p, p))) AS uv FROM (SELECT request_id, list(x ORDER BY i) AS p FROM user_dims GROUP BY 1)",
    "enc": """SELECT * FROM (SELECT request_id, article_id, score, row_number() OVER (PARTITION BY request_id ORDER BY score DESC, article_id) AS rank FROM (
      SELECT u.request_id, l.article_id, round(list_cosine_similarity(uv, learned_embedding), 9) AS score FROM user_vecs u, learned_vectors l
      WHERE NOT EXISTS (SELECT 1 FROM hist h WHERE h.request_id = u.request_id AND h.article_id = l.article_id AND h.hpos <= 5))) WHERE rank <= 20"""}


def _article_units(spark, d):
    return E.encode_articles(V.article_vectors(spark, d).join(V.learned_vectors(spark, d), "article_id"))


def _user_units(spark, d):
    return E.encode_users(R.merged_history(*parts(spark, d)), _article_units(spark, d), "request_id")


@query("encode_articles", f"SELECT article_id, {_TOTAL.format('v')} FROM base_vectors", EV)
def _(spark, d):
    return totals(_article_units(spark, d), ["article_id"], "vector")


@query("backfill_learned_embeddings", "SELECT a.article_id, round(coalesce(list_sum(v), CAST(0 AS DOUBLE)), 6) AS vector_sum FROM articles a LEFT JOIN base_vectors b ON a.article_id = b.article_id", EV)
def _(spark, d):
    from ..operators import merges as M
    stored = V.articles(spark, d).select("article_id", F.lit(None).cast("array<double>").alias("learned_embedding"))
    out = M.update_learned_embedding(stored, _article_units(spark, d).withColumnRenamed("vector", "learned_embedding"))
    return out.select("article_id", F.round(F.coalesce(F.aggregate("learned_embedding", F.lit(0.0), lambda s, x: s + x), F.lit(0.0)), 6).alias("vector_sum"))


# Deterministic weights that SQL can state: (7 i + 13 j + s) mod 11, shifted and scaled.
_HIDDEN, _CATS = 8, 8


def _numbers(rows: int, cols: int, seed: int):
    import numpy as np
    return (((np.arange(cols)[None, :] * 7 + np.arange(rows)[:, None] * 13 + seed) % 11) - 5) / 50.0


def _attention_weights():
    return {"category_w": _numbers(64, _CATS, 1), "category_b": _numbers(1, 64, 2)[0], "view_w1": _numbers(_HIDDEN, 64, 3), "view_b1": _numbers(1, _HIDDEN, 4)[0],
            "view_w2": _numbers(1, _HIDDEN, 5), "view_b2": _numbers(1, 1, 6)[0]}


def _w(j, i, seed):
    return f"((({i}) * 7 + ({j}) * 13 + {seed}) % 11 - 5) / CAST(50 AS DOUBLE)"


_ATT = {
    "att_in": "SELECT article_id, embedding AS s, list_reverse(embedding) AS t, CAST(article_id AS BIGINT) % 8 AS cat FROM article_vectors",
    "att_views": f"""SELECT article_id, 0 AS v, t AS x FROM att_in UNION ALL SELECT article_id, 1, s FROM att_in
      UNION ALL SELECT article_id, 2, list_transform(range(0, 64), lambda j: {_w('j', 'cat', 1)} + {_w('0', 'j', 2)}) FROM att_in""",
    "att_hidden": f"""SELECT article_id, v, x, h, tanh(list_dot_product(x, list_transform(range(0, 64), lambda i: {_w('h', 'i', 3)})) + {_w('0', 'h', 4)}) * {_w('0', 'h', 5)} AS part
      FROM att_views, (SELECT unnest(range(0, {_HIDDEN})) AS h)""",
    "att_logit": f"SELECT article_id, v, any_value(x) AS x, sum(part) + {_w('0', '0', 6)} AS l FROM att_hidden GROUP BY article_id, v",
    "att_share": "SELECT article_id, x, exp(l) / sum(exp(l)) OVER (PARTITION BY article_id) AS p FROM att_logit",
    "att_sum": "SELECT article_id, i, sum(p * x[i]) AS y FROM att_share, (SELECT unnest(range(1, 65)) AS i) GROUP BY article_id, i",
    "att_out": "SELECT article_id, i, y / sqrt(sum(y * y) OVER (PARTITION BY article_id)) AS u FROM att_sum"}


@query("encode_articles_attention", "SELECT article_id, round(sum(u), 6) AS total, round(sum(u * i), 6) AS placed FROM att_out GROUP BY article_id", _ATT)
def _(spark, d):
    v = V.article_vectors(spark, d)
    cat = F.col("article_id").cast("bigint") % 8
    rows = v.select("article_id", "embedding", F.reverse("embedding").alias("title_embedding"),
                    F.transform(F.sequence(F.lit(0), F.lit(_CATS - 1)), lambda i: (i == cat).cast("double")).alias("one_hot"))
    out = E.encode_articles(rows, _attention_weights())
    placed = F.aggregate(F.transform("vector", lambda x, i: x * (i + 1)), F.lit(0.0), lambda a, x: a + x)
    return out.select("article_id", F.round(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x), 6).alias("total"), F.round(placed, 6).alias("placed"))


@query("encode_users", f"SELECT request_id, {_TOTAL.format('uv')} FROM user_vecs", EV)
def _(spark, d):
    return totals(_user_units(spark, d), ["request_id"], "user_vector")


@query("encoder_candidates", "SELECT request_id, article_id, score, rank FROM enc", EV)
def _(spark, d):
    history = write_once(R.merged_history(*parts(spark, d)))
    users = E.encode_users(history, _article_units(spark, d), "request_id")
    return R.encoder_candidates(users, V.learned_vectors(spark, d), history, LIMIT, learned_index(spark, d)).select("request_id", "article_id", "score", "rank")
