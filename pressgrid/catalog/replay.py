"""Queries: interaction samples, replay metrics and weight search."""
from __future__ import annotations

from pyspark.sql import functions as F

from .. import constants as K
from ..plans import replay as R, samples as SM
from ..session import write_once
from ..sources import views as V
from .oracle_views import lst
from .recommend import RV, r6
from .registry import query
from .search import all_chunks_index

N = 3  # negatives per sample, as in the offline evaluation
POS = lst(K.POSITIVE_EVENTS)[1:-1]
SUBJ = "CASE WHEN user_id IS NOT NULL THEN 'user:' || user_id ELSE 'session:' || {0} END"


def cosd(a, b):
    return f"round(CASE WHEN list_dot_product({a}, {a}) > 0 AND list_dot_product({b}, {b}) > 0 THEN list_cosine_similarity({a}, {b}) ELSE CAST(0 AS DOUBLE) END, 9)"


SV = {
    "pos0": f"""SELECT {SUBJ.format('session_id')} AS subject, created_at, article_id FROM event_log WHERE event_type IN ({POS}) AND article_id IN (SELECT article_id FROM article_vectors)
      UNION ALL SELECT {SUBJ.format("'guest'")}, created_at, article_id FROM feedback WHERE feedback_type = 'like' AND article_id IN (SELECT article_id FROM article_vectors)""",
    "pos1": "SELECT *, epoch_us(CAST(created_at AS TIMESTAMP)) / CAST(1000000 AS DOUBLE) AS t, row_number() OVER (PARTITION BY subject, article_id ORDER BY created_at) AS rn FROM pos0",
    "scan": """/*RECURSIVE_CTE*/SELECT subject, article_id, created_at, rn, t AS last, true AS keep FROM pos1 WHERE rn = 1
      UNION ALL SELECT p.subject, p.article_id, p.created_at, p.rn, CASE WHEN p.t - s.last > 30 THEN p.t ELSE s.last END, p.t - s.last > 30
      FROM scan s JOIN pos1 p ON p.subject = s.subject AND p.article_id = s.article_id AND p.rn = s.rn + 1""",
    "kept": "SELECT subject, created_at AS event_at, article_id AS positive, row_number() OVER (PARTITION BY subject ORDER BY created_at, article_id) AS seq FROM scan WHERE keep",
    "imps": f"SELECT {SUBJ.format('session_id')} AS subject, created_at, article_id, position FROM shown WHERE article_id IN (SELECT article_id FROM article_vectors)",
    "lastimp": """SELECT k.subject, k.seq, i.article_id, max((i.created_at, i.position)) AS seen FROM kept k JOIN imps i ON i.subject = k.subject AND i.created_at <= k.event_at AND i.article_id <> k.positive
      GROUP BY 1, 2, 3""",
    "firstpos": "SELECT subject, positive, min(seq) AS f FROM kept GROUP BY 1, 2",
    "negs": f"""SELECT subject, seq, list(article_id ORDER BY n) AS negatives FROM (SELECT l.*, row_number() OVER (PARTITION BY l.subject, l.seq ORDER BY seen DESC) AS n
      FROM lastimp l LEFT JOIN firstpos f ON f.subject = l.subject AND f.positive = l.article_id WHERE f.f IS NULL OR f.f >= l.seq) WHERE n <= {N} GROUP BY 1, 2 HAVING count(*) = {N}""",
    "samples": """SELECT subject, event_at, positive, history, negatives, subject || '|' || event_at || '|' || positive AS sample_id FROM (
      SELECT *, list(positive) OVER (PARTITION BY subject ORDER BY seq ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS history FROM kept) JOIN negs USING (subject, seq) WHERE len(history) > 0""",
    "cands": f"SELECT sample_id, subject, positive, p AS cpos, list_concat([positive], negatives)[p + 1] AS article_id FROM samples, (SELECT unnest(range(0, {N + 1})) AS p)",
    "hist_rows": "SELECT sample_id, history[p + 1] AS article_id, len(history) - 1 - p AS age FROM samples, (SELECT unnest(range(0, 20)) AS p) WHERE p < len(history)",
    "meta": "SELECT a.article_id, coalesce(category, 'unknown') AS category, coalesce(published_at, '') AS published_at, coalesce(trust_score, 0) AS trust_score, embedding FROM articles a LEFT JOIN article_vectors v ON a.article_id = v.article_id",
    "prof_dims": "SELECT sample_id, i, sum(power(0.5, age / CAST(5 AS DOUBLE)) * embedding[i]) / sum(power(0.5, age / CAST(5 AS DOUBLE))) AS x FROM hist_rows h JOIN article_vectors v ON v.article_id = h.article_id, (SELECT unnest(range(1, 65)) AS i) GROUP BY 1, 2",
    "sprof": "SELECT sample_id, list(x ORDER BY i) AS profile FROM prof_dims GROUP BY 1",
    "rows_": f"SELECT c.*, m.category, m.published_at, m.trust_score, {cosd('profile', 'embedding')} AS cosine FROM cands c JOIN meta m ON m.article_id = c.article_id LEFT JOIN sprof s ON s.sample_id = c.sample_id",
    "scatw": "SELECT sample_id, category, sum(power(0.5, age / CAST(5 AS DOUBLE))) AS weight FROM hist_rows h JOIN meta m ON m.article_id = h.article_id GROUP BY 1, 2",
    "rows2": """SELECT r.*, round(coalesce(w.weight, CAST(0 AS DOUBLE)), 9) AS cw, coalesce(w.weight, CAST(0 AS DOUBLE)) AS w, r.trust_score / CAST(100 AS DOUBLE) AS t,
      CAST(dense_rank() OVER (PARTITION BY r.sample_id ORDER BY published_at) - 1 AS DOUBLE) AS f FROM rows_ r LEFT JOIN scatw w ON w.sample_id = r.sample_id AND w.category = r.category""",
}
MM = "(CASE WHEN max({0}) OVER (PARTITION BY sample_id) - min({0}) OVER (PARTITION BY sample_id) <= 1e-12 THEN CAST(0 AS DOUBLE) ELSE ({0} - min({0}) OVER (PARTITION BY sample_id)) / (max({0}) OVER (PARTITION BY sample_id) - min({0}) OVER (PARTITION BY sample_id)) END)"
SV["hyb"] = "SELECT *, round(0.1 * {0} + 0.6 * {1} + 0.1 * {2} + 0.2 * {3}, 9) AS rs FROM rows2".format(*[MM.format(c) for c in ("cosine", "w", "t", "f")])
_ORDERS = {"profile": ("rows2", "cosine DESC, cpos"), "hybrid": ("hyb", "rs DESC, article_id DESC"), "category": ("rows2", "cw DESC, published_at DESC, article_id DESC"),
           "latest": ("rows2", "published_at DESC, article_id DESC"), "random": ("rows2", "sha256('42|' || subject || '|' || positive || '|' || article_id), article_id")}
SV["ranked_all"] = " UNION ALL ".join(f"SELECT '{n}' AS strategy, sample_id, cpos, article_id, row_number() OVER (PARTITION BY sample_id ORDER BY {o}) AS rank FROM {v}" for n, (v, o) in _ORDERS.items())
METRICS = """count(*) AS n, round(avg(CASE WHEN rank <= 3 THEN 1.0 ELSE 0.0 END), 6) AS hit_rate, round(avg(1 / CAST(rank AS DOUBLE)), 6) AS mrr,
  round(avg(CASE WHEN rank <= 3 THEN 1 / log2(rank + 1) ELSE 0 END), 6) AS ndcg"""
SV["catalog"] = """SELECT article_id, category, published_at, embedding, CASE WHEN trust_score <> 0 THEN trust_score / CAST(100 AS DOUBLE) ELSE CAST(0.5 AS DOUBLE) END AS trust,
  (dense_rank() OVER (ORDER BY published_at) - 1) AS place FROM meta WHERE embedding IS NOT NULL"""
SV["catalog2"] = "SELECT *, place / CAST(greatest(max(place) OVER (), 1) AS DOUBLE) AS freshness FROM catalog"
SV["uprof_dims"] = "SELECT sample_id, i, sum(power(0.5, age / CAST(5 AS DOUBLE)) * embedding[i] / sqrt(list_dot_product(embedding, embedding))) AS x FROM hist_rows h JOIN article_vectors v ON v.article_id = h.article_id, (SELECT unnest(range(1, 65)) AS i) GROUP BY 1, 2"
SV["uprof"] = "SELECT sample_id, list(x ORDER BY i) AS profile FROM uprof_dims GROUP BY 1"
SV["comp0"] = f"""SELECT c.sample_id, c.cpos, c.article_id, m.trust, m.freshness, coalesce(w.weight, CAST(0 AS DOUBLE)) AS w, {cosd('profile', 'embedding')} AS sem
  FROM cands c JOIN catalog2 m ON m.article_id = c.article_id JOIN uprof s ON s.sample_id = c.sample_id LEFT JOIN scatw w ON w.sample_id = c.sample_id AND w.category = m.category"""
SV["comps"] = "SELECT sample_id, cpos, article_id, trust AS trust_value, {0} AS semantic, {1} AS interest, {2} AS trust, {3} AS freshness FROM comp0".format(*[MM.format(c) for c in ("sem", "w", "trust", "freshness")])


def samples(spark, d):
    s = SM.temporal_samples(V.event_log(spark, d), V.feedback(spark, d), V.article_vectors(spark, d), negative_count=N)
    return write_once(R.with_ids(s))


def meta(spark, d):
    return R.article_meta(V.articles(spark, d), V.article_vectors(spark, d))


def rows(spark, d):
    s, m = samples(spark, d), meta(spark, d)
    return s, m, R.candidate_rows(s, m)


def metrics6(df):
    return r6(df, "hit_rate", "mrr", "ndcg")


@query("temporal_samples", "SELECT subject, event_at, positive, array_to_string(history, ',') AS history, array_to_string(negatives, ',') AS negatives FROM samples", SV)
def _(spark, d):
    return samples(spark, d).select("subject", "event_at", "positive", F.array_join("history", ",").alias("history"), F.array_join("negatives", ",").alias("negatives"))


@query("observed_negatives_topn", "SELECT sample_id, negatives[1] AS newest, len(negatives) AS n FROM samples", SV)
def _(spark, d):
    return samples(spark, d).select("sample_id", F.col("negatives")[0].alias("newest"), F.size("negatives").alias("n"))


@query("history_frame", "SELECT sample_id, len(history) AS n, history[1] AS oldest, history[-1] AS latest FROM samples", SV)
def _(spark, d):
    return samples(spark, d).select("sample_id", F.size("history").alias("n"), F.element_at("history", 1).alias("oldest"), F.element_at("history", -1).alias("latest"))


@query("impressions_before_click", "SELECT subject, count(*) AS samples FROM samples GROUP BY subject", SV)
def _(spark, d):
    return samples(spark, d).groupBy("subject").agg(F.count("*").alias("samples"))


@query("positive_dedupe", "SELECT subject, event_at, positive FROM kept", SV)
def _(spark, d):
    _, p = SM.actions(V.event_log(spark, d), V.feedback(spark, d), V.article_vectors(spark, d))
    return SM.kept_positives(p).select("subject", F.col("created_at").alias("event_at"), F.col("article_id").alias("positive"))


LV = {
    "lpos": f"""SELECT coalesce(user_id, session_id, 'guest') AS subject, created_at, article_id, 'e' || log_id AS key FROM event_log WHERE event_type IN ({POS}) AND article_id <> ''
      UNION ALL SELECT coalesce(user_id, 'guest'), created_at, article_id, 'f' || feedback_id FROM feedback WHERE feedback_type = 'like'""",
    "lneg": """SELECT subject, list(article_id ORDER BY n) AS neg FROM (SELECT subject, article_id, row_number() OVER (PARTITION BY subject ORDER BY o) AS n FROM (
      SELECT coalesce(user_id, session_id, 'guest') AS subject, article_id, min((created_at, log_id, position)) AS o FROM shown GROUP BY 1, 2) i
      WHERE NOT EXISTS (SELECT 1 FROM lpos p WHERE p.subject = i.subject AND p.article_id = i.article_id)) WHERE n <= 4 GROUP BY subject""",
    "lseq": "SELECT *, row_number() OVER (PARTITION BY subject ORDER BY created_at, key) AS seq, list(article_id) OVER (PARTITION BY subject ORDER BY created_at, key ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS history FROM lpos",
    "lfirst": "SELECT subject, article_id, min(seq) AS f FROM lseq GROUP BY 1, 2",
    "lshort": "SELECT s.* FROM lseq s LEFT JOIN lneg n ON n.subject = s.subject WHERE s.seq > 1 AND coalesce(len(neg), 0) < 4",
    "lorder": "SELECT article_id, row_number() OVER (ORDER BY sha256('42|' || article_id), article_id) AS place FROM articles",
    "lfill": """SELECT subject, seq, list(article_id ORDER BY n) AS extra FROM (SELECT s.subject, s.seq, o.article_id, row_number() OVER (PARTITION BY s.subject, s.seq ORDER BY place) AS n
      FROM lshort s JOIN lorder o ON o.article_id <> s.article_id LEFT JOIN lfirst f ON f.subject = s.subject AND f.article_id = o.article_id WHERE f.f IS NULL OR f.f >= s.seq) WHERE n <= 4 GROUP BY 1, 2""",
}


@query("legacy_samples", """SELECT s.subject, created_at AS event_at, article_id AS positive, array_to_string(history, ',') AS history,
  array_to_string(list_concat(coalesce(neg, []), coalesce(extra, []))[1:4], ',') AS negatives FROM lseq s LEFT JOIN lneg n ON n.subject = s.subject LEFT JOIN lfill f ON f.subject = s.subject AND f.seq = s.seq WHERE s.seq > 1""", LV)
def _(spark, d):
    s = SM.legacy_samples(V.event_log(spark, d), V.feedback(spark, d), V.articles(spark, d))
    return s.select("subject", "event_at", "positive", F.array_join("history", ",").alias("history"), F.array_join("negatives", ",").alias("negatives"))


@query("sample_meta_join", "SELECT sample_id, cpos, article_id, category, published_at, trust_score, cosine FROM rows_", SV)
def _(spark, d):
    return rows(spark, d)[2].select("sample_id", "cpos", "article_id", "category", "published_at", "trust_score", "cosine")


def _strategy(name):
    return f"SELECT sample_id, article_id, rank FROM ranked_all WHERE strategy = '{name}'"


OUT = ["sample_id", "article_id", "rank"]


@query("rank_profile", _strategy("profile"), SV)
def _(spark, d):
    return R.rank_profile(rows(spark, d)[2]).select(*OUT)


@query("rank_category", _strategy("category"), SV)
def _(spark, d):
    s, m, r = rows(spark, d)
    return R.rank_category(r, R.sample_category_weights(s, m)).select(*OUT)


@query("rank_hybrid", _strategy("hybrid"), SV)
def _(spark, d):
    s, m, r = rows(spark, d)
    return R.rank_hybrid(r, R.sample_category_weights(s, m)).select(*OUT)


@query("rank_latest", _strategy("latest"), SV)
def _(spark, d):
    return R.rank_latest(rows(spark, d)[2]).select(*OUT)


@query("rank_random", _strategy("random"), SV)
def _(spark, d):
    s, _, r = rows(spark, d)
    return R.rank_random(r, s).select(*OUT)


@query("seeded_random_rank", "SELECT sample_id, article_id FROM ranked_all WHERE strategy = 'random' AND rank = 1", SV)
def _(spark, d):
    s, _, r = rows(spark, d)
    return R.rank_random(r, s).where("rank = 1").select("sample_id", "article_id")


@query("offline_replay", f"SELECT strategy, {METRICS} FROM ranked_all WHERE cpos = 0 GROUP BY strategy", SV)
def _(spark, d):
    return metrics6(R.offline_replay(samples(spark, d), meta(spark, d)))


@query("ranking_metrics", f"SELECT strategy, {METRICS} FROM ranked_all WHERE cpos = 0 AND strategy = 'latest' GROUP BY strategy", SV)
def _(spark, d):
    return metrics6(R.ranking_metrics(R.rank_latest(rows(spark, d)[2])))


@query("sample_closure_filter", "SELECT sample_id FROM samples s WHERE NOT EXISTS (SELECT 1 FROM (SELECT unnest(list_concat(list_concat([s.positive], s.negatives), s.history)) AS a) u WHERE a NOT IN (SELECT article_id FROM articles))", SV)
def _(spark, d):
    return R.closed_samples(samples(spark, d), V.articles(spark, d)).select("sample_id")


@query("time_ordered_split", "SELECT sample_id, CASE WHEN row_number() OVER (ORDER BY event_at, sample_id) - 1 < floor(count(*) OVER () * CAST(0.8 AS DOUBLE)) THEN 'train' ELSE 'validation' END AS part FROM samples", SV)
def _(spark, d):
    return R.time_ordered_split(samples(spark, d)).select("sample_id", "part")


@query("user_split", "SELECT sample_id, CASE WHEN try_cast(split_part(subject, ':', -1) AS INTEGER) < 14 THEN 'train' ELSE 'validation' END AS part FROM samples", SV)
def _(spark, d):
    return R.user_split(samples(spark, d)).select("sample_id", "part")


@query("training_batch_export", """SELECT sample_id, array_to_string(history, ',') || repeat(',', CAST(20 - len(history) AS BIGINT)) AS history, repeat('1', CAST(len(history) AS BIGINT)) || repeat('0', CAST(20 - len(history) AS BIGINT)) AS mask,
  positive || ',' || array_to_string(negatives, ',') AS candidates, 0 AS label FROM samples""", SV)
def _(spark, d):
    t = R.training_batch_export(samples(spark, d))
    return t.select("sample_id", F.array_join("history", ",").alias("history"), F.array_join(F.transform("history_mask", lambda x: x.cast("string")), "").alias("mask"),
                    F.array_join("candidates", ",").alias("candidates"), "label")


@query("db_readiness", """SELECT (SELECT count(*) FROM samples) AS replay_samples, count(*) AS articles, count(embedding) AS articles_with_vector, round(count(embedding) / CAST(count(*) AS DOUBLE), 6) AS coverage,
  CAST((SELECT count(*) FROM samples) >= 100 AS INTEGER) AS enough_for_initial_conclusion FROM meta""", SV)
def _(spark, d):
    return r6(R.db_readiness(samples(spark, d), V.articles(spark, d), V.article_vectors(spark, d)), "coverage")


@query("read_article_meta", "SELECT article_id, category, published_at, trust_score, CASE WHEN embedding IS NULL THEN 0 ELSE len(embedding) END AS dim FROM meta", SV)
def _(spark, d):
    return meta(spark, d).select("article_id", "category", "published_at", "trust_score", F.when(F.col("embedding").isNull(), 0).otherwise(F.size("embedding")).alias("dim"))


@query("read_interactions", "SELECT count(*) AS n FROM pos0", SV)
def _(spark, d):
    return SM.actions(V.event_log(spark, d), V.feedback(spark, d), V.article_vectors(spark, d))[1].agg(F.count("*").alias("n"))


# ---- weight search -----------------------------------------------------------------------

def catalog(spark, d):
    return R.catalog_features(V.articles(spark, d), V.article_vectors(spark, d))


@query("catalog_features", "SELECT article_id, category, round(trust, 6) AS trust, round(freshness, 6) AS freshness FROM catalog2", SV)
def _(spark, d):
    return r6(catalog(spark, d), "trust", "freshness").select("article_id", "category", "trust", "freshness")


@query("global_freshness", "SELECT DISTINCT published_at, round(freshness, 6) AS freshness FROM catalog2", SV)
def _(spark, d):
    return r6(R.global_freshness(meta(spark, d).where("embedding is not null")), "freshness")


C6 = ("semantic", "interest", "trust", "freshness")


@query("candidate_components", "SELECT sample_id, cpos, " + ", ".join(f"round({c}, 6) AS {c}" for c in C6) + " FROM comps", SV)
def _(spark, d):
    return r6(R.candidate_components(samples(spark, d), catalog(spark, d)), *C6).select("sample_id", "cpos", *C6)


def _groups(s, spark, d):
    return s.join(V.articles(spark, d).select(F.col("article_id").alias("positive"), "category"), "positive").select(
        "sample_id", F.coalesce("category", F.lit("unknown")).alias("persona"))


WV = {**SV,
    "wgrid": "SELECT a / CAST(10 AS DOUBLE) AS w0, b / CAST(10 AS DOUBLE) AS w1, c / CAST(10 AS DOUBLE) AS w2, (10 - a - b - c) / CAST(10 AS DOUBLE) AS w3 FROM (SELECT unnest(range(0, 11)) AS a), (SELECT unnest(range(0, 11)) AS b), (SELECT unnest(range(0, 11)) AS c) WHERE a + b + c <= 10",
    "wsc": "SELECT w0, w1, w2, w3, sample_id, cpos, trust_value, row_number() OVER (PARTITION BY w0, w1, w2, w3, sample_id ORDER BY round(semantic * w0 + interest * w1 + trust * w2 + freshness * w3, 9) DESC, article_id DESC) AS rank FROM comps, wgrid",
    "wrank": """SELECT w.w0, w.w1, w.w2, w.w3, w.sample_id, m.category AS persona, max(CASE WHEN cpos = 0 THEN rank END) AS rank, count(*) FILTER (rank <= 3 AND trust_value < 0.4) AS low, count(*) FILTER (rank <= 3) AS shown
      FROM wsc w JOIN samples s ON s.sample_id = w.sample_id JOIN meta m ON m.article_id = s.positive GROUP BY ALL""",
    "wgroup": "SELECT w0, w1, w2, w3, persona, count(*) AS n, sum(CASE WHEN rank <= 3 THEN 1.0 ELSE 0.0 END) AS hits, sum(1 / CAST(rank AS DOUBLE)) AS rr, sum(CASE WHEN rank <= 3 THEN 1 / log2(rank + 1) ELSE 0 END) AS gain, sum(low) AS low, sum(shown) AS shown FROM wrank GROUP BY ALL",
    "wmetric": "SELECT w0, w1, w2, w3, CAST(sum(n) AS BIGINT) AS n, sum(hits) / sum(n) AS hit_rate, sum(rr) / sum(n) AS mrr, sum(gain) / sum(n) AS ndcg, avg(gain / n) AS macro_persona_ndcg, min(gain / n) AS worst_persona_ndcg, sum(low) / CAST(sum(shown) AS DOUBLE) AS low_trust_topk_rate FROM wgroup GROUP BY ALL"}
M6 = ("hit_rate", "mrr", "ndcg", "macro_persona_ndcg", "worst_persona_ndcg", "low_trust_topk_rate")
_M6 = ", ".join(f"round({c}, 6) AS {c}" for c in M6)


def _weights(spark, d):
    s = samples(spark, d)
    return R.weight_metrics(R.candidate_components(s, catalog(spark, d)), _groups(s, spark, d))


@query("weights_cross_join", f"SELECT w0, w1, w2, w3, n, {_M6} FROM wmetric", WV)
def _(spark, d):
    return r6(_weights(spark, d), *M6).select("w.*", "n", *M6)


@query("persona_macro_metrics", f"SELECT n, {_M6} FROM wmetric WHERE w0 = 0.1 AND w1 = 0.6 AND w2 = 0.1", WV)
def _(spark, d):
    s = samples(spark, d)
    m = R.weight_metrics(R.candidate_components(s, catalog(spark, d)), _groups(s, spark, d), [tuple(K.RERANK_WEIGHTS)])
    return r6(m, *M6).select("n", *M6)


@query("best_weights", "SELECT w0, w1, w2, w3, n FROM wmetric ORDER BY round(macro_persona_ndcg, 9) DESC, round(mrr, 9) DESC, w0 DESC, w1 DESC, w2 DESC, w3 DESC LIMIT 1", WV)
def _(spark, d):
    return R.best_weights(_weights(spark, d)).select("w.*", "n")


def _side(part):
    return f"""SELECT w0, w1, w2, w3, CAST(sum(n) AS BIGINT) AS n, sum(hits) / sum(n) AS hit_rate, sum(rr) / sum(n) AS mrr, sum(gain) / sum(n) AS ndcg, avg(gain / n) AS macro_persona_ndcg, min(gain / n) AS worst_persona_ndcg, sum(low) / CAST(sum(shown) AS DOUBLE) AS low_trust_topk_rate
      FROM (SELECT w0, w1, w2, w3, persona, count(*) AS n, sum(CASE WHEN rank <= 3 THEN 1.0 ELSE 0.0 END) AS hits, sum(1 / CAST(rank AS DOUBLE)) AS rr, sum(CASE WHEN rank <= 3 THEN 1 / log2(rank + 1) ELSE 0 END) AS gain, sum(low) AS low, sum(shown) AS shown
      FROM wrank JOIN wparts USING (sample_id) WHERE part = '{part}' GROUP BY ALL) GROUP BY ALL"""


@query("weight_grid_search", f"SELECT variant, n, {_M6} FROM wvalid JOIN wnamed ON w0 = a AND w1 = b AND w2 = c AND w3 = d", {**WV,
    "wparts": "SELECT sample_id, CASE WHEN try_cast(split_part(subject, ':', -1) AS INTEGER) < 14 THEN 'train' ELSE 'validation' END AS part FROM samples",
    "wtrain": _side("train"), "wvalid": _side("validation"),
    "wbest": "SELECT w0, w1, w2, w3 FROM wtrain ORDER BY round(macro_persona_ndcg, 9) DESC, round(mrr, 9) DESC, w0 DESC, w1 DESC, w2 DESC, w3 DESC LIMIT 1",
    "wnamed": " UNION ALL ".join(f"SELECT '{n}' AS variant, " + ", ".join(f"CAST({x} AS DOUBLE) AS {c}" for x, c in zip(w, "abcd")) for n, w in (
        ("semantic_only", (1, 0, 0, 0)), ("category_only", (0, 1, 0, 0)), ("deployment_candidate", K.RERANK_WEIGHTS))) + " UNION ALL SELECT 'selected_hybrid', w0, w1, w2, w3 FROM wbest"})
def _(spark, d):
    s = R.user_split(samples(spark, d))
    comp, groups = write_once(R.candidate_components(s, catalog(spark, d)), "components"), _groups(s, spark, d)
    side = lambda p: comp.join(s.where(F.col("part") == p).select("sample_id"), "sample_id", "left_semi")
    return r6(R.weight_grid_search(side("train"), side("validation"), groups), *M6).select("variant", "n", *M6)


@query("seed_summary", """SELECT count(*) AS seeds, round(avg(latest), 6) AS latest, round(avg(hybrid), 6) AS hybrid, round(avg(hybrid) / avg(latest) - 1, 6) AS relative_gain FROM (
  SELECT split_part(sample_id, '|', 1) AS subject, avg(CASE WHEN strategy = 'latest' THEN 1 / CAST(rank AS DOUBLE) END) AS latest, avg(CASE WHEN strategy = 'hybrid' THEN 1 / CAST(rank AS DOUBLE) END) AS hybrid FROM ranked_all WHERE cpos = 0 GROUP BY 1)""", SV)
def _(spark, d):
    s, m, r = rows(spark, d)
    r = write_once(r, "rows")  # ranked twice
    both = R.rank_latest(r).unionByName(R.rank_hybrid(r, R.sample_category_weights(s, m))).where("cpos = 0")
    mrr = lambda n: F.avg(F.when(F.col("strategy") == n, 1.0 / F.col("rank"))).alias(n)
    per = both.groupBy(F.split("sample_id", r"\|")[0].alias("subject")).agg(mrr("latest"), mrr("hybrid"))
    return r6(R.seed_summary(per, "latest", "hybrid"), "latest", "hybrid", "relative_gain")


# ---- embedding spaces ----------------------------------------------------------------------

def spaces(spark, d):
    return R.vector_spaces(V.article_vectors(spark, d), V.learned_vectors(spark, d), V.chunks(spark, d))


@query("read_vector_spaces", "SELECT 'raw' AS space, count(*) AS n FROM article_vectors UNION ALL SELECT 'learned', count(*) FROM learned_vectors UNION ALL SELECT 'chunks', count(*) FROM chunks")
def _(spark, d):
    a, b, c = (df.agg(F.lit(n).alias("space"), F.count("*").alias("n")) for n, df in zip(("raw", "learned", "chunks"), spaces(spark, d)))
    return a.unionByName(b).unionByName(c)


@query("cosine_summary", "SELECT count(*) AS paired_articles, round(avg(c), 6) AS mean_cosine, round(quantile_cont(c, 0.5), 6) AS median_cosine FROM (SELECT list_cosine_similarity(embedding, learned_embedding) AS c FROM article_vectors a JOIN learned_vectors l ON a.article_id = l.article_id)")
def _(spark, d):
    raw, learned, _ = spaces(spark, d)
    return r6(R.cosine_summary(raw, learned), "mean_cosine", "median_cosine")


@query("max_chunk_similarity", "SELECT query_id, article_id, max(s) AS score FROM (SELECT query_id, article_id, round(list_cosine_similarity(query_vector, embedding), 9) AS s FROM search_queries, chunks WHERE query_vector IS NOT NULL) WHERE s >= 0.5 GROUP BY 1, 2")
def _(spark, d):
    c = V.chunks(spark, d)
    q = V.search_queries(spark, d).select(F.col("query_id").alias("qid"), F.col("query_vector").alias("qvec"))
    hits = all_chunks_index(spark, d).within(q, 0.5)
    return hits.join(c.select(F.col("chunk_id").alias("cid"), "article_id"), "cid").groupBy(F.col("qid").alias("query_id"), "article_id").agg(F.max("score").alias("score"))


def _retrieval_sql(space, col):
    return f"""SELECT count(*) AS n, round(avg(CASE WHEN rank = 1 THEN 1.0 ELSE 0.0 END), 6) AS top1, round(avg(CASE WHEN rank <= 5 THEN 1.0 ELSE 0.0 END), 6) AS top5, round(avg(1 / CAST(rank AS DOUBLE)), 6) AS mrr FROM (
      SELECT qid, cid, row_number() OVER (PARTITION BY qid ORDER BY s DESC, cid DESC) AS rank FROM (SELECT q.article_id AS qid, c.article_id AS cid, max(round(list_cosine_similarity(q.{col}, c.embedding), 9)) AS s FROM {space} q, chunks c GROUP BY 1, 2)) WHERE qid = cid"""


def _retrieval(spark, d, which):
    raw, learned, chunks = spaces(spark, d)
    q = raw.withColumnRenamed("embedding", "vector") if which == "raw" else learned.withColumnRenamed("learned_embedding", "vector")
    return r6(R.retrieval_metrics(R.self_retrieval_ranks(q, chunks, all_chunks_index(spark, d))), "top1", "top5", "mrr")


@query("retrieval_metrics", _retrieval_sql("article_vectors", "embedding"))
def _(spark, d):
    return _retrieval(spark, d, "raw")


_PAIRED = "SELECT count(*) AS paired_articles, round(avg(c), 6) AS mean_cosine, round(quantile_cont(c, 0.5), 6) AS median_cosine FROM (SELECT list_cosine_similarity(embedding, learned_embedding) AS c FROM article_vectors a JOIN learned_vectors l ON a.article_id = l.article_id)"


@query("embedding_alignment", f"""SELECT space, ranked, top1, top5, mrr, paired_articles, mean_cosine, median_cosine FROM (
  SELECT 'raw' AS space, n AS ranked, top1, top5, mrr FROM ({_retrieval_sql("article_vectors", "embedding")})
  UNION ALL SELECT 'learned', n, top1, top5, mrr FROM ({_retrieval_sql("learned_vectors", "learned_embedding")})), ({_PAIRED})""")
def _(spark, d):
    return r6(R.embedding_alignment(*spaces(spark, d), all_chunks_index(spark, d)), "top1", "top5", "mrr", "mean_cosine", "median_cosine")


def _mixed(space):
    return f"""SELECT strategy, {METRICS} FROM (SELECT '{space}' AS strategy, sample_id, cpos, row_number() OVER (PARTITION BY sample_id ORDER BY score DESC, article_id DESC) AS rank FROM (
      SELECT c.sample_id, c.cpos, c.article_id, {cosd('profile', 'embedding')} AS score FROM cands c JOIN article_vectors v ON v.article_id = c.article_id JOIN {space}_prof p ON p.sample_id = c.sample_id)) WHERE cpos = 0 GROUP BY 1"""


MV = {**SV, **{f"{n}_prof": f"SELECT sample_id, list(x ORDER BY i) AS profile FROM (SELECT sample_id, i, sum(power(0.5, age / CAST(5 AS DOUBLE)) * u[i]) AS x FROM hist_rows h JOIN (SELECT article_id, list_transform({c}, lambda x: x / sqrt(list_dot_product({c}, {c}))) AS u FROM {t}) z ON z.article_id = h.article_id, (SELECT unnest(range(1, 65)) AS i) GROUP BY 1, 2) GROUP BY 1"
               for n, c, t in (("raw", "embedding", "article_vectors"), ("mixed", "learned_embedding", "learned_vectors"))}}


@query("mixed_profile_replay", _mixed("raw") + " UNION ALL " + _mixed("mixed"), MV)
def _(spark, d):
    s = samples(spark, d)
    raw, learned, _ = spaces(spark, d)
    return metrics6(R.mixed_profile_replay(s, raw, learned, False).unionByName(R.mixed_profile_replay(s, raw, learned, True)))


@query("pairwise_auc_recall", """SELECT round(sum(below) / CAST(sum(n) AS DOUBLE), 6) AS auc, round(avg(CASE WHEN above < 2 THEN 1.0 ELSE 0.0 END), 6) AS recall_at_k FROM (
  SELECT r.sample_id, count(*) FILTER (r.cosine < p.cosine) AS below, count(*) FILTER (r.cosine > p.cosine) AS above, count(*) AS n FROM rows_ r JOIN rows_ p ON p.sample_id = r.sample_id AND p.cpos = 0 WHERE r.cpos > 0 GROUP BY 1)""", SV)
def _(spark, d):
    r = rows(spark, d)[2].select("sample_id", "cpos", F.col("cosine").alias("score"))
    return r6(R.pairwise_auc_recall(r, 2), "auc", "recall_at_k")
