"""Queries: trust scoring and its evaluation."""
from __future__ import annotations

from pyspark.sql import functions as F

from .. import constants as K
from ..functions import payload as P, trust_expr as X
from ..operators import ordering as O
from ..plans import trust as T
from ..sources import views as V
from .oracle_views import TIER_REASON_SQL, TIER_SQL, lst, score_sql
from .registry import query

DBL = "CAST({0} AS DOUBLE)"


def scored(spark, d):
    return T.score_trust_table(V.answers(spark, d))


def flat(df):
    return df.select("article_id", "score", "verdict", *[F.element_at("per_criteria", c)["score"].alias(f"c{i}") for i, c in enumerate(K.CRITERIA)])


@query("source_score", f"SELECT article_id, {TIER_SQL} AS score, {TIER_REASON_SQL} AS reason FROM articles")
def _(spark, d):
    return V.articles(spark, d).select("article_id", X.source_score(F.col("source")).alias("s")).select("article_id", "s.score", "s.reason")


@query("predicate_score", "SELECT article_id, CASE WHEN failed THEN 5 ELSE c1 END AS evidence, CASE WHEN failed THEN 5 ELSE c3 END AS logic FROM criteria")
def _(spark, d):
    p = lambda c: X.predicate_score(F.col(c))["score"]
    return V.answers(spark, d).select("article_id", p("evidence_support").alias("evidence"), p("logical_consistency").alias("logic"))


@query("criterion_parse", """SELECT article_id, CASE i % 4 WHEN 0 THEN CAST(least(i % 14, 10) AS INTEGER) WHEN 1 THEN CAST((i % 11) AS INTEGER) ELSE 0 END AS score,
  CASE WHEN i % 4 < 3 THEN 'r' || i ELSE '' END AS reason, CASE WHEN i % 4 < 3 THEN 0 ELSE 1 END AS failed FROM (SELECT article_id, CAST(article_id AS BIGINT) AS i FROM articles)""")
def _(spark, d):
    i = F.col("article_id").cast("bigint")
    raw = (F.when(i % 4 == 0, F.concat(F.lit('{"score": '), i % 14, F.lit(', "reason": "r'), i, F.lit('"}')))
           .when(i % 4 == 1, F.concat(F.lit('{"score": "'), i % 11, F.lit('.7", "reason": "r'), i, F.lit('"}')))
           .when(i % 4 == 2, F.concat(F.lit('{"score": "bad", "reason": "r'), i, F.lit('"}'))).otherwise(F.lit('"text"')))
    return V.articles(spark, d).select("article_id", X.parse_criterion(F.parse_json(raw)).alias("p")).select(
        "article_id", "p.score", "p.reason", F.col("p.parse_failed").cast("int").alias("failed"))


@query("score_trust_table", "SELECT article_id, score, verdict, c0, c1, c2, c3, c4, CAST(length(full_text) < 300 AS INTEGER) AS short FROM trust_rows")
def _(spark, d):
    s = scored(spark, d)
    return flat(s).join(s.select("article_id", F.col("flags.short_article").cast("int").alias("short")), "article_id")


@query("trust_score", "SELECT score, verdict, count(*) AS n FROM trust_rows GROUP BY 1, 2")
def _(spark, d):
    return scored(spark, d).groupBy("score", "verdict").agg(F.count("*").alias("n"))


@query("trust_verdict", "SELECT verdict, count(*) AS n FROM trust_rows GROUP BY 1")
def _(spark, d):
    return scored(spark, d).groupBy("verdict").agg(F.count("*").alias("n"))


@query("trust_failure_row", f"SELECT article_id, score, verdict, '{K.FAILURE_PREFIX}' AS reason FROM trust_rows WHERE failed")
def _(spark, d):
    return scored(spark, d).where("verdict = 'unanalyzed'").select("article_id", "score", "verdict", "reason")


@query("criteria_radar", "SELECT article_id, coalesce(c0, 0) AS source, coalesce(c1, 0) AS evidence, coalesce(c2, 0) AS style, coalesce(c3, 0) AS logic, 10 - coalesce(c4, 0) AS clickbait FROM trust_rows")
def _(spark, d):
    c = lambda i: F.coalesce(F.element_at("per_criteria", K.CRITERIA[i])["score"], F.lit(0))
    return scored(spark, d).select("article_id", c(0).alias("source"), c(1).alias("evidence"), c(2).alias("style"), c(3).alias("logic"),
                                   (10 - c(4)).alias("clickbait"))


def _variants():
    return " UNION ALL ".join(f"SELECT article_id, '{n}' AS variant, {score_sql(w)} AS score FROM trust_rows WHERE NOT failed" for n, w in K.WEIGHT_SETS.items())


@query("reweight", f"SELECT article_id, {score_sql(K.WEIGHT_SETS['W3'])} AS score FROM trust_rows WHERE NOT failed")
def _(spark, d):
    return T.reweight(scored(spark, d).where("score is not null"), K.WEIGHT_SETS["W3"]).select("article_id", "score")


@query("variant_cross_join", _variants())
def _(spark, d):
    return T.with_weight_sets(scored(spark, d).where("score is not null")).select("article_id", "variant", "score")


# Invariant cases: neighbouring articles form a pair, every ninth pair is a single range case.
def _cache(spark, d):
    i = F.col("article_id").cast("bigint")
    return scored(spark, d).where("score is not null").select(
        F.concat(F.lit("P"), F.floor(i / 2)).alias("pair_id"), F.when(i % 2 == 0, "a").otherwise("a_prime").alias("side"),
        "score", "verdict", "per_criteria")


def _pairs(spark, d):
    i = F.floor(F.col("article_id").cast("bigint") / 2)
    return (V.articles(spark, d).where(F.col("article_id").cast("bigint") % 2 == 0).select(
        F.concat(F.lit("P"), i).alias("pair_id"), F.when(i % 9 == 8, "single").otherwise("pair").alias("type"),
        F.concat(F.lit("signal "), i % 5).alias("signal"), F.when(i % 3 == 0, "a_prime_gt_a").otherwise("a_gt_a_prime").alias("expected"),
        F.when(i % 9 == 8, F.array(F.lit(40), F.lit(69))).alias("expected_range")))


PAIR_VIEWS = {
    "variants": _variants(),
    "cache": "SELECT 'P' || (CAST(article_id AS BIGINT) // 2) AS pair_id, CAST(article_id AS BIGINT) % 2 = 0 AS is_a, variant, score, CAST(article_id AS BIGINT) // 2 AS i FROM variants",
    "pair_rows": """SELECT variant, pair_id, case_type, signal, score_a, CASE WHEN case_type = 'pair' THEN score_b END AS score_a_prime, margin,
      CASE WHEN case_type = 'pair' THEN CAST(margin > 0 AS INTEGER) ELSE CAST(margin >= 0 AS INTEGER) END AS passed FROM (
      SELECT *, CASE WHEN case_type = 'single' THEN least(score_a - 40, 69 - score_a) WHEN i % 3 = 0 THEN score_b - score_a ELSE score_a - score_b END AS margin FROM (
        SELECT a.variant, a.pair_id, a.i, CASE WHEN a.i % 9 = 8 THEN 'single' ELSE 'pair' END AS case_type, 'signal ' || (a.i % 5) AS signal, a.score AS score_a, b.score AS score_b
        FROM (SELECT * FROM cache WHERE is_a) a LEFT JOIN (SELECT * FROM cache WHERE NOT is_a) b ON a.pair_id = b.pair_id AND a.variant = b.variant)
      WHERE case_type = 'single' OR score_b IS NOT NULL)""",
}


def _results(spark, d):
    return T.pair_results(_cache(spark, d), _pairs(spark, d))


@query("weight_sensitivity", "SELECT * FROM pair_rows", PAIR_VIEWS)
def _(spark, d):
    return _results(spark, d).withColumn("passed", F.col("passed").cast("int"))


@query("pair_side_join", "SELECT pair_id, score_a, score_a_prime FROM pair_rows WHERE variant = 'W2' AND case_type = 'pair'", PAIR_VIEWS)
def _(spark, d):
    return T.pair_results(_cache(spark, d), _pairs(spark, d), {"W2": K.WEIGHT_SETS["W2"]}).where("case_type = 'pair'").select("pair_id", "score_a", "score_a_prime")


@query("invariant_pass_rate", """SELECT variant, count(*) AS cases, CAST(sum(passed) AS BIGINT) AS passed, round(avg(passed), 6) AS pass_rate,
  round(avg(CASE WHEN case_type = 'pair' THEN margin END), 6) AS mean_pair_margin, min(CASE WHEN case_type = 'pair' THEN margin END) AS min_pair_margin FROM pair_rows GROUP BY variant""", PAIR_VIEWS)
def _(spark, d):
    r = T.invariant_pass_rate(_results(spark, d))
    return r.withColumns({c: F.round(c, 6) for c in ("pass_rate", "mean_pair_margin")})


@query("invariant_failures", "SELECT variant, pair_id, case_type, signal, margin FROM pair_rows WHERE passed = 0", PAIR_VIEWS)
def _(spark, d):
    return T.invariant_failures(_results(spark, d))


@query("cache_overlay", """SELECT pair_id, CASE WHEN is_a THEN 'a' ELSE 'a_prime' END AS side, CASE WHEN i % 4 = 1 THEN 100 - score ELSE score END AS score FROM cache WHERE variant = 'W2'""", PAIR_VIEWS)
def _(spark, d):
    c = _cache(spark, d)
    newer = c.where(F.substring("pair_id", 2, 20).cast("bigint") % 4 == 1).withColumn("score", 100 - F.col("score"))
    return T.overlay_cache(c, newer).select("pair_id", "side", "score")


# ---- labels --------------------------------------------------------------------------

def labelled(spark, d):
    s = flat(scored(spark, d)).withColumnRenamed("c4", "clickbait")
    return s.join(V.labels(spark, d), "article_id")


LABELLED = {"lab": "SELECT t.article_id, t.score, t.verdict, t.c4, l.label FROM trust_rows t JOIN label_rows l ON t.article_id = l.article_id"}
AVG_RANK = "rank() OVER ({0} ORDER BY {1}) + (count(*) OVER ({2}) - 1) / CAST(2 AS DOUBLE)"


def rank_sql(value: str, by: str = "") -> str:
    part = f"PARTITION BY {by} " if by else ""
    tie = f"PARTITION BY {by + ', ' if by else ''}{value}"
    return AVG_RANK.format(part, value, tie)


RANK_VIEWS = {**LABELLED,
    "ranked": f"SELECT *, {rank_sql('score')} AS rs, {rank_sql('label')} AS rl FROM lab WHERE score IS NOT NULL",
    "ext": f"SELECT *, {rank_sql('score')} AS r FROM lab WHERE score IS NOT NULL AND (label <= 0.25 OR label >= 0.75)"}
AUC_SQL = "(sum(CASE WHEN label >= 0.75 THEN r ELSE 0 END) - count(*) FILTER (label >= 0.75) * (count(*) FILTER (label >= 0.75) + 1) / CAST(2 AS DOUBLE)) / (count(*) FILTER (label >= 0.75) * count(*) FILTER (label < 0.75))"


@query("label_eval", "SELECT article_id, score, verdict, label FROM lab", LABELLED)
def _(spark, d):
    return labelled(spark, d).select("article_id", "score", "verdict", "label")


@query("spearman", "SELECT count(*) AS n, round(corr(rs, rl), 6) AS spearman_rho FROM ranked", RANK_VIEWS)
def _(spark, d):
    return T.spearman(labelled(spark, d)).withColumn("spearman_rho", F.round("spearman_rho", 6))


@query("average_rank", "SELECT DISTINCT score, rs AS avg_rank FROM ranked", RANK_VIEWS)
def _(spark, d):
    rows = labelled(spark, d).where("score is not null").groupBy("score").agg(F.count("*").alias("n"))
    return O.average_ranks(rows, [], "score", "n")


@query("extreme_auc", f"SELECT count(*) AS extreme_n, round({AUC_SQL}, 6) AS extreme_auc FROM ext", RANK_VIEWS)
def _(spark, d):
    return T.extreme_auc(labelled(spark, d)).withColumn("extreme_auc", F.round("extreme_auc", 6))


@query("binary_metrics", f"""SELECT n_extreme, tp, tn, fp, fn, round((tp + tn) / CAST(n_extreme AS DOUBLE), 6) AS accuracy, coalesce(round(tp / CAST(nullif(tp + fp, 0) AS DOUBLE), 6), 0) AS "precision",
  coalesce(round(tp / CAST(nullif(tp + fn, 0) AS DOUBLE), 6), 0) AS recall, coalesce(round(2 * tp / CAST(nullif(2 * tp + fp + fn, 0) AS DOUBLE), 6), 0) AS f1,
  round(hi, 6) AS high_label_mean, round(lo, 6) AS low_label_mean, n_valid, round(auc, 6) AS roc_auc, round(rho, 6) AS spearman_rho FROM
  (SELECT count(*) AS n_extreme, count(*) FILTER (label >= 0.75 AND score >= 70) AS tp, count(*) FILTER (label < 0.75 AND score < 70) AS tn, count(*) FILTER (label < 0.75 AND score >= 70) AS fp,
    count(*) FILTER (label >= 0.75 AND score < 70) AS fn, avg(CASE WHEN label >= 0.75 THEN score END) AS hi, avg(CASE WHEN label < 0.75 THEN score END) AS lo, {AUC_SQL} AS auc FROM ext),
  (SELECT count(*) AS n_valid, corr(rs, rl) AS rho FROM ranked)""", RANK_VIEWS)
def _(spark, d):
    m = T.binary_metrics(labelled(spark, d))
    return m.withColumns({c: F.round(c, 6) for c in ("accuracy", "precision", "recall", "f1", "high_label_mean", "low_label_mean", "roc_auc", "spearman_rho")})


@query("label_group_means", "SELECT label, round(avg(score), 6) AS mean_score, count(*) AS n FROM lab WHERE score IS NOT NULL AND label IN (0, 1) GROUP BY label", LABELLED)
def _(spark, d):
    return T.label_group_means(labelled(spark, d)).withColumn("mean_score", F.round("mean_score", 6))


@query("verdict_confusion", "SELECT CASE WHEN label >= 0.75 THEN 'trusted' ELSE 'other' END AS actual, count(*) FILTER (verdict = 'likely_true') AS said_true, count(*) FILTER (verdict <> 'likely_true') AS said_other FROM lab GROUP BY 1", LABELLED)
def _(spark, d):
    return T.verdict_confusion(labelled(spark, d))


@query("clickbait_report", """SELECT class, round(CASE WHEN a + b > 0 THEN a / CAST(a + b AS DOUBLE) ELSE 0 END, 6) AS "precision", round(CASE WHEN a + c > 0 THEN a / CAST(a + c AS DOUBLE) ELSE 0 END, 6) AS recall,
  round(CASE WHEN 2 * a + b + c > 0 AND a > 0 THEN 2 * a / CAST(2 * a + b + c AS DOUBLE) ELSE 0 END, 6) AS f1, a + c AS support FROM (
  SELECT 'clickbait' AS class, count(*) FILTER (label = 0 AND c4 > 5) AS a, count(*) FILTER (label <> 0 AND c4 > 5) AS b, count(*) FILTER (label = 0 AND c4 <= 5) AS c FROM lab
  UNION ALL SELECT 'trusted', count(*) FILTER (label <> 0 AND c4 <= 5), count(*) FILTER (label = 0 AND c4 <= 5), count(*) FILTER (label <> 0 AND c4 > 5) FROM lab)""", LABELLED)
def _(spark, d):
    return T.clickbait_report(labelled(spark, d)).withColumns({c: F.round(c, 6) for c in ("precision", "recall", "f1")})


@query("criteria_distribution", " UNION ALL ".join(f"SELECT '{c}' AS criterion, CAST(min(c{i}) AS DOUBLE) AS min, quantile_cont(CAST(c{i} AS DOUBLE), 0.25) AS q1, quantile_cont(CAST(c{i} AS DOUBLE), 0.5) AS median, quantile_cont(CAST(c{i} AS DOUBLE), 0.75) AS q3, CAST(max(c{i}) AS DOUBLE) AS max FROM trust_rows" for i, c in enumerate(K.CRITERIA)))
def _(spark, d):
    return T.criteria_distribution(scored(spark, d))


@query("live_eval_failure_rate", "SELECT count(*) AS requested, round(avg(CASE WHEN score IS NULL THEN 1.0 ELSE 0.0 END), 6) AS failure_rate FROM trust_rows")
def _(spark, d):
    return T.failure_rate(scored(spark, d)).withColumn("failure_rate", F.round("failure_rate", 6))


@query("latency_percentile_nearest_rank", "SELECT value FROM (SELECT value, row_number() OVER (ORDER BY value) AS n, count(*) OVER () AS total FROM events) WHERE n = ceil(0.95 * total)")
def _(spark, d):
    return T.latency_percentile(V.table(spark, d, "events"), "value", 0.95)


# ---- grounding -----------------------------------------------------------------------

def grounded(spark, d):
    i = F.col("article_id").cast("bigint")
    rows = labelled(spark, d).where("score is not null")
    return rows.select("article_id", "label", F.col("score").cast("double").alias("base_score"),
                       (((i * 3 + 1) % 11) * 10).cast("double").alias("fact_score"), i.alias("row_idx"))


_A = "[0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]"
GROUND = {**LABELLED,
    "grounded": "SELECT article_id, label, CAST(score AS DOUBLE) AS base_score, CAST(((CAST(article_id AS BIGINT) * 3 + 1) % 11) * 10 AS DOUBLE) AS fact_score, CAST(article_id AS BIGINT) AS row_idx FROM lab WHERE score IS NOT NULL",
    "blended": f"SELECT g.*, a.alpha, round((1 - a.alpha) * base_score + a.alpha * fact_score, 9) AS blend FROM grounded g, (SELECT CAST(unnest({_A}) AS DOUBLE) AS alpha) a",
    "sweep_rho": f"SELECT alpha, count(*) AS n, corr(rs, rl) AS rho FROM (SELECT *, {rank_sql('blend', 'alpha')} AS rs, {rank_sql('label', 'alpha')} AS rl FROM blended) GROUP BY alpha",
    "sweep_auc": f"SELECT alpha, count(*) AS extreme_n, {AUC_SQL} AS auc FROM (SELECT *, {rank_sql('blend', 'alpha')} AS r FROM blended WHERE label <= 0.25 OR label >= 0.75) GROUP BY alpha",
    "folded": "SELECT *, CAST((row_number() OVER (PARTITION BY label ORDER BY row_idx) - 1) % 5 AS INTEGER) AS fold FROM grounded",
    "train": f"SELECT f.*, a.alpha, h.held, round((1 - a.alpha) * base_score + a.alpha * fact_score, 9) AS blend FROM folded f, (SELECT CAST(unnest({_A}) AS DOUBLE) AS alpha) a, (SELECT unnest([0, 1, 2, 3, 4]) AS held) h WHERE held <> fold",
    "train_rho": f"SELECT held, alpha, corr(rs, rl) AS rho FROM (SELECT *, {rank_sql('blend', 'held, alpha')} AS rs, {rank_sql('label', 'held, alpha')} AS rl FROM train) GROUP BY held, alpha",
    "train_auc": f"SELECT held, alpha, {AUC_SQL} AS auc FROM (SELECT *, {rank_sql('blend', 'held, alpha')} AS r FROM train WHERE label <= 0.25 OR label >= 0.75) GROUP BY held, alpha",
    "chosen": """SELECT fold, alpha FROM (SELECT r.held AS fold, r.alpha, row_number() OVER (PARTITION BY r.held ORDER BY round(r.rho, 9) DESC NULLS LAST, r.alpha) AS n
      FROM train_rho r JOIN train_auc a ON r.held = a.held AND r.alpha = a.alpha JOIN train_auc b ON b.held = r.held AND b.alpha = 0 WHERE a.auc IS NULL OR b.auc IS NULL OR a.auc >= b.auc) WHERE n = 1"""}


@query("grounded_base_join", "SELECT article_id, label, base_score, fact_score FROM grounded", GROUND)
def _(spark, d):
    return grounded(spark, d).drop("row_idx")


@query("stratified_fold", "SELECT article_id, label, fold FROM folded", GROUND)
def _(spark, d):
    return T.stratified_folds(grounded(spark, d)).select("article_id", "label", "fold")


@query("blend_sweep", "SELECT r.alpha, r.n, round(r.rho, 6) AS spearman_rho, a.extreme_n, round(a.auc, 6) AS extreme_auc FROM sweep_rho r JOIN sweep_auc a ON r.alpha = a.alpha", GROUND)
def _(spark, d):
    return T.blend_sweep(grounded(spark, d)).withColumns({c: F.round(c, 6) for c in ("spearman_rho", "extreme_auc")})


@query("blend_cross_validation", "SELECT f.article_id, f.fold, c.alpha, round((1 - c.alpha) * base_score + c.alpha * fact_score, 6) AS prediction FROM folded f JOIN chosen c ON f.fold = c.fold", GROUND)
def _(spark, d):
    _, held_out = T.blend_cross_validation(T.stratified_folds(grounded(spark, d)))
    return held_out.select("article_id", "fold", "alpha", F.round("prediction", 6).alias("prediction"))


@query("blend_out_of_fold", f"""SELECT n, round(rho, 6) AS spearman_rho, extreme_n, round(auc, 6) AS extreme_auc FROM
  (SELECT count(*) AS n, corr(rs, rl) AS rho FROM (SELECT {rank_sql('score')} AS rs, {rank_sql('label')} AS rl FROM held_rows)),
  (SELECT count(*) AS extreme_n, {AUC_SQL} AS auc FROM (SELECT *, {rank_sql('score')} AS r FROM held_rows WHERE label <= 0.25 OR label >= 0.75))""",
       {**GROUND, "held_rows": "SELECT f.label, round((1 - c.alpha) * base_score + c.alpha * fact_score, 9) AS score FROM folded f JOIN chosen c ON f.fold = c.fold"})
def _(spark, d):
    _, held_out = T.blend_cross_validation(T.stratified_folds(grounded(spark, d)))
    return T.rank_metrics(held_out, "prediction", "label").withColumns({c: F.round(c, 6) for c in ("spearman_rho", "extreme_auc")})


@query("gold_weight_grid", f"""SELECT w.source_credibility, w.evidence_support, w.style_neutrality, w.logical_consistency, w.clickbait_risk,
  round(avg(CASE WHEN (CASE WHEN s >= 70 THEN 'true' WHEN s >= 40 THEN 'uncertain' ELSE 'false' END) = gold THEN 1.0 ELSE 0.0 END), 6) AS agreement FROM (
  SELECT w.*, gold, CAST(trunc(greatest(0.0, least(100.0, CASE WHEN c1 < 4 THEN least(b2, 69.0) ELSE b2 END))) AS INTEGER) AS s FROM (
    SELECT *, CASE WHEN c1 < 4 AND c2 < 4 THEN b1 - 10 ELSE b1 END AS b2 FROM (
      SELECT *, (c0 * source_credibility + c1 * evidence_support + c2 * style_neutrality + c3 * logical_consistency + c4 * clickbait_risk) / ((CAST(0.0 AS DOUBLE) + source_credibility + evidence_support + style_neutrality + logical_consistency) * 10) * 100 AS b1
      FROM gold_rows, grid)) w) w GROUP BY 1, 2, 3, 4, 5""",
       {"gold_rows": "SELECT c0, c1, c2, c3, c4, CASE WHEN label >= 0.75 THEN 'true' WHEN label > 0.25 THEN 'uncertain' ELSE 'false' END AS gold FROM trust_rows t JOIN label_rows l ON t.article_id = l.article_id WHERE NOT failed",
        "grid": "SELECT " + ", ".join(f"CAST({c}_ AS DOUBLE) AS {c}" for c in K.CRITERIA) + " FROM " + ", ".join(f"(SELECT unnest({K.GOLD_GRID[c]}) AS {c}_)" for c in K.CRITERIA)})
def _(spark, d):
    rows = flat(scored(spark, d)).where("score is not null").join(V.labels(spark, d), "article_id")
    gold = F.when(F.col("label") >= 0.75, "true").when(F.col("label") > 0.25, "uncertain").otherwise("false")
    return T.gold_weight_grid(rows.withColumn("gold", gold)).withColumn("agreement", F.round("agreement", 6))


# ---- model answer texts --------------------------------------------------------------

@query("llm_json_clean", """SELECT article_id, CASE WHEN i % 5 < 4 THEN 's' || i END AS summary, CASE WHEN i % 5 < 4 THEN CAST(i AS BIGINT) END AS n FROM (SELECT article_id, CAST(article_id AS BIGINT) AS i FROM articles)""")
def _(spark, d):
    i = F.col("article_id").cast("bigint")
    body = F.concat(F.lit('{"summary": "s'), i, F.lit('", "n": '), i, F.lit("}"))
    raw = (F.when(i % 5 == 0, body).when(i % 5 == 1, F.concat(F.lit("```json\n"), body, F.lit("\n```")))
           .when(i % 5 == 2, F.concat(F.lit("Answer: "), body, F.lit(" done"))).when(i % 5 == 3, F.concat(F.lit("```\n\n"), body, F.lit("```")))
           .otherwise(F.lit("no json {")))
    v = V.articles(spark, d).select("article_id", P.loose_json(raw).alias("v"))
    return v.select("article_id", F.try_variant_get("v", "$.summary", "string").alias("summary"), F.try_variant_get("v", "$.n", "bigint").alias("n"))


@query("summary_keywords_parse", f"""SELECT article_id, CASE i % 4 WHEN 0 THEN 's' || i WHEN 1 THEN 's' || i WHEN 2 THEN '{K.SUMMARY_FAILED}' END AS summary,
  CASE i % 4 WHEN 0 THEN '["a > b","c"]' WHEN 1 THEN '["x","y"]' WHEN 2 THEN '[]' END AS keywords FROM (SELECT article_id, CAST(article_id AS BIGINT) AS i FROM articles)""")
def _(spark, d):
    i = F.col("article_id").cast("bigint")
    raw = (F.when(i % 4 == 0, F.concat(F.lit('```json\n{"summary": "s'), i, F.lit('", "keywords": ["a > b", "c"]}\n```')))
           .when(i % 4 == 1, F.concat(F.lit('{"summary": "s'), i, F.lit('", "keywords": "x, y"}')))
           .when(i % 4 == 2, F.lit('{"summary": ["no"], "keywords": null}')).otherwise(F.lit("broken")))
    return V.articles(spark, d).select("article_id", P.summary_answer(raw, K.SUMMARY_FAILED).alias("s")).select("article_id", "s.summary", "s.keywords")


@query("grounding_parse", """SELECT article_id, CASE WHEN i % 3 < 2 THEN CAST(i % 11 AS INTEGER) END AS factuality_score, CASE i % 3 WHEN 0 THEN 'mixed' WHEN 1 THEN 'supported' END AS status FROM (SELECT article_id, CAST(article_id AS BIGINT) AS i FROM articles)""")
def _(spark, d):
    i = F.col("article_id").cast("bigint")
    raw = (F.when(i % 3 == 0, F.concat(F.lit('```json\n{"factuality_score": '), i % 11, F.lit(', "status": "mixed", "reason": "r"}\n```')))
           .when(i % 3 == 1, F.concat(F.lit("**사실성 점수**: "), i % 11, F.lit("\n**판단:** Supported\n근거"))).otherwise(F.lit("no idea")))
    return V.articles(spark, d).select("article_id", P.grounding_answer(raw).alias("g")).select("article_id", "g.factuality_score", "g.status")
