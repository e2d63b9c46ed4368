"""Trust jobs: scoring, re-weighting, invariant pairs and label evaluation."""
from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame, functions as F

from .. import constants as K
from ..functions import trust_expr as X
from ..operators import ordering as O
from ..session import write_once

ANSWERED = K.CRITERIA[1:]


def score_trust_table(answers: DataFrame) -> DataFrame:
    """One scored row per article from the source rule and four answered criteria.

    One narrow projection, no shuffle.  A row without answers is a failed analysis: null
    score and criteria, verdict 'unanalyzed'.
    """
    failed = F.greatest(*[F.col(c).isNull() for c in ANSWERED])
    parts = {"source_credibility": X.source_score(F.col("source"))}
    parts.update({c: X.predicate_score(F.col(c)) for c in ANSWERED})
    rows = answers.withColumns({f"_{c}": v for c, v in parts.items()}).withColumn("_failed", failed)
    empty = F.struct(F.lit(None).cast("int").alias("score"), F.lit(K.FAILED_REASON).alias("reason"))
    cell = lambda c: F.when(F.col("_failed"), empty).otherwise(F.col(f"_{c}"))
    score = F.when(~F.col("_failed"), X.trust_score([F.col(f"_{c}.score") for c in K.CRITERIA]))
    given = F.col("reason") if "reason" in answers.columns else F.lit("")
    return rows.withColumn("score", score).select(
        "article_id", "score", X.verdict(F.col("score")).alias("verdict"),
        F.when(F.col("_failed"), F.lit(K.FAILURE_PREFIX)).otherwise(F.coalesce(given, F.lit(""))).alias("reason"),
        F.create_map(*[v for c in K.CRITERIA for v in (F.lit(c), cell(c))]).alias("per_criteria"),
        F.struct((F.char_length("full_text") < K.SHORT_ARTICLE_CHARS).alias("short_article")).alias("flags"))


def criterion_scores(per_criteria: Column) -> list[Column]:
    return [F.element_at(per_criteria, c)["score"] for c in K.CRITERIA]


def reweight(rows: DataFrame, weights: list[float] = K.WEIGHT_SETS[K.PRODUCTION_WEIGHTS]) -> DataFrame:
    """Score again from stored criteria."""
    return rows.withColumn("score", X.weighted_score(criterion_scores(F.col("per_criteria")), weights))


def _constant_rows(rows: list[Column]) -> Column:
    return F.explode(F.array(*rows))


def with_weight_sets(rows: DataFrame, sets: dict[str, list[float]] = K.WEIGHT_SETS) -> DataFrame:
    """Every row once per weight set: a constant fan-out inside the row, no join."""
    options = [F.struct(F.lit(n).alias("variant"), *[F.lit(float(x)).alias(f"w{i}") for i, x in enumerate(w)])
               for n, w in sets.items()]
    out = rows.withColumn("_w", _constant_rows(options))
    weights = [F.col(f"_w.w{i}") for i in range(5)]
    score = X.weighted_score(criterion_scores(F.col("per_criteria")), weights)
    return out.withColumns({"variant": F.col("_w.variant"), "score": score}).drop("_w")


def overlay_cache(cache: DataFrame, newer: DataFrame) -> DataFrame:
    """The newer cache wins per (pair_id, side)."""
    both = cache.withColumn("_p", F.lit(0)).unionByName(newer.withColumn("_p", F.lit(1)))
    last = F.max_by(F.struct(*cache.columns), "_p").alias("r")
    return both.groupBy("pair_id", "side").agg(last).select("r.*")


def pair_results(cache: DataFrame, pairs: DataFrame, sets: dict[str, list[float]] = K.WEIGHT_SETS) -> DataFrame:
    """Pass or fail and margin of every pair and range case under every weight set.

    Pairs need both sides in the cache, single cases only side 'a'.
    """
    scored = with_weight_sets(cache, sets).select("pair_id", "side", "variant", "score")
    sides = scored.groupBy("pair_id", "variant").agg(F.max(F.when(F.col("side") == "a", F.col("score"))).alias("score_a"),
                                                     F.max(F.when(F.col("side") == "a_prime", F.col("score"))).alias("score_a_prime"))
    rows = pairs.select("pair_id", F.col("type").alias("case_type"), "signal", "expected", "expected_range").join(sides, "pair_id")
    is_pair = F.col("case_type") == "pair"
    forward = F.coalesce(F.col("expected"), F.lit("a_gt_a_prime")) == "a_gt_a_prime"
    gap = F.col("score_a") - F.col("score_a_prime")
    low = F.coalesce(F.get("expected_range", F.lit(0)), F.lit(0))
    high = F.coalesce(F.get("expected_range", F.lit(1)), F.lit(100))
    margin = F.when(is_pair, F.when(forward, gap).otherwise(-gap)).otherwise(
        F.least(F.col("score_a") - low, high - F.col("score_a")))
    rows = rows.where(F.col("score_a").isNotNull() & (~is_pair | F.col("score_a_prime").isNotNull()))
    return rows.select("variant", "pair_id", "case_type", "signal", "score_a",
                       F.when(is_pair, F.col("score_a_prime")).alias("score_a_prime"), margin.alias("margin"),
                       F.when(is_pair, margin > 0).otherwise(margin >= 0).alias("passed"))


def invariant_pass_rate(results: DataFrame) -> DataFrame:
    """Cases, passes, rate and pair margins per weight set; the failed ones are rows of invariant_failures()."""
    pair = F.when(F.col("case_type") == "pair", F.col("margin"))
    ok = F.col("passed").cast("int")
    return results.groupBy("variant").agg(F.count("*").alias("cases"), F.sum(ok).alias("passed"), F.avg(ok.cast("double")).alias("pass_rate"),
                                          F.avg(pair).alias("mean_pair_margin"), F.min(pair).alias("min_pair_margin"))


def invariant_failures(results: DataFrame) -> DataFrame:
    """(variant, pair_id, case_type, signal, margin) of every failed case."""
    return results.where(~F.col("passed")).select("variant", "pair_id", "case_type", "signal", "margin")


# ---- evaluation against labels -----------------------------------------------------------

def _cells(rows: DataFrame, score: str, label: str, by: list[str]) -> DataFrame:
    """Counts of distinct (group, score, label) values, combined map-side and written once.

    Rows that stand for several (column n_rows) count as many.

    Everything after this works on the distinct values only.
    """
    return write_once(rows.where(F.col(score).isNotNull() & F.col(label).isNotNull())
                       .groupBy(*by, F.col(score).cast("double").alias("s"), F.col(label).cast("double").alias("l"))
                       .agg((F.sum("n_rows") if "n_rows" in rows.columns else F.count("*")).alias("n")))


def _spearman(cells: DataFrame, by: list[str]) -> DataFrame:
    rs = O.average_ranks(cells, by, "s", "n").withColumnRenamed("avg_rank", "rs")
    rl = O.average_ranks(cells, by, "l", "n").withColumnRenamed("avg_rank", "rl")
    j = cells.join(rs, [*by, "s"]).join(rl, [*by, "l"])
    w = F.col("n")
    total = lambda c: F.sum(w * c)
    sums = j.groupBy(*by).agg(F.sum("n").alias("n"), total(F.col("rs")).alias("x"), total(F.col("rl")).alias("y"),
                              total(F.col("rs") * F.col("rl")).alias("xy"), total(F.col("rs") ** 2).alias("xx"),
                              total(F.col("rl") ** 2).alias("yy"))
    cov = F.col("xy") - F.col("x") * F.col("y") / F.col("n")
    vx, vy = (F.col(f"{c}{c}") - F.col(c) * F.col(c) / F.col("n") for c in "xy")
    return sums.select(*by, "n", F.when((vx > 1e-9) & (vy > 1e-9), cov / F.sqrt(vx * vy)).alias("spearman_rho"))


def _auc(cells: DataFrame, by: list[str]) -> DataFrame:
    l = F.col("l")
    ext = cells.where((l <= 0.25) | (l >= 0.75)).groupBy(*by, "s").agg(
        F.sum("n").alias("n"), F.sum(F.when(l >= 0.75, F.col("n")).otherwise(0)).alias("pos"))
    ranks = O.average_ranks(ext, by, "s", "n")
    g = ext.join(ranks, [*by, "s"]).groupBy(*by).agg(
        F.sum("n").alias("extreme_n"), F.sum("pos").alias("p"), F.sum(F.col("pos") * F.col("avg_rank")).alias("rank_sum"))
    p, neg = F.col("p"), F.col("extreme_n") - F.col("p")
    auc = F.when((p > 0) & (neg > 0), (F.col("rank_sum") - p * (p + 1) / 2) / (p * neg))
    return g.select(*by, "extreme_n", auc.alias("extreme_auc"))


def spearman(rows: DataFrame, score: str = "score", label: str = "label", by: list[str] = ()) -> DataFrame:
    """Pearson correlation of average ranks (nulls dropped), one row per group."""
    by = list(by)
    return _spearman(_cells(rows, score, label, by), by)


def extreme_auc(rows: DataFrame, score: str = "score", label: str = "label", by: list[str] = ()) -> DataFrame:
    """Rank-sum AUC over the rows with an extreme label (<= 0.25 or >= 0.75); null when one side is missing."""
    by = list(by)
    return _auc(_cells(rows, score, label, by), by)


def rank_metrics(rows: DataFrame, score: str = "score", label: str = "label", by: list[str] = ()) -> DataFrame:
    """n, extreme_n, Spearman and AUC per group."""
    by = list(by)
    cells = _cells(rows, score, label, by)
    s, a = _spearman(cells, by), _auc(cells, by)
    if by:
        return s.join(a, by, "left")
    return s.withColumn("_o", F.lit(1)).join(a.withColumn("_o", F.lit(1)), "_o", "left").drop("_o")


def binary_metrics(rows: DataFrame, threshold: int = 70) -> DataFrame:
    """Accuracy, precision, recall, F1, AUC and class means at a score threshold, over extreme labels."""
    valid = rows.where("score is not null and label is not null")
    l = F.col("label")
    y, pred = l >= 0.75, F.col("score") >= threshold
    ext = valid.where((l <= 0.25) | (l >= 0.75))
    hits = lambda c: F.coalesce(F.sum(c.cast("bigint")), F.lit(0))
    m = ext.agg(F.count("*").alias("n_extreme"), hits(y & pred).alias("tp"), hits(~y & ~pred).alias("tn"),
                hits(~y & pred).alias("fp"), hits(y & ~pred).alias("fn"),
                F.avg(F.when(y, F.col("score"))).alias("high_label_mean"), F.avg(F.when(~y, F.col("score"))).alias("low_label_mean"))
    div = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    tp, tn, fp, fn = (F.col(c) for c in ("tp", "tn", "fp", "fn"))
    m = m.withColumns({"accuracy": div(tp + tn, F.col("n_extreme")), "precision": div(tp, tp + fp), "recall": div(tp, tp + fn)})
    p, r = F.col("precision"), F.col("recall")
    m = m.withColumn("f1", div(2 * p * r, p + r)).withColumn("_o", F.lit(1))
    ranks = rank_metrics(valid).select(F.col("n").alias("n_valid"), F.col("extreme_auc").alias("roc_auc"), "spearman_rho",
                                       F.lit(1).alias("_o"))
    return m.join(ranks, "_o").drop("_o")


def label_group_means(rows: DataFrame) -> DataFrame:
    """Mean score of the trusted and of the distrusted rows."""
    return rows.where("score is not null and label in (0, 1)").groupBy("label").agg(F.avg("score").alias("mean_score"),
                                                                                   F.count("*").alias("n"))


def verdict_confusion(rows: DataFrame) -> DataFrame:
    """Counts of label >= 0.75 against verdict 'likely_true'."""
    actual = F.when(F.col("label") >= 0.75, "trusted").otherwise("other")
    said = F.when(F.col("verdict") == "likely_true", "said_true").otherwise("said_other")
    return (rows.select(actual.alias("actual"), said.alias("said")).groupBy("actual").pivot("said", ["said_true", "said_other"])
            .count().na.fill(0))


def clickbait_report(rows: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support of 'clickbait score above 5' as a detector of label 0."""
    per = rows.where("clickbait is not null and label is not null").select((F.col("label") == 0).alias("y"), (F.col("clickbait") > 5).alias("p"))
    hit = lambda c: F.sum(c.cast("bigint"))
    y, p = F.col("y"), F.col("p")
    m = per.agg(hit(y & p).alias("tp"), hit(~y & p).alias("fp"), hit(y & ~p).alias("fn"), hit(~y & ~p).alias("tn"))
    rows_ = F.inline(F.array(
        F.struct(F.lit("clickbait").alias("class"), F.col("tp").alias("a"), F.col("fp").alias("b"), F.col("fn").alias("c")),
        F.struct(F.lit("trusted").alias("class"), F.col("tn").alias("a"), F.col("fn").alias("b"), F.col("fp").alias("c"))))
    div = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    out = m.select(rows_).withColumns({"precision": div(F.col("a"), F.col("a") + F.col("b")),
                                       "recall": div(F.col("a"), F.col("a") + F.col("c"))})
    pr, rc = F.col("precision"), F.col("recall")
    return out.select("class", "precision", "recall", div(2 * pr * rc, pr + rc).alias("f1"), (F.col("a") + F.col("c")).alias("support"))


def criteria_distribution(rows: DataFrame) -> DataFrame:
    """Five-number summary per criterion.  Scores are 0..10, so the percentile state stays tiny."""
    cells = rows.select(F.explode("per_criteria").alias("criterion", "cell")).where("cell.score is not null")
    q = cells.groupBy("criterion").agg(F.percentile("cell.score", F.array(*[F.lit(x) for x in (0.0, 0.25, 0.5, 0.75, 1.0)])).alias("q"))
    return q.select("criterion", *[F.col("q")[i].alias(n) for i, n in enumerate(["min", "q1", "median", "q3", "max"])])


def failure_rate(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count("*").alias("requested"), F.avg(F.col("score").isNull().cast("double")).alias("failure_rate"))


def latency_percentile(rows: DataFrame, column: str, q: float) -> DataFrame:
    """Nearest-rank percentile: the ceil(q * n)-th value."""
    counts = rows.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("double").alias("v")).agg(F.count("*").alias("n"))
    run = O.running_total(write_once(counts), [], "v", "n")
    total = run.agg(F.max("upto").alias("all")).withColumn("_o", F.lit(1))
    reached = run.withColumn("_o", F.lit(1)).join(F.broadcast(total), "_o").where(F.col("upto") >= F.greatest(F.ceil(F.col("all") * q), F.lit(1)))
    return reached.agg(F.min("v").alias("value"))


# ---- blending with fact scores -----------------------------------------------------------

ALPHAS = [i / 10 for i in range(11)]


def with_alphas(rows: DataFrame, base: str = "base_score", fact: str = "fact_score") -> DataFrame:
    """Every row once per blend weight 0.0 .. 1.0 (constant fan-out)."""
    out = rows.withColumn("alpha", F.explode(F.array(*[F.lit(a) for a in ALPHAS])))
    # Rounded so that equal blends stay equal: ties decide the ranks.
    mix = F.round((1 - F.col("alpha")) * F.col(base) + F.col("alpha") * F.col(fact), 9)
    return out.withColumn("blend", mix)


def _counted(rows: DataFrame, by: list[str] = ()) -> DataFrame:
    """Distinct (by, label, base, fact) cells with n_rows: the fan-outs copy cells, not rows."""
    return rows.groupBy(*by, "label", "base_score", "fact_score").agg(F.count("*").alias("n_rows"))


def blend_sweep(rows: DataFrame) -> DataFrame:
    return rank_metrics(with_alphas(_counted(rows)), "blend", "label", ["alpha"])


def stratified_folds(rows: DataFrame, folds: int = 5) -> DataFrame:
    """Position inside the label, in row order, modulo the fold count."""
    return O.positions(write_once(rows), ["label"], "row_idx", "_pos").withColumn("fold", (F.col("_pos") % folds).cast("int")).drop("_pos")


def blend_cross_validation(folded: DataFrame, folds: int = 5) -> tuple[DataFrame, DataFrame]:
    """(chosen alpha per fold, held-out predictions).

    Per fold: among the alphas whose AUC on the other folds is not below the base, the best
    Spearman, the smaller alpha on ties.
    """
    blended = with_alphas(folded)
    train = with_alphas(_counted(folded, ["fold"])).withColumn("held", F.explode(F.array(*[F.lit(i) for i in range(folds)]))).where("held <> fold")
    m = rank_metrics(train, "blend", "label", ["held", "alpha"])
    base = m.where("alpha = 0").select("held", F.col("extreme_auc").alias("base_auc"))
    ok = m.join(base, "held").where("extreme_auc is null or base_auc is null or extreme_auc >= base_auc")
    best = F.max_by("alpha", F.struct(F.round(F.col("spearman_rho"), 9), -F.col("alpha"))).alias("alpha")
    chosen = ok.groupBy("held").agg(best).select(F.col("held").alias("fold"), "alpha")
    held_out = blended.join(F.broadcast(chosen), ["fold", "alpha"]).withColumnRenamed("blend", "prediction")
    return chosen, held_out


def gold_weight_grid(rows: DataFrame, grid: dict[str, list[float]] = K.GOLD_GRID) -> DataFrame:
    """Share of rows whose verdict equals the gold label, per weight combination."""
    combos = list(product(*[grid[c] for c in K.CRITERIA]))
    options = [F.struct(F.lit(i).alias("combo"), *[F.lit(float(x)).alias(f"w{j}") for j, x in enumerate(w)])
               for i, w in enumerate(combos)]
    cells = rows.select(*[F.col(c).cast("int") for c in ("c0", "c1", "c2", "c3", "c4")], "gold").groupBy(
        "c0", "c1", "c2", "c3", "c4", "gold").agg(F.count("*").alias("n"))
    fan = cells.withColumn("_w", _constant_rows(options))
    score = X.weighted_score([F.col(f"c{i}") for i in range(5)], [F.col(f"_w.w{i}") for i in range(5)])
    said = F.when(score >= K.VERDICT_TRUE_FROM, "true").when(score >= K.VERDICT_UNCERTAIN_FROM, "uncertain").otherwise("false")
    agree = F.sum(F.when(said == F.col("gold"), F.col("n")).otherwise(0)) / F.sum("n")
    return fan.groupBy(*[F.col(f"_w.w{j}").alias(c) for j, c in enumerate(K.CRITERIA)]).agg(agree.alias("agreement"))
