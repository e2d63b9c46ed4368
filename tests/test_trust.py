import itertools

import pytest
from pyspark.sql import functions as F

from pressgrid import constants as K
from pressgrid.functions import trust_expr as X
from pressgrid.plans import trust as T


def plain_score(c, w):
    raw = 0.0
    for s, x in zip(c, w):
        raw = raw + s * x
    top = 0.0
    for x in w:
        top = top + (x if x > 0 else 0.0)
    score = raw / (top * 10) * 100
    if c[2] < 4 and c[1] < 4:
        score -= 10.0
    if c[1] < 4:
        score = min(score, 69.0)
    return int(max(0, min(100, score)))


def score_all(spark, rows):
    df = spark.createDataFrame(rows, "a int, b int, c int, d int, e int")
    return [r[0] for r in df.select(X.trust_score([F.col(x) for x in "abcde"])).collect()]


@pytest.mark.parametrize("criteria,want", [((10, 10, 10, 10, 0), 100), ((10, 3, 10, 10, 0), 69), ((3, 3, 3, 3, 10), 0),
                                           ((0, 4, 5, 9, 1), 39), ((4, 4, 4, 8, 7), 29)])
def test_known_scores(spark, criteria, want):
    assert score_all(spark, [criteria]) == [want]


def test_score_equals_plain_arithmetic(spark):
    rows = list(itertools.product(range(0, 11, 2), range(0, 11), range(0, 11, 2), range(0, 11, 3), range(0, 11, 5)))
    assert score_all(spark, rows) == [plain_score(r, K.WEIGHT_SETS["W2"]) for r in rows]


def test_missing_criterion_has_no_score(spark):
    assert score_all(spark, [(None, 1, 1, 1, 1)]) == [None]


def test_verdict_borders(spark):
    df = spark.createDataFrame([(70,), (69,), (40,), (39,), (None,)], "s int")
    assert [r[0] for r in df.select(X.verdict(F.col("s"))).collect()] == ["likely_true", "uncertain", "uncertain", "likely_false", "unanalyzed"]


def test_predicates(spark):
    cases = [["yes"] * 3, ["uncertain"] * 3, ["no", "uncertain", "uncertain"], []]
    df = spark.createDataFrame([([(a, "") for a in c],) for c in cases], "x array<struct<answer:string,reason:string>>")
    assert [r[0] for r in df.select(X.predicate_score(F.col("x"))["score"]).collect()] == [10, 3, 1, 5]


def test_source_rule(spark):
    names = ["연합뉴스", "조선일보 경제", "등록되지않은매체", "미상", "", None]
    df = spark.createDataFrame([(n,) for n in names], "s string")
    assert [r[0] for r in df.select(X.source_score(F.col("s"))["score"]).collect()] == [10, 8, 5, 5, 5, 5]


def test_auc_on_quartile_labels(spark):
    df = spark.createDataFrame([(float(i + 1), l) for i, l in enumerate([0.0, 0.25, 0.5, 0.75, 1.0])], "score double, label double")
    row = T.extreme_auc(df).first()
    assert (row["extreme_n"], row["extreme_auc"]) == (4, 1.0)


def test_invariant_pairs(spark):
    per = lambda *s: {c: {"score": v, "reason": ""} for c, v in zip(K.CRITERIA, s)}
    cache = spark.createDataFrame([("P1", "a", per(10, 10, 6, 10, 0)), ("P1", "a_prime", per(5, 10, 6, 10, 3)),
                                   ("P9", "a", per(10, 3, 7, 7, 3)), ("P2", "a", per(1, 1, 1, 1, 1))],
                                  "pair_id string, side string, per_criteria map<string,struct<score:int,reason:string>>")
    pairs = spark.createDataFrame([("P1", "pair", "s", "a_gt_a_prime", None), ("P9", "single", "s", None, [40, 69]), ("P2", "pair", "s", None, None)],
                                  "pair_id string, type string, signal string, expected string, expected_range array<int>")
    results = T.pair_results(cache, pairs)
    rows = {r["variant"]: r for r in T.invariant_pass_rate(results).collect()}
    assert len(rows) == 5 and all(r["cases"] == 2 and r["passed"] == 2 for r in rows.values())
    assert T.invariant_failures(results).count() == 0
    turned = pairs.withColumn("expected", F.when(F.col("pair_id") == "P1", "a_prime_gt_a"))
    failed = T.invariant_failures(T.pair_results(cache, turned)).collect()
    assert failed and {r["pair_id"] for r in failed} == {"P1"} and len(failed) == 5
