"""Trust scoring expressions.  Sums run left to right in double arithmetic, then truncate."""
from __future__ import annotations

from pyspark.sql import Column, functions as F

from .. import constants as K
from .vectors import let


def predicate_value(answer: Column) -> Column:
    a = F.lower(F.coalesce(answer, F.lit("")))
    return F.when(a == "yes", K.ANSWER_YES).when(a == "no", K.ANSWER_NO).otherwise(K.ANSWER_OTHER)


def clamp(value: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), value))


def predicate_score(answers: Column, is_negative: bool = False) -> Column:
    """struct(score, reason) of an array<struct<answer, reason>>; no answers give 5."""
    total = F.aggregate(answers, F.lit(0.0), lambda s, a: s + predicate_value(a["answer"]))
    ratio = total / F.size(answers)
    if is_negative:
        ratio = F.lit(1.0) - ratio
    score = clamp((ratio * 10).cast("int"), 0, 10)
    reasons = F.filter(F.transform(answers, lambda a: a["reason"]), lambda r: F.coalesce(r != "", F.lit(False)))
    reason = F.array_join(F.slice(reasons, 1, 2), " / ")
    missing = answers.isNull() | (F.size(answers) == 0)
    return F.when(missing, F.struct(F.lit(5).alias("score"), F.lit(K.NO_ANSWER_REASON).alias("reason"))).otherwise(
        F.struct(score.cast("int").alias("score"), reason.alias("reason")))


def parse_criterion(item: Column) -> Column:
    """struct(score, reason, parse_failed) of a stored {score, reason} variant."""
    is_object = F.coalesce(F.startswith(F.schema_of_variant(item), F.lit("OBJECT")), F.lit(False))
    score = F.try_variant_get(item, "$.score", "double")
    bounded = clamp(F.coalesce(score.try_cast("int"), F.lit(0)), 0, 10).cast("int")
    reason = F.coalesce(F.try_variant_get(item, "$.reason", "string"), F.lit(""))
    return F.struct(F.when(is_object, bounded).otherwise(0).alias("score"),
                    F.when(is_object, reason).otherwise("").alias("reason"), (~is_object).alias("parse_failed"))


def weighted_score(scores: list[Column], weights: list[Column] | list[float]) -> Column:
    """0-100 score: weighted sum over the largest reachable sum, cross penalty, evidence cap, truncation.

    Null when a criterion has no score.
    """
    as_col = lambda w: w if isinstance(w, Column) else F.lit(float(w))
    w = [as_col(x) for x in weights]
    top = F.lit(0.0)
    for x in w:
        top = top + F.when(x > 0, x).otherwise(F.lit(0.0))

    def body(c):
        raw = c["s0"] * w[0]
        for i in range(1, 5):
            raw = raw + c[f"s{i}"] * w[i]
        penalty = F.when((c["s2"] < 4) & (c["s1"] < 4), 10.0).otherwise(0.0)
        cap = F.when(c["s1"] < 4, 69.0).otherwise(100.0)
        score = F.greatest(F.lit(0.0), F.least(cap, raw / (top * 10) * 100 - penalty)).cast("int")
        known = c["s0"].isNotNull()
        for i in range(1, 5):
            known = known & c[f"s{i}"].isNotNull()
        return F.when(known, score)

    return let(F.struct(*[s.alias(f"s{i}") for i, s in enumerate(scores)]), body)


def trust_score(scores: list[Column]) -> Column:
    return weighted_score(scores, K.WEIGHT_SETS[K.PRODUCTION_WEIGHTS])


def verdict(score: Column) -> Column:
    return (F.when(score.isNull(), "unanalyzed").when(score >= K.VERDICT_TRUE_FROM, "likely_true")
            .when(score >= K.VERDICT_UNCERTAIN_FROM, "uncertain").otherwise("likely_false"))


def source_score(source: Column) -> Column:
    """struct(score, reason): exact tier match, then contained name (highest tier first), else neutral.

    The tier table is a constant of about thirty names, so it is matched with array
    expressions instead of a join.
    """
    s = F.coalesce(source, F.lit(""))
    reply = lambda score, reason: F.struct(F.lit(score).cast("int").alias("score"), reason.alias("reason"))
    out = F.when((s == "") | (s == K.UNKNOWN_SOURCE), reply(K.SOURCE_DEFAULT, F.lit(K.SOURCE_REASON_UNKNOWN)))
    for tier, names in K.SOURCE_TIERS.items():
        out = out.when(s.isin(names), reply(tier, F.concat(F.lit(K.SOURCE_REASON_EXACT), s)))
    for tier, names in K.SOURCE_TIERS.items():
        listed = F.array(*[F.lit(n) for n in sorted(names)])
        hit = F.get(F.filter(listed, lambda n: F.contains(s, n)), F.lit(0))
        out = out.when(hit.isNotNull(), reply(tier, F.concat(F.lit(K.SOURCE_REASON_PARTIAL), hit)))
    unlisted = F.concat(F.lit(K.SOURCE_REASON_UNLISTED_HEAD), s, F.lit(K.SOURCE_REASON_UNLISTED_TAIL))
    return out.otherwise(reply(K.SOURCE_DEFAULT, unlisted))
