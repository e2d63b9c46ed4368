"""Vector expressions on ``array<double>`` columns."""
from __future__ import annotations

from pyspark.sql import Column, functions as F


def as_double(vector: Column) -> Column:
    return vector.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x))


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once per row, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _over_norms(a: Column, b: Column, otherwise) -> Column:
    norms = F.struct(norm(a).alias("a"), norm(b).alias("b"), dot(a, b).alias("d"))
    return let(norms, lambda n: F.when((n["a"] > 0) & (n["b"] > 0), n["d"] / (n["a"] * n["b"])).otherwise(otherwise))


def cosine(a: Column, b: Column) -> Column:
    """Cosine; 0 when a side has no length (replay rule), null when a side is missing."""
    return F.when(a.isNotNull() & b.isNotNull(), _over_norms(a, b, F.lit(0.0)))


def cosine_or_null(a: Column, b: Column) -> Column:
    """Cosine; null when a side has no length (search rule: such rows are dropped)."""
    return _over_norms(a, b, F.lit(None).cast("double"))


def l2_normalize(a: Column) -> Column:
    """Unit vector; a zero vector stays zero."""
    return let(norm(a), lambda n: F.when(n > 0, F.transform(a, lambda x: x / n)).otherwise(a))


def has_length(a: Column) -> Column:
    return F.coalesce(F.exists(a, lambda x: x != 0), F.lit(False))


def blend_vectors(primary: Column, secondary: Column, weight: float) -> Column:
    """Weighted mix; the other side alone when one of them is all zero or missing."""
    mixed = F.zip_with(primary, secondary, lambda p, s: p * weight + s * (1.0 - weight))
    return F.when(~has_length(secondary), primary).when(~has_length(primary), secondary).otherwise(mixed)


def parse_vector(text: Column, dim: int) -> Column:
    """Vector from its text form, padded with zeros or cut to ``dim``; null when unreadable or empty."""
    parsed = F.from_json(text, "array<double>")
    usable = F.size(parsed) > 0
    clean = F.when(usable & ~F.exists(parsed, lambda x: x.isNull()), parsed)
    return F.slice(F.concat(clean, F.array_repeat(F.lit(0.0), dim)), 1, dim)


def format_vector(a: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(F.transform(a, lambda x: F.format_string("%.6f", x)), ","), F.lit("]"))


def one_hot(code: Column, size: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), size - 1), lambda i: (i == code).cast("double"))
