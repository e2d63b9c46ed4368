"""JSON payload expressions (variant based) for event and article columns."""
from __future__ import annotations

from pyspark.sql import Column, functions as F

from .vectors import let


def _kind(v: Column) -> Column:
    return F.schema_of_variant(v)


def parse_object(raw: Column) -> Column:
    """Variant of a JSON object; the empty object when missing, unreadable or not an object."""
    return let(F.try_parse_json(raw), lambda v: F.when(F.startswith(_kind(v), F.lit("OBJECT")), v).otherwise(F.parse_json(F.lit("{}"))))


def raw_items(raw: Column) -> Column:
    """array<variant>: ``articles``, else ``article_ids``; the text is read once."""
    def given(v):
        ids = F.try_variant_get(v, "$.article_ids", "array<variant>")
        return let(F.try_variant_get(v, "$.articles", "array<variant>"), lambda articles: F.when(F.size(articles) > 0, articles).otherwise(
            F.coalesce(ids, F.expr("cast(array() as array<variant>)"))))
    return let(parse_object(raw), given)


def item_id(item: Column) -> Column:
    """Id of a shown item given as an object or plain; null for an empty text, zero or false."""
    value = F.when(F.startswith(_kind(item), F.lit("OBJECT")), F.try_variant_get(item, "$.article_id", "variant")).otherwise(item)

    def plain(v):
        falsy = lambda text: (text == "") | ((_kind(v) != "STRING") & text.isin("0", "false"))
        return let(F.try_variant_get(v, "$", "string"), lambda text: F.when(~falsy(text), text))
    return let(value, plain)


def impression_ids(raw: Column) -> Column:
    """array<string> of the shown article ids, in order."""
    return F.filter(F.transform(raw_items(raw), item_id), lambda i: i.isNotNull())


def impression_items(raw: Column) -> Column:
    """array<struct<article_id, position>>; a missing position is the original index."""
    def build(item, idx):
        is_object = F.startswith(_kind(item), F.lit("OBJECT"))
        given = F.try_variant_get(item, "$.position", "int")
        absent = F.try_variant_get(item, "$.position", "string").isNull() & \
            ~F.coalesce(F.contains(F.to_json(item), F.lit('"position":null')), F.lit(False))
        position = F.when(is_object & ~absent, F.coalesce(given, F.lit(0))).otherwise(idx)
        return F.struct(item_id(item).alias("article_id"), position.cast("int").alias("position"))
    return F.filter(F.transform(raw_items(raw), build), lambda s: s["article_id"].isNotNull())


def subject_key(user_id: Column, session_id: Column) -> Column:
    """'user:<id>', else 'session:<id>', else 'session:guest'; an empty text counts as missing."""
    blank = lambda c: F.when(c != "", c)
    return F.coalesce(F.concat(F.lit("user:"), blank(user_id)),
                      F.concat(F.lit("session:"), F.coalesce(blank(session_id), F.lit("guest"))))


def string_items(raw: Column) -> Column:
    """The string elements of a JSON array; empty when it is not an array."""
    items = F.try_variant_get(F.try_parse_json(raw), "$", "array<variant>")
    texts = F.transform(F.filter(items, lambda v: _kind(v) == "STRING"),
                        lambda v: F.try_variant_get(v, "$", "string"))
    return F.coalesce(texts, F.array().cast("array<string>"))


def keyword_leaves(keywords: Column, content_chars: Column) -> Column:
    """Last part of 'a > b > c' keywords: three for a short body, five otherwise."""
    def leaf(kw):
        last = F.trim(F.element_at(F.split(kw, ">"), -1))
        return F.when(last == "", kw).otherwise(last)
    return F.slice(F.transform(string_items(keywords), leaf), F.lit(1),
                   F.when(content_chars < 500, F.lit(3)).otherwise(F.lit(5)))


def needs_keywords(keywords: Column) -> Column:
    """True for missing, blank, '[]', unreadable or more than three keywords."""
    bare = F.trim(keywords)
    v = F.try_parse_json(bare)
    n = F.size(F.try_variant_get(v, "$", "array<variant>"))
    return (keywords.isNull() | (bare == "") | (bare == "[]") | v.isNull() | F.coalesce(n > 3, F.lit(False)))


def loose_json(raw: Column) -> Column:
    """Variant of a model answer: as is, without code fences, or the first {...} block; null otherwise."""
    bare = F.regexp_replace(F.regexp_replace(raw, r"```(?:json)?\s*|\s*```", ""), r"^\s+|\s+$", "")
    block = F.regexp_extract(bare, r"(?s)(\{.*\})", 1)
    return F.coalesce(F.try_parse_json(raw), F.try_parse_json(bare),
                      F.try_parse_json(F.when(block != "", block)))


STATUS_WORDS = "supported|mostly_supported|mixed|mostly_unsupported|unsupported|unverifiable"


def grounding_answer(raw: Column) -> Column:
    """struct(factuality_score, status, reason) from a JSON or markdown answer; null when neither fits."""
    bare = F.regexp_replace(F.regexp_replace(raw, r"^\s+|\s+$", ""), r"^```(?:json)?\s*|\s*```$", "")
    block = F.regexp_extract(bare, r"(?s)(\{.*\})", 1)
    v = F.try_parse_json(F.when(block != "", block))
    plain = F.replace(bare, F.lit("*"), F.lit(""))
    score = F.regexp_extract(plain, r"(?i)(?:사실성\s*점수|factuality_score)\s*[:：]\s*(\d{1,2})", 1)
    status = F.regexp_extract(plain, rf"(?i)(?:판단|status)\s*[:：]\s*({STATUS_WORDS})", 1)
    from_json = F.struct(F.try_variant_get(v, "$.factuality_score", "int").alias("factuality_score"),
                         F.coalesce(F.try_variant_get(v, "$.status", "string"), F.lit("")).alias("status"),
                         F.coalesce(F.try_variant_get(v, "$.reason", "string"), F.lit("")).alias("reason"))
    from_text = F.struct(
        score.try_cast("int").alias("factuality_score"), F.lower(status).alias("status"),
        F.substring(F.regexp_replace(bare, r"\s+", " "), 1, 1000).alias("reason"))
    return F.when(v.isNotNull(), from_json).when((block == "") & (score != "") & (status != ""), from_text)


def summary_answer(raw: Column, failed_text: str) -> Column:
    """struct(summary, keywords JSON text) from the summary step's answer."""
    bare = F.regexp_replace(raw, r"^\s+|\s+$", "")
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(bare, r"^```json", ""), r"^```", ""), r"```$", "")
    v = F.try_parse_json(F.trim(bare))
    summary = F.try_variant_get(v, "$.summary", "variant")
    text = F.when(_kind(summary) == "STRING", F.try_variant_get(v, "$.summary", "string"))
    good = F.when(F.trim(text) != "", text).otherwise(F.lit(failed_text))
    kws = F.try_variant_get(v, "$.keywords", "variant")
    is_list = F.startswith(_kind(kws), F.lit("ARRAY"))
    as_text = F.try_variant_get(v, "$.keywords", "string")
    split = F.to_json(F.transform(F.split(as_text, ","), lambda w: F.trim(w)))
    empty = as_text.isNull() | as_text.isin("", "0", "false")
    keywords = F.when(is_list, F.to_json(kws)).when(empty, F.lit("[]")).otherwise(split)
    return F.when(v.isNotNull(), F.struct(good.alias("summary"), keywords.alias("keywords")))
