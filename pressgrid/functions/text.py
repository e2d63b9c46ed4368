"""Text expressions.  All of them are plain Column expressions that stay in the JVM."""
from __future__ import annotations

from pyspark.sql import Column, functions as F

from .. import constants as K

KO_TOKEN = "[가-힣a-zA-Z0-9]{2,}"
ALNUM_TOKEN = "[가-힣a-zA-Z0-9]+"
WORD = r"[\p{L}\p{N}_]+"


def _find_all(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"({pattern})"), 1)


def tokenize_ko(text: Column) -> Column:
    """Tokens of two or more Hangul/Latin/digit characters; one empty token when there are none."""
    found = _find_all(text, KO_TOKEN)
    return F.when(F.size(found) == 0, F.array(F.lit(""))).otherwise(found)


def word_set(text: Column) -> Column:
    """Distinct words (letters, digits, underscore in any script)."""
    return F.array_distinct(_find_all(text, WORD))


def alnum_set(text: Column) -> Column:
    return F.array_distinct(_find_all(text, ALNUM_TOKEN))


def descending_text(value: Column) -> Column:
    """A key whose ascending order is the descending order of the text: its hex digits mirrored."""
    return F.concat(F.translate(F.hex(value), "0123456789ABCDEF", "FEDCBA9876543210"), F.lit("~"))


def set_jaccard(left: Column, right: Column) -> Column:
    """|intersection| / |union| of two distinct arrays, 0 when both are empty."""
    union = F.size(F.array_union(left, right))
    return F.when(union == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(left, right)) / union)


def jaccard(left: Column, right: Column) -> Column:
    return set_jaccard(word_set(left), word_set(right))


def jaccard_alnum(left: Column, right: Column) -> Column:
    return set_jaccard(alnum_set(left), alnum_set(right))


def collapse_ws(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))


def clean_title(title: Column) -> Column:
    """Drop the full-video mark and bracketed parts, then strip."""
    bare = F.regexp_replace(F.regexp_replace(title, r"\(풀영상\)", ""), r"\[.*?\]", "")
    return F.regexp_replace(bare, r"^\s+|\s+$", "")


def clean_reporter(name: Column) -> Column:
    """First word of the byline without parentheses and without the job title."""
    bare = F.trim(F.replace(F.regexp_replace(F.coalesce(name, F.lit("")), r"\(.*?\)", ""), F.lit("기자")))
    first = F.element_at(F.split(bare, r"\s+"), 1)
    return F.when(bare == "", F.lit(K.UNKNOWN_SOURCE)).otherwise(first)


def reporter_suffix(name: Column) -> Column:
    return F.when(F.contains(name, F.lit("기자")), name).otherwise(F.concat(name, F.lit(" 기자")))


def strip_tags(text: Column) -> Column:
    return F.regexp_replace(text, "<[^>]+>", "")


# The leading patterns removed from stored texts, in order.
LEADING_NOISE = [
    r"^\s*\[제목\]\s*",
    r"^\s*\[.*?\]\s*",
    r"^\s*[가-힣a-zA-Z\s]+(?:일보|신문|뉴스|방송|미디어)\s*(?:=\s*)?",
]


def clean_leading_noise(text: Column, rounds: int = 2) -> Column:
    for pattern in LEADING_NOISE * rounds:
        text = F.regexp_replace(text, pattern, "")
    return text


def parse_news_date(raw: Column) -> Column:
    """Timestamp of a displayed news date, null when it cannot be read."""
    dashed = F.try_to_timestamp(F.trim(F.substring(raw, 1, 16)), F.lit("yyyy-M-d H:m"))
    digits = F.regexp_replace(F.trim(F.regexp_replace(raw, "[^0-9.: ]", "")), " +", " ")
    dotted = F.try_to_timestamp(digits, F.lit("yyyy.M.d. H:m"))
    afternoon = F.contains(raw, F.lit("오후")) & (F.hour(dotted) != 12)
    shifted = F.when(afternoon, dotted + F.expr("INTERVAL 12 HOURS")).otherwise(dotted)
    return F.when(F.contains(raw, F.lit("-")), dashed).otherwise(shifted)


def parse_iso(raw: Column) -> Column:
    """Timestamp of an ISO text (a trailing Z means UTC); null when it cannot be read."""
    shaped = F.when(raw.rlike(r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d{1,6})?)?(Z|[+-]\d{2}:\d{2})?)?$"), raw)
    return F.try_to_timestamp(shaped)


def trim_middle(text: Column, front: int = K.TRIM_FRONT, tail: int = K.TRIM_TAIL) -> Column:
    long = F.char_length(text) > front + tail
    return F.when(long, F.concat(F.substring(text, 1, front), F.lit(K.TRIM_MARK), F.right(text, F.lit(tail)))
                  ).otherwise(text)


def trim_sentences(text: Column, limit: int) -> Column:
    """The first sentences of a text; the whole text when it has no more than ``limit``.

    A sentence can only start at the end of the one before or after a stop mark, which the
    pattern says outright so that long runs without a stop mark are scanned once.
    """
    found = F.regexp_extract_all(text, F.lit(r"((?:\G|(?<=[.!?]))[^.!?]++[.!?]+(?:\s+|\z))"), 1)
    few = (F.size(found) <= limit)
    strip = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    return F.when(few, strip(text)).otherwise(strip(F.array_join(F.slice(found, 1, limit), "")))


_CUT = "\u0001"


def split_sentences(text: Column) -> Column:
    """Sentence pieces line by line: a stop mark, a space, then Hangul or a capital starts a new piece."""
    marked = F.regexp_replace(text, r"([.!?。！？] )(?=[가-힣A-Z])", "$1" + _CUT)
    return F.filter(F.split(marked, "[\n" + _CUT + "]"), lambda s: s != "")


def highlight_words(text: Column) -> Column:
    """Whitespace words reduced to Hangul/Latin/digits, three characters or more, no stop words.

    The characters go in one pass over the text instead of one per word, and only stop words
    long enough to survive the length rule are looked up.
    """
    words = F.split(F.regexp_replace(text, r"[^가-힣a-zA-Z0-9\s]", ""), r"\s+")
    stop = F.array(*[F.lit(w) for w in K.STOP_WORDS if len(w) >= 3])
    return F.filter(words, lambda w: (F.char_length(w) >= 3) & ~F.array_contains(stop, w))


def summary_words(text: Column) -> Column:
    spaced = F.regexp_replace(text, r"[\s,，、。.!?！？\n]+", " ")
    return F.array_distinct(highlight_words(spaced))


def length_bucket(text: Column) -> Column:
    n = F.char_length(text)
    return F.when(n < 500, "short").when(n < 1200, "medium").otherwise("long")


def length_guide(text: Column) -> Column:
    b = length_bucket(text)
    out = F.when(b == "short", K.LENGTH_GUIDES["short"]).when(b == "medium", K.LENGTH_GUIDES["medium"])
    return out.otherwise(K.LENGTH_GUIDES["long"])


def contextual_prefix(title: Column, source: Column, category: Column, chunk: Column) -> Column:
    return F.concat(F.lit("[제목: "), title, F.lit("] [출처: "), source, F.lit("] [카테고리: "), category,
                    F.lit("]\n"), chunk)


def embedding_input_text(title: Column, summary: Column) -> Column:
    return F.concat(F.coalesce(title, F.lit("")), F.lit("\n"), F.coalesce(summary, F.lit("")))


def judge_to_label(judge: Column) -> Column:
    table = F.create_map(*[F.lit(v) for pair in K.JUDGE_LABELS.items() for v in pair])
    return F.coalesce(F.try_element_at(table, F.trim(judge)), F.lit(K.JUDGE_DEFAULT))


def label_group(label: Column) -> Column:
    return F.when(label >= 0.75, "trust").when(label <= 0.25, "distrust").otherwise("neutral")


def first_contained(text: Column, words: list[str]) -> Column:
    """First word of the list, in list order, that the text contains; null when none."""
    listed = F.array(*[F.lit(w) for w in words])
    return F.get(F.filter(listed, lambda w: F.contains(text, w)), F.lit(0))


def article_hint(source: Column) -> Column:
    """Title hint inside quotes, else inside angle brackets; null when there is none."""
    quoted = F.regexp_extract(source, '["“”](.{10,80})["“”]', 1)
    angled = F.regexp_extract(source, "[<＜](.{5,60})[>＞]", 1)
    pick = F.when(quoted != "", quoted).when(angled != "", angled)
    return F.trim(pick)


def classify_source(source: Column, title: Column) -> Column:
    """struct(type, outlet, article_hint, search_query) of a fact-check source string."""
    s, t = F.trim(F.coalesce(source, F.lit(""))), F.trim(F.coalesce(title, F.lit("")))
    outlet, hint, empty = first_contained(s, K.KNOWN_OUTLETS), article_hint(s), F.lit("")

    def out(kind, outlet_c, hint_c, query_c):
        return F.struct(F.lit(kind).alias("type"), outlet_c.alias("outlet"), hint_c.alias("article_hint"),
                        query_c.alias("search_query"))

    skip = out("SKIP", empty, empty, empty)
    return (F.when(first_contained(s, K.UNCRAWLABLE_WORDS).isNotNull(), skip)
            .when(first_contained(s, K.SELF_RAISED_WORDS).isNotNull(), out("TYPE_C", empty, empty, t))
            .when(outlet.isNull() & first_contained(s, K.SPEECH_WORDS).isNotNull(), out("TYPE_D", empty, empty, t))
            .when(outlet.isNull(), skip)
            .when(F.coalesce(hint, empty) != "", out("TYPE_A", outlet, hint, hint))
            .otherwise(out("TYPE_B", outlet, empty, t)))
