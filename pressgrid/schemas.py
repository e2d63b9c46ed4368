"""Declared schemas, write defaults and read defaults of the data model."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T

S, I, D = T.StringType(), T.IntegerType(), T.DoubleType()
VECTOR = T.ArrayType(T.DoubleType())


def _schema(**fields) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in fields.items()])


ARTICLES = _schema(article_id=S, title=S, source=S, url=S, published_at=S, full_text=S, summary_text=S, keywords=S,
                   embed_full=S, embed_summary=S, trust_score=I, trust_verdict=S, trust_reason=S, trust_per_criteria=S,
                   status=S, category=S)
CHUNKS = _schema(chunk_id=S, article_id=S, chunk_text=S, embedding=VECTOR)
FEEDBACK = _schema(feedback_id=S, article_id=S, user_id=S, feedback_type=S, created_at=S)
EVENTS = _schema(log_id=S, session_id=S, event_type=S, article_id=S, event_data=S, created_at=S, user_id=S)
CRITERION = _schema(score=I, reason=S)
CRITERION_CACHE = _schema(pair_id=S, side=S, score=I, verdict=S, per_criteria=T.MapType(S, CRITERION))
INVARIANT_SIDE = _schema(source=S, text=S)
INVARIANT_PAIRS = _schema(pair_id=S, type=S, signal=S, description=S, expected=S, expected_range=T.ArrayType(I),
                          snu_id=S, a=INVARIANT_SIDE, a_prime=INVARIANT_SIDE)

LIST_COLUMNS = ["article_id", "title", "source", "url", "published_at", "summary_text", "keywords",
                "trust_score", "trust_verdict", "category"]

WRITE_DEFAULTS = {f.name: 0 if f.name == "trust_score" else "" for f in ARTICLES.fields}
READ_DEFAULTS = {"summary_text": "", "keywords": "[]", "trust_score": 0, "trust_verdict": ""}
RESPONSE_DEFAULTS = {"article_id": "", "title": "", "source": "", "url": "", "published_at": "", "summary_text": "",
                     "keywords": "[]", "trust_score": 0, "trust_verdict": "", "category": ""}


def conform(df: DataFrame, schema: T.StructType, defaults: dict | None = None, fill_nulls: bool = False) -> DataFrame:
    """Project to a declared schema: missing columns take their default, present ones are cast.

    With ``fill_nulls`` the default also replaces nulls.
    """
    defaults = defaults or {}
    cols = []
    for f in schema.fields:
        default = F.lit(defaults.get(f.name)).cast(f.dataType)
        if f.name not in df.columns:
            cols.append(default.alias(f.name))
        else:
            c = F.col(f.name).cast(f.dataType)
            cols.append((F.coalesce(c, default) if fill_nulls and f.name in defaults else c).alias(f.name))
    return df.select(*cols)


RESPONSE = _schema(article_id=S, title=S, source=S, url=S, published_at=S, summary_text=S, keywords=S, trust_score=I,
                   trust_verdict=S, category=S, score=D)


def article_response(df: DataFrame) -> DataFrame:
    """The 11-column output row of every list: nulls become defaults, a missing score stays null."""
    return conform(df, RESPONSE, RESPONSE_DEFAULTS, fill_nulls=True)
