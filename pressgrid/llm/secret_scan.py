"""Secret scan: candidates by shape, false positives removed by a random forest.

Candidates are all long runs of token characters in the words of a text, and what follows a credential's
name and '=' or ':', from a lower length on.  The forest sees, for each:
its length, the transitions between character classes, the shares of digits, capitals and hexadecimal
digits, the share of its letters that dictionary words cover, the path it was found under, and the
words beside it.  The dictionary is counted over all texts: lower-case words that at least
``DICTIONARY_DOCS`` documents hold.  The forest is fitted on labelled findings, at most
``MAX_TRAIN`` of them (by a hash of the finding); everything is DataFrame operations.
"""
from __future__ import annotations

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .arrays import forget, saved, tidy

MIN_LENGTH = 16
#: Least length of a value after a credential's name and '=' or ':'.
MIN_ASSIGNED = 6
DICTIONARY_DOCS = 5
MAX_TRAIN = 50_000
TREES, DEPTH, SEED = 24, 6, 17
#: A finding is a secret from this share of the forest's votes on.
LEAST_VOTE = 0.5

_SPACE = "[\\x20\\x09-\\x0D]+"
_TOKEN = f"[A-Za-z0-9+/_=.-]{{{MIN_LENGTH},}}"
#: Names that introduce a credential, and path parts of tests and documentation.
CREDENTIAL_WORDS = "token|secret|password|passwd|pwd|api_?key|apikey|access_?key|auth|bearer|credential|private"
SAMPLE_PATHS = "test|spec|example|sample|mock|fixture|doc|readme"

_QUOTE = "\"'`"
_NAME = f"(?i:{CREDENTIAL_WORDS})(?i:[_-]?key)?[\\\\{_QUOTE}]*"
_SIGN = "[=:]{1,2}>?"
#: A mark is put before each value that is assigned to a credential's name; runs end there.
_MARK = "\x00"
_VALUE = "|".join([*(f"(?<={q}\\x00)[^{q}\\x00]{{{MIN_ASSIGNED},}}+" for q in _QUOTE),
                   f"(?<=(?<![{_QUOTE}])\\x00)[^{_QUOTE},;&(){{}}\\[\\]<>\\x00]{{{MIN_ASSIGNED},}}+"])
#: What lies before a candidate, and the candidate; each match begins where the last one ended.
_EACH = f"\\G((?s:.*?))((?:{_VALUE})|{_TOKEN}+)"

FEATURES = ["length", "transitions", "digit_share", "upper_share", "hex_share", "repeat_share", "coverage", "longest_piece", "path_depth",
            "path_sample", "before_credential", "before_assigns", "quoted", "before_length", "after_length"]


def candidates(docs: DataFrame, path: str = "source", text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, path, place, run, finding, before, near, after, word, lead, assigned): one row for each candidate of every text.

    place is the number of the word it stands in, run the number of the candidate in that word, from the left.
    before is the word to the left, near the one before that, after the word to the right, '' where there is
    none; lead is what the word has before the candidate, from the last candidate on.  assigned: it is
    the value after a credential's name and '=' or ':'.
    """
    docs = tidy(docs)
    words = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.col(f"`{path}`").cast("string"), F.lit("")).alias("path"),
                        F.split(F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")), _SPACE).alias("w"))

    def follows(before: Column, near: Column) -> Column:
        sign = before.endswith("=") | before.endswith(":") | before.endswith(">")
        return sign & (before.rlike(f"{_NAME}{_SIGN}$") | (before.rlike(f"^{_SIGN}$") & near.rlike(f"{_NAME}$")))

    def asked(i: Column) -> Column:
        word = F.get("w", i)
        inside = (word.contains("=") | word.contains(":")) & word.rlike(f"{_NAME}{_SIGN}")
        return ((F.length(word) >= MIN_LENGTH) & word.rlike(_TOKEN)) | ((F.length(word) >= MIN_ASSIGNED) & (inside | follows(F.get("w", i - 1), F.get("w", i - 2))))

    # a candidate takes its word and the words beside it along: the array of all words ends here, so a text costs its length
    at = lambda i: F.coalesce(F.get("w", i), F.lit(""))
    beside = lambda i: F.struct(i.cast("long").alias("place"), at(i - 1).alias("before"), at(i - 2).alias("near"), at(i + 1).alias("after"), at(i).alias("word"))
    places = F.filter(F.sequence(F.lit(0), F.size("w") - 1), asked)
    found = words.select("doc_id", "path", F.explode_outer(F.transform(places, beside)).alias("c")).where("c is not null").select("doc_id", "path", "c.*")
    marked = F.regexp_replace(F.replace("word", F.lit(_MARK), F.lit(" ")), f"({_NAME})({_SIGN}[\\\\{_QUOTE}]*)", f"$1{_MARK}$2{_MARK}")
    marked = F.when(follows(F.col("before"), F.col("near")), F.regexp_replace(marked, f"^([\\\\{_QUOTE}]*)", f"$1{_MARK}")).otherwise(marked)
    found = found.withColumn("marked", marked).withColumns({"leads": F.regexp_extract_all("marked", F.lit(_EACH), 1), "runs": F.regexp_extract_all("marked", F.lit(_EACH), 2)})
    found = found.select("*", F.posexplode_outer("runs").alias("run", "finding")).where("finding is not null")
    lead = F.get("leads", F.col("run"))
    return found.select("doc_id", "path", "place", F.col("run").cast("long").alias("run"), F.rtrim("finding", F.lit("\\")).alias("finding"), "before", "near", "after", "word",
                        F.replace(F.concat(F.coalesce(F.get("runs", F.col("run") - 1), F.lit("")), lead), F.lit(_MARK), F.lit("")).alias("lead"),
                        lead.endswith(_MARK).alias("assigned"))


def dictionary(docs: DataFrame, least: int = DICTIONARY_DOCS, text: str = "text") -> DataFrame:
    """(piece): lower-case words of three ASCII letters or more that at least ``least`` documents hold."""
    words = F.array_distinct(F.split(F.lower(F.regexp_replace(F.col(f"`{text}`").cast("string"), "[^A-Za-z]+", " ")), " "))
    return (docs.select(F.explode(words).alias("piece")).where(F.length("piece") >= 3)
            .groupBy("piece").agg(F.count("*").alias("n")).where(F.col("n") >= least).select("piece"))


def _share(pattern: str) -> Column:
    return (F.length("finding") - F.length(F.regexp_replace("finding", pattern, ""))) / F.length("finding")


def features(found: DataFrame, words: DataFrame) -> DataFrame:
    """Candidates with FEATURES; words: table of dictionary words (piece)."""
    first = F.col("run") == 0  # the words to the left stand beside the first candidate of a word only
    shape = found.withColumns({
        "length": F.length("finding").cast("double"),
        "transitions": F.size(F.regexp_extract_all("finding", F.lit("([a-z]+|[A-Z]+|[0-9]+|[^a-zA-Z0-9]+)"))) / F.length("finding"),
        "digit_share": _share("[0-9]"), "upper_share": _share("[A-Z]"), "hex_share": _share("[0-9a-fA-F]"),
        "repeat_share": 1 - F.size(F.array_distinct(F.split("finding", ""))) / F.length("finding"),
        "path_depth": F.size(F.split("path", "/")).cast("double"), "path_sample": F.lower("path").rlike(SAMPLE_PATHS).cast("double"),
        "before_credential": ((first & (F.lower("before").rlike(CREDENTIAL_WORDS) | F.lower("near").rlike(CREDENTIAL_WORDS))) | F.col("assigned")).cast("double"),
        "before_assigns": ((first & (F.col("before").rlike("[=:]$") | F.col("word").rlike("^[A-Za-z_\"']+[=:]"))) | F.col("lead").rlike(f"{_SIGN}[\\\\{_QUOTE}]*$")).cast("double"),
        "quoted": F.col("word").rlike("[\"'`]").cast("double"),
        "before_length": F.least(F.length("before"), F.lit(64)).cast("double"), "after_length": F.least(F.length("after"), F.lit(64)).cast("double")})
    pieces = F.filter(F.split(F.lower(F.regexp_replace("finding", "[^A-Za-z]+", " ")), " "), lambda p: F.length(p) >= 3)
    shape = shape.withColumns({"row": F.xxhash64("doc_id", "place", "run", "finding", "path", "before", "near", "after"), "pieces": pieces})
    shape = shape.withColumn("longest_piece", F.coalesce(F.array_max(F.transform("pieces", F.length)), F.lit(0)).cast("double"))
    # findings repeat in copies: a finding's pieces are looked up once
    asked = shape.select("finding", "pieces").distinct().select("finding", F.explode("pieces").alias("piece"))
    covered = asked.join(words, "piece").groupBy("finding").agg(F.sum(F.length("piece")).alias("covered"))
    return (shape.join(covered, "finding", "left").withColumn("coverage", F.coalesce("covered", F.lit(0)) / F.length("finding")).drop("covered", "pieces"))


def fit(labelled: DataFrame, max_train: int = MAX_TRAIN) -> RandomForestClassificationModel | None:
    """Forest over findings with FEATURES and a boolean ``secret``; None if only one class is labelled.

    The max_train findings with the smallest hash are used, half of them at most of each class.
    """
    some = None
    for truth in (True, False):
        own = labelled.where(F.col("secret") == truth).orderBy("row").limit(max_train // 2)
        some = own if some is None else some.unionByName(own)
    some = saved(some.select("row", *FEATURES, F.col("secret").cast("double").alias("label")), "labelled")
    if some.select("label").distinct().count() < 2:
        return None
    ready = VectorAssembler(inputCols=FEATURES, outputCol="vector").transform(some.coalesce(1).sortWithinPartitions("row", *FEATURES)).select("vector", "label")
    model = RandomForestClassifier(featuresCol="vector", labelCol="label", numTrees=TREES, maxDepth=DEPTH, seed=SEED).fit(ready)
    forget(some)
    return model


def judged(rows: DataFrame, model: RandomForestClassificationModel | None) -> DataFrame:
    """Findings with ``vote``, the forest's share for a secret (null without a model), and ``is_secret``."""
    if model is None:
        return rows.withColumns({"vote": F.lit(None).cast("double"), "is_secret": F.lit(True)})
    ready = VectorAssembler(inputCols=FEATURES, outputCol="_vector").transform(rows)
    scored = model.setFeaturesCol("_vector").setPredictionCol("_prediction").setRawPredictionCol("_raw").setProbabilityCol("_share").transform(ready)
    vote = F.get(vector_to_array("_share"), F.lit(1))
    return scored.withColumn("vote", vote).withColumn("is_secret", F.col("vote") >= LEAST_VOTE).drop("_vector", "_prediction", "_raw", "_share")


def scan(docs: DataFrame, labelled: DataFrame | None = None, label: Column | None = None, path: str = "source", text: str = "text",
         id_col: str = "doc_id", max_train: int = MAX_TRAIN) -> DataFrame:
    """Candidates of every text with vote and is_secret.

    Labels come as a table ``labelled`` (doc_id, place, run, secret; without run it labels run 0), or as a column ``label`` over the candidates
    (null: unlabelled).  A null or empty text has no candidates, repeated rows repeat them.  Without
    labels of both kinds every candidate stays, with a null vote.
    """
    docs = tidy(docs)
    rows = saved(features(candidates(docs, path, text, id_col), dictionary(docs, text=text)), "findings")
    if labelled is not None:
        run = F.col("run") if "run" in labelled.columns else F.lit(0)
        marks = labelled.select("doc_id", "place", run.cast("long").alias("run"), "secret").where("secret is not null").distinct()
        known = rows.join(marks, ["doc_id", "place", "run"])
    else:
        known = rows.withColumn("secret", F.lit(None).cast("boolean") if label is None else label).where("secret is not null")
    return judged(rows, fit(known, max_train))


def proven() -> Column:
    """Truth of a finding where its form alone proves it, else null.

    A long hexadecimal or base64 value that is assigned, in quotes, to a credential's name is a secret; a
    value of letters only, a number or a dotted name is none unless it is assigned to such a name.
    """
    secret = F.col("assigned") & F.col("lead").rlike(f"[{_QUOTE}]$") & F.col("finding").rlike("^[A-Za-z0-9+/_=-]{32,}$")
    none = ~F.col("assigned") & F.col("finding").rlike("^([A-Za-z]+|[0-9]+|[0-9.]+|[A-Za-z.]+|.*\\.(com|org|net).*)$")
    return F.when(secret, F.lit(True)).when(none, F.lit(False))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables have no labelled findings: those that their form proves are the labels, outside a held-out fifth."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    kept = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0
    out = scan(docs, label=F.when(kept, proven()))
    return out.select("doc_id", "place", "run", "finding", F.round("coverage", 6).alias("coverage"), F.round("vote", 6).alias("vote"), "is_secret")


QUERIES = {"op2_secret_scan": op2_secret_scan}
ORACLES: dict[str, str] = {}
