"""Saved postings and bucketed tables: updates equal rebuilding, and untouched files stay."""
import re

import pytest
from pyspark.sql import functions as F

from pressgrid.operators import bucketed as B, merges as M, postings as PO
from pressgrid.plans import search as S
from pressgrid.session import new_path

SCHEMA = "article_id string, title string, full_text string"


def articles(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def rows_of(df):
    return sorted(map(tuple, df.collect()))


BASE = [(f"a{k}", f"market news {k % 5}", " ".join(["alpha", "beta", "gamma"][: 1 + k % 3]) * (1 + k % 2) + f" word{k}") for k in range(40)]


def test_updates_equal_a_rebuild(spark):
    index = PO.create_postings(articles(spark, BASE), new_path(spark, "post"))
    changed = [("a3", "other title", "alpha delta"), ("a7", None, None), ("n1", "market news", "beta beta")]
    grown = index.update(articles(spark, changed), spark.createDataFrame([("a5",), ("unknown",)], "article_id string"))
    grown = grown.update(articles(spark, [("a3", "third title", "alpha")]))
    now = {r[0]: r for r in BASE} | {r[0]: r for r in changed} | {"a3": ("a3", "third title", "alpha")}
    now.pop("a5")
    fresh = PO.create_postings(articles(spark, list(now.values())), new_path(spark, "post"))
    packed = PO.compact(grown, new_path(spark, "post"))
    for one in (PO.open_postings(spark, grown.path), packed):
        assert rows_of(one.postings()) == rows_of(fresh.postings())
        assert rows_of(one.counts()) == rows_of(fresh.counts())
        assert (one.docs, one.length) == (fresh.docs, fresh.length) and one.mean_idf == pytest.approx(fresh.mean_idf)
    q = spark.createDataFrame([("q1", "alpha"), ("q2", "market news"), ("q3", "nothing")], "query_id string, query string")
    assert rows_of(S.bm25_search(q, grown)) == rows_of(S.bm25_search(q, fresh)) != []


def test_a_search_reads_the_asked_buckets_only_and_an_unfinished_update_is_not_seen(spark):
    index = PO.create_postings(articles(spark, BASE), new_path(spark, "post"))
    plan = index.postings(spark.createDataFrame([("alpha",)], "term string"))._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*\(bucket#\d+ = \d+\)", plan)
    before = rows_of(index.postings())
    articles(spark, BASE[:3]).select("article_id").write.parquet(f"{index.path}/gone/generation=1")
    again = PO.open_postings(spark, index.path)
    assert again.generation == 0 and rows_of(again.postings()) == before


def buckets_and_files(table):
    return {f.split("_bucket=")[1].split("/")[0]: f for f in table.read().inputFiles()}


def test_keyed_updates_replace_their_buckets_only(spark):
    rows = spark.createDataFrame([(f"a{k}", f"t{k}", k, f"v{k}", None, None) for k in range(200)],
                                 "article_id string, title string, trust_score int, trust_verdict string, trust_reason string, trust_per_criteria string")
    table = B.create_table(rows, new_path(spark, "articles"), "article_id", 16)
    new = spark.createDataFrame([("a7", "changed"), ("zz", "new")], "article_id string, title string")
    before, want = buckets_and_files(table), rows_of(M.upsert(rows, new, "article_id"))
    touched = {str(b) for b in table.upsert(new)}
    after = buckets_and_files(table)
    assert rows_of(table.read()) == want and len(touched) <= 2
    assert {b for b in before if before[b] != after.get(b)} == touched
    scores = spark.createDataFrame([("a9", 1, "x", "y", "z")], "article_id string, trust_score int, trust_verdict string, trust_reason string, trust_per_criteria string")
    want = rows_of(M.update_trust(table.read(), scores))
    assert len(table.update_trust(scores)) == 1 and rows_of(table.read()) == want
    whole = table.read().select("article_id").where(B.bucket_of("article_id", 16) == 3)
    gone = spark.createDataFrame(whole.collect(), "article_id string")
    assert B.delete_cascade({"articles": table}, gone) == {"articles": [3]}
    assert "3" not in buckets_and_files(table) and rows_of(table.read()) == [r for r in want if (r[0],) not in {tuple(x) for x in gone.collect()}]


def test_votes_replace_each_other_within_their_bucket(spark):
    schema = "feedback_id string, article_id string, user_id string, feedback_type string, created_at string"
    old = spark.createDataFrame([("f1", "a1", "u1", "like", "2024-01-01"), ("f2", "a1", None, "like", "2024-01-01"), ("f3", "a2", "u1", "like", "2024-01-01")], schema)
    new = spark.createDataFrame([("f4", "a1", "u1", "dislike", "2024-01-02"), ("f5", "a1", "nobody", "dislike", "2024-01-03")], schema)
    users = spark.createDataFrame([("u1",)], "user_id string")
    table = B.create_table(old, new_path(spark, "votes"), "article_id", 8)
    assert len(table.replace_feedback(new, users)) == 1
    assert {r.feedback_id: r.user_id for r in table.read().collect()} == {"f4": "u1", "f5": None, "f3": "u1"}


def test_log_by_day_reads_asked_days_and_compacts_one(spark):
    from pressgrid.operators.event_log import EventLog
    schema = "log_id string, session_id string, event_type string, article_id string, event_data string, created_at string, user_id string"
    rows = [(f"e{k}", "s", "view", "a", "{}", f"2024-01-{1 + k % 5:02d}T00:00:{k:02d}", "u1" if k % 2 else "nobody") for k in range(40)]
    users = spark.createDataFrame([("u1",)], "user_id string")
    frame = lambda r: spark.createDataFrame(r, schema)
    log = EventLog(spark, new_path(spark, "log"), frame(rows).schema)
    for part in (rows[:15], rows[10:30], rows[25:]):
        log.append(frame(part), users)
    want = sorted((*r[:6], "u1" if r[6] == "u1" else None) for r in rows)
    assert rows_of(log.read()) == want
    late = log.read(since="2024-01-04")
    assert rows_of(late) == [r for r in want if r[5] >= "2024-01-04"]
    assert re.search(r"PartitionFilters: \[[^\]]*day#\d+ >= 2024-01-04", late._jdf.queryExecution().executedPlan().toString())
    of_day = lambda: {d: {f for f in log.read().inputFiles() if f"day=2024-01-{d}" in f} for d in ("02", "03")}
    before = of_day()
    assert len(before["02"]) == 3 and log.compact("2024-01-02") == 1
    after = of_day()
    assert len(after["02"]) == 1 and after["03"] == before["03"] and rows_of(log.read()) == want
