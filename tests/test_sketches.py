"""Sketches by day: errors as stated, merges over any range, days replaced, folders pruned."""
import re

import pytest
from pyspark.sql import functions as F

from pressgrid.operators import dashboards as D, sketches as S
from pressgrid.session import new_path

EVENTS = "event_type string, session_id string, user_id string, created_at string"


@pytest.fixture(scope="module")
def log(spark):
    """30 days, 60,000 events; sessions come back on other days, some events have no time or session."""
    k = F.col("id")
    step = F.element_at(F.array(*map(F.lit, ("visit_main", "view_article_detail", "open_trust_modal", "other"))), (k % 4 + 1).cast("int"))
    return spark.range(60_000).select(step.alias("event_type"), F.when(k % 97 != 0, F.concat(F.lit("s"), F.pmod(F.xxhash64("id"), F.lit(9000)))).alias("session_id"),
                                      F.when(k % 3 == 0, F.concat(F.lit("u"), k % 50)).alias("user_id"),
                                      F.when(k % 89 != 0, F.concat(F.lit("2024-01-"), F.lpad((k % 30 + 1).cast("string"), 2, "0"), F.lit("T10:00:00"))).alias("created_at"))


def near(got, want, error):
    return abs(got - want) <= error * want


@pytest.mark.parametrize("since,until", [(None, None), ("2024-01-05", "2024-01-19"), ("2024-01-30", "2024-01-30"), ("2025-01-01", None)])
def test_funnel_over_any_range(spark, log, since, until):
    rows = log if since is None else log.where(F.substring("created_at", 1, 10).between(since, until or "9"))
    want = {r.step: r for r in D.session_funnel(rows).collect()}
    got = {r.step: r for r in S.funnel_estimate(S.session_sketches(log), since, until).collect()}
    assert got.keys() == want.keys() and got["click_feedback"].overall == 0
    for step, r in got.items():
        for audience in ("overall", "member", "guest"):
            assert near(r[audience], want[step][audience], 0.05), (step, audience, r, want[step])


def test_sessions_of_each_day(log):
    got = {r.day: r.sessions for r in S.active_sessions_estimate(S.session_sketches(log)).collect()}
    want = {r.day: r.sessions for r in D.daily_active_sessions(log, 40).collect()}
    assert got.keys() == want.keys() and all(near(got[d], want[d], 0.05) for d in want)


def test_saved_days_are_replaced_and_pruned(spark, log):
    sketches, path = S.session_sketches(log), new_path(spark, "sketch")
    S.save_days(sketches, path)
    first = S.read_days(spark, path, sketches)
    before = {r.f for r in first.where("day <> '2024-01-07'").select(F.input_file_name().alias("f")).distinct().collect()}
    grown = log.where(F.col("created_at").startswith("2024-01-07")).select("event_type", F.concat("session_id", F.lit("x")).alias("session_id"), "user_id", "created_at")
    S.save_days(S.session_sketches(grown.unionByName(log.where(F.col("created_at").startswith("2024-01-07")))), path)
    again = S.read_days(spark, path, sketches)
    assert before == {r.f for r in again.where("day <> '2024-01-07'").select(F.input_file_name().alias("f")).distinct().collect()}
    old, new = ({r.day: r.sessions for r in S.active_sessions_estimate(s).collect()} for s in (sketches, again))
    assert near(new["2024-01-07"], 2 * old["2024-01-07"], 0.05) and {d for d in old if old[d] != new[d]} == {"2024-01-07"}
    plan = S.funnel_estimate(again, "2024-01-05", "2024-01-06")._jdf.queryExecution().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*day", plan)


def test_percentiles_by_rank(spark):
    k = F.col("id")
    value = F.pmod(F.xxhash64("id"), F.lit(100_000))
    speeds = spark.range(40_000).select(F.lit("client_performance").alias("event_type"), F.format_string("2024-01-%02dT08:00:00", k % 20 + 1).alias("created_at"),
                                        F.to_json(F.struct(F.when(k % 5 == 0, "/a").otherwise("/b").alias("path"), value.alias("lcp_ms"), (value / 1e5).alias("cls"),
                                                           F.when(k % 5 != 0, value).alias("max_event_ms"))).alias("event_data"))
    got = {r.path: r for r in S.vitals_estimate(S.speed_sketches(speeds), "2024-01-03", "2024-01-20").collect()}
    part = speeds.where(F.substring("created_at", 1, 10) >= "2024-01-03").select(F.from_json("event_data", "path string, lcp_ms int, cls double, max_event_ms int").alias("v")).select("v.*")
    assert got["/a"].inp_p75 is None and got["/b"].inp_p75 is not None
    for path, r in got.items():
        rows = part.where(F.col("path") == path)
        assert r.sample_count == rows.count()
        for column, name, q in (("lcp_ms", "lcp_p50", .5), ("lcp_ms", "lcp_p75", .75), ("lcp_ms", "lcp_p95", .95), ("cls", "cls_p75", .75)):
            rank = rows.where(F.col(column) <= r[name]).count() / r.sample_count
            assert abs(rank - q) < 0.02, (path, name, rank)


def test_nothing_to_sketch(spark):
    empty = spark.createDataFrame([], EVENTS + ", event_data string")
    assert [tuple(r)[2:] for r in S.funnel_estimate(S.session_sketches(empty)).collect()] == [(0, 0, 0)] * 4
    assert S.vitals_estimate(S.speed_sketches(empty)).count() == 0 == S.active_sessions_estimate(S.session_sketches(empty)).count()
