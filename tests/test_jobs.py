"""Streams over several batches, near-duplicates at any threshold, guests, percentiles, vectors, encoders."""
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pressgrid.functions import arrow
from pressgrid.operators import merges as M, near_dup as N, ordering as O, vector_index as VI, vector_topk as VT
from pressgrid.plans import encoders as E
from pressgrid.streaming import jobs as J

EVENT = "session_id string, user_id string, event_type string, article_id string, event_data string, created_at string, event_time timestamp"


def stream_of(spark, tmp_path, batches):
    """A file stream that takes one file a micro-batch, in order."""
    folder = tmp_path / "in"
    for k, rows in enumerate(batches):
        frame = spark.createDataFrame([(*r, r[-1]) for r in rows], "session_id string, user_id string, event_type string, article_id string, event_data string, created_at string, t string")
        frame.withColumn("event_time", F.col("t").cast("timestamp")).drop("t").coalesce(1).write.mode("append").parquet(str(folder))
    return spark.readStream.schema(EVENT).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(str(folder))


def click(t, article="a1", user="u"):
    return ("s", user, "click_article", article, '{"source": "personalized_recommendation"}', f"2024-01-01T{t}")


def test_late_clicks_are_decided_at_their_own_time(spark, tmp_path):
    batches = [[click("10:00:00"), click("10:00:10")], [click("09:40:00"), click("10:00:40")], [click("10:00:25"), click("09:40:20"), click("10:10:00")]]
    out = J.run_append(J.positive_dedupe(stream_of(spark, tmp_path, batches)), "late").collect()
    assert sorted(r.created_at[11:] for r in out) == ["09:40:00", "10:00:00", "10:00:40", "10:10:00"]


def test_dedupe_state_lies_in_buckets(spark, tmp_path):
    """Many pairs with a few rows each: what is kept is that of a scan of every pair, with one state a bucket."""
    from pressgrid import session
    rnd, batches, want = random.Random(4), [], set()
    times = sorted(rnd.sample(range(3000), 600))
    rows = [click(f"10:{t // 60:02d}:{t % 60:02d}", f"a{rnd.randint(0, 60)}", f"u{rnd.randint(0, 2)}") for t in times]
    last = {}
    for t, r in zip(times, rows):
        if t - last.get((r[1], r[3]), -999) > 300:
            last[r[1], r[3]] = t
            want.add((f"user:{r[1]}", r[3], r[5]))
    half = rows[:300]
    rnd.shuffle(half)
    out = J.run_append(J.positive_dedupe(stream_of(spark, tmp_path, [half, rows[300:]]), 300.0, buckets=4), "bucketed").collect()
    assert {tuple(r) for r in out} == want and len(out) == len(want)
    path = next(p for p in session._written if "/bucketed-" in p)
    assert spark.read.format("statestore").load(path + "-cp").count() <= 4


def test_open_days_are_counted_over_batches(spark, tmp_path):
    batches = [[click("10:00:00")], [click("11:00:00"), click("10:30:00", "a2")], [click("23:59:00")]]
    cells = J.latest(J.run_update(J.recommendation_ctr(stream_of(spark, tmp_path, batches)), "ctr"), ["starts_at", "rec_source"])
    rows = {r.rec_source: r.clicks for r in J.ctr_by_source(cells).collect()}
    assert rows == {"all": 4, "unknown": 4}


@pytest.mark.parametrize("threshold", [0.2, 0.34, 0.5, 0.8, 1.0])
def test_pairs_at_any_threshold(spark, threshold):
    rnd = random.Random(3)
    rows = [(str(k), " ".join(rnd.sample("abcdefghij", rnd.randint(1, 5)))) for k in range(60)]
    sets = {}
    for k, t in sorted(rows):
        sets.setdefault(frozenset(t.split()), k)
    want = set()
    for a, x in sets.items():
        for b, y in sets.items():
            if x < y and len(a & b) / len(a | b) >= threshold - 1e-12:
                want.add((x, y))
    got = N.near_duplicate_pairs(spark.createDataFrame(rows, "id string, t string"), "id", F.col("t"), [], threshold).collect()
    assert {(r.earlier, r.later) for r in got} == want and len(got) == len(want)


def test_guests_stay_and_unknown_users_become_guests(spark):
    rows = spark.createDataFrame([(1, None), (2, "u"), (3, "x"), (4, None)], "n int, user_id string")
    users = spark.createDataFrame([("u",), (None,), ("u",)], "user_id string")
    assert sorted((r.n, r.user_id) for r in M.safe_users(rows, users).collect()) == [(1, None), (2, "u"), (3, None), (4, None)]


def test_append_gives_ids_and_times_once(spark, tmp_path):
    rows = [("l1", "s", None, '{"password": "p"}', "2024-01-01T00:00:00"), (None, "s", "u", '{"n": 1}', None), (None, "s", "u", '{"n": 1}', None)]
    frame = spark.createDataFrame(rows, "log_id string, session_id string, user_id string, event_data string, created_at string")
    users, path, at = spark.createDataFrame([("u",)], "user_id string"), str(tmp_path / "log"), F.lit("2024-02-01").cast("timestamp")
    for _ in range(2):
        log = M.append_events(frame, users, path, at).collect()
    assert len(log) == 3 and len({r.log_id for r in log}) == 3 and all(r.created_at for r in log)
    assert [r.event_data for r in log if r.log_id == "l1"] == ['{"password": "[REDACTED]"}']


def test_redaction_reaches_objects_in_lists():
    assert arrow.redact_text('{"a": [{"Token": [1]}, "x"], "secret": {"b": 1}}') == '{"a": [{"Token": "[REDACTED]"}, "x"], "secret": "[REDACTED]"}'


def test_percentiles_and_totals_over_ranges(spark):
    rnd = random.Random(1)
    values = [(g, rnd.random()) for g in "ab" for _ in range(101 if g == "a" else 1000)]
    frame = spark.createDataFrame(values, "g string, v double")
    got = {r.g: (r.p50, r.p75) for r in O.exact_percentiles(frame, ["g"], "v", {"p50": 0.5, "p75": 0.75}).collect()}
    for g in "ab":
        own = [v for k, v in values if k == g]
        assert np.allclose(got[g], np.percentile(own, [50, 75]))


def test_clusters_are_pruned_without_loss(spark, monkeypatch):
    rnd = np.random.default_rng(0)
    centres = np.eye(16)[:8]
    points = np.concatenate([c + rnd.normal(0, 0.02, (100, 16)) for c in centres])
    frame = spark.createDataFrame([(str(k), p.tolist()) for k, p in enumerate(points)], "cid string, cvec array<double>")
    asked = spark.createDataFrame([(str(k), points[k].tolist()) for k in range(0, 800, 7)], "qid string, qvec array<double>")
    routed = []
    real = VI.VectorIndex._routed
    monkeypatch.setattr(VI.VectorIndex, "_routed", lambda self, q: routed.append(real(self, q)) or routed[-1])
    got = {(r.qid, r.cid) for r in VT.cosine_topk(asked, frame, 5, pivot_count=8).collect()}
    unit = points / np.linalg.norm(points, axis=1, keepdims=True)
    for k in range(0, 800, 7):
        best = np.argsort(-np.round(unit[k] @ unit.T, 9), kind="stable")[:5]
        assert {c for q, c in got if q == str(k)} == {str(b) for b in best}
    assert routed[0].count() <= 2 * asked.count()  # of 8 cells, hardly more than the own one


def test_batched_user_encoder_equals_plain_loops():
    rnd = np.random.default_rng(1)
    dim, heads, n = 16, 8, 5
    w = {"in_w": rnd.normal(size=(3 * dim, dim)), "in_b": rnd.normal(size=3 * dim), "out_w": rnd.normal(size=(dim, dim)), "out_b": rnd.normal(size=dim),
         "norm_w": rnd.normal(size=dim), "norm_b": rnd.normal(size=dim), "pool_w": rnd.normal(size=(7, dim)), "pool_b": rnd.normal(size=7), "pool_q": rnd.normal(size=(1, 7))}
    seqs = rnd.normal(size=(3, n, dim))
    soft = lambda x: np.exp(x - x.max()) / np.exp(x - x.max()).sum()
    for seq, got in zip(seqs, E.user_vectors(w, seqs)):
        q, k, v = np.split(seq @ w["in_w"].T + w["in_b"], 3, axis=1)
        att = np.zeros((n, dim))
        for h in range(heads):
            at = slice(h * dim // heads, (h + 1) * dim // heads)
            for i in range(n):
                share = soft(np.array([q[i, at] @ k[j, at] / np.sqrt(dim // heads) for j in range(n)]))
                att[i, at] = sum(share[j] * v[j, at] for j in range(n))
        x = seq + att @ w["out_w"].T + w["out_b"]
        x = np.array([(r - r.mean()) / np.sqrt(r.var() + 1e-5) * w["norm_w"] + w["norm_b"] for r in x])
        pool = soft(np.array([(np.tanh(r @ w["pool_w"].T + w["pool_b"]) @ w["pool_q"].T)[0] for r in x]))
        out = (x * pool[:, None]).sum(axis=0)
        assert np.allclose(got, out / np.linalg.norm(out))
