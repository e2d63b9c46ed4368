import random

import numpy as np
from pyspark.sql import functions as F

from pressgrid.functions import vectors as X
from pressgrid.plans import encoders as E, recommend as R, samples as S, samples as SM

EVENT = "log_id string, session_id string, user_id string, event_type string, article_id string, event_data string, created_at string"
FEED = "feedback_id string, user_id string, article_id string, feedback_type string, created_at string"


def events(spark, rows):
    return spark.createDataFrame([(str(i), "s1", None, t, a, d, f"2026-01-01T{w}+00:00") for i, (t, a, d, w) in enumerate(rows)], EVENT)


def sample(spark, rows, n=1):
    out = SM.temporal_samples(events(spark, rows), spark.createDataFrame([], FEED), negative_count=n).collect()
    return [(r["history"], r["positive"], r["negatives"]) for r in out]


def test_future_impressions_are_no_negatives(spark):
    rows = [("impression", None, '{"article_ids": ["n_before"]}', "00:00:00"), ("click_article", "h1", None, "00:01:00"),
            ("click_article", "pos", None, "00:02:00"), ("impression", None, '{"article_ids": ["n_future"]}', "00:03:00")]
    assert sample(spark, rows) == [(["h1"], "pos", ["n_before"])]


def test_click_and_view_merge(spark):
    rows = [("impression", None, '{"articles": [{"article_id": "n1", "position": 0}]}', "00:00:00"), ("click_article", "a1", None, "00:01:00"),
            ("view_article_detail", "a1", None, "00:01:01"), ("click_article", "a2", None, "00:02:00")]
    assert sample(spark, rows) == [(["a1"], "a2", ["n1"])]


def test_too_few_negatives(spark):
    assert sample(spark, [("click_article", "a1", None, "00:01:00"), ("click_article", "a2", None, "00:02:00")]) == []


def test_repeats_are_compared_with_the_last_kept_one(spark):
    p = spark.createDataFrame([("u", "a", f"2026-01-01T00:00:{s:02d}") for s in (0, 10, 20, 35, 50)] + [("u", "a", "no time"), ("u", "a", "no time")],
                              "subject string, article_id string, created_at string")
    kept = sorted(r["created_at"] for r in SM.kept_positives(p).collect())
    assert kept == ["2026-01-01T00:00:00", "2026-01-01T00:00:35", "no time", "no time"]


def test_one_hot_subject_equals_plain_replay(spark):
    """A single subject over many blocks gives what one sequential pass gives."""
    rng = np.random.default_rng(5)
    rows = []
    for i in range(400):
        when = f"{i // 3600:02d}:{(i // 60) % 60:02d}:{i % 60:02d}"
        if rng.random() < 0.4:
            ids = [f"a{rng.integers(40)}" for _ in range(3)]
            rows.append(("impression", None, '{"article_ids": ["' + '","'.join(ids) + '"]}', when, ids))
        else:
            rows.append(("click_article", f"a{rng.integers(40)}", None, when, None))
    want, history, shown, last = [], [], [], {}
    for i, (t, a, _, when, ids) in enumerate(rows):
        if t == "impression":
            shown += ids
            continue
        if a in last and i - last[a] <= 30:
            continue
        last[a] = i
        neg = [x for x in dict.fromkeys(reversed(shown)) if x != a and x not in history][:2]
        if history and len(neg) == 2:
            want.append((history[-20:], a, neg))
        history.append(a)
    got = sample(spark, [r[:4] for r in rows], 2)
    assert sorted(map(str, got)) == sorted(map(str, want)) and len(want) > 50


def test_profile_prefers_recent(spark):
    h = spark.createDataFrame([("r", "old", 2), ("r", "new", 1)], "k string, article_id string, pos int")
    v = spark.createDataFrame([("old", [1.0, 0.0]), ("new", [0.0, 1.0])], "article_id string, embedding array<double>")
    p = E.recency_weighted_vector(h, v, ["k"], F.col("pos") - 1, 2).first()["profile"]
    assert p[1] > p[0]


def test_blend(spark):
    df = spark.createDataFrame([([1.0, 0.0], [0.0, 1.0]), ([1.0, 0.0], [0.0, 0.0]), ([0.0, 0.0], [0.0, 1.0])], "a array<double>, b array<double>")
    got = [r[0] for r in df.select(X.blend_vectors(F.col("a"), F.col("b"), 0.65)).collect()]
    assert np.allclose(got[0], [0.65, 0.35]) and got[1:] == [[1.0, 0.0], [0.0, 1.0]]


def test_guardrail_and_cap(spark):
    df = spark.createDataFrame([("r", i + 1, c, t) for i, (c, t) in enumerate([("A", 20), ("A", 85), ("A", 0), ("A", 50), ("A", 50), ("B", 50)])],
                               "request_id string, pos int, category string, trust_score int")
    low_last = R.trust_guardrail(df, ["request_id"]).orderBy("pos").collect()
    assert [r["trust_score"] for r in low_last][:2] == [85, 0] and low_last[-1]["trust_score"] == 20
    top5 = R.diversify(df, ["request_id"], 5).where("pos <= 5").collect()
    assert "B" in {r["category"] for r in top5}


def weights(dim, cats, hidden=8):
    r = np.random.default_rng(1)
    return {"category_w": r.normal(size=(dim, cats)), "category_b": r.normal(size=dim), "view_w1": r.normal(size=(hidden, dim)), "view_b1": r.normal(size=hidden),
            "view_w2": r.normal(size=(1, hidden)), "view_b2": r.normal(size=1), "in_w": r.normal(size=(3 * dim, dim)), "in_b": r.normal(size=3 * dim),
            "out_w": r.normal(size=(dim, dim)), "out_b": r.normal(size=dim), "norm_w": np.ones(dim), "norm_b": np.zeros(dim),
            "pool_w": r.normal(size=(hidden, dim)), "pool_b": r.normal(size=hidden), "pool_q": r.normal(size=(1, hidden))}


def test_encoders_give_unit_vectors(spark):
    w = weights(16, 3)
    a = spark.createDataFrame([(str(i), [float(i + j) for j in range(16)], [1.0, 0.0, 0.0]) for i in range(6)], "article_id string, embedding array<double>, one_hot array<double>")
    v = E.encode_articles(a, w, 16)
    assert np.allclose([np.linalg.norm(r["vector"]) for r in v.collect()], 1.0)
    h = spark.createDataFrame([("u", str(i), i + 1) for i in range(6)], "request_id string, article_id string, hpos int")
    u = E.encode_users(h, v, "request_id", w, 16).first()["user_vector"]
    assert len(u) == 16 and np.isclose(np.linalg.norm(u), 1.0)


def test_entry_state_is_linear_in_the_log(spark):
    """A subject over many blocks: each block starts with at most the last reads and what its positives can ask for."""
    import random

    rnd = random.Random(2)
    rows, n_pos, blocks = [], 0, 40
    for b in range(blocks):
        for k in range(30):
            at = f"2024-01-01T{b // 60:02d}:{b % 60:02d}:{k:02d}"
            if rnd.random() < 0.1:
                n_pos += 1
                rows.append(("s", b, at, 1, [], [], f"a{rnd.randint(0, 400)}"))
            else:
                shown = [f"a{rnd.randint(0, 400)}" for _ in range(5)]
                rows.append(("s", b, at, 0, shown, [(p, a, None) for p, a in enumerate(shown)], None))
    keyed = spark.createDataFrame(rows, "subject string, blk int, created_at string, kind int, ids array<string>, items array<struct<p: int, a: string, d: string>>, article_id string")
    assert S._entry_state(keyed, 20, 4).count() <= blocks * (20 + 4) + n_pos
    assert S.pruned([("a", None), ("b", "t"), ("c", None), ("d", "t"), ("e", None)], 2) == [("a", None), ("b", "t"), ("c", None)]


def test_places_beyond_the_broadcast_head_give_the_same_samples(spark, monkeypatch):
    rnd = random.Random(9)
    events = spark.createDataFrame([(f"e{k}", f"s{k % 3}", None, "click_article", f"a{rnd.randint(0, 30)}", None, f"2024-01-01T10:{k // 60:02d}:{k % 60:02d}") for k in range(200)],
                                   "log_id string, session_id string, user_id string, event_type string, article_id string, event_data string, created_at string")
    feedback = spark.createDataFrame([], "feedback_id string, user_id string, feedback_type string, article_id string, created_at string")
    catalog = spark.createDataFrame([(f"a{k}",) for k in range(60)], "article_id string")
    whole = sorted(map(str, SM.legacy_samples(events, feedback, catalog).collect()))
    monkeypatch.setattr(SM, "HEAD_PLACES", 5)
    assert sorted(map(str, SM.legacy_samples(events, feedback, catalog).collect())) == whole and len(whole) > 150
