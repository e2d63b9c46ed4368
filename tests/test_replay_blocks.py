import math
import random

import numpy as np
from pyspark.sql import functions as F

from pressgrid.operators import vector_index as VI
from pressgrid.operators.vector_rank import better_articles, chunk_units
from pressgrid.plans import replay as R, sample_blocks as B, samples as SM
from pressgrid.session import new_path
from pressgrid.sources import views as V

META = "article_id string, category string, published_at string, trust_score int, embedding array<double>"
SAMPLE = "sample_id string, positive string, history array<string>, negatives array<string>"


def world(spark):
    """25 articles, some without a vector, one of zero length, one twice; samples name unknown articles and one id is shared."""
    rnd = random.Random(5)
    meta = [(f"a{j}", None if j % 5 == 0 else f"c{j % 3}", f"2024-{j:02d}", j, None if j % 6 == 0 else [0.0] * 4 if j == 7 else [rnd.uniform(-1, 1) for _ in range(4)]) for j in range(25)]
    meta.append(("a3", "c0", "2024-99", 1, [1.0, 0.0, 0.0, 0.0]))
    name = lambda: f"a{rnd.randint(0, 27)}"
    samples = [(f"s{k}", name(), [name() for _ in range(rnd.choice([1, 5, 20, 24]))], [name() for _ in range(3)]) for k in range(60)]
    samples.append(("s0", "a4", ["a8"], ["a9", "a10", "a11"]))
    return samples, meta, spark.createDataFrame(samples, SAMPLE), spark.createDataFrame(meta, META)


def profile_of(reads, vectors, skip_unknown):
    """reads: latest first."""
    kept = [(a, n) for n, a in enumerate(reads) if not skip_unknown or a in vectors]
    kept = [(a, n if not skip_unknown else i) for i, (a, n) in enumerate(kept)]
    pairs = [(0.5 ** (n / 5), v) for a, n in kept if n < 20 for v in vectors.get(a, [])]
    return np.sum([w * np.array(v) for w, v in pairs], axis=0) / sum(w for w, _ in pairs) if pairs else None


def test_candidates_and_weights_in_blocks_equal_brute_force(spark, monkeypatch):
    samples, meta, s, m = world(spark)
    vectors, known = {}, {}
    for a, *rest in meta:
        known.setdefault(a, []).append(rest)
        if rest[-1] is not None:
            vectors.setdefault(a, []).append(rest[-1])
    want, weights = [], {}
    for sid, positive, history, negatives in samples:
        if sid == "s0":
            continue
        p = profile_of(history[::-1], vectors, True)
        for a, n in zip(history[::-1], range(20)):
            for rest in known.get(a, [[None]]):
                key = (sid, rest[0] or "unknown")
                weights[key] = weights.get(key, 0.0) + 0.5 ** (n / 5)
        for c, a in enumerate([positive, *negatives]):
            for category, at, trust, v in known.get(a, [[None, "", 0, None]]):
                cos = None
                if v is not None and p is not None and any(p):
                    cos = round(float(np.dot(p, v) / np.linalg.norm(p) / np.linalg.norm(v)), 6) if any(v) else 0.0
                want.append((sid, c, a, category or "unknown", at, trust, cos, v is not None, p is not None and bool(np.any(p))))
    for size in (1, 7, 4096):
        monkeypatch.setattr(B, "BLOCK_SAMPLES", size)
        rows = R.candidate_rows(s, m, 4).where("sample_id <> 's0'").withColumn("cosine", F.round("cosine", 6)).collect()
        assert sorted(map(repr, (tuple(r) for r in rows))) == sorted(map(repr, want))
        got = {(r.sample_id, r.category): r.weight for r in R.sample_category_weights(s, m).where("sample_id <> 's0'").collect()}
        assert got.keys() == weights.keys() and all(math.isclose(got[k], weights[k]) for k in got)
        # the two samples of one id are one group, as for a join on the id
        assert R.candidate_rows(s, m, 4).where("sample_id = 's0'").select("has_profile").distinct().count() == 1


def test_mixed_replay_in_blocks_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(B, "BLOCK_SAMPLES", 7)
    samples, meta, s, m = world(spark)
    raw = {a: [v] for a, _, at, _, v in meta if v is not None and any(v) and at != "2024-99"}
    learned = {a: [v[0][::-1]] for a, v in raw.items() if int(a[1:]) % 2}
    table = lambda d, c: spark.createDataFrame([(a, v[0]) for a, v in d.items()], f"article_id string, {c} array<double>")
    for mixed in (False, True):
        ranks = []
        for sid, positive, history, negatives in samples:
            p, shown = profile_of(history[::-1], {**raw, **learned} if mixed else raw, False), [positive, *negatives]
            if sid != "s0" and p is not None and all(a in raw for a in shown):
                score = [(round(float(np.dot(p, raw[a][0]) / np.linalg.norm(p) / np.linalg.norm(raw[a][0])), 9), a) for a in shown]
                if len(set(shown)) == len(shown):
                    ranks.append(1 + sum(x > score[0] for x in score))
        few = s.where("sample_id <> 's0' and size(array_distinct(concat(array(positive), negatives))) = 4")
        got = R.mixed_profile_replay(few, table(raw, "embedding"), table(learned, "learned_embedding"), mixed, dim=4).first()
        assert (got.n, round(got.mrr, 6)) == (len(ranks), round(sum(1 / r for r in ranks) / len(ranks), 6))


def test_an_impression_is_parsed_once(spark, tmp_path):
    e = spark.createDataFrame([(1, 1, "error", 1.0, '{"k": 3}')], "event_id long, user_id long, event_type string, value double, props string")
    e = e.withColumn("ts", F.lit("2024-01-01 00:00:00").cast("timestamp"))
    e.write.parquet(str(tmp_path / "events.parquet"))
    log = V.event_log(spark, str(tmp_path))
    seen, _ = SM.actions(log, V.feedback(spark, str(tmp_path)), spark.createDataFrame([("3",), ("5",)], "article_id string"))
    assert [r.ids for r in seen.collect()] == [["3", "5"]]
    plan = seen._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("try_parse_json") + plan.count("parseJson") <= 2  # the text and the empty object


def test_units_are_counted_in_areas_of_cells(spark, monkeypatch):
    rnd = np.random.default_rng(8)
    points = rnd.normal(size=(400, 5))
    points[40:60] = points[4]  # copies, in several units
    owner = np.arange(400) // 2
    chunks = spark.createDataFrame([(f"k{j}", f"a{o}", p.tolist()) for j, (o, p) in enumerate(zip(owner, points))], "chunk_id string, article_id string, embedding array<double>")
    asked = points[::2] + rnd.normal(0, 0.5, (200, 5))
    asked[25] = points[4]
    queries = spark.createDataFrame([(f"a{k}", p.tolist()) for k, p in enumerate(asked)], "article_id string, vector array<double>")
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    best = np.round(unit(asked) @ unit(points).T, 9).reshape(200, -1, 2).max(axis=2)
    want = {f"a{k}": 1 + sum((best[k, j] > best[k, k]) or (best[k, j] == best[k, k] and f"a{j}" > f"a{k}") for j in range(200)) for k in range(200)}
    index = VI.create(chunk_units(chunks), new_path(spark, "index-areas"), cells=20)
    for wide, step in ((64, 16), (150, 2048), (16384, 2048)):
        monkeypatch.setattr(VI, "WIDE_ROWS", wide)
        assert {r.article_id: r["rank"] for r in better_articles(queries, chunks, index, step).collect()} == want
    areas = index._areas(150)
    assert len(set(areas)) < 20 and all(index.count[areas == a].sum() <= max(150, index.count[areas == a].max()) for a in set(areas))
