"""Searches that send the vectors to the queries, and the recommendation stages around them."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from pressgrid.operators import vector_index as VI, vector_sent as VS
from pressgrid.plans import encoders as E, recommend as R, search as S
from pressgrid.session import new_path


def table(n, seed, copies=0):
    rng = np.random.default_rng(seed)
    v = rng.normal(size=(n, 6)) + 3 * np.eye(6)[rng.integers(0, 3, n)]
    return np.concatenate([v, v[:1].repeat(copies, 0)])


@pytest.fixture(scope="module", params=[(1 << 25, 4096, 1024, 1 << 22), (1 << 12, 50, 7, 64)])
def sizes(request):
    """As they are, and so small that cells are cut, slabs change and hits are cut on the way."""
    names = ("SLAB_BYTES", "LOOK_ROWS", "QUERY_ROWS", "WAITING")
    before = [getattr(VS, n) for n in names]
    for n, v in zip(names, request.param):
        setattr(VS, n, v)
    yield request.param
    for n, v in zip(names, before):
        setattr(VS, n, v)


@pytest.mark.parametrize("k,floor,exclude", [(5, 0.3, True), (40, None, False), (12, 0.9, False)])
def test_sent_vectors_give_the_best_in_order(spark, sizes, k, floor, exclude):
    c, q = table(500, 1, 120), table(60, 2)
    name = lambda i: f"v{i:03d}"
    corpus = spark.createDataFrame([(name(i), f"u{i // 4}", v.tolist()) for i, v in enumerate(c)], "cid string, ckey string, cvec array<double>")
    asked = spark.createDataFrame([(f"q{i}", v.tolist(), f"u{i}") for i, v in enumerate(q)], "qid string, qvec array<double>, qkey string")
    index = VI.create(corpus, new_path(spark, "index"), cells=9)
    asked = asked if exclude else asked.drop("qkey")
    scores = np.round((q / np.linalg.norm(q, axis=1, keepdims=True)) @ (c / np.linalg.norm(c, axis=1, keepdims=True)).T, 9)
    want, units = {}, {}
    for i in range(len(q)):
        hits = sorted((-scores[i, j], name(j), f"u{j // 4}") for j in range(len(c)) if (floor is None or scores[i, j] >= floor) and not (exclude and i == j // 4))[:k]
        want[f"q{i}"] = [(h[1], -h[0]) for h in hits]
        best = {}
        for h in hits:
            best.setdefault(h[2], (h[0], h[2], h[1]))
        units[f"q{i}"] = [(u, cid, -s) for s, u, cid in sorted(best.values())][:3]
    got = {f"q{i}": [] for i in range(len(q))}
    for r in index.topk(asked, k, floor, unique=True).orderBy("rank").collect():
        got[r.qid].append((r.cid, r.score))
    assert got == want
    got = {f"q{i}": [] for i in range(len(q))}
    for r in index.best_units(asked, k, 3, floor).orderBy("rank").collect():
        got[r.qid].append((r.unit, r.cid, r.score))
    assert got == units
    assert max(s.value.nbytes for s in index.sent_vectors().slabs) <= VS.SLAB_BYTES * 2


def test_no_hit_of_profiles_and_encoders_is_shuffled(spark, monkeypatch):
    """Of the top 5 x 30 chunks of a profile only its articles leave the search, and no query is routed to cells."""
    written, plain = [], VI.write_once
    monkeypatch.setattr(VI, "write_once", lambda df, name="table": written.append(name) or plain(df, name))
    v = table(400, 3)
    chunks = spark.createDataFrame([(str(i), str(i // 4), x.tolist()) for i, x in enumerate(v)], "chunk_id string, article_id string, embedding array<double>")
    articles = spark.createDataFrame([(str(i),) for i in range(100)], "article_id string")
    profiles = spark.createDataFrame([(f"r{i}", x.tolist()) for i, x in enumerate(table(20, 4))], "request_id string, profile array<double>")
    history = spark.createDataFrame([("r1", "3", 1), ("r1", "4", 6), (None, "5", 1)], "request_id string, article_id string, hpos int")
    index = VI.create(S.known_chunks(chunks, articles), new_path(spark, "index"))
    rows = R.profile_candidates(profiles, chunks, articles, history, 10, index)
    learned = chunks.select("article_id", F.col("embedding").alias("learned_embedding")).dropDuplicates(["article_id"])
    users = profiles.withColumnRenamed("profile", "user_vector")
    enc = R.encoder_candidates(users, learned, history, 10)
    assert "routes" not in written and "queries" not in written
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "cogroup" not in plan.lower().replace(" ", "")
    old = S.semantic_search(profiles.toDF("query_id", "query_vector"), chunks, articles, 30, 0.35, index=index).where("not (query_id = 'r1' and article_id = '3')")
    assert sorted(map(tuple, rows.collect())) == sorted((r.query_id, r.article_id, r.score) for r in old.collect())
    assert {r.n for r in enc.groupBy("request_id").agg(F.count("*").alias("n")).collect()} == {20} and enc.where("request_id = 'r1' and article_id = '3'").isEmpty()


def test_both_sides_of_a_profile_come_in_one_row(spark):
    rows = [("a", 0, "x", 1), ("a", 0, "y", 2), ("a", 1, "y", 1), ("b", 1, "z", 3), ("c", 0, "none", 1), (None, 1, "x", 1)]
    history = spark.createDataFrame(rows, "request_id string, src int, article_id string, pos int")
    vectors = spark.createDataFrame([("x", [1.0, 0.0]), ("y", [0.0, 2.0]), ("z", [3.0, 1.0])], "article_id string, embedding array<double>")
    got = {r.request_id: (r.s, r.u) for r in E.recency_weighted_sides(history, vectors, "request_id", "src", F.col("pos") - 1, 2).collect()}
    w = 0.5 ** 0.2
    assert set(got) == {"a", "b", None} and np.allclose(got["a"], [[1 / (1 + w), 2 * w / (1 + w)], [0, 2]]) and np.allclose(got["b"], [[0, 0], [3, 1]])
    assert np.allclose(got[None], [[0, 0], [1, 0]])
