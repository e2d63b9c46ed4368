"""Saved vector index against brute force: searches, thresholds, counts, added vectors."""
import numpy as np
import pytest

from pressgrid.operators import vector_index as VI
from pressgrid.operators.vector_rank import better_articles
from pressgrid.session import new_path


def clustered(seed: int, n: int, dim: int = 12):
    rnd = np.random.default_rng(seed)
    return np.concatenate([c + rnd.normal(0, 0.05, (n // 6, dim)) for c in np.eye(dim)[:6]])


def table(spark, points, offset=0):
    return spark.createDataFrame([(f"c{offset + k}", p.tolist()) for k, p in enumerate(points)], "cid string, cvec array<double>")


def scores_of(asked, points):
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    return np.round(unit(asked) @ unit(points).T, 9)


@pytest.fixture(scope="module")
def saved(spark):
    points = clustered(1, 300)
    path = new_path(spark, "index-test")
    VI.create(table(spark, points), path, cells=12)
    return path, points


def test_a_reopened_index_fits_nothing_and_finds_the_same(spark, saved, monkeypatch):
    path, points = saved
    monkeypatch.setattr(VI, "fit_centroids", lambda *a: pytest.fail("fitted again"))
    asked = points[::17] + 0.01
    q = spark.createDataFrame([(f"q{k}", p.tolist()) for k, p in enumerate(asked)], "qid string, qvec array<double>")
    s = scores_of(asked, points)
    index = VI.open_index(spark, path)
    for block_rows in (7, 2048):
        got = {}
        for r in index.topk(q, 4, block_rows=block_rows).collect():
            got.setdefault(r.qid, {})[r["rank"]] = (r.cid, r.score)
        for k in range(len(asked)):
            best = sorted(range(len(points)), key=lambda j: (-s[k, j], f"c{j}"))[:4]
            assert [got[f"q{k}"][i + 1][0] for i in range(4)] == [f"c{j}" for j in best]
        pairs = {(r.qid, r.cid) for r in index.within(q, 0.95, block_rows).collect()}
        assert pairs == {(f"q{k}", f"c{j}") for k, j in zip(*np.nonzero(s >= 0.95))}


def test_added_vectors_are_found_and_old_files_stay(spark, saved):
    path = new_path(spark, "index-add")
    points, more = saved[1], clustered(2, 60) * 3
    index = VI.create(table(spark, points), path, cells=9)
    before = set(index.vectors.inputFiles())
    grown = index.add(table(spark, more, len(points)))
    assert before < set(grown.vectors.inputFiles()) and VI.open_index(spark, path).generation == 1
    everything = np.concatenate([points, more])
    asked = everything[5::23]
    q = spark.createDataFrame([(f"q{k}", p.tolist()) for k, p in enumerate(asked)], "qid string, qvec array<double>")
    s = scores_of(asked, everything)
    want = {(f"q{k}", f"c{j}") for k in range(len(asked)) for j in sorted(range(len(everything)), key=lambda j: (-s[k, j], f"c{j}"))[:3]}
    assert {(r.qid, r.cid) for r in VI.open_index(spark, path).topk(q, 3).collect()} == want


def test_ranks_by_bounds_equal_brute_force_and_visit_few_cells(spark):
    rnd = np.random.default_rng(4)
    points = clustered(3, 360)
    owner = np.arange(len(points)) // 2  # two chunks an article
    points[1] = -points[0]  # a unit without a mean direction
    rows = [(f"k{j}", f"a{o}", p.tolist()) for j, (o, p) in enumerate(zip(owner, points))]
    chunks = spark.createDataFrame(rows, "chunk_id string, article_id string, embedding array<double>")
    asked = points[::2] + rnd.normal(0, 0.02, (180, points.shape[1]))
    queries = spark.createDataFrame([(f"a{k}", p.tolist()) for k, p in enumerate(asked)], "article_id string, vector array<double>")
    best = scores_of(asked, points).reshape(len(asked), -1, 2).max(axis=2)
    want = {f"a{k}": 1 + sum((best[k, j] > best[k, k]) or (best[k, j] == best[k, k] and f"a{j}" > f"a{k}") for j in range(180)) for k in range(180)}
    from pressgrid.operators.vector_rank import chunk_units
    index = VI.create(chunk_units(chunks), new_path(spark, "index-rank"), cells=18)
    assert {r.article_id: r["rank"] for r in better_articles(queries, chunks, index).collect()} == want
    assert index.visits.first().visits < 0.5 * 180 * 18


def test_empty_and_unusable_vectors(spark):
    none = spark.createDataFrame([("a", None), ("b", [0.0, 0.0])], "cid string, cvec array<double>")
    index = VI.create(none, new_path(spark, "index-none"))
    q = spark.createDataFrame([("q", [1.0, 0.0])], "qid string, qvec array<double>")
    assert index.topk(q, 3).count() == index.within(q, 0.1).count() == 0
