"""What travels and what is written: bounds that keep large inputs within memory and disk."""
import numpy as np
from pyspark.sql import functions as F

from pressgrid.operators import vector_index as VI
from pressgrid.operators.postings import create_postings
from pressgrid.plans import encoders as E, ingest as G, recommend as R, search as S
from pressgrid.session import new_path


def spied(monkeypatch, module):
    written, plain = [], module.write_once

    def spy(df, name="table"):
        out = plain(df, name)
        written.append((name, out.columns, out.count()))
        return out
    monkeypatch.setattr(module, "write_once", spy)
    return written


def test_the_first_block_gives_floors_and_no_hits(spark, monkeypatch):
    rnd = np.random.default_rng(1)
    points = np.concatenate([c + rnd.normal(0, 0.1, (50, 8)) for c in np.eye(8)[:4]])
    frame = spark.createDataFrame([(f"c{k:03d}", p.tolist()) for k, p in enumerate(points)], "cid string, cvec array<double>")
    index = VI.create(frame, new_path(spark, "index-floor"), cells=4)
    met, real = [], VI.VectorIndex._meet

    def meet(self, *args, first_block=False, **more):
        out = real(self, *args, first_block=first_block, **more)
        return met.append(out) or out if first_block else out
    monkeypatch.setattr(VI.VectorIndex, "_meet", meet)
    q = frame.where("cid < 'c060'").select(F.col("cid").alias("qid"), F.col("cvec").alias("qvec"))
    got = {(r.qid, r.cid) for r in index.topk(q, 5).collect()}
    unit = points / np.linalg.norm(points, axis=1, keepdims=True)
    scores = np.round(unit @ unit.T, 9)
    assert got == {(f"c{k:03d}", f"c{j:03d}") for k in range(60) for j in np.argsort(-scores[k], kind="stable")[:5]}
    floors = {r.qid: r.floor for r in met[0].collect()}
    assert len(floors) == met[0].count() == 60
    assert all(f <= np.sort(scores[int(q[1:])])[-5] + 1e-12 for q, f in floors.items()) and min(floors.values()) > 0


def test_a_block_gets_each_vector_once(spark):
    rows = spark.createDataFrame([(f"s{k % 100}", f"a{k % 7}") for k in range(700)], "s string, article_id string")
    vectors = spark.createDataFrame([(f"a{k}", [float(k), 1.0]) for k in range(9)], "article_id string, vector array<double>")

    def sizes(_key, r, v):
        import pandas as pd
        return pd.DataFrame({"rows": [len(r)], "vectors": [len(v)]})
    assert [tuple(r) for r in E._with_vectors(rows, ["s"], vectors, sizes, "rows long, vectors long").collect()] == [(700, 7)]


def test_candidates_hold_the_rarest_terms(spark, monkeypatch):
    docs = [(f"d{k}", "", "공통 흔한 " + ("희귀 드문 특별" if k == 7 else "희귀" if k < 20 else "다른")) for k in range(40)]
    index = create_postings(spark.createDataFrame(docs, "article_id string, title string, full_text string"), new_path(spark, "postings-test"))
    written = spied(monkeypatch, S)
    got = S.bm25_search(spark.createDataFrame([("q", "공통 흔한 희귀 드문 특별"), ("none", "공통 없는말")], "query_id string, query string"), index).collect()
    assert [(r.query_id, r.article_id, r["rank"]) for r in got] == [("q", "d7", 1)]
    assert [n for name, _, n in written if name == "candidates"] == [1]


def test_fallback_keeps_a_request_in_one_row(spark):
    articles = spark.createDataFrame([(f"a{k}", "xyz"[k % 3], None if k == 3 else f"2024-01-{k + 1:02d}", k) for k in range(20)],
                                     "article_id string, category string, published_at string, trust_score int")
    histories = spark.createDataFrame([("r", "a19", "y"), ("r", "a0", "x"), ("s", "a5", "z"), ("t", "a1", None)], "request_id string, article_id string, category string")
    out = R.category_fallback(histories, articles, 4)
    got = sorted((r.request_id, r.pos, r.article_id) for r in out.collect())
    assert got == [("r", 1, "a18"), ("r", 2, "a16"), ("r", 3, "a15"), ("r", 4, "a13"), ("s", 1, "a17"), ("s", 2, "a14"), ("s", 3, "a11"), ("s", 4, "a8")]
    assert "LeftAnti" not in out._jdf.queryExecution().toString()


def test_bodies_are_written_once(spark, monkeypatch):
    written = spied(monkeypatch, G)
    body = "가나다라 마바사 " * 20
    raw = spark.createDataFrame([("1", "첫 기사", "r", body + "하나."), ("2", "첫 기사 제목", "r", body + "하나."), ("3", "다른 소식", "?", body + "둘."), ("4", "새 소식 하나", "r", body + "셋."),
                                 ("5", "옛 소식", "r", body + "넷.")], "article_id string, title string, reporter string, content string")
    out = G.ingest_clean_dedupe(raw, spark.createDataFrame([("옛 소식",)], "title string")).collect()
    assert sorted((r.article_id, r.reporter) for r in out) == [("2", "r 기자"), ("4", "r 기자")]
    assert sum("content" in columns for _, columns, _ in written) == 1
