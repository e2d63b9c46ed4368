import re

import numpy as np
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from pressgrid.functions import arrow as A, payload as P, text as T
from pressgrid.operators import near_dup as N
from pressgrid.operators.vector_topk import cosine_topk
from pressgrid.sources import pages as PG


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="가나다. \nabc[]!", max_size=2500))
def test_chunks_hold_the_limits(text):
    chunks = A.chunk_text(text)
    assert all(0 < len(c) <= 400 for c in chunks)
    start, end = -1, 0
    for c in chunks:  # in order, and nothing but blanks between two chunks
        at = text.index(c, max(start + 1, end - 150))
        assert not text[end:at].strip()
        start, end = at, at + len(c)
    assert not text[end:].strip()


def test_chunks_cover_and_overlap():
    text = " ".join(f"문장 {i}번입니다." for i in range(200))
    chunks = A.chunk_text(text)
    assert len(chunks) > 3 and all(f"문장 {i}번입니다" in " ".join(chunks) for i in range(200))
    assert any(chunks[0].endswith(chunks[1][:n]) for n in range(10, 151))


def test_body_cleaning():
    raw = "[단독] 우리일보 = 홍길동 기자 = 오늘 비가 왔다. 문의 02-123-4567 내일은 맑다. (서울) 메일 a@b.com 끝없는 꼬리"
    out = A.clean_body_text(raw)
    assert out.startswith("오늘 비가 왔다.") and "기자" not in out and out.endswith(".") and A.clean_body_text(out) == out


def test_redaction():
    out = A.redact_text('{"Password": 1, "a": [{"api_key": "k", "b": "' + "x" * 600 + '"}]}')
    assert '"Password": "[REDACTED]"' in out and '"api_key": "[REDACTED]"' in out and "...[TRUNCATED]" in out


def test_impressions(spark):
    rows = ['{"article_ids": ["a1", "a2"]}', '{"articles": [{"article_id": "b", "position": 7}, {"article_id": ""}, "c"]}', "broken", None]
    df = spark.createDataFrame([(r,) for r in rows], "e string")
    got = [[tuple(i) for i in r[0]] for r in df.select(P.impression_items(F.col("e"))).collect()]
    assert got == [[("a1", 0), ("a2", 1)], [("b", 7), ("c", 2)], [], []]


def test_dates(spark):
    raw = ["2026-03-01 09:30:11", "2026.03.01. 오후 3:05", "2026.03.01. 오후 12:05", "어제"]
    df = spark.createDataFrame([(r,) for r in raw], "d string")
    got = [r[0] for r in df.select(F.date_format(T.parse_news_date(F.col("d")), "yyyy-MM-dd HH:mm")).collect()]
    assert got == ["2026-03-01 09:30", "2026-03-01 15:05", "2026-03-01 12:05", None]


def words(t):
    return set(re.findall(r"\w+", t))


def brute_drop(titles, threshold):
    kept, dropped = [], set()
    for i, t in enumerate(titles):
        a = words(t)
        if any(a | words(titles[j]) and len(a & words(titles[j])) / len(a | words(titles[j])) >= threshold for j in kept):
            dropped.add(str(i))
        else:
            kept.append(i)
    return dropped


def test_greedy_near_duplicates_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    base = [[f"w{rng.integers(30)}" for _ in range(rng.integers(1, 9))] for _ in range(40)]
    titles = []
    for _ in range(220):
        t = list(base[rng.integers(len(base))])
        if rng.random() < 0.5:
            t[rng.integers(len(t))] = f"w{rng.integers(30)}"
        if rng.random() < 0.3:
            t.append(f"w{rng.integers(30)}")
        titles.append(" ".join(t))
    titles += ["", "  ", titles[0], titles[0]]
    df = spark.createDataFrame([(str(i), i, t) for i, t in enumerate(titles)], "id string, n int, title string")
    for threshold in (0.7, 0.8):
        got = {r["id"] for r in N.greedy_dropped(df, "id", F.col("title"), [F.col("n")], threshold).collect()}
        assert got == brute_drop(titles, threshold)


def test_vector_topk_equals_brute_force_with_many_cells(spark):
    rng = np.random.default_rng(7)
    centers = rng.normal(size=(6, 8)) * 3
    v = np.round(centers[rng.integers(6, size=180)] + rng.normal(size=(180, 8)), 3)
    df = spark.createDataFrame([(str(i), x.tolist()) for i, x in enumerate(v)], "cid string, cvec array<double>")
    q = df.selectExpr("cid as qid", "cvec as qvec", "cid as qkey")
    got = {(r["qid"], r["cid"]) for r in cosine_topk(q, df.withColumn("ckey", F.col("cid")), 3, 0.6, block_rows=32, pivot_count=9).collect()}
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    s = np.round(u @ u.T, 9)
    want = set()
    for i in range(len(v)):
        order = sorted((j for j in range(len(v)) if j != i and s[i, j] >= 0.6), key=lambda j: (-s[i, j], str(j)))
        want |= {(str(i), str(j)) for j in order[:3]}
    assert got == want


def test_page_fields():
    html = ('<html><h2 id="title_area">[속보] 긴 제목입니다</h2><em class="media_end_head_top_logo"><img alt="연합뉴스"></em>'
            '<div class="x _article_content">본문 <script>var a;</script><p>둘째<span class="ad_area">광고</span></p></div>'
            '<span class="author"><em>2026.01.02. 오후 1:00</em></span></html>')
    from pressgrid import constants as K
    title, source, when, body, reporter = PG.page_fields(html, K.PAGE_SELECTORS)
    assert (source, body, title.strip()) == ("연합뉴스", "본문 둘째", "긴 제목입니다")
    assert when == "2026.01.02. 오후 1:00" and reporter == when


def test_bodies_are_cleaned_in_parts(spark):
    """A batch is cut into views of bounded bytes, nulls and long texts included, and cleaned as one text at a time would be."""
    import pyarrow as pa
    from pressgrid.functions import arrow
    texts = ["기자 본문. 끝", None, "", "x" * (arrow.PART_BYTES + 5) + ". y"] + [f"문장 {n}. [표] 남음" * 5000 for n in range(60)]
    parts = arrow._parts(pa.array(texts, pa.string()))
    assert [t for p in parts for t in p.to_pylist()] == texts and len(parts) > 2
    assert all(len(p) == 1 or sum(len(t.encode()) for t in p.to_pylist() if t) <= arrow.PART_BYTES for p in parts)
    assert [len(p) for p in arrow._parts(pa.array([], pa.string()))] == [0]
    some = texts[:3] + ["a. b", texts[4]]
    frame = spark.createDataFrame(list(enumerate(some)), "n int, body string").coalesce(1)
    got = [r.body for r in frame.withColumn("body", arrow.clean_news_body("body")).orderBy("n").collect()]
    assert got == [arrow.clean_body_text(t) for t in some]
