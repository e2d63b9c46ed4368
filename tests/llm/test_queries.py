"""Registered queries: against their SQL on the smallest tables, and the pipeline against brute force."""
from collections import Counter, defaultdict

import numpy as np
import pyarrow.parquet as pq
import pytest

import __spark_entry__ as entry
import compare
import corpus_pipeline
from pressgrid.llm import line_frequency, load, packing
from test_operators import brute_hits, brute_kept, brute_print, brute_roots, check_places

SF = "/root/testdata/sf0.001"


def test_every_operator_is_registered_once():
    names = [n for n in entry.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14)) and "pipeline" in entry.queries()
    assert set(load()[0]) <= set(entry.queries()) and set(load()[1]) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(load()[1]))
def test_matches_sql(spark, name):
    _, _, status, detail = compare.check(spark, SF, name, entry.queries()[name], entry.oracle_sql()[name])
    assert status == "ok", detail


def test_language_held_out_accuracy(spark):
    docs = {r["doc_id"]: r["lang"] for r in pq.read_table(f"/root/testdata/sf0.01/documents.parquet").to_pylist()}
    rows = [r for r in entry.queries()["op10_language_mixture"](spark, "/root/testdata/sf0.01").collect() if r.held_out]
    assert rows and sum(docs[r.doc_id] == r.lang_pred for r in rows) >= 0.98 * len(rows)


def _without_boilerplate(docs):
    pages, held = defaultdict(set), defaultdict(set)
    for d in docs:
        pages[d["source"]].add(d["text"])
        for line in d["text"].split("\n"):
            if line.strip(" "):
                held[d["source"], line.strip(" ")].add(d["text"])
    gone = {k for k, v in held.items() if len(v) >= max(2, min(line_frequency.MIN_PAGES, len(pages[k[0]]))) and len(v) > len(pages[k[0]]) * line_frequency.MAX_RATIO}
    return [d | {"text": "\n".join(x for x in d["text"].split("\n") if (d["source"], x.strip(" ")) not in gone)} for d in docs]


def test_pipeline_equals_brute_force(spark):
    from tokenizers import Tokenizer
    docs = pq.read_table(f"{SF}/documents.parquet").to_pylist()
    docs = _without_boilerplate([d for d in docs if brute_kept(d["text"])])
    roots = brute_roots([brute_print(d["text"]) for d in docs], 4)
    first = {}
    for d, r in zip(docs, roots):
        first[r] = d if r not in first or d["doc_id"] < first[r]["doc_id"] else first[r]
    docs = list(first.values())
    items = [(r["item_id"], r["text"]) for r in pq.read_table(f"{SF}/benchmark.parquet").to_pylist()]
    hits = brute_hits({d["doc_id"]: d["text"] for d in docs}, items)
    docs = [d for d in docs if not hits[d["doc_id"]][1]]
    encoder = Tokenizer.from_file(packing.tokenizer_path())
    want = Counter()
    for d in docs:
        n = len(encoder.encode(d["text"], add_special_tokens=False).ids) + 1
        want.update((d["doc_id"], d["lang"], d["source"], k // 4096, k, min(4096, n - k)) for k in range(0, n, 4096))
    rows = corpus_pipeline.run(spark, SF).collect()
    assert Counter((r.doc_id, r.lang, r.source, r.piece, r.start, r.length) for r in rows) == want
    n = check_places(rows, 4096)
    assert n <= 1.02 * len(packing.best_fit([r.length for r in rows], 4096)) + 1


def test_stages_keep_the_columns_and_take_odd_tables(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = docs.limit(5).unionByName(spark.createDataFrame([(None, None, None, None, None), (7, "", "en", None, 0)], docs.schema))
    for frame in (odd, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, frame, SF)
            assert out.columns == docs.columns, name
            assert out.count() <= frame.count()
        assert corpus_pipeline.STAGES[-1][1](spark, frame, SF).count() >= frame.count()
