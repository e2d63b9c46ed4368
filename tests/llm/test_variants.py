"""Spelling variants, toxicity and the Merkle manifest against brute force."""
import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from conftest_llm import prose
from pressgrid.llm import merkle_manifest as MM, spelling_variants as SV, toxicity as TX

SF = "/root/testdata/sf0.001"


def table(name, sf=SF):
    return pq.read_table(f"{sf}/{name}.parquet").to_pylist()


# --- 11 -------------------------------------------------------------------------------------------

def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:k] + b[k + 1:] == a for k in range(len(b)))


def brute_variants(docs, slip, min_length=6, min_count=5, ratio=5):
    count = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{doc_id}:{run}".encode())
            if slip and doc_id is not None and h % slip == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            count[run] += 1
    words = {w: n for w, n in count.items() if len(w) >= min_length and n >= min_count}
    near = {w: [x for x in words if one_edit(w, x)] for w in words}
    best = {w: min(near[w], key=lambda x: (-words[x], x)) for w in words if near[w]}
    form = {w: b for w, b in best.items() if words[b] >= ratio * words[w]}
    out = {}
    for w in words:
        root = w
        while root in form:
            root = form[root]
        out[w] = (words[w], len(near[w]), form.get(w), words.get(form.get(w)), root)
    return out


def variants_of(df):
    return {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in df.collect()}


def test_variants_of_the_documents_equal_brute_force(spark):
    want = brute_variants([(d["doc_id"], d["text"]) for d in table("documents")], 199)
    assert variants_of(entry.queries()["op11_spelling_variants"](spark, SF)) == want and any(v[2] for v in want.values())


def test_variants_of_dense_words_of_all_lengths(spark):
    """Few letters, so most words have many neighbours; long words, chains of forms, ties, letters beyond ASCII."""
    rnd = random.Random(5)
    words = ["".join(rnd.choice("abé") for _ in range(rnd.choice((6, 6, 7, 7, 8, 9)))) for _ in range(300)]
    for size in (12, 13, 16, 17, 40, 41, 300):
        base = "".join(rnd.choice("abcde") for _ in range(size))
        for at in (0, size // 2 - 1, size // 2, size // 2 + 1, size - 1):
            words += [base, base[:at] + base[at + 1:], base[:at] + "z" + base[at + 1:], base[:at] + "q" + base[at:], base + "x"]
    chain = ["forest", "foresta", "forestab", "forestabc"]
    text = " ".join(w for k, w in enumerate(words) for _ in range(1 + 7 ** (k % 4) % 60)) + " " + " ".join(w for k, w in enumerate(chain) for _ in range(5 ** (4 - k)))
    docs = [(1, text), (2, text.upper()), (3, None), (4, ""), (None, text), (1, "aaaaaa1bbbbbb×÷ ÉÉaaaa")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    for slip in (None, 3):
        assert variants_of(SV.spelling_variants(df, slip=slip)) == brute_variants(docs, slip)
    assert variants_of(SV.spelling_variants(df))["forestabc"][4] == "forest"


def test_variants_of_odd_and_empty_tables(spark, odd_docs, no_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.select("doc_id", "text").collect()]
    assert variants_of(SV.spelling_variants(odd_docs, slip=199)) == brute_variants(rows, 199)
    assert SV.spelling_variants(no_docs).count() == 0


# --- 12 -------------------------------------------------------------------------------------------

def brute_models(rows, fold):
    """P(word | before, class) of the texts outside a fold, by plain dictionaries; rows: (fold, class, words)."""
    pair, word, total = [Counter(), Counter()], [Counter(), Counter()], [Counter(), Counter()]
    for f, c, words in rows:
        if f != fold:
            held = set(zip([None] + words, words))
            pair[c].update(held)
            total[c].update(h for h, _ in held)
            word[c].update(set(words))
    cut = lambda n, errors: max(n - max(errors * math.sqrt(n), TX.DISCOUNT), 0) if n else 0
    number = [max(sum(w.values()), 1) for w in word]
    left = [1 - sum(cut(n, TX.WORD_ERRORS) for n in word[c].values()) / number[c] for c in (0, 1)]
    shared = word[0] + word[1]
    every = max(sum(shared.values()), 1)
    spare = 1 - sum(n - TX.DISCOUNT for n in shared.values()) / every

    def p(c, h, w):
        low = (max(shared[w] - TX.DISCOUNT, 0) / every if w in shared else 0) + spare / (len(shared) + 1)
        one = cut(word[c][w], TX.WORD_ERRORS) / number[c] + left[c] * low
        if not total[c][h]:
            return one
        rest = 1 - sum(cut(n, TX.PAIR_ERRORS) for (a, _), n in pair[c].items() if a == h) / total[c][h]
        return cut(pair[c][h, w], TX.PAIR_ERRORS) / total[c][h] + rest * one
    return p


@pytest.fixture(scope="module")
def spoken(spark):
    """(documents, labels): prose of few words, so that pairs outlive their discount; toxic texts have words of their own."""
    rnd = random.Random(8)
    common, rude = prose(rnd, 25).split(), ["zounds", "blighter", "knave"]
    docs, labels = [], []
    for k in range(240):
        toxic = k % 3 == 0
        words = [rnd.choice(common) for _ in range(rnd.randint(15, 40))]
        if toxic:
            for _ in range(4):
                at = rnd.randrange(len(words))
                words[at:at] = ["you", rnd.choice(rude)]
        docs.append((k, " ".join(words).title() + "."))
        labels.append((k, int(toxic)))
    return docs, labels


def test_ratios_equal_plain_dictionaries(spark, spoken):
    docs, labels = spoken
    df = spark.createDataFrame(docs, "doc_id long, text string")
    marks = spark.createDataFrame(labels, "doc_id long, toxic int")
    sample, _ = TX.labelled_sample(df.withColumnRenamed("doc_id", "id"), marks.withColumnRenamed("doc_id", "id"))
    sample = sample.withColumn("counted", F.lit(True))
    got = {r.text: r.ratio for r in TX.mean_ratios(sample, TX.train(sample), ["text"]).collect()}
    rows = [(r.fold, r.toxic, r.text, re.findall("[a-z0-9]+", r.text.lower())) for r in sample.collect()]
    assert len(rows) == len(docs)
    kept = 0
    for fold in range(TX.FOLDS):
        p = brute_models([(f, c, w) for f, c, _, w in rows], fold)
        for f, _, text, words in rows[::5]:
            if f == fold:
                raw = [math.log(p(1, h, w) / p(0, h, w)) for h, w in zip([None] + words, words)]
                drawn = [math.copysign(max(abs(min(max(x, -TX.LIMIT), TX.LIMIT)) - TX.MARGIN, 0), x) for x in raw]
                kept += any(drawn)
                assert abs(got[text] - sum(drawn) / len(words)) < 1e-9
    assert kept > 10


def test_scores_tell_the_classes_apart_and_depend_on_the_text_alone(spark, spoken):
    docs, labels = spoken
    df = spark.createDataFrame(docs + [(1000 + k, t) for k, t in docs], "doc_id long, text string")
    marks = spark.createDataFrame(labels, "doc_id long, toxic int")
    got = {r.doc_id: r for r in TX.toxicity(df, df.where("doc_id < 1000"), marks, keep=["doc_id"]).collect()}
    right = sum(got[k].predicted == toxic for k, toxic in labels)
    assert right >= 0.95 * len(labels)
    assert all(got[k].score == got[1000 + k].score and 0 <= got[k].score <= 1 for k, _ in docs)


def test_monotone_curve():
    knots = TX.monotone(np.array([-2.0, -1, 0, 1, 2, 3]), np.array([0.0, 3, 1, 5, 4, 10]), np.full(6, 10.0))
    assert [x for x, _ in knots] == sorted(x for x, _ in knots) and [y for _, y in knots] == sorted(y for _, y in knots)
    assert len(knots) == 4 and knots[1][0] == -0.5


def test_toxicity_held_out_accuracy(spark):
    """Of ten words that only toxic documents have, a document with several is caught; labels without them are noise."""
    sf = "/root/testdata/sf0.1"
    rude = set("trash pathetic idiot disgusting worthless stupid clown loser scum moron".split())
    held = lambda d: sum(w in rude for w in re.findall("[a-z]+", (d["text"] or "").lower()))
    found = {d["doc_id"]: held(d) for d in table("documents", sf)}
    rows = [r for r in entry.queries()["op12_toxicity"](spark, sf).select("doc_id", "held_out", "predicted").collect() if r.held_out]
    bad, good = [r for r in rows if found[r.doc_id] >= 2], [r for r in rows if not found[r.doc_id]]
    assert sum(r.predicted for r in bad) >= 0.9 * len(bad) and sum(r.predicted for r in good) <= 0.05 * len(good)


def test_toxicity_of_odd_and_empty_tables(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(10, 1), (10, 0), (11, 0), (None, 1), (12, None), (13, 5), (99, 1)], "doc_id long, toxic int")
    out = TX.toxicity(odd_docs, odd_docs, labels)
    rows = out.collect()
    assert len(rows) == odd_docs.count() and out.columns[-4:] == ["n_words", "ratio", "score", "predicted"]
    assert all(0 <= r.score <= 1 and (r.text or r.ratio == 0) for r in rows)
    none = TX.toxicity(odd_docs, odd_docs, labels.limit(0)).select("score", "predicted").distinct().collect()
    assert [tuple(r) for r in none] == [(0.5, 0)]
    assert TX.toxicity(no_docs, no_docs, labels).count() == 0


# --- 13 -------------------------------------------------------------------------------------------

def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def brute_tree(leaves):
    """(last node, path of each leaf) of a tree of runs of three."""
    paths, now = [[] for _ in leaves], [(d, [k]) for k, d in enumerate(leaves)]
    while len(now) > 1:
        above = []
        for a in range(0, len(now), 3):
            run = now[a:a + 3]
            for j, (_, own) in enumerate(run):
                for k in own:
                    paths[k].append(("".join(d for d, _ in run[:j]), "".join(d for d, _ in run[j + 1:])))
            above.append((sha("".join(d for d, _ in run)), [k for _, own in run for k in own]))
        now = above
    return now[0][0], paths


def brute_manifest(docs):
    part = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda d, text: sha("".join(part(v) for v in (d["doc_id"], d["source"], d["lang"], d["n_chars"], text)))
    groups = defaultdict(list)
    for d in docs:
        groups[d["source"]].append((d["doc_id"] is not None, d["doc_id"] or 0, leaf(d, d["text"]), d))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in order:
        groups[s].sort(key=lambda x: x[:3])
        trees[s] = brute_tree([x[2] for x in groups[s]])
    root, upper = brute_tree([trees[s][0] for s in order])
    out = Counter()
    for s, above in zip(order, upper):
        for (_, _, own, d), path in zip(groups[s], trees[s][1]):
            h, path = own, path + above
            if d["doc_id"] is not None and d["text"] is not None and zlib.crc32(str(d["doc_id"]).encode()) % 2 == 0:
                h = leaf(d, d["text"].replace("\n", ""))
            for a, b in path:
                h = sha(a + h + b)
            out[d["doc_id"], own, trees[s][0], root, sha("".join(a + b for a, b in path)), h, h == root] += 1
    return out


def test_manifest_of_the_documents_equals_brute_force(spark):
    got = Counter(map(tuple, entry.queries()["op13_merkle_manifest"](spark, SF).collect()))
    want = brute_manifest(table("documents"))
    assert got == want and 0 < sum(n for k, n in want.items() if not k[6]) < sum(want.values())


def checked(df, height):
    other = MM.tampered_text(F.col("doc_id"), F.col("text"))
    changed = F.when(~other.eqNullSafe(F.col("text")), MM.leaf_digest(*[F.col(c) if c != "text" else other for c in MM.COLUMNS]))
    rows = MM.manifest(df, extra={"tampered": changed}, height=height).withColumn("end", MM.folded(F.coalesce("tampered", "leaf"), F.col("path")))
    return Counter(tuple(r) for r in rows.select("doc_id", "leaf", "subroot", "root", MM.proof_digest(F.col("path")), "end", F.col("end") == F.col("root")).collect())


@pytest.mark.parametrize("sizes,height", [((1,), 2), ((2, 1), 1), ((81, 9, 10, 1, 28, 3, 27, 26, 8, 82), 2), ((40, 5, 1, 1), 1)])
def test_manifests_of_many_shapes_in_small_blocks(spark, sizes, height):
    rnd = random.Random(sum(sizes))
    rows, n = [], 0
    for s, size in enumerate(sizes):
        for _ in range(size):
            n += 1
            rows.append((n * 7 % 1009, prose(rnd, 3) + "\n" * (n % 3), None if n % 4 else "en", f"s{s:02d}é" if s else None, n))
    rnd.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    docs = [dict(zip(("doc_id", "text", "lang", "source", "n_chars"), r)) for r in rows]
    assert checked(df, height) == brute_manifest(docs)


def test_manifest_of_odd_and_empty_tables(spark, odd_docs, no_docs):
    docs = [r.asDict() for r in odd_docs.select("doc_id", "text", "lang", "source", "n_chars").collect()]
    assert checked(odd_docs, 2) == brute_manifest(docs)
    assert MM.manifest(no_docs).count() == 0
    assert MM.manifest(odd_docs.limit(1)).select(F.size("path")).first()[0] == 0
