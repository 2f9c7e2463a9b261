"""Context-tree weighting against a sequential brute force; the two classifiers."""
import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from llm_fixtures import SF, docs_of, sf_texts  # noqa: F401  (fixtures)
from vitalspark.llm import ctw, pu_quality, queries, string_kernel
from vitalspark.llm.common import labelled_sample

EDGE = [(0, None), (1, ""), (2, "the cat sat on the mat"), (3, "The cat sat on the MAT"), (4, "the cat"), (4, "the cat"),
        (None, "a null id"), (5, " \n\t "), (6, "žluťoučký kůň " * 3), (7, "x" * 5000), (8, "the dog sat"), (13, "new words")]


def trained(i, folds=10):
    return zlib.crc32(("" if i is None else str(i)).encode()) % folds != 0


def brute_ctw(rows, depth):
    """Tables of every context, weighted recursively, straight from the definition."""
    counts = {}
    for i, t in rows:
        if trained(i):
            s = b"\0" * depth + (t or "").encode().lower() + b"\0"
            for at in range(depth, len(s)):
                for d in range(depth + 1):
                    ctx = s[at - d:at]
                    for k in range(8):
                        node = (1 << k) | (s[at] >> (8 - k))
                        counts.setdefault((ctx, node), [0, 0])[(s[at] >> (7 - k)) & 1] += 1
    kids = {}
    for ctx, node in counts:
        if ctx:
            kids.setdefault((ctx[1:], node), []).append((ctx, node))
    kt = lambda a, b: math.lgamma(a + .5) + math.lgamma(b + .5) - math.lgamma(a + b + 1) - math.log(math.pi)
    memo = {}

    def weigh(key):
        if key not in memo:
            own = kt(*counts[key])
            if len(key[0]) == depth:
                memo[key] = (own, None)
            else:
                below = sum(weigh(c)[0] for c in kids.get(key, []))
                memo[key] = (np.logaddexp(own, below) - math.log(2), below)
        return memo[key]

    def one(ctx, node, d):
        key = (ctx[len(ctx) - d:], node)
        if key not in counts:
            return 0.5
        a, b = counts[key]
        own = (b + .5) / (a + b + 1)
        if d == depth:
            return own
        stop = 1 / (1 + math.exp(weigh(key)[1] - kt(a, b)))
        return stop * own + (1 - stop) * one(ctx, node, d + 1)

    out = []
    for i, t in rows:
        s = b"\0" * depth + (t or "").encode().lower() + b"\0"
        total = 0.0
        for at in range(depth, len(s)):
            for k in range(8):
                p = one(s[at - depth:at], (1 << k) | (s[at] >> (8 - k)), 0)
                total += math.log10(p if (s[at] >> (7 - k)) & 1 else 1 - p)
        out.append((i, total))
    return out


def brute_base(rows):
    c = Counter()
    for i, t in rows:
        if trained(i):
            c.update((t or "").encode().lower().split() + [None])
    n, v = sum(c.values()), len(c)
    tokens = [(t or "").encode().lower().split() + [None] for _, t in rows]
    return n, [(len(w), sum(c[x] > 0 for x in w), sum(math.log10((c[x] + .1) / (n + .1 * (v + 1))) for x in w))
               for w in tokens]


@pytest.mark.parametrize("depth,block_bytes", [(2, 1 << 20), (3, 2000)])
def test_ctw_equals_brute_force(docs_of, depth, block_bytes):
    rows = EDGE[:-3] + EDGE[-2:]
    got = ctw.scores(docs_of(rows, {"n": F.lit(1), "word": F.lit("w")}), depth=depth, block_bytes=block_bytes).collect()
    n, base = brute_base(rows)
    want = sorted((str(i), s, *b) for (i, s), b in zip(brute_ctw(rows, depth), base))
    have = sorted((str(r.doc_id), r.score, r.n_tokens, r.n_known, r.base_score) for r in got)
    assert all(r.train_tokens == n and r.held_out == (not trained(r.doc_id)) for r in got)
    assert len(have) == len(want)
    for h, w in zip(have, want):
        assert h[0] == w[0] and h[2:4] == w[2:4]
        assert h[1] == pytest.approx(w[1], rel=1e-9) and h[4] == pytest.approx(w[4], rel=1e-9)


def test_ctw_long_text_and_empty_table(docs_of):
    assert ctw.scores(docs_of([])).collect() == []
    row = ctw.scores(docs_of([(7, "x" * 50_000)])).first()
    assert row.n_tokens == 2 and math.isfinite(row.score)


def test_ctw_predictions_are_probabilities(docs_of):
    """The 256 next bytes after any context sum to one."""
    text = b"abracadabra, abra!"
    gram, owner = ctw.grams_of([text], 3)
    keys, n = np.unique(gram, return_counts=True)
    tree = ctw.Subtrees(keys, n, 3, 2)
    ctx = (keys >> np.uint64(8))[:5]
    for c in ctx:
        total = np.ones(256)
        for t in range(8):
            sym = np.arange(256, dtype=np.uint64)
            path = c << np.uint64(8) | (np.uint64(1 << t) | (sym >> np.uint64(8 - t)))
            one = tree.one(path, 3, 2)
            total *= np.where((sym >> np.uint64(7 - t)) & np.uint64(1) == 1, one, 1 - one)
        assert total.sum() == pytest.approx(1)


def test_base_score_on_the_table(spark, sf_texts):
    got = {r.doc_id: r for r in queries.QUERIES["op1_context_tree_weighting"](spark, SF).collect()}
    n, base = brute_base(sf_texts)
    assert len(got) == len(sf_texts)
    for (i, _), (tokens, known, score) in zip(sf_texts, base):
        r = got[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (tokens, known, n)
        assert r.base_score == pytest.approx(score, rel=1e-9)


# ------------------------------------------------------------ string kernel
def brute_kernel(s, t, n, decay):
    from itertools import combinations
    total = {}
    for word, k in ((s, 0), (t, 1)):
        for idx in combinations(range(len(word)), n):
            u = "".join(word[i] for i in idx)
            total.setdefault(u, [0, 0])[k] += decay ** (idx[-1] - idx[0] + 1)
    return sum(a * b for a, b in total.values())


@pytest.mark.parametrize("s,t", [("idiot", "idxiot"), ("abc", "abc"), ("ab", "abc"), ("scum", "mucs"), ("aaaa", "aaa"),
                                 ("réeux", "réeuxai")])
def test_subsequence_kernel_equals_brute_force(s, t):
    k = string_kernel.subsequence_kernel(string_kernel.codes([s], 9), string_kernel.codes([t], 8), 3, 0.7)
    assert k[0] == pytest.approx(brute_kernel(s, t, 3, 0.7))


def test_common_length():
    def lcs(a, b):
        d = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                d[i + 1][j + 1] = d[i][j] + 1 if x == y else max(d[i][j + 1], d[i + 1][j])
        return d[-1][-1]
    words = ["idiot", "idxiot", "toidi", "", "stupid", "diot", "iiddiioott", "zzz"]
    marks = string_kernel.Landmarks(["stupid", "idiot"])
    got = string_kernel.common_length(marks._numbers(string_kernel.codes(words, 24)), marks.tables[1], 5)
    assert got.tolist() == [lcs(w, "idiot") for w in words]


@pytest.fixture(scope="module")
def insults(spark, docs_of):
    clean = ["the river runs past the old mill", "we read a long book today", "bread and butter for lunch",
             "rain fell on the quiet town"]
    rows = [(i, f"{clean[i % 4]}. {clean[(i + 1) % 4]}. " + ("you grumblewort, go. " if i % 5 == 0 else "go home. ")
             + clean[i % 3]) for i in range(200)]
    docs = docs_of(rows, {"toxic": F.lit(9), "toxicity": F.lit("x"), "label": F.lit(1)})
    labels = spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i in range(200)] + [(None, 1, 1), (3, None, None)],
                                   "doc_id long, quality int, toxic int")
    return docs, labels, string_kernel.fit(docs.select("doc_id", "text"), labels)


def test_toxicity_tolerates_gaps_and_insertions(spark, docs_of, insults):
    model = insults[2]
    assert "grumblewort" in model.landmarks
    texts = ["you grumblewort", "you grum-blew-ort", "you grumbxlewort", "you g r u m b l e w o r t now", "a grumbleworrt.",
             "the river runs", "", None, "bread " * 20_000, "grumble", "x" * 3000 + "grumblewort"]
    got = [r.toxicity for r in string_kernel.scored(docs_of(list(enumerate(texts))), model).orderBy("doc_id").collect()]
    assert all(p >= 0.3 for p in got[:5]), got
    assert all(p < 0.3 for p in got[5:9]), got
    assert string_kernel.scored(docs_of([]), model).collect() == []


def test_toxicity_keeps_columns_and_never_learns_held_out_rows(insults):
    docs, labels, model = insults
    out = string_kernel.scored(docs, model, into="p")
    assert out.columns == docs.columns + ["p"]
    assert all((r.p >= 0.3) == (r.doc_id % 5 == 0) for r in out.collect())
    ids = [r.doc_id for r in labelled_sample(labels, "toxic", 1000).collect()]
    assert ids and all(zlib.crc32(str(i).encode()) % 4 != 2 for i in ids)


def test_toxicity_without_labels(spark, docs_of):
    empty = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = string_kernel.fit(docs_of([(1, "a b c")]), empty)
    assert string_kernel.scored(docs_of([(1, "a b c")]), model).first().toxicity < 0.01


@pytest.mark.parametrize("name,label,least", [("op10_string_kernel_svm", "toxic", 0.93), ("op6_pu_quality", "quality", 0.95)])
def test_held_out_accuracy(spark, name, label, least):
    sf = "/root/testdata/sf0.01"
    got = queries.QUERIES[name](spark, sf)
    assert dict(got.dtypes) == {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"}
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", label)
    rows = got.where("held_out").join(labels, "doc_id").collect()
    assert np.mean([r[label] == r.predicted for r in rows]) >= least
    assert got.count() == 1000


# ------------------------------------------------------------------ quality
def test_quality_features_are_shapes_only():
    table = pu_quality.new_table()
    one = pu_quality.features(["The cat sat.", "", "a a a a"], table)
    again = pu_quality.features(["a a a a", "The cat sat."], pu_quality.new_table())
    assert one.shape == (3, pu_quality.D)
    assert np.allclose(one[0], again[1]) and np.allclose(one[2], again[0])
    assert not one[1][:-1].any() and one[1][-1] == 1


def test_non_negative_risk(spark):
    """Two clouds, a third of the good one trusted: the unlabelled rest is told apart."""
    rng = np.random.default_rng(0)
    x = np.vstack([rng.normal(1, .4, (300, pu_quality.D)), rng.normal(-1, .4, (100, pu_quality.D))])
    rows = spark.createDataFrame([(v.tolist(), bool(i < 100)) for i, v in enumerate(x)], "f array<double>, positive boolean")
    model = pu_quality.minimise(rows, 0.75)
    good = model.value(x) > 0
    assert good[:300].mean() > .95 and good[300:].mean() < .05


def test_quality_edges(spark, docs_of):
    labels = spark.createDataFrame([(2, 1, 0), (2, 0, 0), (None, 1, 0), (4, None, 0)], "doc_id long, quality int, toxic int")
    docs = docs_of(EDGE, {"f": F.lit(1), "positive": F.lit("p"), "id": F.lit(2)})
    model = pu_quality.fit(pu_quality.featured(docs), labels)
    got = pu_quality.scored(docs, model).collect()
    again = pu_quality.scored_rows(pu_quality.featured(docs), model).collect()
    assert sorted(r.quality_score for r in again) == pytest.approx(sorted(r.quality_score for r in got))
    assert len(got) == len(EDGE) and all(0 <= r.quality_score <= 1 for r in got)
    empty = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert pu_quality.scored(docs, pu_quality.fit(pu_quality.featured(docs), empty)).first().quality_score < 1e-6
    assert pu_quality.scored(docs_of([]), model).collect() == []
