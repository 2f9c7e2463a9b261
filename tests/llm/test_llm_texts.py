"""Token counts, SentencePiece, Order MinHash, near copies: brute force and round trips."""
import hashlib
import random
from collections import defaultdict

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import regex
import tiktoken
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_fixtures import SF, docs_of, sf_texts  # noqa: F401  (fixtures)
from pyspark.sql import functions as F

from vitalspark.llm import edit_tokens, order_minhash, queries, sp_viterbi, superminhash

PIECES, RANKS = P.path("piece_bpe_32k.model"), P.path("byte_bpe_50k.tiktoken")
LETTERS = "ab 's\n\t  .1é're ,'ll 日▁"


# ------------------------------------------------------------ token counts
@pytest.fixture(scope="module")
def bpe():
    ranks = edit_tokens.load_ranks(RANKS)
    whole = tiktoken.Encoding("whole", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return regex.compile(P.PATTERN), edit_tokens.Counter(ranks), whole


def test_edits_equal_counting_anew(bpe):
    split, count, whole = bpe
    rng = random.Random(7)
    for _ in range(600):
        text = "".join(rng.choice(LETTERS) for _ in range(rng.randint(0, 400)))
        tree = edit_tokens.TokenTree(text, split, count)
        for _ in range(5):
            at, cut = rng.randint(0, len(text) + 2), rng.randint(0, 9)
            new = "".join(rng.choice(LETTERS) for _ in range(rng.randint(0, 6)))
            tree.edit(at, cut, new)
            text = text[:at] + new + text[min(at, len(text)) + cut:]
            assert tree.text() == text
            assert [p for x in tree.leaves for p in x] == split.findall(text)
            assert tree.n_tokens == len(whole.encode_ordinary(text)) and tree.n_chars == len(text)


def test_an_edit_touches_its_surroundings_only(bpe, sf_texts):
    split, count, _ = bpe
    text = max((t for _, t in sf_texts), key=len)
    tree = edit_tokens.TokenTree(text, split, count)
    assert tree.edit(len(text) // 2, 3, "xyz") <= 12 < tree.n_pretokens


def test_white_space_runs_and_growth(bpe):
    split, count, whole = bpe
    tree = edit_tokens.TokenTree(" " * 5000, split, count)
    tree.edit(2500, 0, "a")
    assert tree.n_tokens == len(whole.encode_ordinary(" " * 2500 + "a" + " " * 2500))
    tree = edit_tokens.TokenTree("", split, count)
    tree.edit(0, 0, "word " * 2000)
    tree.edit(4, 1, "")
    assert tree.text() == "wordword " + "word " * 1998 and len(tree.leaves) > 10


def test_count_edits_query(spark, sf_texts, bpe):
    split, _, whole = bpe
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", edit_tokens.revision().alias("e")).collect()
    edits = {r.doc_id: r.e for r in rows}
    got = {r.doc_id: r for r in queries.QUERIES["op2_edit_tokens"](spark, SF).collect()}
    assert len(got) == len(sf_texts)
    for i, text in sf_texts:
        r, before = got[i], len(whole.encode_ordinary(text))
        for e in edits[i]:
            at = min(max(e.at, 0), len(text))
            text = text[:at] + e.insert + text[at + e.cut:]
        assert (r.n_tokens, r.edited_tokens) == (before, len(whole.encode_ordinary(text)))
        assert (r.edited_chars, r.edited_pretokens) == (len(text), len(split.findall(text)))
        assert r.edited_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_count_edits_edges(docs_of):
    docs = docs_of([(None, None), (1, ""), (1, ""), (2, "long " * 30_000)], {"counts": F.lit(1), "at": F.lit(2)})
    out = edit_tokens.count_edits(docs, F.when(F.col("doc_id") == 1, F.expr(
        "array(named_struct('at', -5, 'cut', 99, 'insert', 'new text'), named_struct('at', cast(null as int), 'cut',"
        " cast(null as int), 'insert', cast(null as string)))")), RANKS, P.PATTERN, into="c")
    rows = out.orderBy(F.col("doc_id").asc_nulls_first()).collect()
    assert [r.c.n_tokens for r in rows][:3] == [0, 0, 0] and rows[1].c.edited_tokens == 2
    assert rows[3].c.n_tokens == rows[3].c.edited_tokens >= 30_000 and rows[3].c.n_edits == 0
    assert edit_tokens.count_edits(docs_of([]), edit_tokens.revision(), RANKS, P.PATTERN).collect() == []


# ----------------------------------------------------------- SentencePiece
@pytest.fixture(scope="module")
def automaton():
    return sp_viterbi.Automaton(sp_viterbi.load_pieces(PIECES))


def brute_best(auto, text):
    """Best total score over all segmentations, by substring look-up."""
    value = {auto_piece: score for auto_piece, score in auto}
    longest = max(map(len, value))
    best = [0.0] + [-1e18] * len(text)
    for end in range(1, len(text) + 1):
        for start in range(max(0, end - longest), end):
            if text[start:end] in value:
                best[end] = max(best[end], best[start] + value[text[start:end]])
    return best[-1]


def test_viterbi_equals_brute_force(automaton, sf_texts):
    pieces = sp_viterbi.load_pieces(PIECES)
    value = [(pieces[i][0], s) for st_ in automaton.ends if st_ for _, s, i in [st_]]
    score = {i: s for e in automaton.ends if e for _, s, i in [e]}
    for _, text in sf_texts[:20]:
        words = text[:300].replace("\n", " ")
        ids = np.frombuffer(automaton.encode(words), "<i4").tolist()
        if any(i not in score for i in ids):  # spelt in bytes somewhere
            continue
        assert sum(score[i] for i in ids) == pytest.approx(brute_best(value, "▁" + words.replace(" ", "▁")))


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60) | st.text(alphabet=LETTERS, max_size=60))
def test_pieces_spell_every_text(text):
    auto, spell = _shared()
    ids = pa.array([np.frombuffer(auto.encode(t), "<i4") for t in (text, "", "x")], pa.list_(pa.int32()))
    assert pa.chunked_array(spell.decode(ids)).to_pylist() == [text, "", "x"]


def _shared(memo={}):
    if not memo:
        pieces = sp_viterbi.load_pieces(PIECES)
        memo[0] = sp_viterbi.Automaton(pieces), sp_viterbi.Spellings(pieces)
    return memo[0]


def test_side_by_side_equals_one_by_one(automaton, sf_texts):
    chunks = sorted({c for _, t in sf_texts for c in automaton.chunks(t) if len(c) <= sp_viterbi.LONGEST})
    usual = [c for c in chunks if (automaton.column[[ord(x) for x in c]] < 255).all()]
    assert len(usual) > sp_viterbi.SIDE_BY_SIDE  # more than one round
    for chunk, ids in zip(usual, automaton.best_paths(usual)):
        assert np.frombuffer(ids, "<i4").tolist() == automaton.best_path(chunk)


def test_ids_that_spell_no_text(automaton):
    spell = _shared()[1]
    rows = pa.array([[automaton.bytes[0x20], automaton.bytes[0xC3]], [], [automaton.bytes[0x20], automaton.bytes[0x41]]],
                    pa.list_(pa.int32()))
    assert pa.chunked_array(spell.decode(rows)).to_pylist() == ["\ufffd", "", "A"]


def test_chunks_do_not_change_the_best_path(automaton, sf_texts):
    for _, text in sf_texts[:10]:
        text = text[:500]
        whole = automaton.best_path("▁" + text.replace(" ", "▁"))
        assert np.frombuffer(automaton.encode(text), "<i4").tolist() == whole


def test_encode_decode_query_and_edges(spark, docs_of):
    rows = queries.QUERIES["op7_sp_viterbi"](spark, SF).collect()
    assert len(rows) == 200 and all(r.round_trip for r in rows)
    docs = docs_of([(None, None), (1, ""), (2, " "), (3, "a" * 60_000), (3, "a" * 60_000)], {"n_pieces": F.lit(0)})
    out = sp_viterbi.decoded(sp_viterbi.encoded(docs, PIECES), PIECES).orderBy(F.col("doc_id").asc_nulls_first()).collect()
    assert [len(r.ids) for r in out][:3] == [0, 0, 1] and [r.decoded for r in out] == ["", "", " ", "a" * 60_000, "a" * 60_000]
    assert sp_viterbi.encoded(docs_of([]), PIECES).collect() == []
    same = sp_viterbi.round_trip(docs.withColumn("_both", F.lit(1)), PIECES).orderBy(F.col("doc_id").asc_nulls_first())
    assert [(r.ids, r.decoded, r.n_tokens, r["_both"]) for r in same.collect()] == [
        (r.ids, r.decoded, r.n_tokens, 1) for r in out]


# ------------------------------------------------------------ Order MinHash
def test_order_minhash_query(spark, sf_texts):
    got = {r.doc_id: r for r in queries.QUERIES["op3_order_minhash"](spark, SF).collect()}
    rows = sorted(sf_texts)
    assert len(got) == len(rows)
    for at, (i, text) in enumerate(rows):
        other, k = rows[(at + 1) % len(rows)][1], len(text) // 2
        edited = text[:len(text) - k] + other[:k]
        assert got[i].n_chars == len(text)
        assert got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert got[i].edited_fingerprint == brute_omh(edited) and got[i].fingerprint == brute_omh(text)
        assert 0 <= got[i].near_next <= 1


def long_hash(*values):
    """Spark's xxhash64 of longs: the seed passes from one to the next."""
    seed = 42
    for v in values:
        seed = xxhash.xxh64_intdigest(int(v).to_bytes(8, "little", signed=True), seed=seed)
    return seed - (1 << 64) if seed >> 63 else seed


def int_hash(v, i):
    """xxhash64 of (long, int)."""
    seed = long_hash(v) & ((1 << 64) - 1)
    seed = xxhash.xxh64_intdigest(int(i).to_bytes(4, "little", signed=True), seed=seed)
    return seed - (1 << 64) if seed >> 63 else seed


def brute_omh(text):
    k, bits, pos_bits = order_minhash.K, order_minhash.POINT_BITS, order_minhash.POS_BITS
    words = [w for w in text.encode().split()]
    if not words:
        return ""
    h = []
    for w in words:
        v = xxhash.xxh64_intdigest(w, seed=42)
        h.append(v - (1 << 64) if v >> 63 else v)
    kmers = [long_hash(*h[i:i + k]) for i in range(max(len(h) - k + 1, 1))]
    seen, elements = defaultdict(int), []
    for at, x in enumerate(kmers):
        x >>= pos_bits
        ring = int_hash(x, seen[x])
        seen[x] += 1
        elements.append((ring >> pos_bits << pos_bits) | at)
    elements.sort()
    out = []
    for b in range(1 << bits):
        point = -(1 << 63) + (b << (64 - bits))
        s = sum(e < point for e in elements)
        pair = sorted(elements[(s + j) % len(elements)] & ((1 << pos_bits) - 1) for j in (0, 1))
        out.append(f"{long_hash(kmers[pair[0]], kmers[pair[1]]) & ((1 << 64) - 1):016X}")
    return "".join(out)


def test_order_minhash_sees_order_and_edges(spark, docs_of):
    a = [f"w{i}" for i in range(200)]
    moved = a[100:] + a[:100]
    rows = [(1, " ".join(a)), (2, " ".join(a)), (3, " ".join(moved)), (4, ""), (5, None), (6, " \n "), (7, "one"),
            (8, "one one one one"), (None, "null id"), (9, "x " * 30_000), (9, "x " * 30_000)]
    out = order_minhash.edited_pairs(docs_of(rows, {"id": F.lit(1), "omh": F.lit(2), "next": F.lit(3)})).collect()
    assert len(out) == len(rows)
    by = {r.doc_id: r for r in out}
    assert by[1].near_next == 1.0 and by[1].fingerprint == by[2].fingerprint
    assert 0.3 < by[2].near_next < 1.0  # all k-mers but two are shared, the order is not
    assert by[4].fingerprint == by[5].fingerprint == by[6].fingerprint == "" and by[4].near_next == 1.0
    assert by[6].near_next == 0.0 and len(by[7].fingerprint) == 16 * order_minhash.POINTS
    assert order_minhash.edited_pairs(docs_of([])).collect() == []
    alone = order_minhash.edited_pairs(docs_of([(5, "abcdef ghi")])).first()
    assert alone.near_next == 1.0 and alone.n_chars == 10


def test_order_minhash_is_native(spark, docs_of):
    plan = order_minhash.edited_pairs(docs_of([(1, "a b c")]))._jdf.queryExecution().toString()
    assert not any(w in plan for w in ("Python", "Pandas", "Arrow", "MapIn"))


# -------------------------------------------------------------- near copies
def brute_groups(rows):
    """Component names by comparing every pair of texts that share a shingle."""
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append({b" ".join(w[k:k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {b" ".join(w)} if w else set())
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x
    holders = defaultdict(list)
    for i, s in enumerate(sets):
        shared = defaultdict(int)
        for z in s:
            for j in holders[z]:
                shared[j] += 1
            holders[z].append(i)
        for j, n in shared.items():
            if 100 * n >= 75 * (len(s) + len(sets[j]) - n):
                parent[root(i)] = root(j)
    name = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            name[root(i)] = min(d, name.get(root(i), d))
    return [(d, len(sets[i]), name.get(root(i)) if sets[i] else d) for i, (d, _) in enumerate(rows)]


def variants():
    rng = random.Random(5)
    base = [f"word{i}" for i in range(120)]
    rows = [(100 + i, " ".join(base[:i] + [f"new{i}"] + base[i + 1:])) for i in range(60)]  # star around the base
    rows.append((500, " ".join(base)))
    chain = list(base)
    for i in range(30):  # a chain whose ends share nothing
        chain = chain[4:] + [f"c{i}.{j}" for j in range(4)]
        rows.append((600 + i, " ".join(chain)))
    passage = " ".join(f"p{i}" for i in range(40))
    rows += [(700 + i, passage + " " + " ".join(f"q{rng.random()}" for _ in range(60))) for i in range(40)]
    rows += [(800 + i, "Copy of THE same few words") for i in range(50)] + [(900, "copy of the same few WORDS")]
    rows += [(1000, None), (1001, ""), (1002, " \t"), (1003, "one"), (1004, "ONE"), (1005, "one two"), (None, "one"),
             (None, "lonely null"), (1006, "z " * 30_000), (1007, "z " * 20_000)]
    return rows


@pytest.mark.parametrize("block", [1024, 3])
def test_groups_equal_brute_force(docs_of, monkeypatch, block):
    monkeypatch.setattr(superminhash, "BLOCK", block)
    rows = variants()
    docs = docs_of(rows, {"key": F.lit(1), "sig": F.lit("s"), "label": F.lit(2), "rep": F.lit(3)})
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in superminhash.groups(docs).collect())
    assert got == sorted((str(d), n, str(c)) for d, n, c in brute_groups(rows))


def test_a_large_component_is_not_compared_with_itself(spark, docs_of, monkeypatch):
    """One bucket of 40 linked classes and 2 others with links to
    them that only round 3 can find: the 40 are dealt once a block of the others."""
    monkeypatch.setattr(superminhash, "BLOCK", 4)
    base = [f"w{i}" for i in range(200)]
    texts = [" ".join(base[:i] + [f"new{i}"] + base[i + 1:]) for i in range(42)]
    docs = docs_of(list(enumerate(texts)))
    sigs = superminhash.signatures(docs).orderBy("doc_id").collect()
    keys = [r.key for r in sigs]
    buckets = spark.createDataFrame([(k, 0, 7) for k in keys], "key bigint, band int, val bigint")
    classes = spark.createDataFrame(
        [(r.key, r.doc_id, r.n_shingles, [7, *r.sig[1:]]) for r in sigs],
        "key bigint, rep bigint, n_shingles bigint, sig array<bigint>")
    comp = spark.createDataFrame([(k, min(keys[:40])) for k in keys[:40]], "key bigint, comp bigint")
    dealt, joined, deal = [], [], superminhash._dealt

    def counted(rows):
        dealt.append(rows.count())
        joined.append(rows._jdf.queryExecution().optimizedPlan().toString().count("Generate explode(places"))
        return deal(rows)
    monkeypatch.setattr(superminhash, "_dealt", counted)
    got = {frozenset(r) for r in superminhash.remaining_links(buckets, docs, classes, comp).collect()}
    assert dealt[0] == 40 * 1 + 2 * (1 + 10) and joined == [1, 1]  # 42 * 11 when every block meets every block
    of = {k: i for i, k in enumerate(keys)}
    label = {k: 0 if i < 40 else i for k, i in of.items()}
    linked = {frozenset(label[k] for k in pair) for pair in got}
    assert all(len(x) == 2 for x in linked)
    reached = {0}
    for _ in range(3):
        reached |= {y for x in linked if x & reached for y in x}
    assert reached == {0, 40, 41}


def test_groups_of_the_table(spark, sf_texts):
    got = {r.doc_id: r for r in queries.QUERIES["op8_superminhash"](spark, SF).collect()}
    for d, n, c in brute_groups(sf_texts):
        assert (got[d].n_shingles, got[d].component_id, got[d].kept) == (n, c, c == d)


def test_groups_edges(docs_of):
    assert superminhash.groups(docs_of([])).collect() == []
    assert superminhash.deduplicated(docs_of([])).collect() == []
    docs = docs_of([(2, "a b c d e f"), (2, "a b c d e f"), (1, "a b c d e f"), (3, ""), (4, "")], {"_x": F.lit(1)})
    kept = superminhash.deduplicated(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [1, 3, 4]


def test_one_row_of_a_group_stays_whatever_its_ids(docs_of):
    base = [f"w{i}" for i in range(60)]
    near = " ".join([*base[:-1], "other"])
    other = [f"v{i}" for i in range(60)]
    near_other = " ".join([*other[:-1], "end"])
    unnamed = [f"u{i}" for i in range(60)]
    rows = [(5, " ".join(base)), (5, near),                          # one group, one id
            (3, " ".join(other)), (5, near_other),                   # 5 is kept elsewhere
            (None, near + " more"), (None, near_other + " more"),    # near copies of documents with ids
            (None, " ".join(unnamed)), (None, " ".join([*unnamed[:-1], "x"])),  # a group without any id
            (None, "all alone"), (None, "all alone"), (None, None), (8, "")]
    assert len({c for _, _, c in brute_groups([(i, t) for i, (_, t) in enumerate(rows)])}) == 6
    docs = docs_of(rows)
    got = [(r.doc_id, r.text) for r in superminhash.deduplicated(docs).collect()]
    assert sorted(str(d) for d, _ in got) == ["3", "5", "8", "None", "None", "None"]
    assert {t for d, t in got if d is None} > {"all alone", None} and [t for d, t in got if d == 5][0] in (rows[0][1], near)
    assert (3, rows[2][1]) in got


def superminhash_by_element(elements, m):
    """The published loop, one element after the other, without early stop."""
    sig = [None] * m
    mask = (1 << 64) - 1
    for e in elements:
        p = list(range(m))
        for j in range(m):
            with np.errstate(over="ignore"):
                drawn = int(superminhash.mix(np.array([(e ^ (j + 1) * (0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFF)) & mask],
                                                      np.uint64))[0])
            k = j + (((drawn & 0xFFF) * (m - j)) >> 12)
            p[j], p[k] = p[k], p[j]
            v = (j << 52) | (drawn >> 12)
            sig[p[j]] = v if sig[p[j]] is None else min(sig[p[j]], v)
    return sig


def test_signature_equals_the_plain_loop():
    rng = np.random.default_rng(2)
    sets = [rng.integers(0, 1 << 63, n).astype(np.uint64) for n in (1, 2, 7, 60, 300)] + [np.zeros(0, np.uint64)]
    got = superminhash.superminhash(sets, 64)
    for s, sig in zip(sets[:-1], got):
        assert sig.tolist() == superminhash_by_element([int(x) for x in s], 64)
    assert (got[-1] == np.uint64(0xFFFFFFFFFFFFFFFF)).all()


def test_agreement_counts_both_ways():
    sig = np.random.default_rng(4).integers(0, 3, (40, 128)).astype(np.uint16)
    want = [sum((a == b).sum() for b in sig) for a in sig]
    assert superminhash.agreement(sig).tolist() == want
    assert superminhash.agreement(sig[:9]).tolist() == [sum((a == b).sum() for b in sig[:9]) for a in sig[:9]]


def test_signature_estimates_similarity():
    rng = np.random.default_rng(3)
    both, a, b = (rng.integers(0, 1 << 63, n).astype(np.uint64) for n in (600, 200, 200))
    x, y = superminhash.superminhash([np.concatenate([both, a]), np.concatenate([both, b])])
    assert abs((x == y).mean() - 0.6) < 0.15
