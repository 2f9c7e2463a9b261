"""Periodic runs, cross-tokenizer alignment and packing against brute force."""
import hashlib
import random
import signal
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_fixtures import SF, docs_of, sf_texts  # noqa: F401  (fixtures)
from pyspark.sql import functions as F

from vitalspark.llm import alignment, common, packing, periodic_runs, queries

A, B, WORDS = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model"), P.path("word_bpe_49k.json")
ODD = [(None, None), (None, "x"), (1, ""), (1, " "), (2, "a b " * 40), (2, "a b " * 40), (3, "wörd " * 9_000)]


# ------------------------------------------------------------ periodic runs
def brute_runs(words):
    """Maximal stretches of every period, by comparing words one by one."""
    found = {}
    for p in range(1, len(words) // 3 + 1):
        i = 0
        while i + p < len(words):
            j = i
            while j + p < len(words) and words[j] == words[j + p]:
                j += 1
            if j - i + p >= max(24, 3 * p):
                found.setdefault((i, j - i + p), p)
            i = max(j, i + 1)
    return sorted((s, n, p) for (s, n), p in found.items())


def brute_digest(words):
    runs = brute_runs(words)
    keep = [not any(s + p <= i < s + n for s, n, p in runs) for i in range(len(words))]
    best = None
    for s, n, p in runs:
        if best is None or n * best[2] > best[1] * p:
            best = (s, n, p)
    start, length, period = best or (None, None, None)
    return (len(runs), start, length, period, length * 1000 // period if best else None,
            hashlib.sha256("".join(f"{s},{n},{p}\n" for s, n, p in runs).encode()).hexdigest(),
            hashlib.sha256(b" ".join(w for w, k in zip(words, keep) if k)).hexdigest())


def planted_words(doc_id, text):
    words, h = (text or "").encode().split(), zlib.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and words:
        n, g = len(words), h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    return words


def test_runs_equal_brute_force():
    rng = random.Random(5)
    for _ in range(120):
        texts = []
        for _ in range(rng.randint(0, 3)):
            letters, words = "abcdefghij"[:rng.choice([1, 2, 3, 10])], []
            for _ in range(rng.randint(0, 4)):
                words += [rng.choice(letters) for _ in range(rng.randint(1, 12))] * rng.choice([1, 1, 3, 5, 9])
            texts.append(" ".join(words[:len(words) - rng.randint(0, 2)]).encode())
        found = periodic_runs.Slice(texts)
        assert [found.runs(i) for i in range(len(texts))] == [brute_runs(t.split()) for t in texts]


def test_extension_equals_comparing_letters():
    rng = np.random.default_rng(3)
    for letters in (1, 2, 5):
        words = rng.integers(0, letters, 300)
        words[120:180], words[200:260] = words[20:80], words[20:80]
        text = np.concatenate([[letters], words, [letters + 1]])
        grammar = periodic_runs.Grammar(text, letters)
        x = rng.integers(1, 300, 500)
        y = x + rng.integers(1, 301 - x)
        for back in (False, True):
            step = -1 if back else 1
            for i, j, got in zip(x, y, grammar.extension(x, y, back)):
                n = 0
                while text[i + step * n] == text[j + step * n]:
                    n += 1
                assert got == n


def test_grammar_ends_when_texts_end_with_the_first_word():
    texts = [b"a " + b"b c " * 20 + b"a"] * 6 + [b"a " * 30 + b"d a", b"d " + b"e a " * 15]
    def late(*_):
        raise TimeoutError("the grammar does not end")
    before = signal.signal(signal.SIGALRM, late)
    signal.alarm(60)
    try:
        found = periodic_runs.Slice(texts)
    finally:
        signal.alarm(0)
        signal.signal(signal.SIGALRM, before)
    assert [found.runs(i) for i in range(len(texts))] == [brute_runs(t.split()) for t in texts]


def test_runs_of_every_small_period_are_found_at_every_place():
    texts = [" ".join([f"x{i}" for i in range(off)] + [f"w{i % p}" for i in range(max(24, 3 * p) + more)] + ["y"] * (off % 2))
             for p in range(1, 13) for more in (0, 1, p - 1, 3 * p) for off in range(p + 2)]
    found = periodic_runs.Slice([t.encode() for t in texts])
    for i, t in enumerate(texts):
        assert found.runs(i) == brute_runs(t.split()) != []


def test_runs_query_equals_brute_force(spark, sf_texts):
    got = {r.doc_id: r for r in queries.QUERIES["op11_recompression_runs"](spark, SF).collect()}
    assert len(got) == len(sf_texts) and sum(r.n_runs for r in got.values()) > 10
    for d, text in sf_texts:
        r, words = got[d], planted_words(d, text)
        if len(words) < 3000:
            assert (r.n_runs, r.start, r.length, r.period, r.exponent_milli, r.runs_sha256,
                    r.collapsed_sha256) == brute_digest(words)


def test_runs_edges(docs_of):
    docs = docs_of(ODD, {"words": F.lit("kept"), "period": F.lit(0)})
    got = sorted((str(r.doc_id), r.n_runs, r.length, r.period) for r in periodic_runs.run_digests(docs).collect())
    assert got == [("1", 0, None, None), ("1", 0, None, None), ("2", 1, 80, 2), ("2", 1, 80, 2), ("3", 1, 9000, 1),
                   ("None", 0, None, None), ("None", 0, None, None)]
    assert {(r.doc_id, r.text) for r in periodic_runs.collapsed(docs).collect()} >= {(2, "a b"), (3, "wörd"), (None, "")}
    planted = periodic_runs.with_planted_runs(docs)
    assert planted.columns == docs.columns
    assert sorted(map(str, planted.select("doc_id", "words").collect())) == sorted(map(str, docs.select("doc_id", "words").collect()))
    assert periodic_runs.run_digests(docs_of([])).collect() == [] == periodic_runs.runs(docs_of([])).collect()


# ---------------------------------------------------------------- alignment
def brute_sides(pair, text):
    """[(id, end byte)] of A and B, spelled by hand."""
    byte, out = common.byte_letters(), []
    if not text:
        return [], []
    at, side = 0, []
    for i in pair.a.encode(" " + text, add_special_tokens=False).ids:
        at += len(bytes(byte[c] for c in pair.a.id_to_token(i)))
        side.append((i, at))
    out.append(side)
    at, side, spelt = 0, [], b""
    for i in pair.b.encode(text):
        piece = pair.b.id_to_piece(i)
        raw = bytes([int(piece[3:5], 16)]) if pair.b.is_byte(i) else piece.replace("▁", " ").encode()
        spelt, at = spelt + raw, at + len(raw)
        side.append((i, at))
    out.append(side)
    return out if spelt == (" " + text).encode() else ([], [])


def brute_alignment(pair, rows):
    links, groups = [], []
    for _, text in rows:
        a, b = brute_sides(pair, text)
        ends = sorted({e for _, e in a} & {e for _, e in b})
        at_a, at_b = {e: i for i, e in a}, {e: i for i, e in b}
        links.append([(at_a[e], at_b[e]) for e in ends])
        parts = [",".join(str(i) for i, x in a if lo < x <= hi) + "|" + ",".join(str(i) for i, x in b if lo < x <= hi)
                 for lo, hi in zip([0, *ends], ends)]
        groups.append((len(a), len(b), ";".join(parts)))
    count = Counter(x for row in links for x in row)
    most = defaultdict(int)
    for (_, b), n in count.items():
        most[b] = max(most[b], n)
    return sorted((str(d), n_a, n_b, len(row), len(row), sum(count[x] == most[x[1]] for x in row),
                   sum(count[x] for x in row), hashlib.sha256(g.encode()).hexdigest() if g else "")
                  for (d, _), row, (n_a, n_b, g) in zip(rows, links, groups))


@pytest.fixture(scope="module")
def pair():
    return alignment.Pair(open(A, encoding="utf-8").read(), open(B, "rb").read())


FIELDS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def test_alignment_query_equals_brute_force(spark, pair, sf_texts):
    got = sorted((str(r.doc_id), *(r[f] for f in FIELDS)) for r in queries.QUERIES["op12_token_alignment"](spark, SF).collect())
    assert got == brute_alignment(pair, sf_texts)


def test_alignment_edges(docs_of, pair):
    rows = [*ODD, (7, "a▁b"), (8, "<|endoftext|> and <s>"), (9, "日本語   é\t\n\n x"), (10, "  two  spaces ")]
    for size in (200, 1 << 20):  # several blocks, and one
        out = alignment.link_sums(docs_of(rows, {"block": F.lit(1), "links": F.lit("x")}), A, B, block_bytes=size)
        assert sorted((str(r.doc_id), *(r[f] for f in FIELDS)) for r in out.collect()) == brute_alignment(pair, rows)
    assert alignment.link_sums(docs_of([]), A, B).collect() == []


def test_aligned_spans(docs_of, pair):
    text = "Tokenisers disagree, mostly."
    row = alignment.aligned(docs_of([(1, text)]), A, B).collect()[0]
    raw, a = (" " + text).encode(), brute_sides(pair, text)[0]
    assert row.byte_cuts[-1] == len(raw) and row.a_cuts[-1] == len(row.a_ids) and row.b_cuts[-1] == len(row.b_ids)
    assert [a[n - 1][1] for n in row.a_cuts] == row.byte_cuts == sorted(set(row.byte_cuts))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.sets(st.integers(1, 60)), st.sets(st.integers(1, 60))), max_size=6), st.integers(1, 70))
def test_lockstep_equals_sets(docs, window):
    a, b = [sorted(x) for x, _ in docs], [sorted(y) for _, y in docs]
    flat = [np.array([v for row in side for v in row], np.int64) for side in (a, b)]
    n = [np.array([len(row) for row in side], np.int64) for side in (a, b)]
    left, right = alignment.common_ends(flat[0], n[0], flat[1], n[1], window)
    assert flat[0][left].tolist() == flat[1][right].tolist() == [v for x, y in docs for v in sorted(x & y)]


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=40) | st.text(alphabet="aB'sé \n\t \x1c\x85\u2003▁1!<|>", max_size=40))
def test_pair_encodes_like_whole_texts(text):
    if not _PAIR:
        _PAIR.append(alignment.Pair(open(A, encoding="utf-8").read(), open(B, "rb").read()))
    a, b = brute_sides(_PAIR[0], text)
    (got_a, _), (got_b, _) = _PAIR[0].encode([text])
    if [e for _, e in a[-1:]] != [e for _, e in b[-1:]]:
        a = b = []
    assert (got_a.tolist(), got_b.tolist()) == ([i for i, _ in a], [i for i, _ in b])


_PAIR: list = []


# ------------------------------------------------------------------ packing
def plain_first_fit(lengths, capacity):
    rooms, out = [], []
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        at = next((k for k, room in enumerate(rooms) if room >= lengths[i]), len(rooms))
        if at == len(rooms):
            rooms.append(capacity)
            out.append([])
        rooms[at] -= lengths[i]
        out[at].append(i)
    return out


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 63), max_size=60), st.integers(0, 9))
def test_packing_plan(lengths, gap):
    assert packing.first_fit_decreasing(lengths, 64) == plain_first_fit(lengths, 64)
    plan = packing.plan(lengths, 64, gap)
    assert sorted((i, x) for s in plan for i, a, b in s for x in range(a, b)) == [
        (i, x) for i, n in enumerate(lengths) for x in range(n)]
    used = [sum(b - a for _, a, b in s) for s in plan]
    assert all(0 < n <= 64 and (64 - n <= gap or n & (n - 1) == 0) for n in used)


def padding(rows):
    used = Counter()
    for r in rows:
        used[r.sequence_id] += r.length
    assert max(used.values()) <= 2048
    padded = sum(0 if n & (n - 1) == 0 else 2048 - n for n in used.values())
    return padded / (sum(used.values()) + padded)


def check_pieces(rows, want):
    """Each id of each document in exactly one piece, pieces gapless in their sequence."""
    by_sequence = defaultdict(list)
    for r in rows:
        by_sequence[r.sequence_id].append((r.offset, r.length))
    for spans in by_sequence.values():
        assert [o for o, _ in sorted(spans)] == [sum(n for _, n in sorted(spans)[:k]) for k in range(len(spans))]
    covered = defaultdict(list)
    for r in rows:
        covered[r.doc_id].append((r.start, r.length, r.doc_tokens, r.ids_crc32))
    for d, ids in want.items():
        at = 0
        for start, length, total, crc in sorted(covered.pop(d)):
            assert start == at and total == len(ids)
            assert crc == zlib.crc32(np.array(ids[start:start + length], "<u4").tobytes())
            at += length
        assert at == len(ids)
    assert not covered


def test_packing_query(spark, sf_texts):
    from tokenizers import Tokenizer
    tokenizer = Tokenizer.from_file(WORDS)
    want = {d: tokenizer.encode(t or "", add_special_tokens=False).ids + [1] for d, t in sf_texts}
    rows = queries.QUERIES["op13_packing"](spark, SF).collect()
    check_pieces(rows, want)
    assert padding(rows) < 0.005


def test_packing_edges(docs_of):
    docs = docs_of([*ODD, (4, "Ünï cödé Á İ"), (4, None)], {"place": F.lit(1), "ids": F.lit("x")})
    rows = packing.packed(docs, WORDS, group_docs=3).select("*", F.crc32("ids").alias("ids_crc32")).collect()
    assert padding(rows) < 0.02 and sum(r.length for r in rows) == sum(
        r.doc_tokens for r in rows if r.start == 0)
    assert sum(r.start == 0 for r in rows) == 9
    from tokenizers import Tokenizer
    tokenizer = Tokenizer.from_file(WORDS)
    ids = tokenizer.encode("Ünï cödé Á İ", add_special_tokens=False).ids + [1]
    assert {r.ids_crc32 for r in rows if r.doc_id == 4} >= {zlib.crc32(np.array(ids, "<u4").tobytes())}
    assert packing.packed(docs_of([]), WORDS).collect() == []


@settings(max_examples=100, deadline=None)
@given(st.text(max_size=40) | st.text(alphabet="aB'sé \n\t ́İΣς1!", max_size=40))
def test_chunks_encode_like_whole_texts(text):
    from tokenizers import Tokenizer
    encoder = packing.encoder("test", open(WORDS, encoding="utf-8").read())
    whole = Tokenizer.from_file(WORDS) if not _WHOLE else _WHOLE[0]
    _WHOLE[:] = [whole]
    assert np.frombuffer(encoder.encode([text.encode()])[0], "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids


def test_ranked_vocabularies_encode_alike(sf_texts):
    """The faster library must be in use, and agree on every word of the table."""
    from tokenizers import Tokenizer
    encoder, whole = packing.encoder("test", open(WORDS, encoding="utf-8").read()), Tokenizer.from_file(WORDS)
    pair = alignment.Pair(open(A, encoding="utf-8").read(), open(B, "rb").read())
    assert encoder.fast and pair.fast
    for _, text in sf_texts:
        assert np.frombuffer(encoder.encode([text.encode()])[0], "<u4").tolist() == whole.encode(
            text, add_special_tokens=False).ids
        assert pair.fast.encode_ordinary(" " + text) == pair.a.encode(" " + text, add_special_tokens=False).ids
    model = open(WORDS, encoding="utf-8").read()
    assert common.merge_ranks(model) is None and common.merge_ranks(open(A, encoding="utf-8").read(), b"x") is None


_WHOLE: list = []
