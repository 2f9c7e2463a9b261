"""Cross-tokenizer alignment: which tokens of tokenizer A and tokenizer B end
at the same byte of a text.

Documents are encoded by a byte-level model (A, with a space put in front) and
a SentencePiece model (B, which adds that space itself); chunks between places
where both start anew are encoded once a worker and remembered.  Both
sequences are turned into byte end offsets.  All documents of a batch are merged in
lockstep: one NumPy state vector holds every document's A and B pointers, a
step compares the two ends of all documents at once, advances the pointer
that lies behind (both where the ends agree, which emits a link and a cut) and
the vector is compacted as documents finish.  A text of over ``WINDOW`` bytes
takes part as several windows: whether two ends agree does not depend on what
stands before, so a very long text costs no more steps than a short one.

Pair counts are corpus-wide.  Documents are written in blocks of about
``BLOCK_BYTES`` with their links as positions in the block's sorted list of
distinct pairs; pairs are summed block by block, then over blocks, and the
sums join the blocks' lists again.  A pair that occurs everywhere is one row a
block, never one a link, and nothing of the counts is broadcast.

Defined results: a null or empty text, and one whose tokens of A or B do not
spell a space and the text, has no tokens; rows repeated in doc_id stay one by
one, each adds to the counts; extra columns are ignored; an empty table gives
no rows.  Memory a task: a slice of texts, or one block.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch, byte_letters, merge_ranks, salted_join, slices_by_bytes, stored, utf8

WINDOW = 4096
BLOCK_BYTES = 3 << 20
MEMO_CHUNKS = 150_000  # remembered chunks a worker; emptied, not capped, when full
SPACE = "▁"
BORDER = "\udc00"  # in no UTF-8 text
# A border behind a character that Unicode calls white space.
AFTER_WHITE = re.compile("([\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000])" + BORDER)
NONE = (b"", b"")
# Fixed value: the word pattern of byte-level models.
BYTE_LEVEL_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
ALIGNED = pa.schema([("doc_id", pa.int64()), ("a_ids", pa.list_(pa.int32())), ("b_ids", pa.list_(pa.int32())),
                     ("a_cuts", pa.list_(pa.int32())), ("b_cuts", pa.list_(pa.int32())),
                     ("byte_cuts", pa.list_(pa.int32()))])
ALIGNED_DDL = ("doc_id bigint, a_ids array<int>, b_ids array<int>, a_cuts array<int>, b_cuts array<int>, "
               "byte_cuts array<int>")
BLOCKS = pa.schema([("block", pa.int64()), ("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()),
                    ("groups_sha256", pa.string()), ("links", pa.binary()), ("pairs", pa.binary()),
                    ("counts", pa.binary())])
BLOCKS_DDL = ("block bigint, doc_id bigint, n_a bigint, n_b bigint, groups_sha256 string, links binary, "
              "pairs binary, counts binary")


class Side:
    """Spellings of one vocabulary as arrays; ``id -> bytes`` by slices."""

    def __init__(self, spelt: list[bytes]):
        self.letters = np.frombuffer(b"".join(spelt), np.uint8)
        self.lens = np.fromiter(map(len, spelt), np.int64, len(spelt))
        self.starts = np.cumsum(self.lens) - self.lens

    def bytes_of(self, ids: np.ndarray) -> np.ndarray:
        lens = self.lens[ids]
        first = np.cumsum(lens) - lens
        return self.letters[np.arange(int(lens.sum())) + np.repeat(self.starts[ids] - first, lens)]


class Pair:
    """Both tokenizers of a worker."""

    def __init__(self, a_model: str, b_model: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        import sentencepiece
        from tokenizers import Tokenizer
        self.a = Tokenizer.from_str(a_model)
        self.a.encode_special_tokens = True  # their strings in a text are ordinary text
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b_model)
        byte = byte_letters()
        n = self.a.get_vocab_size()
        spelt = [self.a.id_to_token(i) or "" for i in range(n)]
        self.a_side = Side([bytes([byte[c] for c in t]) if all(c in byte for c in t) else t.encode() for t in spelt])
        self.b_side = Side([
            bytes([int(self.b.id_to_piece(i)[3:5], 16)]) if self.b.is_byte(i) else
            b"" if self.b.is_control(i) else self.b.id_to_piece(i).replace(SPACE, " ").encode()
            for i in range(self.b.get_piece_size())])

        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        # Whether no piece goes on over a space or a line end.
        self.cuts = not any(SPACE in p.lstrip(SPACE) or "\n" in p for p in pieces)
        self.space = self.b.encode("\n")[:1]
        self.memo: dict[str, tuple[bytes, bytes]] = {}
        self.fast = self._ranked(a_model)

    @staticmethod
    def _ranked(a_model: str):
        """The same vocabulary and merges in the faster library, if the file
        has the usual word pattern and ids in the order of its merges."""
        split = json.loads(a_model).get("pre_tokenizer") or {}
        usual = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space")
        ranks = merge_ranks(a_model) if usual and not json.loads(a_model).get("normalizer") else None
        if not ranks:
            return None
        import tiktoken
        return tiktoken.Encoding("a", pat_str=BYTE_LEVEL_WORDS, mergeable_ranks=ranks, special_tokens={})

    def chunks(self, text: str) -> list[str]:
        """A space and the text, cut before each space or line end that follows
        no white space: there both tokenizers always start anew."""
        if not self.cuts:
            return [f" {text}"]
        s = f" {text}".replace(" ", BORDER + " ").replace("\n", BORDER + "\n")
        return [c for c in AFTER_WHITE.sub(r"\1", s).split(BORDER) if c]

    def _learn(self, new: list[str]) -> None:
        """Ids of chunks as little-endian 32-bit integers; none of either side
        where they do not spell the chunk."""
        for at in range(0, len(new), 8192):
            some = new[at:at + 8192]
            if self.fast:
                found = [self.fast.encode_ordinary(c) for c in some]
            else:
                found = [e.ids for e in self.a.encode_batch_fast(some, add_special_tokens=False)]
            # B puts its own space in front, of a text that is not empty.
            pieces = self.b.encode([c[1:] if c[0] == " " else c for c in some], num_threads=1)
            pieces = [self.space if c == " " else x if c[0] == " " else x[1:] for c, x in zip(some, pieces)]
            raw = [c.encode() for c in some]
            size = np.fromiter(map(len, raw), np.int64, len(raw))
            want, right, sides = np.frombuffer(b"".join(raw), np.uint8), np.ones(len(raw), bool), []
            for side, ids in ((self.a_side, found), (self.b_side, pieces)):
                n = np.fromiter(map(len, ids), np.int64, len(ids))
                flat = np.fromiter(chain.from_iterable(ids), "<i4", int(n.sum()))
                owner = np.repeat(np.arange(len(n)), n)
                fits = np.bincount(owner, side.lens[flat], len(n)).astype(np.int64) == size
                same = side.bytes_of(flat[fits[owner]]) == want[np.repeat(fits, size)]
                right &= fits
                right[np.repeat(np.flatnonzero(fits), size[fits])[~same]] = False
                buffer, ends = flat.tobytes(), (4 * np.cumsum(n)).tolist()
                sides.append([buffer[x:y] for x, y in zip([0, *ends], ends)])
            self.memo.update((c, (x, y) if r else NONE) for c, x, y, r in zip(some, *sides, right.tolist()))

    def encode(self, texts: list[str | None]) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
        """(flat ids, number of ids per text) of A and of B; texts that their
        ids do not spell have none."""
        sides, memo = ([], []), self.memo
        lens = np.fromiter((len(t or "") for t in texts), np.int64, len(texts))
        for lo, hi in slices_by_bytes(lens, 1 << 20):
            if len(memo) > MEMO_CHUNKS:
                memo.clear()
            parts = [self.chunks(t) if t else [] for t in texts[lo:hi]]
            self._learn([c for c in set(chain.from_iterable(parts)) if c not in memo])
            for row in parts:
                found = [memo[c] for c in row]
                if NONE in found:
                    found = []
                for k, side in enumerate(sides):
                    side.append(b"".join([x[k] for x in found]))
        return tuple((np.frombuffer(b"".join(side), "<i4"),
                      np.fromiter(map(len, side), np.int64, len(side)) // 4) for side in sides)


_PAIR: dict = {}


def _pair(key, models) -> Pair:
    """One pair of tokenizers a worker process."""
    if _PAIR.get("key") != key:
        _PAIR.clear()
        _PAIR.update(key=key, pair=Pair(*models.value))
    return _PAIR["pair"]


def common_ends(a_ends: np.ndarray, a_n: np.ndarray, b_ends: np.ndarray, b_n: np.ndarray,
                window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Indices into the flat, per document ascending, end offsets of A and B of
    all pairs with equal ends, in order.  ``a_n``, ``b_n``: tokens per document."""
    docs = len(a_n)
    a_first, b_first = np.cumsum(a_n) - a_n, np.cumsum(b_n) - b_n
    total = np.zeros(docs, np.int64)
    some = np.flatnonzero((a_n > 0) & (b_n > 0))
    total[some] = np.minimum(a_ends[a_first[some] + a_n[some] - 1], b_ends[b_first[some] + b_n[some] - 1])
    parts = -(-total // window)  # windows per document: ends in (w * window, (w + 1) * window]
    doc = np.repeat(np.arange(docs), parts)
    place = np.arange(len(doc)) - np.repeat(np.cumsum(parts) - parts, parts)
    span = int(max(a_ends.max(initial=0), b_ends.max(initial=0))) + 1
    low, high = doc * span + place * window, doc * span + np.minimum((place + 1) * window, total[doc])
    a_key, b_key = a_ends + np.repeat(np.arange(docs) * span, a_n), b_ends + np.repeat(np.arange(docs) * span, b_n)
    # The state: next A token and next B token of every window still running.
    a, b = np.searchsorted(a_key, low, "right"), np.searchsorted(b_key, low, "right")
    a_to, b_to = np.searchsorted(a_key, high, "right"), np.searchsorted(b_key, high, "right")
    found_a, found_b = [], []
    running = (a < a_to) & (b < b_to)
    a, b, a_to, b_to = a[running], b[running], a_to[running], b_to[running]
    while len(a):
        x, y = a_key[a], b_key[b]
        same = x == y
        if same.any():
            found_a.append(a[same])
            found_b.append(b[same])
        a, b = a + (x <= y), b + (y <= x)
        running = (a < a_to) & (b < b_to)
        if not running.all():  # finished documents leave the vector
            a, b, a_to, b_to = a[running], b[running], a_to[running], b_to[running]
    if not found_a:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    left = np.concatenate(found_a)
    order = np.argsort(left, kind="stable")
    return left[order], np.concatenate(found_b)[order]


class Slice:
    """Aligned texts: flat ids, ids per text, links as indices into them."""

    def __init__(self, pair: Pair, texts: list[str | None]):
        (self.a, self.a_n), (self.b, self.b_n) = pair.encode(texts)
        self.a_end, self.b_end = (self._ends(s.lens[ids], n) for s, ids, n in (
            (pair.a_side, self.a, self.a_n), (pair.b_side, self.b, self.b_n)))
        self.link_a, self.link_b = common_ends(self.a_end, self.a_n, self.b_end, self.b_n)
        self.a_first, self.b_first = np.cumsum(self.a_n) - self.a_n, np.cumsum(self.b_n) - self.b_n
        self.link_doc = np.repeat(np.arange(len(texts)), self.a_n)[self.link_a]
        self.n_links = np.bincount(self.link_doc, minlength=len(texts))
        self.link_ends = np.cumsum(self.n_links)

    @staticmethod
    def _ends(lens: np.ndarray, n: np.ndarray) -> np.ndarray:
        run = np.cumsum(lens)
        before = np.concatenate([[0], run])[np.cumsum(n) - n]
        return run - np.repeat(before, n)

    def lists(self, values: np.ndarray, ends: np.ndarray) -> pa.ListArray:
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()),
                                        pa.array(values.astype(np.int32)))

    def rows(self, ids: pa.Array) -> pa.RecordBatch:
        a, b = self.link_a, self.link_b
        return batch(ALIGNED, doc_id=ids, a_ids=self.lists(self.a, np.cumsum(self.a_n)),
                     b_ids=self.lists(self.b, np.cumsum(self.b_n)),
                     a_cuts=self.lists(a - self.a_first[self.link_doc] + 1, self.link_ends),
                     b_cuts=self.lists(b - self.b_first[self.link_doc] + 1, self.link_ends),
                     byte_cuts=self.lists(self.a_end[a], self.link_ends))


class GroupText:
    """Groups of a text as ``a1,a2|b1;a3|b2,b3``."""

    def __init__(self, pair: Pair):
        self.a = [np.array([b"%d%s" % (i, mark) for i in range(len(pair.a_side.lens))], object) for mark in (b",", b"|")]
        self.b = [np.array([b"%d%s" % (i, mark) for i in range(len(pair.b_side.lens))], object) for mark in (b",", b";")]

    def digests(self, s: Slice) -> list[str]:
        """SHA-256 of each text's groups; '' without tokens."""
        # Tokens in order of their group, A before B: after a token of A stand
        # all tokens of B of earlier groups, and the other way round.
        last_a, last_b = np.zeros(len(s.a), np.int64), np.zeros(len(s.b), np.int64)
        last_a[s.link_a], last_b[s.link_b] = 1, 1
        group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
        b_of, a_of = np.searchsorted(group_b, group_a), np.searchsorted(group_a, group_b, "right")
        out = np.empty(len(s.a) + len(s.b), object)
        for at, ids, last, marks in ((np.arange(len(s.a)) + b_of, s.a, last_a, self.a),
                                     (np.arange(len(s.b)) + a_of, s.b, last_b, self.b)):
            closing = last > 0
            out[at[~closing]] = marks[0][ids[~closing]]
            out[at[closing]] = marks[1][ids[closing]]
        ends = np.cumsum(s.a_n + s.b_n).tolist()
        return [hashlib.sha256(b"".join(out[a:b])[:-1]).hexdigest() if b > a else "" for a, b in zip([0, *ends], ends)]


_TEXT: dict = {}


def _group_text(key, pair: Pair) -> GroupText:
    if _TEXT.get("key") != key:
        _TEXT.clear()
        _TEXT.update(key=key, text=GroupText(pair))
    return _TEXT["text"]


def _slices(b: pa.RecordBatch, most: int) -> Iterator[tuple[pa.Array, list[str | None]]]:
    lens = pc.binary_length(b.column("body")).to_numpy(zero_copy_only=False)
    for lo, hi in slices_by_bytes(lens, most):
        yield b.column("id").slice(lo, hi - lo), [x.decode("utf-8", "replace") for x in
                                                  b.column("body").slice(lo, hi - lo).to_pylist()]


def _aligned(key, models, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = _pair(key, models)
        for b in batches:
            for ids, texts in _slices(b, most):
                yield Slice(pair, texts).rows(ids)
    return run


def _blocks(key, models, most: int):
    """A row per document, then one with the block's distinct pairs."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, block = _pair(key, models), TaskContext.get().partitionId() << 32
        text = _group_text(key, pair)
        for b in batches:
            for ids, texts in _slices(b, most):
                s = Slice(pair, texts)
                del texts
                codes = s.a[s.link_a].astype(np.int64) << 32 | s.b[s.link_b]
                pairs, at, counts = np.unique(codes, return_inverse=True, return_counts=True)
                at = at.astype("<u2" if len(pairs) <= 1 << 16 else "<u4")
                ends, raw, size = s.link_ends.tolist(), at.tobytes(), at.itemsize
                n, none = len(ids), [None]
                yield batch(BLOCKS, block=[block] * (n + 1), doc_id=pa.concat_arrays([ids, pa.nulls(1, pa.int64())]),
                            n_a=s.a_n.tolist() + none, n_b=s.b_n.tolist() + none,
                            groups_sha256=text.digests(s) + none,
                            links=[raw[x * size:y * size] for x, y in zip([0, *ends], ends)] + none,
                            pairs=[None] * n + [pairs.astype("<i8").tobytes()],
                            counts=[None] * n + [counts.astype("<i8").tobytes()])
                block += 1
                del s, codes, at, raw
                pa.default_memory_pool().release_unused()
    return run


def _models(docs: DataFrame, a_path: str, b_path: str):
    """Both vocabulary files, read on the driver and broadcast (a few MB)."""
    with open(a_path, encoding="utf-8") as f, open(b_path, "rb") as g:
        models = f.read(), g.read()
    if sum(map(len, models)) > 64 << 20:
        raise ValueError("vocabulary files of over 64 MB are not broadcast")
    return docs.sparkSession.sparkContext.broadcast(models)


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("bigint").alias("id"), utf8("text").alias("body"))


def aligned(docs: DataFrame, a_path: str, b_path: str, slice_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, a_ids, b_ids, a_cuts, b_cuts, byte_cuts): ids of both sides and,
    for each group, how many ids and bytes of the text stand before its end."""
    return _rows(docs).mapInArrow(_aligned((a_path, b_path), _models(docs, a_path, b_path), slice_bytes), ALIGNED_DDL)


def _pairs_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(block, at, a, b, n): the pairs of each block, ``at`` their position."""
    for b in batches:
        for block, pairs, counts in zip(*(b.column(c).to_pylist() for c in ("block", "pairs", "counts"))):
            code = np.frombuffer(pairs, "<i8")
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(code), block)), pa.array(np.arange(len(code), dtype=np.int32)),
                 pa.array((code >> 32).astype(np.int32)), pa.array((code & 0xFFFFFFFF).astype(np.int32)),
                 pa.array(np.frombuffer(counts, "<i8"))], names=["block", "at", "a", "b", "n"])


SUMS = pa.schema([("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()),
                  ("n_links", pa.int64()), ("n_best", pa.int64()), ("count_sum", pa.int64()),
                  ("groups_sha256", pa.string())])
SUMS_DDL = ("doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, "
            "count_sum bigint, groups_sha256 string")


def _summed(key: tuple, docs: pa.Table, pairs: pa.Table) -> pa.Table:
    """Sums over the links of each document of one block."""
    count, best = np.zeros(pairs.num_rows, np.int64), np.zeros(pairs.num_rows, np.int64)
    at = pairs["at"].to_numpy()
    count[at], best[at] = pairs["count"].to_numpy(), pairs["best"].to_numpy().astype(np.int64)
    width = np.uint16 if len(count) <= 1 << 16 else np.uint32
    raw = docs["links"].to_pylist()
    links = np.frombuffer(b"".join(raw), width)
    n = np.fromiter(map(len, raw), np.int64, len(raw)) // np.dtype(width).itemsize
    ends = np.cumsum(n)

    def per_doc(values):
        run = np.concatenate([[0], np.cumsum(values[links])])
        return pa.array(run[ends] - run[ends - n])
    return pa.Table.from_arrays(
        [docs["doc_id"], docs["n_a"], docs["n_b"], pa.array(n), pa.array(n), per_doc(best), per_doc(count),
         docs["groups_sha256"]], schema=SUMS)


def pair_counts(pairs: DataFrame) -> DataFrame:
    """(a, b, count, best) of every pair; best: no A id shares more links with
    this B id.  One row per pair, and a B id has at most as many as A has ids."""
    counts = pairs.groupBy("a", "b").agg(F.sum("n").alias("count"))
    most = counts.groupBy("b").agg(F.max("count").alias("most"))
    return counts.join(most, "b").select("a", "b", "count", (F.col("count") == F.col("most")).alias("best"))


def link_sums(docs: DataFrame, a_path: str, b_path: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """A row per document: n_a, n_b, n_groups, n_links, n_best, count_sum,
    groups_sha256."""
    rows = _rows(docs).mapInArrow(_blocks((a_path, b_path), _models(docs, a_path, b_path), block_bytes), BLOCKS_DDL)
    blocks = stored(rows, "aligned")
    pairs = stored(blocks.where(F.col("pairs").isNotNull()).select("block", "pairs", "counts").mapInArrow(
        _pairs_of, "block bigint, at int, a int, b int, n bigint"), "pairs")
    counts = stored(pair_counts(pairs), "counts")
    known = salted_join(pairs.select("block", "at", "a", "b"), counts, ["a", "b"], F.col("block"))
    texts = blocks.where(F.col("pairs").isNull()).select("block", "doc_id", "n_a", "n_b", "groups_sha256", "links")
    return texts.groupBy("block").cogroup(known.select("block", "at", "count", "best").groupBy("block")).applyInArrow(
        _summed, SUMS_DDL)
