"""SentencePiece encoding and decoding: an Aho-Corasick automaton over the
pieces drives a single-pass Viterbi.

Each code point advances the automaton once; the state's output chain (the
pieces that end here, found by following output links) relaxes the best score
at that position.  Ties go to the longest piece.  Code points that no piece
covers are spelt in byte pieces at a score below every piece.

The model file holds byte-pair merges whose scores are ranks, not log
probabilities; a Viterbi over raw ranks would prefer many short pieces.
``scores="zipf"`` (default) turns rank r into log(1 / ((r + 2.7) H)), a
unigram estimate by the Zipf-Mandelbrot law; ``"model"`` takes the file's
scores as they stand (right for unigram models).

Decoding gives every text back exactly: spaces become U+2581 after a leading
dummy, a U+2581 of the text itself is spelt in bytes.  Since no piece has
U+2581 after another character (checked at load), chunks between such places
are encoded on their own and remembered; a full memo is emptied.  New chunks
of a slice of texts go through the automaton side by side, one code point a
step, over arrays; chunks that are long or hold a rare character go one by one.

Defined results: null and empty texts have no pieces; all other columns are
kept.  Memory per task: one batch of rows as Arrow, ``SLICE`` bytes of it as
Python strings or indices, the automaton and ``MEMO_BYTES`` of remembered
chunks.  Decoding needs the spellings only, no automaton.
"""

from __future__ import annotations

import math
import struct
from collections import Counter, deque
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices_by_bytes, text_of

SPACE = "▁"
# Stand-ins that no UTF-8 text can hold: a U+2581 of the text, a chunk border.
OWN_SPACE, BORDER = "\ud800", "\udc00"
MANDELBROT = 2.7
MEMO_BYTES = 24 << 20   # of remembered chunks a worker
ENTRY_BYTES = 200       # a remembered chunk besides its own letters and ids
MORE_STEPS = 100_000    # steps beyond the trie that are remembered
TABLE_BYTES = 16 << 20  # of the step table of common characters
SIDE_BY_SIDE, LONGEST = 8192, 64  # chunks that go together, code points of such a chunk
SLICE = 2 << 20         # bytes of text, or ids, taken out of Arrow at a time


def load_pieces(path: str) -> list[tuple[str, float, str]]:
    """(piece, score, kind) by id; kind: normal, byte or control."""
    import sentencepiece
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    out = []
    for i in range(model.get_piece_size()):
        kind = "byte" if model.is_byte(i) else "control" if (
            model.is_control(i) or model.is_unknown(i) or model.is_unused(i)) else "normal"
        out.append((model.id_to_piece(i), model.get_score(i), kind))
    return out


class Automaton:
    """Pieces as an Aho-Corasick automaton with Viterbi encoding on top."""

    def __init__(self, pieces: list[tuple[str, float, str]], scores: str = "zipf"):
        normal = [(i, p, s) for i, (p, s, kind) in enumerate(pieces) if kind == "normal" and p]
        if scores == "zipf":
            ranked = sorted(normal, key=lambda x: (-x[2], x[0]))
            total = sum(1 / (r + MANDELBROT) for r in range(len(ranked)))
            value = {i: -math.log((r + MANDELBROT) * total) for r, (i, _, _) in enumerate(ranked)}
        else:
            value = {i: s for i, _, s in normal}
        self.bytes = {int(p[3:5], 16): i for i, (p, _, kind) in enumerate(pieces) if kind == "byte"}
        if len(self.bytes) != 256:
            raise ValueError("the model has no byte pieces: texts could not be given back exactly")
        self.byte_score = min(value.values(), default=0.0) - 10.0
        self.next, self.fail, self.link, self.ends = [{}], [0], [0], [None]
        for i, p, _ in normal:
            at = 0
            for ch in p:
                if ch not in self.next[at]:
                    self.next[at][ch] = len(self.next)
                    for column, start in ((self.next, {}), (self.fail, 0), (self.link, 0), (self.ends, None)):
                        column.append(start)
                at = self.next[at][ch]
            self.ends[at] = (len(p), value[i], i)
        queue, self.order = deque(self.next[0].values()), []
        while queue:
            at = queue.popleft()
            self.order.append(at)
            back = self.fail[at]
            self.link[at] = back if self.ends[back] else self.link[back]
            for ch, to in self.next[at].items():
                f = back
                while f and ch not in self.next[f]:
                    f = self.fail[f]
                self.fail[to] = self.next[f].get(ch, 0)
                queue.append(to)
        self.chains: list = [None] * len(self.next)
        self.cut_safe = not any(SPACE in p.lstrip(SPACE) for _, p, _ in normal)
        self.alone = [c for c in "\n\t" if not any(c in p for _, p, _ in normal)]
        self.singles = {p for _, p, _ in normal if len(p) == 1}
        self.memo: dict[str, bytes] = {}
        self.held, self.more = 0, MORE_STEPS
        self._as_arrays([p for _, p, _ in normal])

    def _as_arrays(self, pieces: list[str]) -> None:
        """Step table over the most common characters that are pieces of their
        own, and the output chains of all states, as arrays."""
        states = len(self.next)
        small = np.uint16 if states <= 1 << 16 else np.int32
        common = [c for c, _ in Counter(chain.from_iterable(pieces)).most_common() if c in self.singles]
        common = common[:max(1, min(255, TABLE_BYTES // (states * small().itemsize)))]
        column = {c: k for k, c in enumerate(common)}
        self.column = np.full(0x110000, 255, np.uint8)
        self.column[[ord(c) for c in common]] = range(len(common))
        self.table = np.zeros((states, len(common)), small)
        for state in [0, *self.order]:  # a state's own steps over those of where it falls back to
            row = self.table[state]
            if state:
                row[:] = self.table[self.fail[state]]
            for c, to in self.next[state].items():
                if c in column:
                    row[column[c]] = to
        chains = [self.chain(state) for state in range(states)]
        self.n_ends = np.array([len(x) for x in chains], np.int16)
        self.at_ends = np.concatenate([[0], np.cumsum(self.n_ends[:-1], dtype=np.int64)]).astype(np.int32)
        flat = [x for found in chains for x in found] or [(0, 0.0, 0)]
        self.end_len, self.end_id = (np.array([x[k] for x in flat], np.int32) for k in (0, 2))
        self.end_score = np.array([x[1] for x in flat])

    def best_paths(self, chunks: list[str]) -> list[bytes]:
        """``best_path`` of many short chunks of common characters at once."""
        out: list = [None] * len(chunks)
        lens = np.fromiter(map(len, chunks), np.int64, len(chunks))
        by_len = np.argsort(-lens, kind="stable")
        for lo in range(0, len(chunks), SIDE_BY_SIDE):
            rows = by_len[lo:lo + SIDE_BY_SIDE]
            n, m, longest = lens[rows], len(rows), int(lens[rows[0]])
            letters = np.zeros((longest, m), np.uint8)
            who = np.repeat(np.arange(m), n)
            letters[np.arange(len(who)) - np.repeat(np.cumsum(n) - n, n), who] = self.column[
                np.frombuffer("".join([chunks[r] for r in rows]).encode("utf-32-le"), np.uint32)]
            best, pick = np.full((longest + 1, m), -np.inf), np.zeros((longest + 1, m), np.int32)
            best[0], flat, state = 0.0, best.reshape(-1), np.zeros(m, np.int64)
            for i in range(1, longest + 1):
                k = int(np.searchsorted(-n, -i, "right"))  # chunks that reach this position come first
                state = self.table[state[:k], letters[i - 1, :k]].astype(np.int64)
                many, first = self.n_ends[state], self.at_ends[state]
                pick[i, :k] = first
                best[i, :k] = flat[(i - self.end_len[first]) * m + np.arange(k)] + self.end_score[first]
                for r in range(1, int(many.max())):  # shorter pieces along the output links
                    on = np.flatnonzero(many > r)
                    end = first[on] + r
                    score = flat[(i - self.end_len[end]) * m + on] + self.end_score[end]
                    better = score > best[i, on]
                    best[i, on[better]], pick[i, on[better]] = score[better], end[better]
            ids, at, on, steps = np.zeros((m, longest), "<i4"), n.copy(), np.arange(m), np.zeros(m, np.int64)
            while len(on):
                end = pick[at[on], on]
                steps[on] += 1
                ids[on, longest - steps[on]] = self.end_id[end]
                at[on] -= self.end_len[end]
                on = on[at[on] > 0]
            raw = ids.tobytes()
            for j, (r, used) in enumerate(zip(rows.tolist(), steps.tolist())):
                out[r] = raw[4 * ((j + 1) * longest - used):4 * (j + 1) * longest]
        return out

    def chain(self, state: int) -> tuple:
        """Pieces that end in this state, longest first, along output links."""
        out, at = [], state
        while at:
            if self.ends[at]:
                out.append(self.ends[at])
            at = self.link[at]
        self.chains[state] = tuple(out)
        return self.chains[state]

    def best_path(self, chunk: str) -> list[int]:
        n = len(chunk)
        best, back = [0.0] + [-math.inf] * n, [None] * (n + 1)
        nexts, fail, chains, state = self.next, self.fail, self.chains, 0
        for i, ch in enumerate(chunk, 1):
            to = nexts[state].get(ch)
            if to is None:  # follow failure links once, then remember where they led
                at = state
                while at and ch not in nexts[at]:
                    at = fail[at]
                to = nexts[at].get(ch, 0)
                if self.more:
                    self.more -= 1
                    nexts[state][ch] = to
            state = to
            top = -math.inf
            ends = chains[state]
            for found in (ends if ends is not None else self.chain(state)):
                score = best[i - found[0]] + found[1]
                if score > top:
                    top, back[i] = score, found
            if ch not in self.singles:
                spelt = (SPACE if ch == OWN_SPACE else ch).encode("utf-8")
                score = best[i - 1] + self.byte_score * len(spelt)
                if score > top:
                    top, back[i] = score, (1, spelt)
            best[i] = top
        out, at = [], n
        while at:
            step = back[at]
            if len(step) == 2:
                out.extend(self.bytes[x] for x in reversed(step[1]))
            else:
                out.append(step[2])
            at -= step[0]
        return out[::-1]

    def chunks(self, text: str) -> list[str]:
        """The text in parts whose best paths do not depend on each other."""
        if not text:
            return []
        s = SPACE + text.replace(SPACE, OWN_SPACE).replace(" ", SPACE)
        if not self.cut_safe:
            return [s]
        s = s.replace(SPACE, BORDER + SPACE).replace(SPACE + BORDER, SPACE)  # runs of spaces stay whole
        for c in self.alone:
            s = s.replace(c, BORDER + c + BORDER)
        return [x for x in s.split(BORDER) if x]

    def encode_all(self, texts: list[str | None]) -> list[bytes]:
        """Per text its ids as little-endian 32-bit integers."""
        memo, parts = self.memo, [self.chunks(t or "") for t in texts]
        if self.held > MEMO_BYTES:
            self.forget()
        new = [c for c in set(chain.from_iterable(parts)) if c not in memo]
        if new:
            lens = np.fromiter(map(len, new), np.int64, len(new))
            letters = self.column[np.frombuffer("".join(new).encode("utf-32-le", "surrogatepass"), np.uint32)]
            short = (np.maximum.reduceat(letters, np.cumsum(lens) - lens) < 255) & (lens <= LONGEST)
            together = [c for c, s in zip(new, short.tolist()) if s]
            memo.update(zip(together, self.best_paths(together)))
            for c, s in zip(new, short.tolist()):
                if not s:
                    memo[c] = struct.pack(f"<{len(path := self.best_path(c))}i", *path)
            self.held += int(lens.sum()) * 8 + len(new) * ENTRY_BYTES
        return [b"".join([memo[c] for c in x]) for x in parts]

    def forget(self) -> None:
        self.memo.clear()
        self.held = 0

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]

    def encode_array(self, texts: pa.StringArray) -> pa.ListArray:
        """Ids of a batch, ``SLICE`` bytes of text at a time."""
        lens = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
        flat, counts = [], []
        for lo, hi in slices_by_bytes(lens, SLICE):
            ids = self.encode_all(texts.slice(lo, hi - lo).to_pylist())
            counts += [len(x) // 4 for x in ids]
            flat.append(b"".join(ids))
        ends = np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(flat), "<i4")))


class Spellings:
    """The pieces' bytes in one buffer: decoding is a gather."""

    def __init__(self, pieces: list[tuple[str, float, str]]):
        spelt = [bytes([int(p[3:5], 16)]) if kind == "byte" else p.replace(SPACE, " ").encode("utf-8")
                 if kind == "normal" else b"" for p, _, kind in pieces]
        self.letters = np.frombuffer(b"".join(spelt), np.uint8)
        self.lens = np.fromiter(map(len, spelt), np.int64, len(spelt))
        self.starts = np.cumsum(self.lens) - self.lens

    def bytes_of(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(all letters, end of each id's letters)."""
        lens = self.lens[ids]
        ends = np.cumsum(lens)
        at = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(self.starts[ids] - (ends - lens), lens)
        return self.letters[at], ends

    def decode_array(self, rows: pa.ListArray) -> pa.StringArray:
        return pa.concat_arrays([pa.array([], pa.string()), *self.decode(rows)])

    def decode(self, rows: pa.ListArray) -> Iterator[pa.Array]:
        """Texts of consecutive rows, a few at a time, without the leading
        dummy; ids that spell no valid UTF-8 get replacement characters."""
        ends = rows.offsets.to_numpy()
        ids = rows.values.to_numpy(zero_copy_only=False)
        for lo, hi in slices_by_bytes(4 * np.diff(ends), SLICE):
            letters, to = self.bytes_of(ids[ends[lo]:ends[hi]])
            to = np.concatenate([[0], to])[ends[lo:hi + 1] - ends[lo]]
            some = np.diff(to) > 0
            keep = np.ones(len(letters), bool)
            keep[to[:-1][some]] = False
            to = to - np.concatenate([[0], np.cumsum(some)])
            raw = pa.Array.from_buffers(pa.large_binary(), hi - lo, [
                None, pa.py_buffer(to.astype(np.int64)), pa.py_buffer(letters[keep])])
            try:
                yield raw.cast(pa.large_string()).cast(pa.string())
            except pa.ArrowInvalid:
                yield pa.array([x.decode("utf-8", "replace") for x in raw.to_pylist()], pa.string())


_LOADED: dict = {}


def _once(key, make):
    """One object of a kind a worker process."""
    if _LOADED.get("key") != key:
        _LOADED.clear()
        _LOADED.update(key=key, made=make())
    return _LOADED["made"]


class Tokenizer:
    """Column functions over one model; ``path`` is read on the driver only and
    the pieces (a vocabulary, under 2 MB) are broadcast."""

    def __init__(self, spark: SparkSession, path: str, scores: str = "zipf"):
        pieces = load_pieces(path)
        if len(pieces) > 1_000_000:
            raise ValueError("a vocabulary of over a million pieces is not broadcast")
        self._pieces = spark.sparkContext.broadcast(pieces)
        self._key, self._scores = (path, scores), scores

    def encode(self, text: Column) -> Column:
        """array<int> of piece ids."""
        key, pieces, scores = self._key, self._pieces, self._scores

        @F.arrow_udf("array<int>")
        def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            auto = _once(("encode", *key), lambda: Automaton(pieces.value, scores))
            for texts in batches:
                yield auto.encode_array(texts)
            auto.forget()
        return run(text)

    def both(self, text: Column) -> Column:
        """struct<ids, decoded>: ``encode`` and ``decode`` of its ids by one worker."""
        key, pieces, scores = self._key, self._pieces, self._scores

        @F.arrow_udf("struct<ids: array<int>, decoded: string>")
        def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            auto, spell = _once(("both", *key), lambda: (Automaton(pieces.value, scores), Spellings(pieces.value)))
            for texts in batches:
                ids = auto.encode_array(texts)
                yield pa.StructArray.from_arrays([ids, spell.decode_array(ids)], ["ids", "decoded"])
                del ids
                pa.default_memory_pool().release_unused()
            auto.forget()
        return run(text)

    def decode(self, ids: Column) -> Column:
        key, pieces = self._key, self._pieces

        @F.arrow_udf("string")
        def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            spell = _once(("decode", *key), lambda: Spellings(pieces.value))
            for rows in batches:
                yield spell.decode_array(rows)
        return run(ids)


def encoded(docs: DataFrame, path: str, text: str = "text", scores: str = "zipf") -> DataFrame:
    """docs with ``ids`` (array<int>) and ``n_tokens``."""
    t = Tokenizer(docs.sparkSession, path, scores)
    return docs.withColumn("ids", t.encode(text_of(text))).withColumn("n_tokens", F.size("ids").cast("bigint"))


def decoded(rows: DataFrame, path: str, ids: str = "ids", scores: str = "zipf") -> DataFrame:
    """rows with ``decoded``, the text its ids spell."""
    t = Tokenizer(rows.sparkSession, path, scores)
    return rows.withColumn("decoded", t.decode(F.col(ids)))


def round_trip(docs: DataFrame, path: str, text: str = "text", scores: str = "zipf") -> DataFrame:
    """docs with ``ids``, ``n_tokens`` and ``decoded``: what ``encoded`` and
    ``decoded`` add one after the other, by one Python worker instead of two."""
    t = Tokenizer(docs.sparkSession, path, scores)
    both = "_both"
    while both.lower() in {c.lower() for c in docs.columns}:
        both = f"_{both}"
    return (docs.withColumn(both, t.both(text_of(text)))
            .withColumns({"ids": F.col(both)["ids"], "decoded": F.col(both)["decoded"]}).drop(both)
            .withColumn("n_tokens", F.size("ids").cast("bigint")))
