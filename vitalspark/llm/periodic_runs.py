"""Periodic run detection by recompression.

A run is a stretch of consecutive words with smallest period q (words q apart
are identical) and at least ``max(MIN_LENGTH, 3 q)`` words that no neighbouring
word extends keeping period q.

1. Words of a batch of texts become numbers (Arrow's dictionary of the batch);
   a separator of its own kind ends each text, so that nothing extends over texts.
2. Recompression turns the sequence into a run-length grammar, level by level:
   block compression replaces each maximal power of a symbol by one symbol,
   pair compression splits the symbols by a hash of level and symbol into left
   and right ones and replaces every pair (left, right) by one symbol.  Equal
   stretches are parsed alike but for a few symbols at their borders.
3. Candidates come from the harmonic grid: for each period p the places that
   are multiples of p (about n ln n of a text's n words).  A run of period p
   holds three neighbouring ones (m = 24 / p if that is more), whose words must
   agree, and so must every word from the first to the last but one with the
   word p later; a few of them are looked at first.  A text without a candidate
   left has no run and stays out of the grammar.
4. The grammar answers how far two places agree to the right and to the left
   (longest common extension), for all candidates of a batch side by side:
   climb the levels while the symbols agree, then descend to the first word
   that differs.  No suffix array is built.
5. The maximal stretch of period p around a candidate follows exactly; equal
   stretches keep their smallest period.

Defined results: words are ``[^\\x20\\x09-\\x0D]+``; a null or empty text has no
words and no run; rows repeated in doc_id are judged one by one; extra columns
are ignored; an empty table gives no rows.  Memory a task: ``SLICE_BYTES`` of
text, or one longer text, with its grammar (about 100 bytes a word).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from fractions import Fraction
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch, free_name, mix, slices_by_bytes, utf8

MIN_LENGTH = 24
CHECKS = 8  # places of a candidate that are compared before the grammar is asked
SLICE_BYTES = 3 << 20
QUERIES = 1 << 18  # candidates extended side by side
TURNS = 6
RUNS = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
RUNS_DDL = "doc_id bigint, start bigint, length bigint, period bigint"
DIGEST = pa.schema([("doc_id", pa.int64()), ("n_runs", pa.int64()), ("start", pa.int64()), ("length", pa.int64()),
                    ("period", pa.int64()), ("exponent_milli", pa.int64()), ("runs_sha256", pa.string()),
                    ("collapsed_sha256", pa.string())])
DIGEST_DDL = ("doc_id bigint, n_runs bigint, start bigint, length bigint, period bigint, exponent_milli bigint, "
              "runs_sha256 string, collapsed_sha256 string")


class Level:
    """One level of the grammar: its symbols in text order, and for each its
    place one level up and its first part one level down.

    ``unit``: of a level made by block compression the number of equal parts of
    each symbol; None if it was made by pair compression (at most two parts)."""

    def __init__(self, symbol, first, size, unit=None):
        self.symbol, self.first, self.size, self.unit = symbol, first, size, unit
        self.up = self.opens = self.closes = None  # set when the next level is built


class Grammar:
    """Recompression of a sequence of symbols.  Symbols of ``fixed`` and above
    (separators) are never compressed."""

    def __init__(self, symbols: np.ndarray, fixed: int):
        symbols = symbols.astype(np.int64)
        self.levels = [Level(symbols, None, np.ones(len(symbols), np.int64))]
        fresh, stop, stretch = fixed + len(symbols), fixed + len(symbols), int((symbols >= fixed).sum())

        def open_(s):  # not a separator
            return (s < fixed) | (s >= stop)

        turn = 0
        while len(self.levels[-1].symbol) > 2 * stretch + 1 or turn < 2:
            low = self.levels[-1]
            s = low.symbol
            if turn % 2 == 0:
                starts = np.flatnonzero(np.concatenate([[True], (s[1:] != s[:-1]) | ~open_(s[1:])])) if len(s) else np.zeros(0, int)
                count = np.diff(np.append(starts, len(s)))
                new, unit = s[starts], count
                many = np.flatnonzero(count > 1)
                if len(many):
                    powers = np.stack([new[many], count[many]], 1)
                    order = np.lexsort(powers.T)
                    change = np.concatenate([[0], (np.diff(powers[order], axis=0) != 0).any(1).astype(np.int64)])
                    name = np.empty(len(many), np.int64)
                    name[order] = fresh + np.cumsum(change)
                    new = new.copy()
                    new[many] = name
                    fresh = int(name.max()) + 1
            else:
                # Every symbol, 0 too, changes sides from turn to turn: one that never did would never be paired.
                right = (mix(s.astype(np.uint64) + mix(np.array([turn], np.uint64))) >> np.uint64(40)) & np.uint64(1) != 0
                usable = open_(s)
                pair = ~right[:-1] & right[1:] & usable[:-1] & usable[1:]
                starts = np.flatnonzero(np.concatenate([[True], ~pair])) if len(s) else np.zeros(0, int)
                new, unit = s[starts], None
                joined = np.flatnonzero(pair)
                if len(joined):
                    code = s[joined] * np.int64(fresh) + s[joined + 1] if fresh < 1 << 31 else None
                    if code is None:
                        raise ValueError("a batch of over two billion symbols")
                    _, name = np.unique(code, return_inverse=True)
                    new = new.copy()
                    new[np.searchsorted(starts, joined)] = fresh + name
                    fresh += int(name.max()) + 1
            turn += 1
            if len(starts) == len(s):
                if turn > 2 and self._finished(s, usable if turn % 2 == 0 else open_(s)):
                    break
                continue
            parent = np.zeros(len(s), np.int64)
            parent[starts] = 1
            low.up = np.cumsum(parent) - 1
            low.opens = parent.astype(bool)
            low.closes = np.append(low.opens[1:], True)
            total = np.concatenate([[0], np.cumsum(low.size)])
            ends = np.append(starts[1:], len(s))
            self.levels.append(Level(new, starts, total[ends] - total[starts], unit))

    @staticmethod
    def _finished(s, usable) -> bool:
        return not (usable[1:] & usable[:-1]).any()

    def extension(self, x: np.ndarray, y: np.ndarray, back: bool = False) -> np.ndarray:
        """How many words agree from places x and y on (x < y), to the right,
        or with ``back`` to the left; both places count.  The separator at the
        end and the front of the sequence stops every query."""
        out = np.zeros(len(x), np.int64)
        self._climb(x.astype(np.int64), y.astype(np.int64), out, back)
        return out

    def _climb(self, x, y, out, back) -> None:
        step = -1 if back else 1
        who, met = np.arange(len(x)), []  # met: where queries first differ, by level
        for k, level in enumerate(self.levels):
            top = level.up is None
            leave_w, leave_x, leave_y = [], [], []
            on_w, on_x, on_y = who, x, y
            up_w, up_x, up_y = [], [], []
            while len(on_w):
                if not top:
                    edge = level.closes if back else level.opens
                    ready = edge[on_x] & edge[on_y]
                    if ready.any():
                        up_w.append(on_w[ready])
                        up_x.append(level.up[on_x[ready]])
                        up_y.append(level.up[on_y[ready]])
                        on_w, on_x, on_y = on_w[~ready], on_x[~ready], on_y[~ready]
                        if not len(on_w):
                            break
                same = level.symbol[on_x] == level.symbol[on_y]
                if not same.all():
                    leave_w.append(on_w[~same])
                    leave_x.append(on_x[~same])
                    leave_y.append(on_y[~same])
                    on_w, on_x, on_y = on_w[same], on_x[same], on_y[same]
                hop = np.ones(len(on_w), np.int64)
                if not top and self.levels[k + 1].unit is not None:  # rest of a power in one hop
                    hop = np.minimum(self._rest(k, on_x, back), self._rest(k, on_y, back))
                out[on_w] += hop * level.size[on_x]
                on_x, on_y = on_x + step * hop, on_y + step * hop
            met.append(tuple(np.concatenate(v) if v else np.zeros(0, np.int64) for v in (leave_w, leave_x, leave_y)))
            who, x, y = (np.concatenate(v) if v else np.zeros(0, np.int64) for v in (up_w, up_x, up_y))
            if not len(who):
                break
        self._descend(met, out, back)

    def _rest(self, k: int, at: np.ndarray, back: bool) -> np.ndarray:
        """Parts of the power around ``at`` that are left, ``at`` included."""
        above = self.levels[k + 1]
        power = self.levels[k].up[at]
        first = above.first[power]
        return at - first + 1 if back else first + above.unit[power] - at

    def _descend(self, met, out, back) -> None:
        step = -1 if back else 1
        who = x = y = np.zeros(0, np.int64)
        for k in range(len(met) - 1, 0, -1):
            who, x, y = (np.concatenate([a, b]) for a, b in zip((who, x, y), met[k]))
            level, low = self.levels[k], self.levels[k - 1]
            first, size = level.first, len(low.symbol)
            if back:  # the last part of each
                x, y = (np.where(v + 1 < len(first), first[np.minimum(v + 1, len(first) - 1)], size) - 1 for v in (x, y))
            else:
                x, y = first[x], first[y]
            # Two different symbols share at most the shorter power, or one part of a pair.
            same = low.symbol[x] == low.symbol[y]
            hop = np.minimum(self._rest(k - 1, x, back), self._rest(k - 1, y, back)) if level.unit is not None else 1
            hop = np.where(same, hop, 0)
            out[who] += hop * low.size[x]
            x, y = x + step * hop, y + step * hop
            still = low.symbol[x] == low.symbol[y]
            while still.any():
                out[who[still]] += low.size[x[still]]
                x, y = x + step * still, y + step * still
                still = still & (low.symbol[x] == low.symbol[y])
        # Level 0 holds words: whatever differs there differs at once.


def grid_candidates(words: np.ndarray, longest: int) -> Iterator[tuple[np.ndarray, int]]:
    """(places, period): multiples of the period whose word equals that of the
    next two multiples, for every period up to a third of the longest text."""
    for p in range(1, longest // 3 + 1):
        grid = words[::p]
        if len(grid) < 3:
            return
        same = grid[1:] == grid[:-1]
        at = np.flatnonzero(same[1:] & same[:-1])
        if len(at):
            yield at * p, p


def standing(words: np.ndarray, spots: np.ndarray, periods: np.ndarray) -> np.ndarray:
    """Which candidates (place x, period p) can be the first multiple of p in a
    run: m = max(3, 24 // p) multiples lie in every run, so all words of x to
    x + (m - 2) p equal the word p later.  Up to ``CHECKS`` of these are
    compared, until most candidates agree."""
    span = (np.maximum(3, MIN_LENGTH // periods) - 2) * periods
    left = np.flatnonzero(spots + span + periods < len(words))
    for i in range(CHECKS):
        before = len(left)
        x, p = spots[left] + 1 + (span[left] - 2) * i // (CHECKS - 1), periods[left]
        left = left[words[x] == words[x + p]]
        if 4 * len(left) >= 3 * before:
            break
    return left


def stretches(grammar: Grammar, spots: np.ndarray, periods: np.ndarray) -> tuple[np.ndarray, ...]:
    """(begin, length, period) of the maximal stretches around candidates given
    by period and place.  Of a row of neighbouring multiples the first is
    extended; those inside its stretch have the same one and need no query.
    The next left one follows in another turn, all that are left in the last."""
    gap = np.ones(len(spots), bool)
    gap[1:] = (periods[1:] != periods[:-1]) | (spots[1:] - spots[:-1] != periods[1:])
    row, left = np.cumsum(gap) - 1, np.arange(len(spots))
    reach = np.zeros(int(row[-1]) + 1 if len(row) else 0, np.int64)  # where a row's last stretch ends
    out = []
    for turn in range(TURNS):
        if not len(left):
            break
        asked = left[np.flatnonzero(np.diff(row[left], prepend=-1))] if turn < TURNS - 1 else left
        for lo in range(0, len(asked), QUERIES):
            one = asked[lo:lo + QUERIES]
            x, p = spots[one], periods[one]
            right = grammar.extension(x, x + p)
            back = grammar.extension(x, x + p, back=True)
            out.append((x - back + 1, back + right - 1 + p, p))
            reach[row[one]] = x + right + p
        left = left[spots[left] + periods[left] >= reach[row[left]]]
    return tuple(np.concatenate(v) for v in zip(*out)) if out else (spots, spots, periods)


def padded_words(words: np.ndarray, texts: np.ndarray, lens: np.ndarray, distinct: int) -> tuple[np.ndarray, np.ndarray]:
    """(the words with a separator in front and behind every text, places of
    the separators)."""
    walls = np.append(np.cumsum(lens) - lens, len(words)) + np.arange(len(lens) + 1)
    padded = np.empty(len(words) + len(lens) + 1, np.int64)
    padded[walls] = distinct + np.arange(len(lens) + 1)
    padded[np.arange(len(words)) + texts + 1] = words
    return padded, walls


def find_runs(words: np.ndarray, texts: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, ...]:
    """(text, start, length, period) of all runs, by text, start, period.
    ``words``: numbers of all words of all texts, ``texts``: the text of each,
    ``lens``: words per text."""
    distinct = int(words.max(initial=-1)) + 1
    padded, walls = padded_words(words, texts, lens, distinct)
    longest, short = int(lens.max(initial=0)), padded.astype(np.int32)
    spots, periods = [], []
    for at, p in grid_candidates(short, longest):
        spots.append(at)
        periods.append(np.full(len(at), p))
    none = np.zeros(0, np.int64)
    if not spots:
        return none, none, none, none
    spots, periods = np.concatenate(spots), np.concatenate(periods).astype(np.int64)
    kept = standing(short, spots, periods)
    spots, periods = spots[kept], periods[kept]
    owner = np.searchsorted(walls, spots, "right") - 1
    inside = spots + 2 * periods < walls[owner + 1]
    spots, periods, owner = spots[inside], periods[inside], owner[inside]
    if not len(spots):
        return none, none, none, none
    # The grammar of the texts that have candidates.
    held = np.unique(owner)
    if len(held) < len(lens):
        chosen = np.zeros(len(lens), bool)
        chosen[held] = True
        mine, some = chosen[texts], lens[held]
        whole = walls
        padded, walls = padded_words(words[mine], np.repeat(np.arange(len(held)), some), some, distinct)
        spots = spots - whole[owner] + walls[np.searchsorted(held, owner)]
    begin, length, period = stretches(Grammar(padded, distinct), spots, periods)
    enough = length >= np.maximum(MIN_LENGTH, 3 * period)
    begin, length, period = begin[enough], length[enough], period[enough]
    order = np.lexsort([period, length, begin])
    begin, length, period = begin[order], length[order], period[order]
    fresh = np.concatenate([[True], (np.diff(begin) != 0) | (np.diff(length) != 0)]) if len(begin) else np.zeros(0, bool)
    begin, length, period = begin[fresh], length[fresh], period[fresh]
    text = np.searchsorted(walls, begin, "right") - 1
    start = begin - walls[text] - 1
    text = held[text]
    order = np.lexsort([period, start, text])
    return text[order], start[order], length[order], period[order]


def split_words(bodies: pa.Array) -> pa.ListArray:
    """The words of each text (UTF-8 bytes)."""
    parts = pc.ascii_split_whitespace(bodies.view(pa.string()))
    words = parts.flatten()
    real = pc.greater(pc.binary_length(words), 0)  # white space at an end leaves an empty part
    before = np.concatenate([[0], np.cumsum(real.to_numpy(zero_copy_only=False))])
    at = parts.offsets.to_numpy()
    return pa.ListArray.from_arrays(pa.array(before[at - at[0]], pa.int32()), words.filter(real))


class Slice:
    """Words and runs of some texts, given as bytes."""

    def __init__(self, bodies: list[bytes] | pa.Array):
        self.words = split_words(bodies if isinstance(bodies, pa.Array) else pa.array(bodies, pa.binary()))
        self.lens = np.diff(self.words.offsets.to_numpy()).astype(np.int64)
        self.text, self.start, self.length, self.period = find_runs(
            self.words.values.dictionary_encode().indices.to_numpy().astype(np.int64),
            np.repeat(np.arange(len(self.lens)), self.lens), self.lens)
        self.ends = np.searchsorted(self.text, np.arange(len(self.lens) + 1))
        self.joined = pc.binary_join(self.words, " ").view(pa.binary())

    def runs(self, i: int) -> list[tuple[int, int, int]]:
        a, b = self.ends[i], self.ends[i + 1]
        return list(zip(self.start[a:b].tolist(), self.length[a:b].tolist(), self.period[a:b].tolist()))

    def collapsed(self, i: int) -> bytes:
        """The words that no run holds after its first period, joined by spaces."""
        joined, runs = self.joined[i].as_py(), self.runs(i)
        if runs:
            words, keep = joined.split(b" "), np.ones(self.lens[i], bool)
            for start, length, period in runs:
                keep[start + period:start + length] = False
            joined = b" ".join([words[k] for k in np.flatnonzero(keep)])
        return joined


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, Slice]]:
    for b in batches:
        lens = pc.binary_length(b.column("body")).to_numpy(zero_copy_only=False)
        for lo, hi in slices_by_bytes(lens, SLICE_BYTES):
            yield b.column("id").slice(lo, hi - lo).to_pylist(), Slice(b.column("body").slice(lo, hi - lo))
        pa.default_memory_pool().release_unused()


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for ids, s in _slices(batches):
        yield batch(RUNS, doc_id=[ids[i] for i in s.text], start=s.start, length=s.length, period=s.period)


def strongest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int]:
    """The run of greatest length / period, ties: smallest start, then period."""
    return min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for ids, s in _slices(batches):
        out = {f.name: [] for f in DIGEST}
        for i, name in enumerate(ids):
            runs = s.runs(i)
            start, length, period = strongest(runs) if runs else (None, None, None)
            out["doc_id"].append(name)
            out["n_runs"].append(len(runs))
            out["start"].append(start)
            out["length"].append(length)
            out["period"].append(period)
            out["exponent_milli"].append(1000 * length // period if runs else None)
            out["runs_sha256"].append(hashlib.sha256("".join(f"{a},{b},{c}\n" for a, b, c in runs).encode()).hexdigest())
            out["collapsed_sha256"].append(hashlib.sha256(s.collapsed(i)).hexdigest())
        yield batch(DIGEST, **out)


def _collapsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for ids, s in _slices(batches):
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(
            [s.collapsed(i).decode("utf-8", "replace") for i in range(len(ids))], pa.string())], names=["doc_id", "text"])


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("bigint").alias("id"), utf8("text").alias("body"))


def runs(docs: DataFrame) -> DataFrame:
    """(doc_id, start, length, period) of every run of every text, in words."""
    return _rows(docs).mapInArrow(_runs, RUNS_DDL)


def collapsed(docs: DataFrame) -> DataFrame:
    """(doc_id, text): words after the first period of a run dropped."""
    return _rows(docs).mapInArrow(_collapsed, "doc_id bigint, text string")


def run_digests(docs: DataFrame) -> DataFrame:
    """Per row the number of runs, the strongest one and digests of all runs
    and of the collapsed text."""
    return _rows(docs).mapInArrow(_digests, DIGEST_DDL)


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """docs whose ids have a crc32 divisible by ten repeat a stretch of their
    words up to their end (a known case for tests and for the query); other
    columns stay.  Null ids are left alone."""
    words, first, period = (free_name(docs, x) for x in ("words", "first", "period"))
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g, n = F.floor(h / 10), F.size(words)
    found = F.regexp_extract_all(F.coalesce(F.col("text").cast("string"), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    planted = docs.withColumn(words, F.when(h % 10 == 0, found)).withColumn(
        first, F.when(n > 0, (g % n).cast("int"))).withColumn(
        period, F.when(n > 0, (1 + F.floor((n - F.col(first)) / (3 + g % 8))).cast("int")))
    text = F.array_join(F.transform(words, lambda w, i: F.when(i < F.col(first), w).otherwise(
        F.element_at(words, (F.col(first) + (i - F.col(first)) % F.col(period) + 1).cast("int")))), " ")
    return planted.withColumn("text", F.when(F.col(period).isNotNull(), text).otherwise(F.col("text"))).drop(
        words, first, period)
