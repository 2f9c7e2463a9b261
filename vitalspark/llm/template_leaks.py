"""Benchmark decontamination by template canonicalisation.

Numbers, units and names become typed placeholders (``<num> <unit> <name>``,
runs of names one placeholder); windows of ``WINDOW`` template tokens are
hash-joined between documents and benchmark, and per (document, item,
alignment) the slot values must map consistently: an item value that turns
into one document value everywhere is a re-parameterised copy, one that turns
into several is a coincidence and those windows do not count.

A Title-case word that begins a text or sentence is a literal, elsewhere a
name.  What stands around a passage does not hide an item in it: the corpus
windows that begin with a name (also within a run of names) or a unit word are
looked up with that word as a literal too, and a run of names that goes on
beyond the item's ends counts with the item's own words only.

A document leaks an item when at least ``MIN_WINDOWS`` consistent windows (or
all of a shorter item's) are aligned in it.  Items shorter than a window are
matched as a whole.  A template window needs ``MIN_LITERALS`` literal tokens
(or the same share of a shorter one).

Windows with fewer literals (arithmetic, lists of names) are matched as they
are spelled: windows of ``WINDOW`` words and numbers with that few literals,
numbers and names as written, case apart.  ``MIN_WINDOWS`` of them must be
aligned; an item without any template window needs all if it has fewer.  An
item shorter than a window and without any literal (``12 13 14``) is found
only where no further number adjoins it without a closing mark between, so not
within a longer list.  Text without a letter, digit or unit sign has nothing
to match.

The corpus is read once: a fixed-size bitmap of the benchmark's window hashes
(16 MB at most, whatever the benchmark) drops windows on the map side, then a
salted hash join on (hash, template text) decides exactly.

Defined results: null text is empty and leaks nothing; items with equal text
are represented by their smallest item_id; rows repeated in (doc_id, text)
give one match; null ids are matched like any other; extra columns are
ignored by ``matches`` and kept by ``clean``.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import (batch, bitmap_words, bits_for, free_name, in_bitmap, mix, salted_join, text_slices, text_of,
                     utf8)

WINDOW, MIN_LITERALS, MIN_WINDOWS = 10, 6, 3
SLICE_BYTES = 2 << 20
VOCABULARY = 200_000  # memo of spellings per worker; emptied, not capped, when full
# What counts as a unit after a number.
UNITS = ("mm cm m km in inch inches ft foot feet yd yard yards mile miles mi mg g kg t lb lbs oz ml cl l litre litres "
         "liter liters s sec second seconds min minute minutes h hr hour hours day days week weeks month months year "
         "years hz khz mhz ghz w kw kwh v mv a ma j kj cal kcal pa kpa bar c f k mph kmh kb mb gb tb usd eur gbp "
         "dollar dollars euro euros cent cents pound pounds percent degree degrees % $ € £ °").split()
_UNITS = frozenset(UNITS)
_PIECE = re.compile(r"\d+(?:[.,:/]\d+)*|[^\W\d_]+(?:['’][^\W\d_]+)*|[%$€£°]")
_MARKS = ".,;:!?\"'()[]{}*#&|”’“‘"
_CLOSED = re.compile(r"[.!?:;)\]}][\"'”’)\]]*\Z")
_END = re.compile(r"[.!?:][\"'”’)\]]*\Z")
LITERAL, NUMBER, UNIT, TITLE, NAME = range(5)
PLACEHOLDER = {NUMBER: "<num>", UNIT: "<unit>", NAME: "<name>"}
HASH_OF = {k: xxhash.xxh64_intdigest(v) for k, v in PLACEHOLDER.items()}
FOLD = np.uint64(0x9E3779B97F4A7C15)

WINDOWS = pa.schema([("key", pa.string()), ("id", pa.int64()), ("h", pa.int64()), ("n", pa.int32()),
                     ("pos", pa.int32()), ("template", pa.string()), ("slots", pa.list_(pa.string())),
                     ("last", pa.bool_())])
WINDOWS_DDL = "key string, id bigint, h bigint, n int, pos int, template string, slots array<string>, last boolean"


class Spellings(dict):
    """Memo: white-space token -> row; a row is a range of pieces.
    ``closed``: the pieces that a closing mark follows."""

    def __init__(self):
        super().__init__()
        self.text, self.pieces, self.ranges, self.closed = [], [], [], set()
        self.done = [0, 0]
        self.tables = [[np.zeros(1 << 12, t) for t in types] for types in (
            (np.uint64, np.int8, bool, bool), (np.int64, np.int64))]

    def __missing__(self, token: bytes) -> int:
        spelled = token.decode("utf-8", "replace")
        core = spelled.strip(_MARKS)
        found = [core] if core.isalpha() else _PIECE.findall(spelled)  # the pattern finds one piece in letters
        closed = len(core) < len(spelled) and bool(found) and _CLOSED.search(spelled) is not None
        ends = closed and _END.search(spelled) is not None
        at = len(self.text)
        for p in found:
            low = p.lower()
            kind = (NUMBER if p[0].isdigit() else UNIT if p in "%$€£°" else
                    TITLE if p[0].isupper() and p[1:].islower() else LITERAL)
            self.text.append(low)
            self.pieces.append((xxhash.xxh64_intdigest(low), kind, False, low in _UNITS))
        if ends:
            self.pieces[-1] = (*self.pieces[-1][:2], True, self.pieces[-1][3])
        if closed:
            self.closed.add(len(self.text) - 1)
        self.ranges.append((at, len(found)))
        self[token] = row = len(self.ranges) - 1
        return row

    def columns(self) -> list[np.ndarray]:
        """hash, kind, ends and unit-word flag of all pieces, first piece and
        number of pieces of all rows; only what is new since the last call is
        converted."""
        for k, source in enumerate((self.pieces, self.ranges)):
            at, n = self.done[k], len(source)
            if n > len(self.tables[k][0]):
                self.tables[k] = [np.concatenate([a, np.zeros(max(n, len(a)), a.dtype)]) for a in self.tables[k]]
            if n > at:
                for a, values in zip(self.tables[k], zip(*source[at:])):
                    a[at:n] = values
            self.done[k] = n
        return self.tables[0] + self.tables[1]


def templates(texts: list[bytes], memo: Spellings):
    """Template tokens of some texts, end to end: document index, hash, kind,
    and for each the range [start, end) of its pieces; plus the pieces, and
    those that are literals only if a text begins with them: piece, its hash,
    and the first token of what follows it; and the pieces' own document
    index, hash and kind."""
    words = [text.split() for text in texts]
    lens = np.fromiter(map(len, words), np.int64, len(words))
    rows = np.fromiter(map(memo.__getitem__, chain.from_iterable(words)), np.int64, int(lens.sum()))
    *columns, begin, count = memo.columns()
    count = count[rows]
    idx = np.repeat(begin[rows] - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
    doc = np.repeat(np.repeat(np.arange(len(texts)), lens), count)
    hashed, kind, ends, unit_words = (c[idx] for c in columns)
    sign = kind == UNIT
    first = np.ones(len(idx), bool)
    first[1:] = (doc[1:] != doc[:-1]) | ends[:-1]
    title = kind == TITLE
    kind[title & first], kind[title & ~first] = LITERAL, NAME
    # A unit word is a unit only after a number, with none between.
    after = np.zeros(len(idx), bool)
    after[1:] = (kind[:-1] == NUMBER) & (doc[1:] == doc[:-1])
    kind[unit_words & after & (kind != NUMBER)] = UNIT
    lead = np.flatnonzero((kind == NAME) | ((kind == UNIT) & ~sign))
    plain, hashed = hashed, hashed.copy()
    for k, h in HASH_OF.items():
        hashed[kind == k] = h
    same = np.zeros(len(idx), bool)  # continues a run of names
    same[1:] = (kind[1:] == NAME) & (kind[:-1] == NAME) & (doc[1:] == doc[:-1])
    start = np.flatnonzero(~same)
    end = np.append(start[1:], len(idx))
    return (doc[start], hashed[start], kind[start], start, end, idx,
            (lead, plain[lead], np.searchsorted(end, lead + 1, "right")), (doc, plain, kind))


def _windows(lengths: tuple[int, ...], whole: bool, bitmap, window: int, min_literals: int):
    """lengths: the window lengths wanted, in template tokens, or negative in
    pieces as spelled; whole: a text shorter than ``window`` is one window (the
    benchmark side)."""
    words = None if bitmap is None else bitmap

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = None if words is None else words.value
        memo = Spellings()
        for b in batches:
            ids = b.column("id").to_pylist()
            for lo, hi, texts in text_slices(b.column("body"), SLICE_BYTES):
                if len(memo.text) > VOCABULARY:
                    memo = Spellings()
                out = {f.name: [] for f in WINDOWS}
                doc, hashed, kind, start, end, idx, (lead, spelled, rest), pieces = templates(
                    texts, memo)
                literal = np.concatenate([[0], np.cumsum(kind == LITERAL)])
                size = np.bincount(doc, minlength=hi - lo) if len(doc) else np.zeros(hi - lo, int)
                offset = np.concatenate([[0], np.cumsum(size)])
                keys = {}  # of the rows with a window

                def put(d, h, n, pos, template, slots, last):
                    if d not in keys:
                        keys[d] = row_key(ids[lo + d], texts[d])
                    out["id"].append(ids[lo + d])
                    out["key"].append(keys[d])
                    out["h"].append(int(h.view(np.int64)))
                    out["n"].append(n)
                    out["pos"].append(int(pos))
                    out["template"].append(template)
                    out["slots"].append(slots)
                    out["last"].append(bool(last))

                for n in lengths:
                    if n < 0:
                        for d, h, pos, i in _spelled(pieces, idx, memo, -n, whole, seen, window, min_literals):
                            put(d, h, n, pos, " ".join(memo.text[j] for j in idx[i:i - n]), [], False)
                        continue
                    count = len(doc) - n + 1
                    if count <= 0:
                        continue
                    tail = np.zeros(count + 1, np.uint64)  # the n - 1 tokens from each token on
                    with np.errstate(over="ignore"):
                        for j in range(n - 1):
                            tail = tail * FOLD + hashed[j:j + count + 1]
                    # Windows of tokens, then those whose first word is taken as a literal.
                    fits = np.flatnonzero(rest <= count) if not whole else np.zeros(0, np.int64)
                    with np.errstate(over="ignore"):
                        power, base = (np.uint64(x * pow(int(FOLD), e, 1 << 64) % (1 << 64)) for x, e in (
                            (1, n - 1), (n, n)))
                        h = mix(hashed[:count] * power + tail[1:] + base)
                        first = mix(spelled[fits] * power + tail[rest[fits]] + base)
                    begin = np.arange(count)
                    if seen is not None:
                        begin = np.flatnonzero(in_bitmap(seen, h))
                        hit = in_bitmap(seen, first)
                        h, first, fits = h[begin], first[hit], fits[hit]
                    begin, word = np.append(begin, rest[fits] - 1), np.append(np.full(len(begin), -1), lead[fits])
                    h = np.append(h, first)
                    literals = literal[begin + n] - np.where(word < 0, literal[begin], literal[begin + 1] - 1)
                    ok = (doc[begin] == doc[begin + n - 1]) & (literals * window >= min_literals * n)
                    if whole and n < window:
                        ok &= size[doc[begin]] == n
                    for i in np.flatnonzero(ok):
                        at, own = int(begin[i]), int(word[i])
                        d = int(doc[at])
                        kinds, starts = kind[at:at + n], start[at:at + n]
                        if own >= 0:
                            kinds, starts = kinds.copy(), np.maximum(starts, own + 1)
                            kinds[0], starts[0] = LITERAL, own
                        template, slots = [], []
                        for k, s, e in zip(kinds, starts, end[at:at + n]):
                            if k == LITERAL:
                                template.append(memo.text[idx[s]])
                            else:
                                template.append(PLACEHOLDER[k])
                                slots.append(PLACEHOLDER[k] + " ".join(memo.text[j] for j in idx[s:e]))
                        put(d, h[i], n, at - offset[d], " ".join(template), slots, at + n == offset[d + 1])
                if out["h"]:
                    yield batch(WINDOWS, **out)
    return run


def _spelled(pieces, idx, memo: Spellings, n: int, whole: bool, seen, window: int, min_literals: int):
    """(document index, hash, position, piece) of the windows of n pieces with
    too few literals for a template.  What stands before a passage can make a
    literal of it a name or unit, never the reverse, so none is missed."""
    doc, plain, kind = pieces
    count = len(doc) - n + 1
    if count <= 0:
        return
    literal = np.concatenate([[0], np.cumsum(kind == LITERAL)])
    size = np.bincount(doc)
    offset = np.concatenate([[0], np.cumsum(size)])
    literals = literal[n:] - literal[:count]
    at = np.flatnonzero((literals * window < min_literals * n) & (doc[:count] == doc[n - 1:]))
    if whole and n < window:
        at = at[size[doc[at]] == n]
    h = np.full(len(at), -n % (1 << 64), np.uint64)
    with np.errstate(over="ignore"):
        for j in range(n):
            h = h * FOLD + plain[at + j]
    h = mix(h)
    if seen is not None:
        hit = in_bitmap(seen, h)
        at, h = at[hit], h[hit]
    for i, x in zip(at.tolist(), h):
        d = int(doc[i])
        if n < window and not literals[i] and any(
                offset[d] <= j < offset[d + 1] and kind[j] == NUMBER and idx[min(i + n - 1, j)] not in memo.closed
                for j in (i - 1, i + n)):
            continue
        yield d, x, i - offset[d], i


def row_key(doc_id, body: bytes) -> str:
    return hashlib.md5(f"{'' if doc_id is None else doc_id}|".encode() + body).hexdigest()


def key_column(doc_id: str = "doc_id", text: str = "text"):
    """The same key as ``row_key``, as a column."""
    return F.md5(F.concat(F.concat(F.coalesce(F.col(doc_id).cast("bigint").cast("string"), F.lit("")),
                                   F.lit("|")).cast("binary"), utf8(text)))


def _consistent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Count the windows of an alignment whose slots all agree with the most
    frequent document value of each item value (ties: the smallest)."""
    for b in batches:
        good, same = [], []
        for windows in b.column("windows").to_pylist():
            votes = Counter((i, d) for w in windows for i, d in zip(w["item_slots"], w["doc_slots"]))
            chosen = {}
            for (i, d), n in sorted(votes.items(), key=lambda v: (-v[1], v[0])):
                chosen.setdefault(i, d)
            kept = [w for w in windows if all(chosen[i] == d for i, d in zip(w["item_slots"], w["doc_slots"]))]
            good.append(len({w["pos"] for w in kept}))
            same.append(all(w["item_slots"] == w["doc_slots"] for w in kept))
        yield pa.RecordBatch.from_arrays(
            [b.column(c) for c in b.schema.names if c != "windows"]
            + [pa.array(good, pa.int64()), pa.array(same, pa.bool_())],
            names=[c for c in b.schema.names if c != "windows"] + ["windows", "exact"])


def _own_names(joined: DataFrame) -> DataFrame:
    """doc_slots without the names that stand before or after the item in the
    same run: only an item's second token (its first is never a name) and its
    last one can be such a run."""
    name, doc, item = PLACEHOLDER[NAME], F.col("doc_slots"), F.col("item_slots")
    before = F.col("template").startswith(name) & (F.col("item_pos") == 1) & F.get(doc, F.lit(0)).endswith(
        F.concat(F.lit(" "), F.substring(F.get(item, F.lit(0)), len(name) + 1, 1 << 30)))
    after = F.col("template").endswith(name) & F.col("last") & F.get(doc, F.size(doc) - 1).startswith(
        F.concat(F.get(item, F.size(item) - 1), F.lit(" ")))
    return joined.withColumn("doc_slots", F.transform("doc_slots", lambda v, i: F.when(
        (before & (i == 0)) | (after & (i == F.size(doc) - 1)), F.get(item, i)).otherwise(v)))


def benchmark_windows(benchmark: DataFrame, window: int, min_literals: int) -> DataFrame:
    items = (benchmark.select(F.col("item_id").cast("bigint").alias("id"), text_of("text").alias("t"))
             .groupBy("t").agg(F.min("id").alias("id")).select("id", F.col("t").cast("binary").alias("body")))
    lengths = (*range(1, window + 1), *range(-window, 0))
    found = items.mapInArrow(_windows(lengths, True, None, window, min_literals), WINDOWS_DDL)
    return found.where((F.abs("n") == window) | (F.col("pos") == 0))


def matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, min_literals: int = MIN_LITERALS,
            min_windows: int = MIN_WINDOWS) -> DataFrame:
    """(key, doc_id, item_id, kind, windows, item_windows) of every leak."""
    spark = docs.sparkSession
    items = benchmark_windows(benchmark, window, min_literals).select(
        F.col("key").alias("item_key"), F.col("id").alias("item_id"), "h", "n", F.col("pos").alias("item_pos"),
        "template", F.col("slots").alias("item_slots"), "last").persist()
    try:
        lengths = tuple(sorted(r["n"] for r in items.select("n").distinct().collect()))  # at most 2 * ``window``
        seen = spark.sparkContext.broadcast(bitmap_words(items, "h", bits_for(items.count(), 4096)))
    finally:
        items.unpersist()
    rows = docs.select(F.col("doc_id").cast("bigint").alias("id"), utf8("text").alias("body"))
    found = rows.mapInArrow(_windows(lengths, False, seen, window, min_literals), WINDOWS_DDL).drop("last").withColumnRenamed(
        "slots", "doc_slots")
    template = F.col("n") > 0
    totals = items.groupBy("item_key").agg(F.countDistinct(F.when(template, F.col("item_pos"))).alias("item_windows"),
                                           F.countDistinct(F.when(~template, F.col("item_pos"))).alias("item_spelled"))
    joined = salted_join(found, items.join(totals, "item_key"), ["h", "n", "template"], F.xxhash64("key", "pos"))
    aligned = (_own_names(joined).groupBy(
        "key", F.col("id").alias("doc_id"), "item_key", "item_id", "item_windows", "item_spelled", "n",
        (F.col("pos") - F.col("item_pos")).alias("shift"))
               # one row per window of the item: bounded by the item's length
               .agg(F.collect_set(F.struct(F.col("item_pos").alias("pos"), "item_slots", "doc_slots")).alias("windows")))
    checked = aligned.select("key", "doc_id", "item_id", "item_windows", "item_spelled", "n", "windows").mapInArrow(
        _consistent, "key string, doc_id bigint, item_id bigint, item_windows bigint, item_spelled bigint, n int, "
                     "windows bigint, exact boolean")
    most = F.lit(min_windows).cast("bigint")
    need = (F.when(template, F.least(most, F.col("item_windows")))
            .when(F.col("item_windows") == 0, F.least(most, F.col("item_spelled"))).otherwise(most))
    # Of an item found both ways, the templates' result.
    return (checked.where(F.col("windows") >= need)
            .groupBy("key", "doc_id", "item_id", "item_windows", "item_spelled")
            .agg(F.max(F.struct(template.alias("template"), "exact")).alias("best"),
                 F.max(F.when(template, F.col("windows"))).alias("windows"),
                 F.max(F.when(~template, F.col("windows"))).alias("spelled"))
            .select("key", "doc_id", "item_id",
                    F.when(F.col("best.exact"), "exact").otherwise("reparameterised").alias("kind"),
                    F.coalesce("windows", "spelled").alias("windows"),
                    F.when(F.col("best.template"), F.col("item_windows")).otherwise(F.col("item_spelled"))
                    .alias("item_windows")))


def clean(docs: DataFrame, found: DataFrame) -> DataFrame:
    """docs, all columns, without the rows that leak; the columns may have any
    names."""
    key = free_name(docs, "row_key")
    bad = found.select(F.col("key").alias(key)).distinct()
    return docs.withColumn(key, key_column()).join(bad, key, "left_anti").drop(key)
