"""Packing documents into training sequences: first-fit decreasing over a
tournament tree of bin capacities, run independently in randomised groups.

1. Texts become ids, an end id follows, and every document is cut into pieces
   of ``capacity`` ids; such a full piece is a sequence of its own.  In this
   vocabulary (lower case) no token spans white space, or a letter or digit
   and the full stop or comma behind it: each distinct chunk between such
   places is encoded once a worker and remembered.  The rest (shorter than a
   sequence) of each document is to be packed.
2. The rests are dealt to groups of about ``group_docs`` by a seeded hash of
   their place in the written table of pieces.  That place is unique, so a
   document id that a third of all rows share does not fill one group.
3. In a group the rests go, longest first, to the first sequence with room.
   The tree's leaves are the sequences' free places, an inner node holds the
   larger of its two: the first fit is found in log steps.
4. First-fit decreasing leaves a few sequences with gaps.  From the emptiest
   one on, sequences are dissolved: their pieces are cut to fill the gaps of
   over ``gap`` ids of the others.  At most one sequence a group stays partly
   filled; it is cut into sequences of powers of two, which need no padding.

Ids travel as little-endian 32-bit integers in a binary column.

Defined results: a null or empty text is the end id alone; repeated rows and
null ids are packed one by one; extra columns are ignored; an empty table
gives no sequences.  Sequence ids are unique, odd for full pieces.  Memory a
task: a batch of texts and the memo, or one group (``group_docs`` rests of
under ``capacity`` ids, 16 MB at the defaults).
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch, merge_ranks, slices_by_bytes, stored, utf8

CAPACITY, GROUP_DOCS, GAP, SEED = 2048, 2048, 8, 17
END_ID = 1
SLICE_BYTES = 4 << 20
MEMO_CHUNKS = 400_000  # remembered chunks a worker; emptied, not capped, when full
# Lower-case Latin letters of one or two bytes, or one closing mark.
PLAIN = re.compile(rb"(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+|[.,]").fullmatch
END = b"\x00"  # spells the end of a plain word
CLOSING = re.compile(rb"(?<=[a-z0-9])(?=[.,])")
PIECES = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()),
                    ("doc_tokens", pa.int64()), ("ids", pa.binary())])
PIECES_DDL = "doc_id bigint, start bigint, length bigint, doc_tokens bigint, ids binary"
PACKED = pa.schema([*PIECES, ("sequence_id", pa.int64()), ("offset", pa.int64())])
PACKED_DDL = PIECES_DDL + ", sequence_id bigint, offset bigint"


class ChunkEncoder:
    """Ids of texts, one encoding for each distinct chunk between white space."""

    def __init__(self, model: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_str(model)
        self.memo: dict[bytes, bytes] = {}
        ranks, self.fast = merge_ranks(model, END), None
        if ranks:  # the same vocabulary and merges in a faster library, for plain words
            import tiktoken
            self.fast = tiktoken.Encoding("words", pat_str="[^\\x00]+\\x00", mergeable_ranks=ranks, special_tokens={})
            self.closes = np.zeros(max(ranks.values()) + 1, bool)
            self.closes[[i for t, i in ranks.items() if t.endswith(END) and len(t) > 1]] = True

    def _learn_plain(self, words: list[bytes]) -> None:
        """Words that the model's own splitting and spelling leave as they are;
        each ends with the one token that closes a word."""
        ids = np.array(self.fast.encode_ordinary(END.join(words).decode("utf-8") + END.decode()), "<u4")
        ends, raw = (4 * (np.flatnonzero(self.closes[ids]) + 1)).tolist(), ids.tobytes()
        self.memo.update(zip(words, [raw[a:b] for a, b in zip([0, *ends], ends)]))

    def encode(self, texts: list[bytes]) -> list[bytes]:
        parts = [CLOSING.sub(b" ", t.lower()).split() for t in texts]
        memo = self.memo
        if len(memo) > MEMO_CHUNKS:
            memo.clear()
        new = [c for c in set(chain.from_iterable(parts)) if c not in memo]
        if self.fast:
            plain = [c for c in new if PLAIN(c)]
            for at in range(0, len(plain), 1 << 13):
                self._learn_plain(plain[at:at + (1 << 13)])
            new = [c for c in new if c not in memo]
        for at in range(0, len(new), 1 << 15):
            some = new[at:at + (1 << 15)]
            found = self.tokenizer.encode_batch_fast([c.decode("utf-8") for c in some], add_special_tokens=False)
            ids = [e.ids for e in found]
            raw = np.fromiter(chain.from_iterable(ids), "<u4").tobytes()
            ends = np.cumsum([4 * len(x) for x in ids]).tolist()
            memo.update(zip(some, [raw[a:b] for a, b in zip([0, *ends], ends)]))
        return [b"".join([memo[c] for c in x]) for x in parts]


_ENCODER: dict = {}


def encoder(key: str, model: str) -> ChunkEncoder:
    """One encoder a worker process."""
    if _ENCODER.get("key") != key:
        _ENCODER.clear()
        _ENCODER.update(key=key, encoder=ChunkEncoder(model))
    return _ENCODER["encoder"]


def _cut(key: str, model, capacity: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(key, model.value).encode, np.array([end_id], "<u4").tobytes()
        for b in batches:
            names = b.column("id").to_pylist()
            lens = pc.binary_length(b.column("body")).to_numpy(zero_copy_only=False)
            for lo, hi in slices_by_bytes(lens, SLICE_BYTES):
                out = {f.name: [] for f in PIECES}
                for name, ids in zip(names[lo:hi], encode(b.column("body").slice(lo, hi - lo).to_pylist())):
                    ids += end
                    total = len(ids) // 4
                    starts = range(0, total, capacity)
                    out["doc_id"] += [name] * len(starts)
                    out["start"] += starts
                    out["length"] += [min(capacity, total - s) for s in starts]
                    out["doc_tokens"] += [total] * len(starts)
                    out["ids"] += [ids[4 * s:4 * (s + capacity)] for s in starts]
                yield batch(PIECES, **out)
            pa.default_memory_pool().release_unused()
    return run


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """(doc_id, start, length, doc_tokens, ids) of every piece of every row.
    The vocabulary file is read on the driver and broadcast (about 2 MB)."""
    with open(path, encoding="utf-8") as f:
        text = f.read()
    if len(text) > 64 << 20:
        raise ValueError("a vocabulary file of over 64 MB is not broadcast")
    model = docs.sparkSession.sparkContext.broadcast(text)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("id"), utf8("text").alias("body"))
    return rows.mapInArrow(_cut(path, model, capacity, end_id), PIECES_DDL)


class Rooms:
    """Tournament tree over the free places of ``n`` sequences."""

    def __init__(self, n: int, capacity: int):
        self.size = 1 << max(n - 1, 0).bit_length()
        self.most = [capacity] * (2 * self.size)

    def first_fit(self, length: int) -> int:
        """Take ``length`` places of the first sequence that has them."""
        most, at = self.most, 1
        while at < self.size:
            at *= 2
            if most[at] < length:
                at += 1
        sequence, most[at] = at - self.size, most[at] - length
        while at > 1:
            at //= 2
            most[at] = max(most[2 * at], most[2 * at + 1])
        return sequence


def first_fit_decreasing(lengths: list[int], capacity: int) -> list[list[int]]:
    """Item numbers by sequence; items longest first, ties by number."""
    rooms, sequences = Rooms(len(lengths), capacity), []
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        at = rooms.first_fit(lengths[i])
        if at == len(sequences):
            sequences.append([])
        sequences[at].append(i)
    return sequences


def plan(lengths: list[int], capacity: int = CAPACITY, gap: int = GAP) -> list[list[tuple[int, int, int]]]:
    """Sequences of (item, from, to), gapless from the front."""
    sequences = [[(i, 0, lengths[i]) for i in s] for s in first_fit_decreasing(lengths, capacity)]
    used = [sum(b - a for _, a, b in s) for s in sequences]
    order = sorted(range(len(sequences)), key=lambda s: (-used[s], s))
    done = {s for s in order if capacity - used[s] <= gap or used[s] & (used[s] - 1) == 0}
    order = [s for s in order if s not in done]
    front, back = 0, len(order) - 1
    while front < back:
        filled, given = order[front], sequences[order[back]]
        while given and used[filled] < capacity:
            i, a, b = given.pop()
            take = min(b - a, capacity - used[filled])
            sequences[filled].append((i, a, a + take))
            used[filled] += take
            used[order[back]] -= take
            if a + take < b:
                given.append((i, a + take, b))
        front += used[filled] == capacity
        back -= not given
    if 0 <= back < len(order) and capacity - used[order[back]] > gap:
        left, rest = sequences[order[back]], used[order[back]]
        sequences[order[back]] = []
        while rest:
            size = 1 << (rest.bit_length() - 1)
            rest -= size
            cut = []
            while size:
                i, a, b = left.pop()
                take = min(b - a, size)
                cut.append((i, a, a + take))
                size -= take
                if a + take < b:
                    left.append((i, a + take, b))
            sequences.append(cut)
    return [s for s in sequences if s]


def _pack(capacity: int, gap: int):
    def run(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("place")
        cols = {c: rows[c].to_pylist() for c in PIECES.names}
        out = {f.name: [] for f in PACKED}
        for k, sequence in enumerate(plan(cols["length"], capacity, gap)):
            offset = 0
            for i, a, b in sequence:
                out["doc_id"].append(cols["doc_id"][i])
                out["start"].append(cols["start"][i] + a)
                out["length"].append(b - a)
                out["doc_tokens"].append(cols["doc_tokens"][i])
                out["ids"].append(cols["ids"][i][4 * a:4 * b])
                out["sequence_id"].append(2 * ((key[0].as_py() << 24) + k))
                out["offset"].append(offset)
                offset += b - a
        return pa.Table.from_batches([batch(PACKED, **out)])
    return run


def packed(docs: DataFrame, path: str, capacity: int = CAPACITY, group_docs: int = GROUP_DOCS, gap: int = GAP,
           end_id: int = END_ID, seed: int = SEED) -> DataFrame:
    """(doc_id, start, length, doc_tokens, ids, sequence_id, offset): every id
    of every document in exactly one piece of one sequence."""
    cut = stored(pieces(docs, path, capacity, end_id), "pieces").withColumn("place", F.monotonically_increasing_id())
    whole = cut.where(F.col("length") == capacity).select(
        *PIECES.names, (2 * F.col("place") + 1).alias("sequence_id"), F.lit(0).cast("bigint").alias("offset"))
    rests = cut.where(F.col("length") < capacity)
    groups = max(1, round(rests.count() / group_docs))
    dealt = rests.withColumn("group", F.pmod(F.xxhash64("place", F.lit(seed)), F.lit(groups)))
    return whole.unionByName(dealt.groupBy("group").applyInArrow(_pack(capacity, gap), PACKED_DDL))

