"""Edit-aware token counts.

A document's pre-tokens sit in the leaves of a segment tree whose nodes hold
the sums of code points and of tokens below them.  An edit descends the tree to
the first pre-token that could see it, re-splits from there until a border of
the new text meets a border of the old one, re-encodes only those pre-tokens
and updates the sums on the way to the root.

Boundary context: the splitting pattern has no look-behind, and whether a
pre-token ends at e depends on the code points up to e + 1 at most (a run of
white space gives its last one to the word after it, a contraction is looked up
two ahead).  So the first pre-token to redo is the first that ends after
``at - 2``; to the right, a split is final once it ends two code points before
the text looked at ends.

Defined results: null text is empty, null edits are none; positions beyond the
text are clamped to its end, negative ones to 0; edits apply one after the
other; all other columns are kept.  An edit list belongs to one document and is
applied in one task, like the text itself.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LEAF = 32
MEMO = 400_000
RESULT = pa.struct([(n, pa.int64()) for n in (
    "n_chars", "n_pretokens", "n_tokens", "n_edits", "edited_chars", "edited_pretokens", "edited_tokens",
    "redone_pretokens")] + [("edited_sha256", pa.string())])
RESULT_DDL = ("n_chars bigint, n_pretokens bigint, n_tokens bigint, n_edits bigint, edited_chars bigint, "
              "edited_pretokens bigint, edited_tokens bigint, redone_pretokens bigint, edited_sha256 string")


class Counter(dict):
    """Tokens of a pre-token: byte-pair merges of the rank file, remembered."""

    def __init__(self, ranks: dict[bytes, int]):
        super().__init__()
        # The pattern takes all it is given: pre-tokens are merged as they are.
        self.bpe = tiktoken.Encoding("piece", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})

    def __missing__(self, piece: str) -> int:
        if len(self) >= MEMO:
            self.clear()
        self[piece] = n = len(self.bpe.encode_ordinary(piece))
        return n


class TokenTree:
    def __init__(self, text: str, split, count: Counter):
        self.split, self.count = split, count
        self._grow(split.findall(text))

    def _grow(self, pieces: list[str]) -> None:
        """Leaves of LEAF pre-tokens and, heap-ordered above them, the sums."""
        count = self.count
        self.leaves = [pieces[i:i + LEAF] for i in range(0, len(pieces), LEAF)] or [[]]
        self.size = 1 << (len(self.leaves) - 1).bit_length()
        empty = self.size - len(self.leaves)
        self.chars = [0] * self.size + [sum(map(len, x)) for x in self.leaves] + [0] * empty
        self.tokens = [0] * self.size + [sum([count[p] for p in x]) for x in self.leaves] + [0] * empty
        for i in range(self.size - 1, 0, -1):
            self._pull(i)

    def _pull(self, i: int) -> None:
        self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]
        self.tokens[i] = self.tokens[2 * i] + self.tokens[2 * i + 1]

    @property
    def n_chars(self) -> int:
        return self.chars[1]

    @property
    def n_tokens(self) -> int:
        return self.tokens[1]

    @property
    def n_pretokens(self) -> int:
        return sum(map(len, self.leaves))

    def text(self) -> str:
        return "".join("".join(x) for x in self.leaves)

    def locate(self, at: int) -> tuple[int, int, int]:
        """(leaf, index, start) of the first pre-token that ends after ``at``;
        behind the last one if there is none."""
        if at >= self.n_chars:
            last = len(self.leaves) - 1
            return last, len(self.leaves[last]), self.n_chars
        node, start = 1, 0
        while node < self.size:
            node *= 2
            if start + self.chars[node] <= at:
                start += self.chars[node]
                node += 1
        leaf = node - self.size
        for i, p in enumerate(self.leaves[leaf]):
            if start + len(p) > at:
                return leaf, i, start
            start += len(p)
        raise AssertionError("sums do not hold")

    def _from(self, leaf: int, index: int):
        while leaf < len(self.leaves):
            for i in range(index, len(self.leaves[leaf])):
                yield leaf, i, self.leaves[leaf][i]
            leaf, index = leaf + 1, 0

    def edit(self, at: int, cut: int, insert: str) -> int:
        """Replace ``cut`` code points at ``at``; the pre-tokens re-encoded."""
        at = min(max(at, 0), self.n_chars)
        cut = min(max(cut, 0), self.n_chars - at)
        leaf, index, start = self.locate(max(at - 2, 0)) if at >= 2 else (0, 0, 0)
        head, kept, borders, pos = "", [], {}, start
        source, taken, ended = self._from(leaf, index), 0, False
        reach = 64

        def take(until: int) -> None:
            """Read old pre-tokens up to the old position ``until``."""
            nonlocal pos, taken, ended
            while pos < until and not ended:
                step = next(source, None)
                if step is None:
                    ended = True
                    return
                kept.append(step[2])
                pos += len(step[2])
                taken += 1
                borders[pos] = taken
        borders[start] = 0
        while True:
            take(at + cut + reach)
            old = "".join(kept)
            head = old[:at - start] + insert
            new = head + old[at - start + cut:]
            whole = ended or pos >= self.n_chars
            fresh, ends, used = [], 0, None
            for p in self.split.findall(new):
                ends += len(p)
                if not whole and ends > len(new) - 2:
                    break
                fresh.append(p)
                behind = ends - len(head) + at + cut  # the same place in the old text
                if ends >= len(head) and behind in borders:
                    used = borders[behind]
                    break
            if used is not None or whole:
                used = taken if used is None else used
                break
            reach *= 4
        self._splice(leaf, index, used, fresh)
        return len(fresh)

    def _splice(self, leaf: int, index: int, drop: int, fresh: list[str]) -> None:
        touched, at = [leaf], leaf
        gone = min(drop, len(self.leaves[leaf]) - index)
        tail = self.leaves[leaf][index + gone:]
        drop -= gone
        while drop:
            at += 1
            gone = min(drop, len(self.leaves[at]))
            self.leaves[at] = self.leaves[at][gone:]
            touched.append(at)
            drop -= gone
        self.leaves[leaf] = self.leaves[leaf][:index] + fresh + tail
        if len(self.leaves[leaf]) > 4 * LEAF:
            self._grow([p for x in self.leaves for p in x])
            return
        for x in touched:
            i = self.size + x
            self.chars[i] = sum(map(len, self.leaves[x]))
            self.tokens[i] = sum([self.count[p] for p in self.leaves[x]])
            i //= 2
            while i:
                self._pull(i)
                i //= 2


def load_ranks(path: str) -> dict[bytes, int]:
    import base64
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


_LOADED: dict = {}


def count_edits(docs: DataFrame, edits: Column, path: str, pattern: str, text: str = "text",
                into: str = "counts") -> DataFrame:
    """docs with a struct ``into`` of counts before and after the edits.

    edits: array of struct(at, cut, insert), applied in order.  The rank file
    is read on the driver and broadcast (a vocabulary, about 1 MB); splitting
    pattern and path are parameters."""
    spark: SparkSession = docs.sparkSession
    ranks = load_ranks(path)
    if len(ranks) > 1_000_000:
        raise ValueError("a vocabulary of over a million tokens is not broadcast")
    ranks, key = spark.sparkContext.broadcast(ranks), (path, pattern)

    @F.arrow_udf(f"struct<{RESULT_DDL.replace(' bigint', ': bigint').replace(' string', ': string')}>")
    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        if key not in _LOADED:
            _LOADED.clear()
            _LOADED[key] = (regex.compile(pattern), Counter(ranks.value))
        split, count = _LOADED[key]
        for texts, lists in batches:
            out = []
            for body, steps in zip(texts.to_pylist(), lists.to_pylist()):
                tree = TokenTree(body or "", split, count)
                row = {"n_chars": tree.n_chars, "n_pretokens": tree.n_pretokens, "n_tokens": tree.n_tokens,
                       "n_edits": len(steps or ())}
                redone = 0
                for e in steps or ():
                    redone += tree.edit(e["at"] or 0, e["cut"] or 0, e["insert"] or "")
                out.append(row | {"edited_chars": tree.n_chars, "edited_pretokens": tree.n_pretokens,
                                  "edited_tokens": tree.n_tokens, "redone_pretokens": redone,
                                  "edited_sha256": hashlib.sha256(tree.text().encode("utf-8")).hexdigest()})
            yield pa.array(out, RESULT)
    return docs.withColumn(into, run(F.coalesce(F.col(text).cast("string"), F.lit("")), edits))


def revision(text: str = "text", seed: str = "doc_id") -> Column:
    """A revision derived from the row itself: an insertion, a deletion, a
    replacement and an appended sentence at places drawn from its id."""
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    n = F.char_length(body)
    place = lambda k: F.pmod(F.xxhash64(F.lit(k), F.col(seed)), n + 1).cast("int")

    def step(at, cut, insert):
        return F.struct(at.alias("at"), F.lit(cut).alias("cut"), insert.alias("insert"))
    return F.array(step(place(1), 0, body.substr(place(2), F.lit(12))), step(place(3), 9, F.lit("")),
                   step(place(4), 5, F.concat(F.lit(" "), F.coalesce(F.col(seed).cast("string"), F.lit("0")))),
                   step(n, 0, F.concat(F.lit("\n"), body.substr(F.lit(1), F.lit(20)))))
