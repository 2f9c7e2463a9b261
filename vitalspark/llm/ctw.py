"""Language-model scoring by context-tree weighting.

Texts are lower-cased (A-Z) UTF-8 bytes, each ended by one zero byte.  A byte
is eight binary decisions (the path to it in a binary tree of 255 nodes); every
node has a context tree over the preceding ``depth`` bytes, most recent first.
With Krichevsky-Trofimov block probabilities KT(a, b) of the zeros and ones
counted in a context, the weighted probability is

    P_w(s) = (KT(s) + prod P_w(children of s)) / 2,   P_w(leaf) = KT(leaf),

and a decision is predicted by mixing the estimates of all depths on its path,
w = KT / (KT + prod P_w(children)) for stopping at s.  The counts come from the
training texts; texts are scored with the counts frozen.

As Spark jobs:

1. Texts are dealt into blocks of about ``BLOCK_BYTES``; a block gives its
   distinct (depth + 1)-byte grams and words with training counts.
2. Grams are summed over blocks and grouped by their two most recent context
   bytes: such a subtree is bounded by the byte alphabet, not by the corpus.
   Its P_w are summed over (last byte, node), at most 65,280 rows, from which
   the driver weights depths 1 and 0; a second pass gives each gram its code
   length.
3. The rows (block, gram) and (block, word) meet their model values by shuffle
   and come back to their block, where the texts are summed up.  Nothing of
   the model is broadcast, and what is shuffled grows with the corpus at most.

Defined results: null text is empty (its score is that of the end alone); the
remainder that holds a row out is taken of crc32 of the id's text, null: empty;
repeated rows count each; without training rows all estimates are 1/2; extra
columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch, crc_mod, discard, mix, slices_by_bytes, store, stored, utf8

DEPTH = 5
BLOCK_BYTES = 10 << 20
CHUNK_BYTES = 512 << 10
GROUP_ROWS = 50_000
ALPHA = 0.1

FEATURES = pa.schema([("block", pa.int32()), ("word", pa.binary()), ("gram", pa.int64()), ("n", pa.int64())])
FEATURES_DDL = "block int, word binary, gram bigint, n bigint"
SCORES = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()),
                    ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()),
                    ("score", pa.float64()), ("bits_per_byte", pa.float64())])
SCORES_DDL = ("doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, "
              "base_score double, score double, bits_per_byte double")


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Stirling's series after shifting the argument by eight."""
    shift = np.zeros_like(x)
    y = x.astype(np.float64)
    small = y < 8
    z = np.where(small, y, 1.0)
    for j in range(8):
        shift = shift + np.where(small, np.log(z + j), 0.0)
    y = np.where(small, y + 8, y)
    v = 1 / (y * y)
    series = (1 / 12 - v * (1 / 360 - v * (1 / 1260 - v * (1 / 1680 - v / 1188)))) / y
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + series - shift


def log_kt(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """log of the KT block probability of a zeros and b ones."""
    return log_gamma(a + 0.5) + log_gamma(b + 0.5) - log_gamma(a + b + 1.0) - math.log(math.pi)


def grams_of(texts: list[bytes], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(gram, text index) of every byte and end: symbol | last byte << 8 | ...
    Before a text come zero bytes."""
    gap = b"\0" * depth
    flat = np.frombuffer(gap + b"".join(t + gap for t in texts), np.uint8).astype(np.uint64)
    lens = np.fromiter(map(len, texts), np.int64, len(texts))
    starts = depth + np.concatenate([[0], np.cumsum(lens + depth)[:-1]]) if len(texts) else np.zeros(0, np.int64)
    owner = np.repeat(np.arange(len(texts)), lens + 1)
    first = np.repeat(np.concatenate([[0], np.cumsum(lens + 1)[:-1]]) if len(texts) else starts, lens + 1)
    at = np.repeat(starts, lens + 1) + np.arange(len(owner)) - first
    gram = flat[at]
    for j in range(1, depth + 1):
        gram |= flat[at - j] << np.uint64(8 * j)
    return gram, owner


def _chunks(bodies: list[bytes]):
    yield from slices_by_bytes(np.fromiter(map(len, bodies), np.int64, len(bodies)), CHUNK_BYTES)


def _add(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    if not keys:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    distinct, inverse = np.unique(np.concatenate(keys), return_inverse=True)
    return distinct, np.bincount(inverse, weights=np.concatenate(counts), minlength=len(distinct)).astype(np.int64)


def _features(depth: int):
    def run(key, rows):
        bodies, train = rows["body"].to_pylist(), rows["train"].to_pylist()
        words = Counter()
        for t, on in zip(bodies, train):
            if on:
                words.update(t.lower().split())
        for t, on in zip(bodies, train):
            if not on:
                for w in t.lower().split():
                    words.setdefault(w, 0)
        keys, counts = [], []
        for lo, hi in _chunks(bodies):
            gram, owner = grams_of([t.lower() for t in bodies[lo:hi]], depth)
            on = np.array(train[lo:hi], bool)[owner]
            for part, weight in ((gram[on], 1), (gram[~on], 0)):
                k, n = np.unique(part, return_counts=True)
                keys.append(k)
                counts.append(n * weight)
            if len(keys) >= 16:
                k, n = _add(keys, counts)
                keys, counts = [k], [n]
        gram, n = _add(keys, counts)
        del bodies, keys, counts
        pa.default_memory_pool().release_unused()  # of earlier blocks of this worker
        m = len(words) + len(gram)
        return pa.table({
            "block": pa.array(np.full(m, key[0].as_py(), np.int32)),
            "word": pa.array([*words.keys()] + [None] * len(gram), pa.binary()),
            "gram": pa.concat_arrays([pa.nulls(len(words), pa.int64()), pa.array(gram.view(np.int64))]),
            "n": pa.array(np.concatenate([np.fromiter(words.values(), np.int64, len(words)), n]))}, schema=FEATURES)
    return run


# ------------------------------------------------------------------- the tree
# The bit that each of the 255 nodes decides, above the seven bytes of context and node.
_BIT = np.array([max(node, 1).bit_length() - 1 for node in range(256)], np.uint64) << np.uint64(56)


def _level_mask(depth: int) -> np.uint64:
    return np.uint64(7 << 56 | (1 << (8 * depth + 8)) - 1)


class Subtrees:
    """Contexts of ``low`` and more bytes of some complete depth-2 subtrees.
    With ``paths`` the tree knows the nodes that each of its own grams passes."""

    def __init__(self, gram: np.ndarray, n: np.ndarray, depth: int, low: int, paths: bool = False):
        """``gram`` ascending.  A key is (bit, context, node), so the keys of each
        bit ascend with the grams and those of full depth need no sorting."""
        self.seen = seen = n > 0
        sym, ctx, n = gram[seen] & np.uint64(255), gram[seen] >> np.uint64(8), n[seen].astype(np.float64)
        keys, ones, zeros = [], [], []
        for t in range(8):
            bit = (sym >> np.uint64(7 - t)) & np.uint64(1)
            keys.append(_BIT[1 << t] | ctx << np.uint64(8) | (np.uint64(1 << t) | (sym >> np.uint64(8 - t))))
            ones.append(np.where(bit == 1, n, 0.0))
            zeros.append(np.where(bit == 0, n, 0.0))
        key, a, b = np.concatenate(keys), np.concatenate(zeros), np.concatenate(ones)
        below = np.zeros(len(key))
        self.levels, self.steps = {}, []
        for d in range(depth, low - 1, -1):
            if d == depth:
                first = np.ones(len(key), bool)
                first[1:] = key[1:] != key[:-1]
                distinct, inverse = key[first], np.cumsum(first) - 1
            else:
                distinct, inverse = np.unique(key & _level_mask(d), return_inverse=True)
            if paths:
                self.steps.append(inverse.astype(np.int32))
            a, b, below = (np.bincount(inverse, weights=v, minlength=len(distinct)) for v in (a, b, below))
            kt = log_kt(a, b)
            weighted = kt if d == depth else np.logaddexp(kt, below) - math.log(2)
            stop = np.ones(len(distinct)) if d == depth else 1 / (1 + np.exp(np.clip(below - kt, -700, 700)))
            self.levels[d] = (distinct, (b + 0.5) / (a + b + 1), stop)
            key, below = distinct, weighted
        self.top = (key, a, b, below)

    def own(self) -> np.ndarray:
        """P(one) as ``one`` gives it, of the eight paths of every seen gram: (8, grams)."""
        p, node = None, None
        for (_, kt, stop), step in zip(self.levels.values(), self.steps):
            if p is None:
                p = kt
            else:
                node = step if node is None else step[node]
                p = stop[node] * kt[node] + (1 - stop[node]) * p
        return p[self.steps[0]].reshape(8, -1)

    def one(self, path: np.ndarray, depth: int, low: int) -> np.ndarray:
        """P(one) at (context, node) paths, mixed over depths low..depth."""
        p = np.full(len(path), 0.5)
        path = path | _BIT[path & np.uint64(255)]
        for d in range(depth, low - 1, -1):
            keys, kt, stop = self.levels[d]
            want = path & _level_mask(d)
            at = np.minimum(np.searchsorted(keys, want), max(len(keys) - 1, 0))
            hit = keys[at] == want if len(keys) else np.zeros(len(want), bool)
            if len(keys):
                p = np.where(hit, stop[at] * kt[at] + (1 - stop[at]) * p, 0.5)
        return p


def _ascending(rows: pa.Table, end: int) -> tuple[np.ndarray, np.ndarray]:
    gram, n = rows["gram"].to_numpy()[:end].view(np.uint64), rows["n"].to_numpy()[:end]
    order = np.argsort(gram)
    return gram[order], n[order]


def _complete_groups(batches: Iterator[pa.RecordBatch]):
    """(gram, n) arrays of whole depth-2 subtrees, grams ascending, from rows
    sorted by ctx."""
    held: list[pa.RecordBatch] = []
    size = 0
    for b in batches:
        held.append(b)
        size += b.num_rows
        if size < GROUP_ROWS:
            continue
        whole = pa.Table.from_batches(held).combine_chunks()
        ctx = whole["ctx"].to_numpy()
        end = int(np.searchsorted(ctx, ctx[-1], "left"))  # the last group may go on
        if end:
            yield _ascending(whole, end)
        held = whole.slice(end).to_batches()
        size = whole.num_rows - end
    if size:
        yield _ascending(pa.Table.from_batches(held).combine_chunks(), size)


def _tops(depth: int):
    low = min(2, depth)

    def run(batches):
        for gram, n in _complete_groups(batches):
            key, a, b, weighted = Subtrees(gram, n, depth, low).top
            yield pa.RecordBatch.from_arrays(
                [pa.array((key & np.uint64(0xFFFF)).astype(np.int32)), pa.array(a), pa.array(b), pa.array(weighted)],
                names=["path", "a", "b", "weighted"])
    return run


def root_weights(rows: list) -> tuple[np.ndarray, np.ndarray]:
    """Arrays (A, B) over (last byte, node): P(one) = A + B * P(one below)."""
    a, b, below = (np.zeros(1 << 16) for _ in range(3))
    for path, x, y, z in rows:
        a[path], b[path], below[path] = x, y, z
    seen = a + b > 0
    kt1 = log_kt(a, b)
    stop1 = 1 / (1 + np.exp(np.clip(below - kt1, -700, 700)))
    weighted = np.where(seen, np.logaddexp(kt1, below) - math.log(2), 0.0)
    a0, b0, below0 = (v.reshape(256, 256).sum(axis=0) for v in (a, b, weighted))
    kt0 = log_kt(a0, b0)
    stop0 = np.tile(1 / (1 + np.exp(np.clip(below0 - kt0, -700, 700))), 256)
    one0, one1 = np.tile((b0 + 0.5) / (a0 + b0 + 1), 256), (b + 0.5) / (a + b + 1)
    base = np.where(seen, stop0 * one0 + (1 - stop0) * stop1 * one1, stop0 * one0 + (1 - stop0) * 0.5)
    return base, np.where(seen, (1 - stop0) * (1 - stop1), 0.0)


def _lengths(depth: int, weights):
    def run(batches):
        base, rest = weights.value
        for gram, n in _complete_groups(batches):
            tree = Subtrees(gram, n, depth, 2, paths=True)
            sym, ctx = gram & np.uint64(255), gram >> np.uint64(8)
            total, own, new = np.zeros(len(gram)), tree.own(), ~tree.seen
            below = np.empty(len(gram))
            for t in range(8):
                path = ctx << np.uint64(8) | (np.uint64(1 << t) | (sym >> np.uint64(8 - t)))
                root = (path & np.uint64(0xFFFF)).astype(np.int64)
                below[tree.seen], below[new] = own[t], tree.one(path[new], depth, 2)
                one = base[root] + rest[root] * below
                total += np.log10(np.where((sym >> np.uint64(7 - t)) & np.uint64(1) == 1, one, 1 - one))
            yield pa.RecordBatch.from_arrays([pa.array(gram.view(np.int64)), pa.array(total)], names=["gram", "value"])
    return run


def gram_scores(counts: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(gram, value): log10 probability of the gram's last byte after the
    others; counts: (gram, n) with training counts, 0 for grams only scored."""
    if not 2 <= depth <= 6:
        raise ValueError("depth must be 2 to 6 bytes")
    spark = counts.sparkSession
    ctx = F.shiftright("gram", 8).bitwiseAND(F.lit(0xFFFF)).alias("ctx")
    dealt = counts.select(ctx, "gram", "n").repartition("ctx").sortWithinPartitions("ctx")
    rows = (dealt.mapInArrow(_tops(depth), "path int, a double, b double, weighted double")
            .groupBy("path").agg(F.sum("a"), F.sum("b"), F.sum("weighted")).collect())  # at most 256 * 255 rows
    weights = spark.sparkContext.broadcast(root_weights([tuple(r) for r in rows]))
    return dealt.mapInArrow(_lengths(depth, weights), "gram bigint, value double")


# -------------------------------------------------------------------- scoring
class Lookup:
    """Values by 64-bit key: open addressing in arrays, at most half full."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.mask = np.uint64((1 << max(4, int(2 * len(keys)).bit_length())) - 1)
        self.keys = np.full(int(self.mask) + 1, np.uint64(0xFFFFFFFFFFFFFFFF))  # no gram has eight bytes
        self.values = np.zeros(int(self.mask) + 1)
        slot, left = mix(keys) & self.mask, np.arange(len(keys))
        while len(left):
            free = self.keys[slot[left]] == np.uint64(0xFFFFFFFFFFFFFFFF)
            at, one = np.unique(slot[left[free]], return_index=True)
            put = left[free][one]
            self.keys[at], self.values[at] = keys[put], values[put]
            left = left[self.keys[slot[left]] != keys[left]]
            slot[left] = (slot[left] + np.uint64(1)) & self.mask

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        slot = mix(keys) & self.mask
        out, left = self.values[slot], np.flatnonzero(self.keys[slot] != keys)
        while len(left):
            slot[left] = (slot[left] + np.uint64(1)) & self.mask
            out[left] = self.values[slot[left]]
            left = left[self.keys[slot[left]] != keys[left]]
        return out


def _score(depth: int, n_train: int, distinct: int, ends: int):
    denominator = n_train + ALPHA * (distinct + 1)

    def run(key, rows, model):
        out = {f.name: [] for f in SCORES}
        pa.default_memory_pool().release_unused()  # of earlier blocks of this worker
        if rows.num_rows:
            is_gram = model["gram"].is_valid()
            value = Lookup(model["gram"].drop_null().to_numpy().view(np.uint64), model["value"].filter(is_gram).to_numpy())
            count = dict(zip(model["word"].drop_null().to_pylist(),
                             model["value"].filter(pa.compute.invert(is_gram)).to_pylist()))
            bodies = rows["body"].to_pylist()
            score = []
            for lo, hi in _chunks(bodies):
                texts = [t.lower() for t in bodies[lo:hi]]
                tokens = [t.split() for t in texts]
                lens = np.fromiter(map(len, tokens), np.int64, hi - lo)
                c = np.fromiter(map(count.__getitem__, chain.from_iterable(tokens)), np.float64, int(lens.sum()))
                owner = np.repeat(np.arange(hi - lo), lens)
                end = math.log10((ends + ALPHA) / denominator)
                out["n_tokens"].append(lens + 1)
                out["n_known"].append(np.bincount(owner, weights=c > 0, minlength=hi - lo).astype(np.int64) + (ends > 0))
                out["base_score"].append(end + np.bincount(owner, weights=np.log10((c + ALPHA) / denominator),
                                                           minlength=hi - lo))
                g, owner = grams_of(texts, depth)
                score.append(np.bincount(owner, weights=value(g), minlength=hi - lo))
            out["score"] = np.concatenate(score)
            for name in ("n_tokens", "n_known", "base_score"):
                out[name] = np.concatenate(out[name])
            size = np.fromiter((len(t) + 1 for t in bodies), np.int64, len(bodies))
            out["bits_per_byte"] = -out["score"] / math.log10(2) / size
            out["doc_id"], out["train_tokens"] = rows["doc_id"].combine_chunks(), [n_train] * rows.num_rows
            out["held_out"] = pa.compute.invert(rows["train"].combine_chunks())
        return pa.Table.from_batches([batch(SCORES, **out)])
    return run


def scores(docs: DataFrame, depth: int = DEPTH, folds: int = 10, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Model and base scores of every text, learnt from the rows whose
    crc32(doc_id) modulo ``folds`` is not 0."""
    size = docs.agg(F.coalesce(F.sum(F.octet_length(utf8())), F.lit(0)).alias("b"), F.count(F.lit(1)).alias("n")).first()
    blocks = max(1, math.ceil((size["b"] + 100 * size["n"]) / block_bytes))
    rows = docs.select(
        F.col("doc_id").cast("bigint"), utf8().alias("body"), (crc_mod("doc_id", folds) != 0).alias("train"),
        F.pmod(F.xxhash64(F.col("doc_id"), F.col("text")), F.lit(blocks)).cast("int").alias("block"))
    spark = docs.sparkSession
    written = store(rows.groupBy("block").applyInArrow(_features(depth), FEATURES_DDL), "features")
    features = spark.read.parquet(written)
    # A word's or gram's rows: one a block.
    words = features.where("word is not null").select("block", "word", "n")
    grams = features.where("gram is not null").select("block", "gram", "n")
    ends = rows.where("train").count()
    known_at = store(words.groupBy("word").agg(F.sum("n").alias("n")), "words")
    known = spark.read.parquet(known_at)
    found = known.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count_if(F.col("n") > 0).alias("v")).first()
    counts_at = store(grams.groupBy("gram").agg(F.sum("n").alias("n")), "grams")
    lengths = gram_scores(spark.read.parquet(counts_at), depth)
    model = stored(words.select("block", "word").join(known, "word")
                   .select("block", "word", F.lit(None).cast("bigint").alias("gram"),
                           F.col("n").cast("double").alias("value"))
                   .unionByName(grams.select("block", "gram").join(lengths, "gram")
                                .select("block", F.lit(None).cast("binary").alias("word"), "gram", "value")), "model")
    for path in (written, known_at, counts_at):  # the model's rows replace them
        discard(spark, path)
    return (rows.groupBy("block").cogroup(model.groupBy("block"))
            .applyInArrow(_score(depth, found["n"] + ends, found["v"] + (ends > 0), ends), SCORES_DDL))
