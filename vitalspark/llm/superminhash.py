"""Near-duplicate groups by SuperMinHash signatures.

1. ``signatures``: the distinct ``SHINGLE``-word shingles of each text as 64-bit
   hashes; a SuperMinHash signature of ``M`` entries.  Each element draws a
   random permutation of the positions step by step; at step j it offers
   j + r to the position drawn.  All elements of a text take step j together,
   and a text stops as soon as every position holds a value below j + 1, which
   no later step can beat: the same signature as element by element, and long
   texts stop after one or two steps.
2. Texts with equal sets are one class (partial aggregation: a group of
   millions of copies is one row), named by the hash of its sorted set.
3. Banding: 4 entries a band, 32 bands; a pair at the threshold shares no band
   with probability 5e-6.  Within a bucket no pairs are formed at first: each
   class meets the bucket's pivot only (round 1: smallest name; round 2, among
   classes not yet connected: the member whose signature agrees most with the
   others').
   Round 3 looks, block by block inside tasks, at all pairs of different
   components that remain, each in the first bucket they share, and puts out a
   spanning forest of the links it finds, so that no link between components
   is lost and no list of pairs is ever written.  A bucket's largest component
   is never compared with itself.
4. Every candidate whose signatures agree in at least ``SIGNATURE_FLOOR`` of
   the entries is verified on the full sets (intersection and union counted).
5. Connected components by alternating large-star and small-star steps.

Defined results: words are ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z;
texts with fewer words are one shingle, texts without words have an empty set,
are linked with nothing and form their own component; a component is named by
its smallest non-null doc_id; rows with a null doc_id take part and get that
id; rows repeated in doc_id stay one by one.  Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import (batch, bitmap_words, bits_for, free_name, in_bitmap, materialise, mix, quoted, salted_join,
                     text_slices, stored, utf8)

SHINGLE, M, ROWS = 5, 128, 4
BANDS = M // ROWS
MIN_PERCENT = 75
SIGNATURE_FLOOR = 64  # of 128; a pair at the threshold agrees in 96 +- 5
SLICE_BYTES = 2 << 20
MEMO = 200_000
BLOCK = 1024
_COEF = mix(np.arange(1, SHINGLE + 2, dtype=np.uint64)) | np.uint64(1)

SIGNATURES = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("key", pa.int64()),
                        ("sig", pa.list_(pa.int64()))])
SETS = pa.schema([("key", pa.int64()), ("elements", pa.binary())])
PAIRS = pa.schema([("a", pa.int64()), ("b", pa.int64())])
PAIRS_DDL = "a bigint, b bigint"
OPEN = pa.schema([("band", pa.int32()), ("val", pa.int64()), ("lo", pa.int32()), ("hi", pa.int32()),
                  ("key", pa.int64()), ("label", pa.int64()), ("side", pa.int64())])
OPEN_DDL = "band int, val bigint, lo int, hi int, key bigint, label bigint, side bigint"


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


def shingle_sets(texts: list[bytes], memo: WordHashes, k: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each (already lower-cased) text."""
    words = [t.split() for t in texts]
    lens = np.fromiter(map(len, words), np.int64, len(words))
    flat = np.fromiter(map(memo.__getitem__, chain.from_iterable(words)), np.uint64, int(lens.sum()))
    n = len(flat)
    with np.errstate(over="ignore"):
        rolled = np.zeros(max(n - k + 1, 0), np.uint64)
        for j in range(k):
            rolled += flat[j:j + len(rolled)] * _COEF[j]
        rolled = mix(rolled)
        out, at = [], 0
        for m in lens:
            if m >= k:
                out.append(np.unique(rolled[at:at + m - k + 1]))
            elif m:
                out.append(mix((flat[at:at + m] * _COEF[:m]).sum(keepdims=True) + np.uint64(m) * _COEF[k]))
            else:
                out.append(np.zeros(0, np.uint64))
            at += m
    return out


def superminhash(sets: list[np.ndarray], m: int = M) -> np.ndarray:
    """Signatures (len(sets), m) of uint64 values (step << 52 | random); a set
    without elements keeps the largest value everywhere."""
    if m & (m - 1) or m > 256:
        raise ValueError("m must be a power of two of at most 256")
    sig = np.full(len(sets) * m, np.uint64(0xFFFFFFFFFFFFFFFF))
    lens = np.fromiter(map(len, sets), np.int64, len(sets))
    element = np.concatenate(sets) if len(sets) else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(len(sets)), lens)
    perm = None
    for j in range(m):
        if not len(element):
            break
        drawn = mix(element ^ (np.uint64(j + 1) * np.uint64(0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFF)))
        k = j + (((drawn & np.uint64(0xFFF)) * np.uint64(m - j)) >> np.uint64(12)).astype(np.int64)
        if perm is None:
            position = k
        else:
            row = np.arange(len(element))
            position = perm[row, k].astype(np.int64)
            perm[row, k] = perm[:, j]
            perm[:, j] = position
        np.minimum.at(sig, owner * m + position, (np.uint64(j) << np.uint64(52)) | (drawn >> np.uint64(12)))
        highest = sig.reshape(-1, m).max(axis=1)
        going = (highest >= (np.uint64(j + 1) << np.uint64(52)))[owner]
        if perm is None:
            first = k[going]
            element, owner = element[going], owner[going]
            perm = np.tile(np.arange(m, dtype=np.uint8), (len(element), 1))
            row = np.arange(len(element))
            perm[row, first] = 0
            perm[:, 0] = first
        else:
            element, owner, perm = element[going], owner[going], perm[going]
    return sig.reshape(-1, m)


def packed(sig: np.ndarray) -> np.ndarray:
    """16 bits of every entry, four to a 64-bit band value."""
    return np.ascontiguousarray((sig & np.uint64(0xFFFF)).astype("<u2")).view("<i8")


def set_key(elements: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(elements.tobytes()) - (1 << 63)


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    memo = WordHashes()
    for b in batches:
        ids = b.column("doc_id")
        for lo, hi, texts in text_slices(b.column("body"), SLICE_BYTES):
            if len(memo) > MEMO:
                memo.clear()
            sets = shingle_sets([t.lower() for t in texts], memo)
            bands = packed(superminhash(sets))
            sig = pa.ListArray.from_arrays(pa.array(np.arange(0, (hi - lo + 1) * BANDS, BANDS), pa.int32()),
                                           pa.array(bands.ravel(), pa.int64()))
            out = batch(SIGNATURES, doc_id=ids.slice(lo, hi - lo), n_shingles=[len(s) for s in sets],
                        key=[set_key(s) for s in sets], sig=sig)
            yield out.append_column("digest", b.column("digest").slice(lo, hi - lo)) if "digest" in b.schema.names else out


def signatures(docs: DataFrame, digest: bool = False) -> DataFrame:
    """(doc_id, n_shingles, key, sig) of every row, map-only; with ``digest``
    also the text's SHA-1."""
    more = [F.sha1(utf8("text")).alias("digest")] if digest else []
    return docs.select(F.col("doc_id").cast("bigint"), utf8("text").alias("body"), *more).mapInArrow(
        _signatures, "doc_id bigint, n_shingles bigint, key bigint, sig array<bigint>" + ", digest string" * digest)


# ------------------------------------------------------------ verification
def attach(pairs: DataFrame, payload: DataFrame, value: str) -> DataFrame:
    """pairs(a, b) with payload(key, value) of both sides as ``va``, ``vb``.

    b may be a hub: its pairs are dealt over as many salts as they need, and
    only a hub's payload is repeated."""
    salts = (pairs.groupBy("b").agg(F.count(F.lit(1)).alias("n"))
             .select("b", F.ceil(F.col("n") / 500).cast("int").alias("salts")))
    sized = salted_join(pairs, salts, ["b"], F.xxhash64("a"))
    left = sized.withColumn("salt", F.pmod(F.xxhash64("a"), F.col("salts")).cast("int"))
    hubs = (payload.select(F.col("key").alias("b"), F.col(value).alias("vb")).join(salts, "b")
            .withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts"))
    return (left.join(hubs, ["b", "salt"])
            .join(payload.select(F.col("key").alias("a"), F.col(value).alias("va")), "a")
            .select("a", "b", "va", "vb"))


def _similar_signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        if not b.num_rows:
            continue
        x, y = b.column("va"), b.column("vb")
        sx, sy = (np.asarray(pa.compute.list_flatten(c.field("sig"))).astype("<i8").view("<u2").reshape(-1, M)
                  for c in (x, y))
        nx, ny = (np.asarray(c.field("n")) for c in (x, y))
        ok = ((sx == sy).sum(axis=1) >= SIGNATURE_FLOOR) & (
            100 * np.minimum(nx, ny) >= MIN_PERCENT * np.maximum(nx, ny))
        yield pa.RecordBatch.from_arrays([b.column(c).filter(pa.array(ok)) for c in "ab"], schema=PAIRS)


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ok = []
        for x, y in zip(b.column("va"), b.column("vb")):
            x, y = (np.frombuffer(v.as_buffer(), "<u8") for v in (x, y))
            common = len(x) + len(y) - len(np.union1d(x, y))
            ok.append(100 * common >= MIN_PERCENT * (len(x) + len(y) - common))
        yield pa.RecordBatch.from_arrays([b.column(c).filter(pa.array(ok, pa.bool_())) for c in "ab"], schema=PAIRS)


def _element_sets(wanted):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, memo = wanted.value, WordHashes()
        for b in batches:
            ids = b.column("rep").to_numpy()
            for lo, hi, texts in text_slices(b.column("body"), SLICE_BYTES):
                if len(memo) > MEMO:
                    memo.clear()
                at = np.flatnonzero(in_bitmap(seen, ids[lo:hi].view(np.uint64)))
                sets = shingle_sets([texts[i].lower() for i in at], memo)
                if sets:
                    yield batch(SETS, key=[set_key(s) for s in sets], elements=[s.astype("<u8").tobytes() for s in sets])
    return run


def hashed_id():
    return F.xxhash64(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(-(1 << 63))))


def element_sets(docs: DataFrame, classes: DataFrame, keys: DataFrame) -> DataFrame:
    """(key, elements) of the classes named, from the texts of their smallest
    rows; a fixed-size bitmap of these rows' ids keeps the rest of the corpus
    out of the shuffle."""
    spark = docs.sparkSession
    wanted = classes.join(keys, "key", "left_semi").select("key", F.col("rep").alias("doc_id"))
    ids = wanted.select(hashed_id().alias("h"))
    seen = spark.sparkContext.broadcast(bitmap_words(ids, "h", bits_for(ids.count(), 256)))
    rows = docs.select(hashed_id().alias("rep"), utf8("text").alias("body"))
    return (rows.mapInArrow(_element_sets(seen), "key bigint, elements binary")
            .join(wanted.select("key"), "key", "left_semi").dropDuplicates(["key"]))


def verified(pairs: DataFrame, docs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs that are links by their full sets."""
    alike = stored(attach(pairs, classes.select("key", F.struct("sig", F.col("n_shingles").alias("n")).alias("v")), "v")
                   .mapInArrow(_similar_signatures, PAIRS_DDL), "alike")
    keys = alike.select(F.col("a").alias("key")).union(alike.select(F.col("b").alias("key"))).distinct()
    sets = element_sets(docs, classes, keys)
    return attach(alike, stored(sets, "sets"), "elements").mapInArrow(_linked, PAIRS_DDL)


# -------------------------------------------------------------- components
def components(links: DataFrame) -> DataFrame:
    """(key, comp) of every node of the links; comp is its smallest key.

    Large-star, then small-star, until the edges stay the same.  Minima are
    pre-aggregated and a hub's neighbours are dealt over salts."""
    edges = materialise(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
                        .where("u <> v").distinct())
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = (salted_join(both.where("v > u"), low, ["u"], F.col("v"))
                 .select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct())
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (salted_join(large, low, ["u"], F.col("v"))
                 .select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")),
                                           F.struct(F.col("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
                 .where("u <> v").distinct())
        edges = materialise(small)
        now = edges.agg(F.count(F.lit(1)), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0))).first()
        if tuple(now) == state:
            break
        state = tuple(now)
    return (edges.select(F.col("u").alias("key"), F.col("v").alias("comp"))
            .unionByName(edges.select(F.col("v").alias("key"), F.col("v").alias("comp"))).distinct())


# ------------------------------------------------------------------ rounds
GROUP = ["band", "val", "lo", "hi"]


def _blocks(batches: Iterator[pa.RecordBatch], columns: list[str]):
    """(group, rows) of input sorted by GROUP; a group is at most about
    2 * BLOCK rows, whatever the size of its bucket."""
    group, rows = None, []
    for b in batches:
        for band, val, lo, hi, *row in zip(*(b.column(c).to_pylist() for c in GROUP + columns)):
            if group != (band, val, lo, hi):
                if len(rows) > 1:
                    yield group, rows
                group, rows = (band, val, lo, hi), []
            rows.append(row)
    if len(rows) > 1:
        yield group, rows


def _unpacked(rows: list, at: int) -> np.ndarray:
    return np.array([r[at] for r in rows], "<i8").view("<u2").reshape(-1, M)


def agreement(sig: np.ndarray) -> np.ndarray:
    """Per row, the entries that agree with the same entry of any row."""
    if len(sig) <= 32:
        return (sig[:, None, :] == sig[None, :, :]).sum(axis=(1, 2))
    total = np.zeros(len(sig), np.int64)
    for column in sig.T:
        _, at, count = np.unique(column, return_inverse=True, return_counts=True)
        total += count[at]
    return total


def _medoid_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every member of a block with the one that agrees most with all."""
    for _, rows in _blocks(batches, ["key", "label", "sig"]):
        keys, label, sig = np.array([r[0] for r in rows]), np.array([r[1] for r in rows]), _unpacked(rows, 2)
        if (label == label[0]).all():
            continue
        closest = agreement(sig)
        at = max(range(len(rows)), key=lambda i: (closest[i], -int(keys[i])))
        ok = ((sig == sig[at]).sum(axis=1) >= SIGNATURE_FLOOR) & (label != label[at])
        if ok.any():
            yield batch(PAIRS, a=keys[ok], b=np.full(int(ok.sum()), keys[at]))


def _open_partners(i: int, band: int, label, side, sig) -> np.ndarray:
    """Earlier rows of another component that row i may be linked with and
    whose first band in common with i is this one, so that of the buckets a
    pair shares only one looks at it."""
    ok = label[:i] != label[i]
    if side.any():  # two blocks: pairs inside one are looked at elsewhere
        ok &= side[:i] != side[i]
    at = np.flatnonzero(ok)
    same = sig[at] == sig[i]
    enough = same.sum(axis=1) >= SIGNATURE_FLOOR
    at, same = at[enough], same[enough]
    first = same.reshape(len(at), BANDS, ROWS).all(axis=2).argmax(axis=1)
    return at[first == band]


def _open_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The members of a block that have a partner to be verified."""
    for (band, val, lo, hi), rows in _blocks(batches, ["key", "label", "side", "sig"]):
        label, side, sig = np.array([r[1] for r in rows]), np.array([r[2] for r in rows]), _unpacked(rows, 3)
        open_ = np.zeros(len(rows), bool)
        for i in range(1, len(rows)):
            at = _open_partners(i, band, label, side, sig)
            open_[at] = True
            open_[i] |= len(at) > 0
        at = np.flatnonzero(open_)
        if len(at):
            n = len(at)
            yield batch(OPEN, band=[band] * n, val=[val] * n, lo=[lo] * n, hi=[hi] * n, key=[rows[i][0] for i in at],
                        label=label[at], side=side[at])


def _block_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Verify a block's open pairs on their full sets and give a spanning
    forest of the links: fewer rows than the block has, never all pairs."""
    for (band, *_), rows in _blocks(batches, ["key", "label", "side", "sig", "elements"]):
        label, side, sig = np.array([r[1] for r in rows]), np.array([r[2] for r in rows]), _unpacked(rows, 3)
        sets = [np.frombuffer(r[4], "<u8") for r in rows]
        size = np.fromiter(map(len, sets), np.int64, len(sets))
        element, df = np.unique(np.concatenate(sets), return_counts=True)
        element = element[df > 1]  # the others are in no intersection
        bits = np.zeros((len(rows), (len(element) + 63) // 64), np.uint64)
        for i, s in enumerate(sets):
            at = np.searchsorted(element, s)
            at = at[(at < len(element)) & (element[np.minimum(at, max(len(element) - 1, 0))] == s)] if len(element) else at[:0]
            np.bitwise_or.at(bits[i], at >> 6, np.uint64(1) << (at & 63).astype(np.uint64))
        parent = {int(x): int(x) for x in label}

        def root(x):
            while parent[x] != x:
                parent[x] = x = parent[parent[x]]
            return x
        out = []
        for i in range(1, len(rows)):
            at = _open_partners(i, band, label, side, sig)
            at = at[100 * np.minimum(size[at], size[i]) >= MIN_PERCENT * np.maximum(size[at], size[i])]
            common = np.bitwise_count(bits[at] & bits[i]).sum(axis=1, dtype=np.int64)
            for j in at[100 * common >= MIN_PERCENT * (size[at] + size[i] - common)]:
                x, y = root(int(label[i])), root(int(label[j]))
                if x != y:
                    parent[x] = y
                    out.append((rows[i][0], rows[j][0]))
        if out:
            yield batch(PAIRS, a=[p[0] for p in out], b=[p[1] for p in out])


def unsettled_rows(buckets: DataFrame, comp: DataFrame) -> DataFrame:
    """(band, val, key, label, blocks, free, settled, top) of the buckets that
    still hold different components.  ``blocks`` is the bucket's size over
    BLOCK.  Members of its largest component, ``top``, are not compared with
    each other: where that deals fewer rows they form ``settled`` blocks of
    their own and the others ``free`` ones, else all blocks are free."""
    labelled = buckets.join(comp, "key", "left").select(
        "band", "val", "key", F.coalesce("comp", "key").alias("label"))
    n, most = F.col("n"), F.col("most.n")
    blocks, free, settled = (F.ceil(rows / BLOCK).cast("int") for rows in (n, n - most, most))
    fewer = (n - most) * (free + settled) + most * free < n * blocks
    unsettled = (labelled.groupBy("band", "val", "label").agg(F.count(F.lit(1)).alias("n"))
                 .groupBy("band", "val").agg(F.sum("n").alias("n"), F.max(F.struct("n", "label")).alias("most"))
                 .where(n > most)
                 .select("band", "val", blocks.alias("blocks"), F.when(fewer, free).otherwise(blocks).alias("free"),
                         F.when(fewer, settled).otherwise(0).alias("settled"), F.col("most.label").alias("top")))
    return salted_join(labelled, unsettled, ["band", "val"], F.col("key"))


def _per_key(rows: DataFrame, columns: list[str], *payloads: DataFrame) -> DataFrame:
    """rows(key, columns) with the payloads (one row per key) of their keys.  A
    class meets its signature or set once, not once for each of its buckets."""
    held = rows.groupBy("key").agg(F.collect_list(F.struct(*columns)).alias("places"))
    for payload in payloads:
        held = held.join(payload, "key")
    return held.withColumn("place", F.explode("places")).select("place.*", *[c for c in held.columns if c != "places"])


def _dealt(rows: DataFrame) -> DataFrame:
    return rows.repartition(*GROUP).sortWithinPartitions(*GROUP, "key")


def medoid_candidates(buckets: DataFrame, classes: DataFrame, comp: DataFrame) -> DataFrame:
    mine = F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int")
    rows = unsettled_rows(buckets, comp).withColumn("lo", mine).withColumn("hi", mine)
    return _dealt(_per_key(rows, [*GROUP, "label"], classes.select("key", "sig"))).mapInArrow(
        _medoid_pairs, PAIRS_DDL)


def remaining_links(buckets: DataFrame, docs: DataFrame, classes: DataFrame, comp: DataFrame) -> DataFrame:
    """Links between different components, all such pairs of a bucket
    considered, of which only spanning links are put out.  Every pair of blocks
    that may hold one meets once: a free block meets every block, a settled one
    the free ones only, so that a member of the bucket's largest component is
    copied by the number of the others over BLOCK, whatever its own size."""
    in_top = (F.col("settled") > 0) & (F.col("label") == F.col("top"))
    mine = F.when(in_top, F.col("free") + F.pmod(F.xxhash64("key"), F.greatest("settled", F.lit(1)))) \
        .otherwise(F.pmod(F.xxhash64("key"), F.col("free"))).cast("int")
    meets = F.when(in_top, F.col("free")).otherwise(F.col("free") + F.col("settled"))
    rows = unsettled_rows(buckets, comp).withColumn("_m", mine).withColumn("_n", meets)
    rows = (_per_key(rows, ["band", "val", "label", "_m", "_n"], classes.select("key", "sig"))
            .withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
            .withColumn("lo", F.least("_m", "_o")).withColumn("hi", F.greatest("_m", "_o"))
            .withColumn("side", F.when(F.col("_m") > F.col("_o"), 1).otherwise(0).cast("bigint")))
    open_ = stored(_dealt(rows.select(*GROUP, "key", "label", "side", "sig")).mapInArrow(_open_rows, OPEN_DDL), "open")
    sets = stored(element_sets(docs, classes, open_.select("key").distinct()), "sets")
    return _dealt(_per_key(open_, [*GROUP, "label", "side"], classes.select("key", "sig"), sets)).mapInArrow(
        _block_links, PAIRS_DDL)


def groups(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row of docs."""
    return _named(*_connected(docs))


def _connected(docs: DataFrame, digest: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Signatures, classes and the components of linked classes."""
    sigs = stored(signatures(docs, digest), "signatures")
    classes = stored(sigs.where("n_shingles > 0").groupBy("key").agg(
        F.min("doc_id").alias("rep"), F.max("n_shingles").alias("n_shingles"), F.first("sig").alias("sig"),
        F.count(F.lit(1)).alias("copies")), "classes")
    buckets = classes.select("key", F.posexplode("sig").alias("band", "val"))
    shared = buckets.groupBy("band", "val").agg(F.min("key").alias("pivot"), F.count(F.lit(1)).alias("n")).where("n > 1")
    buckets = stored(salted_join(buckets, shared.drop("n"), ["band", "val"], F.col("key")), "buckets")
    star = buckets.where("key <> pivot").select(F.col("key").alias("a"), F.col("pivot").alias("b")).distinct()
    tried = stored(star, "pairs")
    links = stored(verified(tried, docs, classes), "links")
    comp = stored(components(links), "components")
    buckets = buckets.drop("pivot")
    more = medoid_candidates(buckets, classes, comp).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    more = stored(more.distinct().join(tried, ["a", "b"], "left_anti"), "pairs")
    if not more.isEmpty():
        links = stored(links.unionByName(verified(more, docs, classes)), "links")
        comp = stored(components(links), "components")
    more = stored(remaining_links(buckets, docs, classes, comp), "links")
    if not more.isEmpty():
        comp = stored(components(links.unionByName(more)), "components")
    return sigs, classes, comp


def _placed(classes: DataFrame, comp: DataFrame) -> DataFrame:
    """The classes with several rows or links, with their component's label."""
    return (classes.select("key", "rep", "copies").join(comp, "key", "left")
            .where((F.col("copies") > 1) | F.col("comp").isNotNull())
            .withColumn("label", F.coalesce("comp", "key")))


def _named(sigs: DataFrame, classes: DataFrame, comp: DataFrame) -> DataFrame:
    """Component names for the rows.  Only classes with several rows or links
    are joined, and rows are dealt over salts: a group may hold a third of all."""
    placed = _placed(classes, comp)
    names = placed.groupBy("label").agg(F.min("rep").alias("component_id"))
    by_key = salted_join(placed.select("key", "label"), names, ["label"], F.col("key")).select("key", "component_id")
    rows = sigs.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("key")).alias("key"))
    named = salted_join(rows, by_key, ["key"], F.xxhash64("doc_id"), "left")
    return named.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()))


def _row_name(doc_id: str = "doc_id", digest: Column | None = None) -> Column:
    """A row's id and text as one value without nulls."""
    number = F.col(doc_id).cast("bigint")
    return F.struct(number.isNull().alias("no_id"), F.coalesce(number, F.lit(0)).alias("id"),
                    (F.sha1(utf8("text")) if digest is None else digest).alias("digest"))


def deduplicated(docs: DataFrame) -> DataFrame:
    """docs, all columns, with one row of each group: the one with the smallest
    doc_id (null ids last), and of equal ids the smallest SHA-1 of the text.
    Of rows repeated in doc_id and text the one stays whose columns, written as
    text, come first; the columns may have any names."""
    sigs, classes, comp = _connected(docs, digest=True)
    rows = sigs.select("n_shingles", "key", _row_name(digest=F.col("digest")).alias("row"))
    grouped = salted_join(rows.where("n_shingles > 0").select("row", "key"),
                          _placed(classes, comp).select("key", "label"), ["key"], F.xxhash64("row"))
    first = grouped.groupBy("label").agg(F.min("row").alias("first"))
    gone = salted_join(grouped, first, ["label"], F.xxhash64("row")).where("row <> first").select("row").distinct()
    again = rows.groupBy("row").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("row")
    gone, again = stored(gone, "gone"), stored(again, "again")
    name, columns = free_name(docs, "row"), docs.columns
    left = docs.withColumn(name, _row_name()).join(gone.withColumnRenamed("row", name), name, "left_anti")
    if again.isEmpty():
        return left.drop(name)
    again = again.withColumnRenamed("row", name)
    # Partial aggregation: a row repeated a million times is one row a task.
    whole = F.struct(*[F.col(quoted(c)) for c in columns])
    kept = (left.join(again, name, "left_semi").groupBy(name).agg(F.min_by(whole, whole.cast("string")).alias("kept"))
            .select("kept.*"))
    return left.join(again, name, "left_anti").drop(name).unionByName(kept)
