"""Order MinHash fingerprints, in DataFrame functions only.

A text is a sequence of words; its elements are the ``K``-word k-mers, each
with its occurrence number, so repeats count.  Every (k-mer, occurrence) gets
one place on a hash ring; ring point b takes the ``L`` = 2 minimal elements at
or after it, puts their k-mers in text order and hashes the tuple.  The
``POINTS`` tuples are the fingerprint: two texts agree at a point only if the
same elements are minimal there and come in the same order, which makes the
likeness (the share of agreeing points) follow edit distance rather than set
overlap.  One sort of 64-bit integers a text replaces a pass per permutation.

Native functions only: words and k-mers are hashed in ``transform``, packed
with their position into 64-bit integers and sorted; runs of equal k-mers give
the occurrence numbers; markers sorted in with the elements give each ring
point's first element.

Defined results: null text is empty; a text of fewer than K words is one k-mer
of all its words; a text without words (empty or white space only) has the
empty fingerprint; likeness of two empty fingerprints is 1, of an empty and
another 0; equal texts have equal fingerprints.  Hash ties are broken by
position.  Texts up to 2**30 words are read whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, text_of

K, POINT_BITS = 3, 6
POINTS = 1 << POINT_BITS
POS_BITS = 30
_POS = (1 << POS_BITS) - 1
_SPACE = r"[\x20\x09-\x0D]+"


def _long(v: int) -> Column:
    return F.lit(v).cast("bigint")


def _indices(n: Column) -> Column:
    """0 .. n-1 (empty for n <= 0)."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def kmer_hashes(text: Column, k: int = K) -> Column:
    """64-bit hashes of the k-mers, in text order."""
    words = F.transform(F.filter(F.split(text, _SPACE), lambda w: w != ""), lambda w: F.xxhash64(w))
    return F.transform(
        F.filter(F.array(words), lambda w: F.size(w) > 0),  # one lambda variable: words are hashed once
        lambda w: F.transform(_indices(F.greatest(F.size(w) - (k - 1), F.lit(1))),
                              lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(k)])))


def _let(value: Column, body) -> Column:
    """body(value) with the value computed once (null if value is null)."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _run_starts(sorted_keys: Column) -> Column:
    """Indices at which the k-mer part of the sorted integers changes."""
    part = lambda i: F.shiftright(F.get(sorted_keys, i), POS_BITS)
    return F.filter(_indices(F.size(sorted_keys)), lambda i: (i == 0) | (part(i) != part(i - 1)))


def _elements(kmers: Column) -> Column:
    """Sorted integers: ring place of (k-mer, occurrence number) | position."""
    mask = ~_POS
    packed = F.sort_array(F.transform(kmers, lambda h, i: h.bitwiseAND(_long(mask)).bitwiseOR(i.cast("bigint"))))

    def place(x, occurrence):
        ring = F.xxhash64(F.shiftright(x, POS_BITS), occurrence)
        return ring.bitwiseAND(_long(mask)).bitwiseOR(x.bitwiseAND(_long(_POS)))

    def numbered(p):
        def runs(starts):
            end = lambda j: F.coalesce(F.get(starts, j + 1), F.size(p))
            return F.flatten(F.transform(starts, lambda s, j: F.transform(
                F.sequence(s, end(j) - 1), lambda i: place(F.get(p, i), i - s))))
        return _let(_run_starts(p), runs)
    return F.sort_array(_let(packed, numbered))


def _point_starts(elements: Column, points: int) -> Column:
    """Per ring point the number of elements before it: the places of markers
    sorted in among the elements, less the markers before them.  A marker is
    the point's smallest integer; an equal element would be one in 2**64."""
    width = 64 - (points.bit_length() - 1)
    marks = F.array(*[_long(-(1 << 63) + (b << width)) for b in range(points)])
    point = lambda x: F.shiftright(x, width)
    # Of the elements sorted with the markers, those that open a new point are the markers.
    merged = F.sort_array(F.concat(elements, marks))
    return _let(merged, lambda m: F.transform(
        F.filter(_indices(F.size(m)), lambda i: (i == 0) | (point(F.get(m, i)) != point(F.get(m, i - 1)))),
        lambda i, b: i - b))


def tuples(text: Column, k: int = K, points: int = POINTS) -> Column:
    """The hashed tuples, one per ring point; an empty array without words."""
    def of(kmers):
        def ringed(e):
            n = F.size(e)
            pos = lambda s: F.get(e, s % n).bitwiseAND(_long(_POS)).cast("int")
            return F.transform(_point_starts(e, points), lambda s: F.xxhash64(
                F.get(kmers, F.least(pos(s), pos(s + 1))), F.get(kmers, F.greatest(pos(s), pos(s + 1)))))
        return _let(_elements(kmers), ringed)
    return F.flatten(F.transform(kmer_hashes(text, k), of))


def fingerprint(parts: Column) -> Column:
    """Sixteen hexadecimal digits per ring point."""
    return F.array_join(F.transform(parts, lambda x: F.lpad(F.hex(x), 16, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """Share of ring points at which two tuple arrays agree."""
    none = (F.size(a) == 0) | (F.size(b) == 0)
    same = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda x: x))
    return (F.when(none, ((F.size(a) == 0) & (F.size(b) == 0)).cast("double"))
            .otherwise(same / F.size(a)))


def sketch(docs: DataFrame, text: str = "text", k: int = K, points: int = POINTS) -> DataFrame:
    """docs with ``omh`` (tuples) and ``fingerprint`` of a text column; map-only."""
    return (docs.withColumn("omh", tuples(text_of(text), k, points))
            .withColumn("fingerprint", fingerprint(F.col("omh"))))


# --------------------------------------------------------------- neighbours
_NO_ID = -(1 << 63)


def previous_ids(ids: DataFrame) -> DataFrame:
    """(id, prev_id, prev_n) for the distinct ids of ids(id, n): the id before
    it in ascending order, the last one before the first, and that id's n.

    Ids are range-partitioned and each partition is a window of its own; the
    partitions' last ids (one row a partition) link them.  Only ids move."""
    placed = materialise(ids.groupBy("id").agg(F.max("n").alias("n")).repartitionByRange("id")
                         .withColumn("part", F.spark_partition_id()))
    ends = {r["part"]: r["last"] for r in placed.groupBy("part").agg(F.max(F.struct("id", "n")).alias("last")).collect()}
    if not ends:
        return placed.select("id", F.col("id").alias("prev_id"), F.col("n").alias("prev_n"))
    parts = sorted(ends)
    before = [(p, ends[q]["id"], ends[q]["n"]) for p, q in zip(parts, parts[-1:] + parts[:-1])]
    edges = ids.sparkSession.createDataFrame(before, "part int, end_id bigint, end_n int")
    w = Window.partitionBy("part").orderBy("id")
    return (placed.withColumn("prev_id", F.lag("id").over(w)).withColumn("prev_n", F.lag("n").over(w))
            .join(F.broadcast(edges), "part")  # one row a partition
            .select("id", F.coalesce("prev_id", "end_id").alias("prev_id"), F.coalesce("prev_n", "end_n").alias("prev_n")))


def half(n: Column) -> Column:
    return F.floor(n / 2).cast("int")


def edited_pairs(docs: DataFrame, k: int = K, points: int = POINTS) -> DataFrame:
    """Every text's fingerprint beside those of its edited text and of the next
    document: (doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next).

    Edited: the last half of the code points is replaced by as many first ones
    (or all) of the next document in ascending doc_id; after the last comes
    the first.  Of rows repeated in doc_id the smallest text is what the rows
    before see as next; all null ids count as one lowest id.  The texts are
    shuffled once by their own id, and at most half of each once more."""
    rows = docs.select(F.coalesce(F.col("doc_id").cast("bigint"), _long(_NO_ID)).alias("id"), text_of("text").alias("text"))
    prev = previous_ids(rows.select("id", F.char_length("text").alias("n")))
    rows = rows.withColumn("omh", tuples(F.col("text"), k, points))
    following = (rows.join(prev, "id")
                 .select(F.col("prev_id").alias("id"), F.struct(
                     F.col("text").substr(F.lit(1), half(F.col("prev_n"))).alias("head"),
                     F.col("omh").alias("omh")).alias("next"))
                 .groupBy("id").agg(F.min("next").alias("next")))
    n = F.char_length("text")
    edited = F.concat(F.col("text").substr(F.lit(1), n - half(n)), F.col("next.head").substr(F.lit(1), half(n)))
    out = rows.join(following, "id").select(
        F.when(F.col("id") != _NO_ID, F.col("id")).alias("doc_id"), n.cast("bigint").alias("n_chars"), "omh",
        F.col("next.omh").alias("next_omh"), edited.alias("edited"))
    out = out.withColumn("edited_omh", tuples(F.col("edited"), k, points))
    return out.select("doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
                      fingerprint(F.col("omh")).alias("fingerprint"),
                      fingerprint(F.col("edited_omh")).alias("edited_fingerprint"),
                      likeness(F.col("omh"), F.col("edited_omh")).alias("near_edited"),
                      likeness(F.col("omh"), F.col("next_omh")).alias("near_next"))
