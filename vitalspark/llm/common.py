"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir, remove_tree, scratch_table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Fixed seeds of the 64-bit mixer below (splitmix64).
MIX_ADD, MIX_A, MIX_B = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def text_of(name: str = "text") -> Column:
    """The text with null read as empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def utf8(name: str = "text") -> Column:
    """The text's UTF-8 bytes (null: empty)."""
    return F.coalesce(F.col(name).cast("string"), F.lit("")).cast("binary")


def lower_ascii(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def crc_mod(name: str, m: int) -> Column:
    """crc32 of the id written as text, modulo m; a null id counts as ''."""
    return F.crc32(F.coalesce(F.col(name).cast("string"), F.lit("")).cast("binary")) % m


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores in front until df has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def quoted(name: str) -> str:
    """A column name as one part of a reference, dots and back quotes included."""
    return "`" + name.replace("`", "``") + "`"


def shared_path(spark: SparkSession, what: str) -> str:
    """A new folder name below the cluster's shared checkpoint folder."""
    return scratch_table(spark, what)


def materialise(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder: an
    executor that is lost later costs no recomputation."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def byte_letters() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabularies: visible
    Latin-1 letters stand for themselves, the rest for U+0100 onwards."""
    out, shift = {}, 0
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174:
            out[chr(b)] = b
        else:
            out[chr(256 + shift)] = b
            shift += 1
    return out


def merge_ranks(model: str, end: bytes = b"") -> dict[bytes, int] | None:
    """bytes -> id of a byte-level BPE file whose ids follow the order of its
    merges, so that merging the pair of lowest id first is the same algorithm;
    None for other files.  The model's mark of a word's end is spelt ``end``."""
    bpe = json.loads(model)["model"]
    suffix, letters = bpe.get("end_of_word_suffix") or "", byte_letters()
    special = {t["content"] for t in json.loads(model).get("added_tokens", [])}
    joined = ["".join(m if isinstance(m, list) else m.split(" ")) for m in bpe["merges"]]
    if suffix:
        joined = [t.replace(suffix, "", t.count(suffix) - t.endswith(suffix)) for t in joined]
    ids = [bpe["vocab"].get(t) for t in joined]
    first = 512 if suffix else 256
    if bpe.get("ignore_merges") or bool(suffix) != bool(end) or ids != list(range(first, first + len(ids))):
        return None
    out = {}
    for token, i in bpe["vocab"].items():
        if token not in special:
            whole = bool(suffix) and token.endswith(suffix)
            word = token[:len(token) - len(suffix)] if whole else token
            if not all(c in letters for c in word):
                return None
            out[bytes(letters[c] for c in word) + (end if whole else b"")] = i
    return out


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def store(df: DataFrame, what: str) -> str:
    """Write to a new folder below the shared one; returns its path.  The
    written table replaces the shuffle files that made it, so Spark is told to
    drop those with the query."""
    spark = df.sparkSession
    path, before = shared_path(spark, what), spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return path


def stored(df: DataFrame, what: str) -> DataFrame:
    """``store`` and read again: cuts the lineage of tables read more than once."""
    return df.sparkSession.read.parquet(store(df, what))


def discard(spark: SparkSession, path: str) -> None:
    """Delete a folder that ``store`` made and that nothing reads any more."""
    remove_tree(spark, path)


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64 finaliser on a uint64 array."""
    with np.errstate(over="ignore"):
        x = x + np.uint64(MIX_ADD)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(MIX_A)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(MIX_B)
        return x ^ (x >> np.uint64(31))


def salted_join(left: DataFrame, right: DataFrame, keys: Sequence[str], by: Column,
                how: str = "inner", salts: int = 8) -> DataFrame:
    """Join with each key spread over ``salts`` partitions: the left rows are
    dealt by a hash of ``by``, the (one row per key, narrow) right rows are
    repeated.  For keys of which one may hold a third of the left rows."""
    l = left.withColumn("_salt", F.pmod(F.xxhash64(by), F.lit(salts)).cast("int"))
    r = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return l.join(r, [*keys, "_salt"], how).drop("_salt")


def bitmap_words(df: DataFrame, key: str, bits: int) -> np.ndarray:
    """A one-hash Bloom bitmap of a long column: 2**bits bits, so at most
    2**(bits-6) rows of (word, value) reach the driver whatever the input.
    ``bits`` <= 27 keeps the broadcast array at 16 MB or less."""
    if bits > 27:
        raise ValueError("bitmap would exceed its proven bound of 16 MB")
    slot = F.col(key).bitwiseAND(F.lit((1 << bits) - 1))
    rows = (df.where(F.col(key).isNotNull())
            .groupBy(F.shiftright(slot, 6).alias("w"))
            .agg(F.bit_or(F.expr(f"shiftleft(1L, cast(({key} & {(1 << bits) - 1}L) & 63 as int))")).alias("v"))
            .toArrow())
    out = np.zeros(1 << max(bits - 6, 0), np.uint64)
    out[rows["w"].to_numpy()] = rows["v"].to_numpy().view(np.uint64)
    return out


def in_bitmap(words: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which uint64 keys have their bit set (no false negatives)."""
    slot = keys & np.uint64(len(words) * 64 - 1)
    return (words[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63))) & np.uint64(1) != 0


def bits_for(rows: int, per_key: int = 64) -> int:
    """Bitmap size: about ``per_key`` bits a key, within the 16 MB bound."""
    return min(27, max(16, int(max(rows, 1) * per_key).bit_length()))


def slices_by_bytes(lengths: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Consecutive row ranges of about ``most`` bytes; a longer row is alone."""
    at, n, ends = 0, len(lengths), np.cumsum(lengths)
    while at < n:
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + most, "right")))
        yield at, to
        at = to


def text_slices(column: pa.Array, most: int) -> Iterator[tuple[int, int, list]]:
    """(from, to, texts) of consecutive rows of about ``most`` bytes: a batch is
    never turned into Python strings as a whole.  Nulls count as empty."""
    lens = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    for lo, hi in slices_by_bytes(lens, most):
        yield lo, hi, column.slice(lo, hi - lo).to_pylist()
    pa.default_memory_pool().release_unused()


def batch(schema: pa.Schema, **cols) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(cols[f.name], f.type) if not isinstance(cols[f.name], pa.Array)
                                       else cols[f.name] for f in schema], schema=schema)


class TokenTable(dict):
    """Memo of tokens: token -> row of columns computed once per spelling.

    ``describe(token)`` gives the row; ``columns()`` the rows as arrays, of
    which only new ones are converted.  ``fresh()`` empties a table that has
    outgrown its memory; call it between slices only."""

    def __init__(self, describe, dtypes: Sequence, most: int = 200_000):
        super().__init__()
        self.describe, self.dtypes, self.most = describe, dtypes, most
        self._reset()

    def _reset(self) -> None:
        self.clear()
        self.new: list[tuple] = []
        self.done, self.arrays = 0, [np.zeros(1 << 12, t) for t in self.dtypes]

    def __missing__(self, token):
        self[token] = at = self.done + len(self.new)
        self.new.append(self.describe(token))
        return at

    def columns(self) -> list[np.ndarray]:
        n = self.done + len(self.new)
        if n > len(self.arrays[0]):
            self.arrays = [np.concatenate([a, np.zeros(max(n, len(a)), a.dtype)]) for a in self.arrays]
        if self.new:
            for a, values in zip(self.arrays, zip(*self.new)):
                a[self.done:n] = values
        self.done, self.new = n, []
        return self.arrays

    def fresh(self) -> None:
        if len(self) > self.most:
            self._reset()

    def rows_of(self, token_lists: Sequence[Sequence]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row of every token, list index of every token, list lengths)."""
        lens = np.fromiter(map(len, token_lists), np.int64, len(token_lists))
        rows = np.fromiter(map(self.__getitem__, chain.from_iterable(token_lists)), np.int64, int(lens.sum()))
        return rows, np.repeat(np.arange(len(token_lists)), lens), lens


def labelled_sample(labels: DataFrame, column: str, most: int, folds: int = 4, held: int = 2) -> DataFrame:
    """(doc_id, label) of at most ``most`` rows of each class, those with the
    smallest hash of their id, and only ids whose crc32 modulo ``folds`` is not
    ``held``.  A doc labelled twice counts once, with its larger label."""
    rows = (labels.where(F.col(column).isin(0, 1) & F.col("doc_id").isNotNull() & (crc_mod("doc_id", folds) != held))
            .groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.max(column).cast("int").alias("label")))
    parts = [rows.where(F.col("label") == v).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most) for v in (0, 1)]
    return parts[0].unionByName(parts[1])
