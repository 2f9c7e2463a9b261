"""The shared distinct table: how often each value of each column occurs.

A row gives one cell per non-null column: (position of the column, 128-bit
hash of the value), 20 bytes whatever the value.  Cells are counted with
map-side combine, so no value, however long, is a shuffle key, and rows are not
copied once a column as ``count(distinct)`` of many columns does.  Distinct
counts, class shares and modes of every column are read from this one table.

With key columns each cell also holds its smallest row key: the *representative*
row, from which a value can be fetched when a report shows it; with ``numbers``
the cells of numeric columns hold their value, so that figures of a column are
read from its distinct values instead of its rows.  Nulls have no
cell; 0.0 and -0.0 are one value.  Two values of one column share a cell with
probability 2^-128 a pair.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import is_numeric, qcol
from ..session import cut_lineage
from .aggregates import broadcast_if_small

CELL = ("position", "h1", "h2")
# Cells broadcast at once: 20 bytes and a row key each.
FETCH_ROWS = 100_000


def _cells(df: DataFrame, cols: Sequence[str], positions: Sequence[int], carried: Sequence[Column],
           with_value: bool, numbers: bool = False) -> DataFrame:
    """carried columns, position, h1, h2 (, value as text)(, number: value as
    double, null for other types): a row per non-null cell."""
    types = {f.name: f.dataType for f in df.schema.fields}

    def cell(i: int, name: str) -> Column:
        c = qcol(name)
        fields = [F.lit(i).alias("position"), F.xxhash64(c).alias("h1"), F.xxhash64(F.lit(i + 1), c).alias("h2")]
        if with_value:
            fields.append(c.cast("string").alias("value"))
        if numbers:  # -0.0 + 0.0 is 0.0
            number = c.cast("double") + F.lit(0.0) if is_numeric(types[name], "D") else F.lit(None).cast("double")
            fields.append(number.alias("number"))
        return F.when(c.isNotNull(), F.struct(*fields))
    return df.select(*carried, F.explode(F.array(*[cell(i, c) for i, c in zip(positions, cols)])).alias("_u")) \
        .where("_u is not null").select(*(["_key"] if carried else []), "_u.*")


def _row_key(key_cols: Sequence[str]) -> Column:
    return F.struct(*[qcol(k).alias(f"k{i}") for i, k in enumerate(key_cols)]).alias("_key")


def cell_counts(df: DataFrame, cols: Sequence[str] | None = None, key_cols: Sequence[str] = (),
                store: bool = False, numbers: bool = False) -> DataFrame:
    """(position, h1, h2, cnt[, first_key][, number]) of the columns ``cols`` (default:
    all); ``position`` counts from 0 within ``cols``.  ``store`` writes the table
    to the shared folder when several reports read it."""
    cols = list(df.columns if cols is None else cols)
    if not cols:
        return df.sparkSession.createDataFrame([], "position int, h1 long, h2 long, cnt long"
                                               + ", number double" * numbers)
    cells = _cells(df, cols, range(len(cols)), [_row_key(key_cols)] if key_cols else [], False, numbers)
    first = [F.min("_key").alias("first_key")] if key_cols else []
    first += [F.min("number").alias("number")] if numbers else []
    counts = cells.groupBy(*CELL).agg(F.count(F.lit(1)).alias("cnt"), *first)
    return cut_lineage(counts) if store else counts


def class_figures(cells: DataFrame) -> DataFrame:
    """Per column with a value: distinct, total (non-null cells), top and
    bottom (most and least frequent value's count)."""
    return cells.groupBy("position").agg(F.count(F.lit(1)).alias("distinct"), F.sum("cnt").alias("total"),
                                         F.max("cnt").alias("top"), F.min("cnt").alias("bottom"))


def fetch_values(df: DataFrame, cols: Sequence[str], wanted: DataFrame, key_cols: Sequence[str] = (),
                 only: Sequence[int] | None = None) -> DataFrame:
    """``wanted`` (rows of a cell table, further columns kept) with the text of
    each value.  Cells go round when there are at most FETCH_ROWS of them (the
    rows are then read without a shuffle), else both sides meet by hash.  With
    ``key_cols`` only representative rows give their text, else every row with
    the value does and the copies fold before the shuffle.  ``only``: positions
    that can occur."""
    only = range(len(cols)) if only is None else only
    carried = [_row_key(key_cols)] if key_cols else []
    cells = _cells(df, [cols[i] for i in only], only, carried, True)
    found = cells.join(broadcast_if_small(wanted, FETCH_ROWS), list(CELL))
    if key_cols:
        found = found.where(F.col("_key") == F.col("first_key"))
    return found.select(*wanted.columns, "value").distinct()
