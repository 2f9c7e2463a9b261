"""Filters and projections (FLT-1..5, PRJ-1, PRJ-3..5).

A filter list is folded into ``df.filter`` calls; Catalyst merges them and
pushes typed comparisons into the Parquet scan.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import is_float, is_numeric, is_text, nan_to_null, qcol, to_double

COMPARISONS = (">", "<", ">=", "<=")
PREVIEW_ROWS = 500        # fixed: preview length
TRIM_CHARS = 3000         # fixed: context trim length
TRIM_SUFFIX = "\n...[trimmed]"

_CANONICAL_INT = re.compile(r"-?(0|[1-9][0-9]*)")


def _equals(col: Column, dtype: T.DataType, value) -> Column:
    """pandas ``astype(str) == str(value)``.  Text and integer columns with a
    canonical integer literal compare typed (pushdown-able) with the same
    result; everything else compares the string rendering."""
    text = str(value)
    if is_text(dtype):
        return col == F.lit(text)
    if isinstance(dtype, (T.LongType, T.IntegerType, T.ShortType, T.ByteType)) and _CANONICAL_INT.fullmatch(text):
        return col == F.lit(int(text))
    return col.cast("string") == F.lit(text)


def predicate(df: DataFrame, col: str, op: str, value) -> Column | None:
    """One filter as a Column; ``None`` means "no-op" (unknown operator)."""
    dtype = df.schema[col].dataType
    c = qcol(col)
    if op == "==":
        return _equals(c, dtype, value)
    if op == "!=":
        # Null rows are kept: pandas renders them as 'nan' / 'None' first.
        return ~F.coalesce(_equals(c, dtype, value), F.lit(False))
    if op in COMPARISONS:
        if not is_numeric(dtype, "D"):
            raise TypeError(f"filter {col} {op} {value!r}: column is not numeric")
        v = F.lit(float(value))
        hit = {">": c > v, "<": c < v, ">=": c >= v, "<=": c <= v}[op]
        # Spark sorts NaN above every number; here it is a missing value.
        return hit & ~F.isnan(c) if is_float(dtype) and op in (">", ">=") else hit
    if op == "contains":
        # Regular-expression search, case-sensitive, nulls never match.
        return F.coalesce(c.cast("string").rlike(str(value)), F.lit(False))
    return None


def filter_chain(df: DataFrame, filters: Sequence[Mapping]) -> DataFrame:
    """FLT-1: AND of ``{col, op, value}``; unknown columns and operators are
    skipped as in the reference; a comparison on a text column raises."""
    out = df
    for f in filters:
        col = f.get("col", f.get("column"))
        if col not in df.columns:
            continue
        p = predicate(df, col, f.get("op"), f.get("value"))
        if p is not None:
            out = out.filter(p)
    return out


def preview(df: DataFrame, order_cols: Sequence[str], n: int = PREVIEW_ROWS) -> DataFrame:
    """PRJ-1: first ``n`` rows by ``order_cols`` (a top-k, not a sort), every
    value rendered as a string with nulls as ''."""
    top = df.orderBy(*[qcol(c) for c in order_cols]).limit(n)
    return top.select(*[F.coalesce(qcol(c).cast("string"), F.lit("")).alias(c) for c in df.columns])


def coerce_numeric(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """PRJ-3: unparsable values become NULL."""
    return df.withColumns({c: to_double(c) for c in cols})


def impute_mean(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """PRJ-4: nulls replaced by the column mean (one aggregate, then a
    map-only projection with the means as literals)."""
    if not cols:
        return df
    df = nan_to_null(df, [c for c in cols if c in df.columns])
    means = df.agg(*[F.avg(qcol(c)).alias(c) for c in cols]).first().asDict()
    return df.withColumns({c: F.coalesce(qcol(c), F.lit(means[c])) for c in cols})


def trim_text(col: Column | str, max_chars: int = TRIM_CHARS) -> Column:
    """PRJ-5: cut to ``max_chars`` characters plus a marker."""
    c = qcol(col) if isinstance(col, str) else col
    return F.when(F.length(c) > max_chars,
                  F.concat(F.substring(c, 1, max_chars), F.lit(TRIM_SUFFIX))).otherwise(c)
