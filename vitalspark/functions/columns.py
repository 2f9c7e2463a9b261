"""Column-level helpers: type rules, coercion, null handling.

The reference decides "numeric" in four slightly different ways; each rule is
kept so every operator can follow the one it is specified with.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Rule A: float64/float32/int64/int32 only.
RULE_A = (T.DoubleType, T.FloatType, T.LongType, T.IntegerType)
# Rule B (column statistics) adds the small integers.
RULE_B = RULE_A + (T.ShortType, T.ByteType)


def is_numeric(dtype: T.DataType, rule: str = "A") -> bool:
    if rule == "A":
        return isinstance(dtype, RULE_A)
    if rule == "B":
        return isinstance(dtype, RULE_B)
    if rule == "C":  # any numeric, booleans included
        return isinstance(dtype, (T.NumericType, T.BooleanType))
    if rule == "D":  # any numeric, no booleans
        return isinstance(dtype, T.NumericType)
    raise ValueError(f"unknown numeric rule {rule!r}")


def is_float(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.DoubleType, T.FloatType))


def is_text(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.StringType, T.VarcharType, T.CharType))


def numeric_columns(df: DataFrame, cols: Iterable[str] | None = None, rule: str = "A") -> list[str]:
    types = {f.name: f.dataType for f in df.schema.fields}
    names = list(cols) if cols is not None else df.columns
    return [c for c in names if c in types and is_numeric(types[c], rule)]


def require_numeric(df: DataFrame, cols: Sequence[str], rule: str = "A") -> list[str]:
    kept = numeric_columns(df, cols, rule)
    if not kept:
        raise ValueError("no numeric columns selected")
    return kept


def qcol(name: str) -> Column:
    """Column reference that survives dots and spaces in names."""
    return F.col(f"`{name}`")


def nan_to_null(df: DataFrame, cols: Iterable[str] | None = None) -> DataFrame:
    """Spark keeps NaN and NULL apart; pandas does not.  Normalise NaN->NULL
    so every null test below sees both."""
    types = {f.name: f.dataType for f in df.schema.fields}
    targets = [c for c in (cols or df.columns) if is_float(types[c])]
    if not targets:
        return df
    return df.withColumns({c: F.when(F.isnan(qcol(c)), F.lit(None)).otherwise(qcol(c)) for c in targets})


def to_double(c: Column | str) -> Column:
    """``pd.to_numeric(errors='coerce')``: unparsable -> NULL (ANSI-safe), and
    NaN -> NULL: Spark holds NaN equal to itself, so NULLIF removes it."""
    col = qcol(c) if isinstance(c, str) else c
    return F.nullif(col.try_cast("double"), F.lit(float("nan")))


def complete_rows(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Listwise deletion over the used columns (PRJ-2)."""
    return nan_to_null(df, cols).dropna("any", subset=list(cols))


def std_or_one(std: Column) -> Column:
    """pandas ``std() or 1``: zero (or a single-row NULL) becomes 1."""
    return F.coalesce(F.nullif(std, F.lit(0.0)), F.lit(1.0))


def r4(c: Column) -> Column:
    """Registered queries round every float output to 4 decimals."""
    return F.round(c, 4)
