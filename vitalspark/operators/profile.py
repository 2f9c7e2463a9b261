"""Profiling and task detection (PRF-1..5).

Null counts, minima, maxima and means of all columns come from ONE aggregate
over the table; distinct counts, modes and listed values from one shared table
of distinct values (``plans.distinct``).  Only first values and medians take a
pass of their own.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import is_float, is_numeric, is_text, nan_to_null, qcol
from ..plans.aggregates import wide_to_long
from ..plans.distinct import CELL, cell_counts, class_figures, fetch_values
from ..plans.ordered import exact_quantiles
from ..session import cut_lineage

SAMPLE_VALUES = 3        # fixed: PRF-1 shows the first 3 non-null values
MAX_UNIQUE_LISTED = 50   # fixed: PRF-2 lists at most 50 distinct values
# PRF-4 fixed cut-offs
INT_REGRESSION_DISTINCT = 20
INT_CLASS_DISTINCT = 10
INT_CLASS_RATIO = 0.05
# PRF-5 fixed cut-off
MULTI_REGRESSION_DISTINCT = 10


def _with_distinct(df: DataFrame, aggs: Sequence[Column], rows: Sequence[dict], approx: bool) -> DataFrame:
    """The long report ``rows`` over one aggregate, with the distinct count of
    each column (nulls excluded) as ``_d``."""
    if approx:
        sketches = [F.approx_count_distinct(qcol(c)).alias(f"d{i}") for i, c in enumerate(df.columns)]
        return wide_to_long(df.agg(*aggs, *sketches), [{**r, "_d": F.col(f"d{i}")} for i, r in enumerate(rows)])
    report = wide_to_long(df.agg(*aggs), [{**r, "_at": F.lit(i)} for i, r in enumerate(rows)])
    found = class_figures(cell_counts(df)).select(F.col("position").alias("_at"), F.col("distinct").alias("_d"))
    return report.join(found, "_at", "left").withColumn("_d", F.coalesce("_d", F.lit(0))).drop("_at")


def first_values(df: DataFrame, cols: Sequence[str], key_cols: Sequence[str], k: int) -> DataFrame:
    """First ``k`` non-null values per column in key order, as strings:
    (column, rank, value).  Each column is a top-k of its own over the key and
    that column only (TakeOrderedAndProject: a bounded heap per task, no sort
    of the table); the window ranks at most k rows a column."""
    if not cols:
        return df.sparkSession.createDataFrame([], "column string, rank int, value string")
    keys = [f"_k{i}" for i in range(len(key_cols))]
    parts = [df.where(qcol(c).isNotNull()).select(*[qcol(x).alias(n) for x, n in zip(key_cols, keys)],
                                                  F.lit(c).alias("column"), qcol(c).cast("string").alias("value"))
             .orderBy(*keys).limit(k) for c in cols]
    w = Window.partitionBy("column").orderBy(*keys)
    return reduce(DataFrame.unionAll, parts).withColumn("rank", F.row_number().over(w)).select("column", "rank", "value")


def column_info(df: DataFrame, key_cols: Sequence[str], approx: bool = False) -> DataFrame:
    """PRF-1: per column dtype, numeric/categorical (rule A), distinct count
    (nulls excluded), null count and the first 3 non-null values."""
    df = nan_to_null(df)
    fields = df.schema.fields
    aggs = [F.count_if(qcol(f.name).isNull()).alias(f"n{i}") for i, f in enumerate(fields)]
    rows = [{"column": F.lit(f.name), "position": F.lit(i),
             "dtype": F.lit(f.dataType.simpleString()),
             "col_type": F.lit("numeric" if is_numeric(f.dataType, "A") else "categorical"),
             "null_count": F.col(f"n{i}").cast("long")}
            for i, f in enumerate(fields)]
    info = _with_distinct(df, aggs, rows, approx).select(
        "column", "position", "dtype", "col_type", F.col("_d").cast("long").alias("unique_values"), "null_count")
    samples = first_values(df, df.columns, key_cols, SAMPLE_VALUES) \
        .groupBy("column").agg(F.array_sort(F.collect_list(F.struct("rank", "value"))).alias("_s")) \
        .select("column", F.concat_ws(" | ", F.transform("_s", lambda s: s["value"])).alias("sample_values"))
    return info.join(samples, "column", "left") \
        .withColumn("sample_values", F.coalesce("sample_values", F.lit("")))


def _step(lo: Column, hi: Column) -> Column:
    """Slider step from the 3-dp rounded min and max (Python ``round``:
    half-even, hence ``bround``)."""
    rng = hi - lo
    return (F.when(rng == 0, F.lit(1.0))
            .when(rng < 1, F.bround(rng / 100, 6))
            .when(rng < 10, F.lit(0.1))
            .when(rng < 100, F.lit(1.0))
            .otherwise(F.bround(rng / 100, 0)))


def column_stats(df: DataFrame, key_cols: Sequence[str]) -> DataFrame:
    """PRF-2: numeric (rule B) min/max/mean/median rounded to 3 and a slider
    step; categorical: most common value (smallest on ties) and the first 50
    distinct values in key order.  All-null columns are left out."""
    df = nan_to_null(df)
    fields = [f for f in df.schema.fields]
    num = [f.name for f in fields if is_numeric(f.dataType, "B")]
    cat = [f.name for f in fields if f.name not in num]
    spark = df.sparkSession
    aggs = [F.count(qcol(c)).alias(f"k{i}") for i, c in enumerate(df.columns)]
    for i, c in enumerate(num):
        aggs += [F.min(qcol(c)).cast("double").alias(f"lo{i}"), F.max(qcol(c)).cast("double").alias(f"hi{i}"),
                 F.avg(qcol(c)).alias(f"av{i}")]
    wide = df.agg(*aggs)
    pos = {c: i for i, c in enumerate(df.columns)}
    out = []
    if num:
        rows = [{"column": F.lit(c), "n": F.col(f"k{pos[c]}"),
                 "min": F.round(F.col(f"lo{i}"), 3), "max": F.round(F.col(f"hi{i}"), 3),
                 "mean": F.round(F.col(f"av{i}"), 3)} for i, c in enumerate(num)]
        base = wide_to_long(wide, rows)
        long = df.select(F.explode(F.array(*[
            F.struct(F.lit(c).alias("column"), qcol(c).cast("double").alias("value")) for c in num
        ])).alias("_u")).select("_u.*")
        med = exact_quantiles(long, ["column"], "value", [0.5]).select(
            "column", F.round("q", 3).alias("median"))
        numeric = base.join(med, "column", "left").where(F.col("n") > 0).select(
            "column", F.lit("numeric").alias("type"), "min", "max", "mean", "median",
            _step(F.col("min"), F.col("max")).alias("step"),
            F.lit(None).cast("string").alias("most_common"), F.lit(None).cast("string").alias("unique_values"))
        out.append(numeric)
    if cat:
        cells = cell_counts(df, cat, key_cols, store=True)
        per = class_figures(cells).select("position", "top")  # a row per column
        w = Window.partitionBy("position").orderBy("first_key")
        listed = cells.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= MAX_UNIQUE_LISTED) \
            .select(*CELL, "first_key", "_r")
        # Where no value repeats, all tie and the smallest of the column is it.
        tied = cells.join(F.broadcast(per.where(F.col("top") > 1)), "position").where(F.col("cnt") == F.col("top")) \
            .select(*CELL, "first_key", F.lit(None).cast("int").alias("_r"))
        shown = fetch_values(df, cat, cut_lineage(listed.unionByName(tied)), key_cols).groupBy("position").agg(
            F.min(F.when(F.col("_r").isNull(), F.col("value"))).alias("_tied"),
            F.array_sort(F.collect_list(F.when(F.col("_r").isNotNull(), F.struct("_r", "value")))).alias("_l"))
        smallest = wide_to_long(df.agg(*[F.min(qcol(c).cast("string")).alias(f"m{i}") for i, c in enumerate(cat)]),
                                [{"position": F.lit(i), "column": F.lit(c), "_least": F.col(f"m{i}")}
                                 for i, c in enumerate(cat)])
        shown = smallest.join(shown, "position")
        categorical = shown.select(
            "column", F.lit("categorical").alias("type"),
            *[F.lit(None).cast("double").alias(n) for n in ("min", "max", "mean", "median", "step")],
            F.coalesce("_tied", "_least").alias("most_common"),
            F.concat_ws(" | ", F.transform("_l", lambda s: s["value"])).alias("unique_values"))
        out.append(categorical)
    if not out:
        return spark.createDataFrame([], "column string, type string, min double, max double, mean double, "
                                         "median double, step double, most_common string, unique_values string")
    res = out[0]
    for o in out[1:]:
        res = res.unionByName(o)
    return res


def dataset_summary(df: DataFrame) -> DataFrame:
    """PRF-3: rows, columns, and per column its type and null count, from one
    aggregate (null count includes NaN)."""
    df = nan_to_null(df)
    fields = df.schema.fields
    wide = df.agg(F.count(F.lit(1)).alias("_rows"),
                  *[F.count_if(qcol(f.name).isNull()).alias(f"n{i}") for i, f in enumerate(fields)])
    rows = [{"n_rows": F.col("_rows"), "n_cols": F.lit(len(fields)).cast("long"),
             "column": F.lit(f.name), "position": F.lit(i), "dtype": F.lit(f.dataType.simpleString()),
             "null_count": F.col(f"n{i}").cast("long")} for i, f in enumerate(fields)]
    return wide_to_long(wide, rows)


def detect_tasks(df: DataFrame, approx: bool = False) -> DataFrame:
    """PRF-4 (auto task rule) and PRF-5 (multi-target rule) for every column."""
    df = nan_to_null(df)
    fields = df.schema.fields
    aggs = [F.count(F.lit(1)).alias("_rows")]
    report = _with_distinct(df, aggs, [{"column": F.lit(f.name), "_place": F.lit(i), "_rows": F.col("_rows")}
                                       for i, f in enumerate(fields)], approx)
    d, auto_of, multi_of = F.col("_d"), [], []
    for f in fields:
        if is_float(f.dataType):
            auto = F.lit("regression")
        elif is_text(f.dataType) or isinstance(f.dataType, T.DecimalType):
            auto = F.lit("classification")
        else:
            ratio = d / F.col("_rows")
            auto = (F.when(d > INT_REGRESSION_DISTINCT, "regression")
                    .when((ratio < INT_CLASS_RATIO) | (d <= INT_CLASS_DISTINCT), "classification")
                    .otherwise("regression"))
        if is_numeric(f.dataType, "C"):
            multi = F.when(d > MULTI_REGRESSION_DISTINCT, "regression").otherwise("classification")
        else:
            multi = F.lit("classification")
        auto_of.append(auto)
        multi_of.append(multi)
    if not fields:
        return df.sparkSession.createDataFrame([], "column string, distinct long, task_auto string, task_multi string")
    place = F.col("_place") + 1
    return report.select("column", d.cast("long").alias("distinct"),
                         F.element_at(F.array(*auto_of), place).alias("task_auto"),
                         F.element_at(F.array(*multi_of), place).alias("task_multi"))
