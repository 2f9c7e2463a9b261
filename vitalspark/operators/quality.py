"""Data-quality check (DQ-1..8).

One aggregate computes, for all columns at once, null counts and the
numeric-looking share of text columns; distinct counts, class shares, quartiles
and outliers are read from one shared table of distinct values
(``plans.distinct``); duplicates take one more pass.  The reports are small
long-form DataFrames; the score is summed from them.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import is_numeric, is_text, nan_to_null, qcol
from ..plans.aggregates import wide_to_long
from ..plans.distinct import CELL, cell_counts, class_figures, fetch_values
from ..plans.ordered import exact_quantiles_counted

# Fixed values of the reference's quality check.
MISSING_CRITICAL_PCT = 30      # -10 each
MISSING_WARNING_PCT = 5        # -3 each
DUPLICATE_PENALTY = 5
IQR_FACTOR = 3
# Repeated row hashes are marked in so many bits (2 ** 25: at most 2 ** 19 words go round).
REPEATED_BITS = 25
OUTLIER_WARNING_PCT = 5        # -3 each
IMBALANCE_RATIO = 10
IMBALANCE_PENALTY = 5          # each
CONSTANT_PENALTY = 5
BINARY_MIN_ROWS = 100
HIGH_CARDINALITY_CAP = 50
MIXED_LOW, MIXED_HIGH = 0.1, 0.9
GRADES = ((90, "A"), (75, "B"), (60, "C"))
RECOMMENDATIONS = ((90, "Dataset is research-grade quality."),
                   (75, "Minor cleaning recommended before analysis."),
                   (60, "Significant data cleaning required."),
                   (None, "Major data quality issues — review before any analysis."))

# A text value "looks numeric" when, after removing its first '.', it is
# optional leading '-' signs followed by digits.
NUMERIC_TEXT = r"^(-*\.?-*[0-9]+|-*[0-9]+\.[0-9]*)$"


def _pct(n: Column, d: Column) -> Column:
    return F.round(n / d * 100, 1)


@dataclass
class QualityReport:
    missing: DataFrame
    duplicates: DataFrame
    outliers: DataFrame
    imbalance: DataFrame
    columns: DataFrame       # constant / binary / high-cardinality / mixed flags per column
    score: DataFrame


def column_pass(df: DataFrame, with_distinct: bool = True, approx_distinct: bool = False,
                cells: DataFrame | None = None) -> DataFrame:
    """DQ-1, 5, 6, 7: one row per column.  Null counts and the numeric-looking
    share come from one aggregate; exact distinct counts, only when asked for,
    from the distinct table of all columns (``cells``, made here when not
    given).  ``approx_distinct`` swaps them for HyperLogLog sketches (a few KB
    per column, no shuffle of cells) on very wide tables."""
    df = nan_to_null(df)
    fields = df.schema.fields
    sketched = with_distinct and approx_distinct
    aggs = [F.count(F.lit(1)).alias("_rows")]
    for i, f in enumerate(fields):
        c = qcol(f.name)
        aggs += [F.count_if(c.isNull()).alias(f"n{i}"),
                 (F.approx_count_distinct(c) if sketched else F.lit(None).cast("long")).alias(f"d{i}")]
        if with_distinct and is_text(f.dataType):
            aggs += [F.count(c).alias(f"v{i}"), F.count_if(c.rlike(NUMERIC_TEXT)).alias(f"x{i}")]
    wide = df.agg(*aggs)
    rows = []
    for i, f in enumerate(fields):
        text = is_text(f.dataType)
        rows.append({
            "column": F.lit(f.name), "position": F.lit(i), "is_text": F.lit(text),
            "rows": F.col("_rows"), "missing": F.col(f"n{i}").cast("long"),
            "distinct": F.col(f"d{i}").cast("long"),
            "non_null": (F.col(f"v{i}") if text and with_distinct else F.lit(None)).cast("long"),
            "numeric_like": (F.col(f"x{i}") if text and with_distinct else F.lit(None)).cast("long"),
        })
    out = wide_to_long(wide, rows)
    if not with_distinct or sketched:
        return out
    found = class_figures(cell_counts(df) if cells is None else cells).select("position", F.col("distinct").alias("_d"))
    return out.join(found, "position", "left").withColumn("distinct", F.coalesce("_d", F.lit(0))) \
        .select(*out.columns)


def missing_report(cols: DataFrame) -> DataFrame:
    """DQ-1: columns with missing values, % rounded to 1, level."""
    pct = F.when(F.col("rows") > 0, _pct(F.col("missing"), F.col("rows"))).otherwise(F.lit(0.0))
    out = cols.select("column", "position", "missing", pct.alias("percent"))
    level = (F.when(F.col("percent") > MISSING_CRITICAL_PCT, "critical")
             .when(F.col("percent") > MISSING_WARNING_PCT, "warning").otherwise("info"))
    penalty = (F.when(F.col("percent") > MISSING_CRITICAL_PCT, 10)
               .when(F.col("percent") > MISSING_WARNING_PCT, 3).otherwise(0))
    return out.where(F.col("percent") > 0).withColumn("level", level).withColumn("penalty", penalty)


def duplicate_report(df: DataFrame) -> DataFrame:
    """DQ-2: rows minus distinct rows (nulls equal), exact.

    Rows are first counted by a row hash (three independent hashes), so the
    shuffle carries a few bytes per distinct hash instead of whole rows.  The
    hashes that occur more than once are marked in a bitmap of fixed size that
    goes round; only rows with a mark are grouped by their full content, which
    turns hash equality into row equality (a row marked by chance is alone in
    its group and adds nothing).  A hot duplicate collapses map-side in both
    steps."""
    cols = [qcol(c) for c in df.columns]
    # Row digest: three hashes (two seeds of xxhash64, one murmur3) of the
    # same columns; nulls hash consistently, so nulls compare equal.
    hashed = df.withColumn("_h", F.struct(F.xxhash64(*cols).alias("a"), F.hash(*cols).alias("b"),
                                          F.xxhash64(F.lit(7), *cols).alias("c")))
    by_hash = hashed.groupBy("_h").agg(F.count(F.lit(1)).alias("_c"))
    totals = by_hash.agg(F.coalesce(F.sum("_c"), F.lit(0)).alias("rows"))
    slot = F.col("_h.a").bitwiseAND(F.lit((1 << REPEATED_BITS) - 1))
    bit = F.expr("shiftleft(1L, cast(_h.a & 63 as int))")
    marks = by_hash.where(F.col("_c") > 1).groupBy(F.shiftright(slot, 6).alias("_h_word")) \
        .agg(F.bit_or(bit).alias("_h_bits"))
    cand = hashed.join(F.broadcast(marks), F.shiftright(slot, 6) == F.col("_h_word")) \
        .where(F.col("_h_bits").bitwiseAND(bit) != 0)
    exact = cand.groupBy(*cols).agg(F.count(F.lit(1)).alias("_c")) \
        .agg(F.coalesce(F.sum(F.col("_c") - 1), F.lit(0)).alias("duplicates"))
    # Two one-row results meet through a union + sum, not a join.
    both = totals.select("rows", F.lit(0).cast("long").alias("duplicates")) \
        .unionByName(exact.select(F.lit(0).cast("long").alias("rows"), F.col("duplicates").cast("long"))) \
        .agg(F.sum("rows").alias("rows"), F.sum("duplicates").alias("duplicates"))
    return both.select(F.col("duplicates").cast("long").alias("duplicates"),
                       F.when(F.col("rows") > 0, _pct(F.col("duplicates"), F.col("rows")))
                       .otherwise(F.lit(0.0)).alias("percent"),
                       F.when(F.col("duplicates") > 0, DUPLICATE_PENALTY).otherwise(0).alias("penalty"))


def outlier_report(df: DataFrame, cells: DataFrame | None = None) -> DataFrame:
    """DQ-3: 3xIQR outliers of every numeric column (exact linear quartiles,
    computed distributed); iqr = 0 columns skipped; penalty when > 5 %.
    ``cells``: the stored distinct table of all columns of ``df`` with their
    numbers; every figure is read from it, not from the rows.
    ``report_rank`` <= 10 is the reference's displayed cut (first 10 columns)."""
    df = nan_to_null(df)
    num = [f.name for f in df.schema.fields if is_numeric(f.dataType, "D")]
    spark = df.sparkSession
    schema = ("column string, position int, outliers long, percent double, min double, max double, "
              "q1 double, q3 double, penalty int, report_rank int")
    if not num:
        return spark.createDataFrame([], schema)
    at = [df.columns.index(c) for c in num]
    if cells is None:
        cells, at = cell_counts(df, num, store=True, numbers=True), list(range(len(num)))
    values = cells.where(F.col("position").isin(at)).select("position", F.col("number").alias("value"), "cnt")
    q = exact_quantiles_counted(values, ["position"], "value", "cnt", [0.25, 0.75]) \
        .groupBy("position").agg(F.max(F.when(F.col("p") == 0.25, F.col("q"))).alias("q1"),
                                 F.max(F.when(F.col("p") == 0.75, F.col("q"))).alias("q3")) \
        .where(F.col("q3") - F.col("q1") != 0)
    iqr = F.col("q3") - F.col("q1")
    is_out = (F.col("value") < F.col("q1") - IQR_FACTOR * iqr) | (F.col("value") > F.col("q3") + IQR_FACTOR * iqr)
    counted = values.join(F.broadcast(q), "position").groupBy("position", "q1", "q3").agg(  # q: a row per column
        F.sum(F.when(is_out, F.col("cnt")).otherwise(0)).alias("outliers"), F.sum("cnt").alias("_n"),
        F.round(F.min("value"), 2).alias("min"), F.round(F.max("value"), 2).alias("max"))
    place = F.array_position(F.array(*map(F.lit, at)), F.col("position")).cast("int")
    rep = counted.where(F.col("outliers") > 0).withColumn("percent", _pct(F.col("outliers"), F.col("_n"))) \
        .withColumn("column", F.element_at(F.array(*map(F.lit, num)), place)).withColumn("position", place - 1)
    rank = F.row_number().over(Window.orderBy("position"))  # at most one row per column
    return rep.select("column", "position", F.col("outliers").cast("long").alias("outliers"), "percent",
                      "min", "max", "q1", "q3",
                      F.when(F.col("percent") > OUTLIER_WARNING_PCT, 3).otherwise(0).alias("penalty"),
                      rank.alias("report_rank"))


def imbalance_report(df: DataFrame, cells: DataFrame | None = None) -> DataFrame:
    """DQ-4: text columns with >= 2 classes whose largest/smallest class
    ratio (rounded to 1) exceeds 10.  ``cells``: the distinct table of all
    columns of ``df``.  Only the text of the largest classes is read again (the
    smallest of tied ones is named)."""
    df = nan_to_null(df)
    txt = [i for i, f in enumerate(df.schema.fields) if is_text(f.dataType)]
    if not txt:
        return df.sparkSession.createDataFrame([], "column string, dominant_class string, dominant_pct double, "
                                                   "ratio double, penalty int")
    if cells is None:
        names = [df.columns[i] for i in txt]
        cells, df, txt = cell_counts(df, names, store=True), df.select(*map(qcol, names)), range(len(names))
    per = imbalance_penalties(cells, txt)
    tied = cells.join(F.broadcast(per), "position").where(F.col("cnt") == F.col("top"))  # a row per column
    per = fetch_values(df, df.columns, tied.select(*CELL, "total", "top", "ratio"), only=list(txt)) \
        .groupBy("position", "total", "top", "ratio").agg(F.min("value").alias("dominant_class"))
    name = F.element_at(F.array(*[F.lit(c) for c in df.columns]), F.col("position") + 1)
    return per.select(name.alias("column"), "dominant_class", _pct(F.col("top"), F.col("total")).alias("dominant_pct"),
                      "ratio", F.lit(IMBALANCE_PENALTY).alias("penalty"))


def imbalance_penalties(cells: DataFrame, text_positions: Sequence[int]) -> DataFrame:
    """Figures and penalty of the imbalanced text columns, without the names
    of their classes: no value is read."""
    ratio = F.round(F.col("top") / F.col("bottom"), 1)
    return class_figures(cells.where(F.col("position").isin(*text_positions))) \
        .where(F.col("distinct") >= 2).withColumn("ratio", ratio).where(F.col("ratio") > IMBALANCE_RATIO) \
        .withColumn("penalty", F.lit(IMBALANCE_PENALTY))


def mixed_type_sample(df: DataFrame, key_cols: Sequence[str], sample: int = 100) -> DataFrame:
    """DQ-7 as the reference computes it: the first ``sample`` non-null values
    of each text column (in key order), numeric-looking share between 10 and
    90 %.  Returns (column, non_null, numeric_like, mixed_type)."""
    from .profile import first_values
    txt = [f.name for f in df.schema.fields if is_text(f.dataType)]
    vals = first_values(df, txt, key_cols, sample)
    agg = vals.groupBy("column").agg(F.count(F.lit(1)).alias("non_null"),
                                     F.count_if(F.col("value").rlike(NUMERIC_TEXT)).alias("numeric_like"))
    share = F.col("numeric_like") / F.col("non_null")
    return agg.withColumn("mixed_type", (F.col("numeric_like") > 0) & (share < MIXED_HIGH) & (share > MIXED_LOW))


def column_flags(cols: DataFrame) -> DataFrame:
    """DQ-5 constant (-5) / binary note, DQ-6 high cardinality, DQ-7 mixed
    numeric/text values, one row per column."""
    d, rows = F.col("distinct"), F.col("rows")
    share = F.col("numeric_like") / F.col("non_null")
    high_card = F.col("is_text") & (d > F.least(F.lit(float(HIGH_CARDINALITY_CAP)), rows * 0.5))
    mixed = F.col("is_text") & (F.col("numeric_like") > 0) & (share < MIXED_HIGH) & (share > MIXED_LOW)
    return cols.select("column", "position", "distinct",
                       (d <= 1).alias("is_constant"),
                       ((d == 2) & (rows > BINARY_MIN_ROWS)).alias("is_binary"),
                       F.coalesce(high_card, F.lit(False)).alias("high_cardinality"),
                       F.coalesce(mixed, F.lit(False)).alias("mixed_type"),
                       F.when(d <= 1, CONSTANT_PENALTY).otherwise(0).alias("penalty"))


def quality_score(missing: DataFrame, duplicates: DataFrame, outliers: DataFrame,
                  imbalance: DataFrame, flags: DataFrame, n_rows: DataFrame) -> DataFrame:
    """DQ-8: 100 minus all penalties, clamped to 0..100, grade and advice."""
    pens = (missing.select("penalty").unionByName(duplicates.select("penalty"))
            .unionByName(outliers.select("penalty")).unionByName(imbalance.select("penalty"))
            .unionByName(flags.select("penalty")))
    total = pens.agg(F.coalesce(F.sum("penalty"), F.lit(0)).alias("_p"))
    score = F.greatest(F.lit(0), F.least(F.lit(100), F.lit(100) - F.col("_p"))).cast("long")
    grade = None
    for cut, letter in GRADES:
        grade = F.when(score >= cut, letter) if grade is None else grade.when(score >= cut, letter)
    grade = grade.otherwise("D")
    advice = F.when(score >= 90, RECOMMENDATIONS[0][1]).when(score >= 75, RECOMMENDATIONS[1][1]) \
        .when(score >= 60, RECOMMENDATIONS[2][1]).otherwise(RECOMMENDATIONS[3][1])
    return total.select(score.alias("overall_score"), grade.alias("grade"), advice.alias("recommendation"))


def run_quality_check(df: DataFrame, approx_distinct: bool = False) -> QualityReport:
    """All reports.  One distinct table, written once, gives distinct counts,
    class shares and outliers; with ``approx_distinct`` there is one of the text
    and one of the numeric columns."""
    df = nan_to_null(df)
    txt = [i for i, f in enumerate(df.schema.fields) if is_text(f.dataType)]
    if approx_distinct:
        cols = column_pass(df, approx_distinct=True)
        imb = imbalance_report(df)
        imb_penalties, cells = imb, None
    else:
        cells = cell_counts(df, store=True, numbers=True)
        cols = column_pass(df, cells=cells)
        imb = imbalance_report(df, cells)
        imb_penalties = imbalance_penalties(cells, txt) if txt else imb
    missing = missing_report(cols)
    dup = duplicate_report(df)
    out = outlier_report(df, cells)
    flags = column_flags(cols)
    return QualityReport(missing, dup, out, imb, flags,
                         quality_score(missing, dup, out, imb_penalties, flags, cols))
