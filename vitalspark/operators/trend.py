"""Trend and forecast (TRD-1..6).

The reference regresses each column on the row position.  Here the position
comes from ``order_by`` (and restarts per ``group_by`` entity), computed with
``ordered_prefix`` so even a group holding a third of all rows is spread
over many tasks.  The centred moving average uses running sums: the mean of
a frame is a difference of two prefix sums.  Each row sends its running sum to
the two positions whose frames it bounds, and one aggregate by (group,
position) brings them together: no self-join, no hot key, and the frame width
(n // 10, huge at scale) costs nothing.  The windows of a group's edge rows are
computed once a group.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import complete_rows, qcol, require_numeric
from ..plans.aggregates import broadcast_if_small, one_row
from ..plans.ordered import ordered_prefix
from ..session import cut_lineage

MIN_WINDOW = 3           # fixed: moving-average window is max(3, n // 10)
WINDOW_DIVISOR = 10
FORECAST_STEPS = 10
COEF_ROWS = 100_000      # lines broadcast at once: about ten numbers and a group key each
FIRST_ABS_FLOOR = 0.001  # change % is 0 when |first| <= 0.001
# Running sums are exact decimals: a frame sum is the difference of two
# running sums, which in doubles would lose digits as the sums grow.  22 whole
# digits hold 10^15 rows of up to PLAIN[1]; a column whose largest magnitude
# lies outside PLAIN is summed in units of its own power of ten.
PREFIX_TYPE = "decimal(38,16)"
PLAIN = (1e-2, 1e7)


@dataclass
class TrendInput:
    long: DataFrame        # group..., column, unit, idx, value, cum (in units)
    group_cols: list[str]
    key_cols: list[str]


def _unit(largest: float | None) -> float:
    """1 for ordinary magnitudes, else the power of ten above the largest."""
    if not largest or not math.isfinite(largest) or PLAIN[0] <= largest <= PLAIN[1]:
        return 1.0
    return 10.0 ** math.ceil(math.log10(largest))


def trend_input(df: DataFrame, value_cols: Sequence[str], order_cols: Sequence[str],
                group_cols: Sequence[str] = (), max_columns: int | None = None) -> TrendInput:
    """Complete rows over the numeric value columns, one long row per
    (entity, column, position) with the running sum of the values.  All
    columns take part (the reference showed the first 6: ``max_columns=6``)."""
    cols = require_numeric(df, value_cols, "A")[:max_columns]
    group_cols = list(group_cols)
    work = complete_rows(df, cols)
    largest = one_row(work, [F.max(F.abs(qcol(c).cast("double"))).alias(c) for c in cols])
    long = work.select(*[qcol(g) for g in group_cols], *[qcol(o) for o in order_cols], F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.lit(_unit(largest.get(c))).alias("unit"),
                 qcol(c).cast("double").alias("value")) for c in cols
    ])).alias("_u")).select(*group_cols, *order_cols, "_u.column", "_u.unit", "_u.value")
    ranked = ordered_prefix(long, list(order_cols), [*group_cols, "column"],
                            sums=[("cum", (F.col("value") / F.col("unit")).cast(PREFIX_TYPE))], index_name="idx")
    # Positions and running sums feed the fit and two lookups: materialise once.
    return TrendInput(cut_lineage(ranked), group_cols, list(order_cols))


def linear_trend(ti: TrendInput) -> DataFrame:
    """TRD-1 + TRD-5: OLS of value on position per (entity, column): slope,
    intercept, r², direction, first/last value and change %."""
    g = [*ti.group_cols, "column"]
    x, y = F.col("idx").cast("double"), F.col("value")
    fit = ti.long.groupBy(*g).agg(
        F.count(F.lit(1)).alias("n"), F.regr_slope(y, x).alias("slope"),
        F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2"),
        F.min_by("value", "idx").alias("first"), F.max_by("value", "idx").alias("last"))
    slope = F.coalesce(F.col("slope"), F.lit(0.0))
    direction = F.when(slope > 0, "increasing").when(slope < 0, "decreasing").otherwise("stable")
    change = F.when(F.abs(F.col("first")) > FIRST_ABS_FLOOR,
                    F.round((F.col("last") - F.col("first")) / F.abs(F.col("first")) * 100, 2)).otherwise(F.lit(0.0))
    return fit.select(*g, "n", "slope", "intercept", "r2", direction.alias("direction"), "first", "last",
                      change.alias("change_pct"))


def trend_lines(ti: TrendInput, fit: DataFrame) -> DataFrame:
    """TRD-2 + TRD-3 per row: fitted value and the centred moving average of
    width w = max(3, n // 10) over [i-(w-1-o), i+o], o = (w-1)//2; edge rows
    take the first / last full window (pandas bfill + ffill).  ``moving_sum``
    is the exact frame sum in multiples of ``unit`` (1 for ordinary columns)."""
    g = [*ti.group_cols, "column"]
    w = F.greatest(F.lit(MIN_WINDOW), F.floor(F.col("n") / WINDOW_DIVISOR)).cast("long")
    ahead = F.floor((F.col("_w") - 1) / 2).cast("long")
    coef = cut_lineage(fit.select(*g, "n", "slope", "intercept", w.alias("_w")).withColumn("_o", ahead)
                       .withColumn("_back", F.col("_w") - 1 - F.col("_o")))
    i, n = F.col("idx"), F.col("n")
    framed = ti.long.join(broadcast_if_small(coef, COEF_ROWS), g)
    # The first and last full window of a group: three running sums of it.
    edges = cut_lineage(framed.groupBy(*g).agg(
        F.max(F.when(i == F.col("_w") - 1, F.col("cum"))).alias("_head"),
        F.max(F.when(i == n - 1, F.col("cum"))).alias("_all"),
        F.max(F.when(i == n - 1 - F.col("_w"), F.col("cum"))).alias("_before")))
    framed = framed.join(broadcast_if_small(edges, COEF_ROWS), g)
    # Every row's running sum goes to the two rows whose frames it bounds.
    own = [*ti.key_cols, "value", "unit", "n", "slope", "intercept", "_w", "_o", "_back", "_head", "_all", "_before"]
    names = [f"_m{j}" for j in range(len(own))]
    kinds = dict(framed.dtypes)

    def message(at: Column, kind: str) -> Column:
        payload = [F.when(F.lit(kind == "own"), F.col(c)).cast(kinds[c]).alias(m) for c, m in zip(own, names)]
        sums = [F.when(F.lit(kind == k), F.col("cum")).cast(PREFIX_TYPE).alias(f"_{k}") for k in ("hi", "lo")]
        inside = (F.lit(True) if kind == "own" else
                  (n >= F.col("_w")) & (at >= F.col("_back")) & (at <= n - 1 - F.col("_o")))
        return F.when(inside, F.struct(at.alias("idx"), *payload, *sums))
    sent = framed.select(*g, F.explode(F.array(message(i, "own"), message(i - F.col("_o"), "hi"),
                                               message(i + F.col("_back") + 1, "lo"))).alias("_u")) \
        .where("_u is not null").select(*g, "_u.*")
    rows = sent.groupBy(*g, "idx").agg(*[F.max(m).alias(c) for c, m in zip(own, names)],
                                       F.max("_hi").alias("_hi"), F.max("_lo").alias("_lo"))
    upper = F.when(i < F.col("_back"), F.col("_head")).when(i > n - 1 - F.col("_o"), F.col("_all")).otherwise(F.col("_hi"))
    lower = F.when(i < F.col("_back"), F.lit(None)).when(i > n - 1 - F.col("_o"), F.col("_before")).otherwise(F.col("_lo"))
    frame_sum = F.when(n >= F.col("_w"), upper - F.coalesce(lower, F.lit(0)))
    ma = frame_sum.cast("double") / F.col("_w") * F.col("unit")
    fitted = F.col("slope") * i + F.col("intercept")
    return rows.select(*ti.group_cols, *ti.key_cols, "column", "idx", "value",
                       fitted.alias("fitted"), ma.alias("moving_avg"), frame_sum.alias("moving_sum"), "unit",
                       F.col("_w").alias("window"))


def forecast(fit: DataFrame, group_cols: Sequence[str], steps: int = FORECAST_STEPS) -> DataFrame:
    """TRD-4: extend each line ``steps`` positions past the last row."""
    g = [*group_cols, "column"]
    x = F.explode(F.sequence(F.col("n"), F.col("n") + steps - 1)).alias("x")
    return fit.select(*g, "slope", "intercept", x) \
        .select(*g, "x", (F.col("slope") * F.col("x") + F.col("intercept")).alias("forecast"))


def correlation_matrix(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """TRD-6: Pearson correlation of every pair of columns, one aggregate."""
    cols = require_numeric(df, cols, "A")
    work = complete_rows(df, cols)
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i + 1:]]
    wide = work.agg(*[F.corr(qcol(a), qcol(b)).alias(f"c{i}") for i, (a, b) in enumerate(pairs)])
    structs = [F.struct(F.lit(a).alias("column_a"), F.lit(b).alias("column_b"), F.col(f"c{i}").alias("corr"))
               for i, (a, b) in enumerate(pairs)]
    return wide.select(F.explode(F.array(*structs)).alias("_r")).select("_r.*")
