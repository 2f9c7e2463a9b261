"""Risk engine: auto thresholds, threshold alerts, change alerts, row risk
scores and their distribution (RSK-1, 2, 4, 5, 6).  RSK-3 (isolation forest)
lives in ``vitalspark.ml.isoforest``.

Plan shape: one global aggregate (mean/std per column, partial aggregation on
the map side) -> a handful of numbers on the driver -> every later step is a
map-only projection over literal thresholds, or another single aggregate.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import complete_rows, qcol, require_numeric, std_or_one
from ..plans.aggregates import one_row

# Fixed values of the reference's risk engine.
HIGH_SIGMAS = 2          # high = mean + 2 std, low = mean - 2 std
CRITICAL_SIGMAS = 3      # critical_high = mean + 3 std
Z_CAP = 3                # each |z| counts at most 3
HIGH_RISK_SCORE = 60     # score > 60 is high risk
RECENT_ROWS = 10         # ... comparing the last 10 rows
CHANGE_ALERT_PCT = 20    # ... with the overall mean; > 20 % is an alert
TOP_K = 10


@dataclass(frozen=True)
class Threshold:
    column: str
    mean: float
    std: float
    high: float
    critical_high: float
    low: float


def prepare(df: DataFrame, feature_cols: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """PRJ-2: numeric (rule A) feature columns, rows complete over them."""
    cols = require_numeric(df, feature_cols, "A")
    return complete_rows(df, cols), cols


def threshold_table(work: DataFrame, cols: Sequence[str]) -> DataFrame:
    """RSK-1 as a lazy DataFrame: one row per column.  Each figure is rounded
    to 3 decimals after being computed from the unrounded mean and std."""
    aggs = []
    for i, c in enumerate(cols):
        aggs += [F.avg(qcol(c)).alias(f"m{i}"), std_or_one(F.stddev_samp(qcol(c))).alias(f"s{i}")]
    summary = work.agg(*aggs)
    rows = []
    for i, c in enumerate(cols):
        m, s = F.col(f"m{i}"), F.col(f"s{i}")
        rows.append(F.struct(
            F.lit(c).alias("column"), F.round(m, 3).alias("mean"), F.round(s, 3).alias("std"),
            F.round(m + HIGH_SIGMAS * s, 3).alias("high"),
            F.round(m + CRITICAL_SIGMAS * s, 3).alias("critical_high"),
            F.round(m - HIGH_SIGMAS * s, 3).alias("low")))
    return summary.select(F.explode(F.array(*rows)).alias("t")).select("t.*")


def thresholds(work: DataFrame, cols: Sequence[str]) -> list[Threshold]:
    """RSK-1 collected: a few numbers per column drive the later passes."""
    return [Threshold(r["column"], r["mean"], r["std"], r["high"], r["critical_high"], r["low"])
            for r in threshold_table(work, cols).collect()]


def threshold_alerts(work: DataFrame, th: Sequence[Threshold]) -> DataFrame:
    """RSK-2: strict comparisons with the rounded thresholds, all columns in
    one aggregate.  CRITICAL if any value is above critical, else WARNING if
    any is above high; LOW independently."""
    aggs = [F.count(F.lit(1)).alias("_n")]
    for i, t in enumerate(th):
        c = qcol(t.column)
        aggs += [F.count_if(c > F.lit(t.critical_high)).alias(f"c{i}"),
                 F.count_if(c > F.lit(t.high)).alias(f"h{i}"),
                 F.count_if(c < F.lit(t.low)).alias(f"l{i}")]
    summary = work.agg(*aggs)
    rows = []
    for i, t in enumerate(th):
        crit, high, low = F.col(f"c{i}"), F.col(f"h{i}"), F.col(f"l{i}")
        upper_level = F.when(crit > 0, F.lit("CRITICAL")).when(high > 0, F.lit("WARNING"))
        upper_count = F.when(crit > 0, crit).otherwise(high)
        rows.append(F.struct(F.lit(t.column).alias("column"), upper_level.alias("level"),
                             upper_count.alias("count")))
        rows.append(F.struct(F.lit(t.column).alias("column"),
                             F.when(low > 0, F.lit("LOW")).alias("level"), low.alias("count")))
    out = summary.select("_n", F.explode(F.array(*rows)).alias("a")).where(F.col("a.level").isNotNull())
    return out.select("a.column", "a.level", "a.count",
                      (F.col("a.count") / F.col("_n") * 100).alias("percent"))


def risk_score_expr(th: Sequence[Threshold]) -> Column:
    """RSK-5: sum of min(|z|, 3) with rounded mean/std, normalised to 0-100,
    rounded to 1 decimal (the rounded score feeds the > 60 decision)."""
    total = F.lit(0.0)
    for t in th:
        std = t.std if t.std else 1.0
        z = F.abs((qcol(t.column) - F.lit(t.mean)) / F.lit(std))
        total = total + F.least(z, F.lit(float(Z_CAP)))
    n = max(len(th), 1)
    return F.least(F.round(total / F.lit(float(n)) / F.lit(float(Z_CAP)) * 100, 1), F.lit(100.0))


def risk_scores(work: DataFrame, th: Sequence[Threshold], key_cols: Sequence[str]) -> DataFrame:
    """Map-only: key columns + ``risk_score`` for every complete row."""
    return work.select(*[qcol(k) for k in key_cols], risk_score_expr(th).alias("risk_score"))


def risk_distribution(scores: DataFrame) -> DataFrame:
    """RSK-6: number and share of rows with score > 60."""
    return scores.agg(F.count_if(F.col("risk_score") > HIGH_RISK_SCORE).alias("high_risk_count"),
                      F.count(F.lit(1)).alias("total")) \
        .withColumn("high_risk_percent",
                    F.col("high_risk_count") / F.greatest(F.col("total"), F.lit(1)) * 100)


def top_risk(scores: DataFrame, key_cols: Sequence[str], k: int = TOP_K) -> DataFrame:
    """SRT-1 on the scores: a top-k (TakeOrderedAndProject), key breaks ties."""
    return scores.orderBy(F.col("risk_score").desc(), *[qcol(c).asc() for c in key_cols]).limit(k)


def change_alerts_by(work: DataFrame, cols: Sequence[str], order_cols: Sequence[str], group_cols: Sequence[str],
                     recent_rows: int = RECENT_ROWS, n_columns: int | None = None) -> DataFrame:
    """RSK-4 per entity: each entity's last ``recent_rows`` rows against its
    own mean.  The per-entity top-k is a WindowGroupLimit (k rows per entity
    kept in each map task before the shuffle), the means one aggregate."""
    from pyspark.sql import Window
    cols = list(cols)[:n_columns]
    g = list(group_cols)
    w = Window.partitionBy(*[qcol(c) for c in g]).orderBy(*[qcol(c).desc() for c in order_cols])
    recent = work.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= recent_rows) \
        .groupBy(*g).agg(*[F.avg(qcol(c)).alias(f"r{i}") for i, c in enumerate(cols)])
    overall = work.groupBy(*g).agg(F.count(F.lit(1)).alias("_n"),
                                   *[F.avg(qcol(c)).alias(f"o{i}") for i, c in enumerate(cols)])
    j = overall.where(F.col("_n") > recent_rows).join(recent, g)
    rows = []
    for i, c in enumerate(cols):
        r, o = F.col(f"r{i}"), F.col(f"o{i}")
        pct = F.abs((r - o) / o * 100)
        rows.append(F.when(o != 0, F.struct(F.lit(c).alias("column"), r.alias("recent_avg"), o.alias("overall_avg"),
                                            pct.alias("change_percent"),
                                            F.when(r > o, "increasing").otherwise("decreasing").alias("direction"),
                                            (pct > CHANGE_ALERT_PCT).alias("is_alert"))))
    return j.select(*g, F.explode(F.filter(F.array(*rows), lambda x: x.isNotNull())).alias("x")).select(*g, "x.*")


def change_alerts(work: DataFrame, cols: Sequence[str], order_cols: Sequence[str],
                  recent_rows: int = RECENT_ROWS, n_columns: int | None = None) -> DataFrame:
    """RSK-4: mean of the last ``recent_rows`` rows (by ``order_cols``) against
    the overall mean, for all columns (the reference showed the first 4:
    ``n_columns=4``).  Every column is
    reported, with ``is_alert`` for a change above 20 %; nothing is reported
    for tables of 10 rows or fewer, or a zero overall mean."""
    cols = list(cols)[:n_columns]
    overall = one_row(work, [F.count(F.lit(1)).alias("_n")] +
                      [F.avg(qcol(c)).alias(f"o{i}") for i, c in enumerate(cols)])
    n = overall.get("_n") or 0
    spark = work.sparkSession
    schema = ("column string, recent_avg double, overall_avg double, change_percent double, "
              "direction string, is_alert boolean")
    if n <= recent_rows:
        return spark.createDataFrame([], schema)
    recent = work.orderBy(*[qcol(c).desc() for c in order_cols]).limit(recent_rows) \
        .agg(*[F.avg(qcol(c)).alias(f"r{i}") for i, c in enumerate(cols)])
    rows = []
    for i, c in enumerate(cols):
        o = overall.get(f"o{i}")
        if o is None or o == 0:
            continue
        r = F.col(f"r{i}")
        pct = F.abs((r - F.lit(o)) / F.lit(o) * 100)
        rows.append(F.struct(F.lit(c).alias("column"), r.alias("recent_avg"),
                             F.lit(float(o)).alias("overall_avg"), pct.alias("change_percent"),
                             F.when(r > F.lit(o), "increasing").otherwise("decreasing").alias("direction"),
                             (pct > CHANGE_ALERT_PCT).alias("is_alert")))
    if not rows:
        return spark.createDataFrame([], schema)
    return recent.select(F.explode(F.array(*rows)).alias("x")).select("x.*")


@dataclass
class RiskReport:
    thresholds: DataFrame
    alerts: DataFrame
    change_alerts: DataFrame
    scores: DataFrame
    distribution: DataFrame
    top: DataFrame


def run_risk_engine(df: DataFrame, feature_cols: Sequence[str], key_cols: Sequence[str],
                    order_cols: Sequence[str] | None = None, change_columns: int | None = None) -> RiskReport:
    """All sections of the risk engine; ``order_cols`` (default the key)
    define "recent" for change alerts, ``change_columns`` limits them to the
    first columns."""
    work, cols = prepare(df, feature_cols)
    th = thresholds(work, cols)
    scores = risk_scores(work, th, key_cols)
    return RiskReport(
        thresholds=threshold_table(work, cols),
        alerts=threshold_alerts(work, th),
        change_alerts=change_alerts(work, cols, order_cols or key_cols, n_columns=change_columns),
        scores=scores,
        distribution=risk_distribution(scores),
        top=top_risk(scores, key_cols))
