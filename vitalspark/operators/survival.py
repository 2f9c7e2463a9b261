"""Kaplan-Meier survival (SRV-1..4).

Plan: rows -> one row per (group, time) with its row count and event sum
(partial aggregation) -> running at-risk counts and the running product of
(1 - d/n) along time, computed with ``ordered_prefix`` so a hot group is
spread over many tasks -> event times only.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import nan_to_null, qcol, to_double
from ..plans.ordered import ordered_prefix

MIN_ROWS = 5          # fixed: fewer complete rows is an error
Z = 1.96              # fixed: simple normal band, not Greenwood
OVERALL = "Overall"


@dataclass
class SurvivalReport:
    curve: DataFrame
    median: DataFrame
    summary: DataFrame


def survival_input(df: DataFrame, duration_col: str, event_col: str, group_col: str | None = None,
                   check_rows: bool = True) -> DataFrame:
    """SRV-4 validation: columns must exist; drop nulls, coerce to numbers,
    drop again; fewer than 5 rows is an error.  Output (group, t, e)."""
    for c in (duration_col, event_col):
        if c not in df.columns:
            raise ValueError(f"column {c!r} not found")
    use_group = bool(group_col) and group_col in df.columns
    cols = [duration_col, event_col] + ([group_col] if use_group else [])
    work = nan_to_null(df.select(*[qcol(c) for c in cols])).dropna("any")
    grp = qcol(group_col).cast("string") if use_group else F.lit(OVERALL)
    out = work.select(grp.alias("group"), to_double(duration_col).alias("t"), to_double(event_col).alias("e")) \
        .dropna("any", subset=["t", "e"])
    if check_rows and out.limit(MIN_ROWS).count() < MIN_ROWS:
        raise ValueError("Not enough data for survival analysis (need >= 5 rows).")
    return out


def km_curve(rows: DataFrame) -> DataFrame:
    """SRV-1/2 from (group, t, e): one row per group and event time with
    at-risk count, deaths (sum of event values), survival and its band, plus
    the (0, 1.0) starting point of every group."""
    per_t = rows.groupBy("group", "t").agg(
        F.count(F.lit(1)).alias("n_t"), F.sum("e").alias("d"),
        F.max((F.col("e") == 1).cast("int")).alias("has_event"))
    totals = rows.groupBy("group").agg(F.count(F.lit(1)).alias("n_group"))
    # Running count from the left gives "rows before t"; at risk = total - that.
    ranked = ordered_prefix(per_t, ["t"], ["group"], sums=[("_cum_n", "n_t")], index_name=None)
    ranked = ranked.join(totals, "group").withColumn(
        "at_risk", F.col("n_group") - F.col("_cum_n") + F.col("n_t"))
    events = ranked.where(F.col("has_event") == 1) \
        .withColumn("_f", 1 - F.col("d") / F.col("at_risk"))
    surv = ordered_prefix(events, ["t"], ["group"], products=[("survival", "_f")], index_name=None)
    s = F.col("survival")
    se = F.sqrt(s * (1 - s) / F.greatest(F.col("at_risk"), F.lit(1)))
    curve = surv.select("group", "t", F.col("at_risk").cast("long").alias("at_risk"),
                        F.col("d").cast("long").alias("deaths"), s.alias("survival"),
                        F.least(s + Z * se, F.lit(1.0)).alias("ci_upper"),
                        F.greatest(s - Z * se, F.lit(0.0)).alias("ci_lower"), F.lit(False).alias("is_start"))
    start = totals.select("group", F.lit(0.0).alias("t"), F.col("n_group").alias("at_risk"),
                          F.lit(0).cast("long").alias("deaths"), F.lit(1.0).alias("survival"),
                          F.lit(1.0).alias("ci_upper"), F.lit(1.0).alias("ci_lower"), F.lit(True).alias("is_start"))
    return start.unionByName(curve)


def median_survival(curve: DataFrame) -> DataFrame:
    """SRV-3: first time whose survival rounded to 4 decimals is <= 0.5,
    NULL when the curve never gets there."""
    # Every group has its start row, so one aggregation covers all groups.
    hit = (~F.col("is_start")) & (F.round("survival", 4) <= 0.5)
    return curve.groupBy("group").agg(F.min(F.when(hit, F.col("t"))).alias("median_survival"))


def event_summary(rows: DataFrame) -> DataFrame:
    """SRV-4 totals over all rows: events = sum of event values (truncated
    to an integer), censored = rows with event 0, event rate in %."""
    out = rows.agg(F.count(F.lit(1)).alias("n_total"), F.sum("e").alias("_ev"),
                   F.count_if(F.col("e") == 0).alias("n_censored"))
    ev = F.col("_ev").cast("long")
    return out.select("n_total", ev.alias("n_events"), "n_censored",
                      F.round(ev / F.col("n_total") * 100, 1).alias("event_rate"))


def run_kaplan_meier(df: DataFrame, duration_col: str, event_col: str,
                     group_col: str | None = None) -> SurvivalReport:
    rows = survival_input(df, duration_col, event_col, group_col)
    curve = km_curve(rows)
    return SurvivalReport(curve=curve, median=median_survival(curve), summary=event_summary(rows))

