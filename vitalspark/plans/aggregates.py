"""Bounded aggregates and size-checked broadcast joins.

Pattern used across operators: one pass computes a *bounded* summary (one row,
or one row per column), the summary comes to the driver (a few numbers per
column, never data rows) and is applied as literals, so the second pass is a
map-only, whole-stage-codegen projection with no join at all.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A summary larger than this is not a summary: fail instead of pulling it in.
MAX_SUMMARY_ROWS = 100_000
# Broadcast a side only when its row count is known to be below this.
DEFAULT_BROADCAST_ROWS = 1_000_000


def one_row(df: DataFrame, exprs: Sequence[Column]) -> dict:
    """Run one global aggregate and return its single row as a dict."""
    row = df.agg(*exprs).first()
    return row.asDict() if row is not None else {}


def bounded_rows(df: DataFrame, max_rows: int = MAX_SUMMARY_ROWS) -> list:
    """Collect an aggregated table whose size is bounded by construction
    (per column, per rule, per cluster ...).  The bound is checked."""
    rows = df.limit(max_rows + 1).collect()
    if len(rows) > max_rows:
        raise ValueError(f"summary has more than {max_rows} rows; refusing to collect")
    return rows


def broadcast_if_small(df: DataFrame, max_rows: int = DEFAULT_BROADCAST_ROWS) -> DataFrame:
    """Broadcast hint only behind a count; otherwise leave the choice to
    AQE (which re-plans to a broadcast at runtime if the side is small)."""
    n = df.limit(max_rows + 1).count()
    return F.broadcast(df) if n <= max_rows else df


def wide_to_long(wide: DataFrame, rows: Sequence[dict]) -> DataFrame:
    """Turn a one-row (or few-row) wide aggregate into long form: one output
    row per dict, fields in dict order.  Keeps the report lazy and inside
    the same Spark job as the aggregate."""
    structs = [F.struct(*[v.alias(k) for k, v in r.items()]) for r in rows]
    return wide.select(F.explode(F.array(*structs)).alias("_r")).select("_r.*")


def spread_for_cpu(df: DataFrame) -> DataFrame:
    """CPU-heavy per-row work (regular expressions over long texts, Python
    scoring) should use every core.  An input stored as one Parquet row
    group arrives as one partition; spread it round-robin when it has fewer
    partitions than the cluster has cores.  A large input is left alone."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
