"""Entity profiles (PAT-1, 2, 3, 6) for every row at once.

The reference profiles one row per call.  Here each (row, numeric column)
gets its percentile, z-score, outlier flag and direction in one plan:

* percentile = share of non-null values strictly below: computed on the
  distinct-value table with ``ordered_prefix`` (running counts, spread over
  range partitions) and joined back on (column, value) -- no n^2 count and
  no single-task window.  Values that hold over a thousandth of a column (at
  most 1,000 a column) come by broadcast and their rows, like those without a
  value, are spread over the join's partitions;
* mean and sample std per column come from one aggregate, the median from the
  running counts of the distinct-value table.

Columns that are not numeric (texts, dates, lists) have a value and the
missing / feature / target flags but no figures, with ``other_columns``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import is_numeric, nan_to_null, qcol, std_or_one
from ..plans.ordered import exact_quantiles, ordered_prefix

OUTLIER_Z = 2.5                # fixed: |z| > 2.5 is an outlier
DIRECTION_Z = 0.5              # fixed: high / low beyond +-0.5
Z_CAP = 3
HIGH_RISK, MEDIUM_RISK = 65, 35
REASON_COLUMNS = 4             # fixed: the reason names at most 4 columns


def column_moments(df: DataFrame, cols: Sequence[str]) -> dict:
    """count, mean and sample std (0 / single row -> 1) per column."""
    if not cols:
        return {}
    aggs = []
    for i, c in enumerate(cols):
        v = qcol(c).cast("double")
        aggs += [F.count(v).alias(f"n{i}"), F.avg(v).alias(f"m{i}"), std_or_one(F.stddev_samp(v)).alias(f"s{i}"),
                 F.stddev_samp(v).alias(f"r{i}")]
    row = df.agg(*aggs).first()
    return {c: (row[f"n{i}"], row[f"m{i}"], row[f"s{i}"], row[f"r{i}"]) for i, c in enumerate(cols)}


HOT_SHARE = 1000               # a value is hot when it holds over 1 / HOT_SHARE of its column
HOT_SPREAD = 1024              # places that the rows of hot and missing values are spread over


def _medians(ranked: DataFrame) -> DataFrame:
    """(column, median) from (column, value, _c, _below, _n): the mean of the
    two middle values."""
    low, high = F.floor((F.col("_n") - 1) / 2), F.floor(F.col("_n") / 2)
    covers = lambda at: (F.col("_below") <= at) & (at < F.col("_below") + F.col("_c"))
    return ranked.groupBy("column").agg(
        ((F.max(F.when(covers(low), F.col("value"))) + F.max(F.when(covers(high), F.col("value")))) / 2).alias("median"))


def profile_cells(df: DataFrame, key_cols: Sequence[str], feature_cols: Sequence[str] = (),
                  target_col: str | None = None, other_columns: bool = False) -> DataFrame:
    """PAT-1 (+ PAT-6 figures) in long form: one row per (key, numeric
    column) with value, percentile, column mean/median/std, z, outlier,
    direction and the feature/target flags.  With ``other_columns`` every
    column has its row; one that is not numeric shows its value as text in
    ``text_value`` (null for numeric ones) and has no figures."""
    df = nan_to_null(df)
    kinds = {f.name: is_numeric(f.dataType, "C") for f in df.schema.fields if f.name not in key_cols}
    num = [c for c, numeric in kinds.items() if numeric]
    shown = list(kinds) if other_columns else num
    mom = column_moments(df, num)
    cell = [F.struct(F.lit(c).alias("column"),
                     (qcol(c).cast("double") if kinds[c] else F.lit(None).cast("double")).alias("value"),
                     (F.lit(None) if kinds[c] else qcol(c)).cast("string").alias("text_value")) for c in shown]
    long = df.select(*[qcol(k) for k in key_cols], F.explode(F.array(*cell)).alias("_u")) \
        .select(*key_cols, "_u.column", "_u.value", "_u.text_value")
    stats = df.sparkSession.createDataFrame(
        [(c, *((int(mom[c][0] or 0), *mom[c][1:]) if kinds[c] else (0, None, None, None))) for c in shown],
        "column string, _n long, mean double, _s double, std double")
    counts = long.where(F.col("value").isNotNull()).groupBy("column", "value").agg(F.count(F.lit(1)).alias("_c"))
    ranked = ordered_prefix(counts, ["value"], ["column"], sums=[("_cum", "_c")], index_name=None) \
        .select("column", "value", "_c", (F.col("_cum") - F.col("_c")).alias("_below")) \
        .join(F.broadcast(stats.select("column", "_n")), "column")
    hot = F.col("_c") * HOT_SHARE > F.col("_n")
    cells = long.join(F.broadcast(ranked.where(hot).select("column", "value", F.col("_below").alias("_hot"))),
                      ["column", "value"], "left")
    spread = F.when(F.col("_hot").isNotNull() | F.col("value").isNull(),
                    1 + F.pmod(F.xxhash64(*[qcol(k) for k in key_cols]), F.lit(HOT_SPREAD))).otherwise(F.lit(0))
    cells = cells.withColumn("_spread", spread.cast("long")).join(
        ranked.where(~hot).select("column", "value", F.lit(0).cast("long").alias("_spread"), "_below"),
        ["column", "value", "_spread"], "left")
    cells = cells.join(F.broadcast(stats.join(_medians(ranked), "column", "left")), "column")
    z = (F.col("value") - F.col("mean")) / F.col("_s")
    return cells.select(
        *key_cols, "column", "value", *(["text_value"] if other_columns else []),
        (F.col("value").isNull() & F.col("text_value").isNull()).alias("is_missing"),
        F.col("column").isin(list(feature_cols)).alias("is_feature"),
        (F.col("column") == F.lit(target_col or "")).alias("is_target"),
        (F.coalesce("_hot", "_below") / F.col("_n") * 100).alias("percentile"),
        "mean", "median", "std", z.alias("z_score"), (F.abs(z) > OUTLIER_Z).alias("is_outlier"),
        F.when(z > DIRECTION_Z, "high").when(z < -DIRECTION_Z, "low")
        .when(z.isNotNull(), "normal").alias("direction"))


def risk_profile(df: DataFrame, key_cols: Sequence[str], feature_cols: Sequence[str]) -> DataFrame:
    """PAT-2 + PAT-3 per row: composite score from unrounded mean/std (null
    values skipped, columns with < 2 values skipped, divided by all numeric
    features), level, and the outlier reason naming the first 4 features."""
    df = nan_to_null(df)
    num = [c for c in feature_cols if c in df.columns and is_numeric(df.schema[c].dataType, "C")]
    mom = column_moments(df, num)
    total = F.lit(0.0)
    flags = []
    for c in num:
        n, m, s, _ = mom[c]
        v = qcol(c).cast("double")
        z = F.abs((v - F.lit(m)) / F.lit(s)) if (n or 0) >= 2 else None
        if z is not None:
            total = total + F.coalesce(F.least(z, F.lit(float(Z_CAP))), F.lit(0.0))
            flags.append(F.when(z > OUTLIER_Z, F.lit(c)))
    score = F.round(F.least(total / F.lit(float(max(len(num), 1))) / Z_CAP * 100, F.lit(100.0)), 1)
    outliers = F.filter(F.array(*flags), lambda x: x.isNotNull()) if flags else F.array().cast("array<string>")
    missing = sum((qcol(c).isNull().cast("int") for c in df.columns), F.lit(0))
    return df.select(*[qcol(k) for k in key_cols], score.alias("risk_score"), outliers.alias("_o"),
                     missing.alias("missing_count")).select(
        *key_cols, "risk_score",
        F.when(F.col("risk_score") > HIGH_RISK, "HIGH").when(F.col("risk_score") > MEDIUM_RISK, "MEDIUM")
        .otherwise("LOW").alias("risk_level"),
        (F.size("_o") > 0).alias("anomaly_flag"),
        F.when(F.size("_o") > 0, F.concat(F.lit("Outlier values in: "),
                                          F.array_join(F.slice("_o", 1, REASON_COLUMNS), ", ")))
        .otherwise(F.lit("")).alias("anomaly_reason"),
        F.array_join("_o", ", ").alias("outlier_columns"), "missing_count")


def profile_keys(df: DataFrame, key_cols: Sequence[str], keys: Sequence[tuple], feature_cols: Sequence[str] = (),
                 target_col: str | None = None, max_keys: int = 1000) -> DataFrame:
    """PAT-1 / PAT-6 for a bounded set of rows (the reference's one-patient
    profile): the chosen rows' values come back (at most ``max_keys``), and
    ONE aggregate over the table yields, for every (row, column), the count
    of values strictly below it -- no ranking of the whole table.  Output
    columns as ``profile_cells``."""
    from ..plans.aggregates import bounded_rows
    df = nan_to_null(df)
    if len(keys) > max_keys:
        raise ValueError(f"profile_keys takes at most {max_keys} rows; use profile_cells for all rows")
    num = [f.name for f in df.schema.fields if is_numeric(f.dataType, "C") and f.name not in key_cols]
    cond = F.lit(False)
    for key in keys:
        one = F.lit(True)
        for c, v in zip(key_cols, key):
            one = one & (qcol(c) == F.lit(v))
        cond = cond | one
    picked = bounded_rows(df.where(cond).select(*[qcol(k) for k in key_cols],
                                                *[qcol(c).cast("double").alias(c) for c in num]), 4 * max_keys)
    mom = column_moments(df, num)
    aggs = []
    for i, r in enumerate(picked):
        for j, c in enumerate(num):
            v = r[c]
            aggs.append((F.count_if(qcol(c).cast("double") < F.lit(v)) if v is not None else F.lit(None))
                        .alias(f"b{i}_{j}"))
    below = df.agg(*aggs).first() if aggs else None
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), qcol(c).cast("double").alias("value"))
                                         for c in num])).alias("_u")).select("_u.*")
    med = {r["column"]: r["q"] for r in exact_quantiles(long, ["column"], "value", [0.5]).collect()}
    out = []
    for i, r in enumerate(picked):
        for j, c in enumerate(num):
            n, m, s, std = mom[c]
            v = r[c]
            z = (v - m) / s if v is not None and m is not None else None
            out.append((*[r[k] for k in key_cols], c, v, v is None, c in feature_cols, c == (target_col or ""),
                        (below[f"b{i}_{j}"] / n * 100) if v is not None and n else None, m, med.get(c), std, z,
                        abs(z) > OUTLIER_Z if z is not None else None,
                        None if z is None else ("high" if z > DIRECTION_Z else "low" if z < -DIRECTION_Z
                                                else "normal")))
    schema = df.select(*key_cols).schema
    for name, typ in (("column", "string"), ("value", "double"), ("is_missing", "boolean"),
                      ("is_feature", "boolean"), ("is_target", "boolean"), ("percentile", "double"),
                      ("mean", "double"), ("median", "double"), ("std", "double"), ("z_score", "double"),
                      ("is_outlier", "boolean"), ("direction", "string")):
        schema = schema.add(name, typ)
    return df.sparkSession.createDataFrame(out, schema)
