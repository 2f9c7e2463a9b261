"""Alert rules (RUL-1..4) and dataset comparison (CMP-1, CMP-2).

Rules are evaluated by a threshold index, one plan for one rule or a million:
the distinct values that rules compare a column with are sorted, a binary
search gives each row's place among them (below, at or above each one), tasks
add up a histogram of places, and its running sums answer every rule of every
operator.  The first rows of a rule come from bounded lists per place, merged
along the places the rule covers.
"""

from __future__ import annotations

import math
from bisect import bisect_left, bisect_right
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.columns import qcol, to_double
from ..plans.aggregates import bounded_rows, wide_to_long
from ..plans.topk import first_k

OPERATORS = (">", "<", ">=", "<=", "==", "!=")
TRIGGERED_ROWS = 10
THRESHOLDS = 1 << 20   # distinct rule values that go to the tasks at once (8 MB)
PLACES = 4096          # places whose lists of first rows are merged together

# Rule templates suggested by column-name pattern
# (pattern, operator, value, severity, action), in the reference's order.
RULE_TEMPLATES = (
    ("glucose", ">", 140, "warning", "High glucose — check for diabetes"),
    ("glucose", ">", 200, "critical", "Critical hyperglycaemia — immediate review"),
    ("glucose", "<", 70, "critical", "Hypoglycaemia — immediate review"),
    ("blood_pressure", ">", 140, "warning", "Elevated BP — hypertension risk"),
    ("blood_pressure", ">", 180, "critical", "Hypertensive crisis"),
    ("systolic", ">", 140, "warning", "Elevated systolic BP"),
    ("systolic", ">", 180, "critical", "Hypertensive crisis"),
    ("bmi", ">", 30, "warning", "Obesity — review lifestyle factors"),
    ("bmi", ">", 40, "critical", "Severe obesity — bariatric referral"),
    ("age", ">", 65, "info", "Elderly patient — enhanced care protocol"),
    ("cholesterol", ">", 200, "warning", "Elevated cholesterol"),
    ("cholesterol", ">", 240, "critical", "High cholesterol — statin review"),
    ("heart_rate", ">", 100, "warning", "Tachycardia"),
    ("heart_rate", "<", 60, "info", "Bradycardia — check medications"),
    ("heart_rate", ">", 150, "critical", "Critical tachycardia"),
    ("temperature", ">", 38, "warning", "Fever"),
    ("temperature", ">", 39.5, "critical", "High fever — urgent review"),
    ("oxygen", "<", 95, "warning", "Low SpO2"),
    ("oxygen", "<", 90, "critical", "Critical hypoxia — emergency"),
    ("creatinine", ">", 1.2, "warning", "Elevated creatinine — renal function"),
    ("creatinine", ">", 2.0, "critical", "Severe renal impairment"),
)

RULE_SCHEMA = "rule_id int, name string, column string, operator string, value double, severity string, action string"


def compare(c: Column, op: str, v: float) -> Column:
    if op not in OPERATORS:
        raise ValueError(f"unknown rule operator {op!r}")
    lit = F.lit(float(v))
    return {">": c > lit, "<": c < lit, ">=": c >= lit, "<=": c <= lit, "==": c == lit, "!=": c != lit}[op]


def normalise_rules(df: DataFrame, rules: Sequence[Mapping]) -> list[dict]:
    """Rules with defaults filled; rules on unknown columns are skipped."""
    out = []
    for i, r in enumerate(rules):
        col = r.get("column", "")
        if col not in df.columns:
            continue
        op = r.get("operator", ">")
        if op not in OPERATORS:
            raise ValueError(f"unknown rule operator {op!r}")
        val = r.get("value")
        out.append({"rule_id": i, "name": r.get("name") or f"{col} {op} {val}", "column": col,
                    "operator": op, "value": float(val), "severity": r.get("severity", "warning"),
                    "action": r.get("action", "Review required")})
    return out


def evaluate_rules(df: DataFrame, rules: Sequence[Mapping]) -> DataFrame:
    """RUL-1: per rule the triggered count over the coerced non-null values,
    their count, share, status and the column mean/max."""
    return evaluate_rules_table(df, rules_frame(df.sparkSession, rules, df.columns))


def _place(values: np.ndarray, thresholds: np.ndarray) -> np.ndarray:
    """2 j for a value between thresholds j - 1 and j, 2 j + 1 for one equal
    to threshold j."""
    at = np.searchsorted(thresholds, values)
    equal = np.zeros(len(values), bool)
    inside = at < len(thresholds)
    equal[inside] = thresholds[at[inside]] == values[inside]
    return 2 * at + equal


def _histogram(thresholds: dict[str, np.ndarray]):
    """(column, place, n) of a task's rows, and at place -1 the sum and the
    largest of a column's values."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = [np.zeros(2 * len(t) + 1, np.int64) for t in thresholds.values()]
        total, most = np.zeros(len(counts)), np.full(len(counts), -np.inf)
        for b in batches:
            for i, t in enumerate(thresholds.values()):
                v = b.column(f"v{i}").drop_null().to_numpy(zero_copy_only=False)
                counts[i] += np.bincount(_place(v, t), minlength=len(counts[i]))
                total[i] += v.sum()
                most[i] = v.max(initial=most[i])
        for i, (name, n) in enumerate(zip(thresholds, counts)):
            at = np.flatnonzero(n)
            if len(at):
                places = np.append(at, -1)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * len(places), pa.string()), pa.array(places, pa.int32()), pa.array(np.append(n[at], 0)),
                     pa.array(np.where(places < 0, total[i], 0.0)), pa.array(np.where(places < 0, most[i], -np.inf))],
                    names=["column", "place", "n", "total", "most"])
    return run


def _below(thresholds: dict[str, np.ndarray]):
    """(column, value, below, equal) of every threshold, by running sums, with
    the column's count, mean and maximum."""
    def run(key: tuple, t: pa.Table) -> pa.Table:
        name = key[0].as_py()
        values = thresholds[name]
        place, n = t["place"].to_numpy(), np.zeros(2 * len(values) + 1, np.int64)
        n[place[place >= 0]] = t["n"].to_numpy()[place >= 0]
        count, total, most = int(n.sum()), t["total"].to_numpy()[place < 0][0], t["most"].to_numpy()[place < 0][0]
        return pa.table({"column": pa.array([name] * len(values), pa.string()), "value": pa.array(values),
                         "below": pa.array(np.cumsum(n)[0:-1:2]), "equal": pa.array(n[1::2]),
                         "n_total": pa.array(np.full(len(values), count)),
                         "col_mean": pa.array(np.full(len(values), total / count)),
                         "col_max": pa.array(np.full(len(values), most))})
    return run


COUNTED = "column string, value double, below long, equal long, n_total long, col_mean double, col_max double"


def _threshold_blocks(rules_df: DataFrame) -> Iterator[dict[str, np.ndarray]]:
    """The distinct (column, value) of the rules in order, ``THRESHOLDS`` at a time."""
    distinct, last = rules_df.select("column", F.col("value").cast("double").alias("value")).where(
        F.col("value").isNotNull()).distinct(), None
    while True:
        rest = distinct
        if last is not None:
            rest = distinct.where((F.col("column") > last[0]) | ((F.col("column") == last[0]) & (F.col("value") > last[1])))
        block = rest.orderBy("column", "value").limit(THRESHOLDS).toArrow()
        names, values = np.array(block["column"].to_pylist(), object), block["value"].to_numpy()
        if len(values):
            yield {c: values[names == c] for c in dict.fromkeys(names)}
            last = names[-1], float(values[-1])
        if len(values) < THRESHOLDS:
            return


def _threshold_counts(df: DataFrame, thresholds: dict[str, np.ndarray]) -> DataFrame:
    """(column, value, below, equal, n_total, col_mean, col_max): non-null values
    below and at each threshold, and in all."""
    values = df.select(*[to_double(c).alias(f"v{i}") for i, c in enumerate(thresholds)])
    places = values.mapInArrow(_histogram(thresholds), "column string, place int, n long, total double, most double")
    return places.groupBy("column", "place").agg(
        F.sum("n").alias("n"), F.sum("total").alias("total"), F.max("most").alias("most")).groupBy("column").applyInArrow(
        _below(thresholds), COUNTED)


def evaluate_rules_table(df: DataFrame, rules_df: DataFrame) -> DataFrame:
    """RUL-1 for rules that are data: ``rules_df`` has rule_id, name, column,
    operator, value, severity, action; rules on unknown columns are left out.
    Their thresholds pass the driver in blocks of ``THRESHOLDS``; a block costs
    one scan of the columns it names.  A rule without a value counts nothing."""
    cols = [r["column"] for r in bounded_rows(rules_df.select("column").distinct().orderBy("column"))
            if r["column"] in df.columns]
    spark = df.sparkSession
    bad = rules_df.where(~F.col("operator").isin(*OPERATORS)).limit(1).collect()
    if bad:
        raise ValueError(f"unknown rule operator {bad[0]['operator']!r}")
    if not cols:
        return spark.createDataFrame([], RULE_SCHEMA + ", n_triggered long, n_total long, percent double, "
                                     "status string, col_mean double, col_max double")
    known = rules_df.where(F.col("column").isin(*cols)).withColumn("value", F.col("value").cast("double"))
    counts = None
    for block in _threshold_blocks(known):
        found = _threshold_counts(df, block)
        counts = found if counts is None else counts.unionByName(found)
    if counts is None:
        counts = spark.createDataFrame([], COUNTED)
    out = known.join(counts, ["column", "value"], "left").withColumn("n_total", F.coalesce("n_total", F.lit(0)).cast("long"))
    op, n, below, equal = F.col("operator"), F.col("n_total"), F.col("below"), F.col("equal")
    hits = (F.when(op == ">", n - below - equal).when(op == "<", below).when(op == ">=", n - below)
            .when(op == "<=", below + equal).when(op == "==", equal).otherwise(n - equal))
    out = out.withColumn("n_triggered", F.coalesce(hits, F.lit(0)).cast("long"))
    return out.select("rule_id", "name", "column", "operator", "value", "severity", "action", "n_triggered", "n_total",
                      F.when(n > 0, F.col("n_triggered") / n * 100).otherwise(F.lit(0.0)).alias("percent"),
                      F.when(F.col("n_triggered") > 0, "TRIGGERED").otherwise("CLEAR").alias("status"),
                      "col_mean", "col_max")


def rules_frame(spark, rules: Sequence[Mapping], columns: Sequence[str]) -> DataFrame:
    """A rule list as a rules table (defaults filled, unknown columns kept
    out), for ``evaluate_rules_table``."""
    class _Cols:
        def __init__(self, c):
            self.columns = list(c)
    rs = normalise_rules(_Cols(columns), rules)  # type: ignore[arg-type]
    return spark.createDataFrame([(r["rule_id"], r["name"], r["column"], r["operator"], r["value"], r["severity"],
                                   r["action"]) for r in rs], RULE_SCHEMA)


def _first_of_task(thresholds: dict[str, np.ndarray], keys: Sequence[str], schema: pa.Schema, k: int):
    """The first k rows of a task at every place of every column."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list = [None] * len(thresholds)
        for b in batches:
            rows = pa.Table.from_batches([b.select(list(keys))])
            for i, t in enumerate(thresholds.values()):
                v = b.column(f"_v{i}")
                at = np.flatnonzero(v.is_valid().to_numpy(zero_copy_only=False))
                if not len(at):
                    continue
                place = _place(v.drop_null().to_numpy(zero_copy_only=False), t).astype(np.int32)
                found = rows.take(pa.array(at)).add_column(0, "_place", pa.array(place)).add_column(
                    0, "_column", pa.array(np.full(len(at), i, np.int32))).cast(schema)
                best[i] = first_k(found if best[i] is None else pa.concat_tables([best[i], found]), "_place", keys, k)
        for t in best:
            if t is not None:
                yield from t.to_batches()
    return run


def _rows_of_rules(rules: dict[int, list[tuple[int, str, int]]], keys: Sequence[str], schema: pa.Schema, k: int):
    """(rule_id, rank, key...) of a column's rules (id, operator, threshold
    number), from the first k rows of each place."""
    def run(key: tuple, t: pa.Table) -> pa.Table:
        t = t.append_column("_one", pa.array(np.zeros(t.num_rows, np.int32)))
        t = first_k(t, "_one", keys, t.num_rows)  # by key: a row's number is its rank
        by_place: dict[int, list[int]] = {}
        for row, place in enumerate(t["_place"].to_pylist()):
            by_place.setdefault(place, []).append(row)
        order = sorted(by_place)

        def running(places):
            out, so_far = [[]], []
            for p in places:
                so_far = sorted(so_far + by_place[p])[:k]
                out.append(so_far)
            return out
        ahead, behind = running(order), running(order[::-1])[::-1]  # of the first n places; from place n on
        rule_id, rank, rows = [], [], []
        for name, op, j in rules[key[0].as_py()]:
            lo, hi = bisect_left(order, 2 * j + 1), bisect_right(order, 2 * j + 1)
            if op in ("<", "<="):
                first = ahead[lo if op == "<" else hi]
            elif op in (">", ">="):
                first = behind[hi if op == ">" else lo]
            elif op == "==":
                first = by_place.get(2 * j + 1, [])
            else:
                first = sorted(ahead[lo] + behind[hi])[:k]
            rule_id += [name] * len(first)
            rank += range(1, len(first) + 1)
            rows += first
        found = t.select(list(keys)).take(pa.array(rows, pa.int64()))
        return found.add_column(0, "rank", pa.array(rank, pa.int32())).add_column(
            0, "rule_id", pa.array(rule_id, pa.int32())).cast(schema)
    return run


def triggered_rows(df: DataFrame, rules: Sequence[Mapping], key_cols: Sequence[str],
                   k: int = TRIGGERED_ROWS) -> DataFrame:
    """RUL-2: the first ``k`` triggering rows per rule in key order:
    (rule_id, rank, key...)."""
    rs = normalise_rules(df, rules)
    fields = df.select(*[qcol(c) for c in key_cols]).schema.fields
    out = T.StructType([T.StructField("rule_id", T.IntegerType()), T.StructField("rank", T.IntegerType()), *fields])
    if not rs:
        return df.sparkSession.createDataFrame([], out)
    thresholds = {c: np.unique([r["value"] for r in rs if r["column"] == c]) for c in dict.fromkeys(r["column"] for r in rs)}
    of_column: dict[int, list[tuple[int, str, int]]] = {i: [] for i in range(len(thresholds))}
    for r in rs:
        i = list(thresholds).index(r["column"])
        of_column[i].append((r["rule_id"], r["operator"], int(np.searchsorted(thresholds[r["column"]], r["value"]))))
    schema = T.StructType([T.StructField("_column", T.IntegerType()), T.StructField("_place", T.IntegerType()), *fields])
    rows = df.select(*[qcol(c) for c in key_cols], *[to_double(c).alias(f"_v{i}") for i, c in enumerate(thresholds)])
    found = rows.mapInArrow(_first_of_task(thresholds, list(key_cols), to_arrow_schema(schema), k), schema)
    merged = found.groupBy("_column", F.floor(F.col("_place") / PLACES)).applyInArrow(
        lambda t: first_k(t, "_place", list(key_cols), k), schema)
    return merged.groupBy("_column").applyInArrow(
        _rows_of_rules(of_column, list(key_cols), to_arrow_schema(out), k), out)


def rollup_status(evaluated: DataFrame) -> DataFrame:
    """RUL-3: triggered rules per severity; CRITICAL > WARNING > ALL_CLEAR
    (info rules never change the status)."""
    trig = F.col("status") == "TRIGGERED"
    out = evaluated.agg(
        F.count(F.lit(1)).alias("rules_evaluated"),
        F.count_if(trig & (F.col("severity") == "critical")).alias("critical_alerts"),
        F.count_if(trig & (F.col("severity") == "warning")).alias("warning_alerts"),
        F.count_if(trig & (F.col("severity") == "info")).alias("info_alerts"))
    clear = (F.col("critical_alerts") == 0) & (F.col("warning_alerts") == 0)
    return out.withColumn("all_clear", clear).withColumn(
        "overall_status", F.when(clear, "ALL_CLEAR").when(F.col("critical_alerts") > 0, "CRITICAL")
        .otherwise("WARNING"))


def suggest_rules(columns: Sequence[str]) -> list[dict]:
    """RUL-4: templates whose pattern is a substring of the lower-cased column
    name (spaces and hyphens read as '_'), column order then template order."""
    out = []
    for col in columns:
        low = col.lower().replace(" ", "_").replace("-", "_")
        for pat, op, val, sev, action in RULE_TEMPLATES:
            if pat in low:
                out.append({"name": f"{col} {op} {val}", "column": col, "operator": op, "value": val,
                            "severity": sev, "action": action})
    return out


# ----------------------------------------------------------------- comparison

EFFECT_BANDS = ((0.8, "large"), (0.5, "medium"), (0.2, "small"))
MIN_VALUES = 3


def _side_stats(df: DataFrame, cols: Sequence[str], tag: str) -> DataFrame:
    aggs = [F.count(F.lit(1)).alias("_rows")]
    for i, c in enumerate(cols):
        v = to_double(c)
        aggs += [F.count(v).alias(f"n{i}"), F.avg(v).alias(f"m{i}"), F.stddev_samp(v).alias(f"s{i}")]
    wide = df.agg(*aggs)
    rows = [{"column": F.lit(c), "position": F.lit(i), f"rows_{tag}": F.col("_rows"),
             f"n_{tag}": F.col(f"n{i}"), f"mean_{tag}": F.col(f"m{i}"), f"std_{tag}": F.col(f"s{i}")}
            for i, c in enumerate(cols)]
    return wide_to_long(wide, rows)


# erfc(z) = t exp(-z^2 + polynomial in t), t = 1 / (1 + z / 2), for
# z >= 0 (Numerical Recipes, relative error below 1.2e-7); constant term first.
ERFC_TERMS = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587,
              -0.82215223, 0.17087277)


def two_sided_normal(t: Column) -> Column:
    """Probability that a standard normal value lies further from 0 than t."""
    z = F.abs(t) / math.sqrt(2)
    u = 1 / (1 + z / 2)
    poly = F.lit(ERFC_TERMS[-1])
    for c in ERFC_TERMS[-2::-1]:
        poly = poly * u + F.lit(c)
    return F.least(u * F.exp(poly - z * z), F.lit(1.0))


def compare_datasets(df_a: DataFrame, df_b: DataFrame) -> DataFrame:
    """CMP-1/2: common columns with >= 3 numeric values on both sides: means,
    sample stds, difference, Cohen's d and its band, Welch t, the reference's
    ``p_approx`` (not a p-value) and significance, and ``p_normal``, the two-sided
    normal tail of Welch's t; one aggregate per side."""
    common = [c for c in df_a.columns if c in df_b.columns]
    if not common:
        raise ValueError("No common columns between the two datasets.")
    a, b = _side_stats(df_a, common, "a"), _side_stats(df_b, common, "b")
    j = a.join(b.drop("position"), "column").where((F.col("n_a") >= MIN_VALUES) & (F.col("n_b") >= MIN_VALUES))
    ma, mb, sa, sb = F.col("mean_a"), F.col("mean_b"), F.col("std_a"), F.col("std_b")
    pooled = F.sqrt((sa * sa + sb * sb) / 2)
    d = (ma - mb) / F.coalesce(F.nullif(pooled, F.lit(0.0)), F.lit(1.0))
    se = F.sqrt(sa * sa / F.col("n_a") + sb * sb / F.col("n_b"))
    t = F.when(se > 0, (ma - mb) / se).otherwise(F.lit(0.0))
    p = 2 * (1 - F.least(F.abs(t) / (F.abs(t) + 3), F.lit(0.999)))
    effect = None
    for cut, band in EFFECT_BANDS:
        effect = F.when(F.abs(d) > cut, band) if effect is None else effect.when(F.abs(d) > cut, band)
    effect = effect.otherwise("negligible")
    return j.select(
        "column", "position", "rows_a", "rows_b", "n_a", "n_b", "mean_a", "mean_b", "std_a", "std_b",
        (ma - mb).alias("mean_diff"),
        F.when(mb != 0, (ma - mb) / F.abs(mb) * 100).otherwise(F.lit(0.0)).alias("mean_diff_pct"),
        d.alias("cohens_d"), effect.alias("effect_size"), t.alias("t_stat"), p.alias("p_approx"),
        two_sided_normal(t).alias("p_normal"), (p < 0.05).alias("significant"),
        F.when(ma > mb, "A_higher").when(mb > ma, "B_higher").otherwise("equal").alias("direction"))



def comparison_summary(comparison: DataFrame) -> DataFrame:
    """CMP-2 roll-up: columns compared, and the significant differences
    (significant with a medium or large effect) in column order."""
    sig = F.col("significant") & F.col("effect_size").isin("medium", "large")
    return comparison.agg(
        F.count(F.lit(1)).alias("n_compared"),
        F.max("rows_a").alias("rows_a"), F.max("rows_b").alias("rows_b"),
        F.count_if(sig).alias("n_significant"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(sig, F.struct("position", "column")))),
                                 lambda s: s["column"]), ", ").alias("significant_columns"))
