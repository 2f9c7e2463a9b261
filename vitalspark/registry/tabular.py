"""Filter, projection, profiling and data-quality queries (FLT, PRJ, PRF, DQ).

Nulls and duplicates are injected the same way in Spark and in SQL (the
driver tables contain none): ``CASE WHEN key % 7 = 0 THEN NULL ...`` and a
``UNION ALL`` of a keyed slice.  The whole table is always processed.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import r4
from ..operators import filters, profile, quality
from .base import LINEITEM_KEY, register, table

_KEYS = ", ".join(LINEITEM_KEY)

# ---------------------------------------------------------------- derived tables

LINEITEM_NULLS_SQL = (
    "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber,"
    " CASE WHEN l_linenumber % 7 = 0 THEN NULL ELSE l_quantity END AS l_quantity,"
    " l_extendedprice,"
    " CASE WHEN l_orderkey % 3 = 0 THEN NULL ELSE l_discount END AS l_discount,"
    " l_tax, l_returnflag,"
    " CASE WHEN l_linenumber % 7 = 0 THEN NULL ELSE l_linestatus END AS l_linestatus"
    " FROM lineitem")
LINEITEM_DQ_SQL = f"({LINEITEM_NULLS_SQL}) UNION ALL ({LINEITEM_NULLS_SQL} WHERE l_orderkey % 50 = 0)"

CUSTOMER_DQ_SQL = (
    "SELECT c_custkey, c_name, c_nationkey, c_acctbal,"
    " CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_mktsegment END AS c_mktsegment,"
    " CASE WHEN c_custkey % 3 = 0 THEN CAST(c_acctbal AS VARCHAR) ELSE c_mktsegment END AS c_mixed,"
    " 'x' AS c_const FROM customer")


def lineitem_nulls(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
        F.when(F.col("l_linenumber") % 7 == 0, None).otherwise(F.col("l_quantity")).alias("l_quantity"),
        "l_extendedprice",
        F.when(F.col("l_orderkey") % 3 == 0, None).otherwise(F.col("l_discount")).alias("l_discount"),
        "l_tax", "l_returnflag",
        F.when(F.col("l_linenumber") % 7 == 0, None).otherwise(F.col("l_linestatus")).alias("l_linestatus"))


def lineitem_dq(spark, sf_dir):
    base = lineitem_nulls(spark, sf_dir)
    return base.unionByName(base.where(F.col("l_orderkey") % 50 == 0))


def customer_dq(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    return c.select(
        "c_custkey", "c_name", "c_nationkey", "c_acctbal",
        F.when(F.col("c_custkey") % 7 == 0, None).otherwise(F.col("c_mktsegment")).alias("c_mktsegment"),
        F.when(F.col("c_custkey") % 3 == 0, F.col("c_acctbal").cast("string"))
        .otherwise(F.col("c_mktsegment")).alias("c_mixed"),
        F.lit("x").alias("c_const"))


# ---------------------------------------------------------------- filters / projections

FILTERS = [
    {"col": "l_linestatus", "op": "!=", "value": "O"},
    {"col": "l_quantity", "op": ">=", "value": 10},
    {"col": "l_discount", "op": "<", "value": 0.05},
    {"col": "l_returnflag", "op": "contains", "value": "^[AR]$"},
    {"col": "no_such_column", "op": "==", "value": 1},
]


@register("filter_chain", "FLT-1 FLT-2 FLT-3 FLT-4 FLT-5",
          f"SELECT {_KEYS}, l_quantity, l_discount, l_returnflag, l_linestatus FROM ({LINEITEM_NULLS_SQL})"
          " WHERE l_linestatus IS DISTINCT FROM 'O' AND l_quantity >= 10.0 AND l_discount < 0.05"
          " AND regexp_matches(l_returnflag, '^[AR]$')")
def filter_chain(spark, sf_dir):
    out = filters.filter_chain(lineitem_nulls(spark, sf_dir), FILTERS)
    return out.select(*LINEITEM_KEY, "l_quantity", "l_discount", "l_returnflag", "l_linestatus")


@register("filter_equals", "FLT-2",
          "SELECT c_custkey, c_name, c_nationkey FROM customer WHERE c_nationkey = 7 AND c_mktsegment = 'BUILDING'")
def filter_equals(spark, sf_dir):
    out = filters.filter_chain(table(spark, sf_dir, "customer"),
                               [{"col": "c_nationkey", "op": "==", "value": "7"},
                                {"col": "c_mktsegment", "op": "==", "value": "BUILDING"}])
    return out.select("c_custkey", "c_name", "c_nationkey")


_PREVIEW_COLS = ("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")


@register("preview", "PRJ-1",
          "SELECT " + ", ".join(f"coalesce(CAST({c} AS VARCHAR), '') AS {c}" for c in _PREVIEW_COLS)
          + " FROM (SELECT * FROM (" + CUSTOMER_DQ_SQL + ") ORDER BY c_custkey LIMIT 500)")
def preview(spark, sf_dir):
    return filters.preview(customer_dq(spark, sf_dir).select(*_PREVIEW_COLS), ["c_custkey"])


@register("impute_mean", "PRJ-3 PRJ-4",
          f"SELECT {_KEYS}, round(coalesce(l_quantity, (SELECT avg(l_quantity) FROM ({LINEITEM_NULLS_SQL}))), 4)"
          f" AS l_quantity, round(coalesce(l_discount, (SELECT avg(l_discount) FROM ({LINEITEM_NULLS_SQL}))), 4)"
          f" AS l_discount, TRY_CAST(l_returnflag AS DOUBLE) AS flag_num FROM ({LINEITEM_NULLS_SQL})")
def impute_mean(spark, sf_dir):
    df = lineitem_nulls(spark, sf_dir)
    df = filters.coerce_numeric(df.withColumn("flag_num", F.col("l_returnflag")), ["flag_num"])
    out = filters.impute_mean(df, ["l_quantity", "l_discount"])
    return out.select(*LINEITEM_KEY, r4(F.col("l_quantity")).alias("l_quantity"),
                      r4(F.col("l_discount")).alias("l_discount"), "flag_num")


@register("context_trim", "PRJ-5",
          "SELECT doc_id, CASE WHEN length(text) > 3000 THEN substring(text, 1, 3000) || chr(10) || '...[trimmed]'"
          " ELSE text END AS context, length(text) > 3000 AS trimmed FROM documents")
def context_trim(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", filters.trim_text("text").alias("context"),
                    (F.length("text") > filters.TRIM_CHARS).alias("trimmed"))


# ---------------------------------------------------------------- profiling

_CUST_TYPES = {"c_custkey": "bigint", "c_name": "string", "c_nationkey": "int", "c_acctbal": "double",
               "c_mktsegment": "string", "c_mixed": "string", "c_const": "string"}


def _column_info_sql() -> str:
    parts = []
    for i, (c, t) in enumerate(_CUST_TYPES.items()):
        kind = "numeric" if t in ("bigint", "int", "double") else "categorical"
        parts.append(
            f"SELECT '{c}' AS \"column\", {i} AS position, '{t}' AS dtype, '{kind}' AS col_type,"
            f" count(DISTINCT {c}) AS unique_values, count_if({c} IS NULL) AS null_count,"
            f" coalesce((SELECT string_agg(v, ' | ' ORDER BY c_custkey) FROM (SELECT CAST({c} AS VARCHAR) v, c_custkey"
            f" FROM d WHERE {c} IS NOT NULL ORDER BY c_custkey LIMIT 3)), '') AS sample_values FROM d")
    return f"WITH d AS ({CUSTOMER_DQ_SQL}) " + " UNION ALL ".join(parts)


@register("column_info", "PRF-1", _column_info_sql())
def column_info(spark, sf_dir):
    return profile.column_info(customer_dq(spark, sf_dir), ["c_custkey"])


_PART_NUM = ("p_partkey", "p_size", "p_retailprice")
_PART_CAT = ("p_name", "p_brand", "p_type")


def _step_sql(lo: str, hi: str) -> str:
    r = f"({hi} - {lo})"
    return (f"CASE WHEN {r} = 0 THEN 1.0 WHEN {r} < 1 THEN round_even({r} / 100, 6) WHEN {r} < 10 THEN 0.1"
            f" WHEN {r} < 100 THEN 1.0 ELSE round_even({r} / 100, 0) END")


def _column_stats_sql() -> str:
    parts = []
    for c in _PART_NUM:
        parts.append(
            f"SELECT '{c}' AS \"column\", 'numeric' AS type, round(min({c}), 3) AS min, round(max({c}), 3) AS max,"
            f" round(avg({c}), 3) AS mean, round(quantile_cont({c}, 0.5), 3) AS median,"
            f" {_step_sql(f'round(min({c}), 3)', f'round(max({c}), 3)')} AS step,"
            f" NULL::VARCHAR AS most_common, NULL::VARCHAR AS unique_values FROM part")
    for c in _PART_CAT:
        parts.append(
            f"SELECT '{c}', 'categorical', NULL::DOUBLE, NULL::DOUBLE, NULL::DOUBLE, NULL::DOUBLE, NULL::DOUBLE,"
            f" (SELECT {c} FROM part WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1),"
            f" (SELECT string_agg(v, ' | ' ORDER BY k) FROM (SELECT {c} AS v, min(p_partkey) AS k FROM part"
            f" WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY k LIMIT 50))")
    return " UNION ALL ".join(parts)


@register("column_stats", "PRF-2", _column_stats_sql())
def column_stats(spark, sf_dir):
    out = profile.column_stats(table(spark, sf_dir, "part"), ["p_partkey"])
    return out.select("column", "type", *[r4(F.col(c)).alias(c) for c in ("min", "max", "mean", "median", "step")],
                      "most_common", "unique_values")


_LI_TYPES = {"l_orderkey": "bigint", "l_partkey": "bigint", "l_suppkey": "bigint", "l_linenumber": "int",
             "l_quantity": "double", "l_extendedprice": "double", "l_discount": "double", "l_tax": "double",
             "l_returnflag": "string", "l_linestatus": "string"}


def _summary_sql() -> str:
    parts = [f"SELECT (SELECT count(*) FROM d) AS n_rows, {len(_LI_TYPES)}::BIGINT AS n_cols, '{c}' AS \"column\","
             f" {i} AS position, '{t}' AS dtype, count_if({c} IS NULL) AS null_count FROM d"
             for i, (c, t) in enumerate(_LI_TYPES.items())]
    return f"WITH d AS ({LINEITEM_NULLS_SQL}) " + " UNION ALL ".join(parts)


@register("dataset_summary", "PRF-3", _summary_sql())
def dataset_summary(spark, sf_dir):
    return profile.dataset_summary(lineitem_nulls(spark, sf_dir))


def _tasks_sql() -> str:
    parts = []
    for c, t in _LI_TYPES.items():
        d = f"count(DISTINCT {c})"
        if t == "double":
            auto = "'regression'"
        elif t == "string":
            auto = "'classification'"
        else:
            auto = (f"CASE WHEN {d} > 20 THEN 'regression' WHEN {d} / count(*) < 0.05 OR {d} <= 10"
                    f" THEN 'classification' ELSE 'regression' END")
        multi = (f"CASE WHEN {d} > 10 THEN 'regression' ELSE 'classification' END"
                 if t != "string" else "'classification'")
        parts.append(f"SELECT '{c}' AS \"column\", {d} AS \"distinct\", {auto} AS task_auto,"
                     f" {multi} AS task_multi FROM d")
    return f"WITH d AS ({LINEITEM_NULLS_SQL}) " + " UNION ALL ".join(parts)


@register("task_detect", "PRF-4 PRF-5", _tasks_sql())
def task_detect(spark, sf_dir):
    return profile.detect_tasks(lineitem_nulls(spark, sf_dir))


# ---------------------------------------------------------------- data quality


def _missing_sql() -> str:
    parts = []
    for i, c in enumerate(_LI_TYPES):
        parts.append(f"SELECT '{c}' AS \"column\", {i} AS position, count_if({c} IS NULL) AS missing,"
                     f" round(count_if({c} IS NULL) / count(*) * 100, 1) AS percent FROM d")
    return (f"WITH d AS ({LINEITEM_DQ_SQL}), m AS ({' UNION ALL '.join(parts)}) "
            "SELECT *, CASE WHEN percent > 30 THEN 'critical' WHEN percent > 5 THEN 'warning' ELSE 'info' END AS level,"
            " CASE WHEN percent > 30 THEN 10 WHEN percent > 5 THEN 3 ELSE 0 END AS penalty FROM m WHERE percent > 0")


@register("quality_missing", "DQ-1", _missing_sql())
def quality_missing(spark, sf_dir):
    df = lineitem_dq(spark, sf_dir)
    return quality.missing_report(quality.column_pass(df, with_distinct=False))


_LI_COLS = ", ".join(_LI_TYPES)


@register("quality_duplicates", "DQ-2",
          f"WITH d AS ({LINEITEM_DQ_SQL}), g AS (SELECT count(*) AS c FROM d GROUP BY ALL) "
          "SELECT CAST(sum(c - 1) AS BIGINT) AS duplicates, round(sum(c - 1) / sum(c) * 100, 1) AS percent,"
          " CASE WHEN sum(c - 1) > 0 THEN 5 ELSE 0 END AS penalty FROM g".replace("GROUP BY ALL", f"GROUP BY {_LI_COLS}"))
def quality_duplicates(spark, sf_dir):
    return quality.duplicate_report(lineitem_dq(spark, sf_dir))


_DOC_NUM = ("doc_id", "n_chars")


def _outliers_sql() -> str:
    parts = []
    for i, c in enumerate(_DOC_NUM):
        parts.append(
            f"SELECT '{c}' AS \"column\", {i} AS position, quantile_cont({c}, 0.25) AS q1,"
            f" quantile_cont({c}, 0.75) AS q3, count({c}) AS n, min({c}) AS lo, max({c}) AS hi FROM documents")
    per = " UNION ALL ".join(parts)
    counts = " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count_if({c} < q1 - 3 * (q3 - q1) OR {c} > q3 + 3 * (q3 - q1)) AS outliers"
        f" FROM documents, s WHERE s.\"column\" = '{c}'" for c in _DOC_NUM)
    return (f"WITH s AS ({per}), o AS ({counts}) "
            "SELECT s.\"column\", position, outliers, round(outliers / n * 100, 1) AS percent,"
            " round(lo, 2)::DOUBLE AS min, round(hi, 2)::DOUBLE AS max, round(q1, 4) AS q1, round(q3, 4) AS q3,"
            " CASE WHEN round(outliers / n * 100, 1) > 5 THEN 3 ELSE 0 END AS penalty,"
            " row_number() OVER (ORDER BY position)::INTEGER AS report_rank"
            " FROM s JOIN o USING (\"column\") WHERE q3 - q1 <> 0 AND outliers > 0")


@register("quality_outliers", "DQ-3", _outliers_sql())
def quality_outliers(spark, sf_dir):
    out = quality.outlier_report(table(spark, sf_dir, "documents").select(*_DOC_NUM))
    return out.withColumn("q1", r4(F.col("q1"))).withColumn("q3", r4(F.col("q3")))


def _imbalance_sql() -> str:
    parts = []
    for c in ("role", "text"):
        parts.append(
            f"SELECT '{c}' AS \"column\", count(*) AS classes, sum(n) AS total, max(n) AS top, min(n) AS bottom,"
            f" arg_min(v, (-n, v)) AS dominant_class FROM (SELECT {c} AS v, count(*) AS n FROM conversations"
            f" WHERE {c} IS NOT NULL GROUP BY {c})")
    return (f"WITH p AS ({' UNION ALL '.join(parts)}) SELECT \"column\", dominant_class,"
            " round(top / total * 100, 1) AS dominant_pct, round(top / bottom, 1) AS ratio, 5 AS penalty"
            " FROM p WHERE classes >= 2 AND round(top / bottom, 1) > 10")


@register("quality_imbalance", "DQ-4", _imbalance_sql())
def quality_imbalance(spark, sf_dir):
    return quality.imbalance_report(table(spark, sf_dir, "conversations").select("role", "text"))


def _flags_sql() -> str:
    parts = []
    for i, (c, t) in enumerate(_CUST_TYPES.items()):
        d = f"count(DISTINCT {c})"
        if t == "string":
            share = f"count_if(regexp_matches({c}, '{quality.NUMERIC_TEXT}')) / count({c})"
            nl = f"count_if(regexp_matches({c}, '{quality.NUMERIC_TEXT}'))"
            hc = f"{d} > least(50.0, count(*) * 0.5)"
            mixed = f"coalesce({nl} > 0 AND {share} < 0.9 AND {share} > 0.1, false)"
        else:
            hc, mixed = "false", "false"
        parts.append(
            f"SELECT '{c}' AS \"column\", {i} AS position, {d} AS \"distinct\", {d} <= 1 AS is_constant,"
            f" {d} = 2 AND count(*) > 100 AS is_binary, {hc} AS high_cardinality, {mixed} AS mixed_type,"
            f" CASE WHEN {d} <= 1 THEN 5 ELSE 0 END AS penalty FROM d")
    return f"WITH d AS ({CUSTOMER_DQ_SQL}) " + " UNION ALL ".join(parts)


@register("quality_columns", "DQ-5 DQ-6 DQ-7", _flags_sql())
def quality_columns(spark, sf_dir):
    return quality.column_flags(quality.column_pass(customer_dq(spark, sf_dir)))


def _score_sql() -> str:
    miss = _missing_sql().split("WITH d AS", 1)[1]
    return (f"WITH d AS {miss.rsplit(' SELECT *,', 1)[0]}, "
            "mp AS (SELECT CASE WHEN percent > 30 THEN 10 WHEN percent > 5 THEN 3 ELSE 0 END AS p FROM m), "
            f"g AS (SELECT count(*) AS c FROM d GROUP BY {_LI_COLS}), "
            "dp AS (SELECT CASE WHEN sum(c - 1) > 0 THEN 5 ELSE 0 END AS p FROM g), "
            + _score_outlier_cte() + ", "
            + _score_flags_cte() + ", "
            "tot AS (SELECT (SELECT sum(p) FROM mp) + (SELECT sum(p) FROM dp) + (SELECT coalesce(sum(p), 0) FROM op)"
            " + (SELECT coalesce(sum(p), 0) FROM ip) + (SELECT sum(p) FROM fp) AS p) "
            "SELECT CAST(greatest(0, least(100, 100 - p)) AS BIGINT) AS overall_score,"
            " CASE WHEN 100 - p >= 90 THEN 'A' WHEN 100 - p >= 75 THEN 'B' WHEN 100 - p >= 60 THEN 'C' ELSE 'D' END"
            " AS grade, CASE WHEN 100 - p >= 90 THEN 'Dataset is research-grade quality.'"
            " WHEN 100 - p >= 75 THEN 'Minor cleaning recommended before analysis.'"
            " WHEN 100 - p >= 60 THEN 'Significant data cleaning required.'"
            " ELSE 'Major data quality issues — review before any analysis.' END AS recommendation FROM tot")


_LI_NUM = [c for c, t in _LI_TYPES.items() if t != "string"]
_LI_TXT = [c for c, t in _LI_TYPES.items() if t == "string"]


def _score_outlier_cte() -> str:
    per = " UNION ALL ".join(
        f"SELECT count_if({c} < q1 - 3 * (q3 - q1) OR {c} > q3 + 3 * (q3 - q1)) AS o, count({c}) AS n, q3 - q1 AS iqr"
        f" FROM d, (SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3 FROM d) GROUP BY q1, q3"
        for c in _LI_NUM)
    return (f"op AS (SELECT CASE WHEN round(o / n * 100, 1) > 5 THEN 3 ELSE 0 END AS p FROM ({per})"
            " WHERE iqr <> 0 AND o > 0)")


def _score_flags_cte() -> str:
    imb = " UNION ALL ".join(
        f"SELECT count(*) AS k, max(n) AS top, min(n) AS bottom FROM (SELECT count(*) AS n FROM d"
        f" WHERE {c} IS NOT NULL GROUP BY {c})" for c in _LI_TXT)
    flags = " UNION ALL ".join(f"SELECT CASE WHEN count(DISTINCT {c}) <= 1 THEN 5 ELSE 0 END AS p FROM d"
                               for c in _LI_TYPES)
    return (f"ip AS (SELECT 5 AS p FROM ({imb}) WHERE k >= 2 AND round(top / bottom, 1) > 10), "
            f"fp AS ({flags})")


@register("quality_score", "DQ-8", _score_sql())
def quality_score(spark, sf_dir):
    return quality.run_quality_check(lineitem_dq(spark, sf_dir)).score
