"""Rules, comparison, survival and trend queries (RUL, CMP, SRV, TRD)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import r4
from ..operators import rules, survival, trend
from .base import LINEITEM_NUM, register, table

# ---------------------------------------------------------------- alert rules

ORDER_RULES = [
    {"name": "Very large order", "column": "o_totalprice", "operator": ">", "value": 400000, "severity": "critical"},
    {"name": "Small order", "column": "o_totalprice", "operator": "<", "value": 10000, "severity": "warning"},
    {"column": "o_totalprice", "operator": ">=", "value": 250000, "severity": "info", "action": "Log"},
    {"column": "o_custkey", "operator": "==", "value": 899},
    {"column": "o_custkey", "operator": "!=", "value": 899, "severity": "info"},
    {"column": "o_orderstatus", "operator": "<=", "value": 1},
    {"column": "no_such_column", "operator": ">", "value": 1},
]


def _rule_sql(r: dict, i: int) -> str:
    c, op, v = r["column"], r["operator"], float(r["value"])
    sql_op = {"==": "=", "!=": "<>"}.get(op, op)
    name = r.get("name") or f"{c} {op} {r['value']}"
    v_col = f"TRY_CAST({c} AS DOUBLE)"
    return (f"SELECT {i} AS rule_id, '{name}' AS name, '{c}' AS \"column\", '{op}' AS operator, {v}::DOUBLE AS value,"
            f" '{r.get('severity', 'warning')}' AS severity, '{r.get('action', 'Review required')}' AS action,"
            f" coalesce(count_if({v_col} {sql_op} {v}), 0) AS n_triggered, count({v_col}) AS n_total,"
            f" round(CASE WHEN count({v_col}) > 0 THEN count_if({v_col} {sql_op} {v}) / count({v_col}) * 100"
            f" ELSE 0.0 END, 4) AS percent,"
            f" CASE WHEN count_if({v_col} {sql_op} {v}) > 0 THEN 'TRIGGERED' ELSE 'CLEAR' END AS status,"
            f" round(avg({v_col}), 4) AS col_mean, round(max({v_col}), 4) AS col_max FROM src")


def _rules_sql(rule_list, src_sql: str, columns) -> str:
    parts = [_rule_sql(r, i) for i, r in enumerate(rule_list) if r["column"] in columns]
    return f"WITH src AS ({src_sql}) " + " UNION ALL ".join(parts)


_ORDERS_COLS = ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")
RULES_EVAL_SQL = _rules_sql(ORDER_RULES, "SELECT * FROM orders", _ORDERS_COLS)


def _rounded(df):
    return df.select(*[r4(F.col(c)).alias(c) if t == "double" and c != "value" else F.col(c)
                       for c, t in df.dtypes])


@register("rules_eval", "RUL-1", RULES_EVAL_SQL)
def rules_eval(spark, sf_dir):
    return _rounded(rules.evaluate_rules(table(spark, sf_dir, "orders"), ORDER_RULES))


RULES_MANY_SQL = (
    "WITH r AS (SELECT CAST(c_custkey AS INTEGER) AS rule_id, CASE c_custkey % 6 WHEN 0 THEN '>' WHEN 1 THEN '<'"
    " WHEN 2 THEN '>=' WHEN 3 THEN '<=' WHEN 4 THEN '==' ELSE '!=' END AS operator,"
    " CASE WHEN c_custkey % 2 = 0 THEN 'o_totalprice' ELSE 'o_custkey' END AS col,"
    " CASE WHEN c_custkey % 2 = 0 THEN c_acctbal * 30 ELSE CAST(c_custkey AS DOUBLE) END AS value FROM customer),"
    " v AS (SELECT 'o_totalprice' AS col, CAST(o_totalprice AS DOUBLE) AS v FROM orders"
    " UNION ALL SELECT 'o_custkey', CAST(o_custkey AS DOUBLE) FROM orders),"
    " g AS (SELECT col, v, count(*) AS n FROM v GROUP BY col, v),"
    " t AS (SELECT col, sum(n) AS n_total FROM g GROUP BY col)"
    " SELECT rule_id, col AS \"column\", operator, round(value, 4) AS value,"
    " CAST(coalesce(sum(n) FILTER (CASE operator WHEN '>' THEN v > value WHEN '<' THEN v < value WHEN '>=' THEN v >= value"
    " WHEN '<=' THEN v <= value WHEN '==' THEN v = value ELSE v <> value END), 0) AS BIGINT) AS n_triggered,"
    " CAST(any_value(n_total) AS BIGINT) AS n_total FROM r JOIN g USING (col) JOIN t USING (col)"
    " GROUP BY rule_id, col, operator, value")


@register("rules_many", "RUL-1", RULES_MANY_SQL)
def rules_many(spark, sf_dir):
    """A rule for every customer, the rules being a table themselves."""
    price = F.col("c_custkey") % 2 == 0
    op = F.element_at(F.array(*[F.lit(o) for o in rules.OPERATORS]), (F.col("c_custkey") % 6 + 1).cast("int"))
    known = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").cast("int").alias("rule_id"), F.lit("customer rule").alias("name"),
        F.when(price, "o_totalprice").otherwise("o_custkey").alias("column"), op.alias("operator"),
        F.when(price, F.col("c_acctbal") * 30).otherwise(F.col("c_custkey").cast("double")).alias("value"),
        F.lit("info").alias("severity"), F.lit("").alias("action"))
    out = rules.evaluate_rules_table(table(spark, sf_dir, "orders"), known)
    return out.select("rule_id", "column", "operator", r4(F.col("value")).alias("value"), "n_triggered", "n_total")


@register("rules_rows", "RUL-2",
          "WITH h AS (" + " UNION ALL ".join(
              f"SELECT {i} AS rule_id, o_orderkey FROM orders WHERE TRY_CAST({r['column']} AS DOUBLE)"
              f" {({'==': '=', '!=': '<>'}).get(r['operator'], r['operator'])} {float(r['value'])}"
              for i, r in enumerate(ORDER_RULES) if r["column"] in _ORDERS_COLS)
          + ") SELECT rule_id, CAST(rn AS INTEGER) AS rank, o_orderkey FROM (SELECT *, row_number() OVER"
            " (PARTITION BY rule_id ORDER BY o_orderkey) AS rn FROM h) WHERE rn <= 10")
def rules_rows(spark, sf_dir):
    return rules.triggered_rows(table(spark, sf_dir, "orders"), ORDER_RULES, ["o_orderkey"])


@register("rules_status", "RUL-3",
          f"WITH e AS ({RULES_EVAL_SQL}) SELECT count(*) AS rules_evaluated,"
          " count_if(status = 'TRIGGERED' AND severity = 'critical') AS critical_alerts,"
          " count_if(status = 'TRIGGERED' AND severity = 'warning') AS warning_alerts,"
          " count_if(status = 'TRIGGERED' AND severity = 'info') AS info_alerts,"
          " count_if(status = 'TRIGGERED' AND severity IN ('critical', 'warning')) = 0 AS all_clear,"
          " CASE WHEN count_if(status = 'TRIGGERED' AND severity IN ('critical', 'warning')) = 0 THEN 'ALL_CLEAR'"
          " WHEN count_if(status = 'TRIGGERED' AND severity = 'critical') > 0 THEN 'CRITICAL' ELSE 'WARNING' END"
          " AS overall_status FROM e")
def rules_status(spark, sf_dir):
    return rules.rollup_status(rules.evaluate_rules(table(spark, sf_dir, "orders"), ORDER_RULES))


# Clinical column names over lineitem measures, so the name patterns of the
# suggestion table have something to match.
VITALS_SQL = ("SELECT l_orderkey, l_quantity AS age, l_quantity AS bmi, l_discount * 1000 AS heart_rate,"
              " l_extendedprice / 300 AS \"Total-Cholesterol\", l_tax * 1000 AS oxygen FROM lineitem")


def _vitals(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    return li.select("l_orderkey", F.col("l_quantity").alias("age"), F.col("l_quantity").alias("bmi"),
                     (F.col("l_discount") * 1000).alias("heart_rate"),
                     (F.col("l_extendedprice") / 300).alias("Total-Cholesterol"),
                     (F.col("l_tax") * 1000).alias("oxygen"))


_VITAL_COLS = ("l_orderkey", "age", "bmi", "heart_rate", "Total-Cholesterol", "oxygen")


def _suggest_sql() -> str:
    sug = rules.suggest_rules(_VITAL_COLS)
    parts = []
    for i, r in enumerate(sug):
        s = _rule_sql({**r, "column": f'"{r["column"]}"'}, i)
        s = s.replace(f"'\"{r['column']}\"' AS \"column\"", f"'{r['column']}' AS \"column\"")
        parts.append(s)
    return f"WITH src AS ({VITALS_SQL}) " + " UNION ALL ".join(parts)


@register("rules_suggest", "RUL-4 RUL-1", _suggest_sql())
def rules_suggest(spark, sf_dir):
    df = _vitals(spark, sf_dir)
    return _rounded(rules.evaluate_rules(df, rules.suggest_rules(df.columns)))


# ---------------------------------------------------------------- comparison

_CMP_COLS = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", *LINEITEM_NUM, "l_returnflag")


def _normal_sql(t: str) -> str:
    z, u = f"(abs({t}) / sqrt(2.0))", f"(1 / (1 + abs({t}) / sqrt(2.0) / 2))"
    poly = " + ".join(f"({c!r}) * {u} ** {i}" for i, c in enumerate(rules.ERFC_TERMS))
    return f"{u} * exp({poly} - {z} * {z})"


def _compare_sql() -> str:
    parts = []
    for i, c in enumerate(_CMP_COLS):
        v = f"TRY_CAST({c} AS DOUBLE)"
        parts.append(
            f"SELECT '{c}' AS \"column\", {i} AS position,"
            f" (SELECT count(*) FROM a) AS rows_a, (SELECT count(*) FROM b) AS rows_b,"
            f" (SELECT count({v}) FROM a) AS n_a, (SELECT count({v}) FROM b) AS n_b,"
            f" (SELECT avg({v}) FROM a) AS ma, (SELECT avg({v}) FROM b) AS mb,"
            f" (SELECT stddev_samp({v}) FROM a) AS sa, (SELECT stddev_samp({v}) FROM b) AS sb")
    s = " UNION ALL ".join(parts)
    return (
        "WITH a AS (SELECT * FROM lineitem WHERE l_linestatus = 'O'), b AS (SELECT * FROM lineitem WHERE"
        f" l_linestatus = 'F'), s AS ({s}), d AS (SELECT *, coalesce(nullif(sqrt((sa*sa + sb*sb) / 2), 0), 1) AS pooled,"
        " sqrt(sa*sa / n_a + sb*sb / n_b) AS se FROM s WHERE n_a >= 3 AND n_b >= 3),"
        " t AS (SELECT *, (ma - mb) / pooled AS cd, CASE WHEN se > 0 THEN (ma - mb) / se ELSE 0.0 END AS ts FROM d),"
        " p AS (SELECT *, 2 * (1 - least(abs(ts) / (abs(ts) + 3), 0.999)) AS pa FROM t)"
        " SELECT \"column\", position, rows_a, rows_b, n_a, n_b, round(ma, 4) AS mean_a, round(mb, 4) AS mean_b,"
        " round(sa, 4) AS std_a, round(sb, 4) AS std_b, round(ma - mb, 4) + 0.0 AS mean_diff,"
        " round(CASE WHEN mb <> 0 THEN (ma - mb) / abs(mb) * 100 ELSE 0.0 END, 4) + 0.0 AS mean_diff_pct,"
        " round(cd, 4) + 0.0 AS cohens_d, CASE WHEN abs(cd) > 0.8 THEN 'large' WHEN abs(cd) > 0.5 THEN 'medium'"
        " WHEN abs(cd) > 0.2 THEN 'small' ELSE 'negligible' END AS effect_size, round(ts, 4) + 0.0 AS t_stat,"
        f" round(pa, 4) AS p_approx, round(least({_normal_sql('ts')}, 1), 4) AS p_normal, pa < 0.05 AS significant,"
        " CASE WHEN ma > mb THEN 'A_higher' WHEN mb > ma THEN 'B_higher' ELSE 'equal' END AS direction FROM p")


@register("compare_datasets", "CMP-1 CMP-2", _compare_sql())
def compare_datasets(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select(*_CMP_COLS, "l_linestatus")
    a = li.where(F.col("l_linestatus") == "O").drop("l_linestatus")
    b = li.where(F.col("l_linestatus") == "F").drop("l_linestatus")
    return _rounded(rules.compare_datasets(a, b))


# ---------------------------------------------------------------- survival

SURV_BASE_SQL = (
    "SELECT l_linestatus AS grp, CAST(abs(date_diff('day', o_orderdate, l_shipdate)) AS DOUBLE) AS t,"
    " CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END AS e"
    " FROM lineitem JOIN orders ON l_orderkey = o_orderkey")

SURV_CURVE_SQL = (
    f"WITH base AS ({SURV_BASE_SQL}),"
    " agg AS (SELECT grp, t, count(*) AS n_t, sum(e) AS d, max(CASE WHEN e = 1 THEN 1 ELSE 0 END) AS has_event"
    " FROM base GROUP BY grp, t),"
    " rk AS (SELECT *, sum(n_t) OVER (PARTITION BY grp ORDER BY t DESC ROWS BETWEEN UNBOUNDED PRECEDING AND"
    " CURRENT ROW) AS at_risk FROM agg),"
    " ev AS (SELECT *, product(1 - d / at_risk) OVER (PARTITION BY grp ORDER BY t ROWS BETWEEN UNBOUNDED"
    " PRECEDING AND CURRENT ROW) AS s FROM rk WHERE has_event = 1),"
    " curve AS (SELECT grp, t, at_risk, CAST(d AS BIGINT) AS deaths, s,"
    " least(s + 1.96 * sqrt(s * (1 - s) / greatest(at_risk, 1)), 1.0) AS up,"
    " greatest(s - 1.96 * sqrt(s * (1 - s) / greatest(at_risk, 1)), 0.0) AS lo, false AS is_start FROM ev"
    " UNION ALL SELECT grp, 0.0, count(*), 0, 1.0, 1.0, 1.0, true FROM base GROUP BY grp)"
    " SELECT grp AS \"group\", round(t, 4) AS t, CAST(at_risk AS BIGINT) AS at_risk, deaths,"
    " round(s, 4) AS survival, round(up, 4) AS ci_upper, round(lo, 4) AS ci_lower, is_start FROM curve")


def _surv_rows(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    o = table(spark, sf_dir, "orders")
    # Order and shipping dates are drawn independently: the distance between
    # them is a duration for every row.
    days = F.abs(F.datediff(F.to_date("l_shipdate"), F.to_date("o_orderdate")))
    return li.join(o, li.l_orderkey == o.o_orderkey).select(
        "l_linestatus", days.alias("duration"), (F.col("l_returnflag") == "R").cast("int").alias("event"))


@register("survival_curve", "SRV-1 SRV-2", SURV_CURVE_SQL)
def survival_curve(spark, sf_dir):
    rows = survival.survival_input(_surv_rows(spark, sf_dir), "duration", "event", "l_linestatus")
    c = survival.km_curve(rows)
    return c.select("group", r4(F.col("t")).alias("t"), "at_risk", "deaths",
                    *[r4(F.col(x)).alias(x) for x in ("survival", "ci_upper", "ci_lower")], "is_start")


@register("survival_median", "SRV-3",
          SURV_CURVE_SQL.rsplit(" SELECT grp AS", 1)[0]
          + " SELECT grp AS \"group\", round(min(CASE WHEN NOT is_start AND round(s, 4) <= 0.5 THEN t END), 4)"
            " AS median_survival FROM curve GROUP BY grp")
def survival_median(spark, sf_dir):
    rows = survival.survival_input(_surv_rows(spark, sf_dir), "duration", "event", "l_linestatus")
    m = survival.median_survival(survival.km_curve(rows))
    return m.select("group", r4(F.col("median_survival")).alias("median_survival"))


@register("survival_summary", "SRV-4",
          f"WITH base AS ({SURV_BASE_SQL}) SELECT count(*) AS n_total, CAST(sum(e) AS BIGINT) AS n_events,"
          " count_if(e = 0) AS n_censored, round(CAST(sum(e) AS BIGINT) / count(*) * 100, 1) AS event_rate FROM base")
def survival_summary(spark, sf_dir):
    rows = survival.survival_input(_surv_rows(spark, sf_dir), "duration", "event", "l_linestatus")
    return survival.event_summary(rows)


# ---------------------------------------------------------------- trend

TREND_BASE_SQL = (
    "SELECT user_id, event_id, 'value' AS \"column\", value,"
    " row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS idx,"
    " count(*) OVER (PARTITION BY user_id) AS n FROM events WHERE value IS NOT NULL")

TREND_FIT_SQL = (
    f"WITH b AS ({TREND_BASE_SQL}) SELECT user_id, \"column\", count(*) AS n,"
    " round(regr_slope(value, idx), 4) + 0.0 AS slope, round(regr_intercept(value, idx), 4) AS intercept,"
    " round(regr_r2(value, idx), 4) AS r2,"
    " CASE WHEN coalesce(regr_slope(value, idx), 0) > 0 THEN 'increasing'"
    " WHEN coalesce(regr_slope(value, idx), 0) < 0 THEN 'decreasing' ELSE 'stable' END AS direction,"
    " round(arg_min(value, idx), 4) AS first, round(arg_max(value, idx), 4) AS last,"
    " round(CASE WHEN abs(arg_min(value, idx)) > 0.001 THEN"
    " round((arg_max(value, idx) - arg_min(value, idx)) / abs(arg_min(value, idx)) * 100, 2) ELSE 0.0 END, 4)"
    " AS change_pct FROM b GROUP BY user_id, \"column\"")


def _trend(spark, sf_dir):
    ev = table(spark, sf_dir, "events")
    ti = trend.trend_input(ev, ["value"], ["ts", "event_id"], ["user_id"])
    return ti, trend.linear_trend(ti)


@register("trend_fit", "TRD-1 TRD-5", TREND_FIT_SQL)
def trend_fit(spark, sf_dir):
    _, fit = _trend(spark, sf_dir)
    return fit.select("user_id", "column", "n", *[r4(F.col(c)).alias(c) for c in ("slope", "intercept", "r2")],
                      "direction", *[r4(F.col(c)).alias(c) for c in ("first", "last", "change_pct")])


@register("trend_lines", "TRD-2 TRD-3",
          f"WITH b AS ({TREND_BASE_SQL}),"
          " f AS (SELECT user_id, regr_slope(value, idx) AS slope, regr_intercept(value, idx) AS intercept"
          " FROM b GROUP BY user_id),"
          " r AS (SELECT b.*, slope, intercept, greatest(3, n // 10) AS w FROM b JOIN f USING (user_id)),"
          " r2 AS (SELECT *, (w - 1) // 2 AS o FROM r),"
          " r3 AS (SELECT *, least(greatest(idx, w - 1 - o), n - 1 - o) AS c FROM r2),"
          " ma AS (SELECT r3.user_id, r3.event_id, ((2 * CAST(sum(CAST(x.value AS DECIMAL(38, 10))) * 10000000000 AS HUGEINT)"
          " + r3.w * 1000000) // (2 * r3.w * 1000000)) / 10000.0 AS m FROM r3 JOIN b x ON x.user_id = r3.user_id"
          " AND x.idx BETWEEN r3.c - (r3.w - 1 - r3.o) AND r3.c + r3.o WHERE r3.n >= r3.w"
          " GROUP BY r3.user_id, r3.event_id, r3.w)"
          " SELECT r3.user_id, r3.event_id, \"column\", idx, round(value, 4) AS value,"
          " round(slope * idx + intercept, 4) AS fitted, CAST(m AS DOUBLE) AS moving_avg"
          " FROM r3 LEFT JOIN ma USING (user_id, event_id)")
def trend_lines(spark, sf_dir):
    ti, fit = _trend(spark, sf_dir)
    out = trend.trend_lines(ti, fit)
    # Frame means of cent values hit exact .5 ties at the 5th decimal; round
    # the exact decimal mean (half-up) instead of its double.
    return out.select("user_id", "event_id", "column", "idx",
                      *[r4(F.col(c)).alias(c) for c in ("value", "fitted")],
                      F.round(F.col("moving_sum") / F.col("window"), 4).cast("double").alias("moving_avg"))


@register("trend_forecast", "TRD-4",
          f"WITH b AS ({TREND_BASE_SQL}), f AS (SELECT user_id, \"column\", count(*) AS n,"
          " regr_slope(value, idx) AS slope, regr_intercept(value, idx) AS intercept FROM b GROUP BY ALL)"
          " SELECT user_id, \"column\", x, round(slope * x + intercept, 4) AS forecast"
          " FROM f, range(n, n + 10) r(x)")
def trend_forecast(spark, sf_dir):
    _, fit = _trend(spark, sf_dir)
    out = trend.forecast(fit, ["user_id"])
    return out.select("user_id", "column", "x", r4(F.col("forecast")).alias("forecast"))


@register("trend_corr", "TRD-6",
          " UNION ALL ".join(
              f"SELECT '{a}' AS column_a, '{b}' AS column_b, round(corr({a}, {b}), 4) AS corr FROM lineitem"
              for i, a in enumerate(LINEITEM_NUM) for b in LINEITEM_NUM[i + 1:]))
def trend_corr(spark, sf_dir):
    out = trend.correlation_matrix(table(spark, sf_dir, "lineitem"), LINEITEM_NUM)
    return out.select("column_a", "column_b", r4(F.col("corr")).alias("corr"))





# ---------------------------------------------------------------- rules on a stream (batch twin)

EVENT_RULES = [
    {"name": "High value", "column": "value", "operator": ">", "value": 300, "severity": "critical"},
    {"name": "Tiny value", "column": "value", "operator": "<", "value": 1, "severity": "warning"},
    {"column": "user_id", "operator": "==", "value": 7, "severity": "info"},
]


def _event_rules_sql() -> str:
    parts = []
    for i, r in enumerate(EVENT_RULES):
        op = {"==": "=", "!=": "<>"}.get(r["operator"], r["operator"])
        name = r.get("name") or f"{r['column']} {r['operator']} {r['value']}"
        parts.append(f"SELECT ts, {i} AS rule_id, '{name}' AS name, '{r.get('severity', 'warning')}' AS severity"
                     f" FROM events WHERE TRY_CAST({r['column']} AS DOUBLE) {op} {float(r['value'])}")
    return ("SELECT strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H:%M:%S') AS window_start, rule_id, name,"
            " severity, count(*) AS n_triggered FROM (" + " UNION ALL ".join(parts) + ") GROUP BY ALL")


@register("rules_stream_windows", "RUL-5", _event_rules_sql())
def rules_stream_windows(spark, sf_dir):
    from ..streaming.rules_stream import rule_window_counts
    out = rule_window_counts(table(spark, sf_dir, "events"), EVENT_RULES, "ts")
    return out.select(F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"),
                      "rule_id", "name", "severity", "n_triggered")


@register("rules_stream_run", "RUL-5", _event_rules_sql())
def rules_stream_run(spark, sf_dir):
    """The stream itself, drained once over the events."""
    import uuid

    from ..session import ensure_checkpoint_dir
    from ..streaming.rules_stream import run_rules_stream
    out = run_rules_stream(spark, f"{sf_dir.rstrip('/')}/events.parquet", EVENT_RULES, "ts",
                           f"{ensure_checkpoint_dir(spark).rstrip('/')}/rules-{uuid.uuid4().hex}")
    return out.select(F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"),
                      "rule_id", "name", "severity", "n_triggered")


# Events arrive in four parts of equal time; the sign-ups of the first day come
# with the last part, long after their windows closed.
_LATE_SQL = ("WITH b AS (SELECT epoch_us(min(ts)) AS lo, epoch_us(max(ts)) AS hi FROM events), kept AS ("
             "SELECT e.* FROM events e, b WHERE NOT (event_type = 'signup' AND epoch_us(ts) < lo + 86400000000)), c AS ("
             + _event_rules_sql().replace("strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H:%M:%S')",
                                          "time_bucket(INTERVAL 1 HOUR, ts)").replace("FROM events", "FROM kept")
             + ") SELECT strftime(window_start, '%Y-%m-%d %H:%M:%S') AS window_start, rule_id, name, severity,"
               " n_triggered FROM c, b WHERE epoch_us(window_start) + 3600000000 <= hi - 7200000000")


@register("rules_stream_late", "RUL-5", _LATE_SQL)
def rules_stream_late(spark, sf_dir):
    """Append mode with a watermark of two hours over four parts, each a new
    start from the checkpoint; rows that come after their window are left out."""
    import uuid

    from ..session import ensure_checkpoint_dir
    from ..streaming.rules_stream import feed_rules_stream
    events = table(spark, sf_dir, "events")
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    lo, hi = events.agg(F.min(us), F.max(us)).first()
    late = (F.col("event_type") == "signup") & (us < lo + 86_400_000_000)
    part = F.when(late, 3).otherwise(F.least(F.floor((us - lo) * 4 / (hi - lo + 1)), F.lit(3)))
    out = feed_rules_stream([events.where(part == i) for i in range(4)], EVENT_RULES, "ts",
                            f"{ensure_checkpoint_dir(spark).rstrip('/')}/rules-{uuid.uuid4().hex}")
    return out.select(F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"),
                      "rule_id", "name", "severity", "n_triggered")


@register("compare_summary", "CMP-2",
          "WITH c AS (" + _compare_sql() + ") SELECT count(*) AS n_compared, max(rows_a) AS rows_a,"
          " max(rows_b) AS rows_b, count_if(significant AND effect_size IN ('medium', 'large')) AS n_significant,"
          " coalesce(string_agg(CASE WHEN significant AND effect_size IN ('medium', 'large') THEN \"column\" END,"
          " ', ' ORDER BY position), '') AS significant_columns FROM c")
def compare_summary(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select(*_CMP_COLS, "l_linestatus")
    a = li.where(F.col("l_linestatus") == "O").drop("l_linestatus")
    b = li.where(F.col("l_linestatus") == "F").drop("l_linestatus")
    return rules.comparison_summary(rules.compare_datasets(a, b))
