"""Risk engine queries on lineitem (RSK-1, 2, 4, 5, 6)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import r4
from ..operators import risk
from .base import LINEITEM_KEY, LINEITEM_NUM, register, table

_KEYS = ", ".join(LINEITEM_KEY)


def _complete(cols) -> str:
    return " AND ".join(f"{c} IS NOT NULL AND NOT isnan(CAST({c} AS DOUBLE))" for c in cols)


_COMPLETE = _complete(LINEITEM_NUM)


def _stats_cte(tbl: str = "lineitem", cols=LINEITEM_NUM) -> str:
    parts = []
    for i, c in enumerate(cols):
        parts.append(f"avg({c}) AS m{i}, coalesce(nullif(stddev_samp({c}), 0), 1) AS s{i}")
    return (f"w AS (SELECT * FROM {tbl} WHERE {_complete(cols)}), "
            f"s AS (SELECT {', '.join(parts)} FROM w)")


def _thresholds_sql(tbl: str = "lineitem", cols=LINEITEM_NUM) -> str:
    rows = []
    for i, c in enumerate(cols):
        rows.append(f"SELECT '{c}' AS \"column\", round(m{i}, 3) AS mean, round(s{i}, 3) AS std, "
                    f"round(m{i} + 2 * s{i}, 3) AS high, round(m{i} + 3 * s{i}, 3) AS critical_high, "
                    f"round(m{i} - 2 * s{i}, 3) AS low FROM s")
    return f"WITH {_stats_cte(tbl, cols)}, t AS ({' UNION ALL '.join(rows)}) SELECT * FROM t"


def _score_sql(tbl: str = "lineitem", cols=LINEITEM_NUM, keys=LINEITEM_KEY) -> str:
    terms = []
    for i, c in enumerate(cols):
        terms.append(f"least(abs(({c} - t{i}m) / coalesce(nullif(t{i}s, 0), 1)), 3)")
    rnd = ", ".join(f"round(m{i}, 3) AS t{i}m, round(s{i}, 3) AS t{i}s" for i in range(len(cols)))
    n = float(len(cols))
    return (f"WITH {_stats_cte(tbl, cols)}, r AS (SELECT {rnd} FROM s), "
            f"sc AS (SELECT {', '.join(keys)}, least(round(({' + '.join(terms)}) / {n} / 3.0 * 100.0, 1), 100.0) "
            f"AS risk_score FROM w CROSS JOIN r)")


RISK_THRESHOLDS_SQL = _thresholds_sql()

RISK_TOP_SQL = _score_sql() + f" SELECT * FROM sc ORDER BY risk_score DESC, {_KEYS} LIMIT 10"

RISK_DISTRIBUTION_SQL = _score_sql() + (
    " SELECT count_if(risk_score > 60) AS high_risk_count, count(*) AS total,"
    " round(count_if(risk_score > 60) / greatest(count(*), 1) * 100, 4) AS high_risk_percent FROM sc")


def _alerts_sql(tbl: str = "lineitem", cols=LINEITEM_NUM) -> str:
    th = _thresholds_sql(tbl, cols).rsplit(" SELECT * FROM t", 1)[0]
    per_col = []
    for c in cols:
        per_col.append(
            f"SELECT '{c}' AS \"column\", (SELECT count(*) FROM w) AS n,"
            f" count_if({c} > (SELECT critical_high FROM t WHERE \"column\" = '{c}')) AS crit,"
            f" count_if({c} > (SELECT high FROM t WHERE \"column\" = '{c}')) AS hi,"
            f" count_if({c} < (SELECT low FROM t WHERE \"column\" = '{c}')) AS lo FROM w")
    return (f"{th}, c AS ({' UNION ALL '.join(per_col)}) "
            "SELECT \"column\", CASE WHEN crit > 0 THEN 'CRITICAL' ELSE 'WARNING' END AS level,"
            " CASE WHEN crit > 0 THEN crit ELSE hi END AS count,"
            " round(CASE WHEN crit > 0 THEN crit ELSE hi END / n * 100, 4) AS percent"
            " FROM c WHERE crit > 0 OR hi > 0"
            " UNION ALL SELECT \"column\", 'LOW', lo, round(lo / n * 100, 4) FROM c WHERE lo > 0")


RISK_ALERTS_SQL = _alerts_sql()


def _change_sql() -> str:
    order = ", ".join(f"{k} DESC" for k in LINEITEM_KEY)
    parts = []
    for i, c in enumerate(LINEITEM_NUM[:4]):
        parts.append(
            f"SELECT '{c}' AS \"column\", (SELECT avg({c}) FROM rec) AS r, (SELECT avg({c}) FROM w) AS o")
    return (f"WITH w AS (SELECT * FROM lineitem WHERE {_COMPLETE}), "
            f"rec AS (SELECT * FROM w ORDER BY {order} LIMIT 10), x AS ({' UNION ALL '.join(parts)}) "
            "SELECT \"column\", round(r, 4) AS recent_avg, round(o, 4) AS overall_avg,"
            " round(abs((r - o) / o * 100), 4) AS change_percent,"
            " CASE WHEN r > o THEN 'increasing' ELSE 'decreasing' END AS direction,"
            " abs((r - o) / o * 100) > 20 AS is_alert FROM x WHERE o <> 0 AND (SELECT count(*) FROM w) > 10")


RISK_CHANGE_SQL = _change_sql()


def _work(spark, sf_dir):
    return risk.prepare(table(spark, sf_dir, "lineitem"), LINEITEM_NUM)


@register("risk_thresholds", "RSK-1 PRJ-2", RISK_THRESHOLDS_SQL)
def risk_thresholds(spark, sf_dir):
    work, cols = _work(spark, sf_dir)
    return risk.threshold_table(work, cols)


@register("risk_alerts", "RSK-2", RISK_ALERTS_SQL)
def risk_alerts(spark, sf_dir):
    work, cols = _work(spark, sf_dir)
    a = risk.threshold_alerts(work, risk.thresholds(work, cols))
    return a.select("column", "level", "count", r4(F.col("percent")).alias("percent"))


def _scores(spark, sf_dir):
    work, cols = _work(spark, sf_dir)
    return risk.risk_scores(work, risk.thresholds(work, cols), LINEITEM_KEY)


@register("risk_top", "RSK-5 RSK-6 SRT-1", RISK_TOP_SQL)
def risk_top(spark, sf_dir):
    return risk.top_risk(_scores(spark, sf_dir), LINEITEM_KEY)


@register("risk_distribution", "RSK-6", RISK_DISTRIBUTION_SQL)
def risk_distribution(spark, sf_dir):
    d = risk.risk_distribution(_scores(spark, sf_dir))
    return d.select("high_risk_count", "total", r4(F.col("high_risk_percent")).alias("high_risk_percent"))


@register("risk_change", "RSK-4", RISK_CHANGE_SQL)
def risk_change(spark, sf_dir):
    work, cols = _work(spark, sf_dir)
    c = risk.change_alerts(work, cols, LINEITEM_KEY)
    return c.select("column", r4(F.col("recent_avg")).alias("recent_avg"),
                    r4(F.col("overall_avg")).alias("overall_avg"),
                    r4(F.col("change_percent")).alias("change_percent"), "direction", "is_alert")


@register("risk_change_by_user", "RSK-4",
          "WITH r AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC)"
          " AS rn FROM events WHERE value IS NOT NULL AND NOT isnan(value)),"
          " o AS (SELECT user_id, count(*) AS n, avg(value) AS o FROM events WHERE value IS NOT NULL"
          " AND NOT isnan(value) GROUP BY user_id),"
          " rc AS (SELECT user_id, avg(value) AS r FROM r WHERE rn <= 10 GROUP BY user_id)"
          " SELECT user_id, 'value' AS \"column\", round(r, 4) AS recent_avg, round(o, 4) AS overall_avg,"
          " round(abs((r - o) / o * 100), 4) AS change_percent,"
          " CASE WHEN r > o THEN 'increasing' ELSE 'decreasing' END AS direction,"
          " abs((r - o) / o * 100) > 20 AS is_alert FROM o JOIN rc USING (user_id) WHERE n > 10 AND o <> 0")
def risk_change_by_user(spark, sf_dir):
    work, cols = risk.prepare(table(spark, sf_dir, "events"), ["value"])
    c = risk.change_alerts_by(work, cols, ["ts", "event_id"], ["user_id"])
    return c.select("user_id", "column", r4(F.col("recent_avg")).alias("recent_avg"),
                    r4(F.col("overall_avg")).alias("overall_avg"),
                    r4(F.col("change_percent")).alias("change_percent"), "direction", "is_alert")



# The same engine on a heavy-tailed column, so the alert levels fire.
_DOC_NUM = ("n_chars",)


@register("risk_alerts_docs", "RSK-1 RSK-2", _alerts_sql("documents", _DOC_NUM))
def risk_alerts_docs(spark, sf_dir):
    work, cols = risk.prepare(table(spark, sf_dir, "documents"), _DOC_NUM)
    a = risk.threshold_alerts(work, risk.thresholds(work, cols))
    return a.select("column", "level", "count", r4(F.col("percent")).alias("percent"))


@register("risk_top_docs", "RSK-5 RSK-6 SRT-1",
          _score_sql("documents", _DOC_NUM, ("doc_id",)) + " SELECT * FROM sc ORDER BY risk_score DESC, doc_id LIMIT 10")
def risk_top_docs(spark, sf_dir):
    work, cols = risk.prepare(table(spark, sf_dir, "documents"), _DOC_NUM)
    return risk.top_risk(risk.risk_scores(work, risk.thresholds(work, cols), ["doc_id"]), ["doc_id"])
