"""Entity profile and similarity queries (PAT, SIM)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import r4
from ..operators import entity, risk, similarity
from .base import LINEITEM_KEY, LINEITEM_NUM, register, table
from .risk import RISK_TOP_SQL
from .tabular import LINEITEM_NULLS_SQL, lineitem_nulls

_KEYS = ", ".join(LINEITEM_KEY)
_FEATURES = ("l_quantity", "l_extendedprice", "l_discount")
_TARGET = "l_tax"
_NULLS_COLS = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
               "l_discount", "l_tax", "l_returnflag", "l_linestatus")


def _unpivot_sql(src: str, cols) -> str:
    return " UNION ALL ".join(f"SELECT {_KEYS}, '{c}' AS \"column\", CAST({c} AS DOUBLE) AS value FROM {src}"
                              for c in cols)


PROFILE_SQL = (
    f"WITH d AS ({LINEITEM_NULLS_SQL}), l AS ({_unpivot_sql('d', LINEITEM_NUM)}),"
    " s AS (SELECT \"column\", count(value) AS n, avg(value) AS mean, stddev_samp(value) AS std,"
    " coalesce(nullif(stddev_samp(value), 0), 1) AS s1, quantile_cont(value, 0.5) AS median FROM l GROUP BY 1),"
    " r AS (SELECT *, CASE WHEN value IS NOT NULL THEN rank() OVER (PARTITION BY \"column\" ORDER BY value) - 1 END"
    " AS below FROM l)"
    f" SELECT {_KEYS}, r.\"column\", round(value, 4) AS value, value IS NULL AS is_missing,"
    f" r.\"column\" IN ({', '.join(repr(c) for c in _FEATURES)}) AS is_feature, r.\"column\" = '{_TARGET}' AS is_target,"
    " round(below / n * 100, 4) AS percentile, round(mean, 4) AS mean, round(median, 4) AS median,"
    " round(std, 4) AS std, round((value - mean) / s1, 4) + 0.0 AS z_score, abs((value - mean) / s1) > 2.5 AS is_outlier,"
    " CASE WHEN (value - mean) / s1 > 0.5 THEN 'high' WHEN (value - mean) / s1 < -0.5 THEN 'low'"
    " WHEN value IS NOT NULL THEN 'normal' END AS direction FROM r JOIN s USING (\"column\")")


@register("profile_cells", "PAT-1 PAT-6", PROFILE_SQL)
def profile_cells(spark, sf_dir):
    cells = entity.profile_cells(lineitem_nulls(spark, sf_dir), LINEITEM_KEY, _FEATURES, _TARGET)
    dbl = ("value", "percentile", "mean", "median", "std", "z_score")
    return cells.select(*[r4(F.col(c)).alias(c) if c in dbl else F.col(c) for c in cells.columns])


_OTHERS = ("l_returnflag", "l_linestatus")
PROFILE_COLUMNS_SQL = (
    "SELECT " + _KEYS + ", \"column\", value, CAST(NULL AS VARCHAR) AS text_value, is_missing, is_feature, is_target,"
    f" percentile, mean, median, std, z_score, is_outlier, direction FROM ({PROFILE_SQL}) UNION ALL "
    + " UNION ALL ".join(
        f"SELECT {_KEYS}, '{c}', NULL, {c}, {c} IS NULL, {'true' if c == 'l_returnflag' else 'false'}, false, NULL, NULL,"
        f" NULL, NULL, NULL, NULL, NULL FROM ({LINEITEM_NULLS_SQL})" for c in _OTHERS))


@register("profile_columns", "PAT-1 PAT-6", PROFILE_COLUMNS_SQL)
def profile_columns(spark, sf_dir):
    """Every column of a row's profile, the text ones with their value and flags."""
    cells = entity.profile_cells(lineitem_nulls(spark, sf_dir), LINEITEM_KEY, (*_FEATURES, "l_returnflag"), _TARGET,
                                 other_columns=True)
    dbl = ("value", "percentile", "mean", "median", "std", "z_score")
    return cells.select(*[r4(F.col(c)).alias(c) if c in dbl else F.col(c) for c in cells.columns])


def _risk_profile_sql() -> str:
    terms, flags = [], []
    for i, c in enumerate(LINEITEM_NUM):
        z = f"abs(({c} - m{i}) / s{i})"
        terms.append(f"coalesce(least({z}, 3), 0)")
        flags.append(f"CASE WHEN {z} > 2.5 THEN '{c}' END")
    mom = ", ".join(f"avg({c}) AS m{i}, coalesce(nullif(stddev_samp({c}), 0), 1) AS s{i}"
                    for i, c in enumerate(LINEITEM_NUM))
    miss = " + ".join(f"CAST({c} IS NULL AS INTEGER)" for c in _NULLS_COLS)
    return (f"WITH d AS ({LINEITEM_NULLS_SQL}), m AS (SELECT {mom} FROM d),"
            f" x AS (SELECT {_KEYS}, round(least(({' + '.join(terms)}) / {float(len(LINEITEM_NUM))} / 3 * 100, 100.0), 1)"
            f" AS risk_score, concat_ws(', ', {', '.join(flags)}) AS oc, {miss} AS missing_count FROM d, m)"
            f" SELECT {_KEYS}, risk_score, CASE WHEN risk_score > 65 THEN 'HIGH' WHEN risk_score > 35 THEN 'MEDIUM'"
            " ELSE 'LOW' END AS risk_level, oc <> '' AS anomaly_flag,"
            " CASE WHEN oc <> '' THEN 'Outlier values in: ' || oc ELSE '' END AS anomaly_reason,"
            " oc AS outlier_columns, missing_count FROM x")


@register("profile_risk", "PAT-2 PAT-3", _risk_profile_sql())
def profile_risk(spark, sf_dir):
    out = entity.risk_profile(lineitem_nulls(spark, sf_dir), LINEITEM_KEY, LINEITEM_NUM)
    return out.withColumn("missing_count", F.col("missing_count").cast("int"))


# ---------------------------------------------------------------- similarity


def _label_centroids(spark, sf_dir):
    emb = table(spark, sf_dir, "embeddings")
    return emb, similarity.vector_centroids(emb, "embedding", "label")


SIM_VECTORS_SQL = (
    "WITH e AS (SELECT vec_id, label, CAST(unnest(embedding) AS DOUBLE) AS x,"
    " generate_subscripts(embedding, 1) AS d FROM embeddings),"
    " st AS (SELECT d, avg(x) AS m, coalesce(nullif(stddev_pop(x), 0), 1) AS s FROM e GROUP BY d),"
    " c AS (SELECT label, d, avg(x) AS cx FROM e GROUP BY label, d),"
    " q AS (SELECT dense_rank() OVER (ORDER BY label) - 1 AS query, label AS query_label, d, (cx - m) / s AS qz"
    " FROM c JOIN st USING (d)),"
    " z AS (SELECT vec_id, d, (x - m) / s AS z FROM e JOIN st USING (d)),"
    " dist AS (SELECT query, query_label, vec_id, sqrt(sum((z - qz) * (z - qz))) AS distance FROM z JOIN q USING (d)"
    " GROUP BY query, query_label, vec_id),"
    " top AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY distance, vec_id) AS rank FROM dist)"
    " SELECT CAST(query AS INTEGER) AS query, query_label, CAST(rank AS INTEGER) AS rank, vec_id,"
    " round(distance, 4) AS distance, round(greatest(0.0, 100 - distance * 15), 4) AS similarity_pct"
    " FROM top WHERE rank <= 5")


@register("similar_vectors", "SIM-1 SIM-2", SIM_VECTORS_SQL)
def similar_vectors(spark, sf_dir):
    emb, cents = _label_centroids(spark, sf_dir)
    out = similarity.nearest_vectors(emb, "embedding", ["vec_id"], [c for _, c in cents], k=5)
    labels = F.element_at(F.array(*[F.lit(lbl) for lbl, _ in cents]), F.col("query") + 1)
    return out.select("query", labels.alias("query_label"), "rank", "vec_id",
                      r4(F.col("distance")).alias("distance"), r4(F.col("similarity_pct")).alias("similarity_pct"))


def _flag_queries(spark, sf_dir):
    """Query points derived from the table: the mean point of each return
    flag (bounded by the number of flags)."""
    li = table(spark, sf_dir, "lineitem")
    rows = li.groupBy("l_returnflag").agg(*[F.avg(c).alias(c) for c in LINEITEM_NUM]) \
        .orderBy("l_returnflag").collect()
    return li, [r.asDict() for r in rows]


def _scalar_knn_sql() -> str:
    mom = ", ".join(f"avg({c}) AS m{i}, coalesce(nullif(stddev_pop({c}), 0), 1) AS s{i}"
                    for i, c in enumerate(LINEITEM_NUM))
    qv = ", ".join(f"avg({c}) AS q{i}" for i, c in enumerate(LINEITEM_NUM))
    dist = " + ".join(f"(({c} - m{i}) / s{i} - (q{i} - m{i}) / s{i}) * (({c} - m{i}) / s{i} - (q{i} - m{i}) / s{i})"
                      for i, c in enumerate(LINEITEM_NUM))
    return (f"WITH st AS (SELECT {mom} FROM lineitem),"
            f" qs AS (SELECT row_number() OVER (ORDER BY l_returnflag) - 1 AS query, * FROM"
            f" (SELECT l_returnflag, {qv} FROM lineitem GROUP BY l_returnflag)),"
            f" dd AS (SELECT query, {_KEYS}, {', '.join('lineitem.' + c for c in LINEITEM_NUM)},"
            f" sqrt({dist}) AS distance FROM lineitem, st, qs),"
            " top AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY distance, "
            f"{_KEYS}) AS rank FROM dd)")


SIM_SCALAR_SQL = (_scalar_knn_sql() +
                  f" SELECT CAST(query AS INTEGER) AS query, CAST(rank AS INTEGER) AS rank, {_KEYS},"
                  " round(distance, 4) AS distance, round(greatest(0.0, 100 - distance * 15), 4) AS similarity_pct, "
                  + ", ".join(f"round({c}, 3) AS {c}" for c in LINEITEM_NUM) + " FROM top WHERE rank <= 5")


@register("similar_rows", "SIM-1 SIM-2", SIM_SCALAR_SQL)
def similar_rows(spark, sf_dir):
    li, qs = _flag_queries(spark, sf_dir)
    out, _ = similarity.find_similar(li, LINEITEM_NUM, LINEITEM_KEY, qs, n_similar=5, with_values=True)
    return out.select("query", "rank", *LINEITEM_KEY, r4(F.col("distance")).alias("distance"),
                      r4(F.col("similarity_pct")).alias("similarity_pct"), *LINEITEM_NUM)


SIM_TABLE_SQL = (
    "WITH d AS (SELECT s_suppkey, s_acctbal AS x, CAST(s_nationkey AS DOUBLE) AS y FROM supplier),"
    " st AS (SELECT avg(x) AS mx, coalesce(nullif(stddev_pop(x), 0), 1) AS sx, avg(y) AS my,"
    " coalesce(nullif(stddev_pop(y), 0), 1) AS sy FROM d),"
    " q AS (SELECT c_custkey, c_acctbal AS qx, CAST(c_nationkey AS DOUBLE) AS qy FROM customer),"
    " dd AS (SELECT c_custkey, s_suppkey, x, y, sqrt(((x - mx) / sx - (qx - mx) / sx) * ((x - mx) / sx - (qx - mx) / sx)"
    " + ((y - my) / sy - (qy - my) / sy) * ((y - my) / sy - (qy - my) / sy)) AS distance FROM d, q, st),"
    " top AS (SELECT *, row_number() OVER (PARTITION BY c_custkey ORDER BY distance, s_suppkey) AS rank FROM dd)"
    " SELECT c_custkey, CAST(rank AS INTEGER) AS rank, s_suppkey, round(distance, 4) AS distance,"
    " round(greatest(0.0, 100 - distance * 15), 4) AS similarity_pct, round(x, 3) AS acctbal, round(y, 3) AS nationkey"
    " FROM top WHERE rank <= 3")


@register("similar_table", "SIM-1 SIM-2", SIM_TABLE_SQL)
def similar_table(spark, sf_dir):
    """For every customer the three nearest suppliers, with their values: a
    query table against a data table."""
    suppliers = table(spark, sf_dir, "supplier").selectExpr("s_suppkey", "s_acctbal AS acctbal", "s_nationkey AS nationkey")
    customers = table(spark, sf_dir, "customer").selectExpr("c_custkey", "c_acctbal AS acctbal", "c_nationkey AS nationkey")
    out = similarity.nearest_to_table(suppliers, ["acctbal", "nationkey"], ["s_suppkey"], customers, ["c_custkey"], 3, True)
    return out.select("c_custkey", "rank", "s_suppkey", r4(F.col("distance")).alias("distance"),
                      r4(F.col("similarity_pct")).alias("similarity_pct"), "acctbal", "nationkey")


def _cohort_sql() -> str:
    parts = []
    for i, c in enumerate(LINEITEM_NUM):
        parts.append(
            f"SELECT query, '{c}' AS feature, round((SELECT avg({c}) FROM lineitem), 4) AS population_mean,"
            f" round(avg(l.{c}), 4) AS cohort_mean, round(any_value(q{i}), 4) AS query_value,"
            f" round(any_value(q{i}) - (SELECT avg({c}) FROM lineitem), 4) + 0.0 AS diff_from_pop,"
            f" round((any_value(q{i}) - (SELECT avg({c}) FROM lineitem)) / greatest(abs((SELECT avg({c}) FROM lineitem)),"
            f" 0.001) * 100, 4) + 0.0 AS diff_pct FROM top JOIN lineitem l USING ({_KEYS}) JOIN qs USING (query)"
            " WHERE rank <= 5 GROUP BY query")
    return _scalar_knn_sql() + " SELECT CAST(query AS INTEGER) AS query, feature, population_mean, cohort_mean," \
        " query_value, diff_from_pop, diff_pct FROM (" + " UNION ALL ".join(parts) + ")"


@register("cohort_compare", "SIM-3", _cohort_sql())
def cohort_compare(spark, sf_dir):
    li, qs = _flag_queries(spark, sf_dir)
    nn, cols = similarity.find_similar(li, LINEITEM_NUM, LINEITEM_KEY, qs, n_similar=5)
    out = similarity.cohort_comparison(li, cols, LINEITEM_KEY, nn, qs)
    return out.select("query", "feature", *[r4(F.col(c)).alias(c) for c in (
        "population_mean", "cohort_mean", "query_value", "diff_from_pop", "diff_pct")])


def _self_sql() -> str:
    imp = ", ".join(f"coalesce({c}, (SELECT avg({c}) FROM d0)) AS {c}" for c in LINEITEM_NUM)
    mom = ", ".join(f"avg({c}) AS m{i}, coalesce(nullif(stddev_pop({c}), 0), 1) AS s{i}"
                    for i, c in enumerate(LINEITEM_NUM))
    dist = " + ".join(
        f"((d.{c} - m{i}) / s{i} - (q.{c} - m{i}) / s{i}) * ((d.{c} - m{i}) / s{i} - (q.{c} - m{i}) / s{i})"
        for i, c in enumerate(LINEITEM_NUM))
    same = " AND ".join(f"d.{k} = q.{k}" for k in LINEITEM_KEY)
    top_keys = RISK_TOP_SQL.replace("LIMIT 10", "LIMIT 5").replace(
        " SELECT * FROM sc ORDER BY", " , tk AS (SELECT * FROM sc ORDER BY")
    return (top_keys + "), tq AS (SELECT row_number() OVER (ORDER BY risk_score DESC, " + _KEYS + ") - 1 AS query, "
            + _KEYS + " FROM tk),"
            f" d0 AS ({LINEITEM_NULLS_SQL}), d AS (SELECT {_KEYS}, {imp} FROM d0), st AS (SELECT {mom} FROM d),"
            f" q AS (SELECT tq.query, d.* FROM tq JOIN d USING ({_KEYS})),"
            f" dd AS (SELECT q.query, {', '.join('d.' + k for k in LINEITEM_KEY)}, sqrt({dist}) AS distance"
            f" FROM d, q, st WHERE NOT ({same})),"
            f" top AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY distance, {_KEYS}) AS rank FROM dd)"
            f" SELECT CAST(query AS INTEGER) AS query, CAST(rank AS INTEGER) AS rank, {_KEYS},"
            " round(distance, 4) AS distance, round(greatest(0.0, 100 - distance * 15), 4) AS similarity_pct"
            " FROM top WHERE rank <= 4")


@register("similar_self", "PAT-5", _self_sql())
def similar_self(spark, sf_dir):
    work, cols = risk.prepare(table(spark, sf_dir, "lineitem"), LINEITEM_NUM)
    top = risk.top_risk(risk.risk_scores(work, risk.thresholds(work, cols), LINEITEM_KEY), LINEITEM_KEY, 5)
    keys = [tuple(r[k] for k in LINEITEM_KEY) for r in top.collect()]
    out = similarity.similar_rows(lineitem_nulls(spark, sf_dir), LINEITEM_NUM, LINEITEM_KEY, keys)
    return out.select("query", "rank", *LINEITEM_KEY, r4(F.col("distance")).alias("distance"),
                      r4(F.col("similarity_pct")).alias("similarity_pct"))


def _selected_sql() -> str:
    top_keys = RISK_TOP_SQL.replace("LIMIT 10", "LIMIT 5").replace(
        " SELECT * FROM sc ORDER BY", " , tk AS (SELECT * FROM sc ORDER BY")
    return (top_keys + f"), d AS ({LINEITEM_NULLS_SQL}), l AS ({_unpivot_sql('d', LINEITEM_NUM)}),"
            " cs AS (SELECT \"column\", count(value) AS n, avg(value) AS mean, stddev_samp(value) AS std,"
            " coalesce(nullif(stddev_samp(value), 0), 1) AS s1, quantile_cont(value, 0.5) AS median FROM l GROUP BY 1),"
            f" q AS (SELECT l.* FROM l JOIN tk USING ({_KEYS}))"
            f" SELECT {', '.join('q.' + k for k in LINEITEM_KEY)}, q.\"column\", round(q.value, 4) AS value,"
            " q.value IS NULL AS is_missing,"
            f" q.\"column\" IN ({', '.join(repr(c) for c in _FEATURES)}) AS is_feature,"
            f" q.\"column\" = '{_TARGET}' AS is_target,"
            " round(CASE WHEN q.value IS NOT NULL THEN (SELECT count(*) FROM l x WHERE x.\"column\" = q.\"column\""
            " AND x.value < q.value) / cs.n * 100 END, 4) AS percentile,"
            " round(mean, 4) AS mean, round(median, 4) AS median, round(std, 4) AS std,"
            " round((q.value - mean) / s1, 4) + 0.0 AS z_score, abs((q.value - mean) / s1) > 2.5 AS is_outlier,"
            " CASE WHEN (q.value - mean) / s1 > 0.5 THEN 'high' WHEN (q.value - mean) / s1 < -0.5 THEN 'low'"
            " WHEN q.value IS NOT NULL THEN 'normal' END AS direction FROM q JOIN cs USING (\"column\")")


@register("profile_selected", "PAT-1 PAT-6", _selected_sql())
def profile_selected(spark, sf_dir):
    work, cols = risk.prepare(table(spark, sf_dir, "lineitem"), LINEITEM_NUM)
    top = risk.top_risk(risk.risk_scores(work, risk.thresholds(work, cols), LINEITEM_KEY), LINEITEM_KEY, 5)
    keys = [tuple(r[k] for k in LINEITEM_KEY) for r in top.collect()]
    cells = entity.profile_keys(lineitem_nulls(spark, sf_dir), LINEITEM_KEY, keys, _FEATURES, _TARGET)
    dbl = ("value", "percentile", "mean", "median", "std", "z_score")
    return cells.select(*[r4(F.col(c)).alias(c) if c in dbl else F.col(c) for c in cells.columns])
