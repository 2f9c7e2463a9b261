"""Machine-learning queries (ML-1..17, RES-1).  Linear fits of two features,
their metrics, predictions and explanations have SQL; other model fits are
checked by row counts here and by the unit tests (metric bounds, invariants,
brute-force comparisons)."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from ..functions.columns import r4
from ..ml import cluster, dbscan, explain, isoforest, prep, supervised, ward
from ..operators import narrative, trend
from .base import LINEITEM_KEY, register, table

_LI_FEATURES = ["l_quantity", "l_discount", "l_tax", "l_returnflag"]


def _docs_labelled(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "n_chars", "lang", "source")
    lab = table(spark, sf_dir, "labels")
    return d.join(lab, "doc_id")


@register("ml_regression", "ML-1 ML-2 ML-3 ML-5")
def ml_regression(spark, sf_dir):
    fr = supervised.fit(table(spark, sf_dir, "lineitem"), _LI_FEATURES, "l_extendedprice", LINEITEM_KEY,
                        task="regression", model_type="linear")
    return supervised.regression_metrics(fr.predictions)


@register("ml_forest_importance", "ML-3 ML-7")
def ml_forest_importance(spark, sf_dir):
    fr = supervised.fit(table(spark, sf_dir, "lineitem"), _LI_FEATURES, "l_extendedprice", LINEITEM_KEY,
                        task="regression", model_type="random_forest")
    return supervised.importances(fr)


@register("ml_classification", "ML-4 ML-6")
def ml_classification(spark, sf_dir):
    fr = supervised.fit(_docs_labelled(spark, sf_dir), ["n_chars", "lang", "source"], "quality", ["doc_id"],
                        task="classification", model_type="random_forest")
    from ..ml.prep import label_names
    return supervised.classification_report(fr.predictions, label_names(fr.prep))


@register("ml_boosting_predictions", "ML-4 ML-8")
def ml_boosting_predictions(spark, sf_dir):
    fr = supervised.fit(_docs_labelled(spark, sf_dir), ["n_chars", "lang", "source"], "toxic", ["doc_id"],
                        task="classification", model_type="gradient_boost")
    return fr.predictions.select("doc_id", "label", "prediction")


@register("ml_logistic_predictions", "ML-4 ML-8")
def ml_logistic_predictions(spark, sf_dir):
    fr = supervised.fit(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_discount", "l_tax"], "l_returnflag",
                        LINEITEM_KEY, task="classification", model_type="linear")
    return fr.predictions.select(*LINEITEM_KEY, "label", "prediction")


@register("ml_explain", "ML-15")
def ml_explain(spark, sf_dir):
    """The model of the labelled documents, explained for every document."""
    contrib, _, _ = explain.explain(_docs_labelled(spark, sf_dir), ["n_chars", "lang", "source"], "quality",
                                    ["doc_id"], task="classification", inputs=table(spark, sf_dir, "documents"))
    return contrib


@register("ml_predict_inputs", "ML-16")
def ml_predict_inputs(spark, sf_dir):
    fr = supervised.fit(_docs_labelled(spark, sf_dir), ["n_chars", "lang", "source"], "quality", ["doc_id"],
                        task="classification", holdout=False)
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars", "lang", "source")
    unlabelled = docs.join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_anti")
    return supervised.predict_inputs(fr, unlabelled, ["doc_id"])


# ---------------------------------------------------------------- with SQL

# Least squares of y on x1, x2 over the rows t(x1, x2, y), as one row m.
_OLS = (
    "c AS (SELECT avg(x1) AS a1, avg(x2) AS a2, avg(y) AS ay, var_pop(x1) AS v1, var_pop(x2) AS v2,"
    " covar_pop(x1, x2) AS c12, covar_pop(x1, y) AS c1, covar_pop(x2, y) AS c2 FROM t),"
    " b AS (SELECT *, (c1 * v2 - c2 * c12) / (v1 * v2 - c12 * c12) AS b1,"
    " (c2 * v1 - c1 * c12) / (v1 * v2 - c12 * c12) AS b2 FROM c),"
    " m AS (SELECT *, ay - b1 * a1 - b2 * a2 AS b0 FROM b)")


def _train_sql(keys) -> str:
    name = " || '|' || ".join(f"CAST({k} AS VARCHAR)" for k in keys)
    return f"CAST('0x' || substr(md5({name} || '|42'), 1, 8) AS BIGINT) % 100 < 80"


_PREPARED_SQL = (
    "SELECT doc_id, CAST(n_chars AS DOUBLE) AS n_chars, CAST(dense_rank() OVER (ORDER BY lang) - 1 AS INTEGER) AS lang_code,"
    " CAST(dense_rank() OVER (ORDER BY source) - 1 AS INTEGER) AS source_code,"
    " CAST(dense_rank() OVER (ORDER BY quality) - 1 AS INTEGER) AS label, " + _train_sql(["doc_id"]) + " AS is_train"
    " FROM documents JOIN labels USING (doc_id) WHERE n_chars IS NOT NULL AND lang IS NOT NULL AND source IS NOT NULL"
    " AND quality IS NOT NULL")


@register("ml_prepared", "ML-1 ML-2", _PREPARED_SQL)
def ml_prepared(spark, sf_dir):
    """Encoded features and label of the labelled documents, and their side of the split."""
    p = prep.prepare(_docs_labelled(spark, sf_dir), ["n_chars", "lang", "source"], "quality", ["doc_id"], index_label=True)
    return p.data.select("doc_id", F.col("n_chars").cast("double").alias("n_chars"),
                         F.col("lang__idx").cast("int").alias("lang_code"),
                         F.col("source__idx").cast("int").alias("source_code"), F.col("label").cast("int").alias("label"),
                         prep.split_flag(["doc_id"]).alias("is_train"))


def _price(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").withColumn("price", F.col("l_extendedprice") / 1000)


def _price_fit(spark, sf_dir):
    return supervised.fit(_price(spark, sf_dir), ["l_quantity", "l_discount"], "price", LINEITEM_KEY,
                          task="regression", model_type="linear")


_LI_KEYS = ", ".join(LINEITEM_KEY)
_PRICE_SQL = (
    f"WITH r AS (SELECT {_LI_KEYS}, l_quantity AS x1, l_discount AS x2, l_extendedprice / 1000 AS y,"
    f" {_train_sql(LINEITEM_KEY)} AS is_train FROM lineitem WHERE l_quantity IS NOT NULL AND l_discount IS NOT NULL"
    f" AND l_extendedprice IS NOT NULL), t AS (SELECT * FROM r WHERE is_train), {_OLS},"
    f" p AS (SELECT {_LI_KEYS}, y AS label, b0 + b1 * x1 + b2 * x2 AS prediction FROM r, m WHERE NOT is_train)")


@register("ml_linear_metrics", "ML-2 ML-3 ML-5",
          _PRICE_SQL + ", s AS (SELECT count(*) AS n_test, avg((prediction - label) ** 2) AS mse,"
          " 1 - sum((prediction - label) ** 2) / (var_pop(label) * count(*)) AS r2 FROM p)"
          " SELECT n_test, round(mse, 4) AS mse, round(sqrt(mse), 4) AS rmse, round(r2, 4) AS r2,"
          " round(r2 * 100, 4) AS r2_percent FROM s")
def ml_linear_metrics(spark, sf_dir):
    out = supervised.regression_metrics(_price_fit(spark, sf_dir).predictions)
    return out.select("n_test", *[r4(F.col(c)).alias(c) for c in ("mse", "rmse", "r2", "r2_percent")])


@register("ml_linear_predictions", "ML-3 ML-8",
          _PRICE_SQL + f" SELECT {_LI_KEYS}, label, round(prediction, 2) AS prediction FROM p")
def ml_linear_predictions(spark, sf_dir):
    return _price_fit(spark, sf_dir).predictions.select(
        *LINEITEM_KEY, "label", F.round("prediction", 2).alias("prediction"))


@register("ml_linear_importance", "ML-7",
          _PRICE_SQL + ", i AS (SELECT 'l_quantity' AS feature, abs(b1) / (abs(b1) + abs(b2)) AS w FROM m UNION ALL"
          " SELECT 'l_discount', abs(b2) / (abs(b1) + abs(b2)) FROM m)"
          " SELECT feature, round(w, 4) AS importance, round(w * 100, 4) AS percent FROM i")
def ml_linear_importance(spark, sf_dir):
    out = supervised.importances(_price_fit(spark, sf_dir))
    return out.select("feature", *[r4(F.col(c)).alias(c) for c in ("importance", "percent")])


# Inputs with a missing quantity, an unseen and a missing flag; the model is fitted on lineitem itself.
_INPUTS_SQL = (
    "WITH g AS (SELECT l_returnflag AS f, CAST(row_number() OVER (ORDER BY l_returnflag) - 1 AS DOUBLE) AS code"
    " FROM (SELECT DISTINCT l_returnflag FROM lineitem WHERE l_returnflag IS NOT NULL)),"
    " t AS (SELECT l_quantity AS x1, code AS x2, l_extendedprice / 1000 AS y FROM lineitem JOIN g ON l_returnflag = f"
    f" WHERE l_quantity IS NOT NULL AND l_extendedprice IS NOT NULL), {_OLS},"
    f" i AS (SELECT {_LI_KEYS}, CASE WHEN l_linenumber % 7 <> 0 THEN l_quantity END AS q, coalesce(code, 0) AS x2,"
    " (SELECT min(f) FROM g) AS first FROM (SELECT *, CASE WHEN l_orderkey % 50 = 0 THEN 'unseen'"
    " WHEN l_orderkey % 50 <> 1 THEN l_returnflag END AS flag FROM lineitem) LEFT JOIN g ON flag = f)")


def _inputs(spark, sf_dir):
    order = F.col("l_orderkey") % 50
    return table(spark, sf_dir, "lineitem").select(
        *LINEITEM_KEY, F.when(F.col("l_linenumber") % 7 != 0, F.col("l_quantity")).alias("l_quantity"),
        F.when(order == 0, "unseen").when(order != 1, F.col("l_returnflag")).alias("l_returnflag"))


@register("ml_linear_inputs", "ML-16 PAT-4",
          _INPUTS_SQL + f" SELECT {_LI_KEYS}, round(b0 + b1 * coalesce(q, 0) + b2 * x2, 2) + 0.0 AS prediction FROM i, m")
def ml_linear_inputs(spark, sf_dir):
    fr = supervised.fit(_price(spark, sf_dir), ["l_quantity", "l_returnflag"], "price", LINEITEM_KEY,
                        task="regression", model_type="linear", holdout=False)
    out = supervised.predict_inputs(fr, _inputs(spark, sf_dir), LINEITEM_KEY)
    return out.select(*LINEITEM_KEY, (F.round("prediction", 2) + 0.0).alias("prediction"))


@register("ml_linear_explain", "ML-15",
          _INPUTS_SQL + f", e AS (SELECT {_LI_KEYS}, 'l_quantity' AS feature, coalesce(q, a1) AS value, b1 * (coalesce(q, a1) - a1)"
          " AS w, b0 + b1 * coalesce(q, a1) + b2 * x2 AS f FROM i, m UNION ALL"
          f" SELECT {_LI_KEYS}, 'l_returnflag', x2, b2 * (x2 - a2), b0 + b1 * coalesce(q, a1) + b2 * x2 FROM i, m)"
          f" SELECT {_LI_KEYS}, feature, round(value, 2) AS value, round(f, 2) + 0.0 AS prediction, round(w, 2) + 0.0 AS contribution,"
          " CASE WHEN w > 0 THEN 'increases' ELSE 'decreases' END AS direction, round(abs(w), 2) AS magnitude FROM e")
def ml_linear_explain(spark, sf_dir):
    """Given inputs explained: a missing quantity stands for the mean, an
    unseen or missing flag for the first one."""
    out, _, _ = explain.explain(_price(spark, sf_dir), ["l_quantity", "l_returnflag"], "price", LINEITEM_KEY, "linear",
                                "regression", inputs=_inputs(spark, sf_dir))
    two = lambda c: (F.round(c, 2) + 0.0).alias(c)
    return out.select(*LINEITEM_KEY, "feature", two("value"), two("prediction"), two("contribution"), "direction",
                      two("magnitude"))


_REPORT_SQL = (
    "WITH p AS (SELECT quality AS label, CAST(n_chars >= 400 AS INTEGER) AS prediction FROM documents JOIN labels USING (doc_id)"
    " WHERE quality IS NOT NULL AND n_chars IS NOT NULL), k AS (SELECT label AS k FROM p UNION SELECT prediction FROM p),"
    " c AS (SELECT k, count_if(label = k) AS support, count_if(prediction = k) AS predicted,"
    " count_if(label = k AND prediction = k) AS tp FROM k, p GROUP BY k),"
    " r AS (SELECT k, support, tp, coalesce(tp / nullif(predicted, 0), 0) AS pr, coalesce(tp / nullif(support, 0), 0) AS re FROM c),"
    " f AS (SELECT *, CASE WHEN pr + re > 0 THEN 2 * pr * re / (pr + re) ELSE 0 END AS f1 FROM r),"
    " a AS (SELECT CAST(k AS VARCHAR) AS class, pr, re, f1, support FROM f UNION ALL"
    " SELECT 'accuracy', sum(tp) / sum(support), sum(tp) / sum(support), sum(tp) / sum(support), sum(support) FROM f UNION ALL"
    " SELECT 'macro avg', avg(pr), avg(re), avg(f1), sum(support) FROM f UNION ALL"
    " SELECT 'weighted avg', sum(pr * support) / sum(support), sum(re * support) / sum(support),"
    " sum(f1 * support) / sum(support), sum(support) FROM f)"
    " SELECT class, round(pr, 4) AS precision, round(re, 4) AS recall, round(f1, 4) AS f1, CAST(support AS BIGINT) AS support FROM a")


@register("ml_report", "ML-6", _REPORT_SQL)
def ml_report(spark, sf_dir):
    """The report of a rule that calls documents of 400 characters good."""
    preds = _docs_labelled(spark, sf_dir).where("quality is not null and n_chars is not null").select(
        F.col("quality").cast("double").alias("label"), (F.col("n_chars") >= 400).cast("double").alias("prediction"))
    out = supervised.classification_report(preds)
    return out.select("class", *[r4(F.col(c)).alias(c) for c in ("precision", "recall", "f1")], "support")


@register("ml_cluster_stats", "ML-13",
          "SELECT CAST(CASE WHEN c_acctbal < 0 THEN -1 ELSE c_nationkey % 3 END AS INTEGER) AS cluster, count(*) AS size,"
          " round(avg(c_acctbal), 4) AS mean_c_acctbal, round(avg(c_nationkey), 4) AS mean_c_nationkey,"
          " c_acctbal < 0 AS is_noise FROM customer GROUP BY ALL")
def ml_cluster_stats(spark, sf_dir):
    """Figures of given clusters, those in debt being noise."""
    given = F.when(F.col("c_acctbal") < 0, -1).otherwise(F.col("c_nationkey") % 3).cast("int")
    out = cluster.cluster_stats(table(spark, sf_dir, "customer").withColumn("cluster", given), ["c_acctbal", "c_nationkey"])
    return out.select("cluster", "size", r4(F.col("mean_c_acctbal")).alias("mean_c_acctbal"),
                      r4(F.col("mean_c_nationkey")).alias("mean_c_nationkey"), "is_noise")


# Two standardised features have the axes (1, 1) and (1, -1), in the order of their correlation's sign.
@register("ml_pca_plane", "ML-14",
          "WITH s AS (SELECT avg(l_quantity) AS a1, stddev_pop(l_quantity) AS s1, avg(l_extendedprice) AS a2,"
          " stddev_pop(l_extendedprice) AS s2, corr(l_quantity, l_extendedprice) AS r FROM lineitem),"
          f" z AS (SELECT {_LI_KEYS}, l_linenumber AS cluster, (l_quantity - a1) / s1 AS p, (l_extendedprice - a2) / s2 AS q, r"
          " FROM lineitem, s WHERE l_quantity IS NOT NULL AND l_extendedprice IS NOT NULL)"
          f" SELECT {_LI_KEYS}, round((p + sign(r) * q) / sqrt(2.0), 4) + 0.0 AS x, round((p - sign(r) * q) / sqrt(2.0), 4) + 0.0 AS y,"
          " cluster FROM z")
def ml_pca_plane(spark, sf_dir):
    st = cluster.standardise_features(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_extendedprice"], LINEITEM_KEY)
    out = cluster.pca_scatter(st.data.withColumn("cluster", F.col("l_linenumber")), LINEITEM_KEY)
    return out.select(*LINEITEM_KEY, r4(F.col("x")).alias("x"), r4(F.col("y")).alias("y"), "cluster")


@register("ml_multi_target", "ML-17 PRF-5")
def ml_multi_target(spark, sf_dir):
    return supervised.compare_targets(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_discount", "l_tax"],
                                      ["l_extendedprice", "l_returnflag", "l_linenumber"], LINEITEM_KEY)


def _customer_clusters(spark, sf_dir):
    st = cluster.standardise_features(table(spark, sf_dir, "customer"), ["c_acctbal", "c_nationkey"],
                                      ["c_custkey"])
    _, labelled = cluster.kmeans(st, k=3)
    return st, labelled


@register("ml_kmeans", "ML-9 ML-13")
def ml_kmeans(spark, sf_dir):
    st, labelled = _customer_clusters(spark, sf_dir)
    return cluster.cluster_stats(labelled, st.feature_cols)


@register("ml_pca", "ML-14 ML-12")
def ml_pca(spark, sf_dir):
    _, labelled = _customer_clusters(spark, sf_dir)
    sil = cluster.silhouette(labelled, key_cols=["c_custkey"])
    return cluster.pca_scatter(labelled, ["c_custkey"]).withColumn("silhouette", F.lit(sil))


_SILHOUETTE_SQL = """
WITH s AS (SELECT avg(c_acctbal) AS mb, stddev_pop(c_acctbal) AS sb, avg(c_nationkey) AS mn, stddev_pop(c_nationkey) AS sn
           FROM customer),
     p AS (SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 0 WHEN c_acctbal < 5000 THEN 1 ELSE 2 END AS label,
                  (c_acctbal - mb) / sb AS x, (c_nationkey - mn) / sn AS y,
                  md5(CAST(c_custkey AS VARCHAR)) AS name FROM customer, s),
     q AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY label ORDER BY name) <= 1000),
     m AS (SELECT a.c_custkey, a.label, q.label AS their, avg(sqrt((a.x - q.x) ** 2 + (a.y - q.y) ** 2)) AS d
           FROM p a JOIN q ON a.c_custkey <> q.c_custkey GROUP BY ALL),
     o AS (SELECT c_custkey, label, max(d) FILTER (their = label) AS own, min(d) FILTER (their <> label) AS nearest
           FROM m GROUP BY ALL)
SELECT c_custkey, CAST(label AS BIGINT) AS label, round(own, 4) AS own, round(nearest, 4) AS "other",
       round((nearest - own) / greatest(nearest, own), 4) AS silhouette FROM o
"""


@register("ml_silhouette", "ML-12", _SILHOUETTE_SQL)
def ml_silhouette(spark, sf_dir):
    """Euclidean silhouette of every customer, the clusters given by balance."""
    st = cluster.standardise_features(table(spark, sf_dir, "customer"), ["c_acctbal", "c_nationkey"], ["c_custkey"])
    bal = F.col("c_acctbal")
    points = st.data.select("c_custkey", F.when(bal < 0, 0).when(bal < 5000, 1).otherwise(2).alias("label"),
                            vector_to_array("features").alias("z"))
    out = cluster.euclidean_silhouette(points, "label", "z", ["c_custkey"])
    return out.select("c_custkey", "label", *[r4(F.col(c)).alias(c) for c in ("own", "other", "silhouette")])


# ---------------------------------------------------------------- RES-1 on trend fits

def _grading_sql() -> str:
    from .analytics import TREND_BASE_SQL
    r2p = "CAST(round(coalesce(r2, 0) * 100, 1) AS VARCHAR)"
    rows = "format('{:,}', total_rows)"
    return (
        f"WITH b AS ({TREND_BASE_SQL}), f AS (SELECT user_id, 'regression' AS task, 'value' AS target,"
        " 1 AS n_features, count(*) AS total_rows, regr_r2(value, idx) AS r2 FROM b GROUP BY user_id)"
        " SELECT user_id, task, target, n_features, total_rows, round(r2, 4) AS r2,"
        f" 'A regression model was trained to predict ''' || target || ''' using ' || n_features || ' features across '"
        f" || {rows} || ' patients, achieving an R² score of ' || {r2p} || '%.' AS summary,"
        f" 'Model explains ' || {r2p} || '% of variance in ' || target || '.' || ' ''position'' is the strongest predictor of '"
        " || target || '.' AS observation,"
        f" CASE WHEN coalesce(r2, 0) < 0.5 THEN 'Low R² (' || {r2p} || '%) — model may need more features or data cleaning.'"
        " ELSE 'No critical issues detected.' END AS risk_flag,"
        " CASE WHEN coalesce(r2, 0) < 0.5 THEN 'Consider adding more clinically relevant features.'"
        " ELSE 'Model performance is ' || CASE WHEN r2 > 0.8 THEN 'strong' ELSE 'moderate' END"
        " || ' — suitable for clinical decision support.' END AS recommendation,"
        " CASE WHEN coalesce(r2, 0.5) > 0.75 THEN 'high' ELSE 'medium' END AS confidence FROM f")


@register("result_grading", "RES-1 SNK-2", _grading_sql())
def result_grading(spark, sf_dir):
    ev = table(spark, sf_dir, "events")
    fit = trend.linear_trend(trend.trend_input(ev, ["value"], ["ts", "event_id"], ["user_id"]))
    res = fit.select("user_id", F.lit("regression").alias("task"), F.lit("value").alias("target"),
                     F.lit(1).alias("n_features"), F.col("n").alias("total_rows"), "r2",
                     F.lit(None).cast("double").alias("accuracy"), F.lit(None).cast("double").alias("silhouette"),
                     F.lit(None).cast("long").alias("n_clusters"), F.array(F.lit("position")).alias("top_features"))
    g = narrative.grade_results(res)
    return g.select("user_id", "task", "target", "n_features", "total_rows", r4(F.col("r2")).alias("r2"),
                    "summary", "observation", "risk_flag", "recommendation", "confidence")


@register("risk_anomalies", "RSK-3")
def risk_anomalies(spark, sf_dir):
    from .base import LINEITEM_NUM
    out = isoforest.isolation_forest(table(spark, sf_dir, "lineitem"), LINEITEM_NUM, LINEITEM_KEY)
    return out.where("is_anomaly").select(*LINEITEM_KEY, r4(F.col("anomaly_score")).alias("anomaly_score"))


@register("ml_dbscan", "ML-10")
def ml_dbscan(spark, sf_dir):
    return dbscan.dbscan(table(spark, sf_dir, "customer"), ["c_acctbal", "c_nationkey"], ["c_custkey"],
                         eps=0.3, min_samples=10)


# Core and noise flags with the automatic parameters: every pair of rows, as SQL.
DBSCAN_AUTO_SQL = (
    "WITH s AS (SELECT avg(c_acctbal) AS m1, stddev_pop(c_acctbal) AS s1, avg(c_nationkey) AS m2,"
    " stddev_pop(c_nationkey) AS s2, count(*) AS n FROM customer),"
    " z AS (SELECT c_custkey AS k, (c_acctbal - m1) / s1 AS x, (c_nationkey - m2) / s2 AS y FROM customer, s),"
    " p AS (SELECT a.k AS a, b.k AS b, (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) AS d2 FROM z a, z b),"
    " kth AS (SELECT a, sqrt(d2) AS d FROM p QUALIFY row_number() OVER (PARTITION BY a ORDER BY d2) = 5),"
    " e AS (SELECT greatest(0.3, quantile_cont(d, 0.9)) AS eps FROM kth),"
    " near AS (SELECT a, b FROM p, e WHERE d2 <= eps * eps),"
    " c AS (SELECT a FROM near GROUP BY a HAVING count(*) >= (SELECT greatest(3, n // 20) FROM s)),"
    " reached AS (SELECT DISTINCT b AS k FROM near JOIN c USING (a))"
    " SELECT c_custkey, c_custkey IN (SELECT a FROM c) AS is_core, c_custkey NOT IN (SELECT k FROM reached) AS is_noise"
    " FROM customer")


@register("ml_dbscan_auto", "ML-10", DBSCAN_AUTO_SQL)
def ml_dbscan_auto(spark, sf_dir):
    """eps and min_samples chosen from the data, as the reference does."""
    out = dbscan.dbscan(table(spark, sf_dir, "customer"), ["c_acctbal", "c_nationkey"], ["c_custkey"])
    return out.select("c_custkey", "is_core", (F.col("cluster") == -1).alias("is_noise"))


@register("ml_ward", "ML-11")
def ml_ward(spark, sf_dir):
    return ward.ward(table(spark, sf_dir, "customer"), ["c_acctbal", "c_nationkey"], ["c_custkey"], k=3)


@register("profile_prediction", "PAT-4 ML-16")
def profile_prediction(spark, sf_dir):
    """The model fitted on all labelled rows, applied to every document's own
    feature values (the prediction panel of an entity profile)."""
    fr = supervised.fit(_docs_labelled(spark, sf_dir), ["n_chars", "lang", "source"], "quality", ["doc_id"],
                        task="classification", holdout=False)
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars", "lang", "source")
    return supervised.predict_inputs(fr, docs, ["doc_id"])


@register("risk_anomaly_summary", "RSK-3")
def risk_anomaly_summary(spark, sf_dir):
    from .base import LINEITEM_NUM
    out = isoforest.isolation_forest(table(spark, sf_dir, "lineitem"), LINEITEM_NUM, LINEITEM_KEY)
    return isoforest.anomaly_summary(out, LINEITEM_KEY)
