"""The reference's entry points, one function each, composed from the
operators.  Where the reference returns one nested dict, these return a dict
of lazy DataFrames (one per report section) plus a few scalars.  Row order
is explicit: pass ``key_cols`` (row identity) and, where order matters,
``order_cols``.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .ml import cluster as _cluster
from .ml import dbscan as _dbscan
from .ml import explain as _explain
from .ml import isoforest as _isoforest
from .ml import prep as _prep
from .ml import supervised as _sup
from .ml import ward as _ward
from .operators import (coding, entity, filters, privacy, profile, quality, risk, rules, similarity, survival,
                        trend)
from .sources import files


# ---------------------------------------------------------------- loading and profiling

def load_file(spark: SparkSession, path: str, schema=None) -> DataFrame:
    return files.read_table(spark, path, schema)


def load_from_sql(spark: SparkSession, query: str, url: str | None = None, **jdbc) -> DataFrame:
    return files.read_jdbc(spark, url, query=query, **jdbc) if url else files.read_sql(spark, query)


def dataframe_summary(df: DataFrame, key_cols: Sequence[str]) -> dict:
    return {"columns": profile.dataset_summary(df), "preview": filters.preview(df, key_cols)}


def get_column_info(df: DataFrame, key_cols: Sequence[str]) -> DataFrame:
    return profile.column_info(df, key_cols)


def get_column_stats(df: DataFrame, key_cols: Sequence[str]) -> DataFrame:
    return profile.column_stats(df, key_cols)


def auto_detect_task(df: DataFrame, target_col: str) -> str:
    return _sup.detect_task(df, target_col)


def filter_data(df: DataFrame, filter_list: Sequence[Mapping], key_cols: Sequence[str]) -> dict:
    out = filters.filter_chain(df, filter_list)
    return {"data": out, "rows": out.agg(F.count(F.lit(1)).alias("rows")), "preview": filters.preview(out, key_cols)}


# ---------------------------------------------------------------- quality, risk, profiles

def run_quality_check(df: DataFrame) -> quality.QualityReport:
    return quality.run_quality_check(df)


def run_risk_engine(df: DataFrame, feature_cols: Sequence[str], key_cols: Sequence[str],
                    order_cols: Sequence[str] | None = None, anomalies: bool = True) -> dict:
    rep = risk.run_risk_engine(df, feature_cols, key_cols, order_cols)
    out = {"thresholds": rep.thresholds, "alerts": rep.alerts, "change_alerts": rep.change_alerts,
           "scores": rep.scores, "risk_distribution": rep.distribution, "top_risk": rep.top}
    if anomalies:
        flagged = _isoforest.isolation_forest(df, feature_cols, key_cols)
        out["anomalies"] = flagged
        out["anomaly_report"] = _isoforest.anomaly_summary(flagged, key_cols)
    return out


def get_patient_profile(df: DataFrame, key_cols: Sequence[str], feature_cols: Sequence[str],
                        target_col: str | None = None, keys: Sequence[tuple] = ()) -> dict:
    """All rows are profiled; ``keys`` selects rows for the similar-rows
    panel (neighbours need query points)."""
    out = {"cells": entity.profile_cells(df, key_cols, feature_cols, target_col, other_columns=True),
           "risk": entity.risk_profile(df, key_cols, feature_cols)}
    if keys:
        out["selected"] = entity.profile_keys(df, key_cols, keys, feature_cols, target_col)
        out["similar"] = similarity.similar_rows(df, feature_cols, key_cols, keys)
    return out


def find_similar_patients(df: DataFrame, feature_cols: Sequence[str], key_cols: Sequence[str],
                          query_values: Sequence[Mapping] | Mapping, n_similar: int = 5) -> dict:
    qs = [query_values] if isinstance(query_values, Mapping) else list(query_values)
    nn, cols = similarity.find_similar(df, feature_cols, key_cols, qs, n_similar)
    return {"similar": nn, "cohort_comparison": similarity.cohort_comparison(df, cols, key_cols, nn, qs)}


def run_trend_analysis(df: DataFrame, feature_cols: Sequence[str], order_cols: Sequence[str],
                       group_cols: Sequence[str] = (), forecast_steps: int = trend.FORECAST_STEPS) -> dict:
    ti = trend.trend_input(df, feature_cols, order_cols, group_cols)
    fit = trend.linear_trend(ti)
    return {"trends": fit, "lines": trend.trend_lines(ti, fit),
            "forecasts": trend.forecast(fit, group_cols, forecast_steps),
            "correlation": trend.correlation_matrix(df, feature_cols)}


def run_kaplan_meier(df: DataFrame, duration_col: str, event_col: str,
                     group_col: str | None = None) -> survival.SurvivalReport:
    return survival.run_kaplan_meier(df, duration_col, event_col, group_col)


# ---------------------------------------------------------------- rules and comparison

def evaluate_rules(df: DataFrame, rule_list: Sequence[Mapping], key_cols: Sequence[str]) -> dict:
    ev = rules.evaluate_rules(df, rule_list)
    return {"rules": ev, "triggered_rows": rules.triggered_rows(df, rule_list, key_cols),
            "status": rules.rollup_status(ev)}


def suggest_rules(df: DataFrame) -> list[dict]:
    return rules.suggest_rules(df.columns)


def compare(df_a: DataFrame, df_b: DataFrame) -> dict:
    comp = rules.compare_datasets(df_a, df_b)
    return {"columns": comp, "summary": rules.comparison_summary(comp)}


# ---------------------------------------------------------------- privacy and coding

def run_privacy_check(df: DataFrame, key_cols: Sequence[str] | None = None) -> dict:
    rep = privacy.detect_phi(df, key_cols)
    return {"phi_columns": rep, "compliance": privacy.privacy_check(rep)}


def anonymise(df: DataFrame, columns: Sequence[str], method: str = "hash",
              order_cols: Sequence[str] | None = None) -> privacy.Anonymised:
    return privacy.anonymise(df, columns, method, order_cols)


def detect_icd_codes(df: DataFrame, order_cols: Sequence[str]) -> DataFrame:
    return coding.detect_icd_codes(df, order_cols)


def check_drug_interactions(df: DataFrame) -> DataFrame:
    return coding.drug_interactions(df)


# ---------------------------------------------------------------- machine learning

def run_regression(df: DataFrame, feature_cols: Sequence[str], target_col: str, key_cols: Sequence[str],
                   model_type: str = "random_forest") -> dict:
    fr = _sup.fit(df, feature_cols, target_col, key_cols, task="regression", model_type=model_type)
    return {"metrics": _sup.regression_metrics(fr.predictions), "feature_importance": _sup.importances(fr),
            "predictions": fr.predictions.select(*key_cols, "label", "prediction"), "fit": fr}


def run_classification(df: DataFrame, feature_cols: Sequence[str], target_col: str, key_cols: Sequence[str],
                       model_type: str = "random_forest") -> dict:
    fr = _sup.fit(df, feature_cols, target_col, key_cols, task="classification", model_type=model_type)
    classes = _prep.label_names(fr.prep)
    return {"report": _sup.classification_report(fr.predictions, classes),
            "feature_importance": _sup.importances(fr), "classes": classes,
            "predictions": fr.predictions.select(*key_cols, "label", "prediction"), "fit": fr}


def run_clustering(df: DataFrame, feature_cols: Sequence[str], key_cols: Sequence[str], n_clusters: int = 3,
                   model_type: str = "kmeans", eps: float | None = None,
                   min_samples: int | None = None) -> dict:
    st = _cluster.standardise_features(df, feature_cols, key_cols)
    if model_type == "dbscan":
        labels = _dbscan.dbscan(df, feature_cols, key_cols, eps, min_samples).select(*key_cols, "cluster")
    elif model_type == "hierarchical":
        labels = _ward.ward(df, feature_cols, key_cols, n_clusters)
    else:
        _, lab = _cluster.kmeans(st, n_clusters)
        labels = lab.select(*key_cols, "cluster")
    labelled = st.data.join(labels, list(key_cols))
    return {"labels": labels, "cluster_stats": _cluster.cluster_stats(labelled, st.feature_cols),
            "scatter": _cluster.pca_scatter(labelled, key_cols), "silhouette": _cluster.silhouette(labelled, key_cols=key_cols)}


def run_explainability(df: DataFrame, feature_cols: Sequence[str], target_col: str, key_cols: Sequence[str],
                       model_type: str = "random_forest", inputs: DataFrame | None = None,
                       input_keys: Sequence[str] = ()) -> dict:
    contrib, imp, base = _explain.explain(df, feature_cols, target_col, key_cols, model_type, inputs=inputs,
                                          input_keys=input_keys)
    return {"local_contributions": contrib, "global_importance": imp, "baseline": base}


def predict_new_input(df: DataFrame, feature_cols: Sequence[str], target_col: str, key_cols: Sequence[str],
                      inputs: DataFrame, input_keys: Sequence[str], model_type: str = "random_forest") -> DataFrame:
    fr = _sup.fit(df, feature_cols, target_col, key_cols, model_type=model_type, holdout=False)
    return _sup.predict_inputs(fr, inputs, input_keys)


def compare_targets(df: DataFrame, feature_cols: Sequence[str], target_cols: Sequence[str],
                    key_cols: Sequence[str]) -> DataFrame:
    return _sup.compare_targets(df, feature_cols, target_cols, key_cols)
