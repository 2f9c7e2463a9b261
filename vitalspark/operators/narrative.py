"""Result grading (RES-1): the rule-based narrative of an analysis result,
for every row of a result table at once (``when`` / ``format_string``)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Grading cut-offs.
LOW_R2 = 0.5
STRONG_R2 = 0.8
LOW_ACCURACY = 0.7
LOW_SILHOUETTE = 0.3
HIGH_CONFIDENCE = 0.75


def _pct1(c: Column) -> Column:
    return F.round(c * 100, 1).cast("string")


def grade_results(results: DataFrame) -> DataFrame:
    """Input columns: task ('regression' | 'classification' | 'clustering'
    | other), target, n_features, total_rows, r2, accuracy, silhouette,
    n_clusters (nulls allowed), and optionally top_features (array of names,
    strongest first).  Output: summary, observation, risk_flag,
    recommendation, confidence.  The texts are fixed values."""
    # A missing figure reads as 0 in texts and tests, but not as confidence.
    task, zero = F.col("task"), F.lit(0.0)
    r2, acc, sil = (F.coalesce(F.col(c), zero) for c in ("r2", "accuracy", "silhouette"))
    rows = F.format_number(F.coalesce(F.col("total_rows"), F.lit(0)), 0)
    nfeat = F.coalesce(F.col("n_features"), F.lit(0)).cast("string")
    target = F.coalesce(F.col("target"), F.lit(""))
    summary = (F.when(task == "regression", F.concat(
        F.lit("A regression model was trained to predict '"), target, F.lit("' using "), nfeat,
        F.lit(" features across "), rows, F.lit(" patients, achieving an R² score of "), _pct1(r2), F.lit("%.")))
        .when(task == "classification", F.concat(
            F.lit("A classification model was trained to predict '"), target, F.lit("' using "), nfeat,
            F.lit(" features across "), rows, F.lit(" patients, achieving "), _pct1(acc), F.lit("% accuracy.")))
        .when(task == "clustering", F.concat(
            F.lit("K-Means clustering identified "), F.coalesce(F.col("n_clusters"), F.lit(0)).cast("string"),
            F.lit(" distinct patient groups from "), rows, F.lit(" records with a silhouette score of "),
            F.round(sil, 4).cast("string"), F.lit(".")))
        .otherwise(F.concat(F.lit("Analysis completed on "), rows, F.lit(" patient records."))))
    top = F.col("top_features") if "top_features" in results.columns else F.array().cast("array<string>")
    ranked = F.coalesce(F.size(top), F.lit(0)) > 0
    groups = F.coalesce(F.col("n_clusters"), F.lit(0)).cast("string")
    observation = F.concat_ws(
        " ",
        F.when(task == "regression", F.concat(F.lit("Model explains "), _pct1(r2), F.lit("% of variance in "), target,
                                              F.lit(".")))
        .when(task == "classification", F.concat(F.lit("Model correctly classifies "), _pct1(acc), F.lit("% of patients.")))
        .when(task == "clustering", F.concat(groups, F.lit(
            " patient subgroups identified — each may require different care pathways."))),
        F.when(ranked & (task == "regression"), F.concat(
            F.lit("'"), F.get(top, F.lit(0)), F.lit("' is the strongest predictor of "), target, F.lit(".")))
        .when(ranked & (task == "classification"), F.concat(
            F.lit("Top predictors: "), F.array_join(F.slice(top, 1, 3), ", "), F.lit("."))))
    risk = (F.when((task == "regression") & (r2 < LOW_R2), F.concat(
        F.lit("Low R² ("), _pct1(r2), F.lit("%) — model may need more features or data cleaning.")))
        .when((task == "classification") & (acc < LOW_ACCURACY), F.concat(
            F.lit("Accuracy "), _pct1(acc), F.lit("% may be insufficient for clinical decisions.")))
        .when((task == "clustering") & (sil < LOW_SILHOUETTE),
              F.lit("Low silhouette score — clusters may overlap significantly."))
        .otherwise(F.lit("No critical issues detected.")))
    rec = (F.when((task == "regression") & (r2 < LOW_R2), F.lit("Consider adding more clinically relevant features."))
           .when(task == "regression", F.concat(F.lit("Model performance is "),
                                                F.when(r2 > STRONG_R2, "strong").otherwise("moderate"),
                                                F.lit(" — suitable for clinical decision support.")))
           .when((task == "classification") & (acc < LOW_ACCURACY),
                 F.lit("Consider collecting more balanced training data."))
           .when(task == "clustering",
                 F.lit("Review each cluster's characteristics to identify high-risk patient groups."))
           .otherwise(F.lit("Review results with a clinical expert before deployment.")))
    conf_metric = F.coalesce(F.col("r2"), F.col("accuracy"), F.lit(0.5))
    confidence = F.when(conf_metric > HIGH_CONFIDENCE, "high").otherwise("medium")
    return results.select("*", summary.alias("summary"), observation.alias("observation"), risk.alias("risk_flag"), rec.alias("recommendation"),
                          confidence.alias("confidence"))
