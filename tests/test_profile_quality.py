import numpy as np
import pytest

from conftest import NUM6
from vitalspark.operators import profile, quality


def test_column_stats_golden(patients, sample):
    rows = {r["column"]: r for r in profile.column_stats(patients.drop("row_index"), ["patient_id"]).collect()}
    age, glu = rows["age"], rows["glucose"]
    for got, values in ((age, sample.age), (glu, sample.glucose)):
        assert (got["mean"], got["median"]) == pytest.approx((values.mean(), values.median()), abs=1e-3)
    for c in ("age", "cholesterol", "glucose", "bmi"):
        assert rows[c]["step"] == 1
    assert rows["gender"]["type"] == "categorical"
    assert rows["diagnosis"]["most_common"] in sample.diagnosis.mode().tolist()
    assert rows["smoking"]["unique_values"] == "Yes | No"


def test_column_info_and_summary(patients):
    df = patients.drop("row_index")
    info = {r["column"]: r for r in profile.column_info(df, ["patient_id"]).collect()}
    assert info["patient_id"]["unique_values"] == 30
    assert info["patient_id"]["sample_values"] == "P001 | P002 | P003"
    assert info["bmi"]["col_type"] == "numeric" and info["gender"]["col_type"] == "categorical"
    summ = profile.dataset_summary(df).collect()
    assert summ[0]["n_rows"] == 30 and summ[0]["n_cols"] == 11
    assert all(r["null_count"] == 0 for r in summ)


def test_task_detection_golden(patients):
    tasks = {r["column"]: r["task_auto"] for r in profile.detect_tasks(patients).collect()}
    assert (tasks["age"], tasks["bmi"], tasks["diagnosis"]) == ("regression", "regression", "classification")


def test_quartiles_golden(patients, sample):
    from vitalspark.plans.ordered import exact_quantiles
    from pyspark.sql import functions as F
    long = patients.select(F.lit("age").alias("column"), F.col("age").cast("double").alias("value"))
    q = {r["p"]: r["q"] for r in exact_quantiles(long, ["column"], "value", [0.25, 0.75]).collect()}
    assert (q[0.25], q[0.75]) == pytest.approx(tuple(sample.age.quantile([0.25, 0.75])))


def test_quality_golden(patients):
    rep = quality.run_quality_check(patients.drop("row_index"))
    score = rep.score.first()
    assert score["overall_score"] == 100 and score["grade"] == "A"
    flags = {r["column"]: r for r in rep.columns.collect()}
    assert [c for c, r in flags.items() if r["high_cardinality"]] == ["patient_id"]
    assert rep.missing.count() == 0 and rep.duplicates.first()["duplicates"] == 0


def test_quality_detects_injected_problems(spark):
    df = spark.createDataFrame(
        [(i, None if i % 2 else 1.0, "a" if i < 95 else "b", "5" if i % 3 else "x", "k") for i in range(100)]
        + [(0, 1.0, "a", "x", "k")],
        "id long, half_null double, skewed string, mixed string, const string")
    rep = quality.run_quality_check(df)
    miss = {r["column"]: r for r in rep.missing.collect()}
    assert miss["half_null"]["level"] == "critical"
    assert rep.duplicates.first()["duplicates"] == 1
    assert [r["column"] for r in rep.imbalance.collect()] == ["skewed"]
    flags = {r["column"]: r for r in rep.columns.collect()}
    assert flags["const"]["is_constant"] and flags["mixed"]["mixed_type"]
    # missing (critical) -10, duplicate -5, imbalance -5, two constant columns -5 each
    assert rep.score.first()["overall_score"] == 100 - 10 - 5 - 5 - 5 - 5


def test_distinct_table_equals_plain_counts(spark):
    """Nulls, signed zeros, NaN, ties, long texts, equal values in two columns
    and an empty table."""
    from vitalspark.plans.distinct import cell_counts, class_figures
    from vitalspark.functions.columns import nan_to_null
    nan = float("nan")
    rows = [(0.0, "a", "a", None), (-0.0, "a", "b", None), (nan, "b", "x" * 100_000, None), (None, "b", "x" * 100_000 + "y", None)]
    df = nan_to_null(spark.createDataFrame(rows, "v double, s string, t string, empty string"))
    got = {r["position"]: (r["distinct"], r["total"], r["top"], r["bottom"])
           for r in class_figures(cell_counts(df)).collect()}
    assert got == {0: (1, 2, 2, 2), 1: (2, 4, 2, 2), 2: (4, 4, 1, 1)}
    assert cell_counts(df.limit(0)).count() == 0
    stats = {r["column"]: r for r in profile.column_stats(df.selectExpr("*", "monotonically_increasing_id() as id"),
                                                          ["id"]).collect()}
    assert stats["s"]["most_common"] == "a" and stats["s"]["unique_values"] == "a | b"
    assert stats["t"]["most_common"] == "a" and "empty" not in stats


def test_imbalance_names_the_smallest_of_tied_classes(spark):
    df = spark.createDataFrame([("b",)] * 30 + [("a",)] * 30 + [("c",)], "k string")
    row = quality.imbalance_report(df).first()
    assert (row["dominant_class"], row["ratio"], row["dominant_pct"]) == ("a", 30.0, 49.2)


def test_outliers_and_duplicates_do_not_read_the_rows_again(spark, monkeypatch):
    """Outliers come from the distinct table (no row is exploded a second time),
    duplicates without a join of whole rows; marks that collide change nothing."""
    rows = [(i % 40, float(i % 7), None if i % 3 else -0.0, i) for i in range(400)] + [(10**6, 1e9, 0.0, -(10**7))] * 2
    df = spark.createDataFrame(rows, "k long, v double, z double, u long")
    monkeypatch.setattr(quality, "REPEATED_BITS", 6)
    rep = quality.run_quality_check(df)
    plan = rep.outliers._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "position" in plan
    assert "LeftSemi" not in rep.duplicates._jdf.queryExecution().optimizedPlan().toString()
    assert rep.duplicates.first()["duplicates"] == 1
    whole = {r["column"]: r for r in rep.outliers.collect()}
    assert whole == {r["column"]: r for r in quality.outlier_report(df).collect()} and list(whole) == ["k", "v", "u"]
    for at, c in ((0, "k"), (1, "v"), (3, "u")):
        values = np.array([r[at] for r in rows], float)
        q1, q3 = np.quantile(values, [0.25, 0.75])
        far = (values < q1 - 3 * (q3 - q1)) | (values > q3 + 3 * (q3 - q1))
        r = whole[c]
        assert (r["position"], r["q1"], r["q3"], r["outliers"], r["min"], r["max"]) == (
            at, q1, q3, far.sum(), values.min(), values.max())
