"""The reference's entry points through the facade, on the sample table."""
import pytest
from pyspark.sql import functions as F

from conftest import NUM6
from test_risk_rules import expected_risk
from vitalspark import api

KEY = ["patient_id"]


def test_profiling_and_filters(patients, sample):
    assert api.dataframe_summary(patients, KEY)["preview"].count() == 30
    assert api.auto_detect_task(patients, "diagnosis") == "classification"
    f = api.filter_data(patients, [{"col": "age", "op": ">", "value": 65}], KEY)
    assert f["rows"].first()["rows"] == (sample.age > 65).sum() > 0


def test_risk_and_profile(patients, sample):
    r = api.run_risk_engine(patients, NUM6, KEY, order_cols=["row_index"])
    assert r["top_risk"].first()["patient_id"] == sample.patient_id[expected_risk(sample).idxmax()]
    assert r["anomaly_report"].count() <= 10
    p = api.get_patient_profile(patients, KEY, NUM6, "diagnosis", keys=[("P001",)])
    assert p["similar"].count() == 4 and p["risk"].count() == 30


def test_similarity_trend_survival_rules(patients):
    s = api.find_similar_patients(patients, NUM6, KEY, {"glucose": 130.0})
    assert s["similar"].count() == 5
    t = api.run_trend_analysis(patients, ["glucose", "bmi"], ["row_index"])
    assert t["trends"].count() == 2 and t["forecasts"].count() == 20
    km = api.run_kaplan_meier(patients.withColumn("e", (F.col("diagnosis") == "Diabetic").cast("int")), "age", "e",
                              "gender")
    assert km.median.count() == 2
    ev = api.evaluate_rules(patients, api.suggest_rules(patients), KEY)
    assert ev["rules"].count() == 14 and ev["status"].first()["overall_status"] in ("CRITICAL", "WARNING")


def test_compare_privacy_coding(patients):
    c = api.compare(patients.where("gender = 'Male'"), patients.where("gender = 'Female'"))
    assert c["summary"].first()["n_compared"] == 7
    assert api.run_privacy_check(patients, KEY)["compliance"].first()["compliance_score"] == 80
    assert api.anonymise(patients, ["patient_id"], "mask").data.first()["patient_id"].startswith("P")
    assert api.detect_icd_codes(patients, KEY).count() == 2
    assert api.check_drug_interactions(patients).count() == 0


@pytest.mark.parametrize("model_type", ["kmeans", "dbscan", "hierarchical"])
def test_clustering(patients, model_type):
    c = api.run_clustering(patients, NUM6, KEY, n_clusters=3, model_type=model_type, eps=1.5, min_samples=3)
    assert c["labels"].count() == 30 and c["scatter"].count() == 30


def test_supervised(patients):
    r = api.run_regression(patients, ["age", "bmi"], "glucose", KEY, model_type="linear")
    assert r["metrics"].count() == 1
    c = api.run_classification(patients, NUM6, "diagnosis", KEY, model_type="linear")
    assert set(c["classes"]) == {"Diabetic", "Healthy", "Pre-diabetic"}
    e = api.run_explainability(patients, ["age", "bmi"], "glucose", KEY, model_type="linear")
    assert e["local_contributions"].count() == 60
    preds = api.predict_new_input(patients, ["age", "bmi"], "diagnosis", KEY,
                                  patients.select("patient_id", "age").limit(3), KEY)
    assert preds.count() == 3
