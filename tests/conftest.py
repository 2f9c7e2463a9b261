import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF = "/root/testdata/sf0.001"
NUM6 = ["age", "blood_pressure_systolic", "blood_pressure_diastolic", "cholesterol", "glucose", "bmi"]


def patient_rows() -> list[dict]:
    """Thirty invented patients: residues of multiples, so every number is
    spread evenly over its range and no row is copied from anywhere."""
    rows = []
    for i in range(30):
        rows.append({
            "patient_id": f"P{i + 1:03d}", "age": 24 + (i * 19) % 47, "gender": ("Male", "Female")[i % 2],
            "blood_pressure_systolic": 104 + (i * 23) % 61, "blood_pressure_diastolic": 64 + (i * 11) % 43,
            "cholesterol": 158 + (i * 37) % 127, "glucose": 76 + (i * 29) % 67,
            "bmi": round(19.4 + (i * 13) % 31 * 0.6, 1), "smoking": "Yes" if i % 7 in (0, 3, 5) else "No",
            "diabetes_risk": ("High", "Low", "Medium")[(i * i + i // 4) % 3],
            "diagnosis": ("Healthy", "Diabetic", "Pre-diabetic")[(i + i // 5) % 3]})
    return rows


@pytest.fixture(scope="session")
def spark():
    from vitalspark.session import build_session
    s = build_session(master="local[4]", shuffle_partitions=4, app="vitalspark-tests")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def patients(spark, tmp_path_factory):
    """The invented table, written as CSV and read through the CSV source
    (header and inferred types), with its file position as ``row_index``."""
    import pandas as pd
    from pyspark.sql import functions as F
    from vitalspark.sources.files import read_csv
    path = tmp_path_factory.mktemp("patients") / "patients.csv"
    pd.DataFrame(patient_rows()).to_csv(path, index=False)
    df = read_csv(spark, str(path))
    return df.withColumn("row_index", F.regexp_extract("patient_id", r"([0-9]+)", 1).cast("int") - 1)


@pytest.fixture(scope="session")
def sample():
    """The same table in pandas, for independent expectations."""
    import pandas as pd
    return pd.DataFrame(patient_rows())
