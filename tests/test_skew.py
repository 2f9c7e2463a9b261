"""Hot groups: one entity holds a large share of the rows.  Results must equal
a plain per-group computation (pandas / Python) whatever the partitioning."""
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from vitalspark.operators import survival, trend


def _events(spark, n=4000, seed=3):
    rng = np.random.default_rng(seed)
    users = np.where(rng.random(n) < 0.4, 0, rng.integers(1, 40, n))   # user 0 holds ~40 %
    ts = rng.permutation(n)
    vals = np.round(rng.gamma(2.0, 10.0, n), 2)
    pdf = pd.DataFrame({"user_id": users, "ts": ts, "event_id": np.arange(n), "value": vals})
    return pdf, spark.createDataFrame(pdf).repartition(7)


def test_trend_per_user_with_hot_user(spark):
    pdf, df = _events(spark)
    ti = trend.trend_input(df, ["value"], ["ts", "event_id"], ["user_id"])
    fit = trend.linear_trend(ti)
    got_fit = {r["user_id"]: r for r in fit.collect()}
    got_ma = {(r["user_id"], r["idx"]): r["moving_avg"] for r in trend.trend_lines(ti, fit).collect()}
    for u, g in pdf.sort_values(["ts", "event_id"]).groupby("user_id"):
        y = g["value"].to_numpy()
        x = np.arange(len(y))
        if len(y) > 1:
            slope, intercept = np.polyfit(x, y, 1)
            assert got_fit[u]["slope"] == pytest.approx(slope, rel=1e-6, abs=1e-9)
            assert got_fit[u]["intercept"] == pytest.approx(intercept, rel=1e-6)
        w = max(3, len(y) // 10)
        want = pd.Series(y).rolling(w, center=True).mean().bfill().ffill().tolist()
        got = [got_ma[(u, i)] for i in range(len(y))]
        assert got == pytest.approx(want, nan_ok=True)


def test_kaplan_meier_hot_group(spark):
    rng = np.random.default_rng(4)
    n = 3000
    grp = np.where(rng.random(n) < 0.5, "hot", rng.choice(["a", "b", "c"], n))
    t = rng.integers(1, 200, n).astype(float)
    e = (rng.random(n) < 0.6).astype(int)
    pdf = pd.DataFrame({"g": grp, "t": t, "e": e})
    df = spark.createDataFrame(pdf).repartition(5)
    rows = survival.survival_input(df, "t", "e", "g")
    curve = {(r["group"], r["t"]): r["survival"] for r in survival.km_curve(rows).where(~F.col("is_start")).collect()}
    for g, sub in pdf.groupby("g"):
        s = 1.0
        for time in sorted(sub.loc[sub.e == 1, "t"].unique()):
            d = sub.loc[sub.t == time, "e"].sum()
            at_risk = (sub.t >= time).sum()
            s *= 1 - d / at_risk
            assert curve[(g, time)] == pytest.approx(s, rel=1e-9)


def test_hot_key_sinks_and_anonymisation(spark):
    from vitalspark.operators import coding, privacy
    from vitalspark.sources import sinks
    rows = [(i, "hot" if i % 3 else f"v{i % 50}", i % 7, f"msg {i}" + (" warfarin" if i == 5 else "")
             + (" aspirin" if i == 9000 else "")) for i in range(9001)]
    df = spark.createDataFrame(rows, "k long, v string, g long, text string").repartition(6)
    latest = {r["v"]: r["k"] for r in sinks.latest_per_key(df, ["v"], ["k"]).collect()}
    assert latest["hot"] == 8999 and latest["v0"] == 9000   # 9000 % 3 == 0 -> "v0"
    res = privacy.anonymise(df, ["v"], "pseudonymise", order_cols=["k"])
    got = {r["k"]: r["v"] for r in res.data.where("k < 4").collect()}
    assert got == {0: "PATIENT_00001", 1: "PATIENT_00002", 2: "PATIENT_00002", 3: "PATIENT_00003"}
    one_conv = df.withColumn("conv", F.lit(1))
    pairs = coding.drug_interactions_by(one_conv, ["conv"], "text").collect()
    assert [(r["drug_a"], r["drug_b"]) for r in pairs] == [("warfarin", "aspirin")]
