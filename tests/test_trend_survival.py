import numpy as np
import pytest
from pyspark.sql import functions as F

from vitalspark.operators import survival, trend


def test_trend_golden(patients, sample):
    ti = trend.trend_input(patients, ["glucose"], ["row_index"])
    fit = trend.linear_trend(ti).first()
    slope, intercept = np.polyfit(range(30), sample.glucose, 1)
    assert (fit["slope"], fit["intercept"]) == pytest.approx((slope, intercept))
    assert fit["r2"] == pytest.approx(np.corrcoef(range(30), sample.glucose)[0, 1] ** 2)
    lines = trend.trend_lines(ti, trend.linear_trend(ti)).orderBy("idx").collect()
    assert lines[0]["window"] == 3
    vals = [r["value"] for r in lines]
    ma = [sum(vals[i - 1:i + 2]) / 3 for i in range(1, len(vals) - 1)]
    expect = [ma[0]] + ma + [ma[-1]]
    assert [r["moving_avg"] for r in lines] == pytest.approx(expect)


def test_all_columns_and_any_magnitude(spark):
    rows = [(i, *[float(i * (c + 1) % 7) for c in range(6)], i * 3e-11, i * 5e20) for i in range(1, 41)]
    names = [f"c{j}" for j in range(8)]
    ti = trend.trend_input(spark.createDataFrame(rows, ["i", *names]), names, ["i"])
    fit = trend.linear_trend(ti)
    assert fit.count() == 8
    lines = trend.trend_lines(ti, fit).where("idx = 20").collect()
    got = {r["column"]: r["moving_avg"] for r in lines}
    for j, c in enumerate(names):
        assert got[c] == pytest.approx(np.mean([rows[k][j + 1] for k in range(18, 22)]), rel=1e-9), c


def test_moving_average_matches_pandas_even_window(spark):
    import pandas as pd
    vals = [float((i * 37) % 11) for i in range(43)]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vals)], "i long, v double")
    ti = trend.trend_input(df, ["v"], ["i"])
    got = [r["moving_avg"] for r in trend.trend_lines(ti, trend.linear_trend(ti)).orderBy("idx").collect()]
    w = max(3, len(vals) // 10)  # 4: an even, off-centre window
    want = pd.Series(vals).rolling(w, center=True).mean().bfill().ffill().tolist()
    assert got == pytest.approx(want)


def test_forecast_and_corr(patients):
    ti = trend.trend_input(patients, ["glucose"], ["row_index"])
    fc = trend.forecast(trend.linear_trend(ti), []).orderBy("x").collect()
    assert [r["x"] for r in fc] == list(range(30, 40))
    corr = trend.correlation_matrix(patients, ["age", "glucose", "bmi"]).collect()
    assert len(corr) == 3 and all(-1 <= r["corr"] <= 1 for r in corr)


def expected_curve(sample):
    s, out = 1.0, []
    for t in sorted(set(sample.age[sample.diagnosis == "Diabetic"])):
        at_risk, deaths = (sample.age >= t).sum(), ((sample.age == t) & (sample.diagnosis == "Diabetic")).sum()
        s *= 1 - deaths / at_risk
        out.append((t, at_risk, round(s, 4)))
    return out


def test_kaplan_meier_golden(patients, sample):
    df = patients.withColumn("event", (F.col("diagnosis") == "Diabetic").cast("int"))
    rep = survival.run_kaplan_meier(df, "age", "event")
    curve = [(r["t"], r["at_risk"], round(r["survival"], 4))
             for r in rep.curve.where(~F.col("is_start")).orderBy("t").collect()]
    want = expected_curve(sample)
    assert [(t, n) for t, n, _ in curve] == [(t, n) for t, n, _ in want]
    assert [x for *_, x in curve] == pytest.approx([x for *_, x in want], abs=1e-4)
    assert rep.median.first()["median_survival"] == next((t for t, _, x in want if x <= 0.5), None)
    s, events = rep.summary.first(), int((sample.diagnosis == "Diabetic").sum())
    assert (s["n_events"], s["n_censored"], s["n_total"]) == (events, 30 - events, 30)
    surv = [r["survival"] for r in rep.curve.orderBy("t", F.col("is_start").desc()).collect()]
    assert all(a >= b for a, b in zip(surv, surv[1:])) and all(0 <= x <= 1 for x in surv)


def test_survival_needs_five_rows(spark):
    df = spark.createDataFrame([(1.0, 1), (2.0, 0)], "d double, e int")
    with pytest.raises(ValueError):
        survival.run_kaplan_meier(df, "d", "e")


def test_moving_average_by_messages_equals_brute_force(spark):
    """One group with half of all rows, groups of 1 to 40 rows, text keys, and
    a plan without self-joins."""
    import numpy as np
    from vitalspark.operators import trend
    r = np.random.default_rng(5)
    sizes = {0: 900, **{g: g for g in range(1, 41)}}
    rows = [(g, f"{j:05d}", float(r.integers(0, 1000))) for g, n in sizes.items() for j in range(n)]
    df = spark.createDataFrame([rows[j] for j in r.permutation(len(rows))], "g long, at string, v double")
    ti = trend.trend_input(df, ["v"], ["at"], ["g"])
    lines = trend.trend_lines(ti, trend.linear_trend(ti))
    plan = lines._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 2  # the two tables with one row a group
    got = {}
    for x in lines.collect():
        got.setdefault(x["g"], []).append((x["idx"], x["at"], x["value"], x["moving_avg"], x["window"]))
    for g, n in sizes.items():
        mine = sorted(got[g])
        v = [q[2] for q in rows if q[0] == g]
        w = max(3, n // 10)
        o = (w - 1) // 2
        assert [(m[0], m[1], m[2]) for m in mine] == [(j, f"{j:05d}", v[j]) for j in range(n)]
        for j, m in enumerate(mine):
            if n < w:
                assert m[3] is None
                continue
            c = min(max(j, w - 1 - o), n - 1 - o)
            assert m[4] == w and abs(m[3] - np.mean(v[c - (w - 1 - o):c + o + 1])) < 1e-9
