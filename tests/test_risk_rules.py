import math

import pytest
from pyspark.sql import functions as F

from conftest import NUM6
from vitalspark.operators import risk, rules


def expected_risk(sample):
    """Rounded mean and std; sum of min(|z|, 3) as a share of the largest sum."""
    mean, std = sample[NUM6].mean().round(3), sample[NUM6].std().round(3)
    z = ((sample[NUM6] - mean) / std).abs().clip(upper=3)
    return (z.sum(axis=1) / len(NUM6) / 3 * 100).round(1)


def test_risk_engine_golden(patients, sample):
    rep = risk.run_risk_engine(patients, NUM6, ["patient_id"], order_cols=["row_index"])
    mean, std = sample[NUM6].mean(), sample[NUM6].std()
    want = []
    for c in NUM6:
        critical, high = (sample[c] > round(mean[c] + 3 * std[c], 3)).sum(), (sample[c] > round(mean[c] + 2 * std[c], 3)).sum()
        low = (sample[c] < round(mean[c] - 2 * std[c], 3)).sum()
        if critical or high:
            want.append((c, "CRITICAL" if critical else "WARNING", critical or high))
        if low:
            want.append((c, "LOW", low))
    assert [(a["column"], a["level"], a["count"]) for a in rep.alerts.collect()] == want
    changes = {r["column"]: r for r in rep.change_alerts.collect()}
    assert set(changes) == set(NUM6)  # all columns, not the first few
    for c, r in changes.items():
        pct = abs(sample[c].tail(10).mean() - mean[c]) / mean[c] * 100
        assert r["change_percent"] == pytest.approx(pct) and r["is_alert"] == (pct > 20)
    score = expected_risk(sample)
    best = score.sort_values(ascending=False, kind="stable").head(10)
    top = [(r["patient_id"], r["risk_score"]) for r in rep.top.collect()]
    assert [s for _, s in top] == pytest.approx(best.tolist(), abs=0.11)
    assert top[0][0] == sample.patient_id[best.index[0]]
    dist = rep.distribution.first()
    assert (dist["high_risk_count"], dist["total"]) == ((score > 60).sum(), 30)


def test_every_alert_level(spark):
    rows = [(float(i % 7), 50.0, 10.0) for i in range(97)] + [(500.0, 0.0, 10.0)] + [(3.0, 50.0, 14.0)] * 2
    df = spark.createDataFrame(rows, "a double, b double, c double").withColumn("d", F.when(F.col("c") > 13, 9.0).otherwise(F.col("a")))
    levels = {(r["column"], r["level"]) for r in risk.run_risk_engine(df, ["a", "b", "c"], ["a"]).alerts.collect()}
    assert {("a", "CRITICAL"), ("b", "LOW"), ("c", "CRITICAL")} <= levels


def test_nan_is_missing_in_rules_and_filters(spark):
    from vitalspark.operators import filters, quality, similarity
    rows = [(1, 150.0), (2, float("nan")), (3, 100.0), (4, None), (5, 200.0)]
    df = spark.createDataFrame(rows, "k long, g double")
    r = rules.evaluate_rules(df, [{"column": "g", "operator": ">", "value": 140}]).first()
    assert (r["n_triggered"], r["n_total"], r["col_mean"], r["col_max"]) == (2, 3, 150.0, 200.0)
    assert sorted(x["k"] for x in rules.triggered_rows(df, [{"column": "g", "operator": ">", "value": 140}], ["k"]).collect()) == [1, 5]
    assert [x["k"] for x in filters.filter_chain(df, [{"col": "g", "op": ">", "value": 140}]).orderBy("k").collect()] == [1, 5]
    assert [x["g"] for x in filters.impute_mean(df, ["g"]).orderBy("k").collect()] == [150.0, 150.0, 100.0, 150.0, 200.0]
    c = rules.compare_datasets(df, df).where("column = 'g'").first()
    assert (c["n_a"], c["mean_a"]) == (3, 150.0)
    near = similarity.similar_rows(df, ["g"], ["k"], [(1,)]).collect()
    assert all(x["distance"] == x["distance"] for x in near) and len(near) == 4
    assert all(x["max"] == x["max"] for x in quality.outlier_report(df).collect())


def test_rules_golden(patients, sample):
    rs = [{"column": "glucose", "operator": ">", "value": 125},
          {"column": "blood_pressure_systolic", "operator": ">", "value": 140},
          {"column": "bmi", "operator": ">", "value": 30},
          {"column": "age", "operator": ">", "value": 65},
          {"column": "cholesterol", "operator": ">", "value": 240},
          {"column": "cholesterol", "operator": ">", "value": 200},
          {"column": "glucose", "operator": ">", "value": 140, "severity": "critical"},
          {"column": "missing", "operator": ">", "value": 1}]
    ev = rules.evaluate_rules(patients, rs).orderBy("rule_id").collect()
    want = [int((sample[r["column"]] > r["value"]).sum()) for r in rs[:-1]]
    assert [r["n_triggered"] for r in ev] == want
    assert [r["status"] for r in ev] == ["TRIGGERED" if n else "CLEAR" for n in want] and want[0] > 0
    status = rules.rollup_status(rules.evaluate_rules(patients, rs)).first()
    assert status["overall_status"] == ("CRITICAL" if want[-1] else "WARNING")
    rows = rules.triggered_rows(patients, rs[:1], ["patient_id"]).orderBy("rank").collect()
    assert [r["patient_id"] for r in rows] == sample.patient_id[sample.glucose > 125].head(10).tolist()


def test_unknown_operator_raises(patients):
    with pytest.raises(ValueError):
        rules.evaluate_rules(patients, [{"column": "age", "operator": "~", "value": 1}])


def test_rule_suggestions_golden(patients):
    sug = rules.suggest_rules(patients.columns)
    per = {}
    for s in sug:
        per[s["column"]] = per.get(s["column"], 0) + 1
    assert len(sug) == 14
    assert per == {"age": 1, "blood_pressure_systolic": 4, "blood_pressure_diastolic": 2, "cholesterol": 2,
                   "glucose": 3, "bmi": 2}


def test_compare_golden(patients, sample):
    from pyspark.sql import functions as F
    a = patients.where(F.col("gender") == "Male")
    b = patients.where(F.col("gender") == "Female")
    r = {x["column"]: x for x in rules.compare_datasets(a, b).collect()}["glucose"]
    x, y = (sample.glucose[sample.gender == g] for g in ("Male", "Female"))
    d = (x.mean() - y.mean()) / ((x.var() + y.var()) / 2) ** 0.5
    t = (x.mean() - y.mean()) / (x.var() / 15 + y.var() / 15) ** 0.5
    assert (r["n_a"], r["n_b"]) == (15, 15)
    assert (r["mean_a"], r["mean_b"]) == pytest.approx((x.mean(), y.mean()))
    assert r["cohens_d"] == pytest.approx(d) and r["t_stat"] == pytest.approx(t)
    assert r["effect_size"] == next((b for cut, b in ((.8, "large"), (.5, "medium"), (.2, "small")) if abs(d) > cut), "negligible")
    assert r["p_approx"] == pytest.approx(2 * (1 - min(abs(t) / (abs(t) + 3), .999)))
    assert r["p_normal"] == pytest.approx(math.erfc(abs(t) / 2 ** 0.5), rel=1e-6)


def test_two_sided_normal(spark):
    from pyspark.sql import functions as F
    rows = spark.createDataFrame([(t,) for t in (-9.0, -2.0, -1e-4, 0.0, 0.3, 1.96, 6.0, 60.0)], "t double")
    for r in rows.select("t", rules.two_sided_normal(F.col("t")).alias("p")).collect():
        assert r["p"] == pytest.approx(math.erfc(abs(r["t"]) / 2 ** 0.5), rel=2e-6, abs=1e-300)


def test_result_grading_branches(spark):
    from vitalspark.operators import narrative
    res = spark.createDataFrame(
        [("regression", "glucose", 3, 30, 0.85, None, None, None),
         ("classification", "diagnosis", 6, 1234, None, 0.6, None, None),
         ("clustering", None, 6, 30, None, None, 0.25, 3)],
        "task string, target string, n_features int, total_rows long, r2 double, accuracy double, "
        "silhouette double, n_clusters long")
    g = {r["task"]: r for r in narrative.grade_results(res).collect()}
    assert g["regression"]["summary"].endswith("achieving an R² score of 85.0%.")
    assert "strong" in g["regression"]["recommendation"] and g["regression"]["confidence"] == "high"
    assert "1,234 patients" in g["classification"]["summary"]
    assert g["classification"]["risk_flag"].startswith("Accuracy 60.0% may be insufficient")
    assert g["clustering"]["risk_flag"].startswith("Low silhouette")
    assert g["clustering"]["confidence"] == "medium"


def test_rule_table_path_matches_inline(patients):
    rs = [{"column": c, "operator": op, "value": v}
          for c in ("glucose", "bmi", "age") for op in (">", "<", ">=", "<=", "==", "!=") for v in (30, 45, 100)]
    inline = {r["rule_id"]: r["n_triggered"] for r in rules.evaluate_rules(patients, rs).collect()}
    table = {r["rule_id"]: r["n_triggered"] for r in
             rules.evaluate_rules_table(patients, rules.rules_frame(patients.sparkSession, rs, patients.columns))
             .collect()}
    assert inline == table and len(inline) == len(rs)
    many = rs * 12
    big = rules.evaluate_rules(patients, many).collect()
    assert len(big) == len(many) and {r["rule_id"] % len(rs): r["n_triggered"] for r in big} == inline


def _brute_rules(values, rs, k):
    import operator as o
    ops = {">": o.gt, "<": o.lt, ">=": o.ge, "<=": o.le, "==": o.eq, "!=": o.ne}
    out = {}
    for i, r in enumerate(rs):
        hits = [key for key, v in sorted(values[r["column"]]) if v is not None and ops[r["operator"]](v, r["value"])]
        out[i] = (len(hits), hits[:k])
    return out


@pytest.mark.parametrize("n_rules", [1, 60, 3000])
def test_threshold_index_equals_comparing_every_row(spark, monkeypatch, n_rules):
    """Any number of rules, thresholds in one block or several, places merged
    in one group or many; a hot value, nulls and a column without values."""
    import random
    rng = random.Random(n_rules)
    rows = [(i, float(rng.randint(0, 40)) if i % 3 else 7.0, None if rng.random() < 0.2 else rng.random() * 10, None)
            for i in range(400)]
    df = spark.createDataFrame(rows, "k long, a double, b double, c double").repartition(5)
    rs = [{"column": rng.choice("abc"), "operator": rng.choice(rules.OPERATORS), "value": float(rng.randint(-2, 43))}
          for _ in range(n_rules)]
    values = {c: [(r[0], r[j]) for r in rows] for j, c in ((1, "a"), (2, "b"), (3, "c"))}
    want = _brute_rules(values, rs, 4)
    for blocks in ((1 << 20, 4096), (17, 5)):
        monkeypatch.setattr(rules, "THRESHOLDS", blocks[0])
        monkeypatch.setattr(rules, "PLACES", blocks[1])
        got = {r["rule_id"]: r for r in rules.evaluate_rules(df, rs).collect()}
        assert {i: r["n_triggered"] for i, r in got.items()} == {i: n for i, (n, _) in want.items()}
        assert all(r["n_total"] == sum(v is not None for _, v in values[r["column"]]) for r in got.values())
        first = {}
        for r in rules.triggered_rows(df, rs, ["k"], 4).orderBy("rule_id", "rank").collect():
            first.setdefault(r["rule_id"], []).append(r["k"])
        assert first == {i: keys for i, (_, keys) in want.items() if keys}


def test_rules_have_one_plan_for_any_number(patients):
    def shape(n):
        rs = [{"column": "age", "operator": ">", "value": float(v)} for v in range(n)]
        plan = rules.evaluate_rules(patients, rs)._jdf.queryExecution().optimizedPlan().toString()
        return [line.split("(")[0].strip(" +-:").split(" ")[0] for line in plan.splitlines()]
    assert shape(1) == shape(1000)


def test_change_alerts_per_entity(spark):
    from pyspark.sql import functions as F
    rows = [(u, i, 10.0 if (u == 1 and i >= 40) else 1.0) for u in (1, 2) for i in range(50)] + [(3, 0, 5.0)]
    df = spark.createDataFrame(rows, "u long, t long, x double")
    out = {r["u"]: r for r in risk.change_alerts_by(df, ["x"], ["t"], ["u"]).collect()}
    assert set(out) == {1, 2}                       # entity 3 has too few rows
    assert out[1]["is_alert"] and out[1]["recent_avg"] == 10.0 and out[1]["direction"] == "increasing"
    assert not out[2]["is_alert"] and out[2]["change_percent"] == 0.0
