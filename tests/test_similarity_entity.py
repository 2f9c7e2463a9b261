import pandas as pd
import pytest
from pyspark.sql import functions as F

from conftest import NUM6
from vitalspark.operators import entity, similarity


def neighbours(sample, who):
    """(patient_id, distance) of all rows by standardised Euclidean distance."""
    z = (sample[NUM6] - sample[NUM6].mean()) / sample[NUM6].std(ddof=0)
    d = ((z - z.loc[who]) ** 2).sum(axis=1) ** 0.5
    return sorted(zip(d.round(9), sample.patient_id, d))


def test_similar_patients_golden(patients, sample):
    q = patients.where("patient_id = 'P001'").first().asDict()
    nn, _ = similarity.find_similar(patients, NUM6, ["patient_id"], [{c: q[c] for c in NUM6}], n_similar=6)
    got = [(r["patient_id"], round(r["distance"], 4)) for r in nn.orderBy("rank").collect()]
    assert got == [(p, round(d, 4)) for _, p, d in neighbours(sample, 0)[:6]]


def test_similar_rows_excludes_self(patients, sample):
    out = similarity.similar_rows(patients, NUM6, ["patient_id"], [("P001",)]).orderBy("rank").collect()
    assert [r["patient_id"] for r in out] == [p for _, p, _ in neighbours(sample, 0)[1:5]]


def test_profile_cells_percentiles(patients):
    cells = entity.profile_cells(patients.drop("row_index"), ["patient_id"], ["glucose"], "age")
    rows = cells.where("column = 'age'").collect()
    ages = sorted(r["value"] for r in rows)
    for r in rows:
        assert r["percentile"] == pytest.approx(sum(a < r["value"] for a in ages) / 30 * 100)
        assert 0 <= r["percentile"] < 100
    risk = entity.risk_profile(patients, ["patient_id"], NUM6).collect()
    assert all(r["risk_level"] in ("LOW", "MEDIUM", "HIGH") for r in risk)


def test_profile_cells_hot_and_missing_values(spark):
    """Half of the rows hold one value, a quarter none; every column has its
    row, lists and texts as text; figures as pandas has them."""
    rows = [(i, 5.0 if i % 2 else None if i % 4 else float(i), None if i % 3 else f"t{i}", [i]) for i in range(4000)]
    df = spark.createDataFrame(rows, "k long, v double, s string, l array<int>")
    cells = entity.profile_cells(df, ["k"], ["s"], other_columns=True).collect()
    got = {(r["k"], r["column"]): r for r in cells}
    assert len(cells) == len(got) == 12000
    v = pd.Series([r[1] for r in rows], dtype=float)
    below = v.rank(method="min") - 1
    for i, value, text, _ in rows:
        r = got[i, "v"]
        assert (r["value"], r["text_value"], r["is_missing"]) == (value, None, value is None)
        assert r["percentile"] == (None if value is None else pytest.approx(below[i] / v.count() * 100))
        assert r["median"] == v.median() and r["mean"] == pytest.approx(v.mean())
        t = got[i, "s"]
        assert (t["text_value"], t["is_missing"], t["is_feature"], t["percentile"]) == (text, text is None, True, None)
        assert got[i, "l"]["text_value"] == f"[{i}]"
    texts = entity.profile_cells(df.select("k", "s"), ["k"], other_columns=True)
    assert texts.count() == 4000 and entity.profile_cells(df.limit(0), ["k"], other_columns=True).collect() == []


def test_cohort_comparison(patients, sample):
    qv = [{"glucose": 140.0}]
    nn, cols = similarity.find_similar(patients, NUM6, ["patient_id"], qv)
    comp = {r["feature"]: r for r in similarity.cohort_comparison(patients, cols, ["patient_id"], nn, qv).collect()}
    assert comp["glucose"]["query_value"] == 140.0
    assert comp["glucose"]["diff_from_pop"] == pytest.approx(140.0 - sample.glucose.mean())
    assert comp["age"]["query_value"] == pytest.approx(sample.age.mean())


def test_profile_keys_matches_all_rows_profile(patients):
    df = patients.drop("row_index")
    some = entity.profile_keys(df, ["patient_id"], [("P001",), ("P013",)], ["glucose"], "age")
    full = entity.profile_cells(df, ["patient_id"], ["glucose"], "age").where("patient_id IN ('P001', 'P013')")
    a = {(r["patient_id"], r["column"]): r for r in some.collect()}
    b = {(r["patient_id"], r["column"]): r for r in full.collect()}
    assert a.keys() == b.keys() and len(a) == 12
    for k in a:
        for f in ("value", "percentile", "mean", "median", "std", "z_score"):
            assert a[k][f] == pytest.approx(b[k][f])
        assert (a[k]["is_outlier"], a[k]["direction"]) == (b[k]["is_outlier"], b[k]["direction"])


def _brute_nearest(data, queries, k):
    """[(query, rank, key, distance)], ties by key."""
    z = {i: v for i, v in data if v is not None and not any(x is None for x in v)}
    out = []
    for q, point in enumerate(queries):
        order = sorted((sum((a - b) ** 2 for a, b in zip(v, point)) ** 0.5, i) for i, v in z.items())
        out += [(q, r + 1, i, round(d, 9)) for r, (d, i) in enumerate(order[:k])]
    return out


def test_nearest_equals_brute_force_whatever_the_blocks(spark, monkeypatch):
    """Equal rows, ties at the last place, missing coordinates; one plan and one
    result for one block of queries or many, and for merges over several levels."""
    import random
    rng = random.Random(2)
    data = [(i, [float(rng.randint(0, 3)), float(rng.randint(0, 3))]) for i in range(300)]
    data += [(300 + i, [1.0, 1.0]) for i in range(150)] + [(900, None), (901, [None, 1.0])]
    queries = [[float(rng.randint(0, 3)), rng.random()] for _ in range(23)]
    df = spark.createDataFrame(data, "k long, z array<double>").repartition(7)
    want = _brute_nearest(data, queries, 4)

    def run():
        out = similarity.nearest(df, F.col("z"), queries, ["k"], 4)
        return sorted((r["query"], r["rank"], r["k"], round(r["distance"], 9)) for r in out.collect())
    assert run() == want
    for name, value in (("QUERY_CELLS", 10), ("DISTANCES", 50), ("FAN", 2)):
        monkeypatch.setattr(similarity, name, value)
        assert run() == want
    table = spark.createDataFrame([(f"q{i:02}", *map(float, q)) for i, q in enumerate(queries)], "name string, a double, b double")
    flat = df.where("z IS NOT NULL").selectExpr("k", "z[0] AS a", "z[1] AS b")
    out = similarity.nearest_to_table(flat, ["a", "b"], ["k"], table, ["name"], 4, with_values=True).collect()
    assert len(out) == 23 * 4 and {r["name"] for r in out} == {f"q{i:02}" for i in range(23)}
    values = {i: v for i, v in data}
    assert all([r["a"], r["b"]] == values[r["k"]] for r in out)


def test_many_queries_meet_only_near_boxes(spark, monkeypatch):
    """Boxes give the brute-force lists (ties by key, equal rows), and compare far
    fewer pairs than there are; no query is a Python call of its own."""
    import numpy as np
    rng = np.random.default_rng(5)
    data = [(i, [float(x), float(y)]) for i, (x, y) in enumerate(rng.integers(0, 128, (1500, 2)) / 128)]
    data += [(5000 - i, [0.5, 0.5]) for i in range(200)]
    queries = [[float(x), float(y)] for x, y in rng.integers(0, 128, (similarity.BOXED_QUERIES, 2)) / 128]
    df = spark.createDataFrame(data, "k long, z array<double>").repartition(3)
    out = similarity.nearest(df, F.col("z"), queries, ["k"], 3)
    assert "FlatMapGroups" not in out._jdf.queryExecution().executedPlan().toString()
    got = {(r["query"], r["rank"]): (r["k"], r["distance"]) for r in out.collect()}
    z, keys = np.array([v for _, v in data]), np.array([i for i, _ in data])
    for q, point in enumerate(queries):
        square = (z[:, 0] - point[0]) ** 2 + (z[:, 1] - point[1]) ** 2
        for rank, i in enumerate(np.lexsort((keys, square))[:3]):
            assert got[q, rank + 1][0] == keys[i] and got[q, rank + 1][1] == pytest.approx(square[i] ** 0.5)
    assert len(got) == 3 * len(queries)
    many = rng.random((20000, 2))
    seen, whole, all_pairs = [0], similarity._candidates, len(data) * len(many)

    def counted(rows, points, own, k):
        seen[0] += len(rows) * len(points)
        return whole(rows, points, own, k)
    monkeypatch.setattr(similarity, "_candidates", counted)
    list(similarity._boxed_candidates(z, many, similarity._boxes(many, similarity.BOX), 3))
    assert seen[0] < all_pairs / 4


def test_nearest_sorts_nothing_before_the_limit(spark):
    df = spark.range(1000).selectExpr("id AS k", "array(double(id), double(id % 7)) AS z")
    plan = similarity.nearest(df, F.col("z"), [[1.0, 2.0]], ["k"], 3)._jdf.queryExecution().executedPlan().toString()
    below = plan[plan.index("MapInArrow"):]
    assert "Sort" not in below and "Window" not in plan and "NestedLoop" not in plan


def test_nearest_of_an_empty_table(spark):
    df = spark.createDataFrame([], "k long, a double, b double")
    assert similarity.nearest(df, F.array("a", "b"), [[1.0, 2.0]], ["k"], 3).collect() == []
    queries = spark.createDataFrame([], "name string, a double, b double")
    some = spark.createDataFrame([(1, 1.0, 2.0)], "k long, a double, b double")
    assert similarity.nearest_to_table(some, ["a", "b"], ["k"], queries, ["name"]).collect() == []
