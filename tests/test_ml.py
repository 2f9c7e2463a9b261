import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import NUM6
from vitalspark.ml import cluster, dbscan, explain, isoforest, supervised, ward


def test_regression_and_importance(patients):
    fr = supervised.fit(patients, ["age", "bmi", "gender"], "glucose", ["patient_id"], task="regression",
                        model_type="linear")
    m = supervised.regression_metrics(fr.predictions).first()
    assert m["mse"] >= 0 and m["rmse"] == pytest.approx(m["mse"] ** 0.5)
    imp = supervised.importances(fr).collect()
    assert sum(r["importance"] for r in imp) == pytest.approx(1.0)


def test_classification_report(patients):
    fr = supervised.fit(patients, NUM6, "diagnosis", ["patient_id"], task="classification", holdout=False,
                        trees=20)
    from vitalspark.ml.prep import label_names
    assert label_names(fr.prep) == ["Diabetic", "Healthy", "Pre-diabetic"]
    rep = {r["class"]: r for r in supervised.classification_report(fr.predictions, label_names(fr.prep)).collect()}
    assert rep["accuracy"]["support"] == 30
    assert sum(rep[c]["support"] for c in ("Diabetic", "Healthy", "Pre-diabetic")) == 30
    for r in rep.values():
        assert 0 <= r["precision"] <= 1 and 0 <= r["recall"] <= 1
    preds = supervised.predict_inputs(fr, patients.select("patient_id", *NUM6), ["patient_id"]).collect()
    assert all(p["prediction_label"] in ("Diabetic", "Healthy", "Pre-diabetic") for p in preds)
    assert all(0 < p["confidence"] <= 100 for p in preds)


def test_explain_contributions(patients):
    out, imp, base = explain.explain(patients, ["age", "bmi", "glucose"], "cholesterol", ["patient_id"],
                                     model_type="linear", task="regression")
    rows = out.where("patient_id = 'P001'").collect()
    assert len(rows) == 3
    # A linear model's contribution is coef * (x - mean): they add up to f(x) - f(mean).
    assert sum(r["contribution"] for r in rows) == pytest.approx(rows[0]["prediction"] - base, abs=1e-6)


def test_explain_given_inputs(spark, patients):
    """Missing numbers stand for their mean, unseen and missing categories for
    the first; a row of the table explained as an input comes out the same."""
    cols = ["age", "bmi", "gender"]
    inputs = spark.createDataFrame([(1, 40.0, None, "Male"), (2, None, 30.0, "unknown"), (3, float("nan"), 30.0, None)],
                                   "who int, age double, bmi double, gender string")
    out, _, base = explain.explain(patients, cols, "glucose", ["patient_id"], "linear", "regression", inputs=inputs,
                                   input_keys=["who"])
    got = {(r["who"], r["feature"]): r for r in out.collect()}
    assert len(got) == 9 and got[1, "bmi"]["contribution"] == 0 and got[2, "age"]["contribution"] == 0
    assert [got[w, "gender"]["shown_value"] for w in (1, 2, 3)] == ["Male", "Female", "Female"]
    assert got[2, "age"]["value"] == got[3, "age"]["value"] == pytest.approx(patients.toPandas().age.mean())
    for w in (1, 2, 3):
        rows = [r for (k, _), r in got.items() if k == w]
        assert sum(r["contribution"] for r in rows) == pytest.approx(rows[0]["prediction"] - base, abs=1e-6)
    fitted, _, _ = explain.explain(patients, cols, "diagnosis", ["patient_id"], task="classification", trees=5)
    given, _, _ = explain.explain(patients, cols, "diagnosis", ["patient_id"], task="classification", trees=5,
                                  inputs=patients.drop("diagnosis"))
    key = lambda r: (r["patient_id"], r["feature"])
    assert sorted(fitted.collect(), key=key) == sorted(given.collect(), key=key)
    assert all(r["prediction_label"] and 0 < r["confidence"] <= 100 for r in given.collect())


def test_multi_target(patients):
    out = supervised.compare_targets(patients, ["age", "bmi"], ["glucose", "diagnosis"], ["patient_id"], trees=10)
    rows = {r["target"]: r for r in out.collect()}
    assert rows["glucose"]["task"] == "regression" and rows["diagnosis"]["task"] == "classification"
    assert sorted(r["rank"] for r in rows.values()) == [1, 2]


def test_kmeans_pca_stats(patients):
    st = cluster.standardise_features(patients, NUM6, ["patient_id"])
    _, lab = cluster.kmeans(st, k=3, n_init=2)
    stats = cluster.cluster_stats(lab, st.feature_cols).collect()
    assert sum(r["size"] for r in stats) == 30
    sc = cluster.pca_scatter(lab, ["patient_id"]).collect()
    assert len(sc) == 30
    assert -1 <= cluster.silhouette(lab) <= 1


def _brute_iso_score(x, trees, n):
    def one(row, t):
        node, depth = 0, 0
        while t[node, 0] >= 0:
            node = int(t[node, 2] if row[int(t[node, 0])] < t[node, 1] else t[node, 3])
            depth += 1
        return depth + isoforest.c_factor(t[node, 4])
    return np.array([2 ** (-np.mean([one(r, t) for t in trees]) / isoforest.c_factor(n)) for r in x])


def test_isolation_forest_against_brute_force(spark):
    rng = np.random.default_rng(0)
    x = np.vstack([rng.normal(size=(300, 2)), rng.normal(loc=8, size=(6, 2))])
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(x)], "k long, a double, b double")
    trees = isoforest.fit_forest(df, ["a", "b"], ["k"], n_trees=20, sample_size=64)
    assert len(trees) == 20 and all(t[0, 4] == 64 for t in trees)
    scored = {r["k"]: r["anomaly_score"] for r in isoforest.score(df, ["a", "b"], trees, 64).collect()}
    brute = _brute_iso_score(x, trees, 64)
    assert [scored[i] for i in range(len(x))] == pytest.approx(list(brute))
    out = isoforest.isolation_forest(df, ["a", "b"], ["k"], n_trees=50, sample_size=64)
    flagged = {r["k"] for r in out.where("is_anomaly").collect()}
    assert len(flagged) == 31 and set(range(300, 306)) <= flagged


def _brute_dbscan(x, eps, min_samples):
    n = len(x)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    nb = d <= eps
    core = nb.sum(1) >= min_samples
    comp = -np.ones(n, dtype=int)
    c = 0
    for i in range(n):  # components of the core graph, numbered by smallest index
        if core[i] and comp[i] < 0:
            stack = [i]
            comp[i] = c
            while stack:
                j = stack.pop()
                for k in np.flatnonzero(nb[j] & core):
                    if comp[k] < 0:
                        comp[k] = c
                        stack.append(k)
            c += 1
    lab = comp.copy()
    for i in range(n):
        if not core[i]:
            near = [comp[k] for k in np.flatnonzero(nb[i] & core)]
            lab[i] = min(near) if near else -1
    return lab


@pytest.mark.parametrize("dims", [2, 4])
def test_dbscan_against_brute_force(spark, dims):
    rng = np.random.default_rng(dims)
    x = np.vstack([rng.normal(0, 0.3, (120, dims)), rng.normal(3, 0.3, (80, dims)), rng.uniform(-4, 6, (20, dims))])
    cols = [f"f{j}" for j in range(dims)]
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], ["k", *cols])
    got = {r["k"]: r["cluster"] for r in dbscan.dbscan(df, cols, ["k"], eps=0.35, min_samples=5).collect()}
    z = (x - x.mean(0)) / x.std(0)
    want = _brute_dbscan(z, 0.35, 5)
    assert [got[i] for i in range(len(x))] == list(want)


def test_ward_exact_small(spark):
    rng = np.random.default_rng(3)
    x = np.vstack([rng.normal(0, 0.2, (10, 2)), rng.normal(5, 0.2, (10, 2)), rng.normal((0, 5), 0.2, (10, 2))])
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(x)], "k long, a double, b double")
    lab = {r["k"]: r["cluster"] for r in ward.ward(df, ["a", "b"], ["k"], k=3).collect()}
    groups = [{lab[i] for i in range(s, s + 10)} for s in (0, 10, 20)]
    assert all(len(g) == 1 for g in groups) and len(set().union(*groups)) == 3


def _brute_ward(x, k):
    """Merge the pair of clusters that raises the squared error least, until k are left."""
    groups = [[i] for i in range(len(x))]
    while len(groups) > k:
        cost = {(i, j): len(a) * len(b) / (len(a) + len(b)) * ((x[a].mean(0) - x[b].mean(0)) ** 2).sum()
                for i, a in enumerate(groups) for j, b in enumerate(groups) if i < j}
        i, j = min(cost, key=cost.get)
        groups[i] += groups.pop(j)
    return {frozenset(g) for g in groups}


def _groups_of(labels):
    out = {}
    for i, c in labels.items():
        out.setdefault(c, set()).add(i)
    return {frozenset(g) for g in out.values()}


def test_ward_equals_brute_force(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(0, 1, (40, 3)) + rng.integers(0, 3, (40, 1))
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "k long, a double, b double, c double")
    z = (x - x.mean(0)) / x.std(0)
    for k in (2, 5):
        got = {r["k"]: r["cluster"] for r in ward.ward(df, ["a", "b", "c"], ["k"], k=k).collect()}
        assert _groups_of(got) == _brute_ward(z, k)
        sizes = [sum(c == n for c in got.values()) for n in range(k)]
        assert sizes == sorted(sizes, reverse=True)


def _rand_index(a, b):
    a, b = np.asarray(a), np.asarray(b)
    same_a, same_b = a[:, None] == a[None], b[:, None] == b[None]
    return (same_a == same_b)[np.triu_indices(len(a), 1)].mean()


def test_ward_is_one_path_for_all_sizes(spark, monkeypatch):
    """One row more, fewer entries, or several levels of blocks: nearly the
    same clusters, and equal rows always share one."""
    rng = np.random.default_rng(8)
    x = np.vstack([rng.normal(m, 0.6, (250, 2)) for m in ((0, 0), (4, 0), (0, 4), (5, 5))] + [np.full((1, 2), 2.0)])
    x[300:700] = np.where(rng.random((400, 1)) < 0.7, x[300], x[300:700])  # a hot value

    def run(n, **more):
        df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(x[:n])], "k long, a double, b double")
        got = {r["k"]: r["cluster"] for r in ward.ward(df.repartition(5), ["a", "b"], ["k"], k=4, **more).collect()}
        assert sorted(got) == list(range(n))
        equal = {}
        for i in range(n):
            equal.setdefault(tuple(x[i]), set()).add(got[i])
        assert all(len(c) == 1 for c in equal.values())
        return [got[i] for i in range(n)]
    exact = run(1000)
    assert _rand_index(exact, run(1001)[:1000]) >= 0.95
    assert _rand_index(exact, run(1000, entries=120)) >= 0.95
    monkeypatch.setattr(ward, "FAN", 2)
    assert _rand_index(exact, run(1000, entries=120)) >= 0.95


def test_ward_edges(spark):
    schema = "k long, a double, b double"
    assert ward.ward(spark.createDataFrame([], schema), ["a", "b"], ["k"]).collect() == []
    rows = [(1, 1.0, 2.0), (2, 1.0, 2.0), (3, None, 1.0), (4, float("nan"), 0.0), (5, 7.0, 2.0), (5, 7.0, 2.0)]
    got = sorted((r["k"], r["cluster"]) for r in ward.ward(spark.createDataFrame(rows, schema), ["a", "b"], ["k"]).collect())
    assert [k for k, _ in got] == [1, 2, 5, 5] and got[0][1] == got[1][1] != got[2][1] == got[3][1]


def test_dbscan_hot_spot_adjacent_dense_cells(spark):
    # A third of the rows sit on two touching dense blobs plus spread points:
    # the grid path must agree with brute force without pairing the blobs.
    rng = np.random.default_rng(11)
    blob = np.vstack([rng.uniform(0, 0.1, (150, 2)), rng.uniform(0.1, 0.2, (150, 2))])
    x = np.vstack([blob, rng.normal(0, 1.0, (600, 2))])
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(x)], "k long, a double, b double")
    got = {r["k"]: r["cluster"] for r in dbscan.dbscan(df, ["a", "b"], ["k"], eps=0.2, min_samples=8).collect()}
    z = (x - x.mean(0)) / x.std(0)
    assert [got[i] for i in range(len(x))] == list(_brute_dbscan(z, 0.2, 8))


@pytest.mark.parametrize("dims", [2, 5])
def test_dbscan_dense_clump_against_brute_force(spark, dims):
    """A clump of near and equal points beside spread ones, with sparse cores,
    border points and noise; blocks and units are cut many times."""
    rng = np.random.default_rng(dims)
    clump = rng.normal(0, 0.02, (400, dims))
    clump[:200] = clump[0]
    x = np.vstack([clump, rng.normal(0.8, 0.15, (80, dims)), rng.uniform(-2, 2, (150, dims)), clump[:1] + 0.3])
    cols = [f"c{j}" for j in range(dims)]
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], ["k", *cols])
    z = (x - x.mean(0)) / x.std(0)
    for eps, few in ((0.35, 6), (0.9, 150)):
        out = {r["k"]: r for r in dbscan.dbscan(df, cols, ["k"], eps=eps, min_samples=few).collect()}
        want = _brute_dbscan(z, eps, few)
        assert [out[i]["cluster"] for i in range(len(x))] == list(want)
        near = (np.sqrt(((z[:, None] - z[None]) ** 2).sum(-1)) <= eps).sum(1)
        assert [out[i]["is_core"] for i in range(len(x))] == list(near >= few)


def test_dbscan_edges(spark):
    schema = "k long, a double, b double"
    assert dbscan.dbscan(spark.createDataFrame([], schema), ["a", "b"], ["k"], 0.5, 3).collect() == []
    rows = [(1, 1.0, 2.0)] * 4 + [(2, None, 1.0), (3, 9.0, 2.0)]
    got = sorted((r["k"], r["cluster"]) for r in dbscan.dbscan(spark.createDataFrame(rows, schema), ["a", "b"], ["k"], 0.3, 3).collect())
    assert got == [(1, 0)] * 4 + [(3, -1)]


def test_components_paths_agree(spark):
    nodes = spark.createDataFrame([(i,) for i in range(12)], "node long")
    pairs = [(0, 1), (1, 2), (2, 5), (7, 8), (9, 10), (10, 11), (11, 9)]
    edges = spark.createDataFrame(pairs + [(v, u) for u, v in pairs], "u long, v long")
    a = {r["node"]: r["comp"] for r in dbscan.connected_components(nodes, edges).collect()}
    b = {r["node"]: r["comp"] for r in dbscan.propagate_components(nodes, edges).collect()}
    assert a == b == {0: 0, 1: 0, 2: 0, 5: 0, 3: 3, 4: 4, 6: 6, 7: 7, 8: 7, 9: 9, 10: 9, 11: 9}


@pytest.mark.parametrize("n", [40, 1279, 1280, 1281, 6000])
def test_isolation_forest_samples_are_the_smallest_places(spark, n):
    """One rule at every size: a tree's sample are the rows of the smallest
    places, whatever the partitions; 1,280 = 64 rows * 20 trees."""
    rng = np.random.default_rng(8)
    x = np.vstack([rng.normal(size=(n - 10, 2)), rng.normal(loc=9, size=(10, 2))])
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(x)], "k long, a double, b double")
    trees = isoforest.fit_forest(df.repartition(7), ["a", "b"], ["k"], n_trees=20, sample_size=64)
    again = isoforest.fit_forest(df.coalesce(1), ["a", "b"], ["k"], n_trees=20, sample_size=64)
    assert len(trees) == 20 and all(t[0, 4] == min(n, 64) for t in trees)
    assert all(np.array_equal(t, u) for t, u in zip(trees, again))
    h = np.array([r[0] for r in df.orderBy("k").select(F.xxhash64("k", "a", "b", F.lit(42))).collect()])
    place = isoforest._places(h, 20, 42)
    depth = int(np.ceil(np.log2(64)))
    for t in (0, 19):
        drawn = x[np.argsort(place[:, t])[:64]]
        want = isoforest.grow_tree(drawn, np.random.default_rng(42 * 1_000_003 + t), depth)
        assert np.array_equal(trees[t], np.array([w[1:] for w in sorted(want)], dtype=float))
    if n > 1000:
        out = isoforest.isolation_forest(df, ["a", "b"], ["k"], n_trees=20, sample_size=64)
        assert set(range(n - 10, n)) <= {r["k"] for r in out.where("is_anomaly").collect()}


def test_isolation_forest_odd_rows(spark):
    """Equal rows, null keys, a clashing column name; an empty table has no scores."""
    schema = "tree long, place double, x double"
    rows = [(None, 1.0, 2.0)] * 300 + [(i, 1.0 + i % 7, 2.0) for i in range(300)] + [(5, None, 1.0)]
    out = isoforest.isolation_forest(spark.createDataFrame(rows, schema), ["place", "x"], ["tree"], n_trees=5)
    assert out.count() == 600 and out.where("anomaly_score is null").count() == 0
    none = isoforest.isolation_forest(spark.createDataFrame([], schema), ["place", "x"], ["tree"], n_trees=5)
    assert none.collect() == [] and none.columns == out.columns
    one = isoforest.isolation_forest(spark.createDataFrame(rows[-2:], schema), ["place", "x"], ["tree"], n_trees=5)
    assert one.count() == 1


def _brute_auto_eps(z):
    d = np.sqrt(((z[:, None] - z[None]) ** 2).sum(-1))
    k5 = np.sort(d, axis=1)[:, min(4, len(z) - 1)]
    return max(0.3, float(np.quantile(k5, 0.9)))


@pytest.mark.parametrize("n_spread", [15, 400])
def test_dbscan_auto_eps_against_brute_force(spark, n_spread):
    rng = np.random.default_rng(n_spread)
    x = np.vstack([rng.normal(0, 0.05, (300, 2)), rng.uniform(-3, 3, (n_spread, 2))])
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(x)], "k long, a double, b double")
    st = cluster.standardise_features(df, ["a", "b"], ["k"])
    from pyspark.ml.functions import vector_to_array
    pts = st.data.select(F.struct("k").alias("_key"), vector_to_array("features").alias("z"))
    z = (x - x.mean(0)) / x.std(0)
    assert dbscan.auto_eps(pts, 2, len(x)) == pytest.approx(_brute_auto_eps(z))
    got = {r["k"]: r["cluster"] for r in dbscan.dbscan(df, ["a", "b"], ["k"]).collect()}
    want = _brute_dbscan(z, _brute_auto_eps(z), max(3, len(x) // 20))
    assert [got[i] for i in range(len(x))] == list(want)


def test_euclidean_silhouette_equals_brute_force(spark, monkeypatch):
    """Repeated points, noise, null labels, missing numbers, a cluster of one
    row, several blocks, and a sample smaller than a cluster."""
    import hashlib

    import numpy as np
    from vitalspark.ml import cluster
    monkeypatch.setattr(cluster, "SILHOUETTE_BLOCK", 16)
    r = np.random.default_rng(3)
    pts = [(i, int(i % 3), [float(x) for x in r.normal(i % 3, 1, 3)]) for i in range(60)]
    pts += [(60, 0, pts[0][2]), (61, 3, [9.0, 9.0, 9.0])]
    odd = [(62, -1, [0.0] * 3), (63, None, [0.0] * 3), (64, 1, [0.0, None, 0.0]), (65, 1, None)]
    df = spark.createDataFrame(pts + odd, "id long, c int, z array<double>")
    for cap in (1000, 7):
        got = {x["id"]: x for x in cluster.euclidean_silhouette(df, "c", "z", ["id"], per_cluster=cap).collect()}
        name = lambda i: hashlib.md5(str(i).encode()).hexdigest()
        sample = [p for c in range(4) for p in sorted((p for p in pts if p[1] == c), key=lambda p: name(p[0]))[:cap]]
        assert sorted(got) == [p[0] for p in pts]
        for i, c, z in pts:
            mean = {}
            for k in range(4):
                d = [np.linalg.norm(np.subtract(z, q[2])) for q in sample if q[1] == k and q[0] != i]
                if d:
                    mean[k] = np.mean(d)
            other = min(v for k, v in mean.items() if k != c)
            want = (other - mean[c]) / max(other, mean[c]) if c in mean else 0.0
            assert abs(got[i]["silhouette"] - want) < 1e-9
    one = df.where("c = 1")
    assert all(x["silhouette"] == 0 for x in cluster.euclidean_silhouette(one, "c", "z", ["id"]).collect())
    assert cluster.euclidean_silhouette(df.limit(0), "c", "z", ["id"]).count() == 0


def test_forests_keep_node_ids_and_sort_large_training_sets(spark):
    from vitalspark.ml import prep, supervised
    for task in ("regression", "classification"):
        assert supervised.make_model(task).getCacheNodeIds()
    assert not supervised._fills_nodes(2 * 8, 2, 4) and supervised._fills_nodes(2 * 8 + 1, 2, 4)
    df = spark.range(1000).selectExpr("id", "id * 7 % 13 AS a")
    kept = prep.iteration_input(df, [F.col("a")])
    for part in kept.rdd.glom().collect():
        assert [r["a"] for r in part] == sorted(r["a"] for r in part)
    assert kept.count() == 1000
    kept.unpersist()


def test_forest_of_sorted_rows_counts_and_learns(spark):
    from vitalspark.ml import supervised
    df = spark.range(400).selectExpr("id", "CAST(id % 20 AS DOUBLE) AS a", "CAST(id % 3 AS STRING) AS b",
                                     "CAST(id % 20 AS DOUBLE) * 2 AS y")
    fr = supervised.fit(df, ["a", "b"], "y", ["id"], task="regression", trees=2, depth=4)   # 16 < 320 rows: sorted
    assert fr.n_rows == 400 and fr.model.getNumTrees == 2
    assert supervised.regression_metrics(fr.predictions).first()["r2"] > 0.9


def _many_rows(spark, n=9000):
    """Two numbers and a text, a number and classes that follow from them; rows and keys repeat."""
    return spark.range(n).selectExpr("id % 4000 AS id", "CAST(hash(id) % 60 AS DOUBLE) AS a", "CAST(hash(id, 1) % 5 AS DOUBLE) AS b",
                                     "CAST(pmod(hash(id, 2), 3) AS STRING) AS c").selectExpr(
        "*", "1e6 + a * 3 + b * b + CAST(c AS INT) * 10 + hash(id, a) % 7 AS y", "CAST(a + 9 * b > 3 AS INT) AS two",
        "CASE WHEN a > 20 THEN 'x' WHEN b > 1 THEN 'y' ELSE 'z' END AS three")


def test_binned_forest_equals_sparks_on_many_rows(spark):
    """Same quality and importances as Spark's own forest, the same predictions as the model read row by row."""
    from unittest import mock

    from vitalspark.ml import binned_forest as BF
    from vitalspark.ml import supervised
    df = _many_rows(spark).cache()
    for target, task, cols in (("y", "regression", ["a", "b", "c"]), ("two", "classification", ["a", "b", "c"]),
                               ("three", "classification", ["a", "b"])):
        with mock.patch.object(BF, "fit", wraps=BF.fit) as used:
            fr = supervised.fit(df, cols, target, ["id", "a", "b"], task=task, trees=5, depth=5)
            again = supervised.fit(df.repartition(7), cols, target, ["id", "a", "b"], task=task, trees=5, depth=5)
        assert used.call_count == 2 and fr.model.getNumTrees == 5 and fr.model.numFeatures == len(cols)
        with mock.patch.object(supervised, "_grid", return_value=None):
            own = supervised.fit(df, cols, target, ["id", "a", "b"], task=task, trees=5, depth=5)
        both = [x.model.featureImportances.toArray() for x in (fr, own)]
        assert np.array_equal(both[0], again.model.featureImportances.toArray())   # the layout of rows changes nothing
        assert abs(both[0].sum() - 1) < 1e-9
        score = [supervised.regression_metrics(x.predictions).first()["r2"] if task == "regression" else
                 x.predictions.selectExpr("avg(CAST(label = prediction AS DOUBLE))").first()[0] for x in (fr, own)]
        assert min(score) > 0.85 and abs(score[0] - score[1]) < 0.05
        if task == "regression":
            assert np.abs(both[0] - both[1]).max() < 0.05
        test = fr.prep.data.where(~supervised.P.split_flag(["id", "a", "b"]))
        name = ["id", "a", "b", "label"]
        want = sorted(map(tuple, fr.model.transform(test).select(*name, "prediction").collect()))
        assert sorted(map(tuple, fr.predictions.select(*name, "prediction").collect())) == want
    df.unpersist()


def test_binned_tree_splits_where_brute_force_does():
    """Root split of a tree and its gain, by trying every border on rows with their weights."""
    from vitalspark.ml import binned_forest as BF
    rng = np.random.default_rng(4)
    grid = BF.Grid((tuple(range(5)), None), (6, 4))
    cells = np.arange(24)
    w = rng.integers(0, 6, 24).astype(float)
    y = rng.random(24) * 10
    tree = BF.Tree(grid, cells, np.stack([w, w * y, w * y * y], 1), 0, 3, rng).table(0).to_pylist()
    var = lambda on: np.average((y[on] - np.average(y[on], weights=w[on])) ** 2, weights=w[on])
    bins, best = grid.parts(cells), 0
    lefts = [bins[:, 0] <= t for t in range(5)] + [np.isin(bins[:, 1], [k for k in range(4) if m >> k & 1]) for m in range(1, 15)]
    for left in lefts:
        a, b = left & (w > 0), ~left & (w > 0)
        if a.any() and b.any():
            best = max(best, var(w > 0) - w[a].sum() / w.sum() * var(a) - w[b].sum() / w.sum() * var(b))
    assert abs(tree[0]["gain"] - best) < 1e-9 and abs(tree[0]["prediction"] - np.average(y, weights=w)) < 1e-9
    assert all(n["leftChild"] > n["id"] or n["leftChild"] < 0 for n in tree) and [n["id"] for n in tree] == list(range(len(tree)))


def test_binned_forest_borders_and_weights():
    from vitalspark.ml import binned_forest as BF
    assert BF.borders([3.0, 1.0, 1.0, 2.0]) == [1.5, 2.5] and BF.borders([7.0] * 9) == []
    many = BF.borders(np.arange(1000.0))
    assert len(many) == 31 and max(abs(x - 1000 * (i + 1) / 32) for i, x in enumerate(many)) < 2
    drawn = BF.Poisson().draw(np.random.default_rng(1), 100_000, 10)
    assert abs(drawn.mean() - 1) < 0.01 and abs(drawn.var() - 1) < 0.01 and abs((drawn == 0).mean() - np.exp(-1)) < 0.003
