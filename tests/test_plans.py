"""The distributed order helpers must give the same answer as a global
sort, whatever the partitioning, including when one group holds most rows."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from vitalspark.plans.ordered import exact_quantiles, exact_quantiles_sorted, ordered_prefix


@pytest.mark.parametrize("parts", [1, 7, 64])
def test_ordered_prefix_matches_global_sort(spark, parts):
    rng = np.random.default_rng(1)
    rows = [(int(g), int(i), float(v)) for i, (g, v) in enumerate(zip(
        np.where(rng.random(3000) < 0.6, 0, rng.integers(1, 20, 3000)), rng.normal(size=3000)))]
    df = spark.createDataFrame(rows, "g long, id long, v double").repartition(parts)
    out = ordered_prefix(df, ["v", "id"], ["g"], sums=[("cum", "v")], products=[("prod", F.lit(1.0))],
                         num_partitions=parts)
    got = {(r["g"], r["id"]): (r["_idx"], r["cum"], r["prod"]) for r in out.collect()}
    by_g = {}
    for g, i, v in rows:
        by_g.setdefault(g, []).append((v, i))
    for g, items in by_g.items():
        items.sort()
        cum = 0.0
        for pos, (v, i) in enumerate(items):
            cum += v
            idx, c, p = got[(g, i)]
            assert idx == pos and c == pytest.approx(cum, abs=1e-9) and p == 1.0


@pytest.mark.parametrize("fn", [exact_quantiles, exact_quantiles_sorted])
def test_exact_quantiles_match_numpy(spark, fn):
    rng = np.random.default_rng(2)
    vals = np.round(rng.exponential(size=2001), 2)
    df = spark.createDataFrame([("a", float(v)) for v in vals] + [("b", 5.0)], "column string, value double")
    probs = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    got = {(r["column"], r["p"]): r["q"] for r in fn(df, ["column"], "value", probs).collect()}
    for p in probs:
        assert got[("a", p)] == pytest.approx(float(np.quantile(vals, p)))
        assert got[("b", p)] == 5.0
    flat = {r["p"]: r["q"] for r in fn(df.where("column = 'a'"), [], "value", probs).collect()}
    for p in probs:
        assert flat[p] == pytest.approx(float(np.quantile(vals, p)))


def test_exact_quantiles_heavy_ties(spark):
    # One value holds a third of the rows: the bracket collapses onto it.
    vals = [7.0] * 1000 + [float(i) for i in range(2000)]
    df = spark.createDataFrame([(v,) for v in vals], "value double")
    probs = [0.1, 0.33, 0.5, 0.9]
    got = {r["p"]: r["q"] for r in exact_quantiles(df, [], "value", probs).collect()}
    for p in probs:
        assert got[p] == pytest.approx(float(np.quantile(vals, p)))


def test_exact_quantiles_narrowing_rounds(spark, monkeypatch):
    # A tiny band limit forces the narrowing rounds that huge inputs need;
    # the sorted fallback must not be needed.
    import vitalspark.plans.ordered as O

    def no_fallback(*a, **k):
        raise AssertionError("fell back to the sorted path")
    monkeypatch.setattr(O, "exact_quantiles_sorted", no_fallback)
    rng = np.random.default_rng(5)
    vals = np.round(rng.normal(size=20000), 6)
    df = spark.createDataFrame([("a" if i % 3 else "b", float(v)) for i, v in enumerate(vals)],
                               "column string, value double")
    probs = [0.01, 0.25, 0.5, 0.999]
    got = {(r["column"], r["p"]): r["q"] for r in
           exact_quantiles(df, ["column"], "value", probs, max_band_rows=20).collect()}
    for name, sel in (("a", [i % 3 != 0 for i in range(len(vals))]), ("b", [i % 3 == 0 for i in range(len(vals))])):
        sub = vals[np.array(sel)]
        for p in probs:
            assert got[(name, p)] == pytest.approx(float(np.quantile(sub, p)))


def test_exact_quantiles_of_counted_values(spark, monkeypatch):
    """Counts weigh, values may come in several rows, ranges narrow over heavy
    tails; infinite values go by the sorted path."""
    import vitalspark.plans.ordered as O
    rng = np.random.default_rng(6)
    rows = [(0, float(v), int(c)) for v, c in zip(np.exp(rng.normal(0, 2, 3000)), rng.integers(1, 9, 3000))]
    rows += [(1, 7.0, 1000), (1, 7.0, 1), (1, 8.0, 1), (2, -3.0, 1), (2, None, 5), (3, 1.0, 1), (3, 2.0, 1)]
    probs = [0.0, 0.25, 0.5, 0.75, 0.999, 1.0]

    def check(rows):
        df = spark.createDataFrame(rows, "position int, value double, cnt long")
        got = {(r["position"], r["p"]): r["q"] for r in
               O.exact_quantiles_counted(df, ["position"], "value", "cnt", probs).collect()}
        assert len(got) == len(probs) * len({r[0] for r in rows})
        for g in {r[0] for r in rows}:
            whole = np.repeat(*map(np.array, zip(*[(v, c) for k, v, c in rows if k == g and v is not None])))
            for p in probs:
                h = p * (len(whole) - 1)
                x, y = np.sort(whole)[[int(h), min(int(h) + 1, len(whole) - 1)]]
                if np.isfinite(x):
                    assert got[(g, p)] == pytest.approx(x + (y - x) * (h - int(h)), rel=1e-12)
    check([*rows[-7:], (4, float("inf"), 1), (4, 1.0, 6000), (4, -5.0, 3)])

    def no_fallback(*a, **k):
        raise AssertionError("fell back to the sorted path")
    monkeypatch.setattr(O, "_quantiles_by_sort", no_fallback)
    monkeypatch.setattr(O, "QUANTILE_BINS", 64)
    check(rows)
    empty = spark.createDataFrame([], "position int, value double, cnt long")
    assert O.exact_quantiles_counted(empty, ["position"], "value", "cnt", probs).collect() == []
