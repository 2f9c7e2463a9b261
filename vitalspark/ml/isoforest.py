"""Isolation forest (RSK-3) as a Spark job.

1. Samples: every row has one 64-bit hash (of key and features); mixed with a
   tree's constant it gives the row's place for that tree, and the tree's
   sample are the 256 smallest places -- an independent uniform sample a tree,
   the same rule for any number of rows.  Each task keeps the 256 smallest of
   what it has read, lists of up to 1,024 tasks merge into one, and those of a
   tree into its sample, so no task holds more than about 10^5 rows of a tree.
2. Trees: ``groupBy(tree).applyInArrow`` grows each tree from its 256 rows
   (NumPy, random feature and split between the node's min and max, depth
   limit ceil(log2 256) = 8).  A tree is at most 511 nodes, so the forest
   (100 trees) is a bounded table that is collected and shipped to tasks.
3. Scores: a pandas UDF walks every tree for a batch of rows,
   s = 2 ** (-E[h] / c(256)).
4. Anomalies: s above the exact (linear) 90th percentile of all scores --
   contamination 0.1, i.e. the reference's offset rule.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import complete_rows, qcol, require_numeric
from ..plans.aggregates import bounded_rows, spread_for_cpu
from ..plans.ordered import exact_quantiles
from ..session import cut_lineage

N_TREES = 100
SAMPLE_SIZE = 256
CONTAMINATION = 0.1
SEED = 42
TREE_SCHEMA = "tree int, node int, feature int, threshold double, left int, right int, size int"
_EULER = 0.5772156649


def c_factor(n: float) -> float:
    """Average path length of an unsuccessful BST search over n points."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (math.log(n - 1) + _EULER) - 2.0 * (n - 1) / n


def grow_tree(x: np.ndarray, rng: np.random.Generator, max_depth: int) -> list[tuple]:
    """Nodes (node, feature, threshold, left, right, size); leaves have
    feature -1.  Iterative, breadth first."""
    nodes: list[list] = []
    stack = [(np.arange(len(x)), 0, 0)]
    nodes.append(None)
    while stack:
        idx, depth, nid = stack.pop()
        sub = x[idx]
        if depth >= max_depth or len(idx) <= 1:
            nodes[nid] = [nid, -1, 0.0, -1, -1, len(idx)]
            continue
        lo, hi = sub.min(axis=0), sub.max(axis=0)
        usable = np.flatnonzero(hi > lo)
        if usable.size == 0:
            nodes[nid] = [nid, -1, 0.0, -1, -1, len(idx)]
            continue
        f = int(rng.choice(usable))
        thr = float(rng.uniform(lo[f], hi[f]))
        go_left = sub[:, f] < thr
        left_id, right_id = len(nodes), len(nodes) + 1
        nodes.extend([None, None])
        nodes[nid] = [nid, f, thr, left_id, right_id, len(idx)]
        stack.append((idx[go_left], depth + 1, left_id))
        stack.append((idx[~go_left], depth + 1, right_id))
    return [tuple(n) for n in nodes]


_PLACED = "tree int, place long, x array<double>"
_MERGED_TASKS = 1024           # lists of this many tasks become one before a tree's are merged
_TASK_FLOATS = 4 << 20         # (row, tree) places and feature values held at a time


def _places(row_hash: np.ndarray, trees: int, seed: int) -> np.ndarray:
    """(rows, trees) unsigned places: the row hash mixed with each tree's constant."""
    odd = np.random.default_rng(seed).integers(0, 1 << 63, trees, dtype=np.uint64)
    v = row_hash.astype(np.uint64)[:, None] ^ odd[None, :]
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        v ^= v >> np.uint64(shift)
        v *= np.uint64(factor)
    return v ^ v >> np.uint64(31)


def _smallest(place: np.ndarray, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k smallest places of each tree with their features:
    place (rows, trees), x (rows, trees, features)."""
    if len(place) <= k:
        return place, x
    at = np.argpartition(place, k - 1, axis=0)[:k]
    return np.take_along_axis(place, at, 0), np.take_along_axis(x, at[:, :, None], 0)


def _placed_table(tree: np.ndarray, place: np.ndarray, x: np.ndarray) -> pa.Table:
    ends = pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[-1])
    return pa.table({"tree": pa.array(tree.astype(np.int32)), "place": pa.array(place.view(np.int64)),
                     "x": pa.ListArray.from_arrays(ends, pa.array(np.ascontiguousarray(x).ravel()))})


def _sample_of_task(n_features: int, trees: int, k: int, seed: int):
    step = max(1, _TASK_FLOATS // trees)
    block = max(1, min(trees, _TASK_FLOATS // (2 * k * n_features)))

    def run(batches):
        place, x = np.zeros((0, trees), np.uint64), np.zeros((0, trees, n_features))
        for b in batches:
            for start in range(0, b.num_rows, step):
                part = b.slice(start, step)
                new = _places(part.column(0).to_numpy(), trees, seed)
                rows = np.column_stack([c.to_numpy(zero_copy_only=False) for c in part.columns[1:]])
                if len(place) == k:  # only rows that some tree takes
                    live = (new < place.max(axis=0)).any(axis=1)
                    new, rows = new[live], rows[live]
                if not len(new):
                    continue
                n = min(k, len(place) + len(new))
                kept_place, kept_x = np.empty((n, trees), np.uint64), np.empty((n, trees, n_features))
                for t in range(0, trees, block):
                    s = slice(t, t + block)
                    at = np.argpartition(new[:, s], k - 1, axis=0)[:k] if len(new) > k else np.broadcast_to(
                        np.arange(len(new))[:, None], new[:, s].shape)
                    kept_place[:, s], kept_x[:, s] = _smallest(
                        np.concatenate([place[:, s], np.take_along_axis(new[:, s], at, 0)]),
                        np.concatenate([x[:, s], rows[at]]), k)
                place, x = kept_place, kept_x
        for t in range(trees if len(place) else 0):
            yield from _placed_table(np.full(len(place), t), place[:, t], x[:, t]).to_batches()
    return run


def _sample_of_lists(k: int):
    def run(t: pa.Table) -> pa.Table:
        place = t["place"].to_numpy().view(np.uint64)
        return t.select(["tree", "place", "x"]).take(np.argsort(place, kind="stable")[:k])
    return run


def _builder(sample_size: int, seed: int):
    max_depth = int(math.ceil(math.log2(max(sample_size, 2))))
    merge = _sample_of_lists(sample_size)

    def build(t: pa.Table) -> pa.Table:
        t = merge(t)
        tree = t["tree"][0].as_py()
        x = t["x"].combine_chunks().flatten().to_numpy().reshape(t.num_rows, -1)
        nodes = grow_tree(x, np.random.default_rng(seed * 1_000_003 + tree), max_depth)
        node, feature, threshold, left, right, size = (np.array(c) for c in zip(*nodes))
        ints = {"node": node, "feature": feature, "left": left, "right": right, "size": size}
        cols = {"tree": pa.array(np.full(len(nodes), tree, np.int32)), "threshold": pa.array(threshold.astype(float)),
                **{c: pa.array(v.astype(np.int32)) for c, v in ints.items()}}
        return pa.table(cols).select(["tree", "node", "feature", "threshold", "left", "right", "size"])
    return build


def stack_forest(trees: list[np.ndarray]) -> dict:
    """Pad the trees to one node count and stack them: (trees x nodes)
    arrays of feature, threshold, children and the leaf correction c(size)."""
    m = max(len(t) for t in trees)
    n = len(trees)
    feat = np.full((n, m), -1, dtype=np.int64)
    thr = np.zeros((n, m))
    left = np.zeros((n, m), dtype=np.int64)
    right = np.zeros((n, m), dtype=np.int64)
    leaf = np.zeros((n, m))
    for i, t in enumerate(trees):
        k = len(t)
        feat[i, :k] = t[:, 0]
        thr[i, :k] = t[:, 1]
        left[i, :k] = np.maximum(t[:, 2], 0)
        right[i, :k] = np.maximum(t[:, 3], 0)
        leaf[i, :k] = [c_factor(v) for v in t[:, 4]]
    return {"feat": feat, "thr": thr, "left": left, "right": right, "leaf": leaf}


def path_lengths(x: np.ndarray, trees: list[np.ndarray] | dict) -> np.ndarray:
    """Mean path length of each row of ``x`` over the trees.  All rows walk
    all trees at once: one flat gather per tree level on a (rows x trees)
    array of node positions."""
    f = trees if isinstance(trees, dict) else stack_forest(trees)
    t, m = f["feat"].shape
    feat, thr = f["feat"].ravel(), f["thr"].ravel()
    left, right, leaf = f["left"].ravel(), f["right"].ravel(), f["leaf"].ravel()
    n, d = x.shape
    xf = np.ascontiguousarray(x, dtype=float).ravel()
    base = (np.arange(t) * m)[None, :]                 # flat offset of each tree's root
    row_base = (np.arange(n) * d)[:, None]
    pos = np.broadcast_to(base, (n, t)).copy()         # flat node position per (row, tree)
    depth = np.zeros((n, t))
    while True:
        fe = np.take(feat, pos)
        active = fe >= 0
        if not active.any():
            break
        xv = np.take(xf, row_base + np.maximum(fe, 0))
        child = np.where(xv < np.take(thr, pos), np.take(left, pos), np.take(right, pos))
        pos = np.where(active, base + child, pos)
        depth += active
    return (depth + np.take(leaf, pos)).mean(axis=1)


def fit_forest(work: DataFrame, feature_cols: Sequence[str], key_cols: Sequence[str], n_trees: int = N_TREES,
               sample_size: int = SAMPLE_SIZE, seed: int = SEED) -> list[np.ndarray]:
    """Grow the trees, each from the ``sample_size`` rows with its smallest
    places (all rows when there are fewer); no trees without rows.  Rows that
    agree in key and features have one hash, so which of them is drawn makes
    no difference, and the trees do not depend on the partitioning."""
    feats = [qcol(c).cast("double") for c in feature_cols]
    rows = work.select(F.xxhash64(*[qcol(k) for k in key_cols], *feats, F.lit(seed)).alias("h"),
                       *[c.alias(f"x{i}") for i, c in enumerate(feats)])
    lists = rows.mapInArrow(_sample_of_task(len(feats), n_trees, sample_size, seed), _PLACED)
    merged = lists.withColumn("lists", F.floor(F.spark_partition_id() / _MERGED_TASKS)) \
        .groupBy("tree", "lists").applyInArrow(_sample_of_lists(sample_size), _PLACED)
    built = merged.groupBy("tree").applyInArrow(_builder(sample_size, seed), TREE_SCHEMA)
    by_tree: dict[int, list] = {}
    for r in bounded_rows(built, n_trees * 2 * sample_size):
        by_tree.setdefault(r["tree"], []).append((r["node"], r["feature"], r["threshold"], r["left"], r["right"],
                                                 r["size"]))
    if by_tree and len(by_tree) < n_trees:
        raise RuntimeError(f"only {len(by_tree)} of {n_trees} trees got rows")
    return [np.array([n[1:] for n in sorted(by_tree[t])], dtype=float) for t in sorted(by_tree)]


def score(work: DataFrame, feature_cols: Sequence[str], trees: list[np.ndarray],
          sample_size: int = SAMPLE_SIZE) -> DataFrame:
    """Adds ``anomaly_score`` in (0, 1]; higher is more anomalous.  ``sample_size``
    is the number of rows a tree was grown from."""
    norm = c_factor(sample_size)
    spark = work.sparkSession
    bc = spark.sparkContext.broadcast(stack_forest(trees))

    @F.pandas_udf("double")
    def _score(*cols: pd.Series) -> pd.Series:
        x = np.column_stack([c.to_numpy(dtype=float) for c in cols])
        return pd.Series(np.power(2.0, -path_lengths(x, bc.value) / norm))

    # Scoring is CPU-bound Python: use every core.
    work = spread_for_cpu(work)
    return work.withColumn("anomaly_score", _score(*[qcol(c).cast("double") for c in feature_cols]))


def isolation_forest(df: DataFrame, feature_cols: Sequence[str], key_cols: Sequence[str],
                     contamination: float = CONTAMINATION, n_trees: int = N_TREES,
                     sample_size: int = SAMPLE_SIZE, seed: int = SEED) -> DataFrame:
    """RSK-3 on the complete numeric rows: key..., features, anomaly_score,
    is_anomaly."""
    cols = require_numeric(df, feature_cols, "A")
    work = complete_rows(df.select(*[qcol(k) for k in key_cols], *[qcol(c) for c in cols]), cols)
    trees = fit_forest(work, cols, key_cols, n_trees, sample_size, seed)
    if not trees:
        return work.withColumns({"anomaly_score": F.lit(None).cast("double"), "is_anomaly": F.lit(None).cast("boolean")})
    scored = cut_lineage(score(work, cols, trees, max(2, int(trees[0][0, 4]))))
    q = exact_quantiles(scored.select(F.col("anomaly_score").alias("v")), [], "v", [1 - contamination]).first()
    cut = q["q"] if q else float("inf")
    return scored.withColumn("is_anomaly", F.col("anomaly_score") > F.lit(cut))


def anomaly_summary(flagged: DataFrame, key_cols: Sequence[str], top: int = 10) -> DataFrame:
    """The reference's report: number and share of anomalies (one aggregate,
    two numbers to the driver) with the first ``top`` anomalous rows in key
    order (a top-k)."""
    tot = flagged.agg(F.count_if("is_anomaly").alias("a"), F.count(F.lit(1)).alias("n")).first()
    n_anom, n = int(tot["a"] or 0), int(tot["n"] or 0)
    first = flagged.where("is_anomaly").orderBy(*[qcol(k) for k in key_cols]).limit(top)
    return first.select(F.lit(n_anom).cast("long").alias("n_anomalies"),
                        F.lit(n_anom / max(n, 1) * 100).alias("anomaly_percent"), *[qcol(k) for k in key_cols],
                        "anomaly_score")
