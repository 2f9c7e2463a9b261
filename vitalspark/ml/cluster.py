"""Clustering (ML-9, ML-12, ML-13, ML-14).

Features are standardised with the population std (the reference's scaler;
``StandardScaler`` in Spark divides by the sample std, so it is not used).
K-means has no ``n_init`` in Spark: several seeds are fitted and the lowest
training cost is kept.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import qcol
from ..operators.similarity import scale_stats, standardise
from ..session import cut_lineage
from . import prep as P

N_INIT = 10
SEED = 42
SILHOUETTE_ROWS = 1_000          # sampled rows a cluster; up to 1,000 each task keeps its first rows only
SILHOUETTE_BLOCK = 16_384        # sampled rows that go round at once
SILHOUETTE_ROWS_AT_ONCE = 256    # rows compared with a block at once


@dataclass
class Standardised:
    data: DataFrame          # key..., original feature columns, features (vector of z)
    means: list[float]
    stds: list[float]
    feature_cols: list[str]


def standardise_features(df: DataFrame, feature_cols: Sequence[str], key_cols: Sequence[str]) -> Standardised:
    prep = P.prepare(df, feature_cols, None, key_cols)
    data = prep.data
    vec = F.array(*[qcol(c).cast("double") for c in prep.encoded_cols])
    means, stds = scale_stats(data, vec, len(prep.encoded_cols))
    z = standardise(vec, means, stds)
    out = data.select(*[qcol(k) for k in key_cols], *[qcol(c) for c in prep.encoded_cols],
                      array_to_vector(z).alias("features"))
    return Standardised(out, means, stds, list(prep.encoded_cols))


def kmeans(st: Standardised, k: int = 3, n_init: int = N_INIT, seed: int = SEED, max_iter: int = 300):
    """ML-9: best of ``n_init`` seeded K-means fits (lowest cost)."""
    from concurrent.futures import ThreadPoolExecutor
    data = P.iteration_input(st.data)
    data.count()

    def one(i):
        return KMeans(k=k, seed=seed + i, maxIter=max_iter, initMode="k-means||").fit(data)
    # The restarts are independent jobs: submit a few at once so small fits
    # overlap instead of leaving cores idle; the lowest cost wins (ties: the
    # earliest seed).
    with ThreadPoolExecutor(max_workers=min(n_init, 4)) as pool:
        models = list(pool.map(one, range(n_init)))
    best = min(enumerate(models), key=lambda im: (im[1].summary.trainingCost, im[0]))[1]
    labelled = best.transform(st.data).withColumnRenamed("prediction", "cluster")
    data.unpersist()
    return best, labelled


def silhouette(labelled: DataFrame, label_col: str = "cluster", key_cols: Sequence[str] | None = None,
               vector_col: str = "features") -> float:
    """ML-12: mean Euclidean silhouette over all rows (see
    ``euclidean_silhouette``); noise rows (-1) excluded; 0 when fewer than 2
    clusters.  Without ``key_cols`` Spark's evaluator answers (squared
    Euclidean), which needs no key."""
    data = labelled.where(F.col(label_col) >= 0)
    if key_cols:
        points = data.select(*[qcol(k) for k in key_cols], qcol(label_col), vector_to_array(vector_col).alias("_z"))
        return float(euclidean_silhouette(points, label_col, "_z", key_cols).agg(F.avg("silhouette")).first()[0] or 0.0)
    if data.select(label_col).distinct().limit(2).count() < 2:
        return 0.0
    ev = ClusteringEvaluator(featuresCol=vector_col, predictionCol=label_col, metricName="silhouette",
                             distanceMeasure="squaredEuclidean")
    return float(ev.evaluate(data.withColumn(label_col, F.col(label_col).cast("double"))))


def euclidean_silhouette(points: DataFrame, label_col: str, vector_col: str, key_cols: Sequence[str],
                         per_cluster: int = SILHOUETTE_ROWS) -> DataFrame:
    """ML-12 with Euclidean distances: (key, label, own, other, silhouette) per row.

    Each row is compared with a sample that covers every cluster: its first
    ``per_cluster`` rows by the MD5 of the key (all of it where it has no
    more, so small data give the exact value).  ``own`` is the mean distance
    to the other sampled rows of the row's cluster, ``other`` the least mean
    distance to another cluster's; silhouette = (other - own) / max of both, 0
    for the only sampled row of a cluster.  The sample goes round in blocks of
    ``SILHOUETTE_BLOCK`` rows; what is shuffled is one (row, cluster) sum a
    block, and no pair of rows is written.  Noise (-1), null labels and vectors
    with a missing number take no part; with fewer than two clusters the
    silhouette is 0.  The key identifies a row."""
    keys = [f"_k{i}" for i in range(len(key_cols))]
    rows = points.where((F.col(label_col) >= 0) & F.col(vector_col).isNotNull()
                        & ~F.exists(vector_col, lambda x: x.isNull() | F.isnan(x))).select(
        *[qcol(k).alias(n) for k, n in zip(key_cols, keys)], F.col(label_col).cast("long").alias("_label"),
        F.col(vector_col).cast("array<double>").alias("_v"))
    name = F.concat_ws("|", *[F.col(k).cast("string") for k in keys])
    rows = cut_lineage(rows.withColumn("_name", F.md5(name)))
    place = F.row_number().over(Window.partitionBy("_label").orderBy("_name"))
    sample = cut_lineage(rows.select("_label", "_name", "_v").withColumn("_place", place)
                         .where(F.col("_place") <= per_cluster))
    count = sample.count()
    blocks = max(1, math.ceil(count / SILHOUETTE_BLOCK))
    dealt = sample.withColumn("_block", F.pmod(F.xxhash64("_name"), F.lit(blocks)).cast("int"))
    sums = None
    for b in range(blocks):
        part = dealt.where(F.col("_block") == b).select("_label", "_name", "_v").toArrow()  # about SILHOUETTE_BLOCK rows
        if part.num_rows:
            one = rows.mapInArrow(_distance_sums(rows.sparkSession.sparkContext.broadcast(part)),
                                  "_name string, _cluster long, _n long, _d double")
            sums = one if sums is None else sums.unionAll(one)
    if sums is None:
        return rows.select(*[F.col(n).alias(k) for n, k in zip(keys, key_cols)], F.col("_label").alias("label"),
                           *[F.lit(0.0).alias(c) for c in ("own", "other", "silhouette")])
    means = rows.select(*keys, "_label", "_name").join(sums, "_name").groupBy(*keys, "_label", "_cluster").agg(
        F.sum("_n").alias("_n"), F.sum("_d").alias("_d"))
    mean = F.when(F.col("_n") > 0, F.col("_d") / F.col("_n"))
    same = F.col("_cluster") == F.col("_label")
    both = means.groupBy(*keys, "_label").agg(F.max(F.when(same, mean)).alias("own"),
                                              F.min(F.when(~same, mean)).alias("other"))
    value = F.when(F.greatest("own", "other") > 0, (F.col("other") - F.col("own")) / F.greatest("own", "other"))
    value = F.when(F.col("own").isNotNull() & F.col("other").isNotNull(), value)
    return both.select(*[F.col(n).alias(k) for n, k in zip(keys, key_cols)], F.col("_label").alias("label"),
                       "own", "other", F.coalesce(value, F.lit(0.0)).alias("silhouette"))


def _distance_sums(sample):
    """Per row and cluster of a sample block: number and sum of distances to
    the sampled rows but the row itself."""
    def run(batches):
        names = sample.value["_name"].to_pylist()
        at = {n: i for i, n in enumerate(names)}
        points = np.stack(sample.value["_v"].to_pylist()).astype(np.float64)
        clusters, of = np.unique(sample.value["_label"].to_numpy(), return_inverse=True)
        inside = np.zeros((len(names), len(clusters)))
        inside[np.arange(len(names)), of] = 1.0
        sizes = inside.sum(0).astype(np.int64)
        for batch in batches:
            for lo in range(0, batch.num_rows, SILHOUETTE_ROWS_AT_ONCE):
                b = batch.slice(lo, SILHOUETTE_ROWS_AT_ONCE)
                x = np.stack(b.column("_v").to_pylist()).astype(np.float64)
                who = b.column("_name").to_pylist()
                square = np.zeros((len(x), len(points)))
                for j in range(x.shape[1]):  # differences, not products: equal points are at distance 0
                    square += (x[:, j:j + 1] - points[:, j]) ** 2
                total = np.sqrt(square) @ inside
                n = np.tile(sizes, (len(x), 1))
                mine = np.array([of[at[w]] if w in at else -1 for w in who])
                n[np.flatnonzero(mine >= 0), mine[mine >= 0]] -= 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(who, len(clusters)), pa.string()), pa.array(np.tile(clusters, len(x))),
                     pa.array(n.ravel()), pa.array(total.ravel())], names=["_name", "_cluster", "_n", "_d"])
    return run


def cluster_stats(labelled: DataFrame, feature_cols: Sequence[str], label_col: str = "cluster") -> DataFrame:
    """ML-13: size and per-column means of each cluster; noise (-1) is its
    own row, marked ``is_noise``."""
    return labelled.groupBy(label_col).agg(F.count(F.lit(1)).alias("size"),
                                           *[F.avg(qcol(c)).alias(f"mean_{c}") for c in feature_cols]) \
        .withColumn("is_noise", F.col(label_col) == -1)


def pca_scatter(labelled: DataFrame, key_cols: Sequence[str], label_col: str = "cluster") -> DataFrame:
    """ML-14: two principal components of the standardised features; each
    component's sign is fixed so its largest loading (of equal ones the first)
    is positive."""
    model = PCA(k=2, inputCol="features", outputCol="_pc").fit(labelled)
    pc = model.pc.toArray()
    largest = [int((abs(pc[:, j]) > abs(pc[:, j]).max() - 1e-9).argmax()) for j in range(2)]
    signs = [1.0 if pc[i, j] >= 0 else -1.0 for j, i in enumerate(largest)]
    t = model.transform(labelled)
    arr = vector_to_array(F.col("_pc"))
    return t.select(*key_cols, (arr[0] * signs[0]).alias("x"), (arr[1] * signs[1]).alias("y"), label_col)
