"""Hierarchical (Ward) clustering (ML-11) over mergeable clustering features.

Exact Ward needs all distances.  Here one path serves every size:

1. Blocks of rows are summarised where they lie: a block is split top down at
   the mean of its widest dimension, always in the node of the largest squared
   error, until ``entries`` nodes are left (a node of equal rows never splits).
   Every row carries the name of its node.
2. A node's clustering feature is (count, sums, squared sums), an ordinary
   Spark aggregate of its rows; features add up, so nodes of ``FAN`` blocks are
   split and summed the same way, level by level, until one block is left.
3. The last at most ``entries`` features are merged by Ward's rule along
   nearest-neighbour chains, in one task, and the dendrogram is cut at k.
4. Labels travel back down the levels by joins; no row reaches the driver.

With at most ``entries`` distinct rows this is exact Ward.  Clusters are
numbered by falling size, ties by their centre.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.columns import qcol
from ..session import cut_lineage
from .cluster import standardise_features

ENTRIES = 1000        # nodes a block or a group of blocks is summarised to
FAN = 16              # blocks summarised together on the next level
BLOCK_ROWS = 1 << 16


def split_nodes(count: np.ndarray, total: np.ndarray, square: np.ndarray, most: int) -> np.ndarray:
    """Node number of each feature (count, sums, summed squares): top-down
    splits until ``most`` nodes or no error are left."""
    centre = total / count[:, None]
    node = np.zeros(len(count), np.int64)

    def error(rows):  # summed squared distance to the mean, by dimension
        n, s = count[rows].sum(), total[rows].sum(0)
        return np.maximum(square[rows].sum(0) - s * s / n, 0.0)

    def spread(rows):  # whether the centres differ at all
        c = centre[rows]
        return c.max(0) - c.min(0)

    def push(rows, number):
        if len(rows) > 1 and spread(rows).any():
            heapq.heappush(heap, (-float(error(rows).sum()), number, rows))

    heap: list = []
    if len(count):
        push(np.arange(len(count)), 0)
    nodes = 1
    while heap and nodes < most:
        _, number, rows = heapq.heappop(heap)
        between = np.where(spread(rows) > 0, error(rows), -1.0)
        axis = int(between.argmax())
        values = centre[rows, axis]
        middle = (total[rows, axis].sum()) / count[rows].sum()
        low = values <= middle
        if low.all() or not low.any():  # rounding: fall back to the middle of the range
            low = values <= (values.max() + values.min()) / 2
            if low.all():
                low = values < values.max()
        node[rows[~low]] = nodes
        push(rows[low], number)
        push(rows[~low], nodes)
        nodes += 1
    return node


def ward_labels(count: np.ndarray, centre: np.ndarray, k: int) -> np.ndarray:
    """Ward's dendrogram of weighted points by nearest-neighbour chains, cut
    at k clusters."""
    m = len(count)
    n, c = count.astype(float).copy(), centre.astype(float).copy()
    alive, merges, chain = np.ones(m, bool), [], []

    def costs(a):
        gap = ((c - c[a]) ** 2).sum(1) * (n * n[a] / (n + n[a]))
        gap[~alive] = np.inf
        gap[a] = np.inf
        return gap

    for _ in range(m - 1):
        if not chain:
            chain.append(int(np.flatnonzero(alive)[0]))
        while True:
            a = chain[-1]
            gap = costs(a)
            b = int(gap.argmin())
            if len(chain) > 1 and gap[chain[-2]] <= gap[b]:
                b = chain[-2]
            if len(chain) > 1 and b == chain[-2]:
                break
            chain.append(b)
        a, b = chain.pop(), chain.pop()
        merges.append((float(gap[b]), len(merges), min(a, b), max(a, b)))
        a, b = min(a, b), max(a, b)
        c[a] = (n[a] * c[a] + n[b] * c[b]) / (n[a] + n[b])
        n[a] += n[b]
        alive[b] = False
    group = np.arange(m)

    def root(x):
        while group[x] != x:
            group[x] = group[group[x]]
            x = group[x]
        return x

    for _, _, a, b in sorted(merges)[:max(m - k, 0)]:
        group[root(b)] = root(a)
    return np.array([root(x) for x in range(m)], np.int64)


def _number(label: np.ndarray, count: np.ndarray, total: np.ndarray) -> np.ndarray:
    """Clusters numbered by falling size, ties by their centre."""
    names = np.unique(label)
    size = [count[label == x].sum() for x in names]
    mean = [tuple(total[label == x].sum(0) / s) for x, s in zip(names, size)]
    order = sorted(range(len(names)), key=lambda i: (-size[i], mean[i]))
    place = {names[i]: k for k, i in enumerate(order)}
    return np.array([place[x] for x in label], np.int64)


def _matrix(column: pa.Array | pa.ChunkedArray, rows: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(flat.flatten()).reshape(rows, -1)


def _place_rows(most: int, schema: pa.Schema):
    """Blocks of rows with the node each row belongs to."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held, rows = TaskContext.get().partitionId() << 32, [], 0

        def close():
            t = pa.Table.from_batches(held).combine_chunks()
            z = _matrix(t["_z"], t.num_rows)
            node = split_nodes(np.ones(t.num_rows), z, z * z, most)
            t = t.append_column("_block", pa.array(np.full(t.num_rows, block)))
            return t.append_column("_node", pa.array(node)).cast(schema).to_batches()

        for b in batches:
            if not b.num_rows:
                continue
            held.append(b)
            rows += b.num_rows
            if rows >= BLOCK_ROWS:
                yield from close()
                block, held, rows = block + 1, [], 0
        if rows:
            yield from close()
    return run


def _features(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return (t["_n"].to_numpy().astype(float), _matrix(t["_sum"], t.num_rows), _matrix(t["_square"], t.num_rows))


def _regroup(most: int):
    """(block, node) -> (group, node of the group)."""
    def run(key: tuple, t: pa.Table) -> pa.Table:
        t = t.sort_by([("_block", "ascending"), ("_node", "ascending")])
        return pa.table({"_block": t["_block"], "_node": t["_node"],
                         "_group": pa.array(np.full(t.num_rows, key[0].as_py(), np.int64)),
                         "_to": pa.array(split_nodes(*_features(t), most))})
    return run


def _merge(k: int):
    """(block, node) -> cluster, for the features that are left."""
    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by([("_block", "ascending"), ("_node", "ascending")])
        count, total, _ = _features(t)
        label = ward_labels(count, total / count[:, None], k)
        return pa.table({"_block": t["_block"], "_node": t["_node"],
                         "cluster": pa.array(_number(label, count, total))})
    return run


def _sum_arrays(column: str, dims: int) -> Column:
    return F.array(*[F.sum(F.col(column)[d]) for d in range(dims)]).alias(column)


def ward(df: DataFrame, feature_cols: Sequence[str], key_cols: Sequence[str], k: int = 3,
         entries: int = ENTRIES) -> DataFrame:
    """key..., cluster for every complete row."""
    st = standardise_features(df, feature_cols, key_cols)
    dims = len(st.feature_cols)
    rows = st.data.select(*[qcol(c) for c in key_cols], vector_to_array("features").alias("_z"))
    ddl = T.StructType([*rows.schema.fields, T.StructField("_block", T.LongType()), T.StructField("_node", T.LongType())])
    placed = cut_lineage(rows.mapInArrow(_place_rows(entries, to_arrow_schema(ddl)), ddl))
    features = placed.groupBy("_block", "_node").agg(
        F.count(F.lit(1)).alias("_n"), _sum_arrays("_z", dims).alias("_sum"),
        F.array(*[F.sum(F.col("_z")[d] * F.col("_z")[d]) for d in range(dims)]).alias("_square"))
    features = cut_lineage(features)
    blocks, maps = features.select("_block").distinct().count(), []
    while blocks > 1:
        groups = -(-blocks // FAN)
        dealt = features.withColumn("_g", F.pmod(F.xxhash64("_block"), F.lit(groups)))
        moved = cut_lineage(dealt.groupBy("_g").applyInArrow(
            _regroup(entries), "_block long, _node long, _group long, _to long"))
        maps.append(moved)
        features = cut_lineage(features.join(moved, ["_block", "_node"]).groupBy(
            F.col("_group").alias("_block"), F.col("_to").alias("_node")).agg(
            F.sum("_n").alias("_n"), _sum_arrays("_sum", dims), _sum_arrays("_square", dims)))
        blocks = groups
    label = features.withColumn("_all", F.lit(1)).groupBy("_all").applyInArrow(_merge(k), "_block long, _node long, cluster long")
    for moved in reversed(maps):
        label = moved.join(label.withColumnsRenamed({"_block": "_group", "_node": "_to"}), ["_group", "_to"]).select(
            "_block", "_node", "cluster")
    return placed.join(label, ["_block", "_node"]).select(*[qcol(c) for c in key_cols], "cluster")
