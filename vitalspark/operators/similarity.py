"""Similarity: standardise, k nearest rows to query points, cohort comparison
(SIM-1..3) and similar rows with self excluded (PAT-5).

Nearest rows are a block join: query points go round in blocks of at most
``QUERY_CELLS`` numbers, each task compares its Arrow batches with the block
in NumPy and keeps the k nearest rows per query, so it writes at most k rows
per query however many rows it read.  These bounded lists are merged in
groups of ``FAN`` tasks until one is left per query.  The query set may be a
list or a table of any size; no row meets a sort before the k nearest of its
task are known.  A block of many queries is not compared with every row: rows
and queries are put in boxes of near points, and a box of queries only meets
the boxes of rows that can hold one of its k nearest.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.columns import complete_rows, nan_to_null, qcol, require_numeric
from ..plans.aggregates import bounded_rows
from ..plans.ordered import ordered_prefix
from ..plans.topk import first_k, places
from ..session import cut_lineage

SIMILARITY_SCALE = 15        # fixed: similarity % = max(0, 100 - 15 * distance)
DEFAULT_K = 5
SELF_EXCLUDED_K = 4          # fixed: PAT-5 keeps 4 neighbours
QUERY_CELLS = 1 << 20         # queries x dimensions that go to the tasks at once (8 MB)
DISTANCES = 1 << 22          # distances a task holds at once
FAN = 256                    # lists of k nearest merged together
BOX = 64                     # queries in a box; rows in a box: half
BOXED_QUERIES = 1024         # blocks of fewer queries are compared with every row
BOXED_DIMS = 8               # in more dimensions nearly every box is near
PENDING = 1 << 20            # candidates a task holds before it keeps the k nearest


def _as_vector(cols: Sequence[str]) -> Column:
    return F.array(*[qcol(c).cast("double") for c in cols])


def scale_stats(df: DataFrame, vec: Column, dims: int) -> tuple[list[float], list[float]]:
    """Mean and population std of each dimension (SIM-1), zero std -> 1.
    One aggregate; 2 x dims numbers come back."""
    aggs = []
    for d in range(dims):
        x = vec[d]
        aggs += [F.avg(x).alias(f"m{d}"), F.stddev_pop(x).alias(f"s{d}")]
    row = df.agg(*aggs).first()
    means = [0.0 if row[f"m{d}"] is None else row[f"m{d}"] for d in range(dims)]
    stds = [row[f"s{d}"] or 1.0 for d in range(dims)]
    stds = [s if s != 0 else 1.0 for s in stds]
    return means, stds


def standardise(vec: Column, means: Sequence[float], stds: Sequence[float]) -> Column:
    """(x - mean) / population std per dimension, as a vector expression."""
    m = F.array(*[F.lit(float(v)) for v in means])
    s = F.array(*[F.lit(float(v)) for v in stds])
    return F.zip_with(F.zip_with(vec, m, lambda x, a: x - a), s, lambda x, b: x / b)


def standardised_dims(values: Sequence[Column], means: Sequence[float], stds: Sequence[float]) -> list[Column]:
    """(x_j - mean_j) / std_j as one Column per dimension."""
    return [(v - F.lit(float(m))) / F.lit(float(sd)) for v, m, sd in zip(values, means, stds)]


def _candidates(z: np.ndarray, points: np.ndarray, own: dict[int, list[int]], k: int):
    """(query, row, distance) of at least the k nearest rows of each query,
    all rows at the k-th distance included."""
    step = max(1, DISTANCES // max(len(z), 1))
    for lo in range(0, len(points), step):
        some = points[lo:lo + step]
        square = np.zeros((len(some), len(z)))
        for j in range(z.shape[1]):
            gap = some[:, j, None] - z[None, :, j]
            square += gap * gap
        for row, queries in own.items():
            square[[q - lo for q in queries if lo <= q < lo + len(some)], row] = np.inf
        kth = np.partition(square, min(k, len(z)) - 1, axis=1)[:, min(k, len(z)) - 1]
        q, row = np.nonzero((square <= kth[:, None]) & np.isfinite(square))
        yield q + lo, row, np.sqrt(square[q, row])


def _boxes(z: np.ndarray, size: int):
    """The points in boxes of at most ``size`` near ones, by halving the widest
    side: order, first place, length, low and high corner of each box."""
    order, todo, starts = np.arange(len(z)), [(0, len(z))], []
    while todo:
        lo, hi = todo.pop()
        if hi - lo <= size:
            starts.append(lo)
            continue
        part, mid = z[order[lo:hi]], (hi - lo) // 2
        side = np.argmax(part.max(axis=0) - part.min(axis=0))
        order[lo:hi] = order[lo:hi][np.argpartition(part[:, side], mid)]
        todo += [(lo, lo + mid), (lo + mid, hi)]
    at, put = np.array(sorted(starts)), z[order]
    return order, at, np.diff(np.append(at, len(z))), np.minimum.reduceat(put, at), np.maximum.reduceat(put, at)


def _boxed_candidates(z: np.ndarray, points: np.ndarray, boxes: tuple, k: int):
    """As ``_candidates`` for the points in ``boxes``: a box of queries meets
    the rows of those boxes that are no farther than k rows surely are."""
    order, at, sizes, low, high = _boxes(z, max(1, BOX // 2))
    for first, n, q_low, q_high in zip(*boxes[1:]):
        gap = np.maximum(np.maximum(low - q_high, q_low - high), 0.0)
        span = np.maximum(high - q_low, q_high - low)
        far = (span * span).sum(axis=1)
        if sizes.min() >= k:
            reach = far.min()
        else:
            by = np.argsort(far)
            reach = far[by[min(np.searchsorted(np.cumsum(sizes[by]), k), len(by) - 1)]]
        near = np.flatnonzero((gap * gap).sum(axis=1) <= reach * (1 + 1e-9))
        rows = np.concatenate([order[at[i]:at[i] + sizes[i]] for i in near])
        mine = boxes[0][first:first + n]
        for q, row, distance in _candidates(z[rows], points[mine], {}, k):
            yield mine[q], rows[row], distance


def _first_of_equal(rows: pa.Table, z: np.ndarray, keys: Sequence[str], k: int):
    """Of rows with the same point the first k by key: others are nobody's k nearest."""
    by = pc.sort_indices(rows, sort_keys=[(c, "ascending") for c in keys], null_placement="at_start").to_numpy()
    by = by[np.lexsort(z[by].T[::-1])]
    same = np.concatenate([[False], (z[by][1:] == z[by][:-1]).all(axis=1)])
    by = by[places(np.cumsum(~same)) < k]
    return rows.take(pa.array(by)), z[by]


def _nearest_of_task(points: np.ndarray, base: int, own: dict, keys: Sequence[str], schema: pa.Schema, k: int):
    """The k nearest rows of a task's batches to every query of a block."""
    boxed = len(points) >= BOXED_QUERIES and points.shape[1] <= BOXED_DIMS and not own and bool(np.isfinite(points).all())

    def read(batches: Iterator[pa.RecordBatch]):
        """Batches, for boxes put together up to DISTANCES / BOX rows."""
        held, n = [], 0
        for b in batches:
            if b.num_rows:
                held.append(b)
                n += b.num_rows
            if held and (not boxed or n >= DISTANCES // BOX):
                yield pa.Table.from_batches(held)
                held, n = [], 0
        if held:
            yield pa.Table.from_batches(held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, kept, pending = TaskContext.get().partitionId(), [], 0
        queries = _boxes(points, BOX) if boxed else None

        def first(tables):
            return first_k(pa.concat_tables(tables), "query", ["distance", *keys], k)
        for b in read(batches):
            z = np.asarray(b.column("_z").combine_chunks().flatten()).reshape(b.num_rows, -1)
            mine, rows = {}, b.drop_columns(["_z"])
            if own:
                for i, key in enumerate(zip(*(b.column(c).to_pylist() for c in keys))):
                    if key in own:
                        mine[i] = own[key]
            if boxed and np.isfinite(z).all():
                rows, z = _first_of_equal(rows, z, keys, k)
                found = _boxed_candidates(z, points, queries, k)
            else:
                found = _candidates(z, points, mine, k)
            for q, row, distance in _joined(found):
                near = rows.take(pa.array(row))
                for name, v in (("part", np.full(len(q), part, np.int32)), ("distance", distance),
                                ("query", (q + base).astype(np.int32))):
                    near = near.add_column(0, name, pa.array(v))
                kept.append(near.cast(schema))
                pending += len(q)
                if pending >= PENDING:
                    kept, pending = [first(kept)], 0
        if kept:
            yield from first(kept).to_batches()
    return run


def _joined(found):
    """Candidates of many boxes as a few long arrays."""
    held, n = [], 0
    for one in found:
        held.append(one)
        n += len(one[0])
        if n >= 1 << 16:
            yield tuple(map(np.concatenate, zip(*held)))
            held, n = [], 0
    if held:
        yield tuple(map(np.concatenate, zip(*held)))


def _nearest_block(rows: DataFrame, points: np.ndarray, base: int, own: dict, keys: Sequence[str], k: int) -> DataFrame:
    fields = [f for f in rows.schema.fields if f.name != "_z"]
    schema = T.StructType([T.StructField("query", T.IntegerType()), T.StructField("distance", T.DoubleType()),
                           T.StructField("part", T.IntegerType()), *fields])
    found = rows.mapInArrow(_nearest_of_task(points, base, own, keys, to_arrow_schema(schema), k), schema)

    # Lists of at most FAN * k rows are sorted where they are put together: no
    # Python call for a query.
    rest = [f.name for f in fields if f.name not in keys]
    near = F.slice(F.sort_array(F.collect_list(F.struct("distance", *[qcol(c) for c in (*keys, *rest)]))), 1, k)

    def merged(lists: DataFrame, by: list[str]) -> DataFrame:
        return lists.groupBy(*by).agg(near.alias("_near")).select(*by, F.posexplode("_near").alias("rank", "_row")) \
            .select(*by, (F.col("rank") + 1).alias("rank"), "_row.*")
    tasks = rows.rdd.getNumPartitions()
    while tasks > FAN:
        found = merged(found.withColumn("part", F.floor(F.col("part") / FAN).cast("int")), ["query", "part"])
        tasks = -(-tasks // FAN)
    return merged(found, ["query"])


def nearest(df: DataFrame, z: Column | Sequence[Column], queries: Sequence[Sequence[float]], key_cols: Sequence[str],
            k: int, exclude_keys: Sequence[tuple] | None = None, value_cols: Sequence[str] = (),
            first_query: int = 0) -> DataFrame:
    """k nearest rows to each query point: (query, rank, key..., distance,
    similarity_pct, value_cols...).  Ties break on the key; rows with a missing
    coordinate are nobody's neighbours."""
    vector = z if isinstance(z, Column) else F.array(*z)
    names = list(dict.fromkeys([*key_cols, *value_cols]))
    rows = df.select(*[qcol(c) for c in names], vector.cast("array<double>").alias("_z")).where(
        F.col("_z").isNotNull() & ~F.exists("_z", lambda v: v.isNull() | F.isnan(v)))
    points = np.asarray(queries, float).reshape(len(queries), -1 if len(queries) else 1)
    step, found = max(1, QUERY_CELLS // max(points.shape[1], 1)), []
    for lo in range(0, max(len(points), 1), step):
        own: dict[tuple, list[int]] = {}
        for q, key in enumerate((exclude_keys or [])[lo:lo + step]):
            own.setdefault(tuple(key), []).append(q)
        found.append(_nearest_block(rows, points[lo:lo + step], first_query + lo, own, list(key_cols), k))
    top = found[0]
    for more in found[1:]:
        top = top.unionByName(more)
    return top.select("query", "rank", *[qcol(c) for c in key_cols], "distance",
                      F.greatest(F.lit(0.0), 100 - F.col("distance") * SIMILARITY_SCALE).alias("similarity_pct"),
                      *[F.round(qcol(c).cast("double"), 3).alias(c) for c in value_cols if c not in key_cols])


def nearest_to_table(df: DataFrame, feature_cols: Sequence[str], key_cols: Sequence[str], queries: DataFrame,
                     query_cols: Sequence[str], k: int = DEFAULT_K, with_values: bool = False) -> DataFrame:
    """SIM-2 for a table of queries of any size: (query_cols..., rank, key...,
    distance, similarity_pct, value_cols...).  ``queries`` has the feature
    columns (missing: the column mean of df) and names its rows by
    ``query_cols``, whose names must not be those of ``key_cols``.  Its rows
    pass the driver in blocks of ``QUERY_CELLS`` numbers, each written before
    the next one starts."""
    cols = require_numeric(df, feature_cols, "A")
    work = complete_rows(df, cols)
    means, stds = scale_stats(work, _as_vector(cols), len(cols))
    dims = standardised_dims([qcol(c).cast("double") for c in cols], means, stds)
    q = nan_to_null(queries, cols)
    q = q.select(*[qcol(c) for c in query_cols], F.array(*[
        (F.coalesce(qcol(c).cast("double"), F.lit(float(m))) - F.lit(float(m))) / F.lit(float(s))
        for c, m, s in zip(cols, means, stds)]).alias("_q"))
    numbered = cut_lineage(ordered_prefix(q, list(query_cols), [], index_name="_at"))
    total, step, found = numbered.count(), max(1, QUERY_CELLS // max(len(cols), 1)), []
    for lo in range(0, max(total, 1), step):
        block = numbered.where((F.col("_at") >= lo) & (F.col("_at") < lo + step)).orderBy("_at").select("_q").toArrow()
        points = np.asarray(block["_q"].combine_chunks().flatten()).reshape(block.num_rows, len(cols))
        part = nearest(work, dims, points, key_cols, k, value_cols=cols if with_values else (), first_query=lo)
        found.append(part if total <= step else cut_lineage(part))
    top = found[0]
    for more in found[1:]:
        top = top.unionByName(more)
    return numbered.select("_at", *[qcol(c) for c in query_cols]).join(
        top.withColumnRenamed("query", "_at"), "_at").drop("_at")


def find_similar(df: DataFrame, feature_cols: Sequence[str], key_cols: Sequence[str],
                 query_values: Sequence[dict], n_similar: int = DEFAULT_K,
                 with_values: bool = False) -> tuple[DataFrame, list[str]]:
    """SIM-1 + SIM-2 over scalar columns: complete rows, standardised; a
    missing query value means the column mean.  ``with_values`` puts each
    neighbour's own feature values (3 decimals) beside its distance."""
    cols = require_numeric(df, feature_cols, "A")
    work = complete_rows(df, cols)
    vec = _as_vector(cols)
    means, stds = scale_stats(work, vec, len(cols))
    queries = [[(float(qv.get(c, means[i])) - means[i]) / stds[i] for i, c in enumerate(cols)]
               for qv in query_values]
    dims = standardised_dims([qcol(c).cast("double") for c in cols], means, stds)
    return nearest(work, dims, queries, key_cols, n_similar, value_cols=cols if with_values else ()), cols


def cohort_comparison(df: DataFrame, feature_cols: Sequence[str], key_cols: Sequence[str],
                      neighbours: DataFrame, query_values: Sequence[dict]) -> DataFrame:
    """SIM-3: per query and feature: population mean, mean of the returned
    neighbours, query value, its difference and % difference (|mean|
    floored at 0.001)."""
    cols = require_numeric(df, feature_cols, "A")
    work = complete_rows(df, cols)
    pop = work.agg(*[F.avg(qcol(c)).alias(c) for c in cols]).first().asDict()
    cohort = neighbours.join(work.select(*key_cols, *cols), list(key_cols)) \
        .groupBy("query").agg(*[F.avg(qcol(c)).alias(c) for c in cols])
    rows = []
    for c in cols:
        qv = F.element_at(F.array(*[F.lit(float(q.get(c, pop[c]))) for q in query_values]), F.col("query") + 1)
        rows.append(F.struct(F.lit(c).alias("feature"), F.lit(float(pop[c])).alias("population_mean"),
                             qcol(c).alias("cohort_mean"), qv.alias("query_value"),
                             (qv - F.lit(pop[c])).alias("diff_from_pop"),
                             ((qv - F.lit(pop[c])) / F.lit(max(abs(pop[c]), 0.001)) * 100).alias("diff_pct")))
    return cohort.select("query", F.explode(F.array(*rows)).alias("r")).select("query", "r.*")


def vector_centroids(df: DataFrame, vec_col: str, group_col: str, max_groups: int = 10_000) -> list[tuple]:
    """Mean vector per group: (group, [means]).  Bounded by ``max_groups``."""
    dims = df.select(F.size(qcol(vec_col)).alias("d")).agg(F.max("d")).first()[0] or 0
    cent = df.groupBy(group_col).agg(*[F.avg(qcol(vec_col)[d].cast("double")).alias(f"c{d}") for d in range(dims)])
    rows = bounded_rows(cent.orderBy(group_col), max_groups)
    return [(r[group_col], [r[f"c{d}"] for d in range(dims)]) for r in rows]


def nearest_vectors(df: DataFrame, vec_col: str, key_cols: Sequence[str], raw_queries: Sequence[Sequence[float]],
                    k: int = DEFAULT_K) -> DataFrame:
    """SIM-1 + SIM-2 on an array column (embeddings): standardise every
    dimension, standardise the raw query points the same way, k nearest."""
    dims = len(raw_queries[0])
    vec = qcol(vec_col).cast("array<double>")
    means, stds = scale_stats(df, vec, dims)
    queries = [[(q[d] - means[d]) / stds[d] for d in range(dims)] for q in raw_queries]
    return nearest(df, standardise(vec, means, stds), queries, key_cols, k)


def similar_rows(df: DataFrame, feature_cols: Sequence[str], key_cols: Sequence[str], query_keys: Sequence[tuple],
                 k: int = SELF_EXCLUDED_K) -> DataFrame:
    """PAT-5: neighbours of existing rows, self excluded.  Features are
    coerced, mean-imputed (not dropped) and standardised."""
    cols = require_numeric(df, feature_cols, "C")
    df = nan_to_null(df, cols)
    # One aggregate gives the imputation means and the population std of the
    # imputed columns: imputing the mean keeps the mean and scales the
    # variance by (non-null count / row count).
    aggs = [F.count(F.lit(1)).alias("_n")]
    for i, c in enumerate(cols):
        v = qcol(c).cast("double")
        aggs += [F.count(v).alias(f"k{i}"), F.avg(v).alias(f"m{i}"), F.var_pop(v).alias(f"v{i}")]
    row = df.agg(*aggs).first()
    n = row["_n"] or 0
    means = {c: (row[f"m{i}"] if row[f"m{i}"] is not None else 0.0) for i, c in enumerate(cols)}
    m = [means[c] for c in cols]
    s = []
    for i, _ in enumerate(cols):
        var = (row[f"v{i}"] or 0.0) * (row[f"k{i}"] or 0) / n if n else 0.0
        s.append(var ** 0.5 if var > 0 else 1.0)
    filled = df.select(*[qcol(c) for c in key_cols],
                       *[F.coalesce(qcol(c).cast("double"), F.lit(means[c])).alias(c) for c in cols])
    cond = F.lit(False)
    for key in query_keys:
        one = F.lit(True)
        for c, v in zip(key_cols, key):
            one = one & (qcol(c) == F.lit(v))
        cond = cond | one
    q_rows = {tuple(r[c] for c in key_cols): [r[c2] for c2 in cols]
              for r in bounded_rows(filled.where(cond), max(len(query_keys), 1) * 4)}
    ordered = [k_ for k_ in query_keys if k_ in q_rows]
    queries = [[(q_rows[k_][i] - m[i]) / s[i] for i in range(len(cols))] for k_ in ordered]
    if not queries:
        return df.sparkSession.createDataFrame([], "query int, rank int, distance double, similarity_pct double")
    z = standardised_dims([qcol(c) for c in cols], m, s)
    return nearest(filled, z, queries, key_cols, k, exclude_keys=ordered)

