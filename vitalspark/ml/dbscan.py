"""DBSCAN (ML-10) on boxes: space is cut into boxes, two boxes are compared by
their nearest and farthest distance, and only what that leaves open is looked
at point by point, a block of points against another, in any dimension.

* **Units** are the occupied cells of side eps / sqrt(d), with tight bounding
  boxes: points of one unit are all within eps of each other, so its core
  points share a cluster and a crowded spot is one unit, whatever it holds.
* **Blocks** are up to ``BLOCK`` neighbouring points of a unit with a tight box
  of their own: rows of the table, so a crowded unit is many rows.  Points are
  range-partitioned by unit, place and key; equal points do not pile up.
* **Unit pairs** with nearest distance <= eps come from a join over coarse
  cells of the first three axes.  Farthest distance <= eps: every point counts
  the other unit in full, without a look at its points.
* **Early stop**: a unit whose sure neighbours reach min_samples is core as a
  whole, one whose possible neighbours do not reach it holds no core point.
  Only points of the units in between are counted, first by boxes of blocks,
  then block against block in NumPy; what is written is a count per point.
* Units with core points are the nodes of the graph.  An edge needs one pair
  of core points within eps: by unit boxes, else by block boxes, else by the
  first pair found.  No pair of points is ever written.
* Components come from min-label propagation with pointer jumping.  A border
  point takes the lowest cluster among its core neighbours, the rest is noise
  (-1).  Clusters are numbered by their smallest core key.
"""

from __future__ import annotations

import itertools
import math
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
from ..plans.ordered import ordered_prefix
from ..session import cut_lineage
from .cluster import standardise_features

MIN_SAMPLES_FLOOR = 3      # fixed: min_samples = max(3, n // 20) by default
MIN_SAMPLES_DIVISOR = 20
EPS_FLOOR = 0.3            # fixed: the reference never uses eps below 0.3
BLOCK = 256                # points compared with each other at once
SALTS = 8                  # parts of a label or block that many rows share


def default_min_samples(n: int) -> int:
    return max(MIN_SAMPLES_FLOOR, n // MIN_SAMPLES_DIVISOR)


def _dist(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v))


def _offsets(g: int, reach: int) -> list[tuple]:
    return list(itertools.product(range(-reach, reach + 1), repeat=g))


def _shifted(cell_col: str, offsets: list[tuple]) -> Column:
    arr = F.array(*[F.array(*[F.lit(o) for o in off]) for off in offsets])
    return F.transform(arr, lambda off: F.zip_with(F.col(cell_col), off, lambda c, o: c + o))


def connected_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node long) + symmetric edges (u, v) -> (node, comp) where comp is the
    smallest node id of the component.

    Min-label propagation with pointer jumping on the executors, one path for
    every size, checkpointed every round."""
    return propagate_components(nodes, edges)


def propagate_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Distributed min-label propagation with pointer jumping; every round
    lowers a label or ends, so it converges.  Most nodes may share a label:
    the jump joins distinct labels, then deals the nodes over salts."""
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    labels = cut_lineage(nodes.select("node", F.col("node").alias("label")))
    while True:
        best = edges.join(labels.select(F.col("node").alias("v"), F.col("label").alias("lv")), "v") \
            .groupBy(F.col("u").alias("node")).agg(F.min("lv").alias("m"))
        step = cut_lineage(labels.join(best, "node", "left").select(
            "node", F.col("label").alias("old"), F.least("label", F.coalesce("m", "label")).alias("label")))
        ahead = step.select("label").distinct().join(
            step.select(F.col("node").alias("label"), F.col("label").alias("next")), "label")
        jump = step.withColumn("_s", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int")).join(
            ahead.withColumn("_s", salts), ["label", "_s"], "left")
        labels = cut_lineage(jump.select("node", "old", F.least("label", F.coalesce("next", "label")).alias("label")))
        if labels.where("label <> old").limit(1).count() == 0:
            return labels.select("node", F.col("label").alias("comp"))
        labels = labels.select("node", "label")


def _number(comp_keys: DataFrame) -> DataFrame:
    """(comp, first key) -> (comp, cluster), numbered by that key."""
    return ordered_prefix(comp_keys, ["_first"], [], index_name="cluster").select("comp", "cluster")


def _near_far(lo1: Column, hi1: Column, lo2: Column, hi2: Column, d: int) -> tuple[Column, Column]:
    """Squares of the nearest and farthest distance of two boxes."""
    near = far = F.lit(0.0)
    for j in range(d):
        gap = F.greatest(F.lit(0.0), lo2[j] - hi1[j], lo1[j] - hi2[j])
        span = F.greatest(hi2[j] - lo1[j], hi1[j] - lo2[j])
        near, far = near + gap * gap, far + span * span
    return near, far


def _box(prefix: str, d: int) -> list[Column]:
    """Aggregates: the box around the rows' boxes."""
    return [F.array(*[F.min(F.col(f"{prefix}lo")[j]) for j in range(d)]).alias(f"{prefix}lo"),
            F.array(*[F.max(F.col(f"{prefix}hi")[j]) for j in range(d)]).alias(f"{prefix}hi")]


def _cut_blocks(d: int, schema: pa.Schema):
    """Consecutive rows of one unit as blocks."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            units = np.asarray(b.column("unit").flatten()).reshape(n, d)
            z = np.asarray(b.column("z").flatten()).reshape(n, d)
            change = np.flatnonzero(np.concatenate([[True], (units[1:] != units[:-1]).any(1)]))
            starts = np.concatenate([np.arange(x, y, BLOCK) for x, y in zip(change, np.append(change[1:], n))])
            m, offsets = len(starts), np.append(starts, n)
            lists = [pa.ListArray.from_arrays(pa.array(np.arange(m + 1) * d, pa.int32()), pa.array(v.reshape(-1)))
                     for v in (units[starts], np.minimum.reduceat(z, starts), np.maximum.reduceat(z, starts))]
            points = pa.ListArray.from_arrays(pa.array(offsets * d, pa.int32()), pa.array(z.reshape(-1)))
            keys = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), b.column("_key"))
            yield pa.RecordBatch.from_arrays([pa.array(block + np.arange(m)), lists[0], pa.array(np.diff(offsets)),
                                              lists[1], lists[2], points, keys], schema=schema)
            block += m
    return run


def _blocks(pts: DataFrame, d: int, eps: float) -> DataFrame:
    """(block, unit, n, lo, hi, z, keys) of (_key, z)."""
    side = eps / math.sqrt(d) * (1 - 1e-9)

    def cells(parts):
        return F.transform("z", lambda v: F.floor(v * F.lit(parts / side)))
    order = ["unit", cells(2), cells(4), cells(8), "_key"]
    parts = int(pts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = pts.withColumn("unit", cells(1)).repartitionByRange(parts, *order).sortWithinPartitions(*order)
    many = T.ArrayType(T.DoubleType())
    schema = T.StructType([
        T.StructField("block", T.LongType()), T.StructField("unit", T.ArrayType(T.LongType())),
        T.StructField("n", T.LongType()), T.StructField("lo", many), T.StructField("hi", many), T.StructField("z", many),
        T.StructField("keys", T.ArrayType(pts.schema["_key"].dataType))])
    return cut_lineage(rows.select("_key", "z", "unit").mapInArrow(_cut_blocks(d, to_arrow_schema(schema)), schema))


def _unit_pairs(blocks: DataFrame, d: int, eps: float) -> DataFrame:
    """(a, b, n_b, sure) of all units with nearest distance <= eps, a unit
    with itself included; sure: farthest distance <= eps."""
    reach, g = math.floor(math.sqrt(d)) + 1, min(d, 3)
    units = blocks.groupBy("unit").agg(F.sum("n").alias("n"), *_box("", d))
    cell = F.array(*[F.floor(F.col("unit")[j] / reach) for j in range(g)])
    around = F.array(*[F.array(*[cell[j] + o for j, o in enumerate(x)]) for x in itertools.product((-1, 0, 1), repeat=g)])
    a = units.select(F.col("unit").alias("a"), F.col("lo").alias("alo"), F.col("hi").alias("ahi"),
                     F.explode(around).alias("cell"))
    b = units.select(F.col("unit").alias("b"), F.col("n").alias("n_b"), "lo", "hi", cell.alias("cell"))
    near, far = _near_far(F.col("alo"), F.col("ahi"), F.col("lo"), F.col("hi"), d)
    return cut_lineage(a.join(b, "cell").where(near <= eps * eps).select("a", "b", "n_b", (far <= eps * eps).alias("sure")))


def _open_blocks(pairs: DataFrame, left: DataFrame, right: DataFrame, d: int, eps: float) -> DataFrame:
    """Block pairs of unit pairs (a, b) with nearest distance <= eps:
    a, b, ablock, bblock, n_b, sure."""
    l = left.select(F.col("unit").alias("a"), F.col("block").alias("ablock"), F.col("lo").alias("alo"), F.col("hi").alias("ahi"))
    r = right.select(F.col("unit").alias("b"), F.col("block").alias("bblock"), F.col("n").alias("n_b"), "lo", "hi")
    near, far = _near_far(F.col("alo"), F.col("ahi"), F.col("lo"), F.col("hi"), d)
    return pairs.join(l, "a").join(r, "b").where(near <= eps * eps).select(
        *pairs.columns, "ablock", "bblock", "n_b", (far <= eps * eps).alias("sure"))


def _compared(open_pairs: DataFrame, left: DataFrame, right: DataFrame, kind: str, d: int, eps: float,
              value: str | None = None) -> DataFrame:
    """Blocks of open pairs (ablock, bblock) point against point.  ``count``:
    (block, at, found) neighbours of each point of ablock; ``least``: the
    smallest ``value`` among the blocks with a neighbour; ``any``: (a, b) with
    a pair within eps.  Rows of one ablock follow each other, so a task adds
    them up before it writes them."""
    carry = ["a", "b"] if kind == "any" else ["ablock"]
    rows = open_pairs.select(*carry, *([] if kind != "any" else ["ablock"]), "bblock", *([value] if value else [])) \
        .join(left.select(F.col("block").alias("ablock"), F.col("z").alias("az")), "ablock") \
        .join(right.select(F.col("block").alias("bblock"), F.col("z").alias("bz")), "bblock")
    if kind == "any":
        return rows.mapInArrow(_any_pair(d, eps), rows.select("a", "b").schema).distinct()
    salt = F.pmod(F.xxhash64("bblock"), F.lit(SALTS))
    rows = rows.repartition("ablock", salt).sortWithinPartitions("ablock").select(
        "ablock", "az", "bz", *([F.col(value).alias("value")] if value else []))
    found = rows.mapInArrow(_point_values(d, eps, bool(value)), "block long, at int, found long")
    return found.groupBy("block", "at").agg((F.min if value else F.sum)("found").alias("found"))


def _pairs_of(b: pa.RecordBatch, d: int):
    az, bz = b.column("az"), b.column("bz")
    for i in range(b.num_rows):
        x, y = (np.asarray(v[i].values).reshape(-1, d) for v in (az, bz))
        square = np.zeros((len(x), len(y)))
        for j in range(d):  # axis by axis, like the boxes, so that both round alike
            gap = x[:, j, None] - y[None, :, j]
            square += gap * gap
        yield i, square


def _any_pair(d: int, eps: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hit = [i for i, square in _pairs_of(b, d) if (square <= eps * eps).any()]
            yield b.select(["a", "b"]).take(pa.array(hit, pa.int64()))
    return run


def _point_values(d: int, eps: float, least: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, total = None, None

        def close():
            at = np.flatnonzero(total < np.iinfo(np.int64).max) if least else np.flatnonzero(total)
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(at), last, np.int64)), pa.array(at, pa.int32()),
                                               pa.array(total[at])], names=["block", "at", "found"])
        for b in batches:
            names = b.column("ablock").to_pylist()
            values = b.column("value").to_pylist() if least else None
            for i, square in _pairs_of(b, d):
                if names[i] != last:
                    if last is not None:
                        yield close()
                    last, total = names[i], np.full(len(square), np.iinfo(np.int64).max if least else 0, np.int64)
                near = square <= eps * eps
                if least:
                    total = np.where(near.any(1), np.minimum(total, values[i]), total)
                else:
                    total = total + near.sum(1)
        if last is not None:
            yield close()
    return run


def _split_cores(d: int, schema: pa.Schema):
    """Blocks with their points' core flags, and the core points and the
    others each with their own box."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = {c: [] for c in ("core", "cores", "lo", "hi", "cz", "olo", "ohi", "oz", "oat")}
            for i in range(b.num_rows):
                z, known = np.asarray(b.column("z")[i].values).reshape(-1, d), b.column("known")[i].as_py()
                core = np.full(len(z), known >= b.column("need")[i].as_py())
                counts = b.column("counts")[i].values
                if not core.all() and counts is not None and len(counts):
                    at, found = (np.asarray(counts.field(k)) for k in (0, 1))
                    core[at] = known + found >= b.column("need")[i].as_py()
                out["core"].append(core.tolist())
                out["cores"].append(int(core.sum()))
                for names, part in ((("lo", "hi", "cz"), z[core]), (("olo", "ohi", "oz"), z[~core])):
                    lo, hi = (part.min(0), part.max(0)) if len(part) else (None, None)
                    for c, v in zip(names, (lo, hi, part.reshape(-1))):
                        out[c].append(v)
                out["oat"].append(np.flatnonzero(~core).astype(np.int32))
            yield pa.RecordBatch.from_arrays([b.column(c) for c in ("block", "unit", "keys")] + [
                pa.array(out[c], schema.field(c).type) for c in out], schema=schema)
    return run


def core_blocks(pts: DataFrame, d: int, eps: float, min_samples: int) -> tuple[DataFrame, DataFrame]:
    """(unit pairs, blocks with core flags).  A block has keys, core, the
    number of its core points, their box (lo, hi) and points (cz), and the
    box (olo, ohi), points (oz) and places (oat) of the others."""
    blocks = _blocks(pts, d, eps)
    pairs = _unit_pairs(blocks, d, eps)
    state = cut_lineage(pairs.groupBy(F.col("a").alias("unit")).agg(
        F.sum(F.when(F.col("sure"), F.col("n_b")).otherwise(0)).alias("known"), F.sum("n_b").alias("possible")))
    unsure = state.where((F.col("known") < min_samples) & (F.col("possible") >= min_samples))
    mixed = pairs.where(~F.col("sure")).select("a", "b").join(unsure.select(F.col("unit").alias("a"), "known"), "a")
    near = cut_lineage(_open_blocks(mixed, blocks, blocks, d, eps))
    sure = near.groupBy(F.col("ablock").alias("block")).agg(
        F.sum(F.when(F.col("sure"), F.col("n_b")).otherwise(0)).alias("more"), F.max("known").alias("base"))
    left = near.where(~F.col("sure")).join(
        sure.where(F.col("base") + F.col("more") < min_samples).select(F.col("block").alias("ablock")), "ablock", "left_semi")
    counts = _compared(left, blocks, blocks, "count", d, eps).groupBy("block").agg(
        F.collect_list(F.struct("at", "found")).alias("counts"))  # at most BLOCK rows each
    known = blocks.join(state.select("unit", "known"), "unit").join(sure.select("block", "more"), "block", "left") \
        .join(counts, "block", "left").select(
            "block", "unit", "keys", "z", (F.col("known") + F.coalesce("more", F.lit(0))).alias("known"),
            F.lit(min_samples).cast("long").alias("need"),
            F.coalesce("counts", F.array().cast("array<struct<at:int,found:bigint>>")).alias("counts"))
    many = T.ArrayType(T.DoubleType())
    schema = T.StructType([*known.select("block", "unit", "keys").schema.fields,
                           T.StructField("core", T.ArrayType(T.BooleanType())), T.StructField("cores", T.LongType()),
                           *[T.StructField(c, many) for c in ("lo", "hi", "cz", "olo", "ohi", "oz")],
                           T.StructField("oat", T.ArrayType(T.IntegerType()))])
    return pairs, cut_lineage(known.mapInArrow(_split_cores(d, to_arrow_schema(schema)), schema))


def _unit_edges(pairs: DataFrame, cores: DataFrame, units: DataFrame, d: int, eps: float) -> DataFrame:
    """(a, b), a < b, of units with core points within eps of each other."""
    box = units.select(F.col("unit").alias("a"), F.col("lo").alias("alo"), F.col("hi").alias("ahi"))
    near, far = _near_far(F.col("alo"), F.col("ahi"), F.col("lo"), F.col("hi"), d)
    found = cut_lineage(pairs.where(F.col("a") < F.col("b")).select("a", "b").join(box, "a").join(
        units.select(F.col("unit").alias("b"), "lo", "hi"), "b").where(near <= eps * eps).select(
        "a", "b", (far <= eps * eps).alias("whole")))
    blocks = cut_lineage(_open_blocks(found.where(~F.col("whole")).select("a", "b"), cores, cores, d, eps))
    by_box = blocks.where("sure").select("a", "b").distinct()
    left = blocks.where(~F.col("sure")).join(by_box, ["a", "b"], "left_anti")
    points = cores.select("block", F.col("cz").alias("z"))
    return found.where("whole").select("a", "b").unionByName(by_box).unionByName(
        _compared(left, points, points, "any", d, eps))


def _labels(pts: DataFrame, d: int, eps: float, min_samples: int) -> DataFrame:
    """(_key, is_core, cluster) of every point."""
    pairs, blocks = core_blocks(pts, d, eps, min_samples)
    cores = blocks.where("cores > 0").withColumnRenamed("cores", "n")
    flagged = F.filter(F.arrays_zip("keys", "core"), lambda x: x["core"])
    units = cut_lineage(cores.groupBy("unit").agg(
        *_box("", d), F.min(F.array_min(F.transform(flagged, lambda x: x["keys"]))).alias("_first")))
    ids = cut_lineage(ordered_prefix(units.select("unit"), ["unit"], [], index_name="node"))
    edges = _unit_edges(pairs, cores, units, d, eps).join(ids.select(F.col("unit").alias("a"), F.col("node").alias("u")), "a") \
        .join(ids.select(F.col("unit").alias("b"), F.col("node").alias("v")), "b").select("u", "v")
    edges = cut_lineage(edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))))
    named = ids.join(connected_components(ids.select("node"), edges), "node").join(units, "unit")
    numbers = _number(named.groupBy("comp").agg(F.min("_first").alias("_first")))
    clusters = cut_lineage(named.join(numbers, "comp").select("unit", "cluster", "lo", "hi"))

    # Border points: the lowest cluster of a unit, block or point within eps.
    others = blocks.where(F.size("oat") > 0).select("block", "unit", F.col("olo").alias("lo"), F.col("ohi").alias("hi"),
                                                    F.col("oz").alias("z"))
    box = clusters.select(F.col("unit").alias("b"), "cluster", F.col("lo").alias("ulo"), F.col("hi").alias("uhi"))
    near, far = _near_far(F.col("ulo"), F.col("uhi"), F.col("lo"), F.col("hi"), d)
    by_unit = cut_lineage(others.drop("z").join(pairs.select(F.col("a").alias("unit"), "b"), "unit").join(box, "b").where(
        near <= eps * eps).select("unit", "b", "block", "cluster", (far <= eps * eps).alias("whole")))
    mixed = by_unit.where(~F.col("whole")).select(F.col("unit").alias("a"), "b", "cluster").distinct()
    by_block = cut_lineage(_open_blocks(mixed, others, cores, d, eps))
    sure = by_unit.where("whole").select("block", "cluster").unionByName(
        by_block.where("sure").select(F.col("ablock").alias("block"), "cluster")).groupBy("block").agg(
        F.min("cluster").alias("_sure"))
    points = _compared(by_block.where(~F.col("sure")), others, cores.select("block", F.col("cz").alias("z")), "least", d,
                       eps, "cluster").groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct("at", "found"))).alias("_points"))
    rows = blocks.join(clusters.select("unit", "cluster"), "unit", "left").join(sure, "block", "left").join(
        points, "block", "left")
    rows = rows.select("cluster", "_sure", "_points", "oat", F.posexplode(F.arrays_zip("keys", "core")).alias("_at", "_row"))
    # Places in ``oat`` number the points that are not core.
    place = (F.array_position("oat", F.col("_at")) - 1).cast("int")
    border = F.least(F.col("_sure"), F.col("_points")[place])
    return rows.select(F.col("_row.keys").alias("_key"), F.col("_row.core").alias("is_core"),
                       F.when(F.col("_row.core"), F.col("cluster")).otherwise(F.coalesce(border, F.lit(-1))).alias("cluster"))


KNN = 5               # fixed: automatic eps looks at the 5th nearest point, self included
EPS_QUANTILE = 0.9    # fixed: ... at its 90th percentile


def _kth_distance(query: DataFrame, pts: DataFrame, d: int, k: int, start: float) -> DataFrame:
    """Exact distance from each query point to its k-th nearest point of
    ``pts`` (self included): grid search with a radius that doubles only for
    the points not yet resolved.  Points outside the 3^g cells of side R
    around p are at least R away, so a k-th distance <= R is final."""
    from pyspark.sql import Window
    g = min(d, 3)
    offs = _offsets(g, 1)
    radius = start
    unresolved = cut_lineage(query.select("_key", "z"))
    found = []
    for _ in range(64):
        cell = F.array(*[F.floor(F.col("z")[j] / radius) for j in range(g)])
        probe = unresolved.withColumn("cell", cell).select("_key", "z", F.explode(_shifted("cell", offs)).alias("cell"))
        cand = pts.select(cell.alias("cell"), F.col("z").alias("_qz"))
        dist = probe.join(cand, "cell").select("_key", _dist(F.col("z"), F.col("_qz")).alias("_d"))
        w = Window.partitionBy("_key").orderBy("_d")
        top = dist.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k) \
            .groupBy("_key").agg(F.count(F.lit(1)).alias("_c"), F.max("_d").alias("_kd"))
        done = cut_lineage(top.where((F.col("_c") >= k) & (F.col("_kd") <= radius)).select("_key", "_kd"))
        found.append(done)
        unresolved = cut_lineage(unresolved.join(done, "_key", "left_anti"))
        if unresolved.limit(1).count() == 0:
            break
        radius *= 2
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def auto_eps(pts: DataFrame, d: int, n: int) -> float:
    """eps = max(0.3, linear 90th percentile of the distance to the 5th
    nearest point, self included), exactly.  One hot-spot-safe degree count
    at radius 0.3 settles the usual case (that percentile is below 0.3);
    otherwise exact k-th distances are computed for the points beyond 0.3
    only (all points in the rare case where the percentile straddles 0.3)."""
    if n < 2:
        return EPS_FLOOR
    k = min(KNN, n)
    blocks = core_blocks(pts, d, EPS_FLOOR, k)[1]
    within = blocks.agg(F.sum("cores")).first()[0]   # points with k-th distance <= 0.3
    h = EPS_QUANTILE * (n - 1)
    k_lo = int(h // 1)
    k_hi = min(k_lo + 1, n - 1)
    frac = h - k_lo
    if within >= k_hi + 1:
        return EPS_FLOOR
    if within <= k_lo:
        far = blocks.select(F.explode(F.arrays_zip("keys", "core")).alias("_row")).where(~F.col("_row.core"))
        query, base = pts.join(far.select(F.col("_row.keys").alias("_key")), "_key", "left_semi"), within
    else:
        query, base = pts, 0
    kd = _kth_distance(query, pts, d, k, 2 * EPS_FLOOR)
    ranked = ordered_prefix(kd, ["_kd", "_key"], [], index_name="_i")
    picks = {r["_i"]: r["_kd"] for r in ranked.where(F.col("_i").isin(k_lo - base, k_hi - base)).collect()}
    v_lo, v_hi = picks[k_lo - base], picks[k_hi - base]
    return max(EPS_FLOOR, v_lo + frac * (v_hi - v_lo))


def dbscan(df: DataFrame, feature_cols: Sequence[str], key_cols: Sequence[str], eps: float | None = None,
           min_samples: int | None = None) -> DataFrame:
    """key..., cluster (-1 = noise), is_core for every complete row.  With
    ``eps=None`` eps is chosen as the reference does (``auto_eps``); with
    ``min_samples=None`` it is max(3, n // 20)."""
    st = standardise_features(df, feature_cols, key_cols)
    d = len(st.feature_cols)
    keys = [qcol(k) for k in key_cols]
    pts = st.data.select(F.struct(*keys).alias("_key"), vector_to_array("features").alias("z"))
    n = pts.count() if (min_samples is None or eps is None) else None
    if min_samples is None:
        min_samples = default_min_samples(n)
    if eps is None:
        eps = auto_eps(pts, d, n)
    out = _labels(pts, d, eps, min_samples)
    return out.select(*[F.col("_key")[k].alias(k) for k in key_cols], F.col("cluster").cast("long").alias("cluster"),
                      "is_core")
