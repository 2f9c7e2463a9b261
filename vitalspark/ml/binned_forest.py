"""Random forests of many rows over few binned feature vectors (ML-3, ML-4).

Trees see a row only by the bins of its features (32 at most each).  With far
more rows than combinations of bins (cells), the rows of a cell count as sums:

1. Borders of the bins: Spark's rule (midpoints of neighbouring values, or
   about equal shares) on 1,024 quantiles of all training rows.
2. Bootstrap: every training row has its own Poisson(1) weight in every tree.
   Classes: weights of n equal rows add up to a Poisson(n) number, drawn once
   per cell, class and tree.  Numbers: rows are dealt and sorted by cell, each
   gets its weights, and per cell and tree the weight and the weighted sums of
   the label and its square are kept.  Draws depend on the rows of a cell only,
   not on files or partitions; a cell of very many rows is dealt in parts.
3. Every tree is grown in one task from its sums, level by level: best split of
   every feature (of a random subset for classes) by variance or Gini, ordered
   categories, leaves of equal prediction merged, as Spark's own forests do.
4. The nodes are written in Spark's format and read as a Spark model.  Rows are
   scored by their cell: each cell is predicted once.

Memory a task: the sums of ``GROUPS`` cells, or one tree's sums (``CELLS``
numbers at most).  Larger grids, and several classes with text features, are
left to Spark's own forest.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import RandomForestClassificationModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.linalg import Vectors
from pyspark.ml.regression import RandomForestRegressionModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import qcol
from ..session import scratch_table

MAX_BINS = 32          # Spark's default for forests
QUANTILES = 1024       # places of the sorted values that the borders are chosen from
ACCURACY = 10_000
CELLS = 1 << 20        # cells times sums a cell
ROWS_PER_CELL = 4      # training rows there must be for each
BLOCK = 4096           # rows that get their weights at once
PART = 1 << 18         # rows of a cell that go to one task
GROUPS = 2048          # cells whose sums are passed on at once
STATS = pa.schema([("tree", pa.int32()), ("cells", pa.binary()), ("sums", pa.binary())])
STATS_DDL = "tree int, cells binary, sums binary"
NODES = pa.schema([
    ("treeID", pa.int32()), ("id", pa.int32()), ("prediction", pa.float64()), ("impurity", pa.float64()),
    ("impurityStats", pa.list_(pa.float64())), ("rawCount", pa.int64()), ("gain", pa.float64()),
    ("leftChild", pa.int32()), ("rightChild", pa.int32()), ("featureIndex", pa.int32()),
    ("leftCategoriesOrThreshold", pa.list_(pa.float64())), ("numCategories", pa.int32())])
NODES_DDL = ("treeID int, id int, prediction double, impurity double, impurityStats array<double>, rawCount bigint, "
             "gain double, leftChild int, rightChild int, featureIndex int, leftCategoriesOrThreshold array<double>, "
             "numCategories int")


def quantiles(name: str) -> Column:
    """The values at ``QUANTILES`` + 1 places of the sorted column, ends included."""
    places = ", ".join(f"{i / QUANTILES!r}D" for i in range(QUANTILES + 1))
    return F.expr(f"percentile_approx({name}, array({places}), {ACCURACY})")


def borders(values: Sequence[float]) -> list[float]:
    """At most MAX_BINS - 1 thresholds; a value belongs left of the first one
    that is not smaller."""
    value, count = np.unique(np.asarray(values, float), return_counts=True)
    with np.errstate(over="ignore", invalid="ignore"):
        middle = (value[:-1] + value[1:]) / 2
    middle = np.where(np.isfinite(middle) & (middle < value[1:]), middle, value[:-1])
    if len(middle) < MAX_BINS:
        return middle.tolist()
    stride, reached, target, out = count.sum() / MAX_BINS, count[0], count.sum() / MAX_BINS, []
    for i in range(1, len(value)):
        before, reached = reached, reached + count[i]
        if abs(before - target) < abs(reached - target):
            out.append(float(middle[i - 1]))
            target += stride
    return out[:MAX_BINS - 1]


@dataclass(frozen=True)
class Grid:
    """Thresholds of each feature; of a text feature None and its number of categories."""

    thresholds: tuple[tuple[float, ...] | None, ...]
    bins: tuple[int, ...]

    @property
    def cells(self) -> int:
        return reduce(lambda a, b: a * b, self.bins, 1)

    def code(self, columns: Sequence[str]) -> Column:
        """The number of a row's cell."""
        out = "0"
        for c, t, n in zip(columns, self.thresholds, self.bins):
            name = "CAST(`" + c.replace("`", "``") + "` AS DOUBLE)"
            out = f"({out}) * {n} + " + (f"CAST({name} AS INT)" if t is None else _bin(name, t, 0, len(t)))
        return F.expr(out)

    def values(self) -> list[list[float]]:
        """A value of every bin of each feature."""
        return [[float(b) for b in range(n)] if t is None else [*t, float(np.nextafter(t[-1], np.inf)) if t else 0.0]
                for t, n in zip(self.thresholds, self.bins)]

    def parts(self, cells: np.ndarray) -> np.ndarray:
        """(cells, features): the bins of each cell."""
        return np.stack(np.unravel_index(cells, self.bins), 1)


def _bin(c: str, t: Sequence[float], lo: int, hi: int) -> str:
    """SQL: how many thresholds are smaller, by halves."""
    if lo == hi:
        return str(lo)
    mid = (lo + hi) // 2
    return f"CASE WHEN {c} <= CAST('{t[mid]!r}' AS DOUBLE) THEN {_bin(c, t, lo, mid)} ELSE {_bin(c, t, mid + 1, hi)} END"


class Poisson:
    """Poisson(1) numbers by inversion: 16 random bits decide nearly all, the
    few at a step of the distribution take 53 more."""

    def __init__(self):
        mass = np.cumsum(np.cumprod([np.exp(-1.0), *(1 / k for k in range(1, 20))]))
        self.mass = np.append(mass, 1.0)
        low, high = (np.searchsorted(self.mass, x, "right") for x in (np.arange(65536) / 65536, np.arange(1, 65537) / 65536))
        self.table = np.where(low == high, low, -1).astype(np.float64)

    def draw(self, rng: np.random.Generator, rows: int, trees: int) -> np.ndarray:
        bits = np.frombuffer(rng.bytes(2 * rows * trees), np.uint16)
        out = self.table[bits]
        open_ = np.flatnonzero(out < 0)
        out[open_] = np.minimum(np.searchsorted(self.mass, (bits[open_] + rng.random(len(open_))) / 65536, "right"), 20)
        return out.reshape(rows, trees)


def _passed(trees: int, cells: list, sums: list) -> pa.RecordBatch:
    """One row a tree: cells and their sums as bytes."""
    name, each = np.asarray(cells, np.int64).tobytes(), np.stack(sums)  # cells, sums, trees
    return pa.RecordBatch.from_arrays([
        pa.array(range(trees), pa.int32()), pa.array([name] * trees, pa.binary()),
        pa.array([np.ascontiguousarray(each[:, :, t]).tobytes() for t in range(trees)], pa.binary())], schema=STATS)


def _label_sums(trees: int, seed: int):
    """Rows sorted by cell, part and label -> per tree and cell the sums of
    weight, weighted label and weighted square."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        poisson, done_cells, done_sums = Poisson(), [], []
        at, held, blocks, total = None, [], 0, None

        def weigh(last: bool):
            nonlocal held, blocks, total
            y = np.concatenate(held) if held else np.zeros(0)
            end = len(y) if last else len(y) // BLOCK * BLOCK
            for lo in range(0, end, BLOCK):
                part = y[lo:min(lo + BLOCK, end)]
                rng = np.random.default_rng([seed, *at, blocks])
                total += np.stack([np.ones(len(part)), part, part * part]) @ poisson.draw(rng, len(part), trees)
                blocks += 1
            held = [y[end:]]

        for b in batches:
            cell, part, y = (b.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            if not len(cell):
                continue
            starts = np.flatnonzero(np.concatenate([[True], (np.diff(cell) != 0) | (np.diff(part) != 0)]))
            for lo, hi in zip(starts.tolist(), [*starts[1:].tolist(), len(cell)]):
                key = (int(cell[lo]), int(part[lo]))
                if key != at:
                    if at is not None:
                        weigh(True)
                        done_cells.append(at[0])
                        done_sums.append(total)
                        if len(done_cells) == GROUPS:
                            yield _passed(trees, done_cells, done_sums)
                            done_cells, done_sums = [], []
                    at, held, blocks, total = key, [], 0, np.zeros((3, trees))
                held.append(y[lo:hi])
            if sum(map(len, held)) >= BLOCK:
                weigh(False)
        if at is not None:
            weigh(True)
            yield _passed(trees, [*done_cells, at[0]], [*done_sums, total])
    return run


def _class_counts(trees: int):
    """(cell, class, rows) -> the same for each tree; the tree draws its weights."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cell, label, n = (b.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(3))
            name, sums = cell.tobytes(), np.stack([label, n], 1).tobytes()
            yield pa.RecordBatch.from_arrays([pa.array(range(trees), pa.int32()), pa.array([name] * trees, pa.binary()),
                                              pa.array([sums] * trees, pa.binary())], schema=STATS)
    return run


class Tree:
    """Grown from sums of cells.  ``sums``: (cells, k) weights of the classes,
    or (cells, 3) weight, weighted label, weighted square."""

    def __init__(self, grid: Grid, cells: np.ndarray, sums: np.ndarray, classes: int, depth: int,
                 rng: np.random.Generator):
        self.grid, self.classes, self.rng, self.nodes = grid, classes, rng, []
        weight = sums.sum(1) if classes else sums[:, 0]
        used = weight > 0
        sums, weight = sums[used], weight[used]
        # What the gain of a split is made of: labels are centred, which changes no gain and keeps its digits.
        value = sums if classes else (sums[:, 1] - sums[:, 1].sum() / max(weight.sum(), 1) * weight)[:, None]
        bins, node, first = grid.parts(cells[used]), np.zeros(len(weight), np.int64), 0
        level, made = 1, 1
        for d in range(depth + 1):
            stats = self._add(node, sums, level)
            best = self._best(bins, node, weight, value, level) if d < depth else None
            split = best[0] > 0 if best else np.zeros(level, bool)
            child = np.full(level, -1)
            child[split] = made + 2 * np.arange(split.sum())
            self.nodes.append((stats, split, child, best))
            if not split.any():
                break
            _, feature, left = best
            on = split[node]
            node, bins, sums, weight, value = node[on], bins[on], sums[on], weight[on], value[on]
            goes = left[node, bins[np.arange(len(node)), feature[node]]]
            first, level = made, 2 * int(split.sum())
            made += level
            node = child[node] - first + ~goes

    @staticmethod
    def _add(at: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
        return np.stack([np.bincount(at, values[:, i], n) for i in range(values.shape[1])], -1)

    def _best(self, bins, node, weight, value, level):
        """(gain, feature, which bins go left) of each node's best split; gain 0: none."""
        count = len(self.grid.bins)
        total, mine = np.bincount(node, weight, level), self._add(node, value, level)
        base = (mine ** 2).sum(-1) / total
        allowed = np.ones((level, count), bool)
        if self.classes:  # a random subset of the features for every node
            chosen = int(np.ceil(np.sqrt(count)))
            allowed = np.argsort(np.argsort(self.rng.random((level, count)), 1), 1) < chosen
        gain, feature = np.zeros(level), np.full(level, -1)
        left = np.zeros((level, max(self.grid.bins)), bool)
        for f, (n, t) in enumerate(zip(self.grid.bins, self.grid.thresholds)):
            if n < 2:
                continue
            key = node * n + bins[:, f]
            w = np.bincount(key, weight, level * n).reshape(level, n)
            v = self._add(key, value, level * n).reshape(level, n, -1)
            order = np.broadcast_to(np.arange(n), (level, n))
            if t is None:  # categories by mean label, or share of the second class; empty ones last
                with np.errstate(divide="ignore", invalid="ignore"):
                    order = np.argsort(np.where(w > 0, v[:, :, -1] / w, np.inf), 1, kind="stable")
                w, v = np.take_along_axis(w, order, 1), np.take_along_axis(v, order[:, :, None], 1)
            lw, lv = np.cumsum(w, 1)[:, :-1], np.cumsum(v, 1)[:, :-1]
            rw, rv = total[:, None] - lw, mine[:, None, :] - lv
            with np.errstate(divide="ignore", invalid="ignore"):
                won = ((lv ** 2).sum(-1) / lw + (rv ** 2).sum(-1) / rw - base[:, None]) / total[:, None]
            won = np.where((lw >= 1) & (rw >= 1) & allowed[:, f, None], won, 0)
            place = won.argmax(1)
            top = won[np.arange(level), place]
            # Rounding alone is no gain.
            better = (top > gain) & (top * total > 1e-13 * (base + np.abs(top * total)))
            gain[better], feature[better] = top[better], f
            goes = np.zeros((level, n), bool)
            np.put_along_axis(goes, order, np.arange(n) <= place[:, None], 1)
            left[better, :n], left[better, n:] = goes[better], False
        return gain, feature, left

    def table(self, tree: int) -> pa.Table:
        """The nodes in Spark's columns; leaves of one parent with the same prediction are merged into it."""
        sums = np.concatenate([x[0] for x in self.nodes])
        child = np.concatenate([x[2] for x in self.nodes])
        blank = [(np.zeros(len(x[0])), np.full(len(x[0]), -1), np.zeros((len(x[0]), max(self.grid.bins)), bool)) for x in self.nodes]
        gain, feature, left = (np.concatenate([(x[3] or y)[i] for x, y in zip(self.nodes, blank)]) for i in range(3))
        weight = sums.sum(1) if self.classes else sums[:, 0]
        safe = np.maximum(weight, 1)
        if self.classes:
            predicted, impurity = sums.argmax(1).astype(float), 1 - ((sums / safe[:, None]) ** 2).sum(1)
        else:
            predicted = sums[:, 1] / safe
            impurity = np.maximum(sums[:, 2] / safe - predicted ** 2, 0)
        for i in np.flatnonzero(child >= 0)[::-1].tolist():
            a = child[i]
            if child[a] < 0 and child[a + 1] < 0 and predicted[a] == predicted[a + 1]:
                child[i] = -1
        kept = np.zeros(len(child), bool)
        kept[0] = True
        for i in np.flatnonzero(child >= 0).tolist():  # parents come before their children
            if kept[i]:
                kept[child[i]] = kept[child[i] + 1] = True
        name = np.cumsum(kept) - 1
        rows = {f.name: [] for f in NODES}
        for i in np.flatnonzero(kept).tolist():
            inner = child[i] >= 0
            f = int(feature[i]) if inner else -1
            t = self.grid.thresholds[f] if inner else None
            bins = np.flatnonzero(left[i, :self.grid.bins[f]]) if inner else ()
            row = (tree, int(name[i]), predicted[i], impurity[i], sums[i].tolist(), int(weight[i]),
                   gain[i] if inner else -1.0, int(name[child[i]]) if inner else -1, int(name[child[i] + 1]) if inner else -1,
                   f, [] if not inner else [float(b) for b in bins] if t is None else [t[len(bins) - 1]],
                   self.grid.bins[f] if inner and t is None else -1)
            for column, x in zip(rows.values(), row):
                column.append(x)
        return pa.table({k: pa.array(v, NODES.field(k).type) for k, v in rows.items()}, schema=NODES)


def _grow(grid: Grid, classes: int, depth: int, seed: int):
    def run(table: pa.Table) -> pa.Table:
        tree = table.column("tree")[0].as_py()
        cells = np.concatenate([np.frombuffer(x.as_py(), np.int64) for x in table.column("cells")])
        kind = np.int64 if classes else np.float64
        sums = np.concatenate([np.frombuffer(x.as_py(), kind) for x in table.column("sums")]).reshape(len(cells), -1)
        order = np.lexsort([*sums.T[::-1], cells])
        cells, sums = cells[order], sums[order]
        rng = np.random.default_rng([seed, tree])
        name, at = np.unique(cells, return_inverse=True)
        if classes:
            weight = np.bincount(at * classes + sums[:, 0], rng.poisson(sums[:, 1]), len(name) * classes)
            sums = weight.reshape(-1, classes)
        else:
            sums = Tree._add(at, sums, len(name))  # parts of one cell
        return Tree(grid, name, sums, classes, depth, rng).table(tree)
    return run


def _rows_by_cell(coded: DataFrame) -> DataFrame:
    """(cell, part, label) dealt by cell and sorted; a cell of more than
    ``PART`` rows is dealt in parts by its rows' hash."""
    sizes = coded.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / PART).cast("int").alias("parts")).where("parts > 1")
    share = F.when(F.col("parts").isNotNull(), F.pmod(F.col("row"), F.col("parts"))).otherwise(0)
    rows = coded.join(F.broadcast(sizes), "cell", "left").select("cell", share.alias("part"), "label")  # a cell a grid place
    return rows.repartition("cell", "part").sortWithinPartitions("cell", "part", "label")


def fit(train: DataFrame, estimator, encoded: Sequence[str], keys: Sequence[str], grid: Grid, classes: int, seed: int):
    """The forest of ``estimator`` fitted to all rows of ``train`` (encoded
    columns and label), as a Spark model.  ``classes``: 0 for regression."""
    from pyspark import StorageLevel
    spark, trees, depth = train.sparkSession, estimator.getNumTrees(), estimator.getMaxDepth()
    coded = train.select(grid.code(encoded).alias("cell"), F.col("label").cast("double").alias("label"),
                         *([] if classes else [F.hash("label", *[qcol(k) for k in keys]).alias("row")]))
    if classes:
        counted = coded.groupBy("cell", "label").count()
        stats = counted.mapInArrow(_class_counts(trees), STATS_DDL)
    else:
        coded = coded.persist(StorageLevel.MEMORY_AND_DISK)
        stats = _rows_by_cell(coded).mapInArrow(_label_sums(trees, seed), STATS_DDL)
    nodes = stats.repartition(trees, "tree").groupBy("tree").applyInArrow(_grow(grid, classes, depth, seed), NODES_DDL)
    split = F.struct("featureIndex", "leftCategoriesOrThreshold", "numCategories").alias("split")
    data = F.struct("id", "prediction", "impurity", "impurityStats", "rawCount", "gain", "leftChild", "rightChild", split)
    # Spark's own fit to a few rows without any split gives the other parts of a stored model.
    few = spark.createDataFrame([(Vectors.dense([0.0] * len(encoded)), float(i % max(classes, 2))) for i in range(
        64 * max(classes, 1))], ["features", "label"])
    path = scratch_table(spark, "forest")
    estimator.fit(few.coalesce(1)).write().overwrite().save(path)
    nodes.select("treeID", data.alias("nodeData")).write.mode("overwrite").parquet(f"{path}/data")
    coded.unpersist()
    return (RandomForestClassificationModel if classes else RandomForestRegressionModel).load(path)


def predictions(model, rows: DataFrame, encoded: Sequence[str], grid: Grid) -> DataFrame:
    """``model.transform`` of rows: the trees see bins only, so each cell of
    the grid is predicted once and every row takes its cell's prediction."""
    spark, step = rows.sparkSession, 1
    columns = []
    for i, (values, n) in reversed([*enumerate(zip(grid.values(), grid.bins))]):
        texts = ", ".join(f"CAST('{v!r}' AS DOUBLE)" for v in values)
        columns.append(F.expr(f"element_at(array({texts}), CAST((_cell div {step}) % {n} AS INT) + 1)").alias(f"_f{i}"))
        step *= n
    names = [f"_f{i}" for i in range(len(encoded))]
    cells = spark.range(grid.cells).select(F.col("id").cast("int").alias("_cell")).select("_cell", *columns)
    cells = model.transform(VectorAssembler(inputCols=names, outputCol="features").transform(cells))
    told = cells.select("_cell", *[c for c in ("prediction", "probability") if c in cells.columns])
    return rows.withColumn("_cell", grid.code(encoded)).join(F.broadcast(told), "_cell").drop("_cell")
