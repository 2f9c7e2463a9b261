"""Order-dependent computations without a single-task window.

``Window.partitionBy(g).orderBy(o)`` sends a whole group to one task; with a hot
group (a third of all rows) that task is the job.  ``ordered_prefix`` splits
every group across range partitions instead:

1. ``repartitionByRange(P, g, o)``: each partition holds a contiguous slice of
   the global (g, o) order; a hot group spans many partitions.  The partition
   id is materialised with a reliable checkpoint so both uses below see the
   same assignment (also after an executor loss).
2. Local running values inside each (partition, group) segment: a window whose
   partitions are at most one range partition big.
3. Segment totals (one row per partition and group) -> running offsets over
   the small segment table -> joined back.

Positions, running sums and running products come out exactly as a global
ordered window would give them.

``exact_quantiles`` gives linear-interpolated quantiles (pandas/NumPy
"linear", DuckDB ``quantile_cont``) exactly, from approximate brackets and
exact counts; ``exact_quantiles_counted`` reads them from a table of distinct
values; ``exact_quantiles_sorted`` is the fully sorted variant built on
``ordered_prefix``.  None holds a whole column in one buffer.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .aggregates import broadcast_if_small


def _shuffle_partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))


def ordered_prefix(df: DataFrame, order_cols: Sequence[str | Column], group_cols: Sequence[str] = (),
                   sums: Sequence[tuple[str, str | Column]] = (),
                   products: Sequence[tuple[str, str | Column]] = (),
                   index_name: str | None = "_idx", num_partitions: int | None = None,
                   materialise: bool = True) -> DataFrame:
    """Add a 0-based position within each group (in ``order_cols`` order) and
    inclusive running sums / products.  ``order_cols`` must make the order
    total inside a group (end it with a key)."""
    group_cols = list(group_cols)
    parts = num_partitions or _shuffle_partitions(df)
    order = [F.col(c) if isinstance(c, str) else c for c in order_cols]
    sum_exprs = {f"_sv{i}": (F.col(c) if isinstance(c, str) else c) for i, (_, c) in enumerate(sums)}
    prod_exprs = {f"_pv{i}": (F.col(c) if isinstance(c, str) else c) for i, (_, c) in enumerate(products)}

    base = df.withColumns({**sum_exprs, **prod_exprs}) if (sum_exprs or prod_exprs) else df
    ranged = base.repartitionByRange(parts, *[F.col(g) for g in group_cols], *order) \
        .withColumn("_pid", F.spark_partition_id())
    if materialise:
        ranged = cut_lineage(ranged)

    local_w = Window.partitionBy("_pid", *group_cols).orderBy(*order)
    running = local_w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local_cols = {"_lidx": F.row_number().over(local_w) - F.lit(1)}
    for k in sum_exprs:
        local_cols[f"_l{k}"] = F.sum(k).over(running)
    for k in prod_exprs:
        local_cols[f"_l{k}"] = F.product(k).over(running)
    local = ranged.withColumns(local_cols)

    seg_aggs = [F.count(F.lit(1)).alias("_sn")]
    seg_aggs += [F.sum(k).alias(f"_t{k}") for k in sum_exprs]
    seg_aggs += [F.product(k).alias(f"_t{k}") for k in prod_exprs]
    seg = ranged.groupBy("_pid", *group_cols).agg(*seg_aggs)
    before = Window.partitionBy(*group_cols).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offs = {"_on": F.coalesce(F.sum("_sn").over(before), F.lit(0))}
    for k in sum_exprs:
        offs[f"_o{k}"] = F.coalesce(F.sum(f"_t{k}").over(before), F.lit(0))
    for k in prod_exprs:
        offs[f"_o{k}"] = F.coalesce(F.product(f"_t{k}").over(before), F.lit(1.0))
    seg = seg.select("_pid", *[F.col(g).alias(f"_g{i}") for i, g in enumerate(group_cols)],
                     *[v.alias(k) for k, v in offs.items()])

    cond = local["_pid"] == seg["_pid"]
    for i, g in enumerate(group_cols):
        cond = cond & local[g].eqNullSafe(seg[f"_g{i}"])
    joined = local.join(seg, cond, "inner").drop(seg["_pid"])

    out_cols = {}
    if index_name:
        out_cols[index_name] = F.col("_on") + F.col("_lidx")
    for i, (name, _) in enumerate(sums):
        out_cols[name] = F.col(f"_o_sv{i}") + F.col(f"_l_sv{i}")
    for i, (name, _) in enumerate(products):
        out_cols[name] = F.col(f"_o_pv{i}") * F.col(f"_l_pv{i}")
    result = joined.withColumns(out_cols)
    helper = ["_pid", "_lidx", "_on", *[f"_g{i}" for i in range(len(group_cols))],
              *sum_exprs, *prod_exprs, *[f"_l{k}" for k in [*sum_exprs, *prod_exprs]],
              *[f"_o{k}" for k in [*sum_exprs, *prod_exprs]]]
    return result.drop(*helper)


APPROX_ACCURACY = 10_000      # percentile_approx accuracy used to bracket ranks
BAND_MARGIN = 3               # bracket half-width, in units of n / accuracy
MAX_BAND_ROWS = 2_000_000     # distinct (group, p, value) rows brought back per call


def exact_quantiles(long_df: DataFrame, group_cols: Sequence[str], value_col: str,
                    probs: Sequence[float], max_groups: int = 100_000,
                    max_band_rows: int | None = None) -> DataFrame:
    """Linear-interpolated quantiles per group, exact.

    ``percentile_approx`` (rank error <= n / accuracy) brackets each target
    rank with a value band.  One counting scan gives, per (group, p), the exact
    number of values below the band and the distinct values inside it.  When
    the bands are small they are read and the two order statistics around
    p * (n - 1) are picked; when they are not (huge n), approximate quantiles
    on a fine grid *inside* each band narrow it and the count repeats -- every
    round shrinks a band by about three orders of magnitude, so even 10^12
    rows need only a few scans.  Nothing but bands (bounded) leaves the
    executors.  Should a band ever miss its ranks the fully sorted path
    (``exact_quantiles_sorted``) answers instead.
    """
    from .aggregates import bounded_rows
    spark = long_df.sparkSession
    limit = max_band_rows or MAX_BAND_ROWS
    group_cols = list(group_cols)
    probs = [float(p) for p in probs]
    v = F.col(value_col).cast("double")
    clean = long_df.where(F.col(value_col).isNotNull()).select(*group_cols, v.alias("_v"))
    eps = BAND_MARGIN / APPROX_ACCURACY
    band_p = sorted({min(1.0, max(0.0, p + d)) for p in probs for d in (-eps, eps)})
    approx = clean.groupBy(*group_cols).agg(
        F.count(F.lit(1)).alias("_n"), F.percentile_approx("_v", band_p, APPROX_ACCURACY).alias("_b"),
        F.min("_v").alias("_min"), F.max("_v").alias("_max"))
    heads = bounded_rows(approx, max_groups)
    out_schema = (long_df.select(*group_cols).schema.add("p", "double").add("q", "double") if group_cols
                  else "p double, q double")
    if not heads:
        return spark.createDataFrame([], out_schema)
    # target: group key + p -> [lo, hi, k_lo, k_hi, frac]
    targets: dict[tuple, list] = {}
    for r in heads:
        n = r["_n"]
        bmap = dict(zip(band_p, r["_b"]))
        for p in probs:
            h = p * (n - 1)
            k_lo = int(h // 1)
            k_hi = min(k_lo + 1, n - 1)
            lo = r["_min"] if p - eps <= 0 else bmap[min(1.0, max(0.0, p - eps))]
            hi = r["_max"] if p + eps >= 1 else bmap[min(1.0, max(0.0, p + eps))]
            targets[tuple(r[g] for g in group_cols) + (p,)] = [float(lo), float(hi), k_lo, k_hi, h - k_lo]
    for _ in range(MAX_NARROWING_ROUNDS):
        joined = _attach_targets(clean, group_cols, targets)
        in_band = (F.col("_v") >= F.col("_lo")) & (F.col("_v") <= F.col("_hi"))
        # One scan: values in the band by value, those below it as one null.
        counted = joined.where(F.col("_v") <= F.col("_hi")) \
            .groupBy(*group_cols, "p", F.when(in_band, F.col("_v")).alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
        cut = limit + len(targets)
        rows = counted.limit(cut + 1).collect()
        band_rows = [r for r in rows if r["_v"] is not None]
        if len(rows) <= cut and len(band_rows) <= limit:
            below = {tuple(r[g] for g in group_cols) + (r["p"],): r["_c"] for r in rows if r["_v"] is None}
            picked = _pick(targets, below, band_rows, group_cols)
            if picked is None:
                return exact_quantiles_sorted(long_df, group_cols, value_col, probs, max_groups)
            return spark.createDataFrame(picked, out_schema)
        # Too many distinct values in the bands: narrow each band with
        # approximate quantiles computed on its own rows.
        below = {tuple(r[g] for g in group_cols) + (r["p"],): r["_below"] for r in bounded_rows(
            joined.groupBy(*group_cols, "p").agg(F.count_if(F.col("_v") < F.col("_lo")).alias("_below")),
            len(targets))}
        grid = [i / NARROW_GRID for i in range(NARROW_GRID + 1)]
        stats = bounded_rows(joined.where(in_band).groupBy(*group_cols, "p").agg(
            F.count(F.lit(1)).alias("_m"), F.percentile_approx("_v", grid, APPROX_ACCURACY).alias("_g")),
            len(targets))
        for r in stats:
            key = tuple(r[g] for g in group_cols) + (r["p"],)
            lo, hi, k_lo, k_hi, frac = targets[key]
            m, g = r["_m"], r["_g"]
            start = below.get(key, 0)
            if m <= 1:
                continue
            slack = eps + 1.0 / NARROW_GRID
            f_lo = max(0.0, (k_lo - start) / (m - 1) - slack)
            f_hi = min(1.0, (k_hi - start) / (m - 1) + slack)
            i_lo = int(f_lo * NARROW_GRID)
            i_hi = min(NARROW_GRID, int(-(-f_hi * NARROW_GRID // 1)))
            targets[key] = [float(g[i_lo]) if i_lo > 0 else lo, float(g[i_hi]) if i_hi < NARROW_GRID else hi,
                            k_lo, k_hi, frac]
    return exact_quantiles_sorted(long_df, group_cols, value_col, probs, max_groups)


MAX_NARROWING_ROUNDS = 6
NARROW_GRID = 1000


def _attach_targets(clean: DataFrame, group_cols: list, targets: dict, carried: Sequence[str] = ()) -> DataFrame:
    """Every value row (with the columns ``carried``) next to the (few) targets
    of its group: a broadcast equi-join on the group, or literals when there is
    no group."""
    rows = [(*key, lo, hi) for key, (lo, hi, *_rest) in targets.items()]
    if not group_cols:
        arr = F.array(*[F.struct(F.lit(p).alias("p"), F.lit(lo).alias("_lo"), F.lit(hi).alias("_hi"))
                        for p, lo, hi in rows])
        return clean.select("_v", *carried, F.explode(arr).alias("_t")) \
            .select("_v", *carried, "_t.p", "_t._lo", "_t._hi")
    schema = clean.select(*group_cols).schema.add("p", "double").add("_lo", "double").add("_hi", "double")
    tdf = clean.sparkSession.createDataFrame(rows, schema)
    return clean.join(F.broadcast(tdf), group_cols)


def _pick(targets: dict, below: dict, band_rows: list, group_cols: list) -> list | None:
    """Order statistics from the bands; None when a band misses its rank."""
    bands: dict = {}
    for r in band_rows:
        bands.setdefault(tuple(r[g] for g in group_cols) + (r["p"],), []).append((r["_v"], r["_c"]))
    out = []
    for key, (_, _, k_lo, k_hi, frac) in targets.items():
        pos = below.get(key, 0)
        pick = {}
        for val, c in sorted(bands.get(key, [])):
            for k in (k_lo, k_hi):
                if pos <= k < pos + c:
                    pick[k] = val
            pos += c
        if k_lo not in pick or k_hi not in pick:
            return None
        out.append((*key, pick[k_lo] + (pick[k_hi] - pick[k_lo]) * frac))
    return out


QUANTILE_BINS = 1024


def exact_quantiles_counted(counts: DataFrame, group_cols: Sequence[str], value_col: str, count_col: str,
                            probs: Sequence[float], max_groups: int = 100_000) -> DataFrame:
    """``exact_quantiles`` of values that come with how often they occur; the
    table should be stored, as every round reads it.

    A round counts the values of each target's range in QUANTILE_BINS bins of
    equal width, with the smallest and largest value of each.  The two order
    statistics are known as soon as they fall into different bins or a bin with
    one value; else the range shrinks to the values of their bin.  Only bins
    (bounded) leave the executors.  Infinite values, and ranges that do not
    shrink fast enough, are answered by the fully sorted path."""
    from .aggregates import bounded_rows
    group_cols = list(group_cols)
    clean = counts.where(F.col(value_col).isNotNull()).select(
        *group_cols, F.col(value_col).cast("double").alias("_v"), F.col(count_col).alias("_c"))
    heads = bounded_rows(clean.groupBy(*group_cols).agg(
        F.sum("_c").alias("_n"), F.min("_v").alias("_min"), F.max("_v").alias("_max")), max_groups)
    out_schema = counts.select(*group_cols).schema.add("p", "double").add("q", "double")
    targets: dict[tuple, list] = {}  # group key + p -> [lo, hi, count below lo, k_lo, k_hi, frac]
    for r in heads:
        if r["_n"]:
            for p in map(float, probs):
                h = p * (r["_n"] - 1)
                k_lo = int(h // 1)
                targets[tuple(r[g] for g in group_cols) + (p,)] = [
                    r["_min"], r["_max"], 0, k_lo, min(k_lo + 1, r["_n"] - 1), h - k_lo]
    found = []
    for _ in range(MAX_NARROWING_ROUNDS):
        if not targets or not all(math.isfinite(hi - lo) for lo, hi, *_rest in targets.values()):
            break
        width = F.col("_hi") - F.col("_lo")
        place = F.when(width > 0, F.least(F.floor((F.col("_v") - F.col("_lo")) / width * QUANTILE_BINS),
                                          F.lit(QUANTILE_BINS - 1))).otherwise(0).alias("_bin")
        bins = bounded_rows(_attach_targets(clean, group_cols, targets, ["_c"])
                            .where((F.col("_v") >= F.col("_lo")) & (F.col("_v") <= F.col("_hi")))
                            .groupBy(*group_cols, "p", place)
                            .agg(F.sum("_c").alias("_c"), F.min("_v").alias("_min"), F.max("_v").alias("_max")),
                            len(targets) * QUANTILE_BINS)
        held: dict[tuple, list] = {}
        for r in sorted(bins, key=lambda r: r["_bin"]):
            held.setdefault(tuple(r[g] for g in group_cols) + (r["p"],), []).append((r["_c"], r["_min"], r["_max"]))
        for key, (_, _, below, k_lo, k_hi, frac) in list(targets.items()):
            lower = upper = None
            for c, low, high in held[key]:
                if below <= k_lo < below + c:
                    lower = (below, low, high)
                if below <= k_hi < below + c:
                    upper = (below, low, high)
                below += c
            if lower == upper and lower[1] != lower[2]:
                targets[key][:3] = lower[1], lower[2], lower[0]
                continue
            x, y = lower[2], upper[1]  # neighbours in order: the last of one bin, the first of the next
            found.append((*key, x + (y - x) * frac))
            del targets[key]
    if targets:
        return _quantiles_by_sort(clean.groupBy(*group_cols, "_v").agg(F.sum("_c").alias("_c")), group_cols, "_v",
                                  probs, max_groups)
    return counts.sparkSession.createDataFrame(found, out_schema)


def exact_quantiles_sorted(long_df: DataFrame, group_cols: Sequence[str], value_col: str,
                           probs: Sequence[float], max_groups: int = 100_000) -> DataFrame:
    """Linear-interpolated quantiles per group, exact and distributed.

    ``long_df`` is long form (group..., value).  Output: group..., ``p``, ``q``.
    Works on the distinct-value table (``groupBy(group, value).count()``, which
    partial aggregation shrinks before the shuffle), then locates the two order
    statistics around ``p * (n - 1)`` with a running count.
    """
    group_cols = list(group_cols)
    counts = long_df.where(F.col(value_col).isNotNull()) \
        .groupBy(*group_cols, value_col).agg(F.count(F.lit(1)).alias("_c"))
    return _quantiles_by_sort(counts, group_cols, value_col, probs, max_groups)


def _quantiles_by_sort(counts: DataFrame, group_cols: list, value_col: str, probs: Sequence[float],
                       max_groups: int) -> DataFrame:
    """Quantiles of (group..., value, _c), one row per value."""
    ranked = ordered_prefix(counts, [value_col], group_cols, sums=[("_cum", "_c")], index_name=None)
    totals = counts.groupBy(*group_cols).agg(F.sum("_c").alias("_n"))
    first = F.col("_cum") - F.col("_c")
    if not group_cols:
        # One group: n is a single number, so the target positions are literals
        # and the lookup is a filter, not a join.
        n = totals.first()
        n = int(n["_n"]) if n and n["_n"] is not None else 0
        if n == 0:
            return counts.sparkSession.createDataFrame([], "p double, q double")
        picks = []
        for p in probs:
            h = float(p) * (n - 1)
            lo = int(h // 1)
            hi = min(lo + 1, n - 1)
            picks.append((float(p), h - lo, lo, hi))
        hit_any = F.lit(False)
        for _, _, lo, hi in picks:
            for k in (lo, hi):
                hit_any = hit_any | ((F.lit(k) >= first) & (F.lit(k) < F.col("_cum")))
        near = ranked.where(hit_any)
        aggs = []
        for i, (p, frac, lo, hi) in enumerate(picks):
            vlo = F.max(F.when((F.lit(lo) >= first) & (F.lit(lo) < F.col("_cum")), F.col(value_col)))
            vhi = F.max(F.when((F.lit(hi) >= first) & (F.lit(hi) < F.col("_cum")), F.col(value_col)))
            aggs.append(F.struct(F.lit(p).alias("p"), (vlo + (vhi - vlo) * F.lit(frac)).alias("q")).alias(f"_q{i}"))
        return near.agg(F.array(*aggs).alias("_qs")).select(F.explode("_qs").alias("_x")).select("_x.p", "_x.q")
    prob_arr = F.array(*[F.lit(float(p)) for p in probs])
    targets = totals.select(*group_cols, "_n", F.explode(prob_arr).alias("p")) \
        .withColumn("_h", F.col("p") * (F.col("_n") - 1)) \
        .withColumn("_lo", F.floor("_h")) \
        .withColumn("_hi", F.least(F.col("_lo") + 1, F.col("_n") - 1))
    targets = broadcast_if_small(targets, max_groups * max(len(probs), 1))
    t = targets.alias("t")
    r = ranked.alias("r")
    cond = F.lit(True)
    for g in group_cols:
        cond = cond & F.col(f"r.{g}").eqNullSafe(F.col(f"t.{g}"))
    first = F.col("r._cum") - F.col("r._c")
    hit_lo = (F.col("t._lo") >= first) & (F.col("t._lo") < F.col("r._cum"))
    hit_hi = (F.col("t._hi") >= first) & (F.col("t._hi") < F.col("r._cum"))
    pairs = r.join(t, cond & (hit_lo | hit_hi), "inner")
    out = pairs.groupBy(*[F.col(f"t.{g}").alias(g) for g in group_cols], F.col("t.p").alias("p")).agg(
        F.max(F.when(hit_lo, F.col(f"r.{value_col}"))).alias("_vlo"),
        F.max(F.when(hit_hi, F.col(f"r.{value_col}"))).alias("_vhi"),
        F.first(F.col("t._h") - F.col("t._lo")).alias("_frac"))
    q = F.col("_vlo") + (F.col("_vhi") - F.col("_vlo")) * F.col("_frac")
    return out.select(*group_cols, "p", q.alias("q"))
