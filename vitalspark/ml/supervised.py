"""Supervised models, metrics and importances (ML-3..8, ML-16, ML-17).

Fits run on executors (``pyspark.ml``); metrics are plain aggregates over the
keyed prediction table; nothing but model parameters reaches the driver.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.ml.classification import (GBTClassifier, LogisticRegression, OneVsRest,
                                       RandomForestClassifier)
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import is_numeric, qcol, to_double
from ..operators.profile import MULTI_REGRESSION_DISTINCT, detect_tasks
from . import binned_forest as BF
from . import prep as P

# Fixed values of the reference's models (trees / stages per fit).
FOREST_TREES = 100
BOOSTING_STAGES = 100
BOOSTING_DEPTH = 3
BOOSTING_STEP = 0.1
LOGISTIC_ITERATIONS = 500
MULTI_TARGET_TREES = 50
MULTI_TARGET_MIN_ROWS = 20
MULTI_TARGET_TOP_FEATURES = 6
# Fully grown trees are not available in Spark (depth <= 30); this depth is
# the tractable default, a parameter of every fit.
FOREST_DEPTH = 12


def _memory_mb(text: str | None) -> int:
    units = {"k": 1 / 1024, "m": 1, "g": 1024, "t": 1024 * 1024}
    t = (text or "1g").strip().lower().rstrip("b")
    return int(float(t[:-1]) * units[t[-1]]) if t and t[-1] in units else int(float(t) / (1024 * 1024))


def tree_memory_mb(spark) -> int:
    """Histogram budget per tree-training task (Spark's default is 256 MB).
    Every task of an executor holds one, so the budget is a quarter of the
    executor heap divided by its task slots, within [16, 256] MB -- a small
    local heap with many cores then trains in more passes instead of
    running out of memory."""
    conf = spark.sparkContext.getConf()
    local = spark.sparkContext.master.startswith("local")
    heap = _memory_mb(conf.get("spark.driver.memory" if local else "spark.executor.memory", "1g"))
    slots = spark.sparkContext.defaultParallelism if local else int(conf.get("spark.executor.cores", "1"))
    return int(min(256, max(16, heap * 0.25 / max(slots, 1))))


def make_model(task: str, model_type: str = "random_forest", n_rows: int | None = None,
               n_classes: int = 2, seed: int = P.SEED, trees: int = FOREST_TREES, depth: int = FOREST_DEPTH,
               memory_mb: int = 256):
    """ML-3 / ML-4 estimators, configured like the reference's defaults.
    Forests keep each row's node of every tree between levels: a level then
    goes one step down instead of walking every tree from its root (the
    trees are the same)."""
    if task == "regression":
        if model_type == "linear":
            return LinearRegression(regParam=0.0, elasticNetParam=0.0)
        if model_type == "gradient_boost":
            return GBTRegressor(maxIter=BOOSTING_STAGES, maxDepth=BOOSTING_DEPTH, stepSize=BOOSTING_STEP, seed=seed,
                                maxMemoryInMB=memory_mb)
        return RandomForestRegressor(numTrees=trees, featureSubsetStrategy="all", maxDepth=depth, seed=seed,
                                     maxMemoryInMB=memory_mb, cacheNodeIds=True, checkpointInterval=-1)
    if model_type == "linear":
        reg = 1.0 / max(n_rows or 1, 1)   # C = 1 in a sum-of-losses objective
        return LogisticRegression(maxIter=LOGISTIC_ITERATIONS, regParam=reg, standardization=False)
    if model_type == "gradient_boost":
        gbt = GBTClassifier(maxIter=BOOSTING_STAGES, maxDepth=BOOSTING_DEPTH, stepSize=BOOSTING_STEP, seed=seed,
                            maxMemoryInMB=memory_mb)
        return gbt if n_classes <= 2 else OneVsRest(classifier=gbt)
    return RandomForestClassifier(numTrees=trees, featureSubsetStrategy="sqrt", maxDepth=depth, seed=seed,
                                  maxMemoryInMB=memory_mb, cacheNodeIds=True, checkpointInterval=-1)


def detect_task(df: DataFrame, target_col: str) -> str:
    """PRF-4 for one column."""
    return detect_tasks(df.select(qcol(target_col))).first()["task_auto"]


@dataclass
class FitResult:
    task: str
    model_type: str
    prep: P.Prepared
    model: object
    predictions: DataFrame   # key..., label, prediction (test rows)
    n_rows: int


def _fills_nodes(rows: int, trees: int, depth: int) -> bool:
    """More rows than the deepest level of all trees can have nodes: rows of
    equal features, put together, then share their nodes' statistics in the
    processor's cache, which costs less than the sort."""
    return rows > trees << (depth - 1)


def _grid(prep: P.Prepared, values: Mapping[str, Sequence[float]], task: str, n_classes: int, rows: int) -> BF.Grid | None:
    """The bins of a forest's features, if there are few enough combinations
    for ``binned_forest`` (see there) to fit it from sums; otherwise None."""
    labels = {st.getOutputCol(): len(st.labels) for st in prep.prep_model.stages if hasattr(st, "labels")}
    thresholds = [None if c in prep.text_features else tuple(BF.borders(values[c])) for c in prep.feature_cols]
    bins = [labels[e] + 1 if t is None else len(t) + 1 for e, t in zip(prep.encoded_cols, thresholds)]
    grid, sums = BF.Grid(tuple(thresholds), tuple(bins)), n_classes if task == "classification" else 3
    ordered = task == "regression" or n_classes == 2 or not prep.text_features  # one order of the categories
    small = max(bins) <= BF.MAX_BINS and grid.cells * sums <= BF.CELLS and grid.cells * BF.ROWS_PER_CELL <= rows
    return grid if ordered and small and (task == "regression" or n_classes > 1) else None


def fit(df: DataFrame, feature_cols: Sequence[str], target_col: str, key_cols: Sequence[str],
        task: str = "auto", model_type: str = "random_forest", holdout: bool = True,
        trees: int = FOREST_TREES, depth: int = FOREST_DEPTH) -> FitResult:
    """Preprocess, split 80/20 on the key hash, fit, predict the test rows."""
    if task == "auto":
        task = detect_task(df, target_col)
    prep = P.prepare(df, feature_cols, target_col, key_cols, index_label=(task == "classification"))
    data = prep.data
    n_classes = len(P.label_names(prep)) or 2
    train, test = P.split(data, key_cols) if holdout else (data, data)
    # Both counts, and what a forest needs for its bins, in one scan, before the training rows are kept.
    trained = P.split_flag(key_cols) if holdout else F.lit(True)
    forest = model_type == "random_forest"
    numbers = [c for c in feature_cols if forest and c not in prep.text_features]
    seen = data.select(trained.alias("_t"), *[qcol(c).cast("double").alias(f"_c{i}") for i, c in enumerate(numbers)])
    sizes = seen.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("_t")).alias("train"), *[
        BF.quantiles(f"CASE WHEN _t THEN _c{i} END").alias(f"_q{i}") for i in range(len(numbers))]).first()
    n_train = sizes["train"]
    near = [qcol(c) for c in prep.encoded_cols] if forest and _fills_nodes(n_train, trees, depth) else []
    estimator = make_model(task, model_type, n_train, n_classes, trees=trees, depth=depth,
                           memory_mb=tree_memory_mb(df.sparkSession))
    grid = _grid(prep, {c: sizes[f"_q{i}"] for i, c in enumerate(numbers)}, task, n_classes, n_train) if near else None
    if grid:
        model = BF.fit(train, estimator, prep.encoded_cols, key_cols, grid, n_classes if task == "classification" else 0, P.SEED)
    else:
        train = P.iteration_input(train, near)
        model = estimator.fit(train)
        train.unpersist()
    preds = BF.predictions(model, test, prep.encoded_cols, grid) if grid else model.transform(test)
    keep = [*key_cols, "label", "prediction"] + (["probability"] if "probability" in preds.columns else [])
    return FitResult(task, model_type, prep, model, preds.select(*keep), sizes["n"])


def regression_metrics(preds: DataFrame) -> DataFrame:
    """ML-5: mse, rmse, r2, r2 % on the test predictions."""
    err = F.col("prediction") - F.col("label")
    out = preds.agg(F.avg(err * err).alias("mse"), F.sum(err * err).alias("_sse"),
                    (F.variance("label") * (F.count(F.lit(1)) - 1)).alias("_sst"), F.count(F.lit(1)).alias("n_test"))
    r2 = 1 - F.col("_sse") / F.col("_sst")
    return out.select("n_test", "mse", F.sqrt("mse").alias("rmse"), r2.alias("r2"), (r2 * 100).alias("r2_percent"))


def classification_report(preds: DataFrame, classes: Sequence[str] = ()) -> DataFrame:
    """ML-6: per class precision / recall / f1 / support, then accuracy,
    macro and weighted averages; a zero denominator gives 0."""
    # The (label, prediction) counts are tiny and feed four report parts:
    # materialise them once instead of re-scoring the test rows per part.
    from ..session import cut_lineage
    pairs = cut_lineage(preds.groupBy("label", "prediction").agg(F.count(F.lit(1)).alias("n")))
    per_label = pairs.groupBy(F.col("label").alias("cls")).agg(
        F.sum("n").alias("support"), F.sum(F.when(F.col("label") == F.col("prediction"), F.col("n"))).alias("tp"))
    per_pred = pairs.groupBy(F.col("prediction").alias("cls")).agg(F.sum("n").alias("predicted"))
    t = per_label.join(per_pred, "cls", "full").fillna(0, ["support", "tp", "predicted"])
    prec = F.when(F.col("predicted") > 0, F.col("tp") / F.col("predicted")).otherwise(0.0)
    rec = F.when(F.col("support") > 0, F.col("tp") / F.col("support")).otherwise(0.0)
    f1 = F.when(prec + rec > 0, 2 * prec * rec / (prec + rec)).otherwise(0.0)
    names = F.element_at(F.array(*[F.lit(c) for c in classes]), F.col("cls").cast("int") + 1) if classes \
        else F.col("cls").cast("int").cast("string")
    cls = t.select(F.coalesce(names, F.col("cls").cast("string")).alias("class"), prec.alias("precision"),
                   rec.alias("recall"), f1.alias("f1"), F.col("support").cast("long").alias("support"),
                   F.col("tp").cast("long").alias("_tp"))
    tot = cls.agg(F.sum("support").alias("s"), F.sum("_tp").alias("tp"),
                  F.avg("precision").alias("mp"), F.avg("recall").alias("mr"), F.avg("f1").alias("mf"),
                  (F.sum(F.col("precision") * F.col("support")) / F.sum("support")).alias("wp"),
                  (F.sum(F.col("recall") * F.col("support")) / F.sum("support")).alias("wr"),
                  (F.sum(F.col("f1") * F.col("support")) / F.sum("support")).alias("wf"))
    acc = tot.select(F.lit("accuracy").alias("class"), (F.col("tp") / F.col("s")).alias("precision"),
                     (F.col("tp") / F.col("s")).alias("recall"), (F.col("tp") / F.col("s")).alias("f1"),
                     F.col("s").alias("support"))
    macro = tot.select(F.lit("macro avg"), "mp", "mr", "mf", "s")
    weighted = tot.select(F.lit("weighted avg"), "wp", "wr", "wf", "s")
    return cls.drop("_tp").unionAll(acc).unionAll(macro).unionAll(weighted)


def importances(fr: FitResult) -> DataFrame:
    """ML-7: impurity importances, or |coefficients| normalised (first class
    of a multinomial model); ``percent`` of the total."""
    m = fr.model
    names = fr.prep.feature_cols
    if hasattr(m, "featureImportances"):
        raw = [float(v) for v in m.featureImportances.toArray()]
    elif hasattr(m, "coefficientMatrix") and m.coefficientMatrix.numRows > 1:
        raw = [abs(float(v)) for v in m.coefficientMatrix.toArray()[0]]
    elif hasattr(m, "coefficients"):
        raw = [abs(float(v)) for v in m.coefficients.toArray()]
    elif hasattr(m, "models"):  # one model a class: the mean of their importances
        each = [x.featureImportances.toArray() for x in m.models]
        raw = [float(sum(v) / len(each)) for v in zip(*each)]
    else:
        raise ValueError(f"{type(m).__name__} has no importances")
    total = sum(raw) or 1.0
    spark = fr.predictions.sparkSession
    rows = [(n, v / total if not hasattr(m, "featureImportances") else v, v / total * 100)
            for n, v in zip(names, raw)]
    return spark.createDataFrame(rows, "feature string, importance double, percent double")


def encode_inputs(fr: FitResult, inputs: DataFrame, missing: Mapping[str, float]) -> DataFrame:
    """``inputs`` with the encoded features and their vector.  A numeric value
    that is missing, NaN or no number becomes ``missing[column]`` (0 without
    one); an unseen or missing category has index 0; so has a missing column."""
    data = inputs
    for c in fr.prep.feature_cols:
        if c not in data.columns:
            data = data.withColumn(c, F.lit(None).cast("string"))
    data = data.withColumns({c: qcol(c).cast("string") if c in fr.prep.text_features
                             else F.coalesce(to_double(c), F.lit(float(missing.get(c, 0.0))))
                             for c in fr.prep.feature_cols})
    for st in fr.prep.prep_model.stages:
        out = getattr(st, "getOutputCol", lambda: "")()
        if out == "label":
            continue
        data = st.transform(data)
        if hasattr(st, "labels"):
            data = data.withColumn(out, F.when(qcol(out) >= len(st.labels), F.lit(0.0)).otherwise(qcol(out)))
    return data


def predict_inputs(fr: FitResult, inputs: DataFrame, key_cols: Sequence[str]) -> DataFrame:
    """ML-16: score new rows with the fitted preprocessing and model.  A
    missing numeric value becomes 0, an unseen category index 0; classifiers
    add confidence % and the class label."""
    data = encode_inputs(fr, inputs, {})
    scored = fr.model.transform(data)
    cols = [*key_cols, "prediction"]
    if fr.task == "classification":
        classes = P.label_names(fr.prep)
        scored = scored.withColumn("prediction_label",
                                   F.element_at(F.array(*[F.lit(c) for c in classes]),
                                                F.col("prediction").cast("int") + 1))
        cols.append("prediction_label")
        if "probability" in scored.columns:
            scored = scored.withColumn("confidence", F.array_max(vector_to_array("probability")) * 100)
            cols.append("confidence")
    return scored.select(*cols)


def compare_targets(df: DataFrame, feature_cols: Sequence[str], target_cols: Sequence[str],
                    key_cols: Sequence[str], trees: int = MULTI_TARGET_TREES,
                    depth: int = FOREST_DEPTH) -> DataFrame:
    """ML-17: one forest per target (regression when numeric with > 10
    distinct values, else classification), r² or accuracy on the 20 % test
    rows, top 6 features, ranked by performance.  The loop is over a bounded
    list of targets; every fit is a distributed job."""
    spark = df.sparkSession
    rows = []
    for t in target_cols:
        if t not in df.columns:
            continue
        used = list(feature_cols) + [t]
        complete = df.dropna("any", subset=used)
        # Row count and the multi-target task rule, on the complete rows, in
        # one aggregate.
        head = complete.agg(F.count(F.lit(1)).alias("n"), F.count_distinct(qcol(t)).alias("d")).first()
        n = head["n"]
        if n < MULTI_TARGET_MIN_ROWS:
            rows.append((t, None, "error", n, None, None, None, "Too few rows after dropping nulls", []))
            continue
        numeric = is_numeric(df.schema[t].dataType, "C")
        task = "regression" if numeric and head["d"] > MULTI_REGRESSION_DISTINCT else "classification"
        fr = fit(df, feature_cols, t, key_cols, task=task, model_type="random_forest", trees=trees, depth=depth)
        rmse = None
        if task == "regression":
            m = regression_metrics(fr.predictions).first()
            perf, rmse, metric = m["r2"], m["rmse"], "r2"
        else:
            p = fr.predictions
            perf = p.agg(F.avg((F.col("label") == F.col("prediction")).cast("double"))).first()[0]
            metric = "accuracy"
        imp = sorted(zip(fr.prep.feature_cols, fr.model.featureImportances.toArray()), key=lambda x: -x[1])
        top = ", ".join(f for f, _ in imp[:MULTI_TARGET_TOP_FEATURES])
        rows.append((t, task, "success", n, metric, float(perf) if perf is not None else None, rmse, top,
                     [(f, float(v)) for f, v in imp[:MULTI_TARGET_TOP_FEATURES]]))
    out = spark.createDataFrame(rows, "target string, task string, status string, n_rows long, metric string, "
                                      "performance double, rmse double, top_features string, "
                                      "importances array<struct<feature: string, importance: double>>")
    from pyspark.sql import Window
    w = Window.partitionBy(F.col("status")).orderBy(F.col("performance").desc(), F.col("target"))
    return out.withColumn("rank", F.when(F.col("status") == "success", F.rank().over(w)))


def summarise(fr: FitResult) -> Mapping:
    """Numbers for the result log (SNK-2) and result grading (RES-1)."""
    if fr.task == "regression":
        m = regression_metrics(fr.predictions).first().asDict()
        return {"task": "regression", "r2": m["r2"], "rmse": m["rmse"], "mse": m["mse"], "total_rows": fr.n_rows}
    acc = fr.predictions.agg(F.avg((F.col("label") == F.col("prediction")).cast("double"))).first()[0]
    return {"task": "classification", "accuracy": acc, "total_rows": fr.n_rows}
