"""Local explanations (ML-15) for any number of rows in one job.

Contribution of feature i for a row = f(x) - f(x with x_i := mean_i), with
the model fitted on all rows.  The d+1 variants of a row (the original and
one per feature) are scored by d+1 chained model projections on the same
row, so the whole job is map-only: no explode before scoring, no shuffle,
no join back.  The rows are those the model was fitted on or a table of inputs.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import qcol
from . import prep as P
from . import supervised as S


def explain(df: DataFrame, feature_cols: Sequence[str], target_col: str, key_cols: Sequence[str],
            model_type: str = "random_forest", task: str = "auto",
            trees: int = S.FOREST_TREES, depth: int = S.FOREST_DEPTH,
            inputs: DataFrame | None = None, input_keys: Sequence[str] = ()) -> tuple[DataFrame, DataFrame, float]:
    """Returns (contributions, global importances, baseline prediction).

    contributions: key..., feature, value, shown_value (the category's name, or
    the number as text), prediction, prediction_label and confidence (of
    classifiers), contribution, direction, magnitude for every feature of
    every complete row of ``df``, or of every row of ``inputs`` if given (then
    keyed by ``input_keys``, ``key_cols`` without any).  In inputs a missing
    number stands for its mean, so it contributes 0; a missing or unseen
    category counts as the first one, as when predicting."""
    fr = S.fit(df, feature_cols, target_col, key_cols, task=task, model_type=model_type, holdout=False,
               trees=trees, depth=depth)
    data = fr.prep.data
    enc = fr.prep.encoded_cols
    means = data.agg(*[F.avg(qcol(c)).alias(c) for c in enc]).first().asDict()
    rows = data
    if inputs is not None:
        rows = S.encode_inputs(fr, inputs, means)
        key_cols = list(input_keys) or list(key_cols)
    contributions = _contributions(fr, rows, key_cols, means)
    base_vec = data.sparkSession.createDataFrame([tuple(float(means[c]) for c in enc)], enc)
    baseline = fr.model.transform(VectorAssembler(inputCols=enc, outputCol="features").transform(base_vec)) \
        .first()["prediction"]
    return contributions, S.importances(fr), float(baseline)


def _contributions(fr: S.FitResult, rows: DataFrame, key_cols: Sequence[str], means: Mapping[str, float]) -> DataFrame:
    enc = fr.prep.encoded_cols
    keys = [f"_k{i}" for i in range(len(key_cols))]
    cur = rows.select(*[qcol(k).alias(n) for k, n in zip(key_cols, keys)],
                      *[qcol(c).cast("double").alias(f"_x{i}") for i, c in enumerate(enc)],
                      *[F.lit(float(means[c])).alias(f"_m{i}") for i, c in enumerate(enc)])
    confidence = F.lit(None).cast("double")
    # Variant -1 is the row itself; variant i has feature i set to its mean.
    # Each variant is one more projection: assemble, score, keep the
    # prediction -- all map-side, no explode, no join back.
    for v in range(-1, len(enc)):
        names = [f"_m{i}" if i == v else f"_x{i}" for i in range(len(enc))]
        cur = VectorAssembler(inputCols=names, outputCol="features", handleInvalid="keep").transform(cur)
        cur = fr.model.transform(cur)
        if v < 0 and "probability" in cur.columns:
            cur = cur.withColumn("_confidence", F.array_max(vector_to_array("probability")) * 100)
            confidence = F.col("_confidence")
        cur = cur.withColumnRenamed("prediction", f"_p{v + 1}") \
            .drop(*[c for c in ("features", "rawPrediction", "probability") if c in cur.columns])
    labels = {st.getOutputCol(): st.labels for st in fr.prep.prep_model.stages if hasattr(st, "labels")}

    def named(index, known):
        return F.try_element_at(F.array(*[F.lit(c) for c in known]), index.cast("int") + 1) if known \
            else F.lit(None).cast("string")
    cells = []
    for i, (name, c) in enumerate(zip(fr.prep.feature_cols, enc)):
        x = F.col(f"_x{i}")
        cells.append(F.struct(F.lit(name).alias("feature"), x.alias("value"),
                              (named(x, labels[c]) if c in labels else x.cast("string")).alias("shown_value"),
                              (F.col("_p0") - F.col(f"_p{i + 1}")).alias("contribution")))
    classes = P.label_names(fr.prep) if fr.task == "classification" else []
    exploded = cur.select(*keys, F.col("_p0").alias("prediction"), named(F.col("_p0"), classes).alias("prediction_label"),
                          confidence.alias("confidence"), F.explode(F.array(*cells)).alias("_c"))
    contrib = F.col("_c.contribution")
    return exploded.select(*[F.col(n).alias(k) for n, k in zip(keys, key_cols)], "_c.feature", "_c.value",
                           "_c.shown_value", "prediction", "prediction_label", "confidence",
                           contrib.alias("contribution"),
                           F.when(contrib > 0, "increases").otherwise("decreases").alias("direction"),
                           F.abs(contrib).alias("magnitude"))
