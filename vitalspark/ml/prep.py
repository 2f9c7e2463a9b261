"""ML-1 (preprocess) and ML-2 (80/20 split).

Listwise deletion over features + target, text features label-encoded in
sorted order (``StringIndexer(alphabetAsc)``, the order of a sorted label
encoder), all assembled into one vector.  The split is an MD5 of the row key,
so it is stable under any repartitioning (``randomSplit`` is not) and other
engines can repeat it.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import StringIndexer, StringIndexerModel, VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import is_text, nan_to_null, qcol
from ..plans.aggregates import bounded_rows

MAX_CLASSES = 10_000
SEED = 42
TRAIN_PERCENT = 80


@dataclass
class Prepared:
    data: DataFrame              # key..., encoded features, features (vector), label (if any)
    feature_cols: list[str]
    encoded_cols: list[str]      # numeric column actually assembled, per feature
    text_features: list[str]
    target_col: str | None
    label_is_indexed: bool
    prep_model: PipelineModel


def prepare(df: DataFrame, feature_cols: Sequence[str], target_col: str | None = None,
            key_cols: Sequence[str] = (), index_label: bool = False) -> Prepared:
    """ML-1.  ``index_label`` turns the target into class indices (always
    for classification: Spark classifiers need labels 0..k-1)."""
    feature_cols = list(feature_cols)
    used = feature_cols + ([target_col] if target_col else [])
    work = nan_to_null(df.select(*[qcol(c) for c in dict.fromkeys([*key_cols, *used])]), used).dropna("any", subset=used)
    types = {f.name: f.dataType for f in work.schema.fields}
    text = [c for c in feature_cols if is_text(types[c])]
    stages = [StringIndexer(inputCol=c, outputCol=f"{c}__idx", stringOrderType="alphabetAsc", handleInvalid="keep")
              for c in text]
    encoded = [f"{c}__idx" if c in text else c for c in feature_cols]
    label_indexed = False
    if target_col:
        if index_label or is_text(types[target_col]):
            label_indexed = True
            if is_text(types[target_col]):
                stages.append(StringIndexer(inputCol=target_col, outputCol="label", stringOrderType="alphabetAsc"))
            else:  # numeric classes in numeric order: 2 before 10
                classes = bounded_rows(work.select(qcol(target_col).alias("c")).distinct().orderBy("c"), MAX_CLASSES)
                work = work.withColumn("__target_str", qcol(target_col).cast("string"))
                names = work.sparkSession.createDataFrame([(r["c"],) for r in classes] or [(None,)], work.select(
                    qcol(target_col).alias("c")).schema).select(F.col("c").cast("string").alias("s")).collect()
                stages.append(StringIndexerModel.from_labels([r["s"] for r in names], "__target_str", "label"))
    cast = work.withColumns({c: qcol(c).cast("double") for c in feature_cols if c not in text})
    stages.append(VectorAssembler(inputCols=encoded, outputCol="features", handleInvalid="keep"))
    model = Pipeline(stages=stages).fit(cast)
    out = model.transform(cast)
    if target_col and not label_indexed:
        out = out.withColumn("label", qcol(target_col).cast("double"))
    return Prepared(out, feature_cols, encoded, text, target_col, label_indexed, model)


def label_names(prep: Prepared) -> list[str]:
    """Class names in index order (empty for regression)."""
    if not prep.label_is_indexed:
        return []
    for st in prep.prep_model.stages:
        if getattr(st, "getOutputCol", None) and st.getOutputCol() == "label":
            return list(st.labels)
    return []


def split_flag(key_cols: Sequence[str], seed: int = SEED, train_percent: int = TRAIN_PERCENT) -> Column:
    """ML-2: True for training rows: the first 32 bits of md5('key|...|seed'),
    modulo 100, below ``train_percent``; null keys are left out of the name."""
    name = F.concat_ws("|", *[qcol(c).cast("string") for c in key_cols], F.lit(str(seed)))
    return F.conv(F.substring(F.md5(name), 1, 8), 16, 10).cast("bigint") % 100 < train_percent


def split(df: DataFrame, key_cols: Sequence[str], seed: int = SEED,
          train_percent: int = TRAIN_PERCENT) -> tuple[DataFrame, DataFrame]:
    flag = split_flag(key_cols, seed, train_percent)
    return df.where(flag), df.where(~flag)


def iteration_input(df: DataFrame, near: Sequence[Column] = ()) -> DataFrame:
    """Training input for iterative fits (forests, boosting, K-means): spread
    over the cluster's cores when it arrives in fewer partitions (a single
    Parquet row group is one task), and persisted so every iteration reads
    it once from memory/disk instead of from the source.  ``near``: columns
    by which every partition is sorted.  Callers unpersist after fitting."""
    from pyspark import StorageLevel
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() < cores:
        df = df.repartition(cores)
    if near:
        df = df.sortWithinPartitions(*near)
    return df.persist(StorageLevel.MEMORY_AND_DISK)
