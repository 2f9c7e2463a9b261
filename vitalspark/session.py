"""Spark session construction and lineage helpers.

Library code never hard-codes a cluster: it reads what the session already
carries.  ``build_session`` is for tests, the bench and local exploration.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(master: str | None = None, app: str = "vitalspark",
                  shuffle_partitions: int | None = None,
                  extra: dict | None = None) -> SparkSession:
    """A session with AQE on, the UI off and UTC time."""
    cpus = os.environ.get("BENCH_CPUS", "8")
    builder = SparkSession.builder.master(master or f"local[{cpus}]").appName(app)
    conf = dict(_DEFAULTS)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions or int(cpus))
    conf["spark.driver.memory"] = os.environ.get("VITALSPARK_DRIVER_MEMORY", "16g")
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    ensure_worker_path(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Use the cluster's ``spark.checkpoint.dir``; only when it is unset
    (local runs, tests) fall back to a fresh scratch folder."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = sc.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.split("[")[0] == "local":
            raise RuntimeError("spark.checkpoint.dir is not set: a cluster needs a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="vitalspark-ckpt-")
    sc.setCheckpointDir(configured)
    return configured


def ensure_worker_path(spark: SparkSession) -> None:
    """Let Python workers import this package when it is not installed but
    imported from a folder (tests, notebooks); an own setting is kept."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    spark.sparkContext.environment.setdefault("PYTHONPATH", root)


_SCOPES: list[list[str]] = []


@contextmanager
def intermediates(spark: SparkSession) -> Iterator[None]:
    """Delete, at the end of the block and also when it fails, every table that
    operators wrote to the shared folder inside it.  Write or collect the
    result within the block: a lazy result still reads those tables."""
    _SCOPES.append([])
    try:
        yield
    finally:
        for path in _SCOPES.pop():
            remove_tree(spark, path)


def remove_tree(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared file system."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def scratch_table(spark: SparkSession, what: str) -> str:
    """A new folder name below the shared checkpoint folder."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"
    if _SCOPES:
        _SCOPES[-1].append(path)
    return path


def cut_lineage(df: DataFrame) -> DataFrame:
    """The rows written to the shared checkpoint folder and read again.

    Used where values that depend on the partitioning (range-partition ids)
    must stay fixed between two uses of the same rows, and where a
    recomputation after an executor loss would otherwise replay a long plan.
    A checkpoint would compute the rows twice and tell the planner no size;
    it is used for the types that Parquet does not hold.
    """
    spark = df.sparkSession
    if any(t in kind for _, kind in df.dtypes for t in ("void", "interval", "variant")):
        ensure_checkpoint_dir(spark)
        return df.checkpoint(eager=True)
    path = scratch_table(spark, "rows")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
