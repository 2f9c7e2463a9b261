"""Sinks (SNK-1..4): dataset snapshots, result log, latest result per key,
ordered message logs.  Writes are partitioned Parquet; reads prune partitions.
"""

from __future__ import annotations

import datetime as _dt
import json
import uuid
from collections.abc import Mapping, Sequence
from urllib.parse import quote

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.profile import column_info
from ..plans.ordered import ordered_prefix
from ..session import remove_tree

DELETED = "deleted"      # version name of a commit that takes a snapshot away
RESULT_LOG_SCHEMA = ("run_id string, dataset_id string, task string, features string, target string, "
                     "model string, result_json string, created_at timestamp")


def _file_system(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def _home(base_path: str, dataset_id: str) -> str:
    return f"{base_path.rstrip('/')}/{quote(dataset_id, safe='')}"


def _commits(spark: SparkSession, home: str) -> list[tuple[int, str]]:
    """(number, version) of every finished commit, oldest first; an empty
    marker is a commit under way."""
    fs, folder = _file_system(spark, f"{home}/commits")
    if not fs.exists(folder):
        return []
    found = []
    for status in fs.listStatus(folder):
        name = status.getPath().getName()
        if name.isdigit() and status.getLen():
            stream = fs.open(status.getPath())
            try:
                found.append((int(name), bytes(stream.readAllBytes()).decode()))
            finally:
                stream.close()
    return sorted(found)


def _commit(spark: SparkSession, home: str, version: str) -> None:
    """Add the next marker.  Creating a file that exists fails, so of two
    writers that meet one takes the number and the other the next one."""
    number = max((n for n, _ in _commits(spark, home)), default=0) + 1
    fs, _ = _file_system(spark, home)
    while True:
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{home}/commits/{number:012d}")
        if not fs.exists(path):
            try:
                out = fs.create(path, False)
            except Py4JJavaError:
                if not fs.exists(path):
                    raise
            else:
                try:
                    out.write(bytearray(version.encode()))
                finally:
                    out.close()
                return
        number += 1


def save_snapshot(df: DataFrame, base_path: str, dataset_id: str, key_cols: Sequence[str]) -> str:
    """SNK-1: the table (types kept) and its column profile as one new version
    of the snapshot; returns the version.

    Both are written to a folder of their own, then one commit marker names
    it: a reader sees the data and the profile of the same version, the old one
    until the marker is there.  A failed save leaves the old version; a saved
    table may be made from the version it replaces.  Older versions stay for
    readers that hold them until ``drop_old_versions``."""
    spark, home, version = df.sparkSession, _home(base_path, dataset_id), f"v-{uuid.uuid4().hex}"
    try:
        df.write.parquet(f"{home}/{version}/data")
        column_info(spark.read.schema(df.schema).parquet(f"{home}/{version}/data"), key_cols) \
            .write.parquet(f"{home}/{version}/profile")
    except BaseException:
        remove_tree(spark, f"{home}/{version}")
        raise
    _commit(spark, home, version)
    return version


def snapshot_version(spark: SparkSession, base_path: str, dataset_id: str) -> str | None:
    """The current version, None where there is no snapshot or it was deleted."""
    commits = _commits(spark, _home(base_path, dataset_id))
    return commits[-1][1] if commits and commits[-1][1] != DELETED else None


def _part(spark: SparkSession, base_path: str, dataset_id: str, part: str, version: str | None) -> DataFrame:
    version = version or snapshot_version(spark, base_path, dataset_id)
    if version is None:
        raise FileNotFoundError(f"no snapshot {dataset_id!r}")
    return spark.read.parquet(f"{_home(base_path, dataset_id)}/{version}/{part}")


def load_snapshot(spark: SparkSession, base_path: str, dataset_id: str, version: str | None = None) -> DataFrame:
    """The rows of a snapshot (current version)."""
    return _part(spark, base_path, dataset_id, "data", version)


def load_profile(spark: SparkSession, base_path: str, dataset_id: str, version: str | None = None) -> DataFrame:
    """The column profile saved with a snapshot (current version)."""
    return _part(spark, base_path, dataset_id, "profile", version)


def drop_old_versions(spark: SparkSession, base_path: str, dataset_id: str) -> None:
    """Delete the committed versions before the current one."""
    home = _home(base_path, dataset_id)
    for _, version in _commits(spark, home)[:-1]:
        if version != DELETED:
            remove_tree(spark, f"{home}/{version}")


def delete_snapshot(spark: SparkSession, base_path: str, dataset_id: str) -> bool:
    """Delete data and profile: one marker takes both away from new readers,
    then the files go.  False where there was none."""
    if snapshot_version(spark, base_path, dataset_id) is None:
        return False
    _commit(spark, _home(base_path, dataset_id), DELETED)
    drop_old_versions(spark, base_path, dataset_id)
    return True


def append_result(spark: SparkSession, path: str, run_id: str, dataset_id: str, task: str,
                  result: Mapping, features: Sequence[str] = (), target: str | None = None,
                  model: str | None = None, created_at: _dt.datetime | None = None) -> None:
    """SNK-2: one row per run appended to the result log."""
    when = created_at or _dt.datetime.now(_dt.timezone.utc).replace(tzinfo=None)
    row = [(run_id, dataset_id, task, json.dumps(list(features)), target, model,
            json.dumps(result, default=float), when)]
    spark.createDataFrame(row, RESULT_LOG_SCHEMA).write.mode("append").parquet(path)


def append_results(results: DataFrame, path: str, run_id: str, dataset_id: str, task: str,
                   target: str | None = None, model: str | None = None) -> None:
    """SNK-2 for results that are DataFrames (one log row per result row):
    each row is serialised with ``to_json(struct(*))`` on the executors."""
    cols = [F.col(f"`{c}`") for c in results.columns]
    results.select(F.lit(run_id).alias("run_id"), F.lit(dataset_id).alias("dataset_id"), F.lit(task).alias("task"),
                   F.lit(None).cast("string").alias("features"), F.lit(target).cast("string").alias("target"),
                   F.lit(model).cast("string").alias("model"), F.to_json(F.struct(*cols)).alias("result_json"),
                   F.current_timestamp().cast("timestamp").alias("created_at")) \
        .write.mode("append").parquet(path)


def latest_per_key(df: DataFrame, key_cols: Sequence[str], order_cols: Sequence[str]) -> DataFrame:
    """SNK-3: the row with the greatest ``order_cols`` per key, one
    aggregation (``max_by`` with partial aggregation: a hot key collapses
    map-side instead of being sorted in one task)."""
    payload = [c for c in df.columns if c not in key_cols]
    best = F.max_by(F.struct(*[F.col(c) for c in payload]), F.struct(*[F.col(c) for c in order_cols]))
    return df.groupBy(*key_cols).agg(best.alias("_b")).select(*key_cols, *[F.col(f"_b.{c}").alias(c) for c in payload])


def ordered_log(df: DataFrame, session_cols: Sequence[str], order_cols: Sequence[str]) -> DataFrame:
    """SNK-4: messages of each session in order with their 0-based position;
    sessions of any length are split across tasks (no collect_list)."""
    return ordered_prefix(df, list(order_cols), list(session_cols), index_name="position")
