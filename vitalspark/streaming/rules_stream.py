"""Alert rules on a stream (RUL-5).

The same rule predicates as the batch evaluator, applied to a Structured
Streaming source: each event yields the ids of the rules it triggers, and a
watermarked tumbling-window count per rule is kept in state.  The watermark
bounds the state; late events beyond it are dropped by Spark.

``rule_window_counts`` is plan-only and works on batch and streaming
DataFrames alike, so the batch result is the reference for the stream.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..functions.columns import to_double
from ..operators.rules import compare, normalise_rules

DEFAULT_WINDOW = "1 hour"
DEFAULT_WATERMARK = "2 hours"


def rule_hits(df: DataFrame, rules: Sequence[Mapping], ts_col: str) -> DataFrame:
    """(ts, rule_id, name, severity) for every (event, triggered rule)."""
    rs = normalise_rules(df, rules)
    if not rs:
        raise ValueError("no rule refers to a column of the stream")
    hits = F.filter(F.array(*[F.when(compare(to_double(r["column"]), r["operator"], r["value"]),
                                     F.lit(r["rule_id"])) for r in rs]), lambda x: x.isNotNull())
    meta = F.array(*[F.struct(F.lit(r["rule_id"]).alias("rule_id"), F.lit(r["name"]).alias("name"),
                              F.lit(r["severity"]).alias("severity")) for r in rs])
    ids = [r["rule_id"] for r in rs]
    pos = F.array_position(F.array(*[F.lit(i) for i in ids]), F.col("rule_id"))
    return df.select(F.col(ts_col).alias("ts"), F.explode(hits).alias("rule_id")) \
        .withColumn("_m", F.element_at(meta, pos.cast("int"))) \
        .select("ts", "rule_id", F.col("_m.name").alias("name"), F.col("_m.severity").alias("severity"))


def rule_window_counts(df: DataFrame, rules: Sequence[Mapping], ts_col: str, window: str = DEFAULT_WINDOW,
                       watermark: str | None = DEFAULT_WATERMARK) -> DataFrame:
    """Triggered-event counts per (tumbling window, rule)."""
    if watermark and df.isStreaming:
        # Event time advances with every event, not only with rule hits, so
        # the watermark sits on the source.  Watermarks need TIMESTAMP; a
        # wall-clock (NTZ) column is read in the session time zone.
        if dict(df.dtypes)[ts_col] == "timestamp_ntz":
            df = df.withColumn(ts_col, F.col(ts_col).cast("timestamp"))
        df = df.withWatermark(ts_col, watermark)
    hits = rule_hits(df, rules, ts_col)
    return hits.groupBy(F.window("ts", window).alias("w"), "rule_id", "name", "severity") \
        .agg(F.count(F.lit(1)).alias("n_triggered")) \
        .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"),
                "rule_id", "name", "severity", "n_triggered")


def run_rules_stream(spark: SparkSession, source_dir: str, rules: Sequence[Mapping], ts_col: str, folder: str,
                     window: str = DEFAULT_WINDOW) -> DataFrame:
    """Drain a Parquet source once (``availableNow``) and return the counts of
    all windows.  The state is the window counts; each micro-batch writes the
    full table to its own folder below ``folder`` (shared storage), so a batch
    that is repeated after a failure replaces its own result only."""
    still = spark.read.parquet(source_dir)
    schema, files = still.schema, still.inputFiles()
    reader, parent, name = spark.readStream.schema(schema), *source_dir.rstrip("/").rsplit("/", 1)
    if len(files) == 1 and files[0].endswith(f"/{name}"):  # a stream watches folders: the one file of its folder
        reader, source_dir = reader.option("pathGlobFilter", name), parent
    counts = rule_window_counts(reader.parquet(source_dir), rules, ts_col, window, watermark=None)
    done: list[str] = []

    def write(batch: DataFrame, batch_id: int) -> None:
        path = f"{folder}/result-{batch_id}"
        batch.write.mode("overwrite").parquet(path)
        done.append(path)

    query = counts.writeStream.outputMode("complete").foreachBatch(write) \
        .option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(done[-1]) if done else rule_window_counts(
        spark.createDataFrame([], schema), rules, ts_col, window)


def start_rules_stream(spark: SparkSession, source_dir: str, schema, rules: Sequence[Mapping], ts_col: str,
                       sink_dir: str, checkpoint_dir: str, window: str = DEFAULT_WINDOW,
                       watermark: str = DEFAULT_WATERMARK, available_now: bool = True,
                       max_files_per_trigger: int | None = None) -> StreamingQuery:
    """Parquet file source -> rule windows -> Parquet sink (append: a window
    is written once the watermark passes it).  ``checkpoint_dir`` must be on
    shared storage so the query restarts exactly where it stopped."""
    reader = spark.readStream.schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    stream = reader.parquet(source_dir)
    counts = rule_window_counts(stream, rules, ts_col, window, watermark)
    writer = counts.writeStream.outputMode("append").format("parquet") \
        .option("path", sink_dir).option("checkpointLocation", checkpoint_dir)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="30 seconds")
    return writer.start()


def feed_rules_stream(batches: Sequence[DataFrame], rules: Sequence[Mapping], ts_col: str, folder: str,
                      window: str = DEFAULT_WINDOW, watermark: str = DEFAULT_WATERMARK) -> DataFrame:
    """Feed batches that arrive one after another and return the windows that
    the stream has closed.

    Each batch is appended to the source folder and the stream starts again
    from its checkpoint (so a lost driver goes on the same way), reads it,
    moves the watermark to the newest event less ``watermark`` and appends the
    windows that end by then; later rows of such a window are left out, and its
    state is gone.  State is bounded by the windows inside the watermark.
    ``folder`` lies on shared storage.  Without a batch, or with empty ones
    only, there is no window."""
    source, sink, checkpoint = (f"{folder}/{part}" for part in ("source", "windows", "checkpoint"))
    if not batches:
        raise ValueError("no batch")
    spark, schema = batches[0].sparkSession, batches[0].schema
    for rows in batches:
        rows.select(*schema.names).write.mode("append").parquet(source)
        start_rules_stream(spark, source, schema, rules, ts_col, sink, checkpoint, window, watermark).awaitTermination()
    closed = rule_window_counts(spark.createDataFrame([], schema), rules, ts_col, window).schema
    for field in closed.fields:  # the watermark makes the wall clock a point in time
        if field.name.startswith("window_") and dict(batches[0].dtypes)[ts_col] == "timestamp_ntz":
            field.dataType = T.TimestampType()
    return spark.read.schema(closed).parquet(sink)
