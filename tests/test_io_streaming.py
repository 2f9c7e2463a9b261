import datetime
import io
import os
import tempfile
import zipfile

import pytest
from pyspark.sql import functions as F

from conftest import SF
from vitalspark.sources import files, sinks
from vitalspark.streaming import rules_stream


def _xlsx(path, rows):
    shared = sorted({v for r in rows for v in r if isinstance(v, str)})
    sidx = {s: i for i, s in enumerate(shared)}
    cells = []
    for ri, r in enumerate(rows, start=1):
        cs = []
        for ci, v in enumerate(r):
            ref = f"{chr(65 + ci)}{ri}"
            if isinstance(v, str):
                cs.append(f'<c r="{ref}" t="s"><v>{sidx[v]}</v></c>')
            else:
                cs.append(f'<c r="{ref}"><v>{v}</v></c>')
        cells.append(f'<row r="{ri}">{"".join(cs)}</row>')
    ns = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    sheet = f'<worksheet xmlns="{ns}"><sheetData>{"".join(cells)}</sheetData></worksheet>'
    sst = f'<sst xmlns="{ns}">' + "".join(f"<si><t>{s}</t></si>" for s in shared) + "</sst>"
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        z.writestr("xl/worksheets/sheet1.xml", sheet)
        z.writestr("xl/sharedStrings.xml", sst)
    with open(path, "wb") as fh:
        fh.write(buf.getvalue())


def test_workbook_and_dispatch(spark):
    d = tempfile.mkdtemp(prefix="vs-xlsx-")
    _xlsx(os.path.join(d, "a.xlsx"), [["id", "name", "score"], [1, "x", 2.5], [2, "y", 3]])
    df = files.read_workbook(spark, d)
    rows = sorted((r["id"], r["name"], r["score"]) for r in df.collect())
    assert rows == [(1.0, "x", 2.5), (2.0, "y", 3.0)]
    try:
        files.read_table(spark, "data.json")
        raise AssertionError("expected ValueError")
    except ValueError:
        pass


def test_csv_and_sql_sources(spark, patients, sample):
    assert patients.count() == 30 and dict(patients.dtypes)["age"] == "int"
    patients.createOrReplaceTempView("patients_view")
    assert files.read_sql(spark, "SELECT count(*) AS n FROM patients_view WHERE age > 65").first()["n"] == (sample.age > 65).sum()


def test_snapshot_and_result_log(spark, patients):
    base = tempfile.mkdtemp(prefix="vs-snap-")
    sinks.save_snapshot(patients, base, "ds1", ["patient_id"])
    back = sinks.load_snapshot(spark, base, "ds1")
    assert back.count() == 30 and dict(back.dtypes)["bmi"] == "double"
    # A second dataset lands beside the first; overwriting ds2 leaves ds1.
    sinks.save_snapshot(patients.limit(5), base, "ds2", ["patient_id"])
    sinks.save_snapshot(patients.limit(7), base, "ds2", ["patient_id"])
    assert sinks.load_snapshot(spark, base, "ds1").count() == 30
    assert sinks.load_snapshot(spark, base, "ds2").count() == 7
    log = os.path.join(base, "results")
    import datetime as dt
    sinks.append_result(spark, log, "r1", "ds1", "regression", {"r2": 0.5}, created_at=dt.datetime(2024, 1, 1))
    sinks.append_result(spark, log, "r2", "ds1", "regression", {"r2": 0.7}, created_at=dt.datetime(2024, 1, 2))
    latest = sinks.latest_per_key(spark.read.parquet(log), ["dataset_id"], ["created_at", "run_id"]).first()
    assert latest["run_id"] == "r2"
    table_result = patients.groupBy("gender").agg(F.count("*").alias("n"))
    sinks.append_results(table_result, log, "r3", "ds1", "group_sizes")
    logged = spark.read.parquet(log).where("run_id = 'r3'").collect()
    assert len(logged) == 2 and all('"n":15' in r["result_json"] for r in logged)


def test_stream_equals_batch(spark):
    src = tempfile.mkdtemp(prefix="vs-src-")
    ev = spark.read.parquet(f"{SF}/events.parquet")
    ev.repartition(3).write.mode("overwrite").parquet(src)
    rules = [{"column": "value", "operator": ">", "value": 300, "severity": "critical"},
             {"column": "value", "operator": "<", "value": 1}]
    # Two far-future heartbeat files, read last: the first moves the
    # watermark past every window, the second lets the closed windows out.
    import time
    for day in ("2030-01-01 00:00:00", "2030-01-02 00:00:00"):
        time.sleep(1.1)
        beat = spark.createDataFrame([(10 ** 9, day, 0, "view", 50.0, "{}")],
                                     "event_id long, ts string, user_id long, event_type string, value double, "
                                     "props string").withColumn("ts", F.to_timestamp_ntz("ts"))
        beat.coalesce(1).write.mode("append").parquet(src)
    sink, ckpt = tempfile.mkdtemp(prefix="vs-sink-"), tempfile.mkdtemp(prefix="vs-ckpt-")
    # Files are read in arbitrary order: a watermark wider than the data's
    # time span keeps every event on time, so nothing is dropped as late.
    q = rules_stream.start_rules_stream(spark, src, ev.schema, rules, "ts", sink, ckpt, watermark="60 days",
                                        max_files_per_trigger=1)
    q.awaitTermination(300)
    streamed = sorted(tuple(r) for r in spark.read.parquet(sink)
                      .select(F.col("window_start").cast("string"), "rule_id", "n_triggered").collect())
    batch = sorted(tuple(r) for r in rules_stream.rule_window_counts(ev, rules, "ts")
                   .select(F.col("window_start").cast("string"), "rule_id", "n_triggered").collect())
    assert streamed == batch and len(batch) > 0


def test_read_table_dispatch_and_ordered_log(spark):
    d = tempfile.mkdtemp(prefix="vs-read-")
    df = spark.createDataFrame([(1, 0, "user", "hi"), (1, 1, "assistant", "hello"), (2, 0, "user", "x")],
                               "conv long, turn long, role string, text string")
    df.write.mode("overwrite").option("header", True).csv(os.path.join(d, "log.csv"))
    df.write.mode("overwrite").parquet(os.path.join(d, "log.parquet"))
    a = files.read_table(spark, os.path.join(d, "log.csv"))
    b = files.read_table(spark, os.path.join(d, "log.parquet"))
    assert a.count() == b.count() == 3 and dict(a.dtypes)["turn"] == "int"
    pos = {(r["conv"], r["turn"]): r["position"] for r in sinks.ordered_log(b, ["conv"], ["turn"]).collect()}
    assert pos == {(1, 0): 0, (1, 1): 1, (2, 0): 0}


def test_snapshot_versions_replace_and_delete(spark, patients):
    base = tempfile.mkdtemp(prefix="vs-snap-")
    first = sinks.save_snapshot(patients.limit(5), base, "a/b", ["patient_id"])
    old = sinks.load_snapshot(spark, base, "a/b")
    second = sinks.save_snapshot(sinks.load_snapshot(spark, base, "a/b").limit(3), base, "a/b", ["patient_id"])
    assert first != second and old.count() == 5  # a reader of the old version goes on
    profile = {r["column"]: r["unique_values"] for r in sinks.load_profile(spark, base, "a/b").collect()}
    assert sinks.load_snapshot(spark, base, "a/b").count() == 3 == profile["patient_id"]
    home = os.path.join(base, "a%2Fb")
    open(os.path.join(home, "commits", "000000000003"), "w").close()  # a commit under way
    assert sinks.snapshot_version(spark, base, "a/b") == second
    with pytest.raises(Exception):
        sinks.save_snapshot(patients.select(F.raise_error(F.lit("lost")).alias("x")), base, "a/b", ["x"])
    assert sinks.snapshot_version(spark, base, "a/b") == second
    sinks.drop_old_versions(spark, base, "a/b")
    assert sorted(os.listdir(home)) == sorted(["commits", second])
    assert sinks.delete_snapshot(spark, base, "a/b") and not sinks.delete_snapshot(spark, base, "a/b")
    assert os.listdir(home) == ["commits"]
    with pytest.raises(FileNotFoundError):
        sinks.load_snapshot(spark, base, "a/b")


def test_stream_leaves_late_rows_out(spark):
    """Closed windows stay as they are when a row comes after the watermark;
    a row inside it counts; an empty part changes nothing."""
    schema = "ts timestamp_ntz, value double"
    at = lambda day, hour: datetime.datetime(2024, 1, day, hour, 30)
    parts = [[(at(1, 1), 9.0), (at(1, 5), 9.0)], [(at(2, 1), 9.0), (at(1, 23), 9.0)], [],
             [(at(1, 1), 9.0), (at(2, 0), 9.0), (at(3, 0), 9.0)]]
    rules = [{"column": "value", "operator": ">", "value": 5}]
    out = rules_stream.feed_rules_stream([spark.createDataFrame(p, schema) for p in parts], rules, "ts",
                                         tempfile.mkdtemp(prefix="vs-feed-"))
    got = {(r["d"], r["h"]): r["n_triggered"] for r in out.selectExpr("day(window_start) d", "hour(window_start) h",
                                                                      "n_triggered").collect()}
    assert got == {(1, 1): 1, (1, 5): 1, (1, 23): 1, (2, 0): 1, (2, 1): 1}
