"""Sources (SRC-1..3): CSV, workbook, SQL/JDBC and Parquet.

Every reader returns a lazy DataFrame; files are split and read by executors.
The workbook reader parses each ``.xlsx`` inside one task (``binaryFile`` +
``mapInPandas``, standard-library zip/XML), emits long (file, row, column,
value) cells and pivots them in Spark -- no workbook passes through the driver.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator, Sequence
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import nan_to_null

CELL_SCHEMA = "path string, row long, col long, value string"
_NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}
_REF = re.compile(r"([A-Z]+)([0-9]+)")


def read_csv(spark: SparkSession, path: str | Sequence[str], schema=None, header: bool = True) -> DataFrame:
    """SRC-1: header row, explicit schema for production jobs, inference for
    exploration; a directory or glob reads in parallel."""
    reader = spark.read.option("header", header).option("mode", "PERMISSIVE")
    reader = reader.schema(schema) if schema is not None else reader.option("inferSchema", True)
    return nan_to_null(reader.csv(path))


def _col_index(letters: str) -> int:
    n = 0
    for ch in letters:
        n = n * 26 + (ord(ch) - 64)
    return n - 1


def _sheet_cells(path: str, content: bytes) -> list[tuple]:
    """Cells of the first worksheet of one workbook (shared strings, inline
    strings and numbers)."""
    out = []
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            root = ElementTree.fromstring(z.read("xl/sharedStrings.xml"))
            for si in root.findall("m:si", _NS):
                shared.append("".join(t.text or "" for t in si.iter(f"{{{_NS['m']}}}t")))
        sheets = sorted(n for n in z.namelist() if n.startswith("xl/worksheets/sheet") and n.endswith(".xml"))
        if not sheets:
            return out
        first = "xl/worksheets/sheet1.xml" if "xl/worksheets/sheet1.xml" in sheets else sheets[0]
        root = ElementTree.fromstring(z.read(first))
        for c in root.iter(f"{{{_NS['m']}}}c"):
            m = _REF.fullmatch(c.get("r", ""))
            if not m:
                continue
            t = c.get("t")
            v = c.find("m:v", _NS)
            if t == "s" and v is not None:
                val = shared[int(v.text)]
            elif t == "inlineStr":
                val = "".join(x.text or "" for x in c.iter(f"{{{_NS['m']}}}t"))
            else:
                val = v.text if v is not None else None
            out.append((path, int(m.group(2)) - 1, _col_index(m.group(1)), val))
    return out


def _parse_workbooks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for path, content in zip(pdf["path"], pdf["content"]):
            rows.extend(_sheet_cells(path, bytes(content)))
        yield pd.DataFrame(rows, columns=["path", "row", "col", "value"])


def read_workbook_cells(spark: SparkSession, path: str) -> DataFrame:
    """Long cells of the first sheet of every ``.xlsx`` under ``path``."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx").load(path)
    return files.select("path", "content").mapInPandas(_parse_workbooks, CELL_SCHEMA)


def read_workbook(spark: SparkSession, path: str, max_columns: int = 10_000) -> DataFrame:
    """SRC-2: first sheet with a header row; columns whose every value parses
    as a number become doubles.  The header (bounded by ``max_columns``) is
    the only thing collected."""
    cells = read_workbook_cells(spark, path)
    header = cells.where(F.col("row") == 0).groupBy("col").agg(
        F.min("value").alias("name"), F.max("value").alias("other"), F.count("value").alias("n")) \
        .orderBy("col").limit(max_columns + 1).collect()
    if len(header) > max_columns:
        raise ValueError("too many workbook columns")
    files = cells.agg(F.count_distinct("path").alias("n")).first()["n"]
    if any(r["name"] != r["other"] or r["n"] not in (0, files) for r in header):
        raise ValueError("the workbooks have different headers")
    names = {r["col"]: (r["name"] or f"column_{r['col']}") for r in header}
    body = cells.where(F.col("row") > 0)
    wide = body.groupBy("path", "row").pivot("col", list(names)).agg(F.first("value"))
    wide = wide.select("path", "row", *[F.col(f"`{i}`").alias(n) for i, n in names.items()])
    checks = wide.agg(*[F.bool_and(F.col(f"`{n}`").isNull() | F.col(f"`{n}`").try_cast("double").isNotNull())
                        .alias(n) for n in names.values()]).first().asDict()
    return wide.select("path", "row", *[(F.col(f"`{n}`").try_cast("double") if checks[n] else F.col(f"`{n}`")).alias(n)
                                        for n in names.values()])


def read_table(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """Dispatch on the lower-cased extension like the reference's loader;
    unknown extensions raise."""
    low = path.lower().rstrip("/")
    if low.endswith(".csv"):
        return read_csv(spark, path, schema)
    if low.endswith(".xlsx"):
        return read_workbook(spark, path)
    if low.endswith(".parquet"):
        return spark.read.parquet(path)
    raise ValueError(f"Unsupported file type: {path}")


def read_sql(spark: SparkSession, query: str) -> DataFrame:
    """SRC-3 over tables the session already knows (views, catalog)."""
    return spark.sql(query)


def read_jdbc(spark: SparkSession, url: str, table: str | None = None, query: str | None = None,
              partition_column: str | None = None, lower_bound: int | None = None,
              upper_bound: int | None = None, num_partitions: int | None = None,
              properties: dict | None = None) -> DataFrame:
    """SRC-3 against a remote database.  With a partition column the read is
    split into ``num_partitions`` range queries run by executors; a free-form
    ``query`` is pushed down as a subquery."""
    reader = spark.read.format("jdbc").option("url", url)
    for k, v in (properties or {}).items():
        reader = reader.option(k, v)
    if partition_column:
        if not table:
            raise ValueError("a partitioned JDBC read needs a table (or '(query) alias')")
        reader = reader.option("dbtable", table).option("partitionColumn", partition_column) \
            .option("lowerBound", lower_bound).option("upperBound", upper_bound) \
            .option("numPartitions", num_partitions or 8)
    elif query:
        reader = reader.option("query", query)
    else:
        reader = reader.option("dbtable", table)
    return reader.load()
