"""Registry of named queries: a Spark builder plus, where the operator is
SQL-expressible, the DuckDB oracle that must return the same rows.

Every registered query reads whole driver tables (or tables Spark derives from
them); none runs on made-up input.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Query:
    name: str
    build: Callable[[SparkSession, str], DataFrame]
    oracle: str | None
    covers: tuple[str, ...]


QUERIES: dict[str, Query] = {}


def bigint_counts(sql: str) -> str:
    """DuckDB types ``count_if`` as HUGEINT; Spark's is BIGINT.  Wrap every
    ``count_if(...)`` in a BIGINT cast so oracle and query share a schema."""
    out, i, key = [], 0, "count_if("
    while True:
        j = sql.find(key, i)
        if j < 0:
            out.append(sql[i:])
            return "".join(out)
        depth, k = 0, j + len(key) - 1
        while k < len(sql):
            if sql[k] == "(":
                depth += 1
            elif sql[k] == ")":
                depth -= 1
                if depth == 0:
                    break
            k += 1
        inner = bigint_counts(sql[j + len(key):k])
        out.append(sql[i:j] + "CAST(count_if(" + inner + ") AS BIGINT)")
        i = k + 1


def register(name: str, covers: tuple[str, ...] | str, oracle: str | None = None):
    """Decorator: ``@register("risk_top", "RSK-5 RSK-6", sql)``."""
    ids = tuple(covers.split()) if isinstance(covers, str) else tuple(covers)

    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"query {name!r} registered twice")
        QUERIES[name] = Query(name, fn, bigint_counts(oracle) if oracle else None, ids)
        return fn
    return deco


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


# The lineitem row key: (l_orderkey, l_linenumber) repeats, these four do not.
LINEITEM_KEY = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
LINEITEM_NUM = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
