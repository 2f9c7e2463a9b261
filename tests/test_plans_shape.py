"""Plan-shape checks: filters reach the scan, projections prune columns,
top-k stays a top-k, per-group limits are applied before the shuffle."""
import __spark_entry__ as E
from conftest import SF


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_typed_filters_are_pushed(spark):
    plan = _plan(E.queries()["filter_equals"](spark, SF))
    assert "PushedFilters: [IsNotNull(c_nationkey), IsNotNull(c_mktsegment), EqualTo(c_nationkey,7)" in plan


def test_scan_reads_only_needed_columns(spark):
    spark.conf.set("spark.sql.maxMetadataStringLength", "1000")
    plan = _plan(E.queries()["risk_top"](spark, SF))
    assert "ReadSchema: struct<l_orderkey:bigint,l_partkey:bigint,l_suppkey:bigint,l_linenumber:int," \
           "l_quantity:double,l_extendedprice:double,l_discount:double,l_tax:double>" in plan
    assert "TakeOrderedAndProject" in plan and "l_shipdate" not in plan


def test_group_limit_before_shuffle(spark):
    """Rows meet a bounded list per rule place in their own task first; nothing
    shuffles or sorts them before."""
    plan = E.queries()["rules_rows"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    below = plan[plan.index("MapInArrow"):]
    assert "Exchange" in plan and "Window" not in plan and "Exchange" not in below and "Sort" not in below


def test_single_scan_aggregate_for_rules(spark):
    plan = _plan(E.queries()["rules_eval"](spark, SF))
    assert plan.count("FileScan parquet") == 1


def test_first_values_keep_a_heap_not_a_sort(spark):
    from vitalspark.operators.profile import first_values
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    plan = _plan(first_values(docs, docs.columns, ["doc_id"], 3))
    assert plan.count("TakeOrderedAndProject") == len(docs.columns) and "WindowGroupLimit" not in plan


def test_distinct_counts_shuffle_hashes_only(spark):
    """No Expand; the columns that rows are dealt by are numbers, not texts."""
    import re

    from vitalspark.operators import profile, quality
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for df in (quality.column_pass(docs), profile.detect_tasks(docs), profile.column_info(docs, ["doc_id"])):
        plan = _plan(df)
        assert "Expand" not in plan
        keys = re.findall(r"hashpartitioning\(([^)]*)\)", plan)
        assert any("h1" in k and "h2" in k for k in keys) and not any("text" in k for k in keys)
