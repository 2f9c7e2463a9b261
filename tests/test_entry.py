import importlib.util

import __spark_entry__ as E


def test_entry_smoke(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) == 10 and "risk_score" in df.columns


def test_registry_contract():
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q)
    assert len([n for n in q if not n.startswith("op") and n != "pipeline"]) >= 60


def test_the_rest_stands_without_the_optional_part(monkeypatch):
    find = importlib.util.find_spec
    monkeypatch.setattr(importlib.util, "find_spec", lambda n, *a: None if n == "vitalspark.llm" else find(n, *a))
    q = E.queries()
    assert len(q) >= 60 and not [n for n in q if n.startswith("op") or n == "pipeline"]
    assert set(E.oracle_sql()) <= set(q)
