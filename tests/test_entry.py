"""Driver contract: importable without a session, every oracle has a query, entry runs."""

import importlib


def test_contract_without_session():
    E = importlib.import_module("__spark_entry__")
    q, s = E.queries(), E.oracle_sql()
    assert set(s) <= set(q) and len(q) >= 100


def test_entry_runs(spark):
    E = importlib.import_module("__spark_entry__")
    df = E.entry(spark)
    assert df.count() > 0 and df.columns == ["conv_id", "turn", "role", "text"]
