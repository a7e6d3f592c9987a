"""Plan guards over every registered query: no pair-producing joins; top-k stays partial."""

import importlib

SF = "/root/testdata/sf0.001"


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_cartesian_or_nested_loop_joins(spark):
    E = importlib.import_module("__spark_entry__")
    bad = {}
    for name, q in sorted(E.queries().items()):
        plan = _plan(q(spark, SF))
        for op in ("CartesianProduct", "BroadcastNestedLoopJoin"):
            if op in plan:
                bad[name] = op
    assert bad == {}


def test_topk_windows_limit_before_shuffle(spark):
    E = importlib.import_module("__spark_entry__")
    q = E.queries()
    for name in ["c3_sample_per_group", "v3_sparse_top_n", "v7_dense_topk", "v8_sparse_topk"]:
        df = q[name](spark, SF)
        df.collect()  # final adaptive plan
        assert "WindowGroupLimit" in _plan(df), name
