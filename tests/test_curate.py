"""Curation edge cases: score parsing modes, upsert keeps whole new rows."""

from pyspark.sql import functions as F

from quarry.operators import curate as C


def test_parse_score_modes(spark):
    df = spark.createDataFrame([("4.5",), ("10",), ("评分：3 分",), ("无",), ("第一行\n5",)], "t STRING")
    got = df.select(C.parse_score(F.col("t")).alias("a"), C.parse_score(F.col("t"), "last_digit").alias("b")).collect()
    assert [r.a for r in got] == [4.5, 10.0, 3.0, None, 5.0]
    # the greedy reference pattern keeps the tail of the last number on the first line
    assert [r.b for r in got] == [5.0, 0.0, 3.0, None, None]


def test_upsert_whole_row_wins(spark):
    old = spark.createDataFrame([(1, "a", 1.0), (2, "b", 2.0)], "k INT, n STRING, s DOUBLE")
    new = spark.createDataFrame([(2, None, 5.0), (3, "c", 3.0)], "k INT, n STRING, s DOUBLE")
    got = sorted(tuple(r) for r in C.upsert(old, new, "k").collect())
    assert got == [(1, "a", 1.0), (2, None, 5.0), (3, "c", 3.0)]
    assert C.upsert(old, new, "k", mode="replace").count() == 2
