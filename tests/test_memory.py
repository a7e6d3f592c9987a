"""Chat memory: the reference's message-store and bounded-history cases, plus random checks."""

import random

from pyspark.sql import functions as F

from quarry.operators import memory as M

SCHEMA = "conv_id STRING, turn BIGINT, role STRING, text STRING"


def log(spark, msgs, key="k"):
    return spark.createDataFrame([(key, i, r, t) for i, (r, t) in enumerate(msgs)], SCHEMA)


def texts(df):
    return [r.text for r in df.orderBy("conv_id", "turn").collect()]


PAIR = [("assistant", "Hello"), ("user", "Hi")]
FOUR = [("assistant", "Hello"), ("user", "Hi"), ("assistant", "How are you?"), ("user", "I'm good, thanks!")]


def test_set_and_get(spark):
    lg = log(spark, PAIR)
    new = log(spark, [("user", "replaced")])
    assert texts(M.set_messages(lg, new)) == ["replaced"]
    assert texts(M.range_read(lg, 0, -1)) == ["Hello", "Hi"]


def test_add_appends(spark):
    lg = log(spark, [("assistant", "Hello")])
    new = spark.createDataFrame([("k", "user", "Hi", None)], "conv_id STRING, role STRING, text STRING, idx INT")
    assert texts(M.add_messages(lg, new)) == ["Hello", "Hi"]


def test_insert_before_last(spark):
    lg = log(spark, PAIR)
    new = spark.createDataFrame([("k", "assistant", "Hey", -1)], "conv_id STRING, role STRING, text STRING, idx INT")
    out = M.add_messages(lg, new).orderBy("turn").collect()
    assert [r.text for r in out] == ["Hello", "Hey", "Hi"]
    assert [r.turn for r in out] == [0, 1, 2]


def test_delete_all(spark):
    lg = log(spark, PAIR)
    rest, gone = M.delete_keys(lg, lg)
    assert rest.count() == 0 and texts(gone) == ["Hello", "Hi"]


def test_delete_first(spark):
    out = M.delete_at(log(spark, PAIR), 0).collect()
    assert [(r.turn, r.text) for r in out] == [(0, "Hi")]


def test_delete_missing_is_noop(spark):
    assert texts(M.delete_at(log(spark, PAIR), 5)) == ["Hello", "Hi"]


def test_pop_last(spark):
    assert texts(M.pop_last(log(spark, PAIR))) == ["Hello"]


def test_history_token_limit_20(spark):
    out = M.history_window(log(spark, FOUR), token_limit=20, max_conversations=3)
    assert texts(out) == ["I'm good, thanks!"]


def test_history_one_conversation(spark):
    out = M.history_window(log(spark, FOUR), token_limit=1536, max_conversations=1)
    assert texts(out) == ["How are you?", "I'm good, thanks!"]


def test_initial_overflow_keeps_three(spark):
    out = M.history_window(log(spark, FOUR), token_limit=10, initial_token_count=11)
    assert texts(out) == ["Hi", "How are you?", "I'm good, thanks!"]


def brute_history(msgs, limit, mc):
    kept, tok, cnt = [], 0, 0
    for role, text in reversed(msgs):
        if tok + len(text) > limit:
            break
        kept.append(text)
        tok += len(text)
        if role in ("user", "assistant"):
            cnt += 1
        if cnt >= 2 * mc:
            break
    return list(reversed(kept))


def test_history_random_against_loop(spark):
    rng = random.Random(7)
    cases, rows = [], []
    for c in range(60):
        n = rng.randint(0, 12)
        msgs = [(rng.choice(["user", "assistant", "system"]), "x" * rng.randint(0, 9)) for _ in range(n)]
        cases.append(msgs)
        rows += [(str(c), i, r, t + f"#{i}") for i, (r, t) in enumerate(msgs)]
    df = spark.createDataFrame(rows, SCHEMA)
    for limit, mc in [(15, 1), (30, 2), (1000, 3)]:
        got = {}
        for r in M.history_window(df, token_limit=limit, max_conversations=mc, block=4).collect():
            got.setdefault(r.conv_id, []).append((r.turn, r.text))
        for c, msgs in enumerate(cases):
            full = [(r, t + f"#{i}") for i, (r, t) in enumerate(msgs)]
            want = brute_history(full, limit, mc)
            assert [t for _, t in sorted(got.get(str(c), []))] == want


def test_running_totals_blocks_equal_plain_window(spark):
    from pyspark.sql import Window

    from quarry.operators.scan import running_totals
    rng = random.Random(3)
    rows = [(rng.randint(0, 3), i, rng.randint(0, 5)) for i in range(500)]
    df = spark.createDataFrame(rows, "k INT, p INT, v INT")
    got = running_totals(df, ["k"], "p", {"s": F.col("v")}, block=7)
    w = Window.partitionBy("k").orderBy("p").rowsBetween(Window.unboundedPreceding, 0)
    want = df.withColumn("s", F.sum("v").over(w))
    assert sorted(got.collect()) == sorted(want.collect())
    got_d = running_totals(df, ["k"], "p", {"s": F.col("v")}, block=5, descending=True)
    wd = Window.partitionBy("k").orderBy(F.col("p").desc()).rowsBetween(Window.unboundedPreceding, 0)
    assert sorted(got_d.collect()) == sorted(df.withColumn("s", F.sum("v").over(wd)).collect())


def test_pack_unpack_roundtrip(spark):
    lg = log(spark, PAIR)
    packed = M.pack_messages(lg, F.timestamp_seconds(F.lit(1700000000)))
    back = M.unpack_messages(packed).orderBy("turn").collect()
    assert [(r.role, r.text) for r in back] == PAIR
    assert M.model_token_limit("deepseek-chat") == 24576 and M.model_token_limit(None) == 3000


def test_insert_on_repartitioned_input_keeps_row_count(spark):
    # regression: a repartitioned log feeding both sides of the insert's union used to duplicate rows
    rows = [(str(k), i, "user", f"m{i}") for k in range(20) for i in range(k % 5 + 1)]
    lg = spark.createDataFrame(rows, SCHEMA).repartition(7, "conv_id")
    new = lg.groupBy("conv_id").agg(F.lit("system").alias("role"), F.lit("s").alias("text"), F.lit(-1).alias("idx"))
    out = M.add_messages(lg, new)
    assert out.count() == len(rows) + 20
    assert out.groupBy("conv_id", "turn").count().where("count > 1").count() == 0


def test_previous_values_blocks_equal_plain_lag(spark):
    from pyspark.sql import Window

    from quarry.operators.scan import previous_values
    rng = random.Random(9)
    rows = [(rng.randint(0, 3), p, rng.choice(["a", "b", None])) for p in rng.sample(range(400), 300)]
    df = spark.createDataFrame(rows, "k INT, p INT, v STRING")
    got = previous_values(df, ["k"], "p", ["v"], block=7).select("k", "p", "v", "prev_v")
    want = df.withColumn("prev_v", F.lag("v").over(Window.partitionBy("k").orderBy("p")))
    assert sorted(got.collect()) == sorted(want.collect())


def test_rows_with_null_keys_are_kept(spark):
    log = spark.createDataFrame([("a", 0, "user", "x"), (None, 0, "user", "y"), (None, 1, "user", "z")],
                                "conv_id STRING, turn BIGINT, role STRING, text STRING")
    assert M.range_read(log, 0, -1).count() == 3
    assert sorted(r.text for r in M.history_window(log).collect()) == ["x", "y", "z"]
    assert [r.text for r in M.pop_last(log).collect()] == ["y"]
    new = spark.createDataFrame([(None, 0, "user", "n")], "conv_id STRING, idx INT, role STRING, text STRING")
    got = M.add_messages(log, new).where("conv_id IS NULL").orderBy("turn").collect()
    assert [(r.turn, r.text) for r in got] == [(0, "n"), (1, "y"), (2, "z")]
    rest, gone = M.delete_keys(log, new)
    assert (rest.count(), gone.count()) == (1, 2)
