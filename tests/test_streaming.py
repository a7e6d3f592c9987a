"""Event functions on a real stream: envelopes written as files, read with readStream."""

import json
import os
import tempfile

from quarry.streaming import events as E
from quarry.streaming.memory import window_of


def _env(action, ctype, text, uid, mid):
    content = json.dumps({"type": ctype, "text": text, "contentType": 0}, ensure_ascii=False)
    return json.dumps({"action": action, "data": {"content": content, "time": 1720964312225, "user_id": uid,
                                                  "channel_id": "c", "message_id": mid}, "ack": -1, "status": True},
                      ensure_ascii=False)


def test_parse_route_mentions_on_stream(spark):
    d = tempfile.mkdtemp(prefix="quarry-stream-")
    rows = [_env("push", "text", "你好 ${@!42} and ${@!7}", "1", "m1"), _env("push", "image", "x", "2", "m2"),
            _env("connect", None, None, None, "m3"), _env("push", "text", "no mention", "3", "m4")]
    with open(os.path.join(d, "part-0.json"), "w") as f:
        f.write("\n".join(rows) + "\n")
    src = spark.readStream.schema("value STRING").text(d).withColumnRenamed("value", "raw")
    answered, unsupported = E.route_events(E.parse_events(src))
    mentions = E.extract_mentions(answered)
    q1 = mentions.writeStream.format("memory").queryName("q_mentions").trigger(availableNow=True).start()
    q2 = unsupported.writeStream.format("memory").queryName("q_unsupported").outputMode("complete") \
        .trigger(availableNow=True).start()
    q1.awaitTermination()
    q2.awaitTermination()
    got = sorted((r.message_id, r.mention_id) for r in spark.sql("SELECT * FROM q_mentions").collect())
    assert got == [("m1", "42"), ("m1", "7")]
    un = sorted((r.action, r.type, r.n_events) for r in spark.sql("SELECT * FROM q_unsupported").collect())
    assert un == [("connect", None, 1), ("push", "image", 1)]
    ts = spark.sql("SELECT * FROM q_mentions").collect()[0].ts
    assert ts.year == 2024


def test_window_of_matches_history_rule():
    msgs = [{"role": r, "content": c} for r, c in
            [("assistant", "Hello"), ("user", "Hi"), ("assistant", "How are you?"), ("user", "I'm good, thanks!")]]
    assert [m["content"] for m in window_of(msgs, 20, 3)] == ["I'm good, thanks!"]
    assert [m["content"] for m in window_of(msgs, 1536, 1)] == ["How are you?", "I'm good, thanks!"]


def test_memory_of_unordered_messages(spark):
    """One user's messages in falling order, over several Arrow batches and micro-batches."""
    from quarry.streaming.memory import stream_memory, use_state_store
    d = tempfile.mkdtemp(prefix="quarry-stream-")
    for part, ids in enumerate((range(79, 39, -1), range(39, -1, -1))):
        with open(os.path.join(d, f"part-{part}.json"), "w") as f:
            f.write("\n".join(json.dumps({"user_id": i % 2, "ts": i // 3, "event_id": i, "role": "user", "content": f"m{i:02d}"})
                              for i in ids) + "\n")
    src = spark.readStream.schema("user_id LONG, ts LONG, event_id LONG, role STRING, content STRING").option(
        "maxFilesPerTrigger", 1).json(d)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    try:
        with use_state_store(spark):
            q = stream_memory(src, token_limit=10, max_conversations=3).writeStream.format("memory").queryName(
                "q_unordered").trigger(availableNow=True).start()
            q.awaitTermination()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    rows = spark.sql("SELECT * FROM q_unordered").collect()
    for user, want in ((0, ["m74", "m76", "m78"]), (1, ["m75", "m77", "m79"])):
        last = max(r.version for r in rows if r.user_id == user)
        assert [r.content for r in sorted((r for r in rows if r.user_id == user and r.version == last), key=lambda r: r.pos)] == want


def test_late_message_stays_behind_the_one_that_overflowed():
    from quarry.streaming.memory import still_needed
    msgs = [{"at": [i], "role": "user", "content": c} for i, c in ((5, "x" * 9), (6, "abc"), (7, "abc"))]
    kept = still_needed(msgs, 10, 3)
    assert [m["at"] for m in kept] == [[5], [6], [7]]
    late = sorted([*kept, {"at": [4], "role": "user", "content": "y"}], key=lambda m: m["at"])
    assert [m["at"] for m in window_of(still_needed(late, 10, 3), 10, 3)] == [[6], [7]]


def test_silent_user_expires_over_triggers(spark):
    """Triggers on one checkpoint: an active user's messages outlive the time to live, a silent user is forgotten."""
    import time

    from quarry.streaming.memory import stream_memory, use_state_store

    def triggers(ttl):
        """A function that runs a trigger with one message for each of the users; it returns the result so far by user."""
        d, run = tempfile.mkdtemp(prefix="quarry-stream-"), tempfile.mkdtemp(prefix="quarry-ttl-")
        done = []

        def trigger(*users):
            n = len(done)
            done.append(users)
            with open(os.path.join(d, f"part-{n}.json"), "w") as f:
                f.write("\n".join(json.dumps({"user_id": u, "ts": n, "event_id": n, "role": "user", "content": f"m{n}"}) for u in users))
            src = spark.readStream.schema("user_id LONG, ts LONG, event_id LONG, role STRING, content STRING").json(d)
            with use_state_store(spark):
                q = stream_memory(src, token_limit=1000, max_conversations=99, ttl_ms=int(1000 * ttl)).writeStream.format(
                    "parquet").option("path", f"{run}/out").option("checkpointLocation", f"{run}/ckpt").trigger(availableNow=True).start()
                assert q.awaitTermination(120)
            rows = spark.read.parquet(f"{run}/out").collect()
            latest = {u: max(r.version for r in rows if r.user_id == u) for u in users}
            return n, {u: [r.content for r in sorted(rows, key=lambda r: r.pos) if r.user_id == u and r.version == v] for u, v in latest.items()}
        return trigger

    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    try:
        warm = triggers(1000)
        warm(1)
        began = time.time()
        warm(1)
        ttl = 4 * (time.time() - began)
        trigger = triggers(ttl)
        began, (n, got) = time.time(), trigger(1, 2)
        while time.time() - began < 2.3 * ttl:  # user 1 is never silent for so long, and its messages live on
            n, got = trigger(1)
        assert got[1] == [f"m{i}" for i in range(n + 1)]
        trigger(2)  # user 2 was, and is a new user
        n, got = trigger(2, 1)
        assert got[2] == [f"m{n - 1}", f"m{n}"] and got[1][-1] == f"m{n}"
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
