"""Registered event-stream queries.

``events`` rows become bot push envelopes: signups are connect frames, errors are pongs,
purchases carry image content and every other event a text message that mentions its
user. E1-E3 run the stream functions on that table; E4 runs a real Structured Streaming
query over the events file and reads back its final state.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from ..session import scratch_path
from ..streaming import events as E
from ..streaming.memory import stream_memory, use_state_store
from .registry import Tables, register

_ENV_SQL = """
e AS (SELECT CAST(event_id AS VARCHAR) AS message_id, CAST(user_id AS VARCHAR) AS user_id,
        CASE event_type WHEN 'signup' THEN 'connect' WHEN 'error' THEN 'pong' ELSE 'push' END AS action,
        CASE event_type WHEN 'purchase' THEN 'image' ELSE 'text' END AS type,
        event_type || ' ' || props || ' ${@!' || CAST(user_id AS VARCHAR) || '}' AS text,
        make_timestamp((epoch_us(ts) // 1000) * 1000) AS ts
      FROM events)"""


def _envelopes(t):
    ev = t.events
    action = (F.when(F.col("event_type") == "signup", "connect").when(F.col("event_type") == "error", "pong")
              .otherwise("push"))
    ctype = F.when(F.col("event_type") == "purchase", "image").otherwise("text")
    text = F.concat(F.col("event_type"), F.lit(" "), F.col("props"), F.lit(" ${@!"), F.col("user_id").cast("string"),
                    F.lit("}"))
    raw = E.envelope_from_columns(action, ctype, text, F.unix_millis(F.col("ts").cast("timestamp")),
                                  F.col("user_id").cast("string"), F.lit("c0"), F.col("event_id").cast("string"))
    return ev.select(raw.alias("raw"))


def _parsed(t):
    return E.parse_events(_envelopes(t)).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@register("e1_parse_events", "WITH " + _ENV_SQL + "\nSELECT message_id, user_id, action, type, text, ts FROM e")
def e1_parse_events(spark, sf):
    return _parsed(Tables(spark, sf)).select("message_id", "user_id", "action", "type", "text", "ts")


@register("e2_route_unsupported", "WITH " + _ENV_SQL + """
SELECT action, type, count(*) AS n_events FROM e WHERE NOT (action = 'push' AND type = 'text') GROUP BY ALL
""")
def e2_route_unsupported(spark, sf):
    _, unsupported = E.route_events(_parsed(Tables(spark, sf)))
    return unsupported


@register("e2_route_answered", "WITH " + _ENV_SQL + """
SELECT message_id, user_id, text FROM e WHERE action = 'push' AND type = 'text'
""")
def e2_route_answered(spark, sf):
    answered, _ = E.route_events(_parsed(Tables(spark, sf)))
    return answered.select("message_id", "user_id", "text")


@register("e3_extract_mentions", "WITH " + _ENV_SQL + r"""
SELECT message_id, unnest(regexp_extract_all(text, '\$\{@!(\d+)\}', 1)) AS mention_id
FROM e WHERE action = 'push' AND type = 'text'
""")
def e3_extract_mentions(spark, sf):
    answered, _ = E.route_events(_parsed(Tables(spark, sf)))
    return E.extract_mentions(answered).select("message_id", "mention_id")


E4_LIMIT, E4_MC = 60, 2


@register("e4_stream_memory", f"""
WITH m AS (SELECT user_id, ts, event_id, 'user' AS role, event_type || ' ' || props AS content FROM events),
w AS (SELECT *, sum(length(content)) OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC
                                           ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS tok,
        coalesce(count(*) OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC
                                ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS prior FROM m),
k AS (SELECT * FROM w WHERE tok <= {E4_LIMIT} AND prior < {2 * E4_MC})
SELECT user_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS INTEGER) AS pos,
       role, content FROM k
""")
def e4_stream_memory(spark, sf):
    """Structured Streaming over the events file (availableNow), state per user, sink and
    checkpoint in the shared checkpoint folder; the final window per user is read back."""
    schema = Tables(spark, sf).events.schema
    src = (spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
           .select("user_id", "ts", "event_id", F.lit("user").alias("role"),
                   F.concat(F.col("event_type"), F.lit(" "), F.col("props")).alias("content")))
    out = stream_memory(src, token_limit=E4_LIMIT, max_conversations=E4_MC, ttl_ms=None)
    run = scratch_path(spark, f"e4-{uuid.uuid4().hex}")
    with use_state_store(spark):
        q = (out.writeStream.format("parquet").option("path", os.path.join(run, "out"))
             .option("checkpointLocation", os.path.join(run, "ckpt")).outputMode("append")
             .trigger(availableNow=True).start())
        q.awaitTermination()
    res = spark.read.parquet(os.path.join(run, "out"))
    last = res.groupBy("user_id").agg(F.max("version").alias("version"))
    return res.join(last, ["user_id", "version"]).select("user_id", "pos", "role", "content")
