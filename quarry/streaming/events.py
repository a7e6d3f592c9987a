"""Bot push events (E1-E3): the same column logic serves batch and streaming DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ENVELOPE_SCHEMA = ("action STRING, ack LONG, seq LONG, status BOOLEAN, "
                   "data STRUCT<content: STRING, time: LONG, user_id: STRING, channel_id: STRING, "
                   "message_id: STRING, guild_id: STRING, channel_type: INT, resource_type: STRING, "
                   "platform: STRING, `desc`: STRING>")
CONTENT_SCHEMA = "type STRING, text STRING, contentType INT"
MENTION_PATTERN = r"\$\{@!(\d+)\}"


def parse_events(df: DataFrame, raw: str = "raw") -> DataFrame:
    """Envelope JSON, then the JSON string inside ``data.content``; ``time`` (epoch ms) → TIMESTAMP."""
    env = df.select(F.from_json(F.col(raw), ENVELOPE_SCHEMA).alias("e"))
    return env.select(
        F.col("e.action").alias("action"),
        F.from_json(F.col("e.data.content"), CONTENT_SCHEMA).alias("content"),
        F.timestamp_millis(F.col("e.data.time")).alias("ts"),
        F.col("e.data.user_id").alias("user_id"), F.col("e.data.channel_id").alias("channel_id"),
        F.col("e.data.message_id").alias("message_id"),
    ).select("action", F.col("content.type").alias("type"), F.col("content.text").alias("text"), "ts", "user_id",
             "channel_id", "message_id")


def route_events(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(text messages to answer, counts of everything else by action and type).

    Only ``push`` events of type ``text`` are answered; connect/pong and other content
    types are counted as unsupported.
    """
    is_text = (F.col("action") == "push") & (F.col("type") == "text")
    answered = parsed.where(is_text)
    unsupported = parsed.where(~F.coalesce(is_text, F.lit(False))).groupBy("action", "type") \
        .agg(F.count(F.lit(1)).alias("n_events"))
    return answered, unsupported


def extract_mentions(df: DataFrame, text: str = "text") -> DataFrame:
    """One row per ``${@!<id>}`` mention in the text."""
    return df.withColumn("mention_id", F.explode(F.regexp_extract_all(F.col(text), F.lit(MENTION_PATTERN), 1)))


def envelope_from_columns(action, ctype, text, time_ms, user_id, channel_id, message_id):
    """Build the push envelope JSON (``data.content`` is itself a JSON string) from columns."""
    content = F.to_json(F.struct(ctype.alias("type"), text.alias("text"), F.lit(0).alias("contentType")))
    data = F.struct(content.alias("content"), time_ms.alias("time"), user_id.alias("user_id"),
                    channel_id.alias("channel_id"), message_id.alias("message_id"))
    return F.to_json(F.struct(action.alias("action"), data.alias("data"), F.lit(-1).alias("ack"),
                              F.lit(True).alias("status")))
