"""Per-user rolling chat memory on a stream, with key expiry (M8).

Each user's messages arrive over micro-batches and Arrow batches, in any order. The state of a user is a list of messages in
RocksDB that new messages are appended to; it is rewritten only when messages fall out. A message can fall out for good
when it is neither in the bounded history (M9) nor the newest message outside it, which keeps older latecomers out. The
list is therefore bounded by ``token_limit`` and ``2 × max_conversations`` chat messages, plus one.

With ``ttl_ms`` a user silent that long is forgotten: a mark with that time to live is renewed by every write, and a user
whose mark has gone starts anew. The list lives twice as long and is renewed once its age passes ``ttl_ms``, so an
active user's messages never expire and a silent one's are removed by the state store itself.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.memory import CHAT_ROLES, DEFAULT_MAX_CONVERSATIONS, DEFAULT_TOKEN_LIMIT

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER_SETTING = "spark.sql.streaming.stateStore.providerClass"
MESSAGE_SCHEMA = "at array<long>, role string, content string"
OUTPUT_SCHEMA = "user_id LONG, version LONG, pos INT, role STRING, content STRING"


def window_of(messages: list[dict], token_limit: int, max_conversations: int) -> list[dict]:
    """M9 over a list, oldest first: the longest end of it whose tokens, counted from the newest on, stay within the
    limit, and before whose oldest message fewer than ``2 × max_conversations`` chat messages stand."""
    newest = messages[::-1]
    tokens = accumulate(len(m["content"] or "") for m in newest)
    chats = accumulate((m["role"] in CHAT_ROLES for m in newest), initial=0)
    fits = [t <= token_limit and c < 2 * max_conversations for t, c in zip(tokens, chats)]
    n = fits.index(False) if False in fits else len(fits)
    return messages[len(messages) - n:]


def still_needed(messages: list[dict], token_limit: int, max_conversations: int) -> list[dict]:
    """The window and the message just before it, of messages in order."""
    return messages[-(len(window_of(messages, token_limit, max_conversations)) + 1):]


def _sortable(column: pd.Series) -> list:
    return (column.astype("int64") if pd.api.types.is_datetime64_any_dtype(column) else column).tolist()


class RollingMemory(StatefulProcessor):
    """Emits a user's current window after every micro-batch that touched the user."""

    def __init__(self, token_limit: int, max_conversations: int, ttl_ms: int | None, order: tuple[str, ...]):
        self.limits, self.ttl, self.order = (token_limit, max_conversations), ttl_ms, order

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.messages = handle.getListState("messages", MESSAGE_SCHEMA, ttlDurationMs=None if self.ttl is None else 2 * self.ttl)
        self.mark = handle.getValueState("mark", "version long, written long", ttlDurationMs=self.ttl)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        now = 0 if self.ttl is None else timerValues.getCurrentProcessingTimeInMs()
        mark = self.mark.get()
        version, written = mark if mark is not None else (0, now)
        known = [{"at": list(at), "role": r, "content": c} for at, r, c in self.messages.get()] if mark is not None else []
        held, new = known, []
        for pdf in rows:
            at = zip(*(_sortable(pdf[c]) for c in self.order))
            batch = [{"at": list(a), "role": r, "content": c} for a, r, c in zip(at, pdf["role"], pdf["content"])]
            new += batch
            held = still_needed(sorted([*held, *batch], key=lambda m: m["at"]), *self.limits)
            version += len(batch)
        if mark is None or len(held) < len(known) + len(new) or self.ttl is not None and now - written > self.ttl:
            self.messages.put([self.row(m) for m in held])
            written = now
        else:
            self.messages.appendList([self.row(m) for m in new])
        self.mark.update((version, written))
        window = window_of(held, *self.limits)
        yield pd.DataFrame({"user_id": [key[0]] * len(window), "version": [version] * len(window), "pos": list(range(len(window))),
                            "role": [m["role"] for m in window], "content": [m["content"] for m in window]})

    @staticmethod
    def row(message: dict) -> tuple:
        return message["at"], message["role"], message["content"]

    def close(self) -> None:
        pass


def stream_memory(messages: DataFrame, token_limit: int = DEFAULT_TOKEN_LIMIT,
                  max_conversations: int = DEFAULT_MAX_CONVERSATIONS, ttl_ms: int | None = None,
                  key: str = "user_id", order: tuple[str, ...] = ("ts", "event_id")) -> DataFrame:
    """Rolling bounded history per user: emits ``(user_id, version, pos, role, content)`` for the
    current window after every micro-batch that touched the user. The session's state store provider must be
    :data:`STATE_STORE` when the query starts (:func:`use_state_store`)."""
    return messages.groupBy(key).transformWithStateInPandas(
        RollingMemory(token_limit, max_conversations, ttl_ms, order), OUTPUT_SCHEMA, "Append",
        "None" if ttl_ms is None else "ProcessingTime")


class use_state_store:
    """Within it, queries start with the settings that :func:`stream_memory` needs: the RocksDB state store, and no batches
    without data, which a time to live would call for without end. The session's own settings hold again afterwards."""

    SETTINGS = {PROVIDER_SETTING: STATE_STORE, "spark.sql.streaming.noDataMicroBatches.enabled": "false"}

    def __init__(self, spark):
        self.spark = spark

    def __enter__(self):
        self.before = {k: self.spark.conf.get(k, None) for k in self.SETTINGS}
        for k, v in self.SETTINGS.items():
            self.spark.conf.set(k, v)

    def __exit__(self, *error):
        for k, v in self.before.items():
            if v is None:
                self.spark.conf.unset(k)
            else:
                self.spark.conf.set(k, v)
