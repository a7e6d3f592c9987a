"""Registered chat-memory queries (M1-M14) over ``conversations`` and ``events``."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import memory as M
from ..session import stored
from .registry import Tables, register

_LOG = ["conv_id", "turn", "role", "text"]


@register("m1_set_messages", """
SELECT conv_id, turn, role, text FROM conversations
WHERE conv_id NOT IN (SELECT conv_id FROM conversations WHERE role = 'user')
UNION ALL
SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS turn, role, text
FROM conversations WHERE role = 'user'
""")
def m1_set_messages(spark, sf):
    log = Tables(spark, sf).conversations.select(*_LOG)
    new = log.where(F.col("role") == "user")  # new list per key: its user messages only
    return M.set_messages(log, new)


@register("m2_range_read", """
SELECT c.conv_id, c.turn, c.role, c.text FROM conversations c
JOIN (SELECT conv_id, max(turn) + 1 AS n FROM conversations GROUP BY conv_id) s USING (conv_id)
WHERE c.turn >= greatest(s.n - 4, 0) AND c.turn <= least(s.n - 2, s.n - 1)
""")
def m2_range_read(spark, sf):
    return M.range_read(Tables(spark, sf).conversations.select(*_LOG), -4, -2)


@register("m3_add_message", """
WITH s AS (SELECT conv_id, max(turn) + 1 AS n FROM conversations GROUP BY conv_id),
nw AS (SELECT conv_id, 'system' AS role, 'turns: ' || CAST(n AS VARCHAR) AS text,
              CASE WHEN n - 1 >= 0 AND n - 1 < n THEN n - 1 ELSE n END AS ni FROM s)
SELECT c.conv_id, c.turn + CASE WHEN c.turn >= nw.ni THEN 1 ELSE 0 END AS turn, c.role, c.text
FROM conversations c JOIN nw USING (conv_id)
UNION ALL
SELECT conv_id, ni AS turn, role, text FROM nw
""")
def m3_add_message(spark, sf):
    log = Tables(spark, sf).conversations.select(*_LOG)
    new = (log.groupBy("conv_id").agg((F.max("turn") + 1).alias("n"))
           .select("conv_id", F.lit("system").alias("role"),
                   F.concat(F.lit("turns: "), F.col("n").cast("string")).alias("text"),
                   F.lit(-1).alias("idx")))
    return M.add_messages(log, new)


@register("m4_delete_key", """
SELECT conv_id, turn, role, text FROM conversations
WHERE conv_id NOT IN (SELECT conv_id FROM conversations WHERE role = 'system')
""")
def m4_delete_key(spark, sf):
    log = Tables(spark, sf).conversations.select(*_LOG)
    remaining, _deleted = M.delete_keys(log, log.where(F.col("role") == "system"))
    return remaining


@register("m5_delete_at", """
SELECT conv_id, CASE WHEN turn > 0 THEN turn - 1 ELSE turn END AS turn, role, text
FROM conversations WHERE turn <> 0
""")
def m5_delete_at(spark, sf):
    return M.delete_at(Tables(spark, sf).conversations.select(*_LOG), 0)


@register("m6_pop_last", """
SELECT c.conv_id, c.turn, c.role, c.text FROM conversations c
JOIN (SELECT conv_id, max(turn) AS m FROM conversations GROUP BY conv_id) s USING (conv_id)
WHERE c.turn < s.m
""")
def m6_pop_last(spark, sf):
    return M.pop_last(Tables(spark, sf).conversations.select(*_LOG))


@register("m7_list_keys", "SELECT DISTINCT conv_id FROM conversations")
def m7_list_keys(spark, sf):
    return M.list_keys(Tables(spark, sf).conversations)


@register("m8_expire", """
SELECT * FROM events WHERE user_id IN (
  SELECT user_id FROM events GROUP BY user_id
  HAVING max(ts) > TIMESTAMP '2024-01-30 00:00:00' - INTERVAL 2 DAY)
""")
def m8_expire(spark, sf):
    ev = Tables(spark, sf).events
    return M.expire(ev, "ts", 2 * 86400, "2024-01-30 00:00:00", key="user_id")


_M9_SQL = """
SELECT conv_id, turn, role, text FROM (
  SELECT *,
    sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn DESC
                            ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS tok,
    coalesce(sum(CASE WHEN role IN ('user', 'assistant') THEN 1 ELSE 0 END)
      OVER (PARTITION BY conv_id ORDER BY turn DESC
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS prior
  FROM conversations)
WHERE tok <= {limit} AND prior < {cap}
"""


@register("m9_history_window", _M9_SQL.format(limit=M.DEFAULT_TOKEN_LIMIT, cap=2 * M.DEFAULT_MAX_CONVERSATIONS))
def m9_history_window(spark, sf):
    return M.history_window(Tables(spark, sf).conversations.select(*_LOG))


@register("m9_history_window_tight", _M9_SQL.format(limit=1500, cap=2))
def m9_history_window_tight(spark, sf):
    return M.history_window(Tables(spark, sf).conversations.select(*_LOG), token_limit=1500, max_conversations=1)


@register("m10_initial_overflow", """
SELECT c.conv_id, c.turn, c.role, c.text FROM conversations c
JOIN (SELECT conv_id, max(turn) + 1 AS n FROM conversations GROUP BY conv_id) s USING (conv_id)
WHERE c.turn >= s.n - 3
""")
def m10_initial_overflow(spark, sf):
    return M.history_window(Tables(spark, sf).conversations.select(*_LOG), token_limit=100,
                            initial_token_count=101)


@register("m11_model_token_limit", _M9_SQL.format(limit=12288, cap=6))
def m11_model_token_limit(spark, sf):
    limit = M.model_token_limit("qwen-long")
    return M.history_window(Tables(spark, sf).conversations.select(*_LOG), token_limit=limit)


@register("m12_history_tokens", """
SELECT conv_id, CAST(sum(length(text)) + count(*) - 1 AS BIGINT) AS history_tokens
FROM conversations GROUP BY conv_id
""")
def m12_history_tokens(spark, sf):
    return M.history_tokens(Tables(spark, sf).conversations)


@register("m13_last_k_turns", """
SELECT c.conv_id, c.turn, c.role, c.text FROM conversations c
JOIN (SELECT conv_id, max(turn) + 1 AS n FROM conversations GROUP BY conv_id) s USING (conv_id)
WHERE c.turn >= s.n - 4
""")
def m13_last_k_turns(spark, sf):
    return M.last_k_turns(Tables(spark, sf).conversations.select(*_LOG), k=2)


@register("m14_pack_messages", """
SELECT conv_id, turn,
  to_json({'message': {'role': role, 'content': text},
           'timestamp': CAST(1704067200 + conv_id * 3600 + turn * 60 AS BIGINT)}) AS packed
FROM conversations
""")
def m14_pack_messages(spark, sf):
    log = Tables(spark, sf).conversations.select(*_LOG)
    ts = F.timestamp_seconds(F.lit(1704067200) + F.col("conv_id") * 3600 + F.col("turn") * 60)
    return M.pack_messages(log, ts)


@register("m14_unpack_messages", """
SELECT conv_id, turn, role, text,
  make_timestamp(CAST(1704067200 + conv_id * 3600 + turn * 60 AS BIGINT) * 1000000) AS ts
FROM conversations
""")
def m14_unpack_messages(spark, sf):
    log = Tables(spark, sf).conversations.select(*_LOG)
    ts = F.timestamp_seconds(F.lit(1704067200) + F.col("conv_id") * 3600 + F.col("turn") * 60)
    return M.unpack_messages(M.pack_messages(log, ts)).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


#: Ids of found documents that go to every task at most.
MAX_BROADCAST_IDS = 1_000_000


def answer_prompts(spark, sf, k_retrieve: int = 16, k_context: int = 4):
    """Chat answer plan, batch form: for every conversation the last user message is the
    question, the messages before it are the bounded history (M9), documents are retrieved
    by sparse similarity (V8) and the top ``k_context`` become the context (V6); M15 then
    renders the condense prompt and the system prompt."""
    from ..operators import retrieval as V
    t = Tables(spark, sf)
    log = t.conversations.select(*_LOG)
    last_user = log.where(F.col("role") == "user").groupBy("conv_id").agg(
        F.max(F.struct("turn", "text")).alias("_q"))
    questions = last_user.select("conv_id", F.col("_q.turn").alias("q_turn"), F.col("_q.text").alias("question"))
    before = log.join(questions.select("conv_id", "q_turn"), "conv_id").where(F.col("turn") < F.col("q_turn")) \
        .drop("q_turn")
    history = M.history_window(before)
    idf = V.idf_table(t.documents)
    dtop = V.sparse_top_n(V.sparse_encoding(t.documents, idf))
    q = questions.select(F.col("conv_id").alias("qid"), F.col("question").alias("text"))
    qtop = V.sparse_top_n(V.sparse_encoding(q, idf, key="qid"), key="qid")
    cands = V.sparse_topk(qtop, dtop, k=k_retrieve).withColumnRenamed("doc_id", "id")
    top = stored(V.rerank(cands, cands.select("qid", "id", "score"), k=k_context))
    texts = t.documents.select(F.col("doc_id").alias("id"), F.col("text").alias("ctx_text"))
    found = top.select("id").distinct()
    if found.count() <= MAX_BROADCAST_IDS:  # only texts that were found are shuffled
        texts = texts.join(F.broadcast(found), "id", "left_semi")
    ctx = top.join(texts, "id") \
        .select(F.col("qid").alias("conv_id"), "rank", "ctx_text")
    return M.assemble_prompts(questions, history, ctx)


@register("m15_assemble_prompts")
def m15_assemble_prompts(spark, sf):
    return answer_prompts(spark, sf)
