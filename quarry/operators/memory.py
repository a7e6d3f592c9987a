"""Chat memory: a message log table ``(key, pos, role, content)`` with list semantics.

``pos`` is the 0-based list index inside a key (dense). Every operator returns a log in
the same form, so operators chain with ``DataFrame.transform``. Per-key sizes come from
plain aggregations and ordered scans from :func:`quarry.operators.scan.running_totals`,
so a single very long chat log never lands in one task.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scan import DEFAULT_BLOCK, null_safe_join, running_totals

KEY, POS, ROLE, CONTENT = "conv_id", "turn", "role", "text"

# Fixed values that must match the reference behaviour.
DEFAULT_TOKEN_LIMIT = 6144          # memory buffer default token limit
DEFAULT_MAX_CONVERSATIONS = 3       # user/assistant exchanges kept
FALLBACK_TOKEN_LIMIT = 3000         # when the model context window is unknown
TOKEN_LIMIT_RATIO = 0.75            # share of the context window given to history
UNKNOWN_MODEL_CONTEXT = 4096        # context window assumed for unlisted models
MODEL_CONTEXT_WINDOWS = {"deepseek-chat": 32768, "qwen-long": 16384}
INITIAL_OVERFLOW_KEEP = 3           # messages returned when the initial prompt already overflows
CHAT_ROLES = ("user", "assistant")  # roles counted against max_conversations


def char_tokens(c: Column) -> Column:
    """Default tokenizer: one token per character (code point)."""
    return F.length(c)


def _sizes(log: DataFrame, key: str, pos: str) -> DataFrame:
    return log.groupBy(key).agg((F.max(pos) + 1).alias("_n"))


def renumber(log: DataFrame, key: str = KEY, pos: str = POS, tiebreak: tuple = ()) -> DataFrame:
    """Make ``pos`` dense 0..n-1 per key, keeping the current order."""
    d = running_totals(log, [key], pos, {"_rank": F.lit(1)}, tiebreak=tiebreak)
    return d.withColumn(pos, (F.col("_rank") - 1).cast("long")).drop("_rank")


def set_messages(log: DataFrame, new: DataFrame, key: str = KEY, pos: str = POS) -> DataFrame:
    """M1: every key present in ``new`` has its messages replaced by the new ones."""
    replaced = new.select(key).distinct()
    kept = null_safe_join(log, replaced, [key], "left_anti")
    return kept.unionByName(renumber(new.select(*log.columns), key, pos))


def range_read(log: DataFrame, start: int = 0, end: int = -1, key: str = KEY, pos: str = POS) -> DataFrame:
    """M2: inclusive list range with negative indexes counted from the end (LRANGE)."""
    n = F.col("_n")
    s = F.greatest(F.lit(start) + n if start < 0 else F.lit(start), F.lit(0))
    e = F.least(F.lit(end) + n if end < 0 else F.lit(end), n - 1)
    d = null_safe_join(log, _sizes(log, key, pos), [key])
    return d.where((F.col(pos) >= s) & (F.col(pos) <= e)).drop("_n")


def add_messages(log: DataFrame, new: DataFrame, idx: str = "idx", seq: str | None = None,
                 key: str = KEY, pos: str = POS) -> DataFrame:
    """M3: insert each new message before list index ``idx`` (negative from the end).

    A null or missing index appends. Several inserts on one key are applied in ``seq``
    order; inserts at the same index keep that order.
    """
    cols = [c for c in log.columns if c != pos]
    sizes = _sizes(log, key, pos)
    nw = null_safe_join(new, sizes, [key], "left").withColumn("_n", F.coalesce("_n", F.lit(0)))
    raw = F.col(idx)
    ni = F.when(raw < 0, raw + F.col("_n")).otherwise(raw)
    ni = F.when(raw.isNull() | (ni < 0) | (ni >= F.col("_n")), F.col("_n")).otherwise(ni)
    nw = nw.select(*cols, ni.cast("long").alias(pos), F.lit(0).alias("_kind"),
                   (F.col(seq) if seq else F.lit(0)).cast("long").alias("_seq"), F.lit(1).alias("_new"))
    old = log.select(*cols, F.col(pos).cast("long").alias(pos), F.lit(1).alias("_kind"),
                     F.lit(0).cast("long").alias("_seq"), F.lit(0).alias("_new"))
    u = old.unionByName(nw)
    d = running_totals(u, [key], pos, {"_cnew": F.col("_new")}, tiebreak=(F.col("_kind"), F.col("_seq")))
    d = d.withColumn(pos, F.col(pos) + F.col("_cnew") - F.col("_new"))
    return d.select(*log.columns)


def delete_keys(log: DataFrame, keys: DataFrame, key: str = KEY) -> tuple[DataFrame, DataFrame]:
    """M4: drop every message of the listed keys; returns (remaining log, deleted rows)."""
    k = keys.select(key).distinct()
    return null_safe_join(log, k, [key], "left_anti"), null_safe_join(log, k, [key], "left_semi")


def delete_at(log: DataFrame, index: int, key: str = KEY, pos: str = POS) -> DataFrame:
    """M5: delete the message at list index ``index`` (negative from the end); missing → no-op."""
    n = F.col("_n")
    at = (F.lit(index) + n) if index < 0 else F.lit(index)
    d = null_safe_join(log, _sizes(log, key, pos), [key]).withColumn("_at", at)
    d = d.where(F.col(pos) != F.col("_at"))
    d = d.withColumn(pos, F.when((F.col(pos) > F.col("_at")) & (F.col("_at") >= 0), F.col(pos) - 1)
                     .otherwise(F.col(pos)))
    return d.drop("_n", "_at")


def pop_last(log: DataFrame, key: str = KEY, pos: str = POS) -> DataFrame:
    """M6: remove the last message of every key."""
    d = null_safe_join(log, _sizes(log, key, pos), [key])
    return d.where(F.col(pos) < F.col("_n") - 1).drop("_n")


def list_keys(log: DataFrame, key: str = KEY) -> DataFrame:
    """M7: the distinct keys of the log."""
    return log.select(key).distinct()


def expire(log: DataFrame, ts: str, ttl_seconds: int, now, key: str = KEY) -> DataFrame:
    """M8: keep whole keys whose last write is newer than ``now - ttl`` (TTL refreshed per write)."""
    live = (log.groupBy(key).agg(F.max(ts).alias("_last"))
            .where(F.col("_last") > F.lit(now).cast("timestamp_ntz") - F.expr(f"INTERVAL {int(ttl_seconds)} SECONDS"))
            .select(key))
    return null_safe_join(log, live, [key], "left_semi")


def history_window(log: DataFrame, token_limit: int = DEFAULT_TOKEN_LIMIT,
                   max_conversations: int = DEFAULT_MAX_CONVERSATIONS,
                   token_fn: Callable[[Column], Column] = char_tokens, initial_token_count: int = 0,
                   key: str = KEY, pos: str = POS, role: str = ROLE, content: str = CONTENT,
                   block: int = DEFAULT_BLOCK) -> DataFrame:
    """Bounded chat history per key.

    Walk from the newest message backwards, keeping messages while the token total stays
    within ``token_limit`` and fewer than ``2 * max_conversations`` user/assistant
    messages were kept before (other roles ride along). Because token counts are never
    negative, the kept set is exactly the newest-first prefix where
    ``running_tokens <= limit AND prior_chat_messages < 2 * max_conversations``.
    If ``initial_token_count`` already exceeds the limit, the last three messages are
    returned instead (M10).
    """
    if token_limit < 1:
        raise ValueError("token_limit must be >= 1")
    if initial_token_count > token_limit:
        d = null_safe_join(log, _sizes(log, key, pos), [key])
        return d.where(F.col(pos) >= F.col("_n") - INITIAL_OVERFLOW_KEEP).drop("_n")
    is_chat = F.col(role).isin(*CHAT_ROLES).cast("long")
    cap = 2 * max_conversations
    d = running_totals(
        log, [key], pos, {"_tok": token_fn(F.col(content)).cast("long"), "_chat": is_chat},
        descending=True, block=block,
        prefilter=lambda off: (off["_tok"] <= token_limit) & (off["_chat"] < cap))
    prior = F.col("_chat") - is_chat
    return d.where((F.col("_tok") <= token_limit) & (prior < cap)).drop("_tok", "_chat")


def token_limit_for(model: Column) -> Column:
    """History budget for a model = 0.75 × context window (unlisted → 4096 window).

    ``token_limit_for(None)`` (no model) gives the fixed fallback of 3000.
    """
    m = F.create_map(*[x for k, v in MODEL_CONTEXT_WINDOWS.items() for x in (F.lit(k), F.lit(v))])
    ctx = F.coalesce(F.element_at(m, model), F.lit(UNKNOWN_MODEL_CONTEXT))
    return F.when(model.isNull(), F.lit(FALLBACK_TOKEN_LIMIT)).otherwise(
        F.floor(ctx * F.lit(TOKEN_LIMIT_RATIO))).cast("long")


def model_token_limit(model: str | None) -> int:
    """M11 for a single configured model name (driver-side constant)."""
    if model is None:
        return FALLBACK_TOKEN_LIMIT
    return int(MODEL_CONTEXT_WINDOWS.get(model, UNKNOWN_MODEL_CONTEXT) * TOKEN_LIMIT_RATIO)


def history_tokens(log: DataFrame, key: str = KEY, content: str = CONTENT) -> DataFrame:
    """Token count of a whole history joined by single spaces (character tokens)."""
    return log.groupBy(key).agg(
        (F.sum(F.length(content)) + F.count(F.lit(1)) - 1).cast("long").alias("history_tokens"))


def last_k_turns(log: DataFrame, k: int = 5, key: str = KEY, pos: str = POS) -> DataFrame:
    """The last ``2k`` messages of every key; ``k = 0`` gives none."""
    if k <= 0:
        return log.limit(0)
    d = null_safe_join(log, _sizes(log, key, pos), [key])
    return d.where(F.col(pos) >= F.col("_n") - 2 * k).drop("_n")


def pack_messages(log: DataFrame, ts: Column, role: str = ROLE, content: str = CONTENT,
                  out: str = "packed") -> DataFrame:
    """Store form ``{"message": {"role", "content"}, "timestamp": epoch seconds}``."""
    body = F.struct(F.struct(F.col(role).alias("role"), F.col(content).alias("content")).alias("message"),
                    F.unix_timestamp(ts).alias("timestamp"))
    return log.withColumn(out, F.to_json(body)).drop(role, content)


PACKED_SCHEMA = "message STRUCT<role: STRING, content: STRING>, timestamp BIGINT"


def unpack_messages(df: DataFrame, packed: str = "packed", role: str = ROLE, content: str = CONTENT) -> DataFrame:
    """Inverse of :func:`pack_messages`; the timestamp comes back as TIMESTAMP."""
    p = F.from_json(F.col(packed), PACKED_SCHEMA)
    return (df.withColumn("_p", p)
            .select(*[c for c in df.columns if c != packed],
                    F.col("_p.message.role").alias(role), F.col("_p.message.content").alias(content),
                    F.timestamp_seconds(F.col("_p.timestamp")).alias("ts")))


# Fixed prompt templates (context assembly); they must equal the reference wording.
CONDENSE_TEMPLATE = (
    "下面是用户与 AI 助手之间的对话，将用户的问题重写为清晰、严谨的独立问题（使其与历史聊天无关）。\n"
    "\n"
    "对话历史:\n"
    "---------------------\n"
    "{chat_history}\n"
    "---------------------\n"
    "\n"
    "问题: {question}\n"
    "重写问题: "
)
CONTEXT_SYSTEM_TEMPLATE = (
    "你是认真、负责、热情、可爱、积极向上的 AI 游戏助手。你的职责是，依据参考资料，为玩家提供有趣、有帮助、有建设性的游戏指引。\n"
    "1. 每个来自用户的好评，会让你获得 100 元的奖励。\n"
    "2. 回答时，禁止直接引用参考资料。\n"
    "3. 回答时，禁止提及参考资料来源，比如`根据参考材料...`，`根据网页/某用户的博客...`。\n"
    "4. 若给定参考资料无法回答问题，可依据你的知识进行回答。\n"
    "\n"
    "参考资料：\n"
    "---------------------\n"
    "{context_str}\n"
    "---------------------\n"
)


def _fill(template: str, **cols: Column) -> Column:
    """Substitute ``{name}`` placeholders with columns (template split once on the driver)."""
    parts: list[Column] = []
    rest = template
    while rest:
        i = rest.find("{")
        j = rest.find("}", i)
        if i < 0 or j < 0:
            parts.append(F.lit(rest))
            break
        name = rest[i + 1:j]
        if name in cols:
            parts.append(F.lit(rest[:i]))
            parts.append(F.coalesce(cols[name], F.lit("")))
        else:
            parts.append(F.lit(rest[:j + 1]))
        rest = rest[j + 1:]
    return F.concat(*parts)


def ordered_concat(df: DataFrame, keys: list[str], order: str, text: Column, sep: str, out: str) -> DataFrame:
    """``string_agg(text, sep ORDER BY order)`` per key."""
    return df.groupBy(*keys).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), text.alias("t")))),
                                 lambda s: s["t"]), sep).alias(out))


def assemble_prompts(questions: DataFrame, history: DataFrame, context: DataFrame,
                     key: str = KEY, pos: str = POS, role: str = ROLE, content: str = CONTENT,
                     question: str = "question", rank: str = "rank", ctx_text: str = "ctx_text") -> DataFrame:
    """Condense prompt (history + question) and system prompt with retrieved context.

    History lines are ``role: content`` joined by newlines in list order; context passages
    are joined by a blank line in rank order. History and context must already be bounded
    (M9 and the top-k retrieval), so each per-key list is small.
    """
    h = ordered_concat(history, [key], pos, F.concat_ws(": ", F.col(role), F.col(content)), "\n", "_hist")
    c = ordered_concat(context, [key], rank, F.col(ctx_text), "\n\n", "_ctx")
    q = questions.join(h, on=key, how="left").join(c, on=key, how="left")
    return q.select(key, _fill(CONDENSE_TEMPLATE, chat_history=F.col("_hist"), question=F.col(question))
                    .alias("condense_prompt"),
                    _fill(CONTEXT_SYSTEM_TEMPLATE, context_str=F.col("_ctx")).alias("system_prompt"))
