"""Token-bounded chat split (D14) by cuts instead of a walk.

A part can only begin at message 0 or after an assistant message, so the segments between these places are the units.
Running costs tell where a part that begins at a segment would overflow: the first message whose running cost passes
a known bound, found by an ordered lookup within blocks of cost. That gives each segment the segment where the next part
begins, and pointer doubling over these links marks the beginnings that a walk from message 0 would meet, in as many
rounds as the logarithm of the longest chat's parts. Every step is a join or window on (chat, block), so one chat of
millions of messages is spread over tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored
from .scan import DEFAULT_BLOCK, running_totals

#: Template cost of a message by role; other roles have none.
ROLE_COST = {"system": 5, "user": 5, "assistant": 3}
#: Cost that a block of the ordered lookup spans, as a multiple of the bound.
SPAN = 16


def _beside(df: DataFrame, chats: DataFrame, pos: str) -> DataFrame:
    """``df`` with the columns of ``chats`` (one row a chat, ``n`` messages), met by blocks of positions."""
    block = F.floor(F.col(pos) / F.lit(DEFAULT_BLOCK)).cast("long")
    spread = chats.withColumn("_b", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("n") / F.lit(DEFAULT_BLOCK)).cast("long"))))
    return df.withColumn("_b", block).join(spread.drop("n"), ["_k", "_b"], "left").drop("_b")


def _first_above(values: DataFrame, bounds: DataFrame, span: int) -> DataFrame:
    """(_k, id, i, c): for each bound (_k, lane, id, x) the first message (_k, lane, i, c, x) of its lane with a greater x; x rises
    with i. Null where there is none."""
    block = F.floor(F.col("x") / F.lit(span)).cast("long").alias("block")
    found = F.struct("i", "c").alias("found")
    rows = values.select("_k", "lane", block, "x", F.lit(1).alias("rank"), found, F.lit(None).cast("long").alias("id"))
    asks = bounds.select("_k", "lane", block, "x", F.lit(0).alias("rank"), F.lit(None).cast(rows.schema["found"].dataType).alias(
        "found"), "id")
    # within a block: the last message met going down; at equal x the bound comes later, its message isn't above it
    down = Window.partitionBy("_k", "lane", "block").orderBy(F.desc("x"), F.asc("rank"), F.desc("found.i"))
    both = rows.unionByName(asks).withColumn("here", F.last("found", ignorenulls=True).over(down.rowsBetween(
        Window.unboundedPreceding, 0)))
    # else the first message of a later block
    firsts = both.groupBy("_k", "lane", "block").agg(F.min("found").alias("first"))
    after = Window.partitionBy("_k", "lane").orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    later = firsts.select("_k", "lane", "block", F.last("first", ignorenulls=True).over(after).alias("later"))
    out = both.where("rank = 0").join(later.hint("shuffle_hash"), ["_k", "lane", "block"])
    hit = F.coalesce("here", "later")
    return out.select("_k", "id", hit["i"].alias("i"), hit["c"].alias("c"))


def _reached(links: DataFrame) -> DataFrame:
    """(_k, id): segment 0 of every chat and those that following ``links`` (_k, id, next: null at the end) leads to."""
    reached = links.where("id = 0").select("_k", "id")
    jumps = stored(links.where("next IS NOT NULL").select("_k", "id", "next"))
    while True:
        new = stored(reached.join(jumps, ["_k", "id"]).select("_k", F.col("next").alias("id")))
        if not new.limit(1).count():
            return reached
        reached = reached.unionByName(new)
        ahead = jumps.select("_k", F.col("id").alias("next"), F.col("next").alias("then"))
        jumps = stored(jumps.join(ahead, ["_k", "next"]).select("_k", "id", F.col("then").alias("next")))


def split_chats(msgs: DataFrame, max_tokens: int, key: str = "chat_id", msg_no: str = "msg_no", role: str = "role",
                content: str = "content", role_cost: dict[str, int] | None = None, separator_cost: int = 1) -> DataFrame:
    """``(key, part_no, msg_no, role, content, oversize)``: chats in parts of at most ``max_tokens`` tokens.

    From the beginning of a part the cost runs on: the chat's system message once, each message's characters with its
    role's template, a separator before every second message after the first. Where it passes ``max_tokens``, the part
    ends after the last assistant message before that place, its first message not counted; the next part begins there. If
    there is none, the rest of the chat is one part with ``oversize`` true. A chat's first message, if it is a system message,
    opens every part and is no message otherwise. A null content costs its template alone; a null chat id is a chat.
    ``msg_no`` is unique in a chat.
    """
    cost = ROLE_COST if role_cost is None else role_cost
    base = msgs.select(F.struct(F.col(key)).alias("_k"), F.col(msg_no).alias("no"), F.col(role).alias("role"), F.col(
        content).alias("content"))
    price = F.coalesce(*[F.when(F.col("role") == r, F.lit(c)) for r, c in cost.items()], F.lit(0)) if cost else F.lit(0)
    slim = base.select("_k", "no", "role", (price + F.coalesce(F.length("content"), F.lit(0))).cast("long").alias("cost"))
    chats = slim.groupBy("_k").agg(F.min(F.struct("no", "role", "cost")).alias("first"), F.count(F.lit(1)).alias("n"))
    opens = F.col("first.role") == "system"
    chats = stored(chats.select("_k", "n", F.when(opens, F.col("first.no")).alias("system"), F.when(opens, F.col("first.cost")).otherwise(
        F.lit(0)).alias("system_cost")))
    ranked = running_totals(slim, ["_k"], "no", {"at": F.lit(1)})
    ranked = _beside(ranked, chats, "at").where(F.col("system").isNull() | (F.col("no") != F.col("system")))
    ranked = ranked.withColumn("i", (F.col("at") - F.when(F.col("system").isNull(), 1).otherwise(2)).cast("long"))
    is_a = (F.col("role") == "assistant").cast("long")
    walk = running_totals(ranked, ["_k"], "i", {"total": F.col("cost"), "answers": is_a})
    walk = stored(walk.select("_k", "no", "i", "total", "cost", (F.col("answers") - is_a).alias("c"), is_a.alias("a"), "system_cost"))

    # segment c begins at its first message; its lane is the parity of that place, for the separators
    begins = walk.groupBy("_k", "c").agg(F.min(F.struct("i", (F.col("total") - F.col("cost")).alias("before"), "a", "system_cost")).alias("s"))
    begins = begins.select("_k", F.col("c").alias("id"), "s.*", (F.col("s.i") % 2).alias("lane"))

    def with_separators(total: Column, i: Column, lane: Column) -> Column:
        return total + separator_cost * F.floor((i - lane) / F.lit(2))

    values = walk.select("_k", "i", "c", F.explode(F.array(F.lit(0).cast("long"), F.lit(1).cast("long"))).alias("lane"), "total").select(
        "_k", "i", "c", "lane", with_separators(F.col("total"), F.col("i"), F.col("lane")).alias("x"))
    bounds = begins.select("_k", "id", "lane", (with_separators(F.col("before"), F.col("i"), F.col("lane")) + max_tokens - F.col(
        "system_cost")).alias("x"))
    over = _first_above(values.where("i >= lane"), bounds, SPAN * max(max_tokens, 1))
    over = begins.select("_k", "id", F.col("i").alias("begin"), "a").join(over.withColumnRenamed("i", "over"), ["_k", "id"])
    # a bound below the beginning (a system message over the budget) overflows at once; the first message ends no part
    cuts = F.col("over").isNotNull() & (F.col("c") > F.col("id") + F.col("a"))
    links = stored(over.select("_k", "id", "begin", F.when(cuts, F.col("c")).alias("next"), (F.col("over").isNotNull() & ~cuts).alias("stuck")))

    parts = _reached(links).join(links.select("_k", "id", "begin", "stuck"), ["_k", "id"]).select(
        "_k", F.col("begin").alias("i"), F.lit(1).alias("opens"), F.col("stuck").cast("int").alias("stuck"))
    marked = walk.select("_k", "no", "i").join(parts, ["_k", "i"], "left")
    numbered = stored(running_totals(marked, ["_k"], "i", {"part": F.coalesce("opens", F.lit(0)), "late": F.coalesce("stuck", F.lit(0))}))
    place = ((F.col("part") - 1).cast("int").alias("part_no"), (F.col("late") > 0).alias("oversize"))
    own = numbered.select("_k", "no", *place)
    systems = _beside(numbered.where("opens = 1"), chats, "i").where(F.col("system").isNotNull()).select("_k", F.col("system").alias("no"), *place)
    # the opening message is one row of many parts: its parts are spread by their numbers
    texts = base.select("_k", "no", "role", "content")
    first = texts.join(chats.where("system IS NOT NULL").select("_k", F.col("system").alias("no"), "n"), ["_k", "no"])
    opened = _beside(systems.withColumn("at", F.col("part_no")), first.drop("no"), "at").drop("at")
    out = own.join(texts, ["_k", "no"]).unionByName(opened.select("_k", "no", "part_no", "oversize", "role", "content"))
    return out.select(F.col("_k").getField(key).alias(key), "part_no", F.col("no").alias(msg_no), F.col("role").alias(role), F.col(
        "content").alias(content), "oversize")
