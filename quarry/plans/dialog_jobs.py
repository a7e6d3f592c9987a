"""Registered dialogue and reply-parsing queries (D, L, S8) over ``conversations``.

A conversation is a dialogue: its lines are ``role：text`` (line breaks inside a message
become spaces), ordered by turn. The assistant is the character whose lines are
responses; a conversation's system message serves as its profile.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import dialog as D
from .registry import Tables, register

def _line():
    return F.concat(F.col("role"), F.lit("："), F.replace(F.col("text"), F.lit("\n"), F.lit(" ")))
_SQL_LINE = "role || '：' || replace(text, chr(10), ' ')"
_STRIP = r"regexp_replace({x}, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')"


def _lines(t):
    return t.conversations.select(F.col("conv_id").alias("dialog_id"), F.col("turn").alias("line_no"),
                                  _line().alias("line"))


def _dialogs(t):
    return D.ordered_join(_lines(t), ["dialog_id"], "line_no", F.col("line"), "\n", "dialog")


@register("d7_speaker_counts", f"""
WITH d AS (SELECT conv_id, string_agg({_SQL_LINE}, chr(10) ORDER BY turn) AS dialog FROM conversations GROUP BY conv_id),
l AS (SELECT unnest(string_split(dialog, chr(10))) AS line FROM d)
SELECT split_part(line, '：', 1) AS speaker, count(*) AS n_lines FROM l WHERE contains(line, '：') GROUP BY 1
""")
def d7_speaker_counts(spark, sf):
    return D.speaker_counts(_dialogs(Tables(spark, sf)))


_PAIRS_SQL = f"""
l AS (SELECT conv_id AS dialog_id, turn AS line_no, {_SQL_LINE} AS line FROM conversations),
a AS (SELECT *, starts_with(line, 'assistant：') AS isr,
             CASE WHEN contains(line, '：') THEN split_part(line, '：', 1) END AS spk FROM l),
b AS (SELECT *, sum(CASE WHEN NOT isr THEN 1 ELSE 0 END) OVER (PARTITION BY dialog_id ORDER BY line_no
                ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS nq FROM a),
c AS (SELECT *, coalesce(lag(isr) OVER w, false) AS prev_isr,
             coalesce(NOT lag(isr) OVER w, false) AS prev_q, lag(spk) OVER w AS prev_spk
      FROM b WHERE nq > 0 WINDOW w AS (PARTITION BY dialog_id ORDER BY line_no)),
e AS (SELECT *, coalesce(NOT isr AND prev_q AND spk IS NOT NULL AND spk = prev_spk, false) AS cont FROM c),
f AS (SELECT *, sum(CASE WHEN NOT isr AND prev_isr AND nq > 1 THEN 1 ELSE 0 END) OVER w AS turn_no,
             sum(CASE WHEN cont THEN 0 ELSE 1 END) OVER w AS blk
      FROM e WINDOW w AS (PARTITION BY dialog_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
qb AS (SELECT dialog_id, turn_no, blk, min(line_no) AS first,
              string_agg(CASE WHEN cont THEN replace(line, spk || '：', '') ELSE line END, '' ORDER BY line_no) AS qline
       FROM f WHERE NOT isr GROUP BY dialog_id, turn_no, blk),
q AS (SELECT dialog_id, turn_no, string_agg(qline, chr(10) ORDER BY first) AS query FROM qb GROUP BY ALL),
r AS (SELECT dialog_id, turn_no, string_agg({_STRIP.format(x="replace(line, 'assistant：', '')")}, '' ORDER BY line_no)
             AS response FROM f WHERE isr GROUP BY ALL),
pairs AS (SELECT dialog_id, CAST(turn_no AS INTEGER) AS turn_no, query, response FROM q JOIN r USING (dialog_id, turn_no))"""


def _pairs(t):
    return D.dialog_pairs(_lines(t), "assistant")


@register("d11_dialog_pairs", "WITH " + _PAIRS_SQL + "\nSELECT * FROM pairs")
def d11_dialog_pairs(spark, sf):
    return _pairs(Tables(spark, sf))


_MERGE_SQL = """
WITH f AS (SELECT conv_id AS folder, turn AS frag_no, role AS summary, {line} AS dialog FROM conversations {where}),
f2 AS (SELECT *, lag(summary) OVER (PARTITION BY folder ORDER BY frag_no) AS prev_summary,
              row_number() OVER (PARTITION BY folder ORDER BY frag_no) AS rn FROM f),
g AS (SELECT *, sum(CASE WHEN rn > 1 AND summary IS NOT DISTINCT FROM prev_summary THEN 0 ELSE 1 END)
                OVER (PARTITION BY folder ORDER BY frag_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS group_no
      FROM f2)
SELECT folder, CAST(group_no AS BIGINT) AS group_no, summary, string_agg(dialog, chr(10) ORDER BY frag_no) AS dialog
FROM g GROUP BY folder, group_no, summary HAVING summary <> ''
"""


def _frags(t):
    return t.conversations.select(F.col("conv_id").alias("folder"), F.col("turn").alias("frag_no"),
                                  F.col("role").alias("summary"), _line().alias("dialog"))


@register("d12_merge_by_summary", _MERGE_SQL.format(line=_SQL_LINE, where=""))
def d12_merge_by_summary(spark, sf):
    return D.merge_by_summary(_frags(Tables(spark, sf))).withColumn("group_no", F.col("group_no").cast("long"))


@register("d12_merge_by_summary_character",
          _MERGE_SQL.format(line=_SQL_LINE, where=f"WHERE contains({_SQL_LINE}, 'assistant：')"))
def d12_merge_by_summary_character(spark, sf):
    return D.merge_by_summary(_frags(Tables(spark, sf)), character="assistant") \
        .withColumn("group_no", F.col("group_no").cast("long"))


@register("s8_contiguous_prefix", """
WITH r AS (SELECT * FROM conversations WHERE role <> 'system'),
p AS (SELECT DISTINCT conv_id, turn FROM r),
cand AS (SELECT conv_id, turn + 1 AS i FROM p WHERE (conv_id, turn + 1) NOT IN (SELECT (conv_id, turn) FROM p)
         UNION ALL
         SELECT DISTINCT conv_id, 0 FROM p WHERE conv_id NOT IN (SELECT conv_id FROM p WHERE turn = 0)),
gap AS (SELECT conv_id, min(i) AS g FROM cand GROUP BY conv_id)
SELECT r.conv_id, r.turn, r.role, r.text FROM r JOIN gap USING (conv_id) WHERE r.turn < gap.g
""")
def s8_contiguous_prefix(spark, sf):
    c = Tables(spark, sf).conversations.select("conv_id", "turn", "role", "text").where(F.col("role") != "system")
    return D.contiguous_prefix(c, "conv_id", "turn")


_PROFILE_SQL = """
prof AS (SELECT conv_id, arg_min(text, turn) AS profile FROM conversations WHERE role = 'system' GROUP BY conv_id)"""


def _profiles(t):
    c = t.conversations.where(F.col("role") == "system")
    return c.groupBy(F.col("conv_id").alias("character")).agg(
        F.min(F.struct("turn", "text"))["text"].alias("profile"))


def _chats(t):
    pairs = _pairs(t).withColumn("character", F.col("dialog_id")).withColumnRenamed("dialog_id", "chat_id")
    return D.assemble_chats(pairs, _profiles(t), "question_answer")


@register("d13_assemble_chats", "WITH " + _PAIRS_SQL + "," + _PROFILE_SQL + """,
p AS (SELECT pairs.*, CAST(dense_rank() OVER (PARTITION BY dialog_id ORDER BY turn_no) - 1 AS BIGINT) AS i
      FROM pairs WHERE dialog_id IN (SELECT conv_id FROM prof))
SELECT conv_id AS chat_id, CAST(0 AS BIGINT) AS msg_no, 'system' AS role,
       profile || chr(10) || chr(10) || '你将与用户展开日常对话。' || chr(10) AS content
FROM prof WHERE conv_id IN (SELECT dialog_id FROM pairs)
UNION ALL SELECT dialog_id, 2 * i + 1, 'user', query FROM p
UNION ALL SELECT dialog_id, 2 * i + 2, 'assistant', response FROM p
""")
def d13_assemble_chats(spark, sf):
    return _chats(Tables(spark, sf))


#: Parts of chats (m: chat_id, i from 0, no, role, content; sy: chat_id, no, content of the opening system message): part after part,
#: the first message over the bound, then the last assistant message before it.
_SPLIT_SQL = """,
c AS (SELECT m.*, length(coalesce(m.content, '')) + CASE role WHEN 'system' THEN 5 WHEN 'user' THEN 5 WHEN 'assistant' THEN 3 ELSE 0 END AS cost,
  coalesce(5 + length(coalesce(sy.content, '')) + 0 * sy.no, 0) AS opening FROM m LEFT JOIN sy USING (chat_id)),
p AS (SELECT *, sum(cost) OVER (PARTITION BY chat_id ORDER BY i) AS total FROM c),
walk AS (
  SELECT DISTINCT chat_id, CAST(0 AS BIGINT) AS s, 0 AS part FROM c
  UNION ALL
  SELECT chat_id, cut + 1, part + 1 FROM (
    SELECT w.chat_id, w.part, (SELECT max(a.i) FROM p a WHERE a.chat_id = w.chat_id AND a.role = 'assistant' AND a.i > w.s AND a.i < o.i) AS cut
    FROM walk w JOIN (SELECT v.chat_id, v.s, min(q.i) AS i FROM walk v JOIN p b ON b.chat_id = v.chat_id AND b.i = v.s
      JOIN p q ON q.chat_id = v.chat_id AND q.i >= v.s WHERE q.opening + q.total - b.total + b.cost + (q.i - v.s) // 2 > {limit} GROUP BY 1, 2) o
      ON o.chat_id = w.chat_id AND o.s = w.s) WHERE cut IS NOT NULL),
ends AS (SELECT w.*, coalesce(lead(s) OVER (PARTITION BY chat_id ORDER BY part), 1000000000) AS e FROM walk w),
big AS (SELECT e.chat_id, e.part FROM ends e JOIN p b ON b.chat_id = e.chat_id AND b.i = e.s JOIN p q ON q.chat_id = e.chat_id AND q.i >= e.s
  WHERE e.e = 1000000000 GROUP BY 1, 2 HAVING max(q.opening + q.total - b.total + b.cost + (q.i - e.s) // 2) > {limit}),
flagged AS (SELECT e.*, b.part IS NOT NULL AS oversize FROM ends e LEFT JOIN big b ON b.chat_id = e.chat_id AND b.part = e.part)
SELECT f.chat_id, CAST(f.part AS INTEGER) AS part_no, c.no AS msg_no, c.role, c.content, f.oversize FROM flagged f JOIN c ON c.chat_id = f.chat_id
  AND c.i >= f.s AND c.i < f.e
UNION ALL SELECT f.chat_id, CAST(f.part AS INTEGER), sy.no, 'system', sy.content, f.oversize FROM flagged f JOIN sy ON sy.chat_id = f.chat_id
"""

#: Messages without an opening system message, numbered, and these messages, of a table t (chat_id, no, role, content).
_MESSAGES_SQL = """f AS (SELECT *, row_number() OVER (PARTITION BY chat_id ORDER BY no) AS r FROM t),
sy AS (SELECT chat_id, no, content FROM f WHERE r = 1 AND role = 'system'),
m AS (SELECT f.chat_id, f.no, f.role, f.content, row_number() OVER (PARTITION BY f.chat_id ORDER BY f.no) - 1 AS i FROM f LEFT JOIN sy
  ON sy.chat_id = f.chat_id AND sy.no = f.no WHERE sy.no IS NULL)"""


@register("d13_role_play_chats", "WITH " + _PAIRS_SQL + "," + _PROFILE_SQL + """,
plot AS (SELECT conv_id, arg_max(text, turn) AS plot FROM conversations WHERE role = 'user' GROUP BY conv_id),
p AS (SELECT pairs.*, CAST(dense_rank() OVER (PARTITION BY dialog_id ORDER BY turn_no) - 1 AS BIGINT) AS i
      FROM pairs WHERE dialog_id IN (SELECT conv_id FROM prof))
SELECT conv_id AS chat_id, CAST(0 AS BIGINT) AS msg_no, 'system' AS role, profile || chr(10) || chr(10) || '你将依照如下情节，与其他角色对话：' ||
  chr(10) || repeat('-', 21) || chr(10) || coalesce(plot, '') || chr(10) || repeat('-', 21) || chr(10) AS content
FROM prof LEFT JOIN plot USING (conv_id) WHERE conv_id IN (SELECT dialog_id FROM pairs)
UNION ALL SELECT dialog_id, 2 * i + 1, 'user', query FROM p
UNION ALL SELECT dialog_id, 2 * i + 2, 'assistant', response FROM p
""")
def d13_role_play_chats(spark, sf):
    """The last user text of a conversation stands for its plot."""
    t = Tables(spark, sf)
    plots = t.conversations.where(F.col("role") == "user").groupBy(F.col("conv_id").alias("dialog_id")).agg(
        F.max(F.struct("turn", "text"))["text"].alias("summary"))
    pairs = _pairs(t).join(plots, "dialog_id", "left").withColumn("character", F.col("dialog_id")).withColumnRenamed("dialog_id", "chat_id")
    return D.assemble_chats(pairs, _profiles(t), "role_play")


@register("d14_split_chats", "WITH RECURSIVE t AS (SELECT conv_id AS chat_id, turn AS no, role, text AS content FROM conversations), "
          + _MESSAGES_SQL + _SPLIT_SQL.format(limit=2000))
def d14_split_chats(spark, sf):
    t = Tables(spark, sf)
    msgs = t.conversations.select(F.col("conv_id").alias("chat_id"), F.col("turn").alias("msg_no"), "role",
                                  F.col("text").alias("content"))
    return D.split_chats(msgs, max_tokens=2000)


@register("d14_split_long_chats", """
WITH RECURSIVE t AS (SELECT user_id AS chat_id, event_id AS no, CASE event_type WHEN 'signup' THEN 'system' WHEN 'purchase' THEN 'assistant'
  WHEN 'click' THEN 'assistant' WHEN 'error' THEN 'tool' ELSE 'user' END AS role, repeat(props, CAST(floor(value) AS BIGINT) % 5) AS content FROM events),
""" + _MESSAGES_SQL + _SPLIT_SQL.format(limit=120))
def d14_split_long_chats(spark, sf):
    """Stand-in chats: a user's events are its messages, 67 on average; few tokens make many parts."""
    kind = F.col("event_type")
    role = F.when(kind == "signup", "system").when(kind.isin("purchase", "click"), "assistant").when(kind == "error", "tool").otherwise("user")
    msgs = Tables(spark, sf).events.select(F.col("user_id").alias("chat_id"), F.col("event_id").alias("msg_no"), role.alias("role"), F.repeat(
        "props", (F.floor("value") % 5).cast("int")).alias("content"))
    return D.split_chats(msgs, max_tokens=120)


@register("d15_training_rows", """
WITH m AS (SELECT conv_id AS chat_id, turn AS msg_no, role, text AS content FROM conversations),
ua AS (SELECT *, sum(CASE WHEN role = 'assistant' THEN 1 ELSE 0 END) OVER (PARTITION BY chat_id ORDER BY msg_no
         ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS s FROM m WHERE role IN ('user', 'assistant')),
seg AS (SELECT chat_id, coalesce(s, 0) AS seg,
               arg_max(content, msg_no) FILTER (WHERE role = 'user') AS input,
               max(content) FILTER (WHERE role = 'assistant') AS output
        FROM ua GROUP BY chat_id, coalesce(s, 0)),
t AS (SELECT chat_id, CAST(row_number() OVER (PARTITION BY chat_id ORDER BY seg) - 1 AS INTEGER) AS turn_no, input, output
      FROM seg WHERE input <> '' AND output <> ''),
sy AS (SELECT chat_id, arg_min(content, msg_no) AS sys FROM m WHERE role = 'system' GROUP BY chat_id)
SELECT t.chat_id, t.turn_no, CASE WHEN t.turn_no = 0 THEN sy.sys END AS system, t.input, t.output
FROM t LEFT JOIN sy USING (chat_id)
""")
def d15_training_rows(spark, sf):
    t = Tables(spark, sf)
    msgs = t.conversations.select(F.col("conv_id").alias("chat_id"), F.col("turn").alias("msg_no"), "role",
                                  F.col("text").alias("content"))
    return D.training_rows(msgs)


@register("d16_export_training_set")
def d16_export_training_set(spark, sf):
    """Chats → token-bounded parts → training rows → one JSON array per part (S10 row form)."""
    t = Tables(spark, sf)
    parts = D.split_chats(_chats(t), max_tokens=2000)
    keyed = parts.withColumn("chat_id", F.concat_ws("#", F.col("chat_id").cast("string"),
                                                    F.col("part_no").cast("string")))
    rows = D.training_rows(keyed)
    return D.ordered_join(rows, ["chat_id"], "turn_no",
                          F.to_json(F.struct("system", "input", "output")), ",", "_j") \
        .select("chat_id", F.concat(F.lit("["), F.col("_j"), F.lit("]")).alias("jsonl"))


_REPLY = "string_agg({line}, chr(10) ORDER BY turn)"


def _replies(t, line):
    return D.ordered_join(t.conversations.withColumn("_l", line), ["conv_id"], "turn", F.col("_l"), "\n", "text")


_L1_LINE = "CASE WHEN role = 'system' THEN '情节：' ELSE role || '：' END || replace(text, chr(10), ' ')"


@register("l1_parse_scene_replies", f"""
WITH r AS (SELECT conv_id, {_REPLY.format(line=_L1_LINE)} AS text FROM conversations GROUP BY conv_id),
l AS (SELECT conv_id, i, {_STRIP.format(x="parts[i]")} AS line
      FROM (SELECT conv_id, parts, unnest(range(1, len(parts) + 1)) AS i
            FROM (SELECT conv_id, string_split(text, chr(10)) AS parts FROM r)))
SELECT conv_id,
  coalesce({_STRIP.format(x="replace(arg_max(line, i) FILTER (WHERE starts_with(line, '情节：')), '情节：', '')")}, '')
    AS summary,
  coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT starts_with(line, '情节：') AND length(line) > 0), '')
    AS dialog
FROM l GROUP BY conv_id
""")
def l1_parse_scene_replies(spark, sf):
    line = F.concat(F.when(F.col("role") == "system", F.lit("情节：")).otherwise(F.concat("role", F.lit("："))),
                    F.replace(F.col("text"), F.lit("\n"), F.lit(" ")))
    r = _replies(Tables(spark, sf), line)
    return D.parse_scene_replies(r).select("conv_id", "summary", "dialog")


_L2_LINE = ("CASE role WHEN 'user' THEN 'Q: ' WHEN 'assistant' THEN 'A: ' ELSE '' END "
            "|| replace(text, chr(10), ' ')")


@register("l2_parse_qa_replies", f"""
WITH r AS (SELECT conv_id, {_REPLY.format(line=_L2_LINE)} AS text FROM conversations GROUP BY conv_id),
l AS (SELECT conv_id, CAST(i - 1 AS INTEGER) AS line_no, {_STRIP.format(x="parts[i]")} AS line
      FROM (SELECT conv_id, parts, unnest(range(1, len(parts) + 1)) AS i
            FROM (SELECT conv_id, string_split(text, chr(10)) AS parts FROM r))),
k AS (SELECT *, CASE WHEN starts_with(line, 'Q:') THEN {_STRIP.format(x="replace(line, 'Q:', '')")} END AS q,
                CASE WHEN NOT starts_with(line, 'Q:') AND starts_with(line, 'A:')
                     THEN {_STRIP.format(x="replace(line, 'A:', '')")} END AS a FROM l),
w AS (SELECT *,
        last_value(CASE WHEN q <> '' THEN line_no END IGNORE NULLS) OVER p AS lq,
        last_value(CASE WHEN q <> '' THEN q END IGNORE NULLS) OVER p AS question,
        last_value(CASE WHEN a <> '' THEN line_no END IGNORE NULLS) OVER p AS la
      FROM k WINDOW p AS (PARTITION BY conv_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY line_no) - 1 AS INTEGER) AS pair_no,
       question, a AS answer
FROM w WHERE a <> '' AND lq IS NOT NULL AND lq > coalesce(la, -1)
""")
def l2_parse_qa_replies(spark, sf):
    line = F.concat(F.when(F.col("role") == "user", "Q: ").when(F.col("role") == "assistant", "A: ").otherwise(""),
                    F.replace(F.col("text"), F.lit("\n"), F.lit(" ")))
    return D.parse_qa_replies(_replies(Tables(spark, sf), line), "conv_id")


_L3_LINE = ("CASE role WHEN 'assistant' THEN '`' || split_part(text, ' ', 1) || '` ' || replace(text, chr(10), ' ') "
            "WHEN 'system' THEN replace(text, chr(10), ' ') || ' 无需移除' ELSE replace(text, chr(10), ' ') END")


@register("l3_parse_code_replies", f"""
WITH r AS (SELECT conv_id, {_REPLY.format(line=_L3_LINE)} AS text FROM conversations GROUP BY conv_id),
l AS (SELECT conv_id, i, regexp_extract(parts[i], '`([^`]+)`', 1) AS code
      FROM (SELECT conv_id, parts, unnest(range(1, len(parts) + 1)) AS i
            FROM (SELECT conv_id, string_split(text, chr(10)) AS parts FROM r)))
SELECT r.conv_id, c.code, NOT contains(r.text, '无需移除') AS passed
FROM r LEFT JOIN (SELECT conv_id, arg_max(code, i) FILTER (WHERE code <> '') AS code FROM l GROUP BY conv_id) c
  USING (conv_id)
""")
def l3_parse_code_replies(spark, sf):
    c = F.col("text")
    line = (F.when(F.col("role") == "assistant",
                   F.concat(F.lit("`"), F.split_part(c, F.lit(" "), F.lit(1)), F.lit("` "),
                            F.replace(c, F.lit("\n"), F.lit(" "))))
            .when(F.col("role") == "system", F.concat(F.replace(c, F.lit("\n"), F.lit(" ")), F.lit(" 无需移除")))
            .otherwise(F.replace(c, F.lit("\n"), F.lit(" "))))
    return D.parse_code_replies(_replies(Tables(spark, sf), line)).select("conv_id", "code", "passed")


_L4_LINE = "CASE WHEN role = 'system' THEN '结论：不通过' ELSE role || ' 修改建议：' || replace(text, chr(10), ' ') END"


@register("l4_parse_verdicts", f"""
WITH r AS (SELECT conv_id, {_REPLY.format(line=_L4_LINE)} AS text FROM conversations GROUP BY conv_id)
SELECT conv_id, NOT contains(text, '不通过') AS is_pass,
  CASE WHEN contains(text, '修改建议：') THEN {_STRIP.format(x="split_part(text, '修改建议：', -1)")} END AS feedback
FROM r
""")
def l4_parse_verdicts(spark, sf):
    line = F.when(F.col("role") == "system", F.lit("结论：不通过")).otherwise(
        F.concat(F.col("role"), F.lit(" 修改建议："), F.replace(F.col("text"), F.lit("\n"), F.lit(" "))))
    return D.parse_verdicts(_replies(Tables(spark, sf), line)).select("conv_id", "is_pass", "feedback")


@register("l5_parse_list_replies", f"""
SELECT item_id, CAST(i - 1 AS INTEGER) AS item_no, {_STRIP.format(x="parts[i]")} AS item
FROM (SELECT item_id, parts, unnest(range(1, len(parts) + 1)) AS i
      FROM (SELECT item_id, string_split(text, ',') AS parts FROM benchmark))
""")
def l5_parse_list_replies(spark, sf):
    return D.parse_list_replies(Tables(spark, sf).benchmark, "item_id")


@register("d4_rewrite_choices")
def d4_rewrite_choices(spark, sf):
    return _dialogs(Tables(spark, sf)).select("dialog_id", D.rewrite_choices(F.col("dialog")).alias("dialog"))


@register("d4_rewrite_choice_blocks", """
SELECT o_custkey AS dialog_id, string_agg(CASE CAST(floor(o_totalprice) AS BIGINT) % 4
  WHEN 0 THEN chr(10) || '派蒙：行 ' || o_orderkey
  WHEN 1 THEN '* 旅行者：走 ' || o_orderkey || chr(10) || '* 荧：二 ' || o_orderkey || chr(10) || '* 之后'
  WHEN 2 THEN '* 旅行者：去 ' || o_orderkey || chr(10) || '* 旅行者：去 ' || o_orderkey || chr(10) || '* 后'
  ELSE '* 旅行者：不 ' || o_orderkey || chr(10) || '* 完' END, '' ORDER BY o_orderkey) AS dialog FROM orders GROUP BY 1
""")
def d4_rewrite_choice_blocks(spark, sf):
    """Stand-in dialogues, one a customer: a plain line or a choice block for each order, the block with two replies, with the
    player's own line, or with an option alone."""
    star = F.lit("\n★\n")
    no = F.col("o_orderkey").cast("string")
    pieces = F.array(F.concat(F.lit("\n派蒙：行 "), no),
                     F.concat(star, F.lit("走 "), no, F.lit("\n派蒙：一\n荧：二 "), no, F.lit("\n\n* 之后")),
                     F.concat(star, F.lit("旅行者：去 "), no, F.lit("\n\n* 后")),
                     F.concat(star, F.lit("不 "), no, F.lit("\n\n* 完")))
    orders = Tables(spark, sf).orders.withColumn("piece", F.get(pieces, (F.floor("o_totalprice") % 4).cast("int")))
    docs = D.ordered_join(orders, ["o_custkey"], "o_orderkey", F.col("piece"), "", "dialog").withColumnRenamed("o_custkey", "dialog_id")
    return docs.select("dialog_id", D.rewrite_choices(F.col("dialog")).alias("dialog"))
