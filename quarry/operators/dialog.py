"""Dialogue dataset build (D1-D16) and model-reply parsing.

Texts are split into line rows once (``posexplode``); every rule after that is a
window (``lag``, running counts, ``last IGNORE NULLS``) partitioned by one document or
dialogue, followed by ordered concatenation. The only sequential step, the choice-block
rewrite (D4), runs as Arrow-batched Python; the token-bounded split (D14) is in :mod:`.chat_split`.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from ..functions.prompts import QUESTION_ANSWER_SYSTEM_TEMPLATE, ROLE_PLAY_SYSTEM_TEMPLATE, render
from . import chat_split
from .scan import previous_values, running_totals

# Fixed values that must match the reference behaviour.
CHINESE_NUMERALS = "一二三四五六七八九十"
COLON = "："                       # full-width colon separating speaker and line
SCENE_MARK = "幕"
CHAPTER_SUFFIX = "章"
ACT_PATTERN = r"^.*对话.*词条(.*)$"
SKIPPED_FRAGMENT_PREFIXES = ("首页", "目录")
TOPIC_MARKER = "文本语言："
SUMMARY_PREFIX = "情节："
QUESTION_PREFIX, ANSWER_PREFIX = "Q:", "A:"
REJECT_PHRASE = "无需移除"
FAIL_PHRASE = "不通过"
FEEDBACK_PREFIX = "修改建议："
PLAYER = "旅行者"
CHOICE_BLOCK = re.compile(r"(\n★\n[\s\S]+?\n\n)\*")
TRAINING_MAX_TOKENS = 4096 * 2

_WS = r"^[\s\p{Z}]+|[\s\p{Z}]+$"


def strip(c: Column) -> Column:
    """Python ``str.strip()``: leading/trailing whitespace including Unicode spaces."""
    return F.regexp_replace(c, _WS, "")


def lines(df: DataFrame, key: str | list[str], text: str, strip_lines: bool = False) -> DataFrame:
    """``(key…, line_no, line)`` rows for ``text.split('\\n')``."""
    keys = [key] if isinstance(key, str) else list(key)
    d = df.select(*keys, F.posexplode(F.split(F.col(text), "\n", -1)).alias("line_no", "line"))
    return d.withColumn("line", strip(F.col("line"))) if strip_lines else d


def ordered_join(df: DataFrame, keys: list[str], order: str, value: Column, sep: str, out: str) -> DataFrame:
    """``string_agg(value, sep ORDER BY order)`` per key."""
    return df.groupBy(*keys).agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), value.alias("v")))), lambda s: s["v"]), sep)
        .alias(out))


# ------------------------------------------------------------------ numerals, scenes, acts
def chinese_ordinal(c: Column, mode: str = "proper") -> Column:
    """Chinese numeral in the text → int; no numeral → 1.

    ``proper`` reads the first numeral run as 1-99 (十二 → 12, 二十 → 20). ``last``
    reproduces the reference, which only keeps the last numeral character (十二 → 2).
    """
    run_pat = f"[{CHINESE_NUMERALS}]+"
    has = c.rlike(run_pat)
    digit = lambda ch: F.instr(F.lit(CHINESE_NUMERALS), ch)  # noqa: E731  1..10
    if mode == "last":
        last = F.regexp_extract(c, f"^.*([{CHINESE_NUMERALS}])", 1)
        return F.when(has, digit(last)).otherwise(F.lit(1))
    run = F.regexp_extract(c, f"({run_pat})", 1)
    ten = F.instr(run, "十")
    tens = F.when(ten == 1, F.lit(1)).otherwise(digit(F.substring(run, 1, 1)))
    units = F.when(F.length(run) > ten, digit(F.substring(run, -1, 1))).otherwise(F.lit(0))
    value = F.when(ten > 0, tens * 10 + units).otherwise(digit(run))
    return F.when(has, value).otherwise(F.lit(1))


def extract_scenes(docs: DataFrame, key: str = "title", text: str = "text", mode: str = "proper") -> DataFrame:
    """Scene rows from lines ``<chapter>章 第N幕<scene name>`` (space separated)."""
    ln = lines(docs, key, text)
    seg = F.split(F.col("line"), " ", -1)
    d = ln.select(key, "line_no", F.try_element_at(seg, F.lit(1)).alias("s0"), F.try_element_at(seg, F.lit(2)).alias("s1"),
                  F.size(seg).alias("n"))
    d = d.where((F.col("n") >= 2) & F.col("s0").endswith(CHAPTER_SUFFIX)
                & F.col("s1").rlike(f"^第[{CHINESE_NUMERALS}]+{SCENE_MARK}"))
    cut = F.instr(F.col("s1"), SCENE_MARK)
    order = F.substring(F.col("s1"), 1, cut)
    return d.select(key, "line_no", F.col("s0").alias("chapter"), chinese_ordinal(F.col("s0"), mode).alias("chapter_no"),
                    F.expr(f"substring(s1, instr(s1, '{SCENE_MARK}') + 1)").alias("scene_name"),
                    chinese_ordinal(order, mode).alias("scene_no"))


def extract_acts(scenes: DataFrame, pages: DataFrame, excludes: DataFrame | None = None,
                 title: str = "title", text: str = "text") -> DataFrame:
    """D3: acts of every scene.

    Act lines in the scene's page match ``…对话…词条<act>``; every match counts towards
    ``act_no``; acts that are excluded or have no page of their own are dropped. A
    scene without acts (or whose page is excluded or missing) … becomes its own act 1
    when its page exists and it is not excluded.
    """
    ex = excludes.select(F.col("name").alias("_x")) if excludes is not None else None
    sc = scenes.join(pages.select(F.col(title).alias("scene_name")), "scene_name", "left_semi")
    if ex is not None:
        sc = sc.join(ex, sc["scene_name"] == ex["_x"], "left_anti")
    pl = pages.select(F.col(title).alias("scene_name"), text).join(sc.select("scene_name"), "scene_name", "left_semi")
    pl = lines(pl, "scene_name", text)
    hits = pl.where(F.col("line").rlike(ACT_PATTERN)).select(
        "scene_name", "line_no", F.regexp_extract("line", ACT_PATTERN, 1).alias("act_name"))
    hits = hits.withColumn("act_no", F.row_number().over(Window.partitionBy("scene_name").orderBy("line_no")))
    hits = hits.join(pages.select(F.col(title).alias("act_name")).distinct(), "act_name", "left_semi")
    if ex is not None:
        hits = hits.join(ex, hits["act_name"] == ex["_x"], "left_anti")
    acts = sc.join(hits.drop("line_no"), "scene_name", "inner")
    lone = sc.join(hits.select("scene_name").distinct(), "scene_name", "left_anti") \
        .withColumn("act_name", F.col("scene_name")).withColumn("act_no", F.lit(1))
    return acts.unionByName(lone)


# ------------------------------------------------------------------ choice blocks
def choice_bullets(block: str, reply: str = "last") -> list[str]:
    """The two bullets of a choice block: what the player says (their own line, or the first option), and the
    last (or first) line that has a speaker, if there is one."""
    option = next((x for x in block.split("\n") if x.strip() and not x.startswith("★")), "")
    said = option if not option or option.startswith(PLAYER + COLON) else f"{PLAYER}{COLON}{option}"
    spoken = re.findall(rf"^[^\n]*{COLON}[^\n]*$", block, re.M)
    answer = [spoken[-1 if reply == "last" else 0].strip()] if spoken else []
    return [f"* {x}" for x in (said, *answer)]


def rewrite_choices_text(text: str, reply: str = "last") -> str:
    """All choice blocks of a text, pass by pass: a block that begins inside another one's end waits for the next."""
    before = None
    while text != before:
        before = text
        text = CHOICE_BLOCK.sub(lambda m: "\n".join(choice_bullets(m[1], reply)) + "\n*", text)
    return text


def rewrite_choices(text: Column, reply: str = "last") -> Column:
    """Turn ``★`` choice blocks into two bullet lines (player line, reply), until none is left.

    Rows without a block go to Python as null, so nothing is sent or rewritten for them.
    """
    @pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: None if t is None else rewrite_choices_text(t, reply))
    return F.coalesce(run(F.when(text.contains("\n★\n"), text)), text)


# ------------------------------------------------------------------ fragments, topics, outline
def split_fragments(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``## `` sections (首页/目录 sections dropped), then their ``### `` parts without the lead part."""
    sections = F.filter(F.split(F.col(text), "\n## ", -1),
                        lambda s: ~(s.startswith(SKIPPED_FRAGMENT_PREFIXES[0]) | s.startswith(SKIPPED_FRAGMENT_PREFIXES[1])))
    parts = F.flatten(F.transform(sections, lambda s: F.filter(F.split(s, "\n### ", -1), lambda x, i: i > 0)))
    return docs.select(key, F.posexplode(parts).alias("frag_no", "fragment"))


def with_previous_summary(frags: DataFrame, chapter: str = "chapter",
                          order: tuple[str, ...] = ("scene_no", "act_no", "frag_no")) -> DataFrame:
    """The summary of the previous fragment of the same chapter ('' for the first).

    A long chapter is no single task: the lag runs inside blocks of fragments (``scan.previous_values``).
    """
    d = previous_values(frags.withColumn("_has", F.lit(True)), [chapter], order[-1], ["summary", "_has"],
                        outer=order[:-1])
    return d.withColumn("pre_summary", F.when(F.col("prev__has"), F.col("prev_summary")).otherwise("")) \
        .drop("_has", "prev__has", "prev_summary")


def speaker_counts(df: DataFrame, dialog: str = "dialog") -> DataFrame:
    """Lines per speaker (text before the first ``：``) over all dialogues."""
    ln = df.select(F.explode(F.split(F.col(dialog), "\n", -1)).alias("line")).where(F.col("line").contains(COLON))
    return ln.groupBy(F.substring_index("line", COLON, 1).alias("speaker")).agg(F.count(F.lit(1)).alias("n_lines"))


def split_topics(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Text after ``文本语言：``, paragraphs split into two equal halves (an odd last one is dropped)."""
    body = strip(F.try_element_at(F.split(F.col(text), TOPIC_MARKER, -1), F.lit(2)))
    d = docs.where(F.col(text).contains(TOPIC_MARKER)).select(key, F.split(body, "\n\n", -1).alias("_p"))
    half = F.floor(F.size("_p") / 2).cast("int")
    first = F.array_join(F.slice("_p", F.lit(1), half), "\n")
    second = F.array_join(F.slice("_p", half + 1, half), "\n")
    return d.select(key, F.posexplode(F.array(first, second)).alias("topic_no", "topic"))


def markdown_outline(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Headings plus the first non-blank line under each, followed by ``...``."""
    ln = lines(docs, key, text, strip_lines=True).where(F.col("line") != "")
    head = F.col("line").startswith("#")
    prev_head = F.lag(head, 1, False).over(Window.partitionBy(key).orderBy("line_no"))
    d = ln.withColumn("_h", head).withColumn("_ph", prev_head).where(F.col("_h") | F.col("_ph"))
    item = F.when(F.col("_h"), F.col("line")).otherwise(F.concat(F.col("line"), F.lit("\n...\n")))
    out = ordered_join(d, [key], "line_no", item, "\n", "outline")
    return docs.select(key).join(out, key, "left").select(key, F.coalesce("outline", F.lit("")).alias("outline"))


def filter_sections(docs: DataFrame, headings: DataFrame, key: str, text: str = "text",
                    strict_reference: bool = False) -> DataFrame:
    """Keep the sections whose heading line is listed in ``headings(heading)``.

    A section ends at the next heading of the same or a shallower level; with
    ``strict_reference`` it ends at any line starting with the heading's marker (so ``###``
    ends a ``##`` section but ``#`` does not).
    """
    ln = lines(docs, key, text, strip_lines=True)
    listed = headings.select(F.col("heading").alias("line"), F.lit(True).alias("_start")).distinct()
    d = ln.join(listed, "line", "left").withColumn("_start", F.coalesce("_start", F.lit(False)))
    w = Window.partitionBy(key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("_seg", F.sum(F.col("_start").cast("int")).over(w))
    marker = F.when(F.col("_start"), F.substring_index("line", " ", 1))
    d = d.withColumn("_mark", F.last(marker, ignorenulls=True).over(w))
    if strict_reference:
        ends = F.col("line").startswith(F.col("_mark"))
    else:
        lvl = F.length(F.regexp_extract("line", r"^(#+)( |$)", 1))
        ends = (lvl > 0) & (lvl <= F.length(F.regexp_extract("_mark", r"^(#*)", 1)))
    d = d.withColumn("_end", ~F.col("_start") & (F.col("_seg") > 0) & ends)
    ws = Window.partitionBy(key, "_seg")
    d = d.withColumn("_first_end", F.min(F.when(F.col("_end"), F.col("line_no"))).over(ws))
    keep = (F.col("_seg") > 0) & (F.col("_start") | F.col("_first_end").isNull()
                                  | (F.col("line_no") < F.col("_first_end")))
    out = ordered_join(d.where(keep), [key], "line_no", F.col("line"), "\n", "filtered")
    return docs.select(key).join(out, key, "left").select(key, F.coalesce("filtered", F.lit("")).alias("filtered"))


# ------------------------------------------------------------------ pairs and merging
def dialog_pairs(dlg_lines: DataFrame, character: Column | str, key: str = "dialog_id",
                 line_no: str = "line_no", line: str = "line", leading: str = "drop") -> DataFrame:
    """(query, response) pairs for one character.

    Lines of the character are responses (every ``<character>：`` removed, trimmed, joined
    without separator); other lines are queries. Consecutive lines of the same speaker
    merge into one query line (continuations lose every ``speaker：``); query lines are
    joined by newlines. A new turn starts at the first query line after a response.
    ``leading="drop"`` drops character lines before the first query (the reference
    pairs them with the first query: ``leading="reference"``). Turns need both parts.
    """
    ch = F.concat(character if isinstance(character, Column) else F.lit(character), F.lit(COLON))
    has_colon = F.col(line).contains(COLON)
    d = dlg_lines.withColumn("_isr", F.col(line).startswith(ch)).withColumn("_ch", ch) \
        .withColumn("_spk", F.when(has_colon, F.substring_index(F.col(line), COLON, 1)))
    # ordered scans per dialogue are two-level (scan.py), so one huge dialogue is not one task
    d = running_totals(d, [key], line_no, {"_nq": (~F.col("_isr")).cast("long")})
    if leading == "drop":
        d = d.where(F.col("_nq") > 0)
    d = previous_values(d, [key], line_no, ["_isr", "_spk"])
    prev_isr = F.coalesce(F.col("prev__isr"), F.lit(False))
    prev_q = F.coalesce(~F.col("prev__isr"), F.lit(False))
    cont = F.coalesce(~F.col("_isr") & prev_q & F.col("_spk").isNotNull() & (F.col("_spk") == F.col("prev__spk")),
                      F.lit(False))
    d = d.withColumn("_cont", cont).withColumn("_newturn", (~F.col("_isr") & prev_isr & (F.col("_nq") > 1)))
    d = running_totals(d, [key], line_no, {"_turn": F.col("_newturn").cast("long"),
                                           "_qblk": (~F.col("_cont")).cast("long")})
    piece = F.when(F.col("_cont"), F.replace(F.col(line), F.concat(F.col("_spk"), F.lit(COLON)), F.lit(""))) \
        .otherwise(F.col(line))
    q = ordered_join(d.where(~F.col("_isr")).withColumn("_piece", piece), [key, "_turn", "_qblk"], line_no,
                     F.col("_piece"), "", "_qline")
    q = q.join(d.where(~F.col("_isr")).groupBy(key, "_turn", "_qblk").agg(F.min(line_no).alias("_first")),
               [key, "_turn", "_qblk"])
    queries = ordered_join(q, [key, "_turn"], "_first", F.col("_qline"), "\n", "query")
    resp = d.where(F.col("_isr")).withColumn("_r", strip(F.replace(F.col(line), F.col("_ch"), F.lit(""))))
    responses = ordered_join(resp, [key, "_turn"], line_no, F.col("_r"), "", "response")
    out = queries.join(responses, [key, "_turn"], "inner")
    return out.select(key, F.col("_turn").cast("int").alias("turn_no"), "query", "response")


def merge_by_summary(frags: DataFrame, key: str = "folder", order: str = "frag_no", summary: str = "summary",
                     dialog: str = "dialog", character: str | None = None) -> DataFrame:
    """Merge consecutive fragments with equal summary (dialogs joined by newline).

    With ``character`` only fragments holding ``<character>：`` take part. Runs with an
    empty summary are dropped after grouping, so they still separate equal neighbours.
    """
    d = frags if character is None else frags.where(F.col(dialog).contains(character + COLON))
    d = previous_values(d.withColumn("_has", F.lit(True)), [key], order, [summary, "_has"])
    new = ~F.coalesce(F.col(f"prev_{summary}").eqNullSafe(F.col(summary)) & F.col("prev__has"), F.lit(False))
    d = running_totals(d.withColumn("_new", new.cast("long")), [key], order, {"_g": F.col("_new")})
    g = ordered_join(d, [key, "_g", summary], order, F.col(dialog), "\n", dialog)
    return g.where(F.col(summary) != "").select(key, F.col("_g").alias("group_no"), summary, dialog)


def contiguous_prefix(df: DataFrame, key: str, idx: str) -> DataFrame:
    """Rows numbered 0, 1, 2, … per key up to the first missing number.

    The first gap is found with joins and a min aggregation (no per-key sort): the
    smallest ``i + 1`` that is absent, or 0 when 0 itself is absent.
    """
    present = df.select(key, F.col(idx).alias("_i")).distinct()
    after = present.select(key, (F.col("_i") + 1).alias("_i")).join(present, [key, "_i"], "left_anti")
    no_zero = present.select(key).distinct().join(present.where(F.col("_i") == 0).select(key), key, "left_anti") \
        .withColumn("_i", F.lit(0).cast(present.schema["_i"].dataType))
    gap = after.unionByName(no_zero).groupBy(key).agg(F.min("_i").alias("_gap"))
    return df.join(gap, key).where(F.col(idx) < F.col("_gap")).drop("_gap")


# ------------------------------------------------------------------ chats and training rows
def assemble_chats(pairs: DataFrame, profiles: DataFrame, kind: str, key: str = "chat_id",
                   pair_no: str = "turn_no", character: str = "character", context: str | None = "summary") -> DataFrame:
    """Message rows ``(chat_id, msg_no, role, content)``: a system message (profile, plus the
    plot context for role play) then user/assistant messages for every pair in order."""
    tpl = ROLE_PLAY_SYSTEM_TEMPLATE if kind == "role_play" else QUESTION_ANSWER_SYSTEM_TEMPLATE
    chats = pairs.select(key, character, *([context] if kind == "role_play" and context else [])).distinct()
    cols = {"profile": F.col("profile")}
    if kind == "role_play" and context:
        cols["context"] = F.col(context)
    system = chats.join(profiles, character).select(key, F.lit(0).cast("long").alias("msg_no"),
                                                    F.lit("system").alias("role"), render(tpl, **cols).alias("content"))
    p = pairs.join(profiles.select(character), character, "left_semi")
    # pair numbers are unique per chat, so the rank is a two-level running count (skew-safe)
    p = running_totals(p, [key], pair_no, {"_c": F.lit(1)}).withColumn("_i", (F.col("_c") - 1).cast("long"))
    users = p.select(key, (2 * F.col("_i") + 1).alias("msg_no"), F.lit("user").alias("role"), F.col("query").alias("content"))
    bots = p.select(key, (2 * F.col("_i") + 2).alias("msg_no"), F.lit("assistant").alias("role"),
                    F.col("response").alias("content"))
    return system.unionByName(users).unionByName(bots)


def training_rows(msgs: DataFrame, key: str = "chat_id", msg_no: str = "msg_no", role: str = "role",
                  content: str = "content") -> DataFrame:
    """``(chat_id, turn_no, system, input, output)``: each assistant message with the last
    user message since the previous assistant message; the chat's system message goes on
    the first turn. Outputs with no input before them are dropped, and so are empty ones."""
    is_a = (F.col(role) == "assistant").cast("long")
    d = running_totals(msgs.where(F.col(role).isin("user", "assistant")), [key], msg_no, {"_na": is_a})
    d = d.withColumn("_seg", F.col("_na") - (F.col(role) == "assistant").cast("long"))
    seg = d.groupBy(key, "_seg").agg(
        F.max(F.when(F.col(role) == "user", F.struct(F.col(msg_no).alias("n"), F.col(content).alias("c"))))["c"]
        .alias("input"),
        F.max(F.when(F.col(role) == "assistant", F.col(content))).alias("output"))
    seg = seg.where((F.col("input") != "") & (F.col("output") != ""))
    seg = running_totals(seg, [key], "_seg", {"_tn": F.lit(1)}).withColumn("turn_no", (F.col("_tn") - 1).cast("int"))
    system = msgs.where(F.col(role) == "system").groupBy(key).agg(
        F.min(F.struct(F.col(msg_no).alias("n"), F.col(content).alias("c")))["c"].alias("_sys"))
    out = seg.join(system, key, "left").withColumn(
        "system", F.when(F.col("turn_no") == 0, F.col("_sys")))
    return out.select(key, "turn_no", "system", "input", "output")


def split_chats(msgs: DataFrame, max_tokens: int = TRAINING_MAX_TOKENS, **names) -> DataFrame:
    """Token-bounded parts of chats, by :func:`.chat_split.split_chats`."""
    return chat_split.split_chats(msgs, max_tokens, **names)


# ------------------------------------------------------------------ reply parsing
def parse_scene_replies(df: DataFrame, text: str = "text") -> DataFrame:
    """L1: ``summary`` from the last ``情节：`` line; every other non-blank line goes to ``dialog``."""
    ls = F.transform(F.split(F.col(text), "\n", -1), lambda x: strip(x))
    d = df.withColumn("_l", ls)
    summ = F.filter(F.col("_l"), lambda x: x.startswith(SUMMARY_PREFIX))
    dialog = F.filter(F.col("_l"), lambda x: ~x.startswith(SUMMARY_PREFIX) & (F.length(x) > 0))
    return d.withColumn("summary", F.coalesce(strip(F.replace(F.try_element_at(summ, F.lit(-1)), F.lit(SUMMARY_PREFIX),
                                                               F.lit(""))), F.lit(""))) \
        .withColumn("dialog", F.array_join(dialog, "\n")).drop("_l")


def parse_qa_replies(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """L2: Q:/A: lines → pairs; a later question overwrites an open one; answers with no open question are dropped."""
    ln = lines(df, key, text, strip_lines=True)
    isq, isa = F.col("line").startswith(QUESTION_PREFIX), F.col("line").startswith(ANSWER_PREFIX)
    ln = ln.withColumn("_q", F.when(isq, strip(F.replace(F.col("line"), F.lit(QUESTION_PREFIX), F.lit("")))))
    ln = ln.withColumn("_a", F.when(~isq & isa, strip(F.replace(F.col("line"), F.lit(ANSWER_PREFIX), F.lit("")))))
    w = Window.partitionBy(key).orderBy("line_no")
    wp = w.rowsBetween(Window.unboundedPreceding, -1)
    ln = ln.withColumn("_lq", F.last(F.when(F.col("_q") != "", F.col("line_no")), ignorenulls=True).over(wp))
    ln = ln.withColumn("_question", F.last(F.when(F.col("_q") != "", F.col("_q")), ignorenulls=True).over(wp))
    ln = ln.withColumn("_la", F.last(F.when(F.col("_a") != "", F.col("line_no")), ignorenulls=True).over(wp))
    pairs = ln.where((F.col("_a") != "") & F.col("_lq").isNotNull() & (F.col("_lq") > F.coalesce("_la", F.lit(-1))))
    pairs = pairs.withColumn("pair_no", F.row_number().over(Window.partitionBy(key).orderBy("line_no")) - 1)
    return pairs.select(key, "pair_no", F.col("_question").alias("question"), F.col("_a").alias("answer"))


def parse_code_replies(df: DataFrame, text: str = "text") -> DataFrame:
    """L3: ``code`` = first inline code of the last line that has one; ``passed`` false if any line rejects."""
    per_line = F.transform(F.split(F.col(text), "\n", -1), lambda x: F.regexp_extract(x, r"`([^`]+)`", 1))
    codes = F.filter(per_line, lambda x: x != "")
    return df.withColumn("code", F.try_element_at(codes, F.lit(-1))) \
        .withColumn("passed", ~F.col(text).contains(REJECT_PHRASE))


def parse_verdicts(df: DataFrame, text: str = "text") -> DataFrame:
    """L4: ``is_pass`` unless ``不通过`` appears; ``feedback`` after the last ``修改建议：``."""
    fb = F.when(F.col(text).contains(FEEDBACK_PREFIX), strip(F.substring_index(F.col(text), FEEDBACK_PREFIX, -1)))
    return df.withColumn("is_pass", ~F.col(text).contains(FAIL_PHRASE)).withColumn("feedback", fb)


def parse_list_replies(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Comma-separated reply → one trimmed item per row."""
    return df.select(key, F.posexplode(F.split(F.col(text), ",", -1)).alias("item_no", "item")) \
        .withColumn("item", strip(F.col("item")))
