"""Registered queries on scene, fragment and outline texts.

The driver tables hold no such texts, so each query builds them from table columns, one text per row.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import dialog as D
from .registry import Tables, register

_DIGITS = "一二三四五六七八九"


def _numeral(n):
    """A column 1-99 as a Chinese numeral (二十三; 十 for ten)."""
    tens, units = F.floor(n / 10).cast("int"), (n % 10).cast("int")
    digit = lambda x: F.when(x > 0, F.substring(F.lit(_DIGITS), x, F.lit(1))).otherwise("")
    return F.concat(F.when(tens > 1, digit(tens)).otherwise(""), F.when(tens > 0, "十").otherwise(""), digit(units))


def _str(c):
    return F.col(c).cast("string")


def _flat(c):
    return F.replace(F.col(c), F.lit("\n"), F.lit(" "))


_FLAT = "replace(text, chr(10), ' ')"


@register("d1_extract_scenes", """
SELECT c_custkey, 1 AS line_no, CAST(c_custkey % 30 + 1 AS INTEGER) AS chapter_no, c_name AS scene_name,
  CAST(c_custkey % 99 + 1 AS INTEGER) AS scene_no FROM customer
UNION ALL
SELECT c_custkey, 4, CAST(c_custkey % 99 + 1 AS INTEGER), c_mktsegment, CAST(c_custkey % 30 + 1 AS INTEGER)
FROM customer
""")
def d1_extract_scenes(spark, sf):
    a, b = _numeral(F.col("c_custkey") % 30 + 1), _numeral(F.col("c_custkey") % 99 + 1)
    text = F.concat(F.lit("前言\n第"), a, F.lit("章 第"), b, F.lit("幕"), F.col("c_name"),
                    F.lit(" 尾\n第"), a, F.lit("节 第"), b, F.lit("幕无章\n第"), a, F.lit("章 无幕\n第"), b,
                    F.lit("章 第"), a, F.lit("幕"), F.col("c_mktsegment"))
    docs = Tables(spark, sf).customer.select("c_custkey", text.alias("text"))
    return D.extract_scenes(docs, key="c_custkey").drop("chapter")


@register("d2_chinese_ordinal", """
SELECT c_custkey, CAST(c_custkey % 99 + 1 AS INTEGER) AS proper,
  CAST(CASE WHEN (c_custkey % 99 + 1) % 10 = 0 THEN 10 ELSE (c_custkey % 99 + 1) % 10 END AS INTEGER) AS last, 1 AS none
FROM customer
""")
def d2_chinese_ordinal(spark, sf):
    d = Tables(spark, sf).customer.withColumn("t", F.concat(F.lit("第"), _numeral(F.col("c_custkey") % 99 + 1),
                                                            F.lit("幕")))
    return d.select("c_custkey", D.chinese_ordinal(F.col("t")).cast("int").alias("proper"),
                    D.chinese_ordinal(F.col("t"), mode="last").cast("int").alias("last"),
                    D.chinese_ordinal(F.col("c_mktsegment")).cast("int").alias("none"))


@register("d3_extract_acts", """
WITH p AS (SELECT c_custkey AS k FROM customer), live AS (SELECT k FROM p WHERE k % 7 <> 0),
h AS (SELECT k, k + 1 AS act, 1 AS act_no FROM live UNION ALL SELECT k, k * 2, 3 FROM live),
kept AS (SELECT h.* FROM h JOIN live ON live.k = h.act),
a AS (SELECT * FROM kept UNION ALL SELECT k, k, 1 FROM live WHERE k NOT IN (SELECT k FROM kept))
SELECT 'P' || k AS scene_name, 'P' || act AS act_name, act_no FROM a
""")
def d3_extract_acts(spark, sf):
    """A customer's page names three acts: the next page, one that has no page, the page at twice its number."""
    key = F.col("c_custkey")
    name = lambda n: F.concat(F.lit("P"), n.cast("string"))
    text = F.concat(F.lit("简介\n对话：词条"), name(key + 1), F.lit("\n其他\n对话：词条无页\n旧对话 词条"), name(key * 2))
    pages = Tables(spark, sf).customer.select(name(key).alias("title"), text.alias("text"), "c_custkey")
    scenes = pages.select(F.col("title").alias("scene_name")).unionByName(
        pages.where(key % 50 == 0).select(F.concat(F.lit("无页"), "title").alias("scene_name")))
    excludes = pages.where(key % 7 == 0).select(F.col("title").alias("name"))
    return D.extract_acts(scenes, pages, excludes).select("scene_name", "act_name", "act_no")


@register("d5_split_fragments", f"""
SELECT doc_id, 0 AS frag_no, 'A' || chr(10) || {_FLAT} AS fragment FROM documents
UNION ALL SELECT doc_id, 1, 'B' || chr(10) || source FROM documents
UNION ALL SELECT doc_id, 2, lang FROM documents
""")
def d5_split_fragments(spark, sf):
    text = F.concat(F.lit("开头\n## 首页\n### 不要\nx\n## "), F.col("lang"), F.lit("\n引言\n### A\n"), _flat("text"),
                    F.lit("\n### B\n"), F.col("source"), F.lit("\n## 目录2\n### 不要\n## C\n### "), F.col("lang"))
    return D.split_fragments(Tables(spark, sf).documents.withColumn("text", text), "doc_id")


@register("d6_previous_summary", """
SELECT conv_id, turn, coalesce(lag(text) OVER (PARTITION BY conv_id ORDER BY turn // 4, turn % 4 // 2, turn), '')
  AS pre_summary FROM conversations
""")
def d6_previous_summary(spark, sf):
    t = F.col("turn")
    frags = Tables(spark, sf).conversations.select(
        "conv_id", "turn", F.col("text").alias("summary"), F.floor(t / 4).alias("scene_no"),
        F.floor(t % 4 / 2).alias("act_no"), t.alias("frag_no"))
    d = D.with_previous_summary(frags, chapter="conv_id")
    return d.select("conv_id", "turn", F.coalesce("pre_summary", F.lit("")).alias("pre_summary"))


@register("d8_split_topics", """
WITH d AS (SELECT * FROM documents WHERE doc_id % 5 <> 0)
SELECT doc_id, 0 AS topic_no, CASE WHEN doc_id % 2 = 0 THEN lang || chr(10) || 'x' || doc_id ELSE lang END AS topic FROM d
UNION ALL
SELECT doc_id, 1, CASE WHEN doc_id % 2 = 0 THEN source || chr(10) || 'y' ELSE 'x' || doc_id END FROM d
""")
def d8_split_topics(spark, sf):
    """Four paragraphs for even ids, three for odd ones; every fifth document has no marker."""
    marker = F.when(F.col("doc_id") % 5 != 0, "页首\n文本语言：\n").otherwise("页首\n")
    tail = F.when(F.col("doc_id") % 2 == 0, "\n\ny\n").otherwise("")
    text = F.concat(marker, F.col("lang"), F.lit("\n\nx"), _str("doc_id"), F.lit("\n\n"), F.col("source"), tail)
    return D.split_topics(Tables(spark, sf).documents.withColumn("text", text), "doc_id")


@register("d9_markdown_outline", """
SELECT doc_id, '# ' || lang || chr(10) || source || chr(10) || '...' || chr(10) || chr(10) || '## T' || doc_id || chr(10)
  || '### U' || chr(10) || 'body' || chr(10) || '...' || chr(10) AS outline FROM documents
""")
def d9_markdown_outline(spark, sf):
    text = F.concat(F.lit("序\n# "), F.col("lang"), F.lit("\n\n  "), F.col("source"), F.lit(" \nmore\n## T"),
                    _str("doc_id"), F.lit("\n### U\n\nbody\nrest"))
    return D.markdown_outline(Tables(spark, sf).documents.withColumn("text", text), "doc_id")


@register("d10_filter_sections", """
SELECT doc_id, CASE WHEN lang < 'f' THEN '## ' || lang || chr(10) || 'kept ' || doc_id || chr(10) || '### sub' || chr(10)
  || 'deep' ELSE '' END AS loose,
  CASE WHEN lang < 'f' THEN '## ' || lang || chr(10) || 'kept ' || doc_id ELSE '' END AS strict
FROM documents
""")
def d10_filter_sections(spark, sf):
    """The listed headings are the languages before ``f``; the strict form lets a deeper heading end a section."""
    docs = Tables(spark, sf).documents
    text = F.concat(F.lit("# top\nx\n## "), F.col("lang"), F.lit("\nkept "), _str("doc_id"),
                    F.lit("\n### sub\ndeep\n## other\nlost\n# end\nalso"))
    headings = docs.where(F.col("lang") < "f").select(F.concat(F.lit("## "), "lang").alias("heading")).distinct()
    d = docs.withColumn("text", text)
    loose = D.filter_sections(d, headings, "doc_id").withColumnRenamed("filtered", "loose")
    strict = D.filter_sections(d, headings, "doc_id", strict_reference=True).withColumnRenamed("filtered", "strict")
    return loose.join(strict, "doc_id")
