"""Registered curation queries.

Categories are derived from ``documents``: site = lang, category = source, one member
page per document; the score is the mean document length in thousands of characters.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import curate as C
from .registry import Tables, register

CATS_SQL = """WITH cats AS (
  SELECT lang AS site, source AS cat_name, count(*) AS n_pages, avg(n_chars) / 1000 AS score
  FROM documents GROUP BY lang, source)
"""


def _cats(t):
    return C.categories_from_members(t.documents, "lang", "source", F.avg("n_chars") / 1000)


@register("c1_min_pages", CATS_SQL + "SELECT * FROM cats WHERE n_pages >= 2")
def c1_min_pages(spark, sf):
    return C.min_pages(_cats(Tables(spark, sf)))


@register("c2_include_only", CATS_SQL + """
SELECT * FROM cats WHERE cat_name IN (
  SELECT d.source FROM documents d JOIN labels l USING (doc_id) WHERE l.quality = 1 AND l.toxic = 0)
""")
def c2_include_only(spark, sf):
    t = Tables(spark, sf)
    names = (t.documents.join(t.labels.where("quality = 1 AND toxic = 0"), "doc_id")
             .select(F.col("source").alias("cat_name")))
    return C.include_only(_cats(t), names)


@register("c3_sample_per_group", """
WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS rn FROM events),
h AS (SELECT *, row_number() OVER (PARTITION BY user_id
                                   ORDER BY md5(CAST(event_id AS VARCHAR) || ':0')) AS sample_rank
      FROM r WHERE rn <= 10)
SELECT event_id, ts, user_id, event_type, value, props, sample_rank FROM h WHERE sample_rank <= 3
""")
def c3_sample_per_group(spark, sf):
    ev = Tables(spark, sf).events
    return C.sample_per_group(ev, ["user_id"], F.col("ts"), F.col("event_id"), seed=0)


@register("c4_scoring_prompt", """
SELECT doc_id, '标题：' || source || chr(10) || chr(10) || '创建时间：' || CAST(doc_id AS VARCHAR)
       || chr(10) || chr(10) || substring(text, 1, 512) AS prompt
FROM documents
""")
def c4_scoring_prompt(spark, sf):
    d = Tables(spark, sf).documents
    return C.render_scoring_prompt(d, F.col("source"), F.col("doc_id").cast("string"), F.col("text")) \
        .select("doc_id", "prompt")


@register("c5_parse_score", r"""
SELECT event_id,
  TRY_CAST(CASE WHEN regexp_matches(props, '\d') THEN regexp_extract(props, '(\d+(\.\d+)?)', 1) END AS DOUBLE)
    AS score_first,
  TRY_CAST(CASE WHEN regexp_matches(props, '^.*(\d+\.?\d*)') THEN regexp_extract(props, '^.*(\d+\.?\d*)', 1) END
    AS DOUBLE) AS score_reference
FROM events
""")
def c5_parse_score(spark, sf):
    ev = Tables(spark, sf).events
    return ev.select("event_id", C.parse_score(F.col("props"), "first").alias("score_first"),
                     C.parse_score(F.col("props"), "last_digit").alias("score_reference"))


@register("c6_score_groups", CATS_SQL + """,
m AS (SELECT d.source AS cat_name, avg(1 + 4 * l.quality) AS score
      FROM labels l JOIN documents d USING (doc_id) GROUP BY d.source
      HAVING avg(1 + 4 * l.quality) >= 3.5)
SELECT c.site, c.cat_name, c.n_pages, m.score FROM cats c JOIN m USING (cat_name)
""")
def c6_score_groups(spark, sf):
    t = Tables(spark, sf)
    scores = t.labels.join(t.documents, "doc_id").select(
        F.col("source").alias("cat_name"), (1 + 4 * F.col("quality")).alias("score"))
    return C.score_groups(scores, _cats(t))


@register("c7_upsert", """
SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer
WHERE c_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')
UNION ALL
SELECT c_custkey, c_name || '*', c_nationkey, c_acctbal + 100, c_mktsegment FROM customer
WHERE c_mktsegment = 'BUILDING'
""")
def c7_upsert(spark, sf):
    cu = Tables(spark, sf).customer
    new = (cu.where(F.col("c_mktsegment") == "BUILDING")
           .withColumn("c_name", F.concat("c_name", F.lit("*")))
           .withColumn("c_acctbal", F.col("c_acctbal") + 100))
    return C.upsert(cu, new, "c_custkey")


@register("c8_sort_by_score", CATS_SQL + "SELECT * FROM cats ORDER BY score DESC, cat_name")
def c8_sort_by_score(spark, sf):
    return C.sort_by_score(_cats(Tables(spark, sf)))


@register("c9_top_categories", CATS_SQL + """
SELECT * FROM cats ORDER BY score DESC, n_pages DESC, site, cat_name LIMIT 20
""")
def c9_top_categories(spark, sf):
    return C.top_categories(_cats(Tables(spark, sf)))


@register("c10_newest_per_group", """
SELECT o_custkey, o_orderkey FROM (
  SELECT o_custkey, o_orderkey,
         row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn
  FROM orders) WHERE rn = 1
  AND o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'AUTOMOBILE')
""")
def c10_newest_per_group(spark, sf):
    t = Tables(spark, sf)
    chosen = t.customer.where(F.col("c_mktsegment") == "AUTOMOBILE").select(F.col("c_custkey").alias("o_custkey"))
    return C.newest_per_group(t.orders, chosen, ["o_custkey"], "o_orderdate", "o_orderkey", "o_orderkey")


@register("c11_merge_samples", """
SELECT source FROM documents WHERE lang = 'en' UNION SELECT source FROM documents WHERE lang IS DISTINCT FROM 'en'
""")
def c11_merge_samples(spark, sf):
    d = Tables(spark, sf).documents
    english = F.col("lang").eqNullSafe("en")
    return C.merge_samples(d.where(english).select("source"), d.where(~english).select("source"))
