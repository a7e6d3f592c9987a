"""Registered source and sink queries. Files are written from the driver tables to the shared scratch folder, in
the form the reader expects, and read back from there."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import urls as FU
from ..session import scratch_path
from ..sources import files as S
from .registry import Tables, register


@register("s6_incremental_upsert", """
WITH new AS (SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN o_orderdate + INTERVAL 1 DAY ELSE o_orderdate END
                    AS o_orderdate, o_totalprice FROM orders),
changed AS (SELECT * FROM new WHERE (o_orderkey, o_orderdate) NOT IN (SELECT (o_orderkey, o_orderdate) FROM orders))
SELECT o_orderkey, o_orderdate, o_totalprice FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM changed)
UNION ALL SELECT * FROM changed
""")
def s6_incremental_upsert(spark, sf):
    orders = Tables(spark, sf).orders
    stored = orders.select("o_orderkey", "o_orderdate", "o_totalprice")
    # finished orders come back with a new modification date; the others are unchanged
    new = orders.select("o_orderkey", F.when(F.col("o_orderstatus") == "F",
                                             F.col("o_orderdate") + F.expr("INTERVAL 1 DAY"))
                        .otherwise(F.col("o_orderdate")).alias("o_orderdate"), "o_totalprice")
    _changed, store = S.incremental_upsert(new, stored, "o_orderkey", "o_orderdate")
    return store


@register("s11_pending_work", """
SELECT d.doc_id, l.quality AS stored, l.quality IS NULL AS pending
FROM documents d LEFT JOIN labels l USING (doc_id)
""")
def s11_pending_work(spark, sf):
    t = Tables(spark, sf)
    return S.pending_work(t.documents.select("doc_id"), t.labels, "doc_id", "quality")


def _fresh(spark, name):
    return scratch_path(spark, f"{name}-{uuid.uuid4().hex}")


@register("s1_read_categories", """
SELECT 'ys' AS site, c_name AS cat_name, c_custkey % 5 AS n_pages FROM customer WHERE c_custkey % 5 > 0
""")
def s1_read_categories(spark, sf):
    pages = (F.col("c_custkey") % 5)
    listing = F.array(F.struct(F.col("c_name").alias("*"), pages.alias("pages"), pages.alias("size")))
    path = _fresh(spark, "s1")
    Tables(spark, sf).customer.select(F.to_json(F.struct(F.struct(listing.alias("allcategories")).alias("query")))
                                      .alias("value")).write.text(path)
    return S.read_categories(spark, path, site="ys")


@register("s2_read_category_pages", """
SELECT o_orderkey AS page_id, o_orderpriority || '：' || o_orderkey AS title,
  strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS ts, o_orderpriority || chr(10) || '"正文"' AS content
FROM orders WHERE o_orderkey % 4 <> 0
""")
def s2_read_category_pages(spark, sf):
    """Every fourth page has no revision; ``touched`` is a year off and must not be read."""
    o = Tables(spark, sf).orders
    main = F.struct(F.concat("o_orderpriority", F.lit('\n"正文"')).alias("*"))
    iso = "yyyy-MM-dd'T'HH:mm:ss'Z'"
    revision = F.struct(F.date_format("o_orderdate", iso).alias("timestamp"), F.struct(main.alias("main")).alias("slots"))
    revisions = F.filter(F.array(revision), lambda r: F.col("o_orderkey") % 4 != 0)
    page = F.struct(F.col("o_orderkey").alias("pageid"),
                    F.concat("o_orderpriority", F.lit("："), F.col("o_orderkey").cast("string")).alias("title"),
                    F.date_format(F.col("o_orderdate") + F.expr("INTERVAL 365 DAYS"), iso).alias("touched"),
                    revisions.alias("revisions"))
    pages = F.create_map(F.col("o_orderkey").cast("string"), page)
    path = _fresh(spark, "s2")
    o.select(F.to_json(F.struct(F.struct(pages.alias("pages")).alias("query"))).alias("value")).write.text(path)
    p = S.read_category_pages(spark, path, with_content=True)
    return p.withColumn("ts", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))


_SAVE_TO = "regexp_replace(url_decode(replace(url, '+', '%2B')), '^.*://', '')"
_IGNORED = "(文件:|模板:|用户:|特殊:|MediaWiki:|File:|Widget:|User:|Data:|分类:)"


def _items(t):
    return t.pages.select("url", FU.url_leaf(F.col("url")).alias("title"), F.lit(None).cast("timestamp")
                          .alias("modified_at"), F.concat(F.lit("# "), F.col("url"), F.lit("\n\n正文")).alias("markdown"),
                          "html", FU.save_key(F.col("url")).alias("save_to"))


@register("s3_read_feed", f"""
SELECT url, split_part(split_part(split_part(url, '?', 1), '#', 1), '/', -1) AS title,
  '# ' || url || chr(10) || chr(10) || '正文' AS markdown, html, {_SAVE_TO} AS save_to FROM pages
""")
def s3_read_feed(spark, sf):
    path = _fresh(spark, "s3")
    _items(Tables(spark, sf)).write.json(path)
    return S.read_feed(spark, path).drop("modified_at")


@register("s4_site_config", """
WITH c AS (SELECT *, 'site ' || CAST(c_custkey // 10 AS VARCHAR) AS site FROM customer)
SELECT site, 'categories' AS part, c_name AS name, CAST(c_custkey AS BIGINT) AS n, c_acctbal AS score FROM c
UNION ALL SELECT site, 'samples', 'page ' || c_custkey, NULL, NULL FROM c
UNION ALL SELECT site, 'trim_rules', '//div[@id=' || chr(39) || c_custkey || chr(39) || ']',
  row_number() OVER (PARTITION BY site ORDER BY c_custkey) - 1, NULL FROM c
""")
def s4_site_config(spark, sf):
    """Ten neighbouring customers stand for a site; all sites are written, and all are read back."""
    num = F.col("c_custkey").cast("string")
    c = Tables(spark, sf).customer.withColumn("site", F.concat(F.lit("site "), F.floor(F.col("c_custkey") / 10).cast("string")))
    cats = c.select("site", F.col("c_name").alias("cat_name"), F.col("c_custkey").alias("n_pages"),
                    F.col("c_acctbal").alias("score"))
    rules = c.select("site", F.col("c_custkey").alias("rule_no"), F.concat(F.lit("//div[@id='"), num, F.lit("']")).alias("rule"))
    path = _fresh(spark, "s4")
    S.write_site_config(cats, c.select("site", F.concat(F.lit("page "), num).alias("title")), rules, path)
    t = S.read_site_configs(spark, path)

    def part(name, col, n=None, score=None):
        return t[name].select("site", F.lit(name).alias("part"), F.col(col).alias("name"), (F.col(n) if n else F.lit(None)).cast(
            "long").alias("n"), (F.col(score) if score else F.lit(None)).cast("double").alias("score"))

    return part("categories", "cat_name", "n_pages", "score").unionByName(part("samples", "title")).unionByName(
        part("trim_rules", "rule", "rule_no"))


@register("s5_write_markdown", f"""
SELECT regexp_extract({_SAVE_TO}, '^[^/]*/([^/]*)', 1) AS site, {_SAVE_TO} AS save_to,
  split_part(split_part(split_part(url, '?', 1), '#', 1), '/', -1) AS title,
  '# ' || url || chr(10) || chr(10) || '正文' AS markdown
FROM pages WHERE NOT regexp_matches({_SAVE_TO}, '{_IGNORED}')
""")
def s5_write_markdown(spark, sf):
    """Two writes to one store, each of some sites; the second leaves the first one's sites alone."""
    items = _items(Tables(spark, sf))
    early = F.regexp_extract("save_to", r"^[^/]*/([^/]*)", 1) < "es"
    path = _fresh(spark, "s5")
    S.write_markdown(items.where(early), path)
    S.write_markdown(items.where(~early), path)
    return spark.read.schema("save_to STRING, title STRING, markdown STRING, site STRING").parquet(path)


@register("s7_read_texts", """
SELECT lang, CAST(sum(length(text) + 1) AS BIGINT) AS n_chars FROM documents GROUP BY lang
""")
def s7_read_texts(spark, sf):
    """Documents as text files of at most 100 documents, one folder per language, each file read whole."""
    path = _fresh(spark, "s7")
    Tables(spark, sf).documents.select(F.col("text").alias("value"), "lang").write.option("maxRecordsPerFile", 100) \
        .partitionBy("lang").text(path)
    d = S.read_texts(spark, f"{path}/*/*.txt")
    return d.groupBy(F.regexp_extract("path", "lang=([^/]+)/", 1).alias("lang")).agg(
        F.sum(F.length("text")).alias("n_chars"))


@register("s10_write_jsonl", "SELECT lang, doc_id, text, source FROM documents")
def s10_write_jsonl(spark, sf):
    path = _fresh(spark, "s10")
    docs = Tables(spark, sf).documents
    S.write_jsonl(docs.select("lang", F.to_json(F.struct("doc_id", "text", "source")).alias("j")), path, "j", "lang")
    back = spark.read.schema("value STRING, lang STRING").text(path)
    return back.select("lang", F.from_json("value", "doc_id BIGINT, text STRING, source STRING").alias("v")).select(
        "lang", "v.*")
