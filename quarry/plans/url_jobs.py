"""Registered URL and crawl-link queries (U1-U9) over ``pages``."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import urls as FU
from ..operators import urls as U
from .registry import Tables, register

HOST = "https://wiki.example.org"
_SITE = r"regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/([^/?#]*)', 1)"
_ORIGIN = r"regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1)"
_PATH = r"regexp_extract({u}, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1)"

LINKS_CTE = r"""
tags AS (SELECT page_id, url, unnest(str_split_regex(regexp_replace(html, '(?s)<!--.*?-->|<script.*?</script>|<style.*?</style>',
                                                                    '', 'g'), '<(a|area)[ \n]'))
                AS tag, unnest(range(100000)) AS no FROM pages),
h AS (SELECT page_id, url, trim(replace(str_split(str_split(split_part(tag, '>', 1), 'href="')[2], '"')[1],
                                        '&amp;', '&')) AS href
      FROM tags WHERE no > 0 AND tag IS NOT NULL AND contains(split_part(tag, '>', 1), 'href="')),
r AS (SELECT page_id, url,
        CASE WHEN regexp_matches(href, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN href
             WHEN starts_with(href, '//') THEN regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*):', 1) || ':' || href
             WHEN starts_with(href, '/') THEN """ + _ORIGIN + r""" || href
             WHEN starts_with(href, '#') OR href = '' THEN regexp_extract(url, '^([^?#]*)', 1)
             WHEN starts_with(href, '?') THEN regexp_extract(url, '^([^?#]*)', 1) || href
             ELSE regexp_replace(regexp_extract(url, '^([^?#]*)', 1), '[^/]*$', '') || href END AS link,
        """ + _ORIGIN + r""" AS prefix
      FROM h),
links AS (SELECT DISTINCT page_id, link FROM r
          WHERE starts_with(link, prefix) AND substring(link, length(prefix) + 1, 1) IN ('', '/', '?', '#'))
"""


def _links(t):
    return U.extract_links(t.pages)


def _page_site():
    return F.regexp_extract(F.col("url"), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/([^/?#]*)", 1)


@register("u1_extract_links", "WITH " + LINKS_CTE + "SELECT page_id, link FROM links")
def u1_extract_links(spark, sf):
    return _links(Tables(spark, sf))


@register("u2_drop_static", "SELECT page_id, url FROM pages WHERE NOT regexp_matches("
          + _PATH.format(u="url") + r", '^.*\.[a-zA-Z]{1,8}$')")
def u2_drop_static(spark, sf):
    return U.drop_static(Tables(spark, sf).pages.select("page_id", "url"), link="url")


@register("u3a_drop_namespaces", "WITH " + LINKS_CTE + """
SELECT l.page_id, l.link FROM links l JOIN pages p USING (page_id)
WHERE NOT coalesce(regexp_matches(
  split_part(url_decode(replace(""" + _PATH.format(u="l.link") + """, '+', '%2B')),
             regexp_extract(p.url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/([^/?#]*)', 1) || '/', 2),
  '^(文件:|模板:|用户:|特殊:|MediaWiki:|File:|Widget:|User:|Data:|分类:)'), false)
""")
def u3a_drop_namespaces(spark, sf):
    t = Tables(spark, sf)
    links = _links(t).join(t.pages.select("page_id", _page_site().alias("site")), "page_id")
    return U.drop_namespaces(links, F.col("site")).select("page_id", "link")


@register("u3b_drop_ignored", """
SELECT page_id, regexp_replace(url_decode(replace(url, '+', '%2B')), '^.*://', '') AS save_to FROM pages
WHERE NOT regexp_matches(regexp_replace(url_decode(replace(url, '+', '%2B')), '^.*://', ''),
  '(文件:|模板:|用户:|特殊:|MediaWiki:|File:|Widget:|User:|Data:|分类:)')
""")
def u3b_drop_ignored(spark, sf):
    items = Tables(spark, sf).pages.select("page_id", FU.save_key(F.col("url")).alias("save_to"))
    return U.drop_ignored(items)


@register("u4_frontier", "WITH " + LINKS_CTE + """
SELECT page_id, link FROM links WHERE link NOT IN (SELECT url FROM pages)
""")
def u4_frontier(spark, sf):
    t = Tables(spark, sf)
    return U.frontier(_links(t), t.pages)


@register("u5_save_key", """
SELECT page_id, regexp_replace(url_decode(replace(url, '+', '%2B')), '^.*://', '') AS save_to FROM pages
""")
def u5_save_key(spark, sf):
    return Tables(spark, sf).pages.select("page_id", FU.save_key(F.col("url")).alias("save_to"))


@register("u6_reachable", "WITH RECURSIVE " + LINKS_CTE + """,
e AS (SELECT p.url AS src, l.link AS dst FROM links l JOIN pages p USING (page_id)
      UNION SELECT a.url, b.url FROM pages a JOIN pages b ON a.page_id = b.page_id // 2),
walk(node, depth) USING KEY (node) AS (
  SELECT url, 0 FROM pages WHERE page_id // 2 NOT IN (SELECT page_id FROM pages WHERE page_id > 0)
  UNION
  SELECT e.dst, min(walk.depth) + 1 FROM walk JOIN e ON walk.node = e.src
  WHERE e.dst NOT IN (SELECT node FROM recurring.walk) GROUP BY e.dst)
SELECT node, depth FROM walk
""")
def u6_reachable(spark, sf):
    """A page leads to its links and, as the driver pages never link to one another, to the pages whose id halves
    to its own. Pages without such a parent (or their own parent) are seeds; the walk goes on to the end."""
    t = Tables(spark, sf)
    pages = t.pages.select("page_id", "url")
    parent = F.floor(F.col("page_id") / 2).cast("long")
    below = pages.select(F.col("url").alias("dst"), parent.alias("page_id"))
    edges = _links(t).withColumnRenamed("link", "dst").unionByName(below).join(pages, "page_id").select(
        F.col("url").alias("src"), "dst")
    inner = pages.where(F.col("page_id") > 0).select(F.col("page_id").alias("p"))
    seeds = pages.join(inner, parent == F.col("p"), "left_anti").select(F.col("url").alias("node"))
    return U.reachable(edges, seeds)


@register("u7_seed_urls", """
SELECT DISTINCT """ + _SITE + """ AS site,
  'https://wiki.example.org/' || """ + _SITE + """ || '/' ||
  split_part(split_part(split_part(url, '?', 1), '#', 1), '/', -1) AS url
FROM pages
""")
def u7_seed_urls(spark, sf):
    samples = Tables(spark, sf).pages.select(_page_site().alias("site"), FU.url_leaf(F.col("url")).alias("title"))
    return U.seed_urls(samples, HOST)


@register("u8_url_leaf", """
SELECT page_id, split_part(split_part(split_part(url, '?', 1), '#', 1), '/', -1) AS leaf FROM pages
""")
def u8_url_leaf(spark, sf):
    return Tables(spark, sf).pages.select("page_id", FU.url_leaf(F.col("url")).alias("leaf"))


@register("u9_strip_suffix", r"""
SELECT page_id, regexp_replace(split_part(split_part(split_part(url, '?', 1), '#', 1), '/', -1), '\.[^.]*$', '')
  AS name FROM pages
""")
def u9_strip_suffix(spark, sf):
    return Tables(spark, sf).pages.select("page_id", FU.strip_suffix(FU.url_leaf(F.col("url"))).alias("name"))
