"""Registered HTML page queries (P1-P17) over ``pages``.

Trim rules are site configuration (a handful of XPath strings), not data; the rules
used here remove the ad blocks, navigation and footers present on every page.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import functions as F

from ..functions import urls as FU
from ..operators import html as H
from ..operators import text as T
from ..session import stored
from .registry import Tables, register

TRIM_RULES = ["//div[@class='ad']", "//nav", "//footer"]


def _nodes(spark, sf):
    return H.parse_nodes(Tables(spark, sf).pages)


def _cols(d):
    return d.select("page_id", "node_id", "subtree_end", "parent_id", "depth", "kind", "tag", "text")


@register("p2_parse_nodes")
def p2_parse_nodes(spark, sf):
    return _cols(_nodes(spark, sf))


@register("p3_drop_tags")
def p3_drop_tags(spark, sf):
    return _cols(H.drop_tags(_nodes(spark, sf)))


@register("p3_tag_counts", r"""
SELECT page_id, lower(t) AS tag, count(*) AS n
FROM (SELECT page_id, unnest(regexp_extract_all(html, '<([a-zA-Z][a-zA-Z0-9]*)', 1)) AS t FROM pages)
WHERE lower(t) NOT IN (""" + ", ".join(f"'{t}'" for t in H.INTERACTIVE_TAGS) + """)
GROUP BY ALL
""")
def p3_tag_counts(spark, sf):
    n = H.drop_tags(_nodes(spark, sf)).where(F.col("kind") == "element")
    return n.groupBy("page_id", "tag").agg(F.count(F.lit(1)).alias("n"))


@register("p4_drop_blank")
def p4_drop_blank(spark, sf):
    return _cols(H.drop_blank(H.drop_tags(_nodes(spark, sf))))


@register("p5_keep_attrs")
def p5_keep_attrs(spark, sf):
    d = H.keep_attrs(_nodes(spark, sf)).where(F.size("attrs") > 0)
    return d.select("page_id", "node_id", F.explode("attrs").alias("attr", "value"))


@register("p6_decode_links", r"""
SELECT page_id, coalesce(url_decode(replace(h, '+', '%2B')), h) AS href
FROM (SELECT page_id, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS h FROM pages)
""")
def p6_decode_links(spark, sf):
    d = H.decode_links(_nodes(spark, sf)).where(F.col("tag") == "a")
    return d.select("page_id", F.element_at("attrs", F.lit("href")).alias("href"))


@register("p2_tag_counts", r"""
SELECT page_id, lower(t) AS tag, count(*) AS n
FROM (SELECT page_id, unnest(regexp_extract_all(html, '<([a-zA-Z][a-zA-Z0-9]*)', 1)) AS t FROM pages)
GROUP BY ALL
""")
def p2_tag_counts(spark, sf):
    n = _nodes(spark, sf).where(F.col("kind") == "element")
    return n.groupBy("page_id", "tag").agg(F.count(F.lit(1)).alias("n"))


@register("p7_apply_trim_rules")
def p7_apply_trim_rules(spark, sf):
    return _cols(H.apply_trim_rules(H.clean_html(_nodes(spark, sf)), TRIM_RULES))


@register("p8_rule_hits")
def p8_rule_hits(spark, sf):
    rules = spark.createDataFrame(list(enumerate(TRIM_RULES + ["//aside"])), "rule_no int, rule string")
    r = H.rule_hits(_nodes(spark, sf), rules)
    return r.select("rule_no", "n_hits", "n_pages", "rejected", F.size("sample_nodes").alias("n_samples"))


@register("p1_page_meta", """
SELECT page_id, trim(replace(replace(replace(regexp_extract(html, '<title>([^<]*)</title>', 1),
       '&lt;', '<'), '&gt;', '>'), '&amp;', '&')) AS title
FROM pages WHERE contains(html, '<article')
""")
def p1_page_meta(spark, sf):
    return H.page_meta(_nodes(spark, sf)).select("page_id", "title")


@register("p11_structure_signature")
def p11_structure_signature(spark, sf):
    s = H.structure_signature(_nodes(spark, sf))
    return s.groupBy("signature").agg(F.count(F.lit(1)).alias("n_pages"))


@register("p12_collapse_siblings")
def p12_collapse_siblings(spark, sf):
    return _cols(H.collapse_siblings(H.structure_nodes(_nodes(spark, sf))))


def _order_pages(spark, sf):
    """Stand-in pages, one an order: a block for each line item, in order, with its flags as class and as many list items as its
    quantity modulo 4, followed by a table of the same lines and a list of them."""
    def line(x):
        n = x["l_quantity"] % 4
        return F.concat(F.lit('<div class="'), x["l_returnflag"], x["l_linestatus"], F.lit('">'), F.when(n > 0, F.concat(
            F.lit("<ul>"), F.repeat(F.lit("<li></li>"), n.cast("int")), F.lit("</ul>"))).otherwise(""), F.lit("</div>"))

    # a line is made of its flags after the shuffle
    flags = F.struct("l_linenumber", "l_returnflag", "l_linestatus", "l_quantity")
    rows = Tables(spark, sf).lineitem.groupBy(F.col("l_orderkey").alias("page_id")).agg(F.collect_list(flags).alias("flags"))
    rows = rows.select("page_id", F.transform(F.array_sort(F.transform("flags", lambda x: F.struct(
        x["l_linenumber"].alias("l_linenumber"), line(x).alias("line")))), lambda x: x["line"]).alias("lines"))
    n = F.size("lines")
    return rows.select("page_id", F.concat(
        F.lit("<section>"), F.array_join("lines", ""), F.lit("</section><table>"), F.repeat(F.lit("<tr></tr>"), n),
        F.lit("</table><ol>"), F.array_join(F.transform("lines", lambda x: F.concat(F.lit("<li>"), x, F.lit("</li>"))), ""),
        F.lit("</ol>")).alias("html"))


@register("p12_repeated_siblings", """
WITH l AS (
  SELECT l_orderkey AS page_id, list(f ORDER BY l_linenumber, f, q) AS classes, list(q ORDER BY l_linenumber, f, q) AS listed
  FROM (SELECT *, l_returnflag || l_linestatus AS f, CAST(l_quantity AS INT) % 4 > 0 AS q FROM lineitem) GROUP BY 1),
k AS (SELECT page_id, len(classes) AS n, list_transform(range(1, len(classes) + 1), lambda i: '<div class="' || classes[i] || '">' ||
    CASE WHEN listed[i] THEN '<ul><li></li></ul>' ELSE '' END || '</div>') AS kids FROM l),
t AS (SELECT *, list_min(list_filter(range(1, n), lambda i: len(list_distinct(kids[i:n])) = 1)) AS tail FROM k),
tries AS (
  SELECT page_id, s, p, c, s + (c - 1) * p AS last FROM (SELECT *, unnest(range(1, n - c * p + 2)) AS s FROM (
    SELECT *, unnest(range(2, n // p + 1)) AS c FROM (SELECT *, unnest(range(1, n // 2 + 1)) AS p FROM t WHERE tail IS NULL)))
  WHERE kids[s:s + (c - 1) * p - 1] = kids[s + p:s + c * p - 1]),
best AS (SELECT * FROM tries QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY c DESC, last, p) = 1)
SELECT t.page_id, '<section>' || array_to_string(list_transform(list_filter(range(1, n + 1), lambda i:
    CASE WHEN tail IS NOT NULL THEN i <= tail WHEN c IS NOT NULL THEN NOT (i >= s + p AND i < s + c * p) ELSE true END),
    lambda i: kids[i]), '') || '</section><table>' || repeat('<tr></tr>', least(n, 2)) || '</table><ol><li>' || kids[1] || '</li></ol>' AS html
FROM t LEFT JOIN best b ON b.page_id = t.page_id
""")
def p12_repeated_siblings(spark, sf):
    return H.render_html(H.collapse_siblings(H.parse_nodes(_order_pages(spark, sf), packed=True), packed=True), packed=True)


@register("p14_left_prefix")
def p14_left_prefix(spark, sf):
    return _cols(H.left_prefix(H.clean_html(_nodes(spark, sf)), 2000))


@register("p14_left_prefix_markup", """
WITH o AS (SELECT o_custkey AS page_id, o_orderkey, '<p class="' || o_orderstatus || '">' AS tag, replace(o_orderpriority, '-', '&') AS txt FROM orders),
n AS (SELECT page_id, o_orderkey, 0 AS part, tag AS s, length(tag) + 4 AS cost FROM o UNION ALL
  SELECT page_id, o_orderkey, 1, replace(txt, '&', '&amp;'), length(replace(txt, '&', '&amp;')) FROM o),
r AS (SELECT *, 19 + sum(cost) OVER (PARTITION BY page_id ORDER BY o_orderkey, part) <= 200 AS kept FROM n),
p AS (SELECT page_id, o_orderkey, string_agg(s, '' ORDER BY part) || '</p>' AS s FROM r WHERE kept GROUP BY 1, 2)
SELECT o.page_id, '<section>' || coalesce(string_agg(p.s, '' ORDER BY p.o_orderkey), '') || '</section>' AS html
FROM (SELECT DISTINCT page_id FROM o) o LEFT JOIN p USING (page_id) GROUP BY 1
""")
def p14_left_prefix_markup(spark, sf):
    """Stand-in pages, one a customer: a paragraph for each order, with its status as class and its priority as text."""
    text = F.replace(F.replace("o_orderpriority", F.lit("-"), F.lit("&")), F.lit("&"), F.lit("&amp;"))
    line = F.concat(F.lit('<p class="'), F.col("o_orderstatus"), F.lit('">'), text, F.lit("</p>"))
    pages = Tables(spark, sf).orders.groupBy(F.col("o_custkey").alias("page_id")).agg(F.concat(F.lit("<section>"), F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("o_orderkey", line.alias("s")))), lambda x: x["s"]), ""), F.lit("</section>")).alias("html"))
    return H.render_html(H.left_prefix(H.parse_nodes(pages), 200))


def _main_nodes(spark, sf):
    nodes = _nodes(spark, sf)
    meta = H.page_meta(nodes)
    main = H.main_content(nodes, meta)
    return H.apply_trim_rules(H.decode_links(H.clean_html(main)), TRIM_RULES), meta


@register("p15_to_markdown")
def p15_to_markdown(spark, sf):
    nodes, _ = _main_nodes(spark, sf)
    return H.to_markdown(nodes)


@register("p16_render_html")
def p16_render_html(spark, sf):
    nodes, _ = _main_nodes(spark, sf)
    return H.render_html(nodes)


def build_corpus(spark, sf):
    """Pages → main content → clean → trim → Markdown → phrase dedup → items.

    ``html`` is the main content as it came, before cleaning. A site's home page is no item.
    """
    pages = Tables(spark, sf).pages
    pages = pages.where(FU.url_leaf(FU.unquote(F.col("url"))) != FU.HOME_PAGE)
    # the node table feeds five branches (meta, main content, markdown, html, items): keep
    # it in Spark's block store (memory, spilling to disk) so the Python parse runs once;
    # a lost block is rebuilt from lineage
    nodes = H.parse_nodes(pages).persist(StorageLevel.MEMORY_AND_DISK)
    meta = H.page_meta(nodes)
    content = H.main_content(nodes, meta)
    md = H.to_markdown(H.apply_trim_rules(H.decode_links(H.clean_html(content)), TRIM_RULES))
    html = H.render_html(content)
    items = (meta.select("page_id", "title", "modified_at")
             .join(pages.select("page_id", "url"), "page_id")
             .join(md, "page_id", "left").join(html, "page_id", "left"))
    items = items.withColumn("markdown", T.dedup_text(F.coalesce("markdown", F.lit(""))))
    return items.select("page_id", FU.unquote(F.col("url")).alias("url"), "title", "modified_at", "markdown", "html",
                        FU.save_key(F.col("url")).alias("save_to"))


@register("p17_build_corpus")
def p17_build_corpus(spark, sf):
    return build_corpus(spark, sf)


@register("p13_prune_to_template")
def p13_prune_to_template(spark, sf):
    """Template = the first page of the largest structure cluster (P11), pruned with P12;
    every page is then pruned to it."""
    nodes = H.clean_html(_nodes(spark, sf).drop("ancestors")).persist(StorageLevel.DISK_ONLY)
    sig = stored(H.structure_signature(nodes).select("page_id", "signature"))
    sizes = sig.groupBy("signature").agg(F.count(F.lit(1)).alias("n"))
    pick = sig.join(sizes, "signature").orderBy(F.col("n").desc(), "page_id").limit(1).select("page_id")
    # the nodes are kept on disk, since two jobs read them; only the picked page is parsed again
    picked = H.clean_html(H.parse_nodes(Tables(spark, sf).pages.join(F.broadcast(pick), "page_id", "left_semi")))
    template = H.collapse_siblings(H.structure_nodes(picked))
    return _cols(H.prune_to_template(nodes, template))


@register("p9_plan_pages", """
WITH a AS (SELECT event_id % (SELECT max(page_id) + 1 FROM pages) AS page_id, CASE WHEN event_type = 'error' AND value > 50 THEN 'exhausted' ELSE 'ok' END
           AS state FROM events)
SELECT page_id, CAST((SELECT count(*) FROM a WHERE a.page_id = p.page_id) AS BIGINT) AS n_attempts FROM pages p
WHERE page_id NOT IN (SELECT page_id FROM a WHERE state = 'exhausted') AND length(html) >= 100
""")
def p9_plan_pages(spark, sf):
    """Attempts are the events: they go round all page numbers, and a large error exhausted a page."""
    t = Tables(spark, sf)
    spent = (F.col("event_type") == "error") & (F.col("value") > 50)
    n_pages = t.pages.agg((F.max("page_id") + 1).alias("n")).scalar()
    attempts = t.events.select((F.col("event_id") % n_pages).alias("page_id"),
                               F.when(spent, "exhausted").otherwise("ok").alias("state"))
    return H.plan_pages(t.pages, attempts, empty=F.length("html") < 100).select("page_id", "n_attempts")


@register("p10_all_last_n", """
SELECT user_id AS rule_id, count(*) = 3 AND bool_and(event_type IN ('view', 'click')) AS stop
FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events)
WHERE r <= 3 GROUP BY user_id
""")
def p10_all_last_n(spark, sf):
    attempts = Tables(spark, sf).events.select(
        F.col("user_id").alias("rule_id"), F.col("event_id").alias("attempt_no"),
        F.when(F.col("event_type").isin("view", "click"), "exhausted").otherwise("ok").alias("state"))
    return H.all_last_n(attempts)
