"""Registered chunking queries (K1-K3, K6-K8, K10-K12) over ``documents`` and crawled ``pages``."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import chunk as K
from ..operators import html as H
from ..operators.blocks import HTML_BLOCK_TAGS
from .html_jobs import build_corpus
from .registry import Tables, register


#: Markdown pieces that the stand-in documents are made of; @ becomes the order's number.
PIECES = ("", "word @ and", "- item @", "* star @\n  under @", "1. first @", "2) other @", "  indented @", "    deep @", "# Title @", "### Sub @ ##",
          "```sql\ncode @\n\n# no\n```", "~~~ @", "~~~~", "| a | b |\n|---|:-:|\n| @ |  x |", "row | @", "> quoted @", "<div id=@>\nin", "<!-- note @\n\nend -->",
          "---", "===", "* * *", "<b>", "<script>\n\nvar @\n</script>", "", "- loose @\n\n  more\n\n- next", "text @\n- not weak\n-", "   + plus @", "7. seven")


def _markdown_docs(spark, sf):
    """Stand-in documents, one a customer: a piece of Markdown for each order, chosen by its price."""
    pieces = F.array(*[F.lit(p) for p in PIECES])
    piece = F.replace(F.get(pieces, (F.floor("o_totalprice") % len(PIECES)).cast("int")), F.lit("@"), F.col("o_orderkey").cast("string"))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", piece.alias("p")))), lambda x: x["p"])
    return Tables(spark, sf).orders.groupBy(F.col("o_custkey").alias("doc_id")).agg(F.array_join(lines, "\n").alias("text"))


_SQL_PIECES = ", ".join("'" + p.replace("\n", "' || chr(10) || '") + "'" for p in PIECES)
_BLOCK_TAGS = "|".join(HTML_BLOCK_TAGS)


_BLOCKS_SQL = rf"""
WITH RECURSIVE docs AS (
  SELECT o_custkey AS doc_id, trim(string_agg(replace([{_SQL_PIECES}][CAST(floor(o_totalprice) AS BIGINT) % {len(PIECES)} + 1], '@',
    CAST(o_orderkey AS VARCHAR)), chr(10) ORDER BY o_orderkey)) AS text FROM orders GROUP BY 1),
split AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM docs),
line AS (SELECT doc_id, i, ls[i] AS s, coalesce(ls[i + 1], '') AS nxt FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM split)),
seen AS (SELECT *, regexp_extract(s, '^( *)', 1) AS pad, regexp_extract(s, '^ {{0,3}}(`{{3,}}|~{{3,}})', 1) AS marks,
  regexp_extract(s, '^ {{0,3}}(?:[-+*]|[0-9]{{1,9}}([.)]))(?:[ 	]|$)', 1) AS dot, regexp_extract(s, '^ {{0,3}}([-+*])(?:[ 	]|$)', 1) AS bullet FROM line),
typed AS (SELECT *, bullet || dot AS marker, CASE
  WHEN regexp_matches(s, '^[ 	]*$') THEN 'blank'
  WHEN marks <> '' AND (marks[1] = '~' OR NOT contains(substr(ltrim(s), length(marks) + 1), '`')) THEN 'code'
  WHEN length(pad) >= 4 THEN 'deep'
  WHEN regexp_matches(s, '^ {{0,3}}#{{1,6}}([ 	]|$)') THEN 'heading'
  WHEN regexp_matches(s, '^ {{0,3}}-{{3,}}[ 	]*$') THEN 'dashes'
  WHEN regexp_matches(s, '^ {{0,3}}(([*][ 	]*){{3,}}|(_[ 	]*){{3,}}|(-[ 	]*){{3,}})$') THEN 'break'
  WHEN regexp_matches(s, '^ {{0,3}}(=+|-{{1,2}})[ 	]*$') THEN 'equals'
  WHEN bullet || dot <> '' AND (bullet <> '' OR regexp_matches(s, '^ {{0,3}}1[.)]')) AND regexp_matches(s, '^ {{0,3}}[^ ]+[ 	]+[^ 	]') THEN 'item'
  WHEN bullet || dot <> '' THEN 'weak'
  WHEN regexp_matches(s, '^ {{0,3}}>') THEN 'quote'
  WHEN regexp_matches(s, '^ {{0,3}}<!--') THEN 'comment'
  WHEN regexp_matches(s, '^ {{0,3}}<script') THEN 'raw'
  WHEN regexp_matches(s, '^ {{0,3}}</?({_BLOCK_TAGS})([ 	]|/?>|$)') THEN 'html'
  WHEN regexp_matches(s, '^ {{0,3}}</?[a-z]+>[ 	]*$') THEN 'tag'
  WHEN contains(s, '|') AND contains(nxt, '|') AND regexp_matches(nxt, '^ {{0,3}}[|]?[ 	]*:?-+:?[ 	]*([|][ 	]*:?-+:?[ 	]*)*[|]?[ 	]*$') THEN 'table'
  ELSE 'text' END AS k FROM seen),
cuts AS (SELECT *, k IN ('code', 'heading', 'dashes', 'break', 'item', 'quote', 'comment', 'raw', 'html', 'table') AS cuts FROM typed),
walk AS (
  SELECT doc_id, CAST(0 AS BIGINT) AS i, 'none' AS st, '' AS mark, false AS waits, false AS first, false AS member, '' AS kind FROM docs
  UNION ALL
  SELECT doc_id, i, CASE WHEN go = 'open' THEN CASE k WHEN 'item' THEN 'list' WHEN 'weak' THEN 'list' WHEN 'deep' THEN 'code' WHEN 'tag' THEN 'html'
      WHEN 'equals' THEN 'paragraph' WHEN 'text' THEN 'paragraph' WHEN 'heading' THEN 'none' WHEN 'dashes' THEN 'none' WHEN 'break' THEN 'none'
      WHEN 'comment' THEN CASE WHEN contains(s, '-->') THEN 'none' ELSE 'comment' END WHEN 'code' THEN 'fence' ELSE k END
    WHEN go IN ('end', 'out') THEN 'none' ELSE st END,
    CASE WHEN go <> 'open' THEN mark WHEN k = 'code' THEN marks WHEN k IN ('item', 'weak') THEN marker ELSE '' END,
    go = 'wait', go = 'open', go <> 'out',
    CASE WHEN go <> 'open' THEN '' ELSE CASE k WHEN 'deep' THEN 'code' WHEN 'dashes' THEN 'break' WHEN 'item' THEN 'list' WHEN 'weak' THEN 'list'
      WHEN 'comment' THEN 'html' WHEN 'raw' THEN 'html' WHEN 'tag' THEN 'html' WHEN 'text' THEN 'paragraph' WHEN 'equals' THEN 'paragraph' ELSE k END END
  FROM (SELECT c.*, w.st, w.mark, w.waits, CASE
      WHEN st = 'fence' THEN CASE WHEN regexp_matches(s, '^ {{0,3}}(`{{3,}}|~{{3,}})[ 	]*$') AND marks[1] = mark[1] AND length(marks) >= length(mark)
        THEN 'end' ELSE 'stay' END
      WHEN st = 'comment' THEN CASE WHEN contains(s, '-->') THEN 'end' ELSE 'stay' END
      WHEN st = 'raw' THEN CASE WHEN contains(s, '</script>') THEN 'end' ELSE 'stay' END
      WHEN st = 'html' THEN CASE WHEN k = 'blank' THEN 'out' ELSE 'stay' END
      WHEN st = 'list' THEN CASE WHEN k = 'blank' THEN 'wait' WHEN length(pad) >= CASE WHEN mark IN ('-', '+', '*') THEN 2 ELSE 3 END THEN 'stay'
        WHEN k IN ('item', 'weak') AND marker = mark THEN 'stay' WHEN NOT waits AND NOT cuts AND k <> 'weak' THEN 'stay' ELSE 'open' END
      WHEN k = 'blank' THEN CASE WHEN st = 'code' THEN 'wait' ELSE 'out' END
      WHEN st = 'code' THEN CASE WHEN k = 'deep' THEN 'stay' ELSE 'open' END
      WHEN st = 'table' THEN CASE WHEN contains(s, '|') THEN 'stay' ELSE 'open' END
      WHEN st = 'quote' THEN CASE WHEN k = 'quote' OR NOT cuts AND k <> 'weak' THEN 'stay' ELSE 'open' END
      WHEN st = 'paragraph' THEN CASE WHEN k IN ('equals', 'dashes') THEN 'end' WHEN cuts THEN 'open' ELSE 'stay' END
      ELSE 'open' END AS go
    FROM cuts c JOIN walk w ON c.doc_id = w.doc_id AND c.i = w.i + 1)),
numbered AS (SELECT w.*, s, sum(w.first::INT) OVER (PARTITION BY w.doc_id ORDER BY w.i) - 1 AS block_no,
  w.st = 'none' AND NOT w.first AND regexp_matches(s, '^ {{0,3}}(=+|-+)[ 	]*$') AS underlined
  FROM walk w JOIN line l ON l.doc_id = w.doc_id AND l.i = w.i),
grouped AS (SELECT doc_id, block_no, max(kind) AS kind, bool_or(underlined) AS underlined,
    regexp_replace(string_agg(s, chr(10) ORDER BY i), '(
[ 	]*)+$', '') AS block
  FROM numbered WHERE member GROUP BY 1, 2),
named AS (SELECT doc_id, block_no, block, CASE WHEN kind = 'paragraph' AND underlined THEN 'setext' ELSE kind END AS kind FROM grouped)
SELECT doc_id, CAST(block_no AS INTEGER) AS block_no, CASE WHEN block_no = 0 AND kind = 'paragraph' THEN 'heading' ELSE kind END AS kind,
  CASE WHEN block_no = 0 AND kind = 'paragraph' THEN 1 WHEN kind = 'heading' THEN length(regexp_extract(block, '^ *(#+)', 1)) END AS level,
  CASE WHEN block_no = 0 AND kind = 'paragraph' THEN '# ' || block
    WHEN kind = 'table' THEN regexp_replace(regexp_replace(block, ' +', ' ', 'g'), '-+', '-', 'g') ELSE block END AS block
FROM named WHERE kind <> 'break'
"""


@register("k1_block_grammar", _BLOCKS_SQL)
def k1_block_grammar(spark, sf):
    b = K.markdown_blocks(_markdown_docs(spark, sf))
    return b.select("doc_id", "block_no", "kind", "level", "block")


@register("k2_live_headings", f"""
WITH b AS ({_BLOCKS_SQL}),
live AS (
  SELECT b.doc_id, b.block_no, h.block_no AS heading, h.level FROM b JOIN b h ON h.doc_id = b.doc_id AND h.block_no <= b.block_no AND h.level IS NOT NULL
  WHERE NOT EXISTS (SELECT 1 FROM b o WHERE o.doc_id = b.doc_id AND o.block_no > h.block_no AND o.block_no <= b.block_no AND o.level <= h.level))
SELECT b.doc_id, b.block_no, coalesce(string_agg(CAST(l.heading AS VARCHAR), ',' ORDER BY l.level), '') AS headings
FROM b LEFT JOIN live l ON l.doc_id = b.doc_id AND l.block_no = b.block_no GROUP BY 1, 2
""")
def k2_live_headings(spark, sf):
    b = K.heading_path(K.markdown_blocks(_markdown_docs(spark, sf)))
    return b.select("doc_id", "block_no", F.array_join(F.col("headings").cast("array<string>"), ",").alias("headings"))


@register("k1_markdown_blocks", r"""
WITH l AS (SELECT doc_id, unnest(string_split(trim(text), chr(10))) AS s, generate_subscripts(string_split(trim(text), chr(10)), 1) AS i FROM documents),
k AS (SELECT *, regexp_matches(s, '^ {0,3}#{1,6}([ 	]|$)') AS heading, trim(s, ' ' || chr(9)) = '' AS blank FROM l),
b AS (SELECT *, lag(heading, 1, true) OVER w OR lag(blank, 1, true) OVER w OR heading AS first FROM k WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
n AS (SELECT *, sum((first AND NOT blank)::INT) OVER (PARTITION BY doc_id ORDER BY i) - 1 AS block_no FROM b),
g AS (SELECT doc_id, block_no, bool_or(heading) AS heading, string_agg(s, chr(10) ORDER BY i) AS block FROM n WHERE NOT blank GROUP BY 1, 2)
SELECT doc_id, CAST(block_no AS INTEGER) AS block_no, CASE WHEN heading OR block_no = 0 THEN 'heading' ELSE 'paragraph' END AS kind,
  CASE WHEN heading THEN length(regexp_extract(block, '^ *(#+)', 1)) WHEN block_no = 0 THEN 1 END AS level,
  length(block) + CASE WHEN NOT heading AND block_no = 0 THEN 2 ELSE 0 END AS size FROM g
""")
def k1_markdown_blocks(spark, sf):
    b = K.markdown_blocks(Tables(spark, sf).documents)
    return b.select("doc_id", "block_no", "kind", "level", "size")


@register("k3_chunk_documents")
def k3_chunk_documents(spark, sf):
    d = Tables(spark, sf).documents
    return K.chunk_documents(d, chunk_size=512, first_line_title=False)


@register("k3_chunk_crawled_pages")
def k3_chunk_crawled_pages(spark, sf):
    items = build_corpus(spark, sf).select("page_id", F.col("markdown").alias("text"))
    return K.chunk_documents(items, chunk_size=512, key="page_id")


@register("k2_heading_path")
def k2_heading_path(spark, sf):
    items = build_corpus(spark, sf).select("page_id", F.col("markdown").alias("text"))
    b = K.heading_path(K.markdown_blocks(items, key="page_id"), key="page_id")
    return b.select("page_id", "block_no", "kind", F.size("headings").alias("depth"))


@register("k10_html_sections")
def k10_html_sections(spark, sf):
    return K.html_sections(H.parse_nodes(Tables(spark, sf).pages))


@register("k11_effective_size", """
SELECT doc_id, 1024 - (length(source) + 2) AS budget, 1024 - (length(source) + 2) < 50 AS warn FROM documents
""")
def k11_effective_size(spark, sf):
    d = Tables(spark, sf).documents
    eff = K.effective_size(1024, F.col("source"))
    return d.select("doc_id", eff.alias("budget"), K.size_warning(eff).alias("warn"))


@register("k6_table_to_kv", """
SELECT c_custkey, 'key: ' || c_custkey || chr(9) || 'name: ' || c_name || chr(9) || 'segment: ' || c_mktsegment AS line
FROM customer
""")
def k6_table_to_kv(spark, sf):
    header = F.array(F.lit("key"), F.lit("name"), F.lit("segment"))
    row = F.concat(F.lit("|"), F.concat_ws(" | ", F.col("c_custkey").cast("string"), "c_name", "c_mktsegment"), F.lit(" |"))
    return Tables(spark, sf).customer.select("c_custkey", K.table_to_kv(header, K.table_cells(row)).alias("line"))


@register("k7_synth_header", """
SELECT c_custkey, array_to_string(list_transform(range(c_custkey % 60 + 1), lambda i:
  'C_' || CASE WHEN i >= 26 THEN chr(CAST(64 + i // 26 AS INTEGER)) ELSE '' END || chr(CAST(65 + i % 26 AS INTEGER))), ',')
  AS header FROM customer
""")
def k7_synth_header(spark, sf):
    n = (F.col("c_custkey") % 60 + 1).cast("int")
    return Tables(spark, sf).customer.select("c_custkey", F.array_join(K.synth_header(n), ",").alias("header"))


@register("k8_row_cost", """
SELECT c_custkey, CAST(2 + length(c_name) + 2 + length(c_mktsegment) + 2 + length(CAST(c_custkey AS VARCHAR)) + 2 - 1
  AS INTEGER) AS cost FROM customer
""")
def k8_row_cost(spark, sf):
    row = F.concat(F.lit(" |  "), F.concat_ws("  |", "c_name", "c_mktsegment", F.col("c_custkey").cast("string")), F.lit("|"))
    return Tables(spark, sf).customer.select("c_custkey", K.row_cost(K.table_cells(row)).cast("int").alias("cost"))


@register("k12_squeeze_table", """
SELECT c_custkey, '| ' || c_name || ' | - |' || chr(10) || '| ' || c_mktsegment || ' | -:|' AS squeezed FROM customer
""")
def k12_squeeze_table(spark, sf):
    pad = F.repeat(F.lit(" "), (F.col("c_custkey") % 9 + 1).cast("int"))
    dashes = F.repeat(F.lit("-"), (F.col("c_custkey") % 5 + 1).cast("int"))
    block = F.concat(F.lit("|"), pad, F.col("c_name"), pad, F.lit("| "), dashes, F.lit(" |\n|"), pad, F.col("c_mktsegment"),
                     F.lit(" |  "), dashes, F.lit(":|"))
    return Tables(spark, sf).customer.select("c_custkey", K.squeeze_table(block).alias("squeezed"))
