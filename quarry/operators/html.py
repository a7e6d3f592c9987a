"""HTML page processing on a node table.

One parse per page (:func:`parse_nodes`, the only Python step) turns HTML into pre-order
node rows::

    page_id, node_id, subtree_end, parent_id, depth, kind, tag, attrs, text, ancestors

``node_id`` is the pre-order number and ``subtree_end`` the node_id of the last
descendant, so a subtree is the id range ``[node_id, subtree_end]``. After that every
operator is relational:

* removing the subtrees of "hit" nodes is a running max of ``subtree_end`` over hits in
  node order (a node is inside a removed subtree iff that max reaches it);
* "element has no visible text": the first non-blank text from it on, a running min
  in reverse node order, is behind its ``subtree_end``.

The node table is repartitioned by ``page_id`` once, right after the parse, so every
later window and self-join reuses that partitioning. A page is one row of the input,
so its nodes are bounded by the size of one page.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from html import unescape
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from ..functions.urls import unquote

# Fixed values that must match the reference behaviour.
INTERACTIVE_TAGS = ["script", "style", "noscript", "svg", "iframe", "video", "audio", "source", "track", "link",
                    "meta", "object", "param", "input", "label", "select", "textarea", "button", "fieldset",
                    "legend", "datalist", "output", "option", "optgroup", "br", "hr", "wbr", "col", "colgroup",
                    "map", "area", "base", "embed"]
INLINE_TAGS = ["a", "abbr", "acronym", "b", "bdo", "big", "br", "button", "cite", "code", "dfn", "em", "i", "img",
               "input", "kbd", "label", "map", "object", "output", "q", "samp", "script", "select", "small", "span",
               "strong", "sub", "sup", "textarea", "time", "tt", "var"]
KEPT_ATTRIBUTES = ["class", "id", "title", "alt", "href", "src"]

NODE_SCHEMA = ("page_id long, node_id int, subtree_end int, parent_id int, depth int, kind string, tag string, "
               "attrs map<string,string>, text string, ancestors array<int>")

# HTML void elements (never have children) and scope rules for implied end tags.
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_CLOSES_P = {"p", "div", "ul", "ol", "table", "h1", "h2", "h3", "h4", "h5", "h6", "article", "section", "nav",
             "footer", "header", "aside", "pre", "blockquote", "form", "hr", "dl", "main", "figure"}
_SCOPE = {"html", "body", "article", "section", "div", "td", "th", "table", "li", "nav", "footer", "header", "main"}


# A plain end tag, a plain start tag with its attributes, or text before a tag; the base class reads them alike in more steps.
_PLAIN = re.compile(r'<(?:/([a-zA-Z][a-zA-Z0-9]*)|([a-zA-Z][a-zA-Z0-9]*)((?: [a-zA-Z][a-zA-Z-]*="[^"&<>]*")*))>|([^<]+)(?=<)')
_PLAIN_ATTR = re.compile(r' ([a-zA-Z-]+)="([^"]*)"')
# Elements whose content some version of the base class reads in a mode of its own.
_MODES = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes", "noscript", "plaintext"}


class _TreeBuilder(HTMLParser):
    """Lenient pre-order tree builder: implied ``</p>`` / ``</li>``, stray end tags ignored."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.rows: list[list] = []
        self.stack: list[int] = []  # indexes into rows of open elements

    def updatepos(self, i, j):
        return j  # nobody asks for lines and columns

    def _plain(self, i):
        """Reads plain tags and texts from ``i`` on; where the first other thing begins."""
        raw = self.rawdata
        while m := _PLAIN.match(raw, i):
            end, start, attrs, text = m.groups()
            if end:
                self.handle_endtag(end)
            elif start:
                if (start := start.lower()) in _MODES:
                    break
                self.lasttag = start
                self.handle_starttag(start, _PLAIN_ATTR.findall(attrs) if attrs else [])
            else:
                self.handle_data(unescape(text))
            i = m.end()
        return i

    def parse_starttag(self, i):
        after = self._plain(i)
        return after if after > i else super().parse_starttag(i)

    def parse_endtag(self, i):
        after = self._plain(i) if self.cdata_elem is None else i
        return after if after > i else super().parse_endtag(i)

    def _add(self, kind, tag, attrs, text):
        parent = self.rows[self.stack[-1]][0] if self.stack else -1
        nid = len(self.rows)
        self.rows.append([nid, nid, parent, len(self.stack), kind, tag, attrs, text])
        return nid

    def _close_to(self, i):
        while len(self.stack) > i:
            self.stack.pop()

    def _find_open(self, tag, scope=True):
        for i in range(len(self.stack) - 1, -1, -1):
            t = self.rows[self.stack[i]][5]
            if t == tag:
                return i
            if scope and (t in _SCOPE and t != tag or tag == "li" and t in ("ul", "ol")):
                return -1
        return -1

    def handle_starttag(self, tag, attrs):
        tag = tag.lower()
        if tag in _CLOSES_P:
            i = self._find_open("p")
            if i >= 0:
                self._close_to(i)
        if tag == "li":
            i = self._find_open("li")
            if i >= 0:
                self._close_to(i)
        nid = self._add("element", tag, {k.lower(): (v if v is not None else "") for k, v in attrs}, None)
        if tag not in _VOID:
            self.stack.append(nid)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag.lower() not in _VOID and self.stack and self.rows[self.stack[-1]][5] == tag.lower():
            self.stack.pop()

    def handle_endtag(self, tag):
        i = self._find_open(tag.lower(), scope=False)
        if i >= 0:
            self._close_to(i)

    def handle_data(self, data):
        if data:
            self._add("text", None, None, data)

    def handle_comment(self, data):
        self._add("comment", None, None, data)

    def finish(self):
        self.close()
        # subtree_end: last descendant = max node id among descendants (pre-order)
        ends = [r[0] for r in self.rows]
        for r in reversed(self.rows):
            if r[2] >= 0:
                ends[r[2]] = max(ends[r[2]], ends[r[0]])
        for r, e in zip(self.rows, ends):
            r[1] = e
        return self.rows


def tree_rows(html: str) -> Iterator[list]:
    """Pre-order rows ``[node_id, subtree_end, parent_id, depth, kind, tag, attrs, text, ancestors]``. Ancestors are listed as
    a row goes out: those of all rows at once would grow with nodes times depth."""
    b = _TreeBuilder()
    b.feed(html or "")
    path: list[int] = []  # the last node of each depth
    for row in b.finish():
        del path[row[3]:]
        yield [*row, path[:]]
        path.append(row[0])


def html_to_rows(html: str) -> list[list]:
    """The rows of :func:`tree_rows`, all at once."""
    return list(tree_rows(html))


#: What a worker holds of parsed nodes before they leave it: nodes, or characters and ancestors in them.
FLUSH_NODES = 8192
FLUSH_SIZE = 1 << 20


def _node_batches(pages: Iterator[tuple[int | None, str | None]], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """The node rows of the pages in batches of a bounded size; a page may go on in the next batch. Maps and lists are
    gathered flat, with the places where each ends."""
    import pyarrow as pa
    fields = [f for f in schema if f.name not in ("attrs", "ancestors")]

    def batch() -> pa.RecordBatch:
        arrays = {f.name: pa.array(c, f.type) for f, c in zip(fields, plain)}
        # an offset that is null makes its map null
        starts = pa.array([0, *attr_ends], pa.int32(), mask=np.array([*no_attrs, False]))
        arrays["attrs"] = pa.MapArray.from_arrays(starts, pa.array(names, pa.string()), pa.array(values, pa.string()))
        arrays["ancestors"] = pa.ListArray.from_arrays(pa.array([0, *path_ends], pa.int32()), pa.array(paths, pa.int32()))
        return pa.RecordBatch.from_arrays([arrays[f.name].cast(f.type) for f in schema], schema=schema)

    def fresh() -> tuple[list, ...]:
        return [[] for _ in fields], [], [], [], [], [], []

    plain, names, values, attr_ends, no_attrs, paths, path_ends = fresh()
    chars = 0
    for pid, html in pages:
        for nid, end, parent, depth, kind, tag, attrs, text, ancestors in tree_rows(html):
            for column, x in zip(plain, (pid, nid, end, parent, depth, kind, tag, text)):
                column.append(x)
            if attrs:
                names.extend(attrs)
                values.extend(attrs.values())
                chars += sum(map(len, attrs.values()))
            attr_ends.append(len(names))
            no_attrs.append(attrs is None)
            paths.extend(ancestors)
            path_ends.append(len(paths))
            if text:
                chars += len(text)
            if len(path_ends) >= FLUSH_NODES or chars + len(paths) >= FLUSH_SIZE:
                yield batch()
                plain, names, values, attr_ends, no_attrs, paths, path_ends = fresh()
                chars = 0
    if path_ends:
        yield batch()


def _nodes_udf(schema: pa.Schema):
    """The node rows of each page as an array, without the page's id."""
    row_type = StructType(StructType.fromDDL(NODE_SCHEMA).fields[1:])

    @F.arrow_udf(ArrayType(row_type))
    def run(html: pa.Array) -> pa.Array:
        import pyarrow as pa
        batches = [*_node_batches(((i, h.as_py()) for i, h in enumerate(html)), schema)]
        rows = pa.Table.from_batches(batches, schema).combine_chunks()
        ends = np.cumsum(np.bincount(rows.column(0).to_numpy(), minlength=len(html)))
        fields = [rows.column(i).chunk(0) if batches else pa.array([], schema.field(i).type) for i in range(1, len(schema))]
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.StructArray.from_arrays(fields, fields=[*schema][1:]))
    return run.asNondeterministic()  # else a filter on its result is pushed below it, with a second parse


def parse_nodes(pages: DataFrame, key: str = "page_id", html: str = "html", packed: bool = False) -> DataFrame:
    """Pages → node table (one Arrow-batched Python pass), repartitioned by page. A worker holds an input batch of bounded
    bytes, the nodes of one page and one bounded batch of the output, however many pages there are. With ``packed`` a page stays one
    row, ``(key, _rows)`` with its nodes as an array, and nothing is shuffled; a worker then holds all nodes of an input batch. No two
    pages may have the same key there."""
    from pyspark.sql.pandas.types import to_arrow_schema
    schema = to_arrow_schema(StructType.fromDDL(NODE_SCHEMA))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = ((pid.as_py(), h.as_py()) for batch in batches for pid, h in zip(batch.column(0), batch.column(1)))
        yield from _node_batches(pairs, schema)

    from ..session import apply_workarounds, small_batches
    apply_workarounds(pages.sparkSession)
    small_batches(pages.sparkSession)
    if packed:
        return pages.select(F.col(key).cast("long").alias(key), _nodes_udf(schema)(F.col(html)).alias("_rows")).where(F.size("_rows") > 0)
    nodes = pages.select(F.col(key).cast("long").alias(key), html).mapInArrow(run, NODE_SCHEMA)
    return nodes.withColumnRenamed("page_id", key).repartition(key)


def _remove_subtrees(nodes: DataFrame, hit: Column, key: str = "page_id") -> DataFrame:
    w = Window.partitionBy(key).orderBy("node_id").rowsBetween(Window.unboundedPreceding, 0)
    reach = F.max(F.when(hit, F.col("subtree_end"))).over(w)
    return nodes.withColumn("_gone", F.coalesce(reach >= F.col("node_id"), F.lit(False))) \
        .where(~F.col("_gone")).drop("_gone")


def remove_subtrees(nodes: DataFrame, hit: Column, key: str = "page_id") -> DataFrame:
    """Remove every node inside the subtree of a node where ``hit`` is true."""
    return _remove_subtrees(nodes, hit, key)


def drop_tags(nodes: DataFrame, tags=INTERACTIVE_TAGS, key: str = "page_id") -> DataFrame:
    """Drop comments and the listed (interactive/void) elements with their subtrees."""
    hit = (F.col("kind") == "comment") | ((F.col("kind") == "element") & F.col("tag").isin(*tags))
    return _remove_subtrees(nodes, hit, key)


_BLANK = r"^[\s\p{Z}]*$"
def drop_blank(nodes: DataFrame, key: str = "page_id") -> DataFrame:
    """Drop elements with no visible text in their subtree (``img`` itself is exempt).

    A subtree is a range of ids, so it holds text when the first non-blank text from its root on is not behind its end: a
    running minimum from the page's end, with no join. Earlier removals take whole subtrees, so ids and ends stay right.
    Nodes without a page id are kept.
    """
    text = F.when((F.col("kind") == "text") & ~F.col("text").rlike(_BLANK), F.col("node_id"))
    w = Window.partitionBy(key).orderBy(F.col("node_id").desc()).rowsBetween(Window.unboundedPreceding, 0)
    marked = nodes.withColumn("_next", F.min(text).over(w))
    blank = (F.col("kind") == "element") & (F.col("tag") != "img") & F.coalesce(F.col("_next") > F.col("subtree_end"), F.lit(True))
    return _remove_subtrees(marked, blank & F.col(key).isNotNull(), key).drop("_next")


def keep_attrs(nodes: DataFrame, names=KEPT_ATTRIBUTES) -> DataFrame:
    """P5: attribute whitelist."""
    allowed = F.array(*[F.lit(n) for n in names])
    return nodes.withColumn("attrs", F.map_filter("attrs", lambda k, v: F.array_contains(allowed, k)))


def decode_links(nodes: DataFrame) -> DataFrame:
    """Percent-decode ``href`` and ``src`` values (``+`` kept; undecodable kept raw)."""
    return nodes.withColumn("attrs", F.transform_values(
        "attrs", lambda k, v: F.when(k.isin("href", "src"), unquote(v)).otherwise(v)))


def clean_html(nodes: DataFrame, key: str = "page_id") -> DataFrame:
    """P3 → P4 → P5 (the reference's single post-order cleaning pass)."""
    return keep_attrs(drop_blank(drop_tags(nodes, key=key), key=key))


# ------------------------------------------------------------------ trim rules
def rule_predicate(rule: str, key: str = "page_id") -> Column:
    """Compile the supported XPath subset to a node predicate.

    Supported: ``//tag`` or ``//*`` with an optional ``[cond (and cond)*]`` where cond is
    ``@attr='v'`` (class matches as a whole string, as XPath does),
    ``contains(@attr,'v')`` or ``contains(text(),'v')`` (the element's first text child holds it; a window over an element and
    its text children), and such a rule followed by ``/following-sibling::tag[1]``: the first
    sibling of that tag after a match (a window over the siblings, so add the predicate as a column before
    using it inside another window). Anything else is rejected.
    """
    sibling = re.fullmatch(r"(.*)/following-sibling::([A-Za-z][A-Za-z0-9]*)\[1\]\s*", rule)
    if sibling:
        before = Window.partitionBy(key, "parent_id").orderBy("node_id").rowsBetween(Window.unboundedPreceding, -1)
        is_tag = (F.col("kind") == "element") & (F.col("tag") == sibling.group(2).lower())
        if "text()" in sibling.group(1):
            raise ValueError(f"unsupported trim rule: {rule!r}")
        match = F.max(F.when(rule_predicate(sibling.group(1)), F.col("node_id"))).over(before)
        same = F.max(F.when(is_tag, F.col("node_id"))).over(before)
        return is_tag & F.coalesce(match >= F.coalesce(same, F.lit(-1)), F.lit(False))
    m = re.fullmatch(r"\s*//([A-Za-z][A-Za-z0-9]*|\*)(?:\[(.*)\])?\s*", rule)
    if not m:
        raise ValueError(f"unsupported trim rule: {rule!r}")
    tag, conds = m.group(1).lower(), m.group(2)
    pred = F.col("kind") == "element"
    if tag != "*":
        pred = pred & (F.col("tag") == tag)
    if conds:
        for cond in re.split(r"\s+and\s+", conds.strip()):
            eq = re.fullmatch(r"@([\w-]+)\s*=\s*['\"](.*)['\"]", cond.strip())
            ct = re.fullmatch(r"contains\(\s*@([\w-]+)\s*,\s*['\"](.*)['\"]\s*\)", cond.strip())
            tx = re.fullmatch(r"contains\(\s*text\(\)\s*,\s*['\"](.*)['\"]\s*\)", cond.strip())
            if eq:
                pred = pred & F.coalesce(F.element_at("attrs", F.lit(eq.group(1))) == eq.group(2), F.lit(False))
            elif tx:
                # an element and its text children are one group
                family = F.when(F.col("kind") == "text", F.col("parent_id")).otherwise(F.col("node_id"))
                first = F.min(F.when(F.col("kind") == "text", F.struct("node_id", "text"))).over(Window.partitionBy(key, family))
                pred = pred & F.coalesce(first["text"].contains(tx.group(1)), F.lit(False))
            elif ct:
                pred = pred & F.coalesce(F.element_at("attrs", F.lit(ct.group(1))).contains(ct.group(2)), F.lit(False))
            else:
                raise ValueError(f"unsupported trim rule condition: {cond!r}")
    return pred


def rule_hits(nodes: DataFrame, rules: DataFrame, key: str = "page_id", samples: int = 5) -> DataFrame:
    """Per rule: matched elements and pages over all pages, ``rejected`` when nothing
    matched, and up to ``samples`` sample hits (first by page, node).

    Rules are few (a config list, collected once); each is a predicate column, so one scan
    of the node table evaluates all of them.
    """
    rl = [(r["rule_no"], r["rule"]) for r in rules.select("rule_no", "rule").collect()]
    if not rl:
        return rules.sparkSession.createDataFrame([], "rule_no int, n_hits long, n_pages long, rejected boolean, "
                                                  "sample_nodes array<struct<page_id:long,node_id:int>>")
    flags = F.array(*[F.when(rule_predicate(r, key), F.lit(no)) for no, r in rl])
    flagged = nodes.withColumn("_rules", F.array_compact(flags))
    h = flagged.select(key, "node_id", F.explode("_rules").alias("rule_no"))
    w = Window.partitionBy("rule_no").orderBy(key, "node_id")
    sampled = h.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= samples)
    stats = h.groupBy("rule_no").agg(F.count(F.lit(1)).alias("n_hits"), F.count_distinct(key).alias("n_pages"))
    smp = sampled.groupBy("rule_no").agg(F.array_sort(F.collect_list(F.struct(key, "node_id"))).alias("sample_nodes"))
    out = rules.select("rule_no").join(stats, "rule_no", "left").join(smp, "rule_no", "left")
    return out.select("rule_no", F.coalesce("n_hits", F.lit(0)).alias("n_hits"),
                      F.coalesce("n_pages", F.lit(0)).alias("n_pages"),
                      F.coalesce(F.col("n_hits"), F.lit(0)).__eq__(0).alias("rejected"), "sample_nodes")


def apply_trim_rules(nodes: DataFrame, rules: list[str], key: str = "page_id") -> DataFrame:
    """Remove every subtree matched by any rule."""
    if not rules:
        return nodes
    hit = F.lit(False)
    for r in rules:
        hit = hit | rule_predicate(r, key)
    return _remove_subtrees(nodes.withColumn("_hit", hit), F.col("_hit"), key).drop("_hit")


# ------------------------------------------------------------------ planning
def plan_pages(pages: DataFrame, attempts: DataFrame, key: str = "page_id", exhausted_state: str = "exhausted",
               empty: Column | None = None) -> DataFrame:
    """Pages not yet exhausted and not empty, least-attempted first (page id breaks ties)."""
    ex = attempts.where(F.col("state") == exhausted_state).select(key).distinct()
    cnt = attempts.groupBy(key).agg(F.count(F.lit(1)).alias("n_attempts"))
    d = pages.join(ex, key, "left_anti")
    if empty is not None:
        d = d.where(~empty)
    d = d.join(cnt, key, "left").withColumn("n_attempts", F.coalesce("n_attempts", F.lit(0)))
    return d.orderBy("n_attempts", key)


def all_last_n(attempts: DataFrame, n: int = 3, state: str = "exhausted", key: str = "rule_id",
               order: str = "attempt_no") -> DataFrame:
    """P10: per key, true when it has at least ``n`` attempts and the last ``n`` all have ``state``."""
    w = Window.partitionBy(key).orderBy(F.col(order).desc())
    last = attempts.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n)
    return last.groupBy(key).agg(((F.count(F.lit(1)) == n) & F.bool_and(F.col("state") == state)).alias("stop"))


# ------------------------------------------------------------------ structure
def structure_signature(nodes: DataFrame, key: str = "page_id") -> DataFrame:
    """Page skeleton (:func:`structure_nodes`) in order, by depth, tag and class; ``md5`` of it."""
    item = F.concat(F.col("depth").cast("string"), F.lit(":"), F.col("tag"),
                    F.coalesce(F.concat(F.lit("."), F.element_at("attrs", F.lit("class"))), F.lit("")))
    sig = structure_nodes(nodes, key).groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(
        F.struct("node_id", item.alias("s")))), lambda x: x["s"]), "|").alias("skeleton"))
    return sig.withColumn("signature", F.md5("skeleton"))


def structure_nodes(nodes: DataFrame, key: str = "page_id") -> DataFrame:
    """The page skeleton as a node table: cleaned (P3-P5), without inline elements and what is in them, without text; of the
    attributes only ``class`` stays."""
    inline = (F.col("kind") == "element") & F.col("tag").isin(*INLINE_TAGS)
    bare = _remove_subtrees(clean_html(nodes, key), inline, key).where(F.col("kind") == "element")
    return bare.withColumn("attrs", F.map_filter("attrs", lambda k, v: k == "class"))


def adjacent_repeats(numbers: list[int], marked: list[bool]) -> tuple[int, int, int] | None:
    """``(start, period, copies)`` of the adjacent repeat with the most copies, two at least, that holds a marked
    element; of equal ones the one whose last copy begins first, then the shortest period. None without one.

    Equal neighbours at distance ``period`` form runs; a run of length r holds ``r // period + 1`` copies. A longer
    period can only win with as many copies as fit, so the search stops early; elements that occur once are in no repeat
    and cut the sequence.
    """
    best: tuple | None = None
    x, uses = np.asarray(numbers, np.int64), Counter(numbers)
    cuts = [-1, *(i for i, n in enumerate(numbers) if uses[n] == 1), len(numbers)]
    mark = np.concatenate([[0], np.cumsum(marked)])
    for lo, hi in zip([c + 1 for c in cuts], cuts[1:]):
        part, period = x[lo:hi], 1
        while period * (best[0] if best else 2) <= len(part):
            same = np.concatenate([[0], (part[period:] == part[:-period]).astype(np.int8), [0]])
            starts, ends = np.flatnonzero(np.diff(same) == 1), np.flatnonzero(np.diff(same) == -1)
            for s, e in zip(starts.tolist(), ends.tolist()):
                copies = (e - s) // period + 1
                start = lo + s
                if copies > 1 and mark[start + period] > mark[start]:
                    rank = (copies, -(start + (copies - 1) * period), -period, start)
                    best = max(best, rank) if best else rank
            period += 1
    return (best[3], -best[2], best[0]) if best else None


def _kept_children(tag: str | None, tags: list, numbers: list[int], classed: list[bool]) -> list[int]:
    """The places of the children that stay, by the four rules in their order."""
    n = len(numbers)
    if n > 1 and tag in ("table", "tbody") and tags[0] == "tr":
        return [0, 1]
    if n > 1 and tag in ("ul", "ol") and tags[0] == "li":
        return [0]
    tail = n - 1
    while tail > 0 and numbers[tail - 1] == numbers[-1]:
        tail -= 1
    if tail < n - 1 and classed[tail]:
        return list(range(tail + 1))
    found = adjacent_repeats(numbers, classed) if any(classed) and len(set(numbers)) < n else None
    if found:
        start, period, copies = found
        return [i for i in range(n) if not start + period <= i < start + copies * period]
    return list(range(n))


def _collapsed(parents: list[int], labels: list, tags: list, classed: list[bool]) -> list[bool]:
    """Whether each node of a page (pre-order; a parent's place, or -1) stays. Children are settled before their parent: a
    node's number stands for its label and the numbers of the children that stay, so equal numbers are equal subtrees."""
    n = len(parents)
    children: list[list[int]] = [[] for _ in range(n + 1)]
    for i, p in enumerate(parents):
        children[p].append(i)  # -1: the page itself
    numbers, known, stays = [0] * n, {}, [True] * n
    for i in range(n - 1, -2, -1):
        kids = children[i]
        if len(kids) > 1:
            kept = _kept_children(tags[i] if i >= 0 else None, [tags[c] for c in kids], [numbers[c] for c in kids],
                                  [classed[c] for c in kids])
            for c in set(kids) - {kids[k] for k in kept}:
                stays[c] = False
            kids = [kids[k] for k in kept]
        if i >= 0:
            numbers[i] = known.setdefault((labels[i], tuple(numbers[c] for c in kids)), len(known))
    for i, p in enumerate(parents):
        stays[i] = stays[i] and (p < 0 or stays[p])
    return stays


def collapse_siblings(nodes: DataFrame, key: str = "page_id", packed: bool = False) -> DataFrame:
    """Shrink repeated sibling structure, children before parents. The first rule that fits a parent of two or more
    children holds: a ``table``/``tbody`` whose first child is a ``tr`` keeps two; a ``ul``/``ol`` whose first child is an
    ``li`` keeps one; of equal last children (the first attribute is ``class``) the first stays; of the adjacent repeat with
    the most copies that holds such an element the first copy stays.

    Every node counts as a child, text too; see :func:`structure_nodes` for a tree without text. Subtrees are compared
    by numbers built bottom-up, page by page. A page is one row, so a worker gets many small pages in one batch, of
    each node only what the rules look at. ``packed`` pages (see :func:`parse_nodes`) come and go as rows.
    """
    from ..session import small_batches
    small_batches(nodes.sparkSession)
    pages = nodes if packed else nodes.groupBy(key).agg(F.collect_list(F.struct(*[c for c in nodes.columns if c != key])).alias("_rows"))
    label = lambda x: F.to_json(F.struct(x["kind"].alias("kind"), x["tag"].alias("tag"), F.map_entries(x["attrs"]).alias("attrs"), x["text"].alias("text")))
    classed = lambda x: F.coalesce(F.get(F.map_keys(x["attrs"]), F.lit(0)) == "class", F.lit(False))

    @F.arrow_udf("array<boolean>")
    def stays(ids: pa.Array, parents: pa.Array, tags: pa.Array, labels: pa.Array, marks: pa.Array) -> pa.Array:
        import pyarrow as pa
        offsets = np.concatenate([[0], np.cumsum(ids.value_lengths().to_numpy(zero_copy_only=False))])
        ids, parents, marks = (x.flatten().to_numpy(zero_copy_only=False) for x in (ids, parents, marks))
        tags, labels = tags.flatten(), labels.flatten().dictionary_encode().indices.to_numpy(zero_copy_only=False)
        out = np.ones(len(ids), bool)
        for lo, hi in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
            order = np.argsort(ids[lo:hi], kind="stable") + lo
            at = {x: i for i, x in enumerate(ids[order].tolist())}
            out[order] = _collapsed([at.get(p, -1) for p in parents[order].tolist()], labels[order].tolist(),
                                    tags.take(pa.array(order)).to_pylist(), marks[order].tolist())
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(out))

    of = lambda c: F.col(f"_rows.{c}")
    pages = pages.withColumn("_stays", stays(of("node_id"), of("parent_id"), of("tag"), F.transform("_rows", label), F.transform("_rows", classed)))
    kept = F.filter("_rows", lambda _, i: F.get(F.col("_stays"), i))
    return pages.select(key, kept.alias("_rows")) if packed else pages.select(key, F.inline(kept)).select(*nodes.columns)


def left_prefix(nodes: DataFrame, max_tokens: int, key: str = "page_id") -> DataFrame:
    """Keep the longest pre-order prefix whose rendered HTML (P16) has at most ``max_tokens`` tokens (characters).

    Ancestors of every kept node precede it in pre-order, so a prefix is a valid tree. An element costs its opening tag and, from
    there on, the closing tag that it will need; so the running cost at a node is the length of the prefix as rendered.
    """
    w = Window.partitionBy(key).orderBy("node_id").rowsBetween(Window.unboundedPreceding, 0)
    cost = F.length(_opening()) + F.when(_is_container(), F.length(_closing())).otherwise(F.lit(0))
    return nodes.withColumn("_t", F.sum(cost).over(w)).where(F.col("_t") <= max_tokens).drop("_t")


# ------------------------------------------------------------------ page meta
def page_meta(nodes: DataFrame, key: str = "page_id", title_tag: str = "title", main_tag: str = "article",
              time_meta: str = "article:modified_time") -> DataFrame:
    """Title text, modified time (``<meta property=…>``) and main-content root per page;
    pages without the root are dropped (inner join)."""
    txt = nodes.where(F.col("kind") == "text").select(key, F.col("parent_id").alias("_t_parent"), "node_id", "text")
    titles = nodes.where((F.col("kind") == "element") & (F.col("tag") == title_tag)) \
        .groupBy(key).agg(F.min("node_id").alias("_tid"))
    ttext = txt.join(titles, (txt[key] == titles[key]) & (txt["_t_parent"] == titles["_tid"])).drop(titles[key]) \
        .groupBy(key).agg(F.trim(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("node_id", "text"))),
                                                        lambda s: s["text"]), "")).alias("title"))
    meta = nodes.where((F.col("tag") == "meta") & (F.element_at("attrs", F.lit("property")) == time_meta)) \
        .groupBy(key).agg(F.first(F.element_at("attrs", F.lit("content")), ignorenulls=True).alias("modified_at"))
    root = nodes.where((F.col("kind") == "element") & (F.col("tag") == main_tag)) \
        .groupBy(key).agg(F.min(F.struct("node_id", "subtree_end")).alias("_root"))
    return root.select(key, F.col("_root.node_id").alias("root_id"), F.col("_root.subtree_end").alias("root_end")) \
        .join(ttext, key, "left").join(meta, key, "left")


def main_content(nodes: DataFrame, meta: DataFrame, key: str = "page_id") -> DataFrame:
    """Nodes inside each page's main-content root (the root included)."""
    m = meta.select(key, "root_id", "root_end")
    return nodes.join(m, key).where((F.col("node_id") >= F.col("root_id")) & (F.col("node_id") <= F.col("root_end"))) \
        .drop("root_id", "root_end")


# ------------------------------------------------------------------ rendering
_BLOCKS = ["h1", "h2", "h3", "h4", "h5", "h6", "p", "li", "td", "th", "pre", "blockquote", "div", "article",
           "section", "dd", "dt", "figcaption", "caption"]


def _opening(of: Callable[[str], Column] = F.col) -> Column:
    """A node as rendered, an element without its content and closing tag."""
    attrs = F.array_join(F.transform(F.array_sort(F.map_entries(of("attrs"))),
                                     lambda e: F.concat(F.lit(" "), e["key"], F.lit('="'),
                                                        F.replace(F.replace(e["value"], F.lit("&"), F.lit("&amp;")),
                                                                  F.lit('"'), F.lit("&quot;")), F.lit('"'))), "")
    esc = F.replace(F.replace(F.replace(of("text"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")),
                    F.lit(">"), F.lit("&gt;"))
    return (F.when(of("kind") == "element", F.concat(F.lit("<"), of("tag"), F.coalesce(attrs, F.lit("")), F.lit(">")))
            .when(of("kind") == "text", esc)
            .otherwise(F.concat(F.lit("<!--"), of("text"), F.lit("-->"))))


def _closing(of: Callable[[str], Column] = F.col) -> Column:
    return F.concat(F.lit("</"), of("tag"), F.lit(">"))


def _is_container(of: Callable[[str], Column] = F.col) -> Column:
    return (of("kind") == "element") & ~of("tag").isin(*sorted(_VOID))


def render_html(nodes: DataFrame, key: str = "page_id", packed: bool = False) -> DataFrame:
    """Serialise a (cleaned) node table back to HTML, one string per page. ``packed`` pages (see :func:`parse_nodes`) are rows."""
    rows = F.col("_rows")
    if packed:
        pages = nodes.select(key, F.transform(rows, lambda r: _rendered(lambda c: r[c])).alias("_rows"))
    else:
        pages = nodes.groupBy(key).agg(F.collect_list(_rendered(F.col)).alias("_rows"))
    opens = F.transform(rows, lambda r: F.struct(r["node_id"].alias("a"), F.lit(0).alias("b"), F.lit(0).alias("c"), r["open"].alias("s")))
    closes = F.transform(F.filter(rows, lambda r: r["close"].isNotNull()), lambda r: F.struct(
        r["subtree_end"].alias("a"), F.lit(1).alias("b"), (-r["depth"]).alias("c"), r["close"].alias("s")))
    return pages.select(key, F.array_join(F.transform(F.array_sort(F.concat(opens, closes)), lambda t: t["s"]), "").alias("html"))


def _rendered(of: Callable[[str], Column]) -> Column:
    return F.struct(*[of(c).alias(c) for c in ("node_id", "subtree_end", "depth")], _opening(of).alias("open"),
                    F.when(_is_container(of), _closing(of)).alias("close"))


def to_markdown(nodes: DataFrame, key: str = "page_id") -> DataFrame:
    """Main-content nodes → Markdown, one string per page.

    Text goes out in document order and none is lost: it is cut into runs of equal nearest block
    (``h1``-``h6``, ``p``, ``li``, …; text outside any block forms runs of its own), so text after an inner
    block starts a new run. Inline links become spaced text (their URL dropped); bold text is ``**…**`` and
    italics ``*…*``; images render as ``![alt]( "title")`` and vanish without alt and title. Headings get
    ``#`` marks. The first run of a list item gets its mark (``*``, ``+``, ``-`` by nesting, or its number in
    an ordered list), later ones its indent. A table row is one line of cells, with a rule below the first.
    """
    title = F.coalesce(F.element_at("attrs", F.lit("title")), F.lit(""))
    alt = F.coalesce(F.element_at("attrs", F.lit("alt")), F.lit(""))
    is_img = (F.col("tag") == "img") & ((alt != "") | (title != ""))
    is_cell = F.col("tag").isin("td", "th")
    img_md = F.concat(F.lit("!["), alt, F.lit("]("),
                      F.when(title != "", F.concat(F.lit(' "'), F.replace(title, F.lit('"'), F.lit('\\"')), F.lit('"')))
                      .otherwise(F.lit("")), F.lit(")"))
    is_text = F.col("kind") == "text"
    # an element cell is an empty piece of its own, so that empty cells keep their column
    pieces = nodes.where(is_text | ((F.col("kind") == "element") & (is_img | is_cell))).select(
        key, "node_id", "ancestors", F.when(~is_text & is_cell, F.col("node_id")).alias("_self"),
        F.when(is_text, F.regexp_replace("text", r"\s+", " ")).when(is_cell, "").otherwise(img_md).alias("piece"))
    anc = pieces.select(key, "node_id", F.explode_outer("ancestors").alias("a_id"))
    w_li = Window.partitionBy(key, "parent_id", "tag").orderBy("node_id")
    tags = nodes.where(F.col("kind") == "element").select(
        key, F.col("node_id").alias("a_id"), F.col("tag").alias("a_tag"), F.row_number().over(w_li).alias("a_no"))

    def nearest(*names):
        return F.max(F.when(F.col("a_tag").isin(*names), F.col("a_id")))

    def inside(*names):
        return F.coalesce(F.max(F.col("a_tag").isin(*names)), F.lit(False))
    anc = anc.join(tags, [key, "a_id"], "left").groupBy(key, "node_id").agg(
        F.max(F.when(F.col("a_tag").isin(*_BLOCKS), F.struct(F.col("a_id").alias("id"), F.col("a_tag").alias("tag"))))
        .alias("_b"),
        F.max(F.when(F.col("a_tag") == "li", F.struct(F.col("a_id").alias("id"), F.col("a_no").alias("no")))).alias("_li"),
        F.count_if(F.col("a_tag") == "li").alias("_deep"),
        F.max(F.when(F.col("a_tag").isin("ul", "ol"), F.struct(F.col("a_id").alias("id"), F.col("a_tag").alias("tag"))))
        .alias("_list"), nearest("tr").alias("_tr"), nearest("td", "th").alias("_td"), nearest("table").alias("_table"),
        inside("a").alias("_in_a"), inside("b", "strong").alias("_in_b"), inside("em", "i").alias("_in_i"))
    j = pieces.join(anc, [key, "node_id"])
    core = F.trim(F.col("piece"))
    marked = (F.when(core == "", F.col("piece"))
              .when(F.col("_in_b"), F.concat(F.lit("**"), core, F.lit("**")))
              .when(F.col("_in_i"), F.concat(F.lit("*"), core, F.lit("*")))
              .otherwise(F.col("piece")))
    in_row = F.col("_tr").isNotNull() & F.coalesce(F.col("_tr") > F.col("_li.id"), F.lit(True))
    j = j.withColumn("piece", F.when(F.col("_in_a"), F.concat(F.lit(" "), marked, F.lit(" "))).otherwise(marked)) \
        .withColumn("_row", in_row).withColumn("_unit", F.when(in_row, F.col("_tr")).otherwise(F.coalesce("_b.id", F.lit(-1)))) \
        .withColumn("_cell", F.when(in_row, F.coalesce("_self", "_td")))
    # blank text between blocks is no piece of a run; inside one it is a space
    by_page = Window.partitionBy(key).orderBy("node_id")
    j = j.withColumn("_run", F.sum(F.coalesce(F.col("_unit") != F.lag("_unit").over(by_page), F.lit(True)).cast("int"))
                     .over(by_page.rowsBetween(Window.unboundedPreceding, 0)))
    ordered = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("node_id", c))), lambda x: x[c])
    cells = j.groupBy(key, "_run", "_row", "_cell").agg(
        F.min("node_id").alias("node_id"), F.trim(F.regexp_replace(F.array_join(ordered("piece"), ""), r" {2,}", " "))
        .alias("body"), *[F.first(c).alias(c) for c in ("_b", "_li", "_deep", "_list", "_table")])
    runs = cells.groupBy(key, "_run", "_row").agg(
        F.array_join(ordered("body"), " | ").alias("body"), F.count_if(F.col("_cell").isNotNull()).alias("_n"),
        F.count_if(F.col("body") != "").alias("_full"), *[F.first(c).alias(c) for c in ("_b", "_li", "_deep", "_list", "_table")])
    runs = runs.where(F.col("_full") > 0)
    first_of = lambda c: F.col("_run") == F.min("_run").over(Window.partitionBy(key, c, "_row"))
    runs = runs.withColumn("_first", F.when(F.col("_row"), first_of("_table")).otherwise(first_of("_li.id")))
    b_tag = F.coalesce(F.col("_b.tag"), F.lit(""))
    level = F.when(b_tag.rlike("^h[1-6]$"), F.substring(b_tag, 2, 1).cast("int"))
    body = F.when(level.isNotNull(), F.concat(F.repeat(F.lit("#"), level), F.lit(" "), F.col("body"))).otherwise(F.col("body"))
    indent = F.repeat(F.lit("  "), (F.col("_deep") - 1).cast("int"))
    mark = F.when(F.col("_list.tag") == "ol", F.concat(F.col("_li.no").cast("string"), F.lit(". "))).otherwise(
        F.concat(F.substring(F.lit("*+-"), ((F.col("_deep") - 1) % 3 + 1).cast("int"), F.lit(1)), F.lit(" ")))
    row = F.concat(F.lit("| "), F.col("body"), F.lit(" |"))
    line = (F.when(F.col("_row") & F.col("_first"), F.concat(row, F.lit("\n|"), F.repeat(F.lit(" --- |"), F.col("_n").cast("int"))))
            .when(F.col("_row"), row)
            .when(F.col("_li").isNull(), body)
            .when(F.col("_first"), F.concat(indent, mark, body))
            .otherwise(F.concat(indent, F.lit("  "), body)))
    gap = F.when(F.col("_row") & ~F.col("_first"), "\n").otherwise("\n\n")
    lines = runs.select(key, "_run", F.concat(gap, line).alias("line"))
    return lines.groupBy(key).agg(F.substring(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("_run", "line"))), lambda x: x["line"]), ""), 3, 1 << 30).alias("markdown"))


# ------------------------------------------------------------------ template pruning
MAX_TEMPLATE_NODES = 200_000


def _children(rows):
    kids: dict[int, list[int]] = {}
    for nid, parent in rows:
        kids.setdefault(parent, []).append(nid)
    return kids


def prune_tree(page: dict, tpl: dict) -> set[int]:
    """Kept node ids of one page pruned to a template (both: ``{node_id: (parent, kind, tag, cls)}``).

    Children are matched in order: a page child equal to the current template child (same
    element name and class) is kept and matched recursively; any other page child is
    removed; page children left after the template's run out are removed too. Text and
    comment nodes never match. Where the template node has no children the page keeps the
    whole subtree. The virtual roots (top-level nodes) are matched the same way.
    """
    pk = _children(sorted((n, v[0]) for n, v in page.items()))
    tk = _children(sorted((n, v[0]) for n, v in tpl.items()))

    def same(o, s):
        a, b = page[o], tpl[s]
        return a[1] == "element" and b[1] == "element" and a[2] == b[2] and a[3] == b[3]

    keep: set[int] = set()
    stack = [(-1, -1)]
    while stack:
        o, s = stack.pop()
        oc, sc = pk.get(o, []), tk.get(s, [])
        if not sc and o != -1:
            # the template stops here: the page keeps this node's whole subtree
            sub = list(oc)
            while sub:
                x = sub.pop()
                keep.add(x)
                sub.extend(pk.get(x, []))
            continue
        j = 0
        for child in oc:
            if j < len(sc) and same(child, sc[j]):
                keep.add(child)
                stack.append((child, sc[j]))
                j += 1
    return keep


def prune_to_template(nodes: DataFrame, template: DataFrame, key: str = "page_id") -> DataFrame:
    """Prune every page to the template tree (a node table of one page).

    The template is configuration-sized; no more than a bounded number of its nodes is read before it is
    shipped to the tasks. Pages are pruned independently, each a row of an Arrow function that gets of a node only what
    is compared, and keep the partitioning of the node table. Nodes without a page id go.
    """
    from ..session import small_batches
    small_batches(nodes.sparkSession)
    rows = template.select("node_id", "parent_id", "kind", "tag", F.element_at("attrs", F.lit("class")).alias("cls")) \
        .limit(MAX_TEMPLATE_NODES + 1).collect()
    if len(rows) > MAX_TEMPLATE_NODES:
        raise ValueError(f"template has more than {MAX_TEMPLATE_NODES} nodes, which are supported at most")
    tpl = {r.node_id: (r.parent_id, r.kind, r.tag, r.cls) for r in rows}
    others = [c for c in nodes.columns if c != key]
    pages = nodes.where(F.col(key).isNotNull()).groupBy(key).agg(F.collect_list(F.struct(
        *others, F.element_at("attrs", F.lit("class")).alias("_cls"))).alias("_rows"))

    @F.arrow_udf("array<boolean>")
    def stays(ids: pa.Array, parents: pa.Array, kinds: pa.Array, tags: pa.Array, classes: pa.Array) -> pa.Array:
        import pyarrow as pa
        out = []
        for page in zip(ids, parents, kinds, tags, classes):
            n, *of = (c.as_py() for c in page)
            kept = prune_tree(dict(zip(n, zip(*of))), tpl)
            out.append([x in kept for x in n])
        return pa.array(out, pa.list_(pa.bool_()))

    of = lambda c: F.col(f"_rows.{c}")
    pages = pages.withColumn("_stays", stays(of("node_id"), of("parent_id"), of("kind"), of("tag"), of("_cls")))
    kept = F.filter("_rows", lambda _, i: F.get(F.col("_stays"), i))
    return pages.select(key, F.inline(kept)).select(*nodes.columns)
