"""HTML node table: parse, removal rules, template pruning, planning helpers."""

from pyspark.sql import functions as F

from quarry.operators import html as H


def _nodes(spark, pages):
    return H.parse_nodes(spark.createDataFrame(pages, "page_id LONG, html STRING"))


def _tags(df, pid=1):
    return [r.tag or ("#" + r.kind) for r in df.where(F.col("page_id") == pid).orderBy("node_id").collect()]


def test_parse_implied_closes_and_clean(spark):
    n = _nodes(spark, [(1, "<div><p>a<b>x<p>b</div><!--c--><script>s</script><span> </span><img alt=1>")])
    assert _tags(n) == ["div", "p", "#text", "b", "#text", "p", "#text", "#comment", "script", "#text",
                        "span", "#text", "img"]
    cleaned = H.clean_html(n)
    assert _tags(cleaned) == ["div", "p", "#text", "b", "#text", "p", "#text", "img"]


def test_trim_rules_and_hits(spark):
    n = _nodes(spark, [(1, "<div class='ad'>x</div><nav>n</nav><p>keep</p>"), (2, "<p>y</p><div class='ad'>z</div>")])
    out = H.apply_trim_rules(n, ["//div[@class='ad']", "//nav"])
    assert _tags(out) == ["p", "#text"]
    rules = spark.createDataFrame([(0, "//div[@class='ad']"), (1, "//aside")], "rule_no INT, rule STRING")
    hits = {r.rule_no: (r.n_hits, r.n_pages, r.rejected) for r in H.rule_hits(n, rules).collect()}
    assert hits == {0: (2, 2, False), 1: (0, 0, True)}


def _ref_prune(page, tpl):
    # plain restatement of the ordered child matching, on nested (tag, cls, children) tuples
    def same(a, b):
        return isinstance(a, tuple) and isinstance(b, tuple) and a[0] == b[0] and a[1] == b[1]

    def prune(o, s):
        if not o[2] or not s[2]:
            return o
        kept, j = [], 0
        for child in o[2]:
            if j < len(s[2]) and same(child, s[2][j]):
                kept.append(prune(child, s[2][j]))
                j += 1
        return (o[0], o[1], kept)
    return prune(page, tpl)


def _render(t):
    if not isinstance(t, tuple):
        return t
    cls = f' class="{t[1]}"' if t[1] else ""
    return f"<{t[0]}{cls}>" + "".join(_render(c) for c in t[2]) + f"</{t[0]}>"


def test_prune_to_template_matches_restatement(spark):
    import random
    rng = random.Random(4)

    def tree(d):
        kids = [] if d == 0 else [tree(d - 1) if rng.random() < 0.7 else "t" for _ in range(rng.randint(0, 3))]
        return (rng.choice(["div", "p", "ul"]), rng.choice([None, "a", "b"]), kids)
    pages = [("html", None, [tree(3)]) for _ in range(25)]
    tpl = ("html", None, [tree(3)])
    n = _nodes(spark, [(i, _render(p)) for i, p in enumerate(pages)])
    t = _nodes(spark, [(999, _render(tpl))])
    out = H.prune_to_template(n, t)
    got = H.render_html(out).collect()
    by = {r.page_id: r.html for r in got}
    for i, p in enumerate(pages):
        want = _render(_ref_prune(p, tpl))
        assert by.get(i, "") == want.replace(' class="', ' class="') or by.get(i) == want


def test_plan_pages_and_stop(spark):
    pages = spark.createDataFrame([(1,), (2,), (3,)], "page_id INT")
    att = spark.createDataFrame([(1, "exhausted"), (2, "planned"), (2, "planned"), (3, "planned")],
                                "page_id INT, state STRING")
    assert [r.page_id for r in H.plan_pages(pages, att).collect()] == [3, 2]
    tries = spark.createDataFrame([(1, i, s) for i, s in enumerate(["planned", "exhausted", "exhausted", "exhausted"])]
                                  + [(2, 0, "exhausted"), (2, 1, "exhausted")], "rule_id INT, attempt_no INT, state STRING")
    assert {r.rule_id: r.stop for r in H.all_last_n(tries).collect()} == {1: True, 2: False}


def test_to_markdown_blocks(spark):
    n = _nodes(spark, [(1, '<article><h2>T</h2><p>a <b>bold</b> <a href="/x">link</a> <i>it</i></p>'
                           '<ul><li>one</li><li>two</li></ul><p><img alt="pic" title="t"><img></p></article>')])
    md = H.to_markdown(n).collect()[0].markdown
    assert md == '## T\n\na **bold** link *it*\n\n* one\n\n* two\n\n![pic]( "t")'


def test_to_markdown_keeps_order_lists_tables_and_loose_text(spark):
    cases = {1: "<main>loose <article>in</article> tail</main>", 2: "<div>head <p>para</p> tail</div>",
             3: "<ol><li><p>one</p><p>more</p></li><li>two<ul><li>deep</li></ul></li></ol>",
             4: "<table><tr><th>A</th><th>B</th></tr><tr><td></td><td>x <b>y</b></td></tr></table><p>end</p>", 5: "<p> </p>"}
    got = {r.page_id: r.markdown for r in H.to_markdown(_nodes(spark, list(cases.items()))).collect()}
    assert got == {1: "loose\n\nin\n\ntail", 2: "head\n\npara\n\ntail", 3: "1. one\n\n  more\n\n2. two\n\n  + deep",
                   4: "| A | B |\n| --- | --- |\n|  | x **y** |\n\nend"}


def test_following_sibling_rule(spark):
    n = _nodes(spark, [(1, '<div class="x bread-edit"></div><p>a</p><div><i>gone</i></div><div>stays</div>'
                           '<section><div>other parent</div></section>')])
    rule = "//div[contains(@class,'bread-edit')]/following-sibling::div[1]"
    text = [r.text for r in H.apply_trim_rules(n, [rule, "//nav"]).where("kind = 'text'").orderBy("node_id").collect()]
    assert text == ["a", "stays", "other parent"]
    rules = spark.createDataFrame([(0, rule)], "rule_no INT, rule STRING")
    assert H.rule_hits(n, rules).collect()[0].n_hits == 1


def test_adjacent_repeats_matches_definition():
    import random
    rng = random.Random(8)
    for _ in range(3000):
        x = [rng.randint(0, rng.choice([1, 2, 4])) for _ in range(rng.randint(0, 14))]
        marked = [v % 2 == 0 for v in x]
        tries = []
        for s in range(len(x)):
            for p in range(1, len(x)):
                c = 1
                while x[s + c * p:s + (c + 1) * p] == x[s:s + p] and s + (c + 1) * p <= len(x):
                    c += 1
                    if any(marked[s:s + p]):
                        tries.append((-c, s + (c - 1) * p, p, s))
        want = min(tries, default=None)
        assert H.adjacent_repeats(x, marked) == (want and (want[3], want[2], -want[0])), x
    assert H.adjacent_repeats([0] * 200_000, [True] * 200_000) == (0, 1, 200_000)
    assert H.adjacent_repeats(list(range(200_000)), [True] * 200_000) is None


def test_collapse_siblings_rules(spark):
    cases = {
        1: ("<table><tr><td>1</td></tr><tr></tr><tr></tr></table><ul><li>a</li><li>b</li></ul>",
            "<table><tr><td>1</td></tr><tr></tr></table><ul><li>a</li></ul>"),
        # an equal tail keeps one; an unmarked one stays
        2: ('<div><p id="x"></p><p class="a"></p><p class="a"></p><p class="a"></p></div>', '<div><p id="x"></p><p class="a"></p></div>'),
        3: ('<div><p></p><p></p></div>', '<div><p></p><p></p></div>'),
        # the run of most copies, from the very first child on; the rest stays
        4: ('<div><p class="a"></p><b></b><p class="a"></p><b></b><p class="a"></p><b></b><i></i></div>',
            '<div><p class="a"></p><b></b><i></i></div>'),
        # children first: the lists differ until they are collapsed
        5: ('<div><s class="a"><ul><li></li></ul></s><s class="a"><ul><li></li><li></li></ul></s><q></q></div>',
            '<div><s class="a"><ul><li></li></ul></s><q></q></div>'),
        # text is a child, and equal elements of other text differ
        6: ('<div><p class="a">1</p><p class="a">2</p><p class="a">2</p></div>', '<div><p class="a">1</p><p class="a">2</p></div>'),
        7: ("", None)}
    got = {r.page_id: r.html for r in H.render_html(H.collapse_siblings(_nodes(
        spark, [(i, h) for i, (h, _) in cases.items()]))).collect()}
    assert got == {i: w for i, (_, w) in cases.items() if w}


def test_structure_drops_inline_subtrees_and_text(spark):
    page = '<div class="m" id="i"><p>x</p><a href="/"><div class="in">y</div></a><section title="t">z<p></p></section></div>'
    got = H.render_html(H.structure_nodes(_nodes(spark, [(1, page)]))).collect()[0].html
    assert got == '<div class="m"><p></p><section></section></div>'


def test_text_rule(spark):
    n = _nodes(spark, [(1, "<div><b>an ad here</b><b><i>ad</i>ad</b><b>no</b><b><i>ad</i></b><p>ad</p></div>"), (2, "<b>x</b>ad")])
    out = H.apply_trim_rules(n, ["//b[contains(text(),'ad')]", "//nav"])
    got = {r.page_id: r.html for r in H.render_html(out).collect()}
    assert got == {1: "<div><b>no</b><b><i>ad</i></b><p>ad</p></div>", 2: "<b>x</b>ad"}
    rules = spark.createDataFrame([(0, "//*[contains(text(), 'ad')]"), (1, "//b[contains(text(),'ad') and @id='x']")], "rule_no INT, rule STRING")
    assert {r.rule_no: r.n_hits for r in H.rule_hits(n, rules).collect()} == {0: 5, 1: 0}


def test_left_prefix_counts_markup(spark):
    page = '<div class="a"><p>one &amp; two</p><img src="x"><ul><li>three</li><li>four</li></ul></div><p>end</p>'
    n = _nodes(spark, [(1, page)])
    whole = H.render_html(n).collect()[0].html
    order = [r.node_id for r in n.orderBy("node_id").collect()]
    for budget in range(0, len(whole) + 2, 3):
        kept = H.left_prefix(n, budget)
        ids = sorted(r.node_id for r in kept.collect())
        assert ids == order[:len(ids)]
        size = len(H.render_html(kept).collect()[0].html) if ids else 0
        assert size <= budget
        if len(ids) < len(order):  # one node more would not fit
            more = H.render_html(n.where(F.col("node_id") <= order[len(ids)])).collect()[0].html
            assert len(more) > budget


def test_parse_leaves_in_bounded_batches(monkeypatch):
    import pyarrow as pa
    schema = pa.schema([("page_id", pa.int64()), *((n, pa.int32()) for n in ("node_id", "subtree_end", "parent_id", "depth")),
                        ("kind", pa.string()), ("tag", pa.string()), ("attrs", pa.map_(pa.string(), pa.string())),
                        ("text", pa.string()), ("ancestors", pa.list_(pa.int32()))])
    pages = [(1, "<div class='a' id=b><p>x &amp; y<br><!--c--></div>" * 9), (None, "<i>z</i>"), (3, None), (4, ""), (5, "<p title>" + "long " * 40)]
    want = [[i, *r[:6], None if r[6] is None else list(r[6].items()), *r[7:]] for i, h in pages for r in H.html_to_rows(h)]
    monkeypatch.setattr(H, "FLUSH_NODES", 4)
    batches = list(H._node_batches(iter(pages), schema))
    assert max(b.num_rows for b in batches) == 4
    assert [list(r) for b in batches for r in zip(*[c.to_pylist() for c in b.columns])] == want
    monkeypatch.setattr(H, "FLUSH_NODES", 1000)
    monkeypatch.setattr(H, "FLUSH_SIZE", 20)  # characters and ancestors
    assert len(list(H._node_batches(iter(pages), schema))) > 3


def test_plain_markup_reads_as_by_the_base_class(monkeypatch):
    import random
    rng = random.Random(1)
    bits = ["<", "</", ">", "p", "style", " ", '"', "&amp;", "&", "<!--", "-->", "<p>", "</p>", '<a HREF="Q">', '<p class="a" id="b">', "<br/>", "</style>",
            "<style>", '<p a="b"c="d">', '<p a="b" >', "<LI>", "<ul>", "</UL>", "<title>", "</title>", '<p x="a&lt;">', "<textarea>"]
    pages = ["".join(rng.choice(bits) for _ in range(rng.randint(1, 14))) for _ in range(3000)]
    got = [H.html_to_rows(p) for p in pages]
    monkeypatch.setattr(H._TreeBuilder, "_plain", lambda self, i: i)
    assert got == [H.html_to_rows(p) for p in pages]


def test_collapse_has_no_python_call_for_each_page(spark):
    pages = [(i, f'<div><p class="a"></p>{"<b></b>" * (i % 3)}<p class="a"></p></div>') for i in range(300)]
    pages += [(None, '<ul><li>1</li><li>2</li></ul>'), (7, None)]
    got = H.collapse_siblings(_nodes(spark, pages))
    assert "FlatMapGroups" not in got._jdf.queryExecution().executedPlan().toString()
    html = {r.page_id: r.html for r in H.render_html(got).collect()}
    keep = ['<div><p class="a"></p></div>', '<div><p class="a"></p><b></b><p class="a"></p></div>', '<div><p class="a"></p><b></b><b></b><p class="a"></p></div>']
    assert html == {None: "<ul><li>1</li></ul>"} | {i: keep[i % 3] for i in range(300)}


def test_deep_page_costs_memory_by_nodes_not_by_depth(spark):
    import tracemalloc

    import pyarrow.compute as pc
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType
    schema = to_arrow_schema(StructType.fromDDL(H.NODE_SCHEMA))
    page, n = "<div>" * 3000, 0
    tracemalloc.start()
    for batch in H._node_batches(iter([(1, page)]), schema):
        ends = pc.list_value_length(batch.column(schema.get_field_index("ancestors"))).to_pylist()
        assert ends == list(range(n, n + batch.num_rows))
        n += batch.num_rows
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 3000 and peak < 20 << 20  # the ancestors of all rows at once take 36 MB


def test_html_steps_get_input_batches_of_bounded_bytes(spark):
    import pyarrow as pa
    setting = "spark.sql.execution.arrow.maxBytesPerBatch"
    pages = spark.range(0, 9000, 1, 1).select("id", F.repeat(F.lit("x"), 4000).alias("html"))

    def mapped(batches):
        for b in batches:
            yield pa.record_batch([pa.array([b.nbytes], pa.int64())], ["n"])

    @F.arrow_udf("long")
    def called(html: pa.Array) -> pa.Array:
        return pa.array([html.nbytes] * len(html), pa.int64())

    nodes = _nodes(spark, [(1, "<p>a</p>")])
    was = spark.conf.get(setting, "1b")  # 1b: not set
    try:
        for step in (lambda: H.parse_nodes(pages, "id"), lambda: H.collapse_siblings(nodes)):
            spark.conf.unset(setting)
            step()
            assert pages.mapInArrow(mapped, "n long").agg(F.max("n")).first()[0] < 6 << 20
            assert pages.select(called("html").alias("n")).agg(F.max("n")).first()[0] < 6 << 20
        spark.conf.set(setting, "1m")  # a bound of the session's own stays
        H.parse_nodes(pages, "id")
        assert spark.conf.get(setting) in ("1m", "1048576b")
    finally:
        spark.conf.set(setting, was) if was != "1b" else spark.conf.unset(setting)


def test_packed_pages_give_the_same_without_a_shuffle(spark):
    pages = spark.createDataFrame([(i, f'<div><p class="a">x &amp; {i}</p>{"<b></b>" * (i % 3)}<p class="a"></p><br></div><!--c-->') for i in range(50)]
                                  + [(None, "<ul><li>1</li><li>2</li></ul>"), (77, None), (78, "")], "page_id LONG, html STRING")
    want = H.render_html(H.collapse_siblings(H.parse_nodes(pages)))
    got = H.render_html(H.collapse_siblings(H.parse_nodes(pages, packed=True), packed=True), packed=True)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and got.count() == 51
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and plan.count("ArrowEvalPython") == 2


def test_cleaning_and_pruning_shuffle_nodes_once(spark):
    pages = [(1, "<div><p> </p><p>a<img></p><ul><li></li></ul><img></div>"), (2, "<p></p>"), (3, "<div><b><i> </i></b></div>x"),
             (None, "<p></p>"), (1, "<div><p> </p><p>a<img></p><ul><li></li></ul><img></div>")]
    clean = H.drop_blank(_nodes(spark, pages))
    rows = sorted((r.page_id or 0, r.node_id, r.tag or r.text) for r in clean.collect())
    one = [(1, 0, "div"), (1, 3, "p"), (1, 4, "a"), (1, 5, "img"), (1, 8, "img")]
    assert rows == sorted([(0, 0, "p"), (3, 4, "x"), *one, *one])
    pruned = H.prune_to_template(H.clean_html(_nodes(spark, pages)), _nodes(spark, [(9, "<div><p></p><img></div>")]))
    assert sorted((r.page_id, r.node_id) for r in pruned.collect()) == sorted([(1, 0), (1, 3), (1, 4), (1, 5), (1, 8)] * 2)
    plan = pruned._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("Exchange hash") == 1 and "Join" not in plan
