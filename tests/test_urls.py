"""URL column functions on edge cases."""

from pyspark.sql import functions as F

from quarry.functions import urls as U


def test_resolve_and_decode(spark):
    base = "https://h.example.org/ys/dir/page?x=1#t"
    cases = [("/a", "https://h.example.org/a"), ("//cdn.example.org/x", "https://cdn.example.org/x"),
             ("?q=2", "https://h.example.org/ys/dir/page?q=2"), ("#frag", "https://h.example.org/ys/dir/page"),
             ("rel/b", "https://h.example.org/ys/dir/rel/b"), ("http://o.example/z", "http://o.example/z")]
    df = spark.createDataFrame([(base, h) for h, _ in cases], "u STRING, h STRING")
    got = [r.r for r in df.select(U.resolve(F.col("u"), F.col("h")).alias("r")).collect()]
    assert got == [w for _, w in cases]
    d = spark.createDataFrame([("a+b%20c",), ("bad%zz",), ("%E4%B8%AD",)], "s STRING")
    assert [r.x for r in d.select(U.unquote(F.col("s")).alias("x")).collect()] == ["a+b c", "bad%zz", "中"]
    k = spark.createDataFrame([("https://h/ys/%E6%96%87%E4%BB%B6:a.png?x#y",)], "u STRING").select(
        U.save_key(F.col("u")).alias("k"), U.url_leaf(F.col("u")).alias("leaf"),
        U.strip_suffix(U.url_leaf(F.col("u"))).alias("name"), U.is_static(F.col("u")).alias("st")).collect()[0]
    assert k.k == "h/ys/文件:a.png?x#y" and k.leaf == "%E6%96%87%E4%BB%B6:a.png" and k.st
    assert k.name == "%E6%96%87%E4%BB%B6:a"


def test_links_come_from_anchors_with_entities_and_dot_segments(spark):
    from quarry.operators import urls as L
    html = ('<link href="/style.css"><!-- <a href="/hidden">x</a> --><a class=k href="/ys/a?x=1&amp;y=2">a</a>'
            '<a href="../c">c</a><area href="./d/"><a name="n">no link</a><a href="/ys2/x">other</a>'
            "<script>var s='<a href=\"/js\">'</script>")
    pages = spark.createDataFrame([(1, "https://h.org/ys/dir/page", html), (2, "https://h.org/ys/e", ""),
                                   (3, "https://h.org/ys/n", None)], "page_id INT, url STRING, html STRING")
    got = sorted(r.link for r in L.extract_links(pages, F.lit("https://h.org/ys")).collect())
    assert got == ["https://h.org/ys/a?x=1&y=2", "https://h.org/ys/c", "https://h.org/ys/dir/d/"]


def test_reachable_walks_cycles_and_long_chains_to_the_end(spark):
    from quarry.operators import urls as L
    edges = spark.createDataFrame([(str(i), str(i + 1)) for i in range(20)] + [("20", "0"), ("x", "y"), (None, "z"),
                                                                                ("3", None)], "src STRING, dst STRING")
    seeds = spark.createDataFrame([("0",), ("0",), (None,)], "node STRING")
    got = {r.node: r.depth for r in L.reachable(edges, seeds).collect()}
    assert got == {str(i): i for i in range(21)}
    assert {r.node for r in L.reachable(edges, seeds, max_depth=2).collect()} == {"0", "1", "2"}
    assert L.reachable(edges.limit(0), seeds.limit(0)).count() == 0
