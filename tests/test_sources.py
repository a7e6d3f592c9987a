"""File sources and sinks on hand-written inputs in a fresh scratch folder."""

import json
import os
import tempfile

from pyspark.sql import functions as F

from quarry.sources import files as S


def _scratch():
    return tempfile.mkdtemp(prefix="quarry-test-")


def test_category_dumps(spark):
    d = _scratch()
    with open(os.path.join(d, "cats.json"), "w") as f:
        f.write(json.dumps({"query": {"allcategories": [{"*": "角色", "pages": 12, "size": 12},
                                                         {"*": "空", "pages": 0, "size": 0}]}}) + "\n")
    cats = S.read_categories(spark, os.path.join(d, "cats.json"), site="ys").collect()
    assert [(r.site, r.cat_name, r.n_pages) for r in cats] == [("ys", "角色", 12)]
    with open(os.path.join(d, "pages.json"), "w") as f:
        f.write(json.dumps({"query": {"pages": {
            "1": {"pageid": 1, "title": "A", "touched": "2024-02-01T00:00:00Z",
                  "revisions": [{"timestamp": "2024-01-01T10:00:00Z", "slots": {"main": {"*": "内容"}}}]},
            "2": {"pageid": 2, "title": "B", "touched": "2024-02-01T00:00:00Z", "revisions": []}}}}) + "\n")
    pages = S.read_category_pages(spark, os.path.join(d, "pages.json"), with_content=True).collect()
    assert [(r.page_id, r.title, r.content) for r in pages] == [(1, "A", "内容")]
    assert str(pages[0].ts).startswith("2024-01-01 10:00")


def test_site_config_roundtrip(spark):
    d = _scratch()
    meta = {"spider": "wiki", "start_urls": [], "ignore_home": False,
            "categories": [{"cat_name": "x", "n_pages": 3, "score": 4.0}], "samples": ["s1", "s2"],
            "trim_rules": ["//nav", "//div[@class='ad']"]}
    with open(os.path.join(d, "meta.json"), "w") as f:
        json.dump(meta, f, ensure_ascii=False, indent=2)
    t = S.read_site_config(spark, os.path.join(d, "meta.json"), "zz")
    assert [r.rule for r in t["trim_rules"].orderBy("rule_no").collect()] == meta["trim_rules"]
    assert t["categories"].collect()[0].score == 4.0
    out = os.path.join(d, "out")
    other = t["samples"].limit(1).withColumn("site", F.lit("yy"))
    S.write_site_config(t["categories"], t["samples"].unionByName(other), t["trim_rules"], out)
    back = S.read_site_config(spark, os.path.join(out, "folder=zz"), "zz")
    for name, table in t.items():
        assert sorted(map(tuple, back[name].collect())) == sorted(map(tuple, table.collect()))
    yy = S.read_site_config(spark, os.path.join(out, "folder=yy"), "yy")
    assert yy["samples"].count() == 1 and yy["categories"].count() == 0


def test_feed_texts_fragments_jsonl_markdown(spark):
    d = _scratch()
    with open(os.path.join(d, "feed.jsonl"), "w") as f:
        f.write(json.dumps({"url": "u", "title": "t", "modified_at": "2024-01-01T00:00:00", "markdown": "# t",
                            "html": "<p>t</p>", "save_to": "h/ys/t"}) + "\n")
    assert S.read_feed(spark, os.path.join(d, "feed.jsonl")).collect()[0].markdown == "# t"
    os.makedirs(os.path.join(d, "texts"))
    for i in range(2):
        with open(os.path.join(d, "texts", f"{i}.md"), "w") as f:
            f.write(f"line a{i}\nline b{i}\n")
    tx = S.read_texts(spark, os.path.join(d, "texts", "*.md")).orderBy("path").collect()
    assert [r.text for r in tx] == ["line a0\nline b0\n", "line a1\nline b1\n"]
    for folder in ("c_a", "c_b"):
        os.makedirs(os.path.join(d, "frags", folder))
        for i in range(3):
            with open(os.path.join(d, "frags", folder, f"{i}.json"), "w") as f:
                json.dump({"summary": f"s{i}", "dialog": f"甲：{i}"}, f, ensure_ascii=False, indent=2)
    fr = S.read_fragments(spark, os.path.join(d, "frags"))
    assert sorted((r.folder, r.frag_no) for r in fr.collect()) == [(a, i) for a in ("c_a", "c_b") for i in range(3)]
    rows = spark.createDataFrame([("甲", '[{"input":"你好"}]'), ("乙", "[]")], "character STRING, j STRING")
    S.write_jsonl(rows, os.path.join(d, "jsonl"), "j", "character")
    back = spark.read.text(os.path.join(d, "jsonl", "character=甲")).collect()
    assert back[0].value == '[{"input":"你好"}]'
    items = spark.createDataFrame([("h/ys/A", "A", None, "# A"), ("h/ys/文件:x", "F", None, "x")],
                                  "save_to STRING, title STRING, modified_at TIMESTAMP, markdown STRING")
    S.write_markdown(items, os.path.join(d, "md"))
    got = spark.read.parquet(os.path.join(d, "md")).collect()
    assert [(r.site, r.save_to) for r in got] == [("ys", "h/ys/A")]


def test_incremental_upsert(spark):
    stored = spark.createDataFrame([(1, "v1", "a"), (2, "v1", "b")], "k INT, v STRING, x STRING")
    new = spark.createDataFrame([(1, "v1", "a2"), (2, "v2", "b2"), (3, "v1", "c")], "k INT, v STRING, x STRING")
    changed, store = S.incremental_upsert(new, stored, "k", "v")
    assert sorted(r.k for r in changed.collect()) == [2, 3]
    assert sorted(tuple(r) for r in store.collect()) == [(1, "v1", "a"), (2, "v2", "b2"), (3, "v1", "c")]
