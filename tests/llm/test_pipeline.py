"""Registered queries and the pipeline: contract, and each stage against brute force on its own input."""

import hashlib
import importlib
import struct

import brute
import public_tokenizers
from test_operators import ranks_encoding

from quarry.llm import toxicity
from quarry.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
    assert set(ORACLE_SQL) <= set(QUERIES)
    entry = importlib.import_module("__spark_entry__")
    assert set(QUERIES) | {"pipeline"} <= set(entry.queries())


def test_native_queries_run_no_python(spark):
    for n in ("op2_lookup_shards", "op4_host_rules", "op5_secret_scan"):
        df = QUERIES[n](spark, SF)
        assert df.count() == 200
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert not any(w in plan for w in ("Python", "Pandas", "InArrow", "ExistingRDD")), n


def test_pipeline_stages(spark):
    import corpus_pipeline as pipe
    from quarry.llm.common import stored
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in pipe.STAGES:
        before = {r.doc_id: r for r in docs.collect()}
        docs = stored(stage(spark, docs, SF))
        kept[name] = before, {r.doc_id: r for r in docs.collect()}
        assert name == "byte_bpe" or docs.columns == columns
    before, after = kept["toxicity"]
    model = toxicity.fit(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))
    bad = {r.doc_id for r in toxicity.score(spark.read.parquet(f"{SF}/documents.parquet"), model).collect() if r.predicted}
    assert set(after) == set(before) - bad and bad
    before, after = kept["simhash"]
    ids = sorted(before)
    groups = brute.near_groups([brute.fingerprint(before[i].text) for i in ids], 4)
    assert set(after) == {i for k, i in enumerate(ids) if groups[k] == k}
    before, after = kept["decontamination"]
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert set(after) == {i for i, r in before.items() if not brute.contamination(r.text, items)[1]}
    before, after = kept["secrets"]
    assert set(after) == set(before)
    for i, r in after.items():
        assert brute.base_secrets(r.text) == "" and r.n_chars == len(r.text)
        assert r.text == before[i].text or "[SECRET]" in r.text
        assert brute.base_secrets(before[i].text) == "" or "[SECRET]" in r.text
    before, after = kept["byte_bpe"]
    enc = ranks_encoding()
    assert set(after) == set(before)
    for i, r in after.items():
        ids = enc.encode_ordinary(before[i].text)
        assert bytes(r.ids_bytes) == struct.pack(f"<{len(ids)}I", *ids)
        assert r.decoded_sha256 == hashlib.sha256(before[i].text.encode()).hexdigest()
    assert public_tokenizers.PATTERN
