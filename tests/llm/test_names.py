"""Operators on tables whose columns bear the operators' own and internal names."""

import public_tokenizers
from pyspark.sql import functions as F

from quarry.llm import byte_bpe, secret_scan, shard, toxicity

INTERNAL = ("_text", "__text", "_hits", "_slot", "_shard", "_place", "_number", "_row", "_base", "_cands", "_t", "_masked", "c0", "c1", "spans",
            "_least", "block", "hits")


def clashing(spark, rows):
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    for c in INTERNAL:
        df = df.withColumn(c, F.concat(F.lit(c), F.lit("!")))
    return df


def kept(before, after):
    """All columns of the table are there, once, with their values."""
    assert all(after.columns.count(c) == 1 for c in before.columns)
    got = {r.doc_id: r for r in after.collect()}
    assert len(got) == before.count()
    for r in got.values():
        assert all(r[c] == f"{c}!" for c in INTERNAL)
    return got


def test_internal_names(spark):
    secret = "password=abcdef0123456789xyz"
    df = clashing(spark, [(1, "you idiot"), (2, None), (3, f"a {secret} b"), (4, "")])
    got = kept(df, byte_bpe.round_trip(df, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN))
    assert got[2].n_tokens == 0 < got[1].n_tokens
    model = toxicity.Model([toxicity.Term("idiot", False, True, True)], list(toxicity.PRIOR_WEIGHTS))
    got = kept(df, toxicity.score(df.withColumn("score", F.lit("x")), model))
    assert got[1].score > got[2].score == got[4].score
    got = kept(df, shard.assign(df.withColumn("shard", F.lit("x")), "doc_id", ["a", "b"], 11))
    assert {r.shard for r in got.values()} <= {"a", "b"}
    out = secret_scan.redact(df)
    assert out.columns == df.columns
    assert kept(df, out)[3].text == "a [SECRET] b"
