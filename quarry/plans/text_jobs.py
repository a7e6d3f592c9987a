"""Registered text queries (T1-T5) over ``documents``."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as FT
from ..operators import text as T
from .registry import Tables, register

_TOK = r"'(?s)[\x{4e00}-\x{9fff}]|\w+| |.'"


@register("t1_dedup_ngrams")
def t1_dedup_ngrams(spark, sf):
    d = T.spread(Tables(spark, sf).documents.select("doc_id", "text"))
    return d.select("doc_id", T.dedup_ngrams(F.col("text"), 3).alias("text"))


@register("t2_dedup_text")
def t2_dedup_text(spark, sf):
    d = T.spread(Tables(spark, sf).documents.select("doc_id", "text"))
    out = d.select("doc_id", T.dedup_text(F.col("text")).alias("text"))
    return out.select("doc_id", F.length("text").alias("n_chars"), "text")


@register("t3_squeeze", r"""
SELECT doc_id, regexp_replace(regexp_replace(text, ' +', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g') AS text
FROM documents
""")
def t3_squeeze(spark, sf):
    return T.squeeze_docs(Tables(spark, sf).documents.select("doc_id", "text"))


@register("t4_tokens", f"""
SELECT doc_id, CAST(len(regexp_extract_all(text, {_TOK}, 0)) AS BIGINT) AS n_tokens,
       array_to_string(regexp_extract_all(text, {_TOK}, 0), '') = text AS lossless
FROM documents
""")
def t4_tokens(spark, sf):
    d = Tables(spark, sf).documents.select("doc_id", "text", FT.tokens(F.col("text")).alias("toks"))
    return d.select("doc_id", F.size("toks").cast("long").alias("n_tokens"),
                    (F.array_join("toks", "") == F.col("text")).alias("lossless"))


@register("t4_token_rows", f"""
SELECT doc_id, CAST(i - 1 AS INTEGER) AS pos, toks[i] AS tok FROM (
  SELECT doc_id, toks, unnest(range(1, len(toks) + 1)) AS i
  FROM (SELECT doc_id, regexp_extract_all(text, {_TOK}, 0) AS toks FROM documents))
""")
def t4_token_rows(spark, sf):
    return T.token_rows(Tables(spark, sf).documents)


@register("t5_repeated_ngrams", r"""
WITH w AS (SELECT doc_id, regexp_extract_all(regexp_replace(lower(text), '([\x{4e00}-\x{9fff}])', ' \1 ', 'g'), '[\p{L}\p{N}_]+', 0) AS ws FROM documents),
g AS (SELECT doc_id, array_to_string(ws[i:i + 4], ' ') AS gram
      FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM w WHERE len(ws) >= 5))
SELECT gram, count(*) AS n_occ, count(DISTINCT doc_id) AS n_docs FROM g GROUP BY gram HAVING count(*) >= 3
""")
def t5_repeated_ngrams(spark, sf):
    return T.repeated_ngrams(Tables(spark, sf).documents, n=5, min_count=3)
