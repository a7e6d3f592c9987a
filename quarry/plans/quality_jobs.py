"""Registered quality-metric queries (Q1-Q6)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as FT
from ..operators import quality as Q
from .registry import Tables, register

_TOK = r"'(?s)[\x{4e00}-\x{9fff}]|\w+| |.'"
_CLS = r"""CASE WHEN regexp_matches(tok, '^[\x{4e00}-\x{9fff}]$') THEN 'cjk'
  WHEN regexp_matches(tok, '^[0-9]+$') THEN 'num' WHEN regexp_matches(tok, '^\w+$') THEN 'word'
  WHEN tok = ' ' THEN 'space' WHEN tok = chr(10) THEN 'newline'
  WHEN regexp_matches(tok, '^[.,;:!?()\[\]{}-]$') THEN 'punct' ELSE 'other' END"""
_ENTROPY = """
toks AS (SELECT doc_id, unnest(regexp_extract_all(text, """ + _TOK + """, 0)) AS tok FROM documents),
cc AS (SELECT doc_id, """ + _CLS + """ AS cls, count(*)::DOUBLE AS n FROM toks GROUP BY ALL),
ent AS (SELECT doc_id, ln(sum(n)) - sum(n * ln(n)) / sum(n) AS entropy FROM cc GROUP BY doc_id)"""
_PPL = """
t AS (SELECT doc_id, regexp_extract_all(text, """ + _TOK + """, 0) AS toks FROM documents),
b AS (SELECT doc_id, i - 1 AS pos, toks[i - 1] AS prev, toks[i] AS tok
      FROM (SELECT doc_id, toks, unnest(range(2, len(toks) + 1)) AS i FROM t)),
vocab AS (SELECT count(DISTINCT tok) AS v FROM (SELECT unnest(toks) AS tok FROM t)),
c2 AS (SELECT prev, tok, count(*) AS c2 FROM b GROUP BY prev, tok),
c1 AS (SELECT prev, count(*) AS c1 FROM b GROUP BY prev),
win AS (SELECT b.doc_id, CAST(CASE WHEN b.pos < 512 THEN 0 ELSE (b.pos - 512) // 256 + 1 END AS INTEGER) AS win_no,
               exp(avg(-ln((c2.c2 + 1.0) / (c1.c1 + 1.0 * (SELECT v FROM vocab))))) AS ppl
        FROM b JOIN c2 USING (prev, tok) JOIN c1 USING (prev) GROUP BY 1, 2),
dppl AS (SELECT doc_id, avg(ppl) AS ppl FROM win GROUP BY doc_id)"""


@register("q1_class_entropy", """
WITH c AS (SELECT user_id, event_type, count(*)::DOUBLE AS n FROM events GROUP BY ALL)
SELECT user_id, ln(sum(n)) - sum(n * ln(n)) / sum(n) AS entropy FROM c GROUP BY user_id
""")
def q1_class_entropy(spark, sf):
    return Q.class_entropy(Tables(spark, sf).events, "user_id", "event_type")


@register("q2_entropy_by_doc", "WITH " + _ENTROPY + "\nSELECT * FROM ent")
def q2_entropy_by_doc(spark, sf):
    return Q.class_entropy(Q.token_classes(Tables(spark, sf).documents), "doc_id", "cls")


@register("q3_sliding_windows", """
WITH t AS (SELECT doc_id, len(regexp_extract_all(text, """ + _TOK + """, 0)) AS n FROM documents),
w AS (SELECT doc_id, n, unnest(range(0, n, 256)) AS b FROM t WHERE n > 0)
SELECT doc_id, CAST(b // 256 AS INTEGER) AS win_no,
  CAST(CASE WHEN least(b + 512, n) - b < 512 THEN greatest(0, least(b + 512, n) - 512) ELSE b END AS INTEGER) AS start,
  CAST(least(b + 512, n) AS INTEGER) AS "end"
FROM w WHERE b = 0 OR b - 256 + 512 < n
""")
def q3_sliding_windows(spark, sf):
    d = Tables(spark, sf).documents.select("doc_id", F.size(FT.tokens(F.col("text"))).alias("n_tokens"))
    return Q.sliding_windows(d)


@register("q4_window_perplexity", "WITH " + _PPL + "\nSELECT * FROM win")
def q4_window_perplexity(spark, sf):
    return Q.window_perplexity(Tables(spark, sf).documents)


@register("q5_doc_perplexity", "WITH " + _PPL + "\nSELECT * FROM dppl")
def q5_doc_perplexity(spark, sf):
    return Q.doc_perplexity(Q.window_perplexity(Tables(spark, sf).documents))


@register("q6_quality_gate", "WITH " + _PPL + "," + _ENTROPY + """
SELECT doc_id, ppl, entropy FROM dppl JOIN ent USING (doc_id)
WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1) AND ppl < 2000 AND entropy > 1.3
""")
def q6_quality_gate(spark, sf):
    t = Tables(spark, sf)
    ppl = Q.doc_perplexity(Q.window_perplexity(t.documents))
    ent = Q.class_entropy(Q.token_classes(t.documents), "doc_id", "cls")
    scores = ppl.join(ent, "doc_id")
    return Q.quality_gate(scores, t.labels.where("toxic = 1"), max_ppl=2000.0)
