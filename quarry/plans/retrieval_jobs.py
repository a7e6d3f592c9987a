"""Registered vector and retrieval queries.

Fixture conventions: dense queries are the per-label centroids of ``embeddings``
(qid = label); sparse queries are the ``benchmark`` items (qid = item_id) against the
``documents`` corpus; the hybrid query fuses both lists on (qid, id) with
id = vec_id = doc_id. Scores come from columns; no model is called.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as FT
from ..operators import retrieval as V
from .registry import Tables, register

MODEL = "BAAI__bge-m3"
QMODEL = "BAAI__bge-large-zh-v1.5"

# ---------------------------------------------------------------- shared oracle CTEs
_EMB = """
e AS (SELECT vec_id, label, CAST(i - 1 AS INTEGER) AS dim, embedding[i]::DOUBLE AS x
      FROM (SELECT *, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings)),
q AS (SELECT label AS qid, dim, avg(x) AS qx FROM e GROUP BY label, dim),
dense AS (SELECT qid, vec_id, score, CAST(rank AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, vec_id) AS rank FROM (
    SELECT q.qid, e.vec_id, round(sum(q.qx * e.x), 9) AS score FROM q JOIN e USING (dim)
    GROUP BY q.qid, e.vec_id)) WHERE rank <= 16)"""

_SPARSE = r"""
words AS (SELECT doc_id, regexp_extract_all(regexp_replace(lower(text), '([\x{4e00}-\x{9fff}])', ' \1 ', 'g'), '[\p{L}\p{N}_]+', 0) AS ws FROM documents),
occ AS (SELECT doc_id, CAST(i - 1 AS INTEGER) AS pos, ws[i] AS token
        FROM (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM words)),
idf AS (SELECT token, ln(1 + (SELECT count(DISTINCT doc_id) FROM documents) / count(DISTINCT doc_id)) AS idf
        FROM occ GROUP BY token),
smax AS (SELECT doc_id, token, max(idf / ln(2 + pos)) AS weight, min(pos) AS pos
         FROM occ JOIN idf USING (token) GROUP BY doc_id, token),
dtop AS (SELECT doc_id, token, weight, pos FROM (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY weight DESC, pos) AS r FROM smax) WHERE r <= 128),
qw AS (SELECT item_id AS qid, regexp_extract_all(regexp_replace(lower(text), '([\x{4e00}-\x{9fff}])', ' \1 ', 'g'), '[\p{L}\p{N}_]+', 0) AS ws FROM benchmark),
qocc AS (SELECT qid, CAST(i - 1 AS INTEGER) AS pos, ws[i] AS token
         FROM (SELECT qid, ws, unnest(range(1, len(ws) + 1)) AS i FROM qw)),
qmax AS (SELECT qid, token, max(idf / ln(2 + pos)) AS weight, min(pos) AS pos
         FROM qocc JOIN idf USING (token) GROUP BY qid, token),
qtop AS (SELECT qid, token, weight, pos FROM (
  SELECT *, row_number() OVER (PARTITION BY qid ORDER BY weight DESC, pos) AS r FROM qmax) WHERE r <= 128),
sparse AS (SELECT qid, doc_id, score, CAST(rank AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM (
    SELECT q.qid, d.doc_id, round(sum(q.weight * d.weight), 9) AS score FROM qtop q JOIN dtop d USING (token)
    GROUP BY q.qid, d.doc_id)) WHERE rank <= 16)"""


# ---------------------------------------------------------------- spark side helpers
def _centroids(emb):
    e = emb.select("label", F.posexplode(F.transform("embedding", lambda x: x.cast("double"))).alias("dim", "x"))
    c = e.groupBy("label", "dim").agg(F.avg("x").alias("x"))
    return c.groupBy(F.col("label").alias("qid")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("dim", "x"))), lambda s: s["x"]).alias("qvec"))


def _dense(t):
    emb = t.embeddings
    return V.dense_topk(_centroids(emb), emb)


def _sparse_parts(t):
    idf = V.idf_table(t.documents)
    dtop = V.sparse_top_n(V.sparse_encoding(t.documents, idf))
    q = t.benchmark.select(F.col("item_id").alias("qid"), "text")
    qtop = V.sparse_top_n(V.sparse_encoding(q, idf, key="qid"), key="qid")
    return dtop, qtop


def _sparse(t):
    dtop, qtop = _sparse_parts(t)
    return V.sparse_topk(qtop, dtop)


@register("v1_l2_normalize", """
WITH e AS (SELECT vec_id, CAST(i - 1 AS INTEGER) AS dim, embedding[i]::DOUBLE AS x
           FROM (SELECT *, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings)),
n AS (SELECT vec_id, sqrt(sum(x * x)) AS nrm FROM e GROUP BY vec_id)
SELECT vec_id, dim, x / nrm AS x FROM e JOIN n USING (vec_id)
""")
def v1_l2_normalize(spark, sf):
    d = V.normalize_vectors(Tables(spark, sf).embeddings, "embedding", "unit")
    return d.select("vec_id", F.posexplode("unit").alias("dim", "x"))


@register("v2_sparse_max", "WITH " + _SPARSE + "\nSELECT doc_id, token, weight, pos FROM smax")
def v2_sparse_max(spark, sf):
    t = Tables(spark, sf)
    return V.sparse_max(V.lexical_postings(t.documents, V.idf_table(t.documents)))


@register("v3_sparse_top_n", "WITH " + _SPARSE + "\nSELECT doc_id, token, weight, pos FROM dtop")
def v3_sparse_top_n(spark, sf):
    t = Tables(spark, sf)
    return V.sparse_top_n(V.sparse_encoding(t.documents, V.idf_table(t.documents)))


@register("v4_usage", r"""
SELECT lang, CAST(sum(len(regexp_extract_all(regexp_replace(lower(text), '([\x{4e00}-\x{9fff}])', ' \1 ', 'g'), '[\p{L}\p{N}_]+', 0))) AS BIGINT) AS prompt_tokens,
  CAST(sum(len(regexp_extract_all(text, '(?s)[\x{4e00}-\x{9fff}]|\w+| |.', 0))) + 2 * count(*) AS BIGINT)
    AS total_tokens
FROM documents GROUP BY lang
""")
def v4_usage(spark, sf):
    return V.usage(Tables(spark, sf).documents, ["lang"])


@register("v5_sigmoid", """
SELECT vec_id, embedding[1]::DOUBLE AS logit, 1 / (1 + exp(-embedding[1]::DOUBLE)) AS score FROM embeddings
""")
def v5_sigmoid(spark, sf):
    e = Tables(spark, sf).embeddings.select("vec_id", F.element_at("embedding", 1).cast("double").alias("logit"))
    return e.withColumn("score", V.sigmoid(F.col("logit")))


@register("v6_rerank", "WITH " + _EMB + """,
qv AS (SELECT qid, sqrt(sum(qx * qx)) AS qn FROM q GROUP BY qid),
ev AS (SELECT vec_id, sqrt(sum(x * x)) AS en FROM e GROUP BY vec_id),
rs AS (SELECT d.qid, d.vec_id AS id, d.rank AS retrieval_rank,
              round(1 / (1 + exp(-10 * (d.score / (qv.qn * ev.en)))), 9) AS score
       FROM dense d JOIN qv USING (qid) JOIN ev USING (vec_id))
SELECT qid, id, retrieval_rank, score, CAST(rank AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY qid ORDER BY coalesce(score, 0) DESC, retrieval_rank) AS rank FROM rs)
WHERE rank <= 4
""")
def v6_rerank(spark, sf):
    t = Tables(spark, sf)
    cands = _dense(t).withColumnRenamed("vec_id", "id")
    qn = _centroids(t.embeddings).select("qid", V.l2_norm(F.col("qvec")).alias("qn"))
    en = t.embeddings.select(F.col("vec_id").alias("id"), V.l2_norm(F.col("embedding")).alias("en"))
    scores = (cands.join(qn, "qid").join(en, "id")
              .select("qid", "id", F.round(V.sigmoid(10 * (F.col("score") / (F.col("qn") * F.col("en")))), 9)
                      .alias("score")))
    return V.rerank(cands, scores)


@register("v7_dense_topk", "WITH " + _EMB + "\nSELECT * FROM dense")
def v7_dense_topk(spark, sf):
    return _dense(Tables(spark, sf))


@register("v8_sparse_topk", "WITH " + _SPARSE + "\nSELECT * FROM sparse")
def v8_sparse_topk(spark, sf):
    return _sparse(Tables(spark, sf))


@register("v9_hybrid_topk", "WITH " + _EMB + "," + _SPARSE + """,
dn AS (SELECT qid, vec_id AS id, CASE WHEN max(score) OVER w > min(score) OVER w
       THEN (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) ELSE 1.0 END AS dense_score
       FROM dense WINDOW w AS (PARTITION BY qid)),
sn AS (SELECT qid, doc_id AS id, CASE WHEN max(score) OVER w > min(score) OVER w
       THEN (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) ELSE 1.0 END AS sparse_score
       FROM sparse WINDOW w AS (PARTITION BY qid)),
j AS (SELECT coalesce(dn.qid, sn.qid) AS qid, coalesce(dn.id, sn.id) AS id, dense_score, sparse_score,
             round(0.5 * coalesce(dense_score, 0) + 0.5 * coalesce(sparse_score, 0), 9) AS score
      FROM dn FULL JOIN sn ON dn.qid = sn.qid AND dn.id = sn.id)
SELECT qid, id, dense_score, sparse_score, score, CAST(rank AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM j) WHERE rank <= 32
""")
def v9_hybrid_topk(spark, sf):
    t = Tables(spark, sf)
    dense = _dense(t).select(F.col("qid").cast("long").alias("qid"), F.col("vec_id").alias("id"), "score")
    sparse = _sparse(t).select("qid", F.col("doc_id").alias("id"), "score")
    h = V.hybrid_topk(dense, sparse)
    return h.withColumn("score", F.round("score", 9))


_CACHE_SQL = f"""
WITH c AS (SELECT md5('{MODEL}:' || d.text) AS key, max(l.quality) AS cached
           FROM labels l JOIN documents d USING (doc_id) GROUP BY 1)"""


def _cache(t):
    return t.labels.join(t.documents, "doc_id").select(V.cache_key(MODEL, F.col("text")).alias("key"),
                                                       F.col("quality").alias("value"))


@register("v10_cache_lookup", _CACHE_SQL + f"""
SELECT d.doc_id, md5('{MODEL}:' || d.text) AS key, c.cached IS NOT NULL AS hit, c.cached
FROM documents d LEFT JOIN c ON md5('{MODEL}:' || d.text) = c.key
""")
def v10_cache_lookup(spark, sf):
    t = Tables(spark, sf)
    return V.cache_lookup(t.documents, _cache(t), MODEL).select("doc_id", "key", "hit", "cached")


@register("v11_pending_batches", _CACHE_SQL + f""",
u AS (SELECT md5('{MODEL}:' || text) AS key, min(doc_id) AS doc_id FROM documents GROUP BY 1),
m AS (SELECT * FROM u WHERE key NOT IN (SELECT key FROM c))
SELECT doc_id, key, CAST((row_number() OVER (ORDER BY doc_id) - 1) // 16 AS BIGINT) AS batch FROM m
""")
def v11_pending_batches(spark, sf):
    t = Tables(spark, sf)
    return V.pending_batches(t.documents, _cache(t), MODEL, batch=16)


@register("v12_unexpired", """
SELECT event_id, ts FROM events WHERE ts > TIMESTAMP '2024-01-30 00:00:00' - INTERVAL 1 DAY
ORDER BY ts DESC, event_id LIMIT 500
""")
def v12_unexpired(spark, sf):
    ev = Tables(spark, sf).events.select("event_id", "ts")
    return V.unexpired(ev, "ts", "2024-01-30 00:00:00", cap=500, order_tiebreak="event_id")


@register("v13_query_text", f"""
SELECT item_id, '为这个句子生成表示以用于检索相关文章：' || text AS query_text FROM benchmark
""")
def v13_query_text(spark, sf):
    return V.query_text(Tables(spark, sf).benchmark, QMODEL).select("item_id", "query_text")


@register("v14_truncate_tokens", r"""
WITH t AS (SELECT doc_id, lang,
  CAST(least(len(regexp_extract_all(text, '(?s)[\x{4e00}-\x{9fff}]|\w+| |.', 0)), 512) AS INTEGER) AS n_kept
  FROM documents)
SELECT doc_id, lang, n_kept, CAST(max(n_kept) OVER (PARTITION BY lang) - n_kept AS INTEGER) AS n_pad FROM t
""")
def v14_truncate_tokens(spark, sf):
    d = Tables(spark, sf).documents.select("doc_id", "lang", FT.tokens(F.col("text")).alias("tokens"))
    return V.truncate_tokens(d, QMODEL, ["lang"]).select("doc_id", "lang", "n_kept", "n_pad")
