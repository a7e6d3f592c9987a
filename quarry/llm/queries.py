"""Registered queries opN_<name>: each operator with production parameters over its whole table, and
the oracles that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (byte_bpe, chat, decontamination, hard_negatives, host_rules, secret_scan, shard, simhash, spelling,
               substring_dedup, token_counts, topk_search, toxicity)
from .common import table

RANKS = "byte_bpe_50k.tiktoken"
TOKENIZER = "byte_bpe_50k.json"
SHARDS = [f"shard-{i:02d}" for i in range(32)]
SLOTS = 4099
EXTRA_TURN = "</s>[INST] ok [/INST]"


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(F.lit(-7).cast("bigint").alias("conv_id"), F.col("id").alias("turn"),
                                  F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
                                  F.lit(EXTRA_TURN).alias("text"))
    messages = rows.unionByName(extra).withColumn("parts", chat.text_message(F.col("text")))
    return chat.digests(chat.format_turns(messages)).drop("n_attachments", "expanded_tokens")


def op2_lookup_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("bigint").alias("doc_id"))
    return shard.assign(docs, "doc_id", SHARDS, SLOTS)


def op3_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op4_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return host_rules.apply_rules(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    found = secret_scan.stored_scan(docs)
    out = secret_scan.with_spans(found, secret_scan.thresholds(found))
    base = F.filter("spans", lambda s: s["rank"] < secret_scan.RANKS["random"])
    count = lambda k: F.size(F.filter("spans", lambda s: s["rank"] == secret_scan.RANKS[k])).cast("bigint")
    return out.select("doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"),
                      F.sha2(secret_scan.spelled(base), 256).alias("base_sha256"), secret_scan.spelled(F.col("spans")).alias("spans"))


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return byte_bpe.round_trip(docs, public_tokenizers.path(RANKS), public_tokenizers.PATTERN).drop("text")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    slim = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return toxicity.score(slim, model).select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(table(spark, sf_dir, "documents")).drop("spans")


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    items = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    return found.select("doc_id", "n_words", decontamination.hit_words().alias("n_hit"),
                        F.size("items").cast("bigint").alias("n_items"), F.sha2(items, 256).alias("items_sha256"),
                        (F.size("starts") > 0).alias("contaminated"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


def op12_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_search.top_k(table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0, k=5)


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", F.when(F.col("vec_id") % 7 == 0, (F.col(
        "label") + 1) % 10).otherwise(F.col("label")).alias("label"))
    return hard_negatives.hard_negatives(rows, F.col("id") % 100 == 0, n_positives=5, n_negatives=10)


QUERIES = {f.__name__: f for f in (op1_chat_format, op2_lookup_shards, op3_simhash_groups, op4_host_rules, op5_secret_scan,
                                   op6_byte_bpe, op7_token_counts, op8_toxicity, op9_substring_dedup, op10_decontamination,
                                   op11_spelling_variants, op12_topk_search, op13_hard_negatives)}

_ESC = r"""regexp_replace(regexp_replace(replace({0}, '\', '\\'), '<(\||s>|/s>)', '<\\\1', 'g'), '\[(/?INST\])', '[\\\1', 'g')"""

ORACLE_SQL = {
    "op1_chat_format": f"""
WITH m AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '{EXTRA_TURN}' UNION ALL SELECT -7, 1, 'assistant', '{EXTRA_TURN}')
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(7 + sum(29 + length({_ESC.format('role')}) + length({_ESC.format('text')})) AS BIGINT) AS formatted_chars
FROM m GROUP BY conv_id""",
    "op2_lookup_shards": f"""
WITH RECURSIVE shards AS (
  SELECT i AS shard, printf('shard-%02d', i) AS name, md5(printf('shard-%02d', i)) AS h FROM range({len(SHARDS)}) r(i)),
orders AS (
  SELECT list(CAST('0x' || h[:15] AS BIGINT) % {SLOTS} ORDER BY shard) AS starts,
         list(CAST('0x' || h[-15:] AS BIGINT) % {SLOTS - 1} + 1 ORDER BY shard) AS steps FROM shards),
fill AS (
  SELECT 0 AS turn, CAST([] AS BIGINT[]) AS taken, CAST(NULL AS BIGINT) AS slot, CAST(NULL AS BIGINT) AS shard
  UNION ALL
  SELECT turn + 1, list_append(taken, new), new, owner FROM (
    SELECT turn, taken, turn % {len(SHARDS)} AS owner, (
      SELECT (starts[turn % {len(SHARDS)} + 1] + j * steps[turn % {len(SHARDS)} + 1]) % {SLOTS}
      FROM orders, range({SLOTS}) q(j)
      WHERE NOT list_contains(taken, (starts[turn % {len(SHARDS)} + 1] + j * steps[turn % {len(SHARDS)} + 1]) % {SLOTS})
      ORDER BY j LIMIT 1) AS new
    FROM fill WHERE turn < {SLOTS}))
SELECT doc_id, CAST(d.slot AS INTEGER) AS slot, printf('shard-%02d', f.shard) AS shard
FROM (SELECT doc_id, CAST('0x' || md5(coalesce(CAST(doc_id AS VARCHAR), ''))[:15] AS BIGINT) % {SLOTS} AS slot FROM documents) d
JOIN fill f ON f.slot = d.slot""",
    "op4_host_rules": r"""
WITH w AS (
  SELECT doc_id, source, coalesce(text, '') AS text,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines
  FROM documents),
win AS (SELECT doc_id, p, list_aggregate(ws[p:p + 4], 'string_agg', ' ') AS s FROM (
  SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS p FROM w WHERE len(ws) >= 5)),
rep AS (SELECT doc_id, p FROM (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, s) AS c FROM win) WHERE c > 1),
cov AS (SELECT doc_id, count(DISTINCT q) AS n FROM (SELECT doc_id, unnest(range(p, p + 5)) AS q FROM rep) GROUP BY 1),
base AS (
  SELECT w.doc_id, w.source, CAST(len(ws) AS BIGINT) AS n_words,
    CAST(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
    CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, len(lines) AS n_lines,
    CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words
  FROM w LEFT JOIN cov USING (doc_id)),
f AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, 10 * n_symbols > word_chars AS f_symbols,
  10 * n_dup_lines > 3 * n_lines AS f_lines FROM base),
h AS (SELECT source, count(*) AS n, CAST(sum(base_failed::INT) AS DOUBLE) AS a, CAST(sum(f_symbols::INT) AS DOUBLE) AS b,
  CAST(sum(f_lines::INT) AS DOUBLE) AS c FROM f GROUP BY 1),
m AS (SELECT sum(a) / sum(n) AS ma, sum(b) / sum(n) AS mb, sum(c) / sum(n) AS mc FROM h),
v AS (SELECT sum(n * (a / n - ma) ** 2) / sum(n) AS va, sum(n * (b / n - mb) ** 2) / sum(n) AS vb,
  sum(n * (c / n - mc) ** 2) / sum(n) AS vc FROM h, m),
p AS (SELECT ma, mb, mc,
  least(greatest(CASE WHEN va > 0 THEN ma * (1 - ma) / va - 1 ELSE 1e4 END, 1), 1e4) AS ka,
  least(greatest(CASE WHEN vb > 0 THEN mb * (1 - mb) / vb - 1 ELSE 1e4 END, 1), 1e4) AS kb,
  least(greatest(CASE WHEN vc > 0 THEN mc * (1 - mc) / vc - 1 ELSE 1e4 END, 1), 1e4) AS kc FROM m, v),
verdict AS (SELECT source, (a + ka * ma) / (n + ka) >= 0.5 OR (b + kb * mb) / (n + kb) >= 0.6 OR (c + kc * mc) / (n + kc) >= 0.6
  AS rejected FROM h, p)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT rejected AS kept
FROM f JOIN verdict ON f.source IS NOT DISTINCT FROM verdict.source""",
    "op10_decontamination": r"""
WITH dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
bw AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
bwin AS (SELECT DISTINCT item_id, least(10, len(ws)) AS m, array_to_string(ws[p:p + least(10, len(ws)) - 1], ' ') AS s FROM (
  SELECT item_id, ws, unnest(range(1, len(ws) - least(10, len(ws)) + 2)) AS p FROM bw WHERE len(ws) > 0)),
lens AS (SELECT DISTINCT m FROM bwin),
dwin AS (SELECT doc_id, m, p, array_to_string(ws[p:p + m - 1], ' ') AS s FROM (
  SELECT doc_id, ws, m, unnest(range(1, len(ws) - m + 2)) AS p FROM dw, lens WHERE len(ws) >= m)),
hit AS (SELECT doc_id, item_id, dwin.m, p FROM dwin JOIN bwin ON dwin.s = bwin.s AND dwin.m = bwin.m),
items AS (SELECT doc_id, count(DISTINCT item_id) AS n, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR))
  AS ids FROM hit GROUP BY 1),
cov AS (SELECT doc_id, count(DISTINCT q) AS n FROM (SELECT doc_id, unnest(range(p, p + m)) AS q FROM hit) GROUP BY 1)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(cov.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(items.n, 0) AS BIGINT)
  AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(cov.n, 0) > 0 AS contaminated
FROM dw LEFT JOIN items USING (doc_id) LEFT JOIN cov USING (doc_id)""",
    "op11_spelling_variants": r"""
WITH RECURSIVE crc AS (
  SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k:
    xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END)) AS c FROM range(256) r(i))),
found AS (
  SELECT coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run AS named, run FROM (
    SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[A-Za-z\x{C0}-\x{FF}]{6,}')) AS run FROM documents WHERE text IS NOT NULL)),
hashed AS (
  SELECT run, xor(list_reduce(list_prepend(4294967295, list_transform(range(1, octet_length(encode(named)) + 1), lambda i:
    CAST('0x' || substr(hex(encode(named)), 2 * i - 1, 2) AS BIGINT))),
    lambda c, b: xor(c >> 8, list_extract(t, xor(c & 255, b) + 1))), 4294967295) AS h FROM found, crc),
vocab AS (
  SELECT word, count(*) AS n FROM (SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, CAST(h % length(run) AS INT)) ||
    substr(run, CAST(h % length(run) AS INT) + 2) ELSE run END AS word FROM hashed)
  WHERE length(word) >= 6 GROUP BY word HAVING count(*) >= 5),
places AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM vocab),
cut AS (SELECT word, n, i, substr(word, 1, i - 1) AS a, substr(word, i + 1) AS b FROM places),
pairs AS (
  SELECT x.word, y.word AS other, y.n AS m FROM cut x JOIN cut y ON x.i = y.i AND x.a = y.a AND x.b = y.b AND x.word <> y.word
  UNION SELECT x.word, v.word, v.n FROM cut x JOIN vocab v ON v.word = x.a || x.b
  UNION SELECT v.word, x.word, x.n FROM cut x JOIN vocab v ON v.word = x.a || x.b),
best AS (SELECT word, count(*) AS n_near, list(other ORDER BY m DESC, encode(other))[1] AS other, max(m) AS m FROM pairs GROUP BY word),
forms AS (SELECT v.word, v.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN b.m >= 5 * v.n THEN b.other END AS form,
  CASE WHEN b.m >= 5 * v.n THEN b.m END AS form_n FROM vocab v LEFT JOIN best b USING (word)),
walk AS (
  SELECT word, word AS at, form AS next FROM forms
  UNION ALL SELECT w.word, f.word, f.form FROM walk w JOIN forms f ON f.word = w.next)
SELECT f.word, f.form, w.at AS root, f.n, f.n_near, f.form_n FROM forms f JOIN walk w ON w.word = f.word AND w.next IS NULL""",
    "op12_topk_search": """
WITH v AS (SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON c.vec_id <> q.vec_id AND len(c.e) = len(q.e) WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5""",
    "op13_hard_negatives": """
WITH v AS (SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, a.label = c.label AS same, c.vec_id, CAST(list_dot_product(a.e, c.e) AS BIGINT) AS score
  FROM v a JOIN v c ON c.vec_id <> a.vec_id AND len(c.e) = len(a.e) WHERE a.vec_id % 100 = 0),
p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS place FROM s WHERE same)
  WHERE place <= 5),
n AS (SELECT p.anchor_id, p.vec_id AS positive_id, p.score AS positive_score, s.vec_id AS negative_id, s.score AS negative_score,
    row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY s.score DESC, s.vec_id) AS rank
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 100 * s.score BETWEEN 30 * p.score AND 90 * p.score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10""",
}
