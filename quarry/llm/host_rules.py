"""Host-level quality rules.

Every document gets base counts and rule verdicts from its own text. Per host the failures of each
rule are added up, the failure rate is shrunk towards the corpus by a beta prior that is fitted to
the hosts themselves (method of moments), and a host whose shrunk rate reaches a rule's limit is
rejected as a whole; the verdict is joined back to its documents. A host with few documents thus
needs much evidence, a large one is judged by its own rate.

All of it is DataFrame expressions. The text is read once: the slim rows of counts are stored and
both the aggregation (partial before the shuffle, so a hot host is added up where it lies) and the
join read those.

Defined results: a null or empty text has no words and fails the base rule; a null host is a host
of its own; rows that repeat an id are judged row by row; an empty table gives no rows. Columns
beside the named ones are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SEPARATORS, WORD, stored

SYMBOLS = "#*$%&|<>"
WINDOW = 5
#: Host rules: name and the shrunk failure rate from which a host is rejected.
HOST_LIMITS = {"base": 0.5, "symbols": 0.6, "dup_lines": 0.6}


def base_counts(docs: DataFrame, key: str = "doc_id", host: str = "source", text: str = "text") -> DataFrame:
    """(doc_id, host, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words) by row.

    A window is known by the 64-bit hash of its words. Only texts that repeat a window sort their
    windows, as (hash, start); starts whose neighbour has the same hash are repeats, and the words
    that they cover follow from the gaps between consecutive starts. So each text costs n log n.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    step = docs.select(F.col(key).cast("bigint").alias("doc_id"), F.col(host).alias("host"), t.alias("t"))
    step = step.select("doc_id", "host", "t", F.regexp_extract_all("t", F.lit(WORD), F.lit(0)).alias("w"),
                       F.filter(F.split("t", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"))
    n = F.size("w")
    at = lambda i, j: F.get("w", i + j)
    step = step.select(
        "doc_id", "host", n.cast("bigint").alias("n_words"),
        F.length(F.translate("t", SEPARATORS, "")).cast("bigint").alias("word_chars"),
        (F.length("t") - F.length(F.translate("t", SYMBOLS, ""))).cast("bigint").alias("n_symbols"),
        F.size("lines").cast("bigint").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"),
        F.when(n >= WINDOW, F.transform(F.sequence(F.lit(0), n - WINDOW), lambda i: F.xxhash64(
            *(at(i, j) for j in range(WINDOW))))).alias("h"))
    repeats = F.size(F.array_distinct("h")) < F.size("h")
    step = step.withColumn("s", F.when(repeats, F.sort_array(F.transform(
        "h", lambda x, i: F.struct(x.alias("h"), i.alias("p")))))).drop("h")
    same = F.zip_with(F.slice("s", F.lit(1), F.size("s") - 1), F.slice("s", F.lit(2), F.size("s") - 1),
                      lambda a, b: a["h"] == b["h"])
    step = step.withColumn("same", F.when(F.col("s").isNotNull(), same))
    no = F.array(F.lit(False))
    met = F.zip_with(F.concat(no, "same"), F.concat("same", no), lambda a, b: a | b)
    starts = F.sort_array(F.transform(F.filter(
        F.zip_with("s", met, lambda x, m: F.struct(x["p"].alias("p"), m.alias("m"))), lambda x: x["m"]), lambda x: x["p"]))
    step = step.withColumn("starts", F.when(F.col("s").isNotNull(), starts)).drop("s", "same")
    k = F.size("starts")
    gaps = F.zip_with(F.slice("starts", F.lit(1), k - 1), F.slice("starts", F.lit(2), k - 1),
                      lambda a, b: F.least(F.lit(WINDOW), b - a))
    covered = F.aggregate(gaps, F.lit(WINDOW), lambda a, x: a + x)
    return step.withColumn("n_repeat_words", F.when(F.col("starts").isNotNull(), covered).otherwise(F.lit(0)).cast(
        "bigint")).drop("starts")


def failures() -> dict[str, Column]:
    """The rules on a document's counts; base is the contract's, the others weigh on hosts alone."""
    return {
        "base": (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")),
        "symbols": 10 * F.col("n_symbols") > F.col("word_chars"),
        "dup_lines": 10 * F.col("n_dup_lines") > 3 * F.col("n_lines"),
    }


def host_rates(counts: DataFrame) -> DataFrame:
    """(host, n_docs, and per rule n_<rule>, rate_<rule>): failures by host and their rate, shrunk by the
    beta prior. With mean m and variance v of the hosts' rates (weighted by documents) the prior has
    m(1 - m)/v - 1 pseudo-documents, from 1 to 10,000."""
    rules = failures()
    hosts = counts.groupBy("host").agg(F.count(F.lit(1)).alias("n_docs"), *(
        F.sum(c.cast("bigint")).alias(f"n_{r}") for r, c in rules.items()))
    hosts = stored(hosts)
    mean = {r: F.sum(f"n_{r}") / F.sum("n_docs") for r in rules}
    means = hosts.agg(F.struct(*(mean[r].alias(r) for r in rules)).alias("m")).scalar()
    spread = hosts.withColumn("m", means).agg(F.struct(*(
        (F.sum(F.col("n_docs") * F.pow(F.col(f"n_{r}") / F.col("n_docs") - F.col(f"m.{r}"), 2)) / F.sum("n_docs")).alias(r)
        for r in rules)).alias("v")).scalar()
    out = hosts.withColumn("m", means).withColumn("v", spread)
    for r in rules:
        m, v = F.col(f"m.{r}"), F.col(f"v.{r}")
        weight = F.least(F.greatest(F.when(v > 0, m * (1 - m) / v - 1).otherwise(F.lit(1e4)), F.lit(1.0)), F.lit(1e4))
        out = out.withColumn(f"rate_{r}", (F.col(f"n_{r}") + weight * m) / (F.col("n_docs") + weight))
    return out.drop("m", "v")


def apply_rules(docs: DataFrame, limits: dict[str, float] | None = None, key: str = "doc_id", host: str = "source",
                text: str = "text") -> DataFrame:
    """A row for each document: its counts, ``base_failed``, ``host_rejected`` and ``kept``."""
    limits = HOST_LIMITS if limits is None else limits
    counts = stored(base_counts(docs, key, host, text))
    rejected = F.greatest(F.lit(False), *((F.col(f"rate_{r}") >= x) for r, x in limits.items()))
    verdicts = host_rates(counts).select(F.col("host").alias("_host"), rejected.alias("host_rejected"))
    out = counts.join(verdicts, F.col("host").eqNullSafe(F.col("_host")), "left").drop("_host")
    return out.withColumn("base_failed", failures()["base"]).withColumn(
        "kept", ~F.col("base_failed") & ~F.col("host_rejected"))
