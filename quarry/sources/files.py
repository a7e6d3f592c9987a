"""File sources and sinks (S1-S7, S9-S11). Every schema is declared; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.urls import contains_ignored

CATEGORY_DUMP_SCHEMA = "query STRUCT<allcategories: ARRAY<STRUCT<`*`: STRING, pages: BIGINT, size: BIGINT>>>"
PAGES_DUMP_SCHEMA = ("query STRUCT<pages: MAP<STRING, STRUCT<pageid: BIGINT, title: STRING, touched: STRING, "
                     "revisions: ARRAY<STRUCT<timestamp: STRING, slots: STRUCT<main: STRUCT<`*`: STRING>>>>>>>")
ITEM_SCHEMA = "url STRING, title STRING, modified_at TIMESTAMP, markdown STRING, html STRING, save_to STRING"
SITE_CONFIG_SCHEMA = ("spider STRING, start_urls ARRAY<STRING>, ignore_home BOOLEAN, "
                      "categories ARRAY<STRUCT<cat_name: STRING, n_pages: BIGINT, score: DOUBLE>>, "
                      "samples ARRAY<STRING>, trim_rules ARRAY<STRING>")
FRAGMENT_SCHEMA = "summary STRING, dialog STRING, chapter STRING, scene_name STRING, act_name STRING"


def read_categories(spark: SparkSession, path: str, site: str | None = None) -> DataFrame:
    """Category listing dumps → ``(site, cat_name, n_pages)`` for categories with pages."""
    d = spark.read.schema(CATEGORY_DUMP_SCHEMA).json(path)
    c = d.select(F.explode("query.allcategories").alias("c")).select(
        F.col("c.`*`").alias("cat_name"), F.col("c.pages").alias("n_pages"))
    c = c.where(F.col("n_pages") > 0)
    return c.select(F.lit(site).alias("site"), "*") if site is not None else c


def read_category_pages(spark: SparkSession, path: str, with_content: bool = False) -> DataFrame:
    """Category member dumps → ``(page_id, title, ts[, content])``; pages without revisions are dropped.

    The time comes from ``revisions[0].timestamp`` (not ``touched``).
    """
    d = spark.read.schema(PAGES_DUMP_SCHEMA).json(path)
    p = d.select(F.explode("query.pages").alias("k", "p")).where(F.size("p.revisions") > 0)
    first = F.get(F.col("p.revisions"), 0)
    cols = [F.col("p.pageid").alias("page_id"), F.col("p.title").alias("title"),
            F.to_timestamp(first["timestamp"]).alias("ts")]
    if with_content:
        cols.append(first["slots"]["main"]["*"].alias("content"))
    return p.select(*cols)


def read_feed(spark: SparkSession, path: str) -> DataFrame:
    """S3: JSON-lines page feed with the crawl item schema."""
    return spark.read.schema(ITEM_SCHEMA).json(path)


def _config_tables(configs: DataFrame) -> dict[str, DataFrame]:
    """The tables of configs that have a column ``site``."""
    cats = configs.select("site", F.explode("categories").alias("c")).select("site", "c.*")
    samples = configs.select("site", F.explode("samples").alias("title"))
    rules = configs.select("site", F.posexplode("trim_rules").alias("rule_no", "rule"))
    return {"categories": cats, "samples": samples, "trim_rules": rules}


def read_site_config(spark: SparkSession, path: str, site: str) -> dict[str, DataFrame]:
    """A site's ``meta.json`` → ``categories``, ``samples`` and ``trim_rules`` tables."""
    c = spark.read.schema(SITE_CONFIG_SCHEMA).option("multiLine", True).json(path)
    return _config_tables(c.withColumn("site", F.lit(site)))


def read_site_configs(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The configs of all sites under ``path/folder=<site>`` in one read; the site is the folder's name."""
    c = spark.read.schema(SITE_CONFIG_SCHEMA + ", folder STRING").option("multiLine", True).json(path)
    return _config_tables(c.withColumnRenamed("folder", "site"))


def write_site_config(categories: DataFrame, samples: DataFrame, rules: DataFrame, path: str,
                      spider: str = "wiki", start_urls: DataFrame | None = None, ignore_home: bool = False) -> None:
    """One config file per site under ``path/folder=<site>``, in the form :func:`read_site_config` reads.

    The tables carry a ``site`` column (``start_urls`` has ``site, url``). A site that is in any of them gets
    a file; the lists it lacks are empty. A config is a hand-sized file, one row here.
    """
    def per_site(df, entry, out):
        return df.groupBy("site").agg(F.array_sort(F.collect_list(entry)).alias(out))

    urls = start_urls if start_urls is not None else samples.select("site", F.lit("").alias("url")).limit(0)
    cats = per_site(categories, F.struct("cat_name", "n_pages", "score"), "categories")
    titles = per_site(samples, F.col("title"), "samples")
    starts = per_site(urls, F.col("url"), "start_urls")
    ordered = per_site(rules, F.struct("rule_no", "rule"), "_rules").select(
        "site", F.transform("_rules", lambda r: r["rule"]).alias("trim_rules"))
    d = cats.join(titles, "site", "full").join(starts, "site", "full").join(ordered, "site", "full")
    empty = {"categories": "ARRAY<STRUCT<cat_name: STRING, n_pages: BIGINT, score: DOUBLE>>"}
    lists = [F.coalesce(F.col(c), F.array().cast(empty.get(c, "ARRAY<STRING>"))).alias(c)
             for c in ("start_urls", "categories", "samples", "trim_rules")]
    d.select(F.col("site").alias("folder"), F.lit(spider).alias("spider"), F.lit(ignore_home).alias("ignore_home"),
             *lists).repartition("folder").write.mode("overwrite").option("maxRecordsPerFile", 1) \
        .option("partitionOverwriteMode", "dynamic").partitionBy("folder").json(path)


def write_markdown(items: DataFrame, root: str) -> None:
    """Markdown sink keyed by ``save_to``; items under ignored namespaces are skipped.

    Written as parquet partitioned by site (first path segment after the host), so a
    reader can fetch one site's pages without listing the others. Only the sites written
    are replaced; a site's pages are dealt over a few files, so a large site is no single task.
    """
    d = items.where(~contains_ignored(F.col("save_to")))
    d = d.withColumn("site", F.regexp_extract("save_to", r"^[^/]*/([^/]*)", 1))
    d = d.select("site", "save_to", "title", "modified_at", "markdown")
    d.repartition("site", F.pmod(F.xxhash64("save_to"), F.lit(16))).write.mode("overwrite") \
        .option("partitionOverwriteMode", "dynamic").partitionBy("site").parquet(root)


def incremental_upsert(new: DataFrame, stored: DataFrame, key: str, version: str) -> tuple[DataFrame, DataFrame]:
    """(rows to write, new store). A new row whose stored version equals its own is
    skipped; the rest replace the stored rows with the same key; other stored rows stay."""
    changed = new.join(stored.select(key, version), [key, version], "left_anti")
    store = stored.join(changed.select(key), key, "left_anti").unionByName(changed)
    return changed, store


def read_texts(spark: SparkSession, glob: str) -> DataFrame:
    """Whole files as one row each: ``(path, text)``."""
    d = spark.read.text(glob, wholetext=True)
    return d.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def read_fragments(spark: SparkSession, root: str) -> DataFrame:
    """Numbered JSON fragment files in nested folders → ``(folder, frag_no, …)``."""
    d = (spark.read.schema(FRAGMENT_SCHEMA).option("multiLine", True).option("recursiveFileLookup", True)
         .json(root))
    path = F.col("_metadata.file_path")
    return d.select(F.regexp_extract(path, r"([^/]+)/[^/]+$", 1).alias("folder"),
                    F.regexp_extract(path, r"(\d+)\.json$", 1).cast("int").alias("frag_no"), "*")


def write_jsonl(df: DataFrame, path: str, value: str, partition: str | None = None) -> None:
    """One JSON value per line (non-ASCII kept), optionally one folder per ``partition`` value."""
    cols = [F.col(value).alias("value")] + ([F.col(partition)] if partition else [])
    w = df.select(*cols).write.mode("overwrite")
    (w.partitionBy(partition) if partition else w).text(path)


def pending_work(todo: DataFrame, done: DataFrame, key: str, stored: str) -> DataFrame:
    """Every task with ``pending`` (no stored output yet) and the stored value when done."""
    d = done.select(key, F.col(stored).alias("stored")).dropDuplicates([key])
    return todo.join(d, key, "left").withColumn("pending", F.col("stored").isNull())
