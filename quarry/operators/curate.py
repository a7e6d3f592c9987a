"""Category curation: filter, semi join, per-group sampling, scoring, upsert, top-k.

A categories table is ``(site, cat_name, n_pages, score)``; member pages are
``(site, cat_name, title, ts, content)``. All steps are relational; per-group sampling
uses ``row_number`` windows whose partition is one category (bounded to its pages), and
the "newest per group" step uses a ``max(struct)`` aggregation, which combines partially
on the map side and so is safe for a hot group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values that must match the reference behaviour.
MIN_PAGES = 2              # categories need at least two pages
NEWEST_PAGES = 10          # members fetched per category, newest first
SAMPLED_PAGES = 3          # members sampled at random from those
SCORE_PREFIX_CHARS = 512   # content characters shown to the scorer
MIN_MEAN_SCORE = 3.5       # categories kept when their mean score reaches this
TOP_CATEGORIES = 20        # categories that contribute a sample page
SCORE_PROMPT_TITLE = "标题："
SCORE_PROMPT_CREATED = "创建时间："


def min_pages(cats: DataFrame, n: int = MIN_PAGES, col: str = "n_pages") -> DataFrame:
    """Categories with at least ``n`` pages."""
    return cats.where(F.col(col) >= n)


def include_only(cats: DataFrame, names: DataFrame, key: str = "cat_name") -> DataFrame:
    """Keep categories listed in ``names`` (a semi join; the list may be large)."""
    return cats.join(names.select(key).distinct(), on=key, how="left_semi")


def sample_per_group(pages: DataFrame, group: Sequence[str], order: Column, uid: Column,
                     newest: int = NEWEST_PAGES, n: int = SAMPLED_PAGES, seed: int = 0) -> DataFrame:
    """Per group take the ``newest`` rows by ``order`` (desc), then ``n`` of those at random.

    Randomness is a seeded hash of ``uid`` so reruns (and task retries) pick the same rows.
    Adds ``sample_rank`` (1..n): the shuffled order of the picked rows.
    """
    group = list(group)
    w1 = Window.partitionBy(*group).orderBy(order.desc(), uid)
    d = pages.withColumn("_recent", F.row_number().over(w1)).where(F.col("_recent") <= newest)
    d = d.withColumn("_h", F.md5(F.concat(uid.cast("string"), F.lit(f":{seed}"))))
    w2 = Window.partitionBy(*group).orderBy("_h")
    return d.withColumn("sample_rank", F.row_number().over(w2)).where(F.col("sample_rank") <= n).drop("_recent", "_h")


def render_scoring_prompt(pages: DataFrame, title: Column, created: Column, content: Column,
                          out: str = "prompt", chars: int = SCORE_PREFIX_CHARS) -> DataFrame:
    """C4: scorer input = title, creation time and the first 512 characters of content."""
    return pages.withColumn(out, F.concat(F.lit(SCORE_PROMPT_TITLE), title, F.lit("\n\n" + SCORE_PROMPT_CREATED),
                                          created, F.lit("\n\n"), F.substring(content, 1, chars)))


def parse_score(text: Column, mode: str = "first") -> Column:
    """Numeric score from a model reply.

    ``first``: the first number in the reply (null if none). ``last_digit``: the
    reference's greedy pattern ``^.*(\\d+\\.?\\d*)`` on the first line, which keeps only
    the tail of the last number ("4.5" → 5, "10" → 0); null when the line has no digit.
    """
    if mode == "first":
        pat = r"(\d+(\.\d+)?)"
        return F.when(text.rlike(r"\d"), F.regexp_extract(text, pat, 1)).try_cast("double")
    if mode == "last_digit":
        pat = r"^.*(\d+\.?\d*)"
        return F.when(text.rlike(pat), F.regexp_extract(text, pat, 1)).try_cast("double")
    raise ValueError(f"unknown mode {mode!r}")


def score_groups(scores: DataFrame, cats: DataFrame, key: str = "cat_name", score: str = "score",
                 min_mean: float = MIN_MEAN_SCORE) -> DataFrame:
    """Mean score per category, keep those ≥ ``min_mean``, inner-join back (adds ``score``)."""
    means = scores.groupBy(key).agg(F.avg(score).alias(score)).where(F.col(score) >= min_mean)
    return cats.drop(score).join(means, on=key, how="inner")


def upsert(old: DataFrame, new: DataFrame, key: Sequence[str] | str, mode: str = "upsert") -> DataFrame:
    """Rows of ``new`` replace rows of ``old`` with the same key; other old rows stay.

    The whole new row wins (not field by field), so a null in ``new`` is kept as null.
    ``mode="replace"`` returns ``new`` alone.
    """
    if mode == "replace":
        return new
    keys = [key] if isinstance(key, str) else list(key)
    return old.join(new.select(*keys).distinct(), on=keys, how="left_anti").unionByName(new.select(*old.columns))


def sort_by_score(cats: DataFrame, score: str = "score", key: str = "cat_name") -> DataFrame:
    """Score descending, key as tiebreak."""
    return cats.orderBy(F.col(score).desc(), F.col(key))


def top_categories(cats: DataFrame, k: int = TOP_CATEGORIES, score: str = "score", size: str = "n_pages",
                   key: Sequence[str] = ("site", "cat_name")) -> DataFrame:
    """Top ``k`` by (score desc, pages desc); key columns break ties. Runs as TakeOrderedAndProject."""
    return cats.orderBy(F.col(score).desc(), F.col(size).desc(), *[F.col(c) for c in key]).limit(k)


def newest_per_group(pages: DataFrame, chosen: DataFrame, group: Sequence[str], ts: str, value: str,
                     tiebreak: str) -> DataFrame:
    """Per chosen group the ``value`` of its newest member; groups without members are skipped."""
    group = list(group)
    newest = (pages.groupBy(*group)
              .agg(F.max(F.struct(F.col(ts).alias("_t"), F.col(tiebreak).alias("_b"), F.col(value).alias("_v")))
                   .alias("_m"))
              .select(*group, F.col("_m._v").alias(value)))
    return chosen.select(*group).distinct().join(newest, on=group, how="inner")


def merge_samples(old: DataFrame, new: DataFrame) -> DataFrame:
    """C11: union of old and new samples, distinct, sorted."""
    u = old.unionByName(new).distinct()
    return u.orderBy(*u.columns)


def categories_from_members(members: DataFrame, site: str, cat: str, score: Column | None = None) -> DataFrame:
    """Derive a categories table ``(site, cat_name, n_pages, score)`` from member rows."""
    return members.groupBy(F.col(site).alias("site"), F.col(cat).alias("cat_name")).agg(
        F.count(F.lit(1)).alias("n_pages"),
        (score if score is not None else F.lit(None).cast("double")).alias("score"))
