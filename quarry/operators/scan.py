"""Skew-safe ordered scans (running sums) per key.

A plain ``sum(...) OVER (PARTITION BY key ORDER BY pos)`` puts every row of a key in
one task. When one key holds a large share of the data (one long chat log, one huge
document) that task dominates the job. ``running_totals`` computes the same numbers in
two levels, the classic parallel prefix sum:

1. rows are cut into blocks of ``block`` consecutive ``pos`` values, and each
   ``(key, block)`` is summed with a normal partial/final aggregation;
2. a window over the block totals (``rows / block`` rows per key) gives each block the
   sum of all blocks before it;
3. a window partitioned by ``(key, block)`` adds the in-block running sum.

Keys and block travel as one struct column. A struct equals another when its fields do, nulls
included, so rows whose key or position is null form groups of their own and are kept.

Steps 2 and 3 only ever sort ``block`` rows or ``rows / block`` rows per task, so a hot
key is spread over many tasks. The join in step 3 and the window share the
``(key, block)`` hash partitioning, so it costs one extra shuffle of the narrow block
table, not of the data.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DEFAULT_BLOCK = 4096


def _with_block(df: DataFrame, keys: Sequence[str], pos: str, block: int) -> DataFrame:
    blk = F.floor(F.col(pos) / F.lit(block)).cast("long").alias("_blk")
    return df.withColumn("_kb", F.struct(*[F.col(k) for k in keys], blk))


def _block_window(keys: Sequence[str], *order: Column):
    return Window.partitionBy(*[F.col("_kb").getField(k) for k in keys]).orderBy(*order)


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join on ``keys`` in which null equals null; the left side's key columns are kept."""
    renamed = right.select(*[F.col(c).alias(f"_j_{c}") if c in keys else F.col(c) for c in right.columns])
    cond = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_j_{k}")) for k in keys])
    return left.join(renamed, cond, how).drop(*[f"_j_{k}" for k in keys])


def running_totals(df: DataFrame, keys: Sequence[str], pos: str, values: Mapping[str, Column],
                   descending: bool = False, tiebreak: Sequence[Column] = (),
                   block: int = DEFAULT_BLOCK, prefilter=None) -> DataFrame:
    """Add one inclusive running-sum column per entry of ``values``.

    ``pos`` is a numeric ordering column; ``tiebreak`` orders rows with equal ``pos``.
    ``prefilter(offsets)`` may return a Column over the block-offset columns
    ``_off_<name>`` (sums of all earlier blocks) to drop rows that cannot qualify
    before the row-level window runs (the totals are monotone for non-negative values).
    """
    from ..session import apply_workarounds
    apply_workarounds(df.sparkSession)
    keys = list(keys)
    names = list(values)
    d = _with_block(df, keys, pos, block)
    for n in names:
        d = d.withColumn(f"_v_{n}", values[n])
    totals = d.groupBy("_kb").agg(*[F.sum(f"_v_{n}").alias(f"_bt_{n}") for n in names])
    blk = F.col("_kb").getField("_blk")
    wb = _block_window(keys, blk.desc() if descending else blk.asc()).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_kb", *[F.coalesce(F.sum(f"_bt_{n}").over(wb), F.lit(0)).alias(f"_off_{n}")
                                     for n in names])
    # the block table grows with the number of keys: a shuffle join that lines up with the
    # key partitioning, never a broadcast chosen from an estimate
    d = d.join(offsets.hint("shuffle_hash"), on="_kb", how="inner")
    if prefilter is not None:
        d = d.where(prefilter({n: F.col(f"_off_{n}") for n in names}))
    porder = F.col(pos).desc() if descending else F.col(pos).asc()
    wr = Window.partitionBy("_kb").orderBy(porder, *tiebreak).rowsBetween(Window.unboundedPreceding, 0)
    for n in names:
        d = d.withColumn(n, F.col(f"_off_{n}") + F.sum(f"_v_{n}").over(wr))
    return d.drop("_kb", *[f"_v_{n}" for n in names], *[f"_off_{n}" for n in names])


def key_sizes(df: DataFrame, keys: Sequence[str], pos: str) -> DataFrame:
    """Per key: ``n`` = max(pos)+1 for a dense 0-based list (pure aggregation, skew-safe)."""
    return df.groupBy(*keys).agg((F.max(pos) + 1).alias("_n"))


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Hash-partition by ``keys`` when the scan has fewer partitions than the cluster has cores.

    A small input stored as one file with one row group scans as a single task, which
    would run every CPU-heavy step (regex tokenisation, parsing, Python folds) on one
    core. Large inputs already arrive in many splits and are left alone (no shuffle).
    Hashing by the entity key means later windows and groups on that key reuse the
    partitioning instead of shuffling again.
    """
    from ..session import apply_workarounds
    apply_workarounds(df.sparkSession)
    cores = int(df.sparkSession.sparkContext.defaultParallelism)
    if df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(cores * 2, *keys) if keys else df.repartition(cores * 2)


def previous_values(df: DataFrame, keys: Sequence[str], pos: str, cols: Sequence[str],
                    tiebreak: Sequence[str] = (), block: int = DEFAULT_BLOCK, outer: Sequence[str] = ()) -> DataFrame:
    """Skew-safe ``lag(col, 1)`` per key in ``(*outer, pos)`` order: adds ``prev_<col>`` for each col.

    Inside a block of ``block`` consecutive positions it is an ordinary ``lag``; the first
    row of a block takes the last row of the nearest earlier non-empty block, found with a
    max(struct) aggregation per block and a window over the small block table.
    """
    from ..session import apply_workarounds
    apply_workarounds(df.sparkSession)
    keys, cols, tb = list(keys), list(cols), list(tiebreak)
    d = _with_block(df, [*keys, *outer], pos, block)
    w = Window.partitionBy("_kb").orderBy(pos, *tb)
    d = d.withColumn("_first", F.row_number().over(w) == 1)
    for c in cols:
        d = d.withColumn(f"_lag_{c}", F.lag(c).over(w))
    last = d.groupBy("_kb").agg(F.max(F.struct(F.col(pos).alias("_p"), *[F.col(t).alias(f"_t{i}")
                                                                                  for i, t in enumerate(tb)],
                                                       *[F.col(c).alias(f"_c_{c}") for c in cols])).alias("_last"))
    wb = _block_window(keys, *[F.col("_kb").getField(c).asc() for c in (*outer, "_blk")])
    prev = last.select("_kb", F.lag("_last").over(wb).alias("_prev_last"))
    d = d.join(prev.hint("shuffle_hash"), "_kb", "left")
    for c in cols:
        d = d.withColumn(f"prev_{c}", F.when(F.col("_first"), F.col("_prev_last")[f"_c_{c}"])
                         .otherwise(F.col(f"_lag_{c}")))
    return d.drop("_kb", "_first", "_prev_last", *[f"_lag_{c}" for c in cols])
