"""Integer vectors, dealt into blocks that meet in a grid: what the searches over embeddings share.

Both sides of a search, its queries and all rows, are dealt by a hash into blocks of a bounded number of bytes; every
query block meets every row block in one group, so a task holds one block of each side whatever the table's size,
and no row is left out. Each group returns a bounded number of rows for each query.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of integer components in a block of rows and in a block of queries.
BLOCK_BYTES = 2 << 20
QUERY_BYTES = 8 << 20
#: Shuffle partitions of a grid, at most; a partition may hold several groups, one after the other.
MAX_PARTITIONS = 1 << 14


def integer_vectors(df: DataFrame, vector: str = "embedding", scale: int = 256, **keep: Column) -> DataFrame:
    """The columns of ``keep`` by their new names and ``vec``: floor(scale * x) of each component x as double, as
    little-endian 64-bit integers. Vectors that are null or hold a null or non-finite component are left out; rows that
    are equal in all of this count once. A component beyond 64 bits raises OverflowError."""

    names = list(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow as pa
        import pyarrow.compute as pc
        for batch in batches:
            lists = batch.column("vec")
            sizes = pc.fill_null(pc.list_value_length(lists), -1).to_numpy(zero_copy_only=False).astype(np.int64)
            values = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)  # null: NaN
            finite = np.isfinite(values)
            ends = np.cumsum(np.maximum(sizes, 0))
            bad = np.concatenate([[0], np.cumsum(~finite)])
            good = (sizes >= 0) & (bad[ends] == bad[ends - np.maximum(sizes, 0)])
            used = np.repeat(good, np.maximum(sizes, 0))
            whole = np.floor(scale * values[used])
            if len(whole) and np.abs(whole).max() >= 2.0 ** 63:
                raise OverflowError("a component is beyond 64 bits")
            offsets = np.concatenate([[0], np.cumsum(8 * sizes[good])]).astype(np.int32)
            vec = pa.Array.from_buffers(pa.binary(), int(good.sum()), [
                None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(whole.astype("<i8").tobytes())])
            rest = batch.filter(pa.array(good))
            yield pa.RecordBatch.from_arrays([*(rest.column(c) for c in names), vec], names=[*names, "vec"])

    from pyspark.sql.types import BinaryType, StructField, StructType
    slim = df.select(*(c.alias(n) for n, c in keep.items()), F.col(vector).cast("array<double>").alias("vec"))
    schema = StructType([*slim.schema.fields[:-1], StructField("vec", BinaryType())])
    return slim.mapInArrow(run, schema).distinct()


def grid(rows: DataFrame, queries: DataFrame, search: Callable, schema: str, row_bytes: int = BLOCK_BYTES,
         query_bytes: int = QUERY_BYTES) -> DataFrame:
    """``search(rows, queries)`` of two Arrow tables for every pair of blocks; both inputs have a column ``vec`` and no
    other name in common need match. Rows that have a column ``block`` already keep it. What the driver reads are sums."""
    def blocks(df: DataFrame, most: int) -> int:
        total = df.agg(F.sum(F.length("vec") + 16)).first()[0] or 0
        return max(1, -(-int(total) // most))

    if "block" not in rows.columns:
        rows = dealt(rows, blocks(rows, row_bytes))
    n = int(rows.agg(F.max("block")).first()[0] or 0) + 1
    m = blocks(queries, query_bytes)
    other = F.pmod(F.xxhash64(*queries.columns), F.lit(m)).cast("int")
    left = rows.select(F.explode(F.sequence(F.lit(0), F.lit(m - 1))).alias("_q"), F.col("block").alias("_b"), F.struct(
        *rows.columns).alias("row"))
    right = queries.select(other.alias("_q"), F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("_b"), F.struct(
        *queries.columns).alias("query"))
    met = left.unionByName(right, allowMissingColumns=True)

    def run(group: pa.Table) -> pa.Table:
        import pyarrow as pa
        def side(name: str) -> pa.Table:
            col = group.column(name).combine_chunks()
            col = col.filter(col.is_valid())
            return pa.Table.from_arrays(col.flatten(), names=[f.name for f in col.type])
        return search(side("row"), side("query"))

    # a number of partitions of our own: the groups' work is in their pairs, not in their bytes
    return met.repartition(min(2 * m * n, MAX_PARTITIONS), "_q", "_b").groupBy("_q", "_b").applyInArrow(run, schema)


def dealt(rows: DataFrame, n: int) -> DataFrame:
    return rows.withColumn("block", F.pmod(F.xxhash64(*rows.columns), F.lit(n)).cast("int"))


def by_length(table: pa.Table, name: str = "vec") -> dict[int, np.ndarray]:
    """Row numbers of a table by their vectors' length."""
    import pyarrow.compute as pc
    sizes = pc.binary_length(table.column(name)).to_numpy() // 8
    return {int(d): np.flatnonzero(sizes == d) for d in np.unique(sizes)}


def matrix(table: pa.Table, at: np.ndarray, length: int, name: str = "vec") -> np.ndarray:
    """The integer vectors of the rows ``at``, all of one length."""
    found = table.column(name).take(pa.array(at)).to_pylist()
    return np.frombuffer(b"".join(found), "<i8").reshape(len(at), length)


def sorted_by_id(table: pa.Table) -> pa.Table:
    """Rows in the order that settles ties: by ``id``, null last."""
    return table.sort_by([("id", "ascending")]) if table.num_rows else table


def scoring_type(left: np.ndarray, right: np.ndarray) -> type:
    """A type in which inner products of these vectors are exact: float64 below 2^53, else int64; beyond 64 bits an
    OverflowError says so."""
    def most(x: np.ndarray) -> int:
        return max(abs(int(x.max())), abs(int(x.min()))) + 1 if x.size else 0
    bound = left.shape[-1] * most(left) * most(right)
    if bound >= 1 << 63:
        raise OverflowError("inner products may be beyond 64 bits")
    return np.float64 if bound < 1 << 53 else np.int64
