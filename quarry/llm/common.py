"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir, ship_package, small_batches

#: Word separators of the contracts: space and the controls 0x09-0x0D.
SEPARATORS = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table; the package is made importable on the executors and batches are bounded first."""
    ship_package(spark)
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame) -> DataFrame:
    """Cut the lineage: ``df`` written as Parquet under ``spark.checkpoint.dir`` and read back,
    so that a lost executor costs a reread and not the whole plan."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/llm-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def unused(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have, in any case: ``name`` with underscores in front."""
    taken = {c.lower() for c in df.columns}
    name = "_" + name
    while name.lower() in taken:
        name = "_" + name
    return name


def text_key(text="text"):
    """64-bit digest of a text (null like empty); with doc_id it tells rows apart that repeat an id."""
    return F.xxhash64(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")))


def utf8(batch: pa.RecordBatch, name: str) -> list[bytes]:
    """The UTF-8 bytes of a string column, null as empty."""
    return [x or b"" for x in batch.column(name).cast(pa.binary()).to_pylist()]


def slices(batches: Iterator[pa.RecordBatch], name: str, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Zero-copy slices of the batches with about ``limit`` bytes in column ``name``, one row at least,
    so that what a task holds beside the Arrow batch doesn't grow with the batch."""
    for batch in batches:
        pa.default_memory_pool().release_unused()  # what the last batch left
        col = batch.column(name)
        if batch.num_rows and col.nbytes > limit:
            sizes = [x or 0 for x in pc.binary_length(col).to_pylist()]
            start = held = 0
            for i, n in enumerate(sizes):
                if held and held + n > limit:
                    yield batch.slice(start, i - start)
                    start, held = i, 0
                held += n
            yield batch.slice(start)
        else:
            yield batch
