"""Session construction and shared-folder helpers."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings every quarry job wants; a cluster launcher may override any of them.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


# Spark 4.1.2 workaround: with a repartitioned scan feeding both sides of a union that is
# joined to its own aggregate, constraint-based filter inference produced a plan that
# duplicated rows (a filter on an attribute its child did not output). Excluding that one
# optimizer rule restores correct results; it only adds inferred IS NOT NULL filters.
EXCLUDED_RULES = ["org.apache.spark.sql.catalyst.optimizer.InferFiltersFromConstraints"]


def apply_workarounds(spark: SparkSession) -> None:
    """Add our excluded optimizer rules to the session (keeps any rules already excluded)."""
    key = "spark.sql.optimizer.excludedRules"
    cur = [r for r in (spark.conf.get(key, "") or "").split(",") if r]
    missing = [r for r in EXCLUDED_RULES if r not in cur]
    if missing:
        spark.conf.set(key, ",".join(cur + missing))


#: Bytes of an Arrow batch that goes to a Python worker; Spark's own bound is many times that, held twice in every task
#: by the JVM outside its heap and again by the worker.
BATCH_BYTES = "4m"
_BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Bounds the bytes of Arrow batches, unless the session has a bound of its own. It changes no result."""
    if spark.conf.get(_BATCH_SETTING, unset := "1b") == unset:
        spark.conf.set(_BATCH_SETTING, BATCH_BYTES)


def build_session(master: str | None = None, app: str = "quarry", shuffle_partitions: int | None = None,
                  extra: dict | None = None) -> SparkSession:
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    for k, v in DEFAULT_CONF.items():
        b = b.config(k, v)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in (extra or {}).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    apply_workarounds(spark)
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster the launcher sets it to a shared filesystem path. Only when it is unset
    (local tests) do we create a scratch folder of our own.
    """
    d = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not d:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        d = tempfile.mkdtemp(prefix="quarry-ckpt-")
        spark.conf.set("spark.checkpoint.dir", d)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(d)
    return spark.sparkContext.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path under the shared checkpoint folder for materialised intermediate tables."""
    base = ensure_checkpoint_dir(spark)
    return os.path.join(base, name)


def stored(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet to the shared checkpoint folder and read back: what follows doesn't compute it again, and a
    lost executor costs a reread."""
    spark = df.sparkSession
    path = scratch_path(spark, f"stored-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``quarry`` importable on the executors (Python UDFs and grouped functions
    reference its modules). The package is zipped once per application and added with
    ``addPyFile``, which distributes it to every executor."""
    import zipfile

    sc = spark.sparkContext
    app = sc.applicationId
    if app in _SHIPPED:
        return
    pkg = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(pkg)
    fd, path = tempfile.mkstemp(prefix="quarry-", suffix=".zip")
    os.close(fd)
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for base, _dirs, files in os.walk(pkg):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(base, f)
                    z.write(full, os.path.relpath(full, root))
    sc.addPyFile(path)
    _SHIPPED.add(app)
