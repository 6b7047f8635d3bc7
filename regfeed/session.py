"""Session settings, the shared work folder, and size-checked broadcasts."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RUNTIME_CONF = {
    # Every day in the outputs is a UTC day.
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    # The last value of a key that an object has twice counts, as in most JSON readers.
    "spark.sql.variant.allowDuplicateKeys": "true",
    # Rows with whole texts: a batch, and what a Python worker makes of it, should stay at some megabytes.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
}

# Rows a table may have before it is no longer broadcast. Tables measured against this limit are narrow
# (counts, cursors, dictionary entries), so even the limit itself is tens of megabytes.
BROADCAST_ROWS = 200_000

# What opening a file costs a reader, in bytes that it could read meanwhile: about a millisecond.
OPEN_COST = 256 * 1024

_local_dirs: dict[str, str] = {}


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings every operator here relies on, and put this package on the path of Python workers.

    The latter helps workers that share the driver's folders; others need the package installed or sent with ``--py-files``.
    """
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    environment = spark.sparkContext.environment
    known = [p for p in environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in known:
        environment["PYTHONPATH"] = os.pathsep.join([root, *known])
    for key, value in RUNTIME_CONF.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def build_session(master: str = "local[*]", app: str = "regfeed", **conf: str) -> SparkSession:
    """A local session for tests and the benchmark; clusters bring their own."""
    builder = SparkSession.builder.master(master).appName(app).config("spark.ui.enabled", "false")
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return tune(spark)


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can read: ``spark.checkpoint.dir``.

    Only a local session may go without it; a cluster has no safe default, since an executor-local folder is
    lost with its machine.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    app = spark.sparkContext.applicationId
    if app not in _local_dirs:
        _local_dirs[app] = tempfile.mkdtemp(prefix="run-")
    return _local_dirs[app]


def work_path(spark: SparkSession, name: str) -> str:
    """A new, unused path in the shared folder, under the application's own folder so that it can be tidied by it."""
    return f"{shared_dir(spark)}/regfeed/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}/{name}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write once to the shared folder and read back.

    Cuts lineage in a way that survives the loss of executors, and pins anything that would differ between
    two evaluations of the same plan (partition ids, arrival stamps).
    """
    spark = df.sparkSession
    path = work_path(spark, name)
    df.write.mode("errorifexists").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def broadcast_if_small(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast hint only after counting: beyond the limit the join is left to shuffle.

    Meant for stored or input tables, where the count reads footers or one small file.
    """
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


@contextmanager
def many_files(spark: SparkSession) -> Iterator[None]:
    """Actions inside put many small files into each of their reading tasks. By default a file counts as 4 MB, so every few take a task."""
    key = "spark.sql.files.openCostInBytes"
    before = spark.conf.get(key, None)
    spark.conf.set(key, str(OPEN_COST))
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)
