"""Stream sources and batch-numbered result tables in the shared folder."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from regfeed.session import materialise, work_path


class BatchTable:
    """A Parquet table with one folder per micro-batch.

    A replayed micro-batch overwrites its own folder, which makes a ``foreachBatch`` sink exactly-once. Batch -1 is
    empty and fixes the schema. Batch numbers follow each other, so the state before batch b is in folder b - 1.
    """

    def __init__(self, spark: SparkSession, schema: str, name: str, path: str | None = None):
        self.schema = schema
        self.path = path or work_path(spark, name)
        # On a restart this rewrites the same empty folder.
        self.write(spark.createDataFrame([], schema), -1)

    def write(self, df: DataFrame, batch_id: int) -> None:
        df.write.mode("overwrite").parquet(f"{self.path}/batch_id={batch_id}")

    def state_before(self, spark: SparkSession, batch_id: int) -> DataFrame:
        """What batch ``batch_id - 1`` left behind."""
        return spark.read.schema(self.schema).parquet(f"{self.path}/batch_id={batch_id - 1}")

    def read(self, spark: SparkSession, before: int | None = None) -> DataFrame:
        """All batches, or those before one; the batch number comes from the path and prunes folders."""
        table = spark.read.schema(f"{self.schema}, batch_id bigint").parquet(self.path)
        return table if before is None else table.where(F.col("batch_id") < before)

    def newest(self, spark: SparkSession) -> int:
        """Number of the newest batch, -1 before the first; told from the files, whether they hold rows or not."""
        files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true")
        names = files.load(self.path).select(F.regexp_extract("path", r"batch_id=(-?\d+)/", 1).cast("bigint").alias("n"))
        return names.agg(F.max("n")).first()[0]

    def last(self, spark: SparkSession) -> DataFrame:
        """The rows of the newest batch."""
        return spark.read.schema(self.schema).parquet(f"{self.path}/batch_id={self.newest(spark)}")


def source(spark: SparkSession, path: str, schema, files_per_trigger: int = 1) -> DataFrame:
    """Streaming read of a folder that files are added to."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def start(writer, spark: SparkSession, name: str, checkpoint: str | None = None, every: str | None = None):
    """A running query: ``every`` (such as ``"6 seconds"``) keeps it running, without it what is present is read and it ends.

    The checkpoint folder is what a restart resumes from.
    """
    location = checkpoint or work_path(spark, f"{name}_checkpoint")
    trigger = {"processingTime": every} if every else {"availableNow": True}
    return writer.option("checkpointLocation", location).trigger(**trigger).start()


def drain(writer, spark: SparkSession, name: str, checkpoint: str | None = None) -> None:
    """Run until everything present has been read."""
    start(writer, spark, name, checkpoint).awaitTermination()


def beside(checkpoint: str | None, name: str) -> str | None:
    """Where a job with this checkpoint keeps a table, so that a restart finds what it had."""
    return f"{checkpoint.rstrip('/')}_tables/{name}" if checkpoint else None


def stage(df: DataFrame, order: str, slices: int = 4, files: int = 4, stops: int = 1) -> Iterator[str]:
    """Write a table as a growing folder: ``slices`` appends in the order of an integer column.

    Reading it with ``files`` files per trigger gives one micro-batch per slice. The folder is handed out ``stops`` times
    while it grows, the last time when it is complete.
    """
    spark = df.sparkSession
    path = work_path(spark, "staged")
    df = materialise(df, "unstaged")
    low, high = df.agg(F.min(order), F.max(order)).first()
    step = (high - low) // slices + 1
    for i in range(slices):
        part = df.where((F.col(order) >= low + i * step) & (F.col(order) < low + (i + 1) * step))
        part.repartitionByRange(files, order).write.mode("append").parquet(path)
        if (i + 1) * stops % slices == 0:
            yield path
