"""Partitioned Parquet whose files follow a column: one file for each run of rows with one ``part``, however many there are.

Spark's writer can end a file only where a folder ends, so each part took a folder and its listing; and on a local or mounted file
system without Hadoop's native library it starts a process for each file, checksum file and folder to set permissions. Here tasks write the
files themselves, next to each other in one folder per block. They stage them under ``_temporary``; folders of tasks that ended well are
put in their place by the driver, so a task that failed or ran twice leaves nothing that is read.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from regfeed.sources import folders

NO_VALUE = "__HIVE_DEFAULT_PARTITION__"
# As Spark escapes them in the names of folders.
ESCAPED = str.maketrans({c: f"%{ord(c):02X}" for c in [*map(chr, range(1, 32)), *"\"#%'*/:=?\\\x7f{[]^"]})
PLAIN = (
    T.StringType, T.BinaryType, T.BooleanType, T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType,
    T.DateType, T.TimestampType, T.TimestampNTZType,
)


def folder(column: str, value) -> str:
    """``column=value`` as Spark names it."""
    return f"{column}={NO_VALUE if value is None or value == '' else str(value).translate(ESCAPED)}"


def can_write(rows: DataFrame, path: str) -> bool:
    """Whether tasks reach the path as a file, and the rows hold no types but those that Arrow and Spark store alike."""
    return folders.file_path(rows.sparkSession, path) is not None and all(isinstance(f.dataType, PLAIN) for f in rows.schema)


def _changes(batch: pa.RecordBatch, columns: list[str]) -> list[int]:
    """Where a row differs from the one before it in one of the columns, and the number of rows."""
    ends = set()
    for name in columns:
        ends.update(pc.run_end_encode(batch.column(name)).run_ends.to_pylist())
    return sorted(ends)


class _Files:
    """The files of one task."""

    def __init__(self, staging: str, columns: tuple[str, ...], records_per_file: int):
        self.staging, self.columns, self.records_per_file = staging, columns, records_per_file
        self.attempt, self.task = uuid.uuid4().hex, TaskContext.get().partitionId()
        self.key, self.held, self.rows, self.file = None, [], 0, 0
        self.block, self.staged = None, []

    def add(self, batch: pa.RecordBatch) -> None:
        names = [*self.columns, "part"]
        values = batch.drop_columns(names)
        start = 0
        for end in _changes(batch, names):
            key = tuple(batch.column(n)[start].as_py() for n in names)
            if key != self.key:
                self.end_file()
                self.key, self.file = key, 0
            while start < end:
                n = min(end - start, self.records_per_file - self.rows) if self.records_per_file > 0 else end - start
                self.held.append(values.slice(start, n))
                self.rows += n
                start += n
                if self.rows == self.records_per_file:
                    self.end_file()

    def end_file(self) -> None:
        if not self.held:
            return
        block, part = self.key[-1].rsplit("-", 1)
        if self.block != (*self.key[:-1], block):
            self.block = (*self.key[:-1], block)
            into = "/".join(folder(c, v) for c, v in zip((*self.columns, "part"), (*self.key[:-1], f"{block}-t{self.task}"), strict=True))
            self.staged.append((f"{self.attempt}/{len(self.staged)}", into))
            os.makedirs(f"{self.staging}/{self.staged[-1][0]}")
        path = f"{self.staging}/{self.staged[-1][0]}/{part}-{self.file:04d}.snappy.parquet"
        pq.write_table(pa.Table.from_batches(self.held), path, compression="snappy", store_schema=False, write_page_checksum=True)
        self.held, self.rows, self.file = [], 0, self.file + 1


def write(rows: DataFrame, path: str, columns: tuple[str, ...], records_per_file: int = 0) -> None:
    """Write rows under the folders of ``columns``, a file for each ``part`` ("block-part"), none with over ``records_per_file`` rows.

    Rows of a part must follow each other in one task, and so must the parts of a block.
    """
    spark = rows.sparkSession
    root = folders.file_path(spark, path)
    staging = f"{root}/_temporary"
    # As Spark's writer by default: a path that is there already is an error.
    os.makedirs(root)
    os.mkdir(staging)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = _Files(staging, columns, records_per_file)
        for batch in batches:
            files.add(batch)
        files.end_file()
        yield pa.RecordBatch.from_pydict(
            {"staged": [s for s, _ in files.staged], "target": [t for _, t in files.staged]}, pa.schema([("staged", pa.string()), ("target", pa.string())])
        )

    try:
        # A row per block.
        for r in rows.mapInArrow(task, "staged string, target string").collect():
            os.makedirs(os.path.dirname(f"{root}/{r.target}"), exist_ok=True)
            os.rename(f"{staging}/{r.staged}", f"{root}/{r.target}")
    finally:
        folders.remove(spark, f"{path}/_temporary")
    with open(f"{root}/_SUCCESS", "w"):
        pass
