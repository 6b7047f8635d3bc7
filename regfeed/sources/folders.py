"""Names in a shared folder, through the file system that Spark itself uses for the path."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def names(spark: SparkSession, path: str) -> list[str]:
    """Names of the files and folders directly in a folder; none if there is no such folder."""
    system, where = _at(spark, path)
    return sorted(s.getPath().getName() for s in system.listStatus(where)) if system.exists(where) else []


def exists(spark: SparkSession, path: str) -> bool:
    system, where = _at(spark, path)
    return system.exists(where)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder with all that is in it."""
    system, where = _at(spark, path)
    system.delete(where, True)


def file_path(spark: SparkSession, path: str) -> str | None:
    """The path as Python opens it, if it is in a local or mounted file system."""
    system, where = _at(spark, path)
    uri = system.makeQualified(where).toUri()
    return uri.getPath() if uri.getScheme() == "file" else None
