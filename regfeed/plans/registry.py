"""Query registry: each query is a function of the test views, with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from regfeed import fixtures
from regfeed.session import tune

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Views:
    """The fixture views over one folder of tables: ``v("ev")``."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __call__(self, name: str) -> DataFrame:
        return fixtures.view(self.spark, self.sf_dir, name)


def as_text(df: DataFrame) -> DataFrame:
    """Days and timestamps as text, the form the feeds' own interface gives them."""
    out = []
    for field in df.schema.fields:
        column = F.col(field.name)
        if isinstance(field.dataType, T.DateType):
            column = F.date_format(column, "yyyy-MM-dd").alias(field.name)
        elif isinstance(field.dataType, (T.TimestampType, T.TimestampNTZType)):
            column = F.date_format(column, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(field.name)
        out.append(column)
    return df.select(*out)


def query(name: str, sql: str | None = None, needs: tuple[str, ...] = ()):
    """Register a query; ``needs`` are the views its SQL reads."""

    def register(build: Callable[[Views], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return as_text(build(Views(tune(spark), sf_dir)))

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = (fixtures.with_views(*needs) + "\n" if needs else "") + sql
        return build

    return register
