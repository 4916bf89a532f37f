"""Collects the check queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from checks.parts import PARTS
from checks.sql import with_views
from loanloom import fixtures
from loanloom.plans.features import CreditTables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def tidy(df: DataFrame) -> DataFrame:
    """Decimals as doubles and doubles to six digits, so that both engines print the same value."""
    def column(field: T.StructField) -> str:
        if isinstance(field.dataType, (T.DecimalType, T.DoubleType, T.FloatType)):
            return f"round(CAST(`{field.name}` AS DOUBLE), 6) AS `{field.name}`"
        return f"`{field.name}`"

    return df.selectExpr(*[column(f) for f in df.schema.fields])


def check(sql: str | None = None):
    """Registers a query under its function name, with the SQL that must give the same rows."""
    def register(query):
        name = query.__name__

        def run(spark: SparkSession, folder: str) -> DataFrame:
            return tidy(query(Tables(spark, folder)))

        QUERIES[name] = run
        if sql is not None:
            SQL[name] = with_views(sql, **PARTS)
        return query

    return register


class Tables:
    """The derived tables of one sample folder as attributes; `sample` reads a given table."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        if name not in fixtures.VIEWS:
            raise AttributeError(name)
        return fixtures.view(self.spark, self.folder, name)

    def sample(self, name: str) -> DataFrame:
        return fixtures.sample(self.spark, self.folder, name)

    @property
    def credit(self) -> CreditTables:
        return CreditTables(**fixtures.views(self.spark, self.folder, *CreditTables.__dataclass_fields__))
