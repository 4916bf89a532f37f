"""Reading tables: folders of parquet or CSV, JDBC, and the stored feature table."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import ArrayType, StringType, StructType

from loanloom.sources.schemas import SHEETS, struct_type


def read_table(spark: SparkSession, path: str, schema: StructType | None = None, fmt: str = "parquet") -> DataFrame:
    """One table from a folder or file. A declared schema saves a pass over CSV and fixes the types."""
    reader = spark.read.schema(schema) if schema is not None else spark.read
    if fmt == "csv":
        return reader.option("header", True).option("mode", "PERMISSIVE").csv(path)
    return reader.format(fmt).load(path)


def read_workbook(spark: SparkSession, folder: str, workbook: str, fmt: str = "csv") -> dict[str, DataFrame]:
    """Every sheet of one source, kept as `<folder>/<workbook>/<sheet>.<fmt>`, by the table it feeds. All text."""
    return {
        table: read_table(spark, f"{folder}/{workbook}/{sheet}.{fmt}", fmt=fmt)
        for sheet, table in SHEETS[workbook].items()
    }


def read_stored(spark: SparkSession, folder: str, table: str) -> DataFrame:
    """The accepted rows of a table written by ingestion, with its declared schema."""
    path = f"{folder}/{table}"
    stored = spark.read.schema(struct_type(table).add("accepted", "boolean")).parquet(path)
    return stored.where("accepted").drop("accepted")


def read_rejected(spark: SparkSession, folder: str, table: str) -> DataFrame:
    """The rows ingestion kept out, with what is wrong with each."""
    schema = struct_type(table).add("violations", ArrayType(StringType())).add("accepted", "boolean")
    return spark.read.schema(schema).parquet(f"{folder}/{table}").where("NOT accepted").drop("accepted")


def read_jdbc(
    spark: SparkSession,
    url: str,
    table: str,
    split_column: str,
    lower: int,
    upper: int,
    partitions: int,
    properties: Mapping[str, str] | None = None,
) -> DataFrame:
    """A database table read by `partitions` tasks, each a range of a numeric or date column."""
    return spark.read.jdbc(
        url, table, column=split_column, lowerBound=lower, upperBound=upper, numPartitions=partitions,
        properties=dict(properties or {}),
    )


def read_features(spark: SparkSession, path: str, user_id: str | None = None) -> DataFrame:
    """The stored feature table, whole or for one customer (the filter reaches the parquet scan)."""
    df = spark.read.parquet(path)
    return df if user_id is None else df.where(F.col("user_id") == user_id)
