"""Writing tables: append, replace with count, split by outcome."""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from loanloom.functions.scalars import mentions_approval
from loanloom.operators.aggregates import row_count


def append_rows_to(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def append_checked(checked: DataFrame, path: str) -> None:
    """Rows without violations to <path>/accepted=true, the others with their violations to accepted=false."""
    marked = checked.withColumn("accepted", F.size("violations") == 0)
    marked.write.mode("append").partitionBy("accepted").parquet(path)


def replace_table(df: DataFrame, path: str) -> DataFrame:
    """Overwrites a derived table and counts it back from storage."""
    df.write.mode("overwrite").parquet(path)
    return row_count(df.sparkSession.read.parquet(path))


def with_outcome(decisions: DataFrame) -> DataFrame:
    approved = mentions_approval(F.col("decision"))
    return decisions.withColumn("outcome", F.when(approved, "Approved").otherwise("Rejected"))


def write_split(decisions: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Decisions in two folders, outcome=Approved and outcome=Rejected. Appending rewrites nothing."""
    with_outcome(decisions).write.mode(mode).partitionBy("outcome").parquet(path)


def append_submissions(records: DataFrame, path: str) -> None:
    """Stores the records of new customers only."""
    append_rows_to(records.where(F.col("customer_type") == "new"), path)


def replace_versioned(df: DataFrame, path: str, version: str | None = None, keep: int = 2) -> str:
    """Writes `df` as a new version below <path>/versions and points <path>/current at it; gives the version's name.

    The pointer changes by one rename, after the version is complete: a job that dies on the way leaves the table as it
    was, and a reader has one whole version. The `keep` newest versions stay for readers that have begun.
    """
    spark, name = df.sparkSession, version or f"{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
    df.write.mode("overwrite").parquet(f"{path}/versions/{name}")
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    target, draft = jvm.org.apache.hadoop.fs.Path(f"{path}/current"), jvm.org.apache.hadoop.fs.Path(f"{path}/.current-{uuid.uuid4().hex}")
    fs = target.getFileSystem(conf)
    out = fs.create(draft, True)
    out.write(bytearray(name.encode()))
    out.close()
    overwrite = spark._sc._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    overwrite[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.makeQualified(target).toUri(), conf).rename(
        fs.makeQualified(draft), fs.makeQualified(target), overwrite)
    whole = sorted(((s.getModificationTime(), s.getPath()) for s in fs.listStatus(jvm.org.apache.hadoop.fs.Path(f"{path}/versions"))),
                   key=lambda found: (found[0], found[1].getName()))
    for _, old in whole[:-keep]:
        if old.getName() != name:
            fs.delete(old, True)
    return name


def current_version(spark: SparkSession, path: str) -> str | None:
    """The name of the version that readers of a versioned table get, None before the first."""
    pointer = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/current")
    fs = pointer.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(pointer):
        return None
    stream = fs.open(pointer)
    try:
        return spark._jvm.org.apache.hadoop.io.IOUtils.readFullyToByteArray(stream).decode()
    finally:
        stream.close()


def read_current(spark: SparkSession, path: str) -> DataFrame:
    """The current version of a versioned table; the rows stay those of that version."""
    return spark.read.parquet(f"{path}/versions/{current_version(spark, path)}")
