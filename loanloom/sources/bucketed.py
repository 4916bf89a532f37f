"""Credit tables stored in buckets of their customer, so that what is joined by customer never moves again.

Every table is written once as sorted buckets of the same number and key. Scans then report that partitioning, and the
features' group-bys and joins by user need no exchange; a lookup of one customer reads one bucket of each table.
Loan states are stored with the owner of their loan, which is the one join by loan. A bucket holds whole customers: a
customer with a large share of a table makes a large bucket, which partial sums pass over in one task without holding
it; where that matters, the plain tables spread it instead.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from loanloom.operators.joins import states_to_loans
from loanloom.plans.features import CreditTables

NAMES = tuple(CreditTables.__dataclass_fields__)


def _key(name: str) -> str:
    return "id" if name == "users" else "user_id"


def write_bucketed(tables: CreditTables, folder: str, prefix: str, buckets: int) -> CreditTables:
    """Writes all tables below `folder`, registers them as <prefix>_<table> and returns them as stored."""
    for name in NAMES:
        df = getattr(tables, name)
        if name == "loan_states":
            df = states_to_loans(df, tables.loans)
        # One task per bucket, so each bucket is one file.
        placed = df.repartition(buckets, _key(name))
        placed.write.format("parquet").bucketBy(buckets, _key(name)).sortBy(_key(name)).option(
            "path", f"{folder}/{name}").mode("overwrite").saveAsTable(f"{prefix}_{name}")
    return bucketed_tables(tables.users.sparkSession, prefix)


def attach_bucketed(spark: SparkSession, folder: str, prefix: str, buckets: int) -> CreditTables:
    """Registers tables that an earlier session wrote below `folder` with this number of buckets."""
    for name in NAMES:
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in spark.read.parquet(f"{folder}/{name}").schema)
        spark.sql(f"CREATE TABLE IF NOT EXISTS {prefix}_{name} ({columns}) USING parquet CLUSTERED BY ({_key(name)}) "
                  f"SORTED BY ({_key(name)}) INTO {buckets} BUCKETS LOCATION '{folder}/{name}'")
    return bucketed_tables(spark, prefix)


def bucketed_tables(spark: SparkSession, prefix: str) -> CreditTables:
    return CreditTables(**{name: spark.table(f"{prefix}_{name}") for name in NAMES})


def of_customer(tables: CreditTables, user_id: str) -> CreditTables:
    """The rows of one customer; the literal key leaves one bucket of every table to read."""
    return CreditTables(**{name: getattr(tables, name).where(F.col(_key(name)) == user_id) for name in NAMES})
