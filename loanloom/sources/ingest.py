"""From source columns to typed, checked tables."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, functions as F

from loanloom.sources import schemas
from loanloom.sources.readers import read_stored
from loanloom.sources.sinks import append_checked

# Fixed value: the one source column whose canonical name does not follow the rule.
RENAMED = {"response.score.scoreExclusion": "response_score_exclusion"}


def canonical_name(source: str) -> str:
    """`RelatedPEPFullName`, `@timestamp`, `response.reportId` -> related_pep_full_name, timestamp, response_report_id."""
    if source in RENAMED:
        return RENAMED[source]
    flat = source.lstrip("@").replace(".", "_")
    flat = re.sub(r"([a-z0-9])([A-Z])", r"\1_\2", flat)
    return re.sub(r"([A-Z]+)([A-Z][a-z])", r"\1_\2", flat).lower()


def with_canonical_names(df: DataFrame) -> DataFrame:
    return df.withColumnsRenamed({c: canonical_name(c) for c in df.columns})


#: Forms of dates that are tried in order after ISO; of two readings the month comes first.
DATE_FORMS = (
    "M/d/yyyy[ H:m[:s]]", "d/M/yyyy[ H:m[:s]]", "M.d.yyyy[ H:m[:s]]", "d.M.yyyy[ H:m[:s]]", "M-d-yyyy[ H:m[:s]]",
    "d-M-yyyy[ H:m[:s]]", "yyyy/M/d[ H:m[:s]]", "MMM d[,] yyyy", "d MMM yyyy", "MMMM d[,] yyyy", "d MMMM yyyy",
)


def lenient_timestamp(value: Column, forms: Sequence[str] = DATE_FORMS) -> Column:
    """The first form that fits, else NULL."""
    text = F.trim(value.cast("string"))
    tries = [F.try_to_timestamp(text, F.lit(form)).cast("timestamp_ntz") for form in forms]
    return F.coalesce(value.try_cast("timestamp_ntz"), *tries)


def lenient_date(value: Column, forms: Sequence[str] = DATE_FORMS) -> Column:
    return lenient_timestamp(value, forms).cast("date")


def lenient_number(value: Column, type_: str = "decimal(15,2)") -> Column:
    return value.try_cast(type_)


def tri_state(value: Column) -> Column:
    """0/1 or false/true as a boolean; anything else is NULL."""
    text = F.lower(value.cast("string"))
    return F.when(text.isin("1", "1.0", "true"), True).when(text.isin("0", "0.0", "false"), False)


def truthy(value: Column) -> Column:
    """Anything but zero, false or an empty text is true, and so is a missing value."""
    text = F.lower(F.trim(value.cast("string")))
    return F.coalesce(~text.isin("0", "0.0", "false", ""), F.lit(True))


def nullable_integer(value: Column) -> Column:
    """A whole number, possibly written as a float; NULL where it is none."""
    number = value.try_cast("double")
    return F.when(number == F.floor(number), number.try_cast("bigint"))


def typed(df: DataFrame, table: str) -> DataFrame:
    """Canonical names, then the lenient parses of the table; columns without one pass through."""
    named = with_canonical_names(df)
    rules = [
        (schemas.LENIENT_TIMESTAMPS, lenient_timestamp), (schemas.LENIENT_DATES, lenient_date),
        (schemas.LENIENT_NUMBERS, lenient_number), (schemas.TRI_STATE, tri_state),
        (schemas.TRUTHY, truthy), (schemas.NULLABLE_INTEGERS, nullable_integer),
    ]
    parsed = {
        name: parse(F.col(name))
        for by_table, parse in rules for name in by_table.get(table, ()) if name in named.columns
    }
    return named.withColumns(parsed) if parsed else named


def conformed(df: DataFrame, table: str, declared: list[schemas.SourceColumn] | None = None) -> DataFrame:
    """The declared columns with their types and defaults, plus `violations`: what keeps a row out.

    A column the source lacks is NULL or its default. A value that does not fit its type, a text
    that is too long and a missing required value are each named in `violations`.
    """
    declared = declared or schemas.columns(table)
    out, problems = [], []
    for c in declared:
        source = F.col(f"`{c.name}`") if c.name in df.columns else F.lit(None).cast("string")
        value = source.try_cast(c.type)
        problems.append(F.when(source.isNotNull() & value.isNull(), f"{c.name}: not a {c.type}"))
        if c.length:
            problems.append(F.when(F.length(source.cast("string")) > c.length, f"{c.name}: longer than {c.length}"))
        if c.default is not None:
            value = F.coalesce(value, F.lit(c.default).cast(c.type))
        if c.required:
            problems.append(F.when(value.isNull() & source.isNull(), f"{c.name}: missing"))
        out.append(value.alias(c.name))
    # Without the NULLs; a lambda as in array_compact would have every rule interpreted, at several times their cost.
    found = F.array_except(F.array(*problems), F.array(F.lit(None).cast("string")))
    return df.select(*out, found.alias("violations"))


def accepted(checked: DataFrame) -> DataFrame:
    return checked.where(F.size("violations") == 0).drop("violations")


def quarantined(checked: DataFrame) -> DataFrame:
    return checked.where(F.size("violations") > 0)


def reconcile(source: Mapping[str, DataFrame], loaded: Mapping[str, DataFrame]) -> DataFrame:
    """Row counts of both sides per table, OK or MISMATCH. Each side is counted once, column-free."""
    def counted(tables: Mapping[str, DataFrame], side: str) -> DataFrame:
        parts = [df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("table_name"), "rows")
                 for name, df in tables.items()]
        return reduce(DataFrame.unionByName, parts).withColumn("side", F.lit(side))

    both = counted(source, "source").unionByName(counted(loaded, "loaded"))
    per_side = both.groupBy("table_name").agg(
        F.sum(F.when(F.col("side") == "source", F.col("rows"))).alias("source_rows"),
        F.sum(F.when(F.col("side") == "loaded", F.col("rows"))).alias("loaded_rows"),
    )
    return _compared(per_side)


def _compared(counts: DataFrame) -> DataFrame:
    same = F.col("source_rows").eqNullSafe(F.col("loaded_rows"))
    return counts.withColumn("status", F.when(same, "OK").otherwise("MISMATCH"))


def ingest(df: DataFrame, table: str, folder: str) -> int:
    """Types, checks and appends one table, accepted and rejected rows in separate folders; gives the rows read.

    The rows are counted as they pass to the writer, so the source is read once.
    """
    seen = Observation(f"source of {table}")
    counted = df.observe(seen, F.count(F.lit(1)).alias("rows"))
    append_checked(conformed(typed(counted, table), table), f"{folder}/{table}")
    return seen.get.get("rows", 0)


#: Tables that `ingest_all` writes at the same time.
AT_A_TIME = 4


def ingest_all(sources: Mapping[str, DataFrame], folder: str) -> DataFrame:
    """Ingests every table and reconciles the rows read from each source with those its table holds afterwards.

    Row counts of the sources come from the writing pass, those of the tables from the stored files' footers. A few
    tables are written at a time, since one of few files leaves most cores idle.
    """
    spark = next(iter(sources.values())).sparkSession
    with ThreadPoolExecutor(AT_A_TIME) as writers:
        read = list(writers.map(lambda source: (source[0], ingest(source[1], source[0], folder)), sources.items()))
    counts = spark.createDataFrame(read, "table_name string, source_rows bigint")
    stored = [read_stored(spark, folder, table).agg(F.count("*").alias("loaded_rows")).select(F.lit(table).alias("table_name"), "loaded_rows")
              for table in sources]
    return _compared(counts.join(reduce(DataFrame.unionByName, stored), "table_name"))
