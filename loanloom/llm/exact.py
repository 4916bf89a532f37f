"""Exact dedup: combine equal texts inside tasks, then per salted digest, then over the salts.

Built from DataFrame functions only. Texts are equal when identical after deleting white space
(`[\\x20\\x09-\\x0D]`); a null text counts as empty. Every grouping stage has the whole normalised text in
its key beside the digest, so a digest never decides alone; members find their group again by SHA-256.

Defined results: empty and null texts form one group. Of equal texts the longest original stays (code
points), then the smallest doc_id; a null doc_id ranks after every other. Rows that repeat doc_id, text
length and normalised text are copies of each other: one is kept. Other columns are ignored by `groups` and
`decisions`, and carried by `drop_copies`, where columns may have any name but those of the
three helper columns `_sha`, `_length` and `_rank`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loanloom.llm.salted import combine, per_salt, salt_of

_ID_SPAN = 2**65


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", "")


def _rank() -> Column:
    """Length and doc_id as one number: more code points win, then the smaller id, null ids last."""
    by_id = F.coalesce(
        F.expr("CAST(9223372036854775808 AS DECIMAL(20,0)) - CAST(CAST(doc_id AS BIGINT) AS DECIMAL(20,0))"), F.lit(0))
    return F.expr(f"CAST(_length AS DECIMAL(10,0)) * CAST({_ID_SPAN} AS DECIMAL(20,0))") + by_id.cast("decimal(20,0)")


def _winner(groups: DataFrame) -> DataFrame:
    """keep_id and keep_length read back from the winning rank."""
    span, middle = f"CAST({_ID_SPAN} AS DECIMAL(20,0))", "CAST(9223372036854775808 AS DECIMAL(20,0))"
    return groups.selectExpr(
        "*", f"CAST(CASE WHEN _rank % {span} > 0 THEN {middle} - _rank % {span} END AS BIGINT) AS keep_id",
        f"CAST((_rank - _rank % {span}) / {span} AS INT) AS keep_length").drop("_rank")


def _members(docs: DataFrame) -> DataFrame:
    return docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.length(F.coalesce("text", F.lit(""))).alias("_length"),
        normalised(F.col("text")).alias("_norm"),
    ).withColumns({"text_sha256": F.sha2(F.col("_norm"), 256), "_salt": salt_of(F.col("doc_id"), F.col("_length"))})


def groups(docs: DataFrame) -> DataFrame:
    """One row per distinct normalised text: text_sha256, keep_id, keep_length, group_size, _salts."""
    combined = combine(_members(docs), ["text_sha256", "_norm"], _rank())
    return _winner(combined.drop("_norm")).withColumnRenamed("_n", "group_size")


def decisions(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    same = ["doc_id", "_length", "text_sha256", "_salt"]
    members = _members(docs).groupBy(*same).agg(F.count(F.lit(1)).alias("_copies"))
    members = members.withColumn("_copy", F.explode(F.expr("sequence(1L, _copies)")))
    stays = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("_length") == F.col("keep_length")) & (F.col("_copy") == 1)
    return members.join(per_salt(groups(docs)), ["text_sha256", "_salt"]).select(
        "doc_id", "keep_id", "group_size", stays.alias("kept"), "text_sha256")


def drop_copies(docs: DataFrame) -> DataFrame:
    """The rows of `docs` that stay, with all their columns."""
    rows = docs.withColumns({
        "_sha": F.sha2(normalised(F.col("text")), 256), "_length": F.length(F.coalesce("text", F.lit("")))})
    once = rows.withColumn("_rank", _rank()).dropDuplicates(["_sha", "_rank"])
    best = combine(_members(docs), ["text_sha256", "_norm"], _rank()).select(F.col("text_sha256").alias("_sha"), "_rank")
    return once.join(best, ["_sha", "_rank"], "left_semi").select(docs.columns)
