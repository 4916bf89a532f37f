"""The corpus pipeline: language, exact copies, near copies, benchmark leaks, packing.

Each stage reads what its predecessor kept and returns the columns of documents, but for the last, which returns
the packed sequences. A stage that a table gives no reason to drop a document keeps it: language identification
rejects only texts without any letter and texts whose best language has less than LEAST_SCORE.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loanloom.llm import bagminhash, decontaminate, exact, language, packing, queries
from loanloom.session import materialise

LEAST_SCORE = 0.4


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    network = language.fit(docs.where(~language.held_out(F.col("doc_id"))))
    found = language.identify(docs, network)
    return found.where((F.col("lang_pred") != language.UNKNOWN) & (F.col("score") >= LEAST_SCORE)).select(docs.columns)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bagminhash.drop_near_copies(docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_leaks(docs, queries.table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("language", keep_known_languages),
    ("exact_copies", drop_exact_copies),
    ("near_copies", drop_near_copies),
    ("benchmark_leaks", drop_benchmark_leaks),
    ("packing", pack),
]

#: No SQL has the network's, the signatures' and the walks' results; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over documents; what a stage keeps is written to the shared folder for the next."""
    docs = queries.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
