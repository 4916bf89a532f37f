"""The registered queries, and the stages of the pipeline against plain Python, on the smallest sample."""

import os

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from checks.run import compare, connect
from loanloom.llm.queries import QUERIES, SQL
from tests.llm.test_exact_and_packing import check_packing, plain
from tests.llm.test_near_copies import classes

FOLDER = "/root/testdata/sf0.001"
needs_samples = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="sample tables not there")


@needs_samples
@pytest.mark.parametrize("name", list(QUERIES))
def test_query(name, spark):
    outcome, rows = compare(spark, connect(FOLDER), FOLDER, QUERIES[name], SQL.get(name))
    assert outcome in ("ok", "rows only") and rows > 0


def test_all_are_registered():
    assert {f"op{n}" for n in range(1, 11)} == {n.split("_")[0] for n in QUERIES}
    assert {*QUERIES, "pipeline"} <= set(entry.queries())


@needs_samples
def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id: r.text for r in docs.collect()}
        docs = stage(spark, docs, FOLDER)
        assert docs.columns == "doc_id text lang source n_chars".split()
        after = {r.doc_id: r.text for r in docs.collect()}
        assert len(after) == docs.count() and set(after) <= set(before)
        if name == "language":
            assert all(any(c.isalpha() for c in t) for t in after.values())
        if name == "exact_copies":
            assert len(after) == len({plain(t) for t in before.values()}) == len({plain(t) for t in after.values()})
        if name == "near_copies":
            assert set(after) == set(classes(before).values())
        if name == "benchmark_leaks":
            items = [r.text for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
            assert not any(i in t for i in items for t in after.values())
            assert {d for d, t in before.items() if any(i in t for i in items)} == set(before) - set(after)
    check_packing(docs, corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER).collect(), 2048, 65536)
    assert corpus_pipeline.run(spark, FOLDER).count() > 0


def test_stages_on_odd_and_empty_tables(spark, odd, none):
    for docs in (odd, none):
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, FOLDER)
            assert docs.count() >= 0
