import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use for their own columns.
CLASHING = "key chunk bucket kind piece slot shard node root size degree class_id class_size lang_pred score keep_id a b".split()


def prose(rng: random.Random, n: int, words: int = 4000) -> str:
    return " ".join(f"w{rng.randrange(words)}" for _ in range(n))


@pytest.fixture
def documents(spark):
    """documents from {doc_id: text} or (doc_id, text) pairs, over several partitions."""
    def build(texts, lang="en", parts=3):
        pairs = texts.items() if isinstance(texts, dict) else texts
        rows = [(i, t, lang, "src0", None if t is None else len(t)) for i, t in pairs]
        return spark.createDataFrame(rows, SCHEMA).repartition(parts) if rows else spark.createDataFrame([], SCHEMA)
    return build


@pytest.fixture
def odd(documents):
    """Nulls, empty and long texts, repeated rows and ids, and columns with clashing names."""
    from pyspark.sql import functions as F

    rng = random.Random(5)
    long = prose(rng, 30_000)
    shared = prose(rng, 60)
    rows = [
        (1, None), (2, ""), (3, " \t\n "), (4, "one"), (5, "one"), (5, "one"), (6, long), (7, long + " end"),
        (None, shared), (None, None), (8, shared), (9, prose(rng, 40) + " " + shared), (9, "a second text of nine"),
        (10, "Ünïcode — “quotes” 中文字符 " * 5), (11, "123 456 !!! ..."), (12, "é" * 80), (-3, "é" * 80)]
    df = documents(rows)
    return df.withColumns({name: F.lit("x") for name in CLASHING})


@pytest.fixture
def none(documents):
    return documents({})
