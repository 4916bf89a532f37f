import itertools
import random

import pytest

from loanloom.llm import exact, packing


def plain(text):
    return "".join(c for c in text or "" if c not in " \t\n\x0b\x0c\r")


def test_longest_then_smallest_id_stays(documents):
    got = {r.doc_id: r for r in exact.decisions(documents({3: "a b", 1: "ab", 2: "a  b", 7: " a b", 4: "c"})).collect()}
    assert {i: r.keep_id for i, r in got.items()} == {1: 2, 2: 2, 3: 2, 7: 2, 4: 4}
    assert [got[i].kept for i in (1, 2, 3, 7, 4)] == [False, True, False, False, True]
    assert got[1].group_size == 4 and got[4].group_size == 1


def test_every_row_has_a_decision_and_each_text_one_kept(odd):
    rows = exact.decisions(odd).collect()
    assert len(rows) == odd.count()
    texts = {plain(r.text) for r in odd.collect()}
    assert sum(r.kept for r in rows) == len(texts) == len({r.text_sha256 for r in rows})
    kept = exact.drop_copies(odd)
    assert kept.columns == odd.columns and sorted(plain(r.text) for r in kept.collect()) == sorted(texts)


def test_digest_does_not_decide_alone(documents, monkeypatch):
    """With a useless digest the grouping still compares whole texts."""
    from pyspark.sql import functions as F

    docs = documents({i: f"text {i % 3}" for i in range(30)})
    members = exact._members(docs).withColumn("text_sha256", F.lit("same"))
    monkeypatch.setattr(exact, "_members", lambda _: members)
    assert sorted(r.group_size for r in exact.groups(docs).collect()) == [10, 10, 10]


def test_hot_group_over_many_partitions(documents):
    docs = documents({i: "hot text" if i % 3 else f"t{i}" for i in range(600)}, parts=7)
    rows = exact.decisions(docs).collect()
    assert {r.keep_id for r in rows if r.group_size == 400} == {1}


def test_native_plan(documents):
    plan = exact.decisions(documents({1: "a"}))._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow", "CartesianProduct", "NestedLoop"))


def test_exact_on_nothing(none):
    assert exact.decisions(none).count() == exact.drop_copies(none).count() == 0


def padding(histogram, ends):
    return sum(n * (min(e for e in ends if e >= length) - length) for length, n in histogram.items())


@pytest.mark.parametrize("seed", range(6))
def test_boundaries_are_optimal(seed):
    rng = random.Random(seed)
    histogram = {rng.randrange(1, 60): rng.randrange(1, 50) for _ in range(11)}
    for buckets in (1, 2, 3, 4, 20):
        ends = packing.boundaries(histogram, buckets)
        assert len(ends) <= buckets and max(ends) == max(histogram)
        best = min(
            padding(histogram, [*c, max(histogram)])
            for k in range(min(buckets, len(histogram))) for c in itertools.combinations(sorted(histogram), k))
        assert padding(histogram, ends) == best


def check_packing(docs, rows, max_tokens, budget):
    want = sorted((r.doc_id is None, r.doc_id or 0, len((r.text or "").encode().split())) for r in docs.collect() if (r.text or "").encode().split())
    got = {}
    for r in rows:
        assert r.start_token == r.piece * max_tokens and 0 < r.n_tokens <= min(max_tokens, r.bucket_tokens)
    assert sum(r.n_tokens for r in rows) == sum(n for *_, n in want)
    batches = {}
    for r in rows:
        batches.setdefault((r.bucket, r.batch), []).append(r)
        got.setdefault(r.bucket, set()).add(r.bucket_tokens)
    assert all(len(v) == 1 for v in got.values())
    for (bucket, batch), members in batches.items():
        assert sorted(m.slot for m in members) == list(range(len(members)))
        assert len(members) == 1 or len(members) * members[0].bucket_tokens <= budget
        full = max(1, budget // members[0].bucket_tokens)
        assert len(members) == full or batch == max(b for k, b in batches if k == bucket)


def test_packing_places_every_token_once(odd, documents):
    rng = random.Random(2)
    docs = documents({i: "x " * rng.randrange(0, 90) for i in range(300)})
    for given in (odd, docs):
        check_packing(given, packing.pack(given, max_tokens=32, buckets=4, token_budget=200).collect(), 32, 200)


def test_packing_nothing(none, documents):
    assert packing.pack(none).count() == 0
    assert packing.pack(documents({1: None, 2: " "})).count() == 0
