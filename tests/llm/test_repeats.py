import random
from collections import Counter

import numpy as np
import pytest

from loanloom.llm import lookups, substrings, suffixes
from loanloom.llm.bytestext import byte_runs, pack, runs, texts_of, unpack, word_hashes, words_of

from tests.llm.conftest import prose


@pytest.mark.parametrize("period", substrings.COVERS)
def test_covers_have_every_difference(period):
    members = substrings.COVERS[period]
    assert {(a - b) % period for a in members for b in members} == set(range(period))


def test_packed_keys_round_trip():
    keys = np.unique(np.random.default_rng(1).integers(0, 2**64, 5000, dtype=np.uint64))
    for some in (keys, keys[:1], keys[:0], np.array([0, 2**64 - 1], np.uint64)):
        assert (unpack(pack(some)) == some).all()


def test_hashes_depend_on_the_bytes_alone(monkeypatch):
    import pyarrow as pa

    texts = texts_of(pa.array(["abc abc xabc ", None, "", " abc"]))
    first, last, doc = words_of(texts)
    hashes = word_hashes(texts.data, first, last)
    assert [texts.data[a:b].tobytes() for a, b in zip(first, last)] == [b"abc", b"abc", b"xabc", b"abc"]
    assert hashes[0] == hashes[1] == hashes[3] != hashes[2] and doc.tolist() == [0, 0, 0, 3]
    data = np.frombuffer(b"0123456789" * 10, np.uint8)
    monkeypatch.setattr("loanloom.llm.bytestext.RUN_BLOCK", 16)
    found = byte_runs(data, 7, np.arange(len(data) - 6))
    assert (found[:80] == found[10:90]).all() and len(set(found[:10].tolist())) == 10
    assert len(runs(hashes, 9)) == 0


def corpus(seed, n=60):
    """Random texts with copies, shared passages, self-repeats and non-ASCII letters."""
    rng = random.Random(seed)
    passages = [prose(rng, rng.randrange(8, 60)) for _ in range(5)] + ["é" * 70, "na na " * 40]
    texts = {}
    for i in rng.sample(range(-50, 400), n):
        parts = [prose(rng, rng.randrange(0, 40))]
        for _ in range(rng.randrange(3)):
            parts += [rng.choice(passages), prose(rng, rng.randrange(10))]
        texts[i] = rng.choice([" ", "\n", "  "]).join(parts)
    ids = list(texts)
    for k in range(5):
        texts[ids[k]] = texts[ids[-1 - k]]
    texts[500], texts[501] = None, ""
    return texts


@pytest.mark.parametrize("seed,length", [(1, 50), (2, 50), (3, 20)])
def test_removed_bytes_equal_brute_force(documents, seed, length):
    texts = corpus(seed)
    rows = substrings.remove_repeats(documents(texts), length, chunk_bytes=1500).collect()
    want = substrings.brute_force(list(texts.items()), length)
    assert {r.doc_id: bytes(r.kept) for r in rows} == want
    for r in rows:
        data = (texts[r.doc_id] or "").encode()
        assert r.n_bytes == len(data)
        spans = [(s.start, s.end) for s in r.spans]
        assert b"".join(data[a:b] for a, b in zip([0, *(e for _, e in spans)], [*(s for s, _ in spans), len(data)])) == want[r.doc_id]


def without_windows(texts, depth):
    words = {i: (t or "").encode().split() for i, t in texts}
    times = Counter(tuple(w[p:p + depth]) for w in words.values() for p in range(len(w) - depth + 1))
    out = {}
    for i, w in words.items():
        gone = {q for p in range(len(w) - depth + 1) if times[tuple(w[p:p + depth])] > 1 for q in range(p, p + depth)}
        out[i] = (len(w), len(gone), b" ".join(x for q, x in enumerate(w) if q not in gone).decode())
    return out


@pytest.mark.parametrize("seed,digits", [(1, (14, 35)), (2, (4, 9, 12)), (3, (6,))])
def test_removed_words_equal_brute_force(documents, seed, digits):
    texts = corpus(seed)
    rows = suffixes.remove_repeats(documents(texts), digits, chunk_bytes=1500).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in rows} == without_windows(texts.items(), digits[-1])


def test_one_passage_in_all_documents(documents):
    rng = random.Random(4)
    line = prose(rng, 50)
    texts = {i: prose(rng, 12) + "\n" + line for i in range(300)}
    rows = substrings.remove_repeats(documents(texts, parts=6), chunk_bytes=4000).collect()
    assert {r.doc_id: bytes(r.kept) for r in rows} == substrings.brute_force(list(texts.items()))


def test_odd_rows(odd):
    total = odd.count()
    found = substrings.remove_repeats(odd, chunk_bytes=4000).collect()
    assert len(found) == total
    whole = {len(r.text.encode()) for r in odd.where("doc_id = 6 or doc_id = 12").collect()}
    by_id = {r.doc_id: r for r in found if r.doc_id is not None}
    # -3 has the text of 12 first; 7 begins with the text of 6; a null id is larger than 8.
    assert by_id[12].kept == b"" and by_id[-3].spans == [] and by_id[6].spans == []
    assert by_id[7].spans[0].end == max(whole) and len(by_id[7].kept) == 4
    assert sorted(len(r.kept) for r in found if r.doc_id is None) == [0, 0]
    words = suffixes.remove_repeats(odd, chunk_bytes=4000).collect()
    assert len(words) == total and {r.n_removed for r in words if r.doc_id in (6, 7)} == {30_000}


def test_nothing(none, documents):
    for docs in (none, documents({1: None, 2: ""})):
        assert substrings.remove_repeats(docs).count() == suffixes.remove_repeats(docs).count() == docs.count()


def test_texts_are_shuffled_once(documents):
    df = suffixes.remove_repeats(documents({i: "a b c " * 30 for i in range(50)}), chunk_bytes=500)
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("ReusedExchange") >= 1
    assert "Cartesian" not in plan and "NestedLoop" not in plan


def test_layout_grows_with_the_input(documents):
    layout = lookups.Layout(chunks=10**6, bytes=4 * 10**12)
    assert layout.buckets(0.2) > 10**5 and layout.filter_bits(0.2) > 45
