import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from loanloom.llm import bagminhash as B
from loanloom.llm.bytestext import texts_of
from loanloom.llm.components import components

from tests.llm.conftest import prose


def bag(text):
    w = text.split()
    return Counter(tuple(w[k:k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)] if w else [])


def similarity(a, b):
    both = sum((a & b).values())
    return both / (a.total() + b.total() - both) if both else 0.0


def classes(texts):
    """Smallest id of each document's class, by comparing all pairs."""
    ids, root, bags = sorted(texts), {i: i for i in texts}, {i: bag(t or "") for i, t in texts.items()}
    for x in ids:
        for y in ids:
            if x < y and root[x] != root[y] and ((texts[x] or "") == (texts[y] or "") or similarity(bags[x], bags[y]) >= 0.8):
                old, new = max(root[x], root[y]), min(root[x], root[y])
                root = {i: new if r == old else r for i, r in root.items()}
    return root


def noisy(rng, text, share):
    return " ".join(prose(rng, 1) if rng.random() < share else w for w in text.split())


@pytest.mark.parametrize("weights", [((1, 1, 1, 1), (1, 1, 1, 0)), ((5, 1, 9, 0), (3, 1, 14, 2)), ((40, 2, 0, 0), (33, 2, 6, 1))])
def test_signatures_estimate_weighted_jaccard(weights):
    """Over many random keys the share of equal components is the weighted Jaccard similarity."""
    rng, size, docs = np.random.default_rng(3), 64, 400
    keys = rng.integers(0, 2**63, (docs, 4)).astype(np.uint64)
    made = []
    for w in weights:
        counts = np.tile(w, docs)
        owners = np.repeat(np.arange(docs), 4)
        made.append(B.signatures(docs, owners[counts > 0], keys.reshape(-1)[counts > 0], counts[counts > 0], size))
    one, two = map(np.array, weights)
    want = np.minimum(one, two).sum() / np.maximum(one, two).sum()
    assert abs((made[0] == made[1]).mean() - want) < 0.015


def test_signature_times_are_exponential_in_the_weight():
    counts = np.full(2000, 7)
    times = B.signatures(2000, np.arange(2000), np.arange(2000).astype(np.uint64) * np.uint64(77777), counts, 16)
    assert abs(times.mean() * 7 - 1) < 0.03


def test_empty_multiset_has_no_time():
    assert np.isinf(B.signatures(2, np.array([1]), np.array([5], np.uint64), np.array([1]), 8)[0]).all()


def test_shingles_of_short_texts():
    texts = texts_of(pa.array(["a b", "a b c d e f", None, "", "a b c d e", "b a"]))
    owners, keys = B.shingles(texts)
    assert Counter(owners.tolist()) == {0: 1, 1: 2, 4: 1, 5: 1} and len(set(keys.tolist())) == 4


@pytest.mark.parametrize("seed", [1, 2])
def test_classes_equal_all_pairs(documents, seed):
    rng = random.Random(seed)
    texts = {}
    for i in range(25):
        base = prose(rng, rng.randrange(3, 150))
        if i % 4 == 0:
            base += " again and again and" * 20
        for _ in range(rng.randrange(1, 6)):
            texts[rng.randrange(10**6)] = noisy(rng, base, rng.choice([0, 0.005, 0.02, 0.03]))
    texts[-1], texts[-2], texts[-5] = None, "", "  "
    got = {r.doc_id: r.class_id for r in B.near_copies(documents(texts)).collect()}
    assert got == classes(texts)


def test_chain_and_hot_group(documents):
    """Neighbours in a chain are alike, its ends are not; one text has hundreds of near copies."""
    rng = random.Random(9)
    words = prose(rng, 200).split()
    texts = {}
    for i in range(12):
        texts[i] = " ".join(words)
        words[10 + 15 * i] = "other"
        words[12 + 15 * i] = "words"
    base = prose(rng, 120).split()
    for i in range(300):
        copy = list(base)
        copy[rng.randrange(120)] = f"c{i}"
        texts[1000 + i] = " ".join(copy)
    rows = {r.doc_id: r for r in B.near_copies(documents(texts, parts=5)).collect()}
    assert {rows[i].class_id for i in range(12)} == {0}
    assert {rows[1000 + i].class_id for i in range(300)} == {1000} and rows[1000].class_size == 300


def test_one_row_of_each_class_stays(odd, none):
    assert B.near_copies(odd).count() == odd.count()
    kept = B.drop_near_copies(odd)
    assert kept.columns == odd.columns
    texts = [r.text or "" for r in kept.collect()]
    assert len(texts) == len(set(texts))
    # Null and empty are one text, white space another; 6 and 7, and the shared passages, are near copies.
    assert kept.where("text is null or text = ''").count() == 1
    assert B.near_copies(none).count() == B.drop_near_copies(none).count() == 0


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 100 + i) for i in range(1, 40)] + [(7, 7), (139, 150)]
    rng = random.Random(1)
    rng.shuffle(edges)
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(31)}, **{i: 100 for i in [*range(100, 140), 150]}}


def test_a_hot_group_of_several_components(documents, monkeypatch):
    """Copies of one text that are more or less alike, compared in small blocks."""
    monkeypatch.setattr(B, "BLOCK_NODES", 60)
    rng = random.Random(11)
    base = prose(rng, 60).split()
    texts = {}
    for i in range(350):
        copy = list(base)
        for _ in range(rng.choice([1, 2, 3, 4, 5])):
            copy[rng.randrange(60)] = f"c{rng.randrange(500)}"
        texts[i] = " ".join(copy)
    want = classes(texts)
    got = {r.doc_id: r.class_id for r in B.near_copies(documents(texts, parts=5)).collect()}
    assert got == want and len(set(want.values())) > 20
    assert max(Counter(want.values()).values()) > 50
