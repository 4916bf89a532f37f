"""Language model, phrases and prefix trie against plain Python."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from functools import lru_cache

import numpy as np
import pytest
from pyspark.sql import functions as F

from loanloom.llm import grams, katz, phrases, prefixes
from tests.llm.conftest import prose


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


# ---------------------------------------------------------------------------------------------- language model

class PlainKatz:
    """The same model by recursion over dictionaries."""

    def __init__(self, texts, order):
        self.c, self.order = [Counter() for _ in range(order + 1)], order
        for w in texts:
            for n in range(1, order + 1):
                for k in range(len(w) - n + 1):
                    self.c[n][tuple(w[k:k + n])] += 1
        self.tokens = sum(self.c[1].values())
        self.d = [None, *(katz.good_turing([list(c.values()).count(r) for r in range(1, 7)]) for c in self.c[1:])]
        self.following = defaultdict(set)
        for n in range(2, order + 1):
            for g, c in self.c[n].items():
                if c >= self.least(n):
                    self.following[g[:-1]].add(g[-1])
        self.unknown = 1 - sum(self.part((w,)) for (w,) in self.c[1])
        self.p, self.a = lru_cache(None)(self._p), lru_cache(None)(self._a)

    def least(self, n):
        return katz.LEAST[min(n, 3) - 1]

    def part(self, g):
        n, c = len(g), self.c[len(g)][g]
        whole = self.c[n - 1][g[:-1]] if n > 1 else self.tokens
        d = 0 if c < self.least(n) else self.d[n][c - 1] if c <= katz.MOST else 1
        return d * c / (whole + katz.EXTRA)

    def _p(self, h, w):
        if self.c[len(h) + 1][h + (w,)] >= self.least(len(h) + 1):
            return self.part(h + (w,))
        return self.a(h) * self.p(h[1:], w) if h else self.unknown

    def _a(self, h):
        after = self.following[h]
        return (1 - sum(self.part(h + (w,)) for w in after)) / (1 - sum(self.p(h[1:], w) for w in after)) if after else 1.0

    def score(self, w):
        return sum(math.log10(self.p(tuple(w[max(0, k - self.order + 1):k]), w[k])) for k in range(len(w)))


def tokens(text):
    return re.findall(r"[^\x20\x09-\x0d]+", lower(text)) + [""]


def zipf_texts(seed, n, longest=60):
    rng = random.Random(seed)
    return {i: " ".join(f"W{int(rng.paretovariate(0.8))}" for _ in range(rng.randrange(longest))) for i in range(n)}


@pytest.mark.parametrize("order, hot", [(2, 1 << 20), (3, 1 << 20), (3, 5), (4, 12)])
def test_model_equals_plain_recursion(documents, order, hot):
    texts = zipf_texts(order, 300)
    model = katz.fit(documents(texts), order=order, chunk_bytes=2000, hot_count=hot)
    assert any(model.hot[n] for n in model.hot) == (hot < 100)
    words = {i: tokens(t) for i, t in texts.items()}
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i in texts}
    plain = PlainKatz([w for i, w in words.items() if not held[i]], order)
    known = plain.c[1]
    rows = model.score().collect()
    assert len(rows) == len(texts) and sum(held.values()) > 10
    for r in rows:
        w = words[r.doc_id]
        base = sum(math.log10((known[(x,)] + 0.1) / (plain.tokens + 0.1 * (len(known) + 1))) for x in w)
        assert r.held_out == held[r.doc_id] and r.n_tokens == len(w) and r.train_tokens == plain.tokens
        assert r.n_known == sum((x,) in known for x in w)
        assert abs(r.base_score - base) < 1e-8 and abs(r.score - plain.score(w)) < 1e-8
    everything = [w for (w,) in known] + ["never seen"]
    for h in list(plain.following)[:200]:
        assert abs(sum(plain.p(h, w) for w in everything) - 1) < 1e-9


def test_stored_tables_hold_the_model(documents):
    texts = zipf_texts(9, 200)
    model = katz.fit(documents(texts), held=F.lit(False), order=3, chunk_bytes=2000)
    plain = PlainKatz([tokens(t) for t in texts.values()], 3)
    for n in (1, 2, 3):
        stored = {(*(r.history.split(" ") if r.history else []), r.word): r.n for r in model.ngrams(n).collect()}
        assert stored == {g: c for g, c in plain.c[n].items() if c >= plain.least(n)}
    for n in (2, 3):
        weights = {tuple(r.history.split(" ")): r.weight for r in model.backoffs(n).collect()}
        assert set(weights) == {h for h in plain.following if len(h) == n - 1}
        assert all(abs(w - plain.a(h)) < 1e-9 for h, w in weights.items())


def test_discounts_fall_back():
    assert all(0 < d <= 1 for d in katz.good_turing([1000, 300, 120, 60, 40, 25]))
    assert katz.good_turing([10, 0, 0, 0, 0, 0]) == [(r - 0.5) / r for r in range(1, 6)]
    assert katz.good_turing([0] * 6)[0] == 0.5
    # Counts up to 2 can be discounted; with a single count the formula leaves nothing, so an absolute discount follows.
    few = katz.good_turing([100, 30, 6, 0, 0, 0])
    assert few[2:] == [1.0] * 3 and 0 < few[1] < few[0] < 1
    assert katz.good_turing([100, 30, 0, 5, 0, 0]) == [(r - 0.625) / r for r in range(1, 6)]


def test_model_beats_the_base_on_held_out_texts(documents):
    rng = random.Random(2)
    follow = {w: [rng.randrange(300) for _ in range(3)] for w in range(300)}
    texts = {}
    for i in range(400):
        w, run = rng.randrange(300), []
        for _ in range(80):
            run.append(f"w{w}")
            w = rng.choice(follow[w])
        texts[i] = " ".join(run)
    rows = [r for r in katz.fit(documents(texts), chunk_bytes=20_000).score().collect() if r.held_out]
    assert rows and sum(r.score for r in rows) > 0.5 * sum(r.base_score for r in rows)


def test_model_on_odd_and_empty_tables(odd, none, documents):
    rows = katz.fit(odd, chunk_bytes=1000).score().collect()
    assert len(rows) == odd.count() and all(math.isfinite(r.score) and r.score <= 0 for r in rows)
    assert sum(r.doc_id is None for r in rows) == 2 and all(not r.held_out for r in rows if r.doc_id is None)
    assert katz.fit(none).score().collect() == []
    alone = katz.fit(documents({1: "a b", 2: None}), held=F.lit(True)).score().collect()
    assert sorted((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.score) for r in alone) == [(1, 3, 0, 0, 0.0), (2, 1, 0, 0, 0.0)]


def test_equal_rows_spread_over_chunks(documents):
    docs = documents([(1, "the same text again and again")] * 400, parts=8)
    layout = grams.layout_of(docs, 500)
    sizes = grams.chunked(docs, layout, F.lit("x")).groupBy("chunk").count().collect()
    assert len(sizes) > 4
    assert {(r.n_tokens, r.train_tokens) for r in katz.fit(docs, chunk_bytes=500).score().collect()} == {(7, 2800)}


# ----------------------------------------------------------------------------------------------------- phrases

def plain_phrases(rows, least, most_words, most):
    counts, words = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n-\r]", lower(text)):
            w = re.findall(r"[^\x20\x09]+", piece)
            words[lang] += len(w)
            for k in range(1, most_words + 1):
                counts[lang].update(" ".join(w[i:i + k]) for i in range(len(w) - k + 1))
    out = {}
    for lang, f in counts.items():
        frequent = [p for p, n in f.items() if n >= least and " " in p]
        scored = []
        for p in frequent:
            w, a = p.split(" "), f[p]
            if any(f" {p} " in f" {q} " and 100 * f[q] >= 50 * a for q in frequent if q != p):
                continue
            cuts = [(" ".join(w[:k]), " ".join(w[k:])) for k in range(1, len(w))]
            score, k = min((10**6 * a * a // (f[x] * f[y]), k) for k, (x, y) in enumerate(cuts))
            scored.append((-score, -a, p.encode(), f[cuts[k][0]], f[cuts[k][1]]))
        for rank, (score, a, p, left, right) in enumerate(sorted(scored)[:most], 1):
            out[lang, rank] = (p.decode(), -a, left, right, words[lang], -score)
    return out


def mined(docs, **options):
    return {(r.lang, r["rank"]): (r.phrase, r.a, r.l, r.r, r.n, r.score) for r in phrases.mine(docs, **options).collect()}


@pytest.mark.parametrize("sample_bytes", [0, 3000, 1 << 30])
@pytest.mark.parametrize("most_words", [2, 3, 4])
def test_phrases_whatever_the_sample(spark, sample_bytes, most_words):
    rng = random.Random(most_words)
    set_phrases = ["ice Cream cone", "on the other hand", "new york", "éa éb"]
    rows = []
    for i in range(250):
        w = [rng.choice(set_phrases) if rng.random() < 0.2 else f"x{int(rng.paretovariate(1))}{rng.choice(['', '', '.', ';'])}" for _ in range(30)]
        rows.append((i, " ".join(w), rng.choice(["en", "de de", None, "und", "a%20b\nc"])))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    got = mined(docs, most_words=most_words, chunk_bytes=2000, sample_bytes=sample_bytes)
    want = plain_phrases([(lang, text) for _, text, lang in rows], 10, most_words, 2000)
    assert got == want and len({lang for lang, _ in got}) == 4


def test_phrases_of_odd_and_empty_tables(odd, none):
    rows = [(r.lang, r.text) for r in odd.collect()]
    assert mined(odd, chunk_bytes=1000) == plain_phrases(rows, 10, 3, 2000)
    assert mined(none) == {}


def test_scores_are_exact(spark):
    rng = random.Random(4)
    rows = [(rng.randrange(1, 10**15), rng.randrange(1, 10**15), rng.randrange(1, 10**15)) for _ in range(200)]
    rows = [(min(r), r[1], r[2]) for r in rows] + [(10**15, 10**15, 10**15), (3, 7, 11)]
    got = spark.createDataFrame(rows, "a long, l long, r long").select("a", "l", "r", phrases.score_of("a", "l", "r").alias("s")).collect()
    assert all(r.s == 10**6 * r.a * r.a // (r.l * r.r) for r in got)


# -------------------------------------------------------------------------------------------------- prefix trie

def plain_trie(rows):
    convs = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            convs[conv].append((turn is not None, turn or 0, role or "", text or ""))
    convs = {c: [t[2:] for t in sorted(turns, key=lambda t: t[:2])] for c, turns in convs.items()}
    built = {}
    for c, turns in convs.items():
        h = zlib.crc32(str(c).encode()) % 4
        built[c] = convs.get(c - int(math.fmod(c, 20)), [])[:h] + turns[h:]
    members = defaultdict(list)
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    leaves, saved = Counter(), Counter()
    for node, of in members.items():
        words = len(re.findall(r"[^\x20\x09-\x0d]+", node[-1][1])) if node else 0
        for d in range(len(node) + 1):
            leaves[node[:d]] += not children[node]
            saved[node[:d]] += (len(of) - 1) * words
    out = []
    for node, of in members.items():
        ends = ",".join(map(str, sorted(c for c in of if len(built[c]) == len(node))))
        out.append((min(of), len(node), min(members[node[:-1]]) if node else None, len(of), len(children[node]), leaves[node],
                    saved[node], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


COLUMNS = "conv_id depth parent_conv_id n_convs n_children n_leaves saved_tokens ends_sha256".split()


def trie_of(df):
    return sorted((tuple(r) for r in prefixes.rebuilt_trie(df).select(*COLUMNS).collect()), key=str)


@pytest.fixture
def conversations(spark):
    def build(rows):
        df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4)
        return df.withColumns({n: F.lit("x") for n in ("depth", "high", "low", "block", "place", "length", "tail", "chunk", "first")})
    return build


def random_conversations(seed, n, longest):
    rng = random.Random(seed)
    rows = []
    for c in range(-30, n):
        length = rng.choice([1, 2, 3, 4, longest])
        turns = rng.sample([None, *range(-3, 3 * longest)], length)
        rows += [(c, t, rng.choice(["user", None, ""]), rng.choice(["hi there", "a b c", "", None, "one"])) for t in turns]
    return rows


def test_trie_equals_plain_python(conversations):
    rows = random_conversations(1, 150, 9) + [(None, 1, "user", "lost")]
    assert trie_of(conversations(rows)) == plain_trie(rows)


def test_one_hot_conversation_and_many_copies(conversations):
    long = [(7, t, "user", f"turn {t % 5}") for t in range(1500)] + [(27, t, "user", f"turn {t % 5}") for t in range(1400)]
    copies = [(c, t, "user", f"same {t}") for c in range(100, 700) for t in range(3)]
    alone = [(c, 0, "user", f"own {c}") for c in range(1000, 1400)]
    rows = long + copies + alone
    assert trie_of(conversations(rows)) == plain_trie(rows)


def test_a_small_sketch_costs_no_error(conversations, monkeypatch):
    monkeypatch.setattr(prefixes.Sketch, "__init__", lambda self, n: self.__dict__.update(width=64, buckets=1, chunks=3))
    rows = random_conversations(5, 100, 6)
    assert trie_of(conversations(rows)) == plain_trie(rows)


def test_screen_clears_only_single_prefixes(conversations):
    rows = random_conversations(6, 200, 6)
    _, turns = prefixes.rebuilt(prefixes.conversation_turns(conversations(rows)))
    found = prefixes.prefixes_of(turns)
    marked = prefixes.screened(found, found.count())
    times = marked.groupBy("depth", "high", "low").agg(F.count("*").alias("n"), F.max("alone").alias("alone")).collect()
    assert all(r.n == 1 for r in times if r.alone)
    assert sum(r.alone for r in times) > 0.8 * sum(r.n == 1 for r in times)


def test_turnless_and_empty_tables(conversations):
    one_turn = [c for c in range(1, 200) if zlib.crc32(str(c).encode()) % 4 > 0 and c % 20][:5]
    rows = [(c, 0, "user", "gone") for c in one_turn]
    assert trie_of(conversations(rows)) == plain_trie(rows)
    assert len(plain_trie(rows)) == 1 and trie_of(conversations([])) == []


def test_ends_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(prefixes, "PIECE", 60)
    rows = [(1, 5, 5, c) for c in range(1000)] + [(2, 5, 5, c) for c in (3, -4)] + [(1, 5, 6, 9)]
    got = prefixes.ends_of(spark.createDataFrame(rows, "depth long, high long, low long, conv_id long")).collect()
    want = {(1, 5, 5): ",".join(map(str, range(1000))), (2, 5, 5): "-4,3", (1, 5, 6): "9"}
    assert {(r.depth, r.high, r.low): r.ends_sha256 for r in got} == {k: hashlib.sha256(v.encode()).hexdigest() for k, v in want.items()}


# ------------------------------------------------------------------------------------------------------ helpers

def test_packed_messages_round_trip():
    import pyarrow as pa

    words = [b"", b"a", "é".encode(), b"x" * 300]
    assert grams.unpack_strings(grams.pack_strings(pa.array(words, pa.large_binary()))).to_pylist() == words
    assert grams.unpack_strings(grams.pack_strings(pa.array([], pa.large_binary()))).to_pylist() == []
    assert grams.unbundle(grams.bundle(b"", b"ab", b"c")) == [b"", b"ab", b"c"]
    numbers = np.arange(12).reshape(4, 3)
    assert (grams.unpack_ints(grams.pack_ints(numbers), 3) == numbers).all()


def test_a_long_text(documents):
    rng = random.Random(1)
    texts = {1: prose(rng, 60_000), 2: prose(rng, 10)}
    rows = katz.fit(documents(texts), held=F.lit(False), chunk_bytes=1000).score().collect()
    assert sorted(r.n_tokens for r in rows) == [11, 60_001]


def test_chunks_are_stored_as_numbers_of_words():
    """A stored chunk gives back what its texts gave; n-grams with a part below the least count are not formed."""
    import pyarrow as pa

    texts = [b"B a b a b c", b"", b"a b  a x"]
    data = np.frombuffer(b"".join(texts), np.uint8)
    chunk = grams.Chunk(7, pa.array([-3, None, 5]), [katz.LEARNED, katz.HELD, katz.LEARNED], grams.Texts(data, np.cumsum([0, *map(len, texts)])))
    made = katz.Coded.from_texts(chunk)
    back = katz.Coded.of(made.packed())
    assert back.number == 7 and back.ids.to_pylist() == [-3, None, 5] and back.held.tolist() == [False, True, False]
    words = back.words.strings.to_pylist()
    assert [words[c] for c in back.words.code] == [b"b", b"a", b"b", b"a", b"b", b"c", b"", b"", b"a", b"b", b"a", b"x", b""]
    assert (back.words.piece == made.words.piece).all() and (back.words.hashes == made.words.hashes).all()
    passes = katz.Passes(3, grams.Layout(1, 1, 20), 1 << 20)
    single = back.words.root.longer()
    double = passes._longer(single, single.counts(back.learned))
    triple = passes._longer(double, double.counts(back.learned))
    found = dict(zip(triple.phrases(np.arange(len(triple))).to_pylist(), triple.counts().tolist()))
    assert found == {b" b a b": 2, b" a b a": 2}  # led by the empty first history


def test_questions_by_numbers():
    """Longer n-grams are asked by numbers of a few bytes, and what a chunk was told is read without a shuffle."""
    asked = grams.Numbered(np.array([3, 7, (2 << grams.KEY_BITS) + 1]), np.array([2, 0, 3]), np.array([1, 90, 4, 5, 600]),
                           np.array([[1, 2, 1, 1, 9]]).T, np.array([[0, 1, 0], [2, 0, 1]]).T, np.array([50, 50, 7, 9, 1]))
    back = grams.Numbered.of(asked.packed(), 1)
    for name in ("hists", "sizes", "words", "numbers", "of_hists", "of_words"):
        assert (getattr(back, name) == getattr(asked, name)).all()
    rng = random.Random(4)
    n = 20_000
    words = np.sort(np.array([int(rng.paretovariate(0.6)) for _ in range(n)]) % 500_000)
    many = grams.Numbered(np.arange(n) * 180, np.ones(n, np.int64), words, np.ones((n, 1)), np.zeros((n, 0)))
    # As text, a trigram takes some 15 bytes.
    assert len(many.packed()) < 5 * n


def test_what_chunks_were_told_is_not_shuffled_again(documents):
    model = katz.fit(documents(zipf_texts(3, 200)), chunk_bytes=2000)
    assert model.passes.layout.chunks > 4
    plan = model.score()._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and plan.count("Bucketed: true") == 2
