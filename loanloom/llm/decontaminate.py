"""Benchmark decontamination: CGK random-walk embedding, bit-sampling LSH, exact edit verification.

Texts and items are words in lower case without punctuation. The CGK embedding walks over a word sequence: at
step t it emits the word it stands on and moves on by one random bit of (t, word). Two walks with the same bits
that meet after an edit stay together, so a small edit distance becomes a small Hamming distance between the
embeddings. A hash table samples a few coordinates of the embedding; several tables with walks of their own raise
the recall. Walks start at every word of every document and at every word of an item, so an item is found through
any stretch of its window that the edits leave alone. A window that agrees with an item on a table's coordinates
is then verified: the exact word edit distance between the whole item and the best place around the window, by
Myers' bit-parallel algorithm, must be at most 20 % of the item's words.

Each document is read once, with no shuffle. The benchmark is the query set: it goes to the tasks in blocks of at
most BLOCK_BYTES of text, one pass over the documents per block, all items of a block at once.

Defined results: a null text has no words; an item of fewer than LEAST_WORDS words is not looked for; items that
repeat an item_id are items of their own; a null doc_id or item_id is passed on. Matches end inside a document.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loanloom.llm.bytestext import mix, plain_letters, texts_of, word_hashes, words_of

SIMILARITY = 0.8
LEAST_WORDS = 5
#: Sampled steps of each table; every table has a walk of its own.
TABLES = ((0, 2, 4, 7), (0, 1, 3, 6), (0, 3, 5, 6), (1, 2, 4, 5), (0, 2, 5, 8), (0, 1, 4, 6))
BLOCK_BYTES = 16 << 20
#: Different places a walk must sample; one on the same word throughout would match every place of that word.
LEAST_PLACES = 3
#: Bits of the table that tells quickly whether a key can be known.
FILTER_BITS = 18
MATCH = "doc_id bigint, item_id bigint, distance bigint, item_words bigint, similarity double, end_word bigint"


def _word_keys(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, and where each text's words begin (one more at the end)."""
    texts = plain_letters(texts_of(column))
    first, last, doc = words_of(texts)
    return word_hashes(texts.data, first, last), np.searchsorted(doc, np.arange(len(texts) + 1))


@dataclass
class Table:
    """One walk and its sampled steps; `known` has the keys after each step, `places` (item, start) by full key."""

    number: int
    steps: tuple[int, ...]
    known: list[np.ndarray] = field(default_factory=list)
    places: dict[int, list[tuple[int, int]]] = field(default_factory=dict)

    def _moves(self, words: np.ndarray) -> np.ndarray:
        """A random bit for each step and word, as the bits of one number per word."""
        return mix(words + np.uint64(0x9E3779B97F4A7C15 * (2 * self.number + 1) % 2**64))

    def build(self, words: np.ndarray, starts: np.ndarray, ends: np.ndarray, item: np.ndarray, begin: np.ndarray) -> None:
        """Enters the walks from `starts` that stay before `ends` and sample three different places at least."""
        moves = self._moves(words)
        at, key, places, done = starts, np.zeros(len(starts), np.uint64), np.zeros(len(starts), np.int64), 0
        keys = []
        for step in self.steps:
            before = at
            for t in range(done, step):
                at = np.minimum(np.minimum(at + _bit(moves, at, t), ends), len(words) - 1)
            places = places + ((at != before) | (step == self.steps[0]))
            key, done = mix(key * np.uint64(3) + words[at]), step
            keys.append(key)
        good = (at < ends) & (places >= LEAST_PLACES)
        self.known = [np.unique(k[good]) for k in keys]
        for k, start in zip(key[good].tolist(), starts[good].tolist()):
            self.places.setdefault(k, []).append((int(item[start]), start - int(begin[item[start]])))

    def search(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and keys of the walks that agree with some item in every sampled step."""
        moves, low = self._moves(words), np.uint64(2**FILTER_BITS - 1)
        start, done = np.arange(len(words)), 0
        at, key = start, np.zeros(len(words), np.uint64)
        for step, known in zip(self.steps, self.known):
            for t in range(done, step):
                at = np.minimum(at + _bit(moves, at, t), len(words) - 1)
            key, done = mix(key * np.uint64(3) + words[at]), step
            quick = np.zeros(2**FILTER_BITS, bool)
            quick[(known & low).astype(np.int64)] = True
            on = np.flatnonzero(quick[(key & low).astype(np.int64)])
            at, start, key = at[on], start[on], key[on]
        return start, key


def _bit(moves: np.ndarray, at: np.ndarray, step: int) -> np.ndarray:
    return ((moves[at] >> np.uint64(step)) & np.uint64(1)).astype(np.int64)


class Index:
    """Tables over the items of one block of the benchmark."""

    def __init__(self, ids: list, texts: list):
        words, cuts = _word_keys(pa.array(texts, pa.string()))
        sizes = np.diff(cuts)
        self.ids = ids
        self.items = [words[cuts[i]:cuts[i + 1]] for i in range(len(ids))]
        item = np.repeat(np.arange(len(ids)), sizes)
        starts = np.flatnonzero(sizes[item] >= LEAST_WORDS)
        self.tables = [Table(n, steps) for n, steps in enumerate(TABLES)]
        for table in self.tables:
            table.build(words, starts, cuts[item[starts] + 1], item, cuts)

    def matches(self, column: pa.Array) -> list[tuple[int, int, int, int]]:
        """(row, item, distance, end word) of the best place of each item found in each text."""
        words, cuts = _word_keys(column)
        windows: dict[tuple[int, int], set[int]] = {}
        for table in self.tables if len(words) else []:
            starts, keys = table.search(words)
            rows = np.searchsorted(cuts, starts, side="right") - 1
            for start, row, key in zip(starts.tolist(), rows.tolist(), keys.tolist()):
                for item, offset in table.places.get(key, ()):
                    windows.setdefault((row, item), set()).add(start - offset - int(cuts[row]))
        out = []
        for (row, item), begins in windows.items():
            found = _best_place(words[cuts[row]:cuts[row + 1]], self.items[item], sorted(begins))
            if found is not None:
                out.append((row, item, *found))
        return out


def most_edits(n_words: int) -> int:
    return math.floor((1 - SIMILARITY) * n_words + 1e-9)


def _best_place(words: np.ndarray, item: np.ndarray, begins: list[int]) -> tuple[int, int] | None:
    """Least edit distance of the item near one of the window starts, and the word after it; None if too far."""
    slack, best = most_edits(len(item)), None
    regions: list[list[int]] = []
    for begin in begins:
        low, high = max(0, begin - slack), min(len(words), begin + len(item) + slack)
        if regions and low <= regions[-1][1]:
            regions[-1][1] = max(high, regions[-1][1])
        else:
            regions.append([low, high])
    for low, high in regions:
        distance, end = edit_distance_within(item.tolist(), words[low:high].tolist())
        if distance <= slack and (best is None or distance < best[0]):
            best = (distance, low + end)
    return best


def edit_distance_within(pattern: list, text: list) -> tuple[int, int]:
    """Least edit distance between the pattern and any stretch of the text, and where that stretch ends first."""
    masks: dict = {}
    for i, symbol in enumerate(pattern):
        masks[symbol] = masks.get(symbol, 0) | 1 << i
    full, top = (1 << len(pattern)) - 1, 1 << (len(pattern) - 1)
    plus, minus, score, best, end = full, 0, len(pattern), len(pattern), 0
    for j, symbol in enumerate(text):
        equal = masks.get(symbol, 0)
        vertical = equal | minus
        horizontal = (((equal & plus) + plus) ^ plus) | equal
        up, down = (minus | ~(horizontal | plus)) & full, plus & horizontal
        score += (up & top != 0) - (down & top != 0)
        up, down = (up << 1) & full, (down << 1) & full
        plus, minus = (down | ~(vertical | up)) & full, up & vertical
        if score < best:
            best, end = score, j + 1
    return best, end


def _index_blocks(benchmark: DataFrame) -> Iterator[Index]:
    """The benchmark in blocks whose text is bounded, whatever its size."""
    items = benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), F.col("text").cast("string").alias("text"))
    size = items.agg(F.coalesce(F.sum(F.octet_length("text") + 16), F.lit(0))).first()[0]
    blocks = max(1, math.ceil(2 * size / BLOCK_BYTES))
    for block in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).collect()
        yield Index([r["item_id"] for r in rows], [r["text"] for r in rows])


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of some 4 MB of text; a longer text is one by itself."""
    for batch in batches:
        size = np.cumsum(texts_of(batch.column("text")).lengths)
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + (4 << 20), side="right")))
            yield batch.slice(at, to - at)
            at = to


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, distance, item_words, similarity and end_word of each item found in a document."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = None
    for index in _index_blocks(benchmark):
        def search(batches: Iterator[pa.RecordBatch], index: Index = index) -> Iterator[pa.RecordBatch]:
            for batch in _pieces(batches):
                ids = batch.column("doc_id").to_pylist()
                hits = [
                    (ids[row], index.ids[item], distance, len(index.items[item]), 1 - distance / len(index.items[item]), end)
                    for row, item, distance, end in index.matches(batch.column("text"))]
                kinds = [pa.int64()] * 4 + [pa.float64(), pa.int64()]
                columns = zip(*hits) if hits else [[]] * 6
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(columns, kinds)],
                    names="doc_id item_id distance item_words similarity end_word".split())

        part = rows.mapInArrow(search, MATCH)
        found = part if found is None else found.unionByName(part)
    return found


def drop_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of `docs` in which no item was found, with all their columns."""
    for index in _index_blocks(benchmark):
        def clean(batches: Iterator[pa.RecordBatch], index: Index = index) -> Iterator[pa.RecordBatch]:
            for batch in _pieces(batches):
                keep = np.ones(batch.num_rows, bool)
                keep[[row for row, *_ in index.matches(batch.column("text"))]] = False
                yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(clean, docs.schema)
    return docs
