"""Dedup of repeated word windows by hashes, in place of an ordered suffix array.

Every word starts a suffix, of which the first `depth` words count. A pass deals the suffixes by a hash of all their
words up to the end of its digit, a block of words, and lets only suffixes with an equal one go on to the next digit.
Suffixes that are equal through one digit are not kept together in the next, so no order of suffixes exists: the first
digit only filters. After the last digit equal groups are exactly the windows of `depth` words that occur more than
once; their words are removed, wherever they stand.

The passes run over chunks of documents (lookups.py): a chunk sends each distinct digit string once and is told
which of them occur in other chunks, so a passage in a third of all documents is one entry per chunk.
Digit strings of the inner passes are cut to the bits their number needs, since a chance meeting there only
lets a suffix go on; the last pass compares 64 bits.

Defined results: a null text has no words; a document shorter than `depth` words keeps all of them; a window
may repeat inside its own document, overlapping itself; rows with equal or null doc_id are documents of their
own. Only doc_id and text are read, so other columns may have any names.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from loanloom.llm import lookups
from loanloom.llm.bytestext import covered, distinct, id_column, pack_bits, runs, unpack_bits, word_hashes, words_of
from loanloom.llm.lookups import ask, chunk_of, replies_of

DEPTH = 35
#: Words up to the end of each digit.
DIGITS = (14, 35)
#: No more words than this share of the bytes; sizes the buckets.
WORDS_PER_BYTE = 0.17
RESULT = "doc_id bigint, n_words bigint, n_removed bigint, kept string"


def remove_repeats(docs: DataFrame, digits: tuple[int, ...] = DIGITS, chunk_bytes: int = lookups.CHUNK_BYTES) -> DataFrame:
    """doc_id, n_words, n_removed and the kept words (joined by one space) of every document."""
    layout = lookups.layout_of(docs, chunk_bytes)
    sort = RadixSort(digits, layout)
    chunks = lookups.chunked(docs, layout).groupBy("chunk")
    asked = chunks.applyInArrow(lambda t: sort.first_digit(t), lookups.MESSAGE)
    for digit in range(1, len(digits)):
        told = asked.groupBy("bucket").applyInArrow(lookups.answer_elsewhere, lookups.MESSAGE)
        asked = chunks.cogroup(told.groupBy("chunk")).applyInArrow(_pass(sort, digit), lookups.MESSAGE)
    told = asked.groupBy("bucket").applyInArrow(lookups.answer_elsewhere, lookups.MESSAGE)
    return chunks.cogroup(told.groupBy("chunk")).applyInArrow(lambda l, r: sort.remove(l, r), RESULT)


def _pass(sort: RadixSort, digit: int):
    return lambda left, right: sort.next_digit(digit, left, right)


class RadixSort:
    """The passes over a chunk. `alive` marks the words whose suffix is still in a group of several."""

    def __init__(self, digits: tuple[int, ...], layout: lookups.Layout):
        self.digits = digits
        self.bits = [layout.filter_bits(WORDS_PER_BYTE)] * (len(digits) - 1) + [64]
        self.buckets = [layout.buckets(WORDS_PER_BYTE)] + [layout.buckets(WORDS_PER_BYTE / 3)] * (len(digits) - 1)

    def _words(self, chunk):
        first, last, doc = words_of(chunk.texts)
        counts = np.bincount(doc, minlength=len(chunk.texts))
        left = np.cumsum(counts)[doc] - np.arange(len(doc))
        return word_hashes(chunk.texts.data, first, last), first, last, counts, left >= self.digits[-1]

    def _keys(self, hashes: np.ndarray, alive: np.ndarray, digit: int) -> np.ndarray:
        """The words up to this digit of each suffix alive, as one key."""
        at = np.flatnonzero(alive)
        return runs(hashes, self.digits[digit])[at] >> np.uint64(64 - self.bits[digit]) if len(at) else np.zeros(0, np.uint64)

    def first_digit(self, table: pa.Table) -> pa.Table:
        chunk = chunk_of(table)
        hashes, _, _, _, alive = self._words(chunk)
        keys = distinct(self._keys(hashes, alive, 0))
        return ask(chunk.number, keys, self.bits[0], self.buckets[0], carry=_carry(0, alive))

    def _resolve(self, right: pa.Table, hashes: np.ndarray) -> np.ndarray:
        """Suffixes that have an equal one, in this chunk or another, through the digit just sorted."""
        elsewhere, carried = replies_of(right)
        digit, alive = _carried(carried)
        keys = self._keys(hashes, alive, digit)
        _, which, times = np.unique(keys, return_inverse=True, return_counts=True)
        on = np.zeros(len(alive), bool)
        if len(keys):
            on[np.flatnonzero(alive)] = (elsewhere | (times > 1))[which]
        return on

    def next_digit(self, digit: int, left: pa.Table, right: pa.Table) -> pa.Table:
        chunk = chunk_of(left)
        hashes, *_ = self._words(chunk)
        alive = self._resolve(right, hashes)
        keys = distinct(self._keys(hashes, alive, digit))
        return ask(chunk.number, keys, self.bits[digit], self.buckets[digit], carry=_carry(digit, alive))

    def remove(self, left: pa.Table, right: pa.Table) -> pa.Table:
        chunk = chunk_of(left)
        hashes, first, last, counts, _ = self._words(chunk)
        repeated = np.flatnonzero(self._resolve(right, hashes))
        gone = covered(repeated, repeated + self.digits[-1], len(hashes))
        ends = np.concatenate([[0], np.cumsum(counts)])
        lost = np.concatenate([[0], np.cumsum(gone)])[ends]
        kept = []
        for i in range(len(counts)):
            words = chunk.texts.text(i).split()
            if lost[i + 1] > lost[i]:
                words = [w for w, g in zip(words, gone[ends[i]:ends[i + 1]]) if not g]
            kept.append(b" ".join(words).decode("utf-8", "replace"))
        return pa.table({
            "doc_id": id_column(chunk.ids), "n_words": pa.array(counts.astype(np.int64)),
            "n_removed": pa.array(np.diff(lost).astype(np.int64)), "kept": pa.array(kept, pa.string())})


def _carry(digit: int, alive: np.ndarray) -> bytes:
    return struct.pack("<I", digit) + pack_bits(alive)


def _carried(blob: bytes) -> tuple[int, np.ndarray]:
    return struct.unpack_from("<I", blob)[0], unpack_bits(blob[4:])
