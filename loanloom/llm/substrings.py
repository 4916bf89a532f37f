"""Substring dedup: anchors at difference-cover positions find shared strings, which are then extended.

A difference cover D modulo v has, for any two positions, a shift k < v that brings both into D. So two equal
strings of `length` bytes share an aligned anchor: the window of `length` - v + 1 bytes that starts k bytes in.
Hashing windows at positions in D alone therefore finds every match. Around shared anchors each place where a
string of the full length may start is then tested by 64-bit hashes, and owners with a smaller doc_id win.

Five reads of the chunks (lookups.py), the exchange of texts being shared by them:
1. anchors of texts that copy no earlier document -> which anchors occur in several chunks;
2. around shared anchors, long windows (`length` + v - 1 bytes) at cover positions, with the smallest id of the
   chunk -> which have a smaller id elsewhere; every string inside such a window is settled;
3. the single strings not settled, at the ends of matches and in the first owners, by short hashes -> which other
   chunks have them at all. Most do not: the inner strings of a first owner were settled by all who copy them. A
   settled string need not be sent even as an owner, since the document with its smallest id never settles it;
4. full hashes and smallest ids of those that other chunks seem to have -> which have a smaller id elsewhere;
5. the bytes to remove.
Whole copies are settled before by a salted grouping of digests. Two different strings meet under one 64-bit
hash with a chance of one in 2^64 per pair; nothing else is approximate.

Defined results: a null text is empty; texts shorter than `length` lose nothing; a null doc_id is larger than
every other and no smaller than another null; rows with one doc_id are no smaller than each other. Only
doc_id and text are read, so other columns may have any names.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loanloom.llm import lookups
from loanloom.llm.bytestext import byte_runs, covered, distinct, grouped, id_column, pack_bits, unpack_bits
from loanloom.llm.lookups import Chunk, Layout, ask, chunk_of, replies_of
from loanloom.llm.salted import combine, per_salt, salt_of

#: Minimal difference covers by their modulus: every residue is a difference of two members.
COVERS = {3: (0, 1), 7: (0, 1, 3), 13: (0, 1, 3, 9), 21: (0, 1, 4, 14, 16), 31: (0, 1, 3, 8, 12, 18)}
LENGTH = 50
RESULT = "doc_id bigint, n_bytes bigint, spans array<struct<start:bigint,end:bigint>>, kept binary"


def period_for(length: int) -> int:
    """The largest modulus that leaves anchors of at least two fifths of the length."""
    return max([v for v in COVERS if length - v + 1 >= 0.4 * length], default=3)


def copies(docs: DataFrame, layout: Layout) -> DataFrame:
    """chunk and key of every row whose whole text also stands under a smaller doc_id."""
    rows = lookups.chunked(docs, layout).select(
        "chunk", "key", "doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("_digest"))
    rows = rows.withColumn("_salt", salt_of(F.col("key")))
    groups = combine(rows, ["_digest"], F.bitwise_not("doc_id")).where("_n > 1")
    first = per_salt(groups).select("_digest", "_salt", F.bitwise_not("_rank").alias("first"))
    return rows.join(first, ["_digest", "_salt"]).where("doc_id > first OR (doc_id IS NULL AND first IS NOT NULL)").select(
        "chunk", "key")


def remove_repeats(docs: DataFrame, length: int = LENGTH, chunk_bytes: int = lookups.CHUNK_BYTES) -> DataFrame:
    """doc_id, n_bytes, removed spans (byte offsets) and kept bytes of every document."""
    layout = lookups.layout_of(docs, chunk_bytes)
    search = Search(length, layout)
    chunks = lookups.chunked(docs, layout).groupBy("chunk")

    first = chunks.cogroup(copies(docs, layout).groupBy("chunk")).applyInArrow(
        lambda l, r: search.ask_anchors(l, r), lookups.MESSAGE)
    shared = first.groupBy("bucket").applyInArrow(lookups.answer_elsewhere, lookups.MESSAGE)
    second = chunks.cogroup(shared.groupBy("chunk")).applyInArrow(lambda l, r: search.ask_long(l, r), lookups.MESSAGE)
    owned = second.groupBy("bucket").applyInArrow(lookups.answer_smaller, lookups.MESSAGE)
    third = chunks.cogroup(owned.groupBy("chunk")).applyInArrow(lambda l, r: search.ask_rest(l, r), lookups.MESSAGE)
    shared = third.groupBy("bucket").applyInArrow(lookups.answer_elsewhere, lookups.MESSAGE)
    fourth = chunks.cogroup(shared.groupBy("chunk")).applyInArrow(lambda l, r: search.ask_strings(l, r), lookups.MESSAGE)
    owned = fourth.groupBy("bucket").applyInArrow(lookups.answer_smaller, lookups.MESSAGE)
    return chunks.cogroup(owned.groupBy("chunk")).applyInArrow(lambda l, r: search.remove(l, r), RESULT)


class Search:
    """The five passes over a chunk."""

    def __init__(self, length: int, layout: Layout):
        self.length, self.period = length, period_for(length)
        self.width, self.long = length - self.period + 1, length + self.period - 1
        self.cover = np.isin(np.arange(self.period), COVERS[self.period])
        density = len(COVERS[self.period]) / self.period
        # A chance meeting opens as many strings as the period is long, so it must be rare.
        self.bits = layout.filter_bits(density, spare=13)
        self.rest_bits = layout.filter_bits(density)
        self.anchor_buckets, self.string_buckets = layout.buckets(density), layout.buckets(0.1)

    def _anchors(self, chunk: Chunk, skip: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Position, key and document of every anchor, position by position."""
        texts, cover = chunk.texts, np.flatnonzero(self.cover)
        places = np.where(~skip & (texts.lengths >= self.length), texts.lengths - self.width + 1, 0)
        rounds, rest = np.divmod(places, self.period)
        counts = rounds * len(cover) + np.searchsorted(cover, rest)
        doc = np.repeat(np.arange(len(texts), dtype=np.int32), counts)
        turn, member = np.divmod(np.arange(len(doc)) - np.repeat(np.cumsum(counts) - counts, counts), len(cover))
        at = np.repeat(texts.starts[:-1], counts) + turn * self.period + cover[member]
        return at, byte_runs(texts.data, self.width, at) >> np.uint64(64 - self.bits), doc

    def ask_anchors(self, left: pa.Table, right: pa.Table) -> pa.Table:
        chunk = chunk_of(left)
        copied = np.isin(chunk.keys, right["key"].to_numpy()) if right.num_rows else np.zeros(len(chunk.ids), bool)
        _, keys, _ = self._anchors(chunk, copied)
        return ask(chunk.number, distinct(keys), self.bits, self.anchor_buckets, carry=pack_bits(copied))

    def ask_long(self, left: pa.Table, right: pa.Table) -> pa.Table:
        chunk = chunk_of(left)
        elsewhere, carried = replies_of(right)
        copied = unpack_bits(carried)
        at, keys, doc = self._anchors(chunk, copied)
        # The first place of a key is in its first document.
        _, first, which = grouped(keys)
        several = np.zeros(len(first), bool)
        several[which[doc != doc[first][which]]] = True
        hit = (elsewhere | several)[which]
        texts = chunk.texts
        low = np.maximum(at[hit] - self.period + 1, texts.starts[doc[hit]])
        high = np.minimum(at[hit] + 1, texts.starts[doc[hit] + 1] - self.length + 1)
        fits = low < high
        maybe = covered(low[fits], high[fits], len(texts.data))
        strings, owners, _, _ = self._strings(chunk, self._long_starts(chunk, maybe), self.long)
        return ask(chunk.number, strings, 64, self.string_buckets, owners, _join(pack_bits(copied), pack_bits(maybe)))

    def _long_starts(self, chunk: Chunk, maybe: np.ndarray) -> np.ndarray:
        """Cover positions where all the strings of a long window may be shared."""
        at = np.flatnonzero(maybe)
        at = at[at + self.long <= len(chunk.texts.data)]
        doc = np.searchsorted(chunk.texts.starts, at, side="right") - 1
        at = at[self.cover[(at - chunk.texts.starts[doc]) % self.period]]
        ends = np.flatnonzero(maybe & ~np.append(maybe[1:], False)) + 1
        return at[ends[np.searchsorted(ends, at, side="right")] - at >= self.period]

    def _strings(self, chunk: Chunk, at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct strings and their smallest ids; for each place its string and its document's id."""
        keys = byte_runs(chunk.texts.data, length, at)
        ids = chunk.ids[np.searchsorted(chunk.texts.starts, at, side="right") - 1]
        # Documents stand in order of id, so the first place of a string has its smallest id.
        strings, first, which = grouped(keys)
        return strings, ids[first], which, ids

    def ask_rest(self, left: pa.Table, right: pa.Table) -> pa.Table:
        chunk = chunk_of(left)
        smaller, carried = replies_of(right)
        copied, maybe = map(unpack_bits, _split(carried))
        at = self._long_starts(chunk, maybe)
        _, owners, which, ids = self._strings(chunk, at, self.long)
        long = at[smaller[which] | (ids > owners[which])]
        settled = covered(long, long + self.period, len(maybe))
        rest = maybe & ~settled
        short = byte_runs(chunk.texts.data, self.length, np.flatnonzero(rest)) >> np.uint64(64 - self.rest_bits)
        carry = _join(pack_bits(copied), pack_bits(settled), pack_bits(rest))
        return ask(chunk.number, distinct(short), self.rest_bits, self.anchor_buckets, carry=carry)

    def ask_strings(self, left: pa.Table, right: pa.Table) -> pa.Table:
        chunk = chunk_of(left)
        elsewhere, carried = replies_of(right)
        copied, settled, rest = map(unpack_bits, _split(carried))
        at = np.flatnonzero(rest)
        strings, owners, which, ids = self._strings(chunk, at, self.length)
        # Ascending like the strings, so a short hash is new where it differs from the one before.
        short = strings >> np.uint64(64 - self.rest_bits)
        short = np.cumsum(np.diff(short, prepend=short[:1]) != 0)
        asked, here = elsewhere[short], ids > owners[which]
        settled[at[here]] = True
        rest[at[here | ~asked[which]]] = False
        carry = _join(pack_bits(copied), pack_bits(settled), pack_bits(rest))
        return ask(chunk.number, strings[asked], 64, self.string_buckets, owners[asked], carry)

    def remove(self, left: pa.Table, right: pa.Table) -> pa.Table:
        chunk = chunk_of(left)
        texts = chunk.texts
        smaller, carried = replies_of(right)
        copied, settled, rest = map(unpack_bits, _split(carried))
        at = np.flatnonzero(rest)
        _, owners, which, ids = self._strings(chunk, at, self.length)
        settled[at[smaller[which] | (ids > owners[which])]] = True
        gone = np.flatnonzero(settled)
        removed = covered(gone, gone + self.length, len(texts.data))
        removed |= np.repeat(copied & (texts.lengths >= self.length), texts.lengths)
        return _cut(chunk, removed)


def _join(*blobs: bytes) -> bytes:
    return b"".join(struct.pack("<I", len(b)) + b for b in blobs)


def _split(blob: bytes) -> list[bytes]:
    out, at = [], 0
    while at < len(blob):
        size, = struct.unpack_from("<I", blob, at)
        out.append(blob[at + 4:at + 4 + size])
        at += 4 + size
    return out


def _cut(chunk: Chunk, removed: np.ndarray) -> pa.Table:
    texts = chunk.texts
    edge = np.zeros(len(removed) + 1, bool)
    edge[texts.starts] = True
    before, after = np.roll(removed, 1), np.roll(removed, -1)
    first = np.flatnonzero(removed & (~before | edge[:-1]))
    last = np.flatnonzero(removed & (~after | edge[1:])) + 1
    doc = np.searchsorted(texts.starts, first, side="right") - 1
    spans = pa.StructArray.from_arrays(
        [pa.array(first - texts.starts[doc]), pa.array(last - texts.starts[doc])], names=["start", "end"])
    span_cuts = np.searchsorted(doc, np.arange(len(texts) + 1))
    kept = texts.data[~removed]
    kept_cuts = np.concatenate([[0], np.cumsum(~removed)])[texts.starts]
    binary = pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(texts), [None, pa.py_buffer(kept_cuts.astype(np.int64)), pa.py_buffer(kept)])
    return pa.table({
        "doc_id": id_column(chunk.ids), "n_bytes": pa.array(texts.lengths),
        "spans": pa.ListArray.from_arrays(pa.array(span_cuts.astype(np.int32)), spans),
        "kept": binary.cast(pa.binary())})


def brute_force(rows: list[tuple[int, str | None]], length: int = LENGTH) -> dict[int, bytes]:
    """Kept bytes per id by plain search, for tests on small input with distinct ids."""
    texts = {i: (t or "").encode() for i, t in rows}
    seen: set[bytes] = set()
    out: dict[int, bytes] = {}
    for i in sorted(texts):
        text, gone = texts[i], set()
        own = [text[p:p + length] for p in range(len(text) - length + 1)]
        for p, string in enumerate(own):
            if string in seen:
                gone.update(range(p, p + length))
        seen.update(own)
        out[i] = bytes(b for p, b in enumerate(text) if p not in gone)
    return out


