"""Which keys of one chunk of documents occur in another chunk, asked and answered in packed messages.

Documents are dealt to chunks of a few megabytes by a hash of id and text. A chunk sends its distinct keys,
sorted and packed, one message per bucket of the key space; a bucket answers with one bit per key. However
often a passage occurs in a chunk, it is sent once, so a hot key costs one entry per chunk. Every step is a
pure function of its group, and both shuffles can be read again, so lost tasks are simply repeated.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loanloom.llm.bytestext import Texts, ids_of, pack, pack_bits, pack_planes, texts_of, unpack, unpack_bits, unpack_planes

CHUNK_BYTES = 4 << 20
#: Keys a bucket gets on average, about 16 MB unpacked.
BUCKET_KEYS = 2_000_000
MESSAGE = "bucket int, chunk int, kind string, keys binary, owners binary"
KEYS, CARRY, ANSWER = "keys", "carry", "answer"


@dataclass(frozen=True)
class Layout:
    """How much is dealt out: chunks of documents, and the size of the input in bytes."""

    chunks: int
    bytes: int

    def buckets(self, keys_per_byte: float) -> int:
        return max(1, math.ceil(self.bytes * keys_per_byte / BUCKET_KEYS))

    def filter_bits(self, keys_per_byte: float, spare: int = 7) -> int:
        """Bits of a key so that a chance meeting befalls one key in 2^spare at this input size."""
        return min(64, max(32, math.ceil(math.log2(self.bytes * keys_per_byte + 1)) + spare))


def layout_of(docs: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> Layout:
    """Counts the bytes of all texts (one small job)."""
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).cast("bigint")).first()[0]
    return Layout(max(1, math.ceil(size / chunk_bytes)), size)


def chunked(docs: DataFrame, layout: Layout) -> DataFrame:
    """doc_id, text, key and chunk of every row; `key` tells rows apart as far as id and text do."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.withColumn("key", F.xxhash64("doc_id", "text"))
    return rows.withColumn("chunk", F.pmod("key", F.lit(layout.chunks)).cast("int"))


@dataclass
class Chunk:
    number: int
    ids: np.ndarray
    keys: np.ndarray
    texts: Texts


def chunk_of(table: pa.Table) -> Chunk:
    """The documents of one chunk by id (nulls last) and key, whatever order they arrived in."""
    ids, keys = ids_of(table["doc_id"]), table["key"].to_numpy()
    order = np.lexsort((keys, ids))
    text = table["text"].combine_chunks().cast(pa.large_string())
    return Chunk(table["chunk"][0].as_py(), ids[order], keys[order], texts_of(pc.take(text, pa.array(order))))


def _bucket_of(keys: np.ndarray, bits: int, buckets: int) -> np.ndarray:
    top = keys >> np.uint64(max(bits - 32, 0))
    return (top * np.uint64(buckets)) >> np.uint64(min(bits, 32))


def ask(chunk: int, keys: np.ndarray, bits: int, buckets: int, owners: np.ndarray | None = None, carry: bytes | None = None) -> pa.Table:
    """Messages of one chunk: its ascending distinct keys of `bits` bits and, if given, the id owning each."""
    cuts = np.searchsorted(_bucket_of(keys, bits, buckets), np.arange(buckets + 1))
    rows = [
        (b, chunk, KEYS, pack(keys[lo:hi]), None if owners is None else _pack_owners(owners[lo:hi]))
        for b, (lo, hi) in enumerate(zip(cuts[:-1], cuts[1:])) if lo < hi]
    if carry is not None:
        rows.append((chunk % buckets, chunk, CARRY, carry, None))
    return _messages(rows)


def _messages(rows: list[tuple]) -> pa.Table:
    columns = list(zip(*rows)) if rows else [[]] * 5
    kinds = [pa.int32(), pa.int32(), pa.string(), pa.binary(), pa.binary()]
    return pa.table([pa.array(c, k) for c, k in zip(columns, kinds)], names="bucket chunk kind keys owners".split())


def _pack_owners(ids: np.ndarray) -> bytes:
    known, which = np.unique(ids, return_inverse=True)
    head = pack(known.astype(np.int64).view(np.uint64) ^ np.uint64(2**63))
    return len(head).to_bytes(4, "little") + head + pack_planes(which.astype(np.uint64))


def _unpack_owners(blob: bytes) -> np.ndarray:
    size = int.from_bytes(blob[:4], "little")
    known = (unpack(blob[4:4 + size]) ^ np.uint64(2**63)).view(np.int64)
    return known[unpack_planes(blob[4 + size:]).astype(np.int64)]


def _bucket(table: pa.Table) -> tuple[list[tuple], list[tuple]]:
    rows = list(zip(*(table[c].to_pylist() for c in ("bucket", "chunk", "kind", "keys", "owners"))))
    return [r for r in rows if r[2] == KEYS], [r for r in rows if r[2] == CARRY]


def _answers(asked: list[tuple], bits: np.ndarray, sizes: list[int]) -> list[tuple]:
    cuts = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    return [(b, c, ANSWER, pack_bits(bits[lo:hi]), None) for (b, c, *_), lo, hi in zip(asked, cuts[:-1], cuts[1:])]


def answer_elsewhere(table: pa.Table) -> pa.Table:
    """Per chunk one bit for each key it asked about: does another chunk have it?"""
    asked, carried = _bucket(table)
    if not asked:
        return _messages(carried)
    lists = [unpack(r[3]) for r in asked]
    sizes = [len(k) for k in lists]
    keys = np.concatenate(lists)
    del lists
    order = np.argsort(keys)
    same = keys[order][1:] == keys[order][:-1]
    shared = np.zeros(len(keys), bool)
    shared[order[1:]] |= same
    shared[order[:-1]] |= same
    return _messages(carried + _answers(asked, shared, sizes))


def answer_smaller(table: pa.Table) -> pa.Table:
    """Per chunk one bit for each key: does a chunk own it under a smaller id than the one sent?"""
    asked, carried = _bucket(table)
    if not asked:
        return _messages(carried)
    lists = [unpack(r[3]) for r in asked]
    sizes = [len(k) for k in lists]
    keys, owners = np.concatenate(lists), np.concatenate([_unpack_owners(r[4]) for r in asked])
    del lists
    order = np.argsort(keys)
    ordered = keys[order]
    first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    least = np.repeat(np.minimum.reduceat(owners[order], first), np.diff(np.append(first, len(order))))
    smaller = np.zeros(len(keys), bool)
    smaller[order] = least < owners[order]
    return _messages(carried + _answers(asked, smaller, sizes))


def replies_of(table: pa.Table) -> tuple[np.ndarray, bytes | None]:
    """The bits of a chunk's keys in key order, and what the chunk carried along for itself."""
    rows = sorted(zip(table["bucket"].to_pylist(), table["kind"].to_pylist(), table["keys"].to_pylist()))
    carried = next((blob for _, kind, blob in rows if kind == CARRY), None)
    bits = [unpack_bits(blob) for _, kind, blob in rows if kind == ANSWER]
    return (np.concatenate(bits) if bits else np.zeros(0, bool)), carried
