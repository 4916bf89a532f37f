"""Vectorised helpers over the UTF-8 bytes of a batch of texts: words, hashes, packed sorted keys."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes hashed at a time, so that temporary arrays stay small however long a text is.
BLOCK = 1 << 20
#: Windows hashed at a time: the few arrays in use then fit the cache of a core.
RUN_BLOCK = 1 << 14
NO_ID = np.iinfo(np.int64).max

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Odd 64-bit multiplier and random byte values of the polynomial hashes; any fixed values serve.
_BASE = 0x9E3779B97F4A7C15
_BYTE = np.random.default_rng(20240131).integers(0, 2**64, 256, dtype=np.uint64)


@dataclass
class Texts:
    """Concatenated bytes of some documents; document i has bytes starts[i]:starts[i + 1]."""

    data: np.ndarray
    starts: np.ndarray

    @property
    def lengths(self) -> np.ndarray:
        return np.diff(self.starts)

    def __len__(self) -> int:
        return len(self.starts) - 1

    def text(self, i: int) -> bytes:
        return self.data[self.starts[i]:self.starts[i + 1]].tobytes()


def texts_of(column: pa.ChunkedArray | pa.Array) -> Texts:
    """The bytes of a string column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if not len(column):
        return Texts(np.zeros(0, np.uint8), np.zeros(1, np.int64))
    _, offsets, data = column.buffers()
    starts = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8)[starts[0]:starts[-1]] if data is not None else np.zeros(0, np.uint8)
    return Texts(data, starts - starts[0])


def slices_by_size(batch: pa.RecordBatch, size: int = BLOCK) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about `size` bytes of its column text (a longer text is a slice of its own)."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < batch.num_rows:
        done = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, done + size, side="right")))
        yield batch.slice(at, to - at)
        at = to


def ids_of(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Document ids; a null becomes NO_ID, which is larger than every other id."""
    return pc.fill_null(column.cast(pa.int64()), NO_ID).to_numpy(zero_copy_only=False)


def id_column(ids: np.ndarray) -> pa.Array:
    return pa.array(ids, pa.int64(), mask=ids == NO_ID)


def mix(keys: np.ndarray) -> np.ndarray:
    """Spreads every input bit over all 64 bits."""
    keys = keys ^ (keys >> np.uint64(30))
    keys *= np.uint64(0xBF58476D1CE4E5B9)
    keys ^= keys >> np.uint64(27)
    keys *= np.uint64(0x94D049BB133111EB)
    keys ^= keys >> np.uint64(31)
    return keys


def runs(symbols: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of `width` consecutive uint64 symbols, by doubling; shorter input gives no run."""
    return mix(_sums(symbols, width))


def _sums(symbols: np.ndarray, width: int) -> np.ndarray:
    """The polynomial of each run, not mixed yet."""
    if len(symbols) < width:
        return np.zeros(0, np.uint64)
    power, have, done = symbols, 1, None
    done_width, rest = 0, width
    while rest:
        if rest & 1:
            if done is None:
                done = power
            else:
                n = len(power) - done_width
                done = done[:n] * np.uint64(pow(_BASE, have, 2**64))
                done += power[done_width:done_width + n]
            done_width += have
        rest >>= 1
        if rest:
            n = len(power) - have
            longer = power[:n] * np.uint64(pow(_BASE, have, 2**64))
            longer += power[have:]
            power, have = longer, have * 2
    return done[:len(symbols) - width + 1]


def byte_runs(data: np.ndarray, width: int, wanted: np.ndarray) -> np.ndarray:
    """Hashes of the `width` bytes from each ascending position in `wanted`."""
    out = np.empty(len(wanted), np.uint64)
    cuts = np.searchsorted(wanted, np.arange(0, len(data) + RUN_BLOCK, RUN_BLOCK))
    for block, (lo, hi) in enumerate(zip(cuts[:-1], cuts[1:])):
        if lo < hi:
            base, end = int(wanted[lo]), int(wanted[hi - 1]) + width
            out[lo:hi] = mix(_sums(_BYTE[data[base:end]], width)[wanted[lo:hi] - base])
    return out


def words_of(texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word `[^\\x20\\x09-\\x0D]+`, and the index of its document."""
    solid = ~_SPACE[texts.data]
    edge = np.zeros(len(solid) + 1, bool)
    edge[texts.starts] = True
    before = np.concatenate([[False], solid[:-1]]) if len(solid) else solid
    after = np.concatenate([solid[1:], [False]]) if len(solid) else solid
    first = np.flatnonzero(solid & (~before | edge[:-1]))
    last = np.flatnonzero(solid & (~after | edge[1:])) + 1
    return first, last, np.searchsorted(texts.starts, first, side="right") - 1


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = max(BLOCK, 1 << (n - 1).bit_length())
    if size not in _POWERS:
        up, down = np.full(size, _BASE, np.uint64), np.full(size, pow(_BASE, -1, 2**64), np.uint64)
        up[0] = down[0] = 1
        _POWERS[size] = np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)
    return _POWERS[size]


def word_hashes(data: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """64-bit hash of each word, in blocks of about BLOCK bytes (a longer word is a block of its own)."""
    out = np.empty(len(first), np.uint64)
    at = 0
    while at < len(first):
        to = max(at + 1, int(np.searchsorted(last, first[at] + BLOCK, side="right")))
        base = first[at]
        up, down = _powers(int(last[to - 1] - base))
        block = _BYTE[data[base:last[to - 1]]]
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(block * up[:len(block)], dtype=np.uint64)])
        out[at:to] = (total[last[at:to] - base] - total[first[at:to] - base]) * down[first[at:to] - base]
        at = to
    return mix(out)


def plain_letters(texts: Texts) -> Texts:
    """Lower-cased (ASCII and Latin-1 letters) texts without ASCII punctuation; white space stays."""
    data = texts.data.copy()
    upper = (data >= 0x41) & (data <= 0x5A)
    if len(data) > 1:
        lead = data[:-1] == 0xC3
        upper[1:] |= lead & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
    data[upper] += 0x20
    digit = (data >= 0x30) & (data <= 0x39)
    keep = (data >= 0x80) | ((data >= 0x61) & (data <= 0x7A)) | digit | _SPACE[data]
    kept = np.concatenate([[0], np.cumsum(keep)])
    return Texts(data[keep], kept[texts.starts])


def distinct(values: np.ndarray) -> np.ndarray:
    """Ascending distinct values, by sorting: np.unique hashes, which is many times slower on random keys."""
    ordered = np.sort(values)
    return ordered[_first_of_runs(ordered)]


def ascending(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The values in ascending order, and the place of each."""
    bits = max(len(values) - 1, 0).bit_length()
    if len(values) and values.dtype == np.int64 and values.min() >= 0 and int(values.max()).bit_length() + bits < 64:
        # Sorting numbers that hold value and place takes less than half the time of an argsort.
        ordered = np.sort((values << bits) | np.arange(len(values)))
        order = ordered & ((1 << bits) - 1)
        ordered >>= bits
        return ordered, order
    order = np.argsort(values)
    return values[order], order


def grouped(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ascending distinct values, the first place of each, and for each place the number of its value."""
    ordered, order = ascending(values)
    new = _first_of_runs(ordered)
    cuts = np.flatnonzero(new)
    which = np.empty(len(values), np.int64)
    which[order] = np.cumsum(new) - 1
    return ordered[cuts], np.minimum.reduceat(order, cuts) if len(cuts) else order, which


def _first_of_runs(ordered: np.ndarray) -> np.ndarray:
    new = np.ones(len(ordered), bool)
    new[1:] = ordered[1:] != ordered[:-1]
    return new


def pack(values: np.ndarray) -> bytes:
    """Ascending uint64 values as compressed byte planes of their gaps."""
    gaps = np.diff(values, prepend=values[:1])
    return struct.pack("<Q", int(values[0]) if len(values) else 0) + pack_planes(gaps)


def unpack(blob: bytes) -> np.ndarray:
    first = np.uint64(struct.unpack_from("<Q", blob)[0])
    gaps = unpack_planes(blob[8:])
    return np.cumsum(gaps, dtype=np.uint64) + first


def _squeeze(values: np.ndarray) -> bytes:
    return pa.Codec("zstd", compression_level=1).compress(pa.py_buffer(values), asbytes=True) if values.size else b""


def _expand(blob: bytes, size: int) -> bytes:
    return pa.Codec("zstd").decompress(blob, decompressed_size=size, asbytes=True) if size else b""


def pack_planes(values: np.ndarray) -> bytes:
    """uint64 values as compressed byte planes, without the planes that are all zero."""
    values = np.ascontiguousarray(values, dtype="<u8")
    width = (int(values.max()).bit_length() + 7) // 8 if len(values) else 0
    planes = values.view(np.uint8).reshape(-1, 8)[:, :width].T
    return struct.pack("<IB", len(values), width) + _squeeze(np.ascontiguousarray(planes))


def unpack_planes(blob: bytes) -> np.ndarray:
    n, width = struct.unpack_from("<IB", blob)
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = np.frombuffer(_expand(blob[5:], n * width), np.uint8).reshape(width, n).T
    return out.reshape(-1).view("<u8").astype(np.uint64, copy=False)


def pack_bits(bits: np.ndarray) -> bytes:
    return struct.pack("<I", len(bits)) + _squeeze(np.packbits(bits))


def unpack_bits(blob: bytes) -> np.ndarray:
    n, = struct.unpack_from("<I", blob)
    return np.unpackbits(np.frombuffer(_expand(blob[4:], (n + 7) // 8), np.uint8), count=n).astype(bool)


def covered(starts: np.ndarray, ends: np.ndarray, size: int) -> np.ndarray:
    """Which of `size` places lie in one of the half-open spans, which come by ascending start."""
    inside = np.zeros(size + 1, np.int8)
    if len(starts):
        reach = np.maximum.accumulate(ends)
        new = np.flatnonzero(starts[1:] > reach[:-1]) + 1
        inside[starts[np.append(0, new)]] = 1
        inside[reach[np.append(new - 1, len(reach) - 1)]] -= 1
    return np.cumsum(inside[:size], dtype=np.int8).view(bool)
