"""Word n-grams of a chunk of documents, and their exact totals over all chunks.

Words stay strings, so nothing hangs on a hash: a chunk codes its words by their place in its own sorted list, an
n-gram is the pair of its history (the words before the last) and its last word, and messages carry the strings,
sorted and compressed. A chunk sends each distinct n-gram once with its count; a bucket of the key space adds up
and answers each chunk in the order it asked. Documents lie in chunks by a hash of id, text and input partition,
so rows that repeat spread over chunks as well.

Where longer n-grams follow pass by pass (`Numbered`), the buckets also number what they added up: a history is then
its key, a last word its number, so that no word is sent again. Numbers are given by a count, not by a hash.

A history that may fill a bucket (`hot`, by its count, which every chunk knows alike) is spread by its last words.
"""

from __future__ import annotations

import gc
import math
import struct
from dataclasses import dataclass, field
from urllib.parse import quote_from_bytes

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loanloom.llm.bytestext import (
    Texts, ascending, distinct, grouped, mix, pack, pack_bits, pack_planes, texts_of, unpack, unpack_bits, unpack_planes, word_hashes)
from loanloom.session import fresh_path

#: Text of a chunk; the arrays over its words take some 25 times as much.
CHUNK_BYTES = 5 << 20
#: Rows packed together before they are dealt out.
PACK_BYTES = 32 << 20
#: N-grams a bucket receives on average.
BUCKET_GRAMS = 2_000_000
#: Chunks that are stored, and worked on, together on average.
CHUNKS_TOGETHER = 2
CODED = "chunk int, body binary"
MESSAGE = "bucket int, chunk int, kind string, level int, body binary"
ASK, CARRY, ANSWER = "ask", "carry", "answer"
#: A key is the bucket that gave it, shifted by so many bits, and a number in that bucket.
KEY_BITS = 40
_STEP = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Layout:
    """Chunks and buckets for so many bytes of text; at most every 7th byte starts an n-gram that a chunk sends."""

    chunks: int
    buckets: int
    bytes: int

    @property
    def tables(self) -> int:
        """Buckets in which what belongs to chunks is stored."""
        return math.ceil(self.chunks / CHUNKS_TOGETHER)


def layout_of(docs: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> Layout:
    size = docs.agg(F.coalesce(F.sum(F.octet_length(F.col("text").cast("string"))), F.lit(0)).cast("bigint")).first()[0]
    return Layout(max(1, math.ceil(size / chunk_bytes)), max(1, math.ceil(size / 7 / BUCKET_GRAMS)), size)


def chunked(docs: DataFrame, layout: Layout, note: Column) -> DataFrame:
    """chunk and body: the rows of `docs` dealt to chunks, packed together as far as they come from one task.

    A row keeps its doc_id, its whole text and a note, a string that is not null; other columns are left behind.
    """
    rows = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), note.alias("note"))
    key = F.xxhash64("doc_id", "text", "note")
    rows = rows.withColumns({
        "key": key, "chunk": F.pmod(F.xxhash64(key, F.spark_partition_id()), F.lit(layout.chunks)).cast("int")})
    return rows.mapInArrow(_pack_rows, "chunk int, body binary")


def _pack_rows(batches):
    waiting, size = [], 0
    for batch in batches:
        waiting.append(batch)
        size += batch.nbytes
        if size >= PACK_BYTES:
            yield _packed(pa.Table.from_batches(waiting))
            waiting, size = [], 0
    if waiting:
        yield _packed(pa.Table.from_batches(waiting))


def _packed(table: pa.Table) -> pa.RecordBatch:
    number = table["chunk"].to_numpy()
    order = np.argsort(number, kind="stable")
    chunks, cuts = np.unique(number[order], return_index=True)
    bodies = []
    for rows in np.split(order, cuts[1:]) if len(chunks) else []:
        part = table.take(pa.array(rows))
        texts = texts_of(part["text"].combine_chunks())
        notes = [quote_from_bytes(n.encode()) for n in part["note"].to_pylist()]
        bodies.append(bundle(
            pack_bits(part["doc_id"].is_valid().to_numpy()), pc.fill_null(part["doc_id"], 0).to_numpy().tobytes(),
            part["key"].to_numpy().tobytes(), pack_strings(pa.array([n.encode() for n in notes], pa.large_binary())),
            pack_ints(texts.lengths), squeezed(np.ascontiguousarray(texts.data))))
    return pa.record_batch([pa.array(chunks, pa.int32()), pa.array(bodies, pa.binary())], ["chunk", "body"])


@dataclass
class Chunk:
    """The documents of one chunk in an order that does not hang on their arrival."""

    number: int
    ids: pa.Array
    notes: list[bytes]
    texts: Texts


def chunk_of(table: pa.Table) -> Chunk:
    """`notes` are percent-encoded, without spaces and line feeds."""
    parts = [unbundle(body) for body in table["body"].to_pylist()]
    valid = np.concatenate([unpack_bits(p[0]) for p in parts])
    ids, keys = (np.concatenate([np.frombuffer(p[i], np.int64) for p in parts]) for i in (1, 2))
    notes = [n for p in parts for n in unpack_strings(p[3]).to_pylist()]
    lengths = np.concatenate([unpack_ints(p[4]) for p in parts])
    data = np.concatenate([np.frombuffer(expanded(p[5]), np.uint8) for p in parts])
    starts = np.concatenate([[0], np.cumsum(lengths)])
    order = np.lexsort((keys, ids, valid))
    texts = np.concatenate([data[starts[i]:starts[i + 1]] for i in order])
    return Chunk(table["chunk"][0].as_py(), pa.array(ids[order], pa.int64(), mask=~valid[order]), [notes[i] for i in order],
                 Texts(texts, np.concatenate([[0], np.cumsum(lengths[order])])))


def lower_ascii(texts: Texts) -> Texts:
    data = texts.data.copy()
    data[(data >= 0x41) & (data <= 0x5A)] += 0x20
    return Texts(data, texts.starts)


def slices(data: np.ndarray, first: np.ndarray, last: np.ndarray) -> pa.Array:
    """The bytes first:last of each ascending, disjoint span as a binary array."""
    edges = np.zeros(len(data) + 1, np.int8)
    edges[first] += 1
    edges[last] -= 1
    inside = np.cumsum(edges[:-1], dtype=np.int8).view(bool)
    return _binary(np.concatenate([[0], np.cumsum(last - first)]), data[inside])


def _binary(offsets: np.ndarray, data: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(
        pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(np.ascontiguousarray(offsets, np.int64)), pa.py_buffer(data)])


class Words:
    """The tokens of a chunk: `code` places each in `strings`, which ascend by bytes; n-grams stay inside a `piece`."""

    def __init__(self, tokens: pa.Array, piece: np.ndarray, tags: pa.Array, tag: np.ndarray):
        """`tag` numbers, for each token, the string in `tags` that leads all its n-grams."""
        coded = pa.concat_arrays([tags, tokens]).dictionary_encode()
        order = pc.sort_indices(coded.dictionary)
        rank = np.empty(len(order), np.int64)
        rank[order.to_numpy()] = np.arange(len(order))
        codes = rank[coded.indices.to_numpy(zero_copy_only=False)]
        self._hold(pc.take(coded.dictionary, order), codes[len(tags):], piece, codes[:len(tags)], tag)

    def _hold(self, strings: pa.Array, code: np.ndarray, piece: np.ndarray, tags: np.ndarray, tag: np.ndarray) -> None:
        self.strings, self.code, self.piece, self.tags = strings, code, piece, tags
        ends = np.frombuffer(self.strings.buffers()[1], np.int64)[self.strings.offset:self.strings.offset + len(self.strings) + 1]
        data = np.frombuffer(self.strings.buffers()[2] or b"", np.uint8)
        self.hashes = word_hashes(data, ends[:-1], ends[1:])
        self.root = Level(None, self, self.tags[tag] if len(tags) else np.zeros(0, np.int64))

    def packed(self) -> bytes:
        """Words that are all led by one tag; tokens as the places of their words by descending count."""
        counts = np.bincount(self.code, minlength=len(self.strings))
        place = np.empty(len(counts), np.int64)
        place[np.argsort(-counts, kind="stable")] = np.arange(len(counts))
        return bundle(pack_strings(self.strings), pack_ints(counts), pack_ints(place[self.code]), pack_ints(np.bincount(self.piece)),
                      pack_ints(self.tags))

    @classmethod
    def of(cls, body: bytes) -> Words:
        strings, counts, place, sizes, tags = unbundle(body)
        words, sizes = cls.__new__(cls), unpack_ints(sizes)
        code = np.argsort(-unpack_ints(counts), kind="stable")[unpack_ints(place)]
        words._hold(unpack_strings(strings), code, np.repeat(np.arange(len(sizes)), sizes), unpack_ints(tags), np.zeros(len(code), np.int64))
        return words


class Level:
    """The distinct n-grams of a chunk in ascending order of their words.

    `hist` places the history of each in the level before, `last` its last word in the word list, `suffix` the
    n-gram without its first word in the level before; `at` gives for each token the n-gram that ends there, or -1.
    """

    def __init__(self, before: Level | None, words: Words, at: np.ndarray):
        self.before, self.words = before, words
        if before is None:
            self.level, self.hist, self.at = 0, None, at
            self.last, self.hash, self.suffix = np.arange(len(words.strings)), words.hashes, None

    def __len__(self) -> int:
        return len(self.last)

    def ahead(self) -> np.ndarray:
        """For each token the n-gram that ends just before it in its piece, or -1: its history in the next level."""
        if self.level == 0:
            return self.at
        hist = np.concatenate([np.full(min(len(self.at), 1), -1), self.at[:-1]])
        hist[1:][self.words.piece[1:] != self.words.piece[:-1]] = -1
        return hist

    def longer(self, allowed: np.ndarray | None = None) -> Level:
        """The n-grams with one word more. `allowed` picks tokens that may end one."""
        words, level = self.words, Level(self, self.words, None)
        level.level = self.level + 1
        n = len(words.code)
        hist = self.ahead()
        fits = hist >= 0
        if allowed is not None:
            fits &= allowed
        places = np.flatnonzero(fits)
        size = max(len(words.strings), 1)
        if self.level == 0 and len(words.tags) == 1 and allowed is None:
            # One history: the codes are the places already, but for the code of the history itself.
            seen = np.bincount(words.code, minlength=size) > 0
            number = np.cumsum(seen) - 1
            keys, which, first = np.flatnonzero(seen) + size * words.tags[0], number[words.code], None
        else:
            keys, first, which = grouped(hist[places] * size + words.code[places])
        level.at = np.full(n, -1, np.int64)
        level.at[places] = which
        level.hist, level.last = keys // size, keys % size
        level.suffix = self.at[places[first]] if self.level else None
        level.hash = mix(self.hash[level.hist] * _STEP + words.hashes[level.last])
        return level

    def counts(self, chosen: np.ndarray | None = None) -> np.ndarray:
        at = self.at if chosen is None else self.at[chosen]
        return np.bincount(at[at >= 0], minlength=len(self))

    def phrases(self, rows: np.ndarray) -> pa.Array:
        last = pc.take(self.words.strings, pa.array(self.last[rows]))
        if self.before is None:
            return last
        return pc.binary_join_element_wise(self.before.phrases(self.hist[rows]), last, pa.scalar(b" ", pa.large_binary()))


def squeezed(data) -> bytes:
    """Bytes with their size, compressed."""
    data = pa.py_buffer(data)
    return struct.pack("<Q", data.size) + (pa.Codec("zstd", compression_level=3).compress(data, asbytes=True) if data.size else b"")


def expanded(blob: bytes) -> bytes:
    size, = struct.unpack_from("<Q", blob)
    return pa.Codec("zstd").decompress(blob[8:], decompressed_size=size, asbytes=True) if size else b""


def pack_strings(strings: pa.Array) -> bytes:
    """Strings without line feeds, compressed."""
    lines = pc.binary_join_element_wise(strings, pa.scalar(b"", pa.large_binary()), pa.scalar(b"\n", pa.large_binary()))
    return squeezed(lines.buffers()[2] if len(lines) else b"")


def unpack_strings(blob: bytes) -> pa.Array:
    data = np.frombuffer(expanded(blob), np.uint8)
    ends = np.flatnonzero(data == 10)
    lengths = np.diff(ends, prepend=-1) - 1
    return _binary(np.concatenate([[0], np.cumsum(lengths)]), data[data != 10])


def bundle(*blobs: bytes) -> bytes:
    return struct.pack(f"<I{len(blobs)}Q", len(blobs), *map(len, blobs)) + b"".join(blobs)


def unbundle(blob: bytes) -> list[bytes]:
    n, = struct.unpack_from("<I", blob)
    at, out = 4 + 8 * n, []
    for size in struct.unpack_from(f"<{n}Q", blob, 4):
        out.append(blob[at:at + size])
        at += size
    return out


def pack_ints(values: np.ndarray) -> bytes:
    """Integers from 0; a matrix column by column."""
    return pack_planes(np.asarray(values).T.ravel().astype(np.uint64))


def unpack_ints(blob: bytes, columns: int | None = None) -> np.ndarray:
    values = unpack_planes(blob).astype(np.int64)
    return values if columns is None else values.reshape(columns, -1).T


@dataclass
class Question:
    """Histories of one chunk in one bucket, the last words of each, and numbers per n-gram and per history."""

    hists: pa.Array
    sizes: np.ndarray
    words: pa.Array
    numbers: np.ndarray
    of_hists: np.ndarray

    def packed(self) -> bytes:
        return bundle(pack_strings(self.hists), pack_ints(self.sizes), pack_strings(self.words), pack_ints(self.numbers),
                      pack_ints(self.of_hists))

    @staticmethod
    def of(body: bytes, numbers: int, of_hists: int) -> Question:
        hists, sizes, words, mine, theirs = unbundle(body)
        return Question(unpack_strings(hists), unpack_ints(sizes), unpack_strings(words), unpack_ints(mine, numbers),
                        unpack_ints(theirs, of_hists) if of_hists else np.zeros((0, 0), np.int64))


@dataclass
class Route:
    """In which order, and where, a chunk asks: `rows` (n-grams) and `hists` (histories), each by bucket."""

    buckets: np.ndarray
    rows: np.ndarray
    hists: np.ndarray
    row_cuts: np.ndarray
    hist_cuts: np.ndarray


def route(level: Level, rows: np.ndarray, buckets: int, spread: np.ndarray | None, alone: np.ndarray | None = None) -> Route:
    """`rows` of a level dealt to buckets by their history; histories marked in `spread` (None: all) by the n-gram.

    `alone` are histories to be asked for even if none of their n-grams is.
    """
    to = level.hash[rows] if spread is None else np.where(spread[level.hist[rows]], level.hash[rows], level.before.hash[level.hist[rows]])
    bucket = (to % np.uint64(buckets)).astype(np.int64)
    # A stable sort of small integers is a radix sort.
    order = np.argsort(bucket.astype(np.uint16) if buckets <= 1 << 16 else bucket, kind="stable")
    rows, bucket = rows[order], bucket[order]
    size = len(level.before)
    pairs = bucket * size + level.hist[rows]
    if alone is not None:
        pairs = np.concatenate([pairs, (level.before.hash[alone] % np.uint64(buckets)).astype(np.int64) * size + alone])
    pairs = distinct(pairs)
    edges = np.arange(buckets + 1)
    row_cuts, hist_cuts = np.searchsorted(bucket, edges), np.searchsorted(pairs // size, edges)
    used = np.flatnonzero(np.diff(hist_cuts))
    return Route(used, rows, pairs % size, row_cuts, hist_cuts)


def questions(chunk: int, level: Level, way: Route, numbers: np.ndarray, of_hists: np.ndarray | None = None) -> list[tuple]:
    """Messages for the n-grams and histories of `way`, with the columns of numbers per n-gram and per history."""
    out = []
    for b in way.buckets.tolist():
        rows = way.rows[way.row_cuts[b]:way.row_cuts[b + 1]]
        hists = way.hists[way.hist_cuts[b]:way.hist_cuts[b + 1]]
        sizes = np.bincount(np.searchsorted(hists, level.hist[rows]), minlength=len(hists))
        asked = Question(level.before.phrases(hists), sizes, pc.take(level.words.strings, pa.array(level.last[rows])),
                         numbers[rows], np.zeros((0, 0)) if of_hists is None else of_hists[hists])
        out.append((b, chunk, ASK, level.level, asked.packed()))
    return out


@dataclass
class Numbered:
    """A question by numbers: histories by ascending key, and the numbers of their last words, ascending in each history.

    `of_words` has, if anything, a number for each distinct last word, in the order of `alike`.
    """

    hists: np.ndarray
    sizes: np.ndarray
    words: np.ndarray
    numbers: np.ndarray
    of_hists: np.ndarray
    of_words: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))

    def packed(self) -> bytes:
        steps = np.diff(self.words, prepend=0)
        first = (np.cumsum(self.sizes) - self.sizes)[self.sizes > 0]
        steps[first] = self.words[first]
        near = np.diff(self.of_words, prepend=0)
        return bundle(pack(self.hists.astype(np.uint64)), pack_ints(self.sizes), pack_ints(steps), pack_ints((near << 1) ^ (near >> 63)),
                      *columns(self.numbers), *columns(self.of_hists))

    @staticmethod
    def of(body: bytes, numbers: int) -> Numbered:
        hists, sizes, steps, near, *rest = unbundle(body)
        sizes, steps, near = unpack_ints(sizes), unpack_ints(steps), unpack_ints(near)
        sums, some = np.cumsum(steps), sizes[sizes > 0]
        first = np.cumsum(some) - some
        words = sums - np.repeat(sums[first] - steps[first], some)
        mine, theirs = ([unpack_ints(blob) for blob in part] for part in (rest[:numbers], rest[numbers:]))
        return Numbered(unpack(hists).astype(np.int64), sizes, words, np.stack(mine, 1),
                        np.stack(theirs, 1) if theirs else np.zeros((0, 0), np.int64), np.cumsum((near >> 1) ^ -(near & 1)))


def alike(words: np.ndarray, buckets: int) -> np.ndarray:
    """Ascending numbers of words in an order in which neighbours have similar totals: a bucket's descend by count."""
    return words[np.argsort(words % buckets, kind="stable")] if len(words) > 16 * buckets else words


def columns(values: np.ndarray) -> list[bytes]:
    """Each column of a matrix on its own, so that small numbers aren't coded together with large ones."""
    return [pack_ints(column) for column in values.T]


def route_by_keys(level: Level, buckets: int, keys: np.ndarray, words: np.ndarray, spread: np.ndarray, alone: np.ndarray) -> Route:
    """All n-grams of a level, each dealt to the bucket that gave its history the key; otherwise as `route`.

    `keys` are those of the histories, `words` the numbers of the chunk's words; a bucket's part ascends by both.
    """
    size, home = len(level.before), keys >> KEY_BITS
    _, of_place = ascending(keys)
    _, of_word = ascending(words)
    place, word = np.empty(size, np.int64), np.empty(len(words), np.int64)
    place[of_place] = np.arange(size)
    word[of_word] = np.arange(len(words))
    _, rows = ascending(place[level.hist] * max(len(words), 1) + word[level.last])
    hist = level.hist[rows]
    bucket = home[hist]
    if spread.any():
        bucket = np.where(spread[hist], (level.hash[rows] % np.uint64(buckets)).astype(np.int64), bucket)
        order = np.argsort(bucket, kind="stable")
        rows, hist, bucket = rows[order], hist[order], bucket[order]
    pairs = distinct(np.concatenate([bucket * size + place[hist], home[alone] * size + place[alone]]))
    edges = np.arange(buckets + 1)
    row_cuts, hist_cuts = np.searchsorted(bucket, edges), np.searchsorted(pairs // max(size, 1), edges)
    return Route(np.flatnonzero(np.diff(hist_cuts)), rows, of_place[pairs % max(size, 1)], row_cuts, hist_cuts)


def questions_by_keys(chunk: int, level: Level, way: Route, keys: np.ndarray, words: np.ndarray, numbers: np.ndarray,
                      of_hists: np.ndarray, of_words: np.ndarray | None = None, buckets: int = 1) -> list[tuple]:
    """As `questions`, with the keys of histories and the numbers of words that `route_by_keys` had."""
    out, by_number = [], np.argsort(words)
    for b in way.buckets.tolist():
        rows = way.rows[way.row_cuts[b]:way.row_cuts[b + 1]]
        hists = way.hists[way.hist_cuts[b]:way.hist_cuts[b + 1]]
        sizes = np.bincount(np.searchsorted(keys[hists], keys[level.hist[rows]]), minlength=len(hists))
        asked = Numbered(keys[hists], sizes, words[level.last[rows]], numbers[rows], of_hists[hists])
        if of_words is not None:
            used = np.zeros(len(words), bool)
            used[level.last[rows]] = True
            some = by_number[used[by_number]]
            asked.of_words = of_words[some[np.searchsorted(words[some], alike(words[some], buckets))]]
        out.append((b, chunk, ASK, level.level, asked.packed()))
    return out


@dataclass
class Totals:
    """The distinct n-grams of a bucket, and where each asked n-gram and history stands in them."""

    hists: pa.Array | np.ndarray
    hist: np.ndarray
    words: pa.Array | None
    word: np.ndarray
    totals: np.ndarray
    first: np.ndarray
    which: np.ndarray
    hist_which: np.ndarray

    @property
    def phrases(self) -> pa.Array:
        hists, words = pc.take(self.hists, pa.array(self.hist)), pc.take(self.words, pa.array(self.word))
        return pc.binary_join_element_wise(hists, words, pa.scalar(b" ", pa.large_binary()))


def add_up(asked: list[Question]) -> Totals:
    """Sums the first number of every n-gram over all questions."""
    hists = pa.concat_arrays([q.hists for q in asked]).dictionary_encode()
    words = pa.concat_arrays([q.words for q in asked]).dictionary_encode()
    hist_which = hists.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    return _added(asked, hists.dictionary, hist_which, words.dictionary, len(words.dictionary), words.indices.to_numpy(zero_copy_only=False))


def add_up_numbers(asked: list[Numbered]) -> Totals:
    """As `add_up`; the n-grams ascend by the keys of their histories and the numbers of their words (`words` is None)."""
    hists, _, hist_which = grouped(np.concatenate([q.hists for q in asked]))
    words = np.concatenate([q.words for q in asked])
    return _added(asked, hists, hist_which, None, int(words.max(initial=0)) + 1, words)


def _added(asked: list, hists, hist_which: np.ndarray, words: pa.Array | None, size: int, word: np.ndarray) -> Totals:
    size = max(size, 1)
    keys, first, which = grouped(np.repeat(hist_which, np.concatenate([q.sizes for q in asked])) * size + word)
    counts = np.concatenate([q.numbers[:, 0] for q in asked])
    totals = np.zeros(len(keys), np.int64)
    # Sums in double precision are exact up to 2^53; a chunk's counts are far below 2^32.
    for part, scale in ((counts & 0xFFFF, 1), (counts >> 16, 1 << 16)):
        totals += np.bincount(which, weights=part, minlength=len(keys)).astype(np.int64) * scale
    return Totals(hists, keys // size, words, keys % size, totals, first, which, hist_which)


def drop_finished_shuffles(spark: SparkSession) -> None:
    """Spark deletes the shuffle files of a finished pass once the driver collects its garbage: have it done now."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def coded_chunks(rows: DataFrame, layout: Layout, code) -> DataFrame:
    """What `code` makes of each chunk of `rows`, in buckets of the chunk in the shared folder, read without a shuffle."""
    spark, tables = rows.sparkSession, layout.tables
    path = fresh_path(spark, "chunks")
    name = path.rsplit("/", 1)[-1].replace("-", "_")
    coded = rows.repartition(tables, "chunk").groupBy("chunk").applyInArrow(code, CODED)
    coded.write.format("parquet").bucketBy(tables, "chunk").sortBy("chunk").option("path", path).saveAsTable(name)
    return spark.table(name)


class Stored:
    """A pass's messages in the shared folder: those to chunks until the next pass is written, the others for good."""

    def __init__(self, sent: DataFrame):
        self.spark = sent.sparkSession
        self.path = fresh_path(self.spark, "grams")
        sent.withColumn("kept", F.col("chunk") < 0).write.partitionBy("kept").parquet(self.path)

    def told(self) -> DataFrame:
        return self.spark.read.schema(f"{MESSAGE}, kept boolean").parquet(self.path).where("NOT kept").drop("kept")

    def kept(self, *kinds: str) -> DataFrame:
        rows = self.spark.read.schema(f"{MESSAGE}, kept boolean").parquet(self.path).where("kept")
        return rows.where(F.col("kind").isin(*kinds)).drop("kept")

    def drop_told(self) -> None:
        """Once the next pass has been written, nobody reads the messages to chunks any more."""
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/kept=false")
        folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(folder, True)


class Gathered:
    """The messages of all passes in one table in the shared folder, in the buckets of `coded_chunks`.

    So every later pass reads what its chunks were told without a shuffle. What goes to no chunk is spread by its bucket.
    """

    def __init__(self, spark: SparkSession, layout: Layout):
        self.spark, self.tables, self.path = spark, layout.tables, fresh_path(spark, "grams")
        self.name = self.path.rsplit("/", 1)[-1].replace("-", "_")

    def add(self, sent: DataFrame) -> None:
        chunk = F.col("chunk")
        rows = sent.withColumns({"kept": chunk < 0, "chunk": F.when(chunk < 0, -1 - F.col("bucket")).otherwise(chunk)})
        rows.repartition(self.tables, "chunk").write.format("parquet").partitionBy("kept", "level").bucketBy(
            self.tables, "chunk").sortBy("chunk").option("path", self.path).mode("append").saveAsTable(self.name)

    def told(self) -> DataFrame:
        return self.spark.table(self.name).where("NOT kept").drop("kept")

    def kept(self, level: int, *kinds: str) -> DataFrame:
        rows = self.spark.table(self.name).where(F.col("kept") & (F.col("level") == level) & F.col("kind").isin(*kinds))
        return rows.drop("kept")


def messages(rows: list[tuple]) -> pa.Table:
    columns = list(zip(*rows)) if rows else [[]] * 5
    kinds = [pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.binary()]
    return pa.table([pa.array(c, k) for c, k in zip(columns, kinds)], names="bucket chunk kind level body".split())


def rows_of(table: pa.Table) -> list[tuple]:
    return sorted(zip(*(table[c].to_pylist() for c in ("bucket", "chunk", "kind", "level", "body"))))
