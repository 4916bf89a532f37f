"""Training-order materialisation: token sequences in fixed-stride binary shards, in a keyed random order.

Each task turns its documents into one stream of token ids, ended by an end-of-text id per document, and cuts it
into sequences of `length` ids (the last one of a task is filled with end-of-text ids). Sequences are numbered
0..n-1 by a count per task. A Feistel network under a key permutes the numbers; where its domain, a power of four,
is larger than n, a result outside is permuted again (cycle walking) until it lies inside. So every sequence gets
a global slot of its own without any sort or table. Shard s holds the slots from s * rows on; a slot's bytes stand
at (slot % rows) * length * id size, so a reader continues anywhere, and a job that is run again leaves finished
shards alone.

The ids are the UTF-8 bytes (0 to 254) with 255 as end of text, a byte that no UTF-8 text contains; or those of
a byte-pair vocabulary whose file is given (rank file), 16 bits each, with the size of the vocabulary as end of
text.

Sequences are numbered by the tasks of the read, so the input must be dealt out alike each time it is read, as
files are. Any other DataFrame is first written to the shared folder (`stable=False`). Each task checks that it
makes as many sequences as were counted. Shards are written by name and then moved into place, so a repeated task
does no harm.

Defined results: null and empty texts are an end-of-text id only; rows that repeat are written as often; a null
doc_id stays null in the list of a sequence; an empty table gives no shard. Other columns are ignored.
"""

from __future__ import annotations

import base64
import math
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loanloom.llm.bytestext import id_column, ids_of, texts_of
from loanloom.session import fresh_path, materialise

LENGTH = 2048
SHARD_ROWS = 4096
ROUNDS = 6
KEY = 20240131
#: Ids held by a task before it hands on whole sequences.
STREAM = 1 << 22


@dataclass(frozen=True)
class Feistel:
    """A permutation of 0..n-1 under a key."""

    n: int
    key: int

    @property
    def half(self) -> int:
        return max(1, (max(self.n - 1, 1).bit_length() + 1) // 2)

    def _once(self, x: np.ndarray, rounds: range) -> np.ndarray:
        half, low = np.uint64(self.half), np.uint64((1 << self.half) - 1)
        left, right = x >> half, x & low
        for r in rounds:
            left, right = right, left ^ (self._mixed(right, r) & low)
        return (left << half) | right

    def _mixed(self, x: np.ndarray, r: int) -> np.ndarray:
        x = x + np.uint64((self.key * 0x9E3779B97F4A7C15 + r * 0xD1B54A32D192ED03) % 2**64)
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return x ^ (x >> np.uint64(32))

    def slots(self, numbers: np.ndarray) -> np.ndarray:
        out = self._once(numbers.astype(np.uint64), range(ROUNDS))
        while (outside := np.flatnonzero(out >= self.n)).size:
            out[outside] = self._once(out[outside], range(ROUNDS))
        return out.astype(np.int64)

    def numbers(self, slots: np.ndarray) -> np.ndarray:
        """The inverse: which sequence stands in a slot."""
        half, low = np.uint64(self.half), np.uint64((1 << self.half) - 1)

        def back(x):
            left, right = x >> half, x & low
            for r in reversed(range(ROUNDS)):
                left, right = right ^ (self._mixed(left, r) & low), left
            return (left << half) | right

        out = back(slots.astype(np.uint64))
        while (outside := np.flatnonzero(out >= self.n)).size:
            out[outside] = back(out[outside])
        return out.astype(np.int64)


class Bytes:
    """Ids of the bytes themselves."""

    dtype, end = np.dtype("u1"), 255

    def ids(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, each with its end, and where each text's ids begin (one more at the end)."""
        texts = texts_of(column)
        starts = texts.starts + np.arange(len(texts) + 1)
        out = np.full(starts[-1], self.end, np.uint8)
        keep = np.ones(len(out), bool)
        keep[starts[1:] - 1] = False
        out[keep] = texts.data
        return out, starts


@dataclass
class Ranks:
    """Ids of a byte-pair vocabulary in a rank file (a base64 token and its rank on each line)."""

    path: str
    pattern: str
    size: int
    _loaded: object = None

    dtype = np.dtype("<u2")

    @property
    def end(self) -> int:
        return self.size

    def __getstate__(self):
        return {**self.__dict__, "_loaded": None}

    def ids(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if self._loaded is None:
            import tiktoken

            with open(self.path, "rb") as lines:
                ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
            self._loaded = tiktoken.Encoding("ranks", pat_str=self.pattern, mergeable_ranks=ranks, special_tokens={})
        lists = [np.array([*self._loaded.encode_ordinary(t or ""), self.end], self.dtype) for t in column.to_pylist()]
        starts = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int64)
        return (np.concatenate(lists) if lists else np.zeros(0, self.dtype)), starts


def _cut(batches: Iterator[pa.RecordBatch], encoder, length: int) -> Iterator[tuple[np.ndarray, list[np.ndarray]]]:
    """Whole sequences of a task's stream, some at a time, with the ids of the documents in each."""
    ids, docs, firsts = np.zeros(0, encoder.dtype), np.zeros(0, np.int64), np.zeros(0, np.int64)
    for batch in batches:
        at = 0
        while at < batch.num_rows:
            step = batch.slice(at, 256)
            at += step.num_rows
            new, starts = encoder.ids(step.column("text"))
            firsts = np.concatenate([firsts, starts[:-1] + len(ids)])
            ids, docs = np.concatenate([ids, new]), np.concatenate([docs, ids_of(step.column("doc_id"))])
            if len(ids) >= STREAM:
                whole = len(ids) // length * length
                yield ids[:whole].reshape(-1, length), _present(docs, firsts, whole, length)
                open_at = np.searchsorted(firsts, whole, side="right") - 1
                ids, docs, firsts = ids[whole:], docs[open_at:], firsts[open_at:] - whole
                if not len(ids):
                    docs, firsts = docs[:0], firsts[:0]
    if len(ids):
        whole = -(-len(ids) // length) * length
        ids = np.concatenate([ids, np.full(whole - len(ids), encoder.end, encoder.dtype)])
        yield ids.reshape(-1, length), _present(docs, firsts, whole, length)


def _present(docs: np.ndarray, firsts: np.ndarray, whole: int, length: int) -> list[np.ndarray]:
    """Documents with ids in each sequence of the stream's first `whole` ids."""
    begin = np.arange(0, whole, length)
    low = np.maximum(np.searchsorted(firsts, begin, side="right") - 1, 0)
    high = np.searchsorted(firsts, begin + length, side="left")
    return [docs[a:b] for a, b in zip(low, high)]


def _counter(encoder, length: int) -> Callable:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = sum(len(encoder.ids(batch.column("text"))[0]) for batch in batches)
        yield pa.RecordBatch.from_pydict({"task": [TaskContext.get().partitionId()], "n": [-(-size // length)]})

    return count


def _numberer(encoder, length: int, before: dict[int, tuple[int, int]], order: Feistel) -> Callable:
    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, counted = before.get(TaskContext.get().partitionId(), (0, 0))
        made = 0
        for block, docs in _cut(batches, encoder, length):
            if made + len(block) > counted:
                raise RuntimeError("the input was dealt out differently on its second reading")
            slots = order.slots(np.arange(at + made, at + made + len(block)))
            made += len(block)
            yield pa.RecordBatch.from_arrays([
                pa.array(slots), pa.array([row.tobytes() for row in block], pa.binary()),
                pa.ListArray.from_arrays(
                    pa.array(np.concatenate([[0], np.cumsum([len(d) for d in docs])]).astype(np.int32)),
                    id_column(np.concatenate(docs)))], names=["slot", "ids", "doc_ids"])
        if made != counted:
            raise RuntimeError("the input was dealt out differently on its second reading")

    return number


def _filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def _holds(files: pafs.FileSystem, name: str, data: bytes) -> bool:
    """Full shards all have one size, so only equal bytes say that a file is this one, of this key and these documents."""
    with files.open_input_stream(name) as source:
        return source.read() == data


def _writer(folder: str) -> Callable:
    def write(table: pa.Table) -> pa.Table:
        table = table.sort_by("slot")
        number = table["shard"][0].as_py()
        files, base = _filesystem(folder)
        name, data = f"{base}/shard-{number:08d}.bin", b"".join(table["ids"].to_pylist())
        there = files.get_file_info(name)
        if there.type == pafs.FileType.NotFound or there.size != len(data) or not _holds(files, name, data):
            files.create_dir(base, recursive=True)
            part = f"{name}.{uuid.uuid4().hex}"
            with files.open_output_stream(part) as out:
                out.write(data)
            files.move(part, name)
        file = pa.array([f"shard-{number:08d}.bin"] * table.num_rows)
        first = table["slot"][0].as_py()
        place = pa.array(table["slot"].to_numpy() - first)
        return pa.table([table["slot"], table["shard"], place, table["doc_ids"], file],
                        names=["slot", "shard", "place", "doc_ids", "file"])

    return write


def write_shards(docs: DataFrame, folder: str | None = None, length: int = LENGTH, shard_rows: int = SHARD_ROWS,
                 key: int = KEY, encoder=None, stable: bool = False) -> tuple[DataFrame, str]:
    """Writes the shards into `folder` when the returned DataFrame is computed.

    It has slot, shard, place (row in the shard), doc_ids (documents in the sequence) and file of every sequence.
    Also returns the folder, a new one in the shared folder if none is given.
    """
    encoder = encoder or Bytes()
    folder = folder or fresh_path(docs.sparkSession, "shards")
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows if stable else materialise(rows)
    counts = {r["task"]: r["n"] for r in rows.mapInArrow(_counter(encoder, length), "task bigint, n bigint").collect()}
    before, total = {}, 0
    for task in sorted(counts):
        before[task] = (total, counts[task])
        total += counts[task]
    order = Feistel(total, key)
    numbered = rows.mapInArrow(
        _numberer(encoder, length, before, order), "slot bigint, ids binary, doc_ids array<bigint>")
    ranged = numbered.withColumn("shard", F.floor(F.col("slot") / shard_rows))
    written = ranged.groupBy("shard").applyInArrow(
        _writer(folder), "slot bigint, shard bigint, place bigint, doc_ids array<bigint>, file string")
    return written, folder


def read_slots(folder: str, first: int, count: int, length: int = LENGTH, shard_rows: int = SHARD_ROWS,
               dtype: str = "u1") -> Iterator[np.ndarray]:
    """Sequences from slot `first` on, read at their fixed places."""
    files, base = _filesystem(folder)
    stride = length * np.dtype(dtype).itemsize
    for shard in range(first // shard_rows, math.ceil((first + count) / shard_rows)):
        low, high = max(first, shard * shard_rows), min(first + count, (shard + 1) * shard_rows)
        with files.open_input_file(f"{base}/shard-{shard:08d}.bin") as source:
            source.seek((low - shard * shard_rows) * stride)
            data = source.read((high - low) * stride)
        yield from np.frombuffer(data, dtype).reshape(-1, length)
