"""Prefix trie of conversations: a node for every distinct sequence of first turns.

A turn becomes two 64-bit hashes of role and text and its number of words, so no text is ever shuffled. A prefix's
digest is the exclusive or of its turns' hashes, each mixed with its depth: 128 bits, and running over blocks of turns,
so one endless conversation is many tasks.

A count-min sketch screens the digests. Its cells are dealt out in buckets; a chunk of prefixes sends the cells it hits,
sorted and packed, and is told which of them nothing else hits. A prefix with such a cell is a singleton, and so is every
longer prefix of its conversation: these tails become nodes where they are. Only the other prefixes are shuffled and
grouped exactly, so a digest that the sketch could not clear costs one row and no error.

What a node needs of its subtree is added up per conversation, not along the tree: a conversation is the smallest
member of its nodes from some depth on. Before that depth it saves its words, and it counts as a leaf where its last
node has no child. So a node's figures are sums over its members, whatever the depth, with partial sums in each task.

Defined results: `conversation_turns` gives a null role or text as empty, a null turn before all others, and turns with
the same number in an order fixed by their content; rows without a conv_id belong to no conversation and are left out;
rows that repeat are turns of their own; an empty table gives no node, not even the root. Only conv_id, turn, role and
text are read, so other columns may have any names. The SHA-256 of a node's ends takes its ids in one order: they are
sorted in many tasks and pass as pieces of text through one, which holds one piece at a time.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loanloom.llm.bytestext import grouped, mix, pack, pack_bits, pack_planes, unpack, unpack_bits, unpack_planes
from loanloom.llm.packing import word_count
from loanloom.session import materialise

#: Turns that follow each other in one group.
BLOCK = 256
#: Rows of the sketch, cells per row for each prefix, prefixes of a chunk, and cells of a bucket.
SKETCH_ROWS, CELLS_PER_PREFIX = 2, 4
CHUNK_PREFIXES, BUCKET_CELLS = 200_000, 4_000_000
#: Bytes of joined ids that pass through a task at a time.
PIECE = 1 << 16
MESSAGE = "bucket int, chunk int, asked boolean, cells binary, counts binary"
NODE = ["depth", "high", "low"]
NO_ENDS = hashlib.sha256(b"").hexdigest()


def conversation_turns(conversations: DataFrame, block: int = BLOCK) -> DataFrame:
    """conv_id, place (from 1), first and second hash and words of every turn, by turn number."""
    text, role = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("text", "role"))
    turns = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"),
        F.xxhash64(role, text).alias("first"), F.xxhash64(text, F.lit("second"), role).alias("second"),
        word_count(text).cast("bigint").alias("words"),
    ).withColumn("block", F.floor(F.col("turn") / block))
    inside = Window.partitionBy("conv_id", "block").orderBy(F.col("turn").asc_nulls_first(), "first", "second")
    ranked = turns.withColumn("rank", F.row_number().over(inside))
    before = _before(turns.groupBy("conv_id", "block").agg(F.count(F.lit(1)).alias("size")), F.sum("size"), "earlier")
    same = (ranked["block"].eqNullSafe(before["block"])) & (ranked["conv_id"] == before["conv_id"])
    return ranked.join(before, same).select(
        ranked["conv_id"], (F.coalesce("earlier", F.lit(0)) + F.col("rank")).cast("bigint").alias("place"),
        "first", "second", "words")


def _before(blocks: DataFrame, value: Column, name: str) -> DataFrame:
    """`value` over the earlier blocks of each conversation."""
    earlier = Window.partitionBy("conv_id").orderBy(F.col("block").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    return blocks.select("conv_id", "block", value.over(earlier).alias(name))


def rebuilt(turns: DataFrame, every: int = 20, shared: int = 4) -> tuple[DataFrame, DataFrame]:
    """Conversations that begin like the first of their `every`: (conversation lengths, turns by depth).

    The first h turns of conversation c - c % every lead, then come c's own after its first h; h is the CRC-32 of the
    decimal c modulo `shared`.
    """
    own = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("own"))
    own = own.withColumns({
        "source": F.col("conv_id") - F.col("conv_id") % every, "h": F.crc32(F.col("conv_id").cast("string")) % shared})
    heads = turns.where((F.col("conv_id") % every == 0) & (F.col("place") < shared)).withColumnRenamed("conv_id", "source")
    sizes = heads.groupBy("source").agg(F.count(F.lit(1)).alias("head"))
    led = F.least("h", F.coalesce("head", F.lit(0)))
    own = own.join(sizes, "source", "left").select(
        "conv_id", "source", "h", led.alias("led"), (led + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("length"))
    lead = own.join(heads, "source").where("place <= led").select("conv_id", F.col("place").alias("depth"), "first", "second", "words", "length")
    rest = turns.join(own, "conv_id").where("place > h").select(
        "conv_id", (F.col("place") - F.col("h") + F.col("led")).alias("depth"), "first", "second", "words", "length")
    return own.select("conv_id", "length"), lead.unionByName(rest)


def prefixes_of(turns: DataFrame, block: int = BLOCK) -> DataFrame:
    """Every prefix: conv_id, depth, digest (high, low), the digest without its last turn, words of that turn and in all."""
    rows = turns.withColumns({
        "a": F.xxhash64("first", "depth"), "b": F.xxhash64("second", "depth"), "block": F.floor(F.col("depth") / block)})
    until = Window.partitionBy("conv_id", "block").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    inside = rows.select("*", F.bit_xor("a").over(until).alias("in_a"), F.bit_xor("b").over(until).alias("in_b"),
                         F.sum("words").over(until).alias("in_words"))
    blocks = rows.groupBy("conv_id", "block").agg(
        F.bit_xor("a").alias("a"), F.bit_xor("b").alias("b"), F.sum("words").alias("words"))
    earlier = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(
        "conv_id", "block", *[F.coalesce(f.over(earlier), F.lit(0)).alias(n) for f, n in
                              ((F.bit_xor("a"), "on_a"), (F.bit_xor("b"), "on_b"), (F.sum("words"), "on_words"))])
    whole = inside.join(blocks, ["conv_id", "block"])
    high, low = F.col("in_a").bitwiseXOR(F.col("on_a")), F.col("in_b").bitwiseXOR(F.col("on_b"))
    return whole.select(
        "conv_id", "depth", high.alias("high"), low.alias("low"), high.bitwiseXOR(F.col("a")).alias("up_high"),
        low.bitwiseXOR(F.col("b")).alias("up_low"), "words", (F.col("in_words") + F.col("on_words")).alias("total"), "length")


class Sketch:
    """A count-min sketch for about `prefixes` digests, its cells in buckets."""

    def __init__(self, prefixes: int):
        self.width = 1 << max(10, math.ceil(math.log2(CELLS_PER_PREFIX * max(prefixes, 1))))
        self.buckets = max(1, math.ceil(self.width * SKETCH_ROWS / BUCKET_CELLS))
        self.chunks = max(1, math.ceil(prefixes / CHUNK_PREFIXES))

    def _cells(self, table: pa.Table) -> np.ndarray:
        """One cell per prefix and row of the sketch; rows use disjoint numbers."""
        keys = table["cell"].to_numpy().view(np.uint64)
        rows = [np.uint64(i) for i in range(SKETCH_ROWS)]
        return np.stack([mix(keys + i) % np.uint64(self.width) + i * np.uint64(self.width) for i in rows])

    def ask(self, table: pa.Table) -> pa.Table:
        cells, _, which = grouped(self._cells(table).ravel())
        counts = np.bincount(which, minlength=len(cells))
        cuts = np.searchsorted(cells, np.arange(self.buckets + 1, dtype=np.uint64) * np.uint64(BUCKET_CELLS))
        chunk = table["chunk"][0].as_py()
        return _messages([
            (b, chunk, True, pack(cells[lo:hi]), pack_planes(counts[lo:hi].astype(np.uint64)))
            for b, (lo, hi) in enumerate(zip(cuts[:-1], cuts[1:])) if lo < hi])

    @staticmethod
    def tell(table: pa.Table) -> pa.Table:
        """Adds up the counters of a bucket and marks, for each chunk, its cells that count one."""
        asked = [(b, c, unpack(cells), unpack_planes(counts)) for b, c, _, cells, counts in zip(*table.to_pydict().values())]
        cells, _, which = grouped(np.concatenate([a[2] for a in asked]))
        counters = np.bincount(which, weights=np.concatenate([a[3] for a in asked]), minlength=len(cells))
        single = np.split(counters[which] == 1, np.cumsum([len(a[2]) for a in asked])[:-1])
        return _messages([(b, c, False, pack_bits(s), b"") for (b, c, *_), s in zip(asked, single)])

    def screen(self, left: pa.Table, right: pa.Table) -> pa.Table:
        """The prefixes of a chunk with `alone`: whether their estimate is one."""
        told = sorted(zip(right["bucket"].to_pylist(), right["cells"].to_pylist()))
        single = np.concatenate([unpack_bits(bits) for _, bits in told])
        cells, _, which = grouped(self._cells(left).ravel())
        alone = single[which].reshape(SKETCH_ROWS, -1).any(axis=0)
        return left.drop_columns(["chunk", "cell"]).append_column("alone", pa.array(alone))


def _messages(rows: list[tuple]) -> pa.Table:
    columns = list(zip(*rows)) if rows else [[]] * 5
    kinds = [pa.int32(), pa.int32(), pa.bool_(), pa.binary(), pa.binary()]
    return pa.table([pa.array(c, k) for c, k in zip(columns, kinds)], names="bucket chunk asked cells counts".split())


def screened(prefixes: DataFrame, count: int) -> DataFrame:
    """`prefixes` with `alone`, true only for prefixes of a single conversation."""
    sketch = Sketch(count)
    schema = prefixes.schema.add("alone", "boolean")
    rows = prefixes.withColumn("cell", F.xxhash64("depth", "high", "low"))
    rows = rows.withColumn("chunk", F.pmod(F.xxhash64("conv_id", F.floor(F.col("depth") / BLOCK)), F.lit(sketch.chunks)).cast("int"))
    chunks = rows.groupBy("chunk")
    told = chunks.applyInArrow(lambda t: sketch.ask(t), MESSAGE).groupBy("bucket").applyInArrow(lambda t: sketch.tell(t), MESSAGE)
    return chunks.cogroup(told.groupBy("chunk")).applyInArrow(lambda l, r: sketch.screen(l, r), schema)


def trie(lengths: DataFrame, turns: DataFrame) -> DataFrame:
    """The nodes of conversations given by their lengths and turns: conv_id, depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens and ends_sha256."""
    lengths, prefixes = materialise(lengths), materialise(prefixes_of(turns))
    rows = materialise(screened(prefixes, prefixes.count()))
    # From `tail` on a conversation is alone; past its end where it never is.
    tails = rows.where("alone").groupBy("conv_id").agg(F.min("depth").alias("tail"))
    known = lengths.join(tails, "conv_id", "left").withColumn("tail", F.coalesce("tail", F.col("length") + 1))
    open_rows = materialise(rows.join(known.select("conv_id", "tail"), "conv_id").where("depth < tail").drop("alone"))

    nodes = open_rows.groupBy(*NODE).agg(F.min("conv_id").alias("least"), F.max("length").alias("longest"))
    placed = open_rows.join(nodes, NODE)
    other = F.col("conv_id") != F.col("least")
    ends_here = ~other & (F.col("depth") == F.col("length")) & (F.col("longest") == F.col("length"))
    per_conv = placed.groupBy("conv_id").agg(
        F.max(F.when(other, F.col("depth"))).alias("under"), F.max(F.when(other, F.col("total"))).alias("saves"),
        F.max(ends_here).alias("ends_here"))
    # Down to depth `under` the conversation is not the smallest member of its nodes and saves `saves` words in all.
    convs = materialise(known.join(per_conv, "conv_id", "left").select(
        "conv_id", "length", "tail", F.coalesce("under", F.lit(0)).alias("under"), F.coalesce("saves", F.lit(0)).alias("saves"),
        ((F.col("tail") <= F.col("length")) | F.coalesce("ends_here", F.lit(False))).alias("leaf")))

    ends = ends_of(open_rows.where("depth = length").select(*NODE, "conv_id").unionByName(
        convs.where("length = 0").select(F.lit(0).cast("bigint").alias("depth"), F.lit(0).cast("bigint").alias("high"),
                                         F.lit(0).cast("bigint").alias("low"), "conv_id")))
    inner = open_rows.join(convs.select("conv_id", "under", "saves", "leaf"), "conv_id").groupBy(*NODE).agg(
        F.min("conv_id").alias("conv_id"), F.first("up_high").alias("up_high"), F.first("up_low").alias("up_low"),
        F.count(F.lit(1)).alias("n_convs"),
        F.count_if((F.col("under") <= F.col("depth")) & (F.col("depth") < F.col("length"))).alias("n_children"),
        F.count_if("leaf").alias("n_leaves"),
        F.sum(F.greatest(F.col("saves") - F.col("total") + F.col("words"), F.lit(0))).alias("saved_tokens"))
    root = convs.agg(
        F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"),
        F.count_if((F.col("under") == 0) & (F.col("length") > 0)).alias("n_children"),
        F.greatest(F.count_if("leaf"), F.lit(1)).alias("n_leaves"), F.sum("saves").alias("saved_tokens"),
    ).where("n_convs > 0").withColumns({c: F.lit(0).cast("bigint") for c in NODE} | {c: F.lit(None).cast("bigint") for c in ("up_high", "up_low")})
    grouped_nodes = materialise(inner.unionByName(root, allowMissingColumns=True))
    first_of_tail = rows.join(convs.where("tail <= length").select("conv_id", "tail", "length"), ["conv_id", "length"])
    tail_rows = first_of_tail.where("depth >= tail").select(
        *NODE, "conv_id", "up_high", "up_low", F.lit(1).cast("bigint").alias("n_convs"),
        (F.col("depth") < F.col("length")).cast("bigint").alias("n_children"), F.lit(1).cast("bigint").alias("n_leaves"),
        F.lit(0).cast("bigint").alias("saved_tokens"), (F.col("depth") > F.col("tail")).alias("inside"),
        F.when(F.col("depth") == F.col("length"), F.sha2(F.col("conv_id").cast("string"), 256)).otherwise(NO_ENDS).alias("ends_sha256"))

    # Parents are looked up for grouped nodes and for the first node of each tail only.
    parents = grouped_nodes.select((F.col("depth") + 1).alias("depth"), F.col("high").alias("up_high"), F.col("low").alias("up_low"),
                                   F.col("conv_id").alias("parent_conv_id"))
    above = ["depth", "up_high", "up_low"]
    whole = grouped_nodes.join(ends, NODE, "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(NO_ENDS)))
    looked_up = whole.unionByName(tail_rows.where("NOT inside").drop("inside")).join(parents, above, "left")
    inside = tail_rows.where("inside").drop("inside").withColumn("parent_conv_id", F.col("conv_id"))
    columns = "conv_id depth parent_conv_id n_convs n_children n_leaves saved_tokens ends_sha256".split()
    return looked_up.select(columns).unionByName(inside.select(columns))


def ends_of(members: DataFrame) -> DataFrame:
    """ends_sha256 of each node: the SHA-256 of its conv_ids, ascending and joined by commas."""
    ordered = members.repartitionByRange(*NODE, "conv_id").sortWithinPartitions(*NODE, "conv_id")
    pieces = ordered.mapInArrow(_join_ids, "depth bigint, high bigint, low bigint, conv_id bigint, ids string")
    streams = pieces.repartition(*NODE).sortWithinPartitions(*NODE, "conv_id")
    return streams.mapInArrow(_digest, "depth bigint, high bigint, low bigint, ends_sha256 string")


def _runs(batches, *columns):
    """Node and column values of each run of rows of the same node, batch by batch."""
    for batch in batches:
        keys = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in NODE])
        cuts = np.concatenate([[0], np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1, [keys.shape[1]]])
        values = [batch.column(c).to_pylist() for c in columns]
        for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            if lo < hi:
                yield tuple(keys[:, lo].tolist()), [v[lo:hi] for v in values]


def _join_ids(batches):
    """One row for each run of ids, with the ids joined; long runs as several rows."""
    step = PIECE // 20
    rows = []
    for node, (ids,) in _runs(batches, "conv_id"):
        rows += [(*node, ids[at], ",".join(map(str, ids[at:at + step]))) for at in range(0, len(ids), step)]
        if len(rows) > 1000:
            yield _rows(rows, [*NODE, "conv_id", "ids"])
            rows = []
    yield _rows(rows, [*NODE, "conv_id", "ids"])


def _digest(batches):
    """SHA-256 per node over its pieces, which arrive in order."""
    node, state, done = None, None, []
    for now, (pieces,) in _runs(batches, "ids"):
        if now != node:
            if node is not None:
                done.append((*node, state.hexdigest()))
            node, state = now, hashlib.sha256()
        else:
            state.update(b",")
        state.update(",".join(pieces).encode())
        if len(done) > 10_000:
            yield _rows(done, [*NODE, "ends_sha256"])
            done = []
    if node is not None:
        done.append((*node, state.hexdigest()))
    yield _rows(done, [*NODE, "ends_sha256"])


def _rows(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[]] * len(names)
    kinds = [pa.string() if n in ("ids", "ends_sha256") else pa.int64() for n in names]
    return pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds)], names)


def rebuilt_trie(conversations: DataFrame) -> DataFrame:
    """The trie of the conversations as `rebuilt` gives them."""
    turns = materialise(conversation_turns(conversations))
    return trie(*rebuilt(turns))
