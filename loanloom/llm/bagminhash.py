"""MinHash near-dedup with BagMinHash signatures of shingle multisets.

A text is the multiset of its 5-word shingles. Similarity is weighted Jaccard: the sum of the smaller counts over
the sum of the larger. BagMinHash draws the same Poisson points for a shingle in every document: weights are
levels (0, 1], (1, 2], (2, 4], (4, 8], ..., each a process of its own that is split in halves, down to unit
levels, only where a document's weight ends inside it. A point belongs to the documents whose weight reaches its
level, and each of the signature's components keeps the earliest of its points. Points come in order of time, so
a document stops once no later point can win; most shingles need one or two points whatever the signature's
length. Two documents agree in a component with the probability of their weighted Jaccard similarity.

Steps: equal texts become one node; bands of the signature name buckets; in each bucket, and in each finer bucket
of two or three adjoining bands, the node that meets most others leads, and every node is verified against the
LEADERS greatest of its leaders on the exact multisets; links grow to components. Where a bucket still holds several components, its members
outside the largest one are compared with all members, block by block, each pair in the first bucket that it shares,
until each has a verified link to a component or none of its members is left. So no two linked texts of different classes
remain, though a hot group is never compared pair by pair. A pair is verified only if its signatures agree in 55 % of
the components, six standard deviations under the threshold. With 24 bands of 4 a pair at 0.8 meets with a
probability of 0.999997.

Defined results: words are `[^\\x20\\x09-\\x0D]+`, unchanged; a text of fewer than five words is one shingle of
them all; a text without words is in no pair, but equal texts always share a class; a null text is empty; the
class is named by its smallest doc_id, null only if all are null; rows that repeat a doc_id are rows of their
own. Only doc_id and text are read, so other columns may have any names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loanloom.llm.bytestext import Texts, mix, runs, texts_of, word_hashes, words_of
from loanloom.llm.components import components
from loanloom.llm.grams import drop_finished_shuffles
from loanloom.session import materialise

SHINGLE = 5
THRESHOLD = 0.8
BANDS, ROWS = 24, 4
#: Adjoining bands that name a bucket in which a leader is chosen.
LEADER_BANDS = (1, 2, 3)
#: Agreement of signatures below which a pair isn't verified.
LEAST_AGREEMENT = 0.55
#: Leaders that a node is verified with, those that meet most others.
LEADERS = 6
#: Members of an open bucket that a task compares with as many others.
BLOCK_NODES = 1000
SIGNATURE = "node binary, n_shingles bigint, signature binary"
_LOW = np.uint64(2**32 - 1)


def shingles(texts: Texts, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Document index and hash of every shingle."""
    first, last, doc = words_of(texts)
    hashes = word_hashes(texts.data, first, last)
    counts = np.bincount(doc, minlength=len(texts))
    ends = np.cumsum(counts)
    left = ends[doc] - np.arange(len(doc)) if len(doc) else np.zeros(0, np.int64)
    full = np.flatnonzero(left >= size)
    keys, owners = runs(hashes, size)[full] if len(full) else np.zeros(0, np.uint64), doc[full]
    short = np.flatnonzero((counts > 0) & (counts < size))
    whole = np.array([runs(hashes[ends[i] - counts[i]:ends[i]], int(counts[i]))[0] for i in short], np.uint64)
    keys, owners = np.concatenate([keys, mix(whole + np.uint64(1))]), np.concatenate([owners, short])
    return owners.astype(np.int64), keys


def multiset(owners: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, shingle and count, by document."""
    order = np.argsort(keys)
    order = order[np.argsort(owners[order], kind="stable")]
    owners, keys = owners[order], keys[order]
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (owners[1:] != owners[:-1])
    first = np.flatnonzero(new)
    return owners[first], keys[first], np.diff(np.append(first, len(keys)))


def _draw(seed: np.ndarray, rate: np.ndarray | float, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Waiting time of a Poisson process and the component of its point, fixed by the seed."""
    bits = mix(seed)
    wait = -np.log1p(-((bits >> np.uint64(11)).astype(np.float64) * 2.0**-53)) / rate
    return wait, (((mix(bits) & _LOW) * np.uint64(size)) >> np.uint64(32)).astype(np.int64)


def _level_seed(keys: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    return mix(keys ^ mix((low.astype(np.uint64) << np.uint64(32)) | high.astype(np.uint64)))


def signatures(n_docs: int, owners: np.ndarray, keys: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    """The earliest time in each component, n_docs x size; infinite for an empty multiset."""
    best = np.full((n_docs, size), np.inf)
    flat = best.reshape(-1)
    # Open levels: who, shingle, weight, (low, high], seed, time, component, whether the point is counted.
    octaves = np.ceil(np.log2(np.maximum(counts, 1))).astype(np.int64) + 1
    who = np.repeat(np.arange(len(counts)), octaves)
    step = np.arange(len(who)) - np.repeat(np.cumsum(octaves) - octaves, octaves)
    high = np.left_shift(1, step)
    low = np.where(step == 0, 0, high >> 1)
    doc, weight, seed = owners[who], counts[who], _level_seed(keys[who], low, high)
    time, part = _draw(seed, (high - low) * float(size), size)
    new, nth = np.ones(len(who), bool), np.zeros(len(who), np.uint64)
    key = keys[who]
    while len(doc):
        counted = new & (high <= weight)
        np.minimum.at(flat, doc[counted] * size + part[counted], time[counted])
        new = new & ~counted
        on = (time < best.max(axis=1)[doc]) & (low < weight)
        doc, key, weight, low, high, seed, time, part, new, nth = (
            x[on] for x in (doc, key, weight, low, high, seed, time, part, new, nth))
        unit = high - low == 1
        # A unit level goes on to its next point.
        nth_u = nth[unit] + np.uint64(1)
        wait, part_u = _draw(seed[unit] + nth_u * np.uint64(0x9E3779B97F4A7C15), float(size), size)
        units = (doc[unit], key[unit], weight[unit], low[unit], high[unit], seed[unit], time[unit] + wait, part_u,
                 np.ones(len(nth_u), bool), nth_u)
        if unit.all():
            doc, key, weight, low, high, seed, time, part, new, nth = units
            continue
        # A wider level is split: one half inherits its point, the other draws its own.
        w = ~unit
        middle = (low[w] + high[w]) >> 1
        goes_low = (mix(seed[w] + np.uint64(1)) >> np.uint64(63)) == 0
        halves = [units]
        for lo, hi, owns in ((low[w], middle, goes_low), (middle, high[w], ~goes_low)):
            own_seed = _level_seed(key[w], lo, hi)
            wait, own_part = _draw(own_seed, (hi - lo) * float(size), size)
            halves.append((doc[w], key[w], weight[w], lo, hi, own_seed, np.where(owns, time[w], time[w] + wait),
                           np.where(owns, part[w], own_part), np.where(owns, new[w], True), nth[w]))
        doc, key, weight, low, high, seed, time, part, new, nth = (np.concatenate(c) for c in zip(*halves))
    return best


def _node(text: Column) -> Column:
    """16 bytes of the text's SHA-256: equal texts are one node."""
    return F.unhex(F.substring(F.sha2(F.coalesce(text, F.lit("")), 256), 1, 32))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches cut so that their texts stay near 512 KB; a longer text is a block of its own."""
    for batch in batches:
        size = np.cumsum(texts_of(batch.column("text")).lengths)
        at = 0
        while at < batch.num_rows:
            base = size[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(size, base + (1 << 19), side="right")))
            yield batch.slice(at, to - at)
            at = to


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _blocks(batches):
        texts = texts_of(batch.column("text"))
        owners, keys = shingles(texts)
        total = np.bincount(owners, minlength=len(texts))
        times = signatures(len(texts), *multiset(owners, keys), BANDS * ROWS)
        short = (mix(times.view(np.uint64)) >> np.uint64(32)).astype("<u4")
        yield pa.RecordBatch.from_arrays(
            [batch.column("node"), pa.array(total.astype(np.int64)), pa.array([row.tobytes() for row in short], pa.binary())],
            names=["node", "n_shingles", "signature"])


def _shingle_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The multiset as ascending distinct keys: the k-th occurrence of a shingle has a key of its own."""
    for batch in _blocks(batches):
        texts = texts_of(batch.column("text"))
        owners, keys, counts = multiset(*shingles(texts))
        nth = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        keys, owners = mix(np.repeat(keys, counts) + nth.astype(np.uint64)), np.repeat(owners, counts)
        cuts = np.searchsorted(owners, np.arange(len(texts) + 1))
        sets = [np.sort(keys[lo:hi]).tobytes() for lo, hi in zip(cuts[:-1], cuts[1:])]
        yield pa.RecordBatch.from_arrays(
            [batch.column("node"), batch.column("signature"), pa.array(sets, pa.binary())], names=["node", "signature", "items"])


def _similarity(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = [
            _jaccard(*(np.frombuffer(v.as_buffer(), np.uint64) for v in pair))
            for pair in zip(batch.column("items_a"), batch.column("items_b"))]
        yield pa.RecordBatch.from_arrays(
            [batch.column("a"), batch.column("b"), pa.array(out, pa.float64())], names=["a", "b", "similarity"])


def _block(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Signatures, numbers of the components, which rows are outer, and the band of a block of an open bucket."""
    signed = np.frombuffer(b"".join(table["signature"].to_pylist()), "<u4").reshape(table.num_rows, -1)
    roots = table["root"].combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)
    return signed, roots, table["outer"].to_numpy(), table["band"][0].as_py()


def _candidates(signed: np.ndarray, roots: np.ndarray, inner: np.ndarray, x: int, band: int) -> tuple[np.ndarray, np.ndarray]:
    """Members of other components that are similar enough to `x` and share no earlier band with it, the best first."""
    same = signed[inner] == signed[x]
    agreement = same.mean(axis=1)
    first = same.reshape(len(inner), BANDS, ROWS).all(axis=2).argmax(axis=1) == band
    close = np.flatnonzero((agreement >= LEAST_AGREEMENT) & (roots[inner] != roots[x]) & first)
    close = close[np.argsort(-agreement[close], kind="stable")]
    return inner[close], agreement[close]


def _link_across(table: pa.Table) -> pa.Table:
    """One verified link from each outer node of a block to each other component that has one in the block."""
    items = [np.frombuffer(v.as_buffer(), np.uint64) for v in table["items"].combine_chunks()]
    signed, roots, outer, band = _block(table)
    node = table["node"].to_pylist()
    inner = np.flatnonzero(~outer)
    out: set[tuple[bytes, bytes]] = set()
    for x in np.flatnonzero(outer):
        met: set[int] = set()
        for y in _candidates(signed, roots, inner, x, band)[0]:
            if roots[y] not in met and _jaccard(items[x], items[y]) >= THRESHOLD:
                met.add(roots[y])
                out.add((min(node[x], node[y]), max(node[x], node[y])))
    pairs = sorted(out)
    return pa.table([pa.array([p[i] for p in pairs], pa.binary()) for i in (0, 1)], names=["a", "b"])


def _jaccard(one: np.ndarray, two: np.ndarray) -> float:
    both = np.concatenate([one, two])
    both.sort()
    common = int((both[1:] == both[:-1]).sum())
    return common / (len(both) - common) if len(both) else 0.0


def _agreement(one: str, two: str) -> Column:
    return F.expr(
        f"size(filter(sequence(0, {BANDS * ROWS - 1}), i -> substring({one}, 4 * i + 1, 4) = substring({two}, 4 * i + 1, 4)))"
    ) / F.lit(BANDS * ROWS)


def _written(df: DataFrame) -> DataFrame:
    """`df` in the shared folder, without the shuffle files that led to it."""
    stored = materialise(df)
    drop_finished_shuffles(df.sparkSession)
    return stored


class NearCopies:
    """Nodes, buckets and verified links of one table of documents."""

    def __init__(self, docs: DataFrame):
        docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
        self.rows = docs.select("doc_id", _node(F.col("text")).alias("node"))
        self.texts = docs.select(_node(F.col("text")).alias("node"), F.coalesce("text", F.lit("")).alias("text"))
        # Equal texts have equal signatures: copies meet inside each task before any shuffle.
        signed = self.texts.mapInArrow(_sign, SIGNATURE)
        self.nodes = _written(signed.groupBy("node").agg(
            F.max("n_shingles").alias("n_shingles"), F.max("signature").alias("signature")))
        self.buckets = _written(self._buckets())
        self.sets = _written(self._sets())

    def _buckets(self) -> DataFrame:
        """bucket, band, node and degree for nodes that share a bucket; degree is the sum of a node's bucket sizes."""
        band = F.expr(
            f"transform(sequence(0, {BANDS - 1}), i -> xxhash64(i, substring(signature, i * {4 * ROWS} + 1, {4 * ROWS})))")
        banded = self.nodes.where("n_shingles > 0").select("node", F.posexplode(band).alias("band", "bucket"))
        shared = banded.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
        members = banded.join(shared, "bucket")
        degree = members.groupBy("node").agg(F.sum("size").alias("degree"))
        return members.drop("size").join(degree, "node").select("bucket", "band", "node", "degree")

    def _sets(self) -> DataFrame:
        """Signature and shingle multiset of the nodes that are in some bucket."""
        wanted = self.nodes.join(self.buckets.select("node").distinct(), "node", "left_semi").select("node", "signature")
        texts = self.texts.groupBy("node").agg(F.max("text").alias("text")).join(wanted, "node")
        return texts.mapInArrow(_shingle_sets, "node binary, signature binary, items binary")

    def verified(self, pairs: DataFrame) -> DataFrame:
        """Distinct pairs (a, b) with their exact similarity, without those whose signatures differ too much."""
        for side in "ab":
            signed = self.sets.select(F.col("node").alias(side), F.col("signature").alias(f"s_{side}"))
            pairs = pairs.join(signed, side)
        close = pairs.where(_agreement("s_a", "s_b") >= LEAST_AGREEMENT).select("a", "b")
        for side in "ab":
            close = close.join(self.sets.select(F.col("node").alias(side), F.col("items").alias(f"items_{side}")), side)
        return close.select("a", "b", "items_a", "items_b").mapInArrow(_similarity, "a binary, b binary, similarity double")

    def _led(self) -> DataFrame:
        """Distinct pairs (a, b) of a node and its greatest leaders. A node has few pairs however many buckets it is in."""
        known = self.buckets.select("node", "degree").distinct().join(self.nodes, "node")
        led = None
        for wide in LEADER_BANDS:
            names = F.expr(
                f"transform(sequence(0, {BANDS - wide}), i -> "
                f"xxhash64(i, substring(signature, i * {4 * ROWS} + 1, {4 * ROWS * wide})))")
            members = known.select("node", "degree", F.explode(names).alias("bucket"))
            leaders = members.groupBy("bucket").agg(F.max(F.struct("degree", "node")).alias("leader"))
            here = members.join(leaders, "bucket").where("node <> leader.node").select("node", "leader")
            led = here if led is None else led.unionByName(here)
        place = F.row_number().over(Window.partitionBy("node").orderBy(F.desc("leader.degree"), F.desc("leader.node")))
        greatest = led.distinct().withColumn("place", place).where(F.col("place") <= LEADERS)
        return greatest.select(
            F.least("node", "leader.node").alias("a"), F.greatest("node", "leader.node").alias("b")).distinct()

    def _open_blocks(self, classes: DataFrame) -> DataFrame:
        """The members of buckets with several components, in blocks: all of them, and (outer) those outside the largest one."""
        labelled = self.buckets.join(classes, "node", "left").select(
            "bucket", "band", "node", F.coalesce("root", "node").alias("root"))
        parts = labelled.groupBy("bucket", "root").agg(F.count(F.lit(1)).alias("n"))
        open_buckets = parts.groupBy("bucket").agg(
            F.max(F.struct("n", "root")).alias("main"), F.sum("n").alias("n")).where("n > main.n").select(
            "bucket", F.col("main.root").alias("main"),
            F.ceil(F.col("n") / BLOCK_NODES).alias("blocks"),
            F.ceil((F.col("n") - F.col("main.n")) / BLOCK_NODES).alias("outer_blocks"))
        members = labelled.join(open_buckets, "bucket")
        every = members.select(
            "bucket", "band", "node", "root", F.lit(False).alias("outer"), F.pmod(F.xxhash64("node"), "blocks").alias("block"),
            F.explode(F.expr("sequence(0L, outer_blocks - 1)")).alias("outer_block"))
        outer = members.where("root <> main").select(
            "bucket", "band", "node", "root", F.lit(True).alias("outer"), F.explode(F.expr("sequence(0L, blocks - 1)")).alias("block"),
            F.pmod(F.xxhash64("node"), "outer_blocks").alias("outer_block"))
        return every.unionByName(outer).join(self.sets, "node")

    def _across(self, classes: DataFrame) -> DataFrame:
        """Verified links (a, b) between members of a bucket that are in different components so far."""
        blocks = self._open_blocks(classes)
        return blocks.groupBy("bucket", "block", "outer_block").applyInArrow(_link_across, "a binary, b binary").distinct()

    def links(self) -> tuple[DataFrame, DataFrame]:
        """Verified links that connect every class, and the classes (node, root) of linked nodes."""
        tested = _written(self.verified(self._led()))
        links = tested.where(F.col("similarity") >= THRESHOLD).select("a", "b")
        classes = components(links)
        more = _written(self._across(classes))
        if more.isEmpty():
            return links, classes
        links = links.unionByName(more)
        return links, components(links)

    def classes(self) -> DataFrame:
        """node, class_id, class_size and first (the node whose row stands for the class) of every node."""
        _, linked = self.links()
        smallest = self.rows.groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("n"))
        rooted = smallest.join(linked, "node", "left").withColumn("root", F.coalesce("root", "node"))
        named = rooted.groupBy("root").agg(
            F.min("doc_id").alias("class_id"), F.sum("n").alias("class_size"),
            F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "node"))["node"].alias("first"))
        return _written(rooted.join(named, "root").select("node", "class_id", "class_size", "first"))


def near_copies(docs: DataFrame) -> DataFrame:
    """doc_id, class_id and class_size of every row of `docs`."""
    found = NearCopies(docs)
    return found.rows.join(found.classes(), "node").select("doc_id", "class_id", "class_size")


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """One row of each class, with all its columns: the one with the class's smallest doc_id.

    Rows equal in doc_id and text count once. Columns may have any names but `_node` and `_id`.
    """
    none = F.lit(-(2**63))
    stay = NearCopies(docs).classes().where("node = first").select(
        F.col("node").alias("_node"), F.coalesce("class_id", none).alias("_id"))
    keyed = docs.withColumns({"_node": _node(F.col("text")), "_id": F.coalesce(F.col("doc_id").cast("bigint"), none)})
    return keyed.join(stay, ["_node", "_id"], "left_semi").dropDuplicates(["_node", "_id"]).select(docs.columns)
