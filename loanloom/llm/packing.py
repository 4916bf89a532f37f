"""Packing: length buckets chosen by dynamic programming, token-budget batches inside each bucket.

A token is a word `[^\\x20\\x09-\\x0D]+`, or whatever the column given as `tokens` counts. A document becomes
sequences of at most `max_tokens` tokens: full pieces and a rest. The global histogram of sequence lengths has at
most `max_tokens` rows, so the driver may read it; on it a dynamic program finds the bucket boundaries with the
least padding in total. Each sequence is padded to its bucket's boundary, and a batch takes as many as the token
budget allows. Numbers inside a bucket come from counts per shard of a bucket, not from one sorted task, so a
bucket may hold any share of the rows.

Defined results: a document without tokens (null, empty, white space) gives no sequence; rows that repeat are
documents of their own; a null doc_id is kept; an empty table gives an empty result. Only doc_id and text are
read, so other columns may have any names.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MAX_TOKENS = 2048
BUCKETS = 8
TOKEN_BUDGET = 65_536
#: Sequences numbered together; one window group of a bucket holds about so many at most.
SHARD_ROWS = 50_000
LEAST_SHARDS = 64


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"))


def sequences(docs: DataFrame, max_tokens: int = MAX_TOKENS, tokens: Column | None = None) -> DataFrame:
    """doc_id, piece, start_token, n_tokens and an order that the row itself fixes."""
    counted = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        (word_count(F.col("text")) if tokens is None else tokens).cast("bigint").alias("_total"),
        F.xxhash64("doc_id", "text").alias("_key"),
    ).where("_total > 0")
    pieces = counted.withColumn("piece", F.explode(F.expr(f"sequence(0L, (_total - 1) DIV {max_tokens})")))
    return pieces.select(
        "doc_id", "piece", (F.col("piece") * max_tokens).alias("start_token"),
        F.least(F.lit(max_tokens), F.col("_total") - F.col("piece") * max_tokens).alias("n_tokens"),
        F.xxhash64("_key", "piece").alias("_order"))


def length_histogram(rows: DataFrame) -> dict[int, int]:
    """Count per sequence length; at most `max_tokens` entries."""
    return {r["n_tokens"]: r["n"] for r in rows.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n")).collect()}


def boundaries(histogram: dict[int, int], buckets: int = BUCKETS) -> list[int]:
    """Upper lengths of at most `buckets` buckets with the least total padding."""
    lengths = np.array(sorted(histogram), dtype=np.int64)
    if not len(lengths):
        return []
    count = np.concatenate([[0], np.cumsum([histogram[n] for n in lengths])]).astype(np.float64)
    total = np.concatenate([[0], np.cumsum([histogram[n] * n for n in lengths.tolist()])]).astype(np.float64)
    # padding[i, j]: lengths i..j (by rank) padded to length j.
    padding = lengths[None, :] * (count[None, 1:] - count[:-1, None]) - (total[None, 1:] - total[:-1, None])
    padding[np.tril_indices(len(lengths), -1)] = np.inf
    best, cuts = padding[0].copy(), []
    for _ in range(min(buckets, len(lengths)) - 1):
        tried = best[:-1, None] + padding[1:, :]
        came = tried.argmin(axis=0)
        value = tried[came, np.arange(len(lengths))]
        better = value < best
        cuts.append(np.where(better, came, -1))
        best = np.where(better, value, best)
    ends, j = [], len(lengths) - 1
    for cut in [*reversed(cuts), None]:
        if cut is None or cut[j] >= 0:
            ends.append(int(lengths[j]))
            if cut is not None:
                j = int(cut[j])
    return sorted(set(ends))


def pack(docs: DataFrame, max_tokens: int = MAX_TOKENS, buckets: int = BUCKETS, token_budget: int = TOKEN_BUDGET,
         tokens: Column | None = None) -> DataFrame:
    """doc_id, piece, start_token, n_tokens, bucket, bucket_tokens, batch (within the bucket) and slot."""
    rows = sequences(docs, max_tokens, tokens)
    histogram = length_histogram(rows)
    ends = boundaries(histogram, buckets) or [max_tokens]
    shards = max(LEAST_SHARDS, math.ceil(sum(histogram.values()) / SHARD_ROWS))
    edges = F.array(*[F.lit(int(e)) for e in ends])
    rows = rows.withColumn("bucket", F.size(F.filter(edges, lambda e: e < F.col("n_tokens"))))
    rows = rows.withColumns({
        "bucket_tokens": F.element_at(edges, F.col("bucket") + 1), "_shard": F.pmod("_order", F.lit(shards))})
    shard = Window.partitionBy("bucket", "_shard")
    numbered = rows.withColumn("_place", F.row_number().over(shard.orderBy("_order", "doc_id", "piece", "n_tokens")))
    counts = rows.groupBy("bucket", "_shard").agg(F.count(F.lit(1)).alias("_rows"))
    # As many rows as shards in a bucket.
    before = Window.partitionBy("bucket").orderBy("_shard").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("bucket", "_shard", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"))
    index = F.col("_before") + F.col("_place") - 1
    per_batch = F.greatest(F.lit(1), F.floor(F.lit(token_budget) / F.col("bucket_tokens")))
    return numbered.join(offsets, ["bucket", "_shard"]).select(
        "doc_id", "piece", "start_token", "n_tokens", "bucket", "bucket_tokens",
        F.floor(index / per_batch).alias("batch"), (index % per_batch).alias("slot"))
