"""Stratified split and ranked lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def split_token(key: str, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(key)))


def stratified_split(df: DataFrame, label: str, key: str, test_size: float = 0.2, seed: int = 42) -> DataFrame:
    """Adds `slice`: the `test_size` share of each class with the smallest token is 'test', the rest 'train'.

    Ranking a whole class would sort it in one task. Instead each class is counted by the first four
    hex digits of the token, which fixes the one bucket where its quota ends; only that bucket, a
    65,536th of the class, is ranked. The result is one cut-off row per class, so the broadcast is
    bounded by the number of classes.
    """
    tokens = df.select(label, F.col(key).alias("_key"), split_token(key, seed).alias("_token"))
    prefix = F.substring("_token", 1, 4)
    buckets = tokens.groupBy(label, prefix.alias("_bucket")).agg(F.count("*").alias("_n"))
    running = Window.partitionBy(label).orderBy("_bucket")
    whole = Window.partitionBy(label)
    boundary = (
        buckets.select(
            label, "_bucket", "_n",
            F.sum("_n").over(running).alias("_through"),
            F.floor(F.sum("_n").over(whole) * test_size).alias("_quota"),
        )
        .where("_through >= _quota AND _through - _n < _quota")
        .select(F.col(label).alias("_label"), F.col("_bucket").alias("_cut_bucket"),
                (F.col("_quota") - F.col("_through") + F.col("_n")).alias("_remaining"))
    )
    on_boundary = tokens.join(
        F.broadcast(boundary), (F.col(label) == F.col("_label")) & (prefix == F.col("_cut_bucket"))
    )
    order = Window.partitionBy("_label").orderBy("_token", "_key")
    cuts = (
        on_boundary.withColumn("_rank", F.row_number().over(order))
        .where("_rank = _remaining")
        .select("_label", F.col("_token").alias("_cut_token"), F.col("_key").alias("_cut_key"))
    )
    token = split_token(key, seed)
    inside = (token < F.col("_cut_token")) | ((token == F.col("_cut_token")) & (F.col(key) <= F.col("_cut_key")))
    return (
        df.join(F.broadcast(cuts), F.col(label) == F.col("_label"), "left")
        .withColumn("slice", F.when(inside, "test").otherwise("train"))
        .drop("_label", "_cut_token", "_cut_key")
    )


def ranked_importance(importances: DataFrame, top: int = 20, highlighted: int = 5) -> DataFrame:
    """The `top` features by importance with their rank. The input has one row per feature."""
    order = Window.orderBy(F.col("importance").desc(), "feature")
    best = importances.orderBy(F.col("importance").desc(), "feature").limit(top)
    ranked = best.withColumn("rank", F.row_number().over(order))
    return ranked.withColumn("highlight", F.col("rank") <= highlighted)
