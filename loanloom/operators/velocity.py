"""How often, and with which scores, the same person applied in the last 24 hours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from loanloom.functions.scalars import epoch_micros

MICROS = 1_000_000
KEYS = ("_name", "_surname", "_birth")


def _identity(missing_as_empty: bool) -> list[Column]:
    parts = [F.lower("name"), F.lower("surname"), F.col("date_of_birth")]
    if missing_as_empty:
        parts = [F.coalesce(p, F.lit("")) for p in parts]
    return [p.alias(k) for p, k in zip(parts, KEYS)]


def trailing_activity(
    probes: DataFrame,
    history: DataFrame,
    probe_ts: str = "submitted_at",
    hours: int = 24,
    grain_seconds: int = 600,
) -> DataFrame:
    """`probes` with the count, lowest and highest score of `history` rows of the same identity in (ts - hours, ts].

    A window per identity would put a heavy identity into one task and rescan its frame per row, so
    time is cut into grains and the trailing span of a row is the sum of three exact parts:
      * its own grain up to the row: a running aggregate inside (identity, grain);
      * the whole grains in between: a window over one pre-aggregated row per (identity, grain);
      * the grain in which the span begins, after its start: those rows are also sent `hours`
        ahead, into the row's own grain, where a running aggregate from the end counts them.
    A heavy identity is thereby spread over its grains and pairs of rows are never formed.
    """
    span, grain = hours * 3600 * MICROS, grain_seconds * MICROS
    if span % grain:
        raise ValueError("the horizon must be a whole number of grains")
    grains_back = span // grain

    queries = probes.select("*", *_identity(missing_as_empty=True), epoch_micros(F.col(probe_ts)).alias("_pos"))
    events = (
        history.select(*_identity(missing_as_empty=False), epoch_micros(F.col("submitted_at")).alias("_pos"), "akb_score")
        .dropna(subset=list(KEYS) + ["_pos"])
        .groupBy(*KEYS, "_pos")
        .agg(F.count("*").alias("_n"), F.min("akb_score").alias("_low"), F.max("akb_score").alias("_high"))
    )
    nothing = [F.lit(0).cast("bigint").alias("_n"), F.lit(None).cast("double").alias("_low"),
               F.lit(None).cast("double").alias("_high")]
    asked = queries.where(F.col("_pos").isNotNull()).select(*KEYS, "_pos").distinct()
    marks = events.select(
        *KEYS, "_pos", "_n", F.col("_low").cast("double").alias("_low"), F.col("_high").cast("double").alias("_high"),
        F.lit(False).alias("_asked"),
    ).unionByName(asked.select(*KEYS, "_pos", *nothing, F.lit(True).alias("_asked")))

    def cell_of(pos: Column) -> Column:
        return ((pos - F.pmod(pos, F.lit(grain))) / grain).cast("bigint")

    own = F.struct(F.col("_pos").alias("pos"), F.lit(False).alias("earlier"))
    ahead = F.struct((F.col("_pos") + span).alias("pos"), F.lit(True).alias("earlier"))
    placed = (
        marks.select("*", F.explode(F.when(F.col("_n") > 0, F.array(own, ahead)).otherwise(F.array(own))).alias("_at"))
        .select(*KEYS, "_n", "_low", "_high", F.col("_at.pos").alias("_pos"), F.col("_at.earlier").alias("_earlier"),
                (F.col("_asked") & ~F.col("_at.earlier")).alias("_asked"))
        .withColumn("_grain", cell_of(F.col("_pos")))
    )

    def part(column: str, earlier: bool) -> Column:
        return F.when(F.col("_earlier") == earlier, F.col(column))

    cell = Window.partitionBy(*KEYS, "_grain")
    until_now = cell.orderBy("_pos").rangeBetween(Window.unboundedPreceding, 0)
    after_now = cell.orderBy(F.col("_pos").desc()).rangeBetween(Window.unboundedPreceding, -1)
    edges = placed.select(
        *KEYS, "_grain", "_pos", "_asked",
        F.coalesce(F.sum(part("_n", False)).over(until_now), F.lit(0)).alias("_own_n"),
        F.min(part("_low", False)).over(until_now).alias("_own_low"),
        F.max(part("_high", False)).over(until_now).alias("_own_high"),
        F.coalesce(F.sum(part("_n", True)).over(after_now), F.lit(0)).alias("_edge_n"),
        F.min(part("_low", True)).over(after_now).alias("_edge_low"),
        F.max(part("_high", True)).over(after_now).alias("_edge_high"),
    ).where("_asked")

    per_grain = (
        marks.groupBy(*KEYS, cell_of(F.col("_pos")).alias("_grain"))
        .agg(F.sum("_n").alias("_n"), F.min("_low").alias("_low"), F.max("_high").alias("_high"))
    )
    between = Window.partitionBy(*KEYS).orderBy("_grain").rangeBetween(-(grains_back - 1), -1)
    middle = per_grain.select(
        *KEYS, "_grain",
        F.coalesce(F.sum("_n").over(between), F.lit(0)).alias("_mid_n"),
        F.min("_low").over(between).alias("_mid_low"),
        F.max("_high").over(between).alias("_mid_high"),
    )
    answers = edges.join(middle, [*KEYS, "_grain"]).select(
        *KEYS, "_pos",
        (F.col("_own_n") + F.col("_edge_n") + F.col("_mid_n")).alias("recent_count"),
        F.least("_own_low", "_edge_low", "_mid_low").alias("recent_low"),
        F.greatest("_own_high", "_edge_high", "_mid_high").alias("recent_high"),
    )
    joined = queries.join(answers, [*KEYS, "_pos"], "left").drop(*KEYS, "_pos")
    return joined.withColumn("recent_count", F.coalesce("recent_count", F.lit(0)))


# Thresholds and flag texts.
MANY_SUBMISSIONS = 3
SCORE_GAP = 100
MANY_TEXT = "Multiple submissions in 24 hours"
GAP_TEXT = "AKB score varies significantly across submissions"


def flag_list(score: Column) -> Column:
    """Fraud flags from the columns `trailing_activity` adds; a score of NULL or 0 compares to nothing."""
    many = F.col("recent_count") >= MANY_SUBMISSIONS
    spread = F.greatest(F.col("recent_high") - score, score - F.col("recent_low"))
    varies = (score != 0) & (spread > SCORE_GAP)
    return F.array_compact(F.array(F.when(many, MANY_TEXT), F.when(varies, GAP_TEXT)))


def fraud_flags(probes: DataFrame, history: DataFrame) -> DataFrame:
    recent = trailing_activity(probes, history)
    return recent.withColumn("fraud_flags", flag_list(F.col("akb_score").cast("double")))


#: Rows of one identity and day that one task joins.
PART_ROWS = 10_000


def application_pairs(
    probes: DataFrame, history: DataFrame, key: str = "application_id", hours: int = 24, part_rows: int = PART_ROWS,
) -> DataFrame:
    """Every probe with each row of `history` of the same identity in (ts - hours, ts]: key, id, its time and score.

    `trailing_activity` gives what the pairs add up to without forming them; this is for those who must see the rows.
    Time is cut into cells of the horizon: a history row lies in its own, a probe looks into its own and the one
    before. Where an identity has more than `part_rows` rows in a cell, they are dealt to that many parts, which the
    probes of the cell all visit, so no task holds a whole identity.
    """
    span = hours * 3600 * MICROS

    def cell_of(pos: Column) -> Column:
        return F.floor(pos / span).cast("bigint")

    events = history.select(
        *_identity(missing_as_empty=False), epoch_micros(F.col("submitted_at")).alias("_pos"),
        F.col("id").alias("matched_id"), F.col("submitted_at").alias("matched_at"), F.col("akb_score").alias("matched_score"),
    ).dropna(subset=[*KEYS, "_pos"]).withColumn("_cell", cell_of(F.col("_pos")))
    at = epoch_micros(F.col("submitted_at"))
    asked = probes.select(F.col(key), *_identity(missing_as_empty=True), at.alias("_at")).dropna(subset=["_at"])
    asked = asked.withColumn("_cell", F.explode(F.array(cell_of(F.col("_at")), cell_of(F.col("_at")) - 1)))

    place = [*KEYS, "_cell"]
    parts = events.groupBy(*place).agg(F.ceil(F.count(F.lit(1)) / part_rows).cast("int").alias("_parts"))
    dealt = events.join(parts, place).withColumn("_part", F.pmod(F.xxhash64("matched_id", "_pos"), F.col("_parts")).cast("int"))
    visits = asked.join(parts, place).withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))
    joined = visits.join(dealt.drop("_parts"), [*place, "_part"])
    inside = (F.col("_pos") <= F.col("_at")) & (F.col("_pos") > F.col("_at") - span)
    return joined.where(inside).select(key, "matched_id", "matched_at", "matched_score")
