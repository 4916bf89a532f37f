"""Exact trailing velocity kept in operator state: no batch reads the stored table again.

Per identity the state is one value with the rows of the last 24 hours in order of time. Time is cut into grains of ten
minutes. When the watermark passes the end of a grain, nothing can come before its rows any more, so they are answered;
24 hours later no answer needs them, and they are dropped. An identity has one timer, for the first grain of which one
or the other is due; when it fires, everything due by then is answered and dropped in one step, so a batch reads and
writes the state of an identity twice at most, however many grains the watermark has passed. Late rows up to the
watermark's delay count exactly, however the stream is cut into batches, and state never reaches further back than the
horizon and the delay.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor

from loanloom.functions.scalars import wall_clock
from loanloom.operators.velocity import MICROS, flag_list
from loanloom.streaming.applications import IDENTITY, _identified, with_event_time

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: What comes before all times.
NEVER = -(1 << 63)
ANSWER = "name string, surname string, date_of_birth string, id string, akb_score double, at bigint, recent_count bigint, recent_low double, recent_high double"


def use_rocksdb(spark: SparkSession) -> None:
    """Stateful processors need this store: state on local disk, its changes in the query's checkpoint folder."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


class Velocity(StatefulProcessor):
    """Answers each row with the count, lowest and highest score of its identity in (at - horizon, at].

    `rows` are the times ascending, scores (NaN for NULL) and ids of an identity; those before `answered` have their
    answers. `timer` is the end of a grain, in microseconds like all times.
    """

    def __init__(self, hours: int, grain_seconds: int):
        self.horizon, self.grain = hours * 3600 * MICROS, grain_seconds * MICROS
        if self.horizon % self.grain:
            raise ValueError("the horizon must be a whole number of grains")

    def init(self, handle) -> None:
        self.handle = handle
        self.rows = handle.getValueState(
            "rows", "at array<bigint>, score array<double>, id array<string>, answered bigint, timer bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        """Files the rows under their times and sets the timer if they are due before what is waited for."""
        parts = list(rows)
        at = np.concatenate([p["at"].to_numpy(np.int64) for p in parts])
        score = np.concatenate([p["akb_score"].to_numpy(float) for p in parts])
        ids = np.concatenate([p["id"].to_numpy(object) for p in parts])
        stored, answered, timer = self.rows.get(), NEVER, None
        if stored is not None:
            old_at, old_score, old_ids, answered, timer = stored
            at = np.concatenate([np.array(old_at, np.int64), at])
            score = np.concatenate([np.array(old_score, float), score])
            ids = np.concatenate([np.array(old_ids, object), ids])
        order = np.argsort(at, kind="stable")
        self._store(at[order], score[order], ids[order], answered, timer)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """Answers the grains that have ended and drops those that ended a horizon ago."""
        stored = self.rows.get()
        if stored is None:
            return iter([])
        at, score, ids, answered, timer = stored
        at, score, ids = np.array(at, np.int64), np.array(score, float), np.array(ids, object)
        fired = expiredTimerInfo.getExpiryTimeInMs() * (MICROS // 1000)
        passed = max(timerValues.getCurrentWatermarkInMs() * (MICROS // 1000), fired) // self.grain * self.grain
        due = slice(np.searchsorted(at, answered), np.searchsorted(at, passed))
        answers = [self._answers(key, at, score, ids, due)] if due.start < due.stop else []
        kept = np.searchsorted(at, passed - self.horizon)
        if kept < len(at):
            self._store(at[kept:], score[kept:], ids[kept:], max(answered, passed), None if timer == fired else timer)
        else:
            self.rows.clear()
        return iter(answers)

    def _store(self, at: np.ndarray, score: np.ndarray, ids: np.ndarray, answered: int, timer: int | None) -> None:
        """Writes the state with the timer of what is due next; `timer` is the one that is set."""
        first = np.searchsorted(at, answered)
        due = at[first] if first < len(at) else at[0] + self.horizon
        end = (int(due) // self.grain + 1) * self.grain
        if timer is None or end < timer:
            if timer is not None:
                self.handle.deleteTimer(_millis(timer))
            self.handle.registerTimer(_millis(end))
            timer = end
        self.rows.update((at.tolist(), score.tolist(), ids.tolist(), answered, timer))

    def _answers(self, key, at: np.ndarray, score: np.ndarray, ids: np.ndarray, due: slice) -> pd.DataFrame:
        asked = at[due]
        begins = np.searchsorted(at, asked - self.horizon, side="right")
        ends = np.searchsorted(at, asked, side="right")
        name, surname, birth = key
        return pd.DataFrame({
            "name": name, "surname": surname, "date_of_birth": birth, "id": ids[due], "akb_score": score[due], "at": asked,
            "recent_count": ends - begins, "recent_low": _over_ranges(np.fmin, score, begins, ends),
            "recent_high": _over_ranges(np.fmax, score, begins, ends)})

    def close(self) -> None:
        pass


def _over_ranges(pick, values: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """`pick` over values[begin:end] of each range, none of them empty.

    A range is covered by two runs of the largest power of two that fits; runs are doubled step by step.
    """
    out = np.empty(len(begins))
    steps = np.frexp(ends - begins)[1] - 1
    run = values
    for step in range(int(steps.max()) + 1):
        if step:
            half = 1 << step - 1
            run = pick(run[:-half], run[half:])
        mine = steps == step
        out[mine] = pick(run[begins[mine]], run[ends[mine] - (1 << step)])
    return out


def _millis(micros: int) -> int:
    return -(-micros // (MICROS // 1000))


def exact_velocity(submissions: DataFrame, late: str = "1 hour", hours: int = 24, grain_seconds: int = 600, key: str = "id") -> DataFrame:
    """Trailing activity and fraud flags of every submission, given once the watermark has passed it.

    The columns are the identity (lower case), `key` as text under the name id, the score, the time, what
    `velocity.trailing_activity` adds, and the flags. Rows without a time or with a NULL in their identity are nobody's
    and left out; rows later than the watermark are dropped. The session must use the RocksDB store (`use_rocksdb`).
    """
    known = with_event_time(submissions).where(_identified() & F.col("submitted_at").isNotNull())
    rows = known.select(
        F.lower("name").alias("name"), F.lower("surname").alias("surname"), F.col("date_of_birth"), F.col(key).cast("string").alias("id"),
        F.col("akb_score").cast("double").alias("akb_score"), "submitted_at", F.unix_micros("submitted_at").alias("at"))
    answered = rows.withWatermark("submitted_at", late).groupBy(*IDENTITY).transformWithStateInPandas(
        statefulProcessor=Velocity(hours, grain_seconds), outputStructType=ANSWER, outputMode="Append", timeMode="EventTime")
    numbers = {c: F.when(~F.isnan(c), F.col(c)) for c in ("akb_score", "recent_low", "recent_high")}
    answered = answered.withColumns({**numbers, "submitted_at": wall_clock(F.timestamp_micros("at"))}).drop("at")
    return answered.withColumn("fraud_flags", flag_list(F.col("akb_score")))
