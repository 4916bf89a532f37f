"""Toxicity by cumulative-link ordinal regression over sparse text features.

A severity grade y in 0..K has P(y <= k) = sigmoid(threshold_k - w.x): one weight vector w for all ordered
thresholds. x marks which words a text has (lower case, without punctuation), hashed to 2^20 places. w is fitted
by accelerated proximal gradient steps with an L1 penalty, so words that tell nothing have weight zero and a long
clean text gathers no weight by its length alone. The output is the expected severity, the most probable grade
and the probability that the grade is above 0; `toxic` is that probability being at least one half.

Fitting takes about `sample` labelled texts, chosen by a hash of the id: only their distinct hashed words reach
the driver, and that bound is the parameter. The weights that are not zero go to the tasks. Every word of every
text counts in the prediction.

Defined results: a null text has no words, and gets the thresholds' own severity; rows without a grade are not
learned from; without any labelled text every prediction is null; a grade that nobody has gets no mass beyond
the ordering; several label rows for one doc_id count as several examples. A null doc_id is passed on; other
columns may have any names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loanloom.llm.bytestext import distinct, plain_letters, slices_by_size, texts_of, word_hashes, words_of

PLACES = 2**20
SAMPLE = 6000
PENALTY = 5e-4
STEPS = 300
GRADES = "toxic and quality as grades: 0 not toxic, 1 toxic in a text of good quality, 2 toxic in a poor one"


def severity(toxic: Column, quality: Column) -> Column:
    """A grade from the two labels, by GRADES; null where toxic is."""
    return F.when(toxic == 0, 0).when(toxic.isNotNull(), F.when(quality == 0, 2).otherwise(1))


def distinct_words(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Text index and place of the distinct hashed words of each text, by text."""
    texts = plain_letters(texts_of(column))
    first, last, doc = words_of(texts)
    places = word_hashes(texts.data, first, last) & np.uint64(PLACES - 1)
    pairs = distinct((doc.astype(np.uint64) << np.uint64(20)) | places)
    return (pairs >> np.uint64(20)).astype(np.int64), (pairs & np.uint64(PLACES - 1)).astype(np.int64)


@dataclass
class Model:
    """Thresholds in order, and the weights of the places that have one."""

    thresholds: np.ndarray
    places: np.ndarray
    weights: np.ndarray

    def grades(self, score: np.ndarray) -> np.ndarray:
        """Probability of each grade."""
        below = _sigmoid(self.thresholds[None, :] - score[:, None])
        edges = np.concatenate([np.zeros((len(score), 1)), below, np.ones((len(score), 1))], axis=1)
        return np.diff(edges, axis=1)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def learn(rows: np.ndarray, places: np.ndarray, grades: np.ndarray) -> Model:
    """Fits thresholds and weights to texts given as (row, place) pairs and their grades 0..K."""
    top = max(1, int(grades.max()))
    known, column = np.unique(places, return_inverse=True)
    n = len(grades)
    # Thresholds as a first value and positive gaps, from the grades' frequencies.
    share = np.clip(np.array([(grades <= k).mean() for k in range(top)]), 1e-3, 1 - 1e-3)
    start = np.log(share / (1 - share))
    cuts = np.maximum.accumulate(start + 1e-3 * np.arange(top))
    w, momentum, t = np.zeros(len(known)), np.zeros(len(known)), 1.0
    often = np.bincount(rows, minlength=n)
    rate = 4.0 / max(1.0, np.sqrt((often**2).mean()))
    cut_rate = 2.0
    for _ in range(STEPS):
        score = np.bincount(rows, weights=momentum[column], minlength=n)
        edges = np.concatenate([np.full((n, 1), -40.0), cuts[None, :] - score[:, None], np.full((n, 1), 40.0)], axis=1)
        cumulative = _sigmoid(edges)
        cumulative[:, 0], cumulative[:, -1] = 0.0, 1.0
        slope = cumulative * (1 - cumulative)
        high, low = cumulative[np.arange(n), grades + 1], cumulative[np.arange(n), grades]
        mass = np.maximum(high - low, 1e-9)
        to_high, to_low = slope[np.arange(n), grades + 1] / mass, slope[np.arange(n), grades] / mass
        pull = (to_high - to_low) / n
        gradient = np.bincount(column, weights=pull[rows], minlength=len(known))
        stepped = momentum - rate * gradient
        new = np.sign(stepped) * np.maximum(np.abs(stepped) - rate * PENALTY, 0)
        cut_gradient = np.array([
            (to_low[grades == k + 1].sum() - to_high[grades == k].sum()) / n for k in range(top)])
        cuts = np.maximum.accumulate(cuts - cut_rate * cut_gradient)
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        momentum, w, t = new + (t - 1) / t_new * (new - w), new, t_new
    used = np.flatnonzero(w)
    return Model(cuts, known[used], w[used])


def fit(labelled: DataFrame, sample: int = SAMPLE) -> Model | None:
    """A model from doc_id, text and grade; None without any graded text."""
    rows = labelled.where(F.col("grade").isNotNull())
    n = rows.count()
    if not n:
        return None
    draw = F.pmod(F.xxhash64(F.lit("sample"), "doc_id", "text"), F.lit(2**40))
    drawn = rows.where(draw < int(min(1.0, sample / n) * 2**40)).select("text", F.col("grade").cast("int"), draw.alias("draw"))
    taken = drawn.mapInArrow(_features, "draw long, grade int, places binary").toPandas()
    taken = taken.sort_values(["draw", "grade", "places"]).head(2 * sample)
    if not len(taken):
        return None
    lists = [np.frombuffer(b, np.int32) for b in taken["places"]]
    owners = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
    return learn(owners, np.concatenate(lists).astype(np.int64), taken["grade"].to_numpy())


def _sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Arrow batches hold rows by number, however long their texts; arrays over their bytes take some 16 times as much."""
    for batch in batches:
        yield from slices_by_size(batch)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _sliced(batches):
        rows, places = distinct_words(batch.column("text"))
        cuts = np.searchsorted(rows, np.arange(batch.num_rows + 1))
        lists = [places[lo:hi].astype(np.int32).tobytes() for lo, hi in zip(cuts[:-1], cuts[1:])]
        yield pa.RecordBatch.from_arrays(
            [batch.column("draw"), batch.column("grade"), pa.array(lists, pa.binary())], names=["draw", "grade", "places"])


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, expected_severity, grade, p_toxic and toxic of every row."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    if model is None:
        return rows.select(
            "doc_id", F.lit(None).cast("double").alias("expected_severity"), F.lit(None).cast("int").alias("grade"),
            F.lit(None).cast("double").alias("p_toxic"), F.lit(None).cast("boolean").alias("toxic"))

    return rows.mapInArrow(
        lambda batches: _predictions(batches, model),
        "doc_id bigint, expected_severity double, grade int, p_toxic double, toxic boolean")


def _predictions(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    weights = np.zeros(PLACES)
    weights[model.places] = model.weights
    for batch in _sliced(batches):
        owners, places = distinct_words(batch.column("text"))
        p = model.grades(np.bincount(owners, weights=weights[places], minlength=batch.num_rows))
        yield pa.RecordBatch.from_arrays([
            batch.column("doc_id"), pa.array(p @ np.arange(p.shape[1])), pa.array(p.argmax(axis=1).astype(np.int32)),
            pa.array(1 - p[:, 0]), pa.array(p[:, 0] <= 0.5),
        ], names="doc_id expected_severity grade p_toxic toxic".split())
