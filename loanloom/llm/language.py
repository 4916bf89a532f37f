"""Language identification by a byte convolutional network, trained and applied in numpy.

A text is read as windows of WINDOW bytes, the last one padded. Bytes are embedded; filters of several widths
slide over the window; each filter keeps its largest response (max pooling) and a softmax layer turns these
features into language probabilities. A document's probabilities are the mean over all its windows, weighted by
their bytes; `score` is the largest. Every window of every text is read.

Fitting takes a sample of about `sample` texts per language, chosen by a hash of the id, of each a few windows
from anywhere in the text: that bound is the parameter, and only this sample reaches the driver. The weights (some
50 KB) go to the tasks.

Defined results: a null text, or one without any letter, is `und` with score 0; a table without labelled texts
gives `und` for all; with one language only, that language has score 1. Rows with a null label are not learned
from. A null doc_id is passed on; other columns may have any names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loanloom.llm.bytestext import mix, texts_of

WINDOW = 256
WIDTHS = (2, 3, 4, 5)
FILTERS = 8
EMBEDDING = 8
SAMPLE_PER_LANGUAGE = 400
WINDOWS_PER_TEXT = 4
EPOCHS, BATCH, RATE = 12, 64, 0.01
MOST_LANGUAGES = 1000
UNKNOWN = "und"
#: Windows computed together.
STEP = 256
PAD = 0


def no_letter(text: Column) -> Column:
    return F.coalesce(~text.rlike(r"\p{L}"), F.lit(True))


def windows_of(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows of all texts, padded with PAD, with their text and number of bytes."""
    lengths = np.diff(starts)
    counts = -(-lengths // WINDOW)
    text = np.repeat(np.arange(len(lengths)), counts)
    nth = np.arange(len(text)) - np.repeat(np.cumsum(counts) - counts, counts)
    begin = starts[text] + nth * WINDOW
    size = np.minimum(WINDOW, starts[text + 1] - begin)
    padded = np.concatenate([data, np.full(WINDOW, PAD, np.uint8)])
    out = padded[begin[:, None] + np.arange(WINDOW)]
    out[np.arange(WINDOW) >= size[:, None]] = PAD
    return out, text, size


@dataclass
class Network:
    labels: list[str]
    embedding: np.ndarray
    kernels: list[np.ndarray]
    biases: list[np.ndarray]
    out: np.ndarray
    out_bias: np.ndarray

    @classmethod
    def fresh(cls, labels: list[str], seed: int = 7) -> Network:
        rng = np.random.default_rng(seed)
        draw = lambda *shape, scale: rng.normal(0, scale, shape).astype(np.float32)
        features = FILTERS * len(WIDTHS)
        return cls(
            labels, draw(256, EMBEDDING, scale=0.5),
            [draw(w * EMBEDDING, FILTERS, scale=(w * EMBEDDING) ** -0.5) for w in WIDTHS],
            [np.zeros(FILTERS, np.float32) for _ in WIDTHS],
            draw(features, len(labels), scale=features**-0.5), np.zeros(len(labels), np.float32))

    def parameters(self) -> list[np.ndarray]:
        return [self.embedding, *self.kernels, *self.biases, self.out, self.out_bias]

    def features(self, windows: np.ndarray, places: bool = False) -> tuple[np.ndarray, list[np.ndarray]]:
        """Pooled responses of each window and, for training, where they were."""
        embedded = self.embedding[windows]
        n, length, depth = embedded.shape
        pooled, found = [], []
        for width, kernel, bias in zip(WIDTHS, self.kernels, self.biases):
            steps = length - width + 1
            patches = np.lib.stride_tricks.as_strided(
                embedded, (n, steps, width * depth), (embedded.strides[0], embedded.strides[1], embedded.itemsize))
            response = (patches.reshape(n * steps, width * depth) @ kernel).reshape(n, steps, FILTERS)
            if places:
                at = response.argmax(axis=1)
                found.append(at)
                best = np.take_along_axis(response, at[:, None, :], 1)[:, 0]
            else:
                best = response.max(axis=1)
            pooled.append(np.maximum(best + bias, 0))
        return np.concatenate(pooled, axis=1), found

    def probabilities(self, windows: np.ndarray) -> np.ndarray:
        parts = [_softmax(self.features(windows[i:i + STEP])[0] @ self.out + self.out_bias) for i in range(0, len(windows), STEP)]
        return np.concatenate(parts) if parts else np.zeros((0, len(self.labels)), np.float32)

    def gradients(self, windows: np.ndarray, target: np.ndarray) -> list[np.ndarray]:
        """Of the mean cross-entropy, in the order of `parameters`."""
        pooled, found = self.features(windows, places=True)
        error = _softmax(pooled @ self.out + self.out_bias)
        error[np.arange(len(target)), target] -= 1
        error /= len(target)
        back = (error @ self.out.T) * (pooled > 0)
        embedding, kernels, biases = np.zeros_like(self.embedding), [], []
        for i, (width, kernel) in enumerate(zip(WIDTHS, self.kernels)):
            slope = back[:, i * FILTERS:(i + 1) * FILTERS]
            read = found[i][:, :, None] + np.arange(width)
            used = windows[np.arange(len(windows))[:, None, None], read]
            patch = self.embedding[used].reshape(len(windows), FILTERS, -1)
            kernels.append(np.einsum("nf,nfd->df", slope, patch))
            biases.append(slope.sum(axis=0))
            spread = (slope[:, :, None] * kernel.T[None]).reshape(*used.shape, EMBEDDING)
            np.add.at(embedding, used.reshape(-1), spread.reshape(-1, EMBEDDING))
        return [embedding, *kernels, *biases, pooled.T @ error, error.sum(axis=0)]

    def train(self, windows: np.ndarray, target: np.ndarray, seed: int = 11) -> Network:
        """Adam over shuffled batches; the same sample gives the same weights."""
        rng, parameters, step = np.random.default_rng(seed), self.parameters(), 0
        mean, square = [np.zeros_like(p) for p in parameters], [np.zeros_like(p) for p in parameters]
        for _ in range(EPOCHS):
            order = rng.permutation(len(target))
            for i in range(0, len(order), BATCH):
                step += 1
                part = order[i:i + BATCH]
                for p, g, m, s in zip(parameters, self.gradients(windows[part], target[part]), mean, square):
                    m += 0.1 * (g - m)
                    s += 0.001 * (g * g - s)
                    p -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)
        return self


def _softmax(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(axis=1, keepdims=True))
    return x / x.sum(axis=1, keepdims=True)


def training_sample(labelled: DataFrame, sample: int = SAMPLE_PER_LANGUAGE) -> pd.DataFrame:
    """text and lang of about `sample` texts with letters per language, at most twice as many."""
    rows = labelled.where(F.col("lang").isNotNull() & ~no_letter(F.col("text"))).select(
        "text", "lang", F.pmod(F.xxhash64(F.lit("sample"), "doc_id", "text"), F.lit(2**40)).alias("_draw"))
    counts = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).limit(MOST_LANGUAGES + 1).collect()
    if len(counts) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    if not counts:
        return pd.DataFrame({"text": [], "lang": []})
    shares = F.create_map(*[F.lit(v) for r in counts for v in (r["lang"], int(min(1.0, sample / r["n"]) * 2**40))])
    drawn = rows.where(F.col("_draw") < shares[F.col("lang")])
    # Each text is cut to its training windows by the tasks; long texts don't reach the driver.
    cut = drawn.mapInArrow(_training_windows, "lang string, draw long, windows binary").toPandas()
    cut = cut.sort_values(["lang", "draw", "windows"]).groupby("lang").head(2 * sample)
    return cut


def _training_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = texts_of(batch.column("text"))
        windows, text, size = windows_of(texts.data, texts.starts)
        cuts = np.searchsorted(text, np.arange(len(texts) + 1))
        draws = batch.column("_draw").to_numpy()
        out = []
        for lo, hi, draw in zip(cuts[:-1], cuts[1:], draws):
            order = np.argsort(mix(np.uint64(draw) + np.arange(hi - lo, dtype=np.uint64)))[:WINDOWS_PER_TEXT]
            out.append(windows[lo:hi][order].tobytes())
        yield pa.RecordBatch.from_arrays(
            [batch.column("lang"), batch.column("_draw"), pa.array(out, pa.binary())], names=["lang", "draw", "windows"])


def fit(labelled: DataFrame, sample: int = SAMPLE_PER_LANGUAGE) -> Network | None:
    """The network for the labels in `labelled` (doc_id, text, lang); None if there are none."""
    drawn = training_sample(labelled, sample)
    labels = sorted(drawn["lang"].unique())
    if not labels:
        return None
    windows = [np.frombuffer(w, np.uint8).reshape(-1, WINDOW) for w in drawn["windows"]]
    target = np.repeat([labels.index(x) for x in drawn["lang"]], [len(w) for w in windows])
    return Network.fresh(labels).train(np.concatenate(windows), target)


def identify(docs: DataFrame, network: Network | None) -> DataFrame:
    """`docs` with lang_pred and score; these two replace columns of the same name."""
    docs = docs.drop("lang_pred", "score").withColumn("_unknown", no_letter(F.col("text")))
    schema = T.StructType([
        *docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            unknown = batch.column("_unknown").to_numpy(zero_copy_only=False).astype(bool)
            names, scores = [UNKNOWN] * batch.num_rows, np.zeros(batch.num_rows)
            if network is not None:
                best, scores = _predict(network, batch.column("text"))
                names = [UNKNOWN if u else network.labels[b] for u, b in zip(unknown, best)]
                scores = np.where(unknown, 0.0, scores)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(names, pa.string()), pa.array(scores, pa.float64())],
                names=[*batch.schema.names, "lang_pred", "score"])

    return docs.mapInArrow(predict, schema).drop("_unknown")


def _predict(network: Network, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Index of the best language and its probability, for each text."""
    texts = texts_of(column)
    total, at = np.zeros((len(texts), len(network.labels))), 0
    # Windows of some texts at a time; a long text is cut at window bounds.
    lengths, limit = texts.lengths, STEP * WINDOW * 8
    pieces = [(i, s, min(s + limit, n)) for i, n in enumerate(lengths.tolist()) for s in range(0, n, limit)]
    while at < len(pieces):
        to, size = at, 0
        while to < len(pieces) and (to == at or size + pieces[to][2] - pieces[to][1] <= limit):
            size += pieces[to][2] - pieces[to][1]
            to += 1
        part = pieces[at:to]
        first = texts.starts[part[0][0]] + part[0][1]
        starts = np.array([texts.starts[i] + s for i, s, _ in part] + [texts.starts[part[-1][0]] + part[-1][2]]) - first
        windows, text, size_of = windows_of(texts.data[first:first + starts[-1]], starts)
        weighted = network.probabilities(windows) * size_of[:, None]
        np.add.at(total, np.array([i for i, *_ in part])[text], weighted)
        at = to
    total /= np.maximum(lengths, 1)[:, None]
    return total.argmax(axis=1), np.clip(total.max(axis=1), 0, 1)


def held_out(doc_id: Column) -> Column:
    """One document in five, by the CRC-32 of its id as text; a null id counts as learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))
