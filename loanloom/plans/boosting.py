"""Second-order tree boosting for a binary target, grown level by level from sums of gradients and Hessians.

Features are cut once at quantiles into bins. A level of a tree is one pass: every task adds up the gradient and the
Hessian of its rows per node, feature and bin, one DataFrame aggregate adds these sums, and the driver, which gets at
most 2^level x features x bins of them, chooses each node's split. Rows are never shuffled. A missing value has a bin
of its own, and a split sends it to the side with the larger gain. Gradients are counted in whole steps of
1 / SCALE, so sums don't hang on their order and a repeated task gives the same tree.

A split needs `min_child_weight` of Hessian on both sides; one that gains less than `gamma` is taken back where no
split below it stays. Each tree draws its columns and, by a hash of the row, its rows.
"""

from __future__ import annotations

import json
import math
from dataclasses import asdict, dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from loanloom.session import fresh_path

SCALE = 1 << 20
#: Trees after which the rows' margins are written, instead of being added up again in each pass.
WRITE_EVERY = 10
LEAST_GAIN = 1e-6
_LEVEL = "node int, feature int, bin int, g bigint, h bigint"


@dataclass(frozen=True)
class Newton:
    """The boosting settings of the current model; `l2` and `bins` are its library's defaults."""

    trees: int = 300
    depth: int = 5
    step: float = 0.05
    row_share: float = 0.8
    column_share: float = 0.8
    min_child_weight: float = 5.0
    gamma: float = 0.1
    l2: float = 1.0
    bins: int = 256
    seed: int = 42


@dataclass
class Tree:
    """Node i has children 2i + 1 and 2i + 2; a value below its threshold goes left. `feature` is -1 at a leaf."""

    feature: list[int]
    threshold: list[float]
    missing_left: list[bool]
    value: list[float]
    gain: list[float]
    cover: list[float]

    @staticmethod
    def empty(depth: int) -> Tree:
        n = 2 ** (depth + 1) - 1
        return Tree([-1] * n, [0.0] * n, [False] * n, [0.0] * n, [0.0] * n, [0.0] * n)

    def leaves_of(self, values: np.ndarray, levels: int | None = None) -> np.ndarray:
        """The node that each row of `values` (rows x features, NaN where missing) reaches."""
        feature, threshold, left = np.array(self.feature), np.array(self.threshold), np.array(self.missing_left)
        node = np.zeros(len(values), np.int64)
        rows = np.arange(len(values))
        for _ in range(int(math.log2(len(feature) + 1)) - 1 if levels is None else levels):
            f = feature[node]
            v = values[rows, np.maximum(f, 0)]
            goes_left = np.where(np.isnan(v), left[node], v < threshold[node])
            node = np.where(f >= 0, 2 * node + np.where(goes_left, 1, 2), node)
        return node


@dataclass
class Ensemble:
    features: list[str]
    trees: list[Tree] = field(default_factory=list)

    def margins(self, values: np.ndarray, first: int = 0) -> np.ndarray:
        total = np.zeros(len(values))
        for tree in self.trees[first:]:
            total += np.array(tree.value)[tree.leaves_of(values)]
        return total

    def importances(self) -> dict[str, float]:
        """Mean gain of the splits of each feature, as shares."""
        gains: dict[int, list[float]] = {}
        for tree in self.trees:
            for f, gain in zip(tree.feature, tree.gain):
                if f >= 0:
                    gains.setdefault(f, []).append(gain)
        means = {f: sum(g) / len(g) for f, g in gains.items()}
        whole = sum(means.values()) or 1.0
        return {name: means.get(i, 0.0) / whole for i, name in enumerate(self.features)}

    def as_sql(self, step: str = "margin") -> str:
        """The margin as SQL: one nested CASE per tree."""
        def part(tree: Tree, node: int) -> str:
            f = tree.feature[node]
            if f < 0:
                return f"CAST({tree.value[node]!r} AS DOUBLE)"
            left, right = part(tree, 2 * node + 1), part(tree, 2 * node + 2)
            missing = left if tree.missing_left[node] else right
            name = self.features[f]
            return f"CASE WHEN {name} IS NULL THEN {missing} WHEN {name} < CAST({tree.threshold[node]!r} AS DOUBLE) THEN {left} ELSE {right} END"

        return " + ".join(["CAST(0 AS DOUBLE)", *[f"({part(tree, 0)})" for tree in self.trees]]) + f" AS {step}"


def quantile_edges(matrix: DataFrame, features, bins: int) -> list[np.ndarray]:
    """Ascending cut points of every feature from one pass of mergeable quantile sketches."""
    shares = [i / bins for i in range(bins)]
    found = matrix.agg(*[F.percentile_approx(f, shares, 50 * bins).alias(f"e{i}") for i, f in enumerate(features)]).first()
    return [np.unique(np.array(found[i] if found[i] is not None else [], float)) for i in range(len(features))]


def sampled(key: np.ndarray, tree: int, settings: Newton) -> np.ndarray:
    """Which rows a tree draws, by the row's hash."""
    mixed = key.view(np.uint64) ^ np.uint64((settings.seed * 0x9E3779B97F4A7C15 + tree * 0xBF58476D1CE4E5B9) % 2**64)
    mixed = (mixed ^ (mixed >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
    mixed ^= mixed >> np.uint64(29)
    return (mixed % np.uint64(1 << 24)) < np.uint64(int(settings.row_share * (1 << 24)))


def columns_of(tree: int, features: int, settings: Newton) -> np.ndarray:
    drawn = max(1, int(features * settings.column_share))
    return np.sort(np.random.default_rng([settings.seed, tree]).permutation(features)[:drawn])


def derivatives(margin: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradient and Hessian of the log loss, in whole steps."""
    p = 1 / (1 + np.exp(-margin))
    return np.rint((p - target) * SCALE).astype(np.int64), np.rint(p * (1 - p) * SCALE).astype(np.int64)


def level_sums(values, bins, target, margin, chosen, tree: Tree, level: int, columns, widths) -> np.ndarray:
    """(2, nodes, columns, bins) sums of gradient and Hessian over the chosen rows at a level's open nodes."""
    nodes, width = 2 ** level, max(widths) + 2
    out = np.zeros((2, nodes, len(columns), width), np.int64)
    node = tree.leaves_of(values, level) - (nodes - 1)
    here = np.flatnonzero(chosen & (node >= 0))
    for part, amounts in zip(out, derivatives(margin[here], target[here])):
        for place, column in enumerate(columns):
            flat = node[here] * width + bins[here, column]
            part[:, place, :] = np.bincount(flat, weights=amounts, minlength=nodes * width).astype(np.int64).reshape(nodes, width)
    return out


def bins_of(values: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    """The number of cut points up to each value; a missing value has the bin after the last."""
    out = np.empty(values.shape, np.int64)
    for i, cuts in enumerate(edges):
        out[:, i] = np.where(np.isnan(values[:, i]), len(cuts) + 1, np.searchsorted(cuts, values[:, i], side="right"))
    return out


@dataclass(frozen=True)
class Split:
    """A node's split, with the sums of gradient and Hessian that go left."""

    gain: float
    column: int
    threshold: float
    missing_left: bool
    g: float
    h: float


def best_split(sums: np.ndarray, columns, edges: list[np.ndarray], settings: Newton) -> Split | None:
    """The split with the largest gain, the first of several. `sums` is (2, columns, bins) of one node."""
    best = None
    g_all, h_all = sums[:, 0].sum(axis=1) / SCALE
    own = g_all ** 2 / (h_all + settings.l2)
    for place, column in enumerate(columns):
        cuts = len(edges[column])
        if not cuts:
            continue
        below = np.cumsum(sums[:, place, :cuts], axis=1) / SCALE
        missing = sums[:, place, cuts + 1] / SCALE
        for missing_left in (False, True):
            g, h = below + missing[:, None] if missing_left else below
            gain = g ** 2 / (h + settings.l2) + (g_all - g) ** 2 / (h_all - h + settings.l2) - own
            gain[(h < settings.min_child_weight) | (h_all - h < settings.min_child_weight)] = -np.inf
            at = int(gain.argmax())
            if gain[at] > LEAST_GAIN and (best is None or gain[at] > best.gain + 1e-12):
                best = Split(float(gain[at]), int(column), float(edges[column][at]), missing_left, float(g[at]), float(h[at]))
    return best


def grow(tree: Tree, level: int, sums: np.ndarray, columns, edges, settings: Newton) -> bool:
    """Splits the open nodes of a level; the sides of a split give the weights of its children. True if any is split."""
    first, split = 2 ** level - 1, False
    for n in range(2 ** level):
        node = first + n
        if node and tree.feature[(node - 1) // 2] < 0:
            continue
        g, h = (sums[:, n, 0].sum(axis=1) / SCALE).tolist()
        if not node:
            _weigh(tree, node, g, h, settings)
        found = best_split(sums[:, n], columns, edges, settings)
        if found:
            split = True
            tree.gain[node], tree.feature[node] = found.gain, found.column
            tree.threshold[node], tree.missing_left[node] = found.threshold, found.missing_left
            _weigh(tree, 2 * node + 1, found.g, found.h, settings)
            _weigh(tree, 2 * node + 2, g - found.g, h - found.h, settings)
    return split


def _weigh(tree: Tree, node: int, g: float, h: float, settings: Newton) -> None:
    tree.value[node], tree.cover[node] = -settings.step * g / (h + settings.l2), h


def take_back(tree: Tree, gamma: float) -> None:
    """From the bottom up, splits that gain less than `gamma` and have two leaves become leaves."""
    for node in reversed(range(len(tree.feature) // 2)):
        leaves = tree.feature[2 * node + 1] < 0 and tree.feature[2 * node + 2] < 0
        if tree.feature[node] >= 0 and leaves and tree.gain[node] < gamma:
            tree.feature[node], tree.gain[node] = -1, 0.0


def _matrix_of(batch, features: int):
    values = np.frombuffer(batch.column("values").buffers()[2], np.float64, batch.num_rows * features, _start(batch.column("values")))
    bins = np.frombuffer(batch.column("bins").buffers()[2], np.uint16, batch.num_rows * features, _start(batch.column("bins")))
    return values.reshape(-1, features), bins.reshape(-1, features).astype(np.int64)


def _start(column) -> int:
    """Where the bytes of a sliced binary column begin."""
    kind = np.int64 if pa.types.is_large_binary(column.type) else np.int32
    return int(np.frombuffer(column.buffers()[1], kind)[column.offset])


_MATRIX = "target double, key bigint, margin double, values binary, bins binary"


def _known(rows: DataFrame, features: list[str], target: str) -> DataFrame:
    """target, f0, f1, ... as doubles, NULL where missing, and a hash of the row."""
    names = [f"f{i}" for i in range(len(features))]
    known = rows.where(F.col(target).isNotNull()).select(
        F.col(target).cast("double").alias("target"), *[F.col(f).cast("double").alias(n) for n, f in zip(names, features)])
    known = known.select("target", *[F.when(~F.isnan(n), F.col(n)).alias(n) for n in names])
    return known.withColumn("key", F.xxhash64("target", *names))


def _binned(known: DataFrame, edges: list[np.ndarray]) -> DataFrame:
    """The rows packed: values, their bins, and a margin of 0."""
    def pack(batches):
        for batch in batches:
            values = np.stack([batch.column(f"f{i}").to_numpy(zero_copy_only=False) for i in range(len(edges))], 1)
            bins = bins_of(values, edges).astype(np.uint16)
            yield pa.record_batch({
                "target": batch.column("target"), "key": batch.column("key"), "margin": pa.array(np.zeros(len(values))),
                "values": pa.array([v.tobytes() for v in np.ascontiguousarray(values)], pa.binary()),
                "bins": pa.array([b.tobytes() for b in bins], pa.binary())})

    return known.mapInArrow(pack, _MATRIX)


def train(rows: DataFrame, features, settings: Newton = Newton(), target: str = "target") -> Ensemble:
    """Fits on the rows with a target; NULL and NaN are missing. Columns are read as doubles.

    The matrix is written to the shared folder in files of even size, again every WRITE_EVERY trees with the margins so
    far; what that replaces is deleted, so a lost executor costs one pass and the folder holds two copies at most.
    """
    features = list(features)
    known = _known(rows, features, target)
    edges = quantile_edges(known, [f"f{i}" for i in range(len(features))], settings.bins)
    widths = [len(e) for e in edges]
    matrix = _Written(_binned(known, edges).hint("rebalance"))
    ensemble = Ensemble(features)
    for number in range(settings.trees):
        tree, columns = Tree.empty(settings.depth), columns_of(number, len(features), settings)
        since = Ensemble(features, ensemble.trees[number - number % WRITE_EVERY:])
        for level in range(settings.depth):
            sums = _pass(matrix.rows, since, tree, level, columns, widths, number, settings)
            if not grow(tree, level, sums, columns, edges, settings):
                break
        take_back(tree, settings.gamma)
        ensemble.trees.append(tree)
        if len(ensemble.trees) % WRITE_EVERY == 0 and len(ensemble.trees) < settings.trees:
            latest = Ensemble(features, ensemble.trees[-WRITE_EVERY:])
            matrix.replace(matrix.rows.mapInArrow(lambda b, e=latest: _with_margins(b, e), _MATRIX))
    matrix.delete()
    return ensemble


def root_sums(rows: DataFrame, features, edges: list[np.ndarray], target: str = "target") -> DataFrame:
    """feature, bin, g and h of the first level of the first tree over all rows, for given cut points."""
    features = list(features)
    settings = Newton(row_share=1.0, column_share=1.0)
    sums = _sums(_binned(_known(rows, features, target), edges), Ensemble(features), Tree.empty(1), 0, np.arange(len(features)),
                 [len(e) for e in edges], 0, settings)
    name = F.element_at(F.array(*[F.lit(f) for f in features]), F.col("feature") + 1)
    return sums.select(name.alias("feature"), "bin", (F.col("g") / SCALE).alias("g"), (F.col("h") / SCALE).alias("h"))


def _with_margins(batches, latest: Ensemble):
    for batch in batches:
        values, _ = _matrix_of(batch, len(latest.features))
        margin = batch.column("margin").to_numpy() + latest.margins(values)
        yield batch.set_column(batch.schema.get_field_index("margin"), "margin", pa.array(margin))


def _sums(matrix: DataFrame, since: Ensemble, tree: Tree, level: int, columns, widths, number: int, settings: Newton) -> DataFrame:
    """Sums of one level over all rows. Each task sends one row per node, column and bin that it has met."""
    count = len(since.features)

    def sums(batches):
        total = np.zeros((2, 2 ** level, len(columns), max(widths) + 2), np.int64)
        for batch in batches:
            if batch.num_rows:
                values, bins = _matrix_of(batch, count)
                margin = batch.column("margin").to_numpy() + since.margins(values)
                chosen = sampled(batch.column("key").to_numpy(), number, settings)
                total += level_sums(values, bins, batch.column("target").to_numpy(), margin, chosen, tree, level, columns, widths)
        node, place, at = np.nonzero(total.any(axis=0))
        yield pa.record_batch({
            "node": pa.array(node, pa.int32()), "feature": pa.array(place, pa.int32()), "bin": pa.array(at, pa.int32()),
            "g": pa.array(total[0][node, place, at]), "h": pa.array(total[1][node, place, at])})

    return matrix.mapInArrow(sums, _LEVEL).groupBy("node", "feature", "bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h"))


def _pass(matrix: DataFrame, since: Ensemble, tree: Tree, level: int, columns, widths, number: int, settings: Newton) -> np.ndarray:
    """The sums of a level as an array: 2 x nodes x columns x bins."""
    found = _sums(matrix, since, tree, level, columns, widths, number, settings).toPandas()
    out = np.zeros((2, 2 ** level, len(columns), max(widths) + 2), np.int64)
    out[:, found["node"], found["feature"], found["bin"]] = found[["g", "h"]].to_numpy().T
    return out


class _Written:
    """A table in the shared folder; a replacement is written before the table it replaces is deleted."""

    def __init__(self, df: DataFrame):
        self.spark = df.sparkSession
        self._write(df)

    def _write(self, df: DataFrame) -> None:
        self.path = fresh_path(self.spark, "boosting")
        df.write.parquet(self.path)
        self.rows = self.spark.read.schema(df.schema).parquet(self.path)

    def replace(self, df: DataFrame) -> None:
        old = self.path
        self._write(df)
        _delete(self.spark, old)

    def delete(self) -> None:
        _delete(self.spark, self.path)


def _delete(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def predict(rows: DataFrame, ensemble: Ensemble | None) -> DataFrame:
    """Adds probability of class 1 and prediction; both NULL without a model. NULL and NaN features are missing."""
    if ensemble is None:
        return rows.withColumns({"probability": F.lit(None).cast("double"), "prediction": F.lit(None).cast("int")})

    @F.pandas_udf("double")
    def probability(*columns: pd.Series) -> pd.Series:
        values = np.stack([c.to_numpy(float) for c in columns], 1)
        return pd.Series(1 / (1 + np.exp(-ensemble.margins(values))))

    scored = rows.withColumn("probability", probability(*[F.col(f).cast("double") for f in ensemble.features]))
    return scored.withColumn("prediction", (F.col("probability") > 0.5).cast("int"))


def importances(spark: SparkSession, ensemble: Ensemble) -> DataFrame:
    """(feature, importance), one row per feature."""
    return spark.createDataFrame(list(ensemble.importances().items()), "feature string, importance double")


def tree_table(spark: SparkSession, ensemble: Ensemble) -> DataFrame:
    """One row per node: tree, node, feature (NULL at a leaf), threshold, missing_left, value, gain and cover."""
    rows = []
    for number, tree in enumerate(ensemble.trees):
        for node, f in enumerate(tree.feature):
            if node == 0 or tree.feature[(node - 1) // 2] >= 0:
                split = f >= 0
                rows.append((number, node, ensemble.features[f] if split else None, tree.threshold[node] if split else None,
                             tree.missing_left[node] if split else None, None if split else tree.value[node],
                             tree.gain[node] if split else None, tree.cover[node]))
    return spark.createDataFrame(
        rows, "tree int, node int, feature string, threshold double, missing_left boolean, value double, gain double, cover double")


def save(spark: SparkSession, ensemble: Ensemble, path: str) -> None:
    text = json.dumps({"features": ensemble.features, "trees": [asdict(t) for t in ensemble.trees]})
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def load(spark: SparkSession, path: str) -> Ensemble:
    stored = json.loads(spark.read.text(path).first()[0])
    return Ensemble(stored["features"], [Tree(**t) for t in stored["trees"]])
