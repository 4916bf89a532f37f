"""Second-order boosting against a plain search over all splits."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from loanloom.plans import boosting
from loanloom.session import fresh_path, shared_folder

NAMES = ["a", "b", "c", "d"]
SETTINGS = boosting.Newton(trees=12, depth=3, bins=16, min_child_weight=2.0, gamma=0.3)


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(500, 4))
    x[rng.random((500, 4)) < 0.1] = np.nan
    y = (np.nan_to_num(x[:, 0]) + 0.5 * np.nan_to_num(x[:, 1], nan=1) + rng.normal(size=500) * 0.3 > 0).astype(int)
    data = [(*[None if np.isnan(v) else float(v) for v in r], int(t)) for r, t in zip(x, y)]
    data += [(1.0, 2.0, 3.0, 4.0, None)] * 3 + [(float("nan"), 0.5, None, 0.1, 1)] * 2
    return spark.createDataFrame(data, "a double, b double, c double, d double, target int").repartition(3)


@pytest.fixture(scope="module")
def fitted(rows):
    return boosting.train(rows, NAMES, SETTINGS)


class Plain:
    """Every tree as nested dictionaries, by trying each cut of each drawn column with both default sides."""

    def __init__(self, values, target, key, edges, s):
        self.v, self.edges, self.s, self.trees = values, edges, s, []
        margin = np.zeros(len(values))
        for number in range(s.trees):
            p = 1 / (1 + np.exp(-margin))
            self.g = np.rint((p - target) * boosting.SCALE) / boosting.SCALE
            self.h = np.rint(p * (1 - p) * boosting.SCALE) / boosting.SCALE
            columns = boosting.columns_of(number, values.shape[1], s)
            self.trees.append(self.node(np.flatnonzero(boosting.sampled(key, number, s)), columns, 0))
            margin = margin + np.array([self.value(self.trees[-1], x) for x in values])

    def node(self, rows, columns, depth):
        g, h, s = self.g[rows].sum(), self.h[rows].sum(), self.s
        best = None
        for c in columns if depth < s.depth else ():
            v = self.v[rows, c]
            for side in (False, True):
                found = None
                for e in self.edges[c]:
                    left = np.where(np.isnan(v), side, v < e)
                    gl, hl = self.g[rows][left].sum(), self.h[rows][left].sum()
                    if min(hl, h - hl) >= s.min_child_weight:
                        gain = gl ** 2 / (hl + s.l2) + (g - gl) ** 2 / (h - hl + s.l2) - g ** 2 / (h + s.l2)
                        if found is None or gain > found["gain"]:
                            found = {"gain": gain, "c": c, "e": e, "side": side, "left": left}
                if found and found["gain"] > boosting.LEAST_GAIN and (best is None or found["gain"] > best["gain"] + 1e-12):
                    best = found
        leaf = {"value": -s.step * g / (h + s.l2)}
        if best is None:
            return leaf
        best["l"], best["r"] = (self.node(rows[m], columns, depth + 1) for m in (best["left"], ~best["left"]))
        return leaf if best["gain"] < s.gamma and "c" not in best["l"] and "c" not in best["r"] else best

    def value(self, t, x):
        while "c" in t:
            v = x[t["c"]]
            t = t["l"] if (t["side"] if np.isnan(v) else v < t["e"]) else t["r"]
        return t["value"]


def same(tree, node, plain):
    if "c" not in plain:
        return tree.feature[node] == -1 and abs(tree.value[node] - plain["value"]) < 1e-9
    here = (tree.feature[node], tree.threshold[node], tree.missing_left[node]) == (plain["c"], plain["e"], plain["side"])
    return here and same(tree, 2 * node + 1, plain["l"]) and same(tree, 2 * node + 2, plain["r"])


def test_trees_equal_a_plain_search(rows, fitted):
    named = rows.where("target IS NOT NULL").selectExpr("CAST(target AS DOUBLE) AS target", *[f"nanvl({n}, NULL) AS f{i}" for i, n in enumerate(NAMES)])
    columns = [f"f{i}" for i in range(4)]
    found = named.select("*", F.xxhash64("target", *columns).alias("key")).toPandas()
    edges = boosting.quantile_edges(named, columns, SETTINGS.bins)
    plain = Plain(found[columns].to_numpy(float), found["target"].to_numpy(), found["key"].to_numpy(), edges, SETTINGS)
    assert len(fitted.trees) == 12 and all(same(t, 0, p) for t, p in zip(fitted.trees, plain.trees))
    assert len({t.feature[0] for t in fitted.trees}) > 1 and any(any(t.missing_left) for t in fitted.trees)


def test_settings_hold(rows, fitted):
    for tree in fitted.trees:
        for node, f in enumerate(tree.feature):
            if f >= 0:
                sides = tree.cover[2 * node + 1], tree.cover[2 * node + 2]
                assert min(sides) >= 2.0 and sum(sides) == pytest.approx(tree.cover[node])
                below = tree.feature[2 * node + 1] >= 0 or tree.feature[2 * node + 2] >= 0
                assert below or tree.gain[node] >= 0.3
    strict = boosting.train(rows, NAMES, boosting.Newton(trees=2, depth=3, gamma=1e9))
    assert all(t.feature[0] == -1 for t in strict.trees)


def test_one_pass_over_the_rows_per_level(rows, monkeypatch):
    passes = []
    whole = boosting._pass
    monkeypatch.setattr(boosting, "_pass", lambda *a: passes.append(a[3]) or whole(*a))
    boosting.train(rows, NAMES, boosting.Newton(trees=2, depth=2, bins=8))
    assert passes == [0, 1, 0, 1]


def test_same_trees_from_other_partitions(rows, fitted):
    again = boosting.train(rows.repartition(7), NAMES, SETTINGS)
    assert again == fitted


def test_prediction_by_sql_and_after_storing(spark, rows, fitted):
    path = fresh_path(spark, "ensemble")
    boosting.save(spark, fitted, path)
    stored = boosting.load(spark, path)
    assert stored == fitted
    whole = rows.selectExpr(*[f"nanvl({n}, NULL) AS {n}" for n in NAMES], "target")
    scored = boosting.predict(whole, stored).select("*", F.expr(stored.as_sql().removesuffix(" AS margin")).alias("margin"))
    got = scored.collect()
    assert len(got) == 505 and all(abs(r.probability - 1 / (1 + np.exp(-r.margin))) < 1e-12 for r in got)
    known = [r for r in got if r.target is not None]
    assert sum(r.prediction == r.target for r in known) > 0.88 * len(known)
    assert boosting.predict(rows, None).where("probability IS NOT NULL").count() == 0


def test_importances_and_table(spark, fitted):
    shares = {r.feature: r.importance for r in boosting.importances(spark, fitted).collect()}
    assert set(shares) == set(NAMES) and sum(shares.values()) == pytest.approx(1) and max(shares, key=shares.get) == "a"
    nodes = boosting.tree_table(spark, fitted).collect()
    assert {r.tree for r in nodes} == set(range(12)) and all((r.feature is None) == (r.value is not None) for r in nodes)


def test_empty_and_constant_inputs(spark, make):
    nothing = boosting.train(make("a double, target int"), ["a"], boosting.Newton(trees=2, depth=2))
    assert all(t.feature[0] == -1 and t.value[0] == 0 for t in nothing.trees)
    flat = make("a double, target int", *[(None, i % 2) for i in range(40)])
    assert all(t.feature[0] == -1 for t in boosting.train(flat, ["a"], boosting.Newton(trees=2, depth=2)).trees)


def test_replaced_tables_are_deleted(spark, rows):
    import os

    folder = shared_folder(spark).removeprefix("file://")
    before = {f for f in os.listdir(folder) if f.startswith("boosting-")}
    boosting.train(rows, NAMES, boosting.Newton(trees=11, depth=1, bins=4))
    assert {f for f in os.listdir(folder) if f.startswith("boosting-")} == before
