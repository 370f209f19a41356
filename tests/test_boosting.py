"""The boosted learner against a plain one, and its two ways of growing against each other."""

import json
import math
import random

import duckdb
import numpy as np
import pytest

from pyspark.sql import functions as F

from cellwise.operators import boosting as B
from cellwise.operators import detection as D
from cellwise.operators import utility as L
from cellwise.operators.cells import flatten

UNIT = B.UNIT


def rows_of(spark, features, table, labels, member, scored):
    rows = [(i, float(y), m, s, [(f, float(v)) for f, v in enumerate(r) if v is not None]) for i, (r, y, m, s) in enumerate(zip(table, labels, member, scored, strict=True))]
    return spark.createDataFrame(rows, "rid bigint, label double, member int, scored int, entries array<struct<i:int,v:double>>").repartition(7)


def plain_cuts(bins, kinds, sizes, g, h, rows):
    """Best cut of one node by trying every one: (gain, feature, left rows)."""
    best = None
    G, H = sum(g[i] for i in rows), sum(h[i] for i in rows)
    score = lambda a, b: (a / UNIT) ** 2 / (b / UNIT + 1)
    for f, kind in enumerate(kinds):
        if kind == "num":
            present = sorted({bins[i][f] for i in rows if bins[i][f] >= 0})
            cuts = [([i for i in rows if (bins[i][f] <= b if bins[i][f] >= 0 else side)]) for b in present for side in (False, True)]
        else:
            levels = {}
            for i in rows:
                x = levels.setdefault(bins[i][f], [0, 0])
                x[0] += g[i]
                x[1] += h[i]
            order = sorted(levels, key=lambda k: (levels[k][0] / UNIT / (levels[k][1] / UNIT + 1), k))
            cuts = [[i for i in rows if bins[i][f] in set(order[:n])] for n in range(1, len(order)) if min(n, len(order) - n) <= B.LISTED]
        for left in cuts:
            a, b = sum(g[i] for i in left), sum(h[i] for i in left)
            if b / UNIT < 1 or (H - b) / UNIT < 1:
                continue
            gain = score(a, b) + score(G - a, H - b) - score(G, H)
            if gain > 1e-6 and (best is None or gain > best[0] + 1e-12):
                best = (gain, f, set(left))
    return best


def plain_fit(bins, kinds, sizes, labels, classes, trees, depth):
    """Probabilities of the training rows, and (round, output, node, feature, gain) of all cuts."""
    model = B.Model(0, "logistic" if len(classes) == 2 else "softmax", classes)
    margins, cuts = np.zeros((model.outputs, len(labels))), []
    for t in range(trees):
        g, h = model.gradients(margins, np.array(labels))
        for o in range(model.outputs):
            nodes = {1: list(range(len(labels)))}
            for _ in range(depth):
                after = {}
                for node, rows in nodes.items():
                    best = plain_cuts(bins, kinds, sizes, g[o].tolist(), h[o].tolist(), rows)
                    if best:
                        cuts.append((t, o, node, best[1], best[0]))
                        after[2 * node] = [i for i in rows if i in best[2]]
                        after[2 * node + 1] = [i for i in rows if i not in best[2]]
                    else:
                        value = -sum(g[o][rows]) / UNIT / (sum(h[o][rows]) / UNIT + 1) * 0.3
                        margins[o, rows] += value
                nodes = after
            for rows in nodes.values():
                margins[o, rows] += -sum(g[o][rows]) / UNIT / (sum(h[o][rows]) / UNIT + 1) * 0.3
    return model.probabilities(margins), sorted(cuts)


def made(n, classes, seed):
    rng = random.Random(seed)
    table, labels = [], []
    for _ in range(n):
        a, b, c = rng.choice([None, *range(9)]), rng.randint(0, 5), rng.choice([None, rng.random()])
        table.append([a, b, c and round(c, 2)])
        labels.append(float(((a is None) + (b in (1, 4)) + (rng.random() < 0.2)) % classes))
    return table, labels


@pytest.mark.parametrize("classes", [2, 3])
def test_trees_equal_the_plain_ones(spark, classes):
    table, labels = made(160, classes, classes)
    values = sorted({r[2] for r in table if r[2] is not None})
    features = B.Features(["a", "b", "c"], [9, 6, len(values)], [np.arange(1.0, 9), None, np.array(values[1:])], [-1, 0, -1])
    bins = [[-1 if r[0] is None else r[0], r[1], -1 if r[2] is None else values.index(r[2])] for r in table]
    p, cuts = plain_fit(bins, ["num", "cat", "num"], features.sizes, labels, [float(k) for k in range(classes)], 3, 3)
    rows = rows_of(spark, features, table, labels, [1] * 160, [1] * 160)
    model = B.Model(0, "logistic" if classes == 2 else "softmax", [float(k) for k in range(classes)])
    for cells in (0, 1 << 24):
        fitted = B.fit(rows, features, [model], 3, 3, local_cells=cells)
        got = {r["rid"]: r["p"] for r in fitted.predictions.collect()}
        assert np.allclose([got[i] for i in range(160)], p.T, atol=1e-12)
        ledger = sorted((r["round"], r["output"], r["node"], features.names.index(r["feature"]), r["gain"]) for r in fitted.ledger.collect())
        assert [x[:4] for x in ledger] == [x[:4] for x in cuts]
        assert np.allclose([x[4] for x in ledger], [x[4] for x in cuts])


def test_both_ways_agree_on_many_levels_and_models(spark):
    """5,000 levels take two chunks; two models, of two and of four classes, grow together."""
    rng = random.Random(9)
    table = [[rng.randint(0, 4999), rng.choice([None, rng.randint(0, 40)])] for _ in range(9000)]
    labels = [float((r[0] % 3 == 0) + 2 * (r[1] is None)) for r in table]
    member = [1 if y < 2 and i % 2 else 2 for i, y in enumerate(labels)]
    features = B.Features(["wide", "x"], [5000, 41], [None, np.arange(1.0, 41)], [0, -1])
    rows = rows_of(spark, features, table, labels, member, [3] * 9000)
    models = [B.Model(0, "logistic", [0.0, 1.0]), B.Model(1, "softmax", [0.0, 1.0, 2.0, 3.0])]
    found = []
    for cells in (0, 1 << 24):
        fitted = B.fit(rows, features, models, 2, 2, local_cells=cells)
        p = {(r["model"], r["rid"]): tuple(r["p"]) for r in fitted.predictions.collect()}
        found.append((p, sorted(map(tuple, fitted.ledger.collect()))))
    assert found[0] == found[1] and len(found[0][0]) == 18000
    assert any(r[4] == "wide" for r in found[0][1])


def test_numbers(spark):
    rng = random.Random(3)
    table = [[rng.random(), None if i % 4 == 0 else 1.0] for i in range(600)]
    labels = [3.0 * (r[0] > 0.5) - 7.0 * (r[1] is None) for r in table]
    cuts = np.arange(0.01, 1, 0.01)
    features = B.Features(["x", "y"], [100, 1], [cuts, np.array([])], [-1, -1])
    rows = rows_of(spark, features, table, labels, [1] * 600, [1] * 600)
    fitted = B.fit(rows, features, [B.Model(0, "squared", base=float(np.mean(labels)), scale=8.0)], 30, 3)
    pairs = [(r["label"], r["p"][0]) for r in fitted.predictions.collect()]
    assert max(abs(a - b) for a, b in pairs) < 0.3
    assert {r["feature"] for r in fitted.ledger.collect()} == {"x", "y"}


def test_cuts_of_numbers(spark):
    rows = [("few", float(v)) for v in (3, 1, 2, 2, 1)] + [("one", 4.0)] * 3 + [("many", float(v)) for v in range(1000)] + [("many", 5.0)] * 500
    got = {}
    for r in B.quantile_cuts(spark.createDataFrame(rows, "name string, value double"), 10).collect():
        got.setdefault(r["name"], []).append(r["cut"])
    assert sorted(got["few"]) == [2.0, 3.0] and "one" not in got
    values = sorted(v for n, v in rows if n == "many")
    part = {}
    for v in range(1000):
        before = sum(x < v for x in values)
        part.setdefault(before * 10 // 1500, float(v))
    assert sorted(got["many"]) == sorted(part.values())[1:]


def people(n, seed, hide=False):
    rng = random.Random(seed)
    return [{"city": f"c{rng.randint(0, 399)}", "x": rng.random(), **({} if hide and rng.random() < 0.6 else {"y": rng.randint(0, 5)})} for _ in range(n)]


def test_absence_alone_is_found(to_records):
    records = to_records(train=people(300, 1), synth=people(300, 2, hide=True))
    aucs, gains = D.detection_folds(flatten(records, max_depth=1), records)
    assert min(r["roc_auc"] for r in aucs.collect()) > 0.7
    top = D.feature_importances(gains).first()
    assert top["feature"] in ("y.num", "y.dtype")


def test_four_hundred_levels_stay_levels(to_records):
    """A label that depends on the level, not on its order."""
    rng = random.Random(5)
    good = {f"c{i}" for i in rng.sample(range(400), 200)}
    rows = people(3000, 6)
    real = [r for r in rows if r["city"] in good]
    synth = [r for r in rows if r["city"] not in good]
    records = to_records(train=real, synth=synth)
    cells = flatten(records, max_depth=1)
    _, features = B.feature_rows(cells, records)
    assert features.cuts[features.names.index("city.cat")] is None
    assert D.detection_metrics(cells, records).first()["roc_auc"] > 0.9


def test_metrics_and_importances_by_sql(to_records, tmp_path):
    """SQL over stored predictions and the ledger gives the operators' numbers."""
    rng = random.Random(7)
    rows = lambda n: [{**r, "kind": rng.choice("abc") if rng.random() < 0.3 else "abc"[int(r["x"] * 3)]} for r in people(n, rng.random())]
    records = to_records(train=rows(200), test=rows(150), synth=rows(200))
    cells = flatten(records, max_depth=1)
    predicted = L.utility_predictions(cells, records, "kind", trees=4, depth=3)
    predicted.write.parquet(str(tmp_path / "p"))
    got = {(r["trained_on"], r["metric"]): r["value"] for r in L.metrics_of(predicted).collect()}
    sql = f"""WITH p AS (SELECT * FROM '{tmp_path}/p/*.parquet'), k AS (SELECT DISTINCT trained_on, label AS c FROM p),
      f AS (SELECT k.trained_on, k.c, count(*) FILTER (label = c) AS t, count(*) FILTER (prediction = c) AS g, count(*) FILTER (label = c AND prediction = c) AS hit
            FROM p JOIN k USING (trained_on) GROUP BY ALL),
      s AS (SELECT k.trained_on, k.c, p.rid, p.label = k.c AS y, p.p[list_position(p.classes, k.c)] / list_sum(p.p) AS x FROM p JOIN k USING (trained_on)),
      r AS (SELECT *, rank() OVER (PARTITION BY trained_on, c ORDER BY x) + (count(*) OVER (PARTITION BY trained_on, c, x) - 1) / 2.0 AS r FROM s),
      a AS (SELECT trained_on, c, (sum(r) FILTER (y) - count(*) FILTER (y) * (count(*) FILTER (y) + 1) / 2.0) / (count(*) FILTER (y) * count(*) FILTER (NOT y)) AS auc, count(*) FILTER (y) AS n FROM r GROUP BY ALL)
      SELECT trained_on, sum(hit) / sum(t) AS accuracy, sum(t * 2.0 * hit / (t + g)) / sum(t) AS f1_weighted, (SELECT sum(auc * n) / sum(n) FROM a WHERE a.trained_on = f.trained_on) AS roc_auc FROM f GROUP BY trained_on"""
    for name, accuracy, f1, auc in duckdb.sql(sql).fetchall():
        assert math.isclose(got[name, "accuracy"], accuracy) and math.isclose(got[name, "f1_weighted"], f1) and math.isclose(got[name, "roc_auc"], auc)
    _, fitted = D.detection_predictions(cells, records)
    fitted.ledger.write.parquet(str(tmp_path / "l"))
    gains = {(r["fold"], r["feature"]): r["gain"] for r in D.gain_per_use(fitted.ledger, fitted.features.names, 3).collect()}
    for model, feature, gain in duckdb.sql(f"SELECT model, feature, avg(gain) FROM '{tmp_path}/l/*.parquet' GROUP BY ALL").fetchall():
        assert math.isclose(gains.pop((model, feature)), gain)
    assert set(gains.values()) <= {0.0}


def test_one_class_and_regression(to_records):
    alike = [{"k": "a", "n": 1.5, "x": i} for i in range(30)]
    records = to_records(train=people_with_kind(60), test=people_with_kind(40), synth=alike)
    cells = flatten(records, max_depth=1)
    values = {(r["trained_on"], r["metric"]): r["value"] for r in L.utility_metrics(cells, records, "k", trees=2, depth=2).collect()}
    assert values["synth", "roc_auc"] == 0.5 and 0 < values["real", "accuracy"] <= 1
    again = {(r["trained_on"], r["metric"]): r["value"] for r in L.utility_metrics(cells, records, "n", "regression", trees=2, depth=2).collect()}
    assert {m for _, m in again} == {"r2", "mse", "rmse"}


def people_with_kind(n):
    rng = random.Random(n)
    return [{"k": rng.choice("ab"), "n": rng.random(), "x": rng.randint(0, 9)} for _ in range(n)]


# --- logistic regression


def test_sparse_logistic_equals_a_dense_one(to_records):
    rng = random.Random(11)
    row = lambda shift: {"c": rng.choice("abc" if shift else "abbc"), **({"x": rng.gauss(shift, 1)} if rng.random() < 0.8 else {}), "z": rng.randint(0, 3)}
    records = to_records(train=[row(0) for _ in range(80)], synth=[row(1) for _ in range(90)])
    got, _ = D.detection_predictions(flatten(records, max_depth=1), records, method="logistic_regression")
    plain = {r["rid"]: (json.loads(r["t"]), r["split"] == "train") for r in records.select("rid", "split", F.to_json("v").alias("t")).collect()}
    folded, _ = D.with_folds(records.select("rid", "split"), "train", "synth", 3, 42)
    fold = {r["rid"]: r["fold"] for r in folded.collect()}
    want = []
    for f in range(3):
        ids = sorted(plain)
        train = [i for i in ids if fold[i] != f]
        x = np.array([[plain[i][0].get("x", np.nan), plain[i][0]["z"], *[plain[i][0]["c"] == k for k in "abc"], *[("x" in plain[i][0]) == v for v in (True, False)]] for i in ids], float)
        at = [ids.index(i) for i in train]
        x = np.where(np.isnan(x), np.nanmean(x[at], axis=0), x)
        q = np.percentile(x[at], [25, 50, 75], axis=0)
        width = np.where(q[2] == q[0], 1, q[2] - q[0])
        x = np.c_[(x - q[1]) / width, np.ones(len(x))]
        y = np.array([plain[i][1] for i in ids], float)
        w = np.zeros(x.shape[1])
        ridge = np.eye(x.shape[1])
        ridge[-1, -1] = 0
        for _ in range(50):
            p = 1 / (1 + np.exp(-x[at] @ w))
            w -= np.linalg.solve(x[at].T @ ((p * (1 - p))[:, None] * x[at]) + ridge, x[at].T @ (p - y[at]) + ridge @ w)
        want += [(f, y[k], 1 / (1 + math.exp(-x[k] @ w))) for k, i in enumerate(ids) if fold[i] == f]
    mine = sorted((r["fold"], r["label"], r["p"]) for r in got.collect())
    assert np.allclose(mine, sorted(want), atol=2e-4)


def test_a_hundred_thousand_levels(spark):
    """Names never reach the driver: they are numbered and joined in Spark."""
    n = 100_000
    records = spark.range(n).select(F.col("id").alias("rid"), F.when(F.col("id") % 2 == 0, "train").otherwise("synth").alias("split"))
    entries = spark.range(n).select(F.col("id").alias("rid"), F.concat(F.lit("t.cat_"), F.col("id")).alias("name"), F.lit(1.0).alias("value"))
    numbers = D.feature_numbers(entries)
    assert numbers.agg(F.countDistinct("index"), F.min("index"), F.max("index")).first() == (n, 0, n - 1)
    each = records.select("rid", F.lit(0).alias("model"))
    facts = D.scaling_facts(entries, each)
    rows = D.sparse_rows(entries, numbers, facts, each, n)
    assert rows.count() == n
    vector = rows.where("rid = 77").first()["features"]
    assert vector.size == n and len(vector.indices) == 1 and vector.values[0] == 1.0


@pytest.mark.parametrize("cells", [0, 1 << 24])
def test_equal_rows_grow_the_same_trees_as_one(spark, monkeypatch, cells):
    """A fit holds no more rows than the bins allow, and its trees and predictions are those of all records."""
    rng = random.Random(5)
    table = [[rng.choice([None, *range(3)]), rng.randint(0, 2)] for _ in range(3000)]
    labels = [float((r[0] is None) + (r[1] == 1) + (rng.random() < 0.3)) for r in table]
    member, scored = [rng.choice([1, 2]) for _ in table], [rng.choice([2, 3]) for _ in table]
    features = B.Features(["a", "b"], [3, 3], [np.arange(1.0, 3), None], [-1, 0])
    rows = rows_of(spark, features, table, labels, member, scored)
    models = [B.Model(0, "softmax", [0.0, 1.0, 2.0]), B.Model(1, "softmax", [0.0, 1.0, 2.0])]
    held, found, grow = [], [], B._fitted
    monkeypatch.setattr(B, "_fitted", lambda state, n, *a: held.append(n) or grow(state, n, *a))
    for most in (B.different_rows, lambda state, features, n: n):
        monkeypatch.setattr(B, "different_rows", most)
        fitted = B.fit(rows, features, models, 3, 2, local_cells=cells)
        p = sorted((r["model"], r["rid"], r["label"], tuple(r["p"])) for r in fitted.predictions.collect())
        found.append((p, sorted(map(tuple, fitted.ledger.collect()))))
    assert held[0] <= 4 * 3 * 3 * 4 and held[1] == 3000
    assert found[0][1] == found[1][1]
    assert [x[:3] for x in found[0][0]] == [x[:3] for x in found[1][0]] and len(found[0][0]) == 3000 + scored.count(3)
    assert np.allclose([x[3] for x in found[0][0]], [x[3] for x in found[1][0]], atol=1e-12)


def test_heavy_rows_are_summed_as_whole_numbers():
    features = B.Features(["a"], [2], [np.array([1.0])], [-1])
    sums = B.Histograms(features, [[1]])
    big, one = np.array([(1 << 60) + 1, 3]), np.zeros(2, np.int64)
    sums.add(0, one, np.array([[0, 1]]), big, big)
    assert sums.held[0, 0][0].tolist() == [0, (1 << 60) + 1, 3]


def grown_tree(rng, depth, sizes, levels):
    tree = B.Tree(depth)
    for node in range(1, 1 << depth):
        if node == 1 or (tree.cut[node // 2] and rng.random() < 0.8):
            f = rng.randrange(len(sizes))
            tree.cut[node], tree.feature[node] = True, f
            if f in levels:
                tree.listed[node] = (np.array(rng.sample(range(-1, sizes[f]), min(5, sizes[f])), np.int32), rng.random() < 0.5)
            else:
                tree.below[node], tree.absent_left[node] = rng.randrange(sizes[f] + 1), rng.random() < 0.5
    tree.value = np.array([rng.random() for _ in tree.value])
    return tree


@pytest.mark.parametrize("sizes", [[6, 40, 256], [6, 9000, 256]])
def test_places_are_those_of_the_steps(sizes):
    rng = random.Random(5)
    bins = np.array([[rng.randrange(-1, s) for _ in range(700)] for s in sizes], np.int32)
    for _ in range(20):
        tree = grown_tree(rng, 5, sizes, (0, 1))
        at = np.ones(700, np.int64)
        for level in range(5):
            at = tree.step(bins, at, level)
        assert tree.places(bins).tolist() == at.tolist()


def test_margins_move_on_once_a_round(spark, monkeypatch):
    """A round's trees are read once, by the rows that its models train on or score, and nothing is kept after the fit."""
    rng = random.Random(6)
    table = [(rng.randrange(40), rng.random()) for _ in range(400)]
    labels, member, scored = [i % 3 for i in range(400)], [i % 4 for i in range(400)], [3 * (i % 2) for i in range(400)]
    features = B.Features(["a", "b"], [40, 30], [None, np.arange(1, 30) / 30], [0, -1])
    models = [B.Model(0, "softmax", [0.0, 1.0, 2.0]), B.Model(1, "softmax", [0.0, 1.0, 2.0])]
    rows = rows_of(spark, features, table, labels, member, scored)
    kept = spark.sparkContext._jsc.getPersistentRDDs().size()
    moved, after = [], B._after
    monkeypatch.setattr(B, "_after", lambda *a: moved.append(a) or after(*a))
    monkeypatch.setattr(B, "KEEP", 3)
    passes = B.fit(rows, features, models, 5, 3, local_cells=0)
    assert len(moved) == 5
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == kept
    whole = B.fit(rows, features, models, 5, 3)
    key = lambda d: sorted(map(tuple, d.collect()))
    assert key(passes.ledger) == key(whole.ledger)
    assert key(passes.predictions) == key(whole.predictions)
    block = B.Block(np.zeros(400), np.array(member), np.array(scored), None, np.zeros((2, 400), np.int32), np.zeros((6, 400)))
    seen, places = [], B.Tree.places
    monkeypatch.setattr(B.Tree, "places", lambda tree, b: seen.append(b.shape[1]) or places(tree, b))
    B._advanced(block, models, [grown_tree(rng, 3, [40, 30], (0,)) for _ in range(6)])
    assert seen == [sum((m | s) >> k & 1 for m, s in zip(member, scored, strict=True)) for k in (0, 0, 0, 1, 1, 1)]
