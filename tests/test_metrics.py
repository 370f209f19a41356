"""Whole metrics: bounds on identical and shifted data, exact nearest records, models."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellwise.operators import benchmark as B
from cellwise.operators import detection as D
from cellwise.operators import features as E
from cellwise.operators import pairs as P
from cellwise.operators import privacy as V
from cellwise.operators import shapes as S
from cellwise.operators import utility as L
from cellwise.operators.cells import flatten, typed_view
from cellwise.operators.generation import generate_replicates, pending_replicates
from cellwise.plans import evaluate as EV
from cellwise.sources.catalog import CATALOG


def people(n, seed, shift=0):
    rng = np.random.default_rng(seed)
    return [
        {"age": int(rng.integers(20, 70)) + shift, "income": float(round(rng.normal(50000 + 3000 * shift, 9000), 2)),
         "label": str(rng.choice(["A", "B", "C"] if not shift else ["X", "Y"]))}
        for _ in range(n)
    ]


def overall(records):
    cells = flatten(records, max_depth=2)
    counts, sizes = S.value_counts(cells), S.split_sizes(records)
    shapes = S.column_shapes(S.field_fidelity(counts, sizes), sizes)
    trends = P.column_pair_trends(P.pair_fidelity(cells, counts, sizes), sizes)
    return P.fidelity_overall(shapes, trends).first()


def test_fidelity_bounds(to_records):
    real = people(120, 1)
    same = overall(to_records(train=real, synth=real))
    assert same["shapes"] == pytest.approx(1.0) and same["fidelity"] >= 0.9
    other = overall(to_records(train=real, synth=people(120, 2, shift=30)))
    assert other["fidelity"] < 0.95 and other["fidelity"] < same["fidelity"]


def test_fidelity_is_symmetric(to_records):
    a, b = people(60, 3), people(80, 4, shift=5)
    one, two = overall(to_records(train=a, synth=b)), overall(to_records(train=b, synth=a))
    assert one["fidelity"] == pytest.approx(two["fidelity"])


def test_pair_never_present_together_scores_zero(to_records):
    records = to_records(
        train=[{"a": 1, "b": "x"}, {"a": 2, "b": "y"}, {"a": 3, "b": "y"}], synth=[{"a": 1}, {"b": "x"}, {"a": 2}]
    )
    cells = flatten(records, max_depth=1)
    pairs = {r["pair"]: r for r in P.pair_fidelity(cells, S.value_counts(cells), S.split_sizes(records)).collect()}
    row = pairs["a.num|b.cat"]
    assert (row["metric"], row["score"], row["presence"]) == ("N/A", 0.0, 1.0)


def brute_distances(vectors):
    rows = vectors.collect()
    ids = sorted({i for r in rows for i in r["idx"]})
    at = {i: k for k, i in enumerate(ids)}

    def dense(r):
        out = np.zeros(len(ids))
        out[[at[i] for i in r["idx"]]] = r["val"]
        return out

    groups = {s: np.array([dense(r) for r in rows if r["split"] == s]) for s in ("train", "test", "synth")}
    rids = [r["rid"] for r in rows if r["split"] == "synth"]
    return {
        rid: tuple(np.sqrt(((groups[s] - q) ** 2).sum(axis=1)).min() for s in ("train", "test"))
        for rid, q in zip(rids, groups["synth"])
    }


@pytest.mark.parametrize("fan, leaf", [(4, 9), (32, 1024)])
def test_nearest_record_equals_brute_force(to_records, fan, leaf):
    train, test = people(90, 5), people(70, 6)
    records = to_records(train=train, test=test, synth=people(60, 7) + train[:8] * 6)  # a crowd of copies
    vectors = V.privacy_vectors(flatten(records, max_depth=1), records)
    want = brute_distances(vectors)
    got = {r["rid"]: (r["d_train"], r["d_test"]) for r in V.dcr_distances(vectors, fan=fan, leaf_rows=leaf).collect()}
    assert got.keys() == want.keys()
    for rid in want:
        assert got[rid] == pytest.approx(want[rid], abs=1e-9)


def test_privacy_counts_copies(to_records):
    train = people(40, 8)
    records = to_records(train=train, test=people(30, 9), synth=train[:5] + train[:1] + people(10, 10))
    row = V.privacy_metrics(records, lambda r: flatten(r, max_depth=1)).first()
    assert row["exact_matches_train"] == 6 and row["exact_matches_test"] == 0 and row["ref_size"] == 30
    assert 0 <= row["privacy_score"] <= 1


def test_projection_is_the_product_with_the_drawn_matrix(to_records):
    """Every entry against a dense product; distances within the bound of 5 deviations of a projection to 400 dimensions."""
    records = to_records(train=people(60, 11), test=people(5, 12), synth=people(5, 13))
    typed = typed_view(flatten(records, max_depth=1), ("rid", "split"))
    full = V.sparse_vectors(E.scale_by_train_range(E.encode_features(typed, records, keys=("rid", "split"))))
    assert V.random_projection(full, 10, 40) is full
    rows = {r["rid"]: dict(zip(r["idx"], r["val"], strict=True)) for r in full.collect()}
    small = {r["rid"]: dict(zip(r["idx"], r["val"], strict=True)) for r in V.random_projection(full, 2000, 400).collect()}
    ids = sorted({i for r in rows.values() for i in r})
    matrix, density = np.zeros((len(ids), 400)), 2000**-0.5
    for k, i in enumerate(ids):
        at, signs = V.drawn_row(42, i, 400, density)
        matrix[k, at] = signs * density**-0.5 / 20
    x = np.array([[rows[r].get(i, 0.0) for i in ids] for r in sorted(rows)])
    y = np.array([[small[r].get(j, 0.0) for j in range(400)] for r in sorted(rows)])
    assert np.allclose(y, x @ matrix, atol=1e-12)
    square = lambda m: ((m[:, None] - m[None]) ** 2).sum(axis=2)
    away = square(x) > 0
    ratio = square(y)[away] / square(x)[away]
    assert abs(ratio.mean() - 1) < 0.25


def test_drawn_rows_have_the_density():
    rows = [V.drawn_row(1, i, 5000, 0.02) for i in range(200)]
    sizes = np.array([len(a) for a, _ in rows])
    assert abs(sizes.mean() - 100) < 5 * (98 / 200) ** 0.5 + 1
    assert all((np.diff(a) > 0).all() and a.max() < 5000 for a, _ in rows if len(a))
    assert abs(np.concatenate([s for _, s in rows]).mean()) < 0.04


def test_constant_columns_only_is_an_error(to_records):
    records = to_records(train=[{"a": 1}, {"a": 1}])
    cols = E.informative_columns(typed_view(flatten(records)), records.agg(F.count(F.lit(1))))
    with pytest.raises(ValueError, match="No valid features"):
        E.require_columns(cols)


def test_detection_bounds(to_records):
    real = people(150, 14)
    alike = to_records(train=real, synth=people(150, 15))
    apart = to_records(train=real, synth=people(150, 16, shift=30))
    a = D.detection_metrics(flatten(alike, max_depth=1), alike).first()
    b = D.detection_metrics(flatten(apart, max_depth=1), apart).first()
    assert b["roc_auc"] > 0.9 and b["detection"] < a["detection"]
    lin = D.detection_metrics(flatten(apart, max_depth=1), apart, method="logistic_regression").first()
    assert lin["roc_auc"] > 0.9
    with pytest.raises(ValueError):
        D.detection_folds(flatten(alike), alike, method="other")
    tiny = to_records(train=real[:1], synth=real[:5])
    assert D.detection_metrics(flatten(tiny, max_depth=1), tiny).first()["detection"] == 1.0


def test_utility_bounds(to_records):
    records = to_records(train=people(120, 17), test=people(60, 18), synth=people(120, 19))
    cells = flatten(records, max_depth=1)
    row = L.score_from_metrics(L.utility_metrics(cells, records, "label", trees=5, depth=3)).first()
    assert 0 <= row["utility"] <= 1 and 0 <= row["trtr"] <= 1
    reg = L.score_from_metrics(L.utility_metrics(cells, records, "income", "regression", trees=3, depth=2), "regression").first()
    assert 0 <= reg["utility"] <= 1
    with pytest.raises(ValueError, match="Available fields"):
        L.check_target(cells, "nothing")


def test_audit_of_real_data_has_no_failure(spark):
    records = B.to_records(B.generate(spark.range(3000).withColumnRenamed("id", "rid")))
    cells = flatten(records, ("rid",), max_depth=1)
    statuses = {r["name"]: r["status"] for r in B.audit(cells, records, cells, records).collect()}
    assert "FAIL" not in statuses.values()
    bare = records.withColumn("v", F.parse_json(F.lit('{"cont_a": 1}')))
    broken = {r["name"]: r["status"] for r in B.audit(flatten(bare, ("rid",), max_depth=1), bare, cells, records).collect()}
    assert broken["all_columns_present"] == "FAIL" and broken["type_target"] == "FAIL"


def test_generation_is_independent_of_partitions(spark):
    make = lambda rng, i: f'{{"x": {rng.random():.9f}}}'
    read = lambda df: sorted((r["replicate"], r["rid"], r["t"]) for r in df.select("replicate", "rid", F.to_json("v").alias("t")).collect())
    assert read(generate_replicates(spark, 20, [1, 2], make, partitions=1)) == read(generate_replicates(spark, 20, [1, 2], make, partitions=7))
    existing = spark.createDataFrame([(1,)] * 20 + [(2,)] * 3, "replicate int")
    assert pending_replicates(existing, 3, 20) == [2, 3]


def test_evaluate_modes(to_records):
    base = to_records(train=people(40, 20), test=people(20, 21), synth=people(40, 22))
    run = lambda r: flatten(r, max_depth=1)
    names = {r["metric"] for r in EV.evaluate_mode(base, run, [1], mode="dcr").collect()}
    assert "privacy" in names and "fidelity" not in names
    names = {r["metric"] for r in EV.evaluate(base, run, [1], parts=("fidelity",)).collect()}
    assert {"num_train", "fidelity", "fidelity_shapes", "fidelity_trends"} <= names
    with pytest.raises(ValueError):
        EV.evaluate_mode(base, run, [1], mode="none")


def test_unknown_data_set_lists_names():
    with pytest.raises(ValueError, match="Available: events, orders"):
        CATALOG.get("nope")
