"""Two-sample statistics against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellwise.operators import pairs as P
from cellwise.operators import splitting as X
from cellwise.operators import stats as T


@pytest.fixture(scope="module")
def counts(spark):
    rng = random.Random(3)
    rows = []
    for key in ("hot", "cold"):
        for x in sorted({round(rng.gauss(0, 3), 2) for _ in range(600 if key == "hot" else 9)}):
            rows.append((key, x, rng.randint(0, 4), rng.randint(0, 4)))
    return spark.createDataFrame(rows, "k string, x double, n_real bigint, n_synth bigint"), rows


def brute(rows, key):
    own = [(x, a, b) for k, x, a, b in rows if k == key]
    x = np.array([r[0] for r in own])
    f = np.cumsum([r[1] for r in own]) / sum(r[1] for r in own)
    g = np.cumsum([r[2] for r in own]) / sum(r[2] for r in own)
    return 1 - np.abs(f - g).max(), float(np.sum(np.abs(f - g)[:-1] * np.diff(x)))


def test_ks_and_wasserstein(counts):
    df, rows = counts
    ks = {r["k"]: r["score"] for r in T.ks_complement(df, ["k"]).collect()}
    w1 = {r["k"]: r["wasserstein"] for r in T.wasserstein(df, ["k"]).collect()}
    for key in ("hot", "cold"):
        want_ks, want_w1 = brute(rows, key)
        assert ks[key] == pytest.approx(want_ks)
        assert w1[key] == pytest.approx(want_w1)


def test_quantile(spark):
    xs = [float(x) for x in np.random.default_rng(0).normal(size=501).round(2)]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    for q in (0.0, 0.35, 0.65, 1.0):
        got = T.exact_quantile(df, "x", q).first()["quantile"]
        assert got == pytest.approx(float(np.quantile(xs, q)))


def test_one_empty_side_scores_zero(spark):
    df = spark.createDataFrame([("a", 1.0, 3, 0), ("a", 2.0, 1, 0)], "k string, x double, n_real bigint, n_synth bigint")
    assert T.ks_complement(df, ["k"]).first()["score"] == 0.0
    assert T.tv_complement(df, ["k"]).first()["score"] == 0.0


def test_auc_with_ties(spark):
    rng = np.random.default_rng(1)
    y, p = rng.integers(0, 2, 300), rng.integers(0, 20, 300) / 20
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, p)], "y int, p double")
    pos, neg = p[y == 1], p[y == 0]
    want = ((pos[:, None] > neg).sum() + 0.5 * (pos[:, None] == neg).sum()) / (len(pos) * len(neg))
    assert T.roc_auc(df, [], "p", F.col("y") == 1).first()["roc_auc"] == pytest.approx(want)
    assert T.roc_auc(df.filter("y = 1"), [], "p", F.col("y") == 1).first()["roc_auc"] is None


def test_bins_are_right_closed(spark):
    df = spark.createDataFrame([(x,) for x in (1.0, 2.0, 3.0, 10.0)], "x double")
    bins = [r[0] for r in df.select(P.bin_of(F.col("x"), F.lit(1.0), F.lit(10.0), F.lit(4))).collect()]
    assert bins == [0, 0, 0, 3]


@pytest.mark.parametrize("distinct", [1, 2, 5, 9, 10, 11, 40, 500])
def test_bin_count_is_exact(spark, monkeypatch, distinct):
    """Few hash buckets force the exact fallback for collisions."""
    monkeypatch.setattr(P, "HASH_BUCKETS", 3)
    rows = spark.range(600).select(
        F.when(F.col("id") % 2 == 0, "train").otherwise("synth").alias("split"),
        F.lit(1).alias("replicate"),
        F.array(F.struct(F.lit(2).alias("o"), F.lit("k").alias("k"))).alias("labels"),
        F.array(F.struct(F.lit(1).alias("o"), (F.col("id") % distinct).cast("double").alias("x"))).alias("numbers"),
    )
    assert P.bin_edges(rows).first()["bins"] == min(10, distinct)


def test_hash_samples_are_exact(spark):
    rows = spark.range(1000).select(F.col("id").alias("rid"), F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("c"))
    parts = {r["part"]: r["count"] for r in X.split_random(rows, 0.9).groupBy("part").count().collect()}
    assert parts == {"train": 900, "test": 100}
    again = {r["rid"] for r in X.split_random(rows.repartition(13), 0.9).filter("part = 'test'").collect()}
    assert again == {r["rid"] for r in X.split_random(rows, 0.9).filter("part = 'test'").collect()}
    small = {r["c"]: r["count"] for r in X.subsample_stratified(rows, 0.1, "c").groupBy("c").count().collect()}
    assert small == {"a": 33, "b": 67}
    with pytest.raises(ValueError):
        X.subsample_stratified(rows, 1.0, "c")
    folds = X.stratified_kfold(rows, "c", 3).groupBy("c", "fold").count().collect()
    assert {r["count"] for r in folds if r["c"] == "a"} <= {111, 112} and len(folds) == 6


def test_tiny_class_has_no_folds(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (3, "b")], "rid bigint, c string")
    assert X.stratified_kfold(rows, "c", 3).filter("fold IS NOT NULL").count() == 0


def test_classification_metrics_by_hand(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), ("b", "c")], "y string, g string")
    row = T.classification_metrics(df, "y", "g").first()
    assert row["accuracy"] == 0.5
    assert row["f1_macro"] == pytest.approx((2 / 3 + 0.5 + 0) / 3)
    assert row["f1_weighted"] == pytest.approx((2 / 3 * 2 + 0.5 * 2) / 4)
