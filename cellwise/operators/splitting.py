"""Splits and samples by hash rank: exact sizes, no global sort, stable under repartitioning.

Every row has a repeatable key (md5 of seed and id). The number of rows per key prefix
tells which prefix holds the cut; only that slice is ranked row by row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellwise.functions.expr import rank_key
from cellwise.session import materialize

PREFIX = 4  # hex digits: 65,536 slices
BROADCAST_GROUPS = 100_000  # cuts (one small row per group) that may be broadcast


def _with_key(rows: DataFrame, seed: int, id_col: str) -> DataFrame:
    key = rank_key(seed, id_col)
    return rows.withColumn("_key", key).withColumn("_slice", F.substring("_key", 1, PREFIX))


def _group(by: Sequence[str]) -> list[str]:
    return list(by)


def cut_keys(rows: DataFrame, by: Sequence[str], quota: Column, seed: int, id_col: str) -> DataFrame:
    """Highest key inside the quota of each group. ``quota`` may use ``n``, the group size."""
    group = _group(by)
    keyed = _with_key(rows, seed, id_col).select(*group, "_key", "_slice").withColumn("_all", F.lit(0))
    group = ["_all", *group]
    slices = keyed.groupBy(*group, "_slice").agg(F.count(F.lit(1)).alias("m"))
    whole = Window.partitionBy(*group)
    upto = whole.orderBy("_slice").rowsBetween(Window.unboundedPreceding, 0)
    cut = (
        slices.withColumn("n", F.sum("m").over(whole))
        .withColumn("cum", F.sum("m").over(upto))
        .withColumn("quota", quota.cast("bigint"))
        .filter((F.col("cum") >= F.col("quota")) & (F.col("cum") - F.col("m") < F.col("quota")))
        .select(*group, "_slice", (F.col("quota") - (F.col("cum") - F.col("m"))).alias("wanted"))
    )
    inside = Window.partitionBy(*group, "_slice").orderBy("_key")
    return (
        keyed.join(cut, [*group, "_slice"])
        .withColumn("r", F.row_number().over(inside))
        .filter(F.col("r") == F.col("wanted"))
        .select(*group, F.col("_key").alias("_cut"))
    )


def mark_lowest(
    rows: DataFrame, by: Sequence[str], quota: Column, seed: int = 42, id_col: str = "rid", name: str = "chosen"
) -> DataFrame:
    """Flag the ``quota`` rows of lowest key in every group. Ids must be unique: rows that share an
    id share a key and are flagged together.

    Without groups the cut is a scalar subquery, so the rows stay where they are. With groups the
    cuts are written and counted: up to ``BROADCAST_GROUPS`` of them are broadcast, more are joined
    by shuffle (both sides plain exchanges, so a class with most rows can be split)."""
    cuts = cut_keys(rows, by, quota, seed, id_col)
    key = rank_key(seed, id_col)
    if not by:
        return rows.withColumn(name, F.coalesce(key <= cuts.select("_cut").scalar(), F.lit(False)))
    cuts = materialize(cuts.drop("_all"))
    known = F.broadcast(cuts) if cuts.count() <= BROADCAST_GROUPS else cuts
    return (
        rows.join(known, _group(by), "left")
        .withColumn(name, F.coalesce(key <= F.col("_cut"), F.lit(False)))
        .select(*rows.columns, name)
    )


def take_lowest(rows: DataFrame, by: Sequence[str], quota: Column, seed: int = 42, id_col: str = "rid") -> DataFrame:
    return mark_lowest(rows, by, quota, seed, id_col, "_chosen").filter("_chosen").drop("_chosen")


def split_random(rows: DataFrame, ratio: float, seed: int = 42, id_col: str = "rid") -> DataFrame:
    """Exact random split: ``floor(n * ratio)`` rows are ``train``, the others ``test``."""
    marked = mark_lowest(rows, [], F.floor(F.col("n") * F.lit(ratio)), seed, id_col, "_train")
    return marked.withColumn("part", F.when(F.col("_train"), "train").otherwise("test")).drop("_train")


def resplit_half(train: DataFrame, test: DataFrame, seed: int = 42, id_col: str = "rid") -> DataFrame:
    """Merge two splits and cut them into equal halves (privacy mode)."""
    return split_random(train.unionByName(test), 0.5, seed, id_col)


def subsample_stratified(
    rows: DataFrame, fraction: float, target: str | None, seed: int = 42, id_col: str = "rid"
) -> DataFrame:
    """The same fraction of every class, at least one row of each (half-even rounding).

    Without a target, ``floor(n * fraction)`` rows, at least one."""
    if not 0 < fraction < 1:
        raise ValueError(f"fraction must be between 0 and 1, got {fraction}")
    if target is None:
        return take_lowest(rows, [], F.greatest(F.lit(1), F.floor(F.col("n") * F.lit(fraction))), seed, id_col)
    classed = rows.withColumn("_class", F.coalesce(F.col(target).cast("string"), F.lit("__missing__")))
    quota = F.greatest(F.lit(1), F.bround(F.col("n") * F.lit(fraction)))
    return take_lowest(classed, ["_class"], quota, seed, id_col).drop("_class")


def subsample_equal(
    records: DataFrame, cut: str = "train", like: str = "test", seed: int = 42, id_col: str = "rid"
) -> DataFrame:
    """Cut one split to the size of another (fair reference sizes); other splits stay whole."""
    size = records.filter(F.col("split") == like).agg(F.count(F.lit(1))).scalar()
    kept = take_lowest(records.filter(F.col("split") == cut), [], F.least(F.col("n"), size), seed, id_col)
    return kept.unionByName(records.filter(F.col("split") != cut))


def subsample_cap(rows: DataFrame, limit: int, seed: int = 42, id_col: str = "rid") -> DataFrame:
    """At most ``limit`` rows, chosen by hash rank (a sampling option of the caller)."""
    return take_lowest(rows, [], F.least(F.col("n"), F.lit(limit)), seed, id_col)


def hash_rank(rows: DataFrame, by: Sequence[str], seed: int = 42, id_col: str = "rid") -> DataFrame:
    """Add ``rank`` (from 1) by key within each group; groups are ranked in slices, so one
    group holding most rows is spread over many tasks."""
    group = ["_all", *_group(by)]
    keyed = _with_key(rows, seed, id_col).withColumn("_all", F.lit(0))
    slices = keyed.groupBy(*group, "_slice").agg(F.count(F.lit(1)).alias("m"))
    before = Window.partitionBy(*group).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = slices.select(*group, "_slice", F.coalesce(F.sum("m").over(before), F.lit(0)).alias("off"))
    inside = Window.partitionBy(*group, "_slice").orderBy("_key")
    return (
        keyed.join(offsets, [*group, "_slice"])
        .withColumn("rank", F.row_number().over(inside) + F.col("off"))
        .select(*rows.columns, "rank")
    )


def stratified_kfold(rows: DataFrame, label: str, n_splits: int = 3, seed: int = 42, id_col: str = "rid") -> DataFrame:
    """Fold number per row with classes spread evenly. The fold count is at most the
    smallest class; below two folds there is no split and ``fold`` is NULL."""
    smallest = rows.groupBy(label).agg(F.count(F.lit(1)).alias("m")).agg(
        F.least(F.min("m"), F.lit(n_splits)).alias("k")
    ).scalar()
    ranked = hash_rank(rows, [label], seed, id_col).withColumn("_k", smallest)
    return ranked.withColumn("fold", F.when(F.col("_k") >= 2, (F.col("rank") - 1) % F.col("_k"))).drop("_k", "rank")
