"""Two-sample statistics over pre-aggregated value counts.

All functions take a *counts* frame: key columns, a value, and the number of rows with
that value on each side. Rows are aggregated map-side before any shuffle, so a value
shared by a third of all rows costs one row here.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellwise.session import materialize


def plan_bytes(df: DataFrame) -> int:
    """Optimizer's size estimate; exact file sizes for a frame read from a table."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def paired_counts(
    values: DataFrame,
    by: Sequence[str],
    real: str = "train",
    synth: str = "synth",
    replicates: Sequence[int] | None = None,
) -> DataFrame:
    """Count rows per value on the real and the synthetic side in one aggregation.

    With ``replicates`` the synthetic side is counted per replicate and the real
    counts are copied to each of them, after aggregation."""
    by = list(by)
    is_real, is_synth = F.col("split") == real, F.col("split") == synth
    used = values.filter(F.col("split").isin(real, synth))
    if replicates is None:
        return used.groupBy(F.lit(0).alias("replicate"), *by).agg(
            F.count_if(is_real).alias("n_real"), F.count_if(is_synth).alias("n_synth")
        )
    reps = [int(r) for r in replicates]
    counted = (
        used.withColumn("replicate", F.when(is_synth, F.col("replicate")))
        .groupBy("split", "replicate", *by)
        .agg(F.count(F.lit(1)).alias("n"))
    )
    target = F.when(is_real, F.array(*[F.lit(r) for r in reps])).otherwise(F.array("replicate"))
    return (
        counted.withColumn("replicate", F.explode(target))
        .filter(F.col("replicate").isin(reps))
        .groupBy("replicate", *by)
        .agg(
            F.sum(F.when(is_real, F.col("n")).otherwise(0)).alias("n_real"),
            F.sum(F.when(is_synth, F.col("n")).otherwise(0)).alias("n_synth"),
        )
    )


def running_totals(
    counts: DataFrame, keys: Sequence[str], order: str, sums: Sequence[str], next_value: bool = False
) -> DataFrame:
    """Add ``cum_<c>``: sum of ``c`` over all rows of the key up to this one, by ``order``.

    Rows are range-partitioned by (key, order) and written once; each range is summed on its own and
    lifted by the total of the ranges before it, so a key holding most rows is spread over many tasks.
    ``next_value`` adds ``next_<order>``.
    """
    keys = list(keys)
    ranges = int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = materialize(
        counts.repartitionByRange(ranges, *keys, order).withColumn("range_id", F.spark_partition_id())
    )
    per_range = ranged.groupBy(*keys, "range_id").agg(
        *[F.sum(c).alias(f"part_{c}") for c in sums], F.min(order).alias("first_value")
    )
    by_range = Window.partitionBy(*keys).orderBy("range_id")
    before = by_range.rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_range.select(
        *keys,
        "range_id",
        *[F.coalesce(F.sum(f"part_{c}").over(before), F.lit(0)).alias(f"off_{c}") for c in sums],
        F.lead("first_value").over(by_range).alias("next_first"),
    )
    inside = Window.partitionBy(*keys, "range_id").orderBy(order)
    running = inside.rowsBetween(Window.unboundedPreceding, 0)
    out = ranged.join(offsets, [*keys, "range_id"]).select(
        *counts.columns,
        *[(F.sum(c).over(running) + F.col(f"off_{c}")).alias(f"cum_{c}") for c in sums],
        *([F.coalesce(F.lead(order).over(inside), F.col("next_first")).alias(f"next_{order}")] if next_value else []),
    )
    return out


def side_totals(counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    return counts.groupBy(*keys).agg(F.sum("n_real").alias("t_real"), F.sum("n_synth").alias("t_synth"))


def share(n: Column | str, total: Column | str) -> Column:
    n = F.col(n) if isinstance(n, str) else n
    total = F.col(total) if isinstance(total, str) else total
    return F.when(total > 0, n.cast("double") / total)


def tv_complement(counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Total-variation complement per key: 1 minus half the summed share differences.

    A side without rows scores 0."""
    keys = list(keys)
    gaps = counts.join(side_totals(counts, keys), keys)
    return gaps.groupBy(*keys).agg(
        F.max("t_real").alias("t_real"),
        F.max("t_synth").alias("t_synth"),
        F.coalesce(
            F.lit(1.0) - F.lit(0.5) * F.sum(F.abs(share("n_real", "t_real") - share("n_synth", "t_synth"))),
            F.lit(0.0),
        ).alias("score"),
    )


def cdf_gaps(counts: DataFrame, keys: Sequence[str], order: str = "x", next_value: bool = False) -> DataFrame:
    """Both cumulative shares at every distinct value, per key."""
    keys = list(keys)
    running = running_totals(counts, keys, order, ["n_real", "n_synth"], next_value)
    return running.join(side_totals(counts, keys), keys).select(
        *keys,
        order,
        *([f"next_{order}"] if next_value else []),
        "t_real",
        "t_synth",
        (share("cum_n_real", "t_real") - share("cum_n_synth", "t_synth")).alias("gap"),
    )


def ks_complement(counts: DataFrame, keys: Sequence[str], order: str = "x") -> DataFrame:
    """Two-sample Kolmogorov-Smirnov complement per key; a side without rows scores 0."""
    return (
        cdf_gaps(counts, keys, order)
        .groupBy(*keys)
        .agg(
            F.max("t_real").alias("t_real"),
            F.max("t_synth").alias("t_synth"),
            F.coalesce(F.lit(1.0) - F.max(F.abs("gap")), F.lit(0.0)).alias("score"),
        )
    )


def wasserstein(counts: DataFrame, keys: Sequence[str], order: str = "x") -> DataFrame:
    """Wasserstein-1 distance per key (area between the cumulative shares), with the
    mean and population standard deviation of both sides."""
    keys = list(keys)
    area = (
        cdf_gaps(counts, keys, order, next_value=True)
        .groupBy(*keys)
        .agg(F.coalesce(F.sum(F.abs("gap") * (F.col(f"next_{order}") - F.col(order))), F.lit(0.0)).alias("wasserstein"))
    )
    x = F.col(order)
    moments = counts.groupBy(*keys).agg(
        *[
            expr
            for side in ("real", "synth")
            for expr in (
                F.try_divide(F.sum(x * F.col(f"n_{side}")), F.sum(f"n_{side}")).alias(f"mean_{side}"),
                F.try_divide(F.sum(x * x * F.col(f"n_{side}")), F.sum(f"n_{side}")).alias(f"square_{side}"),
            )
        ]
    )
    deviation = lambda side: F.sqrt(
        F.greatest(F.col(f"square_{side}") - F.col(f"mean_{side}") * F.col(f"mean_{side}"), F.lit(0.0))
    )
    return area.join(moments, keys).select(
        *keys,
        "mean_real",
        deviation("real").alias("sd_real"),
        "mean_synth",
        deviation("synth").alias("sd_synth"),
        "wasserstein",
    )


def roc_auc(scored: DataFrame, keys: Sequence[str], score: str, positive: Column) -> DataFrame:
    """Exact area under the ROC curve per key (rank statistic, ties count one half).

    Only distinct scores are sorted. A key with a single class gives NULL."""
    keys = list(keys)
    counts = scored.groupBy(*keys, F.col(score).alias("x")).agg(
        F.count_if(positive).alias("n_pos"), F.count_if(~positive).alias("n_neg")
    )
    running = running_totals(counts, keys or ["n_all"], "x", ["n_neg"]) if keys else None
    if running is None:
        counts = counts.withColumn("n_all", F.lit(0))
        running = running_totals(counts, ["n_all"], "x", ["n_neg"])
    wins = F.sum(F.col("n_pos") * (F.col("cum_n_neg") - F.col("n_neg") / F.lit(2.0)))
    pairs = F.sum("n_pos").cast("double") * F.sum("n_neg").cast("double")
    return running.groupBy(*keys).agg(F.when(pairs > 0, wins / pairs).alias("roc_auc"))


def confusion(predicted: DataFrame, label: str, prediction: str, keys: Sequence[str] = ()) -> DataFrame:
    return predicted.groupBy(
        *keys, F.col(label).alias("label"), F.col(prediction).alias("prediction")
    ).agg(F.count(F.lit(1)).alias("n"))


def classification_metrics(predicted: DataFrame, label: str, prediction: str, keys: Sequence[str] = ()) -> DataFrame:
    """Accuracy, support-weighted F1 and macro F1 over labels seen as truth or prediction."""
    keys = list(keys)
    cells = confusion(predicted, label, prediction, keys)
    sides = F.array(
        F.struct(
            F.col("label").alias("class"),
            F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(0).alias("hit"),
            F.col("n").alias("truth"),
            F.lit(0).cast("bigint").alias("guess"),
        ),
        F.struct(
            F.col("prediction").alias("class"),
            F.lit(0).cast("bigint").alias("hit"),
            F.lit(0).cast("bigint").alias("truth"),
            F.col("n").alias("guess"),
        ),
    )
    per_class = (
        cells.select(*keys, F.explode(sides).alias("s"))
        .groupBy(*keys, "s.class")
        .agg(F.sum("s.hit").alias("hit"), F.sum("s.truth").alias("truth"), F.sum("s.guess").alias("guess"))
        .withColumn("f1", F.lit(2.0) * F.col("hit") / (F.col("truth") + F.col("guess")))
    )
    return per_class.groupBy(*keys).agg(
        (F.sum("hit").cast("double") / F.sum("truth")).alias("accuracy"),
        (F.sum(F.col("f1") * F.col("truth")) / F.sum("truth")).alias("f1_weighted"),
        F.avg("f1").alias("f1_macro"),
    )


def regression_metrics(predicted: DataFrame, label: str, prediction: str, keys: Sequence[str] = ()) -> DataFrame:
    """R2, mean squared error and its root, from sums of one aggregation."""
    keys = list(keys)
    y, p = F.col(label).cast("double"), F.col(prediction).cast("double")
    sums = predicted.groupBy(*keys).agg(
        F.avg((y - p) * (y - p)).alias("mse"),
        F.var_pop(y).alias("variance"),
    )
    return sums.select(
        *keys,
        F.when(F.col("variance") > 0, F.lit(1.0) - F.col("mse") / F.col("variance"))
        .when(F.col("mse") == 0, F.lit(1.0))
        .otherwise(F.lit(0.0))
        .alias("r2"),
        "mse",
        F.sqrt("mse").alias("rmse"),
    )


def roc_auc_one_vs_rest(probabilities: DataFrame, label: str, classes: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Support-weighted one-vs-rest AUC over the classes of the test labels.

    Probabilities are rescaled to sum to one over these classes (a zero row stays
    zero). Two classes use the second one alone; fewer give 0.5."""
    if len(classes) < 2:
        return probabilities.agg(F.lit(0.5).alias("roc_auc"))
    if len(classes) == 2:
        scored = probabilities.select(F.col(label).alias("y"), F.col(columns[1]).alias("p"))
        return roc_auc(scored, [], "p", F.col("y") == classes[1]).select(
            F.coalesce("roc_auc", F.lit(0.5)).alias("roc_auc")
        )
    total = sum((F.col(c) for c in columns[1:]), F.col(columns[0]))
    scale = F.when(total == 0, F.lit(1.0)).otherwise(total)
    rows = probabilities.select(
        F.col(label).alias("y"),
        F.explode(
            F.array(*[F.struct(F.lit(k).alias("class"), (F.col(c) / scale).alias("p")) for k, c in zip(classes, columns)])
        ).alias("e"),
    ).select("y", "e.class", "e.p")
    auc = roc_auc(rows, ["class"], "p", F.col("y") == F.col("class"))
    support = probabilities.groupBy(F.col(label).alias("class")).agg(F.count(F.lit(1)).alias("support"))
    return auc.join(support, "class").agg(
        (F.sum(F.col("roc_auc") * F.col("support")) / F.sum("support")).alias("roc_auc")
    )


def exact_quantile(rows: DataFrame, column: str, q: float) -> DataFrame:
    """One row: quantile with linear interpolation, from running counts of distinct values."""
    counts = rows.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("x"), F.lit(0).alias("one")).agg(
        F.count(F.lit(1)).alias("m")
    )
    running = running_totals(counts, ["one"], "x", ["m"])
    place = (counts.agg(F.sum("m").alias("n")).scalar() - 1) * F.lit(q)
    low = F.min(F.when(F.col("cum_m") >= F.floor(place) + 1, F.col("x")))
    high = F.min(F.when(F.col("cum_m") >= F.ceil(place) + 1, F.col("x")))
    return running.agg((low + (high - low) * F.max(place - F.floor(place))).alias("quantile"))
