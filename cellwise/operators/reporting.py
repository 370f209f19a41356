"""Aggregates over replicates and leaderboards, on the long metrics table.

Metrics rows: (dataset, model, mode, replicate, metric, value).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

RUN = ("dataset", "model", "mode")
# The metrics that are ranked, and which direction is better (1 up, -1 down). Others, such as
# the DCR score and counts of rows or copies, are reported without a winner.
DIRECTIONS = {
    "fidelity": 1,
    "fidelity_shapes": 1,
    "fidelity_trends": 1,
    "utility": 1,
    "utility_trtr_f1_weighted": 1,
    "utility_tstr_f1_weighted": 1,
    "detection": 1,
    "detection_roc_auc": -1,
    "privacy": 1,
    "privacy_exact_matches_train": -1,
}


def aggregate_replicates(metrics: DataFrame, keys: Sequence[str] = RUN) -> DataFrame:
    """Mean, sample deviation (0 for one value) and values in replicate order per metric.

    Only metrics of the first replicate are kept, as later ones may lack or add some."""
    keys = list(keys)
    first = Window.partitionBy(*keys)
    grouped = metrics.groupBy(*keys, "metric").agg(
        F.avg("value").alias("mean"),
        F.coalesce(F.stddev_samp("value"), F.lit(0.0)).alias("std"),
        F.transform(F.sort_array(F.collect_list(F.struct("replicate", "value"))), lambda e: e["value"]).alias("values"),
        F.min("replicate").alias("from_replicate"),
    )
    return (
        grouped.withColumn("first_replicate", F.min("from_replicate").over(first))
        .filter(F.col("from_replicate") == F.col("first_replicate"))
        .drop("from_replicate", "first_replicate")
    )


def replicate_counts(metrics: DataFrame, models: Sequence[str]) -> DataFrame:
    """Replicates per dataset and mode, one column per model in the given order."""
    counts = metrics.groupBy("dataset", "mode").pivot("model", list(models)).agg(F.countDistinct("replicate"))
    return counts.na.fill(0)


def direction_of(metric):
    out = F.lit(0)
    for name, sign in DIRECTIONS.items():
        out = F.when(metric == name, F.lit(sign)).otherwise(out)
    return out


def leaderboard(aggregated: DataFrame) -> DataFrame:
    """Best models per dataset and metric; ties are kept and undirected metrics have none."""
    signed = aggregated.withColumn("direction", direction_of(F.col("metric")))
    best = Window.partitionBy("dataset", "mode", "metric").orderBy(F.desc(F.col("mean") * F.col("direction")))
    return (
        signed.withColumn("place", F.rank().over(best))
        .withColumn("is_best", (F.col("place") == 1) & (F.col("direction") != 0))
        .drop("place", "direction")
    )


def leaderboard_wide(aggregated: DataFrame, models: Sequence[str], failures: DataFrame | None = None) -> DataFrame:
    """Means per dataset, mode and metric with models as columns; a failed run reads ``OOM``.

    ``failures``: (dataset, model), and ``mode`` if a run failed in one mode only."""
    text = F.format_string("%.3f", F.col("mean"))
    keys = ["dataset", "mode", "metric"]
    cells = aggregated.select(*keys, "model", text.alias("text"))
    if failures is not None:
        on = [c for c in ("dataset", "mode") if c in failures.columns]
        wanted = aggregated.select(*keys).distinct()
        marked = wanted.join(failures.select(*on, "model").distinct(), on).withColumn("failed", F.lit("OOM"))
        cells = cells.join(marked, [*keys, "model"], "full").select(*keys, "model", F.coalesce("text", "failed").alias("text"))
    return cells.groupBy(*keys).pivot("model", list(models)).agg(F.first("text", ignorenulls=True)).na.fill("-")
