"""Results as tables: written per run and replicate, scanned by partition folders."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

METRICS_SCHEMA = "metric string, value double, dataset string, model string, mode string, replicate int"


def write_metrics(metrics: DataFrame, path: str, mode: str = "append") -> None:
    """One JSON folder per data set, model, mode and replicate."""
    metrics.write.mode(mode).partitionBy("dataset", "model", "mode", "replicate").json(path)


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(METRICS_SCHEMA).json(path)


def run_metrics(
    runs: DataFrame,
    metrics: Sequence[str],
    datasets: Mapping[str, str],
    models: Mapping[str, str],
    default_model: str,
    private_mark: str = "dcr",
) -> DataFrame:
    """Metrics of tracked runs whose name tells data set, model and mode.

    ``datasets`` maps name prefixes, ``models`` maps name parts; a run of unknown data set
    is dropped, and an id seen twice counts once. ``-`` and empty cells are no values."""
    name = F.col("name")
    dataset = F.lit(None).cast("string")
    for prefix, label in reversed(list(datasets.items())):
        dataset = F.when(name.startswith(prefix), F.lit(label)).otherwise(dataset)
    model = F.lit(default_model)
    for part, label in models.items():
        model = F.when(name.contains(part), F.lit(label)).otherwise(model)
    parsed = runs.dropDuplicates(["id"]).select(
        "id",
        dataset.alias("dataset"),
        model.alias("model"),
        F.when(name.contains(private_mark), "dcr").otherwise("base").alias("mode"),
        *[F.nullif(F.nullif(F.col(m).cast("string"), F.lit("-")), F.lit("")).cast("double").alias(m) for m in metrics],
    )
    return (
        parsed.filter("dataset IS NOT NULL")
        .unpivot(["id", "dataset", "model", "mode"], list(metrics), "metric", "value")
        .filter("value IS NOT NULL")
    )
