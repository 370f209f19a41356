"""Replicated generation of records by a user function."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def pending_replicates(existing: DataFrame | None, replicates: int, n: int) -> list[int]:
    """Replicates to (re)generate: those absent or without exactly ``n`` records."""
    wanted = range(1, replicates + 1)
    if existing is None:
        return list(wanted)
    done = existing.groupBy("replicate").agg(F.count(F.lit(1)).alias("m")).filter(F.col("m") == n)
    complete = {r["replicate"] for r in done.collect()}
    return [r for r in wanted if r not in complete]


def generate_replicates(
    spark: SparkSession,
    n: int,
    replicates: list[int],
    make_record: Callable[[np.random.Generator, int], str],
    seed_base: int = 42,
    partitions: int | None = None,
) -> DataFrame:
    """``n`` records per replicate from ``make_record(generator, i)``, which returns JSON text.

    Every record has its own generator seeded by (seed_base + replicate - 1, i): the
    result does not depend on the partitioning, and Spark's task retries repeat it exactly."""
    span = spark.range(0, n * len(replicates), 1, partitions) if partitions else spark.range(n * len(replicates))
    slot = F.element_at(F.array(*[F.lit(r) for r in replicates]), (F.floor(F.col("id") / n) + 1).cast("int"))
    jobs = span.select(slot.alias("replicate"), (F.col("id") % n).alias("i"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            text = [
                make_record(np.random.default_rng([seed_base + int(r) - 1, int(i)]), int(i))
                for r, i in zip(pdf["replicate"], pdf["i"])
            ]
            yield pd.DataFrame({"replicate": pdf["replicate"], "rid": pdf["i"], "doc": text})

    return jobs.mapInPandas(run, "replicate int, rid bigint, doc string").select(
        "replicate", "rid", F.parse_json("doc").alias("v")
    )
