"""Evaluation of synthetic replicates against real records, as one long metrics table."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellwise.operators import pairs as P
from cellwise.operators import shapes as S
from cellwise.operators.detection import detection_metrics
from cellwise.operators.privacy import privacy_metrics
from cellwise.operators.utility import score_from_metrics, utility_metrics
from cellwise.session import materialize

PARALLEL_REPLICATES = 4
MODES = {"standard": ("fidelity", "utility", "detection"), "dcr": ("privacy",)}


def evaluate(
    records: DataFrame,
    flatten: Callable[[DataFrame], DataFrame],
    replicates: Sequence[int],
    target: str | None = None,
    task: str = "classification",
    parts: Sequence[str] = ("fidelity", "utility", "privacy", "detection"),
    utility_options: dict | None = None,
    privacy_options: dict | None = None,
    detection_options: dict | None = None,
) -> DataFrame:
    """(replicate, metric, value) for every replicate of the synthetic split.

    Records are flattened once and written; all replicates share the fidelity jobs. The
    real side of fidelity and detection is the training split. Utility needs a target."""
    base = materialize(records)
    # privacy flattens its own fair sample, so only the other parts need the shared cells
    cells = materialize(flatten(base), "split") if {"fidelity", "utility", "detection"} & set(parts) else None
    reps = list(replicates)
    sizes = materialize(S.split_sizes(base, replicates=reps))
    n_eval = base.agg(F.count_if(F.col("split") == "test")).scalar()
    out = _long(
        sizes.select(
            "replicate",
            F.col("rows_real").cast("double").alias("num_train"),
            n_eval.cast("double").alias("num_eval"),
            F.col("rows_synth").cast("double").alias("num_synth"),
        )
    )
    if "fidelity" in parts:
        counts = S.value_counts(cells, replicates=reps)
        shapes = S.column_shapes(S.field_fidelity(counts, sizes), sizes)
        trends = P.column_pair_trends(P.pair_fidelity(cells, counts, sizes, replicates=reps), sizes)
        scores = P.fidelity_overall(shapes, trends).select(
            "replicate", "fidelity", F.col("shapes").alias("fidelity_shapes"), F.col("trends").alias("fidelity_trends")
        )
        out = out.unionByName(_long(scores))
    def scored(r: int) -> list[DataFrame]:
        """Metrics of one replicate; its jobs are independent of the other replicates'."""
        found = []
        own = base.filter((F.col("split") != "synth") | (F.col("replicate") == r))
        own_cells = cells.filter((F.col("split") != "synth") | (F.col("replicate") == r)) if cells is not None else None
        if "utility" in parts and target:
            row = score_from_metrics(utility_metrics(own_cells, own, target, task, **(utility_options or {})), task)
            primary = "f1_weighted" if task == "classification" else "r2"
            found.append(
                row.select(
                    F.lit(r).alias("replicate"),
                    "utility",
                    F.col("trtr").alias(f"utility_trtr_{primary}"),
                    F.col("tstr").alias(f"utility_tstr_{primary}"),
                )
            )
        if "privacy" in parts:
            row = privacy_metrics(own, flatten, **(privacy_options or {}))
            copies = [F.col(f"exact_matches_{k}").cast("double").alias(f"privacy_exact_matches_{k}") for k in ("train", "test", "train_only")]
            found.append(
                row.select(
                    F.lit(r).alias("replicate"), F.col("privacy_score").alias("privacy"), F.col("dcr_score").alias("privacy_dcr_score"), *copies
                )
            )
        if "detection" in parts:
            row = detection_metrics(own_cells, own, **(detection_options or {}))
            found.append(row.select(F.lit(r).alias("replicate"), "detection", F.col("roc_auc").alias("detection_roc_auc")))
        return [_long(wide) for wide in found]

    # driver threads only submit jobs, so that the small ones of several replicates share the cluster
    with ThreadPoolExecutor(max_workers=PARALLEL_REPLICATES) as pool:
        for found in pool.map(scored, reps):
            for part in found:
                out = out.unionByName(part)
    return out


def evaluate_mode(records, flatten, replicates, mode: str = "standard", **options) -> DataFrame:
    """Standard mode measures fidelity, utility and detection; ``dcr`` measures privacy only."""
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode}; use one of {sorted(MODES)}")
    return evaluate(records, flatten, replicates, parts=MODES[mode], **options)


def _long(wide: DataFrame) -> DataFrame:
    values = [c for c in wide.columns if c != "replicate"]
    return wide.unpivot(["replicate"], values, "metric", "value").select(
        F.col("replicate").cast("int").alias("replicate"), "metric", F.col("value").cast("double").alias("value")
    )
