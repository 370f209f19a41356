"""Per-field fidelity: presence, type mix, values and array lengths of two tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellwise.functions.expr import VALUE_TYPES
from cellwise.operators.cells import typed_view
from cellwise.operators.stats import ks_complement, paired_counts, share, tv_complement
from cellwise.session import materialize

CELL_TYPES = ("num", "cat", "bool", "date", "null", "array", "object")
FIELD = ("replicate", "path")


def value_counts(
    cells: DataFrame, real: str = "train", synth: str = "synth", replicates: Sequence[int] | None = None
) -> DataFrame:
    """Counts of every distinct value of every typed column on both sides, written once.

    This is the only pass over the cells; all field scores derive from it."""
    return materialize(paired_counts(typed_view(cells), ["path", "typ", "x", "s"], real, synth, replicates))


def split_sizes(
    records: DataFrame, real: str = "train", synth: str = "synth", replicates: Sequence[int] | None = None
) -> DataFrame:
    """Records per side and replicate."""
    return paired_counts(records, [], real, synth, replicates).select(
        "replicate", F.col("n_real").alias("rows_real"), F.col("n_synth").alias("rows_synth")
    )


def type_counts(counts: DataFrame) -> DataFrame:
    """One row per field: cells of every dtype on both sides."""
    per_type = [
        F.sum(F.when(F.col("s") == t, F.col(f"n_{side}")).otherwise(0)).alias(f"{side}_{t}")
        for t in CELL_TYPES
        for side in ("real", "synth")
    ]
    return (
        counts.filter("typ = 'dtype'")
        .groupBy(*FIELD)
        .agg(F.sum("n_real").alias("present_real"), F.sum("n_synth").alias("present_synth"), *per_type)
    )


def _type_score() -> Column:
    gap = sum(
        (
            F.abs(share(f"real_{t}", "present_real") - share(f"synth_{t}", "present_synth"))
            for t in CELL_TYPES[1:]
        ),
        F.abs(share("real_num", "present_real") - share("synth_num", "present_synth")),
    )
    return F.coalesce(F.lit(1.0) - F.lit(0.5) * gap, F.lit(0.0))


def presence_fidelity(types: DataFrame, sizes: DataFrame) -> DataFrame:
    real_rate = share("present_real", "rows_real")
    synth_rate = share("present_synth", "rows_synth")
    return types.join(F.broadcast(sizes), "replicate").select(
        *types.columns,
        "rows_real",
        "rows_synth",
        F.coalesce(real_rate, F.lit(0.0)).alias("real_rate"),
        F.coalesce(synth_rate, F.lit(0.0)).alias("synth_rate"),
        (F.lit(1.0) - F.abs(real_rate - synth_rate)).alias("presence_fidelity"),
    )


def value_scores(counts: DataFrame) -> DataFrame:
    """Score of every typed value column: KS for numbers, dates and lengths, TV for the rest."""
    keys = [*FIELD, "typ"]
    ordered = ks_complement(counts.filter(F.col("typ").isin("num", "date", "alen")), keys)
    labelled = tv_complement(counts.filter(F.col("typ").isin("cat", "bool")), keys)
    return ordered.unionByName(labelled)


def field_fidelity(counts: DataFrame, sizes: DataFrame) -> DataFrame:
    """Score of every field: presence x type x (length for arrays, values for scalars)."""
    fields = presence_fidelity(type_counts(counts), sizes).withColumn("type_fidelity", _type_score())
    scores = (
        value_scores(counts)
        .groupBy(*FIELD)
        .agg(*[F.max(F.when(F.col("typ") == t, F.col("score"))).alias(f"score_{t}") for t in (*VALUE_TYPES, "alen")])
    )
    joined = fields.join(scores, list(FIELD), "left")
    pooled = {t: F.col(f"real_{t}") + F.col(f"synth_{t}") for t in CELL_TYPES}
    total = sum((pooled[t] for t in VALUE_TYPES[1:]), pooled["num"])
    weighted = sum(
        (pooled[t] / total * F.coalesce(f"score_{t}", F.lit(0.0)) for t in VALUE_TYPES[1:]),
        pooled["num"] / total * F.coalesce("score_num", F.lit(0.0)),
    )
    is_array, is_object = pooled["array"] > 0, pooled["object"] > 0
    value = F.when(~is_array & (total > 0), weighted)
    length = F.when(is_array, F.coalesce("score_alen", F.lit(0.0)))
    base = F.col("presence_fidelity") * F.col("type_fidelity")
    score = (
        F.when((F.col("rows_real") == 0) | (F.col("rows_synth") == 0), F.lit(0.0))
        .when(is_array, base * length)
        .when(is_object, base)
        .otherwise(base * F.coalesce(value, F.lit(1.0)))
    )
    return joined.select(
        *FIELD,
        "presence_fidelity",
        "type_fidelity",
        value.alias("value_fidelity"),
        length.alias("length_fidelity"),
        score.alias("score"),
        F.greatest("real_rate", "synth_rate").alias("presence"),
        *[F.when(~is_array & (total > 0), pooled[t] / total).alias(f"weight_{t}") for t in VALUE_TYPES],
    )


def with_weights(fields: DataFrame, raw: str = "presence") -> DataFrame:
    """Add the share of each field in the total presence (uniform when it is zero)."""
    totals = fields.groupBy("replicate").agg(F.sum(raw).alias("total"), F.count(F.lit(1)).alias("fields"))
    weight = F.when(F.col("total") > 0, F.col(raw) / F.col("total")).otherwise(F.lit(1.0) / F.col("fields"))
    return fields.join(F.broadcast(totals), "replicate").select(*fields.columns, weight.alias("weight"))  # one row per replicate


def column_shapes(fields: DataFrame, sizes: DataFrame) -> DataFrame:
    """Weighted mean of the field scores per replicate; 1 when there are no fields."""
    total = F.sum("presence")
    scored = fields.groupBy("replicate").agg(
        F.when(total > 0, F.sum(F.col("presence") * F.col("score")) / total)
        .otherwise(F.avg("score"))
        .alias("shapes"),
        F.count(F.lit(1)).alias("num_fields"),
    )
    return sizes.select("replicate").join(scored, "replicate", "left").select(
        "replicate",
        F.coalesce("shapes", F.lit(1.0)).alias("shapes"),
        F.coalesce("num_fields", F.lit(0)).cast("bigint").alias("num_fields"),
    )


def worst(scored: DataFrame, name: str, n: int = 10) -> DataFrame:
    """The ``n`` entries that cost most: (1 - score) x weight, ties by name."""
    return (
        scored.withColumn("cost", (F.lit(1.0) - F.col("score")) * F.col("weight"))
        .orderBy(F.round("cost", 9).desc(), F.col(name))
        .limit(n)
    )


def informative_column(fields: DataFrame) -> DataFrame:
    """Typed column to show for a field: length, else the heaviest value type, else dtype."""
    # the earliest type in this order wins ties
    ranked = F.array_max(
        F.array(
            *[
                F.struct(
                    F.coalesce(f"weight_{t}", F.lit(0.0)).alias("w"),
                    F.lit(-i).alias("o"),
                    F.lit(t).alias("t"),
                )
                for i, t in enumerate(VALUE_TYPES)
            ]
        )
    )
    typ = (
        F.when(F.col("length_fidelity").isNotNull(), "alen")
        .when(F.col("value_fidelity").isNotNull(), ranked["t"])
        .otherwise("dtype")
    )
    return fields.select("replicate", "path", F.concat_ws(".", "path", typ).alias("plot_column"))
