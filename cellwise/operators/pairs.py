"""Column-pair trends: does the synthetic table keep the joint behaviour of two columns?

The metric is defined over all pairs of typed columns, so its size follows the schema,
not the rows: the members of a record are paired inside its own row and aggregated
map-side at once; rows are never paired with other rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cellwise.functions.expr import CONTINUOUS, suffix_rank
from cellwise.operators.cells import typed_view
from cellwise.operators.stats import paired_counts, share, tv_complement
from cellwise.session import materialize

MAX_BINS = 10  # fixed value: upper limit of equal-width bins of a continuous column
HASH_BUCKETS = 64
PAIR = ("replicate", "a", "b")


def pair_columns(counts: DataFrame, sizes: DataFrame) -> DataFrame:
    """Typed columns with more than one value over both sides, numbered in column order.

    Absence counts as a value of a ``dtype`` column."""
    columns = counts.groupBy("replicate", "path", "typ").agg(
        F.count(F.lit(1)).alias("values"), (F.sum("n_real") + F.sum("n_synth")).alias("present")
    )
    absent = (F.col("typ") == "dtype") & (F.col("present") < F.col("rows_real") + F.col("rows_synth"))
    kept = columns.join(F.broadcast(sizes), "replicate").filter(F.col("values") + absent.cast("int") > 1)
    # one window over the columns of the schema, not over rows
    order = Window.orderBy("path", suffix_rank(F.col("typ")))
    numbered = kept.select("path", "typ").distinct().select("path", "typ", F.row_number().over(order).alias("o"))
    return kept.join(numbered, ["path", "typ"]).select(
        "replicate",
        "o",
        "path",
        "typ",
        F.concat_ws(".", "path", "typ").alias("col"),
        F.col("typ").isin(*CONTINUOUS).alias("continuous"),
    )


def pair_catalog(columns: DataFrame) -> DataFrame:
    """All pairs of kept columns, first before second in column order: a join of the written columns with themselves."""
    columns = materialize(columns.select("replicate", "o", "col", "continuous"))
    x, y = columns.alias("x"), columns.alias("y")
    return x.join(y, (F.col("x.replicate") == F.col("y.replicate")) & (F.col("x.o") < F.col("y.o"))).select(
        F.col("x.replicate").alias("replicate"),
        F.col("x.o").alias("a"),
        F.col("y.o").alias("b"),
        F.concat_ws("|", "x.col", "y.col").alias("pair"),
        F.col("x.continuous").alias("a_continuous"),
        F.col("y.continuous").alias("b_continuous"),
    )


def record_columns(cells: DataFrame, columns: DataFrame, real: str = "train", synth: str = "synth") -> DataFrame:
    """One row per record with its discrete and continuous values, written once.

    The single shuffle of the pair step: cells go to their record."""
    known = columns.select("path", "typ", "o", "continuous").distinct()
    values = typed_view(cells.filter(F.col("split").isin(real, synth))).join(known, ["path", "typ"])
    label = F.when(~F.col("continuous"), F.struct("o", F.col("s").alias("k")))
    number = F.when(F.col("continuous"), F.struct("o", "x"))
    return materialize(
        values.groupBy("rid", "split", "replicate").agg(
            F.sort_array(F.collect_list(label)).alias("labels"),
            F.sort_array(F.collect_list(number)).alias("numbers"),
        )
    )


def _within(rows: DataFrame, array: str) -> DataFrame:
    """Pairs of members of one array column of a record."""
    return rows.select("split", "replicate", array, F.posexplode(array).alias("i", "m")).select(
        "split", "replicate", "m", F.explode(F.expr(f"slice({array}, i + 2, size({array}))")).alias("n")
    )


def _mixed(rows: DataFrame) -> DataFrame:
    """Every number of a record beside every label of it."""
    return (
        rows.select("split", "replicate", "labels", F.explode("numbers").alias("m"))
        .select("split", "replicate", "m", F.explode("labels").alias("l"))
        .select(
            "split",
            "replicate",
            F.least("m.o", "l.o").alias("a"),
            F.greatest("m.o", "l.o").alias("b"),
            F.col("m.x").alias("x"),
            F.col("l.k").alias("k"),
        )
    )


def _to_replicates(sided: DataFrame, real: str, replicates: Sequence[int] | None) -> DataFrame:
    """Copy aggregated rows of the real side to every replicate."""
    if replicates is None:
        return sided.withColumn("replicate", F.lit(0))
    reps = [int(r) for r in replicates]
    target = F.when(F.col("split") == real, F.array(*[F.lit(r) for r in reps])).otherwise(F.array("replicate"))
    return sided.withColumn("replicate", F.explode(target)).filter(F.col("replicate").isin(reps))


def _side_replicate(rows: DataFrame, real: str, replicates: Sequence[int] | None) -> DataFrame:
    if replicates is None:
        return rows.withColumn("replicate", F.lit(0))
    return rows.withColumn("replicate", F.when(F.col("split") != real, F.col("replicate")))


def contingency(rows: DataFrame, real="train", synth="synth", replicates=None) -> DataFrame:
    """Joint value counts of label pairs, scored by total variation."""
    joint = _within(rows, "labels").select(
        "split",
        "replicate",
        F.col("m.o").alias("a"),
        F.col("n.o").alias("b"),
        F.col("m.k").alias("ka"),
        F.col("n.k").alias("kb"),
    )
    return tv_complement(paired_counts(joint, ["a", "b", "ka", "kb"], real, synth, replicates), PAIR)


def correlation(rows: DataFrame, real="train", synth="synth", replicates=None) -> DataFrame:
    """1 - |r - s| / 2 of the Pearson correlations; 0 when a side has fewer than two
    rows or a constant column."""
    pairs = _side_replicate(_within(rows, "numbers"), real, replicates)
    va, vb = F.col("m.x"), F.col("n.x")
    sided = pairs.groupBy("split", "replicate", F.col("m.o").alias("a"), F.col("n.o").alias("b")).agg(
        F.count(F.lit(1)).alias("n"),
        F.try_divide(F.covar_pop(va, vb), F.stddev_pop(va) * F.stddev_pop(vb)).alias("r"),
        ((F.min(va) < F.max(va)) & (F.min(vb) < F.max(vb))).alias("varied"),
    )
    sided = sided.withColumn("r", F.when(F.col("varied") & (F.col("n") >= 2) & ~F.isnan("r"), F.col("r")))
    is_real = F.col("split") == real
    gap = F.max(F.when(is_real, F.col("r"))) - F.max(F.when(~is_real, F.col("r")))
    return _to_replicates(sided, real, replicates).groupBy(*PAIR).agg(
        F.coalesce(F.max(F.when(is_real, F.col("n"))), F.lit(0)).alias("t_real"),
        F.coalesce(F.max(F.when(~is_real, F.col("n"))), F.lit(0)).alias("t_synth"),
        F.coalesce(F.lit(1.0) - F.abs(gap) / F.lit(2.0), F.lit(0.0)).alias("score"),
    )


def bin_edges(rows: DataFrame, real="train", synth="synth", replicates=None) -> DataFrame:
    """Range and bin count of the number in every (number, label) pair, over co-present rows.

    The bin count is min(10, distinct values). Values are spread over hash buckets that
    keep only their extremes: ten or more bucket extremes prove ten distinct values, and
    buckets holding one value are counted exactly. Only pairs neither rule settles are
    counted with an exact distinct."""
    mixed = _mixed(rows)
    sided = (
        _side_replicate(mixed, real, replicates)
        .groupBy("split", "replicate", "a", "b", F.pmod(F.xxhash64("x"), F.lit(HASH_BUCKETS)).alias("h"))
        .agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    )
    buckets = _to_replicates(sided, real, replicates).groupBy(*PAIR, "h").agg(
        F.min("lo").alias("lo"), F.max("hi").alias("hi")
    )
    edges = materialize(
        buckets.groupBy(*PAIR).agg(
            F.min("lo").alias("lo"),
            F.max("hi").alias("hi"),
            F.sum(F.when(F.col("lo") < F.col("hi"), 2).otherwise(1)).alias("at_least"),
            F.bool_and(F.col("lo") == F.col("hi")).alias("exact"),
        )
    )
    settled = (F.col("at_least") >= MAX_BINS) | F.col("exact")
    proven = edges.withColumn("bins", F.least(F.col("at_least"), F.lit(MAX_BINS)).cast("int"))
    open_pairs = edges.filter(~settled)
    if not open_pairs.isEmpty():
        few = _to_replicates(
            _side_replicate(mixed.join(open_pairs.select("a", "b").distinct(), ["a", "b"], "left_semi"), real, replicates)
            .select("split", "replicate", "a", "b", "x")
            .distinct(),
            real,
            replicates,
        )
        counted = few.groupBy(*PAIR).agg(F.countDistinct("x").alias("distinct_x"))
        proven = (
            proven.join(counted, list(PAIR), "left")
            .withColumn("bins", F.when(settled, F.col("bins")).otherwise(F.least("distinct_x", F.lit(MAX_BINS))).cast("int"))
        )
    return proven.select(*PAIR, "lo", "hi", "bins")


def cut_points(lo, hi, bins):
    """Inner edges of equal-width bins; a value belongs to the bin after the edges below it."""
    width = (hi - lo) / bins
    inner = F.transform(F.sequence(F.lit(1), F.greatest(bins, F.lit(2)) - 1), lambda i: lo + i.cast("double") * width)
    return F.when(bins > 1, inner).otherwise(F.array().cast("array<double>"))


def edges_below(cuts, x):
    """Number of edges under a value."""
    return F.size(F.filter(cuts, lambda c: c < x))


def bin_of(x, lo, hi, bins):
    """Index of the right-closed equal-width bin; the lowest value is in bin 0."""
    return edges_below(cut_points(lo, hi, bins), x)


def mixed_contingency(rows: DataFrame, real="train", synth="synth", replicates=None) -> DataFrame:
    """Number-label pairs: bin the number over its co-present range, then total variation.

    The edges of all replicates of a pair cut the line into elementary intervals. Rows are counted by interval once;
    the counts go to the replicates, where an interval lies in one bin."""
    edges = bin_edges(rows, real, synth, replicates)
    own = F.struct("replicate", cut_points(F.col("lo"), F.col("hi"), F.col("bins")).alias("cuts"))
    per_pair = materialize(
        edges.groupBy("a", "b").agg(F.collect_list(own).alias("own")).withColumn("cuts", F.array_sort(F.array_distinct(F.flatten("own.cuts"))))
    )
    mixed = _side_replicate(_mixed(rows), real, replicates)
    interval = edges_below(F.col("cuts"), F.col("x")).alias("interval")
    counted = (
        mixed.join(per_pair.select("a", "b", "cuts"), ["a", "b"])
        .select("split", "replicate", "a", "b", "k", interval)
        .groupBy("split", "replicate", "a", "b", "k", "interval")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    bounds = per_pair.select("a", "b", F.col("cuts").alias("every"), F.explode("own").alias("o")).select("a", "b", "every", "o.replicate", "o.cuts")
    below = F.filter("cuts", lambda c: c <= F.element_at("every", F.col("interval")))  # edges at or under the interval's lower end
    placed = _to_replicates(counted, real, replicates).join(bounds, list(PAIR))
    bin_ = F.when(F.col("interval") == 0, 0).otherwise(F.size(below)).alias("bin")
    is_real = F.col("split") == real
    n = lambda side: F.sum(F.when(side, F.col("n")).otherwise(0))
    counts = placed.select("split", *PAIR, "k", bin_, "n").groupBy(*PAIR, "k", "bin").agg(n(is_real).alias("n_real"), n(~is_real).alias("n_synth"))
    return tv_complement(counts, PAIR)


def pair_fidelity(
    cells: DataFrame,
    counts: DataFrame,
    sizes: DataFrame,
    real: str = "train",
    synth: str = "synth",
    replicates: Sequence[int] | None = None,
) -> DataFrame:
    """Score, metric and raw weight of every column pair.

    A pair never present together on one side scores 0 and keeps its weight."""
    columns = materialize(pair_columns(counts, sizes))
    rows = record_columns(cells, columns, real, synth)
    scored = (
        contingency(rows, real, synth, replicates)
        .unionByName(correlation(rows, real, synth, replicates))
        .unionByName(mixed_contingency(rows, real, synth, replicates))
    )
    both = (F.col("n_real") > 0) & (F.col("n_synth") > 0)
    return (
        pair_catalog(columns)
        .join(scored, list(PAIR), "left")
        .join(F.broadcast(sizes), "replicate")
        .withColumn("n_real", F.coalesce("t_real", F.lit(0)))
        .withColumn("n_synth", F.coalesce("t_synth", F.lit(0)))
        .select(
            "replicate",
            "pair",
            F.when(~both, "N/A")
            .when(F.col("a_continuous") & F.col("b_continuous"), "CorrelationSimilarity")
            .otherwise("ContingencySimilarity")
            .alias("metric"),
            F.when(both, F.col("score")).otherwise(F.lit(0.0)).alias("score"),
            F.coalesce(share("n_real", "rows_real"), F.lit(0.0)).alias("co_rate_real"),
            F.coalesce(share("n_synth", "rows_synth"), F.lit(0.0)).alias("co_rate_synth"),
            "n_real",
            "n_synth",
        )
        .withColumn("presence", F.greatest("co_rate_real", "co_rate_synth"))
    )


def pair_weights(pairs: DataFrame) -> DataFrame:
    """Share of each pair in the total co-presence; raw weights when the total is zero."""
    totals = pairs.groupBy("replicate").agg(F.sum("presence").alias("total"))
    weight = F.when(F.col("total") > 0, F.col("presence") / F.col("total")).otherwise(F.col("presence"))
    return pairs.join(F.broadcast(totals), "replicate").select(*pairs.columns, weight.alias("weight"))  # one row per replicate


def column_pair_trends(pairs: DataFrame, sizes: DataFrame) -> DataFrame:
    """Weighted mean of the pair scores; 1 without pairs or without any co-presence."""
    total = F.sum("presence")
    scored = pairs.groupBy("replicate").agg(
        F.when(total > 0, F.sum(F.col("presence") * F.col("score")) / total).alias("trends"),
        F.count(F.lit(1)).alias("num_pairs"),
    )
    return sizes.select("replicate").join(scored, "replicate", "left").select(
        "replicate",
        F.coalesce("trends", F.lit(1.0)).alias("trends"),
        F.coalesce("num_pairs", F.lit(0)).cast("bigint").alias("num_pairs"),
    )


def fidelity_overall(shapes: DataFrame, trends: DataFrame) -> DataFrame:
    """Mean of the shape and trend scores per replicate."""
    return shapes.join(trends, "replicate").select(
        "replicate",
        ((F.col("shapes") + F.col("trends")) / 2.0).alias("fidelity"),
        "shapes",
        "trends",
        "num_fields",
        "num_pairs",
    )
