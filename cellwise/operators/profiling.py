"""Dataset profiles and distribution views of typed columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellwise.operators.cells import typed_view
from cellwise.session import materialize


def cardinalities(cells: DataFrame) -> DataFrame:
    """Distinct values of every text, number and boolean column; values are deduplicated
    before they are counted, so no task holds the values of a whole column."""
    return cardinalities_of(distinct_values(cells))


def distinct_values(cells: DataFrame) -> DataFrame:
    """(path, typ, x, s, m): every distinct value of the typed columns and its cells."""
    return typed_view(cells).groupBy("path", "typ", "x", "s").agg(F.count(F.lit(1)).alias("m"))


def cardinalities_of(values: DataFrame) -> DataFrame:
    return values.filter(F.col("typ").isin("cat", "num", "bool")).groupBy("path", "typ").agg(F.count(F.lit(1)).alias("cardinality")).select(
        "path", "typ", F.concat_ws(".", "path", "typ").alias("col"), "cardinality"
    )


def dataset_stats(leaves: DataFrame, records: DataFrame) -> DataFrame:
    """One row: records per split, flat columns, typed columns, discrete levels, sparsity.

    Sparsity is the share of empty cells (null or absent) in the flat table."""
    sizes = records.agg(
        F.count_if(F.col("split") == "train").alias("n_train"),
        F.count_if(F.col("split") == "test").alias("n_test"),
        F.count(F.lit(1)).alias("n_total"),
    )
    values = materialize(distinct_values(leaves))  # one pass over the cells for all that follows
    dtypes = values.filter("typ = 'dtype'")
    paths = dtypes.groupBy("path").agg(F.sum(F.when(F.col("s") != "null", F.col("m")).otherwise(0)).alias("filled")).agg(
        F.count(F.lit(1)).alias("n_flat_cols"), F.sum("filled").alias("filled")
    )
    kinds = cardinalities_of(values).agg(
        *[F.count_if(F.col("typ") == t).alias(f"n_{t}") for t in ("cat", "num", "bool")],
        F.sum(F.when(F.col("typ") != "num", F.col("cardinality")).otherwise(0)).alias("total_discrete"),
    )
    one = F.lit(1).alias("one")
    return (
        sizes.withColumn("one", one)
        .join(paths.withColumn("one", one), "one")
        .join(kinds.withColumn("one", one), "one")
        .withColumn("total_discrete", F.coalesce("total_discrete", F.lit(0)))
        .withColumn("sparsity", F.lit(1.0) - F.col("filled") / (F.col("n_total") * F.col("n_flat_cols")))
        .drop("one", "filled")
    )


def column_sparsity(leaves: DataFrame, n_records: DataFrame) -> DataFrame:
    """Share of records in which a field is null or absent."""
    return leaves.groupBy("path").agg(F.count_if(F.col("dtype") != "null").alias("filled")).select(
        "path", (F.lit(1.0) - F.col("filled") / n_records.scalar()).alias("sparsity")
    )


def length_pmf(counts: DataFrame, path: str, longest: int = 15) -> DataFrame:
    """Share of each array length 0..``longest`` on both sides, within that range."""
    grid = counts.sparkSession.range(longest + 1).select(F.col("id").cast("double").alias("x"))
    own = counts.filter((F.col("path") == path) & (F.col("typ") == "alen") & (F.col("x") <= longest))
    total = own.agg(F.sum("n_real").alias("r"), F.sum("n_synth").alias("s"), F.lit(1).alias("one"))
    return (
        grid.join(own.groupBy("x").agg(F.sum("n_real").alias("n_real"), F.sum("n_synth").alias("n_synth")), "x", "left")
        .withColumn("one", F.lit(1))
        .join(F.broadcast(total), "one")
        .select(
            F.col("x").cast("bigint").alias("length"),
            F.coalesce(F.try_divide("n_real", "r"), F.lit(0.0)).alias("real"),
            F.coalesce(F.try_divide("n_synth", "s"), F.lit(0.0)).alias("synth"),
        )
    )


def kde_grid(
    counts: DataFrame, low: float, high: float, points: int, factor: float | None = None
) -> DataFrame:
    """Gaussian kernel density of both sides on an even grid.

    ``counts`` holds distinct values ``x`` with n_real and n_synth. Bandwidth is the sample
    deviation times ``factor`` (n to the power -1/5 by default). Every distinct value
    meets the fixed grid in its own row and is summed map-side."""
    step = (high - low) / (points - 1)
    grid = F.array(*[F.lit(low + step * i) for i in range(points)])
    sides = F.array(
        F.struct(F.lit("real").alias("side"), F.col("n_real").alias("n")),
        F.struct(F.lit("synth").alias("side"), F.col("n_synth").alias("n")),
    )
    rows = counts.select("x", F.explode(sides).alias("s")).select("x", "s.side", "s.n").filter("n > 0")
    total, mean = F.sum("n"), F.sum(F.col("x") * F.col("n")) / F.sum("n")
    moments = rows.groupBy("side").agg(total.alias("total"), mean.alias("mean"))
    spread = (
        rows.join(F.broadcast(moments), "side")
        .groupBy("side")
        .agg(
            F.max("total").alias("total"),
            F.sum(F.col("n") * F.pow(F.col("x") - F.col("mean"), F.lit(2))).alias("squares"),
        )
        .select("side", "total", F.sqrt(F.try_divide(F.col("squares"), F.col("total") - 1)).alias("sd"))
    )
    scale = F.lit(factor) if factor is not None else F.pow(F.col("total"), F.lit(-0.2))
    bandwidth = spread.select("side", "total", (F.col("sd") * scale).alias("h"))
    distance = F.try_divide(F.col("g") - F.col("x"), F.col("h"))
    return (
        rows.join(F.broadcast(bandwidth), "side")
        .select("side", "x", "n", "total", "h", F.posexplode(grid).alias("i", "g"))
        .groupBy("side", "i", "g")
        .agg(
            (
                F.sum(F.col("n") * F.exp(F.lit(-0.5) * distance * distance))
                / (F.max("total") * F.max("h") * F.sqrt(F.lit(2.0) * F.pi()))
            ).alias("density")
        )
    )


def column_histogram(counts: DataFrame, path: str, typ: str, bins: int = 20) -> DataFrame:
    """Counts of one typed column on both sides: per level, or per equal-width bin of the pooled range."""
    own = counts.filter((F.col("path") == path) & (F.col("typ") == typ))
    if typ in ("cat", "dtype", "bool"):
        bucket = F.col("s")
    else:
        low, high = own.agg(F.min("x")).scalar(), own.agg(F.max("x")).scalar()
        at = F.floor((F.col("x") - low) / (high - low) * F.lit(float(bins)))
        bucket = F.when(high > low, F.least(at, F.lit(bins - 1))).otherwise(F.lit(0)).cast("string")
    return own.groupBy(bucket.alias("bucket")).agg(F.sum("n_real").alias("n_real"), F.sum("n_synth").alias("n_synth"))


def path_marginals(cells: DataFrame, truth: DataFrame) -> DataFrame:
    """Share of true values per replicate and boolean path, with its error against ``truth``."""
    shares = cells.filter("dtype = 'bool'").groupBy("replicate", "path").agg(
        F.avg(F.col("bool").cast("double")).alias("p"), F.count(F.lit(1)).alias("n")
    )
    return shares.join(truth, "path").withColumn("error", F.abs(F.col("p") - F.col("true_p")))


def marginal_errors(marginals: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Mean absolute error per replicate, then its mean and population deviation over replicates."""
    return marginals.groupBy("replicate", *by).agg(F.avg("error").alias("mae")).groupBy(*by).agg(
        F.avg("mae").alias("mae_mean"), F.stddev_pop("mae").alias("mae_sd")
    )
