"""Typed rows to numeric features, kept tall and sparse (an absent row is zero or null)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellwise.functions.expr import many
from cellwise.operators.cells import KEYS
from cellwise.operators.stats import running_totals
from cellwise.session import materialize

NUMERIC = ("num", "alen", "date")
ABSENT_LABEL = "NaN"  # fixed value: category of an absent text


def informative_columns(typed: DataFrame, n_records: DataFrame, exclude: Sequence[str] = ()) -> DataFrame:
    """Typed columns with more than one value over all splits; absence is a value of ``dtype``.

    ``exclude`` drops whole fields; ``n_records`` is a one-row count of records."""
    used = typed.filter(~F.col("path").isin(*exclude)) if exclude else typed
    levels = used.groupBy("path", "typ", "x", "s").agg(F.count(F.lit(1)).alias("m"))
    columns = levels.groupBy("path", "typ").agg(F.count(F.lit(1)).alias("levels"), F.sum("m").alias("present"))
    absent = (F.col("typ") == "dtype") & (F.col("present") < n_records.scalar())
    return columns.filter(F.col("levels") + absent.cast("int") > 1).select(
        "path", "typ", F.concat_ws(".", "path", "typ").alias("col")
    )


def require_columns(columns: DataFrame) -> DataFrame:
    if columns.isEmpty():
        raise ValueError("No valid features found for encoding")
    return columns


def encode_numeric(typed: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Numbers, lengths and dates (epoch nanoseconds); infinite and NaN values are null, so no row."""
    value = F.when(F.col("typ") == "date", F.col("x") * F.lit(1000.0)).otherwise(F.col("x"))
    return (
        typed.filter(F.col("typ").isin(*NUMERIC))
        .select(*keys, F.concat_ws(".", "path", "typ").alias("name"), value.alias("value"))
        .filter(~F.isnan("value") & (F.abs("value") != F.lit(float("inf"))))
    )


def encode_bool(typed: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    return typed.filter(F.col("typ") == "bool").select(
        *keys,
        F.concat_ws(".", "path", "typ").alias("name"),
        F.when(F.col("s") == "True", 1.0).otherwise(0.0).alias("value"),
    )


def encode_onehot(
    typed: DataFrame, columns: DataFrame, records: DataFrame, keys: Sequence[str] = KEYS
) -> DataFrame:
    """Indicators ``column_level`` = 1 of text and dtype columns, all levels kept.

    A record without the column gets the level ``NaN`` (text) or ``missing`` (dtype):
    the columns it lacks are listed inside its own row, from the set it has."""
    labels = typed.filter(F.col("typ").isin("cat", "dtype")).select(
        *keys, F.concat_ws(".", "path", "typ").alias("col"), "s"
    )
    present = labels.select(*keys, F.concat_ws("_", "col", "s").alias("name"))
    wanted = columns.filter(F.col("typ").isin("cat", "dtype")).agg(F.collect_set("col")).scalar()
    held = labels.groupBy(*keys).agg(F.collect_set("col").alias("held"))
    absent = (
        records.select(*keys)
        .join(many(held), list(keys), "left")
        .select(*keys, F.explode(F.array_except(wanted, F.coalesce("held", F.array().cast("array<string>")))).alias("col"))
        .select(
            *keys,
            F.concat_ws(
                "_", "col", F.when(F.col("col").endswith(".dtype"), "missing").otherwise(ABSENT_LABEL)
            ).alias("name"),
        )
    )
    return present.unionByName(absent).withColumn("value", F.lit(1.0))


def encode_ordinal(
    typed: DataFrame, records: DataFrame, columns: DataFrame, keys: Sequence[str] = KEYS, codes: DataFrame | None = None
) -> DataFrame:
    """Level codes: position of the level among the sorted levels of its column (from 0).

    An absent text is the level ``NaN``, an absent dtype the level ``missing``. ``codes`` are those of ``ordinal_codes``,
    if they are known already."""
    codes = ordinal_codes(typed, records, columns) if codes is None else codes
    labels = typed.filter(F.col("typ").isin("cat", "dtype")).join(columns.select("path", "typ"), ["path", "typ"])
    return labels.select(*keys, F.concat_ws(".", "path", "typ").alias("col"), "s").join(codes, ["col", "s"]).select(
        *keys, F.col("col").alias("name"), F.col("code").cast("double").alias("value")
    )


def ordinal_codes(typed: DataFrame, records: DataFrame, columns: DataFrame) -> DataFrame:
    """(col, s, code) of every level, including the level that stands for absence."""
    kept = columns.filter(F.col("typ").isin("cat", "dtype"))
    counts = materialize(  # one row per level, read twice
        typed.join(kept.select("path", "typ"), ["path", "typ"])
        .groupBy(F.concat_ws(".", "path", "typ").alias("col"), "typ", "s")
        .agg(F.count(F.lit(1)).alias("m"))
    )
    n = records.agg(F.count(F.lit(1))).scalar()
    gaps = (
        counts.groupBy("col", "typ")
        .agg(F.sum("m").alias("held"))
        .filter(F.col("held") < n)
        .select("col", F.when(F.col("typ") == "dtype", "missing").otherwise(ABSENT_LABEL).alias("s"))
    )
    levels = counts.select("col", "s").unionByName(gaps).distinct().withColumn("one", F.lit(1))
    return running_totals(levels, ["col"], "s", ["one"]).select("col", "s", (F.col("cum_one") - 1).alias("code"))


def encode_features(
    typed: DataFrame, records: DataFrame, exclude: Sequence[str] = (), keys: Sequence[str] = KEYS
) -> DataFrame:
    """All features of all records: (keys, name, value), without null entries.

    Typed rows and their columns are written first, since every kind of feature reads them."""
    typed = materialize(typed)
    columns = materialize(informative_columns(typed, records.agg(F.count(F.lit(1))), exclude))
    kept = typed.join(columns.select("path", "typ"), ["path", "typ"], "left_semi")
    return (
        encode_numeric(kept, keys)
        .unionByName(encode_bool(kept, keys))
        .unionByName(encode_onehot(kept, columns, records, keys))
    )


def scale_by_train_range(features: DataFrame, train: str = "train") -> DataFrame:
    """Divide numbers, dates and lengths by their range in the training split (no shift);
    other features and columns of zero range stay as they are."""
    numeric = F.col("name").rlike(r"[.](num|alen|date)$")
    ranges = (
        features.filter(numeric & (F.col("split") == train))
        .groupBy("name")
        .agg((F.max("value") - F.min("value")).alias("width"))
        .filter("width > 0")
    )
    return features.join(ranges, "name", "left").select(
        *[c for c in features.columns if c != "value"],
        (F.col("value") / F.coalesce("width", F.lit(1.0))).alias("value"),
    )
