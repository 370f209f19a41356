"""Record sources and sinks: JSON lines, prepared splits, replicates, flat CSV and matrices."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType, VariantType


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of JSON files with their parse result: ``line``, ``v`` (NULL when malformed), ``file``.

    Lines of white space alone are skipped."""
    lines = spark.read.text(path).select(F.col("value").alias("line"), F.col("_metadata.file_path").alias("file"))
    return lines.filter(F.col("line").rlike(r"\S")).withColumn("v", F.try_parse_json("line"))


def read_jsonl(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(records, corrupt lines): a malformed line is never dropped silently."""
    parsed = read_lines(spark, path)
    return parsed.filter("v IS NOT NULL").select("v", "file"), parsed.filter("v IS NULL").select("line", "file")


def write_jsonl(records: DataFrame, path: str, mode: str = "errorifexists") -> None:
    records.select(F.to_json("v").alias("value")).write.mode(mode).text(path)


MANIFEST = "run string, split string, n bigint, digest bigint, splits int"


def split_facts(records: DataFrame) -> DataFrame:
    """(split, n, digest): rows and an order-free digest of every column, per split."""
    text = [F.to_json(f.name) if isinstance(f.dataType, VariantType) else F.col(f.name) for f in records.schema if f.name != "split"]
    return records.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64(F.lit(1), *text)).alias("digest"))


def read_manifest(spark: SparkSession, path: str) -> DataFrame | None:
    """Manifest rows of the first complete run under ``path``, or None. Only a missing folder counts as none:
    any other error is the caller's."""
    try:
        rows = spark.read.schema(MANIFEST).json(f"{path}/_manifest")
        runs = rows.groupBy("run").agg(F.count(F.lit(1)).alias("held"), F.max("splits").alias("splits")).filter("held = splits")
        first = runs.agg(F.min("run").alias("run")).first()["run"]
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    return rows.filter(F.col("run") == first) if first else None


def prepare_splits(records: DataFrame, path: str) -> DataFrame:
    """Write records once, partitioned by split; splits that an earlier call completed are kept.

    Every call writes a folder of its own, and then the manifest (rows and digest of each split) in one file. A
    failed write has no manifest row and is never read, and nothing is ever overwritten."""
    spark = records.sparkSession
    manifest = read_manifest(spark, path)
    if manifest is None:
        run = uuid.uuid4().hex
        records.write.partitionBy("split").parquet(f"{path}/run-{run}")
        written = spark.read.schema(_split_last(records)).parquet(f"{path}/run-{run}")
        facts = split_facts(written)
        count = facts.agg(F.count(F.lit(1)).cast("int")).scalar()
        rows = facts.select(F.lit(run).alias("run"), "split", "n", "digest", count.alias("splits"))
        rows.coalesce(1).write.mode("append").json(f"{path}/_manifest")  # one row per split, one file: all or nothing
        manifest = read_manifest(spark, path)
        if manifest is None:  # a table without rows has no splits to list
            return written
    run = manifest.first()["run"]
    return spark.read.schema(_split_last(records)).parquet(f"{path}/run-{run}")


def _split_last(records: DataFrame) -> StructType:
    fields = [f for f in records.schema if f.name != "split"]
    return StructType([*fields, *(f for f in records.schema if f.name == "split")])


def verify_splits(prepared: DataFrame, path: str) -> DataFrame:
    """(split, n, ok): each split of the manifest, and whether the rows read agree with it."""
    manifest = read_manifest(prepared.sparkSession, path)
    if manifest is None:
        raise ValueError(f"no complete preparation under {path}")
    found = split_facts(prepared).select("split", F.col("n").alias("n_read"), F.col("digest").alias("digest_read"))
    same = F.col("n").eqNullSafe(F.col("n_read")) & F.col("digest").eqNullSafe(F.col("digest_read"))
    return manifest.join(found, "split", "left").select("split", "n", same.alias("ok"))


def read_replicates(spark: SparkSession, folder: str, stem: str = "synthetic") -> DataFrame:
    """Records of all replicate files or folders ``<stem>_<i>.jsonl`` with their number."""
    parsed = read_lines(spark, f"{folder}/{stem}_*.jsonl")
    number = F.regexp_extract("file", rf"/{stem}_([0-9]+)[.]jsonl(?:/|$)", 1)
    return parsed.filter(number != "").select(number.cast("int").alias("replicate"), "v", "line")


def write_replicates(records: DataFrame, folder: str, replicates: Sequence[int], stem: str = "synthetic") -> None:
    for r in replicates:
        write_jsonl(records.filter(F.col("replicate") == r), f"{folder}/{stem}_{r}.jsonl")


def flat_columns(cells: DataFrame) -> list[str]:
    """Sorted leaf paths of all splits (names only; they follow the schema)."""
    leaves = cells.filter(~F.col("dtype").isin("array", "object"))
    return [r["path"] for r in leaves.select("path").distinct().orderBy("path").collect()]


def flat_table(cells: DataFrame, columns: Sequence[str], keys: Sequence[str] = ("rid", "split")) -> DataFrame:
    """One text column per leaf path, the same for every split; needs cells with ``json``."""
    leaves = cells.filter(~F.col("dtype").isin("array", "object"))
    inner = F.col("json").substr(F.lit(2), F.length("json") - F.lit(2))
    plain = F.when(F.contains("json", F.lit("\\")), F.try_variant_get(F.parse_json("json"), "$", "string")).otherwise(inner)
    text = F.when(F.col("dtype").isin("cat", "date"), plain).otherwise(
        F.nullif(F.col("json"), F.lit("null"))
    )
    return leaves.select(*keys, "path", text.alias("text")).groupBy(*keys).pivot("path", list(columns)).agg(F.first("text"))


def write_flat_csv(flat: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """CSV with a header, one sub-folder per split, every split with the same columns."""
    flat.write.mode(mode).option("header", True).option("emptyValue", "").partitionBy("split").csv(path)


def matrix_export(
    table: DataFrame, numeric: Sequence[str], categorical: Sequence[str], target: str
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Numeric (float), categorical (text) and target columns as three aligned tables by ``rid``."""
    return (
        table.select("rid", "split", *[F.col(c).cast("float").alias(c) for c in numeric]),
        table.select("rid", "split", *[F.col(c).cast("string").alias(c) for c in categorical]),
        table.select("rid", "split", F.col(target).alias("y")),
    )


def matrix_info(table: DataFrame, numeric: Sequence[str], categorical: Sequence[str], target: str) -> DataFrame:
    """One row describing the export: rows per split, column lists, whole-number columns, task."""
    whole = F.filter(
        F.array(
            *[
                F.struct(F.lit(c).alias("c"), F.coalesce(F.bool_and(F.col(c) % 1 == 0), F.lit(False)).alias("w"))
                for c in numeric
            ]
        ),
        lambda e: e["w"],
    )
    return table.agg(
        F.count_if(F.col("split") == "train").alias("train_num"),
        F.count_if(F.col("split") == "test").alias("test_num"),
        F.array_join(F.array(*[F.lit(c) for c in numeric]), ",").alias("num_columns"),
        F.array_join(F.array(*[F.lit(c) for c in categorical]), ",").alias("cat_columns"),
        F.array_join(F.transform(whole, lambda e: e["c"]), ",").alias("int_columns"),
        F.when(F.countDistinct(target) == 2, "binclass").otherwise("multiclass").alias("task_type"),
    )
