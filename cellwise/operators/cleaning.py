"""Projections, filters and cleaning steps before records are compared or exported."""

from __future__ import annotations

import ast
import json
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Texts that stand for a missing category, and what they become.
MISSING_TEXTS = ("", "NA")
MISSING_LABEL = "nan"
BOOL_TEXTS = ("True", "False")


def drop_fields(records: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Remove top-level members of VARIANT records (identifiers, personal data)."""
    names = F.array(*[F.lit(f) for f in fields])
    members = F.map_filter(F.expr("cast(v AS map<string,variant>)"), lambda k, _: ~F.array_contains(names, k))
    return records.withColumn("v", F.to_variant_object(members))


def split_to_array(text: Column) -> Column:
    """Comma-separated text to an array of trimmed texts."""
    return F.transform(F.split(text, ",", -1), lambda e: F.regexp_replace(e, r"^\s+|\s+$", ""))


def _literal_text(text: str | None) -> str | None:
    if text is None:
        return None
    try:
        return json.dumps(ast.literal_eval(text), allow_nan=False)  # JSON has no infinities
    except (ValueError, SyntaxError, TypeError, MemoryError, RecursionError):
        return json.dumps(text)


@F.pandas_udf(T.StringType())
def _parsed_literal(texts: pd.Series) -> pd.Series:
    return texts.map(_literal_text, na_action="ignore")


# Forms that need no parser: whole numbers, plain texts, lists of both, and words, which are no literal.
_WHOLE = "(?:0|-?[1-9][0-9]*)"
_PLAIN = "'[A-Za-z0-9 _.:/+-]*'"
_LIST = rf"\[(?:(?:{_PLAIN}|{_WHOLE})(?:, (?:{_PLAIN}|{_WHOLE}))*)?\]"
_WORDS = "[A-Za-z][A-Za-z0-9]*(?:[ -][A-Za-z][A-Za-z0-9]*)*"


def literal_to_json(texts: Column | str) -> Column:
    """Python literal texts to JSON text; a text that is no literal stays a JSON string.

    The common forms are rewritten by built-in functions; only other texts reach Python."""
    texts = F.col(texts) if isinstance(texts, str) else texts
    whole = lambda pattern: texts.rlike(rf"\A(?:{pattern})\z")
    common = (
        F.when(texts == "True", "true")
        .when(texts == "False", "false")
        .when(texts == "None", "null")
        .when(whole(_WHOLE), texts)
        .when(whole(f"{_PLAIN}|{_LIST}"), F.replace(texts, F.lit("'"), F.lit('"')))
        .when(whole(_WORDS), F.concat(F.lit('"'), texts, F.lit('"')))
    )
    return F.coalesce(common, _parsed_literal(F.when(common.isNull(), texts)))


def clean_categoricals(
    table: DataFrame, categorical: Sequence[str], target: str | None = None, regression: bool = False
) -> DataFrame:
    """NULL, empty text and ``NA`` become ``nan``; a regression drops rows without target."""
    names = list(categorical) + ([target] if target and not regression else [])
    out = table
    for name in names:
        text = F.col(name).cast("string")
        out = out.withColumn(
            name, F.when(text.isNull() | text.isin(*MISSING_TEXTS), F.lit(MISSING_LABEL)).otherwise(text)
        )
    return out.dropna(subset=[target]) if target and regression else out


def restore_nulls(table: DataFrame, categorical: Sequence[str]) -> DataFrame:
    return table.withColumns({c: F.nullif(F.col(c), F.lit(MISSING_LABEL)) for c in categorical})


def bool_value(c: Column) -> Column:
    """Boolean from its text or number form."""
    text = c.cast("string")
    return F.when(text.isin("True", "true", "1", "1.0"), F.lit(True)).when(
        text.isin("False", "false", "0", "0.0"), F.lit(False)
    )


def bool_like_columns(table: DataFrame, columns: Sequence[str]) -> list[str]:
    """Columns whose every value is ``True`` or ``False`` (one aggregation, one row back)."""
    row = table.agg(
        *[F.coalesce(F.bool_and(F.col(c).isin(*BOOL_TEXTS)), F.lit(True)).alias(c) for c in columns]
    ).first()
    return [c for c in columns if row[c]]


def restore_bools(table: DataFrame, columns: Sequence[str], recorded: dict[str, str] | None = None) -> DataFrame:
    """Turn columns recorded as ``bool`` back into booleans; columns without a record are
    converted when all their values look like booleans."""
    recorded = recorded or {}
    known = [c for c in columns if recorded.get(c) == "bool"]
    unknown = [c for c in columns if c not in recorded]
    chosen = known + (bool_like_columns(table, unknown) if unknown else [])
    return table.withColumns({c: bool_value(F.col(c)) for c in chosen}) if chosen else table


def classify_columns(cells: DataFrame, target: str) -> DataFrame:
    """Role of every field: target, numeric (only numbers and nulls) or categorical."""
    profile = cells.groupBy("path").agg(
        F.bool_and(F.col("dtype").isin("num", "null")).alias("numeric_only"),
        F.bool_or(F.col("dtype") == "num").alias("has_num"),
    )
    return profile.select(
        "path",
        F.when(F.col("path") == target, "target")
        .when(F.col("numeric_only") & F.col("has_num"), "numeric")
        .otherwise("categorical")
        .alias("role"),
    )


def semantic_types(table: DataFrame) -> list[tuple[str, str]]:
    """Statistical type of every column of a table, from its schema alone."""
    out = []
    for field in table.schema.fields:
        kind = field.dataType
        if isinstance(kind, T.BooleanType):
            name = "boolean"
        elif isinstance(kind, T.NumericType):
            name = "numerical"
        elif isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            name = "datetime"
        else:
            name = "categorical"
        out.append((field.name, name))
    return out


def semantic_types_of_cells(cells: DataFrame) -> DataFrame:
    """The same for fields of records: one clean type names the kind, anything else is categorical."""
    only = lambda t: F.bool_and(F.col("dtype") == t)
    return cells.groupBy("path").agg(
        F.when(only("bool"), "boolean")
        .when(F.bool_and(F.col("dtype").isin("num", "null")) & F.bool_or(F.col("dtype") == "num"), "numerical")
        .otherwise("categorical")
        .alias("semantic_type")
    )


def integer_columns(cells: DataFrame) -> DataFrame:
    """Numeric fields and whether every number in them is whole."""
    return cells.filter("num IS NOT NULL").groupBy("path").agg(
        F.bool_and(F.col("num") % 1 == 0).alias("integer_valued")
    )


def task_type(table: DataFrame, target: str, task: str = "classification") -> DataFrame:
    """``regression`` as given; else binclass for two target values and multiclass for more."""
    n = F.countDistinct(target)
    return table.agg(
        n.alias("n_classes"),
        F.when(F.lit(task == "regression"), "regression").when(n == 2, "binclass").otherwise("multiclass").alias("task"),
    )


def evaluation_task(task: str) -> str:
    return "classification" if task in ("binclass", "multiclass") else task


def compact_records(table: DataFrame, columns: Sequence[str] | None = None) -> Column:
    """JSON text of a row without its NULL members."""
    return F.to_json(F.struct(*(columns or table.columns)))
