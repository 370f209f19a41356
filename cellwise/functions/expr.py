"""Column expressions shared by the operators (all built-in, JVM side)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Names of the typed columns of one field, in their column order.
TYPED_SUFFIXES = ("dtype", "num", "cat", "date", "bool", "alen")
CONTINUOUS = ("num", "date", "alen")
DISCRETE = ("dtype", "cat", "bool")
VALUE_TYPES = ("num", "cat", "bool", "date")
# Fixed value: prefix pattern of an ISO date or date-time string.
ISO_PREFIX = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}(T[0-9]{2}:[0-9]{2}:[0-9]{2})?"


def suffix_rank(typ: Column) -> Column:
    """Order of the typed columns within one field."""
    return F.array_position(F.array(*[F.lit(t) for t in TYPED_SUFFIXES]), typ)


def many(df: DataFrame) -> DataFrame:
    """A side of a join with a row per record or cell, never to be collected and broadcast.

    The optimizer sizes a projection by the widths of its columns and takes a VARIANT for 2 KB: of a table of millions of
    records, the columns beside it seem small enough for the driver."""
    return df.hint("merge")


def cell_dtype(v: Column) -> Column:
    """Type of one VARIANT cell: null, bool, num, date, cat, array or object."""
    shape = F.schema_of_variant(v)
    return (
        F.when(shape == "VOID", "null")
        .when(shape == "BOOLEAN", "bool")
        .when(shape == "STRING", F.when(F.try_variant_get(v, "$", "string").rlike(ISO_PREFIX), "date").otherwise("cat"))
        .when(shape.startswith("ARRAY"), "array")
        .when(shape.startswith("OBJECT"), "object")
        .when(shape.startswith("DATE") | shape.startswith("TIMESTAMP"), "date")
        .when(shape.isin("BIGINT", "DOUBLE", "FLOAT") | shape.startswith("DECIMAL"), "num")
        .otherwise("cat")
    )


def json_dtype(text: Column, v: Column) -> Column:
    """``cell_dtype`` of a VARIANT cell with its JSON ``text``: the first character tells all but the types written in quotes."""
    first = F.substring(text, 1, 1)
    return (
        F.when(first == "{", "object")
        .when(first == "[", "array")
        .when(first.between("0", "9") | (first == "-"), "num")
        .when(first == "t", "bool")
        .when(first == "f", "bool")
        .when(first == "n", "null")
        .otherwise(cell_dtype(v))
    )


def try_timestamp(text: Column) -> Column:
    return text.try_cast("timestamp")


def nonneg_zero(c: Column) -> Column:
    """Fold -0.0 into 0.0 so that equal numbers are equal group keys and print alike."""
    return c + F.lit(0.0)


def rank_key(seed: int, *ids: Column | str) -> Column:
    """Repeatable random key of a row: md5 of seed and row id, independent of partitioning."""
    cols = [F.col(i) if isinstance(i, str) else i for i in ids]
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[c.cast("string") for c in cols]).cast("binary"))


def unit_uniform(seed: int | str, *ids: Column | str) -> Column:
    """Uniform number in [0, 1) from the first 52 bits of the md5 of seed and ids."""
    cols = [F.col(i) if isinstance(i, str) else i for i in ids]
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), *[c.cast("string") for c in cols]).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def unit_normal(seed: int | str, *ids: Column | str) -> Column:
    """Standard normal number from two hash uniforms (Box-Muller)."""
    u = F.lit(1.0) - unit_uniform(f"{seed}.r", *ids)
    w = unit_uniform(f"{seed}.t", *ids)
    return F.sqrt(F.lit(-2.0) * F.log(u)) * F.cos(F.lit(2.0) * F.pi() * w)


def json_quote(text: Column) -> Column:
    """Text as a JSON string literal; only texts with special characters pay for escaping."""
    wrapped = F.to_json(F.array(text))
    return F.when(text.rlike("^[A-Za-z0-9 _.:/+-]*$"), F.concat(F.lit('"'), text, F.lit('"'))).when(
        text.isNotNull(), wrapped.substr(F.lit(2), F.length(wrapped) - F.lit(2))
    )


def last_segment(path: Column) -> Column:
    return F.substring_index(path, ".", -1)


def parent_path(path: Column) -> Column:
    """Path without its last segment; empty at the top level."""
    return path.substr(F.lit(1), F.greatest(F.length(path) - F.length(last_segment(path)) - F.lit(1), F.lit(0)))


def python_bool(c: Column) -> Column:
    return F.when(c, "True").when(~c, "False")
