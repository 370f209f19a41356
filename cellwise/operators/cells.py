"""Records to cells: flattening, cell typing, the typed view and column profiles.

A *record* frame carries key columns and a VARIANT column ``v``. A *cell* frame has
one row per present path of a record; an absent path has no row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellwise.functions.expr import (
    TYPED_SUFFIXES,
    VALUE_TYPES,
    json_dtype,
    nonneg_zero,
    python_bool,
    suffix_rank,
    try_timestamp,
)
from cellwise.session import materialize

KEYS = ("rid", "split", "replicate")
CONTAINERS = ("array", "object")


def _members(v: str) -> str:
    """Name and value of the direct members of a container, in SQL; none for a scalar."""
    named = f"transform(map_entries(try_cast({v} AS map<string,variant>)), e -> named_struct('k', e.key, 'v', e.value))"
    listed = f"transform(try_cast({v} AS array<variant>), (e, i) -> named_struct('k', cast(i AS string), 'v', e))"
    return f"coalesce({named}, {listed}, array())"


def nesting_depth(v: str = "v") -> str:
    """Levels of containers in a record, in SQL: the deepest bracket of its text outside of strings."""
    unescaped = rf"replace(replace(to_json({v}), '\\\\', ''), '\\\"', '')"
    brackets = rf"""regexp_replace({unescaped}, '"[^"]*"|[^\\[\\]{{}}"]+', '')"""
    step = "named_struct('now', a.now + if(c IN ('[', '{'), 1, -1), 'top', greatest(a.top, a.now + if(c IN ('[', '{'), 1, -1)))"
    return f"aggregate(filter(split({brackets}, ''), c -> c <> ''), named_struct('now', 0, 'top', 0), (a, c) -> {step}, a -> a.top)"


def explode_paths(
    records: DataFrame, keys: Sequence[str] = KEYS, max_depth: int | None = None
) -> DataFrame:
    """One row per path of every record: keys, dotted ``path``, ``depth``, VARIANT ``v``.

    A record is read once: the members of each level are listed from those above, inside the row, and
    one generator yields a node and all below it. Without ``max_depth`` one aggregate finds the
    deepest nesting first. With it, a deeper container raises: nothing is cut off.
    """
    keys = list(keys)
    depth = max_depth
    if depth is None:
        depth = max(1, records.select(F.max(F.expr(nesting_depth())).alias("d")).first()["d"] or 1)
    node = "named_struct('path', {path}, 'depth', {depth}, 'v', m.v)"
    out = records.select(*keys, F.expr(f"transform({_members('v')}, m -> {node.format(path='m.k', depth=1)})").alias("l1"))
    for d in range(2, depth + 1):
        below = node.format(path="concat_ws('.', n.path, m.k)", depth=d)
        out = out.withColumn(f"l{d}", F.expr(f"flatten(transform(l{d - 1}, n -> transform({_members('n.v')}, m -> {below})))"))
    nodes = F.concat(*[F.col(f"l{d}") for d in range(1, depth + 1)])
    if max_depth is not None:
        deeper = F.expr(f"exists(l{depth}, n -> size({_members('n.v')}) > 0)")
        nodes = F.when(deeper, F.raise_error(F.lit("record nested deeper than max_depth")).cast(out.schema["l1"].dataType)).otherwise(nodes)
    return out.select(*keys, F.explode(nodes).alias("n")).select(*keys, "n.path", "n.depth", "n.v")


def type_cells(paths: DataFrame, keys: Sequence[str] = KEYS, with_json: bool = False) -> DataFrame:
    """Give every path its dtype and put its value in the column of that type."""
    text = F.try_variant_get("v", "$", "string")
    # whole numbers that a double may not tell from their neighbours keep their text beside it
    base = paths.withColumn("json", F.to_json("v")).withColumn("dtype", json_dtype(F.col("json"), F.col("v")))
    base = base.withColumn("text", F.when(F.col("dtype").isin("cat", "date"), text)).withColumn("number", F.when(F.col("dtype") == "num", F.try_variant_get("v", "$", "double")))
    cols = [
        *keys,
        "path",
        "depth",
        "dtype",
        nonneg_zero(F.col("number")).alias("num"),
        F.when(F.col("dtype") == "cat", F.col("text")).alias("cat"),
        F.when(F.col("dtype") == "date", try_timestamp(F.col("text"))).alias("date"),
        F.when(F.col("dtype") == "bool", F.try_variant_get("v", "$", "boolean")).alias("bool"),
        F.when(F.col("dtype") == "array", F.size(F.expr("try_cast(v AS array<variant>)"))).alias("alen"),
        F.when((F.abs("number") >= 1e15) & F.col("json").rlike("^-?[0-9]{16,}$"), F.col("json")).alias("whole"),
    ]
    if with_json:
        cols.append("json")
    return base.select(*cols)


def flatten(
    records: DataFrame,
    keys: Sequence[str] = KEYS,
    leaf_only: bool = False,
    with_json: bool = False,
    max_depth: int | None = None,
) -> DataFrame:
    """Typed cells of all records; ``leaf_only`` keeps scalars and nulls."""
    out = type_cells(explode_paths(records, keys, max_depth), keys, with_json)
    if leaf_only:
        out = out.filter(~F.col("dtype").isin(*CONTAINERS))
    return out


def numeric_null_as_missing(cells: DataFrame) -> DataFrame:
    """Drop null cells of paths whose other cells are all numbers (the pandas coercion)."""
    numeric = (
        cells.groupBy("path")
        .agg(
            F.bool_and(F.col("dtype").isin("num", "null")).alias("numeric_only"),
            F.bool_or(F.col("dtype") == "num").alias("has_num"),
        )
        .filter("numeric_only AND has_num")
        .select("path", F.lit("null").alias("dtype"))
    )
    return cells.join(numeric, ["path", "dtype"], "left_anti")


def typed_view(cells: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Cells as (field, typed column, value) rows: one ``dtype`` row per cell and one
    row for its value when there is one. Numbers, dates (epoch microseconds) and
    lengths are in ``x``; categories, dtypes and booleans are in ``s``, and so is the exact text of
    a whole number of 16 digits or more."""
    empty_x, empty_s = F.lit(None).cast("double"), F.lit(None).cast("string")
    value = (
        F.when(F.col("dtype") == "num", F.col("num"))
        .when(F.col("dtype") == "date", F.unix_micros("date").cast("double"))
        .when(F.col("dtype") == "array", F.col("alen").cast("double"))
    )
    exact = F.col("whole") if "whole" in cells.columns else empty_s
    label = F.when(F.col("dtype") == "cat", F.col("cat")).when(F.col("dtype") == "num", exact).when(F.col("dtype") == "bool", python_bool(F.col("bool")))
    rows = F.array(
        F.struct(F.lit("dtype").alias("typ"), empty_x.alias("x"), F.col("dtype").alias("s")),
        F.struct(
            F.when(F.col("dtype") == "array", F.lit("alen")).otherwise(F.col("dtype")).alias("typ"),
            value.alias("x"),
            F.coalesce(label, empty_s).alias("s"),
        ),
    )
    return (
        cells.select(*keys, "path", F.explode(rows).alias("t"))
        .select(*keys, "path", "t.typ", "t.x", "t.s")
        .filter((F.col("typ") == "dtype") | F.col("x").isNotNull() | F.col("s").isNotNull())
    )


def separate_types(cells: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Typed view with display names: ``col`` is ``path.dtype``, ``path.num`` and so on."""
    return typed_view(cells, keys).withColumn("col", F.concat_ws(".", "path", "typ"))


def profile(cells: DataFrame) -> DataFrame:
    """Per path: cells present, dtype set and counts of cells per dtype."""
    counts = [
        F.count_if(F.col("dtype") == t).alias(f"n_{t}")
        for t in ("num", "cat", "date", "bool", "null", "array", "object")
    ]
    return cells.groupBy("path").agg(
        F.count(F.lit(1)).alias("present"),
        F.sort_array(F.collect_set("dtype")).alias("dtypes"),
        *counts,
    )


def homogeneous_paths(cells: DataFrame, n_records: int) -> DataFrame:
    """Paths that need no separation: at most one value type and no absent cell."""
    value_types = F.size(F.array_except("dtypes", F.array(F.lit("null"))))
    return profile(cells).select(
        "path",
        "present",
        value_types.cast("bigint").alias("value_types"),
        ((value_types <= 1) & (F.col("present") == n_records)).alias("passthrough"),
    )


def separate_columns(
    cells: DataFrame, n_records: int, columns: Sequence[str] | None = None, force: bool = False, keys: Sequence[str] = KEYS
) -> DataFrame:
    """Fields as columns of a flat table: (keys, ``path``, ``typ``, ``col``, ``x``, ``s``, ``kept``).

    A field of one value type that no record lacks keeps its name, and so does one outside of ``columns`` if they are
    given; the other fields become typed columns, all of them with ``force``. A kept column has one row per cell: its dtype in
    ``typ``, which is the recorded type needed to restore it, and its value; the text of a container is in ``s`` if
    the cells have ``json``."""
    uniform = homogeneous_paths(cells, n_records).select("path", (F.col("passthrough") & F.lit(not force)).alias("kept"))
    if columns is not None:
        uniform = uniform.select("path", (F.col("kept") | ~F.col("path").isin(*columns)).alias("kept"))
    fields = materialize(uniform)
    typed = typed_view(cells, keys).join(fields.filter("NOT kept").select("path"), "path")
    separated = typed.select(*keys, "path", "typ", F.concat_ws(".", "path", "typ").alias("col"), "x", "s", F.lit(False).alias("kept"))
    own = cells.join(fields.filter("kept").select("path"), "path")
    value = F.when(F.col("dtype") == "num", F.col("num")).when(F.col("dtype") == "date", F.unix_micros("date").cast("double"))
    exact = F.col("whole") if "whole" in cells.columns else F.lit(None).cast("string")
    text = F.when(F.col("dtype") == "cat", F.col("cat")).when(F.col("dtype") == "num", exact).when(F.col("dtype") == "bool", python_bool(F.col("bool")))
    if "json" in cells.columns:
        text = F.when(F.col("dtype").isin(*CONTAINERS), F.col("json")).otherwise(text)
    plain = own.select(*keys, "path", F.col("dtype").alias("typ"), F.col("path").alias("col"), value.alias("x"), text.alias("s"), F.lit(True).alias("kept"))
    return separated.unionByName(plain)


def column_catalog(cells: DataFrame) -> DataFrame:
    """Typed columns that exist: (path, typ, col) for every dtype seen at a path."""
    seen = cells.select("path", "dtype").distinct()
    typ = F.when(F.col("dtype") == "array", F.lit("alen")).when(
        F.col("dtype").isin(*VALUE_TYPES), F.col("dtype")
    )
    return (
        seen.select("path", F.explode(F.array(F.lit("dtype"), typ)).alias("typ"))
        .filter("typ IS NOT NULL")
        .distinct()
        .withColumn("col", F.concat_ws(".", "path", "typ"))
    )


def column_map(columns: DataFrame) -> DataFrame:
    """Group typed column names (``col``) by the field they come from, in typed order.

    A name without a matching ``.dtype`` column stands for itself."""
    pattern = r"^(.*)\.(" + "|".join(TYPED_SUFFIXES) + ")$"
    parsed = columns.select(
        "col",
        F.regexp_extract("col", pattern, 1).alias("field"),
        F.regexp_extract("col", pattern, 2).alias("typ"),
    )
    fields = parsed.filter(F.col("typ") == "dtype").select("field", F.lit(True).alias("separated"))
    named = parsed.join(fields, "field", "left").select(
        F.when(F.col("separated"), F.col("field")).otherwise(F.col("col")).alias("field"),
        F.when(F.col("separated"), suffix_rank(F.col("typ"))).otherwise(F.lit(0)).alias("rank"),
        "col",
    )
    return named.groupBy("field").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("rank", "col"))), lambda e: e["col"]).alias("typed_columns")
    )


def flatten_wide(cells: DataFrame, paths: Sequence[str], keys: Sequence[str] = KEYS) -> DataFrame:
    """One column per path (sorted), values as JSON text; for a modest list of paths.

    The explicit path list makes this a single conditional aggregation by record."""
    return cells.groupBy(*keys).pivot("path", sorted(paths)).agg(F.first("json"))


def union_records(groups: dict[str, DataFrame], keys: Sequence[str] = ("rid",)) -> DataFrame:
    """Stack named record groups under a ``split`` tag; every group feeds one cell table."""
    out = None
    for tag, frame in groups.items():
        tagged = frame.select(*keys, F.lit(tag).alias("split"), "v")
        out = tagged if out is None else out.unionByName(tagged)
    return out


def nested_predicates(cells: DataFrame) -> DataFrame:
    """One row: any container cell, any dotted path, and container cells holding members."""
    container = F.col("dtype").isin(*CONTAINERS)
    return cells.agg(
        F.coalesce(F.bool_or(container & (F.col("depth") == 1)), F.lit(False)).alias("is_nested"),
        F.coalesce(F.bool_or(container), F.lit(False)).alias("has_nested_cells"),
        F.coalesce(F.bool_or(F.col("path").contains(".")), F.lit(False)).alias("has_flattened_columns"),
    )
