"""Facts and checks of a table that a specification lists, one row each.

The specification is a table: a *fact* names a measure of one or two fields, a *check* compares a fact with a number, with
another fact, or with the same fact of the real table. All facts come from one aggregation of the cells that they
name; checks are a join of facts and specification. Both follow any table of cells, so the same code verifies a
generated benchmark and a table read from files.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellwise.operators.cells import CONTAINERS, typed_view
from cellwise.session import materialize

# Measures: ``missing`` (share of records without a value of ``field``), ``correlation`` (of the numbers of ``field`` and ``other``),
# ``mean`` (of the numbers of ``field``), ``share`` (of records whose ``field`` is ``value``), ``distinct`` (values), ``odd`` (cells of a type
# that is not listed in ``value``). All but ``distinct`` may be restricted to records whose ``other`` is ``among``.
FACT = "name string, measure string, field string, other string, value string, among string"
# Rules: ``at_most`` and ``near`` (a number), ``same`` (the real table's fact, within ``tolerance``), ``above`` (another fact, by ``tolerance``).
CHECK = "name string, rule string, fact string, against string, number double, tolerance double, soft boolean"


def fact_table(spark: SparkSession, facts: Sequence[tuple]) -> DataFrame:
    """Rows (name, measure, field, other, value, among)."""
    return spark.createDataFrame([tuple(f) for f in facts], FACT)


def check_table(spark: SparkSession, checks: Sequence[tuple]) -> DataFrame:
    """Rows (name, rule, fact, against, number, tolerance, soft)."""
    return spark.createDataFrame([tuple(c) for c in checks], CHECK)


def facts(cells: DataFrame, records: DataFrame, wanted: DataFrame, keys: Sequence[str] = ("rid",)) -> DataFrame:
    """(name, value) of every fact of ``wanted``; NULL where it is not defined."""
    keys = list(keys)
    used = wanted.select(F.explode(F.array("field", "other")).alias("path")).where("path IS NOT NULL").distinct()
    typed = typed_view(cells.join(F.broadcast(used), "path"), keys)  # one row per field of the specification
    value = F.when(F.col("typ") == "num", F.struct("x", F.coalesce("s", F.col("x").cast("string")).alias("s"))).when(F.col("typ").isin("cat", "bool"), F.struct("x", "s")).when(
        F.col("typ") == "date", F.struct(F.lit(None).cast("double").alias("x"), F.col("x").cast("bigint").cast("string").alias("s"))
    )
    cell = F.struct("path", F.when(F.col("typ") == "dtype", F.col("s")).alias("dtype"), value.alias("v"))
    held = typed.where(F.col("typ") != "alen").groupBy(*keys).agg(F.collect_list(cell).alias("cells"))
    rows = records.select(*keys).join(held, keys, "left").select(F.coalesce("cells", F.array().cast(held.schema["cells"].dataType)).alias("cells"))
    spec = wanted.agg(F.collect_list(F.struct(*wanted.columns))).scalar()  # the specification itself, beside every record
    each = rows.select("cells", F.explode(spec).alias("f"))
    first = lambda field, part: F.try_element_at(F.filter("cells", lambda c: (c["path"] == F.col(field)) & c[part].isNotNull()), F.lit(1))[part]
    named = each.select(
        "f.*", first("f.field", "dtype").alias("dtype"), first("f.field", "v").alias("own"), first("f.other", "v").alias("its")
    )
    inside = F.col("among").isNull() | F.coalesce(F.col("its.s") == F.col("among"), F.lit(False))
    flag = (
        F.when(F.col("measure") == "missing", F.coalesce(F.col("dtype") == "null", F.lit(True)))
        .when(F.col("measure") == "share", F.coalesce(F.col("own.s") == F.col("value"), F.lit(False)))
        .cast("double")
    )
    odd = (F.col("measure") == "odd") & F.col("dtype").isNotNull() & (F.col("dtype") != "null") & ~F.array_contains(F.split("value", ","), F.col("dtype"))
    both = F.col("own.x").isNotNull() & F.col("its.x").isNotNull()
    x, y = F.when(both, F.col("own.x")), F.when(both, F.col("its.x"))
    sums = named.where(inside).groupBy("name", "measure").agg(
        F.avg(flag).alias("rate"),
        F.avg("own.x").alias("mean"),
        F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y)).alias("r"),
        F.count_if(odd).cast("double").alias("odd"),
    )
    found = sums.select("name", F.when(F.col("measure").isin("missing", "share"), F.col("rate")).when(F.col("measure") == "mean", F.col("mean")).when(F.col("measure") == "correlation", F.col("r")).when(F.col("measure") == "odd", F.col("odd")).alias("value"))
    levels = typed.where((F.col("typ") != "dtype") & ~F.col("typ").isin(*CONTAINERS, "alen")).select("path", "typ", "x", "s").distinct()
    distinct = levels.groupBy("path").agg(F.count(F.lit(1)).cast("double").alias("levels"))
    own = wanted.select("name", "measure", "field")
    filled = own.join(found, "name", "left").join(distinct.withColumnRenamed("path", "field"), "field", "left")
    value = F.when(F.col("measure") == "distinct", F.coalesce("levels", F.lit(0.0))).otherwise(F.col("value"))
    return filled.select("name", value.alias("value"))


def audit(synth: DataFrame, real: DataFrame, checks: DataFrame) -> DataFrame:
    """PASS, WARN or FAIL of every check: (name, status, actual, expected) from the facts of both tables."""
    synth, real = materialize(synth), materialize(real)
    own = synth.select(F.col("name").alias("fact"), F.col("value").alias("actual"))
    other = synth.select(F.col("name").alias("against"), F.col("value").alias("other"))
    its = real.select(F.col("name").alias("fact"), F.col("value").alias("real"))
    row = checks.join(own, "fact", "left").join(its, "fact", "left").join(other, "against", "left")
    expected = F.when(F.col("rule") == "same", F.col("real")).when(F.col("rule") == "above", F.col("other")).otherwise(F.col("number"))
    passed = (
        F.when(F.col("rule") == "at_most", F.col("actual") <= expected)
        .when(F.col("rule") == "above", F.col("actual") > expected + F.col("tolerance"))
        .otherwise(F.abs(F.col("actual") - expected) < F.col("tolerance"))
    )
    status = F.when(F.coalesce(passed, F.lit(False)), "PASS").when(F.col("soft"), "WARN").otherwise("FAIL")
    return row.select("name", status.alias("status"), "actual", expected.alias("expected"))
