"""Shared inputs of the registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellwise.operators.cells import flatten
from cellwise.session import materialize
from cellwise.sources import fixtures

# Nesting depth of each document view; a deeper record would raise, not be cut.
DEPTH = {"event": 2, "order": 3, "conv": 3, "customer": 1}
VIEWS = {"event": fixtures.event_docs, "order": fixtures.order_docs, "conv": fixtures.conv_docs, "customer": fixtures.customer_docs}


def docs(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    return VIEWS[kind](spark, sf_dir)


def records(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    return fixtures.parse(docs(spark, sf_dir, kind))


def prepared(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    """Records parsed and written once, for queries that read them several times."""
    return materialize(records(spark, sf_dir, kind))


def cells(spark: SparkSession, sf_dir: str, kind: str, **options) -> DataFrame:
    return cells_of(prepared(spark, sf_dir, kind), kind, **options)


def cells_of(base: DataFrame, kind: str, **options) -> DataFrame:
    return flatten(base, max_depth=DEPTH[kind], **options)


def both(spark: SparkSession, sf_dir: str, kind: str, **options) -> tuple[DataFrame, DataFrame]:
    """(cells, records) over the same prepared records."""
    base = prepared(spark, sf_dir, kind)
    return cells_of(base, kind, **options), base


def r6(name: str, alias: str | None = None):
    """Rounded output column; adding zero folds -0.0."""
    return (F.round(name, 6) + F.lit(0.0)).alias(alias or name)
