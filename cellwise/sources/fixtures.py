"""Document views over the given tables: JSON records derived by SQL expressions.

The same expressions exist for the check engine in ``cellwise.plans.oracle_parts``.
Keys are written in sorted order and numbers without trailing zeros, so the text is
already canonical JSON.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellwise.functions.expr import many
from cellwise.session import spread, table

SPLIT = "CASE WHEN {id} % 5 IN (0, 1) THEN 'train' WHEN {id} % 5 = 2 THEN 'test' ELSE 'synth' END"


def number_text(expr: str) -> str:
    return f"regexp_replace(cast(cast({expr} AS decimal(18,2)) AS string), '[.]?0+$', '')"


def event_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One document per event: a field of mixed type with nulls, an optional date,
    a nested object and a boolean."""
    value = number_text("value")
    doc = f"""concat('{{"props":', replace(props, ' ', ''),
        CASE WHEN event_id % 7 = 0 THEN '' ELSE concat(',"ts":"', date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), '"') END,
        ',"type":"', event_type, '"',
        ',"value":', CASE WHEN event_id % 13 = 0 THEN '"n/a"' WHEN event_id % 17 = 0 THEN 'null' ELSE {value} END,
        ',"vip":', CASE WHEN user_id % 3 = 0 THEN 'true' ELSE 'false' END, '}}')"""
    events = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value", "props")
    return spread(events, "event_id").selectExpr(
        "event_id AS rid",
        f"{SPLIT.format(id='event_id')} AS split",
        "cast(event_id % 3 + 1 AS int) AS replicate",
        f"{doc} AS doc",
    )


def order_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One document per order with its lines as an array of objects (empty when it has none)."""
    orders = spread(
        table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate", "o_totalprice"),
        "o_orderkey",
    ).selectExpr("o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate", f"{number_text('o_totalprice')} AS total"
    )
    item = """concat('{"flag":"', l_returnflag, '","ln":', l_linenumber, ',"part":', l_partkey, '}')"""
    lines = (
        table(spark, sf_dir, "lineitem")
        .select(
            "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_returnflag", F.expr(item).alias("item")
        )
        .groupBy("l_orderkey")
        .agg(
            F.sort_array(
                F.collect_list(
                    F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_returnflag", "item")
                )
            ).alias("lines")
        )
        .select("l_orderkey", F.array_join(F.col("lines.item"), ",").alias("items"))
    )
    lines = many(lines)
    doc = """concat('{"customer":{"key":', o_custkey, '},"date":"', cast(cast(o_orderdate AS date) AS string),
        '","items":[', coalesce(items, ''), '],"status":"', o_orderstatus, '","total":', total, '}')"""
    return orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left").selectExpr(
        "o_orderkey AS rid",
        f"{SPLIT.format(id='o_orderkey')} AS split",
        "cast(o_orderkey % 3 + 1 AS int) AS replicate",
        f"{doc} AS doc",
    )


def conv_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One document per conversation: its turns with role and text length."""
    turns = (
        table(spark, sf_dir, "conversations")
        .select("conv_id", "turn", "role", F.length("text").alias("n"))
        .groupBy("conv_id")
        .agg(F.sort_array(F.collect_list(F.struct("turn", "role", "n"))).alias("turns"))
    )
    item = """concat('{"n":', e.n, ',"role":"', e.role, '","turn":', e.turn, '}')"""
    return turns.selectExpr(
        "conv_id AS rid",
        f"{SPLIT.format(id='conv_id')} AS split",
        "cast(conv_id % 3 + 1 AS int) AS replicate",
        f"""concat('{{"conv_id":', conv_id, ',"turns":[', array_join(transform(turns, e -> {item}), ','), ']}}') AS doc""",
    )


def customer_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One small flat document per customer; some synthetic ones copy a training document."""
    customers = table(spark, sf_dir, "customer").selectExpr(
        "c_custkey AS src",
        f"""concat('{{', CASE WHEN c_custkey % 7 = 0 THEN '' ELSE concat('"acctbal":', {number_text('c_acctbal')}, ',') END,
            '"nation":', c_nationkey, ',"segment":"', c_mktsegment, '"}}') AS doc""",
    )
    keys = spread(table(spark, sf_dir, "customer").select("c_custkey"), "c_custkey").selectExpr(
        "c_custkey AS rid", "CASE WHEN c_custkey % 10 = 3 THEN c_custkey - 3 ELSE c_custkey END AS src"
    )
    return keys.join(many(customers), "src").selectExpr(
        "rid", f"{SPLIT.format(id='rid')} AS split", "cast(rid % 3 + 1 AS int) AS replicate", "doc"
    )


def parse(docs: DataFrame) -> DataFrame:
    """Document text to records; the views hold valid JSON, so a bad line is an error."""
    return docs.select("rid", "split", "replicate", F.parse_json("doc").alias("v"))
