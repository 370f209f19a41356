"""Cumulative-snapshot collapse of logged conversations, and chat formatting, in DataFrame functions only.

A log may hold a conversation several times, each time some turns longer. Every turn gets the rolling
hash of its turn prefix: the exclusive-or of hashes of (place, role, text) over the turns so far, 128
bits in all. A conversation whose last prefix is a proper prefix of a longer one goes by an anti-join;
of equal conversations the smallest id stays. What is left is rendered with a chat template.

Places and rolling hashes are found in two levels, inside ranges of turn numbers and then over the
ranges, so a conversation with very many turns is spread over tasks. Rendering returns parts of at most
``PART`` turns, so no row gathers an unbounded conversation; usual conversations are one part.

Edge cases: rows of a null ``conv_id`` form one conversation; a null turn comes first, equal turn
numbers are ordered by role and text; a null role or text differs from an empty one in comparisons and
renders as an empty one; a repeated row is a turn of its own; marks of the template inside a text are
broken up, so that no text can pose as a turn; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellwise.session import materialize

RANGE = 512  # turn numbers per range
PART = 512  # turns per rendered part
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def rolling(turns: DataFrame) -> DataFrame:
    """``conv_id``, ``role``, ``text``, ``place`` (from 1) and the prefix hashes ``h1``, ``h2`` of every turn."""
    rows = turns.select(
        "conv_id", F.col("turn").cast("bigint").alias("turn"), "role", "text", F.coalesce(F.floor(F.col("turn") / RANGE), F.lit(-(2**62))).cast("bigint").alias("range")
    )
    inside = Window.partitionBy("conv_id", "range")
    ordered = rows.withColumn("nth", F.row_number().over(inside.orderBy(F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first())))
    ordered = materialize(ordered)
    # few rows: one per conversation and range
    before = Window.partitionBy("conv_id").orderBy("range")
    starts = materialize(
        ordered.groupBy("conv_id", "range").count().withColumn("earlier", F.coalesce(F.sum("count").over(before.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("conv_id", "range", "earlier")
    )
    same = ordered["conv_id"].eqNullSafe(starts["conv_id"]) & (ordered["range"] == starts["range"])
    placed = ordered.join(starts, same).select(ordered["conv_id"], ordered["range"], "role", "text", (F.col("nth") + F.col("earlier")).cast("bigint").alias("place"))

    def mark(salt: int) -> Column:
        return F.xxhash64(F.lit(salt), "place", F.col("role").isNull(), "role", F.col("text").isNull(), "text")

    hashed = placed.withColumn("m1", mark(1)).withColumn("m2", mark(2))
    so_far = inside.orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    hashed = materialize(hashed.withColumn("p1", F.bit_xor("m1").over(so_far)).withColumn("p2", F.bit_xor("m2").over(so_far)).drop("m1", "m2"))
    whole = hashed.groupBy("conv_id", "range").agg(F.max_by("p1", "place").alias("r1"), F.max_by("p2", "place").alias("r2"))
    earlier = before.rowsBetween(Window.unboundedPreceding, -1)
    carried = materialize(whole.select("conv_id", "range", F.coalesce(F.bit_xor("r1").over(earlier), F.lit(0)).alias("c1"), F.coalesce(F.bit_xor("r2").over(earlier), F.lit(0)).alias("c2")))
    same = hashed["conv_id"].eqNullSafe(carried["conv_id"]) & (hashed["range"] == carried["range"])
    joined = hashed.join(carried, same)
    return joined.select(hashed["conv_id"], "role", "text", "place", F.col("p1").bitwiseXOR(F.col("c1")).alias("h1"), F.col("p2").bitwiseXOR(F.col("c2")).alias("h2"))


def maximal(prefixes: DataFrame) -> DataFrame:
    """``conv_id``, ``n_turns`` and ``n_copies`` of the conversations that no longer one begins with; ``prefixes`` from ``rolling``."""
    ends = prefixes.groupBy("conv_id").agg(F.max("place").alias("n_turns"), F.max_by("h1", "place").alias("h1"), F.max_by("h2", "place").alias("h2"))
    ends = materialize(ends)
    longer = prefixes.join(ends.select(F.col("conv_id").alias("c"), "n_turns"), prefixes["conv_id"].eqNullSafe(F.col("c"))).where("place < n_turns")
    inner = longer.select(F.col("place").alias("n_turns"), "h1", "h2").distinct()
    groups = ends.groupBy("n_turns", "h1", "h2").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_copies"))
    return groups.join(inner, ["n_turns", "h1", "h2"], "left_anti").select("conv_id", "n_turns", "n_copies")


def segment(role: Column, text: Column) -> Column:
    """One rendered turn."""
    plain = lambda c: F.replace(F.coalesce(c, F.lit("")), F.lit("<|"), F.lit("< |"))
    return F.concat(F.lit(OPEN), plain(role), F.lit("\n"), plain(text), F.lit(CLOSE + "\n"))


def chat_format(turns: DataFrame) -> DataFrame:
    """Rendered maximal conversations: ``conv_id``, ``part`` (from 0), ``n_turns``, ``n_copies`` and ``rendered``."""
    prefixes = materialize(rolling(turns))
    kept = materialize(maximal(prefixes))
    lines = prefixes.select(F.col("conv_id").alias("c"), "place", segment(F.col("role"), F.col("text")).alias("segment"), F.floor((F.col("place") - 1) / PART).cast("int").alias("part"))
    parts = lines.join(kept, lines["c"].eqNullSafe(kept["conv_id"])).groupBy("conv_id", "part", "n_turns", "n_copies").agg(F.array_sort(F.collect_list(F.struct("place", "segment"))).alias("s"))
    return parts.select("conv_id", "part", "n_turns", "n_copies", F.array_join(F.transform("s", lambda x: x["segment"]), "").alias("rendered"))


CHECK_SQL = """
WITH whole AS (
  SELECT conv_id, list(struct_pack(r := role, t := text) ORDER BY turn, role, text) AS l FROM conversations GROUP BY conv_id
), prefixes AS (
  SELECT DISTINCT l[1:i] AS l FROM (SELECT l, unnest(range(1, len(l))) AS i FROM whole)
), kept AS (
  SELECT min(conv_id) AS conv_id, count(*) AS n_copies, l FROM whole
  WHERE NOT EXISTS (SELECT 1 FROM prefixes p WHERE p.l = whole.l) GROUP BY l
)
SELECT conv_id, CAST(0 AS INTEGER) AS part, CAST(len(l) AS BIGINT) AS n_turns, n_copies,
  list_aggregate(list_transform(l, lambda x: '<|im_start|>' || replace(coalesce(x.r, ''), '<|', '< |') || chr(10)
    || replace(coalesce(x.t, ''), '<|', '< |') || '<|im_end|>' || chr(10)), 'string_agg', '') AS rendered
FROM kept
"""
