"""Best-fit packing of token sequences under several capacities at once.

An item is a piece of a document. Its demand vector is (tokens, documents = 1, attention cost = length
squared), so it is fixed by its length, and Spark only has to count the pieces of each length: at most
``capacity`` counts, however large the corpus. Bins are filled one after another: among the lengths
that fit under every residual capacity, the next piece is the one with the largest weighted dot product
of demand and residual, or the one that leaves the smallest weighted residual norm. A filled bin's
pattern is repeated as often as the counts allow, so few patterns describe all bins. Pieces of a length
are then numbered across partitions, and their numbers are looked up in the pattern table.

Edge cases: a null text counts as empty and gives one piece that is the end id alone; rows with null
or repeated ids are packed row by row; an empty table gives no pieces; other columns are ignored; ties
between lengths go to the longer one.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellwise.llm import tokens
from cellwise.llm.common import binary_column, slices, small_batches, stored, utf8

CACHE_WORDS = 300_000


def pieces(docs: DataFrame, path: str, capacity: int = 1024, end_id: int | None = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: ``doc_id``, ``piece``, ``start``, ``length`` and ``ids`` (little-endian unsigned 32-bit).

    A document's ids and ``end_id`` are cut only beyond ``capacity``; then the first piece may be shorter.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = tokens.load(path)
        cache: dict[bytes, list[int]] = {}
        for batch in batches:
            for part in slices(batch, "text"):
                index, words, first = tokens.text_words(*utf8(part.column("text")), vocabulary.added)
                table, begin = tokens.known_ids(words.to_pylist(), vocabulary, cache, CACHE_WORDS)
                ids, starts = tokens.gather(begin, table, index)
                at = starts[first]
                if end_id is not None:
                    ids = np.insert(ids, at[1:], end_id)
                    at = at + np.arange(len(at))
                total = np.diff(at)
                count = np.maximum(1, -(-total // capacity))
                owner = np.repeat(np.arange(len(total)), count)
                piece = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
                short = total[owner] - (count[owner] - 1) * capacity  # length of a document's first piece
                start = np.where(piece == 0, 0, short + (piece - 1) * capacity)
                length = np.where(piece == 0, short, capacity)
                edges = np.r_[at[owner] + start, at[-1]] * 4
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").take(pa.array(owner)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), binary_column(ids.astype("<u4").view(np.uint8), edges)],
                    names=["doc_id", "piece", "start", "length", "ids"],
                )

    picked = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    return picked.mapInArrow(run, "doc_id bigint, piece int, start bigint, length bigint, ids binary")


def fill(counts: dict[int, int], capacities: tuple[float, float, float], weights: tuple[float, float, float] = (1.0, 0.0, 0.0), score: str = "dot") -> list[tuple[list[tuple[int, int]], int]]:
    """Patterns ([(length, times), ...], number of bins) that place every piece.

    ``capacities``: tokens, documents, attention cost (sum of squared lengths). A bin's next piece is
    chosen as the module text says; demands and residuals are taken as shares of the capacities.
    """
    left = {n: c for n, c in counts.items() if c > 0}
    lengths = sorted(left)
    for n in lengths:
        if n > capacities[0] or capacities[1] < 1 or n * n > capacities[2]:
            raise ValueError(f"a piece of {n} tokens fits no bin")
    patterns = []
    while lengths:
        residual = list(capacities)
        used: dict[int, int] = {}
        while residual[1] >= 1:
            high = bisect.bisect_right(lengths, min(residual[0], residual[2] ** 0.5 + 1e-9))
            best, chosen = None, 0
            for n in reversed(lengths[:high]):
                if left[n] <= used.get(n, 0) or n * n > residual[2]:
                    continue
                if score == "dot":
                    # each term grows with the length, so the longest piece that fits has the largest product
                    chosen = n
                    break
                rest = ((residual[0] - n) / capacities[0], (residual[1] - 1) / capacities[1], (residual[2] - n * n) / capacities[2])
                value = -sum(w * r * r for w, r in zip(weights, rest, strict=True))
                if best is None or value > best:
                    best, chosen = value, n
            if not chosen:
                break
            used[chosen] = used.get(chosen, 0) + 1
            residual = [residual[0] - chosen, residual[1] - 1, residual[2] - chosen * chosen]
        times = min(left[n] // k for n, k in used.items())
        patterns.append((sorted(used.items(), reverse=True), times))
        for n, k in used.items():
            left[n] -= k * times
            if not left[n]:
                del left[n]
                lengths.remove(n)
    return patterns


def _numbered(df: DataFrame, key: str) -> DataFrame:
    """Adds ``rank_``, from 0 within each value of ``key``, without gathering a value in one task.

    ``df`` must be a written table. Counts per part and value give each part its first number.
    """
    counts = df.groupBy(key, "part_").count()
    from pyspark.sql import Window

    before = counts.select(key, "part_", (F.sum("count").over(Window.partitionBy(key).orderBy("part_")) - F.col("count")).alias("before_"))
    inside = df.withColumn("in_", F.row_number().over(Window.partitionBy("part_", key).orderBy("order_")) - 1)
    return inside.join(before, [key, "part_"]).withColumn("rank_", F.col("in_") + F.col("before_")).drop("in_", "before_")


def pack(items: DataFrame, capacity: int = 1024, max_docs: float = float("inf"), max_cost: float = float("inf"), weights: tuple[float, float, float] = (1.0, 0.0, 0.0), score: str = "dot") -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to pieces (see ``pieces``); a sequence's pieces lie gapless from 0."""
    spark = items.sparkSession
    parts = 4096
    written = stored(items.withColumn("order_", F.monotonically_increasing_id()))
    light = written.select("length", "order_", F.pmod(F.xxhash64("order_"), F.lit(parts)).alias("part_"))
    counts = {row["length"]: row["count"] for row in light.groupBy("length").count().collect()}  # one row per length
    limits = (float(capacity), float(max_docs if max_docs != float("inf") else capacity), float(max_cost if max_cost != float("inf") else capacity**2))
    rows, bins, given = [], 0, dict.fromkeys(counts, 0)
    for pattern, times in fill(counts, limits, weights, score):
        place = 0
        for length, k in pattern:
            rows.append((length, given[length], given[length] + k * times, k, bins, place))
            given[length] += k * times
            place += k * length
        bins += times
    if not rows:
        return written.drop("order_").withColumn("sequence_id", F.lit(None).cast("bigint")).withColumn("offset", F.lit(None).cast("bigint"))
    # the runs of each length, as arrays: at most `capacity` rows
    runs = spark.createDataFrame(rows, "length bigint, low bigint, high bigint, k bigint, bin bigint, place bigint")
    runs = runs.groupBy("length").agg(F.sort_array(F.collect_list(F.struct("low", "high", "k", "bin", "place"))).alias("runs"))
    placed = _numbered(light, "length").join(F.broadcast(runs), "length")
    run = F.filter("runs", lambda r: (F.col("rank_") >= r["low"]) & (F.col("rank_") < r["high"]))[0]
    placed = placed.select("order_", "length", "rank_", run.alias("r"))
    nth = F.col("rank_") - F.col("r.low")
    spots = placed.select(
        "order_",
        (F.col("r.bin") + F.floor(nth / F.col("r.k"))).cast("bigint").alias("sequence_id"),
        (F.col("r.place") + F.pmod(nth, F.col("r.k")) * F.col("length")).cast("bigint").alias("offset"),
    )
    return written.join(spots, "order_").drop("order_")
