"""Approximate nearest neighbours by an inverted multi-index.

The two halves of the vectors are quantised separately (k-means on a bounded sample); every
vector belongs to the cell of its pair of centroids. A query ranks the centroids of each half by inner
product and walks the pairs by their sum with a heap, best first, until the cells it has opened hold a
``share`` of all entries, whole cells at a time. For one left centroid the opened cells are the first
few in the query's order of right centroids, so the walk is handed on as one number per left centroid.
The entries of opened cells are ranked by their exact inner product. Equal vectors are one entry that stands for the smallest of their ids, as many as an
answer can need, so large groups of copies cost one entry and lose nothing.

Entries and the queries that open their cells meet in blocks of bounded size, as matrices. Cell sizes
(at most ``CENTROIDS`` squared numbers) and centroids are all that the driver holds. The share is large
because vectors that fill the space evenly leave little to prune at a recall of 0.9; clustered vectors
need less.

Edge cases: vectors that are null, zero, of another length than most, or hold a null or non-finite
component take no part; rows with a null id take none either; a row that repeats an id and a vector
counts once; a query with fewer candidates than ``k`` returns them all; ties go to the smaller id; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellwise.session import materialize

SAMPLE = 16_384
SHARE = 0.6
CENTROIDS = 128
BLOCK = 2_048
QUERIES = 256
SALTS = 256


def valid_vectors(table: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``id`` and ``vector`` (array<double>) of the rows that take part."""
    v = F.col("vector")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = table.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).cast("array<double>").alias("vector"))
    rows = rows.where(F.col("id").isNotNull() & v.isNotNull() & finite & F.exists(v, lambda x: x != 0))
    size = rows.groupBy(F.size(v).alias("size")).count().orderBy(F.desc("count"), "size").first()
    return rows.where(F.size(v) == (size["size"] if size else 0))


def _entries(rows: DataFrame, k: int) -> DataFrame:
    """One row per distinct vector: its smallest ``k`` + 1 ids; ``rep`` is the first."""
    few = lambda ids: F.slice(F.array_sort(F.array_distinct(ids)), 1, k + 1)
    salted = rows.groupBy("vector", F.pmod("id", F.lit(SALTS)).alias("salt")).agg(few(F.collect_list("id")).alias("ids"))
    return salted.groupBy("vector").agg(few(F.flatten(F.collect_list("ids"))).alias("ids")).select(F.col("ids")[0].alias("rep"), "ids", "vector")


def _quantise(half: np.ndarray, count: int, rounds: int = 12) -> np.ndarray:
    """K-means centroids of one half, started from rows spread over the sample."""
    centers = half[np.linspace(0, len(half) - 1, count).astype(int)].copy()
    for _ in range(rounds):
        near = np.argmin((centers**2).sum(1)[None, :] - 2 * half @ centers.T, axis=1)
        sums = np.zeros_like(centers)
        np.add.at(sums, near, half)
        sizes = np.bincount(near, minlength=count)
        full = sizes > 0
        centers[full] = sums[full] / sizes[full, None]
    return centers


class MultiIndex:
    """Centroids of both halves and the number of entries per cell."""

    def __init__(self, left: np.ndarray, right: np.ndarray):
        self.left, self.right = left, right
        self.sizes = np.zeros(len(left) * len(right), np.int64)
        self.listed: list[int] = []

    def cells(self, vectors: np.ndarray) -> np.ndarray:
        split = self.left.shape[1]
        a = np.argmin((self.left**2).sum(1)[None, :] - 2 * vectors[:, :split] @ self.left.T, axis=1)
        b = np.argmin((self.right**2).sum(1)[None, :] - 2 * vectors[:, split:] @ self.right.T, axis=1)
        return a * len(self.right) + b

    def walk(self, query: np.ndarray, enough: float) -> dict[int, int]:
        """Per left centroid, how many of the query's right centroids are opened before ``enough`` entries are found."""
        split = self.left.shape[1]
        one, two = -(self.left @ query[:split]), -(self.right @ query[split:])
        a, b = np.argsort(one, kind="stable").tolist(), np.argsort(two, kind="stable").tolist()
        one, two = one[a].tolist(), two[b].tolist()
        sizes, width = self.listed, len(b)
        heap, found, opened = [(one[0] + two[0], 0, 0)], 0, {}
        while heap and found < enough:
            _, i, j = heapq.heappop(heap)
            opened[a[i]] = j + 1
            found += sizes[a[i] * width + b[j]]
            if j + 1 < width:
                heapq.heappush(heap, (one[i] + two[j + 1], i, j + 1))
            if j == 0 and i + 1 < len(a):  # a row begins once the row before it has
                heapq.heappush(heap, (one[i + 1] + two[0], i + 1, 0))
        return opened

    def right_ranks(self, queries: np.ndarray) -> np.ndarray:
        """Place of each right centroid in each query's order."""
        split = self.left.shape[1]
        order = np.argsort(np.stack([-(self.right @ q[split:]) for q in queries]), axis=1, kind="stable")
        ranks = np.empty_like(order)
        np.put_along_axis(ranks, order, np.arange(order.shape[1])[None, :], 1)
        return ranks


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def search(table: DataFrame, queries: Column, k: int = 20, share: float = SHARE, centroids: int = CENTROIDS, sample: int = SAMPLE, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``query_id``, ``rank`` (from 1), ``vec_id`` and ``score`` for the rows whose ``id`` satisfies ``queries``.

    ``sample`` vectors (by a hash of their ids) fit the centroids; every vector is indexed.
    """
    spark = table.sparkSession
    rows = materialize(valid_vectors(table, id_col, vector_col))
    entries = materialize(_entries(rows, k))
    fitted = entries.orderBy(F.xxhash64("rep"), "rep").limit(sample).select("vector").collect()
    if not fitted:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    points = np.array([r["vector"] for r in fitted])
    width = points.shape[1]
    split = max(1, width // 2)
    total = entries.count()
    count = max(1, min(centroids, round(total**0.5)))
    index = MultiIndex(_quantise(points[:, :split], count), _quantise(points[:, split:], count) if width > split else np.zeros((1, 0)))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                left, right = np.divmod(index.cells(_matrix(batch.column("vector"), width)), len(index.right))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("rep"), batch.column("vector"), pa.array(left.astype(np.int32)), pa.array(right.astype(np.int32))], names=["rep", "vector", "left", "right"]
                )

    placed = materialize(entries.select("rep", "vector").mapInArrow(assign, "rep bigint, vector array<double>, left int, right int"))
    for r in placed.groupBy("left", "right").count().collect():  # at most centroids squared rows
        index.sizes[r["left"] * len(index.right) + r["right"]] = r["count"]
    index.listed = index.sizes.tolist()
    enough = max(share * total, 8 * (k + 1))  # small tables are opened whole

    def open_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            found = [index.walk(v, enough) for v in _matrix(batch.column("vector"), width)]
            pick = pa.array(np.repeat(np.arange(len(found)), [len(f) for f in found]))
            left = pa.array([c for f in found for c in f], pa.int32())
            depth = pa.array([d for f in found for d in f.values()], pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column("id").take(pick), batch.column("vector").take(pick), left, depth], names=["id", "vector", "left", "depth"])

    asking = materialize(rows.where(queries).groupBy("id").agg(F.min("vector").alias("vector")))
    packs = max(1, -(-asking.count() // QUERIES))
    opened = asking.repartition(F.col("id")).mapInArrow(open_cells, "id bigint, vector array<double>, left int, depth int")
    groups = opened.groupBy("left", F.pmod(F.xxhash64("id"), F.lit(packs)).alias("pack")).agg(
        F.collect_list("id").alias("ids"), F.collect_list("depth").alias("depths"), F.flatten(F.collect_list("vector")).alias("asked")
    )
    by_left = index.sizes.reshape(len(index.left), -1).sum(1)
    parts = spark.createDataFrame([(i, max(1, -(-int(n) // BLOCK))) for i, n in enumerate(by_left)], "left int, parts bigint")  # one row per left centroid
    dealt = placed.join(F.broadcast(parts), "left").withColumn("part", F.pmod(F.xxhash64("rep"), "parts"))
    blocks = dealt.groupBy("left", "part").agg(
        F.collect_list("rep").alias("reps"), F.collect_list("right").alias("rights"), F.flatten(F.collect_list("vector")).alias("matrix")
    )

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in zip(*(batch.column(c) for c in ("reps", "rights", "matrix", "ids", "depths", "asked")), strict=True):
                reps, rights, m, ids, depths, q = (x.values.to_numpy() for x in row)
                m, q = m.reshape(-1, width), q.reshape(-1, width)
                scores = np.where(index.right_ranks(q)[:, rights] < depths[:, None], q @ m.T, -np.inf)
                top = min(k + 1, len(reps))
                floor = np.partition(scores, len(reps) - top, axis=1)[:, len(reps) - top]
                # a tie at the cut is kept whole, and left to the final ranking
                near, which = np.nonzero((scores >= floor[:, None] - 1e-12) & (scores > -np.inf))
                exact = (q[near] * m[which]).sum(1)
                yield pa.RecordBatch.from_arrays([pa.array(ids[near]), pa.array(reps[which]), pa.array(exact)], names=["query_id", "rep", "score"])

    near = groups.join(blocks, "left").select("reps", "rights", "matrix", "ids", "depths", "asked").mapInArrow(rank, "query_id bigint, rep bigint, score double")
    order = Window.partitionBy("query_id")
    close = near.withColumn("place", F.row_number().over(order.orderBy(F.desc("score"), "rep"))).where(F.col("place") <= k + 1)
    named = close.join(entries.select("rep", "ids"), "rep").select("query_id", "score", F.explode("ids").alias("vec_id")).where("vec_id != query_id")
    ranked = named.withColumn("rank", F.row_number().over(order.orderBy(F.desc("score"), "vec_id"))).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
