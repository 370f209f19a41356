"""Privacy: exact copies and the distance of each synthetic record to its closest real one.

The nearest-record search is exact without comparing every pair. References form a tree of balls,
kept as tables, with leaves of bounded size; a query opens the balls that the triangle inequality
cannot rule out. Queries and leaves meet in blocks of bounded size, so no task depends on how
crowded one region is. Copies collapse to one vector first.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cellwise.functions.expr import many
from cellwise.operators.cells import typed_view
from cellwise.operators.features import encode_features, scale_by_train_range
from cellwise.operators.splitting import subsample_cap, subsample_equal
from cellwise.session import materialize

FAN = 32  # balls that a node is split into
LEAF_ROWS = 1024  # vectors in a leaf at most
BLOCK_ROWS = 1024  # queries compared with the balls of a node, or with a leaf, at once
DENSE_CELLS = 1 << 22  # cells of a matrix
DRAWN_ROWS = 1 << 16  # rows of the projection matrix that a task keeps


def record_hash(records: DataFrame) -> DataFrame:
    """SHA-256 of the canonical JSON text (members sorted by name)."""
    return records.withColumn("hash", F.sha2(F.to_json("v").cast("binary"), 256))


def exact_matches(records: DataFrame, train="train", test="test", synth="synth") -> DataFrame:
    """Synthetic rows (duplicates counted) whose whole record occurs in train, in test,
    and in train but not in test. One aggregation by hash; a hot hash is one row."""
    per_hash = record_hash(records).groupBy("hash").agg(
        F.count_if(F.col("split") == synth).alias("n"),
        F.bool_or(F.col("split") == train).alias("in_train"),
        F.bool_or(F.col("split") == test).alias("in_test"),
    )
    total = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0)).cast("bigint")
    return per_hash.agg(
        total(F.col("in_train")).alias("exact_matches_train"),
        total(F.col("in_test")).alias("exact_matches_test"),
        total(F.col("in_train") & ~F.col("in_test")).alias("exact_matches_train_only"),
    )


def sparse_vectors(features: DataFrame) -> DataFrame:
    """One row per record: sorted feature ids (60 bits of the name's md5) and values (zeros left out), with a content key."""
    number = F.conv(F.substring(F.md5(F.col("name").cast("binary")), 1, 15), 16, 10).cast("bigint")
    entry = F.when(F.col("value") != 0, F.struct(number.alias("i"), "value"))
    grouped = features.groupBy("rid", "split").agg(F.sort_array(F.collect_list(entry)).alias("e"))
    packed = grouped.select(
        "rid",
        "split",
        F.transform("e", lambda t: t["i"]).alias("idx"),
        F.transform("e", lambda t: t["value"]).alias("val"),
    )
    return packed.withColumn("vec", F.md5(F.to_json(F.struct("idx", "val")).cast("binary")))


# -- blocks of sparse rows, inside tasks -----------------------------------------------


@dataclass
class Sparse:
    """Rows in compressed form: the ids and values of row i lie from ``ends[i]`` to ``ends[i + 1]``."""

    ends: np.ndarray
    ids: np.ndarray
    values: np.ndarray

    @classmethod
    def of(cls, idx: pa.ListArray, val: pa.ListArray) -> Sparse:
        ends = idx.offsets.to_numpy()
        return cls(ends - ends[0], idx.flatten().to_numpy(zero_copy_only=False), val.flatten().to_numpy(zero_copy_only=False))

    def __len__(self) -> int:
        return len(self.ends) - 1

    def rows(self, low: int, high: int) -> Sparse:
        a, b = self.ends[low], self.ends[high]
        return Sparse(self.ends[low : high + 1] - a, self.ids[a:b], self.values[a:b])

    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self)), np.diff(self.ends))

    def dense(self, ids: np.ndarray) -> np.ndarray:
        """A matrix over the sorted ``ids``; others are ignored."""
        out = np.zeros((len(self), len(ids)))
        if len(ids) and len(self.ids):
            at = np.minimum(np.searchsorted(ids, self.ids), len(ids) - 1)
            known = ids[at] == self.ids
            out[self.owner()[known], at[known]] = self.values[known]
        return out

    def squares(self) -> np.ndarray:
        return np.bincount(self.owner(), self.values * self.values, len(self))


def _parts(a: Sparse, b: Sparse) -> Iterator[tuple[slice, slice, np.ndarray, np.ndarray]]:
    """Both sides as matrices over common ids, in parts of bounded size."""
    ids = np.unique(np.concatenate([a.ids, b.ids]))
    step = max(1, DENSE_CELLS // max(1, len(ids)))
    for i in range(0, len(a), step):
        left = a.rows(i, min(i + step, len(a))).dense(ids)
        for j in range(0, len(b), step):
            yield slice(i, i + len(left)), slice(j, min(j + step, len(b))), left, b.rows(j, min(j + step, len(b))).dense(ids)


def distances(a: Sparse, b: Sparse) -> np.ndarray:
    """Euclidean distances between two blocks: |a|^2 + |b|^2 - 2ab, floored at zero."""
    out = np.empty((len(a), len(b)))
    left, right = a.squares(), b.squares()
    for i, j, x, y in _parts(a, b):
        out[i, j] = left[i, None] + right[None, j] - 2.0 * (x @ y.T)
    return np.sqrt(np.maximum(out, 0.0))


def nearest(a: Sparse, b: Sparse) -> np.ndarray:
    """Distance of each row of ``a`` to its closest row of ``b``, taken again by direct differences, so that
    equal rows give exactly zero."""
    best = np.full(len(a), np.inf)
    right = b.squares()
    for i, j, x, y in _parts(a, b):
        winner = (right[None, j] - 2.0 * (x @ y.T)).argmin(axis=1)
        best[i] = np.minimum(best[i], np.sqrt(((x - y[winner]) ** 2).sum(axis=1)))
    return best


# -- random projection ------------------------------------------------------------------


def drawn_row(seed: int, feature: int, n_components: int, density: float) -> tuple[np.ndarray, np.ndarray]:
    """Components and signs of one feature: the gaps between its components are geometric numbers from
    md5 hashes of seed, feature and place, so any task draws the same row."""
    at, out, signs, k = -1, [], [], 0
    while True:
        digest = hashlib.md5(f"{seed}.{feature}:{k}".encode()).hexdigest()
        at += int(math.log(1.0 - int(digest[:13], 16) / 2.0**52) / math.log(1.0 - density)) + 1
        if at >= n_components:
            return np.array(out, np.int64), np.array(signs, float)
        out.append(at)
        signs.append(1.0 if int(digest[13], 16) >= 8 else -1.0)
        k += 1


def random_projection(vectors: DataFrame, n_features: int, n_components: int, seed: int = 42) -> DataFrame:
    """Sparse random projection of the vectors to ``n_components`` dimensions.

    A feature has each component with probability 1 / sqrt(``n_features``), with a random sign. Batches of rows are
    multiplied with the rows drawn for their features as two compressed matrices. With no more features than
    components the vectors are returned unchanged."""
    if n_components >= n_features:
        return vectors
    density = 1.0 / math.sqrt(n_features)
    scale = math.sqrt(1.0 / density) / math.sqrt(n_components)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drawn: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            if len(drawn) > DRAWN_ROWS:
                drawn.clear()
            block = Sparse.of(batch.column("idx"), batch.column("val"))
            features, which = np.unique(block.ids, return_inverse=True)
            for f in features.tolist():
                if f not in drawn:
                    drawn[f] = drawn_row(seed, f, n_components, density)
            rows = [drawn[f] for f in features.tolist()]
            sizes = np.array([len(c) for c, _ in rows], np.int64)
            columns, signs = (np.concatenate(x) if rows else np.zeros(0, t) for x, t in zip(zip(*rows, strict=True) if rows else ((), ()), (np.int64, float), strict=True))
            starts = np.cumsum(sizes) - sizes
            each = sizes[which]  # every entry meets the components of its feature
            entry = np.repeat(np.arange(len(which)), each)
            place = np.arange(int(each.sum())) - np.repeat(np.cumsum(each) - each, each) + starts[which][entry]
            key, at = np.unique(block.owner()[entry] * n_components + columns[place], return_inverse=True)
            total = np.bincount(at, block.values[entry] * signs[place], len(key)) * scale
            key, total = key[total != 0], total[total != 0]
            row, column = np.divmod(key, n_components)
            offsets = pa.array(np.searchsorted(row, np.arange(len(block) + 1)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (column, total)]
            yield pa.RecordBatch.from_arrays([batch.column("rid"), batch.column("split"), *lists, batch.column("vec")], names=["rid", "split", "idx", "val", "vec"])

    return vectors.select("rid", "split", "idx", "val", "vec").mapInArrow(project, "rid bigint, split string, idx array<bigint>, val array<double>, vec string")


# -- exact nearest-record search ------------------------------------------------------

BLOCK = "idxs array<array<bigint>>, vals array<array<double>>"


def _blocks(rows: DataFrame, keys: Sequence[str], block_rows: int, extra: Sequence[str] = ()) -> DataFrame:
    """Rows of each key in blocks of about ``block_rows``: lists ``vecs``, ``idxs``, ``vals`` and the extra columns'."""
    sizes = rows.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / block_rows).alias("parts"))
    dealt = rows.join(sizes, list(keys)).withColumn("part", F.pmod(F.xxhash64("vec"), F.col("parts")))
    item = F.struct(F.col("vec"), F.col("idx"), F.col("val"), *extra)
    held = dealt.groupBy(*keys, "part").agg(F.collect_list(item).alias("b"))
    return held.select(*keys, *[F.col(f"b.{c}").alias(f"{c}s") for c in ("vec", "idx", "val", *extra)])


def _sparse(row: dict, prefix: str = "") -> Sparse:
    return Sparse.of(row[prefix + "idxs"].values, row[prefix + "vals"].values)


def _each(df: DataFrame, make, schema: str) -> DataFrame:
    """One output batch per row of ``df``; ``make`` sees the row's Arrow scalars."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                yield make({c: batch.column(c)[i] for c in batch.schema.names})

    return df.mapInArrow(emit, schema)


def ball_tree(refs: DataFrame, fan: int, leaf_rows: int) -> tuple[list[DataFrame], DataFrame]:
    """Balls by level (side, node, child, idx, val, inner, outer) and the leaves' rows (side, node, vec, idx, val).

    A node of more than ``leaf_rows`` vectors is split around ``fan`` of them, those of the lowest content keys. A child
    holds the vectors nearest to its pivot; ``inner`` and ``outer`` are their least and largest distance from it. Vectors are
    distinct, so every split leaves smaller nodes. Only row counts reach the driver."""
    rows = materialize(refs.select("side", F.lit(1).cast("bigint").alias("node"), "vec", "idx", "val"))
    levels, leaves = [], None
    while True:
        sizes = rows.groupBy("side", "node").agg(F.count(F.lit(1)).alias("n"))
        full = materialize(sizes.where(F.col("n") > leaf_rows).select("side", "node"))
        small = rows.join(full, ["side", "node"], "left_anti")
        leaves = small if leaves is None else leaves.unionByName(small)
        if full.isEmpty():
            return levels, materialize(leaves)
        rows = materialize(rows.join(full, ["side", "node"], "left_semi"))
        order = Window.partitionBy("side", "node").orderBy("vec")
        ranked = rows.withColumn("r", F.row_number().over(order)).where(F.col("r") <= fan)
        item = F.struct("r", "idx", "val")
        pivots = ranked.groupBy("side", "node").agg(F.array_sort(F.collect_list(item)).alias("p"))
        pivots = materialize(pivots.select("side", "node", F.col("p.idx").alias("p_idxs"), F.col("p.val").alias("p_vals")))
        work = _blocks(rows, ["side", "node"], BLOCK_ROWS).join(pivots, ["side", "node"])

        def place(row: dict) -> pa.RecordBatch:
            d = distances(_sparse(row), _sparse(row, "p_"))
            near = d.argmin(axis=1)
            n = len(d)
            fixed = [pa.repeat(row["side"], n), pa.repeat(row["node"], n), pa.array(near.astype(np.int32)), pa.array(d[np.arange(n), near])]
            return pa.RecordBatch.from_arrays([*fixed, row["vecs"].values, row["idxs"].values, row["vals"].values], names=["side", "node", "child", "radius", "vec", "idx", "val"])

        placed = materialize(_each(work, place, "side string, node bigint, child int, radius double, vec string, idx array<bigint>, val array<double>"))
        rings = placed.groupBy("side", "node", "child").agg(F.min("radius").alias("inner"), F.max("radius").alias("outer"))
        centres = ranked.select("side", "node", (F.col("r") - 1).alias("child"), "idx", "val")
        levels.append(materialize(rings.join(centres, ["side", "node", "child"])))
        rows = placed.select("side", (F.col("node") * fan + F.col("child")).alias("node"), "vec", "idx", "val")


OPENED = "side string, node bigint, vec string, best double, bound double"
VECTOR = "idx array<bigint>, val array<double>"


def _opened(asked: DataFrame, level: DataFrame, fan: int, nearest_only: bool, with_vectors: bool = True) -> DataFrame:
    """Children of the nodes that queries stand at: the nearest one, or all that may hold something closer than ``best``.

    ``with_vectors`` repeats the query's vector for each of them."""
    ball = F.struct("child", "inner", "outer", "idx", "val")
    nodes = level.groupBy("side", "node").agg(F.array_sort(F.collect_list(ball)).alias("b"))
    nodes = nodes.select("side", "node", *[F.col(f"b.{c}").alias(n) for c, n in (("child", "children"), ("inner", "inners"), ("outer", "outers"), ("idx", "p_idxs"), ("val", "p_vals"))])
    work = _blocks(asked, ["side", "node"], BLOCK_ROWS, ["best"]).join(nodes, ["side", "node"])

    def open_(row: dict) -> pa.RecordBatch:
        d = distances(_sparse(row), _sparse(row, "p_"))
        inner, outer, best = (row[c].values.to_numpy() for c in ("inners", "outers", "bests"))
        bound = np.maximum(np.maximum(d - outer, inner - d), 0.0)
        if nearest_only:
            chosen = np.zeros(d.shape, bool)
            chosen[np.arange(len(d)), d.argmin(axis=1)] = True
        else:
            chosen = bound < best[:, None] + 1e-9 * (1.0 + d)  # room for the rounding of the distances
        q, c = np.nonzero(chosen)
        node = row["node"].as_py() * fan + row["children"].values.to_numpy()[c]
        pick = pa.array(q)
        columns = [pa.repeat(row["side"], len(q)), pa.array(node.astype(np.int64)), row["vecs"].values.take(pick), pa.array(best[q]), pa.array(bound[q, c])]
        names = ["side", "node", "vec", "best", "bound"]
        if with_vectors:
            columns, names = columns + [row[x].values.take(pick) for x in ("idxs", "vals")], [*names, "idx", "val"]
        return pa.RecordBatch.from_arrays(columns, names=names)

    return _each(work, open_, f"{OPENED}, {VECTOR}" if with_vectors else OPENED)


def _search(asked: DataFrame, leaves: DataFrame, leaf_rows: int) -> DataFrame:
    """(side, vec, distance): the closest reference in the leaves that queries were sent to."""
    held = leaves.groupBy("side", "node").agg(F.collect_list(F.struct("idx", "val")).alias("b"))
    held = held.select("side", "node", F.col("b.idx").alias("p_idxs"), F.col("b.val").alias("p_vals"))
    work = _blocks(asked.select("side", "node", "vec", "idx", "val"), ["side", "node"], BLOCK_ROWS).join(held, ["side", "node"])

    def closest(row: dict) -> pa.RecordBatch:
        best = nearest(_sparse(row), _sparse(row, "p_"))
        return pa.RecordBatch.from_arrays([pa.repeat(row["side"], len(best)), row["vecs"].values, pa.array(best)], names=["side", "vec", "distance"])

    found = _each(work, closest, "side string, vec string, distance double")
    return found.groupBy("side", "vec").agg(F.min("distance").alias("distance"))


def nearest_distances(vectors: DataFrame, synth: str = "synth", fan: int = FAN, leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """Distance of every distinct synthetic vector to the closest vector of each other split: (side, vec, distance).

    Every query first goes down to the leaf of its nearest balls, which gives it a bound. From the root, it then opens
    the balls that may hold something closer, and visits the leaves left open in the order of their bounds, a few
    more in each round, while the bound falls. Leaves that are only open are kept without the query's vector, which joins
    again when a leaf is visited: far more are opened than visited."""
    refs = materialize(
        vectors.filter(F.col("split") != synth).groupBy(F.col("split").alias("side"), "vec").agg(F.first("idx").alias("idx"), F.first("val").alias("val"))
    )
    if refs.isEmpty():
        raise ValueError("no reference records")
    sides = refs.agg(F.collect_set("side")).scalar()
    levels, leaves = ball_tree(refs, fan, leaf_rows)
    queries = vectors.filter(F.col("split") == synth).groupBy("vec").agg(F.first("idx").alias("idx"), F.first("val").alias("val"))
    start = materialize(queries.select(F.explode(sides).alias("side"), F.lit(1).cast("bigint").alias("node"), "vec", "idx", "val", F.lit(float("inf")).alias("best"), F.lit(0.0).alias("bound")))
    at, ends = start, None
    for level in levels:  # a query that has come to a leaf finds no balls there, and stays behind
        here = level.select("side", "node").distinct()
        stay = at.join(here, ["side", "node"], "left_anti")
        ends = stay if ends is None else ends.unionByName(stay)
        at = materialize(_opened(at, level, fan, True))
    first = at if ends is None else ends.unionByName(at)
    best = materialize(_search(first, leaves, leaf_rows))
    if not levels:
        return best
    known = best.join(first.select("side", "vec", F.col("node").alias("seen")), ["side", "vec"])  # each went down to one leaf
    bounded = start.drop("best").join(best.withColumnRenamed("distance", "best"), ["side", "vec"]).where("best > 0")
    at, open_ = materialize(bounded.select(*start.columns)), None
    slim = ["side", "vec", "node", "bound"]
    for i, level in enumerate(levels):
        here = level.select("side", "node").distinct()
        stay = at.join(here, ["side", "node"], "left_anti").select(*slim)
        open_ = stay if open_ is None else open_.unionByName(stay)
        at = materialize(_opened(at, level, fan, False, with_vectors=i + 1 < len(levels)))
    open_ = open_.unionByName(at.select(*slim))
    asked = start.select("side", "vec", "idx", "val")
    visits = 4
    order = Window.partitionBy("side", "vec").orderBy("bound", "node")  # the open leaves of one query
    while True:
        alive = open_.join(known, ["side", "vec"]).where((F.col("bound") < F.col("distance") * (1 + 1e-9) + 1e-9) & (F.col("node") != F.col("seen"))).select(*slim)
        ranked = materialize(alive.withColumn("r", F.row_number().over(order)))
        if ranked.isEmpty():
            return best
        more = _search(ranked.where(F.col("r") <= visits).join(many(asked), ["side", "vec"]), leaves, leaf_rows)
        best = materialize(best.unionByName(more).groupBy("side", "vec").agg(F.min("distance").alias("distance")))
        known = best.withColumn("seen", F.lit(0))  # the rows left have not been visited
        open_ = ranked.where(F.col("r") > visits).drop("r")
        visits *= 2


def dcr_distances(vectors: DataFrame, synth="synth", train="train", test="test", **options) -> DataFrame:
    """Per synthetic record: distance to the closest training and to the closest test record."""
    found = nearest_distances(vectors, synth, **options)
    per_vector = found.groupBy("vec").agg(
        F.max(F.when(F.col("side") == train, F.col("distance"))).alias("d_train"),
        F.max(F.when(F.col("side") == test, F.col("distance"))).alias("d_test"),
    )
    return vectors.filter(F.col("split") == synth).select("rid", "vec").join(per_vector, "vec").select(
        "rid", "d_train", "d_test"
    )


def dcr_score(distances: DataFrame) -> DataFrame:
    """Percentage of synthetic records strictly closer to train than to test."""
    return distances.agg(
        (F.avg((F.col("d_train") < F.col("d_test")).cast("double")) * F.lit(100.0)).alias("dcr_score")
    )


def privacy_score(dcr):
    """1 minus twice the excess of the share over one half; a share up to one half scores 1."""
    return F.lit(1.0) - F.lit(2.0) * F.greatest(dcr / F.lit(100.0) - F.lit(0.5), F.lit(0.0))


def privacy_vectors(cells: DataFrame, records: DataFrame, n_components: int = 40000, seed: int = 42) -> DataFrame:
    """Scaled feature vectors of the three splits, projected when there are more than
    ``n_components`` features."""
    keys = ("rid", "split")
    typed = typed_view(cells, keys)
    features = materialize(scale_by_train_range(materialize(encode_features(typed, records, keys=keys))))
    n_features = features.select("name").distinct().count()
    return random_projection(sparse_vectors(features), n_features, n_components, seed)


def privacy_metrics(
    records: DataFrame,
    make_cells,
    n_components: int = 40000,
    max_synth_rows: int | None = None,
    seed: int = 42,
    **options,
) -> DataFrame:
    """One row: privacy score, DCR score, exact matches and reference size.

    ``make_cells`` flattens a record frame; copies are sought in the full training split,
    distances against a training sample as large as the test split."""
    if max_synth_rows is not None:
        synth = subsample_cap(records.filter("split = 'synth'"), max_synth_rows, seed)
        records = records.filter("split <> 'synth'").unionByName(synth)
    copies = exact_matches(records)
    fair = materialize(subsample_equal(records, seed=seed))
    vectors = materialize(privacy_vectors(make_cells(fair), fair, n_components, seed))
    scored = dcr_score(dcr_distances(vectors, **options))
    size = records.agg(F.count_if(F.col("split") == "test").alias("ref_size"))
    return (
        copies.withColumn("dcr_score", scored.scalar())
        .withColumn("ref_size", size.scalar())
        .withColumn("privacy_score", privacy_score(F.col("dcr_score")))
    )
