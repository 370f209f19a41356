"""Embedding whitening by incremental eigendecomposition.

Entries are held as whole numbers, x = floor(1024 c) + 100000, so counts and sums are exact. Each
partition keeps the spectrum (eigenvalues and eigenvectors) of the scatter of its rows around their mean
and applies centred rank-one updates to it: the roots of the secular equation are the new eigenvalues,
vectors along which nothing changes are deflated, and equal eigenvalues are turned first so that one
vector of each group takes the whole update. The rows of a batch are rotated to at most as many rows as
there are dimensions before they are applied (an orthogonal transform of the rows, which leaves their
scatter as it is), and the shift of the mean is one more update, so a row costs a share of an update.

Spectra of partitions are combined in groups of ``FAN`` neighbours, round by round, by successive
rank-one updates: one per eigenvector of the other spectrum and one for the distance of the means.

Rounding of many updates is taken out by a final Rayleigh-Ritz refinement: every row is projected on
the vectors found, tasks add up the projected covariance, and its eigenvectors turn the basis into the
components, to double precision. All that the driver holds is a few matrices of the vectors' dimension.

Edge cases: rows whose vector is null, of another length than most, or holds a null or non-finite entry
(or one of 2**30 or more) take no part; rows with a null id and repeated rows count like any other; components of
no variance (all rows equal, one row, constant dimensions) are left out, so such a table gives no rows, as
does an empty one; a deviation beyond 64 bits is null; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from cellwise.llm.common import small_batches
from cellwise.session import materialize

SCALE, SHIFT = 1024, 100_000
COMPONENTS = 8
FAN = 32
EPS = np.finfo(float).eps
LIMIT = float(1 << 40)


# --- one update


def secular_roots(poles: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """``gap[i, j]`` = pole i minus root j of 1 + sum(weights / (poles - x)) = 0; poles rise, weights are positive.

    Root j lies between pole j and the next one (the last one below the sum of the weights further on). It is
    sought as a distance from the nearer pole, so that small gaps keep their digits: each step solves
    the equation with the poles of either side drawn together into one, and halves the interval instead
    if that leaves it."""
    k = len(poles)
    ends = np.r_[poles[1:], poles[-1] + weights.sum()]
    width = ends - poles
    middle = 1 + (weights[:, None] / (poles[:, None] - (poles + width / 2)[None, :])).sum(0)
    right = middle < 0
    right[-1] = False
    origin = np.where(right, ends, poles)
    offset = poles[:, None] - origin[None, :]
    low = np.where(right, -width / 2, np.where(middle < 0, width / 2, 0.0))
    high = np.where(right, 0.0, np.where(middle < 0, width, width / 2))
    low[-1], high[-1] = 0.0, width[-1]
    x = (low + high) / 2
    before = np.tri(k, dtype=bool).T  # pole i is left of root j
    own, nxt = np.arange(k), np.minimum(np.arange(k) + 1, k - 1)
    for _ in range(100):
        gap = offset - x
        with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
            part = weights[:, None] / gap
            slope = part / gap
            psi, dpsi = (part * before).sum(0), (slope * before).sum(0)
            phi, dphi = (part * ~before).sum(0), (slope * ~before).sum(0)
            f = 1 + psi + phi
            low = np.where(f < 0, x, low)
            high = np.where(f > 0, x, high)
            a, b = gap[own, own], gap[nxt, own]
            s, t = dpsi * a * a, dphi * b * b
            c = f - dpsi * a - dphi * b
            p = c * (a + b) + s + t
            q = a * b * f
            root = np.sqrt(np.maximum(p * p - 4 * q * c, 0))
            step = np.where(p <= 0, (p - root) / (2 * c), 2 * q / (p + root))
            step[-1] = a[-1] + s[-1] / c[-1]  # no pole beyond the last root
            new = x + step
        done = (np.abs(f) <= EPS * k * (1 + np.abs(psi) + np.abs(phi))) | (high - low <= 2 * EPS * np.maximum(np.abs(low), np.abs(high)))
        if done.all():
            break
        inside = (new > low) & (new < high) & np.isfinite(new)
        x = np.where(done, x, np.where(inside, new, (low + high) / 2))
    return offset - x


def rank_one(values: np.ndarray, vectors: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spectrum of the matrix plus ``v`` times its transpose; ``values`` rise."""
    z = vectors.T @ v
    total = z @ z
    if total == 0:
        return values, vectors
    tolerance = 8 * EPS * max(abs(values[-1]), total)
    heads = np.flatnonzero(np.r_[True, np.diff(values) > tolerance])
    for a, b in zip(heads.tolist(), [*heads[1:].tolist(), len(values)], strict=True):
        if b - a > 1 and (norm := np.linalg.norm(z[a:b])) > 0:  # equal values: a reflection leaves one vector with the whole of z
            w = z[a:b].copy()
            w[-1] += norm if w[-1] >= 0 else -norm
            vectors[:, a:b] -= np.outer(vectors[:, a:b] @ w, w * (2 / (w @ w)))
            z[a : b - 1], z[b - 1] = 0.0, -norm if z[b - 1] >= 0 else norm
    live = np.flatnonzero(z * z * total > tolerance * tolerance)
    live = live[np.r_[True, np.diff(values[live]) > 0]] if len(live) else live
    if not len(live):
        return values, vectors
    poles, weights = values[live], z[live] ** 2
    gap = secular_roots(poles, weights)
    k = len(live)
    ratio = gap / (poles[:, None] - poles[None, :] + np.eye(k))  # (pole i - root j) / (pole i - pole j)
    ratio[np.arange(k), np.arange(k)] = -gap[np.arange(k), np.arange(k)]
    exact = np.sqrt(np.abs(np.prod(ratio, axis=1))) * np.sign(z[live])  # the z whose update has just these roots: keeps vectors orthogonal
    turn = exact[:, None] / gap
    turn /= np.linalg.norm(turn, axis=0)
    values = values.copy()
    values[live] = poles - np.diag(gap)
    vectors[:, live] = vectors[:, live] @ turn
    order = np.argsort(values, kind="stable")
    return values[order], vectors[:, order]


class Spectrum:
    """Count, exact sums, mean and eigen-decomposed scatter of some rows."""

    def __init__(self, dim: int):
        self.n, self.sums = 0, np.zeros(dim, object)
        self.mean, self.values, self.vectors = np.zeros(dim), np.zeros(dim), np.eye(dim)

    def _update(self, v: np.ndarray) -> None:
        self.values, self.vectors = rank_one(self.values, self.vectors, v)

    def _move(self, n: int, mean: np.ndarray) -> None:
        """Take in the distance of the mean of ``n`` more rows."""
        apart = mean - self.mean
        if self.n:
            self._update(apart * np.sqrt(self.n * (n / (self.n + n))))
        self.mean = self.mean + apart * (n / (self.n + n))
        self.n += n

    def add(self, rows: np.ndarray) -> None:
        """Take in whole-number rows (less ``SHIFT``)."""
        mean = rows.mean(axis=0)
        centred = rows - mean
        for r in np.linalg.qr(centred, mode="r") if len(rows) > rows.shape[1] else centred:
            self._update(r)
        self.sums = self.sums + rows.astype(np.int64).sum(axis=0).astype(object)
        self._move(len(rows), mean)

    def merge(self, other: Spectrum) -> None:
        for value, vector in zip(other.values, other.vectors.T, strict=True):
            if value > 0:
                self._update(np.sqrt(value) * vector)
        self.sums = self.sums + other.sums
        self._move(other.n, other.mean)

    SCHEMA = "id int, n bigint, sums array<bigint>, mean array<double>, values array<double>, vectors array<double>"

    def row(self, number: int) -> pa.RecordBatch:
        lists = [pa.array([list(self.sums)], pa.list_(pa.int64()))] + [pa.array([x.ravel().tolist()], pa.list_(pa.float64())) for x in (self.mean, self.values, self.vectors)]
        return pa.RecordBatch.from_arrays([pa.array([number], pa.int32()), pa.array([self.n], pa.int64()), *lists], names=["id", "n", "sums", "mean", "values", "vectors"])

    @classmethod
    def of(cls, row: dict) -> Spectrum:
        dim = len(row["mean"])
        out = cls(dim)
        out.n, out.sums, out.mean, out.values = row["n"], np.array(row["sums"], object), np.array(row["mean"]), np.array(row["values"])
        out.vectors = np.array(row["vectors"]).reshape(dim, dim)
        return out


# --- Spark


def valid_rows(table: DataFrame, id_col: str, vector_col: str) -> tuple[DataFrame, int]:
    """``id`` and ``vector`` (array<double>) of the rows that take part, and the vectors' length."""
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < LIMIT / SCALE))
    rows = table.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("vector")).where(F.col("vector").isNotNull() & (F.size("vector") > 0) & finite)
    rows = materialize(rows)
    size = rows.groupBy(F.size("vector").alias("size")).count().orderBy(F.desc("count"), "size").first()
    return rows.where(F.size("vector") == (size["size"] if size else 0)), size["size"] if size else 0


def whole(batch: pa.RecordBatch, dim: int) -> np.ndarray:
    """The batch's vectors as whole numbers less ``SHIFT`` (exact in double precision)."""
    return np.floor(SCALE * batch.column("vector").flatten().to_numpy(zero_copy_only=False).reshape(-1, dim))


def partial_spectra(rows: DataFrame, dim: int) -> DataFrame:
    """One ``Spectrum`` row per partition."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, part = Spectrum(dim), 0
        for batch in batches:
            if batch.num_rows:
                part = batch.column("part")[0].as_py()
                found.add(whole(batch, dim))
        if found.n:
            yield found.row(part)

    return rows.select("vector", F.spark_partition_id().alias("part")).mapInArrow(emit, Spectrum.SCHEMA)


def combine(spectra: DataFrame, fan: int = FAN) -> Spectrum | None:
    """One spectrum of all, in rounds of ``fan`` neighbours."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                first, *others = [Spectrum.of(x) for x in row["spectra"]]
                for other in others:
                    first.merge(other)
                yield first.row(row["up"])

    spectra = materialize(spectra)
    while spectra.agg(F.max("id")).first()[0]:
        up = F.floor(F.col("id") / fan).cast("int").alias("up")
        groups = spectra.groupBy(up).agg(F.array_sort(F.collect_list(F.struct("id", "n", "sums", "mean", "values", "vectors"))).alias("spectra"))
        spectra = materialize(groups.mapInArrow(fold, Spectrum.SCHEMA))
    last = spectra.first()
    return Spectrum.of(last.asDict()) if last else None


def _summed(rows: DataFrame, width: int, measure) -> np.ndarray:
    """Sum over all rows of an array that ``measure`` makes of each batch; ``width`` entries reach the driver."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(width)
        for batch in batches:
            if batch.num_rows:
                held += measure(batch).ravel()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width, dtype=np.int32)), pa.array(held)], names=["at", "value"])

    out = np.zeros(width)
    for r in rows.select("vector").mapInArrow(emit, "at int, value double").groupBy("at").agg(F.sum("value").alias("value")).collect():
        out[r["at"]] = r["value"]
    return out


class Whitener:
    """Components of a fit list: ``centre`` (less ``SHIFT``), unit ``vectors`` as columns, their ``values`` and the ``trace``."""

    def __init__(self, n: int, sums: list[int], vectors: np.ndarray, values: np.ndarray, trace: float):
        self.n, self.sums, self.vectors, self.values, self.trace = n, sums, vectors, values, trace
        self.centre = np.array([float(Fraction(s, n)) for s in sums])

    def whiten(self, rows: np.ndarray) -> np.ndarray:
        return ((rows - self.centre) @ self.vectors) / np.sqrt(self.values)

    def deviations(self, rows: np.ndarray) -> list[int | None]:
        """Exact sums of (n x - S) squared; None beyond 64 bits."""
        most = self.n * (np.abs(rows).max() + max(map(abs, self.sums), default=0) / self.n + 1)
        kind = np.int64 if most * most * rows.shape[1] < 2.0**62 else object
        apart = self.n * rows.astype(np.int64).astype(kind) - np.array(self.sums, kind)
        return [int(s) if s < 1 << 63 else None for s in (apart * apart).sum(axis=1)]


def fit(rows: DataFrame, dim: int, components: int = COMPONENTS) -> Whitener | None:
    """Components of the covariance of all ``rows`` (see ``valid_rows``), the largest first."""
    start = combine(partial_spectra(rows, dim)) if dim else None
    if start is None:
        return None
    basis, _ = np.linalg.qr(start.vectors)
    sums = [int(s) for s in start.sums]
    centre = np.array([float(Fraction(s, start.n)) for s in sums])

    def projected(batch: pa.RecordBatch) -> np.ndarray:
        y = (whole(batch, dim) - centre) @ basis
        return y.T @ y

    ritz = _summed(rows, dim * dim, projected).reshape(dim, dim) / start.n
    values, turn = np.linalg.eigh((ritz + ritz.T) / 2)
    values, turn = values[::-1], turn[:, ::-1]
    trace = float(values.sum())
    kept = min(components, int((values > dim * EPS * values[0]).sum()) if values[0] > 0 else 0)
    vectors = basis @ turn[:, :kept]
    vectors *= np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(kept)])
    return Whitener(start.n, sums, vectors, values[:kept], trace)


def identity_error(rows: DataFrame, dim: int, model: Whitener) -> float:
    """Largest entry of the whitened rows' covariance minus the identity."""
    k = len(model.values)

    def moments(batch: pa.RecordBatch) -> np.ndarray:
        w = model.whiten(whole(batch, dim))
        return np.vstack([w.T @ w, w.sum(axis=0)])

    found = _summed(rows, (k + 1) * k, moments).reshape(k + 1, k) / model.n
    return float(np.abs(found[:k] - np.outer(found[k], found[k]) - np.eye(k)).max())


def whiten(table: DataFrame, components: int = COMPONENTS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Per row and component: ``vec_id``, ``component`` (from 1), ``n``, ``deviation``, ``whitened``, ``explained``, ``identity_error``."""
    small_batches(table.sparkSession)
    rows, dim = valid_rows(table, id_col, vector_col)
    schema = StructType([StructField("vec_id", table.schema[id_col].dataType), *StructType.fromDDL("component int, n bigint, deviation bigint, whitened double, explained double, identity_error double")])
    model = fit(rows, dim, components)
    k = len(model.values) if model else 0
    if not k:
        return table.sparkSession.createDataFrame([], schema)
    error = identity_error(rows, dim, model)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = whole(batch, dim)
                pick = pa.array(np.repeat(np.arange(len(x)), k))
                each = lambda v: pa.array(np.tile(v, len(x)))
                columns = [
                    batch.column("id").take(pick),
                    each(np.arange(1, k + 1, dtype=np.int32)),
                    each(np.full(k, model.n)),
                    pa.array(model.deviations(x), pa.int64()).take(pick),
                    pa.array(model.whiten(x).ravel()),
                    each(model.values / model.trace),
                    each(np.full(k, error)),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return rows.mapInArrow(emit, schema)
