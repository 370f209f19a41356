"""Incremental eigendecomposition and whitening against dense linear algebra."""

import math

import numpy as np
import pytest
from cellwise.llm import whitening
from cellwise.llm.queries import op11_whitening

SCHEMA = "vec_id bigint, embedding array<float>, component int, n string, part int"


@pytest.mark.parametrize("kind", ["plain", "repeated", "zero", "sparse", "spread", "along"])
def test_rank_one(kind):
    rng = np.random.default_rng(5)
    d = 12
    values = np.sort(rng.random(d))
    vectors, _ = np.linalg.qr(rng.normal(size=(d, d)))
    v = rng.normal(size=d)
    if kind == "repeated":
        values[3:8] = values[3]
    if kind == "zero":
        values[:] = 0
    if kind == "sparse":
        v = vectors[:, [2, 7]] @ np.array([1.0, 1e-9])
    if kind == "spread":
        values = np.sort(10.0 ** rng.uniform(-12, 3, d))
    if kind == "along":
        v = 3 * vectors[:, -1]
    before = (vectors * values) @ vectors.T
    got, q = whitening.rank_one(values.copy(), vectors.copy(), v)
    want = np.linalg.eigvalsh(before + np.outer(v, v))
    scale = want[-1]
    assert np.all(np.diff(got) >= 0)
    assert np.allclose(got, want, rtol=0, atol=1e-13 * scale)
    assert np.allclose(q.T @ q, np.eye(d), atol=1e-12)
    assert np.allclose((q * got) @ q.T, before + np.outer(v, v), atol=1e-12 * scale)


def test_roots_interlace():
    rng = np.random.default_rng(6)
    for _ in range(40):
        k = rng.integers(1, 30)
        poles = np.cumsum(10.0 ** rng.uniform(-10, 2, k))
        weights = 10.0 ** rng.uniform(-12, 3, k)
        gap = whitening.secular_roots(poles, weights)
        for j in range(k):
            assert gap[j, j] < 0 and (j + 1 == k or gap[j + 1, j] > 0)
            parts = weights / gap[:, j]
            assert abs(1 + parts.sum()) <= 1e-10 * (1 + np.abs(parts).sum())


def test_chunks_and_merges_agree():
    rng = np.random.default_rng(7)
    rows = np.floor(1024 * rng.normal(size=(400, 10)) * np.linspace(0.1, 2, 10))
    want = np.cov(rows.T, bias=True) * len(rows)
    for cut in (1, 7, 64, 400):
        parts = []
        for a in range(0, 400, 100):
            s = whitening.Spectrum(10)
            for b in range(a, a + 100, cut):
                s.add(rows[b : min(b + cut, a + 100)])
            parts.append(s)
        first, *others = parts
        for other in others:
            first.merge(other)
        assert first.n == 400 and list(first.sums) == rows.astype(int).sum(0).tolist()
        assert np.allclose((first.vectors * first.values) @ first.vectors.T, want, rtol=0, atol=1e-10 * np.abs(want).max())


def brute(rows, components=8):
    vectors = [(i, v) for i, v in rows if v is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    x = np.array([[math.floor(1024 * float(np.float32(c))) + 100000 for c in v] for _, v in vectors], object)
    n, s = len(x), x.sum(0)
    dev = [int(sum((n * a - b) ** 2 for a, b in zip(r, s, strict=True))) for r in x]
    y = np.array([[float(a * n - b) / n for a, b in zip(r, s, strict=True)] for r in x])
    values, q = np.linalg.eigh(y.T @ y / n)
    values, q = values[::-1], q[:, ::-1]
    return [i for i, _ in vectors], n, dev, y, values, q


def check(rows, got, components=8):
    ids, n, dev, y, values, q = brute(rows)
    k = min(components, len(values))
    assert len(got) == n * k
    by = {}
    for r in got:
        assert r.n == n and r.identity_error <= 1e-9
        by.setdefault(r.component, {}).setdefault(r.vec_id, []).append(r)
    for c in range(1, k + 1):
        e = values[c - 1]
        want = y @ q[:, c - 1] / np.sqrt(e)
        expected = {}
        for i, d, w in zip(ids, dev, want, strict=True):
            expected.setdefault(i, []).append((d, w))
        sign = np.sign(sum(by[c][i][0].whitened * expected[i][0][1] for i in expected if len(expected[i]) == 1))
        for i, pairs in expected.items():
            mine = sorted((r.deviation, sign * r.whitened) for r in by[c][i])
            assert [d for d, _ in mine] == sorted(d for d, _ in pairs)
            assert np.allclose([w for _, w in mine], [w for _, w in sorted(pairs)], rtol=1e-7, atol=1e-9)
            assert all(abs(r.explained / (e / values.sum()) - 1) < 1e-9 for r in by[c][i])


def test_against_dense(spark):
    rng = np.random.default_rng(8)
    basis = rng.normal(size=(12, 12)) * np.geomspace(3, 0.05, 12)
    rows = [(i, (rng.normal(size=12) @ basis).tolist()) for i in range(500)]
    rows += [(900 + i, [1.0] * 12) for i in range(250)]  # a third of all rows are copies
    odd = [(1000, None), (1001, [None] + [0.0] * 11), (1002, [float("nan")] + [0.0] * 11), (1003, [float("inf")] * 12), (1004, [-float("inf")] * 12)]
    table = spark.createDataFrame([(i, v, 1, "x", 3) for i, v in [*rows, *odd, (None, [0.5] * 12)]], SCHEMA)
    got = whitening.whiten(table.repartition(37)).collect()
    check([*rows, *odd, (None, [0.5] * 12)], got)


def test_edges(spark):
    run = lambda rows: whitening.whiten(spark.createDataFrame([(i, v, 1, "x", 3) for i, v in rows], SCHEMA)).collect()
    assert run([]) == [] and run([(1, None)]) == [] and run([(1, [1.0, 2.0])]) == []
    assert run([(1, [1.0, 2.0])] * 5) == []
    flat = run([(i, [float(i), 7.0]) for i in range(5)])  # one dimension never changes
    assert {r.component for r in flat} == {1} and len(flat) == 5 and flat[0].explained == 1.0
    few = run([(i, [float(i % 3), float(i % 2)]) for i in range(12)] + [(99, [1.0])])
    assert {r.component for r in few} == {1, 2} and {r.n for r in few} == {12}


def test_deviation_beyond_small_integers():
    model = whitening.Whitener(10**6, [10**9, -(10**9)], np.eye(2), np.ones(2), 2.0)
    far = np.array([[1e6, -1e6], [3e12, 0.0]])
    assert model.deviations(far) == [2 * (10**12 - 10**9) ** 2 if 2 * (10**12 - 10**9) ** 2 < 1 << 63 else None, None]


def test_query(spark):
    at = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{at}/embeddings.parquet").select("vec_id", "embedding").collect()]
    check(rows, op11_whitening(spark, at).collect())
