"""Whitening against numpy, and its eigenvectors on matrices with equal and zero eigenvalues."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from strataflow.llm import whitening
from strataflow.session import table

VECTORS = "vec_id long, embedding array<float>, n string"


@pytest.mark.parametrize("d", [1, 2, 3, 40])
def test_eigenpairs_of_random_matrices(d):
    x = np.random.default_rng(d).standard_normal((200, d)) * np.linspace(1, 3, d)
    v = np.cov(x.T, bias=True).reshape(d, d)
    values, axes = whitening.leading_eigenpairs(v, 16)
    assert np.allclose(values, np.linalg.eigvalsh(v)[::-1][:16], rtol=1e-12)
    assert np.abs(v @ axes - axes * values).max() < 1e-12 and np.abs(axes.T @ axes - np.eye(len(values))).max() < 1e-12


@pytest.mark.parametrize(
    "v",
    [np.eye(20), np.zeros((5, 5)), np.diag([3.0, 3, 3, 1, 1, 0, 0]), np.ones((8, 8)), np.kron(np.eye(6), [[2.0, 1], [1, 2]]), np.diag(np.ones(21), 1) + np.diag(np.ones(21), -1) + np.diag(np.abs(np.arange(-10.0, 12)))],
    ids=["identity", "zero", "groups", "rank one", "pairs", "nearly equal pairs"],
)
def test_eigenpairs_of_clusters(v):
    values, axes = whitening.leading_eigenpairs(v, 16)
    assert np.allclose(values, np.linalg.eigvalsh(v)[::-1][:16], atol=1e-12)
    assert np.abs(v @ axes - axes * values).max() < 1e-12 and np.abs(axes.T @ axes - np.eye(len(values))).max() < 1e-12


def test_sturm_counts():
    diag, off = np.array([2.0, 2, 2]), np.array([1.0, 1])
    values = np.linalg.eigvalsh(np.diag(diag) + np.diag(off, 1) + np.diag(off, -1))
    assert whitening.count_below(diag, off, np.array([0.0, 1, 2.0001, 3, 5])).tolist() == [(values < x).sum() for x in (0, 1, 2.0001, 3, 5)]


def test_pack_keeps_levels():
    m = np.array([[0, -32768], [32767, 5], [-32769, 0], [1 << 40, -(1 << 40)], [0, 0]])
    import pyarrow as pa

    got = [tuple(r) for part in whitening.unpack(pa.array(whitening.pack(m), pa.binary()), 2) for r in part.tolist()]
    assert sorted(got) == sorted(map(tuple, m.tolist()))


def brute(rows, d, k=16):
    kept = []
    for i, v in rows:
        if v is not None and len(v) == d and all(c is not None and np.isfinite(c) for c in v):
            kept.append((i, tuple(int(np.floor(64 * float(np.float32(c)))) + 1_000_000 for c in v)))
    fit = sorted({x for _, x in kept})
    n, sums = len(fit), [sum(x[j] for x in fit) for j in range(d)]
    y = np.array([[n * a - s for a, s in zip(x, sums, strict=True)] for x in fit], float) / n
    v = y.T @ y / n
    values, axes = np.linalg.eigh(v)
    values, axes = values[::-1][:k], axes[:, ::-1][:, :k]
    axes, values = axes[:, values > 1e-9 * values[0]], values[values > 1e-9 * values[0]]
    out = []
    for i, x in kept:
        c = np.array([n * a - s for a, s in zip(x, sums, strict=True)], float) / n
        out.append((i, n, sum((n * a - s) ** 2 for a, s in zip(x, sums, strict=True)), (c @ axes) / np.sqrt(values), values / np.trace(v)))
    return out


def compare(got, want):
    by = {}
    for r in got:
        by.setdefault((r.vec_id, r.deviation), {}).setdefault(r.component, []).append(r)
    signs = None
    assert sum(len(c) for g in by.values() for c in g.values()) == sum(len(w[3]) for w in want)
    for i, n, deviation, white, explained in want:
        own = by[i, deviation]
        assert sorted(own) == list(range(1, len(white) + 1))
        mine = np.array([own[c][0].whitened for c in sorted(own)])
        if signs is None and (np.abs(white) > 1e-3).all():
            signs = np.sign(white * mine)
        assert all(own[c][0].n == n and own[c][0].identity_error < 1e-9 for c in own)
        assert np.allclose([own[c][0].explained for c in sorted(own)], explained, rtol=1e-9)
        assert np.allclose(np.abs(mine), np.abs(white), atol=1e-8)
        if signs is not None:
            assert np.allclose(mine * signs, white, atol=1e-8)


def test_query_equals_numpy(spark, sf_dir):
    rows = [(r.vec_id, r.embedding) for r in table(spark, sf_dir, "embeddings").collect()]
    from strataflow.llm.queries import QUERIES

    got = QUERIES["op11_spectral_whitening"](spark, sf_dir)
    assert got.dtypes == [("vec_id", "bigint"), ("component", "int"), ("n", "bigint"), ("deviation", "bigint"), ("whitened", "double"), ("explained", "double"), ("identity_error", "double")]
    compare(got.collect(), brute(rows, 64))


def test_odd_rows(spark):
    rng = np.random.default_rng(4)
    rows = [(i, rng.standard_normal(3).astype("f4").tolist(), "x") for i in range(60)]
    rows += [(None, [0.5, 0.5, 0.5], "x"), (100, None, "x"), (101, [1.0, None, 0.0], "x"), (102, [1.0, float("nan"), 0.0], "x"), (103, [float("inf"), 0.0, 0.0], "x"), (104, [1.0, 2.0], "x"), (105, [], "x"), (106, [3e38, 0.0, 0.0], "x")]
    rows += [(7, rows[7][1], None)] + [(200 + i, [9.0, -9.0, 9.0], "x") for i in range(40)]
    frame = spark.createDataFrame(rows, VECTORS).withColumn("component", F.lit("clash"))
    want = brute([(i, v) for i, v, _ in rows if i != 106], 3)
    got = whitening.whiten(frame).collect()
    compare(got, want)
    assert {r.vec_id for r in got} == {w[0] for w in want} and len(got) == 3 * (60 + 1 + 1 + 40)
    # the same however the rows are dealt
    other = {(r.vec_id, r.component, r.deviation, round(abs(r.whitened), 9)) for r in whitening.whiten(frame.repartition(7)).collect()}
    assert other == {(r.vec_id, r.component, r.deviation, round(abs(r.whitened), 9)) for r in got}


def test_nothing_to_fit(spark):
    frame = lambda rows: spark.createDataFrame(rows, VECTORS)
    for rows in ([], [(1, None, "x")], [(1, [], "x")], [(1, [float("nan")], "x")], [(1, [1.0, 2.0], "x"), (2, [1.0, 2.0], "x")]):
        got = whitening.whiten(frame(rows))
        assert got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"] and got.count() == 0
    # two distinct vectors span one component
    got = whitening.whiten(frame([(1, [1.0, 2.0], "x"), (2, [2.0, 2.0], "x"), (3, [2.0, 2.0], "x")])).collect()
    assert sorted((r.vec_id, r.component, r.n, abs(r.whitened), r.explained) for r in got) == [(1, 1, 2, 1.0, 1.0), (2, 1, 2, 1.0, 1.0), (3, 1, 2, 1.0, 1.0)]


def test_deviations_are_exact_or_null():
    w = whitening.Whitening(10**7, [10**7 * 5 + 3, 10**7 * -7 - 2])
    m = np.array([[6, -7], [1 << 20, 4], [1 << 40, 0]])
    want = [sum((10**7 * int(a) - s) ** 2 for a, s in zip(r, [10**7 * 5 + 3, 10**7 * -7 - 2], strict=True)) for r in m]
    assert w.deviations(m) == [x if x < 1 << 63 else None for x in want] and want[2] >= 1 << 63


def test_wide_doubles(spark):
    rows = [(i, [float(i % 3), i * 1000.0], "x") for i in range(9)]
    frame = spark.createDataFrame(rows, "vec_id int, embedding array<double>, n string")
    compare(whitening.whiten(frame).collect(), brute([(i, v) for i, v, _ in rows], 2))
