"""Segments along edges: the same whatever the tiles, across gaps and thresholds."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from strataflow.operators import lineaments
from strataflow.operators.lineaments import Scale


def cells(spark, a, key=0):
    r, c = np.nonzero(np.isfinite(a) | True)
    rows = [(key, int(i), int(j), None if np.isnan(a[i, j]) else float(a[i, j])) for i, j in zip(r, c, strict=True)]
    return spark.createDataFrame(rows, "key int, r int, c int, v double")


def terrain(n=48):
    """A step along a slanted line through the middle, where four tiles of 24 meet, and a fainter one aside."""
    r, c = np.mgrid[:n, :n]
    return np.where(c > r * 0.5 + 12.3, 10.0, 0.0) + np.where(r > 40, 0.8, 0.0)


@pytest.mark.parametrize("size", [16, 24, 128])
def test_peaks_do_not_depend_on_tiles(spark, size):
    a = terrain() + np.random.default_rng(1).normal(0, 0.05, (48, 48))
    a[5, 7] = np.nan
    filled = np.where(np.isnan(a), np.nanmean(a), a)
    g, peak = lineaments.peak_cells(filled, 2.0)
    want = {(int(r), int(c)): g[r, c] for r, c in zip(*np.nonzero(peak), strict=True)}
    got = {(r.r, r.c): r.g for r in lineaments.gradient_peaks(cells(spark, a), 2.0, size).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(v, abs=1e-8) for k, v in want.items())


def test_a_line_over_four_tiles_comes_out_once(spark):
    found = {}
    for size in (24, 128):
        peaks = lineaments.gradient_peaks(cells(spark, terrain()), 1.5, size)
        mask = lineaments.hysteresis(peaks, F.lit(0.5), F.lit(1.0))
        found[size] = sorted(map(tuple, lineaments.extract(mask, [Scale(20, 2)]).collect()))
    assert found[24] == found[128] and len(found[24]) == 1
    _, r0, c0, r1, c1 = found[24][0]
    assert min(r0, r1) < 8 and max(r0, r1) > 38 and all(abs(c - (0.5 * r + 12.5)) < 2 for r, c in ((r0, c0), (r1, c1)))


def test_hysteresis_follows_weak_edges_any_distance(spark):
    chain = [(0, 5, k, 1.0) for k in range(100)] + [(0, 6, 100, 1.0), (0, 5, 101, 9.0)]  # one strong end
    lone = [(0, 20, k, 1.0) for k in range(100)] + [(1, 5, 50, 1.0), (0, 40, 40, 9.0), (0, 5, 110, 0.2)]
    peaks = spark.createDataFrame(chain + lone, "key int, r int, c int, g double")
    got = {tuple(r) for r in lineaments.hysteresis(peaks, F.lit(0.5), F.lit(5.0)).collect()}
    assert got == {x[:3] for x in chain} | {(0, 40, 40)}


def test_gaps_lengths_and_keys(spark):
    row = lambda key, r, cs: [(key, r, c) for c in cs]
    broken = [*range(0, 10), *range(12, 20)]  # a gap of two cells
    mask = spark.createDataFrame(row(0, 3, broken) + row(1, 3, broken) + row(0, 30, range(5)) + [(1, k + 40, k + 40) for k in range(12)], "key int, r int, c int")
    got = sorted(map(tuple, lineaments.segments(mask, [Scale(8, 2), Scale(6, 1)]).collect()))
    ends = [(k, *sorted([(r0, c0), (r1, c1)])) for k, r0, c0, r1, c1 in got]
    assert sorted(ends) == [(0, (3, 0), (3, 19)), (1, (3, 0), (3, 9)), (1, (3, 12), (3, 19)), (1, (40, 40), (51, 51))]


def test_cells_serve_one_segment(spark):
    cross = [(0, 20, c) for c in range(40)] + [(0, r, 20) for r in range(30) if r != 20]
    mask = spark.createDataFrame(cross, "key int, r int, c int")
    pieces = lineaments.segments(mask, [Scale(8, 2)]).collect()
    assert sum(max(abs(r.r1 - r.r0), abs(r.c1 - r.c0)) + 1 for r in pieces) <= len(cross) + 2
    # the cross's second bar is cut by the first and put together again
    got = lineaments.extract(mask, [Scale(8, 2)]).collect()
    assert sorted(abs(r.r1 - r.r0) + abs(r.c1 - r.c0) for r in got) == [29, 39]


def test_joined(spark):
    rows = [(0, 10, 0, 10, 20), (0, 10, 23, 11, 50), (0, 12, 53, 12, 60)]  # go on in each other
    rows += [(0, 14, 62, 40, 62), (0, 30, 0, 30, 20), (0, 32, 0, 32, 20), (1, 10, 23, 11, 50), (0, 80, 0, 80, 20), (0, 80, 30, 80, 50)]  # turn off, run beside, lie elsewhere or too far
    got = lineaments.joined(spark.createDataFrame(rows, "key int, r0 int, c0 int, r1 int, c1 int"), [Scale(8, 2), Scale(8, 2)])
    norm = lambda t: (t[0], *sorted([t[1:3], t[3:]]))
    assert sorted(norm(tuple(r)) for r in got.collect()) == sorted(norm(t) for t in [(0, 10, 0, 12, 60), *rows[3:]])


def test_frame_and_nothing(spark):
    grid = cells(spark, np.zeros((40, 50)))
    found = spark.createDataFrame([(0, 2, 5, 3, 40), (0, 2, 5, 30, 40), (0, 10, 47, 30, 48), (0, 15, 15, 20, 30)], "key int, r0 int, c0 int, r1 int, c1 int")
    assert sorted(tuple(r)[1:] for r in lineaments.inside_frame(found, grid, 5).collect()) == [(2, 5, 30, 40), (15, 15, 20, 30)]
    assert lineaments.gradient_peaks(grid).count() == 0
    empty = spark.createDataFrame([], "key int, r int, c int")
    assert lineaments.segments(empty, [Scale()]).columns == ["key", "r0", "c0", "r1", "c1"]
