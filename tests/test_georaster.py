"""Rasters in their place, snapshots, and a partitioned read from a database."""

import dataclasses

import numpy as np
import pytest
from pyspark.sql import functions as F

from strataflow.sources import georaster, tables
from strataflow.sources.georaster import DEGREES, METRES, Place, Raster


def raster(spark, a, place):
    rows = [(i, j, None if np.isnan(a[i, j]) else float(a[i, j])) for i in range(a.shape[0]) for j in range(a.shape[1])]
    return Raster(spark.createDataFrame(rows, "r int, c int, v double"), place)


def array(got):
    out = np.full((got.place.rows, got.place.cols), np.nan)
    for r in got.cells.collect():
        if r.v is not None:
            out[r.r, r.c] = r.v
    return out


def brute(a, place, to):
    out = np.full((to.rows, to.cols), np.nan)
    for i in range(to.rows):
        for j in range(to.cols):
            r = (to.y0 + (i + 0.5) * to.dy - place.y0) / place.dy - 0.5
            c = (to.x0 + (j + 0.5) * to.dx - place.x0) / place.dx - 0.5
            top = bottom = 0.0
            for p in (int(np.floor(r)), int(np.floor(r)) + 1):
                for q in (int(np.floor(c)), int(np.floor(c)) + 1):
                    if 0 <= p < place.rows and 0 <= q < place.cols and not np.isnan(a[p, q]):
                        w = (1 - abs(r - p)) * (1 - abs(c - q))
                        top, bottom = top + w * a[p, q], bottom + w
            p, q = int(np.floor(r + 0.5)), int(np.floor(c + 0.5))
            if 0 <= p < place.rows and 0 <= q < place.cols and not np.isnan(a[p, q]):
                out[i, j] = top / bottom
    return out


def test_align_equals_brute_force(spark):
    rng = np.random.default_rng(2)
    a = rng.normal(0, 10, (9, 7))
    a[2, 3] = a[8, 0] = np.nan
    place = Place(100.0, 900.0, 100.0, -100.0, 9, 7)
    for to in (Place(130.0, 870.0, 40.0, -40.0, 20, 18), Place(0.0, 0.0, 150.0, 150.0, 7, 6), place):
        got = georaster.align(raster(spark, a, place), to)
        assert got.place == to
        np.testing.assert_allclose(array(got), a if to == place else brute(a, place, to), rtol=1e-9)
    # the nearest cell's own values, where asked for
    whole = array(georaster.align(raster(spark, a, place), Place(110.0, 890.0, 100.0, -100.0, 9, 7), 0))
    np.testing.assert_array_equal(whole, a)


def test_zoom_equals_order_one(spark):
    a = np.add.outer(np.arange(4.0) * 10, np.arange(5.0))
    got = array(georaster.zoom(raster(spark, a, Place(0.0, 40.0, 10.0, -10.0, 4, 5)), 2.0))
    want = np.add.outer(np.linspace(0, 30, 8), np.linspace(0, 4, 10))
    np.testing.assert_allclose(got, want)


def test_systems(spark):
    metres = Place(500_000.0, 7_500_000.0, 2000.0, -2000.0, 6, 6)
    a = np.add.outer(np.arange(6.0), 3 * np.arange(6.0))
    lon, lat = spark.range(1).select(*georaster.utm_inverse(F.lit(506_000.0), F.lit(7_494_000.0))).first()
    one = Place(lon - 0.001, lat + 0.001, 0.002, -0.002, 1, 1, DEGREES)
    got = array(georaster.align(raster(spark, a, metres), one))
    # the middle of the raster, between four cells
    assert got[0, 0] == pytest.approx(2.5 + 3 * 2.5, abs=0.2)
    with pytest.raises(ValueError):
        georaster.between(F.lit(0), F.lit(0), METRES, 4326)


def test_two_folders_stacks_and_points(spark, tmp_path):
    fine, wide = Place(0.0, 0.0, 10.0, 10.0, 8, 8), Place(0.0, 0.0, 20.0, 20.0, 4, 4)
    a, b = np.arange(64.0).reshape(8, 8), np.arange(16.0).reshape(4, 4)
    a[0, 0] = np.nan
    raster(spark, a, fine).write(str(tmp_path / "one" / "a"), year="2024")
    raster(spark, b, wide).write(str(tmp_path / "two" / "b"))
    raster(spark, b, wide).write(str(tmp_path / "two" / "a"))
    folders = [str(tmp_path / "one"), str(tmp_path / "two")]
    got = {n: georaster.read(spark, folders, n) for n in ("a", "b")}
    assert (got["a"].place, got["b"].place) == (fine, wide)
    np.testing.assert_array_equal(array(got["a"]), a)
    with pytest.raises(FileNotFoundError):
        georaster.read(spark, folders, "c")
    stacked = georaster.stack(got, fine)
    assert stacked.columns == ["r", "c", "a", "b"] and stacked.count() == 64
    want = brute(b, wide, fine)
    assert all(r.b == pytest.approx(want[r.r, r.c]) and (r.a is None if np.isnan(a[r.r, r.c]) else r.a == a[r.r, r.c]) for r in stacked.collect())
    points = spark.createDataFrame([(1, 15.0, 25.0), (2, -5.0, 3.0), (3, 1.0, 1.0)], "code int, x double, y double")
    assert sorted(map(tuple, georaster.at_points(points, got).select("code", "a", "b").collect())) == [(1, a[2, 1], b[1, 0]), (2, None, None), (3, None, b[0, 0])]
    assert dataclasses.replace(fine, rows=1) != fine


def test_snapshots_never_change(spark, tmp_path):
    root = str(tmp_path / "s")
    tables.write_snapshot(spark.range(3), root, "2026-01-01")
    tables.write_snapshot(spark.range(5), root, "2026-03-01")
    with pytest.raises(FileExistsError):
        tables.write_snapshot(spark.range(9), root, "2026-03-01")
    with pytest.raises(ValueError):
        tables.write_snapshot(spark.range(9), root, "March")
    assert tables.read_snapshot(spark, root).count() == 5 and tables.read_snapshot(spark, root, "2026-01-01").count() == 3


def test_partitioned_read_from_a_database(spark, tmp_path):
    url = f"jdbc:derby:{tmp_path}/db;create=true"
    options = {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    rows = [(k, -50.0 + k / 100, -20.0 - k / 200, f"n{k}", None if k % 5 else k * 1.5) for k in range(400)]
    spark.createDataFrame(rows, "code int, lon double, lat double, name string, depth double").coalesce(1).write.format("jdbc").options(url=url, dbtable="wells", **options).save()
    box, columns = (-49.0, -21.5, -47.5, -20.0), {"id": "code", "x": "lon", "y": "lat", "d": "depth"}
    want = sorted((k, x, y, d) for k, x, y, _, d in rows if box[0] <= x <= box[2] and box[1] <= y <= box[3])
    got = tables.read_jdbc(spark, url, "wells", columns, box, by="code", parts=5, **options)
    assert sorted(map(tuple, got.collect())) == want and got.rdd.getNumPartitions() == 5
    plan = got._jdf.queryExecution().toString()
    assert "*LessThanOrEqual(lat,-20.0)" in plan and "ReadSchema: struct<code:int,lon:double,lat:double,depth:double>" in plan
    assert sorted(map(tuple, tables.read_jdbc(spark, url, "wells", columns, box, **options).collect())) == want
    for by in (None, "code"):
        with pytest.raises(ValueError):
            tables.read_jdbc(spark, url, "wells", columns, (0.0, 0.0, 1.0, 1.0), by=by, **options)
