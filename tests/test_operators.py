"""Operators against brute force and on edges."""

import heapq
import json
import math
import random
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer
from urllib.parse import parse_qs, urlparse

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strataflow import config
from strataflow.functions import geometry
from strataflow.operators import kriging, metrics, models, quality_control, raster, resample, spatial, tiles
from strataflow.operators.components import connected_components
from strataflow.sources import flight_lines, paged_layer, record_sheets, tables


def points(spark, n, seed=0, span=1000.0):
    rng = random.Random(seed)
    return spark.createDataFrame([(i, rng.uniform(-span, span), rng.uniform(-span, span), rng.random()) for i in range(n)] + [(n, 0.0, 0.0, 0.1), (n + 1, 0.0, 0.0, 0.2), (n + 2, None, 1.0, 0.3)], "code long, x double, y double, z double")


def test_radius_pairs_and_nearest_equal_brute_force(spark):
    p = points(spark, 150)
    rows = [r for r in p.collect() if r.x is not None]
    d = lambda a, b: math.sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2)
    want = {(a.code, b.code) for a in rows for b in rows if a.code < b.code and d(a, b) <= 120}
    got = spatial.radius_pairs(p, 120.0).collect()
    assert len(got) == len(want) and {(r.a, r.b) for r in got} == want
    near = {(r.a, r["rank"]): r.b for r in spatial.nearest(p, p, 4, exclude_self=True).collect()}
    for a in rows:
        order = sorted((b for b in rows if b.code != a.code), key=lambda b: (d(a, b), b.code))
        assert [near[(a.code, k)] for k in (1, 2, 3, 4)] == [b.code for b in order[:4]]
    assert spatial.nearest(p.where("false"), p, 2).count() == 0 and spatial.nearest(p, p.where("false"), 2).count() == 0


def test_nearest_of_far_targets_in_clusters(spark):
    rng = random.Random(8)
    right = [(i, rng.gauss(c, 3), rng.gauss(-c, 3), i % 3) for i, c in enumerate([0, 0, 0, 500, 500, 9000] * 60)] + [(1000 + i, 42.0, 42.0, i % 2) for i in range(40)]
    left = [(5000 + i, rng.uniform(-20000, 20000), rng.uniform(-20000, 20000), i % 3) for i in range(60)] + [(5100, 42.0, 42.0, 0), (5101, 41.0, 42.0, 1), (5102, None, 1.0, 1)]
    schema = "code long, x double, y double, fold int"
    r, t = spark.createDataFrame(right, schema), spark.createDataFrame(left, schema)
    dist = lambda a, b: math.sqrt((a[1] - b[1]) ** 2 + (a[2] - b[2]) ** 2)
    for k, most, differ in ((5, None, None), (2, None, "fold"), (3, 9000.0, None), (500, None, None)):
        got = {}
        for x in spatial.nearest(t, r, k, carry=("fold",), most=most, differ=differ).collect():
            got.setdefault(x.a, []).append((x["rank"], x.b))
        for a in left[:-1]:
            order = sorted((dist(a, b), b[0]) for b in right if not differ or a[3] != b[3])
            assert [b for _, b in sorted(got.get(a[0], []))] == [b for d, b in order[:k] if most is None or d <= most]


def test_components_of_chains_stars_and_rings(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(40)] + [(1000, i) for i in range(1001, 1060)] + [(rng.randint(2000, 2080), rng.randint(2000, 2080)) for _ in range(60)] + [(None, 3), (5, 5)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {}

    def root(i):
        while parent.setdefault(i, i) != i:
            i = parent[i]
        return i

    for a, b in edges:
        if a is not None and a != b:
            u, v = root(a), root(b)
            parent[max(u, v)] = min(u, v)
    assert got == {i: root(i) for i in parent}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_auc_is_symmetric_and_weighted(spark):
    rng = random.Random(1)
    rows = [(rng.randint(0, 1), float(rng.randint(0, 30)), float(rng.randint(1, 3))) for _ in range(400)]
    df = spark.createDataFrame(rows, "y int, s double, w double")
    one = metrics.auc(df, "y", "s", "w").first()["auc"]
    assert one == pytest.approx(1 - metrics.auc(df.withColumn("s", -F.col("s")), "y", "s", "w").first()["auc"])
    num = sum(a[2] * b[2] * ((a[1] > b[1]) + 0.5 * (a[1] == b[1])) for a in rows for b in rows if a[0] == 1 and b[0] == 0)
    assert one == pytest.approx(num / (sum(r[2] for r in rows if r[0]) * sum(r[2] for r in rows if not r[0])))
    assert metrics.auc(df.where("y = 1"), "y", "s").first()["auc"] is None


def test_azimuth_families(spark):
    bounds = [("A", 20.0, 70.0), ("B", 70.0, 110.0), ("C", 110.0, 160.0), ("D", 160.0, 20.0)]
    az = [0.0, 19.999, 20.0, 69.999, 70.0, 110.0, 159.999, 160.0, 179.999]
    got = [r[0] for r in spark.createDataFrame([(a,) for a in az], "a double").select(geometry.family(F.col("a"), bounds)).collect()]
    assert got == ["D", "D", "A", "A", "B", "C", "C", "D", "D"]


def test_projection_round_trip(spark):
    df = spark.createDataFrame([(-45.0, -20.0), (-47.9, -15.1), (-42.1, -23.4), (-45.0, 0.0)], "lon double, lat double")
    e, n = geometry.utm_forward(F.col("lon"), F.col("lat"))
    rows = df.select("*", e.alias("e"), n.alias("n")).select("*", *[c.alias(k) for c, k in zip(geometry.utm_inverse(F.col("e"), F.col("n")), ("lon2", "lat2"), strict=True)]).collect()
    for r in rows:
        assert r.lon2 == pytest.approx(r.lon, abs=1e-9) and r.lat2 == pytest.approx(r.lat, abs=1e-9)
    assert rows[0].e == pytest.approx(500000.0) and rows[3].n == pytest.approx(10_000_000.0)


@given(st.lists(st.floats(0, 100), min_size=9, max_size=60))
def test_flood_levels(values):
    side = int(len(values) ** 0.5)
    v = np.array(values[: side * side]).reshape(side, side)
    level = np.full(v.shape, np.inf)
    level[[0, -1], :] = v[[0, -1], :]
    level[:, [0, -1]] = v[:, [0, -1]]
    out = tiles.flood(v, level, 1e-4)
    assert (out >= v).all() and np.isfinite(out).all()
    for i in range(1, side - 1):
        for j in range(1, side - 1):
            around = min(out[p, q] for p in (i - 1, i, i + 1) for q in (j - 1, j, j + 1) if (p, q) != (i, j))
            assert out[i, j] > v[i, j] - 1e-12 and (out[i, j] == v[i, j] or out[i, j] >= around + 1e-4 - 1e-9)


def brute_fill(v, eps):
    out = {}
    heap = [(z, k) for k, z in v.items() if sum((k[0] + i, k[1] + j) in v for i in (-1, 0, 1) for j in (-1, 0, 1)) < 9]
    heapq.heapify(heap)
    for z, k in heap:
        out[k] = z
    while heap:
        z, (i, j) = heapq.heappop(heap)
        for k in [(i + a, j + b) for a in (-1, 0, 1) for b in (-1, 0, 1)]:
            if k in v and k not in out:
                out[k] = max(v[k], z + eps)
                heapq.heappush(heap, (out[k], k))
    return out


def test_depressions_fill_alike_over_tiles(spark):
    rng = random.Random(8)
    v = {(r, c): rng.uniform(0, 50) for r in range(20) for c in range(23)}
    grid = spark.createDataFrame([(r, c, z) for (r, c), z in v.items()], "r int, c int, v double")
    want = brute_fill(v, 1e-4)
    for size, keep in ((128, 16), (7, 16), (5, 2)):
        got = {(r.r, r.c): r.filled for r in tiles.fill_depressions(grid, size=size, keep=keep).collect()}
        assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)


def test_only_tiles_beside_fallen_levels_flood_again(spark, monkeypatch):
    """A channel winds through walls: each round after the first floods the next tile on its way alone."""
    v = {(r, c): 90.0 for r in range(12) for c in range(12)} | {(5, c): 1.0 for c in range(1, 12)}
    grid = spark.createDataFrame([(r, c, z) for (r, c), z in v.items()], "r int, c int, v double")
    sizes, cut_ = [], tiles.cut
    monkeypatch.setattr(tiles, "cut", lambda d: (lambda out: (sizes.append((out.columns, out.count())), out)[1])(cut_(d)))
    got = {(r.r, r.c): r.filled for r in tiles.fill_depressions(grid, size=4).collect()}
    want = brute_fill(v, 1e-4)
    assert all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)
    flooded = [n for columns, n in sizes if columns == ["tr", "tc"]]
    assert flooded[-1] == 0 and max(flooded) <= 9 and sum(flooded) < 9 * len(flooded)


def test_null_levels_stay_apart(spark):
    grid = spark.createDataFrame([(r, c, None if (r, c) in ((0, 0), (2, 2)) else 5.0) for r in range(5) for c in range(5)], "r int, c int, v double")
    got = {(r.r, r.c): r.filled for r in tiles.fill_depressions(grid, size=3).collect()}
    assert len(got) == 25 and got[0, 0] is None and all(5 <= got[k] < 5.001 for k in got if k not in ((0, 0), (2, 2)))


def test_flow_and_drainage(spark):
    grid = spark.createDataFrame([(0, c, float(10 - c)) for c in range(10)], "r int, c int, v double")
    d = raster.d8(grid, 1.0)
    acc = {r.c: r.acc for r in raster.flow_accumulation(d).collect()}
    assert acc == {c: c + 1 for c in range(10)}
    hand = {r.c: r.hand for r in raster.height_above_drainage(d, grid.where("c = 6")).collect()}
    assert [hand[c] for c in (0, 5, 6)] == [6.0, 1.0, 0.0] and hand[9] == 0.0 and hand[7] == 2.0


def test_vertical_derivative_of_the_whole_raster(spark):
    rng = np.random.default_rng(3)
    v = rng.normal(0, 1, (300, 37)).cumsum(axis=0) + 50
    holes, absent = rng.random(v.shape) < 0.05, rng.random(v.shape) < 0.05
    absent[17] = True  # a whole row
    absent[0, 0] = absent[-1, -1] = False
    rows = [(r - 5, c + 2, None if holes[r, c] else float(v[r, c])) for r in range(300) for c in range(37) if not absent[r, c]]
    held = np.where(holes | absent, np.median([x for _, _, x in rows if x is not None]), v)
    k = 2 * np.pi * np.hypot(np.fft.fftfreq(300, 2.0)[:, None], np.fft.fftfreq(37, 2.0)[None, :])
    want = np.fft.ifft2(np.fft.fft2(held) * k).real
    got = tiles.vertical_derivative(spark.createDataFrame(rows, "r int, c int, v double").repartition(5), 2.0).collect()
    assert len(got) == len(rows) and all(abs(x.value - want[x.r + 5, x.c - 2]) < 1e-9 for x in got)
    assert tiles.vertical_derivative(spark.createDataFrame([], "r int, c int, v double"), 1.0).count() == 0


@pytest.mark.parametrize("size", [3, 6, 17])
def test_windows_are_mirrored_at_the_edges(spark, size):
    v = np.random.default_rng(size).normal(0, 1, (7, 4))
    padded = np.pad(v, [(size // 2, size - size // 2 - 1)] * 2, mode="symmetric")
    want = np.lib.stride_tricks.sliding_window_view(padded, (size, size)).mean(axis=(2, 3))
    grid = spark.createDataFrame([(r + 3, c - 1, float(v[r, c])) for r in range(7) for c in range(4)], "r int, c int, v double")
    got = raster.box_stats(grid, size).collect()
    assert len(got) == 28 and all(abs(x.s1 / x.n - want[x.r - 3, x.c + 1]) < 1e-9 and x.n == size * size for x in got)


def test_kriging_is_exact_at_points(spark):
    p = points(spark, 60, 2).where("x is not null and code < 60")
    got = {r.code: r.estimate for r in kriging.ordinary_kriging(p, "z", p.select("code", "x", "y"), (0, 200, 400, 800), k=6).collect()}
    assert all(got[r.code] == pytest.approx(r.z, abs=1e-5) for r in p.collect())


def test_folds_follow_the_seed_not_the_order(spark):
    p = points(spark, 80).where("x is not null")
    a = {r.code: r.fold for r in models.spatial_folds(p, 300.0, 4, 5).collect()}
    assert a == {r.code: r.fold for r in models.spatial_folds(p.orderBy(F.desc("code")), 300.0, 4, 5).collect()}
    assert a != {r.code: r.fold for r in models.spatial_folds(p, 300.0, 4, 6).collect()}


def test_poisson_weights(spark):
    w = resample.weights(spark.range(300).withColumnRenamed("id", "u"), "u", 50)
    assert w.agg(F.sum("w")).first()[0] / (300 * 50) == pytest.approx(1.0, abs=0.05)


def test_upsert_and_losers(spark):
    old = spark.createDataFrame([(1, "a", 5.0), (2, "b", None)], "k int, keep string, v double")
    new = spark.createDataFrame([(2, "x", 7.0), (3, "y", 8.0), (1, "z", None)], "k int, keep string, v double")
    got = sorted(tuple(r) for r in quality_control.upsert(old, new, "k", ["v"], ["keep"]).select("k", "keep", "v").collect())
    assert got == [(1, "a", 5.0), (2, "b", 7.0), (3, "y", 8.0)]
    groups = spark.createDataFrame([(1, 1), (2, 1), (3, 1)], "code long, component long")
    scores = spark.createDataFrame([(1, 4), (2, 9), (3, 9)], "code long, score int")
    assert sorted(r.code for r in quality_control.losers(groups, scores).collect()) == [1, 2]


def test_record_sheet():
    html = '<div class="subsection-header">General</div><table><tr><td class="label-cell">Code</td><td class="data-cell">77</td></tr></table><div class="subsection-header">Screens</div><table><tr><td class="data-cell">1,5</td><td class="data-cell">3.0</td><td class="data-cell">steel</td></tr><tr><td class="data-cell">x</td><td class="data-cell">y</td></tr></table>'
    got = record_sheets.parse_sheet(html)
    assert got["code"] == "77" and got["intervals"] == {"Screens": [{"top": 1.5, "base": 3.0, "label": "steel"}]}
    assert record_sheets.parse_sheet(None)["code"] is None


def test_flight_files(spark, tmp_path):
    (tmp_path / "a.xyz").write_text("/ head\n L 1 -46.0 -20.0 5\n\nshort\n L 2 * * * 500000 7789000\n L 3 -46.5 -20.5 7.5 1 2\n L 4 10 10 1 1 1\n")
    got = flight_lines.read_files(spark, str(tmp_path), flight_lines.Layout(lon=2, lat=3, channels={"m": 4}), flight_lines.Box(-50, -25, -40, -15)).collect()
    assert sorted((r.lon, r.m) for r in got) == [(-46.5, 7.5), (-46.0, 5.0)]
    back = flight_lines.read_files(spark, str(tmp_path), flight_lines.Layout(lon=2, lat=3, channels={"m": 4}, x=5, y=6), flight_lines.Box(-50, -25, -40, -15)).collect()
    assert any(r.m is None and r.lon == pytest.approx(-45.0) for r in back)


def test_rasters_reports_and_old_files(spark, tmp_path):
    grid = spark.createDataFrame([(0, 0, 1.5), (0, 1, -9999.0)], "r int, c int, v double")
    tables.write_raster(grid, str(tmp_path / "g"), {"epsg": 31983, "res": 60})
    cells, meta = tables.read_raster(spark, str(tmp_path / "g"))
    assert meta["epsg"] == 31983 and sorted((r.c, r.v) for r in cells.collect()) == [(0, 1.5), (1, None)]
    assert tables.with_columns_of(grid.drop("v"), grid.schema).columns == ["r", "c", "v"]
    assert tables.first_column(grid, ["x", "v", "r"]) == "v"
    tables.write_csv(grid, str(tmp_path / "c"))
    assert spark.read.option("sep", ";").option("header", True).csv(str(tmp_path / "c")).count() == 2
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "1.html").write_bytes("é".encode("latin-1") * 1200)
    (tmp_path / "p" / "2.html").write_bytes(b"short")
    assert [r.html[:1] for r in record_sheets.read_pages(spark, str(tmp_path / "p")).collect()] == ["é"]


def test_paged_layer(spark):
    class Layer(BaseHTTPRequestHandler):
        failed, asked = False, []

        def do_GET(self):
            q = {k: v[0] for k, v in parse_qs(urlparse(self.path).query).items()}
            Layer.asked.append(q)
            if "returnIdsOnly" in q:
                body = {"objectIds": list(range(25)) + ([99] if "99" in q.get("geometry", "") else [])}
            elif not Layer.failed:
                Layer.failed, body = True, {"error": "busy"}
            else:
                ids = [int(i) for i in q["objectIds"].split(",") if i != "99"][:7]  # never more than seven at a time, and none for 99
                body = {"features": [{"attributes": {"OBJECTID": i}, "geometry": {"x": -45.0, "y": float(i)}} for i in ids]}
            self.send_response(200)
            self.end_headers()
            self.wfile.write(json.dumps(body).encode())

        def log_message(self, *a):
            pass

    server = HTTPServer(("127.0.0.1", 0), Layer)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        spark.dataSource.register(paged_layer.PagedLayer)
        df = spark.read.format("paged_layer").option("url", f"http://127.0.0.1:{server.server_port}/q").option("batch", 10).option("pause", 0.01).option("bbox", "-50,-25,-40,-15").load()
        assert df.rdd.getNumPartitions() == 3
        assert sorted(r.lat for r in df.collect()) == [float(i) for i in range(25)]
        first = next(q for q in Layer.asked if "returnIdsOnly" in q)
        assert json.loads(first["geometry"]) == {"xmin": -50.0, "ymin": -25.0, "xmax": -40.0, "ymax": -15.0, "spatialReference": {"wkid": 4326}}
        assert first["geometryType"] == "esriGeometryEnvelope" and first["inSR"] == "4326" and first["spatialRel"] == "esriSpatialRelIntersects"
        assert all(q["outSR"] == "4326" and q["returnGeometry"] == "true" for q in Layer.asked if "objectIds" in q)
        short = spark.read.format("paged_layer").option("url", f"http://127.0.0.1:{server.server_port}/q").option("pause", 0.01).option("bbox", "0,0,99,99").load()
        with pytest.raises(Exception, match="no feature for 1 of 26 ids"):
            short.collect()
    finally:
        server.shutdown()


def test_lines_are_numbered_across_blocks(spark, tmp_path):
    want = {}
    for name, n in (("a.xyz", 3000), ("b.xyz", 1), ("c.xyz", 0)):
        text = [f"{name} {k} " + "x" * (k % 40) for k in range(n)]
        (tmp_path / name).write_text("".join(x + "\n" for x in text))
        want |= {(name, k): x for k, x in enumerate(text)}
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "9000")
    try:
        got = flight_lines.read_lines(spark, str(tmp_path))
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 1
        assert {(r.file_no.rsplit("/", 1)[1], r.line_no): r.value for r in got.collect()} == want
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    n = flight_lines.numbered(spark.range(1000).selectExpr("id % 3 as f", "id * 7 as place"), "f", "place", span=100).collect()
    by = {}
    for r in sorted(n, key=lambda r: r.place):
        by.setdefault(r.f, []).append(r.n)
    assert all(v == list(range(1, len(v) + 1)) for v in by.values())


def test_quantiles_equal_numpy(spark):
    rng = np.random.default_rng(4)
    rows = [(int(k), None if x > 0.97 else float(round(v, 1))) for k, x, v in zip(rng.integers(0, 3, 500), rng.random(500), rng.normal(0, 3, 500), strict=True)] + [(9, 4.0), (8, None)]
    frame = spark.createDataFrame(rows, "k int, v double")
    at, names = [0.0, 0.02, 0.25, 0.5, 0.9, 1.0], list("abcdef")
    values = np.array([v for _, v in rows if v is not None])
    got = metrics.quantiles(frame, "v", at, names).first()
    assert np.allclose([got[n] for n in names], np.quantile(values, at))
    for r in metrics.quantiles(frame, "v", at, names, ("k",), parts=5).collect():
        assert np.allclose([r[n] for n in names], np.quantile([v for k, v in rows if k == r.k and v is not None], at))
    assert {r.k: r.n for r in metrics.median(frame, "v", ("k",)).collect()}[8] == 0
    assert metrics.quantiles(frame.where("false"), "v", [0.5], ["m"]).first().m is None


def test_overlaps_equal_brute_force(spark):
    rng = random.Random(6)
    rows = [(c, i, float(a), None if rng.random() < 0.05 else float(a + rng.randint(1, 6))) for c in range(8) for i in range(rng.randint(0, 25)) for a in [rng.randint(0, 40)]]
    want = {}
    for c in range(8):
        own = [(a, b) for k, _, a, b in rows if k == c and b is not None]
        n = sum(own[i][0] < own[j][1] and own[j][0] < own[i][1] for i in range(len(own)) for j in range(i))
        if n:
            want[c] = n
    got = quality_control.overlapping(spark.createDataFrame(rows, "code int, rn int, top_m double, base_m double"))
    assert {r.code: r.n_overlaps for r in got.collect()} == want


def test_settings(spark, tmp_path):
    c = config.Config(box=(0.0, 0.0, 1.0, 1.0), ceiling_auc=0.67, domains=(("a", ("x", "y")),), relations={"a": (0.8, 1.1)})
    (tmp_path / "c.json").write_text(c.dump())
    assert config.Config.load(spark, str(tmp_path / "c.json")) == c
    assert config.resolve(None, "set", default="d") == "set" and config.resolve(None, None, default="d") == "d"
    assert config.predictors(["a_1", "b", "a_2"], ("a_",), ("a_2",)) == ["a_1"]
    with pytest.raises(ValueError):
        config.predictors(["a_1"], ("a_",), ("a_9",))
    assert config.provenance(spark, [("dem", "tiles", 30.0, "2024-01-01")]).count() == 1
