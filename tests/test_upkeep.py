"""Replacing rows, examples of columns, marked CSV files, clipped water tables."""

import gc
import glob
import random

from pyspark.sql import functions as F

from strataflow import session
from strataflow.operators import kriging, quality_control, spatial
from strataflow.operators.components import connected_components
from strataflow.operators.quality_control import replace_where
from strataflow.sources import tables


def test_replace_where_keeps_other_and_null_rows(spark):
    old = spark.createDataFrame([(1, "a", 1.0), (2, "b", 2.0), (3, None, 3.0), (1, "a", 1.0)], "code int, method string, v double")
    new = spark.createDataFrame([(9, "a")], "code int, method string")
    got = sorted(map(tuple, replace_where(old, F.col("method") == "a", new).collect()), key=str)
    assert got == [(2, "b", 2.0), (3, None, 3.0), (9, "a", None)]
    assert replace_where(old, F.col("method") == "a", new.where("false")).count() == 2


def test_examples(spark):
    rows = [(None, "b", None)] * 4 + [(k % 2, t, None) for k, t in enumerate("dacab")]
    frame = spark.createDataFrame(rows, "h_one int, `h.two` string, h_none string").withColumn("other", F.lit(1))
    assert {r.name: r.examples for r in tables.examples(frame, "^h").collect()} == {"h_one": ["0", "1"], "h.two": ["a", "b", "c"], "h_none": []}
    assert tables.examples(frame, "^nothing").count() == 0


def test_csv_files_begin_with_a_mark(spark, tmp_path):
    frame = spark.createDataFrame([("é", 1), ("b", 2)], "name string, n int").coalesce(1)
    tables.write_csv(frame, str(tmp_path / "out"), bom=True)
    (file,) = glob.glob(str(tmp_path / "out" / "part-*.csv"))
    raw = open(file, "rb").read()
    assert raw.startswith(b"\xef\xbb\xbfname;n") and raw.decode("utf-8-sig").splitlines() == ["name;n", "é;1", "b;2"]


def test_kriged_depths_below_zero_are_held_and_counted(spark):
    points = spark.createDataFrame([(i, 100.0 * (i % 15), 100.0 * (i // 15), 0.0 if i % 15 < 7 else 60.0) for i in range(225)], "code long, x double, y double, s double")
    targets = spark.createDataFrame([(k, 35.0 * k, 640.0) for k in range(44)], "code long, x double, y double")
    ground = targets.select("code", F.lit(100.0).alias("v")).unionByName(spark.createDataFrame([(999, 50.0)], "code long, v double"))
    lags = (0, 150, 300, 500, 800)
    plain = {r.code: r.estimate for r in kriging.ordinary_kriging(points, "s", targets, lags).collect()}
    got = {r.code: r for r in kriging.water_table(points, "s", targets, ground, lags).collect()}
    low = [k for k, e in plain.items() if e < 0]
    assert low and {r.n_clipped for r in got.values()} == {len(low)} and got.keys() == plain.keys() | {999} and got[999].head is None
    for k, e in plain.items():
        assert got[k].clipped == (e < 0) and abs(got[k].head - (100 - max(e, 0.0))) < 1e-9


def test_checkpoints_collect_the_drivers_garbage(spark, monkeypatch):
    jvm = spark.sparkContext._jvm
    old = jvm.java.lang.Object()
    held = jvm.java.lang.ref.WeakReference(old)
    del old
    gc.collect()
    monkeypatch.setattr(session, "_collected", [-session.COLLECT_EVERY])
    monkeypatch.setattr(session.time, "monotonic", lambda: 1.0)
    for _ in range(50):  # the bridge lets go of a handle a moment later
        session._collected[0] = -session.COLLECT_EVERY
        session.cut(spark.range(1))
        if held.get() is None:
            break
    assert held.get() is None
    session._collected[0] = 1.0
    session.cut(spark.range(1))
    assert session._collected[0] == 1.0  # not again so soon


def test_duplicate_groups_follow_cells_not_pairs(spark, monkeypatch):
    rng = random.Random(6)
    rows = [(k, float(rng.randrange(0, 9000)), float(rng.randrange(0, 9000))) for k in rng.sample(range(10**6), 400)]
    rows += [(10**6 + k, 5000.0 + k % 3, 5000.0) for k in range(300)]  # 44,850 pairs in one cell
    rows += [(2 * 10**6 + k, -400.0 * k, -400.0) for k in range(12)]  # a chain whose links are as long as the radius
    rows += [(3 * 10**6, 20000.0, 0.0), (3 * 10**6 + 1, None, 0.0)]
    points = spark.createDataFrame(rows, "code long, x double, y double")
    pairs = spatial.radius_pairs(points, 400.0).select("a", "b").collect()
    root = {c: c for p in pairs for c in p}
    for _ in range(len(root)):
        before = dict(root)
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
        if root == before:
            break
    seen = []
    monkeypatch.setattr(quality_control, "connected_components", lambda links: (seen.append(links.count()), connected_components(links))[1])
    assert {r.code: r.component for r in quality_control.duplicate_groups(points, 400.0).collect()} == root
    assert seen[0] < 5 * 400 < len(pairs)
