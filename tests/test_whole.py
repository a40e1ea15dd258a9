"""Queries cover their whole tables and ranges."""

from pyspark.sql import functions as F

from strataflow.adapters import relation
from strataflow.operators.variogram import LAGS
from strataflow.plans import learning
from strataflow.plans.registry import QUERIES
from strataflow.sources import lines


def test_density_covers_the_raster(spark, sf_dir):
    got = QUERIES["lineament_density"](spark, sf_dir)
    assert got.select("r", "c").distinct().count() == got.count() == 400 * 400
    assert got.where("density > 0 and (r % 20 <> 0 or c % 20 <> 0)").count() > 0


def test_variograms_reach_16_km(spark, sf_dir):
    points = [(r.x, r.y) for r in relation(spark, sf_dir, "wells").select("x", "y").collect()]
    want = dict.fromkeys(LAGS[1:], 0)
    for i, (x, y) in enumerate(points):
        for u, v in points[:i]:
            d = ((x - u) ** 2 + (y - v) ** 2) ** 0.5
            lag = next((b for a, b in zip(LAGS, LAGS[1:], strict=False) if a < d <= b), None)
            if lag:
                want[lag] += 1
    want = {k: n for k, n in want.items() if n >= 100}
    assert max(want) == 16000
    for name in ("variogram", "variogram_detrended"):
        assert {r.lag: r.pairs for r in QUERIES[name](spark, sf_dir).collect()} == want
    got = QUERIES["variogram_directional"](spark, sf_dir).groupBy("lag").agg(F.sum("pairs").alias("n"))
    # of the four directions' bins only those with 100 pairs stay
    assert all(want[r.lag] - 4 * 99 <= r.n <= want[r.lag] for r in got.collect()) and got.where("lag = 16000").count() == 1


def test_lines_take_all_vertices(spark, sf_dir):
    w = relation(spark, sf_dir, "wells").withColumn("line", F.concat_ws("/", "domain", (F.col("code") % 7).cast("string")))
    by = {}
    for r in w.select("line", "code").collect():
        by.setdefault(r.line, []).append(r.code)
    everywhere = lines.segments_between(w, -1e6, 1e6, 100.0, 10**6, 10**6, span=16)
    assert sorted((r.line, r.i) for r in everywhere.collect()) == sorted((k, i) for k, c in by.items() for i in range(len(c) - 1))
    args = (10000.0, 60000.0, 100.0, 400, 400)
    assert sorted(map(tuple, lines.segments_between(w, *args, span=16).collect())) == sorted(map(tuple, QUERIES["line_segments"](spark, sf_dir).collect()))


def test_cells_of_a_long_raster_have_numbers(spark, sf_dir, tmp_path):
    shift = 40 * 25000  # row 25,000 times 100,000 is no int
    spark.read.parquet(f"{sf_dir}/part.parquet").withColumn("p_partkey", F.col("p_partkey") + F.when(F.col("p_partkey") >= 100, shift).otherwise(0)).write.parquet(f"{tmp_path}/part.parquet")
    (tmp_path / "customer.parquet").symlink_to(f"{sf_dir}/customer.parquet")
    here = {r.r * 100000 + r.c for r in relation(spark, str(tmp_path), "grid").collect()}
    assert max(here) > 2**31
    assert {r.code for r in learning.cells(spark, str(tmp_path)).collect()} == here
    assert {r.cell for r in QUERIES["idw_grid"](spark, str(tmp_path)).collect()} == here
    for name in ("ok_kriging", "regression_kriging"):
        got = QUERIES[name](spark, str(tmp_path)).collect()
        assert {r.cell for r in got} == here and all(r.estimate is not None for r in got)
    assert QUERIES["water_table_kriged"](spark, str(tmp_path)).where("head is not null").count() == len(here)
