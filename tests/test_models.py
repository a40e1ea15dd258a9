"""Regressors, the grid of fits, persisted models and samples against what they are defined by."""

import random

import pytest
from pyspark.sql import functions as F

from strataflow.operators import models, resample, validation
from strataflow.operators.ordering import numbered
from strataflow.plans import learning
from strataflow.plans.registry import QUERIES


@pytest.fixture(scope="module")
def frame(spark):
    rng = random.Random(3)
    rows = []
    for k in range(240):
        a, b = rng.uniform(0, 1), rng.uniform(0, 1)
        z = 3 * a - b + rng.gauss(0, 0.1)
        rows.append((k, rng.uniform(0, 6000), rng.uniform(0, 6000), a if k % 9 else None, b, z, int(z > 1)))
    return spark.createDataFrame(rows, "code long, bx double, by double, a double, b double, z double, y int").cache()


SIZE = dict(seeds=1, folds=3, inner=2, depths=(2, 4), trees=5, rounds=2)


def rows_of(got):
    return sorted(tuple(None if v is None else round(v, 9) for v in r) for r in got.collect())


def test_grid_in_flight_equals_one_by_one_and_goes_on(spark, frame, tmp_path, monkeypatch):
    together = validation.nested_validation(frame, ["a", "b"], str(tmp_path / "x"), 1000.0, at_once=4, **SIZE)
    alone = validation.nested_validation(frame, ["a", "b"], str(tmp_path / "y"), 1000.0, at_once=1, **SIZE)
    assert rows_of(together) == rows_of(alone) and together.count() == 240
    # a call that finds all but one task finished runs that one alone
    ran = []
    real = validation.fold_predictions
    monkeypatch.setattr(validation, "fold_predictions", lambda *a: ran.append(a[2:4]) or real(*a))
    import shutil

    shutil.rmtree(tmp_path / "y" / "seed-1-fold-1")
    again = validation.nested_validation(frame, ["a", "b"], str(tmp_path / "y"), 1000.0, at_once=2, **SIZE)
    assert ran == [(1, 1)] and rows_of(again) == rows_of(together)


def test_grid_raises_what_a_task_raises_and_keeps_the_rest(spark, tmp_path):
    def bad():
        raise ArithmeticError("no fit")

    tasks = {"a": lambda: spark.range(3), "b": bad, "c": lambda: spark.range(2)}
    with pytest.raises(ArithmeticError):
        validation.run_grid(spark, str(tmp_path), tasks, 2)
    assert [validation.is_written(spark, str(tmp_path / t)) for t in "abc"] == [True, False, True]
    assert validation.run_grid(spark, str(tmp_path), tasks | {"b": lambda: spark.range(1)}, 2).count() == 6


def test_value_scores_equal_residuals(spark, sf_dir):
    got = learning.out_of_fold(spark, sf_dir).collect()
    z = [r.z for r in got]
    mean = sum(z) / len(z)
    scores = {r.model: r for r in validation.value_scores(spark.createDataFrame(got), {"forest": "z_rf", "boosted": "z_gbt", "mean": "z_mean"}).collect()}
    for name, column in (("forest", "z_rf"), ("boosted", "z_gbt"), ("mean", "z_mean")):
        left = [r.z - r[column] for r in got]
        assert scores[name].n == len(z)
        assert scores[name].rmse == pytest.approx((sum(e * e for e in left) / len(z)) ** 0.5)
        assert scores[name].r2 == pytest.approx(1 - sum(e * e for e in left) / sum((v - mean) ** 2 for v in z))


def test_regressors_learn_out_of_fold(spark, frame, tmp_path):
    got = validation.nested_validation(frame, ["a", "b"], str(tmp_path), 1000.0, seeds=1, folds=3, depths=(4,), trees=20, rounds=40)
    scores = {r.model: r.r2 for r in validation.value_scores(got, {"rf": "z_rf", "gbt": "z_gbt", "mean": "z_mean"}).collect()}
    # a ninth of the rows have a median for the feature that matters most
    assert all(v > 0.5 for v in scores.values())


def test_a_fold_without_rows_or_classes_gives_none(spark, frame):
    args = (["a", "b"], 0, 1, (2,), 2, 3, 2)
    no_rows = frame.withColumn("fold", F.lit(1))
    one_class = frame.withColumn("fold", F.when(F.col("y") == 1, 0).otherwise(1))
    assert validation.fold_predictions(no_rows, *args).count() == validation.fold_predictions(one_class, *args).count() == 0


def test_enough(spark):
    rows = spark.range(60).select((F.col("id") % 2).alias("y"))
    assert validation.enough(rows) is rows
    for bad in (rows.limit(49), rows.where("y = 1"), rows.withColumn("y", F.lit(1)), rows.where("false")):
        with pytest.raises(ValueError):
            validation.enough(bad)


def test_models_read_back_predict_the_same(spark, frame, tmp_path):
    whole = frame.fillna(0.5)
    for name, make, predict in (("c", models.classifier, models.predict), ("r", models.regressor, models.predict_value)):
        for kind in ("rf", "gbt"):
            fitted = make(kind, ["a", "b"], 7, trees=5, rounds=3).fit(whole)
            path = str(tmp_path / (name + kind))
            models.save_model(fitted, path, ["a", "b"], {"area": "1"})
            back, features, about = models.load_model(spark.newSession(), path)
            assert (features, about) == (["a", "b"], {"area": "1"})
            assert predict(back, whole, "v").select("code", "v").orderBy("code").collect() == predict(fitted, whole, "v").select("code", "v").orderBy("code").collect()
            with pytest.raises(Exception):
                models.save_model(fitted, path, ["a", "b"], {})


def test_regression_queries(spark, sf_dir):
    got = {(r.seed, r.model): r for r in QUERIES["regression_cv"](spark, sf_dir).collect()}
    assert len(got) == 6 and all(r.rmse > 0 and r.r2 < 1 for r in got.values())
    external = {r.model: r for r in QUERIES["external_validation"](spark, sf_dir).collect()}
    assert set(external) == {"rf", "gbt"} and all(r.rmse > 0 and r.r2 < 1 and 0 <= r.auc <= 1 for r in external.values())


def test_numbered_and_dealt_blocks(spark):
    points = spark.range(900).select("id", (F.col("id") % 30 * 100.0).alias("x"), (F.floor(F.col("id") / 30) * 100.0).alias("y"))
    got = numbered(points, "x", "y").orderBy("place").collect()
    assert [r.place for r in got] == list(range(900)) and [(r.x, r.y) for r in got] == sorted((r.x, r.y) for r in got)
    dealt = models.spatial_folds(points, 300.0, 4, 5)
    by = dealt.groupBy(F.floor(F.col("x") / 300), F.floor(F.col("y") / 300)).agg(F.count_distinct("fold").alias("n"), F.first("fold").alias("fold")).collect()
    assert all(r.n == 1 for r in by) and [sum(r.fold == k for r in by) for k in range(4)] == [25] * 4


@pytest.mark.parametrize("n", [0, 1, 500, 1999, 2000, 5000])
def test_exact_sample(spark, n, monkeypatch):
    monkeypatch.setattr(resample, "RANKED_ROWS", 20)
    frame = spark.range(2000).select("id", (F.col("id") % 3).alias("k"))
    got = {r.id for r in resample.exact_sample(frame, n, ["id"], 4).collect()}
    assert len(got) == min(n, 2000)
    assert got == {r.id for r in resample.exact_sample(frame.repartition(7), n, ["id"], 4).collect()}
    order = [r.id for r in frame.orderBy(F.shiftrightunsigned(F.xxhash64("id", F.lit(4)), 1), "id").collect()]
    assert got == set(order[:n])


def test_exact_sample_of_repeated_rows(spark, monkeypatch):
    monkeypatch.setattr(resample, "RANKED_ROWS", 5)
    frame = spark.range(300).select(F.lit(7).alias("id"))
    assert resample.exact_sample(frame, 120, ["id"]).count() == 120
