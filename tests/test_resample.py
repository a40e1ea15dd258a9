"""Repetitions in numpy against the same weights as columns."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strataflow.operators import metrics, resample

DRAWS = (resample.GivenDraw(), resample.PoissonDraw(7), resample.OnceAlso(resample.PoissonDraw(20), -1))


def test_weights_are_the_columns(spark):
    for draw in DRAWS:
        reps = [-1, *range(30)] if isinstance(draw, resample.OnceAlso) else list(range(30))
        units = spark.range(0, 40000, 131).select("id", draw.key(F.col("id")).alias("k"), F.array(*[draw.column(F.lit(r), F.col("id")) for r in reps]).alias("w")).collect()
        got = draw.of(np.array([u.k for u in units]), np.array(reps))
        assert got.tolist() == [u.w for u in units]


def rows(spark):
    rng = random.Random(3)
    # many ties, ties across batches and ranges, missing scores and labels
    some = [(i, rng.randrange(300), f"w{i % 3}", None if i % 50 == 0 else round(rng.gauss(0, 1), 1 if i % 2 else 6), None if i % 61 == 0 else int(rng.random() < 0.4)) for i in range(4000)]
    return spark.createDataFrame([*some, (5000, 5, "one label", 0.5, 1)], "a long, b long, what string, score double, y int")


@pytest.mark.parametrize("held", [1 << 20, 500])
def test_auc_equals_a_weight_table(spark, monkeypatch, held):
    monkeypatch.setattr(resample, "HELD_WEIGHTS", held)
    frame = rows(spark)
    for draw in DRAWS[:2]:
        rep = F.col("rep")
        table = frame.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(19)))).withColumn("c", draw.column(rep, F.col("a")) * (draw.column(rep, F.col("b")) > 0).cast("double"))
        want = {(r.what, r.rep): r.auc for r in metrics.auc(table, "y", "score", "c", keys=("what", "rep")).collect()}
        got = {(r.what, r.rep): r.auc for r in resample.auc_by_repetition(frame, "y", "score", "a", draw, 20, ("b",), "what").collect()}
        assert got.keys() == want.keys()
        assert all(got[k] is None if want[k] is None else got[k] == pytest.approx(want[k], rel=1e-12) for k in want)


def test_rows_and_repetitions_don_t_multiply(spark):
    plan = resample.auc_by_repetition(rows(spark), "y", "score", "a", DRAWS[1], 1000, ("b",))._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "Join" not in plan


def test_captured_rows_don_t_multiply_by_repetitions(spark, sf_dir, monkeypatch):
    from strataflow.operators import captured
    from strataflow.plans import evaluation

    rows, cut_ = [], captured.cut
    monkeypatch.setattr(captured, "cut", lambda d: (lambda out: (rows.append(out.count()), out)[1])(cut_(d)))
    assert evaluation.captured_populations_drawn(spark, sf_dir, repetitions=300).where("n_valid > 0").count() > 0
    w, _ = evaluation.population(spark, sf_dir)
    blocks = w.select("block").distinct().count()
    # of tables by repetition there are those of blocks and of statistics only
    assert max(rows) <= max(301 * blocks, 301 * 6, 6 * w.count())
