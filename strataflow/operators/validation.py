"""Nested spatial validation as a grid of fits: several at a time, each result written as it comes."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataflow.functions.fuzzy import impute_median
from strataflow.operators import metrics, models
from strataflow.session import cut
from strataflow.sources.tables import is_written

C = F.col
#: Tasks of a grid that run at the same time.
AT_ONCE = 4
#: Test rows that a result needs, besides both classes.
LEAST_ROWS = 50

PREDICTIONS = "seed int, fold int, code {code}, y int, z double, p_rf double, p_gbt double, p_mean double, z_rf double, z_gbt double, z_mean double"


def run_grid(spark: SparkSession, path: str, tasks: dict[str, Callable[[], DataFrame]], at_once: int = AT_ONCE) -> DataFrame:
    """The rows of all ``tasks``, each written to its own folder below ``path``.

    ``at_once`` tasks run on the session at the same time, each in a scheduler pool of its
    own, so that with fair scheduling a short fit doesn't wait for a long one. A task whose
    folder is complete isn't run again: after a failure a second call goes on where the
    first one stopped. If tasks fail, the others are still run to their end; then the first
    failure is raised.
    """

    def run(name: str) -> None:
        where = f"{path}/{name}"
        if is_written(spark, where):
            return
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", name)
        try:
            tasks[name]().write.mode("overwrite").parquet(where)
        finally:
            spark.sparkContext.setLocalProperty("spark.scheduler.pool", None)

    with ThreadPoolExecutor(max(1, at_once)) as pool:
        done = [pool.submit(inheritable_thread_target(spark)(run), name) for name in sorted(tasks)]
    for d in done:
        d.result()
    return spark.read.parquet(*[f"{path}/{name}" for name in sorted(tasks)])


def fold_predictions(frame: DataFrame, features: list[str], fold: int, seed: int, depths: tuple[int, ...], inner: int, trees: int, rounds: int) -> DataFrame:
    """The rows of one fold with probabilities of y and values of z from models of the other folds.

    Medians come from the training side, and the forest's depth is chosen inside it; both
    kinds of model are fitted for the class and for the value. A fold without rows, or one
    whose training side has a single class, gives no rows.
    """
    rest = frame.where(C("fold") != fold)
    whole = cut(models.in_order(impute_median(frame, features, rest)))
    rest, own = whole.where(C("fold") != fold), whole.where(C("fold") == fold)
    schema = PREDICTIONS.format(code=frame.schema["code"].dataType.simpleString())
    names = [c.split()[0] for c in schema.split(", ")]
    if own.isEmpty() or rest.select("y").distinct().count() < 2:
        return frame.sparkSession.createDataFrame([], schema)
    depth = models.choose_depth(rest, features, "rf", depths, seed, inner, trees=trees) if len(depths) > 1 else depths[0]
    got = models.predict(models.classifier("rf", features, seed, trees=trees, depth=depth).fit(rest), own, "p_rf")
    got = models.predict(models.classifier("gbt", features, seed, rounds=rounds).fit(rest), got, "p_gbt")
    got = models.predict_value(models.regressor("rf", features, seed, trees=trees, depth=depth).fit(rest), got, "z_rf")
    got = models.predict_value(models.regressor("gbt", features, seed, rounds=rounds).fit(rest), got, "z_gbt")
    got = got.withColumns({"seed": F.lit(seed), "p_mean": (C("p_rf") + C("p_gbt")) / 2, "z_mean": (C("z_rf") + C("z_gbt")) / 2})
    return got.select(*names)


def nested_validation(frame: DataFrame, features: list[str], path: str, block_m: float, seeds: int = models.SEEDS, folds: int = models.OUTER, inner: int = models.INNER, depths: tuple[int, ...] = models.DEPTHS, trees: int = models.TREES, rounds: int = models.ROUNDS, at_once: int = AT_ONCE) -> DataFrame:
    """``PREDICTIONS`` of every row for each of ``seeds`` deals of blocks to ``folds``; ``frame`` has code, x, y, the block coordinates bx and by, z and ``features``.

    The grid of seeds times folds runs through ``run_grid``.
    """
    spark, tasks = frame.sparkSession, {}
    for seed in range(1, seeds + 1):
        dealt = cut(models.deal_blocks(frame, block_m, folds, seed))
        for k in range(folds):
            tasks[f"seed-{seed}-fold-{k}"] = lambda dealt=dealt, k=k, seed=seed: fold_predictions(dealt, features, k, seed, depths, inner, trees, rounds)
    return run_grid(spark, path, tasks, at_once)


def class_scores(predictions: DataFrame, columns: dict[str, str]) -> DataFrame:
    """(seed, model, n, positives, auc) of each of ``columns`` (model -> probability), on the same rows."""
    long = predictions.select("seed", "y", F.explode(F.array(*[F.struct(F.lit(m).alias("model"), C(c).alias("p")) for m, c in columns.items()])).alias("s")).select("seed", "y", "s.*")
    return metrics.auc(long, "y", "p", keys=("seed", "model"))


def value_scores(predictions: DataFrame, columns: dict[str, str]) -> DataFrame:
    """(seed, model, n, r2, rmse) of each of ``columns`` (model -> value) against z, on the same rows."""
    long = predictions.select("seed", "z", F.explode(F.array(*[F.struct(F.lit(m).alias("model"), C(c).alias("v")) for m, c in columns.items()])).alias("s")).select("seed", "z", "s.*")
    return metrics.r2_rmse(long, "z", "v", keys=("seed", "model"))


def enough(frame: DataFrame, label: str = "y", least: int = LEAST_ROWS) -> DataFrame:
    """``frame``, or an error where it has fewer than ``least`` rows or one class only: no figure stands on such a test."""
    got = frame.agg(F.count("*").alias("n"), F.count_distinct(label).alias("classes")).first()
    if got.n < least or got.classes < 2:
        raise ValueError(f"{got.n} rows of {got.classes} classes are too few for a test; it takes {least} and both classes")
    return frame
