"""Evaluation statistics as aggregations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def running_below(cells: DataFrame, order: str, count: str, keys: tuple[str, ...] = (), parts: int = 64) -> DataFrame:
    """Adds ``below``: the sum of ``count`` over the cells with a smaller ``order`` (unique by ``keys``).

    The running sum is taken within ``parts`` ranges between approximate quantiles, on top of
    the totals of the ranges below, so that no task has to order all cells.
    """
    steps = ", ".join(f"{i / parts}D" for i in range(1, parts))
    breaks = cells.agg(F.expr(f"percentile_approx({order}, array({steps}), 10000)").alias("__breaks"))
    cells = cells.crossJoin(F.broadcast(breaks)).withColumn("__part", F.size(F.filter("__breaks", lambda b: b < F.col(order)))).drop("__breaks")
    ranges = cells.groupBy(*keys, "__part").agg(F.sum(count).alias("__total"))
    over = f"partition by {', '.join(keys)} " if keys else ""
    ranges = ranges.select(*keys, "__part", F.expr(f"sum(__total) over ({over}order by __part rows between unbounded preceding and current row) - __total").alias("__base"))
    cells = cells.join(ranges, [*keys, "__part"])
    own = ", ".join([*keys, "__part"])
    below = F.expr(f"__base + sum({count}) over (partition by {own} order by {order} rows between unbounded preceding and current row) - {count}")
    return cells.withColumn("below", below).drop("__part", "__base")


def auc(frame: DataFrame, label: str, score: str, weight: str | None = None, keys: tuple[str, ...] = (), parts: int = 64) -> DataFrame:
    """Mann-Whitney AUC by ``keys``, ties counted half, with optional weights: n, positives, auc.

    Rows collapse to one per key and score first; ``running_below`` ranks them. Null when a
    key has one label only.
    """
    w = F.col(weight) if weight else F.lit(1.0)
    cells = frame.where(F.col(score).isNotNull() & F.col(label).isNotNull()).groupBy(*keys, score).agg(
        F.sum(F.when(F.col(label) == 1, w).otherwise(0.0)).alias("pos"), F.sum(F.when(F.col(label) == 1, 0.0).otherwise(w)).alias("neg"), F.count("*").alias("n")
    )
    cells = running_below(cells, score, "neg", keys, parts)
    total = cells.groupBy(*keys) if keys else cells.groupBy()
    return total.agg(
        F.sum("n").alias("n"),
        F.sum("pos").alias("positives"),
        (F.sum(F.col("pos") * (F.col("below") + F.col("neg") / 2)) / F.nullif(F.sum("pos") * F.sum("neg"), F.lit(0.0))).alias("auc"),
    )


def r2_rmse(frame: DataFrame, actual: str, predicted: str, weight: str | None = None, keys: tuple[str, ...] = ()) -> DataFrame:
    """n, R2 and RMSE by ``keys``, with optional weights."""
    w = F.col(weight) if weight else F.lit(1.0)
    y, e = F.col(actual), F.col(actual) - F.col(predicted)
    sums = frame.groupBy(*keys).agg(F.count("*").alias("n"), F.sum(w).alias("w"), F.sum(w * y).alias("wy"), F.sum(w * y * y).alias("wyy"), F.sum(w * e * e).alias("wee"))
    spread = F.col("wyy") - F.col("wy") * F.col("wy") / F.col("w")
    return sums.select(*keys, "n", (1 - F.col("wee") / spread).alias("r2"), F.sqrt(F.col("wee") / F.col("w")).alias("rmse"))


def quantiles(frame: DataFrame, column: str, at: list[float], names: list[str], keys: tuple[str, ...] = (), parts: int = 64) -> DataFrame:
    """Exact, linearly interpolated quantiles: ``names`` in one row, or one row for each of ``keys``; null where there is no value.

    Values collapse to counts, and ranks are taken within ranges of values on top of the
    counts of the ranges below, so that no task or buffer holds all values.
    """
    cells = frame.where(F.col(column).isNotNull()).groupBy(*keys, F.col(column).cast("double").alias("__v")).agg(F.count("*").alias("__n"))
    cells = running_below(cells, "__v", "__n", keys, parts)
    total = cells.groupBy(*keys).agg(F.sum("__n").alias("__all")) if keys else cells.agg(F.sum("__n").alias("__all"))
    ranked = cells.join(total, list(keys)) if keys else cells.crossJoin(F.broadcast(total))

    def value_at(rank: Column) -> Column:
        return F.max(F.when((F.col("below") <= rank) & (rank < F.col("below") + F.col("__n")), F.col("__v")))

    place = lambda q: F.lit(float(q)) * (F.col("__all") - 1)
    found = [v for k, q in enumerate(at) for v in (value_at(F.floor(place(q))).alias(f"__l{k}"), value_at(F.ceil(place(q))).alias(f"__h{k}"), F.max(place(q) - F.floor(place(q))).alias(f"__f{k}"))]
    got = ranked.groupBy(*keys).agg(*found) if keys else ranked.agg(*found)
    low = lambda k: F.col(f"__l{k}") + (F.col(f"__h{k}") - F.col(f"__l{k}")) * F.col(f"__f{k}")
    return got.select(*keys, *[low(k).alias(n) for k, n in enumerate(names)])


def median(frame: DataFrame, column: str, keys: tuple[str, ...], name: str = "med") -> DataFrame:
    """(keys, name, n): exact median and number of values by ``keys``, however many rows a key has."""
    counts = frame.groupBy(*keys).agg(F.count(column).alias("n"))
    return counts.join(quantiles(frame, column, [0.5], [name], keys), list(keys), "left")
