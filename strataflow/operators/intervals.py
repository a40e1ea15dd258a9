"""Interval logic along wells."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def contacts(intervals: DataFrame, cover: list[str], rock: list[str], sound: list[str], tolerance: float = 0.5) -> DataFrame:
    """(code, cover_base, rock_top, sound_top) of each code, over its classified intervals by top.

    cover_base is the base of the unbroken run of ``cover`` classes from the surface, where
    an interval may start up to ``tolerance`` below the one before; rock_top and sound_top
    are the tops of the first interval of these classes.
    """
    have = intervals.where(F.col("lithology").isNotNull())
    before = F.coalesce(F.expr("lag(base_m) over (partition by code order by top_m, rn)"), F.lit(0.0))
    broken = (~F.col("lithology").isin(*cover)) | (F.col("top_m") - before > tolerance)
    run = have.withColumn("broken", broken.cast("int")).withColumn("stop", F.expr("max(broken) over (partition by code order by top_m, rn rows between unbounded preceding and current row)"))
    first = lambda names: F.min(F.when(F.col("lithology").isin(*names), F.col("top_m")))
    return run.groupBy("code").agg(F.max(F.when(F.col("stop") == 0, F.col("base_m"))).alias("cover_base"), first(rock).alias("rock_top"), first(sound).alias("sound_top"))


def overlap_length(a0, a1, b0, b1):
    """Length that two intervals share."""
    return F.greatest(F.lit(0.0), F.least(a1, b1) - F.greatest(a0, b0))


def class_fractions(intakes: DataFrame, intervals: DataFrame, order: list[str]) -> DataFrame:
    """(code, main, fraction, covered): the class with the largest share of each intake, by ``order`` among equals."""
    met = intakes.join(intervals.where(F.col("lithology").isNotNull()), "code")
    part = met.select("code", "lithology", (overlap_length(F.col("top"), F.col("base"), F.col("top_m"), F.col("base_m")) / (F.col("base") - F.col("top"))).alias("f"))
    by = part.groupBy("code", "lithology").agg(F.sum("f").alias("f")).where("f > 0")
    rank = F.array_position(F.array(*[F.lit(o) for o in order]), F.col("lithology"))
    best = by.groupBy("code").agg(F.max(F.struct(F.round("f", 9).alias("f"), (-rank).alias("r"), F.col("lithology").alias("main"))).alias("b"), F.sum("f").alias("covered"))
    return best.select("code", F.col("b.main").alias("main"), F.col("b.f").alias("fraction"), "covered")
