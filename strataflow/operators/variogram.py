"""Variograms, nuggets and trends from pairs of points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataflow.functions.geometry import direction_class
from strataflow.operators.spatial import radius_pairs

LAGS = (0, 250, 500, 1000, 2000, 4000, 8000, 16000)


def lag_bin(d: Column, lags: tuple[int, ...] = LAGS) -> Column:
    """Upper bound of the half-open bin (a, b] that holds ``d``; null outside."""
    out = F.lit(None).cast("int")
    for a, b in reversed(list(zip(lags, lags[1:], strict=False))):
        out = F.when((d > a) & (d <= b), F.lit(b)).otherwise(out)
    return out


def pair_bins(points: DataFrame, value: str, lags: tuple[int, ...] = LAGS, directional: bool = False) -> DataFrame:
    """Pairs within the last lag, with their bin and half squared difference ``g``."""
    pairs = radius_pairs(points, float(lags[-1]), carry=(value,))
    diff = F.col(f"a_{value}") - F.col(f"b_{value}")
    cols = ["a", "b", "d", lag_bin(F.col("d"), lags).alias("lag"), (diff * diff / 2).alias("g")]
    if directional:
        cols.append(direction_class(F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")).alias("direction"))
    return pairs.select(*cols).where(F.col("lag").isNotNull())


def variogram(bins: DataFrame, keys: tuple[str, ...] = (), least_pairs: int = 1) -> DataFrame:
    """lag, pairs and semivariance of each bin with at least ``least_pairs`` pairs."""
    return bins.groupBy(*keys, "lag").agg(F.count("*").alias("pairs"), F.avg("g").alias("gamma")).where(F.col("pairs") >= least_pairs)


#: Pairs that a bin needs.
LEAST_PAIRS = 100


def nugget(lags: DataFrame, points: DataFrame, value: str, least_pairs: int = LEAST_PAIRS, cap: bool = True) -> DataFrame:
    """The first valid lag's share of the population variance (capped at 1), and the highest R2 it leaves; ``lags`` has lag, pairs and gamma."""
    first = lags.where(F.col("pairs") >= least_pairs).agg(F.min_by(F.struct("lag", "pairs", "gamma"), "lag").alias("f")).where("f is not null").select("f.*")
    sill = points.agg(F.var_pop(value).alias("sill"))
    share = F.col("gamma") / F.col("sill")
    return first.crossJoin(F.broadcast(sill)).select("lag", "pairs", (F.least(F.lit(1.0), share) if cap else share).alias("nugget")).withColumn("r2_max", 1 - F.col("nugget"))


def linear_trend(points: DataFrame, value: str) -> DataFrame:
    """Least-squares plane in x and y: b0, bx, by and R2, from one row of sums around the means."""
    m = points.agg(F.avg("x").alias("mx"), F.avg("y").alias("my"), F.avg(value).alias("mz"))
    c = points.crossJoin(F.broadcast(m)).select((F.col("x") - F.col("mx")).alias("u"), (F.col("y") - F.col("my")).alias("v"), (F.col(value) - F.col("mz")).alias("t"), "mx", "my", "mz")
    s = c.agg(*[F.sum(F.col(a) * F.col(b)).alias(a + b) for a, b in (("u", "u"), ("u", "v"), ("v", "v"), ("u", "t"), ("v", "t"), ("t", "t"))], F.max("mx").alias("mx"), F.max("my").alias("my"), F.max("mz").alias("mz"))
    det = F.col("uu") * F.col("vv") - F.col("uv") * F.col("uv")
    s = s.withColumn("bx", (F.col("ut") * F.col("vv") - F.col("vt") * F.col("uv")) / det).withColumn("by", (F.col("vt") * F.col("uu") - F.col("ut") * F.col("uv")) / det)
    return s.select((F.col("mz") - F.col("bx") * F.col("mx") - F.col("by") * F.col("my")).alias("b0"), "bx", "by", ((F.col("bx") * F.col("ut") + F.col("by") * F.col("vt")) / F.col("tt")).alias("r2"))


def detrend(points: DataFrame, value: str) -> DataFrame:
    """``points`` with ``value`` replaced by its residual from the plane."""
    t = F.broadcast(linear_trend(points, value).select("b0", "bx", "by"))
    return points.crossJoin(t).withColumn(value, F.col(value) - (F.col("b0") + F.col("bx") * F.col("x") + F.col("by") * F.col("y"))).drop("b0", "bx", "by")
