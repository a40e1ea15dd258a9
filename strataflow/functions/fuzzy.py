"""Fuzzy memberships and exact-median imputation over whole frames."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataflow.operators.metrics import quantiles


def membership(value: Column, low: Column, high: Column, inverted: bool = False) -> Column:
    """Linear rise from ``low`` to ``high``, held within 0 and 1; missing values get a half."""
    m = F.when(value.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), (value - low) / (high - low))))
    return F.coalesce(1 - m if inverted else m, F.lit(0.5))


def gamma(members: list[Column], g: float = 0.9) -> Column:
    """Fuzzy gamma: the algebraic sum to the power g times the product to the power 1 - g."""
    product = reduce(lambda a, b: a * b, members)
    rest = reduce(lambda a, b: a * b, [1 - m for m in members])
    return F.pow(1 - rest, F.lit(g)) * F.pow(product, F.lit(1 - g))


def gamma_score(frame: DataFrame, columns: list[tuple[str, bool]], name: str, low: float = 0.02, high: float = 0.98) -> DataFrame:
    """Adds ``name``: the fuzzy gamma of ``columns`` (name, inverted) between their quantiles."""
    at = [(c, q, f"__{s}_{c}") for c, _ in columns for q, s in ((low, "a"), (high, "b"))]
    q = column_quantiles(frame, [c for c, _ in columns], {"a": low, "b": high})
    joined = frame.crossJoin(F.broadcast(q))
    members = [membership(F.col(c), F.col(f"__a_{c}"), F.col(f"__b_{c}"), inv) for c, inv in columns]
    return joined.withColumn(name, gamma(members)).drop(*[n for _, _, n in at])


def column_quantiles(frame: DataFrame, columns: list[str], at: dict[str, float]) -> DataFrame:
    """One row of exact quantiles ``__{name}_{column}`` of several columns, found in one pass over (column, value)."""
    one = F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).cast("double").alias("v")) for c in columns])).alias("s")
    got = quantiles(frame.select(one).select("s.*"), "v", list(at.values()), list(at), ("c",))
    return got.agg(*[F.max(F.when(F.col("c") == c, F.col(n))).alias(f"__{n}_{c}") for c in columns for n in at])


def impute_median(frame: DataFrame, columns: list[str], source: DataFrame | None = None) -> DataFrame:
    """Missing values replaced by their column's exact median in ``source``, such as a training side (by default the frame itself)."""
    source = frame if source is None else source
    q = column_quantiles(source, columns, {"m": 0.5})
    joined = frame.crossJoin(F.broadcast(q))
    return joined.withColumns({c: F.coalesce(F.col(c), F.col(f"__m_{c}")) for c in columns}).drop(*[f"__m_{c}" for c in columns])
