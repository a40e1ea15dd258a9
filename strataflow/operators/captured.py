"""How much of what neighbours can tell a model captures, in two populations, with intervals over blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataflow.operators import resample, spatial
from strataflow.session import cut

C = F.col
#: The repetition that stands for the estimate itself: every block once.
POINT = -1


def neighbour_scores(points: DataFrame, value: str, radius: float, ks: tuple[int, ...]) -> DataFrame:
    """(code, k, score): the 1/d-weighted mean of the values of the ``k`` nearest other points, of these the ones within ``radius``; no row without any."""
    own = points.select("code", "x", "y", C(value).alias("v"))
    near = spatial.nearest(own, own, max(ks), carry=("v",), exclude_self=True, most=radius)
    by = near.select(C("a").alias("code"), "d", "b_v", F.explode(F.array(*[F.when(C("rank") <= k, F.lit(k)) for k in ks])).alias("k")).where("k is not null")
    return spatial.inverse_distance(by, "b_v", 1.0, keys=("code", "k")).withColumnRenamed("value", "score")


def block_weights(points: DataFrame, draw: resample.Draw, reps: list[int]) -> DataFrame:
    """(rep, block, c > 0): how often each block is drawn in each of ``reps``."""
    blocks = points.select("block").where("block is not null").distinct().select("block", F.explode(F.array(*[F.lit(r) for r in reps])).alias("rep"))
    return blocks.select("rep", "block", draw.column(C("rep"), C("block")).alias("c")).where("c > 0")


def captured(points: DataFrame, predictions: DataFrame, draw: resample.Draw, repetitions: int, radius: float, lag: float, ks: tuple[int, ...] = (1, 5), least_valid: int = 10) -> DataFrame:
    """(ratio, population, k, point, low, high, above, n_valid).

    ``points`` has code, x, y, z, y1 and block; ``predictions`` seed, code, p and v for each
    point; ``draw`` says how often a block is drawn. Ratio ``auc`` is the model's AUC above one half
    over that of the k nearest neighbours within ``radius``, for population A (all points
    over the ones with a neighbour) and B (the ones with a neighbour on both sides); ratio
    ``r2`` is R2 over what the nugget of pairs within ``lag`` leaves. The model's figures are
    means over seeds. Numerator and denominator come from the same weights in each
    repetition; ``above`` is the share of repetitions over 1. Ratios aren't cut off; without
    room above chance, or with fewer than ``least_valid`` repetitions, they are null.
    """
    scores = cut(neighbour_scores(points, "z", radius, ks))
    reps = [POINT, *range(repetitions)]
    draw = resample.OnceAlso(draw, POINT)
    drawn = cut(block_weights(points, draw, reps))
    inside = scores.select("code").distinct().withColumn("inside", F.lit(True))
    own = cut(points.select("code", "block", "z", "y1").join(inside, "code", "left"))
    base = own.join(scores.withColumn("score", F.round("score", 9)), "code").select("block", "y1", "score", F.concat(F.lit("k"), "k").alias("what"))
    seeded = own.join(predictions.select("seed", "code", "p", "v"), "code")
    population = F.explode(F.array(F.lit("A"), F.when(C("inside"), F.lit("B")))).alias("population")
    model = seeded.select("block", "y1", C("p").alias("score"), "seed", population).where("population is not null")
    model = model.select("block", "y1", "score", F.concat_ws("|", "population", C("seed").cast("string")).alias("what"))
    auc = cut(resample.auc_by_repetition(cut(base.unionByName(model)), "y1", "score", "block", draw, reps, what="what"))
    bench = auc.where("what like 'k%'").select("rep", F.substring("what", 2, 9).cast("int").alias("k"), C("auc").alias("bench"))
    mean = auc.where("what not like 'k%'").groupBy("rep", F.substring("what", 1, 1).alias("population")).agg(F.avg("auc").alias("auc"))
    room = C("bench") - 0.5
    shares = mean.join(bench, "rep").select(F.lit("auc").alias("ratio"), "population", "k", "rep", F.when(room > 0, (C("auc") - 0.5) / room).alias("v"))

    # blocks have one weight: rows are summed by block before repetitions multiply them
    e = C("z") - C("v")
    summed = seeded.groupBy("block", "seed").agg(F.count("*").alias("n"), F.sum("z").alias("s"), F.sum(C("z") * C("z")).alias("ss"), F.sum(e * e).alias("ee")).join(drawn, "block")
    total = {k: F.sum(C("c") * C(k)) for k in ("n", "s", "ss", "ee")}
    r2 = summed.groupBy("rep", "seed").agg((1 - total["ee"] / F.nullif(total["ss"] - total["s"] * total["s"] / total["n"], F.lit(0.0))).alias("r2")).groupBy("rep").agg(F.avg("r2").alias("r2"))
    part = points.select("code", "x", "y", "z", "block")
    pairs = spatial.radius_pairs(part, lag, carry=("z", "block")).select("a_block", "b_block", ((C("a_z") - C("b_z")) * (C("a_z") - C("b_z")) / 2).alias("g"))
    # and pairs by their two blocks
    pairs = pairs.groupBy("a_block", "b_block").agg(F.sum("g").alias("g"), F.count("*").alias("n"))
    side = lambda s: drawn.select("rep", C("block").alias(f"{s}_block"), C("c").alias(f"{s}_c"))
    w = C("a_c") * C("b_c")
    gamma = pairs.join(side("a"), "a_block").join(side("b"), ["rep", "b_block"]).groupBy("rep").agg((F.sum(w * C("g")) / F.sum(w * C("n"))).alias("gamma"))
    sums = part.groupBy("block").agg(F.count("*").alias("n"), F.sum("z").alias("s"), F.sum(C("z") * C("z")).alias("ss")).join(drawn, "block")
    mean_z = F.sum(C("c") * C("s")) / F.sum(C("c") * C("n"))
    sill = sums.groupBy("rep").agg((F.sum(C("c") * C("ss")) / F.sum(C("c") * C("n")) - mean_z * mean_z).alias("sill"))
    left: Column = 1 - C("gamma") / C("sill")
    reach = gamma.join(sill, "rep").select("rep", F.when(C("sill") > 0, left).alias("most"))
    reached = r2.join(reach, "rep", "left").select(F.lit("r2").alias("ratio"), F.lit("A").alias("population"), F.lit(None).cast("int").alias("k"), "rep", F.when(C("most") > 0, C("r2") / C("most")).alias("v"))

    every = cut(shares.unionByName(reached))
    keys = ["ratio", "population", "k"]
    valid = every.where((C("rep") != POINT) & C("v").isNotNull())
    spread = resample.interval(valid, "v", tuple(keys), least_valid).join(valid.groupBy(*keys).agg(F.avg((C("v") > 1).cast("int")).alias("above")).withColumnsRenamed({k: f"__{k}" for k in keys}), F.expr(" and ".join(f"{k} <=> __{k}" for k in keys)))
    spread = spread.drop(*[f"__{k}" for k in keys]).withColumnsRenamed({k: f"__{k}" for k in keys})
    point = every.where(C("rep") == POINT).select(*keys, C("v").alias("point"))
    return point.join(spread, F.expr(" and ".join(f"{k} <=> __{k}" for k in keys)), "left").select(*keys, "point", "low", "high", "above", F.coalesce("n_valid", F.lit(0)).alias("n_valid"))
