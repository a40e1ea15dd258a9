"""Quality control of well records: flags, duplicates, interval rules, upserts."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataflow.operators import metrics
from strataflow.operators.components import connected_components
from strataflow.operators.spatial import distance
from strataflow.session import cut


def in_box(x: Column, y: Column, box: tuple[float, float, float, float]) -> Column:
    """Whether a point lies in (x0, y0, x1, y1), edges included."""
    return x.between(box[0], box[2]) & y.between(box[1], box[3])


def flag_rows(frame: DataFrame, blocking: dict[str, Column], warning: dict[str, Column]) -> DataFrame:
    """Adds ``flags`` (names of all rules that hit) and ``approved`` (no blocking rule hit)."""
    every = {**blocking, **warning}
    flags = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in every.items()]))
    bad = F.lit(False)
    for c in blocking.values():
        bad = bad | F.coalesce(c, F.lit(False))
    return frame.withColumn("flags", flags).withColumn("approved", ~bad)


def completeness(wells: DataFrame, children: dict[str, tuple[DataFrame, int | None, int]], depth: str = "depth_m") -> DataFrame:
    """(code, score): a point for a depth, plus for each child table its row count, held below a limit and weighted.

    ``children``: name -> (rows with code, limit or None, weight). Each child is counted by code
    before it meets the wells.
    """
    out = wells.select("code", F.col(depth).isNotNull().cast("int").alias("score"))
    for name, (rows, limit, weight) in children.items():
        n = rows.groupBy("code").agg(F.count("*").alias(name))
        c = F.coalesce(F.col(name), F.lit(0))
        out = out.join(n, "code", "left").select("code", (F.col("score") + (F.least(c, F.lit(limit)) if limit else c) * weight).alias("score"))
    return out


def duplicate_groups(points: DataFrame, radius: float) -> DataFrame:
    """(code, component) of all points with another at most ``radius`` away, chains included.

    Cells are so small that all their points are that near each other; a link of two cells
    needs one pair of places. So the links follow the cells, not the pairs of points, whose
    number grows with the square of the density.
    """
    size = radius / math.sqrt(2) * (1 - 1e-6)
    have = points.where("code is not null and x is not null and y is not null").select("code", "x", "y", F.floor(F.col("x") / size).alias("cx"), F.floor(F.col("y") / size).alias("cy"))
    cells = cut(have.groupBy("cx", "cy").agg(F.min("code").alias("first"), F.max("code").alias("last")))
    members = have.select("code", "cx", "cy").join(cells, ["cx", "cy"])
    places = have.select("cx", "cy", "x", "y").distinct().join(cells.drop("last"), ["cx", "cy"])
    around = [(i, j) for i in (0, 1, 2) for j in (-2, -1, 0, 1, 2) if (i, j) > (0, 0)]
    steps = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in around])).alias("s")
    sent = places.select(F.col("x").alias("ax"), F.col("y").alias("ay"), F.col("first").alias("a"), "cx", "cy", steps)
    sent = sent.select("ax", "ay", "a", (F.col("cx") + F.col("s.i")).alias("cx"), (F.col("cy") + F.col("s.j")).alias("cy"))
    met = sent.join(places.withColumnRenamed("first", "b"), ["cx", "cy"]).where(distance(F.col("ax"), F.col("ay"), F.col("x"), F.col("y")) <= radius)
    # a code at several places links their cells
    split = members.groupBy("code").agg(F.min("first").alias("a"), F.max("first").alias("b")).where("a <> b").select("code", "a")
    links = met.select("a", "b").distinct().unionByName(members.join(split, "code").select("a", F.col("first").alias("b")))
    groups = connected_components(links).withColumnRenamed("node", "first")
    found = members.join(groups, "first", "left").where("component is not null or first <> last")
    return found.groupBy("code").agg(F.min(F.coalesce("component", "first")).alias("component"))


def losers(groups: DataFrame, scores: DataFrame) -> DataFrame:
    """(component, winner, code): all but the best of each group; the largest code wins among equal scores."""
    rated = groups.join(scores, "code")
    winners = rated.groupBy("component").agg(F.max(F.struct("score", "code")).alias("best")).select("component", F.col("best.code").alias("winner"))
    return rated.join(winners, "component").where(F.col("code") != F.col("winner")).select("component", "winner", "code")


def overlapping(intervals: DataFrame) -> DataFrame:
    """(code, n_overlaps): pairs of intervals of one code that share a stretch, for codes that have any.

    Of all pairs of a code's intervals those are apart where one ends at or above the other's
    top; a running count of ends along the tops finds them, so that a code with many
    intervals costs a sort. Intervals without a length, or with a missing bound, share none.
    """
    have = intervals.where("base_m > top_m")
    ends = have.select("code", F.col("base_m").alias("at"), F.lit(0).alias("top")).unionByName(have.select("code", F.col("top_m").alias("at"), F.lit(1).alias("top")))
    counted = ends.withColumn("ended", F.expr("sum(1 - top) over (partition by code order by at, top rows between unbounded preceding and current row)"))
    n = F.sum("top")
    apart = counted.groupBy("code").agg((n * (n - 1) / 2 - F.sum(F.when(F.col("top") == 1, F.col("ended")))).cast("long").alias("n_overlaps"))
    return apart.where("n_overlaps > 0")


def gaps(intervals: DataFrame, most: float = 2.0) -> DataFrame:
    """(code, n_gaps, widest): intervals that start over ``most`` below the end of the one before."""
    gap = intervals.select("code", (F.col("top_m") - F.expr("lag(base_m) over (partition by code order by top_m, rn)")).alias("gap"))
    return gap.where(F.col("gap") > most).groupBy("code").agg(F.count("*").alias("n_gaps"), F.max("gap").alias("widest"))


def upsert(old: DataFrame, new: DataFrame, key: str, prefer_new: list[str], keep_old: list[str] = ()) -> DataFrame:
    """Old and new rows by key: ``prefer_new`` columns take the new value where it isn't null, ``keep_old`` ones only for new keys."""
    o, n = old.alias("o"), new.alias("n")
    cols = [F.coalesce(F.col(f"n.{key}"), F.col(f"o.{key}")).alias(key)]
    cols += [F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}")).alias(c) for c in prefer_new]
    cols += [F.when(F.col(f"o.{key}").isNotNull(), F.col(f"o.{c}")).otherwise(F.col(f"n.{c}")).alias(c) for c in keep_old]
    return o.join(n, F.col(f"o.{key}") == F.col(f"n.{key}"), "full_outer").select(*cols)


def replace_by_key(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Old rows of keys that ``new`` doesn't have, and all new rows."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def replace_where(old: DataFrame, replaced: Column, new: DataFrame) -> DataFrame:
    """Old rows for which ``replaced`` isn't true (null included), and all new rows; columns that one side lacks are null."""
    return old.where(~F.coalesce(replaced, F.lit(False))).unionByName(new, allowMissingColumns=True)


def mad_outliers(frame: DataFrame, value: str, group: str, least: int = 30, most: float = 3.0) -> DataFrame:
    """Rows further than ``most`` median absolute deviations from their group's median, in groups of ``least`` rows or more."""
    med = metrics.median(frame, value, (group,))
    dev = frame.join(med, group).withColumn("dev", F.abs(F.col(value) - F.col("med")))
    mad = metrics.quantiles(dev, "dev", [0.5], ["mad"], (group,))
    return dev.join(mad, group).where((F.col("n") >= least) & (F.col("mad") > 0) & (F.col("dev") / F.col("mad") > most))
