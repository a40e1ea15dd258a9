"""Polylines as segments between neighbouring vertices."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

C = F.col


def segments_of(lines: DataFrame, x0: float, y1: float, res: float, rows: int, cols: int) -> DataFrame:
    """(line, part, i, r0, c0, r1, c1) of lines whose ``parts`` are arrays of arrays of (x, y), on a grid with its top left corner at (x0, y1).

    A segment stays if one of its ends lies on the grid; parts with fewer than two vertices have none.
    """
    part = lines.select("line", F.posexplode("parts").alias("part", "v")).where(F.size("v") >= 2)
    pairs = F.transform(F.sequence(F.lit(0), F.size("v") - 2), lambda i: F.struct(i.alias("i"), F.get("v", i).alias("a"), F.get("v", i + 1).alias("b")))
    s = part.select("line", "part", F.explode(pairs).alias("s"))
    row = lambda p: F.floor((F.lit(y1) - C(f"s.{p}.y")) / res).cast("int")
    col = lambda p: F.floor((C(f"s.{p}.x") - F.lit(x0)) / res).cast("int")
    s = s.select("line", "part", C("s.i").alias("i"), row("a").alias("r0"), col("a").alias("c0"), row("b").alias("r1"), col("b").alias("c1"))
    inside = lambda r, c: C(r).between(0, rows - 1) & C(c).between(0, cols - 1)
    return s.where(inside("r0", "c0") | inside("r1", "c1"))


def segments_between(vertices: DataFrame, x0: float, y1: float, res: float, rows: int, cols: int, span: int = 4096) -> DataFrame:
    """``segments_of`` for rows (line, code, x, y) in the order of code, as part 0 of each line.

    Rows are ordered within ranges of ``span`` codes; a range's place in its line and the
    first vertex of the next come from one row a range.
    """
    v = vertices.withColumn("range", F.floor(C("code") / span))
    along = Window.partitionBy("line").orderBy("range")
    ranges = v.groupBy("line", "range").agg(F.count("*").alias("n"), F.min(F.struct("code", "x", "y")).alias("first"))
    ranges = ranges.select("line", "range", (F.sum("n").over(along) - C("n")).alias("before"), F.lead("first").over(along).alias("after"))
    within = Window.partitionBy("line", "range").orderBy("code")
    s = v.select("line", "range", F.row_number().over(within).alias("k"), F.struct("x", "y").alias("a"), F.lead(F.struct("x", "y")).over(within).alias("b"))
    s = s.join(ranges, ["line", "range"]).withColumn("b", F.coalesce("b", F.struct("after.x", "after.y"))).where("b.x is not null and b.y is not null")
    row = lambda p: F.floor((F.lit(y1) - C(f"{p}.y")) / res).cast("int")
    col = lambda p: F.floor((C(f"{p}.x") - F.lit(x0)) / res).cast("int")
    s = s.select("line", F.lit(0).alias("part"), (C("before") + C("k") - 1).cast("int").alias("i"), row("a").alias("r0"), col("a").alias("c0"), row("b").alias("r1"), col("b").alias("c1"))
    inside = lambda r, c: C(r).between(0, rows - 1) & C(c).between(0, cols - 1)
    return s.where(inside("r0", "c0") | inside("r1", "c1"))
