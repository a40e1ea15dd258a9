"""Raster operators over long tables (r, c, v): windows along rows and columns, and joins on cells.

A raster may have more cells than a task holds: windows run per row or per column, so that a
task needs a strip, and neighbours meet by equi-joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataflow.operators.spatial import nearest
from strataflow.session import cut

C = F.col
#: The eight neighbours, in the order that settles ties.
AROUND = [(-1, -1), (-1, 0), (-1, 1), (0, -1), (0, 1), (1, -1), (1, 0), (1, 1)]


def cell_number() -> Column:
    """A number for each cell (r, c) of fewer than 100,000 columns; rows are no fewer than an int can count."""
    return C("r").cast("long") * 100000 + C("c")


def _lag(along: str, across: str, expr: str) -> Column:
    return F.expr(expr.format(over=f"over (partition by {across} order by {along})"))


def gradient(grid: DataFrame, res: float) -> DataFrame:
    """Adds gr and gc: slopes down the rows and along the columns, central inside and one-sided at the edges."""
    out = grid
    for name, along, across in (("gr", "r", "c"), ("gc", "c", "r")):
        before, after = _lag(along, across, "lag(v) {over}"), _lag(along, across, "lead(v) {over}")
        d = F.when(before.isNull() & after.isNull(), 0.0).when(before.isNull(), after - C("v")).when(after.isNull(), C("v") - before).otherwise((after - before) / 2)
        out = out.withColumn(name, d / res)
    return out


def laplacian(grid: DataFrame, res: float) -> DataFrame:
    """Adds lap: the sum of the four neighbours less four times the cell, edges reflected."""
    total = F.lit(0.0)
    for along, across in (("r", "c"), ("c", "r")):
        for f in ("lag", "lead"):
            total = total + F.coalesce(_lag(along, across, f + "(v) {over}"), C("v"))
    return grid.withColumn("lap", (total - 4 * C("v")) / (res * res))


def _mirrored(at: Column, n: Column, before: int, after: int) -> Column:
    """The places from -before to n + after - 1 that place ``at`` of ``n`` is mirrored to, its own included."""
    turns = F.sequence(-F.ceil(F.lit(before) / (2 * n)) - 1, F.ceil(F.lit(after) / (2 * n)) + 1)
    places = F.flatten(F.transform(turns, lambda k: F.array(at + 2 * n * k, 2 * n - 1 - at + 2 * n * k)))
    return F.filter(places, lambda p: (p >= -before) & (p < n + after))


def reflected(grid: DataFrame, before: int, after: int) -> DataFrame:
    """(r, c, v, pr, pc): ``grid`` with its cells mirrored at the edges of its bounding box.

    Places pr and pc reach ``before`` back and ``after`` on beyond the box; an edge cell is its
    own first mirror image, and a box narrower than the reach is mirrored again and again.
    """
    box = grid.agg(F.min("r").alias("r1"), F.max("r").alias("r2"), F.min("c").alias("c1"), F.max("c").alias("c2"))
    out = grid.crossJoin(F.broadcast(box))
    for x in ("r", "c"):
        out = out.withColumn(f"p{x}", F.explode(_mirrored(C(x) - C(f"{x}1"), C(f"{x}2") - C(f"{x}1") + 1, before, after)))
        out = out.withColumn(f"p{x}", C(f"p{x}") + C(f"{x}1"))
    return out.select("r", "c", "v", "pr", "pc")


def box_stats(grid: DataFrame, size: int) -> DataFrame:
    """Adds n, s1, s2: count, sum and sum of squares in a size x size window, mirrored at the edges.

    The window reaches size // 2 back and size - size // 2 - 1 on, by one window function
    down the columns and one along the rows.
    """
    a, b = size // 2, size - size // 2 - 1
    frame = f"rows between {a} preceding and {b} following"
    one = reflected(grid.select("r", "c", "v"), a, b)
    for out, own in (("__n", "count(v)"), ("__1", "sum(v)"), ("__2", "sum(v * v)")):
        one = one.withColumn(out, F.expr(f"{own} over (partition by pc order by pr {frame})"))
    one = one.where("pr = r")
    for out, own in (("n", "__n"), ("s1", "__1"), ("s2", "__2")):
        one = one.withColumn(out, F.expr(f"sum({own}) over (partition by pr order by pc {frame})"))
    return one.where("pc = c").select("r", "c", "v", "n", "s1", "s2")


def box_sum_sparse(cells: DataFrame, before: int, after: int) -> DataFrame:
    """(r, c, value): sums of v over windows around every cell near a given one; missing cells are 0."""
    span = F.explode(F.sequence(F.lit(-after), F.lit(before))).alias("s")
    rows = cells.select("r", "c", "v", span).groupBy((C("r") + C("s")).alias("r"), "c").agg(F.sum("v").alias("v"))
    return rows.select("r", "c", "v", span).groupBy("r", (C("c") + C("s")).alias("c")).agg(F.sum("v").alias("value"))


def with_neighbours(grid: DataFrame, value: str, carry: tuple[str, ...] = ()) -> DataFrame:
    """(r, c, k, nr, nc, nv): each cell beside its neighbours, k being the neighbour's order."""
    near = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(i).alias("i"), F.lit(j).alias("j")) for k, (i, j) in enumerate(AROUND)])
    sent = grid.select(C("r").alias("nr"), C("c").alias("nc"), C(value).alias("nv"), F.explode(near).alias("s"))
    sent = sent.select((C("nr") - C("s.i")).alias("r"), (C("nc") - C("s.j")).alias("c"), C("s.k").alias("k"), "nr", "nc", "nv", F.sqrt((C("s.i") * C("s.i") + C("s.j") * C("s.j")).cast("double")).alias("step"))
    return grid.select("r", "c", value, *carry).join(sent, ["r", "c"])


def d8(grid: DataFrame, res: float, value: str = "v") -> DataFrame:
    """(r, c, v, tr, tc): the neighbour with the steepest drop, first in order among equals; null where nothing is lower."""
    slope = (C(value) - C("nv")) / (C("step") * res)
    steep = with_neighbours(grid, value).withColumn("slope", slope).where(C("slope") > 0)
    best = steep.groupBy("r", "c").agg(F.max(F.struct("slope", (-C("k")).alias("o"), "nr", "nc")).alias("b"))
    return grid.join(best, ["r", "c"], "left").select("r", "c", C(value).alias("v"), C("b.nr").alias("tr"), C("b.nc").alias("tc"))


def flow_accumulation(directions: DataFrame, max_rounds: int = 64) -> DataFrame:
    """(r, c, acc): cells that drain through each cell, itself included.

    Pointer doubling: after round k each cell knows the total of the 2^k cells above it on
    every path and the cell 2^k steps down, so the rounds follow the logarithm of the longest path.
    """
    key = F.struct("r", "c")
    d = directions.select(key.alias("k"), F.when(C("tr").isNotNull(), F.struct(C("tr").alias("r"), C("tc").alias("c"))).alias("t"))
    state = cut(d.select("k", "t", F.lit(1).cast("long").alias("acc")))
    for _ in range(max_rounds):
        add = state.where(C("t").isNotNull()).groupBy(C("t").alias("k")).agg(F.sum("acc").alias("more"))
        down = state.select(C("k").alias("t"), C("t").alias("t2"))
        state = state.join(add, "k", "left").join(down, "t", "left").select("k", C("t2").alias("t"), (C("acc") + F.coalesce("more", F.lit(0))).alias("acc"))
        state = cut(state)
        if state.where(C("t").isNotNull()).isEmpty():
            return state.select("k.r", "k.c", "acc")
    raise ValueError(f"paths are longer than 2^{max_rounds} cells, or directions form a ring")


def height_above_drainage(directions: DataFrame, streams: DataFrame, max_rounds: int = 64) -> DataFrame:
    """(r, c, hand): height above the first stream cell downstream, at least 0, or above the last cell of a path without one. Pointer jumping."""
    s = streams.select("r", "c", F.lit(True).alias("stream"))
    d = directions.join(s, ["r", "c"], "left")
    own = F.struct("r", "c")
    goal = F.when(C("stream") | C("tr").isNull(), own).otherwise(F.struct(C("tr").alias("r"), C("tc").alias("c")))
    state = cut(d.select(own.alias("k"), goal.alias("t"), "v", F.coalesce("stream", F.lit(False)).alias("stream")))
    for _ in range(max_rounds):
        down = state.select(C("k").alias("t"), C("t").alias("t2"))
        now = cut(state.join(down, "t").select("k", C("t2").alias("t"), "v", "stream"))
        same = now.join(state.select("k", C("t").alias("was")), "k").where("t <> was").isEmpty()
        state = now
        if same:
            break
    else:
        raise ValueError(f"paths are longer than 2^{max_rounds} cells, or directions form a ring")
    end = state.select(C("k").alias("t"), C("v").alias("base"))
    return state.select("k", "t", "v").join(end, "t").select("k.r", "k.c", F.greatest(F.lit(0.0), C("v") - C("base")).alias("hand"))


def block_median(points: DataFrame, value: str, size: float, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, r, c, value): median of the points in each cell."""
    cells = points.where(C(value).isNotNull()).groupBy(*keys, F.floor(C("y") / size).alias("r"), F.floor(C("x") / size).alias("c"))
    return cells.agg(F.expr(f"percentile({value}, 0.5D)").alias("value"))


def zscore(cells: DataFrame, value: str, group: str) -> DataFrame:
    """Adds z: the value's distance from its group's mean in population standard deviations, 0 if these are 0."""
    stats = cells.groupBy(group).agg(F.avg(value).alias("__a"), F.stddev_pop(value).alias("__s"))
    return cells.join(F.broadcast(stats), group).withColumn("z", F.when(C("__s") == 0, 0.0).otherwise((C(value) - C("__a")) / C("__s"))).drop("__a", "__s")


def mosaic(first: DataFrame, second: DataFrame, value: str) -> DataFrame:
    """(r, c, value): the first grid's cells, and the second's where the first has none."""
    a, b = first.select("r", "c", C(value).alias("__a")), second.select("r", "c", C(value).alias("__b"))
    return a.join(b, ["r", "c"], "full_outer").select("r", "c", F.coalesce("__a", "__b").alias(value))


def fill_gaps(grid: DataFrame, most: float) -> DataFrame:
    """(r, c, v): cells without a value take that of the nearest cell with one, at most ``most`` cells away."""
    pts = grid.select(F.struct("r", "c").alias("code"), C("c").cast("double").alias("x"), C("r").cast("double").alias("y"), "v")
    near = nearest(pts.where("v is null"), pts.where("v is not null"), 1, carry=("v",), most=most)
    return grid.select(F.struct("r", "c").alias("a"), "r", "c", "v").join(near.select("a", "b_v"), "a", "left").select("r", "c", F.coalesce("v", "b_v").alias("v"))


def distance_transform(grid: DataFrame, features: DataFrame, res: float) -> DataFrame:
    """(r, c, dist): distance of each cell to the nearest feature cell."""
    pts = lambda g: g.select(F.struct("r", "c").alias("code"), C("c").cast("double").alias("x"), C("r").cast("double").alias("y"))
    near = nearest(pts(grid), pts(features), 1)
    return near.select("a.r", "a.c", (C("d") * res).alias("dist"))


def rasterise(segments: DataFrame, family: str) -> DataFrame:
    """Distinct (family, r, c) of the cells on each segment, one step a pixel along its longer side."""
    n = F.greatest(F.abs(C("r1") - C("r0")), F.abs(C("c1") - C("c0")))
    steps = segments.select(family, "r0", "c0", "r1", "c1", n.alias("n"), F.explode(F.sequence(F.lit(0), n)).alias("i"))
    at = lambda a, b: F.floor(C(a) + (C(b) - C(a)) * C("i") / F.greatest(C("n"), F.lit(1)) + 0.5).cast("int")
    return steps.select(family, at("r0", "r1").alias("r"), at("c0", "c1").alias("c")).distinct()


def family_intersections(cells: DataFrame, family: str, rows: int, cols: int) -> DataFrame:
    """(r, c) where cells of two families meet once each is dilated by a cross of one pixel."""
    cross = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in ((0, 0), (1, 0), (-1, 0), (0, 1), (0, -1))])
    wide = cells.select(family, "r", "c", F.explode(cross).alias("s")).select(family, (C("r") + C("s.i")).alias("r"), (C("c") + C("s.j")).alias("c"))
    inside = wide.where((C("r") >= 0) & (C("r") < rows) & (C("c") >= 0) & (C("c") < cols))
    return inside.groupBy("r", "c").agg(F.count_distinct(family).alias("k")).where("k >= 2").select("r", "c")


def bilinear(points: DataFrame, grid: DataFrame) -> DataFrame:
    """(id, value): grid values at fractional (pr, pc), weighted over the four corners; null unless all four are there."""
    base = points.select("id", "pr", "pc", F.floor("pr").cast("int").alias("r0"), F.floor("pc").cast("int").alias("c0"))
    corners = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (0, 1) for j in (0, 1)])
    four = base.select("*", F.explode(corners).alias("s"))
    fr, fc = C("pr") - C("r0"), C("pc") - C("c0")
    w = F.when(C("s.i") == 1, fr).otherwise(1 - fr) * F.when(C("s.j") == 1, fc).otherwise(1 - fc)
    four = four.select("id", (C("r0") + C("s.i")).alias("r"), (C("c0") + C("s.j")).alias("c"), w.alias("w"))
    got = four.join(grid.select("r", "c", "v"), ["r", "c"]).groupBy("id").agg(F.sum(C("w") * C("v")).alias("value"), F.count("v").alias("n"))
    return points.select("id").join(got, "id", "left").select("id", F.when(C("n") == 4, C("value")).alias("value"))
