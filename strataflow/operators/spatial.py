"""Spatial joins over points in metres: radius pairs, nearest neighbours, inverse-distance weights, blocks.

Points fall into square cells, so that each join is an equi-join on cells with an exact
distance test behind it; no side is ever joined with all of the other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataflow.session import cut


def distance(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    return F.sqrt((ax - bx) * (ax - bx) + (ay - by) * (ay - by))


def _cell(v: Column, size: float) -> Column:
    return F.floor(v / F.lit(float(size)))


def cross_pairs(left: DataFrame, right: DataFrame, radius: float, carry: tuple[str, ...] = ()) -> DataFrame:
    """(a, b, d, and ``carry`` of both sides) of all pairs at most ``radius`` apart, a from ``left`` and b from ``right``.

    Both sides have code, x, y; each left point looks into the nine cells around it. Rows
    without coordinates pair with nothing.
    """
    l_cols = [F.col("code").alias("a"), F.col("x").alias("ax"), F.col("y").alias("ay"), *[F.col(c).alias(f"a_{c}") for c in carry]]
    r_cols = [F.col("code").alias("b"), F.col("x").alias("bx"), F.col("y").alias("by"), *[F.col(c).alias(f"b_{c}") for c in carry]]
    lhs = left.where("x is not null and y is not null").select(*l_cols)
    rhs = right.where("x is not null and y is not null").select(*r_cols)
    steps = F.array(*[F.lit(i) for i in (-1, 0, 1)])
    lhs = lhs.withColumn("i", F.explode(steps)).withColumn("j", F.explode(steps))
    lhs = lhs.withColumn("cx", _cell(F.col("ax"), radius) + F.col("i")).withColumn("cy", _cell(F.col("ay"), radius) + F.col("j")).drop("i", "j")
    rhs = rhs.withColumn("cx", _cell(F.col("bx"), radius)).withColumn("cy", _cell(F.col("by"), radius))
    d = distance(F.col("ax"), F.col("ay"), F.col("bx"), F.col("by"))
    met = lhs.join(rhs, ["cx", "cy"]).withColumn("d", d).where(F.col("d") <= radius)
    return met.drop("cx", "cy")


def radius_pairs(points: DataFrame, radius: float, carry: tuple[str, ...] = ()) -> DataFrame:
    """Each unordered pair of different codes at most ``radius`` apart once, with a < b, d, and the coordinates.

    A point looks into its own cell and four of the eight around it, so that a pair meets once.
    """
    cols = lambda s: [F.col("code").alias(s), F.col("x").alias(f"{s}x"), F.col("y").alias(f"{s}y"), *[F.col(c).alias(f"{s}_{c}") for c in carry]]
    have = points.where("x is not null and y is not null")
    half = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in ((0, 0), (1, -1), (1, 0), (1, 1), (0, 1))])
    lhs = have.select(*cols("p"), F.explode(half).alias("s"))
    lhs = lhs.withColumn("cx", _cell(F.col("px"), radius) + F.col("s.i")).withColumn("cy", _cell(F.col("py"), radius) + F.col("s.j")).withColumn("own", (F.col("s.i") == 0) & (F.col("s.j") == 0)).drop("s")
    rhs = have.select(*cols("q")).withColumn("cx", _cell(F.col("qx"), radius)).withColumn("cy", _cell(F.col("qy"), radius))
    met = lhs.join(rhs, ["cx", "cy"]).where((F.col("p") != F.col("q")) & (~F.col("own") | (F.col("p") < F.col("q"))))
    met = met.withColumn("d", distance(F.col("px"), F.col("py"), F.col("qx"), F.col("qy"))).where(F.col("d") <= radius)
    first = F.col("p") < F.col("q")
    out = [F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b"), "d"]
    for c in ("x", "y"):
        out += [F.when(first, F.col(f"p{c}")).otherwise(F.col(f"q{c}")).alias(f"a{c}"), F.when(first, F.col(f"q{c}")).otherwise(F.col(f"p{c}")).alias(f"b{c}")]
    for c in carry:
        out += [F.when(first, F.col(f"p_{c}")).otherwise(F.col(f"q_{c}")).alias(f"a_{c}"), F.when(first, F.col(f"q_{c}")).otherwise(F.col(f"p_{c}")).alias(f"b_{c}")]
    return met.select(*out)


def both_ways(pairs: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """Unordered pairs as (a, b, d) in both directions."""
    there = ["a", "b", "d", *[f"a_{c}" for c in carry], *[f"b_{c}" for c in carry]]
    back = [F.col("b").alias("a"), F.col("a").alias("b"), "d", *[F.col(f"b_{c}").alias(f"a_{c}") for c in carry], *[F.col(f"a_{c}").alias(f"b_{c}") for c in carry]]
    return pairs.select(*there).unionByName(pairs.select(*back))


#: Cells of a level along one side of a cell of the level above.
FAN = 4
#: Levels of the pyramid at most: the finest cells are then FAN ** DEPTH times smaller than the extent.
DEPTH = 12


def _levels(points: DataFrame, side: float, x0: float, y0: float, per_cell: float) -> int:
    """The first level whose occupied cells hold ``per_cell`` points or fewer on average."""
    cell = lambda d: F.struct(F.floor((F.col("x") - x0) / (side / FAN**d)), F.floor((F.col("y") - y0) / (side / FAN**d)))
    got = points.agg(F.count("*"), *[F.approx_count_distinct(cell(d)) for d in range(1, DEPTH + 1)]).first()
    return next((d for d in range(1, DEPTH + 1) if got[0] <= per_cell * max(got[d], 1)), DEPTH)


def nearest(left: DataFrame, right: DataFrame, k: int, carry: tuple[str, ...] = (), exclude_self: bool = False, most: float | None = None, differ: str | None = None) -> DataFrame:
    """The ``k`` nearest right points of each left point: (a, b, d, rank, coordinates, ``carry``), ties by code.

    Right points are counted in a pyramid of occupied cells. Each left point goes down from
    its root: of a level's cells, the nearest that hold k points by their farthest corners
    bound the distance of its k-th neighbour, and only cells that begin within that bound are
    opened at the next level. So a point meets the points of a few fine cells, wherever it
    lies, and no radius is guessed. ``most`` is the largest distance, ``differ`` a carried
    column whose values have to differ, such as a fold. Rows without coordinates have no
    neighbours; a left point gets fewer than ``k`` where there are no more.
    """
    have = "x is not null and y is not null"
    l_cols = [F.col("code").alias("a"), F.col("x").alias("ax"), F.col("y").alias("ay"), *[F.col(c).alias(f"a_{c}") for c in carry]]
    r_cols = [F.col("code").alias("b"), F.col("x").alias("bx"), F.col("y").alias("by"), *[F.col(c).alias(f"b_{c}") for c in carry]]
    targets, points = left.where(have).select(*l_cols), right.where(have)
    box = points.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
    x0, y0 = (float(box[0]), float(box[2])) if box[0] is not None else (0.0, 0.0)
    side = max(float(box[1]) - x0, float(box[3]) - y0, 1e-6) * (1 + 1e-9) if box[0] is not None else 1.0
    need = k + int(exclude_self)
    depth = _levels(points, side, x0, y0, max(need / 2, 2.0))
    group = F.col(differ) if differ else F.lit(0)
    size = side / FAN**depth
    placed = points.select(*r_cols, F.floor((F.col("x") - x0) / size).alias("cx"), F.floor((F.col("y") - y0) / size).alias("cy"), group.alias("g"))
    boxes = lambda frame, keys: frame.groupBy(*keys).agg(*(f(c).alias(c) for f, c in ((F.sum, "n"), (F.min, "x1"), (F.max, "x2"), (F.min, "y1"), (F.max, "y2"))))
    finest = cut(boxes(placed.select("cx", "cy", "g", F.lit(1).alias("n"), F.col("bx").alias("x1"), F.col("bx").alias("x2"), F.col("by").alias("y1"), F.col("by").alias("y2")), ["cx", "cy", "g"]))

    kept = targets.withColumns({"px": F.lit(0).cast("long"), "py": F.lit(0).cast("long")})
    names = targets.columns
    for d in range(1, depth + 1):
        up = FAN ** (depth - d)
        cells = finest if up == 1 else boxes(finest.withColumns({"cx": F.floor(F.col("cx") / up), "cy": F.floor(F.col("cy") / up)}), ["cx", "cy", "g"])
        cells = cells.withColumns({"px": F.floor(F.col("cx") / FAN), "py": F.floor(F.col("cy") / FAN)})
        met = kept.join(cells, ["px", "py"] if d == 1 else ["px", "py", "g"])
        if differ and d == 1:
            met = met.where(F.col(f"a_{differ}") != F.col("g"))
        dx = F.greatest(F.col("x1") - F.col("ax"), F.col("ax") - F.col("x2"), F.lit(0.0))
        dy = F.greatest(F.col("y1") - F.col("ay"), F.col("ay") - F.col("y2"), F.lit(0.0))
        fx = F.greatest(F.abs(F.col("ax") - F.col("x1")), F.abs(F.col("ax") - F.col("x2")))
        fy = F.greatest(F.abs(F.col("ay") - F.col("y1")), F.abs(F.col("ay") - F.col("y2")))
        met = met.withColumns({"near": F.sqrt(dx * dx + dy * dy), "far": F.sqrt(fx * fx + fy * fy)})
        if most is not None:
            met = met.where(F.col("near") <= most)
        held = met.withColumn("held", F.expr("sum(n) over (partition by a order by far, cx, cy, g rows between unbounded preceding and current row)"))
        bound = held.withColumn("bound", F.expr(f"min(case when held >= {need} then far end) over (partition by a)"))
        kept = bound.where(F.col("bound").isNull() | (F.col("near") <= F.col("bound") * (1 + 1e-9) + 1e-9)).select(*names, F.col("cx").alias("px"), F.col("cy").alias("py"), "g")

    met = kept.withColumnsRenamed({"px": "cx", "py": "cy"}).join(placed, ["cx", "cy", "g"]).withColumn("d", distance(F.col("ax"), F.col("ay"), F.col("bx"), F.col("by")))
    if exclude_self:
        met = met.where("a <> b")
    if most is not None:
        met = met.where(F.col("d") <= most)
    ranked = met.withColumn("rank", F.expr("row_number() over (partition by a order by d, b)")).where(F.col("rank") <= k)
    return ranked.drop("cx", "cy", "g")


def inverse_distance(neighbours: DataFrame, value: str, power: float = 2.0, keys: tuple[str, ...] = ("a",), least: float = 1.0) -> DataFrame:
    """Weighted mean of ``value`` over each point's neighbours, with weights 1 / max(d, least)^power."""
    w = 1.0 / F.pow(F.greatest(F.col("d"), F.lit(least)), F.lit(float(power)))
    return neighbours.groupBy(*keys).agg((F.sum(w * F.col(value)) / F.sum(w)).alias("value"))
