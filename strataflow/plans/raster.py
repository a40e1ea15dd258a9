"""Terrain and raster queries."""

from __future__ import annotations

import dataclasses
import math

from pyspark.sql import functions as F

from strataflow.adapters import relation
from strataflow.operators import lineaments, metrics, raster, spatial, tiles
from strataflow.plans.registry import query
from strataflow.session import cut
from strataflow.sources import georaster

C = F.col
RES = 60.0


def grid(spark, sf_dir):
    return relation(spark, sf_dir, "grid")


def r6(c, name=None):
    return F.round(c, 6).alias(name or c)


def _side(along: str, across: str) -> str:
    o = f"over (partition by {across} order by {along})"
    return f"(case when lag(v) {o} is null and lead(v) {o} is null then 0 when lag(v) {o} is null then lead(v) {o} - v when lead(v) {o} is null then v - lag(v) {o} else (lead(v) {o} - lag(v) {o}) / 2 end) / 60"


GRAD = f", g as (select *, {_side('r', 'c')} as gr, {_side('c', 'r')} as gc from grid)"


@query("slope_northness", "grid", GRAD + " select r, c, round(degrees(atan(sqrt(gr * gr + gc * gc))), 6) as slope, round(cos(atan2(-gc, gr)), 6) as northness from g")
def slope_northness(spark, sf_dir):
    """Slope in degrees and northness."""
    g = raster.gradient(grid(spark, sf_dir), RES)
    return g.select("r", "c", r6(F.degrees(F.atan(F.hypot("gr", "gc"))), "slope"), r6(F.cos(F.atan2(-C("gc"), C("gr"))), "northness"))


@query("laplacian", "grid", """ select r, c, round((coalesce(lag(v) over (partition by c order by r), v) + coalesce(lead(v) over (partition by c order by r), v) + coalesce(lag(v) over (partition by r order by c), v) + coalesce(lead(v) over (partition by r order by c), v) - 4 * v) / 3600, 6) as curvature from grid""")
def laplacian(spark, sf_dir):
    """Curvature."""
    return raster.laplacian(grid(spark, sf_dir), RES).select("r", "c", r6("lap", "curvature"))


def _box(src: str, size: int, what: str) -> str:
    """A size x size window over ``src``, mirrored at the edges of the grid."""
    a = size // 2
    return f""" select s.r, s.c, {what} from (select g.r, g.c, pmod(g.r + i, 2 * h) as mr, pmod(g.c + j, 2 * w) as mc, h, w from {src} g, ext, (select unnest(range(-{a}, {size - a})) as i), (select unnest(range(-{a}, {size - a})) as j)) s
  join {src} n on n.r = case when mr < h then mr else 2 * h - 1 - mr end and n.c = case when mc < w then mc else 2 * w - 1 - mc end group by s.r, s.c""".replace("pmod(g.r + i, 2 * h)", "((g.r + i) % (2 * h) + 2 * h) % (2 * h)").replace("pmod(g.c + j, 2 * w)", "((g.c + j) % (2 * w) + 2 * w) % (2 * w)")


EXT = ", ext as (select max(r) + 1 as h, max(c) + 1 as w from grid)"


@query("tri", "grid", EXT + _box("grid", 3, "round(stddev_pop(n.v), 5) as tri"))
def tri(spark, sf_dir):
    """Ruggedness: population standard deviation in 3 x 3 windows mirrored at the edges."""
    b = raster.box_stats(grid(spark, sf_dir), 3)
    var = F.greatest(F.lit(0.0), C("s2") / C("n") - (C("s1") / C("n")) * (C("s1") / C("n")))
    return b.select("r", "c", F.round(F.sqrt(var), 5).alias("tri"))


def focal(source, sizes: dict[str, int]):
    """(r, c, and a mean for each window) of a raster's values."""
    out = None
    for name, size in sizes.items():
        one = raster.box_stats(source, size).select("r", "c", r6(C("s1") / C("n"), name))
        out = one if out is None else out.join(one, ["r", "c"])
    return out


@query("focal_mean", "grid", EXT + ", a as (" + _box("grid", 5, "avg(n.v) as m5") + "), b as (" + _box("grid", 6, "avg(n.v) as m6") + ") select r, c, round(m5, 6) as m5, round(m6, 6) as m6 from a join b using (r, c)")
def focal_mean(spark, sf_dir):
    """Means in windows of five and of six cells; an even window reaches further back."""
    return focal(grid(spark, sf_dir), {"m5": 5, "m6": 6})


#: Windows of focal means, in cells: twice the radius in metres over the resolution, and one.
FOCAL = {f"f{m}": max(3, int(2 * m / RES) + 1) for m in (250, 500, 1000)}


@query("focal_slope", "grid", GRAD + ", sl as (select r, c, degrees(atan(sqrt(gr * gr + gc * gc))) as v from g)" + EXT + "".join(f", {n} as (" + _box("sl", k, f"avg(n.v) as {n}") + ")" for n, k in FOCAL.items()) + " select r, c, " + ", ".join(f"round({n}, 6) as {n}" for n in FOCAL) + " from f250 join f500 using (r, c) join f1000 using (r, c)")
def focal_slope(spark, sf_dir):
    """Mean slope within 250, 500 and 1000 m."""
    slope = raster.gradient(grid(spark, sf_dir), RES).select("r", "c", F.degrees(F.atan(F.hypot("gr", "gc"))).alias("v"))
    return focal(slope, FOCAL)


AROUND = ", o(k, i, j) as (values (0, -1, -1), (1, -1, 0), (2, -1, 1), (3, 0, -1), (4, 0, 1), (5, 1, -1), (6, 1, 0), (7, 1, 1))"
# lowest levels that drain to the frame, relaxed until none falls
FILL = AROUND + """, frame as (select r, c, v from grid where (r, c) not in (select n.r - i, n.c - j from grid n, o group by all having count(*) = 8)),
fill as (with recursive f(r, c, h) using key (r, c) as (select r, c, v from frame union
  select n.r, n.c, min(greatest(n.v, f.h + 1e-4)) from f, o join grid n on n.r = f.r + i and n.c = f.c + j left join recurring.f as old on old.r = n.r and old.c = n.c
  where old.h is null or greatest(n.v, f.h + 1e-4) < old.h group by n.r, n.c) select r, c, h as v from f)"""


@query("priority_flood", "grid", FILL + " select grid.r, grid.c, grid.v, round(fill.v, 6) as filled from grid join fill using (r, c)")
def priority_flood(spark, sf_dir):
    """The terrain with its depressions filled so that every cell drains."""
    return tiles.fill_depressions(grid(spark, sf_dir)).select("r", "c", "v", r6("filled"))


def filled(spark, sf_dir):
    """The terrain that water runs over: without depressions."""
    return tiles.fill_depressions(grid(spark, sf_dir)).select("r", "c", C("filled").alias("v"))


D8 = FILL + """, drops as (select g.r, g.c, n.r as tr, n.c as tc, k, (g.v - n.v) / (sqrt(i * i + j * j) * 60) as slope from fill g, o join fill n on n.r = g.r + i and n.c = g.c + j where g.v > n.v),
d as (select * from (select *, row_number() over (partition by r, c order by slope desc, k) as rank from drops) where rank = 1)"""


@query("d8_direction", "grid", D8 + " select g.r, g.c, tr, tc from grid g left join d using (r, c)")
def d8_direction(spark, sf_dir):
    """Where each cell of the filled terrain drains to."""
    return raster.d8(filled(spark, sf_dir), RES).select("r", "c", "tr", "tc")


ACC = D8 + """, acc as (with recursive p(r, c, tr, tc) as (select r, c, r, c from grid union all select p.r, p.c, d.tr, d.tc from p join d on d.r = p.tr and d.c = p.tc) select tr as r, tc as c, count(*) as acc from p group by tr, tc)"""


@query("flow_accumulation", "grid", ACC + " select r, c, acc from acc")
def flow_accumulation(spark, sf_dir):
    """Cells that drain through each cell."""
    return raster.flow_accumulation(raster.d8(filled(spark, sf_dir), RES))


WET = ACC + ", wet as (select r, c from acc where acc * 3600 / 1e6 >= 0.02)"


def streams(directions):
    """Cells that drain 0.02 square kilometres or more."""
    return raster.flow_accumulation(directions).where(C("acc") * RES * RES / 1e6 >= 0.02).select("r", "c")


@query("stream_mask", "grid", WET + " select r, c from wet")
def stream_mask(spark, sf_dir):
    """Cells that drain 0.02 square kilometres or more."""
    return streams(raster.d8(filled(spark, sf_dir), RES))


@query("twi", "grid", ACC + GRAD + " select r, c, round(ln(acc * 60 / tan(radians(greatest(degrees(atan(sqrt(gr * gr + gc * gc))), 0.1)))), 6) as twi from acc join g using (r, c)")
def twi(spark, sf_dir):
    """Topographic wetness index: flow over the filled terrain, slope of the raw one."""
    acc = raster.flow_accumulation(raster.d8(filled(spark, sf_dir), RES))
    slope = F.greatest(F.degrees(F.atan(F.hypot("gr", "gc"))), F.lit(0.1))
    return acc.join(raster.gradient(grid(spark, sf_dir), RES), ["r", "c"]).select("r", "c", r6(F.log(C("acc") * RES / F.tan(F.radians(slope))), "twi"))


@query("hand", "grid", WET + """, down as (with recursive p(r, c, tr, tc) as (select r, c, r, c from grid union all select p.r, p.c, d.tr, d.tc from p join d on d.r = p.tr and d.c = p.tc where not exists (select 1 from wet where wet.r = p.tr and wet.c = p.tc))
  select p.r, p.c, p.tr, p.tc from p where exists (select 1 from wet where wet.r = p.tr and wet.c = p.tc) or not exists (select 1 from d where d.r = p.tr and d.c = p.tc))
select g.r, g.c, round(greatest(0, g.v - b.v), 6) as hand from fill g join down on down.r = g.r and down.c = g.c join fill b on b.r = down.tr and b.c = down.tc""")
def hand(spark, sf_dir):
    """Height above the nearest stream cell downstream on the filled terrain, or above the end of a path that meets none."""
    d = cut(raster.d8(filled(spark, sf_dir), RES))
    return raster.height_above_drainage(d, streams(d)).select("r", "c", r6("hand"))


@query("drainage_density", "grid", WET + ", m as (select grid.r, grid.c, case when wet.r is null then 0.0 else 1.0 end as v from grid left join wet on wet.r = grid.r and wet.c = grid.c)" + EXT + _box("m", 33, "round(avg(n.v), 6) as density"))
def drainage_density(spark, sf_dir):
    """Share of stream cells in windows of 2 km."""
    wet = stream_mask(spark, sf_dir).withColumn("wet", F.lit(1.0))
    mask = grid(spark, sf_dir).join(wet, ["r", "c"], "left").select("r", "c", F.coalesce("wet", F.lit(0.0)).alias("v"))
    return focal(mask, {"density": int(2000 / RES)})


@query("drainage_distance", "grid", WET + " select g.r, g.c, round(60 * min(sqrt((g.r - w.r) * (g.r - w.r) + (g.c - w.c) * (g.c - w.c))), 6) as dist from grid g, wet w group by g.r, g.c")
def drainage_distance(spark, sf_dir):
    """Distance to the nearest stream cell."""
    return raster.distance_transform(grid(spark, sf_dir), stream_mask(spark, sf_dir), RES).select("r", "c", r6("dist"))


@query("distance_transform", "grid", """, f as (select r, c from grid where v > 1000 and (r * 7 + c) % 11 = 0), d as (select g.r, g.c, min(sqrt((g.r - f.r) * (g.r - f.r) + (g.c - f.c) * (g.c - f.c))) as d from grid g, f group by g.r, g.c) select r, c, round(d * 60, 6) as dist from d""")
def distance_transform(spark, sf_dir):
    """Distance to the nearest feature cell."""
    g = grid(spark, sf_dir)
    return raster.distance_transform(g, g.where("v > 1000 and (r * 7 + c) % 11 = 0"), RES).select("r", "c", r6("dist"))


@query("hillshade", "grid", GRAD + ", s as (select *, pi() / 2 - atan(sqrt(gr * gr + gc * gc)) as steep, atan2(-gr, gc) as aspect from g) select r, c, round(sin(radians(45)) * sin(steep) + cos(radians(45)) * cos(steep) * cos(radians(315) - pi() / 2 - aspect), 6) as shade from s")
def hillshade(spark, sf_dir):
    """Shading under a sun at 315 degrees, 45 degrees high."""
    g = raster.gradient(grid(spark, sf_dir), RES)
    steep, aspect, h = math.pi / 2 - F.atan(F.hypot("gr", "gc")), F.atan2(-C("gr"), C("gc")), math.radians(45)
    return g.select("r", "c", r6(math.sin(h) * F.sin(steep) + math.cos(h) * F.cos(steep) * F.cos(math.radians(315) - math.pi / 2 - aspect), "shade"))


@query("ght_tilt", "grid", GRAD + ", t as (select *, sqrt(gr * gr + gc * gc) as ght from g) select r, c, round(ght, 6) as ght, round(atan2(v / 1000, greatest(ght, 1e-9)), 6) as tilt from t")
def ght_tilt(spark, sf_dir):
    """Total horizontal gradient, and the tilt angle with a given vertical component."""
    g = raster.gradient(grid(spark, sf_dir), RES).withColumn("ght", F.hypot("gr", "gc"))
    return g.select("r", "c", r6("ght"), r6(F.atan2(C("v") / 1000, F.greatest(C("ght"), F.lit(1e-9))), "tilt"))


GAPS = ", holes as (select r, c, case when (r * 13 + c * 7) % 9 < 4 then null else v end as v from grid)"


def holes(spark, sf_dir):
    return grid(spark, sf_dir).withColumn("v", F.when((C("r") * 13 + C("c") * 7) % 9 >= 4, C("v")))


@query("gap_fill", "grid", GAPS + """, near as (select a.r, a.c, b.v, row_number() over (partition by a.r, a.c order by sqrt((a.r - b.r) * (a.r - b.r) + (a.c - b.c) * (a.c - b.c)), b.r, b.c) as k from holes a join holes b on a.v is null and b.v is not null and abs(a.r - b.r) <= 4 and abs(a.c - b.c) <= 4 and (a.r - b.r) * (a.r - b.r) + (a.c - b.c) * (a.c - b.c) <= 16)
select h.r, h.c, coalesce(h.v, n.v) as v from holes h left join (select * from near where k = 1) n using (r, c)""")
def gap_fill(spark, sf_dir):
    """Gaps filled from the nearest cell within four cells."""
    return raster.fill_gaps(holes(spark, sf_dir), 4.0)


@query("bilinear_resample", "grid", """, p as (select r * 100 + c as id, r * 0.7 + 0.3 as pr, c * 0.9 + 0.2 as pc from grid), b as (select *, floor(pr) as r0, floor(pc) as c0 from p),
j as (select id, sum((case when g.r = r0 then 1 - (pr - r0) else pr - r0 end) * (case when g.c = c0 then 1 - (pc - c0) else pc - c0 end) * v) as value, count(*) as n from b join grid g on g.r between r0 and r0 + 1 and g.c between c0 and c0 + 1 group by id)
select p.id, round(case when n = 4 then value end, 6) as value from p left join j using (id)""")
def bilinear_resample(spark, sf_dir):
    """The grid read at fractional places."""
    g = grid(spark, sf_dir)
    p = g.select((C("r") * 100 + C("c")).alias("id"), (C("r") * 0.7 + 0.3).alias("pr"), (C("c") * 0.9 + 0.2).alias("pc"))
    return raster.bilinear(p, g).select("id", r6("value"))


@query("raster_lookup", "wells grid", " select code, v from wells w left join grid g on g.r = cast(floor(w.y / 1500) as int) and g.c = cast(floor(w.x / 1500) as int)")
def raster_lookup(spark, sf_dir):
    """The grid cell under each well."""
    w = relation(spark, sf_dir, "wells").select("code", F.floor(C("y") / 1500).cast("int").alias("r"), F.floor(C("x") / 1500).cast("int").alias("c"))
    return w.join(grid(spark, sf_dir), ["r", "c"], "left").select("code", "v")


@query("downsample", "grid", " select r, c, v from grid where r % 4 = 0 and c % 4 = 0")
def downsample(spark, sf_dir):
    """Every fourth cell."""
    return grid(spark, sf_dir).where("r % 4 = 0 and c % 4 = 0")


@query("depth_to_elevation", "wells grid", " select code, round(v - depth_m, 6) as elevation from wells w join grid g on g.r = cast(floor(w.y / 1500) as int) and g.c = cast(floor(w.x / 1500) as int)")
def depth_to_elevation(spark, sf_dir):
    """Ground level less depth."""
    w = relation(spark, sf_dir, "wells").select("code", "depth_m", F.floor(C("y") / 1500).cast("int").alias("r"), F.floor(C("x") / 1500).cast("int").alias("c"))
    return w.join(grid(spark, sf_dir), ["r", "c"]).select("code", r6(C("v") - C("depth_m"), "elevation"))


@query("delta_depth", "wells grid", """, blocks as (select floor(x / 20000) as bx, floor(y / 20000) as bb, quantile_cont(depth_m - 10 * z, 0.5) as delta, count(*) as n from wells where depth_m - 10 * z > 0 and depth_m - 10 * z < 300 group by all having n >= 8),
ctr as (select cast(bx * 100 + bb as bigint) as code, (bx + 0.5) * 20000 as x, (bb + 0.5) * 20000 as y, delta from blocks), cells as (select r, c, (c + 0.5) * 1500 as x, (r + 0.5) * 1500 as y, v from grid),
p as (select cells.r, cells.c, cells.v, delta, sqrt((cells.x - ctr.x) * (cells.x - ctr.x) + (cells.y - ctr.y) * (cells.y - ctr.y)) as d, code from cells, ctr), k as (select *, row_number() over (partition by r, c order by d, code) as rank from p)
select r, c, round(greatest(20, least(160, max(v) / 50 + sum(delta / pow(greatest(d, 1), 2)) / sum(1 / pow(greatest(d, 1), 2)))), 6) as depth from k where rank <= 4 group by r, c""")
def delta_depth(spark, sf_dir):
    """Recommended depth: a surface plus the block medians of productive depth, interpolated from the four nearest blocks and clipped."""
    delta = C("depth_m") - 10 * C("z")
    w = relation(spark, sf_dir, "wells").where((delta > 0) & (delta < 300))
    b = w.groupBy(F.floor(C("x") / 20000).alias("bx"), F.floor(C("y") / 20000).alias("bb")).agg(F.percentile(delta, F.lit(0.5)).alias("delta"), F.count("*").alias("n")).where("n >= 8")
    ctr = b.select((C("bx") * 100 + C("bb")).alias("code"), ((C("bx") + 0.5) * 20000).alias("x"), ((C("bb") + 0.5) * 20000).alias("y"), "delta")
    cells = grid(spark, sf_dir).select(F.struct("r", "c").alias("code"), ((C("c") + 0.5) * 1500).alias("x"), ((C("r") + 0.5) * 1500).alias("y"), "v", F.lit(0.0).alias("delta"))
    near = spatial.nearest(cells, ctr.withColumn("v", F.lit(0.0)), 4, carry=("delta", "v"))
    got = spatial.inverse_distance(near, "b_delta", 2.0, keys=("a", "a_v"))
    return got.select("a.r", "a.c", r6(F.greatest(F.lit(20.0), F.least(F.lit(160.0), C("a_v") / 50 + C("value"))), "depth"))


@query("water_table", "wells grid", """, w as (select code, x, y, static_sheet as s from wells where static_sheet between 0 and 120), cells as (select r, c, (c + 0.5) * 1500 as x, (r + 0.5) * 1500 as y, v from grid),
p as (select cells.r, cells.c, cells.v, s, sqrt((cells.x - w.x) * (cells.x - w.x) + (cells.y - w.y) * (cells.y - w.y)) as d, code from cells, w), k as (select *, row_number() over (partition by r, c order by d, code) as rank from p)
select r, c, round(max(v) - greatest(0, sum(s / pow(greatest(d, 1), 2)) / sum(1 / pow(greatest(d, 1), 2))), 6) as head from k where rank <= 12 group by r, c""")
def water_table(spark, sf_dir):
    """Ground level less the interpolated depth to water, which is held at 0 or more."""
    w = relation(spark, sf_dir, "wells").where("static_sheet between 0 and 120").select("code", "x", "y", C("static_sheet").alias("s"), F.lit(0.0).alias("v"))
    cells = grid(spark, sf_dir).select(F.struct("r", "c").alias("code"), ((C("c") + 0.5) * 1500).alias("x"), ((C("r") + 0.5) * 1500).alias("y"), F.lit(0.0).alias("s"), "v")
    near = spatial.nearest(cells, w, 12, carry=("s", "v"))
    got = spatial.inverse_distance(near, "b_s", 2.0, keys=("a", "a_v"))
    return got.select("a.r", "a.c", r6(C("a_v") - F.greatest(F.lit(0.0), C("value")), "head"))


@query("vertical_derivative")
def vertical_derivative(spark, sf_dir):
    """First vertical derivative of the whole raster."""
    return tiles.vertical_derivative(grid(spark, sf_dir), RES).select("r", "c", r6("value"))


@query("tilt_angle")
def tilt_angle(spark, sf_dir):
    """Tilt: the angle of the vertical derivative against the total horizontal gradient."""
    g = raster.gradient(grid(spark, sf_dir), RES).select("r", "c", F.hypot("gr", "gc").alias("ght"))
    return g.join(tiles.vertical_derivative(grid(spark, sf_dir), RES), ["r", "c"]).select("r", "c", r6("ght"), r6(F.atan2(C("value"), F.greatest(C("ght"), F.lit(1e-9))), "tilt"))


#: The grid's own place, and that of a coarse raster of 4 x 4 cells of another origin.
FINE = georaster.Place(0.0, 0.0, RES, RES, 50, 40)
COARSE = georaster.Place(-RES * 7 / 15, -RES * 7 / 15, 4 * RES, 4 * RES, 14, 11)


def coarse(spark, sf_dir):
    """Means of the grid's cells by the coarse cell that their centre lies in, without the ones below 935."""
    g = grid(spark, sf_dir).select(F.floor((C("r") + 0.5 + 7 / 15) / 4).cast("int").alias("r"), F.floor((C("c") + 0.5 + 7 / 15) / 4).cast("int").alias("c"), "v")
    return georaster.Raster(g.groupBy("r", "c").agg(F.avg("v").alias("v")).withColumn("v", F.when(C("v") >= 935, C("v"))), COARSE)


def on_the_grid(spark, sf_dir):
    """The grid with as many rows as it has."""
    g = grid(spark, sf_dir)
    rows = (g.agg(F.max("r")).first()[0] or 0) + 1
    return georaster.Raster(g.select("r", "c", "v"), dataclasses.replace(FINE, rows=rows))


@query("raster_align", "grid", """, w as (select cast(floor((r + 0.5 + 7.0 / 15) / 4) as int) as r, cast(floor((c + 0.5 + 7.0 / 15) / 4) as int) as c, avg(v) as v from grid group by 1, 2), k as (select * from w where v >= 935),
size as (select max(r) + 1 as n from grid), t as (select cast(i // 40 as int) as r, cast(i % 40 as int) as c from (select unnest(range(0, (select n * 40 from size))) as i)),
p as (select r, c, (r + 0.5 + 7.0 / 15) / 4 - 0.5 as pr, (c + 0.5 + 7.0 / 15) / 4 - 0.5 as pc from t),
j as (select p.r, p.c, sum((1 - abs(pr - k.r)) * (1 - abs(pc - k.c)) * v) / sum((1 - abs(pr - k.r)) * (1 - abs(pc - k.c))) as v, max(case when k.r = floor(pr + 0.5) and k.c = floor(pc + 0.5) then 1 else 0 end) as near
  from p join k on k.r between floor(pr) and floor(pr) + 1 and k.c between floor(pc) and floor(pc) + 1 group by p.r, p.c)
select p.r, p.c, round(case when near = 1 then v end, 6) as v from p left join j using (r, c)""")
def raster_align(spark, sf_dir):
    """A coarse raster with another origin and gaps, on the cells of the grid."""
    got = georaster.align(coarse(spark, sf_dir), on_the_grid(spark, sf_dir).place)
    return got.cells.select("r", "c", r6("v"))


@query("raster_zoom", "grid", """, s as (select max(r) + 1 as n from grid), t as (select cast(i // 80 as int) as r, cast(i % 80 as int) as c from (select unnest(range(0, (select n * 2 * 80 from s))) as i)),
p as (select r, c, r * (n - 1.0) / (2 * n - 1) as pr, c * 39.0 / 79 as pc from t, s),
j as (select p.r, p.c, sum((1 - abs(pr - g.r)) * (1 - abs(pc - g.c)) * v) / sum((1 - abs(pr - g.r)) * (1 - abs(pc - g.c))) as v, max(case when g.r = floor(pr + 0.5) and g.c = floor(pc + 0.5) then 1 else 0 end) as near
  from p join grid g on g.r between floor(pr) and floor(pr) + 1 and g.c between floor(pc) and floor(pc) + 1 group by p.r, p.c)
select p.r, p.c, round(case when near = 1 then v end, 6) as v from p left join j using (r, c)""")
def raster_zoom(spark, sf_dir):
    """The grid on twice as many rows and columns."""
    return georaster.zoom(on_the_grid(spark, sf_dir), 2.0).cells.select("r", "c", r6("v"))


#: Suns that edges are looked for under, and scales of segments.
SUNS, SCALES = (315.0, 45.0), (lineaments.Scale(8, 2), lineaments.Scale(16, 4))


def shaded(spark, sf_dir, sun):
    """Shading between 0 and 1 under a sun 45 degrees high."""
    g = raster.gradient(grid(spark, sf_dir), RES)
    steep, aspect, h = math.pi / 2 - F.atan(F.hypot("gr", "gc")), F.atan2(-C("gr"), C("gc")), math.radians(45)
    shade = math.sin(h) * F.sin(steep) + math.cos(h) * F.cos(steep) * F.cos(math.radians(sun) - math.pi / 2 - aspect)
    return g.select("r", "c", F.greatest(F.lit(0.0), F.least(F.lit(1.0), shade)).alias("v"))


@query("lineament_extract")
def lineament_extract(spark, sf_dir):
    """Straight segments along the edges of the shaded terrain, for two suns and two scales, without those along the border."""
    lit = None
    for k, sun in enumerate(SUNS):
        one = shaded(spark, sf_dir, sun).withColumn("sun", F.lit(k))
        lit = one if lit is None else lit.unionByName(one)
    peaks = cut(lineaments.gradient_peaks(lit.select(C("sun").alias("key"), "r", "c", "v"), 1.0))
    bar = metrics.quantiles(peaks, "g", [0.8, 0.95], ["low", "high"], ("key",))
    mask = cut(lineaments.hysteresis(peaks.join(bar, "key"), C("low"), C("high")))
    n = len(SCALES)
    keyed = mask.select(F.explode(F.array(*[C("key") * n + k for k in range(n)])).alias("key"), "r", "c")
    found = lineaments.inside_frame(lineaments.extract(keyed, [s for _ in SUNS for s in SCALES]), grid(spark, sf_dir), 4)
    return found.select(F.floor(C("key") / n).cast("int").alias("sun"), (C("key") % n).cast("int").alias("scale"), "r0", "c0", "r1", "c1")
