"""Predictability ceilings: neighbour AUC, variograms, nuggets, zones."""

from __future__ import annotations

from pyspark.sql import functions as F

from strataflow.adapters import relation
from strataflow.functions.geometry import block
from strataflow.operators import metrics, pair_moments, resample, spatial, variogram
from strataflow.operators.nugget_intervals import Given, nugget_intervals, poisson
from strataflow.operators.raster import cell_number
from strataflow.plans.registry import query
from strataflow.session import cut

RADII = (250, 500, 1000, 2000)

# Brute-force nearest neighbours for the oracles.
NEAR = """, t as (select quantile_cont(z, 0.75) as q from wells), pts as (select code, x, y, z, case when z >= q then 1 else 0 end as y1 from wells, t),
pairs as (select a.code as a, b.code as b, a.y1, b.z as bz, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) as d
  from pts a join pts b on a.code <> b.code and abs(a.x - b.x) <= 2000 and abs(a.y - b.y) <= 2000),
ranked as (select *, row_number() over (partition by a order by d, b) as rank from pairs where d <= 2000)"""

AUC_SQL = """cells as (select {k}, score, sum(y1) as pos, sum(1 - y1) as neg from {src} group by {k}, score),
run as (select *, sum(neg) over (partition by {k} order by score rows between unbounded preceding and current row) - neg as below from cells),
aucs as (select {k}, cast(sum(pos + neg) as bigint) as n, cast(sum(pos) as bigint) as positives, round(sum(pos * (below + neg / 2.0)) / nullif(sum(pos) * sum(neg), 0), 6) as auc from run group by {k})"""


def targets(spark, sf_dir):
    """Wells with the binary target: z at or above its upper quartile. Checkpointed, as a search reads them many times."""
    w = relation(spark, sf_dir, "wells").select("code", "x", "y", "z")
    q = metrics.quantiles(w, "z", [0.75], ["q"])
    return cut(w.crossJoin(F.broadcast(q)).withColumn("y1", (F.col("z") >= F.col("q")).cast("int")).drop("q"))


def neighbours(spark, sf_dir, k: int, radius: float | None = 2000.0):
    """(a, b, d, rank, y1 of a, z of b) of the ``k`` nearest neighbours, within ``radius`` if one is given."""
    w = targets(spark, sf_dir)
    return spatial.nearest(w, w, k, carry=("z", "y1"), exclude_self=True, most=radius).select("a", "b", "d", F.col("a_y1").alias("y1"), F.col("b_z").alias("bz"), "rank")


def _rounded(df):
    return df.withColumn("auc", F.round("auc", 6)).withColumn("n", F.col("n").cast("long")).withColumn("positives", F.col("positives").cast("long"))


@query("knn_auc_by_radius", "wells", NEAR + ", " + "near as (select radius, y1, bz as score from ranked, (values (250), (500), (1000), (2000)) r(radius) where rank = 1 and d <= radius), " + AUC_SQL.format(k="radius", src="near") + " select radius, n, auc from aucs where n >= 30")
def knn_auc_by_radius(spark, sf_dir):
    """AUC of the nearest neighbour's value for the target, by cumulative radius, where 30 wells or more have one."""
    near = neighbours(spark, sf_dir, 1)
    by = near.select(F.explode(F.array(*[F.when(F.col("d") <= r, F.lit(r)) for r in RADII])).alias("radius"), "y1", F.col("bz").alias("score")).where("radius is not null")
    return _rounded(metrics.auc(by, "y1", "score", keys=("radius",))).where("n >= 30").select("radius", "n", "auc")


KS = (1, 3, 5, 10)


@query("knn_auc_k", "wells", NEAR + """, kk as (select a, y1, radius, k, round(sum(bz / greatest(d, 1)) / sum(1 / greatest(d, 1)), 9) as score
  from ranked, (values (250), (500), (1000), (2000)) r(radius), (values (1), (3), (5), (10)) v(k) where rank <= k and d <= radius group by a, y1, radius, k), """ + AUC_SQL.format(k="radius, k", src="kk") + " select radius, k, n, positives, auc from aucs where n >= 30 and auc is not null")
def knn_auc_k(spark, sf_dir):
    """AUC of the distance-weighted mean of the k nearest values, of these the ones within a radius, for each k and radius with 30 wells and both classes."""
    choices = F.explode(F.array(*[F.when((F.col("rank") <= k) & (F.col("d") <= r), F.struct(F.lit(r).alias("radius"), F.lit(k).alias("k"))) for k in KS for r in RADII])).alias("c")
    near = neighbours(spark, sf_dir, max(KS)).select("a", "y1", "bz", "d", choices).where("c is not null").select("a", "y1", "bz", "d", "c.*")
    score = spatial.inverse_distance(near, "bz", 1.0, keys=("a", "y1", "radius", "k")).withColumn("score", F.round("value", 9))
    return _rounded(metrics.auc(score, "y1", "score", keys=("radius", "k"))).where("n >= 30 and auc is not null").select("radius", "k", "n", "positives", "auc")


FAR = """, t as (select quantile_cont(z, 0.75) as q from wells), pts as (select code, x, y, z, case when z >= q then 1 else 0 end as y1 from wells, t),
ranked as (select a.code as a, a.y1, b.z as bz, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) as d, row_number() over (partition by a.code order by sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)), b.code) as rank
  from pts a join pts b on a.code <> b.code)"""


@query("auc_distance_bands", "wells", FAR + """, near as (select case when d <= 250 then 0 when d <= 500 then 250 when d <= 1000 then 500 when d <= 2000 then 1000 else 2000 end as band, y1, bz as score from ranked where rank = 1 and d > 0), """ + AUC_SQL.format(k="band", src="near") + " select band, n, positives, auc, round(positives / n, 6) as prevalence from aucs where n >= 30 and auc is not null")
def auc_distance_bands(spark, sf_dir):
    """AUC and prevalence by the distance band of the nearest neighbour, named by its lower end; the last one is open. Neighbours at the same place are in none."""
    near = neighbours(spark, sf_dir, 1, None).where("d > 0")
    band = F.when(F.col("d") <= 250, 0).when(F.col("d") <= 500, 250).when(F.col("d") <= 1000, 500).when(F.col("d") <= 2000, 1000).otherwise(2000)
    got = _rounded(metrics.auc(near.select(band.alias("band"), "y1", F.col("bz").alias("score")), "y1", "score", keys=("band",)))
    return got.where("n >= 30 and auc is not null").select("band", "n", "positives", "auc", F.round(F.col("positives") / F.col("n"), 6).alias("prevalence"))


LAG_CASE = "case " + " ".join(f"when d > {a} and d <= {b} then {b}" for a, b in zip(variogram.LAGS, variogram.LAGS[1:], strict=False)) + " end"
PAIRS = """, pairs as (select a.code as a, b.code as b, a.z as az, b.z as bz, a.x as ax, a.y as ay, b.x as bx, b.y as by_, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) as d
  from {src} a join {src} b on a.code < b.code and abs(a.x - b.x) <= 16000 and abs(a.y - b.y) <= 16000),
bins as (select *, """ + LAG_CASE + """ as lag, (az - bz) * (az - bz) / 2 as g from pairs where d > 0 and d <= 16000)"""
THIN = variogram.LEAST_PAIRS


def bins(points, value="z", directional=False):
    """The bins with THIN pairs or more."""
    return pair_moments.moment_bins(points, value, directional=directional).where(F.col("pairs") >= THIN).drop("opened")


@query("variogram", "wells", PAIRS.format(src="wells") + " select lag, count(*) as pairs, round(avg(g), 6) as gamma from bins group by lag having count(*) >= 100")
def variogram_query(spark, sf_dir):
    """Empirical semivariogram of z up to 16 km, without thin bins."""
    w = relation(spark, sf_dir, "wells").select("code", "x", "y", "z")
    return bins(w).withColumn("gamma", F.round("gamma", 6))


TREND = """, m as (select avg(x) as mx, avg(y) as my, avg(z) as mz from wells),
s as (select sum((x-mx)*(x-mx)) as uu, sum((x-mx)*(y-my)) as uv, sum((y-my)*(y-my)) as vv, sum((x-mx)*(z-mz)) as ut, sum((y-my)*(z-mz)) as vt, sum((z-mz)*(z-mz)) as tt from wells, m),
b as (select (ut*vv - vt*uv) / (uu*vv - uv*uv) as bx, (vt*uu - ut*uv) / (uu*vv - uv*uv) as by_, ut, vt, tt from s),
res as (select code, x, y, z - (mz + bx * (x - mx) + by_ * (y - my)) as z from wells, m, b)"""


@query("variogram_detrended", "wells", TREND + PAIRS.format(src="res") + ", v as (select var_pop(z) as sill from res) select lag, count(*) as pairs, round(avg(g), 6) as gamma, round(avg(g) / max(sill), 6) as of_sill from bins, v group by lag having count(*) >= 100")
def variogram_detrended(spark, sf_dir):
    """Semivariogram of the residuals from a plane, and its share of their variance."""
    w = variogram.detrend(relation(spark, sf_dir, "wells").select("code", "x", "y", "z"), "z")
    sill = F.broadcast(w.agg(F.var_pop("z").alias("sill")))
    v = bins(w).crossJoin(sill)
    return v.select("lag", "pairs", F.round("gamma", 6).alias("gamma"), F.round(F.col("gamma") / F.col("sill"), 6).alias("of_sill"))


@query("linear_trend", "wells", TREND + " select round(bx * 1e6, 6) as bx_per_km2, round(by_ * 1e6, 6) as by_per_km2, round((bx * ut + by_ * vt) / tt, 6) as r2 from b")
def linear_trend(spark, sf_dir):
    """The plane through z, and its R2."""
    t = variogram.linear_trend(relation(spark, sf_dir, "wells").select("code", "x", "y", "z"), "z")
    return t.select(F.round(F.col("bx") * 1e6, 6).alias("bx_per_km2"), F.round(F.col("by") * 1e6, 6).alias("by_per_km2"), F.round("r2", 6).alias("r2"))


DIRECTION = "case when azim < 22.5 or azim >= 157.5 then 'N-S' when azim < 67.5 then 'NE-SW' when azim < 112.5 then 'E-W' else 'NW-SE' end"
AZ = "(degrees(atan2(bx - ax, by_ - ay)) + 360) % 180"


@query("variogram_directional", "wells", PAIRS.format(src="wells") + f", dirs as (select *, {DIRECTION} as direction from (select *, {AZ} as azim from bins)), v as (select var_pop(z) as sill from wells) select direction, lag, count(*) as pairs, round(avg(g), 6) as gamma, round(100 * avg(g) / max(sill), 4) as pct_sill from dirs, v group by direction, lag having count(*) >= 100")
def variogram_directional(spark, sf_dir):
    """Semivariogram by four directions, as a percentage of the global variance."""
    w = relation(spark, sf_dir, "wells").select("code", "x", "y", "z")
    sill = F.broadcast(w.agg(F.var_pop("z").alias("sill")))
    v = bins(w, directional=True).crossJoin(sill)
    return v.select("direction", "lag", "pairs", F.round("gamma", 6).alias("gamma"), F.round(100 * F.col("gamma") / F.col("sill"), 4).alias("pct_sill"))


@query("nugget_fraction", "wells", PAIRS.format(src="wells") + ", v as (select lag, count(*) as pairs, avg(g) as gamma from bins group by lag having count(*) >= 100), f as (select * from v order by lag limit 1) select lag, pairs, round(least(1, gamma / sill), 6) as nugget, round(1 - least(1, gamma / sill), 6) as r2_max from f, (select var_pop(z) as sill from wells)")
def nugget_fraction(spark, sf_dir):
    """Nugget as a share of the variance at the first lag with 100 pairs, and the R2 it leaves."""
    w = relation(spark, sf_dir, "wells").select("code", "x", "y", "z")
    n = variogram.nugget(bins(w), w, "z")
    return n.withColumn("nugget", F.round("nugget", 6)).withColumn("r2_max", F.round("r2_max", 6))


@query("first_valid_lag", "wells", PAIRS.format(src="wells") + ", v as (select lag, count(*) as pairs from bins group by lag), ok as (select min(lag) as first_lag from v where pairs >= 100) select first_lag, (select count(*) from v where lag < first_lag) as n_discarded from ok")
def first_valid_lag(spark, sf_dir):
    """The shortest lag with 100 pairs, and how many shorter ones were passed over."""
    v = pair_moments.moment_bins(relation(spark, sf_dir, "wells").select("code", "x", "y", "z"), "z").select("lag", "pairs")
    found = v.agg(F.min(F.when(F.col("pairs") >= 100, F.col("lag"))).alias("first_lag"), F.collect_set("lag").alias("lags"))
    return found.select("first_lag", F.size(F.filter("lags", lambda x: x < F.col("first_lag"))).cast("long").alias("n_discarded"))


@query("radius_pairs", "wells", """, pairs as (select a.code as a, b.code as b, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) as d from wells a join wells b on a.code < b.code and abs(a.x - b.x) <= 500 and abs(a.y - b.y) <= 500)
select a, b, round(d, 6) as d from pairs where d <= 500""")
def radius_pairs(spark, sf_dir):
    """Pairs of wells at most 500 m apart."""
    return spatial.radius_pairs(relation(spark, sf_dir, "wells").select("code", "x", "y"), 500.0).select("a", "b", F.round("d", 6).alias("d"))


@query("knn_pairs", "wells", """, pairs as (select a.code as a, b.code as b, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) as d from wells a join wells b on a.code <> b.code),
r as (select *, row_number() over (partition by a order by d, b) as rank from pairs) select a, b, cast(rank as int) as rank, round(d, 6) as d from r where rank <= 3""")
def knn_pairs(spark, sf_dir):
    """The three nearest wells of each well, at any distance."""
    w = relation(spark, sf_dir, "wells").select("code", "x", "y")
    return spatial.nearest(w, w, 3, exclude_self=True).select("a", "b", F.col("rank").cast("int").alias("rank"), F.round("d", 6).alias("d"))


def zone_medians(spark, sf_dir, size: float, least: int):
    """Block medians of z with at least ``least`` wells: bx, by, n, med."""
    w = relation(spark, sf_dir, "wells").select(block(F.col("x"), size).alias("bx"), block(F.col("y"), size).alias("by_"), "z")
    return w.groupBy("bx", "by_").agg(F.count("*").alias("n"), F.expr("percentile(z, 0.5D)").alias("med")).where(F.col("n") >= least)


ZONES = """, zones as (select floor(x / 4000) as bx, floor(y / 4000) as by_, count(*) as n, quantile_cont(z, 0.5) as med from wells group by 1, 2 having count(*) >= 2)"""


@query("zone_ceiling", "wells", ZONES + """, t as (select quantile_cont(med, 0.75) as q from zones), pts as (select bx, by_, med, case when med >= q then 1 else 0 end as y1 from zones, t),
pairs as (select a.bx, a.by_, a.y1, a.med as am, b.med as score, row_number() over (partition by a.bx, a.by_ order by (a.bx-b.bx)*(a.bx-b.bx)+(a.by_-b.by_)*(a.by_-b.by_), b.bx, b.by_) as rank from pts a join pts b on (a.bx <> b.bx or a.by_ <> b.by_) and abs(a.bx-b.bx) <= 1 and abs(a.by_-b.by_) <= 1),
near as (select 1 as k, y1, am, score from pairs where rank = 1), """ + AUC_SQL.format(k="k", src="near") + " select n, positives, auc, (select round(corr(am, score), 6) from near) as r from aucs")
def zone_ceiling(spark, sf_dir):
    """AUC of an adjacent block's median for the block's own, on 4 km blocks with two wells or more."""
    z = zone_medians(spark, sf_dir, 4000.0, 2)
    z = z.crossJoin(F.broadcast(metrics.quantiles(z, "med", [0.75], ["q"]))).withColumn("y1", (F.col("med") >= F.col("q")).cast("int"))
    around = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1) if i or j])
    a = z.select(F.struct("bx", "by_").alias("own"), "y1", F.col("med").alias("am"), F.explode(around).alias("s"), "bx", "by_").select("own", "y1", "am", (F.col("bx") + F.col("s.i")).alias("bx"), (F.col("by_") + F.col("s.j")).alias("by_"), (F.col("s.i") * F.col("s.i") + F.col("s.j") * F.col("s.j")).alias("d2"))
    near = a.join(z.select("bx", "by_", F.col("med").alias("score")), ["bx", "by_"]).withColumn("rank", F.expr("row_number() over (partition by own order by d2, bx, by_)")).where("rank = 1")
    return _rounded(metrics.auc(near, "y1", "score")).crossJoin(near.agg(F.round(F.corr("am", "score"), 6).alias("r")))


#: Block size in metres and the wells that a block needs; blocks that a setting needs.
ZONE_SETTINGS, LEAST_ZONES = ((1000, 3), (2000, 4), (2000, 6), (4000, 6), (4000, 10)), 30


def _zones_sql(size: int, least: int) -> str:
    z, km = f"z{size}_{least}", size / 1000
    return f""", {z} as (select *, row_number() over (order by bx, by_) as code from (select floor(x / {size}) as bx, floor(y / {size}) as by_, count(*) as n, quantile_cont(z, 0.5) as med from wells group by 1, 2 having count(*) >= {least})),
{z}t as (select *, case when med >= (select quantile_cont(med, 0.75) from {z}) then 1 else 0 end as y1 from {z}),
{z}n as (select y1, am, score from (select a.y1, a.med as am, b.med as score, row_number() over (partition by a.bx, a.by_ order by (a.bx - b.bx) * (a.bx - b.bx) + (a.by_ - b.by_) * (a.by_ - b.by_), b.bx, b.by_) as rank from {z}t a join {z}t b on a.code <> b.code) where rank = 1),
{z}r as (select score, pos, neg, sum(neg) over (order by score rows between unbounded preceding and current row) - neg as below from (select score, sum(y1) as pos, sum(1 - y1) as neg from {z}n group by score)),
{z}g as (select avg((a.med - b.med) * (a.med - b.med) / 2) as g from {z} a join {z} b on a.code <> b.code and (a.bx - b.bx) * (a.bx - b.bx) + (a.by_ - b.by_) * (a.by_ - b.by_) <= 2.25),
{z}o as (select cast({km} as double) as size_km, {least} as least, n, case when n >= 30 then (select round(sum(pos * (below + neg / 2.0)) / nullif(sum(pos) * sum(neg), 0), 6) from {z}r) end as auc,
  case when n >= 30 then (select round(least(1, g / (select var_samp(med) from {z})), 6) from {z}g) end as nugget, case when n >= 30 then (select round(corr(am, score), 6) from {z}n) end as r from (select count(*) as n from {z}))"""


@query("zone_ceilings", "wells", "".join(_zones_sql(*s) for s in ZONE_SETTINGS) + " " + " union all ".join(f"select * from z{s}_{n}o" for s, n in ZONE_SETTINGS))
def zone_ceilings(spark, sf_dir):
    """AUC and correlation of the nearest block's median, and the nugget of adjacent blocks, for five block sizes and least numbers of wells; null below 30 blocks.

    The settings lie side by side on one plane, a long way apart, so that one search serves all.
    """
    w = relation(spark, sf_dir, "wells").select("x", "y", "z")
    setting = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(s).alias("size"), F.lit(n).alias("least")) for k, (s, n) in enumerate(ZONE_SETTINGS)])).alias("s")
    keyed = w.select("x", "y", "z", setting).select("s.*", F.floor(F.col("x") / F.col("s.size")).alias("bx"), F.floor(F.col("y") / F.col("s.size")).alias("by_"), "z")
    z = metrics.median(keyed, "z", ("k", "least", "bx", "by_")).where("n >= least")
    z = cut(z.join(metrics.quantiles(z, "med", [0.75], ["q"], ("k",)), "k").withColumn("y1", (F.col("med") >= F.col("q")).cast("int")))
    apart = 10.0 * (z.agg(F.max(F.abs("bx")) + F.max(F.abs("by_"))).first()[0] or 0) + 1000
    pts = cut(z.select(F.struct("k", "bx", "by_").alias("code"), (F.col("bx") + F.col("k") * apart).alias("x"), F.col("by_").cast("double").alias("y"), "k", "med", "y1"))
    near = spatial.nearest(pts, pts, 1, carry=("k", "med", "y1"), exclude_self=True).where("a_k = b_k").select(F.col("a_k").alias("k"), F.col("a_y1").alias("y1"), F.col("a_med").alias("am"), F.col("b_med").alias("score"))
    near = cut(near)
    g = (F.col("a_med") - F.col("b_med")) * (F.col("a_med") - F.col("b_med")) / 2
    beside = spatial.cross_pairs(pts, pts, 1.5, carry=("k", "med")).where("a <> b").groupBy(F.col("a_k").alias("k")).agg(F.avg(g).alias("g"))
    whole = spark.createDataFrame([(k, s / 1000, n) for k, (s, n) in enumerate(ZONE_SETTINGS)], "k int, size_km double, least int")
    for part in (pts.groupBy("k").agg(F.count("*").alias("n"), F.var_samp("med").alias("s")), beside, near.groupBy("k").agg(F.corr("am", "score").alias("r")), metrics.auc(near, "y1", "score", keys=("k",)).select("k", "auc")):
        whole = whole.join(part, "k", "left")
    known = lambda c: F.when(F.col("n") >= LEAST_ZONES, F.round(c, 6))
    return whole.select("size_km", "least", F.coalesce("n", F.lit(0)).alias("n"), known(F.col("auc")).alias("auc"), known(F.least(F.lit(1.0), F.col("g") / F.col("s"))).alias("nugget"), known(F.col("r")).alias("r"))


@query("bootstrap_auc_by_well", "wells", NEAR + """, reps as (select unnest(range(0, 20)) as rep), wt as (select rep, code, cast((code * 31 + rep * 17 + code * rep) % 4 as double) as c from wells, reps),
near as (select wa.rep, y1, bz as score, wa.c from ranked join wt wa on wa.code = a join wt wb on wb.code = b and wb.rep = wa.rep where rank = 1 and wa.c > 0 and wb.c > 0),
cells as (select rep, score, sum(c * y1) as pos, sum(c * (1 - y1)) as neg from near group by rep, score),
run as (select *, sum(neg) over (partition by rep order by score rows between unbounded preceding and current row) - neg as below from cells),
aucs as (select rep, sum(pos * (below + neg / 2)) / nullif(sum(pos) * sum(neg), 0) as auc from run group by rep)
select count(auc) as reps, case when count(auc) >= 10 then round(quantile_cont(auc, 0.025), 6) end as low, case when count(auc) >= 10 then round(quantile_cont(auc, 0.975), 6) end as high from aucs""")
def bootstrap_auc_by_well(spark, sf_dir):
    """Interval of the nearest neighbour's AUC with wells drawn by given weights: a row counts where both wells are drawn, as often as its own well."""
    near = neighbours(spark, sf_dir, 1).select("a", "b", "y1", F.col("bz").alias("score"))
    return well_bootstrap(near, resample.GivenDraw(), 20).select(F.col("n_valid").alias("reps"), F.round("low", 6).alias("low"), F.round("high", 6).alias("high"))


def well_bootstrap(near, draw, repetitions):
    """Interval of the AUC over repetitions, for rows (a, b, y1, score): a row counts as often as a is drawn, where b is."""
    return resample.interval(resample.auc_by_repetition(cut(near), "y1", "score", "a", draw, repetitions, ("b",)), "auc")


@query("bootstrap_neighbour_auc")
def bootstrap_neighbour_auc(spark, sf_dir, repetitions=1000):
    """The same interval with wells drawn by Poisson weights in a thousand repetitions."""
    near = neighbours(spark, sf_dir, 1).select("a", "b", "y1", F.col("bz").alias("score"))
    return well_bootstrap(near, resample.PoissonDraw(3), repetitions)


@query("adjacent_block_nugget", "wells", ZONES + """, pairs as (select (a.med - b.med) * (a.med - b.med) / 2 as g from zones a join zones b on (a.bx <> b.bx or a.by_ <> b.by_) and sqrt((a.bx-b.bx)*(a.bx-b.bx)+(a.by_-b.by_)*(a.by_-b.by_)) <= 1.5)
select count(*) as pairs, round(least(1, avg(g) / (select var_samp(med) from zones)), 6) as nugget from pairs""")
def adjacent_block_nugget(spark, sf_dir):
    """Half squared difference of adjacent block medians over their sample variance."""
    z = zone_medians(spark, sf_dir, 4000.0, 2)
    pts = z.select(F.struct("bx", "by_").alias("code"), F.col("bx").cast("double").alias("x"), F.col("by_").cast("double").alias("y"), "med")
    pairs = spatial.cross_pairs(pts, pts, 1.5, carry=("med",)).where("a <> b")
    g = (F.col("a_med") - F.col("b_med")) * (F.col("a_med") - F.col("b_med")) / 2
    return pairs.agg(F.count("*").alias("pairs"), F.avg(g).alias("g")).crossJoin(z.agg(F.var_samp("med").alias("s"))).select("pairs", F.round(F.least(F.lit(1.0), F.col("g") / F.col("s")), 6).alias("nugget"))


@query("idw_grid", "wells grid", """, cells as (select r * 100000 + c as code, (c + 0.5) * 1500 as x, (r + 0.5) * 1500 as y from grid),
pairs as (select g.code as a, b.code as b, b.z, sqrt((g.x - b.x) * (g.x - b.x) + (g.y - b.y) * (g.y - b.y)) as d from cells g, wells b), r as (select *, row_number() over (partition by a order by d, b) as rank from pairs)
select a as cell, round(sum(z / pow(greatest(d, 1), 2)) / sum(1 / pow(greatest(d, 1), 2)), 6) as value from r where rank <= 12 group by a""")
def idw_grid(spark, sf_dir):
    """Inverse-distance mean of the twelve nearest wells on each grid cell."""
    cells = relation(spark, sf_dir, "grid").select(cell_number().alias("code"), ((F.col("c") + 0.5) * 1500).alias("x"), ((F.col("r") + 0.5) * 1500).alias("y"), F.lit(0.0).alias("z"))
    near = spatial.nearest(cells, relation(spark, sf_dir, "wells").select("code", "x", "y", "z"), 12, carry=("z",))
    return spatial.inverse_distance(near, "b_z", 2.0).select(F.col("a").alias("cell"), F.round("value", 6).alias("value"))


#: Lags of the nugget's intervals.
NEAR_LAGS = (0, 250, 500, 1000, 2000)


@query("nugget_intervals_fixed", "wells", """, pairs as (select a.code as a, b.code as b, (a.z - b.z) * (a.z - b.z) / 2 as g, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) as d from wells a join wells b on a.code < b.code and abs(a.x - b.x) <= 2000 and abs(a.y - b.y) <= 2000),
bins as (select a, b, g, case when d <= 250 then 250 when d <= 500 then 500 when d <= 1000 then 1000 else 2000 end as lag from pairs where d > 0 and d <= 2000),
reps as (select unnest(range(0, 20)) as rep),
own as (select lag, count(*) as pairs, least(1, avg(g) / max(v)) as nugget, max(v) as v from bins, (select var_pop(z) as v from wells) group by lag having count(*) >= 100),
drawn as (select lag, rep, g, cast((a * 31 + rep * 17 + a * rep) % 4 as double) * ((b * 31 + rep * 17 + b * rep) % 4) as w, cast((a * 31 + b * 17 + rep * (a + b)) % 4 as double) as p from bins, reps),
gammas as (select lag, rep, sum(p * g) / nullif(sum(p), 0) as gp, sum(w * g) / nullif(sum(w), 0) as gw from drawn group by lag, rep),
sill as (select rep, sum(c * t * t) / sum(c) - pow(sum(c * t) / sum(c), 2) as sill from (select rep, z - (select avg(z) from wells) as t, cast((code * 31 + rep * 17 + code * rep) % 4 as double) as c from wells, reps) group by rep),
ends as (select lag, case when count(gp) >= 10 then quantile_cont(least(1, gp / v), 0.025) end as lp, case when count(gp) >= 10 then quantile_cont(least(1, gp / v), 0.975) end as hp,
  case when count(gw) >= 10 then quantile_cont(case when gw is not null then least(1, gw / sill) end, 0.025) end as lw, case when count(gw) >= 10 then quantile_cont(case when gw is not null then least(1, gw / sill) end, 0.975) end as hw
  from gammas join sill using (rep) join own using (lag) group by lag)
select cast(lag as int) as lag, pairs, round(nugget, 6) as nugget, round(lp, 6) as low_pairs, round(hp, 6) as high_pairs, round(lw, 6) as low_wells, round(hw, 6) as high_wells, round(1 - nugget, 6) as r2_max from own left join ends using (lag)""")
def nugget_intervals_fixed(spark, sf_dir):
    """Nugget by lag with both intervals, pairs and wells drawn by given weights."""
    w = relation(spark, sf_dir, "wells").select("code", "x", "y", "z")
    got = nugget_intervals(w, "z", NEAR_LAGS, 20, Given(), Given())
    return got.select("lag", "pairs", *[F.round(c, 6).alias(c) for c in got.columns[2:]])


def first_valid_lag(points, value="z"):
    """The ends of the first lag that holds LEAST_PAIRS pairs, of the last lag where none does; found from cell moments."""
    lags = variogram.LAGS
    first = pair_moments.moment_bins(points, value).where(F.col("pairs") >= variogram.LEAST_PAIRS).agg(F.min("lag")).first()[0]
    return lags[lags.index(first) - 1 : lags.index(first) + 1] if first is not None else lags[-2:]


@query("nugget_intervals")
def nugget_intervals_drawn(spark, sf_dir, repetitions=2000):
    """Nugget at the first valid lag, of the values and of their residuals from the plane, with intervals over drawn pairs and over drawn wells."""
    w = relation(spark, sf_dir, "wells").select("code", "x", "y", "z")
    lags = first_valid_lag(w)  # detrending moves no pair to another lag
    both = [nugget_intervals(p, "z", lags, repetitions, poisson(11), poisson(12)).select(F.lit(name).alias("variant"), "*") for name, p in (("raw", w), ("detrended", variogram.detrend(w, "z")))]
    return both[0].unionByName(both[1])
