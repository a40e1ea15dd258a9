"""Derivation of the hydraulic target from well records."""

from __future__ import annotations

from pyspark.sql import functions as F

from strataflow.adapters import relation
from strataflow.functions import fuzzy, hydraulics
from strataflow.functions.geometry import block, direction_class, utm_forward, utm_inverse
from strataflow.operators import metrics
from strataflow.operators import quality_control as qc
from strataflow.operators.ordering import numbered
from strataflow.plans.registry import query

C = F.col


def wells(spark, sf_dir):
    return relation(spark, sf_dir, "wells")


def levels(spark, sf_dir):
    """Wells with levels reconciled over both sources."""
    w = wells(spark, sf_dir)
    return w.withColumn("static", hydraulics.reconcile(C("static_sheet"), C("static_cadastre"))).withColumn("dynamic", hydraulics.reconcile(C("dynamic_sheet"), C("dynamic_cadastre")))


LEVELS = ", lv as (select *, coalesce(static_sheet, static_cadastre) as static, coalesce(dynamic_sheet, dynamic_cadastre) as dynamic from wells)"


@query("level_reconcile", "wells", LEVELS + " select code, static, dynamic, coalesce(abs(static_sheet - static_cadastre) > 1, false) as static_differs, coalesce(abs(dynamic_sheet - dynamic_cadastre) > 1, false) as dynamic_differs from lv")
def level_reconcile(spark, sf_dir):
    """Levels from the sheet, else the cadastre, flagged where both are there and differ by over a metre."""
    return levels(spark, sf_dir).select("code", "static", "dynamic", hydraulics.diverges(C("static_sheet"), C("static_cadastre")).alias("static_differs"), hydraulics.diverges(C("dynamic_sheet"), C("dynamic_cadastre")).alias("dynamic_differs"))


@query("test_flags", "wells", LEVELS + " select code, array_to_string(list_filter([case when dynamic <= static then 'level_order' end, case when flow <= 0 then 'no_flow' end, case when hours < 4 then 'short_test' end], lambda v: v is not null), ';') as flags from lv")
def test_flags(spark, sf_dir):
    """Why a pumping test is doubtful."""
    return levels(spark, sf_dir).select("code", F.array_join(hydraulics.test_flags(C("static"), C("dynamic"), C("flow"), C("hours")), ";").alias("flags"))


QS = LEVELS + """, parts as (select *, case when flow > 0 and dynamic > static then flow / (dynamic - static) end as computed, case when qs_sheet > 0 then qs_sheet end as s2, case when qs_cadastre > 0 then qs_cadastre end as s3 from lv),
qs as (select *, coalesce(computed, s2, s3) as q, case when computed is not null then 'computed' when s2 is not null then 'sheet' when s3 is not null then 'cadastre' end as source, coalesce(abs(computed - s2) / s2 > 0.2, false) as inconsistent from parts)"""


def capacities(spark, sf_dir):
    got = hydraulics.specific_capacity(C("flow"), C("static"), C("dynamic"), C("qs_sheet"), C("qs_cadastre"))
    return levels(spark, sf_dir).withColumn("c", got).select("*", C("c.qs").alias("q"), C("c.source").alias("source"), C("c.inconsistent").alias("inconsistent")).drop("c")


@query("qs_cascade", "wells", QS + " select code, round(q, 6) as qs, source, inconsistent from qs")
def qs_cascade(spark, sf_dir):
    """Specific capacity from the test, the sheet or the cadastre, in this order."""
    return capacities(spark, sf_dir).select("code", F.round("q", 6).alias("qs"), "source", "inconsistent")


INTAKE = LEVELS + """, ints as (select code, min(case when lithology = 'fractured_rock' then top_m end) as s_top, max(case when lithology = 'fractured_rock' then base_m end) as s_base, sum(case when lithology = 'fractured_rock' then thick_m end) as s_len,
  max(case when lithology in ('soil', 'alluvium') then base_m end) as casing from intervals group by code),
intake as (select w.code, static, depth_m, case when s_top is not null then 'screens' when casing < depth_m then 'open_hole' when static < depth_m then 'saturated_column' else 'undefined' end as kind,
  case when s_top is not null then s_top when casing < depth_m then casing when static < depth_m then static end as top, case when s_top is not null then s_base when casing < depth_m or static < depth_m then depth_m end as base,
  case when s_top is not null then s_len when casing < depth_m then depth_m - casing when static < depth_m then depth_m - static end as len from lv w left join ints using (code))"""


def intakes(spark, sf_dir):
    """Intake interval by hierarchy: screens, open hole below the casing, saturated column, undefined."""
    i = relation(spark, sf_dir, "intervals")
    screen, cased = C("lithology") == "fractured_rock", C("lithology").isin("soil", "alluvium")
    agg = i.groupBy("code").agg(F.min(F.when(screen, C("top_m"))).alias("s_top"), F.max(F.when(screen, C("base_m"))).alias("s_base"), F.sum(F.when(screen, C("thick_m"))).alias("s_len"), F.max(F.when(cased, C("base_m"))).alias("casing"))
    open_hole, column = C("casing") < C("depth_m"), C("static") < C("depth_m")
    return levels(spark, sf_dir).join(agg, "code", "left").select(
        "code", "static", "depth_m", "domain", "z",
        F.when(C("s_top").isNotNull(), "screens").when(open_hole, "open_hole").when(column, "saturated_column").otherwise("undefined").alias("kind"),
        F.when(C("s_top").isNotNull(), C("s_top")).when(open_hole, C("casing")).when(column, C("static")).alias("top"),
        F.when(C("s_top").isNotNull(), C("s_base")).when(open_hole | column, C("depth_m")).alias("base"),
        F.when(C("s_top").isNotNull(), C("s_len")).when(open_hole, C("depth_m") - C("casing")).when(column, C("depth_m") - C("static")).alias("len"),
    )


@query("intake_interval", "wells intervals", INTAKE + " select code, kind, top, base, len from intake")
def intake_interval(spark, sf_dir):
    """Where a well takes in water, by the first source that says so."""
    return intakes(spark, sf_dir).select("code", "kind", "top", "base", "len")


@query("saturated_thickness", "wells intervals", INTAKE + " select code, case when base is not null and top is not null and static is not null then greatest(0, base - greatest(static, top)) end as thickness from intake")
def saturated_thickness(spark, sf_dir):
    """Length of the intake below the water level."""
    got = hydraulics.saturated_thickness(C("static"), C("top"), C("base"))
    return intakes(spark, sf_dir).select("code", F.when(C("base").isNotNull() & C("top").isNotNull() & C("static").isNotNull(), got).alias("thickness"))


@query("transmissivity", "wells", QS + ", rel(domain, a, b) as (values ('porous', 0.8, 1.1), ('karstic', 1.2, 0.9)) select code, round(a * pow(24 * q, b), 6) as t from qs join rel using (domain) where q is not null")
def transmissivity(spark, sf_dir):
    """Transmissivity by the domain's power law."""
    rel = spark.createDataFrame([("porous", 0.8, 1.1), ("karstic", 1.2, 0.9)], "domain string, a double, b double")
    return capacities(spark, sf_dir).where("q is not null").join(F.broadcast(rel), "domain").select("code", F.round(hydraulics.transmissivity(C("q"), C("a"), C("b")), 6).alias("t"))


@query("mad_outliers", "wells", """, m as (select domain, quantile_cont(z, 0.5) as med, count(z) as n from wells group by domain), d as (select w.*, med, n, abs(z - med) as dev from wells w join m using (domain)), a as (select domain, quantile_cont(dev, 0.5) as mad from d group by domain)
select code, domain, round(dev / mad, 6) as deviations from d join a using (domain) where n >= 30 and mad > 0 and dev / mad > 3""")
def mad_outliers(spark, sf_dir):
    """Wells over three median absolute deviations from their domain's median."""
    return qc.mad_outliers(wells(spark, sf_dir), "z", "domain").select("code", "domain", F.round(C("dev") / C("mad"), 6).alias("deviations"))


QUART = ", q as (select quantile_cont(z, 0.25) as q1, quantile_cont(z, 0.5) as q2, quantile_cont(z, 0.75) as q3 from wells)"


@query("quantile_classes", "wells", QUART + " select code, case when z <= q1 then 'low' when z <= q2 then 'medium' when z <= q3 then 'high' else 'very_high' end as class, case when z >= q3 then 1 else 0 end as target from wells, q")
def quantile_classes(spark, sf_dir):
    """Right-closed quartile classes, and the target that is 1 from the upper quartile on."""
    q = F.broadcast(metrics.quantiles(wells(spark, sf_dir), "z", [0.25, 0.5, 0.75], ["q1", "q2", "q3"]))
    c = F.when(C("z") <= C("q1"), "low").when(C("z") <= C("q2"), "medium").when(C("z") <= C("q3"), "high").otherwise("very_high")
    return wells(spark, sf_dir).crossJoin(q).select("code", c.alias("class"), (C("z") >= C("q3")).cast("int").alias("target"))


FUZZY_COLUMNS = [("depth_m", False), ("z", False), ("flow", False), ("static_sheet", True), ("hours", True)]


@query("fuzzy_gamma", "wells", ", q as (select " + ", ".join(f"quantile_cont({c}, 0.02) as a{i}, quantile_cont({c}, 0.98) as b{i}" for i, (c, _) in enumerate(FUZZY_COLUMNS)) + " from wells), m as (select code, " + ", ".join(f"case when {c} is null then 0.5 else {'1 - ' if inv else ''}greatest(0, least(1, ({c} - a{i}) / (b{i} - a{i}))) end as m{i}" for i, (c, inv) in enumerate(FUZZY_COLUMNS)) + " from wells, q) select code, round(pow(1 - (1-m0)*(1-m1)*(1-m2)*(1-m3)*(1-m4), 0.9) * pow(m0*m1*m2*m3*m4, 0.1), 6) as favourability from m")
def fuzzy_gamma(spark, sf_dir):
    """Fuzzy gamma of five memberships between the 2 % and 98 % quantiles."""
    return fuzzy.gamma_score(wells(spark, sf_dir), FUZZY_COLUMNS, "favourability").select("code", F.round("favourability", 6).alias("favourability"))


@query("median_impute", "wells", ", m as (select quantile_cont(flow, 0.5) as f, quantile_cont(static_sheet, 0.5) as s from wells) select code, coalesce(flow, f) as flow, coalesce(static_sheet, s) as static_sheet, coalesce(qs_sheet, (select quantile_cont(qs_sheet, 0.5) from wells)) as qs_sheet from wells, m")
def median_impute(spark, sf_dir):
    """Missing values replaced by their column's exact median."""
    return fuzzy.impute_median(wells(spark, sf_dir), ["flow", "static_sheet", "qs_sheet"]).select("code", "flow", "static_sheet", "qs_sheet")


@query("block_key", "wells", " select code, cast(floor((x - 30000) / 10000) as bigint) as bx, cast(floor((y - 30000) / 10000) as bigint) as block_y from wells")
def block_key(spark, sf_dir):
    """Ten-kilometre blocks around a centre, negative ones included."""
    return wells(spark, sf_dir).select("code", block(C("x") - 30000, 10000).alias("bx"), block(C("y") - 30000, 10000).alias("block_y"))


@query("block_fold_map", "wells", """, b as (select distinct floor(x / 10000) as bx, floor(y / 10000) as bb from wells), f as (select bx, bb, (row_number() over (order by bx, bb) - 1) % 5 as fold from b)
select w.code, cast(fold as int) as fold from wells w join f on floor(w.x / 10000) = bx and floor(w.y / 10000) = bb""")
def block_fold_map(spark, sf_dir):
    """Folds dealt to blocks in turn, and the blocks' folds on the wells."""
    w = wells(spark, sf_dir).select("code", block(C("x"), 10000).alias("bx"), block(C("y"), 10000).alias("bb"))
    folds = numbered(w.select("bx", "bb").distinct(), "bx", "bb").select("bx", "bb", (C("place") % 5).cast("int").alias("fold"))
    return w.join(folds, ["bx", "bb"]).select("code", "fold")


@query("hydraulic_head", "wells grid", LEVELS + ", cell as (select lv.*, cast(floor(y / 1500) as int) as r, cast(floor(x / 1500) as int) as c from lv) select cell.code, round(grid.v - static, 6) as head from cell join grid using (r, c) where static is not null")
def hydraulic_head(spark, sf_dir):
    """Ground level of the well's cell less the static level."""
    w = levels(spark, sf_dir).where("static is not null").withColumn("r", F.floor(C("y") / 1500).cast("int")).withColumn("c", F.floor(C("x") / 1500).cast("int"))
    return w.join(relation(spark, sf_dir, "grid"), ["r", "c"]).select("code", F.round(C("v") - C("static"), 6).alias("head"))


@query("matrix_assembly", "wells intervals", QS.replace(", lv as", ", lv as", 1) + """, ints as (select code, count(*) as n_intervals, sum(thick_m) as thickness from intervals group by code), m as (select quantile_cont(flow, 0.5) as f from qs where domain in ('fissured', 'other') and q > 0)
select code, round(log10(q), 6) as log_qs, n_intervals, thickness, coalesce(flow, f) as flow, cast(source = 'computed' as int) as source_computed, cast(source = 'sheet' as int) as source_sheet from qs join ints using (code), m where domain in ('fissured', 'other') and q > 0""")
def matrix_assembly(spark, sf_dir):
    """The model matrix: target, joined covariates, one-hot sources, medians for missing values, two domains."""
    q = capacities(spark, sf_dir).where(C("domain").isin("fissured", "other") & (C("q") > 0))
    q = fuzzy.impute_median(q, ["flow"])
    ints = relation(spark, sf_dir, "intervals").groupBy("code").agg(F.count("*").alias("n_intervals"), F.sum("thick_m").alias("thickness"))
    return q.join(ints, "code").select("code", F.round(F.log10("q"), 6).alias("log_qs"), "n_intervals", "thickness", "flow", (C("source") == "computed").cast("int").alias("source_computed"), (C("source") == "sheet").cast("int").alias("source_sheet"))


@query("clip", "wells", " select code, greatest(20, least(160, depth_m)) as depth from wells")
def clip(spark, sf_dir):
    """Depths held within 20 and 160 m."""
    return wells(spark, sf_dir).select("code", hydraulics.clip(C("depth_m"), 20.0, 160.0).alias("depth"))


@query("direction_class", "wells", """, p as (select a.code as a, b.code as b, (degrees(atan2(b.x - a.x, b.y - a.y)) + 360) % 180 as azim from wells a join wells b on b.code = a.code + 1)
select a, case when azim < 22.5 or azim >= 157.5 then 'N-S' when azim < 67.5 then 'NE-SW' when azim < 112.5 then 'E-W' else 'NW-SE' end as direction from p""")
def direction_class_query(spark, sf_dir):
    """Direction class from each well to the next by code."""
    w = wells(spark, sf_dir).select("code", "x", "y")
    after = w.select((C("code") - 1).alias("code"), C("x").alias("x2"), C("y").alias("y2"))
    return w.join(after, "code").select(C("code").alias("a"), direction_class(C("x2") - C("x"), C("y2") - C("y")).alias("direction"))


@query("surface_fraction", "wells", """, s as (select code, z * 5 as d1, z * 5 + 10 as d2, z * 5 + 30 as d3, 10.0 as top, 10 + depth_m / 2 as base from wells), st as (
  select code, top, base, unnest(['soil', 'saprolite', 'fractured', 'sound']) as class, unnest([0, d1, d2, d3]) as t, unnest([d1, d2, d3, 1e5]) as b from s)
select code, class, round(greatest(0, least(base, b) - greatest(top, t)) / (base - top), 6) as fraction from st""")
def surface_fraction(spark, sf_dir):
    """Share of an intake in each of four strata between three surfaces."""
    s = wells(spark, sf_dir).select("code", (C("z") * 5).alias("d1"), F.lit(10.0).alias("top"), (10 + C("depth_m") / 2).alias("base"))
    edges = [F.lit(0.0), C("d1"), C("d1") + 10, C("d1") + 30, F.lit(1e5)]
    strata = F.array(*[F.struct(F.lit(n).alias("class"), edges[i].alias("t"), edges[i + 1].alias("b")) for i, n in enumerate(("soil", "saprolite", "fractured", "sound"))])
    e = s.select("code", "top", "base", F.explode(strata).alias("s"))
    length = F.greatest(F.lit(0.0), F.least(C("base"), C("s.b")) - F.greatest(C("top"), C("s.t")))
    return e.select("code", C("s.class").alias("class"), F.round(length / (C("base") - C("top")), 6).alias("fraction"))


@query("stack_coherence", "wells", " select code, z as s1, greatest(z, z * 1.5 - 1) as s2, greatest(greatest(z, z * 1.5 - 1), depth_m / 50) as s3, round(greatest(z, z * 1.5 - 1) - z, 6) as t1, round(greatest(greatest(z, z * 1.5 - 1), depth_m / 50) - greatest(z, z * 1.5 - 1), 6) as t2 from wells")
def stack_coherence(spark, sf_dir):
    """Surfaces pushed down so that none lies above the one before, and the thicknesses between them."""
    s = wells(spark, sf_dir).select("code", C("z").alias("s1"), F.greatest(C("z"), C("z") * 1.5 - 1).alias("s2"), (C("depth_m") / 50).alias("d3")).withColumn("s3", F.greatest("s2", "d3"))
    return s.select("code", "s1", "s2", "s3", F.round(C("s2") - C("s1"), 6).alias("t1"), F.round(C("s3") - C("s2"), 6).alias("t2"))


def _kruger_sql() -> str:
    from strataflow.functions.geometry import FLATTENING, SCALE, kruger

    radius, alpha, _ = kruger()
    e = (FLATTENING * (2 - FLATTENING)) ** 0.5
    series = lambda f, g: " + ".join(f"{a!r} * {f}({2 * k} * xi) * {g}({2 * k} * eta)" for k, a in enumerate(alpha, 1))
    return f""", g as (select code, -47 + x / 60000 * 3 as lon, -22 + y / 60000 * 3 as lat from wells),
t as (select *, radians(lon + 45.0) as lam, sinh(atanh(sin(radians(lat))) - {e!r} * atanh({e!r} * sin(radians(lat)))) as t from g),
u as (select *, atan2(t, cos(lam)) as xi, atanh(sin(lam) / sqrt(1 + t * t)) as eta from t)
select code, round(500000 + {SCALE * radius!r} * (eta + {series('cos', 'sinh')}), 3) as east, round(10000000 + {SCALE * radius!r} * (xi + {series('sin', 'cosh')}), 3) as north, round(lon, 6) as lon, round(lat, 6) as lat from u"""


@query("utm_project", "wells", _kruger_sql())
def utm_project(spark, sf_dir):
    """Degrees projected to metres, and back."""
    g = wells(spark, sf_dir).select("code", (-47 + C("x") / 60000 * 3).alias("lon0"), (-22 + C("y") / 60000 * 3).alias("lat0"))
    east, north = utm_forward(C("lon0"), C("lat0"))
    p = g.select("code", east.alias("e"), north.alias("n"))
    lon, lat = utm_inverse(C("e"), C("n"))
    return p.select("code", F.round("e", 3).alias("east"), F.round("n", 3).alias("north"), F.round(lon, 6).alias("lon"), F.round(lat, 6).alias("lat"))
