"""Lithology, contacts, line work and flight lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from strataflow.adapters import numbered_flights, relation
from strataflow.functions import geometry
from strataflow.functions import text as tx
from strataflow.operators import intervals as iv
from strataflow.operators import metrics, raster
from strataflow.plans.registry import query
from strataflow.session import table

C = F.col

# Term lists in their order of precedence; the first class with a hit wins.
DOMAINS = [("porous", ["anti", "sedim"]), ("karstic", ["réeux", "achlich"]), ("fissured", ["ingly", "ción"])]
CLASSES = [("soil", ["eaux", "heit"]), ("saprolite", ["cion", "tion"]), ("rock", ["ungs", "ent"])]


def _contains(col: str, classes, fold: bool) -> str:
    subject = f"strip_accents(lower({col}))" if fold else f"lower({col})"
    return "case when text is null then 'unstated' " + " ".join("when " + " or ".join(f"contains({subject}, '{t}')" for t in terms) + f" then '{n}'" for n, terms in classes) + " else 'other' end"


@query("domain_class", "", "select doc_id, " + _contains("text", DOMAINS, False) + " as domain from documents")
def domain_class(spark, sf_dir):
    """First domain, in order, with a term in the lower-cased text; accents count."""
    return table(spark, sf_dir, "documents").select("doc_id", tx.first_class(C("text"), DOMAINS, missing="unstated", other="other").alias("domain"))


@query("lithology_class", "", "select doc_id, " + _contains("text", CLASSES, True) + " as class from documents")
def lithology_class(spark, sf_dir):
    """First class, in order, with a term in the text; accents don't count."""
    return table(spark, sf_dir, "documents").select("doc_id", tx.first_class(C("text"), CLASSES, fold=True, missing="unstated", other="other").alias("class"))


COVER = "('soil', 'alluvium', 'saprolite')"


@query("contacts", "intervals", f""", b as (select *, case when lithology not in {COVER} or top_m - coalesce(lag(base_m) over (partition by code order by top_m, rn), 0) > 0.5 then 1 else 0 end as broken from intervals where lithology is not null),
r as (select *, max(broken) over (partition by code order by top_m, rn rows between unbounded preceding and current row) as stop from b)
select code, max(case when stop = 0 then base_m end) as cover_base, min(case when lithology in ('fractured_rock', 'sound_rock', 'sound_sedimentary') then top_m end) as rock_top, min(case when lithology in ('sound_rock', 'sound_sedimentary') then top_m end) as sound_top from r group by code""")
def contacts(spark, sf_dir):
    """Base of the cover, top of the rock and of sound rock in each well."""
    return iv.contacts(relation(spark, sf_dir, "intervals"), ["soil", "alluvium", "saprolite"], ["fractured_rock", "sound_rock", "sound_sedimentary"], ["sound_rock", "sound_sedimentary"])


ORDER = ["soil", "alluvium", "saprolite", "fractured_rock", "sound_rock", "sound_sedimentary"]


@query("intake_fraction", "wells intervals", """, it as (select code, depth_m / 10 as top, depth_m as base from wells), p as (select code, lithology, sum(greatest(0, least(base, base_m) - greatest(top, top_m)) / (base - top)) as f from it join intervals using (code) where lithology is not null group by code, lithology having f > 0),
r as (select *, row_number() over (partition by code order by round(f, 9) desc, list_position(['soil', 'alluvium', 'saprolite', 'fractured_rock', 'sound_rock', 'sound_sedimentary'], lithology)) as k, sum(f) over (partition by code) as covered from p)
select code, lithology as main, round(f, 6) as fraction, round(covered, 6) as covered from r where k = 1""")
def intake_fraction(spark, sf_dir):
    """The class that makes up most of each intake."""
    intake = relation(spark, sf_dir, "wells").select("code", (C("depth_m") / 10).alias("top"), C("depth_m").alias("base"))
    got = iv.class_fractions(intake, relation(spark, sf_dir, "intervals"), ORDER)
    return got.select("code", "main", F.round("fraction", 6).alias("fraction"), F.round("covered", 6).alias("covered"))


@query("median_by_unit", "intervals", " select lithology, count(*) as n, round(quantile_cont(thick_m, 0.5), 2) as median from intervals where lithology is not null group by lithology")
def median_by_unit(spark, sf_dir):
    """Median thickness by class."""
    m = metrics.median(relation(spark, sf_dir, "intervals").where("lithology is not null"), "thick_m", ("lithology",))
    return m.select("lithology", "n", F.round("med", 2).alias("median"))


@query("fill_rate", "flights", " select source, count(*) as n, round(avg(case when mag is not null then 1.0 else 0.0 end), 6) as filled from flights group by source")
def fill_rate(spark, sf_dir):
    """Share of readings by source."""
    return relation(spark, sf_dir, "flights").groupBy("source").agg(F.count("*").alias("n"), F.round(F.avg(C("mag").isNotNull().cast("int")), 6).alias("filled"))


@query("decimate", "flights", " select event_id, file_no, line_no, mag from flights where line_no % 10 = 0")
def decimate(spark, sf_dir):
    """Every tenth line of each file."""
    return numbered_flights(spark, sf_dir).where("line_no % 10 = 0").select("event_id", "file_no", "line_no", "mag")


CELLS = ", cells as (select source, cast(floor(y / 250) as bigint) as r, cast(floor(x / 250) as bigint) as c, quantile_cont(mag, 0.5) as m from flights where mag is not null group by all)"


@query("block_median_grid", "flights", CELLS + " select source, r, c, round(m, 6) as m from cells")
def block_median_grid(spark, sf_dir):
    """Median reading of each 250 m cell by source."""
    return raster.block_median(relation(spark, sf_dir, "flights"), "mag", 250.0, keys=("source",)).select("source", "r", "c", F.round("value", 6).alias("m"))


@query("zscore_mosaic", "flights", CELLS + """, z as (select source, r, c, case when s = 0 then 0 else (m - a) / s end as z from cells join (select source, avg(m) as a, stddev_pop(m) as s from cells group by source) using (source))
select coalesce(a.r, b.r) as r, coalesce(a.c, b.c) as c, round(coalesce(a.z, b.z), 6) as z from (select * from z where source = '1105') a full join (select * from z where source = '1039') b on a.r = b.r and a.c = b.c""")
def zscore_mosaic(spark, sf_dir):
    """Cells as z-scores of their source, the newer source first."""
    cells = raster.block_median(relation(spark, sf_dir, "flights"), "mag", 250.0, keys=("source",))
    z = raster.zscore(cells, "value", "source")
    return raster.mosaic(z.where("source = '1105'"), z.where("source = '1039'"), "z").select("r", "c", F.round("z", 6).alias("z"))


AZ = ", a as (select *, (degrees(atan2(c1 - c0, r0 - r1)) + 180) % 180 as azim, sqrt((r1-r0)*(r1-r0) + (c1-c0)*(c1-c0)) as len from segments)"
FAMILIES = [("A", 20.0, 70.0), ("B", 70.0, 110.0), ("C", 110.0, 160.0), ("D", 160.0, 20.0)]
FAMILY = "case when azim >= 20 and azim < 70 then 'A' when azim >= 70 and azim < 110 then 'B' when azim >= 110 and azim < 160 then 'C' else 'D' end"


def segments(spark, sf_dir):
    s = relation(spark, sf_dir, "segments")
    s = s.withColumn("azim", geometry.azimuth(C("r0"), C("c0"), C("r1"), C("c1")))
    return s.withColumn("len", F.sqrt(F.pow((C("r1") - C("r0")).cast("double"), 2) + F.pow((C("c1") - C("c0")).cast("double"), 2))).withColumn("family", geometry.family(C("azim"), FAMILIES))


@query("azimuth_family", "segments", AZ + f" select seg, round(azim, 6) as azimuth, {FAMILY} as family from a")
def azimuth_family(spark, sf_dir):
    """Azimuth and family of each segment; the last family wraps at 180."""
    return segments(spark, sf_dir).select("seg", F.round("azim", 6).alias("azimuth"), "family")


@query("axial_concentration", "segments", AZ + f", f as (select *, {FAMILY} as family from a) select family, count(*) as n, round(sqrt(pow(sum(len * cos(radians(2 * azim))), 2) + pow(sum(len * sin(radians(2 * azim))), 2)) / sum(len), 6) as r from f where len > 0 group by family")
def axial_concentration(spark, sf_dir):
    """Length-weighted mean resultant of doubled angles by family."""
    a = F.radians(2 * C("azim"))
    s = segments(spark, sf_dir).where("len > 0").groupBy("family")
    return s.agg(F.count("*").alias("n"), F.round(F.hypot(F.sum(C("len") * F.cos(a)), F.sum(C("len") * F.sin(a))) / F.sum("len"), 6).alias("r"))


@query("rose", "segments", AZ + " select cast(floor(azim / 5) as int) as bin, count(*) as n, round(sum(len), 4) as length from a group by bin")
def rose(spark, sf_dir):
    """Length of segments in 36 bins of 5 degrees."""
    return segments(spark, sf_dir).groupBy(F.floor(C("azim") / 5).cast("int").alias("bin")).agg(F.count("*").alias("n"), F.round(F.sum("len"), 4).alias("length"))


INNER = "r0 between 10 and 389 and r1 between 10 and 389 and c0 between 10 and 389 and c1 between 10 and 389"


@query("segment_filter", "segments", AZ + f" select seg, round(len, 6) as len from a where {INNER} and len >= 30")
def segment_filter(spark, sf_dir):
    """Segments of 30 pixels or more that keep off the frame."""
    return segments(spark, sf_dir).where(f"{INNER} and len >= 30").select("seg", F.round("len", 6).alias("len"))


LINE = AZ + f""", s as (select *, {FAMILY} as family, greatest(abs(r1 - r0), abs(c1 - c0)) as n from a), cells as (
  select distinct family, cast(floor(r0 + (r1 - r0) * i / greatest(n, 1) + 0.5) as int) as r, cast(floor(c0 + (c1 - c0) * i / greatest(n, 1) + 0.5) as int) as c from (select *, unnest(range(0, n + 1)) as i from s))"""


@query("rasterise", "segments", LINE + " select family, count(*) as n, sum(r) as sum_r, sum(c) as sum_c from cells group by family")
def rasterise(spark, sf_dir):
    """Cells that each family's segments cross."""
    return raster.rasterise(segments(spark, sf_dir), "family").groupBy("family").agg(F.count("*").alias("n"), F.sum("r").alias("sum_r"), F.sum("c").alias("sum_c"))


@query("family_intersection", "segments", LINE + """, d as (select distinct family, r + i as r, c + j as c from cells, (values (0, 0), (1, 0), (-1, 0), (0, 1), (0, -1)) o(i, j))
select count(*) as n, sum(r) as sum_r, sum(c) as sum_c from (select r, c from d where r between 0 and 399 and c between 0 and 399 group by r, c having count(distinct family) >= 2)""")
def family_intersection(spark, sf_dir):
    """Cells where two families meet, each dilated by a pixel."""
    got = raster.family_intersections(raster.rasterise(segments(spark, sf_dir), "family"), "family", 400, 400)
    return got.agg(F.count("*").alias("n"), F.sum("r").alias("sum_r"), F.sum("c").alias("sum_c"))


@query("lineament_density", "segments", LINE + """, g as (select r, c, 1 as m from (select distinct r, c from cells)), w as (select g.r + i as r, g.c + j as c, count(*) as n from g, (select unnest(range(-5, 6)) as i), (select unnest(range(-5, 6)) as j) group by all),
raster as (select r, c from (select unnest(range(0, 400)) as r), (select unnest(range(0, 400)) as c))
select r, c, round(coalesce(n, 0) / 121.0 * 1000 / 30, 6) as density from raster left join w using (r, c)""")
def lineament_density(spark, sf_dir):
    """Share of crossed cells in 11 x 11 windows, as length a kilometre, at every cell of the raster."""
    mask = raster.rasterise(segments(spark, sf_dir), "family").select("r", "c").distinct().withColumn("v", F.lit(1.0))
    cells = spark.range(400 * 400).select(F.floor(C("id") / 400).alias("r"), (C("id") % 400).alias("c"))
    got = cells.join(raster.box_sum_sparse(mask, 5, 5), ["r", "c"], "left")
    return got.select("r", "c", F.round(F.coalesce("value", F.lit(0.0)) / 121.0 * 1000 / 30, 6).alias("density"))
