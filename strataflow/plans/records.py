"""Well records: quality control, parsing, relational upkeep."""

from __future__ import annotations

from pyspark.sql import functions as F

from strataflow.adapters import relation
from strataflow.functions import text as tx
from strataflow.operators import quality_control as qc
from strataflow.operators import resample
from strataflow.operators.spatial import radius_pairs
from strataflow.plans.registry import query
from strataflow.session import table

BOX = (10000.0, 10000.0, 45000.0, 50000.0)


def wells(spark, sf_dir):
    return relation(spark, sf_dir, "wells")


def intervals(spark, sf_dir):
    return relation(spark, sf_dir, "intervals")


@query("aoi_filter", "wells", " select code, x, y from wells where x between 10000 and 45000 and y between 10000 and 50000")
def aoi_filter(spark, sf_dir):
    """Wells inside the area of interest, edges included."""
    return wells(spark, sf_dir).where(qc.in_box(F.col("x"), F.col("y"), BOX)).select("code", "x", "y")


FLAGS = """, f as (select code, list_filter([case when not (x between 10000 and 45000 and y between 10000 and 50000) then 'outside' end, case when depth_m < 40 then 'shallow' end, case when hours < 4 then 'short_test' end], lambda v: v is not null) as flags,
  (x between 10000 and 45000 and y between 10000 and 50000) and depth_m >= 40 as approved from wells)"""


def flagged(spark, sf_dir):
    return qc.flag_rows(wells(spark, sf_dir), {"outside": ~qc.in_box(F.col("x"), F.col("y"), BOX), "shallow": F.col("depth_m") < 40}, {"short_test": F.col("hours") < 4})


@query("flags_array", "wells", FLAGS + " select code, array_to_string(flags, ';') as flags, approved from f")
def flags_array(spark, sf_dir):
    """Flags and approval of each well; two rules block, one only warns."""
    return flagged(spark, sf_dir).select("code", F.array_join("flags", ";").alias("flags"), "approved")


@query("qc_report", "wells", FLAGS + ", u as (select unnest(flags) as rule from f) select rule, count(*) as wells from u group by rule union all select 'approved', count(*) from f where approved union all select 'total', count(*) from f")
def qc_report(spark, sf_dir):
    """Wells by rule, approved, and in total."""
    f = flagged(spark, sf_dir)
    by = f.select(F.explode("flags").alias("rule")).groupBy("rule").agg(F.count("*").alias("wells"))
    totals = f.agg(F.count_if("approved").alias("approved"), F.count("*").alias("total"))
    return by.unionByName(totals.select(F.expr("stack(2, 'approved', approved, 'total', total) as (rule, wells)")))


@query("manual_flags", "wells", """, manual(code, reason) as (values (3, 'moved'), (12, 'wrong unit'), (77, 'closed'), (99999999, 'elsewhere'))
select code, reason from wells join manual using (code)""")
def manual_flags(spark, sf_dir):
    """Flags set by hand, for the wells that are there."""
    manual = spark.createDataFrame([(3, "moved"), (12, "wrong unit"), (77, "closed"), (99999999, "elsewhere")], "code long, reason string")
    return wells(spark, sf_dir).join(F.broadcast(manual), "code").select("code", "reason")


@query("completeness_score", "wells intervals", """, n as (select code, count(*) as n, count(case when lithology is not null then 1 end) as k from intervals group by code)
select w.code, cast((depth_m is not null)::int + least(coalesce(n.n, 0), 5) + least(coalesce(n.k, 0), 3) * 3 as bigint) as score from wells w left join n using (code)""")
def completeness_score(spark, sf_dir):
    """How much each well's record holds."""
    i = intervals(spark, sf_dir).select("code", "lithology")
    return qc.completeness(wells(spark, sf_dir), {"n_intervals": (i, 5, 1), "n_lithology": (i.where("lithology is not null"), 3, 3)})


NEAR_DUP = """, pairs as (select a.code as a, b.code as b, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) as d from wells a join wells b on a.code < b.code and abs(a.x - b.x) <= 400 and abs(a.y - b.y) <= 400),
close as (select a, b, d from pairs where d <= 400)"""
REACH = NEAR_DUP + """, lnk as (select a, b from close union all select b, a from close),
reach as (with recursive r(code, other) as (select a, a from lnk union select r.code, lnk.b from r join lnk on r.other = lnk.a) select code, min(other) as component from r group by code)"""


@query("duplicate_pairs", "wells", NEAR_DUP + " select a, b, round(d, 6) as d from close")
def duplicate_pairs(spark, sf_dir):
    """Pairs of wells closer than the duplicate distance."""
    return radius_pairs(wells(spark, sf_dir), 400.0).select("a", "b", F.round("d", 6).alias("d"))


@query("duplicate_components", "wells", REACH + " select code, component from reach")
def duplicate_components(spark, sf_dir):
    """Groups of duplicates, chains included."""
    return qc.duplicate_groups(wells(spark, sf_dir), 400.0)


LOSERS = REACH + """, rated as (select component, w.code, hours as score from reach join wells w using (code)),
best as (select component, code as winner from (select *, row_number() over (partition by component order by score desc, code desc) as k from rated) where k = 1)"""


@query("duplicate_losers", "wells", LOSERS + " select component, winner, code from rated join best using (component) where code <> winner")
def duplicate_losers(spark, sf_dir):
    """All wells of a group but the best, by hours and then code."""
    w = wells(spark, sf_dir)
    return qc.losers(qc.duplicate_groups(w, 400.0), w.select("code", F.col("hours").alias("score")))


@query("group_minus_winner", "wells", LOSERS + " select component, count(*) as n_rejected from rated join best using (component) where code <> winner group by component")
def group_minus_winner(spark, sf_dir):
    """Rejected wells by group."""
    w = wells(spark, sf_dir)
    return qc.losers(qc.duplicate_groups(w, 400.0), w.select("code", F.col("hours").alias("score"))).groupBy("component").agg(F.count("*").alias("n_rejected"))


@query("interval_overlap_flag", "intervals", """, shifted as (select code, rn, top_m - case when rn % 3 = 0 then 2 else 0 end as top_m, base_m from intervals)
select a.code, count(*) as n_overlaps from shifted a join shifted b on a.code = b.code and a.rn < b.rn and a.top_m < b.base_m and b.top_m < a.base_m group by a.code""")
def interval_overlap_flag(spark, sf_dir):
    """Wells with overlapping intervals (every third interval is drawn up by 2 m)."""
    shifted = intervals(spark, sf_dir).withColumn("top_m", F.col("top_m") - F.when(F.col("rn") % 3 == 0, 2).otherwise(0))
    return qc.overlapping(shifted)


@query("screen_below_bottom", "wells intervals", " select w.code from wells w where exists (select 1 from intervals i where i.code = w.code and i.base_m > w.depth_m + 1)")
def screen_below_bottom(spark, sf_dir):
    """Wells with an interval that ends over a metre below the bottom."""
    w, i = wells(spark, sf_dir).select("code", "depth_m"), intervals(spark, sf_dir).groupBy("code").agg(F.max("base_m").alias("deepest"))
    return w.join(i, "code").where("deepest > depth_m + 1").select("code")


@query("lithology_gap", "intervals", """, g as (select code, top_m - lag(base_m) over (partition by code order by top_m, rn) as gap from intervals)
select code, count(*) as n_gaps, round(max(gap), 6) as widest from g where gap > 2 group by code""")
def lithology_gap(spark, sf_dir):
    """Wells with gaps of over 2 m between intervals."""
    return qc.gaps(intervals(spark, sf_dir)).withColumn("widest", F.round("widest", 6))


@query("anti_missing", "wells intervals", " select code from wells where code not in (select code from intervals)")
def anti_missing(spark, sf_dir):
    """Wells without any interval."""
    return wells(spark, sf_dir).select("code").join(intervals(spark, sf_dir).select("code"), "code", "left_anti")


UPSERT = ", old as (select code, depth_m, flow, domain from wells where code % 2 = 0), new as (select code, case when code % 3 = 0 then null else depth_m + 1 end as depth_m, flow, 'new' as domain from wells where code % 5 = 0)"


def old_new(spark, sf_dir):
    w = wells(spark, sf_dir).select("code", "depth_m", "flow", "domain")
    new = w.where("code % 5 = 0").withColumn("depth_m", F.when(F.col("code") % 3 != 0, F.col("depth_m") + 1)).withColumn("domain", F.lit("new"))
    return w.where("code % 2 = 0"), new


@query("upsert", "wells", UPSERT + " select coalesce(n.code, o.code) as code, coalesce(n.depth_m, o.depth_m) as depth_m, coalesce(n.flow, o.flow) as flow, case when o.code is not null then o.domain else n.domain end as domain from old o full join new n on o.code = n.code")
def upsert(spark, sf_dir):
    """New records over old ones, with nulls and protected columns left alone."""
    old, new = old_new(spark, sf_dir)
    return qc.upsert(old, new, "code", ["depth_m", "flow"], ["domain"])


@query("replace_by_key", "wells", UPSERT + " select * from old where code not in (select code from new) union all select * from new")
def replace_by_key(spark, sf_dir):
    """Old records whose key has no new ones, and the new ones."""
    old, new = old_new(spark, sf_dir)
    return qc.replace_by_key(old, new, "code")


@query("cadastre_load", "wells", " select code, x, y, static_cadastre, dynamic_cadastre, qs_cadastre from wells where coalesce(static_cadastre, dynamic_cadastre, qs_cadastre) is not null and x between 10000 and 45000 and y between 10000 and 50000")
def cadastre_load(spark, sf_dir):
    """Cadastre rows in the area with at least one measurement."""
    w = wells(spark, sf_dir).where(qc.in_box(F.col("x"), F.col("y"), BOX))
    return w.where(F.coalesce("static_cadastre", "dynamic_cadastre", "qs_cadastre").isNotNull()).select("code", "x", "y", "static_cadastre", "dynamic_cadastre", "qs_cadastre")


MEASURED = """, held as (select code, 'sheet' as method, static_sheet as static_m, dynamic_sheet as dynamic_m, qs_sheet as qs from wells where code % 3 > 0
  union all select code, 'cadastre', static_cadastre + 1, dynamic_cadastre + 1, null from wells where code % 4 = 0)"""


@query("cadastre_replace", "wells", MEASURED + """ select * from held where method <> 'cadastre' union all
select code, 'cadastre', static_cadastre, dynamic_cadastre, qs_cadastre from wells where coalesce(static_cadastre, dynamic_cadastre, qs_cadastre) is not null and x between 10000 and 45000 and y between 10000 and 50000""")
def cadastre_replace(spark, sf_dir):
    """Measurements in which all earlier cadastre rows give way to those of a new load; rows of other methods stay."""
    w = wells(spark, sf_dir)
    named = lambda kind, add=0: [F.lit(kind).alias("method"), (F.col(f"static_{kind}") + add).alias("static_m"), (F.col(f"dynamic_{kind}") + add).alias("dynamic_m")]
    sheets = w.where("code % 3 > 0").select("code", *named("sheet"), F.col("qs_sheet").alias("qs"))
    earlier = w.where("code % 4 = 0").select("code", *named("cadastre", 1))
    new = cadastre_load(spark, sf_dir).select("code", *named("cadastre"), F.col("qs_cadastre").alias("qs"))
    return qc.replace_where(sheets.unionByName(earlier, allowMissingColumns=True), F.col("method") == "cadastre", new)


@query("audit_export", "wells intervals", FLAGS + ", n as (select code, count(*) as n_intervals, max(base_m) as deepest from intervals group by code) select w.code, w.domain, array_to_string(f.flags, ';') as flags, f.approved, n_intervals, deepest from wells w join f using (code) left join n using (code)")
def audit_export(spark, sf_dir):
    """One flat row a well, with flags joined by semicolons."""
    n = intervals(spark, sf_dir).groupBy("code").agg(F.count("*").alias("n_intervals"), F.max("base_m").alias("deepest"))
    return flagged(spark, sf_dir).join(n, "code", "left").select("code", "domain", F.array_join("flags", ";").alias("flags"), "approved", "n_intervals", "deepest")


@query("value_counts_top", "", "select word, count(*) as n from (select unnest(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) as word from documents) group by 1 order by n desc, word limit 15")
def value_counts_top(spark, sf_dir):
    """The fifteen commonest words of all texts."""
    return table(spark, sf_dir, "documents").select(F.explode(F.split("text", r"[\x20\x09-\x0D]+")).alias("word")).where("word <> ''").groupBy("word").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "word").limit(15)


@query("distinct_and_corr", "wells", " select count(distinct domain) as domains, count(distinct depth_m) as depths, count(distinct flow) as flows, round(corr(depth_m, z), 6) as r_depth, round(corr(x, z), 6) as r_x from wells")
def distinct_and_corr(spark, sf_dir):
    """Distinct values of columns and correlations with z."""
    return wells(spark, sf_dir).agg(F.count_distinct("domain").alias("domains"), F.count_distinct("depth_m").alias("depths"), F.count_distinct("flow").alias("flows"), F.round(F.corr("depth_m", "z"), 6).alias("r_depth"), F.round(F.corr("x", "z"), 6).alias("r_x"))


@query("variance_conventions", "wells", " select domain, round(var_pop(z), 6) as population, round(var_samp(z), 6) as sample from wells group by domain")
def variance_conventions(spark, sf_dir):
    """Population and sample variance of z by domain."""
    return wells(spark, sf_dir).groupBy("domain").agg(F.round(F.var_pop("z"), 6).alias("population"), F.round(F.var_samp("z"), 6).alias("sample"))


@query("grouped_min_n", "wells", " select cast(floor(x / 5000) as bigint) as bx, cast(floor(y / 5000) as bigint) as bb, count(*) as n, round(quantile_cont(depth_m, 0.5), 6) as median from wells group by 1, 2 having count(*) >= 8")
def grouped_min_n(spark, sf_dir):
    """Median depth of blocks with eight wells or more."""
    b = wells(spark, sf_dir).groupBy(F.floor(F.col("x") / 5000).alias("bx"), F.floor(F.col("y") / 5000).alias("bb"))
    return b.agg(F.count("*").alias("n"), F.round(F.expr("percentile(depth_m, 0.5D)"), 6).alias("median")).where("n >= 8")


@query("exact_sample", "", "select doc_id, lang, strlen(text) as bytes from documents order by substr(md5(cast(doc_id as varchar) || ':42'), 1, 15), doc_id limit 300")
def exact_sample(spark, sf_dir):
    """Exactly 300 documents (all of a smaller table), the same at any partitioning."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", F.octet_length("text").alias("bytes"))
    digest = F.md5(F.concat(F.col("doc_id").cast("string"), F.lit(":42")))
    return resample.exact_sample(d, 300, ["doc_id"], number=F.conv(F.substring(digest, 1, 15), 16, 10).cast("long"))


@query("stratified_sample", "", "select lang, doc_id from (select lang, doc_id, row_number() over (partition by lang order by md5(cast(doc_id as varchar)), doc_id) as k from documents) where k <= 12")
def stratified_sample(spark, sf_dir):
    """At most twelve documents of each language, by a hash of the id."""
    d = table(spark, sf_dir, "documents").select("lang", "doc_id")
    return d.withColumn("k", F.expr("row_number() over (partition by lang order by md5(cast(doc_id as string)), doc_id)")).where("k <= 12").drop("k")


@query("clean_text", "", r"""select doc_id, md5(trim(regexp_replace(text, '[\x00-\x08\x0b\x0c\x0e-\x1f]', '', 'g'))) as clean_md5, length(trim(regexp_replace(text, '[\x00-\x08\x0b\x0c\x0e-\x1f]', '', 'g'))) as n from documents""")
def clean_text(spark, sf_dir):
    """Texts without control characters."""
    c = tx.clean(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(c).alias("clean_md5"), F.length(c).cast("long").alias("n"))


NUMBERS = """, raw as (select code, case code % 4 when 0 then replace(cast(depth_m as varchar), '.', ',') when 1 then 'ca. -' || cast(cast(depth_m as int) as varchar) || ',5 m' when 2 then ' ' || cast(depth_m as varchar) || ' ' else 'none' end as s from wells)"""


@query("num_tolerant", "wells", NUMBERS + r""" select code, try_cast(replace(trim(s), ',', '.') as double) as strict, try_cast(replace(nullif(regexp_extract(s, '-?\d+([.,]\d+)?', 0), ''), ',', '.') as double) as tolerant from raw""")
def num_tolerant(spark, sf_dir):
    """Numbers with commas, units and words around them."""
    d = F.col("depth_m").cast("string")
    k = F.col("code") % 4
    raw = F.when(k == 0, F.replace(d, F.lit("."), F.lit(","))).when(k == 1, F.concat(F.lit("ca. -"), F.col("depth_m").cast("int").cast("string"), F.lit(",5 m"))).when(k == 2, F.concat(F.lit(" "), d, F.lit(" "))).otherwise(F.lit("none"))
    return wells(spark, sf_dir).select("code", raw.alias("s")).select("code", tx.number(F.col("s")).alias("strict"), tx.number_within(F.col("s")).alias("tolerant"))


DATES = """raw as (select o_orderkey as code, case o_orderkey % 5 when 0 then strftime(o_orderdate, '%d/%m/%Y') when 1 then strftime(o_orderdate, '%Y-%m-%d') when 2 then cast(cast(epoch(o_orderdate) as bigint) * 1000 as varchar)
  when 3 then '01/01/1850' else 'unknown' end as s from orders)"""


@query("date_parse", "", "with " + DATES + """ select code, case when d >= date '1900-01-01' and d <= date '2030-01-01' then d end as d from (select code, case when try_cast(s as double) is not null
  then cast(epoch_ms(cast(try_cast(s as double) as bigint)) as date) else coalesce(cast(try_strptime(s, '%d/%m/%Y') as date), cast(try_strptime(s, '%Y-%m-%d') as date)) end as d from raw)""")
def date_parse(spark, sf_dir):
    """Dates as text in two orders and as epoch milliseconds; anything else, or before 1900, is null."""
    o, k = table(spark, sf_dir, "orders").withColumn("o_orderdate", F.col("o_orderdate").cast("timestamp_ntz")), F.col("o_orderkey") % 5
    ms = (F.datediff(F.col("o_orderdate").cast("date"), F.lit("1970-01-01").cast("date")).cast("long") * 86400 + F.hour("o_orderdate") * 3600 + F.minute("o_orderdate") * 60 + F.second("o_orderdate")) * 1000
    raw = F.when(k == 0, F.date_format("o_orderdate", "dd/MM/yyyy")).when(k == 1, F.date_format("o_orderdate", "yyyy-MM-dd")).when(k == 2, ms.cast("string")).when(k == 3, F.lit("01/01/1850")).otherwise(F.lit("unknown"))
    return o.select(F.col("o_orderkey").alias("code"), raw.alias("s")).select("code", tx.date_of(F.col("s"), F.lit("2030-01-01").cast("date")).alias("d"))


@query("zero_is_missing", "wells", " select code, coalesce(nullif(static_sheet, 0), static_cadastre) as level from wells")
def zero_is_missing(spark, sf_dir):
    """A level of zero gives way to the other source."""
    return wells(spark, sf_dir).select("code", tx.zero_is_missing(F.col("static_sheet"), F.col("static_cadastre")).alias("level"))


@query("math_functions", "wells", " select code, round(log10(depth_m), 6) as lg, round(sqrt(x * x + y * y), 6) as r, round(degrees(atan2(y, x)), 6) as angle, round(ln(1 + depth_m), 6) as l, round(cos(radians(depth_m)), 6) as c, round(tan(radians(depth_m / 10)), 6) as t, round(pow(depth_m, 0.5), 6) as p from wells")
def math_functions(spark, sf_dir):
    """The numeric functions in use."""
    r = lambda c, n: F.round(c, 6).alias(n)
    d = F.col("depth_m")
    return wells(spark, sf_dir).select("code", r(F.log10(d), "lg"), r(F.hypot("x", "y"), "r"), r(F.degrees(F.atan2("y", "x")), "angle"), r(F.log1p(d), "l"), r(F.cos(F.radians(d)), "c"), r(F.tan(F.radians(d / 10)), "t"), r(F.pow(d, F.lit(0.5)), "p"))


@query("label_join_json", "", """select event_id, event_type || '_' || coalesce(json_extract_string(props, '$.k'), 'none') as label, cast(json_extract_string(props, '$.k') as bigint) as k, len(string_split(event_type || '_x', '_')) as n_tokens from events""")
def label_join_json(spark, sf_dir):
    """Labels joined from a column and a JSON field, and their tokens."""
    k = F.get_json_object("props", "$.k")
    return table(spark, sf_dir, "events").select("event_id", F.concat_ws("_", "event_type", F.coalesce(k, F.lit("none"))).alias("label"), k.cast("long").alias("k"), F.size(F.split(F.concat("event_type", F.lit("_x")), "_")).cast("long").alias("n_tokens"))


@query("ordered_union", "wells", """ select code, case when domain = 'other' then domain || ';north;karstic' when domain = 'karstic' then 'karstic;north' else domain || ';north;karstic' end as labels from wells""")
def ordered_union(spark, sf_dir):
    """Labels of two lists in first-seen order, without repeats."""
    both = F.concat(F.array("domain", F.lit("north")), F.array(F.lit("karstic"), F.col("domain")))
    return wells(spark, sf_dir).select("code", F.array_join(F.array_distinct(both), ";").alias("labels"))


@query("common_columns", "wells", """, a as (select * from wells where code % 2 = 0), b as (select * from wells where code % 2 = 1)
select name, round(fa, 6) as share_a, round(fb, 6) as share_b from (
  select unnest(['static_sheet', 'dynamic_sheet', 'flow', 'qs_sheet', 'qs_cadastre', 'hours']) as name,
    unnest([a1, a2, a3, a4, a5, a6]) as fa, unnest([b1, b2, b3, b4, b5, b6]) as fb
  from (select count(static_sheet) / count(*) as a1, count(dynamic_sheet) / count(*) as a2, count(flow) / count(*) as a3, count(qs_sheet) / count(*) as a4, count(qs_cadastre) / count(*) as a5, count(hours) / count(*) as a6 from a),
    (select count(static_sheet) / count(*) as b1, count(dynamic_sheet) / count(*) as b2, count(flow) / count(*) as b3, count(qs_sheet) / count(*) as b4, count(qs_cadastre) / count(*) as b5, count(hours) / count(*) as b6 from b)) where fa >= 0.6 and fb >= 0.6""")
def common_columns(spark, sf_dir):
    """Numeric columns that are 60 % filled on both sides."""
    names = ["static_sheet", "dynamic_sheet", "flow", "qs_sheet", "qs_cadastre", "hours"]
    side = wells(spark, sf_dir).groupBy((F.col("code") % 2).alias("side")).agg(F.array(*[F.count(c) / F.count("*") for c in names]).alias("f"))
    one = side.agg(F.max(F.when(F.col("side") == 0, F.col("f"))).alias("fa"), F.max(F.when(F.col("side") == 1, F.col("f"))).alias("fb"))
    rows = one.select(F.explode(F.arrays_zip(F.array(*[F.lit(c) for c in names]).alias("name"), "fa", "fb")).alias("r"))
    return rows.select(F.col("r.name").alias("name"), F.round("r.fa", 6).alias("share_a"), F.round("r.fb", 6).alias("share_b")).where("share_a >= 0.6 and share_b >= 0.6")
