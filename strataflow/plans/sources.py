"""Readers and parsers, over texts that Spark derives from the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from strataflow.adapters import numbered_flights, relation
from strataflow.plans.registry import query
from strataflow.session import scratch_path, table
from strataflow.sources import flight_lines, lines, record_sheets, tables

C = F.col


@query("dem_tiles", "wells", """, b as (select min(-47 + x / 60000 * 3) as west, max(-47 + x / 60000 * 3) as east, min(-22 + y / 60000 * 3) as south, max(-22 + y / 60000 * 3) as north from wells),
t as (select lon, unnest(range(cast(floor(south - 0.05) as bigint), cast(floor(north + 0.05) as bigint) + 1)) as lat from (select *, unnest(range(cast(floor(west - 0.05) as bigint), cast(floor(east + 0.05) as bigint) + 1)) as lon from b))
select (case when lat < 0 then 'S' else 'N' end) || lpad(cast(abs(lat) as varchar), 2, '0') || (case when lon < 0 then 'W' else 'E' end) || lpad(cast(abs(lon) as varchar), 3, '0') as tile, lon, lat from t""")
def dem_tiles(spark, sf_dir):
    """Elevation tiles that the wells' box needs."""
    lon, lat = -47 + C("x") / 60000 * 3, -22 + C("y") / 60000 * 3
    box = relation(spark, sf_dir, "wells").agg(F.min(lon).alias("west"), F.max(lon).alias("east"), F.min(lat).alias("south"), F.max(lat).alias("north"))
    return tables.dem_tiles(box)


@query("xyz_parse", "flights", """, ll as (select *, row_number() over (partition by file_no order by line_no) as n from flights where event_id % 23 <> 0 and event_id % 29 <> 0),
p as (select *, case when event_id % 31 = 0 then null else round(-46 + x / 20000, 6) end as lon from ll where n % 2 = 0)
select file_no, line_no, lon, round(-21 + y / 20000, 6) as lat, case when event_id % 17 = 0 then null else round(mag, 3) end as mag from p where lon between -45.8 and -45.2 and round(-21 + y / 20000, 6) between -20.9 and -20.3""")
def xyz_parse(spark, sf_dir):
    """Flight lines written out as text (with comments, short lines and dummies) and parsed again: every second data line, in a box."""
    f = numbered_flights(spark, sf_dir)
    lon = F.when(C("event_id") % 31 == 0, F.lit("*")).otherwise(F.round(-46 + C("x") / 20000, 6).cast("string"))
    data = F.concat_ws("  ", F.lit("L1"), lon, F.round(-21 + C("y") / 20000, 6).cast("string"), F.coalesce(F.round("mag", 3).cast("string"), F.lit("*")))
    value = F.when(C("event_id") % 23 == 0, F.lit("/ comment 1 2 3 4")).when(C("event_id") % 29 == 0, F.lit("Line 7")).otherwise(F.concat(F.lit("  "), data))
    lines = f.select("file_no", "line_no", value.alias("value"))
    layout = flight_lines.Layout(lon=1, lat=2, channels={"mag": 3}, keep_every=2)
    return flight_lines.parse_lines(lines, layout, flight_lines.Box(-45.8, -20.9, -45.2, -20.3))


@query("file_inspection", "", """select doc_id, n as line_no, len(list_filter(string_split_regex(trim(line), '\\s+'), lambda t: t <> '')) as tokens from (select doc_id, unnest(lines) as line, unnest(range(1, len(lines) + 1)) as n from (select doc_id, string_split(text, chr(10))[1:3] as lines from documents))""".replace("\\\\", "\\"))
def file_inspection(spark, sf_dir):
    """Tokens on the first three lines of each text, a report's fixed head."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.slice(F.split("text", "\n"), 1, 3)).alias("i", "line"))
    return d.select("doc_id", (C("i") + 1).cast("long").alias("line_no"), F.size(F.filter(F.split(F.trim("line"), r"\s+"), lambda t: t != "")).cast("long").alias("tokens"))


@query("column_inventory", "", """select unnest(['c_custkey', 'c_name', 'c_nationkey', 'c_acctbal', 'c_mktsegment']) as name, unnest([count(c_custkey), count(c_name), count(c_nationkey), count(c_acctbal), count(c_mktsegment)]) as filled,
unnest([count(c_custkey), count(try_cast(c_name as double)), count(c_nationkey), count(c_acctbal), count(try_cast(c_mktsegment as double))]) as numeric from customer""")
def column_inventory(spark, sf_dir):
    """Filled and numeric values of the columns whose names match."""
    return tables.inventory(table(spark, sf_dir, "customer"), "^c_")


@query("column_examples", "", " union all ".join(f"select '{c}' as name, array_to_string(list(v order by v), '|') as examples from (select distinct cast({c} as varchar) as v from customer where {c} is not null order by v limit 3)" for c in ("c_custkey", "c_name", "c_nationkey", "c_mktsegment")))
def column_examples(spark, sf_dir):
    """Three values of each column whose name matches, the smallest as text."""
    return tables.examples(table(spark, sf_dir, "customer"), "^c_(custkey|name|nationkey|mktsegment)").select("name", F.array_join("examples", "|").alias("examples"))


@query("report_parse", "", """select 'rule_' || cast(c_custkey as varchar) as key, case when c_custkey % 7 = 0 then null else cast(c_nationkey as double) end as number from customer where c_custkey % 10 <> 0""")
def report_parse(spark, sf_dir):
    """Report lines with comments, read back as keys and numbers."""
    c = table(spark, sf_dir, "customer")
    body = F.concat(F.lit("rule_"), C("c_custkey").cast("string"), F.lit(" , "), F.when(C("c_custkey") % 7 == 0, F.lit("n/a")).otherwise(C("c_nationkey").cast("string")))
    return tables.read_report(c.select(F.when(C("c_custkey") % 10 == 0, F.concat(F.lit("  # "), body)).otherwise(body).alias("value")))


@query("record_sheets", "wells", """ select cast(code as varchar) as code, domain as municipality, case when code % 3 = 0 then 0 else 1 + code % 2 end as n_screens, case when code % 3 = 0 then null else depth_m / 2 end as first_top, case when flow is null then null else round(flow, 3) end as flow from wells""")
def record_sheets_query(spark, sf_dir):
    """HTML sheets written from the wells and parsed into nested records."""
    w = relation(spark, sf_dir, "wells")
    cell = lambda kind, v: F.concat(F.lit(f'<td class="{kind}">'), v, F.lit("</td>"))
    field = lambda k, v: F.concat(F.lit("<tr>"), cell("label-cell", F.lit(k)), cell("data-cell", v), F.lit("</tr>"))
    interval = lambda a, b: F.concat(F.lit("<tr>"), cell("data-cell", a), cell("data-cell", b), F.lit("</tr>"))
    d = C("depth_m")
    comma = lambda v: F.replace(v.cast("string"), F.lit("."), F.lit(","))
    head = lambda t: F.lit(f'<div class="subsection-header">{t}</div>')
    screens = F.when(C("code") % 3 == 0, F.lit("")).otherwise(F.concat(interval(comma(d / 2), comma(d / 2 + 5)), F.when(C("code") % 2 == 1, interval(comma(d / 2 + 6), comma(d))).otherwise(F.lit(""))))
    html = F.concat(F.lit("<html><table>"), head("General"), field("Code", C("code").cast("string")), field("Municipality", C("domain")), head("Screens"), screens, head("Test"), field("Stable flow (m3/h)", F.coalesce(comma(F.round("flow", 3)), F.lit("-"))), F.lit("</table></html>"))
    parsed = w.select(record_sheets.parse_pages(html).alias("s"))
    screens_of = F.coalesce(C("s.intervals")["Screens"], F.array().cast("array<struct<top:double,base:double,label:string>>"))
    return parsed.select("s.code", "s.municipality", F.size(screens_of).cast("long").alias("n_screens"), F.get(screens_of, F.lit(0)).top.alias("first_top"), record_sheets.value_by_words(C("s.fields"), ["flow", "stable"]).alias("flow"))


@query("line_segments", "wells", """, v as (select domain || '/' || cast(code % 7 as varchar) as line, 0 as part, cast(row_number() over (partition by domain, code % 7 order by code) - 1 as int) as i, x, y from wells),
p as (select line, part, i, x, y, lead(x) over w as x2, lead(y) over w as y2 from v window w as (partition by line order by i)),
s as (select line, part, i, cast(floor((60000 - y) / 100) as int) as r0, cast(floor((x - 10000) / 100) as int) as c0, cast(floor((60000 - y2) / 100) as int) as r1, cast(floor((x2 - 10000) / 100) as int) as c1 from p where x2 is not null)
select * from s where (r0 between 0 and 399 and c0 between 0 and 399) or (r1 between 0 and 399 and c1 between 0 and 399)""")
def line_segments(spark, sf_dir):
    """Lines through the wells of each domain and residue, as segments on a grid of 400 x 400 cells; lines are cut into ranges of codes, so that no task holds one whole."""
    w = relation(spark, sf_dir, "wells").withColumn("line", F.concat_ws("/", "domain", (C("code") % 7).cast("string")))
    return lines.segments_between(w.select("line", "code", "x", "y"), 10000.0, 60000.0, 100.0, 400, 400)


@query("dated_snapshots", "wells", " select code, x, y, z, cast('2026-02-01' as date) as snapshot from wells")
def dated_snapshots(spark, sf_dir):
    """The latest of two snapshots of the wells; the first one holds half of them."""
    w, root = relation(spark, sf_dir, "wells").select("code", "x", "y", "z"), scratch_path(spark, "snapshots")
    tables.write_snapshot(w.where("code % 2 = 0"), root, "2026-01-01")
    tables.write_snapshot(w, root, "2026-02-01")
    return tables.read_snapshot(spark, root)


@query("record_layout", "wells", """ select cast(code as varchar) as code, 'SP' as state, domain as municipality, 'Sítio ' || cast(code % 9 as varchar) as locality, case when code % 3 = 0 then 0 else 1 + code % 2 end as n_screens,
  case when code % 3 = 0 then null else depth_m / 2 end as first_top, case when flow > 0 then round(flow, 3) end as flow, case when hours <> 0 then hours end as hours from wells""")
def record_layout(spark, sf_dir):
    """Sheets in the registry's own layout and labels, written from the wells, parsed, and searched for the pumping test's values."""
    w = relation(spark, sf_dir, "wells")
    comma = lambda v: F.replace(v.cast("string"), F.lit("."), F.lit(","))
    td = lambda kind, v: F.concat(F.lit(f'<td class="{kind}">'), v, F.lit("</td>"))
    row = lambda kind, *v: F.concat(F.lit("<tr>"), *[td(kind, x) for x in v], F.lit("</tr>"))
    section = lambda name, labels, *rows: F.concat(F.lit("<table>"), row("subsection-header", F.lit(name)), row("label-cell", *map(F.lit, labels)), *rows, F.lit("</table>"))
    d, some, two = C("depth_m"), C("code") % 3 != 0, (C("code") % 3 != 0) & (C("code") % 2 == 1)
    screens = [F.when(some, row("data-cell", comma(d / 2), comma(d / 2 + 5))).otherwise(""), F.when(two, row("data-cell", comma(d / 2 + 6), comma(d + 1))).otherwise("")]
    flow = F.coalesce(F.concat(comma(F.round("flow", 3)), F.lit(" m3/h")), F.lit("-"))
    html = F.concat(
        F.lit("<html><table>"), row("x", F.concat(F.lit("Poço: "), C("code").cast("string")), F.lit("UF: SP"), F.concat(F.lit("Município: "), "domain"), F.concat(F.lit("Localidade: Sítio "), (C("code") % 9).cast("string"))), F.lit("</table>"),
        section("Filtros:", ("De (m):", "Até (m):"), *screens),
        section("Teste de Bombeamento", ("Vazão após estabilização (m3/h)", "Duração"), row("data-cell", flow, F.concat(comma(C("hours")), F.lit(" h")))), F.lit("</html>"),
    )
    got = record_sheets.test_values(record_sheets.sheet_records(w.select(html.alias("html"))))
    flow_value = F.when(C("flow_m3h") > 0, C("flow_m3h"))
    return got.select("code", "state", "municipality", "locality", F.size("screens").cast("long").alias("n_screens"), F.get("screens", F.lit(0)).top.alias("first_top"), flow_value.alias("flow"), "hours")
