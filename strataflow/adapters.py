"""Domain relations (wells, intervals, scores, flight lines, grid, segments) over the star-schema tables.

Each text runs as it is in Spark SQL and in DuckDB, so that a query and its oracle start from
the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataflow.operators.ordering import numbered
from strataflow.session import table

WELLS = """
select c_custkey as code,
  cast((c_custkey * c_custkey * 31 + c_custkey * 7919) % 60000 as double) as x,
  cast((c_custkey * c_custkey * 17 + c_custkey * 104729) % 60000 as double) as y,
  log10(abs(c_acctbal) + cast(1 as double)) as z,
  case c_nationkey % 5 when 0 then 'porous' when 1 then 'karstic' when 2 then 'other' else 'fissured' end as domain,
  cast(20 + (c_custkey * 37) % 280 as double) as depth_m,
  case when c_custkey % 3 = 0 then null else cast((c_custkey * 13) % 60 as double) / 2 end as static_sheet,
  case when c_custkey % 4 = 0 then null else cast(5 + (c_custkey * 29) % 120 as double) / 2 end as dynamic_sheet,
  case when c_custkey % 5 = 0 then null else cast((c_custkey * 17) % 60 as double) / 2 end as static_cadastre,
  case when c_custkey % 7 = 0 then null else cast(8 + (c_custkey * 31) % 120 as double) / 2 end as dynamic_cadastre,
  case when c_custkey % 6 = 0 then null else cast((c_custkey * 11) % 90 as double) / 3 end as flow,
  case when c_custkey % 2 = 0 then null else cast((c_custkey * 7) % 50 as double) / 40 end as qs_sheet,
  case when c_custkey % 11 = 0 then null else cast((c_custkey * 5) % 50 as double) / 45 end as qs_cadastre,
  cast((c_custkey * 3) % 30 as double) as hours
from customer"""

INTERVALS = """
select code, rn, s - l_quantity as top_m, s as base_m, l_quantity as thick_m,
  case l_partkey % 7 when 0 then 'soil' when 1 then 'alluvium' when 2 then 'saprolite'
    when 3 then 'fractured_rock' when 4 then 'sound_rock' when 5 then 'sound_sedimentary' end as lithology
from (select l_orderkey as code, l_quantity, l_partkey,
    row_number() over (partition by l_orderkey order by l_shipdate, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) as rn,
    sum(l_quantity + case when l_partkey % 5 = 0 then 3 else 0 end)
      over (partition by l_orderkey order by l_shipdate, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice
        rows between unbounded preceding and current row) as s
  from lineitem) t"""

SCORES = """
select c_custkey as code, case when c_acctbal > 2500 then 1 else 0 end as y,
  cast((c_custkey * 7919 + c_nationkey * 31) % 1000 as double) / 1000 as p,
  cast((c_custkey * 104729 + 13) % 1000 as double) / 1000 as p2,
  cast((c_custkey * 7919 + c_nationkey * 31) % 200 as double) as score,
  cast(c_custkey % 20 as int) as block, cast(1 + c_custkey % 3 as double) as w,
  c_acctbal / 1000 as v, c_acctbal / 1250 + cast(c_custkey % 10 as double) / 10 as v_hat, cast(c_custkey % 5 as int) as seed
from customer"""

FLIGHTS = """
select event_id, row_number() over (partition by event_id % 8 order by ts, event_id) as line_no, cast(event_id % 8 as int) as file_no,
  cast((user_id * user_id * 31 + event_id * 97) % 20000 as double) as x,
  cast((user_id * 911 + event_id * 53) % 20000 as double) as y,
  case when event_id % 3 = 0 then '1039' else '1105' end as source,
  case when event_id % 17 = 0 then null else value end as mag, ts
from events"""

GRID = """
select cast(floor(p_partkey / cast(40 as double)) as int) as r, cast(p_partkey % 40 as int) as c,
  p_retailprice + cast((p_partkey * p_partkey * 7) % 50 as double) as v
from part"""

SEGMENTS = """
select p_partkey as seg, cast((p_partkey * 13) % 400 as int) as r0, cast((p_partkey * 29) % 400 as int) as c0,
  cast((p_partkey * p_partkey * 3 + 7) % 400 as int) as r1, cast((p_partkey * p_partkey * 5 + 11) % 400 as int) as c1
from part"""

#: CTE name -> (table, text).
ADAPTERS = {
    "wells": ("customer", WELLS),
    "intervals": ("lineitem", INTERVALS),
    "scores": ("customer", SCORES),
    "flights": ("events", FLIGHTS),
    "grid": ("part", GRID),
    "segments": ("part", SEGMENTS),
}


def relation(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The adapter ``name`` over the tables below ``sf_dir``."""
    source, text = ADAPTERS[name]
    at = text.rindex(f"from {source}")
    return spark.sql(text[:at] + f"from {{{source}}}" + text[at + len(f"from {source}") :], **{source: table(spark, sf_dir, source)})


def numbered_flights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flight lines with ``line_no``, each file's lines from 1, numbered within ranges so that no task holds a file."""
    placed = numbered(relation(spark, sf_dir, "flights").drop("line_no"), "file_no", "ts", "event_id")
    first = placed.groupBy("file_no").agg(F.min("place").alias("first"))
    return placed.join(first, "file_no").withColumn("line_no", F.col("place") - F.col("first") + 1).drop("ts", "place", "first")


def ctes(names: str) -> str:
    """``with`` clause that defines the adapters in ``names`` for DuckDB."""
    return "with " + ", ".join(f"{n} as ({ADAPTERS[n][1]})" for n in names.split())
