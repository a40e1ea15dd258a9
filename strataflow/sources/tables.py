"""Readers and writers of relations, rasters and reports."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

C = F.col


def read_jdbc(spark: SparkSession, url: str, relation: str, columns: dict[str, str], box: tuple[float, float, float, float], lon: str = "lon", lat: str = "lat", by: str | None = None, parts: int = 8, **options: str) -> DataFrame:
    """A relation's ``columns`` (new name -> source name) within a box over ``lon`` and ``lat``; filter and columns go to the database. An empty result is an error.

    With ``by``, a numeric column of the source, the rows come in ``parts`` reads at once,
    each of a range of it between the smallest and largest value that the box holds.
    """
    lon, lat = columns.get(lon, lon), columns.get(lat, lat)
    base = {"url": url, **options}
    if by is not None:
        named = spark._jvm.org.apache.spark.sql.jdbc.JdbcDialects.get(url).quoteIdentifier
        inside = f"{named(lon)} between {box[0]!r} and {box[2]!r} and {named(lat)} between {box[1]!r} and {box[3]!r}"
        ends = spark.read.format("jdbc").options(query=f"select min({named(by)}) as low, max({named(by)}) as high from {relation} where {inside}", **base).load().first()
        if ends[0] is None:
            raise ValueError(f"no rows of {relation} in {box}")
        base |= {"partitionColumn": by, "lowerBound": str(ends[0]), "upperBound": str(ends[1]), "numPartitions": str(parts)}
    rows = spark.read.format("jdbc").options(dbtable=relation, **base).load()
    got = rows.where(C(lon).between(box[0], box[2]) & C(lat).between(box[1], box[3])).select(*[C(old).alias(new) for new, old in columns.items()])
    if by is None and got.isEmpty():
        raise ValueError(f"no rows of {relation} in {box}")
    return got


def is_written(spark: SparkSession, path: str) -> bool:
    """Whether a table was written to ``path`` to its end, in any store that Spark reaches."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path + "/_SUCCESS")
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def write_snapshot(frame: DataFrame, root: str, date: str) -> str:
    """``frame`` as it is on ``date`` (YYYY-MM-DD), below ``root``. A snapshot never changes: a second one of a date is an error."""
    import datetime

    path = f"{root}/snapshot={datetime.date.fromisoformat(date).isoformat()}"
    if is_written(frame.sparkSession, path):
        raise FileExistsError(f"there is a snapshot at {path}")
    # what an interrupted write left behind isn't a snapshot
    frame.write.mode("overwrite").parquet(path)
    return path


def read_snapshot(spark: SparkSession, root: str, date: str | None = None) -> DataFrame:
    """The snapshot of ``date``, or the latest one, with its date as ``snapshot``."""
    rows = spark.read.option("basePath", root).parquet(f"{root}/snapshot=*")
    day = F.lit(date).cast("date") if date else rows.select("snapshot").distinct().agg(F.max("snapshot")).first()[0]
    return rows.where(C("snapshot") == day)


def first_column(frame: DataFrame, candidates: list[str]) -> str | None:
    """The first of ``candidates`` that ``frame`` has, by trimmed lower-case name."""
    have = {c.strip().lower(): c for c in frame.columns}
    return next((have[c] for c in candidates if c in have), None)


def with_columns_of(frame: DataFrame, schema: StructType) -> DataFrame:
    """``frame`` with the columns of ``schema`` that it lacks as typed nulls, so that old files meet new readers."""
    missing = {f.name: F.lit(None).cast(f.dataType) for f in schema.fields if f.name not in frame.columns}
    return frame.withColumns(missing) if missing else frame


def write_raster(cells: DataFrame, path: str, meta: dict) -> None:
    """Cells (r, c, v) and their metadata (origin, cell size, reference system, tags) as one Parquet table."""
    cells.select(C("r").cast("int"), C("c").cast("int"), C("v").cast("float"), F.lit(json.dumps(meta, sort_keys=True)).alias("meta")).repartitionByRange("r").write.parquet(path)


def read_raster(spark: SparkSession, path: str, nodata: float = -9999.0) -> tuple[DataFrame, dict]:
    """The cells of ``path``, nodata as null, and the metadata."""
    rows = spark.read.parquet(path)
    first = rows.select("meta").head()
    return rows.select("r", "c", F.when(C("v") != nodata, C("v")).alias("v")), json.loads(first["meta"]) if first else {}


def write_csv(frame: DataFrame, path: str, sep: str = ";", bom: bool = False) -> None:
    """CSV with a header; array columns must be joined before. With ``bom`` each file begins with a byte order mark, as spreadsheets ask for."""
    if bom:
        frame = frame.toDF("\ufeff" + frame.columns[0], *frame.columns[1:])
    frame.write.option("header", True).option("sep", sep).csv(path)


def read_report(lines: DataFrame, sep: str = ",") -> DataFrame:
    """(key, value) of report lines; lines that start with # are comments, a value that isn't a number is null."""
    parts = F.split("value", sep)
    rows = lines.where(~F.startswith(F.ltrim("value"), F.lit("#")) & C("value").contains(sep))
    return rows.select(F.trim(F.get(parts, F.lit(0))).alias("key"), F.trim(F.get(parts, F.lit(1))).try_cast("double").alias("number"))


def inventory(frame: DataFrame, pattern: str) -> DataFrame:
    """(name, filled, numeric): for each column whose name matches, values that are there and that are numbers; one pass."""
    import re

    names = [c for c in frame.columns if re.search(pattern, c)]
    counts = frame.agg(*[x for c in names for x in (F.count(c).alias(f"f_{c}"), F.count(C(c).cast("string").try_cast("double")).alias(f"n_{c}"))])
    rows = F.array(*[F.struct(F.lit(c).alias("name"), C(f"f_{c}").alias("filled"), C(f"n_{c}").alias("numeric")) for c in names])
    return counts.select(F.explode(rows).alias("r")).select("r.*")


def examples(frame: DataFrame, pattern: str, n: int = 3) -> DataFrame:
    """(name, examples): for each column whose name matches, its ``n`` smallest different values as text, fewer if it has fewer.

    Each value is a minimum over what lies above the one before, so that ``n`` aggregations
    to a single row do and no values are gathered or shuffled.
    """
    import re

    names = [c for c in frame.columns if re.search(pattern, c)]
    texts = frame.select(*[C(f"`{c}`").cast("string").alias(f"c{k}") for k, c in enumerate(names)])
    found: list[list[str]] = [[] for _ in names]
    for turn in range(n):
        above = [C(f"c{k}") if turn == 0 else F.when(C(f"c{k}") > F.lit(v[-1]), C(f"c{k}")) for k, v in enumerate(found) if len(v) == turn]
        todo = [v for v in found if len(v) == turn]
        if not todo:
            break
        row = texts.agg(*[F.min(c) for c in above]).first()
        for v, x in zip(todo, row, strict=True):
            v += [x] if x is not None else []
    return frame.sparkSession.createDataFrame(list(zip(names, found, strict=True)), "name string, examples array<string>")


def dem_tiles(box: DataFrame, buffer: float = 0.05) -> DataFrame:
    """(tile, lon, lat) of one-degree tiles, named by their south-west corner, that meet the buffered box (west, south, east, north)."""
    span = lambda a, b: F.sequence(F.floor(C(a) - buffer), F.floor(C(b) + buffer))
    t = box.select(F.explode(span("west", "east")).alias("lon"), "south", "north").select("lon", F.explode(span("south", "north")).alias("lat"))
    part = lambda v, pos, neg, n: F.concat(F.when(C(v) < 0, neg).otherwise(pos), F.lpad(F.abs(C(v)).cast("string"), n, "0"))
    return t.select(F.concat(part("lat", "N", "S", 2), part("lon", "E", "W", 3)).alias("tile"), C("lon").cast("long").alias("lon"), C("lat").cast("long").alias("lat"))
