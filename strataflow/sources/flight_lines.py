"""Flight-line point files: positional columns in whitespace text."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strataflow.functions.geometry import utm_inverse

C = F.col


@dataclass(frozen=True)
class Layout:
    """0-based columns of a file: place in degrees, place in metres to fall back on, channels, and how many lines to skip."""

    lon: int
    lat: int
    channels: dict[str, int]
    x: int | None = None
    y: int | None = None
    keep_every: int = 1

    @property
    def width(self) -> int:
        return max(self.lon, self.lat, self.x or 0, self.y or 0, *self.channels.values()) + 1


@dataclass(frozen=True)
class Box:
    """West, south, east, north in degrees."""

    west: float = -180.0
    south: float = -90.0
    east: float = 180.0
    north: float = 90.0


def numbered(frame: DataFrame, key: str, order: str, span: int = 1 << 17) -> DataFrame:
    """Adds n: each row's number by ``key`` in the order of the whole number ``order``, from 1.

    Rows are ordered within ranges of ``span`` only, on top of the rows of the ranges below,
    so that no task holds all rows of a key.
    """
    ranged = frame.withColumn("__range", F.floor(C(order) / span))
    counts = ranged.groupBy(key, "__range").agg(F.count("*").alias("__rows"))
    before = counts.select(key, "__range", (F.expr(f"sum(__rows) over (partition by {key} order by __range)") - C("__rows")).alias("__before"))
    own = ranged.withColumn("n", F.expr(f"row_number() over (partition by {key}, __range order by {order})"))
    return own.join(before, [key, "__range"]).withColumn("n", C("n") + C("__before")).drop("__range", "__before")


def parse_lines(lines: DataFrame, layout: Layout, box: Box) -> DataFrame:
    """(file_no, line_no, lon, lat, channels) of the data lines of ``lines`` (file_no, line_no, value).

    Lines that start with "/" and lines with too few columns are no data; of the rest every
    n-th of a file is kept. Places out of range come from the metric columns; points outside
    the box go, bad channel values are null.
    """
    tokens = F.split(F.trim("value"), r"\s+")
    data = lines.where(~F.startswith("value", F.lit("/"))).select("file_no", "line_no", tokens.alias("t")).where(F.size("t") >= layout.width)
    if layout.keep_every > 1:
        data = numbered(data, "file_no", "line_no").where(C("n") % layout.keep_every == 0).drop("n")
    number = lambda i: F.get("t", F.lit(i)).try_cast("double")
    lon, lat = number(layout.lon), number(layout.lat)
    ok = lon.between(-180, 180) & lat.between(-90, 90)
    at: tuple[Column, Column] = (F.when(ok, lon), F.when(ok, lat))
    if layout.x is not None and layout.y is not None:
        back = utm_inverse(number(layout.x), number(layout.y))
        at = (F.coalesce(at[0], back[0]), F.coalesce(at[1], back[1]))
    # places first: only points in the box have their channels parsed
    placed = data.select("file_no", "line_no", "t", at[0].alias("lon"), at[1].alias("lat")).where(C("lon").between(box.west, box.east) & C("lat").between(box.south, box.north))
    return placed.select("file_no", "line_no", "lon", "lat", *[number(i).alias(n) for n, i in layout.channels.items()])


def read_files(spark: SparkSession, path: str, layout: Layout, box: Box) -> DataFrame:
    """The points of all text files below ``path``; see ``read_lines``."""
    return parse_lines(read_lines(spark, path), layout, box)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file_no, line_no, value) of all text files below ``path``, with a file's name as its number and lines numbered from 0.

    Files are split like any text: lines are numbered within each block that a task reads, on
    top of the lines of the blocks before it.
    """
    raw = spark.read.text(path).select(C("_metadata.file_path").alias("file_no"), C("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("place"), "value")
    counts = raw.groupBy("file_no", "block").agg(F.count("*").alias("lines"))
    before = counts.select("file_no", "block", (F.expr("sum(lines) over (partition by file_no order by block)") - C("lines")).alias("before"))
    own = raw.withColumn("k", F.expr("row_number() over (partition by file_no, block order by place)"))
    return own.join(before, ["file_no", "block"]).select("file_no", (C("before") + C("k") - 1).alias("line_no"), "value")
