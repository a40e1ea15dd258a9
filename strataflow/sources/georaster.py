"""Rasters with their place on the ground: reading from several folders, alignment, zoom and stacks."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strataflow.functions.geometry import utm_forward, utm_inverse
from strataflow.sources.tables import is_written, read_raster, write_raster

C = F.col
#: Systems that coordinates can be changed between: geographic degrees, and metres in zone 23 south, of one datum.
DEGREES, METRES = 4674, 31983


@dataclass(frozen=True)
class Place:
    """Where a raster lies: its first corner, the cells' steps (``dy`` below 0 where rows go down), rows, columns, system."""

    x0: float
    y0: float
    dx: float
    dy: float
    rows: int
    cols: int
    epsg: int = METRES

    def centre(self, r: Column, c: Column) -> tuple[Column, Column]:
        return F.lit(self.x0) + (c + 0.5) * self.dx, F.lit(self.y0) + (r + 0.5) * self.dy

    def index(self, x: Column, y: Column) -> tuple[Column, Column]:
        """Fractional row and column of a point; cell centres are whole numbers."""
        return (y - self.y0) / self.dy - 0.5, (x - self.x0) / self.dx - 0.5

    def cells(self, spark: SparkSession) -> DataFrame:
        """(r, c) of every cell."""
        n = spark.range(self.rows * self.cols)
        return n.select(F.floor(C("id") / self.cols).cast("int").alias("r"), (C("id") % self.cols).cast("int").alias("c"))


@dataclass(frozen=True)
class Raster:
    """Cells (r, c, v), nodata as null, and their place."""

    cells: DataFrame
    place: Place

    def write(self, path: str, nodata: float = -9999.0, **tags: str) -> None:
        write_raster(self.cells.fillna({"v": nodata}), path, {"place": asdict(self.place), "nodata": nodata, "tags": tags})


def read(spark: SparkSession, folders: list[str], name: str) -> Raster:
    """The raster ``name`` of the first of ``folders`` that has it."""
    for f in folders:
        if is_written(spark, f"{f}/{name}"):
            _, meta = read_raster(spark, f"{f}/{name}")
            cells, _ = read_raster(spark, f"{f}/{name}", meta["nodata"])
            return Raster(cells, Place(**meta["place"]))
    raise FileNotFoundError(f"{name} is in none of {', '.join(folders)}")


def between(x: Column, y: Column, source: int, target: int) -> tuple[Column, Column]:
    """A point's coordinates in another system."""
    if source == target:
        return x, y
    change: dict[tuple[int, int], Callable] = {(DEGREES, METRES): utm_forward, (METRES, DEGREES): utm_inverse}
    if (source, target) not in change:
        raise ValueError(f"no way from system {source} to {target}")
    return change[source, target](x, y)


def sample(points: DataFrame, raster: Raster, r: Column, c: Column, order: int = 1) -> DataFrame:
    """``points`` with ``v``, the raster at fractional places: of the nearest cell (order 0), or between four (order 1).

    A place whose nearest cell is missing has no value; of the four cells the known ones
    count, by their shares. A place is joined with its cells by their numbers, so that any
    raster serves any number of points.
    """
    cells = raster.cells.where(C("v").isNotNull()).select(C("r").alias("__r"), C("c").alias("__c"), "v")
    near_r, near_c = F.floor(r + 0.5).cast("int"), F.floor(c + 0.5).cast("int")
    if order == 0:
        return points.withColumns({"__r": near_r, "__c": near_c}).join(cells, ["__r", "__c"], "left").drop("__r", "__c")
    kept = points.columns
    placed = points.withColumns({"__id": F.monotonically_increasing_id(), "__pr": r, "__pc": c, "__nr": near_r, "__nc": near_c})
    corner = F.explode(F.array(*[F.struct((F.floor("__pr") + i).cast("int").alias("r"), (F.floor("__pc") + j).cast("int").alias("c")) for i in (0, 1) for j in (0, 1)])).alias("__k")
    weight = (1 - F.abs(C("__pr") - C("__r"))) * (1 - F.abs(C("__pc") - C("__c")))
    met = placed.select("*", corner).withColumns({"__r": C("__k.r"), "__c": C("__k.c")}).join(cells, ["__r", "__c"], "left").withColumn("__w", F.when(C("v").isNotNull(), weight))
    nearest = F.max(F.when((C("__r") == C("__nr")) & (C("__c") == C("__nc")), C("v"))).isNotNull()
    got = met.groupBy("__id", *kept).agg(F.when(nearest, F.sum(C("__w") * C("v")) / F.sum("__w")).alias("v"))
    return got.drop("__id")


def align(raster: Raster, to: Place, order: int = 1) -> Raster:
    """The raster on the cells of ``to``, whatever its own origin, cell size and system; itself where it lies there already."""
    if raster.place == to:
        return raster
    x, y = to.centre(C("r"), C("c"))
    r, c = raster.place.index(*between(x, y, to.epsg, raster.place.epsg))
    return Raster(sample(to.cells(raster.cells.sparkSession), raster, r, c, order), to)


def zoom(raster: Raster, factor: float) -> Raster:
    """The raster on ``factor`` times as many rows and columns, between the same first and last cell centres (order 1)."""
    p = raster.place
    rows, cols = max(1, round(p.rows * factor)), max(1, round(p.cols * factor))
    step = lambda a, b: (a - 1) / (b - 1) if b > 1 else 0.0
    sr, sc = step(p.rows, rows), step(p.cols, cols)
    to = Place(p.x0 + 0.5 * p.dx - 0.5 * sc * p.dx, p.y0 + 0.5 * p.dy - 0.5 * sr * p.dy, p.dx * sc, p.dy * sr, rows, cols, p.epsg)
    return Raster(sample(to.cells(raster.cells.sparkSession), raster, C("r") * sr, C("c") * sc), to)


def stack(rasters: dict[str, Raster], to: Place) -> DataFrame:
    """(r, c and a column for each of ``rasters``) on the cells of ``to``."""
    out = None
    for name, raster in rasters.items():
        cells = align(raster, to).cells.select("r", "c", C("v").cast("double").alias(name))
        out = cells if out is None else out.join(cells, ["r", "c"], "full")
    return out


def at_points(points: DataFrame, rasters: dict[str, Raster], order: int = 0) -> DataFrame:
    """``points`` (x, y in metres) with a column for each raster: its value there."""
    for name, raster in rasters.items():
        r, c = raster.place.index(*between(C("x"), C("y"), METRES, raster.place.epsg))
        points = sample(points, raster, r, c, order).withColumnRenamed("v", name)
    return points
