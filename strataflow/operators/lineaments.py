"""Straight segments along the edges of rasters: gradient peaks, hysteresis across the whole raster, runs on lines.

Only the gradient's peaks are found on tiles, with margins that make the tiling invisible;
all else is joins and windows over edge cells, so that a line comes out once however many
tiles it crosses. Rasters of several passes (lightings, scales) lie side by side under ``key``.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataflow.operators.components import connected_components
from strataflow.operators.spatial import radius_pairs
from strataflow.operators.tiles import smooth
from strataflow.session import cut

C = F.col
#: Directions that lines are looked for in, over half a turn.
ANGLES = 36


@dataclass(frozen=True)
class Scale:
    """What a segment takes: its least length, and the longest gap within it, in cells."""

    least: float = 8.0
    gap: float = 2.0


def peak_cells(a: np.ndarray, sigma: float) -> tuple[np.ndarray, np.ndarray]:
    """The gradient's size after smoothing, and where it is a local maximum along its own direction."""
    s = smooth(a, sigma)
    if min(s.shape) < 2:
        return np.zeros(s.shape), np.zeros(s.shape, bool)
    gr, gc = np.gradient(s)
    # sizes that are equal but for rounding stay equal, however the array is cut
    g = np.round(np.hypot(gr, gc), 9)
    sector = np.round(np.round(np.arctan2(gr, gc) / (np.pi / 4), 6)).astype(int) % 4
    around, peak = np.pad(g, 1), np.zeros(g.shape, bool)
    for k, (i, j) in enumerate(((0, 1), (1, 1), (1, 0), (1, -1))):
        ahead = around[1 + i : 1 + i + g.shape[0], 1 + j : 1 + j + g.shape[1]]
        behind = around[1 - i : 1 - i + g.shape[0], 1 - j : 1 - j + g.shape[1]]
        # of a ridge two cells wide only the second one is a peak
        peak |= (sector == k) & (g > behind) & (g >= ahead)
    return g, peak & (g > 0)


def gradient_peaks(cells: DataFrame, sigma: float = 2.0, size: int = 128) -> DataFrame:
    """(key, r, c, g) of the gradient's peaks of ``cells`` (key, r, c, v); missing values take their raster's mean."""
    margin = int(3 * sigma + 0.5) + 2
    box = cells.groupBy("key").agg(F.avg("v").alias("mean"), *[f(c).alias(f"{n}_{c}") for c in "rc" for f, n in ((F.min, "first"), (F.max, "last"))])
    near = lambda x: F.sequence(F.floor((C(x) - margin) / size), F.floor((C(x) + margin) / size))
    dealt = cells.select("key", "r", "c", "v", F.explode(near("r")).alias("tr")).select("*", F.explode(near("c")).alias("tc")).join(box, "key")

    def one(key, pdf: pd.DataFrame) -> pd.DataFrame:
        p = pdf.iloc[0]
        r0, r1 = (int(x) for x in (max(key[1] * size - margin, p["first_r"]), min((key[1] + 1) * size - 1 + margin, p["last_r"])))
        c0, c1 = (int(x) for x in (max(key[2] * size - margin, p["first_c"]), min((key[2] + 1) * size - 1 + margin, p["last_c"])))
        a = np.full((r1 - r0 + 1, c1 - c0 + 1), 0.0 if p["mean"] is None or p["mean"] != p["mean"] else p["mean"])
        known = pdf[pdf["v"].notna()]
        a[known["r"] - r0, known["c"] - c0] = known["v"]
        g, peak = peak_cells(a, sigma)
        r, c = np.nonzero(peak)
        own = ((r + r0) // size == key[1]) & ((c + c0) // size == key[2])
        return pd.DataFrame({"key": key[0], "r": r[own] + r0, "c": c[own] + c0, "g": g[r[own], c[own]]})

    return dealt.groupBy("key", "tr", "tc").applyInPandas(one, "key int, r int, c int, g double")


def hysteresis(peaks: DataFrame, low: Column, high: Column) -> DataFrame:
    """The peaks of at least ``low`` that are joined, over eight neighbours and any distance, to one of at least ``high``."""
    weak = cut(peaks.where(C("g") >= low).select("key", "r", "c", (C("g") >= high).alias("strong"), F.struct("key", "r", "c").alias("cell")))
    beside = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in ((0, 1), (1, -1), (1, 0), (1, 1))])).alias("s")
    steps = weak.select("key", C("cell").alias("a"), beside, "r", "c").select("key", "a", (C("r") + C("s.i")).alias("r"), (C("c") + C("s.j")).alias("c"))
    edges = steps.join(weak.select("key", "r", "c", C("cell").alias("b")), ["key", "r", "c"]).select("a", "b")
    group = connected_components(edges).withColumnRenamed("node", "cell")
    named = weak.join(group, "cell", "left").withColumn("component", F.coalesce("component", "cell"))
    return named.join(named.where("strong").select("component").distinct(), "component", "left_semi").select("key", "r", "c")


def _runs(pixels: DataFrame, gap: Column) -> DataFrame:
    """``pixels`` of lines (key, k, rho, along, r, c) with ``run``: the line is cut where the next pixel is more than the gap away."""
    over = "over (partition by key, k, rho order by along, r, c)"
    cutoff = pixels.withColumn("step", F.expr(f"along - lag(along) {over}")).withColumn("new", F.when(C("step") > gap + 1, 1).otherwise(0))
    return cutoff.withColumn("run", F.expr(f"sum(new) {over}")).drop("step", "new")


def segments(mask: DataFrame, scales: list[Scale]) -> DataFrame:
    """(key, r0, c0, r1, c1): straight runs of the cells of ``mask`` (key, r, c); ``scales`` by key.

    Lines are three cells wide, so that a cell is on three of each direction, and an edge
    between two directions isn't split lengthwise. Runs along a line are as long as gaps allow;
    each cell goes to the longest run it is on, and what a run is left with, cut at its
    gaps, is a segment if it is long enough. Cells that end in no segment are tried again
    among themselves until no segment is found.
    """
    by_key = lambda values: F.element_at(F.array(*[F.lit(float(v)) for v in values]), C("key") + 1)
    gap, least = by_key([s.gap for s in scales]), by_key([s.least for s in scales])
    theta = [k * np.pi / ANGLES for k in range(ANGLES)]
    rho = lambda t: F.round(C("r") * float(np.sin(t)) + C("c") * float(np.cos(t))).cast("int")
    along = lambda t: C("r") * float(np.cos(t)) - C("c") * float(np.sin(t))
    lines = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), (rho(t) + F.lit(i)).alias("rho"), along(t).alias("along")) for k, t in enumerate(theta) for i in (-1, 0, 1)])).alias("l")
    line, ends = ["key", "k", "rho", "run"], F.struct("along", "r", "c")
    left, out = cut(mask.select("key", "r", "c").distinct()), None
    while True:
        on = _runs(left.select("key", "r", "c", lines).select("key", "r", "c", "l.*"), gap)
        long = on.groupBy(*line).agg((F.max("along") - F.min("along")).alias("length"), F.count("*").alias("n")).where(C("length") >= least)
        best = on.join(long, line).withColumn("rank", F.expr("row_number() over (partition by key, r, c order by length desc, n desc, k, rho, run)")).where("rank = 1")
        kept = _runs(best.select("key", "k", "rho", "along", "r", "c"), gap)
        found = kept.groupBy(*line).agg(F.min(ends).alias("a"), F.max(ends).alias("b")).where(C("b.along") - C("a.along") >= least)
        found = cut(found)
        if found.isEmpty():
            break
        got = found.select("key", C("a.r").alias("r0"), C("a.c").alias("c0"), C("b.r").alias("r1"), C("b.c").alias("c1"))
        out = got if out is None else out.unionByName(got)
        left = cut(left.join(kept.join(found.select(*line), line, "left_semi").select("key", "r", "c"), ["key", "r", "c"], "left_anti"))
    return out if out is not None else mask.select("key", *[C("r").alias(c) for c in ("r0", "c0", "r1", "c1")]).where("false")


def joined(found: DataFrame, scales: list[Scale], turn: float = 10.0) -> DataFrame:
    """``found`` with segments of one key put together where one goes on in the other's direction.

    Ends within a gap and four cells (the width of a line and one) meet if the segments' directions differ by ``turn``
    degrees at most and they lead away from each other. What hangs together that way becomes
    one segment, between its farthest ends along the longest piece.
    """
    own = cut(found.withColumn("code", F.struct("key", "r0", "c0", "r1", "c1")))
    angle = F.pmod(F.degrees(F.atan2((C("r1") - C("r0")).cast("double"), (C("c1") - C("c0")).cast("double"))), F.lit(180.0))
    end = lambda a, b: F.struct(C(f"r{a}").alias("y"), C(f"c{a}").alias("x"), C(f"r{b}").alias("oy"), C(f"c{b}").alias("ox"))
    ends = own.select("key", C("code").alias("segment"), angle.alias("angle"), F.posexplode(F.array(end(0, 1), end(1, 0))).alias("side", "e"))
    reach = F.element_at(F.array(*[F.lit(float(s.gap) + 4) for s in scales]), C("a_key") + 1)
    points = ends.select(F.struct("segment", "side").alias("code"), C("e.x").cast("double").alias("x"), C("e.y").cast("double").alias("y"), "key", "segment", "angle", C("e.ox").alias("ox"), C("e.oy").alias("oy"))
    met = radius_pairs(points, max(s.gap for s in scales) + 4.0, carry=("key", "segment", "angle", "ox", "oy")).where((C("a_key") == C("b_key")) & (C("a_segment") != C("b_segment")) & (C("d") <= reach))
    bend = F.abs(C("a_angle") - C("b_angle"))
    size = lambda p: F.hypot(C(f"{p}x") - C(f"{p}_ox"), C(f"{p}y") - C(f"{p}_oy"))
    onward = F.hypot(C("a_ox") - C("b_ox"), C("a_oy") - C("b_oy")) >= F.greatest(size("a"), size("b"))
    links = met.where((F.least(bend, 180 - bend) <= turn) & onward).select(C("a_segment").alias("a"), C("b_segment").alias("b"))
    group = connected_components(links).withColumnRenamed("node", "code")
    named = own.join(group, "code", "left").withColumn("component", F.coalesce("component", "code"))
    length = F.hypot(C("r1") - C("r0"), C("c1") - C("c0"))
    lead = named.groupBy("component").agg(F.max(F.struct(length.alias("length"), ((C("r1") - C("r0")) / length).alias("dr"), ((C("c1") - C("c0")) / length).alias("dc"))).alias("d"))
    both = named.join(lead, "component").select("component", "key", "d", F.explode(F.array(F.struct(C("r0").alias("r"), C("c0").alias("c")), F.struct(C("r1").alias("r"), C("c1").alias("c")))).alias("e"))
    at = F.struct((C("e.r") * C("d.dr") + C("e.c") * C("d.dc")).alias("along"), C("e.r").alias("r"), C("e.c").alias("c"))
    return both.groupBy("component", "key").agg(F.min(at).alias("a"), F.max(at).alias("b")).select("key", C("a.r").alias("r0"), C("a.c").alias("c0"), C("b.r").alias("r1"), C("b.c").alias("c1"))


def extract(mask: DataFrame, scales: list[Scale]) -> DataFrame:
    """Segments of the least lengths of ``scales``: pieces of half of them, put together where they go on in each other."""
    pieces = joined(segments(mask, [Scale(s.least / 2, s.gap) for s in scales]), scales)
    least = F.element_at(F.array(*[F.lit(float(s.least)) for s in scales]), C("key") + 1)
    return pieces.where(F.hypot(C("r1") - C("r0"), C("c1") - C("c0")) >= least)


def inside_frame(found: DataFrame, grid: DataFrame, frame: int = 10) -> DataFrame:
    """The segments that don't run along the raster's border: those with both ends within ``frame`` cells of one side go."""
    box = F.broadcast(grid.agg(F.min("r").alias("__r0"), F.max("r").alias("__r1"), F.min("c").alias("__c0"), F.max("c").alias("__c1")))
    at = lambda c: ((C(f"{c}0") < C(f"__{c}0") + frame) & (C(f"{c}1") < C(f"__{c}0") + frame)) | ((C(f"{c}0") > C(f"__{c}1") - frame) & (C(f"{c}1") > C(f"__{c}1") - frame))
    return found.crossJoin(box).where(~(at("r") | at("c"))).select(*found.columns)
