"""Azimuths, blocks and map projection."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def azimuth(r0: Column, c0: Column, r1: Column, c1: Column) -> Column:
    """Azimuth in [0, 180) of a segment between pixels, rows counted downwards."""
    return F.pmod(F.degrees(F.atan2((c1 - c0).cast("double"), (r0 - r1).cast("double"))), F.lit(180.0))


def family(az: Column, bounds: list[tuple[str, float, float]]) -> Column:
    """The first family whose half-open range holds ``az``; a range may wrap at 180."""
    out = F.lit(None).cast("string")
    for name, a, b in reversed(bounds):
        inside = (az >= a) & (az < b) if a <= b else (az >= a) | (az < b)
        out = F.when(inside, F.lit(name)).otherwise(out)
    return out


def direction_class(dx: Column, dy: Column) -> Column:
    """One of four 45-degree classes around N-S, NE-SW, E-W and NW-SE."""
    az = F.pmod(F.degrees(F.atan2(dx, dy)), F.lit(180.0))
    return F.when((az < 22.5) | (az >= 157.5), "N-S").when(az < 67.5, "NE-SW").when(az < 112.5, "E-W").otherwise("NW-SE")


def block(x: Column, size: float) -> Column:
    """Index of the block of ``size`` that holds x (floor, so that negatives go down)."""
    return F.floor(x / F.lit(float(size)))


# GRS80 and the transverse Mercator zone 23 south.
AXIS, FLATTENING, SCALE, MERIDIAN, FALSE_EAST, FALSE_NORTH = 6378137.0, 1 / 298.257222101, 0.9996, -45.0, 500_000.0, 10_000_000.0


def kruger() -> tuple[float, list[float], list[float]]:
    """Rectifying radius and the series of the forward and inverse projection, to the fourth order in the third flattening."""
    n = FLATTENING / (2 - FLATTENING)
    radius = AXIS / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    forward = [
        n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16 + 41 * n**4 / 180,
        13 * n**2 / 48 - 3 * n**3 / 5 + 557 * n**4 / 1440,
        61 * n**3 / 240 - 103 * n**4 / 140,
        49561 * n**4 / 161280,
    ]
    inverse = [
        n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96 - n**4 / 360,
        n**2 / 48 + n**3 / 15 - 437 * n**4 / 1440,
        17 * n**3 / 480 - 37 * n**4 / 840,
        4397 * n**4 / 161280,
    ]
    return radius, forward, inverse


def utm_forward(lon: Column, lat: Column) -> tuple[Column, Column]:
    """Easting and northing of geographic degrees."""
    radius, alpha, _ = kruger()
    e = math.sqrt(FLATTENING * (2 - FLATTENING))
    phi, lam = F.radians(lat), F.radians(lon - F.lit(MERIDIAN))
    t = F.sinh(F.atanh(F.sin(phi)) - F.lit(e) * F.atanh(F.lit(e) * F.sin(phi)))
    xi, eta = F.atan2(t, F.cos(lam)), F.atanh(F.sin(lam) / F.sqrt(1 + t * t))
    north, east = xi, eta
    for k, a in enumerate(alpha, 1):
        north = north + a * F.sin(2.0 * k * xi) * F.cosh(2.0 * k * eta)
        east = east + a * F.cos(2.0 * k * xi) * F.sinh(2.0 * k * eta)
    return F.lit(FALSE_EAST) + SCALE * radius * east, F.lit(FALSE_NORTH) + SCALE * radius * north


def utm_inverse(x: Column, y: Column, rounds: int = 5) -> tuple[Column, Column]:
    """Longitude and latitude in degrees of easting and northing."""
    radius, _, beta = kruger()
    e2 = FLATTENING * (2 - FLATTENING)
    e = math.sqrt(e2)
    xi0, eta0 = (y - FALSE_NORTH) / (SCALE * radius), (x - FALSE_EAST) / (SCALE * radius)
    xi, eta = xi0, eta0
    for k, b in enumerate(beta, 1):
        xi = xi - b * F.sin(2.0 * k * xi0) * F.cosh(2.0 * k * eta0)
        eta = eta - b * F.cos(2.0 * k * xi0) * F.sinh(2.0 * k * eta0)
    tau1 = F.sin(xi) / F.sqrt(F.sinh(eta) * F.sinh(eta) + F.cos(xi) * F.cos(xi))
    # the latitude's tangent from the conformal latitude's, by iteration inside one row
    start = F.struct(tau1.alias("t"), tau1.alias("goal"))

    def step(acc: Column, _: Column) -> Column:
        t = acc.t
        sigma = F.sinh(e * F.atanh(e * t / F.sqrt(1 + t * t)))
        now = t * F.sqrt(1 + sigma * sigma) - sigma * F.sqrt(1 + t * t)
        delta = (acc.goal - now) / F.sqrt(1 + now * now) * (1 + (1 - e2) * t * t) / ((1 - e2) * F.sqrt(1 + t * t))
        return F.struct((t + delta).alias("t"), acc.goal.alias("goal"))

    tau = F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, step, lambda acc: acc.t)
    return F.lit(MERIDIAN) + F.degrees(F.atan2(F.sinh(eta), F.cos(xi))), F.degrees(F.atan(tau))


def haversine(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Great-circle distance in metres."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * 6371008.8 * F.asin(F.sqrt(a))
