"""Transverse Mercator as column expressions: the Krüger series in the third flattening, forward and back."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The ellipsoid GRS80, and zone 32 of UTM on it.
AXIS, FLATTENING = 6378137.0, 1 / 298.257222101
MERIDIAN, SCALE, FALSE_EAST = 9.0, 0.9996, 500_000.0
_N = FLATTENING / (2 - FLATTENING)
#: The series' coefficients, by power of n from the first on, for each multiple of the angle.
FORWARD = ((1 / 2, -2 / 3, 5 / 16, 41 / 180), (0, 13 / 48, -3 / 5, 557 / 1440), (0, 0, 61 / 240, -103 / 140), (0, 0, 0, 49561 / 161280))
BACK = ((1 / 2, -2 / 3, 37 / 96, -1 / 360), (0, 1 / 48, 1 / 15, -437 / 1440), (0, 0, 17 / 480, -37 / 840), (0, 0, 0, 4397 / 161280))
LATITUDE = ((2, -2 / 3, -2, 116 / 45), (0, 7 / 3, -8 / 5, -227 / 45), (0, 0, 56 / 15, -136 / 35), (0, 0, 0, 4279 / 630))
RADIUS = AXIS / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
ECCENTRICITY = 2 * math.sqrt(_N) / (1 + _N)


def series(table: tuple) -> list[float]:
    return [sum(c * _N ** (k + 1) for k, c in enumerate(row)) for row in table]


def _sum(table: tuple, xi: Column, eta: Column, first, second) -> Column:
    return sum((F.lit(c) * first(2 * (j + 1) * xi) * second(2 * (j + 1) * eta) for j, c in enumerate(series(table))), F.lit(0.0))


def projected(lon: Column, lat: Column) -> tuple[Column, Column]:
    """(easting, northing) of degrees."""
    s, lam = F.sin(F.radians(lat)), F.radians(lon - MERIDIAN)
    t = F.sinh(F.atanh(s) - ECCENTRICITY * F.atanh(ECCENTRICITY * s))
    xi, eta = F.atan2(t, F.cos(lam)), F.atanh(F.sin(lam) / F.sqrt(1 + t * t))
    east = eta + _sum(FORWARD, xi, eta, F.cos, F.sinh)
    north = xi + _sum(FORWARD, xi, eta, F.sin, F.cosh)
    return FALSE_EAST + SCALE * RADIUS * east, SCALE * RADIUS * north


def geographic(east: Column, north: Column) -> tuple[Column, Column]:
    """(longitude, latitude) in degrees of an easting and a northing."""
    xi, eta = north / (SCALE * RADIUS), (east - FALSE_EAST) / (SCALE * RADIUS)
    x = xi - _sum(BACK, xi, eta, F.sin, F.cosh)
    y = eta - _sum(BACK, xi, eta, F.cos, F.sinh)
    chi = F.asin(F.sin(x) / F.cosh(y))
    lat = chi + sum((F.lit(c) * F.sin(2 * (j + 1) * chi) for j, c in enumerate(series(LATITUDE))), F.lit(0.0))
    return MERIDIAN + F.degrees(F.atan(F.sinh(y) / F.cos(x))), F.degrees(lat)


def corners(extents: DataFrame) -> DataFrame:
    """A row for each corner of extents (id, west, south, east, north): lon, lat, and how far from the
    corner the way there and back ends. The axes are always easting and northing."""
    at = F.explode(F.array(*(F.struct(F.col(x).alias("x"), F.col(y).alias("y")) for x in ("west", "east") for y in ("south", "north"))))
    there = extents.select("id", at.alias("c")).select("id", "c.x", "c.y")
    lon, lat = geographic(F.col("x"), F.col("y"))
    placed = there.withColumns({"lon": lon, "lat": lat})
    x, y = projected(F.col("lon"), F.col("lat"))
    return placed.withColumn("error", F.hypot(x - F.col("x"), y - F.col("y")))


def extent_findings(extents: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """(id, finding), a row for each fault of extents (id, west, south, east, north, side, spacing, centres, north_up):
    spans have to be side - 1 spacings, as bounds are the centres of the outer samples."""
    span = (F.col("side") - 1) * F.col("spacing")
    off = (F.abs(F.col("east") - F.col("west") - span) > tolerance) | (F.abs(F.col("north") - F.col("south") - span) > tolerance)
    said = F.array_compact(F.array(F.when(off, "span"), F.when(~F.coalesce("centres", F.lit(False)), "centres"), F.when(~F.coalesce("north_up", F.lit(False)), "orientation")))
    return extents.select("id", F.explode(said).alias("finding"))
