"""Stencils over a field (region, row, col, z): neighbours by window functions along rows and columns.

Windows are partitioned by one line of one field, so a large field spreads over all tasks.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

#: Offsets of the eight neighbours, in the order that breaks ties.
NEIGHBOURS = [(-1, -1), (-1, 0), (-1, 1), (0, -1), (0, 1), (1, -1), (1, 0), (1, 1)]


def along_row() -> WindowSpec:
    return Window.partitionBy("region", "row").orderBy("col")


def along_col() -> WindowSpec:
    return Window.partitionBy("region", "col").orderBy("row")


def neighbours(cells: DataFrame, value: str = "z") -> DataFrame:
    """cells with west, east, north and south neighbours' values; null beyond the edge."""
    v = F.col(value)
    return cells.withColumns({"w": F.lag(v).over(along_row()), "e": F.lead(v).over(along_row())}).withColumns({"n": F.lag(v).over(along_col()), "s": F.lead(v).over(along_col())})


def _central(before: Column, at: Column, after: Column, spacing: float) -> Column:
    return F.when(before.isNull(), (after - at) / spacing).when(after.isNull(), (at - before) / spacing).otherwise((after - before) / (2 * spacing))


def gradient(cells: DataFrame, spacing: float = 1.0) -> DataFrame:
    """cells with gx and gy: central differences inside, one-sided at the edges."""
    z = F.col("z")
    out = neighbours(cells).withColumns({"gx": _central(F.col("w"), z, F.col("e"), spacing), "gy": _central(F.col("n"), z, F.col("s"), spacing)})
    return out.drop("w", "e", "n", "s")


def slope(cells: DataFrame, spacing: float = 1.0) -> DataFrame:
    return gradient(cells, spacing).withColumn("slope", F.sqrt(F.col("gx") * F.col("gx") + F.col("gy") * F.col("gy")))


def hillshade(cells: DataFrame, spacing: float = 1.0, azimuth: float = 315.0, altitude: float = 45.0) -> DataFrame:
    """cells with shade, 0 to 1: the cosine between the surface's normal and the light."""
    az, alt = F.radians(F.lit(azimuth)), F.radians(F.lit(altitude))
    g = gradient(cells, spacing)
    lx, ly, lz = F.sin(az) * F.cos(alt), -F.cos(az) * F.cos(alt), F.sin(alt)
    dot = (lz - F.col("gx") * lx - F.col("gy") * ly) / F.sqrt(1 + F.col("gx") * F.col("gx") + F.col("gy") * F.col("gy"))
    return g.withColumn("shade", F.greatest(F.lit(0.0), dot)).drop("gx", "gy")


def laplacian(cells: DataFrame, spacing: float = 1.0) -> DataFrame:
    """cells with lap: five points, edges repeated, so that it sums to zero."""
    z = F.col("z")
    total = sum((F.coalesce(F.col(k), z) for k in ("e", "n", "s")), F.coalesce(F.col("w"), z)) - 4 * z
    return neighbours(cells).withColumn("lap", total / (spacing * spacing)).drop("w", "e", "n", "s")


def teacher_flux(g: Column, critical: float, diffusivity: float = 1.0) -> Column:
    """Nonlinear diffusion: the flux grows without bound as a slope nears the critical one (clipped at 0.99)."""
    r = F.least(F.abs(g) / critical, F.lit(0.99))
    return diffusivity * g / (1 - r * r)


def flux_divergence(cells: DataFrame, spacing: float = 1.0, flux=lambda g: g) -> DataFrame:
    """cells with div: the sum of the fluxes through a cell's faces; no flux leaves the field."""
    z = F.col("z")
    face = lambda d: F.coalesce(flux(d / spacing), F.lit(0.0))
    total = face(F.col("e") - z) - face(z - F.col("w")) + face(F.col("s") - z) - face(z - F.col("n"))
    return neighbours(cells).withColumn("div", total / spacing).drop("w", "e", "n", "s")


def variable_flux(cells: DataFrame, critical: float, spacing: float = 1.0) -> DataFrame:
    """cells (with d, a diffusivity at each node) and div: nonlinear fluxes through a cell's faces, each
    under the harmonic mean of the diffusivities on its two sides; no flux leaves the field."""
    z, d, out = F.col("z"), F.col("d"), cells
    sides = {"e": (F.lead, along_row(), 1), "w": (F.lag, along_row(), -1), "s": (F.lead, along_col(), 1), "n": (F.lag, along_col(), -1)}
    total = F.lit(0.0)
    for name, (to, window, sign) in sides.items():
        out = out.withColumns({f"__z{name}": to("z").over(window), f"__d{name}": to("d").over(window)})
        there, other = F.col(f"__z{name}"), F.col(f"__d{name}")
        slope = (there - z) / spacing * sign
        total = total + sign * F.coalesce(teacher_flux(slope, critical) * 2 * d * other / (d + other), F.lit(0.0))
    return out.withColumn("div", total / spacing).select(*cells.columns, "div")


def whole(cells: DataFrame, side: int) -> DataFrame:
    """cells as they are; a field that lacks a node, has one twice or a missing height is an error."""
    held = cells.groupBy("region").agg(F.count("*").alias("__n"), F.countDistinct("row", "col").alias("__d"), F.count_if(F.isnan("z") | F.col("z").isNull() | ~F.col("row").between(0, side - 1) | ~F.col("col").between(0, side - 1)).alias("__bad"))
    fault = (F.col("__n") != side * side) | (F.col("__d") != side * side) | (F.col("__bad") > 0)
    tested = held.select("region", F.when(fault, F.raise_error(F.concat(F.lit("not a whole field: "), F.col("region").cast("string")))).otherwise(F.lit(True)).alias("__whole"))
    return cells.join(tested.where("__whole"), "region").drop("__whole")


def smooth_decimate(cells: DataFrame, side: int) -> DataFrame:
    """The next pyramid level: [1, 4, 6, 4, 1] / 16 along both axes with repeated edges, every second node."""

    def taps(window: Window) -> Column:
        z = F.col("z")
        one_b, one_a = F.coalesce(F.lag(z, 1).over(window), z), F.coalesce(F.lead(z, 1).over(window), z)
        two_b = F.coalesce(F.lag(z, 2).over(window), one_b)
        two_a = F.coalesce(F.lead(z, 2).over(window), one_a)
        return (two_b + 4 * one_b + 6 * z + 4 * one_a + two_a) / 16

    half = cells.withColumn("z", taps(along_row())).where("col % 2 = 0")
    both = half.withColumn("z", taps(along_col())).where("row % 2 = 0")
    return both.select("region", (F.col("row") / 2).cast("int").alias("row"), (F.col("col") / 2).cast("int").alias("col"), "z")


def twist(cells: DataFrame) -> DataFrame:
    """(region, row, col, twist) of each square of four nodes: |h00 + h11 - h01 - h10| / 4."""
    right = cells.withColumn("h01", F.lead("z").over(along_row()))
    out = right.withColumns({"h10": F.lead("z").over(along_col()), "h11": F.lead("h01").over(along_col())})
    return out.where("h01 IS NOT NULL AND h10 IS NOT NULL").select("region", "row", "col", (F.abs(F.col("z") + F.col("h11") - F.col("h01") - F.col("h10")) / 4).alias("twist"))


def offsets(cells: DataFrame, around: list[tuple[int, int]]) -> DataFrame:
    """cells with a row for each offset: `order`, and the neighbour's `nrow`, `ncol`."""
    table = F.array(*(F.struct(F.lit(k).alias("order"), F.lit(a).alias("dr"), F.lit(b).alias("dc")) for k, (a, b) in enumerate(around)))
    out = cells.withColumn("__o", F.explode(table))
    return out.select(*cells.columns, F.col("__o.order").alias("order"), F.col("__o.dr").alias("dr"), F.col("__o.dc").alias("dc"), (F.col("row") + F.col("__o.dr")).alias("nrow"), (F.col("col") + F.col("__o.dc")).alias("ncol"))


def autocovariance(cells: DataFrame, most: int) -> DataFrame:
    """(region, h, v): the covariance of a field with itself, averaged over the shifts that round to h.
    Opposite shifts have the same, so half of them are looked at."""
    shifts = [(a, b) for a in range(most + 1) for b in range(-most, most + 1) if (a > 0 or b >= 0) and round(math.hypot(a, b)) <= most]
    mean = cells.groupBy("region").agg(F.avg("z").alias("__m"))
    own = cells.join(mean, "region").select("region", "row", "col", (F.col("z") - F.col("__m")).alias("z"))
    there = own.select("region", F.col("row").alias("nrow"), F.col("col").alias("ncol"), F.col("z").alias("o"))
    met = offsets(own, shifts).join(there, ["region", "nrow", "ncol"])
    each = met.groupBy("region", "dr", "dc").agg(F.avg(F.col("z") * F.col("o")).alias("v"))
    h = F.rint(F.sqrt(F.col("dr") * F.col("dr") + F.col("dc") * F.col("dc"))).cast("int")
    return each.groupBy("region", h.alias("h")).agg(F.avg("v").alias("v"))


def rolled(cells: DataFrame, rows: int, cols: int, side: int) -> DataFrame:
    """The field shifted around its edges."""
    return cells.withColumns({"row": F.pmod(F.col("row") + rows, F.lit(side)), "col": F.pmod(F.col("col") + cols, F.lit(side))})
