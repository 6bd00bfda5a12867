"""Points and lines against fields: bilinear and triangulated samples, profiles, robust fits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def corners(points: DataFrame, side: int) -> DataFrame:
    """points (r, c in cells, any key) inside the lattice, with a row for each of the four nodes around
    them and its weight; the last node belongs to the last square."""
    inside = points.where(F.col("r").between(0, side - 1) & F.col("c").between(0, side - 1))
    r0, c0 = F.least(F.floor("r"), F.lit(side - 2)).cast("int"), F.least(F.floor("c"), F.lit(side - 2)).cast("int")
    at = inside.withColumns({"r0": r0, "c0": c0, "fr": F.col("r") - r0, "fc": F.col("c") - c0})
    fr, fc = F.col("fr"), F.col("fc")
    four = [(0, 0, (1 - fr) * (1 - fc)), (0, 1, (1 - fr) * fc), (1, 0, fr * (1 - fc)), (1, 1, fr * fc)]
    table = F.array(*(F.struct((F.col("r0") + a).alias("row"), (F.col("c0") + b).alias("col"), w.alias("w")) for a, b, w in four))
    return at.withColumn("n", F.explode(table)).select(*points.columns, "fr", "fc", "n.row", "n.col", "n.w")


def bilinear(points: DataFrame, cells: DataFrame, key: str, side: int) -> DataFrame:
    """(key, region, z) for points (key, region, r, c) inside their region's field."""
    met = corners(points.select(key, "region", "r", "c"), side).join(cells, ["region", "row", "col"])
    return met.groupBy(key, "region").agg(F.sum(F.col("w") * F.col("z")).alias("z"))


def triangulated(points: DataFrame, cells: DataFrame, key: str, side: int) -> DataFrame:
    """The same on each square's two triangles, which meet along the diagonal from its first node."""
    fr, fc = F.col("fr"), F.col("fc")
    met = corners(points.select(key, "region", "r", "c"), side)
    dr, dc = F.col("row") - F.least(F.floor("r"), F.lit(side - 2)), F.col("col") - F.least(F.floor("c"), F.lit(side - 2))
    upper = F.when(dr + dc == 0, 1 - fc).when((dr == 0) & (dc == 1), fc - fr).when(dr + dc == 2, fr).otherwise(0.0)
    lower = F.when(dr + dc == 0, 1 - fr).when((dr == 1) & (dc == 0), fr - fc).when(dr + dc == 2, fc).otherwise(0.0)
    met = met.withColumn("w", F.when(fc >= fr, upper).otherwise(lower)).join(cells, ["region", "row", "col"])
    return met.groupBy(key, "region").agg(F.sum(F.col("w") * F.col("z")).alias("z"))


def densified(vertices: DataFrame, step: float) -> DataFrame:
    """(line, k, j, x, y): points at most `step` apart on each segment of lines (line, k, x, y); the
    last vertex of a line ends it."""
    w = Window.partitionBy("line").orderBy("k")
    seg = vertices.withColumns({"nx": F.lead("x").over(w), "ny": F.lead("y").over(w)})
    length = F.sqrt((F.col("nx") - F.col("x")) * (F.col("nx") - F.col("x")) + (F.col("ny") - F.col("y")) * (F.col("ny") - F.col("y")))
    n = F.when(F.col("nx").isNull(), 1).otherwise(F.greatest(F.lit(1), F.ceil(length / step))).cast("int")
    out = seg.withColumn("n", n).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    t = F.least(F.lit(1.0), F.col("j") / F.col("n"))
    at = lambda a, b: F.col(a) + t * (F.coalesce(F.col(b), F.col(a)) - F.col(a))
    return out.select("line", "k", "j", at("x", "nx").alias("x"), at("y", "ny").alias("y"))


def mad_core(df: DataFrame, value: str, by: list[str], reach: float = 3 * 1.4826) -> DataFrame:
    """df with the median absolute deviation and whether a row lies within `reach` of it."""
    mid = df.groupBy(*by).agg(F.median(value).alias("__m"))
    off = df.join(mid, by).withColumn("__d", F.abs(F.col(value) - F.col("__m")))
    mad = off.groupBy(*by).agg(F.median("__d").alias("mad"))
    return off.join(mad, by).withColumn("core", F.col("__d") <= reach * F.col("mad")).drop("__m", "__d")


def least_squares2(x: str, y: str, z: str) -> dict[str, Column]:
    """Aggregates of z = a + b x + c y by normal equations on centred sums; sound if x and y are not in line."""
    n, mx, my, mz = F.count(z), F.avg(x), F.avg(y), F.avg(z)
    cov = lambda p, q, mp, mq: F.sum(F.col(p) * F.col(q)) - n * mp * mq
    xx, yy, xy, xz, yz = cov(x, x, mx, mx), cov(y, y, my, my), cov(x, y, mx, my), cov(x, z, mx, mz), cov(y, z, my, mz)
    det = xx * yy - xy * xy
    b, c = (xz * yy - yz * xy) / det, (yz * xx - xz * xy) / det
    return {"a": mz - b * mx - c * my, "b": b, "c": c, "sound": det > 1e-6 * xx * yy}


#: A vertex and its banks, as columns; and the most nodes of fields that go to every executor.
PLACES, MOST_SENT = ("centre", "left", "right"), 2**17


def banks(axes: DataFrame, offset: float, wide: bool = False) -> DataFrame:
    """Points on axes (line, k, x, y) of three vertices or more and, `offset` to either side of them, on what
    should be their banks: (line, k, side, x, y) with side 0, 1 and -1. The direction at a vertex is that
    from the one before to the one after; where the two are one place, there is none, and all three
    points are the vertex. Other columns stay."""
    rest = [c for c in axes.columns if c not in ("line", "k", "x", "y")]
    w, whole = Window.partitionBy("line").orderBy("k"), Window.partitionBy("line")

    def along(c: str) -> Column:
        before, after = F.lag(c).over(w), F.lead(c).over(w)
        return F.when(before.isNull(), after - F.col(c)).when(after.isNull(), F.col(c) - before).otherwise((after - before) / 2)

    out = axes.withColumns({"tx": along("x"), "ty": along("y"), "n": F.count("*").over(whole)}).where("n >= 3")
    size = F.sqrt(F.col("tx") * F.col("tx") + F.col("ty") * F.col("ty"))
    out = out.withColumn("size", F.when(size == 0, 1.0).otherwise(size))

    def place(side: int) -> Column:
        x, y = F.col("x") - offset * side * F.col("ty") / F.col("size"), F.col("y") + offset * side * F.col("tx") / F.col("size")
        return F.struct(F.lit(side).alias("side"), x.alias("x"), y.alias("y"))

    if wide:
        three = F.struct(*(place(s).alias(n) for n, s in zip(PLACES, (0, 1, -1), strict=True)))
        return out.select("line", "k", *rest, F.inline(F.array(three)))  # computed here, once: filters above do not take it apart
    return out.select("line", "k", *rest, F.explode(F.array(*map(place, (0, 1, -1)))).alias("p")).select("line", "k", *rest, "p.side", "p.x", "p.y")


def squares(cells: DataFrame, side: int) -> DataFrame:
    """(region, r0, c0, z, turned): the heights at the four corners of each square, first row first, of a field and
    of the field turned upside down; null where there is no node at all."""
    ends = [(a, b, t) for t in (0, 1) for a in (0, 1) for b in (0, 1)]
    row = lambda t: F.lit(side - 1) - F.col("row") if t else F.col("row")
    at = F.array(*(F.struct((row(t) - a).cast("int").alias("r0"), (F.col("col") - b).cast("int").alias("c0"), F.lit(k).alias("k")) for k, (a, b, t) in enumerate(ends)))
    held = cells.select("region", "z", F.explode(at).alias("p")).where(f"p.r0 BETWEEN 0 AND {side - 2} AND p.c0 BETWEEN 0 AND {side - 2}").groupBy("region", "p.r0", "p.c0")
    z = [F.max(F.when(F.col("p.k") == k, F.col("z"))) for k in range(8)]
    known = [F.max(F.col("p.k") < 4), F.max(F.col("p.k") >= 4)]
    return held.agg(F.when(known[0], F.array(*z[:4])).alias("z"), F.when(known[1], F.array(*z[4:])).alias("turned"))


def _weighed(heights: Column, fr: Column, fc: Column) -> Column:
    """The bilinear height of a square; nodes without a height add nothing, four without have none."""
    parts = [w * heights[k] for k, w in enumerate(((1 - fr) * (1 - fc), (1 - fr) * fc, fr * (1 - fc), fr * fc))]
    return F.when(F.coalesce(*parts).isNotNull(), sum((F.coalesce(p, F.lit(0.0)) for p in parts[1:]), F.coalesce(parts[0], F.lit(0.0))))


def valley_floor(axes: DataFrame, cells: DataFrame, offset: float, side: int) -> DataFrame:
    """(region, samples, below, mirrored): of the vertices of axes (line, region, k, x, y) whose banks lie in the field,
    the share that lies no higher than either bank, and the same share in the field turned upside down. Axes of
    water that are where they should be give a large one, a mirrored field does not. A vertex stays one row with
    its three places, which meet the squares they lie in; fields that are few go to every executor."""
    most = MOST_SENT // (side * side)
    crossed = [r.region for r in axes.select("region").distinct().limit(most + 1).collect()]
    few = len(crossed) <= most
    around = squares(cells.where(F.col("region").isin(crossed)) if few else cells, side)
    around = F.broadcast(around) if few else around
    at = banks(axes, offset, wide=True)
    for n in PLACES:
        at = at.where(F.col(f"{n}.x").between(0, side - 1) & F.col(f"{n}.y").between(0, side - 1))
    for n in PLACES:
        r, c = F.col(f"{n}.y"), F.col(f"{n}.x")
        at = at.withColumns({"r0": F.least(F.floor(r), F.lit(side - 2)).cast("int"), "c0": F.least(F.floor(c), F.lit(side - 2)).cast("int")}).join(around, ["region", "r0", "c0"])
        fr, fc = r - F.col("r0"), c - F.col("c0")
        here = F.struct(*(F.struct(F.col(h).isNotNull().alias("known"), _weighed(F.col(h), fr, fc).alias("z")).alias(h) for h in ("z", "turned")))
        at = at.withColumn(n, here).drop("r0", "c0", "z", "turned")

    def told(field: str) -> tuple[Column, Column]:
        centre, *sides = (F.col(f"{n}.{field}.z") for n in PLACES)
        known = F.col(f"centre.{field}.known") & F.col(f"left.{field}.known") & F.col(f"right.{field}.known")
        return known, F.coalesce(centre <= F.least(*sides) + 1e-9, F.lit(False)).cast("int")

    (own, low), (other, high) = told("z"), told("turned")
    out = at.groupBy("region").agg(F.count(F.when(own, 1)).alias("samples"), F.avg(F.when(own, low)).alias("below"), F.avg(F.when(other, high)).alias("mirrored"))
    return out.where("samples > 0")
