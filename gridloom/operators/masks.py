"""Cell sets and class rasters: dilation, erosion, pooling, boundaries, majority, labels, polygons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import Rounds, checkpointed

from .stencils import along_col, along_row, offsets


def ball(radius: int) -> list[tuple[int, int]]:
    return [(a, b) for a in range(-radius, radius + 1) for b in range(-radius, radius + 1)]


def dilate(cells: DataFrame, radius: int, side: int) -> DataFrame:
    """(region, row, col) within `radius` of a cell of the set, rows and columns alike."""
    near = offsets(cells.select("region", "row", "col"), ball(radius)).select("region", F.col("nrow").alias("row"), F.col("ncol").alias("col"))
    return near.where(F.col("row").between(0, side - 1) & F.col("col").between(0, side - 1)).distinct()


def erode(cells: DataFrame, times: int, mask: str = "m") -> DataFrame:
    """The mask after `times` erosions by the four neighbours; the outside does not erode."""
    for _ in range(times):
        m = F.col(mask)
        on = lambda c: F.coalesce(c, F.lit(True))
        inside = m & on(F.lag(m).over(along_row())) & on(F.lead(m).over(along_row())) & on(F.lag(m).over(along_col())) & on(F.lead(m).over(along_col()))
        cells = cells.withColumn(mask, inside)
    return cells


def pool_any(cells: DataFrame, stride: int, side: int, mask: str = "m") -> DataFrame:
    """Display nodes every `stride` cells: set if a set cell is within half a stride."""
    last = (side - 1) // stride
    near = lambda c: F.least(F.floor((F.col(c) + stride // 2) / stride), F.lit(last)).cast("int")
    return cells.groupBy("region", near("row").alias("row"), near("col").alias("col")).agg(F.bool_or(mask).alias("m"))


def boundary_distance(cells: DataFrame, limit: int, side: int, label: str = "label") -> DataFrame:
    """cells with `distance`: rows or columns to the nearest cell at a class boundary, at most `limit`."""
    v = F.col(label)
    differs = F.lit(False)
    for w in (along_row(), along_col()):
        for f in (F.lag, F.lead):
            differs = differs | F.coalesce(f(v).over(w) != v, F.lit(False))
    edge = cells.withColumn("__edge", differs).where("__edge").select("region", "row", "col")
    near = offsets(edge, ball(limit - 1)).select("region", F.col("nrow").alias("row"), F.col("ncol").alias("col"), F.greatest(F.abs("dr"), F.abs("dc")).alias("d"))
    near = near.where(F.col("row").between(0, side - 1) & F.col("col").between(0, side - 1)).groupBy("region", "row", "col").agg(F.min("d").alias("d"))
    return cells.join(near, ["region", "row", "col"], "left").withColumn("distance", F.coalesce("d", F.lit(limit))).drop("d")


def fault_field(cells: DataFrame, limit: int, side: int) -> DataFrame:
    """(region, row, col, distance, strike) around fault cells (region, row, col, strike): steps along
    rows and columns to the nearest one, at most `limit` and never around an edge, and the smallest
    strike among the nearest. Cells farther away are left out."""
    diamond = [(a, b) for a in range(-limit, limit + 1) for b in range(abs(a) - limit, limit - abs(a) + 1)]
    near = offsets(cells.select("region", "row", "col", "strike"), diamond)
    near = near.where(F.col("nrow").between(0, side - 1) & F.col("ncol").between(0, side - 1))
    best = near.groupBy("region", F.col("nrow").alias("row"), F.col("ncol").alias("col")).agg(F.min(F.struct((F.abs("dr") + F.abs("dc")).alias("distance"), "strike")).alias("b"))
    return best.select("region", "row", "col", "b.distance", "b.strike")


def majority(cells: DataFrame, radius: int, side: int, label: str = "label") -> DataFrame:
    """The commonest class around each cell; of equally common ones the lowest."""
    near = offsets(cells.select("region", "row", "col", label), ball(radius))
    near = near.where(F.col("nrow").between(0, side - 1) & F.col("ncol").between(0, side - 1))
    counts = near.groupBy("region", F.col("nrow").alias("row"), F.col("ncol").alias("col"), label).agg(F.count("*").alias("n"))
    return counts.groupBy("region", "row", "col").agg(F.max(F.struct("n", (-F.col(label)).alias("k"))).alias("b")).select("region", "row", "col", (-F.col("b.k")).alias(label))


def voronoi(cells: DataFrame, seeds: list[tuple[int, int, int]]) -> DataFrame:
    """cells with the label of the nearest seed (label, row, col); the first one on a tie."""
    best = None
    for k, (label, r, c) in enumerate(seeds):
        d = (F.col("row") - r) * (F.col("row") - r) + (F.col("col") - c) * (F.col("col") - c)
        own = F.struct(d.alias("d"), F.lit(k).alias("k"), F.lit(label).alias("label"))
        best = own if best is None else F.least(best, own)
    return cells.withColumn("label", best["label"])


def shuffled_blocks(cells: DataFrame, block: int, side: int, seed: int) -> DataFrame:
    """The field with its square blocks permuted by a hash of their place; what is left over stays."""
    n = side // block
    inside = (F.col("row") < n * block) & (F.col("col") < n * block)
    blocks = cells.where(inside).select("region", (F.floor(F.col("row") / block)).cast("int").alias("br"), (F.floor(F.col("col") / block)).cast("int").alias("bc")).distinct()
    rank = F.row_number().over(Window.partitionBy("region").orderBy(F.sha2(F.concat_ws(":", F.lit(seed), "br", "bc"), 256)))
    moved = blocks.withColumn("k", rank - 1).select("region", "br", "bc", F.floor(F.col("k") / n).cast("int").alias("tr"), (F.col("k") % n).alias("tc"))
    at = cells.withColumns({"br": F.floor(F.col("row") / block).cast("int"), "bc": F.floor(F.col("col") / block).cast("int")}).join(moved, ["region", "br", "bc"], "left")
    row = F.coalesce(F.col("tr") * block + F.col("row") % block, F.col("row"))
    col = F.coalesce(F.col("tc") * block + F.col("col") % block, F.col("col"))
    return at.select("region", row.cast("int").alias("row"), col.cast("int").alias("col"), "z")


def folded(cells: DataFrame, share: float, label: str = "label") -> DataFrame:
    """Classes with less than `share` of the cells become 0, the others 1, 2, … by label; 0 stays."""
    counts = cells.groupBy(label).agg(F.count("*").alias("n"))
    kept = counts.crossJoin(F.broadcast(counts.agg(F.sum("n").alias("t")))).where((F.col("n") >= share * F.col("t")) & (F.col(label) != 0))  # one row
    codes = kept.select(label, F.dense_rank().over(Window.orderBy(label)).alias("code"))
    return cells.join(codes, label, "left").withColumn("code", F.coalesce("code", F.lit(0)))


def checked_classes(cells: DataFrame, count: int, label: str = "label") -> DataFrame:
    """cells as they are; a column that is not of whole numbers is refused at once (classes were
    interpolated or averaged), a code outside 0 to count - 1 when it is read."""
    kind = dict(cells.dtypes)[label]
    if kind not in ("tinyint", "smallint", "int", "bigint"):
        raise TypeError(f"class codes are whole numbers, not {kind}")
    wrong = (F.col(label) < 0) | (F.col(label) >= count)
    return cells.withColumn(label, F.when(wrong, F.raise_error(F.concat(F.lit(f"class codes lie in 0 to {count - 1}, not "), F.col(label).cast("string")))).otherwise(F.col(label)))


def nearest_class(cells: DataFrame, coarse: DataFrame, side: int, coarse_side: int) -> DataFrame:
    """cells with the label of the nearest node of a coarser raster, whose own size sets its spacing."""
    step = (side - 1) / (coarse_side - 1) if coarse_side > 1 else float(side)
    at = lambda c: F.least(F.rint(F.col(c) / step), F.lit(float(coarse_side - 1))).cast("int")
    near = coarse.select("region", F.col("row").alias("__r"), F.col("col").alias("__c"), "label")
    return cells.withColumns({"__r": at("row"), "__c": at("col")}).join(near, ["region", "__r", "__c"]).drop("__r", "__c")


#: Rows of cells that meet the same edges.
BAND = 16


def rasterised(cells: DataFrame, edges: DataFrame, x: Column, y: Column) -> DataFrame:
    """cells with the last shape (shape, label, x0, y0, x1, y1 an edge) that holds (x, y); 0 if none.

    Even-odd rule on crossings of a ray. Only places count, not regions, so each place is looked at
    once; it meets the edges of its band of rows by equality, then those that its ray can cross.
    """
    at = cells.select("row", "col", x.alias("__x"), y.alias("__y")).distinct().withColumn("__band", F.floor(F.col("__y") / BAND))
    spans = F.sequence(F.floor(F.least("y0", "y1") / BAND), F.floor(F.greatest("y0", "y1") / BAND))
    near = edges.withColumn("__band", F.explode(spans))
    rising = (F.col("y0") > F.col("__y")) != (F.col("y1") > F.col("__y"))
    cut = F.col("x0") + (F.col("__y") - F.col("y0")) / (F.col("y1") - F.col("y0")) * (F.col("x1") - F.col("x0"))
    hit = at.join(near, "__band").where(rising & (F.col("__x") < cut))
    inside = hit.groupBy("row", "col", "shape", "label").agg(F.count("*").alias("n")).where("n % 2 = 1")
    last = inside.groupBy("row", "col").agg(F.max(F.struct("shape", "label")).alias("b")).select("row", "col", F.col("b.label").alias("label"))
    return cells.join(last, ["row", "col"], "left").withColumn("label", F.coalesce("label", F.lit(0)))


def fault_growth(faults: DataFrame, cells: DataFrame, reach: int) -> DataFrame:
    """cells (region, row, col) with distance, sin2, cos2 and reached: steps to the nearest fault cell, by the
    four neighbours and at most `reach`, and the strike there.

    faults is (region, row, col, strike in degrees), with as many rows a cell as there are strikes. A
    strike has no sense of direction, so it is carried as the vector of its doubled angle. Each ring's cell
    takes the mean of those it is reached from, so that strikes that differ shorten it; away from faults it decays
    with a third of the reach. Cells beyond have the reach as distance and no strike. Rings grow
    on the frontier alone: a neighbour of a ring lies in it, in the one before or in the next. Nothing
    wraps around an edge, as growth only goes to cells that there are.
    """
    angle = F.radians(2 * F.col("strike"))
    own = cells.select("region", "row", "col")
    with Rounds(cells.sparkSession) as rounds:
        key = ["region", "row", "col"]
        start = faults.join(own, key).groupBy(*key).agg(F.avg(F.sin(angle)).alias("s"), F.avg(F.cos(angle)).alias("c"))
        ring = rounds.table(start.withColumn("distance", F.lit(0)))
        before, found = ring.select(*key).limit(0), ring
        for step in range(1, reach + 1):
            moves = F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in ((0, 1), (1, 0), (0, -1), (-1, 0)))))
            near = ring.select("region", "row", "col", "s", "c", moves.alias("m")).select("region", (F.col("row") + F.col("m.a")).alias("row"), (F.col("col") + F.col("m.b")).alias("col"), "s", "c")
            fresh = near.groupBy(*key).agg(F.avg("s").alias("s"), F.avg("c").alias("c")).join(own, key).join(ring.select(*key).union(before), key, "left_anti")
            before, ring = ring.select(*key), rounds.table(fresh.select(*key, "s", "c", F.lit(step).alias("distance")))
            if ring.isEmpty():
                break
            found = found.union(ring)
        decay = F.exp(-F.col("distance") / (reach / 3))
        out = own.join(found, key, "left").withColumn("reached", F.col("distance").isNotNull()).withColumn("distance", F.coalesce("distance", F.lit(reach)))
        return checkpointed(out.select(*key, "distance", (F.coalesce("s", F.lit(0.0)) * decay).alias("sin2"), (F.coalesce("c", F.lit(0.0)) * decay).alias("cos2"), "reached"))
