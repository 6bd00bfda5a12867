"""Flow over a field: receivers, outlets, accumulation and stream agreement, as operations on edges.

A cell is (region, cell), cell being row * side + col. Pointers double at each step, so a path of
length n takes log2(n) joins; a step's result is a reliable checkpoint, which cuts the lineage.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import hydro
from ..functions.dense import MOST_NODES, dense
from ..sources.shared import Rounds, checkpointed
from .stencils import NEIGHBOURS, along_col, along_row, offsets

NO_RECEIVER = -1


def traced(cells: DataFrame, side: int, values: tuple[str, ...] = ("z",), most: int = MOST_NODES, filled: bool = False) -> DataFrame:
    """cells (region, row, col, the values) with `cell` and, for each value v, v_receiver, v_outlet and
    v_upstream. A field of up to `most` nodes is one task, all surfaces of it together; larger ones go
    by edges, which no task has to hold, with the same result. With `filled`, pits are filled before,
    which lifts flats and is done in tasks only."""
    if side * side > most:
        if filled:
            raise ValueError(f"fields of more than {most} nodes are filled by spill.levels")
        return _on_edges(cells, side, values)

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        out = pdf[["region", "row", "col", *values]].copy()
        at = (pdf["row"].to_numpy(), pdf["col"].to_numpy())
        out["cell"] = at[0] * side + at[1]
        for v in values:
            z = dense(pdf, v)
            to = hydro.receivers(hydro.filled(z) if filled else z)
            paths = hydro.Drainage(to)
            for name, held in (("receiver", to), ("outlet", paths.outlet.reshape(to.shape)), ("upstream", paths.upstream())):
                out[f"{v}_{name}"] = held[at]
        return out

    made = ", ".join(f"{v}_receiver int, {v}_outlet int, {v}_upstream bigint" for v in values)
    schema = f"region bigint, row int, col int, {', '.join(f'{v} double' for v in values)}, cell int, {made}"
    return cells.select("region", "row", "col", *values).groupBy("region").applyInPandas(one, schema)


def _on_edges(cells: DataFrame, side: int, values: tuple[str, ...]) -> DataFrame:
    at = (F.col("row").cast("long") * side + F.col("col")).alias("cell")
    out = cells.select("region", "row", "col", *values, at)
    for v in values:
        edges = checkpointed(receivers(cells.select("region", "row", "col", v), side, value=v).select("region", "cell", "receiver"))
        ends = outlets(edges).withColumnRenamed("outlet", f"{v}_outlet")
        total = accumulation(edges).withColumnRenamed("upstream", f"{v}_upstream")
        found = edges.withColumnRenamed("receiver", f"{v}_receiver").join(ends, ["region", "cell"]).join(total, ["region", "cell"])
        out = out.join(found, ["region", "cell"])
    made = (f"{v}_{name}" for v in values for name in ("receiver", "outlet", "upstream"))
    return out.select("region", "row", "col", *values, "cell", *made)


def receivers(cells: DataFrame, side: int, spacing: float = 1.0, value: str = "z") -> DataFrame:
    """cells with `cell` and `receiver`: the neighbour with the steepest drop a metre, the first in the
    fixed order on a tie, -1 where nothing is lower. Neighbours come from two windows, not a join."""
    v = F.col(value)
    out = cells.withColumns({"w": F.lag(v).over(along_row()), "e": F.lead(v).over(along_row())})
    out = out.withColumns({"nw": F.lag("w").over(along_col()), "n": F.lag(v).over(along_col()), "ne": F.lag("e").over(along_col()), "sw": F.lead("w").over(along_col()), "s": F.lead(v).over(along_col()), "se": F.lead("e").over(along_col())})
    cell = F.col("row") * side + F.col("col")
    drops = {name: (v - F.col(name)) / (math.hypot(a, b) * spacing) for name, (a, b) in zip(("nw", "n", "ne", "w", "e", "sw", "s", "se"), NEIGHBOURS, strict=True)}
    best = F.greatest(*drops.values())
    pick = F.when(best.isNull() | (best <= 0), NO_RECEIVER)
    for (a, b), drop in zip(NEIGHBOURS, drops.values(), strict=True):
        pick = pick.when(drop == best, cell + a * side + b)
    return out.withColumns({"cell": cell, "receiver": pick}).drop(*drops)


def outlets(edges: DataFrame) -> DataFrame:
    """(region, cell, outlet): where each cell's path ends, by pointer doubling until nothing moves."""
    with Rounds(edges.sparkSession) as rounds:
        at = rounds.table(edges.select("region", "cell", F.when(F.col("receiver") == NO_RECEIVER, F.col("cell")).otherwise(F.col("receiver")).alias("outlet")))
        while True:
            to = at.select("region", F.col("cell").alias("outlet"), F.col("outlet").alias("__next"))
            new = rounds.table(at.join(to, ["region", "outlet"]).select("region", "cell", F.col("__next").alias("outlet"), (F.col("__next") != F.col("outlet")).alias("__moved")))
            at = new.drop("__moved")
            if new.where("__moved").isEmpty():
                return checkpointed(at)


def accumulation(edges: DataFrame) -> DataFrame:
    """(region, cell, upstream): cells whose path passes a cell, itself included.

    Doubling: what lies less than 2^k steps above a cell, plus the same for each cell that is 2^k
    steps above it, is what lies less than 2^(k+1) steps above it.
    """
    with Rounds(edges.sparkSession) as rounds:
        at = rounds.table(edges.select("region", "cell", F.when(F.col("receiver") != NO_RECEIVER, F.col("receiver")).alias("far"), F.lit(1).cast("bigint").alias("upstream")))
        while not (open_ := at.where("far IS NOT NULL")).isEmpty():
            more = open_.groupBy("region", F.col("far").alias("cell")).agg(F.sum("upstream").alias("__more"))
            further = at.select("region", F.col("cell").alias("far"), F.col("far").alias("__far"))
            new = at.join(more, ["region", "cell"], "left").withColumn("upstream", F.col("upstream") + F.coalesce("__more", F.lit(0))).drop("__more")
            at = rounds.table(new.join(further, ["region", "far"], "left").select("region", "cell", F.col("__far").alias("far"), "upstream"))
        return checkpointed(at.select("region", "cell", "upstream"))


def tolerant_scores(a: DataFrame, b: DataFrame, side: int, reach: int = 1) -> DataFrame:
    """(region, recall, precision, f1) of cell sets (region, row, col) where a cell counts as found if
    the other set has one within `reach`; null where undefined."""
    around = [(p, q) for p in range(-reach, reach + 1) for q in range(-reach, reach + 1)]

    def found(x: DataFrame, y: DataFrame, name: str) -> DataFrame:
        near = offsets(y.select("region", "row", "col"), around).select("region", F.col("nrow").alias("row"), F.col("ncol").alias("col")).distinct().withColumn("__hit", F.lit(1))
        met = x.select("region", "row", "col").join(near, ["region", "row", "col"], "left")
        return met.groupBy("region").agg((F.count("__hit") / F.count("*")).alias(name))

    both = found(a, b, "recall").join(found(b, a, "precision"), "region", "full")
    f1 = 2 * F.col("recall") * F.col("precision") / (F.col("recall") + F.col("precision"))
    return both.withColumn("f1", F.when(F.col("recall") + F.col("precision") > 0, f1).when(F.col("recall").isNotNull() & F.col("precision").isNotNull(), 0.0))


def agreement(routed: DataFrame, a: str, b: str, side: int, least: int) -> DataFrame:
    """(region, jaccard, f1, receivers, outlets) of two surfaces in rows of `traced`: overlap of the cells that `least`
    cells drain through, its score within a cell, and the shares of inner cells with one receiver and
    of cells with one outlet. The first two are null where a surface has no such cells."""
    streams = routed.select("region", "row", "col", (F.col(f"{a}_upstream") >= least).alias("a"), (F.col(f"{b}_upstream") >= least).alias("b")).where("a OR b")
    one, two = F.count_if("a"), F.count_if("b")
    over = streams.groupBy("region").agg(F.when((one > 0) & (two > 0), F.count_if(F.col("a") & F.col("b")) / F.count("*")).alias("jaccard"))
    near = tolerant_scores(streams.where("a"), streams.where("b"), side).select("region", "f1")
    inner = F.col("row").between(1, side - 2) & F.col("col").between(1, side - 2)
    same = lambda c: (F.col(f"{a}_{c}") == F.col(f"{b}_{c}")).cast("int")
    shares = routed.groupBy("region").agg(F.avg(F.when(inner, same("receiver"))).alias("receivers"), F.avg(same("outlet")).alias("outlets"))
    return shares.join(over, "region", "left").join(near, "region", "left").select("region", "jaccard", "f1", "receivers", "outlets")


def noise_floor(cells: DataFrame, side: int, sigma: float, seeds: tuple[int, ...], least: int) -> DataFrame:
    """(region, jaccard, f1, receivers, outlets): the mean agreement of fields with themselves under white
    noise. The noise is told by a cell's place and the seed, so it is the same however rows lie."""
    even = lambda k: (F.pmod(F.xxhash64(F.lit(k), "region", "row", "col"), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    normal = lambda s: F.sqrt(-2 * F.log(even(2 * s))) * F.cos(2 * math.pi * even(2 * s + 1))
    noisy = cells.select("region", "row", "col", "z", *((F.col("z") + sigma * normal(s)).alias(f"n{s}") for s in seeds))
    routed = checkpointed(traced(noisy, side, ("z", *(f"n{s}" for s in seeds)), filled=True))
    each = None
    for s in seeds:
        own = agreement(routed, "z", f"n{s}", side, least)
        each = own if each is None else each.union(own)
    return each.groupBy("region").agg(*(F.avg(c).alias(c) for c in ("jaccard", "f1", "receivers", "outlets")))


def downstream(edges: DataFrame, weight: str) -> DataFrame:
    """(region, cell, total): the sum of `weight` from a cell to its outlet, by the same doubling."""
    at = checkpointed(edges.select("region", "cell", F.when(F.col("receiver") != NO_RECEIVER, F.col("receiver")).alias("far"), F.col(weight).alias("total")))
    while not at.where("far IS NOT NULL").isEmpty():
        further = at.select("region", F.col("cell").alias("far"), F.col("far").alias("__far"), F.col("total").alias("__total"))
        at = checkpointed(at.join(further, ["region", "far"], "left").select("region", "cell", F.col("__far").alias("far"), (F.col("total") + F.coalesce("__total", F.lit(0.0))).alias("total")))
    return at.select("region", "cell", "total")
