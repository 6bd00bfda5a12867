"""Depressions filled without a field in one task: spill levels by minimum spanning forests.

A cell's level is the least height that a path to the border has to climb, its own included. Edges join
neighbours at the greater of their heights, and border cells to the outside at their own. In each round
every component takes its least edge. Its own level is then that edge's height or the level of where the
edge leads, whichever is more: any way out has to pass an edge at least as high, and that edge is as good
in either direction. So components point at each other along falling edges, are contracted to where the
pointers end, and halve in number at least; what is remembered of a round is a row for each component.

The first contraction needs no other rows than those of a tile of bounded size, and goes on in a task
until only cells that touch another tile are left, with a forest of the ways between them. Of these, at
most four sides a tile, the rounds are made. Then each cell's level is that of the cell it left its tile by,
or what it had to climb to get there, whichever is more.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import hydro
from ..sources.shared import Rounds, checkpointed
from .stencils import NEIGHBOURS

OUTSIDE = -1
#: Nodes a side of what one task contracts at a time.
TILE = 256
_TILES = """region long, ty long, tx long, cells array<struct<place: int, z: double, own: double, end: int>>, ends array<long>,
 links array<struct<low: long, high: long, w: double, halves: int>>"""


def _structs(**columns) -> pa.ListArray:
    """A list of one row: the columns as structs."""
    rows = pa.StructArray.from_arrays(list(columns.values()), list(columns))
    return pa.ListArray.from_arrays(pa.array([0, len(rows)], pa.int32()), rows)


def _tile(table: pa.Table, side: int, tile: int) -> pa.Table:
    """One tile of cells as a row: what each has to climb to leave it and where it then is, an index into
    `ends`; links between ends, and for each neighbour in another tile one half of a link."""
    region, ty, tx = (table[n][0].as_py() for n in ("region", "ty", "tx"))
    z = table["z"].combine_chunks()
    place = (table["row"].to_numpy() - ty * tile) * tile + table["col"].to_numpy() - tx * tile
    # heights as ranks, which order nulls first and NaN last as Spark does
    given = z.is_valid().to_numpy(zero_copy_only=False)
    heights, rank = np.unique(z.fill_null(0.0).to_numpy(), return_inverse=True)
    rank = np.where(given, rank + 1, 0)
    heights = pa.concat_arrays([pa.nulls(1, pa.float64()), pa.array(heights)])
    at = lambda ranks: heights.take(pa.array(ranks))

    dense, there = np.zeros((tile, tile), np.int64), np.zeros((tile, tile), bool)
    dense.flat[place], there.flat[place] = rank, True
    row, col = ty * tile + np.arange(tile)[:, None], tx * tile + np.arange(tile)
    rim = (row == 0) | (row == side - 1) | (col == 0) | (col == side - 1)
    first, last = np.arange(tile) == 0, np.arange(tile) == tile - 1
    meets = (first[:, None] & (row > 0)) | (last[:, None] & (row < side - 1)) | (first & (col > 0)) | (last & (col < side - 1))
    level, end, links = hydro.contracted(dense, there, rim, meets)

    ends, cell = np.flatnonzero(meets & there), row * side + col
    named = np.append(cell, OUTSIDE)
    found = [(named[links[:, 0]], named[links[:, 1]], links[:, 2], np.full(len(links), 2))]
    for down, along in NEIGHBOURS:
        r, c = ends // tile + down, ends % tile + along
        beyond = (r < 0) | (r == tile) | (c < 0) | (c == tile)
        r, c, own = r[beyond] + ty * tile, c[beyond] + tx * tile, ends[beyond]
        inside = (r >= 0) & (r < side) & (c >= 0) & (c < side)
        own, other = own[inside], (r * side + c)[inside]
        found.append((cell.flat[own], other, dense.flat[own], np.ones(own.size, np.int64)))
    one, two, w, halves = map(np.concatenate, zip(*found, strict=True))
    # a cell that gets outside within its tile has the end -1, one that gets nowhere -2
    index = np.full(tile * tile + 2, -1)
    index[ends], index[-1] = np.arange(ends.size), -2
    return pa.table({
        "region": pa.array([region], pa.int64()), "ty": pa.array([ty], pa.int64()), "tx": pa.array([tx], pa.int64()),
        "cells": _structs(place=pa.array(place, pa.int32()), z=z, own=at(np.maximum(level[place], 0)), end=pa.array(index[end[place]], pa.int32())),
        "ends": pa.ListArray.from_arrays(pa.array([0, ends.size], pa.int32()), pa.array(cell.flat[ends], pa.int64())),
        "links": _structs(low=pa.array(np.minimum(one, two), pa.int64()), high=pa.array(np.maximum(one, two), pa.int64()), w=at(w), halves=pa.array(halves, pa.int32())),
    })


def _tiles(cells: DataFrame, side: int, tile: int) -> DataFrame:
    whole = lambda c: F.expr(f"CAST({c} AS LONG) div {tile}")
    dealt = cells.select("region", whole("row").alias("ty"), whole("col").alias("tx"), "row", "col", F.col("z").cast("double").alias("z"))
    return dealt.groupBy("region", "ty", "tx").applyInArrow(lambda t: _tile(t, side, tile), _TILES)


def _ends(rounds: Rounds, least: DataFrame) -> DataFrame:
    """(region, a, w, root): where the pointers of (region, a, w, b) end; of two that point at each other the lesser is an end."""
    back = least.select("region", F.col("a").alias("b"), F.col("b").alias("a2"))
    mutual = (F.col("a2") == F.col("a")) & (F.col("a") < F.col("b"))
    at = least.join(back, ["region", "b"], "left").select("region", "a", "w", F.when(mutual, F.col("a")).otherwise(F.col("b")).alias("root"))
    at = rounds.table(at)
    while True:
        nxt = at.select("region", F.col("a").alias("root"), F.col("root").alias("further"))
        new = at.join(nxt, ["region", "root"], "left").select("region", "a", "w", F.coalesce("further", "root").alias("root"), (F.col("further") != F.col("root")).alias("moved"))
        new = rounds.table(new)
        at = new.drop("moved")
        if new.where("moved").isEmpty():
            return at


def _rounds(rounds: Rounds, edges: DataFrame) -> DataFrame | None:
    """(region, a, level) of all that edges (region, a, b, w) lead outside; none without edges."""
    forests = []
    while not edges.isEmpty():
        both = edges.union(edges.select("region", F.col("b").alias("a"), F.col("a").alias("b"), "w")).where(F.col("a") != OUTSIDE)
        # edges of one height have an order too, the same from both sides
        least = both.groupBy("region", "a").agg(F.min(F.struct("w", F.least("a", "b"), F.greatest("a", "b"), "b")).alias("m")).select("region", "a", F.col("m.w").alias("w"), F.col("m.b").alias("b"))
        ends = _ends(rounds, rounds.table(least))
        forests.append(ends)
        name = ends.select("region", "a", "root")
        one = edges.join(name, ["region", "a"]).select("region", F.col("root").alias("a"), "b", "w")
        two = one.join(name.withColumnsRenamed({"a": "b", "root": "end"}), ["region", "b"], "left").select("region", "a", F.coalesce("end", "b").alias("b"), "w").where("a != b")
        # of all edges between two components the least is enough
        low, high = F.least("a", "b"), F.greatest("a", "b")
        kept = two.groupBy("region", low.alias("b"), high.alias("a")).agg(F.min(F.struct("w")).alias("m")).select("region", "a", "b", "m.w")
        edges = rounds.table(kept)
    level = None
    for ends in reversed(forests):
        out = ends.where(F.col("root") == OUTSIDE).select("region", "a", F.col("w").alias("level"))
        if level is not None:
            above = level.select("region", F.col("a").alias("root"), F.col("level").alias("above"))
            own = F.when(F.col("root") == F.col("a"), F.col("above")).otherwise(F.greatest("w", "above"))
            out = out.union(ends.join(above, ["region", "root"]).select("region", "a", own.alias("level")))
        level = out
    return level


def levels(cells: DataFrame, side: int, tile: int = TILE) -> DataFrame:
    """cells (region, row, col, z) with `fill`: every pit raised to the height at which it spills, flats
    left flat. Each field is square with `side` nodes; what is not there lets nothing through, and cells
    that it cuts off from the border are left out. No field has to fit a task, only `tile` nodes a side."""
    tile = min(tile, side)
    with Rounds(cells.sparkSession) as rounds:
        tiles = rounds.table(_tiles(cells, side, tile))
        halves = tiles.select("region", F.explode("links").alias("l")).groupBy("region", "l.low", "l.high").agg(F.max("l.w").alias("w"), F.sum("l.halves").alias("halves"))
        edges = halves.where("halves = 2").select("region", F.col("high").alias("a"), F.col("low").alias("b"), "w")
        level = _rounds(rounds, rounds.table(edges))
        if level is None:
            out = tiles.withColumn("known", F.lit(None).cast("map<long, struct<level: double>>"))
        else:
            part = [F.expr(f"{c} div {tile}").alias(n) for c, n in ((f"(a div {side})", "ty"), (f"(a % {side})", "tx"))]
            known = level.groupBy("region", *part).agg(F.map_from_entries(F.collect_list(F.struct("a", F.struct("level")))).alias("known"))
            out = tiles.join(known, ["region", "ty", "tx"], "left")
        out = out.select("region", "ty", "tx", "cells", F.transform("ends", lambda a: F.try_element_at("known", a)).alias("known"))

        def cell(c):
            there = F.get("known", c["end"])
            at = [(F.col(t) * tile + n).cast("int").alias(k) for t, n, k in (("ty", F.floor(c["place"] / tile), "row"), ("tx", c["place"] % tile, "col"))]
            return F.struct(*at, c["z"].alias("z"), F.greatest(c["own"], there["level"]).alias("fill"), ((c["end"] == -1) | there.isNotNull()).alias("reached"))

        return checkpointed(out.select("region", F.inline(F.transform("cells", cell))).where("reached").drop("reached"))
