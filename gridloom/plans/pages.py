"""From cells to pages: which pages answer a request, as predicates that prune partitions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Box:
    """Rows r0..r1 and columns c0..c1, ends included."""

    r0: int
    r1: int
    c0: int
    c1: int


def span(low: int, high: int, n: int, count: int | None = None) -> tuple[int, int]:
    """First and last page over nodes low..high. A boundary node is in both pages, so a span that
    ends on one takes the page before; with `count` pages the last node is in the last of them."""
    last = (high - 1) // n if high > low and high % n == 0 else high // n
    first, last = low // n, max(low // n, last)
    return (first, last) if count is None else (min(first, count - 1), min(last, count - 1))


def page_predicate(box: Box, intervals: int, count: int | None = None) -> Column:
    """The pages that a box needs, as a filter on page columns x and y; sources prune by it."""
    x, y = "x", "y"
    (y0, y1), (x0, x1) = span(box.r0, box.r1, intervals, count), span(box.c0, box.c1, intervals, count)
    return F.col(y).between(y0, y1) & F.col(x).between(x0, x1)


def cell_predicate(box: Box) -> Column:
    return F.col("row").between(box.r0, box.r1) & F.col("col").between(box.c0, box.c1)


def last_page(low: Column, high: Column, n: int) -> Column:
    high_page = F.when((high > low) & (high % n == 0), F.floor((high - 1) / n)).otherwise(F.floor(high / n))
    return F.greatest(F.floor(low / n), high_page).cast("int")


def cover(windows: DataFrame, intervals: int, minimal: bool = True) -> DataFrame:
    """windows (id, r0, r1, c0, c1) with the pages (y, x) that they need, a row per page."""

    def pages(low: str, high: str) -> Column:
        lo, hi = F.col(low), F.col(high)
        last = last_page(lo, hi, intervals) if minimal else F.floor(hi / intervals).cast("int")
        return F.explode(F.sequence(F.floor(lo / intervals).cast("int"), last))

    return windows.withColumn("y", pages("r0", "r1")).withColumn("x", pages("c0", "c1"))


def with_pages(cells: DataFrame, intervals: int, last: int) -> DataFrame:
    """A row for each page that holds a cell: nodes on a boundary belong to up to four pages."""

    def pages(name: str) -> Column:
        at, n = F.col(name), intervals
        before = F.when((at % n == 0) & (at > 0), F.floor(at / n) - 1)
        here = F.when(at < last, F.floor(at / n))
        return F.explode(F.array_compact(F.array(before.cast("int"), here.cast("int"))))

    return cells.withColumn("y", pages("row")).withColumn("x", pages("col"))


def paged(cells: DataFrame, intervals: int, last: int) -> DataFrame:
    """The page relation of level 0: (region, y, x, low, high, z), z row by row."""
    held = with_pages(cells, intervals, last).groupBy("region", "y", "x")
    values = F.transform(F.sort_array(F.collect_list(F.struct("row", "col", "z"))), lambda c: c["z"])
    return held.agg(F.min("z").alias("low"), F.max("z").alias("high"), values.alias("z"))


def window(pages: DataFrame, box: Box, intervals: int, count: int) -> DataFrame:
    """(region, row, col, z) of a box, from those of `count` pages a side that it needs: prune, filter, unpack once."""
    side = intervals + 1
    need = pages.where(page_predicate(box, intervals, count))
    cells = need.select("region", "y", "x", F.posexplode("z").alias("k", "z"))
    cells = cells.select("region", "y", "x", (F.col("y") * intervals + F.floor(F.col("k") / side)).cast("int").alias("row"), (F.col("x") * intervals + F.col("k") % side).cast("int").alias("col"), "z")
    # a shared node is answered by the page below and to the right, unless that was not read
    own_row = (F.col("row") % intervals != 0) | (F.col("row") == F.col("y") * intervals) | (F.col("row") == box.r1)
    own_col = (F.col("col") % intervals != 0) | (F.col("col") == F.col("x") * intervals) | (F.col("col") == box.c1)
    return cells.where(cell_predicate(box) & own_row & own_col).select("region", "row", "col", "z")
