"""Greedy separation: points taken in the order of their rank, each if it keeps a distance from those taken before."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import Rounds, checkpointed

_AROUND = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1)]


def _around(df: DataFrame) -> DataFrame:
    """Each row in its own grid cell and the eight about it."""
    moves = F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in _AROUND)))
    out = df.withColumn("__m", moves)
    return out.withColumns({"cx": F.col("cx") + F.col("__m.a"), "cy": F.col("cy") + F.col("__m.b")}).drop("__m")


def _near(p: str, q: str, distance: float):
    return F.greatest(F.abs(F.col(f"{p}.x") - F.col(f"{q}.x")), F.abs(F.col(f"{p}.y") - F.col(f"{q}.y"))) < distance


def free(points: DataFrame, taken: DataFrame, distance: float) -> DataFrame:
    """The points (group, x, y, ...) that are `distance` or more, in the larger of both axes, from all taken ones."""
    cell = {"cx": F.floor(F.col("x") / distance), "cy": F.floor(F.col("y") / distance)}
    kept = _around(taken.select("group", "x", "y").withColumns(cell)).select(F.struct("x", "y").alias("t"), "group", "cx", "cy")
    own = points.withColumns(cell).select(F.struct(*(F.col(c) for c in points.columns)).alias("p"), "group", "cx", "cy")
    met = own.join(kept, (own["group"].eqNullSafe(kept["group"])) & (own["cx"] == kept["cx"]) & (own["cy"] == kept["cy"]) & _near("p", "t", distance), "left_anti")
    return met.select("p.*")


def separated(points: DataFrame, distance: float, log: list[tuple[int, int]] | None = None) -> DataFrame:
    """Of points (group, id, rank, x, y) those that a greedy choice takes: in each group by rank (ties by
    id), a point is taken if no point taken before is nearer than `distance` in both axes.

    Rounds: a point is taken once it comes first among the undecided ones about it, and those about it
    go; that is the sequential choice, reached in a logarithmic number of rounds where ranks are random.
    All points of a grid cell as wide as the distance are about one another, so that only a cell's first
    point can be taken, and a point meets nine such at most: rounds are linear in the points, however
    dense they lie. Null places are never taken; null groups are one group. `log` gets the numbers of
    undecided and of taken points of each round.
    """
    cell = {"cx": F.floor(F.col("x") / distance), "cy": F.floor(F.col("y") / distance)}
    cols = ["group", "id", "rank", "x", "y"]
    with Rounds(points.sparkSession) as rounds:
        left = rounds.table(points.select(*cols).where("x IS NOT NULL AND y IS NOT NULL").withColumns(cell))
        taken = left.select(*cols).limit(0)
        while undecided := left.count():
            first = left.groupBy("group", "cx", "cy").agg(F.min(F.struct("rank", "id", "x", "y")).alias("f"))
            about = _around(first.select("group", "cx", "cy", "f")).select(F.col("group").alias("g"), F.col("cx").alias("fx"), F.col("cy").alias("fy"), "f")
            own = left.select("group", "cx", "cy", F.struct("rank", "id", "x", "y").alias("p"))
            met = own.join(about, own["group"].eqNullSafe(about["g"]) & (own["cx"] == about["fx"]) & (own["cy"] == about["fy"]))
            beaten = met.where((F.col("p") < F.col("f")) & _near("p", "f", distance)).select(F.col("g").alias("bg"), F.col("f").alias("bf")).distinct()
            won = first.join(beaten, first["group"].eqNullSafe(beaten["bg"]) & (first["f"] == beaten["bf"]), "left_anti").select("group", "f.id", "f.rank", "f.x", "f.y")
            won = rounds.table(won)
            if log is not None:
                log.append((undecided, won.count()))
            taken = taken.union(won)
            left = rounds.table(free(left, won, distance))
        return checkpointed(taken)


def by_strata(points: DataFrame, distance: float, count: int, strata: int) -> DataFrame:
    """Of points (group, id, rank, x, y, stratum, second) about `count` a group: from each stratum in turn
    its share, by rank, and if that leaves some to be had, more of any stratum by `second`; all at `distance` from
    those taken before."""
    from pyspark.sql import Window

    taken = None
    for s in range(strata + 1):
        pool = points.where(F.col("stratum") == s) if s < strata else points
        pool = pool.select("group", "id", (F.col("rank") if s < strata else F.col("second")).alias("rank"), "x", "y")
        pool = pool if taken is None else free(pool, taken, distance)
        order = Window.partitionBy("group").orderBy("rank", "id")
        new = separated(pool, distance).withColumn("n", F.row_number().over(order))
        if s < strata:
            new = new.where(F.col("n") <= count // strata + (1 if s < count % strata else 0))
        else:
            had = taken.groupBy(F.col("group").alias("g")).agg(F.count("*").alias("had"))
            new = new.join(had, F.col("group").eqNullSafe(F.col("g")), "left").where(F.col("n") <= count - F.coalesce("had", F.lit(0)))
        new = new.select("group", "id", "x", "y", F.lit(s).alias("step"))
        taken = checkpointed(new if taken is None else taken.union(new))
    return taken
