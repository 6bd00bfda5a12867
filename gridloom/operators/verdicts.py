"""Reducers of measured rows: best products, paired ratios, verdicts, frontiers, amortisation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import rounded
from ..sources.shared import checkpointed


def best_conventional(rows: DataFrame, learned: Column) -> DataFrame:
    """The smallest product of each region and bound that keeps its bound; unknown violations count
    as violations, ties go to the first coder by name, then to the smallest loss."""
    ok = rows.where(~learned & (F.coalesce(F.col("violations"), F.lit(1)) == 0))
    best = ok.groupBy("region", "bound").agg(F.min(F.struct("bytes", "coder", "loss")).alias("b"))
    return best.select("region", "bound", "b.coder", "b.bytes", "b.loss")


def by_region(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The mean over a region's rows first, so that each region weighs the same later."""
    return rows.groupBy(*keys).agg(F.avg(value).alias(value))


def paired(rows: DataFrame, first: Column, second: Column, value: str = "bytes") -> DataFrame:
    """(region, bound, a, b): regions where both sides have a mean."""
    a = by_region(rows.where(first), ["region", "bound"], value).withColumnRenamed(value, "a")
    b = by_region(rows.where(second), ["region", "bound"], value).withColumnRenamed(value, "b")
    return a.join(b, ["region", "bound"])


def log_ratio(pairs: DataFrame) -> DataFrame:
    """By bound: the geometric mean of a/b, the range of it with each region left out, and whether
    every region is smaller."""
    r = pairs.withColumn("r", F.log(F.col("a") / F.col("b")))
    w = Window.partitionBy("bound")
    left = r.withColumns({"n": F.count("*").over(w), "s": F.sum("r").over(w)}).withColumn("loo", F.when(F.col("n") > 1, (F.col("s") - F.col("r")) / (F.col("n") - 1)))
    return left.groupBy("bound").agg(
        F.count("*").alias("regions"), rounded(F.exp(F.avg("r"))).alias("ratio"), rounded(F.exp(F.min("loo"))).alias("loo_low"),
        rounded(F.exp(F.max("loo"))).alias("loo_high"), F.bool_and(F.col("a") < F.col("b")).alias("all_smaller"),
    )


def resampled(logs: DataFrame, draws: int, by: str = "bound") -> DataFrame:
    """(by, ratio, low, high): the geometric mean of logs (by, region, r), a row a region, and the 2.5
    and 97.5 percentiles of it over regions drawn with replacement. Draws come from a digest, so that
    they are the same everywhere."""
    w = Window.partitionBy(by)
    numbered = logs.withColumns({"k": F.row_number().over(w.orderBy("region")) - 1, "n": F.count("*").over(w)})
    drawn = numbered.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    digest = F.md5(F.concat_ws(":", F.col("draw").cast("string"), F.col("k").cast("string")))
    drawn = drawn.select(by, "draw", (F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") % F.col("n")).cast("int").alias("k"))
    means = drawn.join(numbered.select(by, "k", "r"), [by, "k"]).groupBy(by, "draw").agg(F.avg("r").alias("m"))
    ends = means.groupBy(by).agg(*(F.exp(F.percentile("m", F.lit(q))).alias(name) for q, name in ((0.025, "low"), (0.975, "high"))))
    return logs.groupBy(by).agg(F.exp(F.avg("r")).alias("ratio")).join(ends, by)


def judged(learned: DataFrame, best: DataFrame, draws: int, most: float = 0.9, high: float = 0.95, drop: float = 0.01) -> DataFrame:
    """By bound, whether learned products (region, bound, bytes, f1) beat the best conventional ones (the
    same): the mean ratio is at most `most`, the upper end of its bootstrap below `high`, every region
    is smaller, and no region's streams lose more than `drop`. A region without a learned score loses all."""
    c = best.select("region", "bound", F.col("bytes").alias("cb"), F.col("f1").alias("cf"))
    both = c.join(learned, ["region", "bound"], "left").withColumn("r", F.log(F.col("bytes") / F.col("cb")))
    met = both.where("bytes IS NOT NULL")
    rows = met.groupBy("bound").agg(F.count("*").alias("regions"), F.bool_and(F.col("r") < 0).alias("smaller"))
    lost = both.groupBy("bound").agg(F.max(F.col("cf") - F.coalesce("f1", F.lit(0.0))).alias("lost"))
    out = resampled(met.select("bound", "region", "r"), draws).join(rows, "bound").join(lost, "bound")
    passes = (F.col("ratio") <= most) & (F.col("high") < high) & F.col("smaller") & (F.coalesce(F.col("lost"), F.lit(0.0)) <= drop + 1e-12)
    return out.withColumn("passes", passes)


def whole_regions(cells: DataFrame, arm: str, by: list[str]) -> DataFrame:
    """cells of those groups that have a row of every arm there is."""
    arms = cells.agg(F.countDistinct(arm).alias("__all"))
    full = cells.groupBy(*by).agg(F.count("*").alias("__n")).crossJoin(F.broadcast(arms)).where("__n = __all").select(*by)  # one row
    return cells.join(full, by)


def _elsewhere(cells: DataFrame) -> DataFrame:
    """cells (bound, region, arm, r, gap) with the mean of r and the least gap over the other regions."""
    w = Window.partitionBy("bound", "arm")
    before, after = w.orderBy("region").rowsBetween(Window.unboundedPreceding, -1), w.orderBy("region").rowsBetween(1, Window.unboundedFollowing)
    mean = (F.sum("r").over(w) - F.col("r")) / F.nullif(F.count("*").over(w) - 1, F.lit(0))
    return cells.withColumns({"others": mean, "worst": F.least(F.min("gap").over(before), F.min("gap").over(after))})


def chosen_elsewhere(cells: DataFrame, most: float, fallback: str) -> DataFrame:
    """For each bound and region the cell of the arm that the other regions choose: of arms whose mean
    ratio there is at most `most` the one with the largest least gap, the last by name on a tie."""
    fits = F.when(F.exp("others") <= most, F.struct("worst", "arm"))
    e = _elsewhere(cells).withColumn("pick", F.coalesce(F.max(fits).over(Window.partitionBy("bound", "region"))["arm"], F.lit(fallback)))
    return e.where(F.col("arm") == F.col("pick")).select(*cells.columns)


def smallest_elsewhere(cells: DataFrame) -> DataFrame:
    """For each bound and region the cell of the arm that is smallest on the other regions."""
    best = F.min(F.struct(F.round("others", 9).alias("o"), "arm")).over(Window.partitionBy("bound", "region"))["arm"]
    return _elsewhere(cells).withColumn("pick", best).where(F.col("arm") == F.col("pick")).select(*cells.columns)


def interpolated(points: DataFrame, curve: DataFrame, by: str) -> DataFrame:
    """points (by, x) with y, linear in the logarithm of x between the neighbouring nodes of a curve
    (by, cx, cy), its ends included; points outside are left out. A point meets only the segment that holds it."""
    w = Window.partitionBy(by).orderBy("cx")
    segments = curve.withColumns({"nx": F.lead("cx").over(w), "ny": F.lead("cy").over(w), "end": F.lead("cx", 2).over(w).isNull()}).where("nx IS NOT NULL")
    s, p = segments.alias("s"), points.alias("p")
    holds = (F.col("p.x") >= F.col("s.cx")) & ((F.col("p.x") < F.col("s.nx")) | (F.col("s.end") & (F.col("p.x") == F.col("s.nx"))))
    share = F.log(F.col("p.x") / F.col("s.cx")) / F.log(F.col("s.nx") / F.col("s.cx"))
    return p.join(s, (F.col(f"p.{by}") == F.col(f"s.{by}")) & holds).select("p.*", (F.col("s.cy") + share * (F.col("s.ny") - F.col("s.cy"))).alias("y"))


def break_even(gain: Column, model: Column) -> Column:
    """Fields until a model's bytes are earned back; null if never."""
    return F.when(gain > 0, F.ceil(model / gain))


#: Ranges that a key's rows are cut into, so that one task need not see them all.
RANGES = 64


def ranged(rows: DataFrame, by: list[str], x: str, ranges: int = RANGES) -> DataFrame:
    """rows with __range: about as many rows in each range of x within a key; equal x share a range."""
    cuts = rows.groupBy(*by).agg(F.percentile_approx(x, [k / ranges for k in range(1, ranges)], 1000).alias("__cuts"))
    met = rows.join(cuts, by)
    return met.withColumn("__range", F.size(F.filter(F.array_distinct("__cuts"), lambda c: c < F.col(x)))).drop("__cuts")


def least_before(rows: DataFrame, by: list[str], value: Column, own: Window) -> DataFrame:
    """ranged rows with __before: the least value in earlier ranges, or before a row in its own range."""
    ends = rows.groupBy(*by, "__range").agg(F.min(value).alias("__least"))
    w = Window.partitionBy(*by).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.withColumn("__least", F.min("__least").over(w))  # a row for each range
    return rows.withColumn("__own", F.min(value).over(own)).join(ends, [*by, "__range"]).withColumn("__before", F.least("__least", "__own")).drop("__least", "__own")


def staircase(rows: DataFrame, by: list[str], x: str, y: str, key: str) -> DataFrame:
    """Rows that improve on all cheaper ones: y below its running minimum in order of (x, y, key)."""
    own = Window.partitionBy(*by, "__range").orderBy(x, y, key).rowsBetween(Window.unboundedPreceding, -1)
    held = least_before(ranged(rows, by, x), by, F.col(y), own)
    return held.where(F.col("__before").isNull() | (F.col(y) < F.col("__before"))).select(*rows.columns)


#: Rows of the side of a join that is sent to all tasks, at most.
SENT = 100_000


def dominated(rows: DataFrame, first: int = 1024, growth: int = 8) -> DataFrame:
    """rows (id, package, bytes, mae, worst) with dominated_by: the first id in order that is no
    worse on all three and better on one, within a package. Rows with a null are not compared.

    Rows meet the others in order of their ids, block by block: first a small block, then ever larger
    ones. A row that an id of a block dominates is settled and meets no further block, so that most
    rows meet few others; of a block and the open rows the smaller is sent to all tasks if it is
    small enough.

    The ids of settled rows are called `of`: Spark drops an alias that only repeats a name, and then a
    checkpoint keeps constraints on a column that it does not have, at which a union of such fails.
    """
    full = checkpointed(rows.where("bytes IS NOT NULL AND mae IS NOT NULL AND worst IS NOT NULL").select("id", "package", "bytes", "mae", "worst"))
    n, shares = full.count(), []
    while first < n:
        shares, first = [*shares, first / n], first * growth
    cuts = full.approxQuantile("id", shares, 0.0001) if shares else []  # a number for each block
    left, settled, low = full, [], None
    for cut in [*sorted(set(cuts)), None]:
        block = full if low is None else full.where(F.col("id") > low)
        block = block if cut is None else block.where(F.col("id") <= cut)
        open_rows, block_rows = left.count(), block.count()
        small = min(open_rows, block_rows) <= SENT
        a = (F.broadcast(left) if small and open_rows < block_rows else left).alias("a")
        b = (F.broadcast(block) if small and open_rows >= block_rows else block).alias("b")
        no_worse = (F.col("b.bytes") <= F.col("a.bytes")) & (F.col("b.mae") <= F.col("a.mae")) & (F.col("b.worst") <= F.col("a.worst"))
        better = (F.col("b.bytes") < F.col("a.bytes")) | (F.col("b.mae") < F.col("a.mae")) | (F.col("b.worst") < F.col("a.worst"))
        hit = a.join(b, (F.col("a.package") == F.col("b.package")) & no_worse & better).groupBy(F.col("a.id").alias("of")).agg(F.min("b.id").alias("dominated_by"))
        settled.append(checkpointed(hit))
        if cut is not None:
            left = checkpointed(left.join(settled[-1], F.col("id") == F.col("of"), "left_anti"))
        low = cut
    found = settled[0]
    for more in settled[1:]:
        found = found.unionByName(more)
    return rows.join(found.withColumnRenamed("of", "id"), "id", "left")


def best_at_or_below(rows: DataFrame) -> DataFrame:
    """rows (id, package, bytes, mae) with the most accurate row of no more bytes: a running minimum
    in order of bytes, not an inequality join."""
    own = Window.partitionBy("package", "__range").orderBy("bytes").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    held = least_before(ranged(rows, ["package"], "bytes"), ["package"], F.when(F.col("mae").isNotNull(), F.struct("mae", "bytes", "id")), own)
    return held.select(*rows.columns, F.col("__before")["id"].alias("best"))
