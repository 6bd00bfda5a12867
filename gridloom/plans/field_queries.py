"""Queries on fields: windows and pages, error metrics, stencils, resampling, masks."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.scalar import rounded, slope_class, varint_bytes, zigzag
from ..operators import masks, metrics, resample, stencils
from ..sources.tables import ESTIMATE_SQL, LATTICE_SQL, NODES_SQL, SIDE, STEP, estimate, lattice, nodes, read
from .pages import Box, cover, window, with_pages
from .stored import stored
from .catalog import query

BOX = Box(10, 25, 20, 35)
L, E = f"WITH {LATTICE_SQL}", f"WITH {LATTICE_SQL}, {ESTIMATE_SQL}"
WINDOWS = [(1, 0, 15, 0, 15), (2, 10, 25, 20, 35), (3, 30, 32, 5, 40), (4, 63, 63, 0, 63), (5, 8, 16, 8, 16)]
WINDOWS_SQL = "W(id, r0, r1, c0, c1) AS (VALUES " + ", ".join(map(str, WINDOWS)) + ")"
HELD = """H AS (SELECT region, y, x, row, col, z FROM LN, range(0, 8) AS a(y), range(0, 8) AS b(x)
 WHERE row BETWEEN y * 8 AND y * 8 + 8 AND col BETWEEN x * 8 AND x * 8 + 8)"""
NEIGH = """N AS (SELECT *, lag(z) OVER (PARTITION BY region, row ORDER BY col) AS w, lead(z) OVER (PARTITION BY region, row ORDER BY col) AS e,
 lag(z) OVER (PARTITION BY region, col ORDER BY row) AS n, lead(z) OVER (PARTITION BY region, col ORDER BY row) AS s FROM L)"""
GRAD = """G AS (SELECT region, row, col, z, CASE WHEN w IS NULL THEN e - z WHEN e IS NULL THEN z - w ELSE (e - w) / 2 END AS gx,
 CASE WHEN n IS NULL THEN s - z WHEN s IS NULL THEN z - n ELSE (s - n) / 2 END AS gy FROM N)"""
SLOPE = "S AS (SELECT *, sqrt(gx * gx + gy * gy) AS slope FROM G)"


#: A window for each customer.
CUSTOMER_WINDOWS = "W AS (SELECT c_custkey AS id, CAST(c_custkey * 37 % 64 AS INTEGER) AS r0, CAST(least(c_custkey * 37 % 64 + c_custkey % 17, 63) AS INTEGER) AS r1, CAST(c_custkey * 53 % 64 AS INTEGER) AS c0, CAST(least(c_custkey * 53 % 64 + c_custkey % 23, 63) AS INTEGER) AS c1 FROM customer)"


def _customer_windows(spark, d):
    k = F.col("c_custkey")
    ends = lambda m, most: ((k * m % 64).cast("int"), F.least(k * m % 64 + k % most, F.lit(63)).cast("int"))
    (r0, r1), (c0, c1) = ends(37, 17), ends(53, 23)
    return read(spark, d, "customer").select(k.alias("id"), r0.alias("r0"), r1.alias("r1"), c0.alias("c0"), c1.alias("c1"))


def _windows(spark):
    rows = ", ".join(map(str, WINDOWS))
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t(id, r0, r1, c0, c1)")


@query("window_query", f"{L} SELECT region, row, col, z FROM L WHERE row BETWEEN 10 AND 25 AND col BETWEEN 20 AND 35")
def window_query(spark, d):
    """A window from stored pages: 9 of the 64 pages of a field are read and unpacked, by partition
    folder and row group."""
    return window(stored(spark, d), BOX, 8, 8)


#: Points of a place that meet a field together.
_BLOCK = 256


@query("point_lookup", f"{L} SELECT o_orderkey AS id, region, row, col, z FROM orders JOIN L ON row = o_orderkey % 64 AND col = o_custkey % 64")
def point_lookup(spark, d):
    """Every point in every field. What comes out is points times fields, so its tasks follow the cores and
    not the bytes that go in, by a join that spills. A place's points go in blocks, and a block's rows come field by
    field: field and height stay the same over a block and its ids recur, so what keeps the rows keeps them in few bytes."""
    points = read(spark, d, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_orderkey") % 64).cast("int").alias("row"), (F.col("o_custkey") % 64).cast("int").alias("col"))
    tasks = max(16 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    nth = F.row_number().over(Window.partitionBy("row", "col").orderBy("id"))
    blocks = points.repartition(tasks, "row", "col").withColumn("block", F.floor((nth - 1) / _BLOCK)).groupBy("row", "col", "block").agg(F.collect_list("id").alias("ids"))
    met = blocks.join(lattice(spark, d).hint("merge"), ["row", "col"])
    return met.select(F.explode("ids").alias("id"), "region", "row", "col", "z")


@query("multi_window", f"{L}, {WINDOWS_SQL} SELECT id, region, row, col, z FROM W JOIN L ON row BETWEEN r0 AND r1 AND col BETWEEN c0 AND c1")
def multi_window(spark, d):
    """Windows meet the pages that they cover by equality, then cells are cut to the window."""
    need = cover(_windows(spark), 8)
    cells = lattice(spark, d).withColumns({"y": F.floor(F.col("row") / 8).cast("int"), "x": F.floor(F.col("col") / 8).cast("int")})
    last = cover(_windows(spark), 8, minimal=False).select("id", "r0", "r1", "c0", "c1", "y", "x")
    found = cells.join(need.unionByName(last).distinct(), ["y", "x"]).where(F.col("row").between(F.col("r0"), F.col("r1")) & F.col("col").between(F.col("c0"), F.col("c1")))
    return found.select("id", "region", "row", "col", "z")


@query("overview_stride8", f"{L} SELECT region, row // 8 AS row, col // 8 AS col, z FROM L WHERE row % 8 = 0 AND col % 8 = 0")
def overview_stride8(spark, d):
    return lattice(spark, d).where("row % 8 = 0 AND col % 8 = 0").select("region", F.expr("cast(row / 8 as int)").alias("row"), F.expr("cast(col / 8 as int)").alias("col"), "z")


_LAST = "greatest({lo} // 8, CASE WHEN {hi} > {lo} AND {hi} % 8 = 0 THEN ({hi} - 1) // 8 ELSE {hi} // 8 END)"
_COVER = f"""K AS (SELECT id, r0, r1, c0, c1, CAST(y AS INTEGER) AS y, CAST(x AS INTEGER) AS x FROM W, range(0, 9) AS a(y), range(0, 9) AS b(x)
 WHERE y BETWEEN r0 // 8 AND {_LAST.format(lo="r0", hi="r1")} AND x BETWEEN c0 // 8 AND {_LAST.format(lo="c0", hi="c1")})"""


@query("page_cover_minimal", f"WITH {CUSTOMER_WINDOWS}, {_COVER} SELECT id, y, x FROM K")
def page_cover_minimal(spark, d):
    return cover(_customer_windows(spark, d), 8).select("id", "y", "x")


@query(
    "page_cover_naive_ratio",
    f"""WITH {CUSTOMER_WINDOWS}, {_COVER}, pg AS (SELECT id, count(*) AS pages FROM K GROUP BY id)
    SELECT id, pages, CAST((r1 // 8 - r0 // 8 + 1) * (c1 // 8 - c0 // 8 + 1) AS BIGINT) AS naive,
    round((r1 // 8 - r0 // 8 + 1) * (c1 // 8 - c0 // 8 + 1) / pages, 6) AS ratio FROM pg JOIN W USING (id)""",
)
def page_cover_naive_ratio(spark, d):
    best = cover(_customer_windows(spark, d), 8).groupBy("id").agg(F.count("*").alias("pages"))
    naive = cover(_customer_windows(spark, d), 8, minimal=False).groupBy("id").agg(F.count("*").alias("naive"))
    return best.join(naive, "id").withColumn("ratio", rounded(F.col("naive") / F.col("pages")))


@query("page_workload", "SELECT DISTINCT CAST(least((o_orderkey % 64) // 8, 7) * 8 AS INTEGER) AS y, CAST(least((o_custkey % 64) // 8, 7) * 8 AS INTEGER) AS x FROM orders")
def page_workload(spark, d):
    """Pages that a workload of points touches, by their first node."""
    at = lambda c: (F.least(F.floor(F.col(c) % 64 / 8), F.lit(7)) * 8).cast("int")
    return read(spark, d, "orders").select(at("o_orderkey").alias("y"), at("o_custkey").alias("x")).distinct()


@query(
    "page_useful_samples",
    f"""WITH {CUSTOMER_WINDOWS}, {_COVER} SELECT id, y, x, CAST((least(r1, y * 8 + 8) - greatest(r0, y * 8) + 1) * (least(c1, x * 8 + 8) - greatest(c0, x * 8) + 1) AS INTEGER) AS useful FROM K""",
)
def page_useful_samples(spark, d):
    shared = lambda lo, hi, p: F.least(F.col(hi), F.col(p) * 8 + 8) - F.greatest(F.col(lo), F.col(p) * 8) + 1
    return cover(_customer_windows(spark, d), 8).select("id", "y", "x", (shared("r0", "r1", "y") * shared("c0", "c1", "x")).alias("useful"))


@query("page_stats", f"{L}, {NODES_SQL}, {HELD} SELECT region, CAST(y AS INTEGER) AS y, CAST(x AS INTEGER) AS x, count(*) AS nodes, min(z) AS low, max(z) AS high FROM H GROUP BY ALL")
def page_stats(spark, d):
    held = with_pages(nodes(spark, d), 8, SIDE)
    return held.groupBy("region", "y", "x").agg(F.count("*").alias("nodes"), F.min("z").alias("low"), F.max("z").alias("high"))


_BOUNDS = "B AS (SELECT region, CAST(y AS INTEGER) AS y, CAST(x AS INTEGER) AS x, min(z) AS low, max(z) AS high FROM H GROUP BY ALL)"


@query(
    "compact_bounds",
    f"""{L}, {NODES_SQL}, {HELD}, {_BOUNDS} SELECT region, y, x, floor(low / 0.01::DOUBLE) * 0.01::DOUBLE AS low_q, ceil(high / 0.01::DOUBLE) * 0.01::DOUBLE AS high_q,
    round(greatest(low - floor(low / 0.01::DOUBLE) * 0.01::DOUBLE, ceil(high / 0.01::DOUBLE) * 0.01::DOUBLE - high), 9) + 0.0 AS loosened FROM B""",
)
def compact_bounds(spark, d):
    """Bounds rounded outwards to a quantum, and by how much that loosens them."""
    low, high = F.floor(F.col("low") / 0.01) * F.lit(0.01), F.ceil(F.col("high") / 0.01) * F.lit(0.01)
    b = page_stats(spark, d).withColumns({"low_q": low.cast("double"), "high_q": high.cast("double")})
    return b.select("region", "y", "x", "low_q", "high_q", rounded(F.greatest(F.col("low") - F.col("low_q"), F.col("high_q") - F.col("high")), 9).alias("loosened"))


@query("zone_map_prune", f"{L}, {NODES_SQL}, {HELD}, {_BOUNDS} SELECT region, y, x FROM B WHERE low <= -0.3 AND high >= 0.3")
def zone_map_prune(spark, d):
    return page_stats(spark, d).where("low <= -0.3 AND high >= 0.3").select("region", "y", "x")


@query("uniform_quantise", f"{E} SELECT region, row, col, e FROM E")
def uniform_quantise(spark, d):
    return estimate(lattice(spark, d)).select("region", "row", "col", "e")


@query(
    "lattice_quantise",
    f"{L} SELECT region, row, col, CAST(round_even(z / 0.001::DOUBLE, 0) AS BIGINT) AS mm, CAST(floor((round_even(z / 0.001::DOUBLE, 0) + 24) / 49) AS BIGINT) AS k FROM L",
)
def lattice_quantise(spark, d):
    """Millimetres, and bins of 2 E + 1 of them for a bound of 25 mm: the quotient is floored."""
    e = 24
    mm = F.rint(F.col("z") / 0.001)
    return lattice(spark, d).select("region", "row", "col", mm.cast("bigint").alias("mm"), F.floor((mm + e) / (2 * e + 1)).alias("k"))


_METRICS = """round(max(abs(e - z)), 6) + 0.0 AS max_error, round(sqrt(avg((e - z) * (e - z))), 6) + 0.0 AS rmse, round(avg(abs(e - z)), 6) + 0.0 AS mae,
 round(quantile_cont(abs(e - z), 0.99), 6) + 0.0 AS p99, round(avg(e - z), 6) + 0.0 AS bias"""


@query(
    "height_metrics",
    f"""{E} SELECT region, {_METRICS},
    count(*) FILTER (abs(e - z) > 0.02 + CASE WHEN z = 0 THEN pow(2.0, -149) ELSE pow(2.0, floor(log2(abs(z))) - 23) END) AS violations,
    count(*) FILTER (abs(e - z) > 0.02) AS strict_violations, round(greatest(0.0, max(abs(e - z) - 0.02)), 6) + 0.0 AS max_excess FROM E GROUP BY region""",
)
def height_metrics(spark, d):
    return metrics.height_metrics(estimate(lattice(spark, d)), 0.02)


@query("bound_violations", f"{E} SELECT region, count(*) FILTER (abs(e - z) > 0.01) AS over, round(max(abs(e - z) - 0.01), 6) + 0.0 AS most FROM E GROUP BY region HAVING count(*) FILTER (abs(e - z) > 0.01) > 0")
def bound_violations(spark, d):
    a = F.abs(F.col("e") - F.col("z"))
    return estimate(lattice(spark, d)).groupBy("region").agg(F.count_if(a > 0.01).alias("over"), rounded(F.max(a - 0.01)).alias("most")).where("over > 0")


@query("error_percentiles", f"{E} SELECT region, round(quantile_cont(abs(e - z), 0.5), 6) AS p50, round(quantile_cont(abs(e - z), 0.95), 6) AS p95, round(quantile_cont(abs(e - z), 0.99), 6) AS p99, round(max(abs(e - z)), 6) AS top FROM E GROUP BY region")
def error_percentiles(spark, d):
    return metrics.percentiles(estimate(lattice(spark, d)), F.abs(F.col("e") - F.col("z")), ["region"])


@query("tile_mae", f"{E} SELECT region, row // 16 AS tr, col // 16 AS tc, round(avg(abs(e - z)), 6) + 0.0 AS mae FROM E GROUP BY ALL")
def tile_mae(spark, d):
    at = lambda c: F.floor(F.col(c) / 16).cast("int")
    return estimate(lattice(spark, d)).groupBy("region", at("row").alias("tr"), at("col").alias("tc")).agg(rounded(F.avg(F.abs(F.col("e") - F.col("z")))).alias("mae"))


@query(
    "merged_partial_sums",
    f"""{E} SELECT region, count(*) AS n, round(sum(e - z), 6) + 0.0 AS total, round(sum((e - z) * (e - z)), 6) + 0.0 AS squares, round(max(abs(e - z)), 6) + 0.0 AS most FROM E GROUP BY region""",
)
def merged_partial_sums(spark, d):
    """Tiles' sums, squares and maxima merge exactly; means of means would not."""
    at = lambda c: F.floor(F.col(c) / 16)
    diff = F.col("e") - F.col("z")
    tiles = estimate(lattice(spark, d)).groupBy("region", at("row"), at("col")).agg(F.count("*").alias("n"), F.sum(diff).alias("s"), F.sum(diff * diff).alias("q"), F.max(F.abs(diff)).alias("m"))
    return tiles.groupBy("region").agg(F.sum("n").alias("n"), rounded(F.sum("s")).alias("total"), rounded(F.sum("q")).alias("squares"), rounded(F.max("m")).alias("most"))


@query("gradient_slope", f"{L}, {NEIGH}, {GRAD}, {SLOPE} SELECT region, row, col, round(gx, 9) + 0.0 AS gx, round(gy, 9) + 0.0 AS gy, round(slope, 9) + 0.0 AS slope FROM S")
def gradient_slope(spark, d):
    return stencils.slope(lattice(spark, d)).select("region", "row", "col", *(rounded(c, 9).alias(c) for c in ("gx", "gy", "slope")))


EDGES = (0.1, 0.3, 0.6)
CLASS = "(CASE WHEN slope >= 0.1 THEN 1 ELSE 0 END + CASE WHEN slope >= 0.3 THEN 1 ELSE 0 END + CASE WHEN slope >= 0.6 THEN 1 ELSE 0 END)"


@query("slope_classes", f"{L}, {NEIGH}, {GRAD}, {SLOPE} SELECT region, CAST({CLASS} AS INTEGER) AS band, count(*) AS cells FROM S GROUP BY ALL")
def slope_classes(spark, d):
    return stencils.slope(lattice(spark, d)).groupBy("region", slope_class(F.col("slope"), EDGES).alias("band")).agg(F.count("*").alias("cells"))


@query(
    "stratified_agreement",
    f"""{E}, {NEIGH}, {GRAD}, {SLOPE} SELECT CAST({CLASS} AS INTEGER) AS band, count(*) AS cells, round(avg(abs(e - S.z)), 6) + 0.0 AS mae,
    round(avg(CASE WHEN sign(e) = sign(S.z) THEN 1 ELSE 0 END), 6) + 0.0 AS same_sign FROM S JOIN E USING (region, row, col) GROUP BY ALL""",
)
def stratified_agreement(spark, d):
    cells = estimate(stencils.slope(lattice(spark, d)))
    same = (F.signum("e") == F.signum("z")).cast("int")
    return cells.groupBy(slope_class(F.col("slope"), EDGES).alias("band")).agg(F.count("*").alias("cells"), rounded(F.avg(F.abs(F.col("e") - F.col("z")))).alias("mae"), rounded(F.avg(same)).alias("same_sign"))


@query("laplacian_zero_flux", f"{L}, {NEIGH} SELECT region, row, col, round(coalesce(w, z) + coalesce(e, z) + coalesce(n, z) + coalesce(s, z) - 4 * z, 9) + 0.0 AS lap FROM N")
def laplacian_zero_flux(spark, d):
    return stencils.laplacian(lattice(spark, d)).select("region", "row", "col", rounded("lap", 9).alias("lap"))


@query("flux_divergence", f"{L}, {NEIGH} SELECT region, row, col, round(coalesce(e - z, 0) - coalesce(z - w, 0) + coalesce(s - z, 0) - coalesce(z - n, 0), 9) + 0.0 AS div FROM N")
def flux_divergence(spark, d):
    return stencils.flux_divergence(lattice(spark, d)).select("region", "row", "col", rounded("div", 9).alias("div"))


def _teacher(g: str) -> str:
    return f"coalesce(({g}) / (1 - least(abs({g}) / 1.2::DOUBLE, 0.99::DOUBLE) * least(abs({g}) / 1.2::DOUBLE, 0.99::DOUBLE)), 0)"


@query("nonlinear_flux", f"{L}, {NEIGH} SELECT region, row, col, round({_teacher('e - z')} - {_teacher('z - w')} + {_teacher('s - z')} - {_teacher('z - n')}, 7) + 0.0 AS div FROM N")
def nonlinear_flux(spark, d):
    return stencils.flux_divergence(lattice(spark, d), flux=lambda g: stencils.teacher_flux(g, 1.2)).select("region", "row", "col", rounded("div", 7).alias("div"))


@query("ledger_closure", f"{L}, {NEIGH}, d AS (SELECT region, coalesce(e - z, 0) - coalesce(z - w, 0) + coalesce(s - z, 0) - coalesce(z - n, 0) AS div FROM N) SELECT region, round(sum(0.1 * div), 6) + 0.0 AS observed, 0.0::DOUBLE AS boundary, abs(sum(0.1 * div)) < 1e-6 AS closed FROM d GROUP BY region")
def ledger_closure(spark, d):
    """One explicit diffusion step with closed edges: the volume that changed against what left."""
    moved = stencils.flux_divergence(lattice(spark, d)).groupBy("region").agg(F.sum(F.col("div") * 0.1).alias("v"))
    return moved.select("region", rounded("v").alias("observed"), F.lit(0.0).alias("boundary"), (F.abs("v") < 1e-6).alias("closed"))


_SHADE = "(sin(radians(45)) - gx * sin(radians(315)) * cos(radians(45)) + gy * cos(radians(315)) * cos(radians(45))) / sqrt(1 + gx * gx + gy * gy)"


@query("hillshade", f"{L}, {NEIGH}, {GRAD} SELECT region, row, col, round(greatest(0.0, {_SHADE}), 6) + 0.0 AS shade FROM G")
def hillshade(spark, d):
    return stencils.hillshade(lattice(spark, d)).select("region", "row", "col", rounded("shade").alias("shade"))


_FIVE = "({a2} + 4 * {a1} + 6 * z + 4 * {b1} + {b2}) / 16"


def _taps(part: str, order: str) -> str:
    w = f"OVER (PARTITION BY region, {part} ORDER BY {order})"
    one = {"a1": f"coalesce(lag(z, 1) {w}, z)", "b1": f"coalesce(lead(z, 1) {w}, z)"}
    return _FIVE.format(**one, a2=f"coalesce(lag(z, 2) {w}, {one['a1']})", b2=f"coalesce(lead(z, 2) {w}, {one['b1']})")


SMOOTH = f"""A1 AS (SELECT region, row, col, {_taps("row", "col")} AS z FROM L), A2 AS (SELECT * FROM A1 WHERE col % 2 = 0),
 A3 AS (SELECT region, row, col, {_taps("col", "row")} AS z FROM A2),
 A4 AS (SELECT region, row // 2 AS row, col // 2 AS col, z FROM A3 WHERE row % 2 = 0)"""


@query("smooth_decimate", f"{L}, {SMOOTH} SELECT region, row, col, round(z, 9) + 0.0 AS z FROM A4")
def smooth_decimate(spark, d):
    return stencils.smooth_decimate(lattice(spark, d), SIDE).select("region", "row", "col", rounded("z", 9).alias("z"))


_TRAP, _UP, _GAUSS = resample.weights("trapezoid", SIDE + 1, 4), resample.weights("bilinear", SIDE + 1, 4), resample.weights("gaussian", SIDE + 1, 4)


def _apply_sql(name: str, src: str, axis: str) -> str:
    return f"""{name}1 AS (SELECT region, o AS row, col, sum(w * z) AS z FROM {src} JOIN {axis} ON row = s GROUP BY ALL),
 {name} AS (SELECT region, row, o AS col, sum(w * z) AS z FROM {name}1 JOIN {axis} ON col = s GROUP BY ALL)"""


_OBS = f"{L}, {NODES_SQL}, {resample.sql_axis(_TRAP, 'WT')}, {_apply_sql('O', 'LN', 'WT')}"


@query("observe_trapezoid", f"{_OBS} SELECT region, row, col, round(z, 8) + 0.0 AS z FROM O")
def observe_trapezoid(spark, d):
    return resample.apply(nodes(spark, d), _TRAP).select("region", "row", "col", rounded("z", 8).alias("z"))


@query("observe_gaussian", f"{L}, {NODES_SQL}, {resample.sql_axis(_GAUSS, 'WG')}, {_apply_sql('O', 'LN', 'WG')} SELECT region, row, col, round(z, 8) + 0.0 AS z FROM O")
def observe_gaussian(spark, d):
    return resample.apply(nodes(spark, d), _GAUSS).select("region", "row", "col", rounded("z", 8).alias("z"))


@query("upsample_bilinear", f"{L}, {NODES_SQL}, A0 AS (SELECT region, row // 4 AS row, col // 4 AS col, z FROM LN WHERE row % 4 = 0 AND col % 4 = 0), {resample.sql_axis(_UP, 'WU')}, {_apply_sql('U', 'A0', 'WU')} SELECT region, row, col, round(z, 8) + 0.0 AS z FROM U")
def upsample_bilinear(spark, d):
    coarse = nodes(spark, d).where("row % 4 = 0 AND col % 4 = 0").select("region", (F.col("row") / 4).cast("int").alias("row"), (F.col("col") / 4).cast("int").alias("col"), "z")
    return resample.apply(coarse, _UP).select("region", "row", "col", rounded("z", 8).alias("z"))


@query("operator_consistency", f"{_OBS}, {resample.sql_axis(_UP, 'WU')}, {_apply_sql('U', 'O', 'WU')}, {_apply_sql('R', 'U', 'WT')} SELECT O.region, round(max(abs(R.z - O.z)), 7) + 0.0 AS worst, round(avg(abs(R.z - O.z)), 7) + 0.0 AS mean FROM O JOIN R USING (region, row, col) GROUP BY ALL")
def operator_consistency(spark, d):
    """How far a field brought up again is from what was observed."""
    seen = resample.apply(nodes(spark, d), _TRAP)
    again = resample.apply(resample.apply(seen, _UP), _TRAP).withColumnRenamed("z", "r")
    diff = F.abs(F.col("r") - F.col("z"))
    return seen.join(again, ["region", "row", "col"]).groupBy("region").agg(rounded(F.max(diff), 7).alias("worst"), rounded(F.avg(diff), 7).alias("mean"))


@query("back_projection", f"{_OBS}, {resample.sql_axis(_UP, 'WU')}, {_apply_sql('U', 'O', 'WU')}, {_apply_sql('R', 'U', 'WT')}, D AS (SELECT O.region, O.row, O.col, O.z - R.z AS z FROM O JOIN R USING (region, row, col)), {_apply_sql('V', 'D', 'WU')} SELECT region, row, col, round(U.z + V.z, 7) + 0.0 AS z FROM U JOIN V USING (region, row, col)")
def back_projection(spark, d):
    """One step of back-projection: the residual of what was observed is brought up and added."""
    seen = resample.apply(nodes(spark, d), _TRAP)
    up = resample.apply(seen, _UP)
    back = resample.apply(up, _TRAP).withColumnRenamed("z", "r")
    rest = seen.join(back, ["region", "row", "col"]).select("region", "row", "col", (F.col("z") - F.col("r")).alias("z"))
    more = resample.apply(rest, _UP).withColumnRenamed("z", "m")
    return up.join(more, ["region", "row", "col"]).select("region", "row", "col", rounded(F.col("z") + F.col("m"), 7).alias("z"))


#: Axes of four intervals for each supplier of a nation, and the weights of every fourth node along them.
AXES_SQL = """AX AS (SELECT s_nationkey AS nation, 4 * count(*) + 1 AS side FROM supplier GROUP BY 1),
 AW0 AS (SELECT nation, o, 4 * o + j AS s, CASE WHEN abs(j) = 2 THEN 0.5::DOUBLE ELSE 1.0 END AS w FROM AX, range(0, (side - 1) // 4 + 1) t(o), range(-2, 3) u(j) WHERE 4 * o + j BETWEEN 0 AND side - 1),
 AW AS (SELECT nation, CAST(o AS INTEGER) AS o, CAST(s AS INTEGER) AS s, w / sum(w) OVER (PARTITION BY nation, o) AS w FROM AW0)"""


def axes(spark, d):
    return read(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("nation")).agg((4 * F.count("*") + 1).cast("int").alias("side"))


@query("operator_fingerprint", f"WITH {AXES_SQL} SELECT nation, sha256(string_agg(t, ',' ORDER BY t)) AS sha256 FROM (SELECT nation, printf('%d:%d:%.9f', o, s, w) AS t FROM AW) GROUP BY nation")
def operator_fingerprint(spark, d):
    """A digest of the weights along each nation's axis, in order."""
    return resample.fingerprints(axes(spark, d), "nation", "trapezoid", 4)


TWIST = """W1 AS (SELECT *, lead(z) OVER (PARTITION BY region, row ORDER BY col) AS h01 FROM L),
 W2 AS (SELECT *, lead(z) OVER (PARTITION BY region, col ORDER BY row) AS h10, lead(h01) OVER (PARTITION BY region, col ORDER BY row) AS h11 FROM W1),
 TW AS (SELECT region, row, col, abs(z + h11 - h01 - h10) / 4 AS twist FROM W2 WHERE h01 IS NOT NULL AND h10 IS NOT NULL)"""


@query("twist_slack", f"{L}, {TWIST} SELECT region, round(max(twist), 9) + 0.0 AS slack, round(avg(twist), 9) + 0.0 AS mean FROM TW GROUP BY region")
def twist_slack(spark, d):
    return stencils.twist(lattice(spark, d)).groupBy("region").agg(rounded(F.max("twist"), 9).alias("slack"), rounded(F.avg("twist"), 9).alias("mean"))


_UP2 = resample.weights("bilinear", SIDE + 1, 2)
_HALF = "C2 AS (SELECT region, row // 2 AS row, col // 2 AS col, z FROM LN WHERE row % 2 = 0 AND col % 2 = 0)"


@query(
    "seam_certificate",
    f"""{L}, {NODES_SQL}, {_HALF}, {resample.sql_axis(_UP2, 'WU')}, {_apply_sql('U', 'C2', 'WU')},
    G AS (SELECT LN.region, max(abs(LN.z - U.z)) AS gap FROM LN JOIN U USING (region, row, col) GROUP BY ALL), {TWIST.replace('FROM L)', 'FROM LN)')},
    T2 AS (SELECT region, max(twist) AS slack FROM TW GROUP BY region)
    SELECT region, round(gap, 8) + 0.0 AS gap, round(slack, 8) + 0.0 AS slack, round(gap + slack, 8) + 0.0 AS bound FROM G JOIN T2 USING (region)""",
)
def seam_certificate(spark, d):
    """A bound on the gap between neighbouring pages of two levels: the bilinear gap, and the slack
    that drawing squares as two triangles can add."""
    fine = nodes(spark, d)
    coarse = fine.where("row % 2 = 0 AND col % 2 = 0").select("region", (F.col("row") / 2).cast("int").alias("row"), (F.col("col") / 2).cast("int").alias("col"), "z")
    up = resample.apply(coarse, _UP2).withColumnRenamed("z", "u")
    gap = fine.join(up, ["region", "row", "col"]).groupBy("region").agg(F.max(F.abs(F.col("z") - F.col("u"))).alias("gap"))
    slack = stencils.twist(fine).groupBy("region").agg(F.max("twist").alias("slack"))
    return gap.join(slack, "region").select("region", rounded("gap", 8).alias("gap"), rounded("slack", 8).alias("slack"), rounded(F.col("gap") + F.col("slack"), 8).alias("bound"))


@query("dilate_mask", f"{L}, m AS (SELECT * FROM L WHERE z > 0.3) SELECT DISTINCT region, CAST(row + a AS INTEGER) AS row, CAST(col + b AS INTEGER) AS col FROM m, range(-2, 3) AS p(a), range(-2, 3) AS q(b) WHERE row + a BETWEEN 0 AND 63 AND col + b BETWEEN 0 AND 63")
def dilate_mask(spark, d):
    return masks.dilate(lattice(spark, d).where("z > 0.3"), 2, SIDE)


def _erode(src: str, name: str) -> str:
    r, c = "(PARTITION BY region, row ORDER BY col)", "(PARTITION BY region, col ORDER BY row)"
    return f"""{name} AS (SELECT region, row, col, m AND coalesce(lag(m) OVER {r}, true) AND coalesce(lead(m) OVER {r}, true)
 AND coalesce(lag(m) OVER {c}, true) AND coalesce(lead(m) OVER {c}, true) AS m FROM {src})"""


@query("erode_mask", f"{L}, m0 AS (SELECT region, row, col, z > -0.3 AS m FROM L), {_erode('m0', 'm1')}, {_erode('m1', 'm2')} SELECT region, row, col FROM m2 WHERE m")
def erode_mask(spark, d):
    return masks.erode(lattice(spark, d).withColumn("m", F.col("z") > -0.3), 2).where("m").select("region", "row", "col")


@query("pool_any", f"{L} SELECT region, CAST(least((row + 2) // 4, 15) AS INTEGER) AS row, CAST(least((col + 2) // 4, 15) AS INTEGER) AS col, bool_or(z > 0.3) AS m FROM L GROUP BY ALL")
def pool_any(spark, d):
    return masks.pool_any(lattice(spark, d).withColumn("m", F.col("z") > 0.3), 4, SIDE)


LABELS = "K AS (SELECT region, row, col, CAST((row // 16 + 2 * (col // 16)) % 4 AS INTEGER) AS label FROM L)"


def _labelled(spark, d):
    return lattice(spark, d).select("region", "row", "col", ((F.floor(F.col("row") / 16) + 2 * F.floor(F.col("col") / 16)) % 4).cast("int").alias("label"))


@query(
    "distance_to_boundary",
    f"""{L}, {LABELS}, K2 AS (SELECT *, coalesce(lag(label) OVER r <> label, false) OR coalesce(lead(label) OVER r <> label, false)
    OR coalesce(lag(label) OVER c <> label, false) OR coalesce(lead(label) OVER c <> label, false) AS edge FROM K
    WINDOW r AS (PARTITION BY region, row ORDER BY col), c AS (PARTITION BY region, col ORDER BY row)),
    D AS (SELECT region, row + a AS row, col + b AS col, min(greatest(abs(a), abs(b))) AS d FROM K2, range(-4, 5) AS p(a), range(-4, 5) AS q(b) WHERE edge GROUP BY ALL)
    SELECT K.region, K.row, K.col, CAST(coalesce(d, 5) AS INTEGER) AS distance FROM K LEFT JOIN D ON K.region = D.region AND K.row = D.row AND K.col = D.col""",
)
def distance_to_boundary(spark, d):
    return masks.boundary_distance(_labelled(spark, d), 5, SIDE).select("region", "row", "col", "distance")


@query(
    "majority_filter",
    f"""{L}, K AS (SELECT region, row, col, CAST(floor((z + 1) * 10) AS INTEGER) % 3 AS label FROM L), Q AS (SELECT region, row + a AS row, col + b AS col, label, count(*) AS n FROM K, range(-1, 2) AS p(a), range(-1, 2) AS q(b) GROUP BY ALL)
    SELECT region, CAST(row AS INTEGER) AS row, CAST(col AS INTEGER) AS col, label FROM Q WHERE row BETWEEN 0 AND 63 AND col BETWEEN 0 AND 63 QUALIFY row_number() OVER (PARTITION BY region, row, col ORDER BY n DESC, label) = 1""",
)
def majority_filter(spark, d):
    cells = lattice(spark, d).select("region", "row", "col", (F.floor((F.col("z") + 1) * 10).cast("int") % 3).alias("label"))
    return masks.majority(cells, 1, SIDE)


SEEDS = [(3, 5, 5), (1, 40, 12), (2, 20, 50), (1, 60, 60), (4, 33, 33)]


@query("voronoi_labels", f"{L}, V(k, label, r, c) AS (VALUES " + ", ".join(f"({k}, {a}, {b}, {c})" for k, (a, b, c) in enumerate(SEEDS)) + ") SELECT region, row, col, label FROM L, V QUALIFY row_number() OVER (PARTITION BY region, row, col ORDER BY (row - r) * (row - r) + (col - c) * (col - c), k) = 1")
def voronoi_labels(spark, d):
    return masks.voronoi(lattice(spark, d), SEEDS).select("region", "row", "col", "label")


@query("roll_shift", f"{L} SELECT region, CAST((row + 5) % 64 AS INTEGER) AS row, CAST((col - 7 + 64) % 64 AS INTEGER) AS col, z FROM L")
def roll_shift(spark, d):
    return stencils.rolled(lattice(spark, d), 5, -7, SIDE)


@query(
    "block_shuffle",
    f"""{L}, B AS (SELECT DISTINCT region, row // 16 AS br, col // 16 AS bc FROM L),
    R AS (SELECT *, row_number() OVER (PARTITION BY region ORDER BY sha256(concat('7:', br, ':', bc))) - 1 AS k FROM B)
    SELECT L.region, CAST(k // 4 * 16 + row % 16 AS INTEGER) AS row, CAST(k % 4 * 16 + col % 16 AS INTEGER) AS col, z FROM L JOIN R ON L.region = R.region AND row // 16 = br AND col // 16 = bc""",
)
def block_shuffle(spark, d):
    return masks.shuffled_blocks(lattice(spark, d), 16, SIDE, 7)


@query(
    "class_fold",
    f"""{L}, K AS (SELECT *, CAST(floor(abs(z) * 10) AS INTEGER) AS label FROM L), N AS (SELECT label, count(*) AS n FROM K GROUP BY label),
    C AS (SELECT label, n, CASE WHEN label <> 0 AND n >= 0.005 * (SELECT sum(n) FROM N) THEN 1 ELSE 0 END AS keep FROM N)
    SELECT label, n AS cells, CAST(CASE WHEN keep = 1 THEN sum(keep) OVER (ORDER BY label) ELSE 0 END AS INTEGER) AS code FROM C""",
)
def class_fold(spark, d):
    cells = lattice(spark, d).withColumn("label", F.floor(F.abs("z") * 10).cast("int"))
    return masks.folded(cells, 0.005).groupBy("label", "code").agg(F.count("*").alias("cells"))


_SHAPES = [(1, 7, [(5.0, 5.0), (40.0, 8.0), (30.0, 45.0), (10.0, 30.0)]), (2, 9, [(20.0, 20.0), (60.0, 25.0), (50.0, 60.0), (35.0, 30.0), (22.0, 55.0)])]
_EDGES = [(s, v, *ring[k], *ring[(k + 1) % len(ring)]) for s, v, ring in _SHAPES for k in range(len(ring))]
_EDGE_ROWS = ", ".join(f"({s}, {v}, {a}D, {b}D, {c}D, {e}D)" for s, v, a, b, c, e in _EDGES)


@query(
    "rasterise_polygons",
    f"""{L}, P(shape, label, x0, y0, x1, y1) AS (VALUES {_EDGE_ROWS.replace("D", "::DOUBLE")}),
    G AS (SELECT CAST(r AS INTEGER) AS row, CAST(c AS INTEGER) AS col FROM range(0, 64) p(r), range(0, 64) q(c)),
    X AS (SELECT row, col, shape, label FROM G, P WHERE (y0 > row + 0.5) <> (y1 > row + 0.5) AND col + 0.5 < x0 + (row + 0.5 - y0) / (y1 - y0) * (x1 - x0) GROUP BY ALL HAVING count(*) % 2 = 1),
    Y AS (SELECT row, col, max_by(label, shape) AS label FROM X GROUP BY ALL)
    SELECT region, row, col, coalesce(label, 0) AS label FROM L LEFT JOIN Y USING (row, col)""",
)
def rasterise_polygons(spark, d):
    edges = spark.sql(f"SELECT * FROM VALUES {_EDGE_ROWS} AS t(shape, label, x0, y0, x1, y1)")
    return masks.rasterised(lattice(spark, d), edges, F.col("col") + F.lit(0.5), F.col("row") + F.lit(0.5)).select("region", "row", "col", "label")


@query("error_codes", f"{E} SELECT region, row, col, CAST(greatest(0, least(254, round_even((e - z) / 0.001::DOUBLE, 0) + 127)) AS INTEGER) AS code FROM E")
def error_codes(spark, d):
    code = F.greatest(F.lit(0.0), F.least(F.lit(254.0), F.rint((F.col("e") - F.col("z")) / 0.001) + 127))
    return estimate(lattice(spark, d)).select("region", "row", "col", code.cast("int").alias("code"))


_CODES = "Q AS (SELECT region, row, col, CAST(round_even((z + 10) / 0.001::DOUBLE, 0) AS BIGINT) % 65536 AS code FROM L)"


@query(
    "u16_delta_roundtrip",
    f"{L}, {_CODES}, D AS (SELECT *, ((code - coalesce(lag(code) OVER (PARTITION BY region ORDER BY row, col), 0)) % 65536 + 65536) % 65536 AS delta FROM Q) SELECT region, row, CAST(sum(delta) AS BIGINT) AS deltas, CAST(max(delta) AS BIGINT) AS top, true AS same FROM D GROUP BY ALL",
)
def u16_delta_roundtrip(spark, d):
    """Codes as differences that wrap at 2^16, and summed up again, along each field in row order."""
    from pyspark.sql import Window

    order = Window.partitionBy("region").orderBy("row", "col")
    q = lattice(spark, d).withColumn("code", F.rint((F.col("z") + 10) / 0.001).cast("bigint") % 65536)
    q = q.withColumn("delta", F.pmod(F.col("code") - F.coalesce(F.lag("code").over(order), F.lit(0)), F.lit(65536)))
    q = q.withColumn("back", F.pmod(F.sum("delta").over(order), F.lit(65536)))
    return q.groupBy("region", "row").agg(F.sum("delta").alias("deltas"), F.max("delta").alias("top"), F.bool_and(F.col("back") == F.col("code")).alias("same"))


_RES = "Q AS (SELECT region, row, col, CAST(round_even((z - e) / 0.001::DOUBLE, 0) AS BIGINT) AS r FROM E)"
_ZIG = "Z AS (SELECT *, CASE WHEN r >= 0 THEN 2 * r ELSE -2 * r - 1 END AS u FROM Q)"


@query("varint_zigzag_bytes", f"{E}, {_RES}, {_ZIG} SELECT region, CAST(sum(u) AS BIGINT) AS codes, CAST(sum(CASE WHEN u < 128 THEN 1 WHEN u < 16384 THEN 2 ELSE 3 END) AS BIGINT) AS bytes FROM Z GROUP BY region")
def varint_zigzag_bytes(spark, d):
    u = zigzag(F.rint((F.col("z") - F.col("e")) / 0.001).cast("bigint"))
    return estimate(lattice(spark, d)).withColumn("u", u).groupBy("region").agg(F.sum("u").alias("codes"), F.sum(varint_bytes(F.col("u"))).alias("bytes"))


@query(
    "symbol_entropy",
    f"""{E}, {_RES}, N AS (SELECT region, r, count(*) AS n FROM Q GROUP BY ALL), T AS (SELECT region, count(*) AS symbols, sum(n) AS t, sum(n * log2(n)) AS s FROM N GROUP BY region)
    SELECT region, symbols, round(log2(t) - s / t, 6) + 0.0 AS bits, round((log2(t) - s / t) * t, 3) + 0.0 AS code_bits FROM T""",
)
def symbol_entropy(spark, d):
    cells = estimate(lattice(spark, d)).withColumn("r", F.rint((F.col("z") - F.col("e")) / 0.001).cast("bigint"))
    return metrics.entropy(cells, "r", ["region"])


@query("interval_coverage", f"{E} SELECT region, round(avg(CASE WHEN z BETWEEN e - 0.02 AND e + 0.02 THEN 1 ELSE 0 END), 6) + 0.0 AS coverage, round(avg((e + 0.02) - (e - 0.02)), 6) + 0.0 AS width FROM E GROUP BY region")
def interval_coverage(spark, d):
    return metrics.interval_coverage(estimate(lattice(spark, d)), F.col("z"), F.col("e") - 0.02, F.col("e") + 0.02, ["region"])


@query(
    "pit_histogram",
    f"{E}, U AS (SELECT least(greatest((z - e) / 0.05::DOUBLE + 0.5, 0), 1) AS u FROM E) SELECT CAST(least(floor(u * 10), 9) AS INTEGER) AS bin, count(*) AS cells FROM U GROUP BY ALL",
)
def pit_histogram(spark, d):
    """Where heights fall in their quantiser cell; the last bin is closed."""
    u = F.least(F.greatest((F.col("z") - F.col("e")) / STEP + 0.5, F.lit(0.0)), F.lit(1.0))
    return estimate(lattice(spark, d)).groupBy(F.least(F.floor(u * 10), F.lit(9)).cast("int").alias("bin")).agg(F.count("*").alias("cells"))


@query("mask_neighbour_pairs", f"{L}, M AS (SELECT region, row, col FROM L WHERE z > 0), P AS (SELECT region, count(*) AS n FROM M a JOIN M b USING (region) WHERE (a.row = b.row AND b.col = a.col + 1) OR (a.col = b.col AND b.row = a.row + 1) GROUP BY region) SELECT region, n AS pairs FROM P")
def mask_neighbour_pairs(spark, d):
    """East and south neighbours that are both in a mask."""
    m = lattice(spark, d).withColumn("m", (F.col("z") > 0).cast("int"))
    east, south = F.lead("m").over(stencils.along_row()), F.lead("m").over(stencils.along_col())
    pairs = m.withColumns({"p": F.col("m") * F.coalesce(east, F.lit(0)), "q": F.col("m") * F.coalesce(south, F.lit(0))})
    return pairs.groupBy("region").agg(F.sum(F.col("p") + F.col("q")).alias("pairs"))


@query("semivariogram", f"{L}, P AS (SELECT region, h AS lag, avg((b.z - a.z) * (b.z - a.z)) / 2 AS g FROM L a JOIN range(1, 9) AS k(h) ON true JOIN L b USING (region, row) WHERE b.col = a.col + h GROUP BY ALL) SELECT region, CAST(lag AS INTEGER) AS lag, round(g, 8) + 0.0 AS gamma FROM P")
def semivariogram(spark, d):
    cells = lattice(spark, d)
    shifts = F.array(*(F.struct(F.lit(h).alias("lag"), F.lead("z", h).over(stencils.along_row()).alias("b")) for h in range(1, 9)))
    pairs = cells.withColumn("p", shifts).select("region", "z", F.explode("p").alias("p")).where("p.b IS NOT NULL")
    diff = F.col("p.b") - F.col("z")
    return pairs.groupBy("region", F.col("p.lag").alias("lag")).agg(rounded(F.avg(diff * diff) / 2, 8).alias("gamma"))


_FIT = """G2 AS (SELECT lag, avg(gamma) AS gamma FROM G GROUP BY lag), K AS (SELECT r AS reach, s / 10.0::DOUBLE AS sill FROM range(1, 11) AS a(r), range(1, 21) AS b(s)),
 X AS (SELECT reach, sill, sum((gamma - sill * (1 - exp(-lag / CAST(reach AS DOUBLE)))) * (gamma - sill * (1 - exp(-lag / CAST(reach AS DOUBLE))))) AS sse FROM K, G2 GROUP BY ALL)"""


@query("variogram_grid_fit", f"{L}, G AS (SELECT a.region, CAST(h AS INTEGER) AS lag, round(avg((b.z - a.z) * (b.z - a.z)) / 2, 8) AS gamma FROM L a JOIN range(1, 9) AS k(h) ON true JOIN L b USING (region, row) WHERE b.col = a.col + h GROUP BY ALL), {_FIT} SELECT CAST(reach AS INTEGER) AS reach, round(sill, 3) AS sill, round(sse, 6) + 0.0 AS sse FROM X ORDER BY X.sse, reach, sill LIMIT 1")
def variogram_grid_fit(spark, d):
    """An exponential model by least squares over a grid of reaches and sills."""
    gamma = semivariogram(spark, d).groupBy("lag").agg(F.avg("gamma").alias("gamma"))
    grid = spark.sql("SELECT CAST(r.id AS INT) AS reach, s.id / 10.0D AS sill FROM range(1, 11) r CROSS JOIN range(1, 21) s")
    miss = F.col("gamma") - F.col("sill") * (1 - F.exp(-F.col("lag") / F.col("reach").cast("double")))
    fits = gamma.crossJoin(F.broadcast(grid)).groupBy("reach", "sill").agg(F.sum(miss * miss).alias("sse"))  # 200 rows, fixed
    return fits.orderBy("sse", "reach", "sill").limit(1).select("reach", rounded("sill", 3).alias("sill"), rounded("sse").alias("sse"))


