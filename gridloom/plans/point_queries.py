"""Queries on points, lines, tiles, dates and markup."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.scalar import rounded
from ..operators import points
from ..sources.tables import EPOCHS_SQL, LATTICE_SQL, OBSERVATIONS_SQL, SIDE, epochs, lattice, observations, read
from .catalog import query

P = f"WITH {LATTICE_SQL}, {OBSERVATIONS_SQL}"
T = f"WITH {EPOCHS_SQL}"
IN = "I AS (SELECT id, region, n AS r, e AS c, height FROM P WHERE n BETWEEN 0 AND 63 AND e BETWEEN 0 AND 63)"
FOUR = """K AS (SELECT *, CAST(least(floor(r), 62) AS INTEGER) AS r0, CAST(least(floor(c), 62) AS INTEGER) AS c0 FROM I),
 S AS (SELECT id, K.region, height, r, c, sum((CASE WHEN a = 0 THEN 1 - (r - r0) ELSE r - r0 END) * (CASE WHEN b = 0 THEN 1 - (c - c0) ELSE c - c0 END) * z) AS z
 FROM K, (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) AS o(a, b), L WHERE L.region = K.region AND L.row = r0 + a AND L.col = c0 + b GROUP BY ALL)"""


def _points(spark, d):
    return observations(spark, d).select("id", "region", F.col("n").alias("r"), F.col("e").alias("c"), "height")


@query("bilinear_sample", f"{P}, {IN}, {FOUR} SELECT id, region, round(z, 8) + 0.0 AS z FROM S")
def bilinear_sample(spark, d):
    return points.bilinear(_points(spark, d), lattice(spark, d), "id", SIDE).select("id", "region", rounded("z", 8).alias("z"))


@query(
    "triangulated_sample",
    f"""{P}, {IN}, K AS (SELECT *, CAST(least(floor(r), 62) AS INTEGER) AS r0, CAST(least(floor(c), 62) AS INTEGER) AS c0 FROM I),
    N AS (SELECT id, region, r - r0 AS fr, c - c0 AS fc, dr, dc, CAST(r0 + dr AS INTEGER) AS row, CAST(c0 + dc AS INTEGER) AS col FROM K, (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) AS o(dr, dc)),
    Q AS (SELECT id, region, fr, fc, max(z) FILTER (dr = 0 AND dc = 0) AS z0, max(z) FILTER (dr = 0 AND dc = 1) AS z1, max(z) FILTER (dr = 1 AND dc = 0) AS z2, max(z) FILTER (dr = 1 AND dc = 1) AS z3 FROM N JOIN L USING (region, row, col) GROUP BY id, region, fr, fc)
    SELECT id, region, round(CASE WHEN fc >= fr THEN z0 * (1 - fc) + z1 * (fc - fr) + z3 * fr ELSE z0 * (1 - fr) + z2 * (fr - fc) + z3 * fc END, 8) + 0.0 AS z FROM Q""",
)
def triangulated_sample(spark, d):
    return points.triangulated(_points(spark, d), lattice(spark, d), "id", SIDE).select("id", "region", rounded("z", 8).alias("z"))


@query("point_in_box", f"{P} SELECT id, region FROM P WHERE e BETWEEN 10 AND 20 AND n BETWEEN 30 AND 40")
def point_in_box(spark, d):
    return observations(spark, d).where("e BETWEEN 10 AND 20 AND n BETWEEN 30 AND 40").select("id", "region")


@query(
    "profile_sample",
    f"""{P}, I AS (SELECT k AS id, region, 5 + k * 0.5::DOUBLE AS r, 3 + k * 0.7::DOUBLE AS c, 0.0::DOUBLE AS height FROM (SELECT DISTINCT region FROM L), range(0, 81) AS t(k) WHERE 3 + k * 0.7::DOUBLE <= 63), {FOUR}
    SELECT id, region, round(z, 8) + 0.0 AS z FROM S""",
)
def profile_sample(spark, d):
    """Heights at equal steps along a segment."""
    cells = lattice(spark, d)
    at = cells.select("region").distinct().withColumn("id", F.explode(F.transform(F.sequence(F.lit(0), F.lit(80)), lambda k: k.cast("bigint"))))
    at = at.select("id", "region", (5 + F.col("id") * 0.5).alias("r"), (3 + F.col("id") * 0.7).alias("c")).where("c <= 63")
    return points.bilinear(at, cells, "id", SIDE).select("id", "region", rounded("z", 8).alias("z"))


LINES = "V AS (SELECT o_custkey AS line, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k, CAST((o_orderkey * 37) % 640 AS DOUBLE) / 10 AS x, CAST((o_orderkey * 53) % 640 AS DOUBLE) / 10 AS y FROM orders)"


def _lines(spark, d):
    o = read(spark, d, "orders")
    k = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    return o.select(F.col("o_custkey").alias("line"), k.alias("k"), (((F.col("o_orderkey") * 37) % 640).cast("double") / 10).alias("x"), (((F.col("o_orderkey") * 53) % 640).cast("double") / 10).alias("y"))


@query(
    "polyline_densify",
    f"""WITH {LINES}, S AS (SELECT *, lead(x) OVER w AS nx, lead(y) OVER w AS ny FROM V WINDOW w AS (PARTITION BY line ORDER BY k)),
    N AS (SELECT *, CASE WHEN nx IS NULL THEN 1 ELSE greatest(1, ceil(sqrt((nx - x) * (nx - x) + (ny - y) * (ny - y)) / 10)) END AS n FROM S)
    SELECT line, CAST(k AS INTEGER) AS k, CAST(j AS INTEGER) AS j, round(x + j / n * (coalesce(nx, x) - x), 7) + 0.0 AS x, round(y + j / n * (coalesce(ny, y) - y), 7) + 0.0 AS y FROM N, range(0, 12) AS r(j) WHERE j < n""",
)
def polyline_densify(spark, d):
    return points.densified(_lines(spark, d), 10.0).select("line", "k", "j", rounded("x", 7).alias("x"), rounded("y", 7).alias("y"))


@query("path_distance", f"WITH {LINES}, S AS (SELECT *, sqrt(pow(x - lag(x) OVER w, 2) + pow(y - lag(y) OVER w, 2)) AS d FROM V WINDOW w AS (PARTITION BY line ORDER BY k)) SELECT line, CAST(k AS INTEGER) AS k, round(sum(coalesce(d, 0)) OVER (PARTITION BY line ORDER BY k), 6) + 0.0 AS distance FROM S")
def path_distance(spark, d):
    w = Window.partitionBy("line").orderBy("k")
    v = _lines(spark, d)
    step = F.sqrt(F.pow(F.col("x") - F.lag("x").over(w), 2) + F.pow(F.col("y") - F.lag("y").over(w), 2))
    return v.withColumn("s", F.coalesce(step, F.lit(0.0))).select("line", "k", rounded(F.sum("s").over(w)).alias("distance"))


@query("profile_bump", f"WITH {LATTICE_SQL}, B AS (SELECT *, median(z) OVER (PARTITION BY region, row ORDER BY col ROWS BETWEEN 6 PRECEDING AND 6 FOLLOWING) AS m FROM L) SELECT region, row, col, round(z - m, 8) + 0.0 AS bump FROM B")
def profile_bump(spark, d):
    """A node against the median of the six nodes on each side."""
    w = Window.partitionBy("region", "row").orderBy("col").rowsBetween(-6, 6)
    near = F.array_sort(F.collect_list("z").over(w))
    n = F.size("s")
    mid = (F.get("s", F.floor((n - 1) / 2).cast("int")) + F.get("s", F.floor(n / 2).cast("int"))) / 2
    return lattice(spark, d).withColumn("s", near).select("region", "row", "col", rounded(F.col("z") - mid, 8).alias("bump"))


@query("rolling_relief", f"WITH {LATTICE_SQL}, R AS (SELECT region, row, col, max(z) OVER w AS a, min(z) OVER w AS b FROM L WINDOW w AS (PARTITION BY region, row ORDER BY col ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)) SELECT region, row, col, max(a) OVER w - min(b) OVER w AS relief FROM R WINDOW w AS (PARTITION BY region, col ORDER BY row ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)")
def rolling_relief(spark, d):
    """Highest minus lowest node in a 7 by 7 neighbourhood, one axis after the other."""
    row = Window.partitionBy("region", "row").orderBy("col").rowsBetween(-3, 3)
    col = Window.partitionBy("region", "col").orderBy("row").rowsBetween(-3, 3)
    r = lattice(spark, d).withColumns({"a": F.max("z").over(row), "b": F.min("z").over(row)})
    return r.select("region", "row", "col", (F.max("a").over(col) - F.min("b").over(col)).alias("relief"))


@query("tertiles", f"WITH {LATTICE_SQL}, Q AS (SELECT region, quantile_cont(z, 1 / 3.0::DOUBLE) AS a, quantile_cont(z, 2 / 3.0::DOUBLE) AS b FROM L GROUP BY region) SELECT region, CASE WHEN z < a THEN 'low' WHEN z < b THEN 'mid' ELSE 'high' END AS stratum, count(*) AS cells FROM L JOIN Q USING (region) GROUP BY ALL")
def tertiles(spark, d):
    cells = lattice(spark, d)
    q = cells.groupBy("region").agg(F.percentile("z", F.lit(1 / 3.0)).alias("a"), F.percentile("z", F.lit(2 / 3.0)).alias("b"))
    s = F.when(F.col("z") < F.col("a"), "low").when(F.col("z") < F.col("b"), "mid").otherwise("high")
    return cells.join(q, "region").groupBy("region", s.alias("stratum")).agg(F.count("*").alias("cells"))


@query(
    "cdf_quantile",
    "WITH G AS (SELECT p_brand AS g, p_size AS x, sum(p_retailprice) AS w FROM part GROUP BY ALL), C AS (SELECT *, sum(w) OVER (PARTITION BY g ORDER BY x) / sum(w) OVER (PARTITION BY g) AS f FROM G), B AS (SELECT *, lag(f) OVER (PARTITION BY g ORDER BY x) AS f0, lag(x) OVER (PARTITION BY g ORDER BY x) AS x0 FROM C) SELECT g, round(CASE WHEN f0 IS NULL THEN x ELSE x0 + (0.5 - f0) / (f - f0) * (x - x0) END, 6) + 0.0 AS median FROM B WHERE f >= 0.5 AND coalesce(f0, 0) < 0.5",
)
def cdf_quantile(spark, d):
    """The median of a density on a grid, linear between its nodes."""
    g = read(spark, d, "part").groupBy(F.col("p_brand").alias("g"), F.col("p_size").alias("x")).agg(F.sum("p_retailprice").alias("w"))
    w = Window.partitionBy("g").orderBy("x")
    c = g.withColumn("f", F.sum("w").over(w) / F.sum("w").over(Window.partitionBy("g")))
    b = c.withColumns({"f0": F.lag("f").over(w), "x0": F.lag("x").over(w)}).where("f >= 0.5 AND coalesce(f0, 0) < 0.5")
    mid = F.col("x0") + (0.5 - F.col("f0")) / (F.col("f") - F.col("f0")) * (F.col("x") - F.col("x0"))
    return b.select("g", rounded(F.when(F.col("f0").isNull(), F.col("x").cast("double")).otherwise(mid)).alias("median"))


@query(
    "level_interval",
    "WITH G AS (SELECT p_brand AS g, p_size AS x, avg(p_retailprice) AS v FROM part GROUP BY ALL), H AS (SELECT *, max(v) OVER (PARTITION BY g) - v AS fall FROM G), I AS (SELECT *, lag(fall) OVER (PARTITION BY g ORDER BY x) AS d0, lag(x) OVER (PARTITION BY g ORDER BY x) AS x0 FROM H), C AS (SELECT g, x0 + (lev - d0) / (fall - d0) * (x - x0) AS hit FROM (SELECT *, max(fall) OVER (PARTITION BY g) / 2 AS lev FROM I) WHERE (d0 > lev) <> (fall > lev)) SELECT g, round(min(hit), 6) + 0.0 AS low, round(max(hit), 6) + 0.0 AS high FROM C GROUP BY g",
)
def level_interval(spark, d):
    """First and last crossing of the level halfway down a profile, linear between nodes."""
    g = read(spark, d, "part").groupBy(F.col("p_brand").alias("g"), F.col("p_size").alias("x")).agg(F.avg("p_retailprice").alias("v"))
    w = Window.partitionBy("g").orderBy("x")
    h = g.withColumn("drop", F.max("v").over(Window.partitionBy("g")) - F.col("v"))
    h = h.withColumns({"d0": F.lag("drop").over(w), "x0": F.lag("x").over(w), "level": F.max("drop").over(Window.partitionBy("g")) / 2}).where("(d0 > level) <> (drop > level)")
    at = F.col("x0") + (F.col("level") - F.col("d0")) / (F.col("drop") - F.col("d0")) * (F.col("x") - F.col("x0"))
    return h.groupBy("g").agg(rounded(F.min(at)).alias("low"), rounded(F.max(at)).alias("high"))


RES = "R AS (SELECT id, region, height - z AS res FROM S)"


def _residuals(spark, d):
    p = _points(spark, d)
    z = points.bilinear(p, lattice(spark, d), "id", SIDE)
    return p.join(z, ["id", "region"]).withColumn("res", F.col("height") - F.col("z"))


@query("residual_spread_mad", f"{P}, {IN}, {FOUR}, {RES}, A AS (SELECT *, abs(res - median(res) OVER (PARTITION BY region)) AS d FROM R), B AS (SELECT *, median(d) OVER (PARTITION BY region) AS mad FROM A) SELECT region, round(any_value(mad), 7) + 0.0 AS mad, count(*) AS n, count(*) FILTER (d <= 3 * 1.4826::DOUBLE * mad) AS core FROM B GROUP BY region")
def residual_spread_mad(spark, d):
    core = points.mad_core(_residuals(spark, d), "res", ["region"])
    return core.groupBy("region").agg(rounded(F.first("mad"), 7).alias("mad"), F.count("*").alias("n"), F.count_if("core").alias("core"))


@query("top_residuals", f"{P}, {IN}, {FOUR}, {RES} SELECT id, round(res, 6) + 0.0 AS res FROM R ORDER BY abs(round(res, 6)) DESC, id LIMIT 10")
def top_residuals(spark, d):
    r = _residuals(spark, d).select("id", rounded("res").alias("res"))
    return r.orderBy(F.desc(F.abs("res")), "id").limit(10)


@query("registration_fit", f"{P}, {IN}, {FOUR}, {RES}, X AS (SELECT S.region, r AS y, c AS x, res AS z FROM R JOIN S ON R.id = S.id), G AS (SELECT region, count(z) AS n, avg(x) AS mx, avg(y) AS my, avg(z) AS mz, sum(x * x) - count(z) * avg(x) * avg(x) AS xx, sum(y * y) - count(z) * avg(y) * avg(y) AS yy, sum(x * y) - count(z) * avg(x) * avg(y) AS xy, sum(x * z) - count(z) * avg(x) * avg(z) AS xz, sum(y * z) - count(z) * avg(y) * avg(z) AS yz FROM X GROUP BY region), H AS (SELECT *, (xz * yy - yz * xy) / (xx * yy - xy * xy) AS b, (yz * xx - xz * xy) / (xx * yy - xy * xy) AS c FROM G) SELECT region, CASE WHEN n >= 10 AND xx * yy - xy * xy > 1e-6 * xx * yy THEN round(mz - b * mx - c * my, 4) + 0.0 END AS a, CASE WHEN n >= 10 AND xx * yy - xy * xy > 1e-6 * xx * yy THEN round(b, 4) + 0.0 END AS b, CASE WHEN n >= 10 AND xx * yy - xy * xy > 1e-6 * xx * yy THEN round(c, 4) + 0.0 END AS c FROM H")
def registration_fit(spark, d):
    """A plane through the residuals: shift and tilt by normal equations."""
    fit = points.least_squares2("c", "r", "res")
    enough = (F.count("res") >= 10) & fit.pop("sound")
    return _residuals(spark, d).groupBy("region").agg(*(F.when(enough, rounded(v, 4)).alias(k) for k, v in fit.items()))


@query("ols_slope", "SELECT p_brand AS g, count(*) AS n, round(regr_slope(p_retailprice, p_size), 6) + 0.0 AS slope, CASE WHEN count(*) > 2 THEN round(sqrt((1 - regr_r2(p_retailprice, p_size)) * regr_syy(p_retailprice, p_size) / (count(*) - 2) / regr_sxx(p_retailprice, p_size)), 6) + 0.0 END AS se FROM part GROUP BY ALL")
def ols_slope(spark, d):
    y, x = "p_retailprice", "p_size"
    se = F.sqrt((1 - F.regr_r2(y, x)) * F.regr_syy(y, x) / (F.count("*") - 2) / F.regr_sxx(y, x))
    return read(spark, d, "part").groupBy(F.col("p_brand").alias("g")).agg(F.count("*").alias("n"), rounded(F.regr_slope(y, x)).alias("slope"), F.when(F.count("*") > 2, rounded(se)).alias("se"))


@query(
    "nearest_axis",
    "WITH B AS (SELECT s_suppkey AS bridge, (s_suppkey * 37) % 640 / 10.0::DOUBLE AS x, (s_suppkey * 53) % 640 / 10.0::DOUBLE AS y FROM supplier), V AS (SELECT o_custkey AS axis, o_orderkey AS k, (o_orderkey * 37) % 640 / 10.0::DOUBLE AS x, (o_orderkey * 53) % 640 / 10.0::DOUBLE AS y FROM orders), D AS (SELECT bridge, axis, min(sqrt((B.x - V.x) * (B.x - V.x) + (B.y - V.y) * (B.y - V.y))) AS d FROM B JOIN V ON V.x BETWEEN B.x - 1.5 AND B.x + 1.5 AND V.y BETWEEN B.y - 1.5 AND B.y + 1.5 GROUP BY ALL HAVING min(sqrt((B.x - V.x) * (B.x - V.x) + (B.y - V.y) * (B.y - V.y))) <= 1.5) SELECT bridge, min(axis) AS axis, round(arg_min(d, axis), 6) + 0.0 AS distance FROM D GROUP BY bridge",
)
def nearest_axis(spark, d):
    """The first axis with a vertex within reach of a bridge. A place follows from a key's remainder by 640,
    so there are few: of all vertices at a place only the first axis can be an answer, and all bridges at a
    place have the same. Places are put on a grid of the reach, so that they meet by equality in the nine
    squares around a bridge."""
    reach = 1.5
    at = lambda k, x, y: [((F.col(k) * 37) % 640 / F.lit(10.0)).alias(x), ((F.col(k) * 53) % 640 / F.lit(10.0)).alias(y)]
    square = lambda c: F.floor(F.col(c) / reach)
    around = lambda c: F.explode(F.sequence(square(c) - 1, square(c) + 1))
    bridges = read(spark, d, "supplier").select(F.col("s_suppkey").alias("bridge"), *at("s_suppkey", "bx", "by")).distinct()
    b = bridges.select("bx", "by").distinct().withColumn("gx", around("bx")).withColumn("gy", around("by"))
    v = read(spark, d, "orders").select(F.col("o_custkey").alias("axis"), *at("o_orderkey", "x", "y")).groupBy("x", "y").agg(F.min("axis").alias("axis"))
    v = v.withColumns({"gx": square("x"), "gy": square("y")})
    dist = F.sqrt((F.col("bx") - F.col("x")) * (F.col("bx") - F.col("x")) + (F.col("by") - F.col("y")) * (F.col("by") - F.col("y")))
    near = b.join(v, ["gx", "gy"]).withColumn("d", dist).where(F.col("d") <= reach)
    best = near.groupBy("bx", "by").agg(F.min(F.when(F.col("axis").isNotNull(), F.struct("axis", "d"))).alias("b"))
    return bridges.join(F.broadcast(best), ["bx", "by"]).select("bridge", F.col("b.axis").alias("axis"), rounded("b.d").alias("distance"))  # 1,279 places at most


@query("nearest_samples", f"{P}, K AS (SELECT id, e, n, CAST(floor(e / 16) AS INTEGER) AS tx, CAST(floor(n / 16) AS INTEGER) AS ty FROM P WHERE e >= 0 AND n >= 0 AND e < 64 AND n < 64), T0 AS (SELECT CAST(a AS INTEGER) AS tx, CAST(b AS INTEGER) AS ty FROM range(0, 4) p(a), range(0, 4) q(b)), D AS (SELECT T0.tx, T0.ty, id, (e - (T0.tx * 16 + 8)) * (e - (T0.tx * 16 + 8)) + (n - (T0.ty * 16 + 8)) * (n - (T0.ty * 16 + 8)) AS d FROM T0, K WHERE K.tx BETWEEN T0.tx - 1 AND T0.tx + 1 AND K.ty BETWEEN T0.ty - 1 AND T0.ty + 1) SELECT tx, ty, id FROM D QUALIFY row_number() OVER (PARTITION BY tx, ty ORDER BY d, id) <= 20")
def nearest_samples(spark, d):
    """At most twenty samples nearest to a tile's centre, from it and the tiles around it."""
    k = observations(spark, d).where("e >= 0 AND n >= 0 AND e < 64 AND n < 64").select("id", "e", "n", F.floor(F.col("e") / 16).cast("int").alias("tx"), F.floor(F.col("n") / 16).cast("int").alias("ty"))
    around = lambda c: F.explode(F.sequence(F.greatest(F.col(c) - 1, F.lit(0)), F.least(F.col(c) + 1, F.lit(3))))
    near = k.withColumn("ax", around("tx")).withColumn("ay", around("ty"))
    dx, dy = F.col("e") - (F.col("ax") * 16 + 8), F.col("n") - (F.col("ay") * 16 + 8)
    place = F.row_number().over(Window.partitionBy("ax", "ay").orderBy(dx * dx + dy * dy, "id"))
    return near.withColumn("k", place).where("k <= 20").select(F.col("ax").alias("tx"), F.col("ay").alias("ty"), "id")


@query("tiles_under_bounds", f"{T} SELECT tile, e, n FROM T WHERE e < 12500 AND e + 1000 > 3500 AND n < 9000 AND n + 1000 > 4000")
def tiles_under_bounds(spark, d):
    return epochs(spark, d).where("e < 12500 AND e + 1000 > 3500 AND n < 9000 AND n + 1000 > 4000").select("tile", "e", "n")


@query("late_republished", f"{T} SELECT tile, CASE WHEN published > DATE '1997-01-01' THEN NULL ELSE surveyed END AS epoch FROM T")
def late_republished(spark, d):
    """A tile published again after it was retrieved has an unknown epoch: null, not the date at hand."""
    return epochs(spark, d).select("tile", F.when(F.col("published") > F.lit("1997-01-01").cast("date"), None).otherwise(F.col("surveyed")).alias("epoch"))


@query("epoch_counts", f"{T} SELECT method, CAST(year(surveyed) AS INTEGER) AS y, count(*) AS tiles FROM T GROUP BY ALL")
def epoch_counts(spark, d):
    return epochs(spark, d).groupBy("method", F.year("surveyed").alias("y")).agg(F.count("*").alias("tiles"))


@query("state_as_of", "WITH E AS (SELECT o_custkey AS k, o_orderdate AS t, o_orderkey AS v FROM orders), Q AS (SELECT c_custkey AS k, TIMESTAMP '1995-01-01' + to_days(CAST(c_custkey % 700 AS INTEGER)) AS at FROM customer) SELECT Q.k, (SELECT arg_max(v, (t, v)) FROM E WHERE E.k = Q.k AND E.t <= Q.at) AS v FROM Q")
def state_as_of(spark, d):
    """For each request the last state at or before it: both kinds of rows in one order, not a range join."""
    e = read(spark, d, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderdate").alias("t"), F.col("o_orderkey").alias("v"), F.lit(0).alias("kind"))
    q = read(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.expr("timestamp'1995-01-01' + make_interval(0, 0, 0, cast(c_custkey % 700 as int))").alias("t"), F.lit(None).cast("bigint").alias("v"), F.lit(1).alias("kind"))
    w = Window.partitionBy("k").orderBy("t", "kind", "v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return e.union(q).withColumn("s", F.last("v", ignorenulls=True).over(w)).where("kind = 1").select("k", F.col("s").alias("v"))


@query("latest_survey", "SELECT c_custkey AS id, max(CAST(o_orderdate AS DATE)) AS latest FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY ALL")
def latest_survey(spark, d):
    o = read(spark, d, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.max(F.to_date("o_orderdate")).alias("latest"))
    return read(spark, d, "customer").select(F.col("c_custkey").alias("id")).join(o, "id", "left")


@query("tile_names", "WITH N AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 7 = 0 THEN p_name ELSE 'dgm1_32_' || (300 + p_partkey % 100) || '_' || (5600 + p_size) || '_1_nw_' || (2015 + p_partkey % 9) END AS name FROM part) SELECT id, CAST(nullif(regexp_extract(name, '^dgm1_32_([0-9]+)_([0-9]+)_1_nw_([0-9]{4})$', 1), '') AS INTEGER) AS e, CAST(nullif(regexp_extract(name, '^dgm1_32_([0-9]+)_([0-9]+)_1_nw_([0-9]{4})$', 3), '') AS INTEGER) AS y FROM N")
def tile_names(spark, d):
    k = F.col("p_partkey")
    name = F.when(k % 7 == 0, F.col("p_name")).otherwise(F.concat(F.lit("dgm1_32_"), 300 + k % 100, F.lit("_"), 5600 + F.col("p_size"), F.lit("_1_nw_"), 2015 + k % 9))
    part = lambda g: F.expr(f"try_cast(regexp_extract(name, '^dgm1_32_([0-9]+)_([0-9]+)_1_nw_([0-9]{{4}})$', {g}) AS INT)")
    return read(spark, d, "part").select(k.alias("id"), name.alias("name")).select("id", part(1).alias("e"), part(3).alias("y"))


@query("decimal_comma", "WITH N AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 17 = 0 THEN 'x' ELSE replace(printf('%.2f', c_acctbal), '.', ',') END AS t, printf('32%06d', CAST(c_custkey AS INTEGER)) AS east FROM customer) SELECT id, TRY_CAST(replace(t, ',', '.') AS DOUBLE) AS height, TRY_CAST(substr(east, 3) AS BIGINT) AS east FROM N WHERE TRY_CAST(replace(t, ',', '.') AS DOUBLE) IS NOT NULL")
def decimal_comma(spark, d):
    """Heights with a decimal comma, eastings with a zone in front; rows without a number are dropped."""
    k = F.col("c_custkey")
    t = F.when(k % 17 == 0, "x").otherwise(F.translate(F.format_string("%.2f", "c_acctbal"), ".", ","))
    n = read(spark, d, "customer").select(k.alias("id"), t.alias("t"), F.format_string("32%06d", k).alias("east"))
    return n.select("id", F.expr("try_cast(replace(t, ',', '.') AS DOUBLE)").alias("height"), F.expr("try_cast(substring(east, 3) AS BIGINT)").alias("east")).where("height IS NOT NULL")


@query("late_receipts", "WITH C AS (SELECT max(ts) - INTERVAL 2 HOUR AS cut FROM events) SELECT event_type, count(*) AS n, count(*) FILTER (ts < cut) AS late FROM events, C GROUP BY event_type")
def late_receipts(spark, d):
    e = read(spark, d, "events")
    cut = e.agg((F.max("ts") - F.expr("INTERVAL 2 HOURS")).alias("cut"))
    return e.crossJoin(F.broadcast(cut)).groupBy("event_type").agg(F.count("*").alias("n"), F.count_if(F.col("ts") < F.col("cut")).alias("late"))  # one row


@query("tumbling_counts", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) + 0.0 AS total FROM events GROUP BY ALL")
def tumbling_counts(spark, d):
    """Extension: hourly windows."""
    w = F.window("ts", "1 hour")
    return read(spark, d, "events").groupBy(w, "event_type").agg(F.count("*").alias("n"), rounded(F.sum("value"), 4).alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


@query("session_counts", "WITH S AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), G AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM S) SELECT user_id, min(ts) AS start, count(*) AS n FROM G GROUP BY user_id, k")
def session_counts(spark, d):
    """Extension: sessions that a pause of half an hour ends."""
    s = F.session_window("ts", "30 minutes")
    return read(spark, d, "events").groupBy("user_id", s).agg(F.count("*").alias("n")).select("user_id", F.col("session_window.start").alias("start"), "n")


@query("markup_inventory", "WITH T AS (SELECT unnest(regexp_extract_all(html, '<([a-z][a-z0-9]*)', 1)) AS tag FROM pages) SELECT tag, count(*) AS n FROM T GROUP BY tag")
def markup_inventory(spark, d):
    tags = F.regexp_extract_all("html", F.lit("<([a-z][a-z0-9]*)"), F.lit(1))
    return read(spark, d, "pages").select(F.explode(tags).alias("tag")).groupBy("tag").agg(F.count("*").alias("n"))


@query("markup_attributes", "WITH T AS (SELECT unnest(regexp_extract_all(html, '<html lang=\"([a-z]+)\"', 1)) AS v FROM pages) SELECT list_sort(list_distinct(list(v)))[1:12] AS vals, count(*) AS n FROM T")
def markup_attributes(spark, d):
    """At most twelve sample values of a field, in order."""
    v = F.explode(F.regexp_extract_all("html", F.lit('<html lang="([a-z]+)"'), F.lit(1)))
    one = read(spark, d, "pages").select(v.alias("v")).groupBy("v").agg(F.count("*").alias("n"))
    first = one.orderBy("v").limit(12).agg(F.array_sort(F.collect_list("v")).alias("vals"))  # twelve rows
    return first.crossJoin(one.agg(F.sum("n").alias("n")))  # one row each


@query("axial_strike", "SELECT c_custkey AS id, round(sin(2 * radians(c_custkey % 180)), 9) + 0.0 AS s2, round(cos(2 * radians(c_custkey % 180)), 9) + 0.0 AS c2 FROM customer")
def axial_strike(spark, d):
    a = 2 * F.radians(F.col("c_custkey") % 180)
    return read(spark, d, "customer").select(F.col("c_custkey").alias("id"), rounded(F.sin(a), 9).alias("s2"), rounded(F.cos(a), 9).alias("c2"))


@query("node_of_point", "SELECT c_custkey AS id, CAST(round_even((5700000 - (5690000 + (c_custkey * 53) % 6600)) / 10.0, 0) AS BIGINT) AS row, CAST(round_even(((360000 + (c_custkey * 37) % 6600) - 360000) / 10.0, 0) AS BIGINT) AS col FROM customer")
def node_of_point(spark, d):
    """The lattice node of a coordinate: rows go south, halves go to even."""
    k = F.col("c_custkey")
    row = F.rint((5700000 - (5690000 + (k * 53) % 6600)) / F.lit(10.0)).cast("bigint")
    return read(spark, d, "customer").select(k.alias("id"), row.alias("row"), F.rint(((k * 37) % 6600) / F.lit(10.0)).cast("bigint").alias("col"))


@query("event_error_by_distance", "SELECT CAST(least(floor(p_size / 10.0), 4) AS INTEGER) AS ring, count(*) AS n, round(avg(p_retailprice), 4) + 0.0 AS error FROM part GROUP BY ALL")
def event_error_by_distance(spark, d):
    ring = F.least(F.floor(F.col("p_size") / 10.0), F.lit(4)).cast("int")
    return read(spark, d, "part").groupBy(ring.alias("ring")).agg(F.count("*").alias("n"), rounded(F.avg("p_retailprice"), 4).alias("error"))


@query("dimensionless_groups", "SELECT p_partkey AS id, round(p_size * 0.01 / p_retailprice, 9) + 0.0 AS nf, CASE WHEN p_size % 5 > 0 THEN round(log10((p_size % 5) * 1.0 / p_retailprice), 6) + 0.0 END AS log_rate FROM part")
def dimensionless_groups(spark, d):
    """Ratios without a unit; the logarithm of a zero rate is null."""
    r = F.col("p_size") % 5
    return read(spark, d, "part").select(F.col("p_partkey").alias("id"), rounded(F.col("p_size") * F.lit(0.01) / F.col("p_retailprice"), 9).alias("nf"), F.when(r > 0, rounded(F.log10(r * F.lit(1.0) / F.col("p_retailprice")))).alias("log_rate"))
