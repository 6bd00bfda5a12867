"""Wider forms of some queries: workloads of all kinds, variable diffusivity, controls, packed bits, rules, rollouts."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.scalar import rounded
from ..operators import points, stencils
from ..sources.tables import ESTIMATE_SQL, LATTICE_SQL, MEASUREMENTS_SQL, OBSERVATIONS_SQL, SIDE, estimate, lattice, measurements, observations, read
from .catalog import query
from .field_queries import GRAD, NEIGH, SLOPE, WINDOWS, WINDOWS_SQL
from .flow_queries import _RE, _RZ, _STREAMS, E as FLOW_E, _paths, _streams
from .measure_queries import LEARNED_SQL, PAIRS, _pairs

L, E, M = f"WITH {LATTICE_SQL}", f"WITH {LATTICE_SQL}, {ESTIMATE_SQL}", f"WITH {MEASUREMENTS_SQL}"


@query(
    "page_workloads",
    f"""WITH {WINDOWS_SQL}, K AS (SELECT 'random' AS kind, o_orderkey % 64 AS r, o_custkey % 64 AS c FROM orders UNION ALL SELECT 'clustered', 20 + o_orderkey % 9, 30 + o_custkey % 9 FROM orders
    UNION ALL SELECT 'windows', r, c FROM W, range(0, 64) p(r), range(0, 64) q(c) WHERE r BETWEEN r0 AND r1 AND c BETWEEN c0 AND c1 UNION ALL SELECT 'full', r, c FROM range(0, 64) p(r), range(0, 64) q(c))
    SELECT DISTINCT kind, CAST(least(r // 8, 7) * 8 AS INTEGER) AS y, CAST(least(c // 8, 7) * 8 AS INTEGER) AS x FROM K""",
)
def page_workloads(spark, d):
    """Pages that points, clusters of points, windows and a whole field touch, by their first node."""
    o = read(spark, d, "orders")
    nodes = spark.sql("SELECT a.id AS r, b.id AS c FROM range(64) a CROSS JOIN range(64) b")
    boxes = spark.sql(f"SELECT * FROM VALUES {', '.join(map(str, WINDOWS))} AS t(id, r0, r1, c0, c1)")
    inside = boxes.select(F.explode(F.sequence("r0", "r1")).alias("r"), "c0", "c1").select("r", F.explode(F.sequence("c0", "c1")).alias("c"))
    kinds = {
        "random": o.select((F.col("o_orderkey") % 64).alias("r"), (F.col("o_custkey") % 64).alias("c")),
        "clustered": o.select((20 + F.col("o_orderkey") % 9).alias("r"), (30 + F.col("o_custkey") % 9).alias("c")), "windows": inside, "full": nodes,
    }
    at = lambda c: (F.least(F.floor(F.col(c) / 8), F.lit(7)) * 8).cast("int")
    parts = [df.select(F.lit(kind).alias("kind"), at("r").alias("y"), at("c").alias("x")).distinct() for kind, df in kinds.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


_FACE = "2 * (1 + abs(z)) * (1 + abs({o})) / (2 + abs(z) + abs({o})) * ({g}) / (1 - least(abs({g}) / 1.2::DOUBLE, 0.99::DOUBLE) ** 2)"


@query("variable_flux", f"{L}, {NEIGH} SELECT region, row, col, round(coalesce({_FACE.format(o='e', g='(e - z)')}, 0) - coalesce({_FACE.format(o='w', g='(z - w)')}, 0) + coalesce({_FACE.format(o='s', g='(s - z)')}, 0) - coalesce({_FACE.format(o='n', g='(z - n)')}, 0), 8) + 0.0 AS div FROM N")
def variable_flux(spark, d):
    """Nonlinear diffusion whose diffusivity differs from node to node: a face has the harmonic mean of its two."""
    return stencils.variable_flux(lattice(spark, d).withColumn("d", 1 + F.abs("z")), 1.2).select("region", "row", "col", rounded("div", 8).alias("div"))


@query("paired_ratio_spread", f"{M}, {PAIRS} SELECT bound, count(*) AS n, round(median(a / b), 6) + 0.0 AS mid, round(quantile_cont(a / b, 0.75) - quantile_cont(a / b, 0.25), 6) + 0.0 AS iqr, CASE WHEN count(*) >= 3 AND stddev_pop(a) > 0 AND stddev_pop(b) > 0 THEN round(corr(a, b), 6) + 0.0 END AS r FROM PR GROUP BY bound")
def paired_ratio_spread(spark, d):
    """Median and quartile range of paired ratios; a correlation only of three pairs or more that vary."""
    ratio = F.col("a") / F.col("b")
    enough = (F.count("*") >= 3) & (F.stddev_pop("a") > 0) & (F.stddev_pop("b") > 0)
    q = lambda p: F.percentile(ratio, F.lit(p))
    return _pairs(spark, d).groupBy("bound").agg(F.count("*").alias("n"), rounded(q(0.5)).alias("mid"), rounded(q(0.75) - q(0.25)).alias("iqr"), F.when(enough, rounded(F.corr("a", "b"))).alias("r"))


@query("merge_seed_suffixes", f"{M}, R AS (SELECT region, coder || '-seed' || seed || CASE WHEN bound % 2 = 0 THEN '+bp' ELSE '' END AS name, avg(bytes) AS v FROM M GROUP BY ALL) SELECT region, regexp_extract(name, '^(.+)-seed[0-9]+([+]bp)?$', 1) || regexp_extract(name, '^(.+)-seed[0-9]+([+]bp)?$', 2) AS method, round(avg(v), 4) + 0.0 AS mean, round(stddev_pop(v), 4) + 0.0 AS std, count(*) AS seeds FROM R GROUP BY ALL")
def merge_seed_suffixes(spark, d):
    """Names that end in a seed, with or without back-projection: what is left of the name is the method."""
    name = F.concat("coder", F.lit("-seed"), "seed", F.when(F.col("bound") % 2 == 0, "+bp").otherwise(""))
    runs = measurements(spark, d).groupBy("region", name.alias("name")).agg(F.avg("bytes").alias("v"))
    method = F.regexp_replace("name", r"-seed[0-9]+(\+bp)?$", "$1").alias("method")
    return runs.groupBy("region", method).agg(rounded(F.avg("v"), 4).alias("mean"), rounded(F.stddev_pop("v"), 4).alias("std"), F.count("*").alias("seeds"))


@query("mask_bits", f"{L} SELECT region, row, string_agg(CASE WHEN z > 0 THEN '1' ELSE '0' END, '' ORDER BY col) AS bits, CAST(count(*) FILTER (z > 0) AS INTEGER) AS ones FROM L GROUP BY ALL")
def mask_bits(spark, d):
    """A mask's rows as packed bits: one number a row, shown in binary; counted from the number itself."""
    bit = F.expr("CASE WHEN z > 0 THEN shiftleft(1L, 63 - col) ELSE 0L END")
    packed = lattice(spark, d).groupBy("region", "row").agg(F.bit_or(bit).alias("word"))
    return packed.select("region", "row", F.lpad(F.bin("word"), 64, "0").alias("bits"), F.bit_count("word").alias("ones"))


@query("palette_codes", f"{L}, K AS (SELECT region, floor(abs(z) * 10) AS label FROM L) SELECT region, CAST(label AS BIGINT) AS label, CAST(dense_rank() OVER (PARTITION BY region ORDER BY label) - 1 AS INTEGER) AS code, n FROM (SELECT region, label, count(*) AS n FROM K GROUP BY ALL)")
def palette_codes(spark, d):
    """Each field's own palette: the classes that it has, in order, with their counts."""
    n = lattice(spark, d).groupBy("region", F.floor(F.abs("z") * 10).alias("label")).agg(F.count("*").alias("n"))
    return n.select("region", "label", (F.dense_rank().over(Window.partitionBy("region").orderBy("label")) - 1).alias("code"), "n")


@query("weight_quantise_bits", f"{L}, B AS (SELECT unnest([4, 6, 8]) AS bits), S AS (SELECT region, max(abs(z)) AS top FROM L GROUP BY region), Q AS (SELECT region, bits, z, top / (2 ** (bits - 1) - 1) AS s FROM L JOIN S USING (region), B) SELECT region, CAST(bits AS INTEGER) AS bits, round(max(abs(z - round_even(z / s, 0) * s)), 9) + 0.0 AS worst, count(DISTINCT round_even(z / s, 0)) AS levels FROM Q GROUP BY ALL")
def weight_quantise_bits(spark, d):
    """What four, six and eight bits with a scale for each group lose."""
    cells = lattice(spark, d)
    top = cells.groupBy("region").agg(F.max(F.abs("z")).alias("top"))
    many = cells.join(top, "region").withColumn("bits", F.explode(F.array(*map(F.lit, (4, 6, 8)))))
    many = many.withColumn("s", F.col("top") / (F.pow(F.lit(2.0), F.col("bits") - 1) - 1)).withColumn("q", F.rint(F.col("z") / F.col("s")))
    return many.groupBy("region", "bits").agg(rounded(F.max(F.abs(F.col("z") - F.col("q") * F.col("s"))), 9).alias("worst"), F.countDistinct("q").alias("levels"))


@query(
    "profile_pair",
    f"""{E}, I AS (SELECT k, region, 5 + k * 0.5::DOUBLE AS r, 3 + k * 0.7::DOUBLE AS c FROM (SELECT DISTINCT region FROM L), range(0, 81) AS t(k) WHERE 3 + k * 0.7::DOUBLE <= 63),
    N AS (SELECT k, region, CAST(least(floor(r), 62) + dr AS INTEGER) AS row, CAST(least(floor(c), 62) + dc AS INTEGER) AS col, (CASE WHEN dr = 1 THEN r - least(floor(r), 62) ELSE 1 - (r - least(floor(r), 62)) END) * (CASE WHEN dc = 1 THEN c - least(floor(c), 62) ELSE 1 - (c - least(floor(c), 62)) END) AS w FROM I, (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) AS o(dr, dc))
    SELECT k AS id, N.region, round(sum(w * z), 8) + 0.0 AS z, round(sum(w * e), 8) + 0.0 AS e FROM N JOIN E USING (region, row, col) GROUP BY ALL""",
)
def profile_pair(spark, d):
    """Two fields at the same steps along a segment."""
    cells = estimate(lattice(spark, d))
    at = cells.select("region").distinct().withColumn("id", F.explode(F.transform(F.sequence(F.lit(0), F.lit(80)), lambda k: k.cast("bigint"))))
    at = at.select("id", "region", (5 + F.col("id") * 0.5).alias("r"), (3 + F.col("id") * 0.7).alias("c")).where("c <= 63")
    met = points.corners(at, SIDE).join(cells, ["region", "row", "col"])
    return met.groupBy("id", "region").agg(*(rounded(F.sum(F.col("w") * F.col(v)), 8).alias(v) for v in ("z", "e")))


@query("aggregate_in_sql", f"{M}, {PAIRS} SELECT bound, round(exp(avg(r)), 6) + 0.0 AS ratio FROM PR GROUP BY bound")
def aggregate_in_sql(spark, d):
    """An aggregate of one's own, called from SQL on a row a region."""

    @F.pandas_udf("double")
    def geometric_mean(x: pd.Series) -> float:
        return float(np.exp(np.log(x).mean()))

    spark.udf.register("geometric_mean", geometric_mean)
    out = spark.sql("SELECT bound, round(geometric_mean(a / b), 6) + 0D AS ratio FROM {pairs} GROUP BY bound", pairs=_pairs(spark, d))
    spark.sql("DROP TEMPORARY FUNCTION geometric_mean")
    return out


@query("samples_in_reach", f"WITH {OBSERVATIONS_SQL}, T0 AS (SELECT CAST(a AS INTEGER) AS tx, CAST(b AS INTEGER) AS ty FROM range(0, 2) p(a), range(0, 2) q(b)), D AS (SELECT tx, ty, id, greatest(0, tx * 32 - e, e - (tx * 32 + 31)) AS dx, greatest(0, ty * 32 - n, n - (ty * 32 + 31)) AS dy FROM T0, P) SELECT tx, ty, id FROM D WHERE sqrt(dx * dx + dy * dy) <= 8 QUALIFY row_number() OVER (PARTITION BY tx, ty ORDER BY dx * dx + dy * dy, id) <= 300")
def samples_in_reach(spark, d):
    """At most three hundred samples within reach of a tile of 32 cells, the nearest first. A sample meets the tiles whose square of reach it lies in."""
    p = observations(spark, d).select("id", "e", "n")
    tiles = lambda c: F.explode(F.sequence(F.greatest(F.floor((F.col(c) - 39) / 32), F.lit(0)), F.least(F.floor((F.col(c) + 8) / 32), F.lit(1))))
    near = p.where("e BETWEEN -8 AND 71 AND n BETWEEN -8 AND 71").withColumn("tx", tiles("e")).withColumn("ty", tiles("n"))
    gap = lambda c, t: F.greatest(F.lit(0.0), F.col(t) * 32 - F.col(c), F.col(c) - (F.col(t) * 32 + 31))
    far = near.withColumn("d2", gap("e", "tx") * gap("e", "tx") + gap("n", "ty") * gap("n", "ty")).where(F.sqrt("d2") <= 8)
    place = F.row_number().over(Window.partitionBy("tx", "ty").orderBy("d2", "id"))
    return far.withColumn("k", place).where("k <= 300").select(F.col("tx").cast("int").alias("tx"), F.col("ty").cast("int").alias("ty"), "id")


@query("rescaled_groups", "SELECT p_partkey AS id, round(p_size * 0.01 / p_retailprice, 9) + 0.0 AS nf, round(p_size * 0.01 / p_retailprice * (2 * p_retailprice) / 0.01, 6) + 0.0 AS doubled FROM part")
def rescaled_groups(spark, d):
    """Groups without a unit, and what the same group means at twice the scale."""
    nf = F.col("p_size") * F.lit(0.01) / F.col("p_retailprice")
    return read(spark, d, "part").select(F.col("p_partkey").alias("id"), rounded(nf, 9).alias("nf"), rounded(nf * (2 * F.col("p_retailprice")) / F.lit(0.01)).alias("doubled"))


@query(
    "stream_states",
    f"""{FLOW_E}, {_RZ}, {_paths('RZ', 'PZ')}, {_RE}, {_paths('RE', 'PE')}, {_STREAMS}, K AS (SELECT region, cell, max(a) AS a, max(b) AS b FROM (SELECT region, cell, 1 AS a, 0 AS b FROM SZ UNION ALL SELECT region, cell, 0, 1 FROM SE) GROUP BY ALL)
    SELECT region, count(*) FILTER (a = 1 AND b = 1) AS kept, count(*) FILTER (a = 1 AND b = 0) AS lost, count(*) FILTER (a = 0 AND b = 1) AS spurious FROM K GROUP BY region""",
)
def stream_states(spark, d):
    """Stream cells that both surfaces have, that the estimate lost, and that it made up."""
    a, b = F.col("a"), F.col("b")
    return _streams(spark, d).groupBy("region").agg(F.count_if(a & b).alias("kept"), F.count_if(a & ~b).alias("lost"), F.count_if(~a & b).alias("spurious"))


@query("slope_rule", f"{L}, {NEIGH}, {GRAD}, {SLOPE} SELECT region, CAST(floor(49 * least(1, greatest(0.25, slope / 0.3::DOUBLE))) AS INTEGER) AS half, count(*) AS nodes FROM S GROUP BY ALL")
def slope_rule(spark, d):
    """Half widths that a rule by slope allots: gentle ground has the tighter bound."""
    half = F.floor(49 * F.least(F.lit(1.0), F.greatest(F.lit(0.25), F.sqrt(F.col("gx") * F.col("gx") + F.col("gy") * F.col("gy")) / 0.3))).cast("int")
    return stencils.gradient(lattice(spark, d)).groupBy("region", half.alias("half")).agg(F.count("*").alias("nodes"))


@query(
    "arm_controls",
    f"""{M}, C AS (SELECT coder, region, seed, avg(bytes) AS b FROM M WHERE {LEARNED_SQL} GROUP BY ALL), R AS (SELECT c.coder, c.seed, avg(ln(c.b / o.b)) AS r FROM C c JOIN C o ON o.coder = 'Brand#11' AND o.region = c.region AND o.seed = c.seed GROUP BY ALL)
    SELECT coder AS arm, round(exp(avg(r)), 6) + 0.0 AS ratio, round(coalesce(stddev_samp(r), 0), 6) + 0.0 AS spread, avg(r) <= least(ln(0.99), -coalesce(stddev_samp(r), 0)) AS better FROM R GROUP BY coder""",
)
def arm_controls(spark, d):
    """Arms against the one without context: the ratio, its spread over seeds, and whether it is beyond both a hundredth and the spread."""
    c = measurements(spark, d).where(F.col("coder").startswith("Brand#1")).groupBy("coder", "region", "seed").agg(F.avg("bytes").alias("b"))
    base = c.where("coder = 'Brand#11'").select("region", "seed", F.col("b").alias("o"))
    r = c.join(base, ["region", "seed"]).groupBy("coder", "seed").agg(F.avg(F.log(F.col("b") / F.col("o"))).alias("r"))
    spread = F.coalesce(F.stddev_samp("r"), F.lit(0.0))
    return r.groupBy(F.col("coder").alias("arm")).agg(rounded(F.exp(F.avg("r"))).alias("ratio"), rounded(spread).alias("spread"), (F.avg("r") <= F.least(F.log(F.lit(0.99)), -spread)).alias("better"))


@query("sensitivity_table", f"{M}, K AS (SELECT CASE WHEN region < 'J' THEN 'development' ELSE 'confirmation' END AS cohort, seed AS policy, length(coder) + bound % 4 AS area, bound, loss FROM M) SELECT cohort, policy, area, bound, round(max(loss), 6) + 0.0 AS worst, round(avg(loss), 6) + 0.0 AS gap, avg(loss) <= 0.05 AS pass, count(*) AS n FROM K GROUP BY CUBE (cohort, policy, area, bound)")
def sensitivity_table(spark, d):
    """Worst and mean gap by cohort, policy, area and bound, and over all of any of them."""
    k = measurements(spark, d).select(F.when(F.col("region") < "J", "development").otherwise("confirmation").alias("cohort"), F.col("seed").alias("policy"), (F.length("coder") + F.col("bound") % 4).alias("area"), "bound", "loss")
    return k.cube("cohort", "policy", "area", "bound").agg(rounded(F.max("loss")).alias("worst"), rounded(F.avg("loss")).alias("gap"), (F.avg("loss") <= 0.05).alias("pass"), F.count("*").alias("n"))


@query("confirmation_flags", f"{M}, S AS (SELECT coder, seed, avg(bytes) AS bytes, avg(loss) * 100000 AS loss FROM M GROUP BY ALL), U AS (SELECT coder, 'bytes' AS metric, bytes AS v FROM S UNION ALL SELECT coder, 'loss', loss FROM S) SELECT coder, metric, round(median(v), 4) + 0.0 AS mid, round(max(v) - min(v), 4) + 0.0 AS spread, min(v) > 0 AS trained, max(v) <= 1.05 * median(v) AS extrapolates FROM U GROUP BY ALL")
def confirmation_flags(spark, d):
    """Median and spread over seeds for each metric, and what they allow to say."""
    s = measurements(spark, d).groupBy("coder", "seed").agg(F.avg("bytes").alias("bytes"), (F.avg("loss") * 100000).alias("loss"))
    u = s.unpivot(["coder"], ["bytes", "loss"], "metric", "v")
    return u.groupBy("coder", "metric").agg(rounded(F.median("v"), 4).alias("mid"), rounded(F.max("v") - F.min("v"), 4).alias("spread"), (F.min("v") > 0).alias("trained"), (F.max("v") <= 1.05 * F.median("v")).alias("extrapolates"))


_RATES = (("unique nodes", 4096), ("nodes of the lattice", 4225), ("nodes of all pages", 64 * 81), ("nodes of all levels", 4225 + 33 * 33 + 17 * 17 + 81))


@query("rate_denominators", f"{M}, B AS (SELECT bound, avg(bytes) * 8 AS bits FROM M GROUP BY bound) SELECT bound, rate, round(bits / nodes, 6) + 0.0 AS bits_per_node FROM B, (VALUES {', '.join(map(str, _RATES))}) AS r(rate, nodes)")
def rate_denominators(spark, d):
    """Bits by each of the numbers of nodes that a rate may be taken by."""
    bits = measurements(spark, d).groupBy("bound").agg((F.avg("bytes") * 8).alias("bits"))
    rates = F.explode(F.array(*(F.struct(F.lit(name).alias("rate"), F.lit(n).alias("nodes")) for name, n in _RATES)))
    return bits.withColumn("r", rates).select("bound", "r.rate", rounded(F.col("bits") / F.col("r.nodes")).alias("bits_per_node"))


@query(
    "rollout_gates",
    f"""{L}, U AS (SELECT region, avg(z) AS m FROM L GROUP BY region), J AS (SELECT CAST(n AS INTEGER) AS steps, CASE WHEN a.row BETWEEN 8 AND 55 AND a.col BETWEEN 8 AND 55 THEN 'interior' ELSE 'edge' END AS ring, a.z AS z0, b.z AS z1, ub.m - ua.m AS rise FROM range(1, 4) t(n), L a JOIN L b ON b.row = a.row AND b.col = a.col JOIN U ua ON ua.region = a.region JOIN U ub ON ub.region = b.region WHERE b.region = a.region + n)
    SELECT steps, ring, round(avg(abs(z1 - z0)), 6) + 0.0 AS persistence, round(avg(abs(z1 - z0 - rise)), 6) + 0.0 AS uplift, round(quantile_cont(abs(z1 - z0), 0.9), 6) + 0.0 AS p90, avg(abs(z1 - z0 - rise)) < avg(abs(z1 - z0)) AS better FROM J GROUP BY ALL""",
)
def rollout_gates(spark, d):
    """Errors by length of a rollout and ring, of standing still and of rising as a whole. Fields that follow one another stand for its steps."""
    cells = lattice(spark, d)
    mean = cells.groupBy("region").agg(F.avg("z").alias("m"))
    own = cells.join(mean, "region")
    later = own.withColumn("steps", F.explode(F.array(*map(F.lit, (1, 2, 3)))))
    later = later.select((F.col("region") - F.col("steps")).alias("region"), "steps", "row", "col", F.col("z").alias("z1"), F.col("m").alias("m1"))
    ring = F.when(F.col("row").between(8, 55) & F.col("col").between(8, 55), "interior").otherwise("edge")
    still, rising = F.abs(F.col("z1") - F.col("z")), F.abs(F.col("z1") - F.col("z") - (F.col("m1") - F.col("m")))
    return own.join(later, ["region", "row", "col"]).groupBy("steps", ring.alias("ring")).agg(rounded(F.avg(still)).alias("persistence"), rounded(F.avg(rising)).alias("uplift"), rounded(F.percentile(still, F.lit(0.9))).alias("p90"), (F.avg(rising) < F.avg(still)).alias("better"))
