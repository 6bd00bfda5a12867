"""Queries on flow: receivers, basins, accumulation, streams and their agreement."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalar import rounded
from ..operators import flow, metrics
from ..sources.tables import ESTIMATE_SQL, LATTICE_SQL, SIDE, estimate, lattice
from .catalog import query

E = f"WITH RECURSIVE {LATTICE_SQL}, {ESTIMATE_SQL}"
#: Fields are small here, so that streams begin at a few cells.
STREAM = 8


def _joined(value: str, name: str) -> str:
    return f"""{name}N AS (SELECT region, row * 64 + col AS cell, {value} AS v, k, CAST(row + dr AS INTEGER) AS nrow, CAST(col + dc AS INTEGER) AS ncol, sqrt(CAST(dr * dr + dc * dc AS DOUBLE)) AS far
 FROM E, (VALUES (0, -1, -1), (1, -1, 0), (2, -1, 1), (3, 0, -1), (4, 0, 1), (5, 1, -1), (6, 1, 0), (7, 1, 1)) AS o(k, dr, dc)),
 {name}0 AS (SELECT n.region, n.cell, k, E.row * 64 + E.col AS nb, (n.v - E.{value}) / far AS fall FROM {name}N n JOIN E ON E.region = n.region AND E.row = n.nrow AND E.col = n.ncol WHERE n.v > E.{value}),
 {name}1 AS (SELECT region, cell, arg_min(nb, (-fall, k)) AS receiver FROM {name}0 GROUP BY ALL),
 {name} AS (SELECT E.region, E.row * 64 + E.col AS cell, coalesce(receiver, -1) AS receiver FROM E LEFT JOIN {name}1 ON E.region = {name}1.region AND E.row * 64 + E.col = {name}1.cell)"""


_RZ, _RE = _joined("z", "RZ"), _joined("e", "RE")


def _paths(edges: str, name: str) -> str:
    return f"""{name}(region, start, cur) AS (SELECT region, cell, cell FROM {edges} UNION ALL SELECT p.region, p.start, r.receiver FROM {name} p JOIN {edges} r ON r.region = p.region AND r.cell = p.cur WHERE r.receiver >= 0)"""


def _ends(edges: str, paths: str, name: str) -> str:
    return f"{name} AS (SELECT p.region, p.start AS cell, p.cur AS outlet FROM {paths} p JOIN {edges} r ON r.region = p.region AND r.cell = p.cur WHERE r.receiver < 0)"


@query("d8_receivers", f"{E}, {_RZ} SELECT region, CAST(cell AS INTEGER) AS cell, CAST(receiver AS INTEGER) AS receiver FROM RZ")
def d8_receivers(spark, d):
    return flow.receivers(lattice(spark, d), SIDE).select("region", "cell", "receiver")


@query("receiver_agreement", f"{E}, {_RZ}, {_RE} SELECT RZ.region, round(avg(CASE WHEN RZ.receiver = RE.receiver THEN 1 ELSE 0 END), 6) + 0.0 AS share FROM RZ JOIN RE USING (region, cell) WHERE cell // 64 BETWEEN 1 AND 62 AND cell % 64 BETWEEN 1 AND 62 GROUP BY RZ.region")
def receiver_agreement(spark, d):
    """The share of interior cells that keep their receiver."""
    both = flow.receivers(flow.receivers(estimate(lattice(spark, d)).withColumnRenamed("e", "q"), SIDE).withColumnRenamed("receiver", "a"), SIDE, value="q")
    inside = both.where("row BETWEEN 1 AND 62 AND col BETWEEN 1 AND 62")
    return inside.groupBy("region").agg(rounded(F.avg((F.col("a") == F.col("receiver")).cast("int"))).alias("share"))


@query("basins", f"{E}, {_RZ}, {_paths('RZ', 'PZ')}, {_ends('RZ', 'PZ', 'OZ')} SELECT region, CAST(cell AS INTEGER) AS cell, CAST(outlet AS INTEGER) AS outlet FROM OZ")
def basins(spark, d):
    return flow.traced(lattice(spark, d), SIDE).select("region", "cell", F.col("z_outlet").alias("outlet"))


@query("basin_agreement", f"{E}, {_RZ}, {_paths('RZ', 'PZ')}, {_ends('RZ', 'PZ', 'OZ')}, {_RE}, {_paths('RE', 'PE')}, {_ends('RE', 'PE', 'OE')} SELECT OZ.region, count(DISTINCT OZ.outlet) AS reference, count(DISTINCT OE.outlet) AS estimate, round(avg(CASE WHEN OZ.outlet = OE.outlet THEN 1 ELSE 0 END), 6) + 0.0 AS same FROM OZ JOIN OE USING (region, cell) GROUP BY OZ.region")
def basin_agreement(spark, d):
    both = flow.traced(_surfaces(spark, d), SIDE, ("z", "q"))
    same = rounded(F.avg((F.col("z_outlet") == F.col("q_outlet")).cast("int"))).alias("same")
    return both.groupBy("region").agg(F.countDistinct("z_outlet").alias("reference"), F.countDistinct("q_outlet").alias("estimate"), same)


@query("flow_accumulation", f"{E}, {_RZ}, {_paths('RZ', 'PZ')} SELECT region, CAST(cur AS INTEGER) AS cell, count(*) AS upstream FROM PZ GROUP BY ALL")
def flow_accumulation(spark, d):
    return flow.traced(lattice(spark, d), SIDE).select("region", "cell", F.col("z_upstream").alias("upstream"))


@query("flow_on_edges", f"{E}, {_RZ}, {_paths('RZ', 'PZ')}, {_ends('RZ', 'PZ', 'OZ')}, U AS (SELECT region, cur AS cell, count(*) AS upstream FROM PZ GROUP BY ALL) SELECT RZ.region, CAST(RZ.cell AS INTEGER) AS cell, CAST(receiver AS INTEGER) AS receiver, CAST(outlet AS INTEGER) AS outlet, upstream FROM RZ JOIN OZ USING (region, cell) JOIN U USING (region, cell)")
def flow_on_edges(spark, d):
    """Receivers, outlets and accumulation as fields go that no task can hold."""
    out = flow.traced(lattice(spark, d), SIDE, most=0)
    return out.select("region", F.col("cell").cast("int").alias("cell"), F.col("z_receiver").alias("receiver"), F.col("z_outlet").alias("outlet"), F.col("z_upstream").alias("upstream"))


_STREAMS = f"SZ AS (SELECT region, cur AS cell FROM PZ GROUP BY ALL HAVING count(*) >= {STREAM}), SE AS (SELECT region, cur AS cell FROM PE GROUP BY ALL HAVING count(*) >= {STREAM})"


def _surfaces(spark, d):
    """The fields and what a uniform quantiser makes of them."""
    return estimate(lattice(spark, d)).withColumnRenamed("e", "q")


def _streams(spark, d):
    """(region, row, col, a, b): the cells that are streams on either surface."""
    both = flow.traced(_surfaces(spark, d), SIDE, ("z", "q"))
    return both.select("region", "row", "col", (F.col("z_upstream") >= STREAM).alias("a"), (F.col("q_upstream") >= STREAM).alias("b")).where("a OR b")


@query(
    "stream_overlap",
    f"""{E}, {_RZ}, {_paths('RZ', 'PZ')}, {_RE}, {_paths('RE', 'PE')}, {_STREAMS},
    K AS (SELECT region, cell, max(a) AS a, max(b) AS b FROM (SELECT region, cell, 1 AS a, 0 AS b FROM SZ UNION ALL SELECT region, cell, 0, 1 FROM SE) GROUP BY ALL)
    SELECT region, round(sum(a * b) / sum(greatest(a, b)), 6) + 0.0 AS jaccard, CASE WHEN sum(a) > 0 THEN round(sum(a * b) / sum(a), 6) + 0.0 END AS recall, CASE WHEN sum(b) > 0 THEN round(sum(a * b) / sum(b), 6) + 0.0 END AS precision FROM K GROUP BY region""",
)
def stream_overlap(spark, d):
    return metrics.overlap(_streams(spark, d), ["region"])


@query(
    "tolerant_streams",
    f"""{E}, {_RZ}, {_paths('RZ', 'PZ')}, {_RE}, {_paths('RE', 'PE')}, {_STREAMS},
    A AS (SELECT region, avg(CASE WHEN EXISTS (SELECT 1 FROM SE b WHERE b.region = a.region AND abs(b.cell // 64 - a.cell // 64) <= 1 AND abs(b.cell % 64 - a.cell % 64) <= 1) THEN 1.0 ELSE 0.0 END) AS r FROM SZ a GROUP BY region),
    B AS (SELECT region, avg(CASE WHEN EXISTS (SELECT 1 FROM SZ b WHERE b.region = a.region AND abs(b.cell // 64 - a.cell // 64) <= 1 AND abs(b.cell % 64 - a.cell % 64) <= 1) THEN 1.0 ELSE 0.0 END) AS p FROM SE a GROUP BY region)
    SELECT region, round(r, 6) + 0.0 AS recall, round(p, 6) + 0.0 AS precision, round(2 * r * p / (r + p), 6) + 0.0 AS f1 FROM A JOIN B USING (region)""",
)
def tolerant_streams(spark, d):
    both = _streams(spark, d)
    s = flow.tolerant_scores(both.where("a"), both.where("b"), SIDE)
    return s.select("region", *(rounded(c).alias(c) for c in ("recall", "precision", "f1")))


@query("downstream_fall", f"{E}, {_RZ}, {_paths('RZ', 'PZ')} SELECT p.region, CAST(p.start AS INTEGER) AS cell, round(sum(CASE WHEN r.receiver >= 0 THEN a.z - b.z ELSE 0 END), 7) + 0.0 AS fall FROM PZ p JOIN RZ r ON r.region = p.region AND r.cell = p.cur JOIN L a ON a.region = p.region AND a.row = p.cur // 64 AND a.col = p.cur % 64 LEFT JOIN L b ON b.region = p.region AND b.row = r.receiver // 64 AND b.col = r.receiver % 64 GROUP BY ALL")
def downstream_fall(spark, d):
    """The height lost on the way to the outlet, summed along receivers."""
    edges = flow.receivers(lattice(spark, d), SIDE).select("region", "cell", "receiver", "z")
    low = edges.select("region", F.col("cell").alias("receiver"), F.col("z").alias("zr"))
    falls = edges.join(low, ["region", "receiver"], "left").withColumn("w", F.coalesce(F.col("z") - F.col("zr"), F.lit(0.0)))
    return flow.downstream(falls, "w").select("region", "cell", rounded("total", 7).alias("fall"))
