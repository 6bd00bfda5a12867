"""Queries on choices across regions, classes, page indexes, products, kriging, noise and hidden detail."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import codecs, container, entropy, index, physics, recon
from ..functions.dense import per_field
from ..functions.scalar import rounded
from ..operators import flow, masks, resample, stencils, verdicts
from ..sources.tables import LATTICE_SQL, MEASUREMENTS_SQL, NODES_SQL, SIDE, epochs, lattice, measurements, nodes, read
from .catalog import query
from .measure_queries import BEST, LEARNED_SQL
from .pages import paged

L, M = f"WITH {LATTICE_SQL}", f"WITH {MEASUREMENTS_SQL}"


def _learned():
    return F.col("coder").startswith("Brand#1")


#: Bytes of an arm are those of its smallest product here, so that some arms come near the conventional ones.
ARMS = f"""{BEST}, AR AS (SELECT M.region, M.bound, M.coder AS arm, min(M.bytes) AS bytes, avg(1 - loss) AS f1 FROM M WHERE {LEARNED_SQL} GROUP BY ALL),
 CE AS (SELECT AR.*, ln(AR.bytes / CAST(B.bytes AS DOUBLE)) AS r, AR.f1 - (1 - B.loss) AS gap, B.bytes AS conv FROM AR JOIN B USING (region, bound)),
 WH AS (SELECT * FROM CE QUALIFY count(*) OVER (PARTITION BY bound, region) = (SELECT count(DISTINCT arm) FROM CE))"""


def _arms(spark, d):
    """(region, bound, arm, bytes, f1, r, gap, conv): regions that all arms have, against the best conventional product."""
    m = measurements(spark, d)
    arms = m.where(_learned()).groupBy("region", "bound", F.col("coder").alias("arm")).agg(F.min("bytes").alias("bytes"), F.avg(1 - F.col("loss")).alias("f1"))
    best = verdicts.best_conventional(m, _learned()).select("region", "bound", F.col("bytes").alias("conv"), F.col("loss").alias("closs"))
    cells = arms.join(best, ["region", "bound"]).withColumns({"r": F.log(F.col("bytes") / F.col("conv")), "gap": F.col("f1") - (1 - F.col("closs"))})
    return verdicts.whole_regions(cells, "arm", ["bound", "region"])


@query(
    "choice_on_other_regions",
    f"""{M}, {ARMS}, O AS (SELECT g.bound, g.region, g.arm, exp(avg(h.r)) AS ratio, min(h.gap) AS gap FROM WH g JOIN WH h ON h.bound = g.bound AND h.arm = g.arm AND h.region <> g.region GROUP BY ALL),
    P AS (SELECT bound, region, arg_max(arm, (gap, arm)) AS arm FROM O WHERE ratio <= 3 GROUP BY ALL)
    SELECT DISTINCT WH.bound, WH.region, coalesce(P.arm, 'Brand#11') AS arm, round(exp(min(WH.r) FILTER (WH.arm = coalesce(P.arm, 'Brand#11')) OVER (PARTITION BY WH.bound, WH.region)), 6) + 0.0 AS ratio FROM WH LEFT JOIN P USING (bound, region)""",
)
def choice_on_other_regions(spark, d):
    """For each region the arm that loses least of the streams where it is worst among the other regions,
    of those that are small enough there; the first arm if none is. Each is scored on its own region."""
    return verdicts.chosen_elsewhere(_arms(spark, d), most=3.0, fallback="Brand#11").select("bound", "region", "arm", rounded(F.exp("r")).alias("ratio"))


@query(
    "frontier_choice",
    f"""{M}, {ARMS}, O AS (SELECT g.bound, g.region, g.arm, avg(h.r) AS r FROM WH g JOIN WH h ON h.bound = g.bound AND h.arm = g.arm AND h.region <> g.region GROUP BY ALL),
    P AS (SELECT bound, region, arg_min(arm, (round(r, 9), arm)) AS arm FROM O GROUP BY ALL),
    X AS (SELECT bound, arg_min(arm, (round(r, 9), arm)) AS fixed, min(round(r, 9)) AS fr FROM (SELECT bound, arm, avg(r) AS r FROM WH GROUP BY ALL) GROUP BY bound)
    SELECT P.bound, count(*) AS regions, round(exp(avg(WH.r)), 6) + 0.0 AS chosen_ratio, fixed, round(exp(fr), 6) + 0.0 AS fixed_ratio FROM P JOIN WH USING (bound, region, arm) JOIN X USING (bound) GROUP BY P.bound, fixed, fr""",
)
def frontier_choice(spark, d):
    """The configuration chosen for each region on the others, and the best one that is the same for all."""
    cells = _arms(spark, d)
    chosen = verdicts.smallest_elsewhere(cells).groupBy("bound").agg(F.count("*").alias("regions"), rounded(F.exp(F.avg("r"))).alias("chosen_ratio"))
    means = cells.groupBy("bound", "arm").agg(F.round(F.avg("r"), 9).alias("r"))
    fixed = means.groupBy("bound").agg(F.min(F.struct("r", "arm")).alias("b"))
    return chosen.join(fixed, "bound").select("bound", "regions", "chosen_ratio", F.col("b.arm").alias("fixed"), rounded(F.exp("b.r")).alias("fixed_ratio"))


@query(
    "portfolio",
    f"""{M}, {BEST}, A1 AS (SELECT region, bound, avg(bytes) AS a FROM M WHERE {LEARNED_SQL} GROUP BY ALL), P AS (SELECT bound, least(a, B.bytes) + 1 AS p, a, B.bytes AS c FROM A1 JOIN B USING (region, bound))
    SELECT bound, count(*) AS regions, round(exp(avg(ln(p / c))), 6) + 0.0 AS against_best, round(exp(avg(ln(p / a))), 6) + 0.0 AS against_learned, count(*) FILTER (c < a) AS conventional FROM P GROUP BY bound""",
)
def portfolio(spark, d):
    """The smaller of the learned and the best conventional product of each tile, with a byte that says which."""
    m = measurements(spark, d)
    learned = verdicts.by_region(m.where(_learned()), ["region", "bound"], "bytes").withColumnRenamed("bytes", "a")
    both = learned.join(verdicts.best_conventional(m, _learned()).select("region", "bound", F.col("bytes").alias("c")), ["region", "bound"])
    p = F.least("a", "c") + 1
    mean = lambda other: rounded(F.exp(F.avg(F.log(p / F.col(other)))))
    return both.groupBy("bound").agg(F.count("*").alias("regions"), mean("c").alias("against_best"), mean("a").alias("against_learned"), F.count_if(F.col("c") < F.col("a")).alias("conventional"))


@query("class_validity", f"{L}, K AS (SELECT region, CAST(floor(abs(z) * 10) AS INTEGER) AS label FROM L) SELECT region, min(label) AS low, max(label) AS high, count(DISTINCT label) AS classes, min(label) >= 0 AND max(label) < 12 AS valid FROM K GROUP BY region")
def class_validity(spark, d):
    """Whether a class raster holds whole codes of the classes there are; masks.checked_classes refuses others."""
    k = lattice(spark, d).select("region", F.floor(F.abs("z") * 10).cast("int").alias("label"))
    return k.groupBy("region").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.countDistinct("label").alias("classes"), ((F.min("label") >= 0) & (F.max("label") < 12)).alias("valid"))


@query(
    "context_upsample",
    f"""{L.replace("L AS (", "L AS MATERIALIZED (", 1)}, {NODES_SQL}, C AS MATERIALIZED (SELECT region, row // 4 AS r, col // 4 AS c, CAST(floor(abs(z) * 10) AS INTEGER) AS label FROM LN WHERE row % 4 = 0 AND col % 4 = 0),
    F AS MATERIALIZED (SELECT region, row, col, least(CAST(round_even(row / 4.0, 0) AS INTEGER), 16) AS r, least(CAST(round_even(col / 4.0, 0) AS INTEGER), 16) AS c FROM LN) SELECT region, row, col, label FROM F JOIN C USING (region, r, c)""",
)
def context_upsample(spark, d):
    """The class of every node from a raster of every fourth: the nearest, halves to the even one."""
    fine = nodes(spark, d)
    coarse = fine.where("row % 4 = 0 AND col % 4 = 0").select("region", F.expr("row div 4").cast("int").alias("row"), F.expr("col div 4").cast("int").alias("col"), F.floor(F.abs("z") * 10).cast("int").alias("label"))
    return masks.nearest_class(fine.select("region", "row", "col"), coarse, SIDE + 1, SIDE // 4 + 1)


@query(
    "autocovariance",
    f"""{L}, D AS (SELECT region, row, col, z - avg(z) OVER (PARTITION BY region) AS z FROM L),
    O AS (SELECT CAST(a AS INTEGER) AS a, CAST(b AS INTEGER) AS b, CAST(round_even(sqrt(a * a + b * b), 0) AS INTEGER) AS h FROM range(0, 4) p(a), range(-3, 4) q(b) WHERE (a > 0 OR b >= 0) AND round_even(sqrt(a * a + b * b), 0) <= 3),
    N AS (SELECT region, a, b, h, row + a AS row, col + b AS col, z FROM D, O), P AS (SELECT N.region, N.a, N.b, N.h, avg(N.z * D.z) AS v FROM N JOIN D USING (region, row, col) GROUP BY ALL)
    SELECT region, h, round(avg(v), 7) + 0.0 AS covariance FROM P GROUP BY ALL""",
)
def autocovariance(spark, d):
    """Covariance with the field itself, shifted, averaged over the shifts of each rounded distance."""
    return stencils.autocovariance(lattice(spark, d), 3).select("region", "h", rounded("v", 7).alias("covariance"))


@query("page_index")
def page_index(spark, d):
    """The compact index of each field's pages, all of one level: its bytes, and what its bounds give up."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pages = {}
        for r in pdf.itertuples():
            blob = codecs.page_bytes(np.array(r.z).reshape(9, 9))
            pages[0, r.x, r.y] = {"sha256": hashlib.sha256(blob).hexdigest(), "packed_bytes": len(blob), "low": r.low, "high": r.high, "error": 0.005}
        scalars = {"spacing": 10.0, "quantum": 0.01, "west": 0.0, "south": 0.0, "east": 640.0, "north": 640.0, "low": float(pdf["low"].min()), "high": float(pdf["high"].max())}
        own = index.PageIndex(65, 8, 3, codecs.PAGE.struct.size + 4 * 81, scalars, dict.fromkeys(index.TEXTS, "none"), pages)
        loose = own.loosened()
        return pd.DataFrame([(int(pdf["region"].iloc[0]), len(pages), len(own.to_bytes()), loose["low"], loose["high"], loose["never_tighter"])], columns=["region", "pages", "bytes", "low", "high", "never_tighter"])

    out = paged(nodes(spark, d), 8, SIDE).groupBy("region").applyInPandas(one, "region bigint, pages int, bytes int, low double, high double, never_tighter boolean")
    return out.withColumns({"low": rounded("low", 9), "high": rounded("high", 9)})


#: Where the fields of the products lie, and the numbers of their reference systems.
_PLACE = {"west": 0.0, "north": 0.0, "spacing": 10.0, "epsg_h": 25832, "epsg_v": 7837}


@query("product_files")
def product_files(spark, d):
    """Each field as a product of the context coder, read back from its bytes: sizes by component and the largest error."""

    def one(k: int, z: np.ndarray) -> pd.DataFrame:
        made = container.Writer("cubic-ctx", rows=65, cols=65, half=49, **_PLACE)
        parts = entropy.context_encode(z, 0.05)
        for kind, data in parts.items():
            made.put(kind, data)
        blob = made.done()
        header, back = container.opened(blob)
        worst = float(np.abs(entropy.context_decode(dict(back), header["rows"], 0.05) - z).max())
        order0, tables, _ = entropy.multilevel(z, 0.05)
        return pd.DataFrame([(k, len(blob), made.taken["stream"], len(entropy.encode(order0, tables)), worst, dict(back) == parts and sum(made.taken.values()) == len(blob))], columns=["region", "bytes", "stream", "by_pass", "worst", "same"])

    out = per_field(nodes(spark, d), one, "region bigint, bytes int, stream int, by_pass int, worst double, same boolean")
    return out.withColumn("worst", rounded("worst", 7))


@query("noise_floor")
def noise_floor(spark, d):
    """Agreement of a field's drainage with that of itself under white noise, the mean over three seeds:
    the best that an estimate can expect."""
    out = flow.noise_floor(lattice(spark, d), SIDE, 0.01, (0, 1, 2), 8)
    return out.select("region", *(rounded(c).alias(c) for c in ("jaccard", "f1", "receivers", "outlets")))


@query("hidden_detail")
def hidden_detail(spark, d):
    """Two fields that the observation cannot tell apart: detail of another field, as far as it is unseen, is put in place of a field's own."""
    seen = recon.axis_matrix(resample.weights("trapezoid", SIDE + 1, 4))
    up = recon.axis_matrix(resample.weights("bilinear", SIDE + 1, 4))

    def one(k: int, z: np.ndarray) -> pd.DataFrame:
        detail = lambda x: x - up @ (seen @ x @ seen.T) @ up.T
        other = z + recon.unseen(detail(z[:, ::-1]) - detail(z), seen, seen)
        gap = np.abs(other - z)
        return pd.DataFrame([(k, float(np.abs(seen @ (other - z) @ seen.T).max()) < 1e-9, float(gap.mean()), float(gap.max()), int((gap > 0.1).sum()))], columns=["region", "same", "gap_mean", "gap_max", "cells"])

    out = per_field(nodes(spark, d), one, "region bigint, same boolean, gap_mean double, gap_max double, cells int")
    return out.withColumns({c: rounded(c) for c in ("gap_mean", "gap_max")})


@query("area_to_point")
def area_to_point(spark, d):
    """Points between area averages by kriging under the covariance of each field: its range, the mean
    error of the predicted nodes, and the mean deviation that the kriging expects."""
    taps = np.array([0.5, 1, 1, 1, 0.5]) / 4
    axis = recon.axis_matrix(resample.weights("trapezoid", SIDE + 1, 4))

    def one(k: int, z: np.ndarray) -> pd.DataFrame:
        cov = recon.radial_covariance(z, 6)
        ranges = np.geomspace(0.2, 50, 200)
        shapes = np.exp(-np.arange(5)[None, :] / ranges[:, None])
        sills = np.maximum((shapes * cov[:5]).sum(1) / (shapes**2).sum(1), 1e-9)
        best = int(((sills[:, None] * shapes - cov[:5]) ** 2).sum(1).argmin())
        kernels, variance = recon.area_kernels(taps, 4, float(sills[best]), float(ranges[best]))
        coarse = axis @ (z - z.mean()) @ axis.T
        near = np.lib.stride_tricks.sliding_window_view(coarse, (4, 4))
        errors = [np.abs(np.tensordot(near, kernels[a, b], 2) + z.mean() - z[4 + a : 4 + a + 4 * near.shape[0] : 4, 4 + b : 4 + b + 4 * near.shape[1] : 4]).mean() for a in range(4) for b in range(4)]
        return pd.DataFrame([(k, float(ranges[best]), float(np.mean(errors)), float(np.sqrt(variance).mean()))], columns=["region", "reach", "mae", "deviation"])

    out = per_field(nodes(spark, d), one, "region bigint, reach double, mae double, deviation double")
    return out.withColumns({c: rounded(c) for c in ("reach", "mae", "deviation")})


@query("resumed_runs")
def resumed_runs(spark, d):
    """Runs that are cut off after two steps, saved, restored and finished: whether they end where whole ones do."""

    def one(k: int, z: np.ndarray) -> pd.DataFrame:
        settings = {"years": 7.0, "dt": 2.0, "uplift": 0.05, "k_stream": 0.02, "k_slope": 0.05}
        whole, ledger = physics.evolve(z, **settings)
        part, held = physics.evolve(z, **settings | {"years": 4.0})
        again, more = physics.evolve(*physics.restored(physics.saved(part, held, settings), settings)[:1], **settings, ledger=held)
        return pd.DataFrame([(k, len(more), bool(np.array_equal(whole, again)), more == ledger)], columns=["region", "steps", "same_heights", "same_ledger"])

    return per_field(lattice(spark, d), one, "region bigint, steps int, same_heights boolean, same_ledger boolean")


BOUNDS = [(1, 3500, 4000, 12500, 9000), (2, 0, 0, 1000, 1000), (3, 20000, 15000, 26500, 39000)]


@query("tiles_in_boxes", f"WITH T AS (SELECT o_orderkey AS tile, CAST((o_orderkey % 40) * 1000 AS BIGINT) AS e, CAST((o_orderkey // 40) % 40 * 1000 AS BIGINT) AS n FROM orders), B(box, w, s, r, t) AS (VALUES {', '.join(map(str, BOUNDS))}) SELECT box, tile FROM T JOIN B ON e < r AND e + 1000 > w AND n < t AND n + 1000 > s")
def tiles_in_boxes(spark, d):
    """Tiles that share area with boxes: boxes and tiles meet by the squares of a grid that they touch, then by their sides."""
    grid = 4000
    boxes = spark.sql(f"SELECT * FROM VALUES {', '.join(map(str, BOUNDS))} AS b(box, w, s, r, t)")
    touched = lambda low, high: F.explode(F.sequence(F.floor(low / grid), F.floor(high / grid)))
    b = boxes.withColumn("gx", touched(F.col("w"), F.col("r"))).withColumn("gy", touched(F.col("s"), F.col("t")))
    tiles = epochs(spark, d).select("tile", "e", "n").withColumn("gx", touched(F.col("e"), F.col("e") + 1000)).withColumn("gy", touched(F.col("n"), F.col("n") + 1000))
    met = tiles.join(b, ["gx", "gy"]).where((F.col("e") < F.col("r")) & (F.col("e") + 1000 > F.col("w")) & (F.col("n") < F.col("t")) & (F.col("n") + 1000 > F.col("s")))
    return met.select("box", "tile").distinct()


@query("field_shuffle", f"{L}, R AS (SELECT region, z, row_number() OVER (PARTITION BY region ORDER BY sha256(concat('5:', row, ':', col))) - 1 AS k FROM L) SELECT region, CAST(k // 64 AS INTEGER) AS row, CAST(k % 64 AS INTEGER) AS col, z FROM R")
def field_shuffle(spark, d):
    """All cells of a field in the order of a seeded hash: a control without any neighbourhood."""
    k = F.row_number().over(Window.partitionBy("region").orderBy(F.sha2(F.concat_ws(":", F.lit(5), "row", "col"), 256))) - 1
    return lattice(spark, d).select("region", F.floor(k / SIDE).cast("int").alias("row"), (k % SIDE).cast("int").alias("col"), "z")


_FAULTS = [(5.0, 5.0, 30.0, 12.0), (30.0, 12.0, 55.0, 50.0), (10.0, 60.0, 40.0, 58.0)]
_FAULT_ROWS = ", ".join(f"({i}, {a}, {b}, {c}, {e})" for i, (a, b, c, e) in enumerate(_FAULTS))


@query(
    "error_by_fault_distance",
    f"""WITH P AS (SELECT c_custkey AS id, ((c_custkey * 37) % 6400) / 100.0::DOUBLE AS x, ((c_custkey * 53) % 6400) / 100.0::DOUBLE AS y, abs(c_acctbal) / 10000.0::DOUBLE AS err FROM customer),
    S(k, x0, y0, x1, y1) AS (SELECT k, x0::DOUBLE, y0::DOUBLE, x1::DOUBLE, y1::DOUBLE FROM (VALUES {_FAULT_ROWS}) AS v(k, x0, y0, x1, y1)),
    T AS (SELECT id, x, y, err, x0, y0, x1 - x0 AS dx, y1 - y0 AS dy, greatest(0, least(1, ((x - x0) * (x1 - x0) + (y - y0) * (y1 - y0)) / ((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0)))) AS t FROM P, S),
    D AS (SELECT id, any_value(err) AS err, min(sqrt((x - x0 - t * dx) * (x - x0 - t * dx) + (y - y0 - t * dy) * (y - y0 - t * dy))) AS d FROM T GROUP BY id)
    SELECT CAST(least(floor(d / 8), 4) AS INTEGER) AS ring, count(*) AS n, round(avg(err), 6) + 0.0 AS error FROM D GROUP BY ALL""",
)
def error_by_fault_distance(spark, d):
    """Errors of events by their distance from the nearest fault, in rings. The faults are a literal of three segments."""
    p = read(spark, d, "customer").select((((F.col("c_custkey") * 37) % 6400) / F.lit(100.0)).alias("x"), (((F.col("c_custkey") * 53) % 6400) / F.lit(100.0)).alias("y"), (F.abs("c_acctbal") / 10000.0).alias("err"))

    def far(x0: float, y0: float, x1: float, y1: float):
        dx, dy = x1 - x0, y1 - y0
        t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((F.col("x") - x0) * dx + (F.col("y") - y0) * dy) / (dx * dx + dy * dy)))
        return F.sqrt(F.pow(F.col("x") - x0 - t * dx, F.lit(2)) + F.pow(F.col("y") - y0 - t * dy, F.lit(2)))

    ring = F.least(F.floor(F.least(*(far(*s) for s in _FAULTS)) / 8), F.lit(4)).cast("int")
    return p.groupBy(ring.alias("ring")).agg(F.count("*").alias("n"), rounded(F.avg("err")).alias("error"))


@query(
    "gml_lines",
    "WITH P AS (SELECT o_custkey AS line, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS k, CAST((o_orderkey * 37) % 640 AS DOUBLE) / 10 AS x, CAST((o_orderkey * 53) % 640 AS DOUBLE) / 10 AS y FROM orders) SELECT line, CAST(k AS INTEGER) AS k, x, y FROM P WHERE line IN (SELECT line FROM P GROUP BY line HAVING count(*) >= 2)",
)
def gml_lines(spark, d):
    """Lines out of markup: features with a position list are written and read again; lines of one point are none."""
    from ..sources import text

    o = read(spark, d, "orders").select(F.col("o_custkey").alias("line"), "o_orderkey", *(((F.col("o_orderkey") * m % 640).cast("double") / 10).alias(c) for m, c in ((37, "x"), (53, "y"))))
    at = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", "x", "y"))), lambda p: F.concat(p["x"].cast("string"), F.lit(" "), p["y"].cast("string"))), " ")
    xml = F.concat(F.lit('<Fault id="'), F.col("line").cast("string"), F.lit('"><curveProperty><MultiCurve><curveMember><posList>'), at, F.lit("</posList></curveMember></MultiCurve></curveProperty></Fault>"))
    written = o.groupBy("line").agg(xml.alias("xml"))  # a customer's orders, as a line has its points
    return text.polylines(written.select("xml")).select(F.col("id").cast("bigint").alias("line"), "k", "x", "y")
