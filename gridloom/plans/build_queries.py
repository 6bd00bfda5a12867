"""Queries on building: separated places, fills without a field in one task, receipts, published atlases, markup, projections."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from ..functions import codecs
from ..functions.scalar import rounded
from ..operators import geodesy, masks, points, resample, separation, spill, stencils
from ..sources import atlas, coverages, markup
from ..sources.shared import checkpointed, folder
from ..sources.tables import LATTICE_SQL, NODES_SQL, SIDE, lattice, nodes, read
from ..streaming import receipts
from .catalog import query
from .field_queries import SMOOTH, _apply_sql
from .pages import paged

L = f"WITH {LATTICE_SQL}"

#: Places of customers on a plane of 1000 by 1009, in random order.
_PLACES = "PL AS (SELECT c_nationkey AS g, c_custkey AS id, md5(CAST(c_custkey AS VARCHAR)) AS rank, md5('x' || c_custkey) AS second, CAST((c_custkey * 7919) % 1000 AS DOUBLE) AS x, CAST((c_custkey * 104729) % 1009 AS DOUBLE) AS y, c_acctbal AS v FROM customer)"
_FAR = 60.0
_CLEAR = "len(list_filter(kept, lambda o: abs(o.x - n.x) < {far} AND abs(o.y - n.y) < {far})) = 0"


def _places(spark, d):
    c = read(spark, d, "customer")
    key = F.col("c_custkey")
    return c.select(
        F.col("c_nationkey").alias("group"), key.alias("id"), F.md5(key.cast("string").cast("binary")).alias("rank"), F.md5(F.concat(F.lit("x"), key.cast("string")).cast("binary")).alias("second"),
        (key * 7919 % 1000).cast("double").alias("x"), (key * 104729 % 1009).cast("double").alias("y"), F.col("c_acctbal").alias("v"),
    )


@query(
    "separated_places",
    f"""WITH RECURSIVE {_PLACES}, N AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY rank, id) AS k FROM PL),
    G(g, k, kept) AS (SELECT DISTINCT g, 0::BIGINT, []::STRUCT(id BIGINT, x DOUBLE, y DOUBLE)[] FROM PL UNION ALL
      SELECT n.g, n.k, CASE WHEN {_CLEAR.format(far=_FAR)} THEN kept || [struct_pack(id := n.id::BIGINT, x := n.x, y := n.y)] ELSE kept END FROM G JOIN N n ON n.g = G.g AND n.k = G.k + 1),
    B AS (SELECT g, arg_max(kept, k) AS kept FROM G GROUP BY g), U AS (SELECT g, unnest(kept) AS p FROM B)
    SELECT U.g AS nation, PL.id, PL.x, PL.y FROM U JOIN PL ON PL.g = U.g AND PL.id = p.id""",
)
def separated_places(spark, d):
    """Customers of a nation in random order, each taken if no place taken before is nearer than 60."""
    return separation.separated(_places(spark, d), _FAR).select(F.col("group").alias("nation"), "id", "x", "y")


def _strata_sql(count: int, strata: int, far: float) -> str:
    steps, before = [], "SELECT DISTINCT g, []::STRUCT(id BIGINT, x DOUBLE, y DOUBLE, step INTEGER)[] AS kept FROM PL"
    for s in range(strata + 1):
        own, order = (f"WHERE stratum = {s}", "rank") if s < strata else ("", "second")
        want = str(count // strata + (1 if s < count % strata else 0)) if s < strata else f"{count} - base"
        steps.append(f"""N{s} AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY {order}, id) AS k FROM S {own}),
    G{s}(g, k, base, kept) AS (SELECT g, 0::BIGINT, len(kept), kept FROM ({before}) UNION ALL
      SELECT n.g, n.k, base, CASE WHEN len(kept) - base < {want} AND {_CLEAR.format(far=far)} THEN kept || [struct_pack(id := n.id::BIGINT, x := n.x, y := n.y, step := {s})] ELSE kept END FROM G{s} q JOIN N{s} n ON n.g = q.g AND n.k = q.k + 1),
    B{s} AS (SELECT g, arg_max(kept, k) AS kept FROM G{s} GROUP BY g)""")
        before = f"SELECT g, kept FROM B{s}"
    return f"WITH RECURSIVE {_PLACES}, S AS (SELECT *, least(CAST(floor({strata} * percent_rank() OVER (PARTITION BY g ORDER BY v)) AS INTEGER), {strata - 1}) AS stratum FROM PL), {', '.join(steps)}, U AS (SELECT g, unnest(kept) AS p FROM B{strata}) SELECT g AS nation, p.id AS id, p.step AS step FROM U"


@query("separated_strata", _strata_sql(12, 3, 150.0))
def separated_strata(spark, d):
    """Twelve places of each nation, a third from each third of balances, and what separation leaves short made up from all."""
    from pyspark.sql import Window

    share = F.percent_rank().over(Window.partitionBy("group").orderBy("v"))
    points = _places(spark, d).withColumn("stratum", F.least(F.floor(3 * share).cast("int"), F.lit(2)))
    return separation.by_strata(points, 150.0, 12, 3).select(F.col("group").alias("nation"), F.col("id"), "step")


@query(
    "spill_levels",
    f"""WITH RECURSIVE {LATTICE_SQL}, FL(region, row, col, v) USING KEY (region, row, col) AS (SELECT region, row, col, z FROM L WHERE row IN (0, {SIDE - 1}) OR col IN (0, {SIDE - 1})
    UNION SELECT n.region, n.row, n.col, min(greatest(n.z, f.v)) FROM FL f JOIN (VALUES (-1, -1), (-1, 0), (-1, 1), (0, -1), (0, 1), (1, -1), (1, 0), (1, 1)) AS o(a, b) ON true JOIN L n ON n.region = f.region AND n.row = f.row + o.a AND n.col = f.col + o.b
      LEFT JOIN recurring.FL h ON h.region = n.region AND h.row = n.row AND h.col = n.col WHERE h.v IS NULL OR greatest(n.z, f.v) < h.v GROUP BY n.region, n.row, n.col)
    SELECT L.region, L.row, L.col, round(FL.v, 7) + 0.0 AS fill FROM L JOIN FL USING (region, row, col)""",
)
def spill_levels(spark, d):
    """The level that each pit fills to, flats left flat, by spanning forests in tiles, then over edges between them."""
    return spill.levels(lattice(spark, d), SIDE, SIDE // 2).select("region", "row", "col", rounded("fill", 7).alias("fill"))


#: Bytes that a payload may have to be received.
_ALLOWANCE = 4000
_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def deliveries(pages):
    """What two deliveries of pages hold: all of them; then every second again, and every fifth changed."""
    row = lambda df, seq, html: df.select("url", (F.col("page_id") + seq).alias("seq"), F.sha2(html, 256).alias("sha256"), F.octet_length(html).cast("bigint").alias("bytes"))
    html, changed = F.coalesce("html", F.lit("")), F.concat(F.coalesce("html", F.lit("")), F.lit("!"))
    return row(pages, 0, html), row(pages.where("page_id % 2 = 0"), 10**12, html).union(row(pages.where("page_id % 5 = 0"), 2 * 10**12, changed))


@query(
    "receipts_streamed",
    f"""WITH P AS (SELECT url, page_id, coalesce(html, '') AS h FROM pages WHERE url IS NOT NULL),
    D AS (SELECT url, page_id AS seq, h FROM P UNION ALL SELECT url, page_id + 1000000000000, h FROM P WHERE page_id % 2 = 0 UNION ALL SELECT url, page_id + 2000000000000, h || '!' FROM P WHERE page_id % 5 = 0),
    I AS (SELECT url, seq, sha256(h) AS sha256, strlen(h) AS bytes FROM D), F AS (SELECT url, min(seq) AS first, arg_min(sha256, seq) AS known FROM I WHERE bytes <= {_ALLOWANCE} GROUP BY url)
    SELECT I.url, I.seq, I.sha256, I.bytes, CASE WHEN first IS NULL OR seq < first THEN 'refused: over the allowance' WHEN seq = first THEN 'accepted' ELSE 'refused: another identity' END AS outcome
    FROM I LEFT JOIN F ON I.url = F.url WHERE first IS NULL OR seq <= first OR sha256 <> known""",
)
def receipts_streamed(spark, d):
    """Pages delivered twice to a stream that keeps receipts, with a restart from the checkpoint between the deliveries."""
    before = spark.conf.get(_STORE)
    spark.conf.set(_STORE, _ROCKS)
    try:
        with folder(spark) as path:
            for batch in deliveries(read(spark, d, "pages")):
                batch.write.mode("append").parquet(f"{path}/in")
                stream = receipts.received(receipts.source(spark, f"{path}/in", batch.schema, 1000), _ALLOWANCE)
                run = stream.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/log").trigger(availableNow=True).start()
                run.awaitTermination()
            out = spark.read.parquet(f"{path}/out")
            return checkpointed(out.select(F.col("key").alias("url"), F.col("place").alias("seq"), F.col("identity").alias("sha256"), F.col("size").alias("bytes"), "outcome"))
    finally:
        spark.conf.set(_STORE, before)


_QUANTUM, _LEVELS = 0.001, 3


def _pyramid_sql() -> str:
    steps, side = ["Y0 AS (SELECT region, row, col, z FROM LN)"], SIDE
    for k in range(1, _LEVELS + 1):
        side //= 2
        one = SMOOTH.replace("FROM L)", f"FROM Y{k - 1})")
        for n in (1, 2, 3, 4):
            one = one.replace(f"A{n} ", f"A{k}_{n} ").replace(f"A{n}\n", f"A{k}_{n}\n").replace(f"FROM A{n} ", f"FROM A{k}_{n} ").replace(f"FROM A{n})", f"FROM A{k}_{n})")
        steps += [one, f"Y{k} AS (SELECT * FROM A{k}_4)"]
    every = " UNION ALL ".join(f"SELECT region, {k} AS level, row, col, z FROM Y{k}" for k in range(_LEVELS + 1))
    return f"WITH {LATTICE_SQL}, {NODES_SQL}, {', '.join(steps)} SELECT region, CAST(level AS INTEGER) AS level, row, col, round(round_even(z / {_QUANTUM}::DOUBLE, 0) * {_QUANTUM}::DOUBLE, 6) + 0.0 AS z FROM ({every})"


def pyramid(cells, side: int, intervals: int, levels: int):
    """(region, level, y, x, z): the pages of a field of side + 1 nodes and of its coarser levels."""
    out = None
    for level in range(levels + 1):
        pages = paged(cells, intervals, side >> level).select("region", F.lit(level).alias("level"), "y", "x", "z")
        out = pages if out is None else out.union(pages)
        cells = stencils.smooth_decimate(cells, (side >> level) + 1)
    return out


def unpacked(pages, intervals: int):
    """(region, level, row, col, z) of packed pages; a node that several pages share comes once."""

    def unpack(batches):
        for pdf in batches:
            for r in pdf.itertuples():
                z = codecs.page_values(bytes(r.blob))
                at = np.indices(z.shape)
                yield pd.DataFrame({"region": r.region, "level": np.int32(r.level), "row": (r.y * intervals + at[0].ravel()).astype(np.int32), "col": (r.x * intervals + at[1].ravel()).astype(np.int32), "z": z.ravel()})

    cells = pages.select("region", "level", "y", "x", "blob").mapInPandas(unpack, "region bigint, level int, row int, col int, z double")
    return cells.select("region", "level", "row", "col", rounded("z", 6).alias("z")).distinct()


@query("atlas_levels", _pyramid_sql())
def atlas_levels(spark, d):
    """All fields and their coarser levels published as an atlas, and all its pages read again."""
    with folder(spark) as path:
        atlas.publish(pyramid(nodes(spark, d), SIDE, 8, _LEVELS), f"{path}/atlas", _QUANTUM)
        return checkpointed(unpacked(atlas.read(spark, f"{path}/atlas"), 8))


def _escaped(c):
    return F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))


def _markup(spark, d):
    """Members of collections: customers as points with nested attributes, orders as lines from one place to another,
    suppliers as areas, of which some have a hole."""
    c, o, s = (read(spark, d, t) for t in ("customer", "orders", "supplier"))
    say = lambda *parts: F.concat(*(F.lit(x) if isinstance(x, str) else x.cast("string") for x in parts))
    east, north = lambda k: F.lit(300_000) + k * 37 % 400_000, lambda k: F.lit(5_600_000) + k * 53 % 90_000
    k = F.col("c_custkey")
    places = c.select(
        say('<wfs:member><cu:Customer gml:id="c', k, '"><cu:localId>', F.lpad(k.cast("string"), 9, "0"), "</cu:localId><cu:name> ", _escaped(F.col("c_name")), ' </cu:name><cu:nation xlink:href="#n', F.col("c_nationkey"),
            '"/><cu:market><cu:Market><cu:segment>', F.lower("c_mktsegment"), "</cu:segment><cu:name>second</cu:name></cu:Market></cu:market>",
            '<cu:place><gml:Point srsName="EPSG:25832"><gml:pos>', east(k), " ", north(k), "</gml:pos></gml:Point></cu:place></cu:Customer></wfs:member>").alias("value"),
    )
    k, j = F.col("o_orderkey"), F.col("o_custkey")
    lines = o.select(say("<wfs:member><or:Order><or:status>", F.col("o_orderstatus"), '</or:status><or:empty/><or:way><gml:LineString srsName="urn:ogc:def:crs:EPSG::25832"><gml:posList>', east(k), " ", north(k), " ", east(j), " ", north(j), "</gml:posList></gml:LineString></or:way></or:Order></wfs:member>").alias("value"))
    k = F.col("s_suppkey")
    box = lambda m: say(*(x for a, b in ((0, 0), (1, 0), (1, 1), (0, 1), (0, 0)) for x in (east(k) + m + a * (100 - 2 * m), " ", north(k) + m + b * (100 - 2 * m), " ")))
    ring = lambda side, m: say(f"<gml:{side}><gml:LinearRing><gml:posList>", box(m), f"</gml:posList></gml:LinearRing></gml:{side}>")
    areas = s.select(say('<wfs:member><su:Supplier gml:id="s', k, '"><su:area><gml:Polygon>', ring("exterior", 0), F.when(k % 3 == 0, ring("interior", 10)).otherwise(""), "</gml:Polygon></su:area></su:Supplier></wfs:member>").alias("value"))
    return places.union(lines).union(areas)


def _marked_up(spark, d, use):
    """What `use` makes of a folder of such collections, which tasks write."""
    with folder(spark) as path:
        _markup(spark, d).write.text(path)
        return checkpointed(use(path))


_XY = "CAST(300000 + {k} * 37 % 400000 AS DOUBLE) AS {a}, CAST(5600000 + {k} * 53 % 90000 AS DOUBLE) AS {b}"


@query(
    "feature_scan",
    f"""SELECT 'Customer' AS type, 3::INTEGER AS names, c_name AS name, lower(c_mktsegment) AS detail, 1::INTEGER AS points, {_XY.format(k='c_custkey', a='x', b='y')} FROM customer
    UNION ALL SELECT 'Order', 1, NULL, o_orderstatus, 2, {_XY.format(k='o_orderkey', a='x', b='y')} FROM orders
    UNION ALL SELECT 'Supplier', 0, NULL, NULL, 5, {_XY.format(k='s_suppkey', a='x', b='y')} FROM supplier""",
)
def feature_scan(spark, d):
    """Features of collections with the first text of each name and their first geometry."""
    def use(path):
        f = markup.features(spark, path)
        a = F.col("attributes")
        return f.select("type", F.size(a).alias("names"), F.get(F.map_values(F.map_filter(a, lambda k, _: k == "name")), F.lit(0)).alias("name"), F.coalesce(a["segment"], a["status"]).alias("detail"), F.size("points").alias("points"), F.col("points")[0]["x"].alias("x"), F.col("points")[0]["y"].alias("y"))

    return _marked_up(spark, d, use)


@query(
    "unit_rings",
    f"""WITH S AS (SELECT s_suppkey AS k, {_XY.format(k='s_suppkey', a='x', b='y')} FROM supplier), C(i, a, b) AS (VALUES (0, 0, 0), (1, 1, 0), (2, 1, 1), (3, 0, 1), (4, 0, 0)), R(ring, m) AS (VALUES (0, 0), (1, 10))
    SELECT 's' || k AS id, CAST(ring AS INTEGER) AS ring, CAST(i AS INTEGER) AS k, x + m + a * (100 - 2 * m) AS x, y + m + b * (100 - 2 * m) AS y FROM S, C, R WHERE ring = 0 OR k % 3 = 0""",
)
def unit_rings(spark, d):
    """Rings of the areas of features, the outer one first."""
    return _marked_up(spark, d, lambda path: markup.rings(spark, path, feature="Supplier").select("id", "ring", "k", "x", "y"))


@query(
    "schema_inventory",
    """WITH V AS (SELECT 'localId' AS name, lpad(c_custkey::VARCHAR, 9, '0') AS v FROM customer UNION ALL SELECT 'name', c_name FROM customer UNION ALL SELECT 'nation', '#n' || c_nationkey FROM customer UNION ALL SELECT 'market', lower(c_mktsegment) FROM customer
    UNION ALL SELECT 'status', o_orderstatus FROM orders UNION ALL SELECT 'empty', NULL FROM orders), C AS (SELECT count(*) AS c FROM customer), O AS (SELECT count(*) AS o FROM orders), S AS (SELECT count(*) AS s FROM supplier),
    A AS (SELECT 'field' AS kind, name, count(*) AS n, coalesce(list_sort(list_distinct(list(v)))[1:12], []) AS l FROM V GROUP BY name
    UNION ALL SELECT 'feature', 'Customer', c, [] FROM C UNION ALL SELECT 'feature', 'Order', o, [] FROM O UNION ALL SELECT 'feature', 'Supplier', s, [] FROM S
    UNION ALL SELECT 'geometry', 'Point', c, [] FROM C UNION ALL SELECT 'geometry', 'LineString', o, [] FROM O UNION ALL SELECT 'geometry', 'Polygon', s, [] FROM S
    UNION ALL SELECT 'srs', 'EPSG:25832', c, [] FROM C UNION ALL SELECT 'srs', 'urn:ogc:def:crs:EPSG::25832', o, [] FROM O UNION ALL SELECT 'reference', 'nation', c, [] FROM C UNION ALL SELECT 'identifier', 'localId', c, [] FROM C)
    SELECT kind, name, n, array_to_string(l, '|') AS samples FROM A""",
)
def schema_inventory(spark, d):
    """Features, fields, links, geometries and reference systems of collections, counted, with samples of the fields' values."""
    return _marked_up(spark, d, lambda path: markup.inventory(spark, path).withColumn("samples", F.array_join("samples", "|")))


_REACH = 9


@query(
    "fault_growth",
    f"""WITH RECURSIVE {LATTICE_SQL}, G(region, row, col, s, c, d) USING KEY (region, row, col) AS (SELECT region, row, col, sin(radians(2 * ((row * 7 + col) % 180))), cos(radians(2 * ((row * 7 + col) % 180))), 0 FROM L WHERE z > 0.35
    UNION SELECT n.region, n.row, n.col, avg(g.s), avg(g.c), max(g.d) + 1 FROM G g JOIN (VALUES (0, 1), (1, 0), (0, -1), (-1, 0)) AS o(a, b) ON true JOIN L n ON n.region = g.region AND n.row = g.row + o.a AND n.col = g.col + o.b
      LEFT JOIN recurring.G h ON h.region = n.region AND h.row = n.row AND h.col = n.col WHERE h.d IS NULL AND g.d < {_REACH} GROUP BY n.region, n.row, n.col)
    SELECT L.region, L.row, L.col, coalesce(d, {_REACH}) AS distance, round(coalesce(s, 0) * exp(-coalesce(d, {_REACH}) / {_REACH / 3}), 7) + 0.0 AS sin2, round(coalesce(c, 0) * exp(-coalesce(d, {_REACH}) / {_REACH / 3}), 7) + 0.0 AS cos2, d IS NOT NULL AS reached FROM L LEFT JOIN G USING (region, row, col)""",
)
def fault_growth(spark, d):
    """Distance to the nearest fault cells and the mean of their strikes, ring by ring."""
    cells = lattice(spark, d)
    faults = cells.where("z > 0.35").select("region", "row", "col", ((F.col("row") * 7 + F.col("col")) % 180).alias("strike"))
    return masks.fault_growth(faults, cells, _REACH).select("region", "row", "col", "distance", rounded("sin2", 7).alias("sin2"), rounded("cos2", 7).alias("cos2"), "reached")


_SPLINE = resample.weights("bspline", SIDE + 1, 4)


@query("upsample_bspline", f"{L}, {NODES_SQL}, A0 AS (SELECT region, row // 4 AS row, col // 4 AS col, z FROM LN WHERE row % 4 = 0 AND col % 4 = 0), {resample.sql_axis(_SPLINE, 'WB')}, {_apply_sql('U', 'A0', 'WB')} SELECT region, row, col, round(z, 8) + 0.0 AS z FROM U")
def upsample_bspline(spark, d):
    """Every fourth node brought back up by cubic B-splines through them."""
    coarse = nodes(spark, d).where("row % 4 = 0 AND col % 4 = 0").select("region", (F.col("row") / 4).cast("int").alias("row"), (F.col("col") / 4).cast("int").alias("col"), "z")
    return resample.apply(coarse, _SPLINE).select("region", "row", "col", rounded("z", 8).alias("z"))


def _extents(spark, d):
    """A customer's square of a hundred nodes, ten apart; some have pixel edges for bounds, or do not say what theirs are."""
    k = F.col("c_custkey")
    c = read(spark, d, "customer").select(k.alias("id"), (F.lit(300_000) + k * 37 % 400_000).cast("double").alias("west"), (F.lit(5_600_000) + k * 53 % 90_000).cast("double").alias("south"), k)
    over = F.when(k % 7 == 0, 1000.0).otherwise(990.0)
    return c.select("id", "west", "south", (F.col("west") + over).alias("east"), (F.col("south") + over).alias("north"), F.lit(100).alias("side"), F.lit(10.0).alias("spacing"), F.when(k % 11 != 0, True).alias("centres"), (k % 13 != 0).alias("north_up"))


_EXTENTS = "X AS (SELECT c_custkey AS id, CAST(300000 + c_custkey * 37 % 400000 AS DOUBLE) AS west, CAST(5600000 + c_custkey * 53 % 90000 AS DOUBLE) AS south, CASE WHEN c_custkey % 7 = 0 THEN 1000.0::DOUBLE ELSE 990.0 END AS over FROM customer)"


def _corner_sql() -> str:
    lit = lambda x: f"{x!r}::DOUBLE"
    sinh, cosh = "((exp({0}) - exp(-({0}))) / 2)".format, "((exp({0}) + exp(-({0}))) / 2)".format
    term = lambda table, f, g: " + ".join(f"{lit(c)} * {f(f'{2 * j} * xi')} * {g(f'({2 * j} * eta)')}" for j, c in enumerate(geodesy.series(table), 1))
    size = lit(geodesy.SCALE * geodesy.RADIUS)
    sin, cos = "sin({0})".format, "cos({0})".format
    lat = "chi + " + " + ".join(f"{lit(c)} * sin({2 * j} * chi)" for j, c in enumerate(geodesy.series(geodesy.LATITUDE), 1))
    return f"""WITH {_EXTENTS}, C AS (SELECT id, west + a * over AS x, south + b * over AS y FROM X, (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) AS o(a, b)),
    S AS (SELECT *, y / {size} AS xi, (x - {geodesy.FALSE_EAST}) / {size} AS eta FROM C), T AS (SELECT id, x, y, xi - ({term(geodesy.BACK, sin, cosh)}) AS p, eta - ({term(geodesy.BACK, cos, sinh)}) AS q FROM S),
    U AS (SELECT *, asin(sin(p) / {cosh('q')}) AS chi FROM T)
    SELECT id, x, y, round({geodesy.MERIDIAN} + degrees(atan({sinh('q')} / cos(p))), 8) + 0.0 AS lon, round(degrees({lat}), 8) + 0.0 AS lat, true AS back FROM U"""


@query("geodetic_corners", _corner_sql())
def geodetic_corners(spark, d):
    """Corners of extents in degrees, and whether the way back ends at them to within a micrometre."""
    out = geodesy.corners(_extents(spark, d))
    return out.select("id", "x", "y", rounded("lon", 8).alias("lon"), rounded("lat", 8).alias("lat"), (F.col("error") < 1e-6).alias("back"))


@query(
    "extent_findings",
    f"WITH {_EXTENTS}, F AS (SELECT id, 'span' AS finding FROM X WHERE over <> 990 UNION ALL SELECT id, 'centres' FROM X WHERE id % 11 = 0 UNION ALL SELECT id, 'orientation' FROM X WHERE id % 13 = 0) SELECT * FROM F",
)
def extent_findings(spark, d):
    """What is wrong with extents: spans that are not those of sample centres, and what they do not state."""
    return geodesy.extent_findings(_extents(spark, d))


_LABELS = ("E N", "x y", "Lat Long h", "i j", "", "E")


@query(
    "schema_negotiation",
    """WITH A AS (SELECT s_nationkey AS n, unnest(CASE WHEN s_suppkey % 5 = 0 THEN ['geo__' || s_name, 'ns:' || s_name] WHEN s_suppkey % 5 = 1 THEN [s_name, 'ns:' || s_name] ELSE ['geo__' || s_name] END) AS a, s_name AS t FROM supplier),
    Q AS (SELECT c_custkey AS id, c_nationkey AS n, 'Supplier#' || lpad((c_custkey % (SELECT count(*) FROM supplier))::VARCHAR, 9, '0') AS wanted, c_nationkey % 6 AS k FROM customer),
    M AS (SELECT id, count(*) AS c, bool_or(a = wanted) AS exact, min(a) AS one, string_agg(a, ' ' ORDER BY a) AS every FROM Q JOIN A ON A.n = Q.n AND t = wanted GROUP BY id),
    R AS (SELECT Q.id, k, Q.n, CASE WHEN exact THEN wanted WHEN c = 1 THEN one END AS coverage, CASE k WHEN 0 THEN 'E' WHEN 1 THEN 'x' WHEN 2 THEN 'Long' WHEN 4 THEN 'x' END AS easting, CASE k WHEN 0 THEN 'N' WHEN 1 THEN 'y' WHEN 2 THEN 'Lat' WHEN 4 THEN 'y' END AS northing,
      coalesce(CASE WHEN Q.n % 7 = 6 THEN 'exception: closed' END, CASE WHEN Q.n % 7 = 6 OR c IS NULL THEN 'absent' WHEN NOT exact AND c > 1 THEN 'ambiguous: ' || every END, CASE k WHEN 3 THEN 'no easting and northing' WHEN 5 THEN 'too few axes' END) AS refusal FROM Q LEFT JOIN M ON M.id = Q.id)
    SELECT id, CASE WHEN n % 7 <> 6 THEN coverage END AS coverage, easting, northing, refusal, CASE WHEN refusal IS NULL THEN CASE n % 3 WHEN 0 THEN 'SCALEFACTOR' WHEN 1 THEN 'SCALEAXESBYFACTOR' ELSE 'none' END END AS form,
      CASE WHEN refusal IS NULL THEN CASE n % 3 WHEN 0 THEN '0.1' WHEN 1 THEN easting || '(0.1),' || northing || '(0.1)' ELSE '' END END AS value FROM R""",
)
def schema_negotiation(spark, d):
    """What customers' requests to the service of their nation come to, from documents that each service has written."""
    s, n, c = (read(spark, d, t) for t in ("supplier", "nation", "customer"))
    name = F.col("s_name")
    ids = F.when(F.col("s_suppkey") % 5 == 0, F.array(F.concat(F.lit("geo__"), name), F.concat(F.lit("ns:"), name))).when(F.col("s_suppkey") % 5 == 1, F.array(name, F.concat(F.lit("ns:"), name))).otherwise(F.array(F.concat(F.lit("geo__"), name)))
    offers = s.groupBy("s_nationkey").agg(F.concat_ws("", F.sort_array(F.flatten(F.collect_list(F.transform(ids, lambda v: F.concat(F.lit("<CoverageId>"), v, F.lit("</CoverageId>"))))))).alias("ids"))  # a service's own offer
    key = F.col("n_nationkey")
    labels = F.element_at(F.array(*map(F.lit, _LABELS)), (key % 6 + 1).cast("int"))
    offered = F.concat(F.lit('<w:Capabilities xmlns:w="w"><w:Contents>'), F.regexp_replace(F.coalesce("ids", F.lit("")), "(</?)(?=Cov)", "$1w:"), F.lit("</w:Contents></w:Capabilities>"))
    closed = F.lit("<o:ExceptionReport xmlns:o='o'><o:ExceptionText>closed</o:ExceptionText></o:ExceptionReport>")
    stated = F.concat(F.lit('<g:CoverageDescription xmlns:g="g"><g:Envelope srsName="EPSG:25832"'), F.when(labels != "", F.concat(F.lit(' axisLabels="'), labels, F.lit('"'))).otherwise(""), F.lit("/></g:CoverageDescription>"))
    docs = n.join(offers, key == F.col("s_nationkey"), "left").select(key.alias("service"), F.to_json(F.struct(F.when(key % 7 == 6, closed).otherwise(offered).alias("capabilities"), stated.alias("description"))).alias("value"))
    with folder(spark) as path:
        docs.write.partitionBy("service").text(path)
        back = spark.read.schema("value string, service long").text(path).select("service", F.from_json("value", "capabilities string, description string").alias("d"))
        told = coverages.capabilities(back.select("service", F.col("d.capabilities").alias("xml"), F.col("d.description").alias("about")))
        told = coverages.described(told.drop("xml"), "about").select("service", "available", "refused", "labels", F.slice(F.array(*map(F.lit, coverages.FORMS)), (F.col("service") % 3 + 1).cast("int"), F.lit(1)).alias("accepts"))
        count = s.agg(F.count("*").alias("n"))
        asked = c.join(F.broadcast(count)).select(F.col("c_custkey").alias("id"), F.col("c_nationkey").cast("long").alias("service"), F.concat(F.lit("Supplier#"), F.lpad((F.col("c_custkey") % F.col("n")).cast("string"), 9, "0")).alias("wanted"))  # one row
        out = coverages.negotiated(coverages.asked(asked, told, "service"), 0.1)
        return checkpointed(out.select("id", "coverage", "easting", "northing", "refusal", "form", "value"))


_OFF = 2.5


def _valley_sql(name: str, row: str) -> str:
    return f"""Z{name} AS (SELECT q.region, q.line, q.k, q.side, sum(w * L.z) AS z FROM Q q JOIN L ON L.region = q.region AND {row} = q.r AND L.col = q.c GROUP BY ALL),
    T{name} AS (SELECT region, line, k, max(CASE WHEN side = 0 THEN z END) AS centre, min(CASE WHEN side <> 0 THEN z END) AS bank FROM Z{name} GROUP BY ALL HAVING count(*) = 3),
    V{name} AS (SELECT region, count(*) AS samples, round(avg(CASE WHEN centre <= bank + 1e-9 THEN 1 ELSE 0 END), 6) + 0.0 AS below FROM T{name} GROUP BY region)"""


@query(
    "valley_floor",
    f"""{L}, A AS (SELECT o_custkey AS line, o_custkey % 7 AS region, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k, CAST((o_orderkey * 37) % 640 AS DOUBLE) / 10 AS x, CAST((o_orderkey * 53) % 640 AS DOUBLE) / 10 AS y FROM orders),
    B AS (SELECT *, lag(x) OVER v AS xb, lead(x) OVER v AS xa, lag(y) OVER v AS yb, lead(y) OVER v AS ya, count(*) OVER (PARTITION BY line) AS n FROM A WINDOW v AS (PARTITION BY line ORDER BY k)),
    C AS (SELECT *, CASE WHEN xb IS NULL THEN xa - x WHEN xa IS NULL THEN x - xb ELSE (xa - xb) / 2 END AS tx, CASE WHEN yb IS NULL THEN ya - y WHEN ya IS NULL THEN y - yb ELSE (ya - yb) / 2 END AS ty FROM B WHERE n >= 3),
    D AS (SELECT *, CASE WHEN sqrt(tx * tx + ty * ty) = 0 THEN 1 ELSE sqrt(tx * tx + ty * ty) END AS size FROM C),
    P AS (SELECT region, line, k, side, x - {_OFF} * side * ty / size AS px, y + {_OFF} * side * tx / size AS py FROM D, (VALUES (0), (1), (-1)) AS s(side)),
    I AS (SELECT *, least(CAST(floor(py) AS INTEGER), 62) AS r0, least(CAST(floor(px) AS INTEGER), 62) AS c0 FROM P WHERE px BETWEEN 0 AND 63 AND py BETWEEN 0 AND 63),
    Q AS (SELECT region, line, k, side, r0 + a AS r, c0 + b AS c, (CASE a WHEN 0 THEN 1 - (py - r0) ELSE py - r0 END) * (CASE b WHEN 0 THEN 1 - (px - c0) ELSE px - c0 END) AS w FROM I, (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) AS o(a, b)),
    {_valley_sql("A", "L.row")}, {_valley_sql("B", "63 - L.row")} SELECT VA.region, VA.samples, VA.below, VB.below AS mirrored FROM VA JOIN VB USING (region)""",
)
def valley_floor(spark, d):
    """Whether lines, a customer's orders each, run along valleys, against the field turned upside down."""
    from pyspark.sql import Window

    key = F.col("o_orderkey")
    place = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    a = read(spark, d, "orders").select(F.col("o_custkey").alias("line"), (F.col("o_custkey") % 7).alias("region"), place.alias("k"), ((key * 37 % 640).cast("double") / 10).alias("x"), ((key * 53 % 640).cast("double") / 10).alias("y"))
    out = points.valley_floor(a, lattice(spark, d), _OFF, SIDE).where("mirrored IS NOT NULL")
    return out.select("region", "samples", rounded("below").alias("below"), rounded("mirrored").alias("mirrored"))
