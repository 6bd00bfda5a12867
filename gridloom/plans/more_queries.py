"""Further queries: splits and samples, index arithmetic, display statistics, frontier products, checks."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.scalar import rounded
from ..operators import masks, resample, stencils
from ..sources.tables import ESTIMATE_SQL, LATTICE_SQL, MEASUREMENTS_SQL, NODES_SQL, SIDE, estimate, lattice, measurements, nodes, read
from .catalog import query
from .field_queries import L, _apply_sql

E, M = f"WITH {LATTICE_SQL}, {ESTIMATE_SQL}", f"WITH {MEASUREMENTS_SQL}"
_KEYS = resample.weights("keys", SIDE + 1, 4)


@query("upsample_keys", f"{L}, {NODES_SQL}, A0 AS (SELECT region, row // 4 AS row, col // 4 AS col, z FROM LN WHERE row % 4 = 0 AND col % 4 = 0), {resample.sql_axis(_KEYS, 'WK')}, {_apply_sql('U', 'A0', 'WK')} SELECT region, row, col, round(z, 8) + 0.0 AS z FROM U")
def upsample_keys(spark, d):
    coarse = nodes(spark, d).where("row % 4 = 0 AND col % 4 = 0").select("region", (F.col("row") / 4).cast("int").alias("row"), (F.col("col") / 4).cast("int").alias("col"), "z")
    return resample.apply(coarse, _KEYS).select("region", "row", "col", rounded("z", 8).alias("z"))


_KINDS = ("decimate", "trapezoid", "gaussian", "box")


def _seen(kind: str) -> str:
    return f"{resample.sql_axis(resample.weights(kind, SIDE + 1, 4), f'W_{kind}')}, {_apply_sql(f'O_{kind}', 'LN', f'W_{kind}')}"


@query(
    "provider_kernel_fit",
    f"{L}, {NODES_SQL}, {', '.join(map(_seen, _KINDS))}, G AS ({' UNION ALL '.join(f'''SELECT '{k}' AS kind, avg(abs(a.z - b.z)) AS mae FROM O_trapezoid a JOIN O_{k} b USING (region, row, col)''' for k in _KINDS)}) SELECT kind, round(mae, 7) + 0.0 AS mae, round(mae, 7) = (SELECT min(round(mae, 7)) FROM G) AS best FROM G",
)
def provider_kernel_fit(spark, d):
    """Which observation operator explains a provider's coarse field best (here it is the trapezoid's own)."""
    fine = nodes(spark, d)
    given = resample.apply(fine, resample.weights("trapezoid", SIDE + 1, 4))
    fits = None
    for kind in _KINDS:
        own = resample.apply(fine, resample.weights(kind, SIDE + 1, 4)).withColumnRenamed("z", "o")
        one = given.join(own, ["region", "row", "col"]).agg(F.lit(kind).alias("kind"), F.round(F.avg(F.abs(F.col("z") - F.col("o"))), 7).alias("mae"))
        fits = one if fits is None else fits.union(one)
    return fits.select("kind", (F.col("mae") + 0.0).alias("mae"), (F.col("mae") == F.min("mae").over(Window.partitionBy(F.lit(0)))).alias("best"))  # four rows


@query("index_unpack", "SELECT o_orderkey AS id, CAST((o_orderkey * 31) // 4096 AS BIGINT) AS region, CAST((o_orderkey * 31) % 4096 // 64 AS INTEGER) AS row, CAST((o_orderkey * 31) % 64 AS INTEGER) AS col, round(2 * ((o_orderkey * 31) % 64) / 63.0::DOUBLE - 1, 9) + 0.0 AS x FROM orders")
def index_unpack(spark, d):
    """A flat index to region, row and column, and a coordinate in [-1, 1]."""
    k = F.col("o_orderkey") * 31
    cell = k % (SIDE * SIDE)
    col = k % SIDE
    return read(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.floor(k / (SIDE * SIDE)).alias("region"), F.floor(cell / SIDE).cast("int").alias("row"), col.cast("int").alias("col"), rounded(2 * col / 63.0 - 1, 9).alias("x"))


@query("sublattice_targets", f"{L}, {NODES_SQL}, S AS (SELECT unnest([8, 4, 2]) AS s) SELECT region, CAST(s AS INTEGER) AS stride, CAST(p AS INTEGER) AS pass, row, col FROM LN, S, (VALUES (0), (1)) AS q(p) WHERE (p = 0 AND row % s = s // 2 AND col % s = 0) OR (p = 1 AND row % (s // 2) = 0 AND col % s = s // 2)")
def sublattice_targets(spark, d):
    """Nodes that each pass of a multilevel coder predicts in a field: each but those of every eighth row and column once."""
    n = nodes(spark, d).select("region", "row", "col").withColumn("stride", F.explode(F.array(*map(F.lit, (8, 4, 2))))).withColumn("pass", F.explode(F.array(F.lit(0), F.lit(1))))
    half = F.floor(F.col("stride") / 2)
    first = (F.col("pass") == 0) & (F.col("row") % F.col("stride") == half) & (F.col("col") % F.col("stride") == 0)
    second = (F.col("pass") == 1) & (F.col("row") % half == 0) & (F.col("col") % F.col("stride") == half)
    return n.where(first | second).select("region", "stride", "pass", "row", "col")


@query("step_plan", "SELECT p_partkey AS id, CAST(floor(p_retailprice / p_size) AS BIGINT) AS whole, round(p_retailprice - floor(p_retailprice / p_size) * p_size, 6) + 0.0 AS rest FROM part")
def step_plan(spark, d):
    n = F.floor(F.col("p_retailprice") / F.col("p_size"))
    return read(spark, d, "part").select(F.col("p_partkey").alias("id"), n.alias("whole"), rounded(F.col("p_retailprice") - n * F.col("p_size")).alias("rest"))


@query("log2_approximation", "SELECT p_partkey AS id, CAST(floor(log2(p_size)) AS INTEGER) AS exponent, round(floor(log2(p_size)) + p_size / pow(2.0, floor(log2(p_size))) - 1, 9) + 0.0 AS approx FROM part")
def log2_approximation(spark, d):
    """Exponent plus linear mantissa; the exponent from the binary digits."""
    e = F.length(F.bin("p_size")) - 1
    return read(spark, d, "part").select(F.col("p_partkey").alias("id"), e.alias("exponent"), rounded(e + F.col("p_size") / F.pow(F.lit(2.0), e) - 1, 9).alias("approx"))


@query("cell_shuffle", f"{L}, R AS (SELECT *, row_number() OVER (PARTITION BY region, row ORDER BY sha256(concat('5:', row, ':', col))) - 1 AS k FROM L) SELECT region, row, CAST(k AS INTEGER) AS col, z FROM R")
def cell_shuffle(spark, d):
    """Cells of each row in the order of a seeded hash."""
    order = F.row_number().over(Window.partitionBy("region", "row").orderBy(F.sha2(F.concat_ws(":", F.lit(5), "row", "col"), 256)))
    return lattice(spark, d).select("region", "row", (order - 1).alias("col"), "z")


@query("seeded_sample", f"{L} SELECT region, row, col FROM L QUALIFY row_number() OVER (PARTITION BY region ORDER BY sha256(concat('11:', region, ':', row, ':', col))) <= 20")
def seeded_sample(spark, d):
    """Twenty cells of each field without replacement, by a seeded hash."""
    rank = F.row_number().over(Window.partitionBy("region").orderBy(F.sha2(F.concat_ws(":", F.lit(11), "region", "row", "col"), 256)))
    return lattice(spark, d).withColumn("k", rank).where("k <= 20").select("region", "row", "col")


@query("page_limit", f"{L} SELECT DISTINCT region, CAST(row // 16 AS INTEGER) AS y, CAST(col // 16 AS INTEGER) AS x FROM L ORDER BY region, y, x LIMIT 10")
def page_limit(spark, d):
    at = lambda c: F.floor(F.col(c) / 16).cast("int")
    return lattice(spark, d).select("region", at("row").alias("y"), at("col").alias("x")).distinct().orderBy("region", "y", "x").limit(10)


@query("borehole_split", "SELECT s_suppkey AS id, CASE WHEN s_suppkey % 10 = 0 THEN 'held' WHEN (s_suppkey * 37) % 64 >= 48 AND (s_suppkey * 53) % 64 >= 48 THEN 'block' ELSE 'train' END AS role FROM supplier")
def borehole_split(spark, d):
    k = F.col("s_suppkey")
    role = F.when(k % 10 == 0, "held").when(((k * 37) % 64 >= 48) & ((k * 53) % 64 >= 48), "block").otherwise("train")
    return read(spark, d, "supplier").select(k.alias("id"), role.alias("role"))


@query("display_stats", f"{E} SELECT region, count(*) FILTER (z < -0.2) AS below, count(*) FILTER (z > 0.2) AS above, round(avg(abs(e - z)), 7) + 0.0 AS mean_error, round(max(abs(e - z)), 7) + 0.0 AS max_error, min(z) AS low, max(z) AS high FROM E GROUP BY region")
def display_stats(spark, d):
    a = F.abs(F.col("e") - F.col("z"))
    return estimate(lattice(spark, d)).groupBy("region").agg(F.count_if(F.col("z") < -0.2).alias("below"), F.count_if(F.col("z") > 0.2).alias("above"), rounded(F.avg(a), 7).alias("mean_error"), rounded(F.max(a), 7).alias("max_error"), F.min("z").alias("low"), F.max("z").alias("high"))


@query("source_control", f"{E}, D AS (SELECT region, e - z AS d FROM E) SELECT region, round(avg(d), 7) + 0.0 AS mean, round(sqrt(avg(d * d)), 7) + 0.0 AS rms, round(quantile_cont(abs(d), 0.95), 7) AS p95, round(max(abs(d)), 7) AS top FROM D GROUP BY region")
def source_control(spark, d):
    """Two sources of one field against each other."""
    diff = F.col("e") - F.col("z")
    return estimate(lattice(spark, d)).groupBy("region").agg(rounded(F.avg(diff), 7).alias("mean"), rounded(F.sqrt(F.avg(diff * diff)), 7).alias("rms"), rounded(F.percentile(F.abs(diff), F.lit(0.95)), 7).alias("p95"), rounded(F.max(F.abs(diff)), 7).alias("top"))


@query("lattice_check", f"{L} SELECT region, count(*) AS nodes, CAST(max(row) AS INTEGER) AS last_row, CAST(max(col) AS INTEGER) AS last_col, count(*) = 4096 AND count(DISTINCT row * 64 + col) = 4096 AND count(*) FILTER (isnan(z) OR z IS NULL) = 0 AS whole FROM L GROUP BY region")
def lattice_check(spark, d):
    """Whether a field has each node once and none is missing."""
    ok = (F.count("*") == SIDE * SIDE) & (F.countDistinct(F.col("row") * SIDE + F.col("col")) == SIDE * SIDE) & (F.count_if(F.isnan("z") | F.col("z").isNull()) == 0)
    return lattice(spark, d).groupBy("region").agg(F.count("*").alias("nodes"), F.max("row").alias("last_row"), F.max("col").alias("last_col"), ok.alias("whole"))


@query("orientation_control", f"{L}, B AS (SELECT region, row, 63 - col AS col, z FROM L) SELECT L.region, round(corr(L.z, B.z), 6) + 0.0 AS mirrored, round(avg(abs(L.z - B.z)), 6) + 0.0 AS mae FROM L JOIN B USING (region, row, col) GROUP BY L.region")
def orientation_control(spark, d):
    """A negative control: a mirrored field has to disagree."""
    cells = lattice(spark, d)
    other = cells.select("region", "row", (SIDE - 1 - F.col("col")).alias("col"), F.col("z").alias("o"))
    return cells.join(other, ["region", "row", "col"]).groupBy("region").agg(rounded(F.corr("z", "o")).alias("mirrored"), rounded(F.avg(F.abs(F.col("z") - F.col("o")))).alias("mae"))


@query("page_stitch", f"{L}, {NODES_SQL}, P AS (SELECT y, x, region, row, col, z + y * 0.001::DOUBLE + x * 0.0001::DOUBLE AS z FROM LN, range(0, 8) a(y), range(0, 8) b(x) WHERE row BETWEEN y * 8 AND y * 8 + 8 AND col BETWEEN x * 8 AND x * 8 + 8) SELECT region, row, col, arg_min(z, (y, x)) AS z FROM P GROUP BY ALL")
def page_stitch(spark, d):
    """Pages that disagree on shared nodes: the first page wins."""
    from .pages import with_pages

    held = with_pages(nodes(spark, d), 8, SIDE)
    held = held.withColumn("z", F.col("z") + F.col("y") * 0.001 + F.col("x") * 0.0001)
    return held.groupBy("region", "row", "col").agg(F.min(F.struct("y", "x", "z")).alias("b")).select("region", "row", "col", F.col("b.z").alias("z"))


@query("parent_child", f"{L} SELECT a.region, CAST(p.y AS INTEGER) AS y, CAST(p.x AS INTEGER) AS x, max(a.z) - min(a.z) AS relief, count(DISTINCT (a.row // 8, a.col // 8)) AS children FROM L a JOIN (SELECT y, x FROM range(0, 4) r(y), range(0, 4) s(x)) p ON p.y = a.row // 16 AND p.x = a.col // 16 GROUP BY ALL")
def parent_child(spark, d):
    """Pages joined with the four they come from, by integer division of their keys."""
    at = lambda c, n: F.floor(F.col(c) / n).cast("int")
    child = lattice(spark, d).groupBy("region", at("row", 8).alias("cy"), at("col", 8).alias("cx")).agg(F.min("z").alias("low"), F.max("z").alias("high"))
    parents = spark.sql("SELECT CAST(a.id AS INT) AS y, CAST(b.id AS INT) AS x FROM range(4) a CROSS JOIN range(4) b")
    met = child.withColumns({"y": at("cy", 2), "x": at("cx", 2)}).join(F.broadcast(parents), ["y", "x"])  # sixteen rows, fixed
    return met.groupBy("region", "y", "x").agg((F.max("high") - F.min("low")).alias("relief"), F.count("*").alias("children"))


@query("lookup_fallback", "SELECT c_custkey AS id, coalesce(n, -1) AS orders, n IS NULL AS missing FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY ALL) ON o_custkey = c_custkey")
def lookup_fallback(spark, d):
    n = read(spark, d, "orders").where("o_orderstatus = 'F'").groupBy(F.col("o_custkey").alias("id")).agg(F.count("*").alias("n"))
    c = read(spark, d, "customer").select(F.col("c_custkey").alias("id")).join(n, "id", "left")
    return c.select("id", F.coalesce("n", F.lit(-1)).alias("orders"), F.col("n").isNull().alias("missing"))


@query("weight_quantise", f"{L}, S AS (SELECT region, max(abs(z)) / 127 AS s FROM L GROUP BY region) SELECT region, row, col, CAST(greatest(-127, least(127, round_even(z / s, 0))) AS INTEGER) AS q FROM L JOIN S USING (region)")
def weight_quantise(spark, d):
    """Eight bits with a scale for each group."""
    s = lattice(spark, d).groupBy("region").agg((F.max(F.abs("z")) / 127).alias("s"))
    q = F.greatest(F.lit(-127.0), F.least(F.lit(127.0), F.rint(F.col("z") / F.col("s"))))
    return lattice(spark, d).join(s, "region").select("region", "row", "col", q.cast("int").alias("q"))


@query(
    "receiver_margin",
    f"""{L}, D AS (SELECT a.region, a.row, a.col, a.z - b.z AS fall, row_number() OVER (PARTITION BY a.region, a.row, a.col ORDER BY a.z - b.z DESC) AS k FROM L a JOIN L b ON b.region = a.region AND abs(b.row - a.row) <= 1 AND abs(b.col - a.col) <= 1 AND (b.row <> a.row OR b.col <> a.col))
    SELECT region, row, col, max(CASE WHEN k = 1 THEN fall END) - max(CASE WHEN k = 2 THEN fall END) AS margin FROM D WHERE k <= 2 GROUP BY ALL""",
)
def receiver_margin(spark, d):
    """How much the best drop leads the second best: where errors can turn a receiver."""
    v = F.col("z")
    out = lattice(spark, d).withColumns({"w": F.lag(v).over(stencils.along_row()), "e": F.lead(v).over(stencils.along_row())})
    near = {}
    for name, f in (("n", F.lag), ("s", F.lead)):
        near |= {name + k: f(F.col(k) if k != "z" else v).over(stencils.along_col()) for k in ("w", "z", "e")}
    out = out.withColumns(near)
    falls = F.sort_array(F.array_compact(F.array(*(v - F.col(c) for c in ("w", "e", *near)))), asc=False)
    return out.select("region", "row", "col", (F.get(falls, F.lit(0)) - F.get(falls, F.lit(1))).alias("margin"))


@query("arm_ranking", f"{M}, S AS (SELECT coder, seed, avg(loss) AS v, max(violations) AS bad FROM M GROUP BY ALL), R AS (SELECT coder, median(v) AS mid, min(v) AS low, max(v) AS high, CAST(sum(bad) AS BIGINT) AS failures FROM S GROUP BY coder) SELECT coder, round(mid, 7) + 0.0 AS mid, round(low, 7) + 0.0 AS low, round(high, 7) + 0.0 AS high, failures, CASE WHEN failures > 2 THEN 'removed: failures' WHEN high - low > 0.01 THEN 'removed: spread' END AS reason FROM R")
def arm_ranking(spark, d):
    s = measurements(spark, d).groupBy("coder", "seed").agg(F.avg("loss").alias("v"), F.max("violations").alias("bad"))
    r = s.groupBy("coder").agg(F.median("v").alias("mid"), F.min("v").alias("low"), F.max("v").alias("high"), F.sum("bad").alias("failures"))
    reason = F.when(F.col("failures") > 2, "removed: failures").when(F.col("high") - F.col("low") > 0.01, "removed: spread")
    return r.select("coder", *(rounded(c, 7).alias(c) for c in ("mid", "low", "high")), "failures", reason.alias("reason"))


@query("ring_gates", f"{E}, R AS (SELECT CASE WHEN least(row, col, 63 - row, 63 - col) < 8 THEN 'edge' ELSE 'inner' END AS ring, abs(e - z) AS a, abs(z) AS p FROM E) SELECT ring, round(median(a), 7) AS mid, round(quantile_cont(a, 0.9), 7) AS p90, avg(a) < avg(p) AS beats_persistence FROM R GROUP BY ring")
def ring_gates(spark, d):
    """Error at the edge and inside, and whether it beats doing nothing."""
    edge = F.least("row", "col", SIDE - 1 - F.col("row"), SIDE - 1 - F.col("col")) < 8
    a = F.abs(F.col("e") - F.col("z"))
    cells = estimate(lattice(spark, d)).withColumns({"ring": F.when(edge, "edge").otherwise("inner"), "a": a})
    return cells.groupBy("ring").agg(rounded(F.median("a"), 7).alias("mid"), rounded(F.percentile("a", F.lit(0.9)), 7).alias("p90"), (F.avg("a") < F.avg(F.abs("z"))).alias("beats_persistence"))


@query("method_summaries", f"{M}, T AS (SELECT region, coder, avg(loss) AS v FROM M GROUP BY ALL), B AS (SELECT coder, avg(v) AS v FROM T GROUP BY coder) SELECT coder, round(v, 7) + 0.0 AS balanced, CAST(rank() OVER (ORDER BY round(v, 7)) AS INTEGER) AS place FROM B")
def method_summaries(spark, d):
    """Means that weigh each region the same, and their order."""
    t = measurements(spark, d).groupBy("region", "coder").agg(F.avg("loss").alias("v"))
    b = t.groupBy("coder").agg((F.round(F.avg("v"), 7) + 0.0).alias("balanced"))
    return b.withColumn("place", F.rank().over(Window.orderBy("balanced")))  # a row for each coder


@query("profile_export", f"{M} SELECT region, list(round(v, 3) + 0.0 ORDER BY bound) AS profile FROM (SELECT region, bound, avg(loss) AS v FROM M GROUP BY ALL) GROUP BY region")
def profile_export(spark, d):
    """Profiles as arrays in order, to three digits."""
    v = measurements(spark, d).groupBy("region", "bound").agg(F.avg("loss").alias("v"))
    inorder = F.sort_array(F.collect_list(F.struct("bound", (F.round("v", 3) + 0.0).alias("v"))))
    return v.groupBy("region").agg(F.transform(inorder, lambda x: x["v"]).alias("profile"))


@query("axis_names", "SELECT page_id, regexp_extract(url, '^([a-z]+)://', 1) AS scheme, len(string_split(regexp_extract(url, '://([^/?#]+)', 1), '.')) AS labels, TRY_CAST(nullif(regexp_extract(url, '/([0-9]+)', 1), '') AS BIGINT) AS number FROM pages")
def axis_names(spark, d):
    """Names, counts and numbers out of service addresses, as when coverage axes are negotiated."""
    u = F.col("url")
    return read(spark, d, "pages").select("page_id", F.regexp_extract(u, "^([a-z]+)://", 1).alias("scheme"), F.size(F.split(F.regexp_extract(u, "://([^/?#]+)", 1), r"\.")).cast("bigint").alias("labels"), F.expr("try_cast(regexp_extract(url, '/([0-9]+)', 1) AS BIGINT)").alias("number"))


@query("first_attributes", "SELECT user_id, arg_min(event_type, event_id) AS kind, min(event_id) AS first_id FROM events GROUP BY user_id")
def first_attributes(spark, d):
    """Of repeated attributes the first one wins."""
    return read(spark, d, "events").groupBy("user_id").agg(F.min(F.struct("event_id", "event_type")).alias("b")).select("user_id", F.col("b.event_type").alias("kind"), F.col("b.event_id").alias("first_id"))


@query("json_fields", "SELECT event_type, count(*) AS n, count(json_extract_string(props, '$.page')) AS pages FROM events GROUP BY ALL")
def json_fields(spark, d):
    return read(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.count(F.get_json_object("props", "$.page")).alias("pages"))


@query("sliding_counts", "SELECT start, event_type, count(*) AS n FROM (SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type FROM events UNION ALL SELECT time_bucket(INTERVAL 1 HOUR, ts, INTERVAL 30 MINUTE) AS start, event_type FROM events) GROUP BY ALL")
def sliding_counts(spark, d):
    """Extension: windows of an hour that begin each half hour."""
    w = F.window("ts", "1 hour", "30 minutes")
    return read(spark, d, "events").groupBy(w, "event_type").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "event_type", "n")


@query(
    "fault_distance",
    f"""{L}, K AS (SELECT region, row, col, CAST((row * 7 + col) % 180 AS INTEGER) AS strike FROM L WHERE z > 0.35),
    D AS (SELECT region, row + a AS row, col + b AS col, abs(a) + abs(b) AS d, strike FROM K, range(-3, 4) p(a), range(-3, 4) q(b) WHERE abs(a) + abs(b) <= 3)
    SELECT region, CAST(row AS INTEGER) AS row, CAST(col AS INTEGER) AS col, CAST(min(d) AS INTEGER) AS distance, arg_min(strike, (d, strike)) AS strike FROM D WHERE row BETWEEN 0 AND 63 AND col BETWEEN 0 AND 63 GROUP BY ALL""",
)
def fault_distance(spark, d):
    """Distance to the nearest fault cell and its strike, without wrapping around an edge."""
    faults = lattice(spark, d).where("z > 0.35").select("region", "row", "col", ((F.col("row") * 7 + F.col("col")) % 180).alias("strike"))
    return masks.fault_field(faults, 3, SIDE)


@query("metre_envelope", f"{E}, G AS (SELECT CAST(q AS INTEGER) AS spacing, t AS target FROM (VALUES (2), (4), (8)) a(q), (VALUES (0.01::DOUBLE), (0.05)) b(t)), N AS (SELECT spacing, target, abs(z - round_even(z / (2 * target), 0) * 2 * target) AS e FROM L, G WHERE row % spacing = 0 AND col % spacing = 0) SELECT spacing, target, count(*) AS nodes, round(max(e), 7) + 0.0 AS most, max(e) <= target * 1.000001 AS held FROM N GROUP BY spacing, target")
def metre_envelope(spark, d):
    """Stored rows of every spacing under every target, quantised, and whether the target holds."""
    grid = spark.sql("SELECT CAST(q AS INT) AS spacing, t AS target FROM (SELECT explode(array(2, 4, 8)) AS q) CROSS JOIN (SELECT explode(array(0.01D, 0.05D)) AS t)")
    n = lattice(spark, d).crossJoin(F.broadcast(grid)).where((F.col("row") % F.col("spacing") == 0) & (F.col("col") % F.col("spacing") == 0))  # six rows, fixed
    e = F.abs(F.col("z") - F.rint(F.col("z") / (2 * F.col("target"))) * 2 * F.col("target"))
    return n.groupBy("spacing", "target").agg(F.count("*").alias("nodes"), rounded(F.max(e), 7).alias("most"), (F.max(e) <= F.first("target") * 1.000001).alias("held"))


@query("bound_allocation", f"{L}, N AS (SELECT *, CASE WHEN row % 8 = 0 AND col % 8 = 0 THEN 8 WHEN row % 4 = 0 AND col % 4 = 0 THEN 4 WHEN row % 2 = 0 AND col % 2 = 0 THEN 2 ELSE 1 END AS level FROM L), W AS (SELECT *, CASE WHEN level >= 4 THEN 12 ELSE 24 END AS half FROM N) SELECT level, CAST(min(half) AS INTEGER) AS half, count(*) AS nodes, CAST(sum(abs(floor((round_even(z / 0.001::DOUBLE, 0) + half) / (2 * half + 1)))) AS BIGINT) AS codes FROM W GROUP BY level")
def bound_allocation(spark, d):
    """A tighter bound on coarse levels, which finer ones are predicted from."""
    r, c = F.col("row"), F.col("col")
    level = F.lit(1)
    for s in (2, 4, 8):
        level = F.when((r % s == 0) & (c % s == 0), s).otherwise(level)
    n = lattice(spark, d).withColumn("level", level).withColumn("half", F.when(F.col("level") >= 4, 12).otherwise(24))
    k = F.floor((F.rint(F.col("z") / 0.001) + F.col("half")) / (2 * F.col("half") + 1))
    return n.groupBy("level").agg(F.min("half").alias("half"), F.count("*").alias("nodes"), F.sum(F.abs(k)).alias("codes"))
