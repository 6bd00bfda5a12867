"""Queries on measured rows, candidates and splits."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.scalar import box_gap, rounded
from ..operators import verdicts
from ..sources.tables import CANDIDATES_SQL, LATTICE_SQL, MEASUREMENTS_SQL, candidates, lattice, measurements, read
from .catalog import query

M, C = f"WITH {MEASUREMENTS_SQL}", f"WITH {CANDIDATES_SQL}"
#: Coders of the first two brands stand for learned ones, the others for conventional ones.
LEARNED_SQL = "(coder LIKE 'Brand#1%')"


def _learned():
    return F.col("coder").startswith("Brand#1")


BEST = f"B AS (SELECT region, bound, arg_min(coder, (bytes, coder)) AS coder, min(bytes) AS bytes, arg_min(loss, (bytes, coder, loss)) AS loss FROM M WHERE NOT {LEARNED_SQL} AND coalesce(violations, 1) = 0 GROUP BY ALL)"


@query("best_conventional", f"{M}, {BEST} SELECT region, bound, coder, bytes FROM B")
def best_conventional(spark, d):
    return verdicts.best_conventional(measurements(spark, d), _learned()).drop("loss")


PAIRS = f"""A1 AS (SELECT region, bound, avg(bytes) AS a FROM M WHERE {LEARNED_SQL} GROUP BY ALL), A2 AS (SELECT region, bound, avg(bytes) AS b FROM M WHERE NOT {LEARNED_SQL} GROUP BY ALL),
 PR AS (SELECT *, ln(a / b) AS r FROM A1 JOIN A2 USING (region, bound)),
 LO AS (SELECT *, (sum(r) OVER (PARTITION BY bound) - r) / nullif(count(*) OVER (PARTITION BY bound) - 1, 0) AS loo FROM PR),
 LR AS (SELECT bound, count(*) AS regions, round(exp(avg(r)), 6) + 0.0 AS ratio, round(exp(min(loo)), 6) + 0.0 AS loo_low, round(exp(max(loo)), 6) + 0.0 AS loo_high, bool_and(a < b) AS all_smaller FROM LO GROUP BY bound)"""


def _pairs(spark, d):
    return verdicts.paired(measurements(spark, d), _learned(), ~_learned())


@query("paired_log_ratio", f"{M}, {PAIRS} SELECT * FROM LR")
def paired_log_ratio(spark, d):
    return verdicts.log_ratio(_pairs(spark, d))


@query("leave_one_region_out", f"{M}, {PAIRS} SELECT region, bound, round(exp(loo), 6) + 0.0 AS ratio FROM LO")
def leave_one_region_out(spark, d):
    r = _pairs(spark, d).withColumn("r", F.log(F.col("a") / F.col("b")))
    w = Window.partitionBy("bound")
    loo = (F.sum("r").over(w) - F.col("r")) / F.nullif(F.count("*").over(w) - 1, F.lit(0))
    return r.withColumn("loo", loo).select("region", "bound", rounded(F.exp("loo")).alias("ratio"))


#: Bootstrap draws.
DRAWS = 400
BOOT = f"""NB AS (SELECT *, row_number() OVER (PARTITION BY bound ORDER BY region) - 1 AS k, count(*) OVER (PARTITION BY bound) AS n FROM LG),
 DR AS (SELECT bound, draw, ('0x' || substr(md5(concat(draw, ':', k)), 1, 8))::BIGINT % n AS k FROM NB, range(0, {DRAWS}) t(draw)),
 MB AS (SELECT DR.bound, draw, avg(r) AS m FROM DR JOIN NB USING (bound, k) GROUP BY ALL),
 BB AS (SELECT bound, exp(quantile_cont(m, 0.025)) AS low, exp(quantile_cont(m, 0.975)) AS high FROM MB GROUP BY bound)"""


@query("bootstrap_ratio", f"{M}, {PAIRS}, LG AS (SELECT bound, region, r FROM PR), {BOOT} SELECT bound, round(exp(avg(r)), 6) + 0.0 AS ratio, round(any_value(low), 6) + 0.0 AS low, round(any_value(high), 6) + 0.0 AS high FROM LG JOIN BB USING (bound) GROUP BY bound")
def bootstrap_ratio(spark, d):
    """The geometric mean ratio for each bound with a percentile bootstrap over regions."""
    logs = _pairs(spark, d).select("bound", "region", F.log(F.col("a") / F.col("b")).alias("r"))
    return verdicts.resampled(logs, DRAWS).select("bound", *(rounded(c).alias(c) for c in ("ratio", "low", "high")))


VERDICT = f"""{BEST}, LE AS (SELECT region, bound, avg(bytes) AS bytes, avg(1 - loss) AS f1 FROM M WHERE {LEARNED_SQL} GROUP BY ALL),
 LB AS (SELECT B.region, B.bound, ln(LE.bytes / B.bytes) AS r, (1 - B.loss) - coalesce(f1, 0) AS lost FROM B LEFT JOIN LE USING (region, bound)), LG AS (SELECT bound, region, r FROM LB WHERE r IS NOT NULL), {BOOT},
 VV AS (SELECT bound, exp(avg(r)) AS ratio, count(r) AS regions, bool_and(r < 0) AS smaller, max(lost) AS lost FROM LB GROUP BY bound HAVING count(r) > 0),
 VD AS (SELECT bound, regions, ratio, high, lost, ratio <= 0.9 AND high < 0.95 AND smaller AND lost <= 0.01 + 1e-12 AS passes FROM VV JOIN BB USING (bound))"""


@query("verdict_per_bound", f"{M}, {VERDICT} SELECT bound, regions, round(ratio, 6) + 0.0 AS ratio, round(high, 6) + 0.0 AS upper, round(lost, 6) + 0.0 AS lost, passes FROM VD")
def verdict_per_bound(spark, d):
    """Learned products against the best conventional one of each region; 1 - loss stands for the streams' score."""
    m = measurements(spark, d).withColumn("f1", 1 - F.col("loss"))
    learned = m.where(_learned()).groupBy("region", "bound").agg(F.avg("bytes").alias("bytes"), F.avg("f1").alias("f1"))
    best = verdicts.best_conventional(m, _learned()).withColumn("f1", 1 - F.col("loss"))
    v = verdicts.judged(learned, best, DRAWS)
    return v.select("bound", "regions", rounded("ratio").alias("ratio"), rounded("high").alias("upper"), rounded("lost").alias("lost"), "passes")


@query("overall_verdict", f"{M}, {VERDICT} SELECT bool_and(passes) AS supported, round(max(ratio), 6) + 0.0 AS worst FROM VD")
def overall_verdict(spark, d):
    return verdict_per_bound(spark, d).agg(F.bool_and("passes").alias("supported"), F.max("ratio").alias("worst"))


@query("paired_differences", f"{M}, {PAIRS} SELECT region, bound, round(a - b, 4) + 0.0 AS difference, round((a - b) / b, 6) + 0.0 AS relative FROM PR")
def paired_differences(spark, d):
    diff = F.col("a") - F.col("b")
    return _pairs(spark, d).select("region", "bound", rounded(diff, 4).alias("difference"), rounded(diff / F.col("b")).alias("relative"))


@query("two_level_means", f"{M}, R AS (SELECT region, coder, avg(bytes) AS bytes FROM M GROUP BY ALL) SELECT coder, count(*) AS regions, round(avg(bytes), 4) + 0.0 AS bytes FROM R GROUP BY coder")
def two_level_means(spark, d):
    return verdicts.by_region(measurements(spark, d), ["region", "coder"], "bytes").groupBy("coder").agg(F.count("*").alias("regions"), rounded(F.avg("bytes"), 4).alias("bytes"))


@query("arm_summaries", f"{M}, R AS (SELECT coder, seed, avg(bytes) AS v FROM M GROUP BY ALL) SELECT coder, round(avg(v), 4) + 0.0 AS mean, round(stddev_samp(v), 4) + 0.0 AS spread, round(median(v), 4) + 0.0 AS median, count(*) AS seeds FROM R GROUP BY coder")
def arm_summaries(spark, d):
    seeds = measurements(spark, d).groupBy("coder", "seed").agg(F.avg("bytes").alias("v"))
    return seeds.groupBy("coder").agg(rounded(F.avg("v"), 4).alias("mean"), rounded(F.stddev_samp("v"), 4).alias("spread"), rounded(F.median("v"), 4).alias("median"), F.count("*").alias("seeds"))


@query("arm_pivot", f"{M} SELECT region, count(*) FILTER (seed = 0) AS s0, count(*) FILTER (seed = 1) AS s1, count(*) FILTER (seed = 2) AS s2 FROM M GROUP BY region")
def arm_pivot(spark, d):
    out = measurements(spark, d).groupBy("region").pivot("seed", [0, 1, 2]).agg(F.count("bytes"))
    return out.select("region", *(F.coalesce(F.col(str(k)), F.lit(0)).alias(f"s{k}") for k in range(3)))


@query("merge_seeds", f"{M}, R AS (SELECT region, coder || '-seed' || seed AS name, avg(bytes) AS v FROM M GROUP BY ALL) SELECT region, regexp_extract(name, '^(.+)-seed[0-9]+$', 1) AS method, round(avg(v), 4) + 0.0 AS mean, round(stddev_pop(v), 4) + 0.0 AS std FROM R GROUP BY ALL")
def merge_seeds(spark, d):
    """Names that end in a seed are one method: the mean and population deviation over seeds."""
    runs = measurements(spark, d).groupBy("region", F.concat("coder", F.lit("-seed"), "seed").alias("name")).agg(F.avg("bytes").alias("v"))
    method = F.regexp_extract("name", "^(.+)-seed[0-9]+$", 1).alias("method")
    return runs.groupBy("region", method).agg(rounded(F.avg("v"), 4).alias("mean"), rounded(F.stddev_pop("v"), 4).alias("std"))


@query(
    "equal_bytes_interp",
    f"""{M}, K AS (SELECT region, bound, avg(bytes) AS x, avg(loss) AS y FROM M WHERE NOT {LEARNED_SQL} GROUP BY ALL),
    S AS (SELECT region, x AS cx, y AS cy, lead(x) OVER w AS nx, lead(y) OVER w AS ny, max(x) OVER (PARTITION BY region) AS top FROM K WINDOW w AS (PARTITION BY region ORDER BY x)),
    Q AS (SELECT region, bound, avg(bytes) AS x FROM M WHERE {LEARNED_SQL} GROUP BY ALL)
    SELECT Q.region, bound, round(cy + (ln(x) - ln(cx)) / (ln(nx) - ln(cx)) * (ny - cy), 6) + 0.0 AS y FROM Q JOIN S ON Q.region = S.region AND x >= cx AND (x < nx OR (x = nx AND nx = top))""",
)
def equal_bytes_interp(spark, d):
    """The conventional curve's loss at a learned product's bytes, where the curve reaches them."""
    m = measurements(spark, d)
    curve = m.where(~_learned()).groupBy("region", "bound").agg(F.avg("bytes").alias("cx"), F.avg("loss").alias("cy")).drop("bound")
    points = m.where(_learned()).groupBy("region", "bound").agg(F.avg("bytes").alias("x"))
    return verdicts.interpolated(points, curve, "region").select("region", "bound", rounded("y").alias("y"))


@query("amortisation_breakeven", f"{M}, {PAIRS} SELECT region, round(avg(b - a), 4) + 0.0 AS gain, CAST(CASE WHEN avg(b - a) > 0 THEN ceil(100000 / avg(b - a)) END AS BIGINT) AS fields FROM PR GROUP BY region")
def amortisation_breakeven(spark, d):
    gain = F.avg(F.col("b") - F.col("a"))
    return _pairs(spark, d).groupBy("region").agg(rounded(gain, 4).alias("gain"), verdicts.break_even(gain, F.lit(100000)).alias("fields"))


@query("amortisation_sizes", f"{M}, {PAIRS}, T AS (SELECT sum(a) AS a, sum(b) AS b FROM PR) SELECT CAST(n AS INTEGER) AS corpus, round((100000 + n * a) / (n * b), 6) + 0.0 AS ratio FROM T, (VALUES (1), (10), (100), (1000)) AS s(n)")
def amortisation_sizes(spark, d):
    """Bytes of the learned side with its model, against the other, for corpora of several sizes."""
    t = _pairs(spark, d).agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    n = F.col("corpus")
    sizes = t.withColumn("corpus", F.explode(F.array(*map(F.lit, (1, 10, 100, 1000)))))
    return sizes.select("corpus", rounded((100000 + n * F.col("a")) / (n * F.col("b"))).alias("ratio"))


@query("amortisation_crossover", "SELECT p_partkey AS id, CAST(CASE WHEN p_size > 20 AND 50000 / (p_size - 20.0::DOUBLE) >= 1 THEN ceil(50000 / (p_size - 20.0::DOUBLE)) END AS BIGINT) AS fields FROM part")
def amortisation_crossover(spark, d):
    at = 50000 / (F.col("p_size") - F.lit(20.0))
    return read(spark, d, "part").select(F.col("p_partkey").alias("id"), F.when((F.col("p_size") > 20) & (at >= 1), F.ceil(at)).alias("fields"))


@query("sensitivity_cube", f"{M} SELECT coder, bound, seed, count(*) AS n, max(bytes) AS worst, round(avg(loss), 6) + 0.0 AS gap FROM M WHERE bound <= 3 GROUP BY CUBE (coder, bound, seed)")
def sensitivity_cube(spark, d):
    return measurements(spark, d).where("bound <= 3").cube("coder", "bound", "seed").agg(F.count("*").alias("n"), F.max("bytes").alias("worst"), rounded(F.avg("loss")).alias("gap"))


@query("region_rollup", f"{M} SELECT region, bound, count(*) AS n, CAST(sum(bytes) AS BIGINT) AS bytes FROM M GROUP BY ROLLUP (region, bound)")
def region_rollup(spark, d):
    return measurements(spark, d).rollup("region", "bound").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"))


@query("grouping_sets", f"{M} SELECT region, coder, count(*) AS n FROM M GROUP BY GROUPING SETS ((region), (coder), ())")
def grouping_sets(spark, d):
    measurements(spark, d).createOrReplaceTempView("gridloom_measurements")
    return spark.sql("SELECT region, coder, count(*) AS n FROM gridloom_measurements GROUP BY GROUPING SETS ((region), (coder), ())")


@query("pareto_front", f"{C}, S AS (SELECT *, min(mae) OVER (PARTITION BY package ORDER BY bytes, mae, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM C WHERE mae IS NOT NULL) SELECT package, id, bytes, mae FROM S WHERE m IS NULL OR mae < m")
def pareto_front(spark, d):
    return verdicts.staircase(candidates(spark, d).where("mae IS NOT NULL"), ["package"], "bytes", "mae", "id").select("package", "id", "bytes", "mae")


@query(
    "dominated_by",
    f"""{C}, F0 AS (SELECT * FROM C WHERE mae IS NOT NULL AND worst IS NOT NULL AND id <= 1500), H AS (SELECT a.id, min(b.id) AS dominated_by FROM F0 a JOIN F0 b ON a.package = b.package AND b.bytes <= a.bytes AND b.mae <= a.mae AND b.worst <= a.worst
    AND (b.bytes < a.bytes OR b.mae < a.mae OR b.worst < a.worst) GROUP BY a.id) SELECT C.id, dominated_by FROM C LEFT JOIN H USING (id)""".replace(" AND id <= 1500", ""),
)
def dominated_by(spark, d):
    return verdicts.dominated(candidates(spark, d)).select("id", "dominated_by")


@query("best_at_or_below", f"{C} SELECT a.id, (SELECT arg_min(b.id, (b.mae, b.bytes, b.id)) FROM C b WHERE b.package = a.package AND b.bytes <= a.bytes AND b.mae IS NOT NULL) AS best FROM C a")
def best_at_or_below(spark, d):
    return verdicts.best_at_or_below(candidates(spark, d)).select("id", "best")


@query(
    "finalists",
    f"""{C}, K AS (SELECT *, row_number() OVER (PARTITION BY family ORDER BY bytes, id) AS cheap, row_number() OVER (PARTITION BY family ORDER BY mae NULLS LAST, id) AS good FROM C WHERE mae IS NOT NULL)
    SELECT family, id, bytes, mae, CAST(least(cheap, good) AS INTEGER) AS place FROM K WHERE cheap = 1 OR good = 1 ORDER BY least(cheap, good), bytes, id LIMIT 30""",
)
def finalists(spark, d):
    """The cheapest and the most accurate of each family, cut to thirty."""
    w = Window.partitionBy("family")
    k = candidates(spark, d).where("mae IS NOT NULL").withColumns({"cheap": F.row_number().over(w.orderBy("bytes", "id")), "good": F.row_number().over(w.orderBy("mae", "id"))})
    best = k.where("cheap = 1 OR good = 1").withColumn("place", F.least("cheap", "good"))
    return best.orderBy("place", "bytes", "id").limit(30).select("family", "id", "bytes", "mae", "place")


@query("matched_bytes_report", f"{C}, B AS (SELECT a.id, a.mae, (SELECT min(b.mae) FROM C b WHERE b.package = a.package AND b.bytes <= a.bytes AND b.family NOT LIKE 'Brand#1%') AS rival FROM C a WHERE a.family LIKE 'Brand#1%' AND a.mae IS NOT NULL) SELECT count(*) AS n, count(*) FILTER (rival < mae) AS below, round(max(rival - mae), 4) + 0.0 AS largest_gain FROM B")
def matched_bytes_report(spark, d):
    """Learned rows against the best conventional row of no more bytes."""
    own = Window.partitionBy("package", "__range").orderBy("bytes").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    learned = F.col("family").startswith("Brand#1")
    held = verdicts.ranged(candidates(spark, d), ["package"], "bytes")
    c = verdicts.least_before(held, ["package"], F.when(~learned, F.col("mae")), own).withColumnRenamed("__before", "rival").where(learned & F.col("mae").isNotNull())
    return c.agg(F.count("*").alias("n"), F.count_if(F.col("rival") < F.col("mae")).alias("below"), rounded(F.max(F.col("rival") - F.col("mae")), 4).alias("largest_gain"))


@query(
    "spearman_ties",
    f"""{M}, K AS (SELECT region, coder, avg(loss) AS a, avg(violations) AS b FROM M GROUP BY ALL),
    R AS (SELECT region, rank() OVER (PARTITION BY region ORDER BY a) + (count(*) OVER (PARTITION BY region, a) - 1) / 2 AS ra, rank() OVER (PARTITION BY region ORDER BY b) + (count(*) OVER (PARTITION BY region, b) - 1) / 2 AS rb FROM K)
    SELECT region, count(*) AS n, CASE WHEN count(*) >= 3 AND stddev_pop(ra) > 0 AND stddev_pop(rb) > 0 THEN round(corr(ra, rb), 6) + 0.0 END AS rho FROM R GROUP BY region""",
)
def spearman_ties(spark, d):
    """Rank correlation with averaged ties; null for fewer than three rows or no spread."""
    k = measurements(spark, d).groupBy("region", "coder").agg(F.avg("loss").alias("a"), F.avg("violations").alias("b"))
    rank = lambda c: F.rank().over(Window.partitionBy("region").orderBy(c)) + (F.count("*").over(Window.partitionBy("region", c)) - 1) / 2
    r = k.withColumns({"ra": rank("a"), "rb": rank("b")})
    ok = (F.count("*") >= 3) & (F.stddev_pop("ra") > 0) & (F.stddev_pop("rb") > 0)
    return r.groupBy("region").agg(F.count("*").alias("n"), F.when(ok, rounded(F.corr("ra", "rb"))).alias("rho"))


@query("cohort_quota", "WITH K AS (SELECT s_suppkey AS id, s_nationkey % 3 AS stratum, sha256(concat('salt:', s_suppkey, ':', s_nationkey)) AS rank FROM supplier), R AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY rank) AS k, row_number() OVER (ORDER BY rank) AS place FROM K), L AS (SELECT max(place) AS stop FROM R WHERE k <= 5) SELECT id, CAST(stratum AS INTEGER) AS stratum, CASE WHEN k <= 5 THEN 'taken' ELSE 'full' END AS outcome FROM R, L WHERE place <= stop")
def cohort_quota(spark, d):
    """Candidates in order of a salted hash, five of each stratum; the walk ends at the last one taken.
    The stop is a maximum over those taken, so no candidate is ranked among all."""
    k = read(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), (F.col("s_nationkey") % 3).alias("stratum"), F.sha2(F.concat(F.lit("salt:"), "s_suppkey", F.lit(":"), "s_nationkey"), 256).alias("rank"))
    r = k.withColumn("k", F.row_number().over(Window.partitionBy("stratum").orderBy("rank")))
    stop = r.where("k <= 5").agg(F.max("rank").alias("stop"))
    return r.join(F.broadcast(stop), F.col("rank") <= F.col("stop")).select("id", "stratum", F.when(F.col("k") <= 5, "taken").otherwise("full").alias("outcome"))  # one row


@query("splits", f"WITH {LATTICE_SQL} SELECT DISTINCT region, CAST(row // 8 AS INTEGER) AS y, CAST(col // 8 AS INTEGER) AS x, CASE WHEN row // 8 >= 6 AND col // 8 >= 6 THEN 'corner' WHEN (row // 8 + col // 8) % 2 = 1 THEN 'test' WHEN row // 8 % 2 = 0 THEN 'train' ELSE 'validation' END AS role FROM L")
def splits(spark, d):
    """A checkerboard of a field's pages with a held corner, which wins; the rest by row parity."""
    at = lambda c: F.floor(F.col(c) / 8).cast("int")
    p = lattice(spark, d).select("region", at("row").alias("y"), at("col").alias("x")).distinct()
    role = F.when((F.col("y") >= 6) & (F.col("x") >= 6), "corner").when((F.col("y") + F.col("x")) % 2 == 1, "test").when(F.col("y") % 2 == 0, "train").otherwise("validation")
    return p.withColumn("role", role)


@query("folds", "SELECT n_name AS held, coalesce(lead(n_name) OVER (ORDER BY n_name), (SELECT min(n_name) FROM nation)) AS validation FROM nation")
def folds(spark, d):
    """Each region is held once; the next one validates, around the end."""
    n = read(spark, d, "nation").select(F.col("n_name").alias("held"))
    w = Window.orderBy("held")  # a row for each region: a dimension table
    return n.withColumn("validation", F.coalesce(F.lead("held").over(w), F.first("held").over(w)))


@query("train_rows", f"{M}, H AS (SELECT min(region) AS held FROM M) SELECT DISTINCT region FROM M EXCEPT SELECT held FROM H")
def train_rows(spark, d):
    regions = measurements(spark, d).select("region").distinct()
    return regions.exceptAll(regions.agg(F.min("region").alias("region")))


@query("regions_in_all_arms", f"{M} SELECT region FROM M WHERE violations = 0 GROUP BY region HAVING count(DISTINCT coder) = (SELECT count(DISTINCT coder) FROM M)")
def regions_in_all_arms(spark, d):
    m = measurements(spark, d)
    arms = m.agg(F.countDistinct("coder").alias("arms"))
    own = m.where("violations = 0").groupBy("region").agg(F.countDistinct("coder").alias("n"))
    return own.join(F.broadcast(arms), F.col("n") == F.col("arms")).select("region")  # one row


@query("region_intersection", f"{M} (SELECT region FROM M WHERE seed = 0 AND bytes > 90000) INTERSECT (SELECT region FROM M WHERE seed = 1 AND bytes > 90000)")
def region_intersection(spark, d):
    m = measurements(spark, d)
    return m.where("seed = 0 AND bytes > 90000").select("region").intersect(m.where("seed = 1 AND bytes > 90000").select("region"))


@query("union_families", f"{C} SELECT id, bytes, mae, NULL::VARCHAR AS family FROM C WHERE package = 'pyramid' UNION ALL SELECT id, bytes, NULL::DOUBLE AS mae, family FROM C WHERE package <> 'pyramid'")
def union_families(spark, d):
    c = candidates(spark, d)
    return c.where("package = 'pyramid'").select("id", "bytes", "mae").unionByName(c.where("package <> 'pyramid'").select("id", "bytes", "family"), allowMissingColumns=True)


@query("configuration_grid", f"WITH R AS (SELECT DISTINCT n_name AS region FROM nation) SELECT region, CAST(f AS INTEGER) AS factor, CAST(s AS INTEGER) AS seed FROM R, (VALUES (2), (4), (8)) a(f), range(0, 3) b(s)")
def configuration_grid(spark, d):
    grid = spark.sql("SELECT CAST(f AS INT) AS factor, CAST(s.id AS INT) AS seed FROM (SELECT explode(array(2, 4, 8)) AS f) CROSS JOIN range(3) s")
    return read(spark, d, "nation").select(F.col("n_name").alias("region")).distinct().crossJoin(F.broadcast(grid))  # nine rows, fixed


@query("scaling_efficiency", f"{M}, S AS (SELECT region, bound AS workers, sum(bytes) AS t FROM M GROUP BY ALL) SELECT s.region, s.workers, round(o.t / (s.workers * s.t), 6) + 0.0 AS strong, round(o.t / s.t, 6) + 0.0 AS weak FROM S s JOIN S o ON s.region = o.region AND o.workers = 1")
def scaling_efficiency(spark, d):
    s = measurements(spark, d).groupBy("region", F.col("bound").alias("workers")).agg(F.sum("bytes").alias("t"))
    one = s.where("workers = 1").select("region", F.col("t").alias("t1"))
    return s.join(one, "region").select("region", "workers", rounded(F.col("t1") / (F.col("workers") * F.col("t"))).alias("strong"), rounded(F.col("t1") / F.col("t")).alias("weak"))


@query("seed_confirmation", f"{M}, U AS (SELECT coder, seed, 'bytes' AS metric, avg(bytes) AS v FROM M GROUP BY ALL UNION ALL SELECT coder, seed, 'loss', avg(loss) FROM M GROUP BY ALL) SELECT coder, metric, round(median(v), 6) + 0.0 AS median, round(min(v), 6) + 0.0 AS low, round(max(v), 6) + 0.0 AS high, round(max(v) - min(v), 6) + 0.0 AS spread FROM U GROUP BY ALL")
def seed_confirmation(spark, d):
    means = measurements(spark, d).groupBy("coder", "seed").agg(F.avg("bytes").alias("bytes"), F.avg("loss").alias("loss"))
    u = means.unpivot(["coder", "seed"], ["bytes", "loss"], "metric", "v")
    return u.groupBy("coder", "metric").agg(rounded(F.median("v")).alias("median"), rounded(F.min("v")).alias("low"), rounded(F.max("v")).alias("high"), rounded(F.max("v") - F.min("v")).alias("spread"))


@query("run_selection", f"{M}, R AS (SELECT region, coder, seed, bound, avg(loss) AS mae, max(bytes) AS top FROM M GROUP BY ALL) SELECT region, arg_min(coder, (round(mae, 9), bound, seed, coder)) AS coder, bool_or(bound = 7) AS at_cap FROM R WHERE top > 20000 GROUP BY region")
def run_selection(spark, d):
    """The run with the lowest loss, ties to fewer steps, then the lower seed; collapsed runs are left out."""
    r = measurements(spark, d).groupBy("region", "coder", "seed", "bound").agg(F.avg("loss").alias("mae"), F.max("bytes").alias("top")).where("top > 20000")
    best = F.min(F.struct(F.round("mae", 9), "bound", "seed", "coder")).alias("b")
    return r.groupBy("region").agg(best, F.bool_or(F.col("bound") == 7).alias("at_cap")).select("region", F.col("b.coder").alias("coder"), "at_cap")


@query("gates", f"{M}, {PAIRS}, G AS (SELECT bound, avg((b - a) / b) AS gain, avg(CASE WHEN a < b THEN 1.0 ELSE 0.0 END) AS share FROM PR GROUP BY bound) SELECT CAST(k AS INTEGER) AS bound, CASE WHEN gain IS NULL THEN 'not-run' WHEN gain >= 0.05 AND share >= 0.5 THEN 'pass' ELSE 'fail' END AS state FROM range(1, 10) AS r(k) LEFT JOIN G ON G.bound = k")
def gates(spark, d):
    g = _pairs(spark, d).groupBy("bound").agg(F.avg((F.col("b") - F.col("a")) / F.col("b")).alias("gain"), F.avg((F.col("a") < F.col("b")).cast("double")).alias("share"))
    bounds = spark.range(1, 10).select(F.col("id").cast("int").alias("bound"))
    state = F.when(F.col("gain").isNull(), "not-run").when((F.col("gain") >= 0.05) & (F.col("share") >= 0.5), "pass").otherwise("fail")
    return bounds.join(g, "bound", "left").select("bound", state.alias("state"))


@query("error_budget", f"{M}, R AS (SELECT bound, avg(loss) AS e FROM M GROUP BY bound) SELECT CAST(b AS DOUBLE) AS budget, max(CASE WHEN e <= b THEN bound END) AS largest FROM R, (VALUES (0.049), (0.05), (0.0505), (0.01)) AS t(b) GROUP BY b")
def error_budget(spark, d):
    r = measurements(spark, d).groupBy("bound").agg(F.avg("loss").alias("e"))
    budgets = r.withColumn("budget", F.explode(F.array(*map(F.lit, (0.049, 0.05, 0.0505, 0.01)))))
    return budgets.groupBy("budget").agg(F.max(F.when(F.col("e") <= F.col("budget"), F.col("bound"))).alias("largest"))


@query("io_summaries", f"{M} SELECT coder, bound, round(median(bytes), 4) + 0.0 AS mid, round(quantile_cont(bytes, 0.25), 4) + 0.0 AS q1, round(quantile_cont(bytes, 0.75), 4) + 0.0 AS q3 FROM M GROUP BY ALL")
def io_summaries(spark, d):
    p = F.percentile("bytes", F.array(F.lit(0.25), F.lit(0.75)))
    g = measurements(spark, d).groupBy("coder", "bound").agg(F.median("bytes").alias("mid"), p.alias("p"))
    return g.select("coder", "bound", rounded("mid", 4).alias("mid"), rounded(F.get("p", F.lit(0)), 4).alias("q1"), rounded(F.get("p", F.lit(1)), 4).alias("q3"))


@query("layout_decision", f"{M}, S AS (SELECT bound, median(bytes) FILTER (seed = 0) / median(bytes) FILTER (seed = 1) AS speed_up FROM M GROUP BY bound) SELECT bound, round(speed_up, 6) + 0.0 AS speed_up, CASE WHEN speed_up >= 3 THEN 'adopt' WHEN speed_up >= 1.5 THEN 'useful' ELSE 'no case' END AS decision FROM S")
def layout_decision(spark, d):
    med = lambda k: F.median(F.when(F.col("seed") == k, F.col("bytes")))
    s = measurements(spark, d).groupBy("bound").agg((med(0) / med(1)).alias("speed_up"))
    return s.select("bound", rounded("speed_up").alias("speed_up"), F.when(F.col("speed_up") >= 3, "adopt").when(F.col("speed_up") >= 1.5, "useful").otherwise("no case").alias("decision"))


@query("qualification", "SELECT user_id % 20 AS host, bool_and(value < 450) AS qualified, string_agg(event_type, ',' ORDER BY event_type, event_id) FILTER (value >= 450) AS reasons FROM events WHERE event_id < 2000 GROUP BY ALL".replace(" WHERE event_id < 2000", ""))
def qualification(spark, d):
    """Hosts whose every reading is below the ceiling, and what spoke against the others."""
    e = read(spark, d, "events").groupBy((F.col("user_id") % 20).alias("host"))
    bad = F.sort_array(F.collect_list(F.when(F.col("value") >= 450, F.struct("event_type", "event_id"))))
    reasons = F.transform(bad, lambda x: x["event_type"])
    return e.agg(F.bool_and(F.col("value") < 450).alias("qualified"), F.when(F.size(reasons) > 0, F.array_join(reasons, ",")).alias("reasons"))


@query("preferred_report", "SELECT o_custkey AS name, o_orderkey AS source, o_orderpriority AS preference FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority, o_orderkey) = 1")
def preferred_report(spark, d):
    best = F.min(F.struct("o_orderpriority", "o_orderkey")).alias("b")
    return read(spark, d, "orders").groupBy(F.col("o_custkey").alias("name")).agg(best).select("name", F.col("b.o_orderkey").alias("source"), F.col("b.o_orderpriority").alias("preference"))


@query("byte_buckets", "WITH K AS (SELECT CASE WHEN source LIKE '%1' THEN 'model' WHEN source LIKE '%2' THEN 'index' WHEN lang = 'en' THEN 'payload' WHEN lang IN ('de', 'fr') THEN 'metadata' ELSE 'unclassified' END AS bucket, n_chars FROM documents) SELECT bucket, count(*) AS files, CAST(sum(n_chars) AS BIGINT) AS bytes FROM K GROUP BY bucket")
def byte_buckets(spark, d):
    """Files by rule into buckets; what no rule takes is a bucket that has to be empty to publish."""
    rule = F.when(F.col("source").endswith("1"), "model").when(F.col("source").endswith("2"), "index").when(F.col("lang") == "en", "payload").when(F.col("lang").isin("de", "fr"), "metadata").otherwise("unclassified")
    return read(spark, d, "documents").groupBy(rule.alias("bucket")).agg(F.count("*").alias("files"), F.sum("n_chars").alias("bytes"))


@query("content_dedup", "SELECT sha256(text) AS sha256, min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY ALL")
def content_dedup(spark, d):
    return read(spark, d, "documents").groupBy(F.sha2("text", 256).alias("sha256")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))


@query("canonical_digest", "SELECT p_partkey AS id, sha256('{\"brand\":\"' || p_brand || '\",\"size\":' || p_size || '}') AS sha256 FROM part")
def canonical_digest(spark, d):
    """A row's digest over its JSON with keys in order."""
    return read(spark, d, "part").select(F.col("p_partkey").alias("id"), F.sha2(F.to_json(F.struct(F.col("p_brand").alias("brand"), F.col("p_size").alias("size"))), 256).alias("sha256"))


@query(
    "buffered_lattice",
    """WITH K AS (SELECT c_custkey AS id, (c_custkey % 100) * 20 AS x, (c_custkey // 100) * 20 AS y FROM customer), P AS (SELECT (s_suppkey * 37) % 2000 AS w, (s_suppkey * 53) % 2000 AS s, (s_suppkey * 37) % 2000 + 30 AS e, (s_suppkey * 53) % 2000 + 20 AS n FROM supplier)
    SELECT id, x, y FROM K WHERE NOT EXISTS (SELECT 1 FROM P WHERE sqrt(pow(greatest(0, w - (x + 10), x - e), 2) + pow(greatest(0, s - (y + 10), y - n), 2)) < 15)""",
)
def buffered_lattice(spark, d):
    """Customers' tiles that keep a distance to every supplier's box. A box is put into the cells of a grid from which tiles come near it."""
    c, s = F.col("c_custkey"), F.col("s_suppkey")
    k = read(spark, d, "customer").select(c.alias("id"), (c % 100 * 20).alias("x"), (F.floor(c / 100) * 20).alias("y"))
    boxes = read(spark, d, "supplier").select((s * 37 % 2000).alias("w"), (s * 53 % 2000).alias("s")).withColumns({"e": F.col("w") + 30, "n": F.col("s") + 20})
    cells = lambda lo, hi: F.explode(F.sequence(F.floor((F.col(lo) - 25) / 100), F.floor((F.col(hi) + 15) / 100)))
    boxes = boxes.withColumn("cx", cells("w", "e")).withColumn("cy", cells("s", "n"))
    k = k.withColumns({"kx": F.floor(F.col("x") / 100), "ky": F.floor(F.col("y") / 100)})
    gap = box_gap((F.col("x"), F.col("y"), F.col("x") + 10, F.col("y") + 10), tuple(F.col(v) for v in "wsen"))
    return k.join(boxes, (F.col("kx") == F.col("cx")) & (F.col("ky") == F.col("cy")) & (gap < 15), "left_anti").select("id", "x", "y")


@query("binomial_tail", "WITH R AS (SELECT o_custkey AS id, count(*) AS n, count(*) FILTER (o_orderstatus = 'F') AS k FROM orders GROUP BY 1) SELECT id, n, k, round(list_sum(list_transform(range(k, n + 1), lambda j: (factorial(n::INTEGER) // (factorial(j::INTEGER) * factorial((n - j)::INTEGER)))::DOUBLE)) / pow(2, n), 9) + 0.0 AS p FROM R")
def binomial_tail(spark, d):
    """Of a customer's orders, how likely as many or more are filled as are, were it even: P(X >= k) of n fair trials."""
    r = read(spark, d, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.count("*").alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("k"))
    n, k = F.col("n"), F.col("k")
    up_to_k = F.when(k > 0, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<bigint>"))

    def tail(first, step, last):
        start = F.struct(F.lit(0.0).alias("total"), F.aggregate(up_to_k, first, step).alias("term"))
        following = lambda a, j: F.struct((a["total"] + last(a["term"])).alias("total"), step(a["term"], j + 1).alias("term"))
        return F.aggregate(F.sequence(k, n), start, following, lambda a: a["total"])

    # counts are exact in doubles for some fifty trials, and finite for a thousand; beyond that logarithms
    ratio = lambda i: (n - i + 1).cast("double") / i
    exact = tail(F.lit(1.0), lambda c, i: c * (n - i + 1) / i, lambda c: c) / F.pow(F.lit(2.0), n)
    logs = tail(-n * F.log(F.lit(2.0)), lambda c, i: c + F.log(F.when(ratio(i) > 0, ratio(i)).otherwise(1e-300)), F.exp)
    total = F.when(n <= 1000, exact).otherwise(logs)
    return r.select("id", "n", "k", rounded(total, 9).alias("p"))


@query("settled_time", "WITH R AS (SELECT o_custkey % 50 AS run, CAST(date_trunc('month', o_orderdate) AS DATE) AS t, sum(o_totalprice) AS rate FROM orders GROUP BY ALL), N AS (SELECT *, lead(t) OVER (PARTITION BY run ORDER BY t) AS nt FROM R), H AS (SELECT run, max(t) AS last FROM R WHERE rate >= 300000 GROUP BY run), A AS (SELECT DISTINCT run FROM R) SELECT A.run, (SELECT max(nt) FROM N WHERE N.run = A.run AND N.t = H.last) AS settled FROM A LEFT JOIN H USING (run)")
def settled_time(spark, d):
    """The first time after the last rate at or over the threshold; null if none or never."""
    r = read(spark, d, "orders").groupBy((F.col("o_custkey") % 50).alias("run"), F.to_date(F.date_trunc("month", "o_orderdate")).alias("t")).agg(F.sum("o_totalprice").alias("rate"))
    n = r.withColumn("nt", F.lead("t").over(Window.partitionBy("run").orderBy("t")))
    last = F.max(F.when(F.col("rate") >= 300000, F.struct("t", "nt")))
    return n.groupBy("run").agg(last.alias("l")).select("run", F.col("l.nt").alias("settled"))


@query("binned_log_fit", "WITH K AS (SELECT log10(o_totalprice) AS x, log10(o_custkey + 1) AS y FROM orders WHERE o_totalprice > 0), R AS (SELECT min(x) AS a, max(x) AS b FROM K), B AS (SELECT least(floor((x - a) / ((b - a) / 12)), 11) AS bin, median(x) AS mx, median(y) AS my, count(*) AS n FROM K, R GROUP BY 1) SELECT count(*) AS bins, round(regr_slope(my, mx), 6) + 0.0 AS slope, round(regr_intercept(my, mx), 5) + 0.0 AS intercept FROM B WHERE n >= 5")
def binned_log_fit(spark, d):
    """A power law: medians in bins of equal width in the logarithm, and a line through them."""
    k = read(spark, d, "orders").where("o_totalprice > 0").select(F.log10("o_totalprice").alias("x"), F.log10(F.col("o_custkey") + 1).alias("y"))
    k = k.crossJoin(F.broadcast(k.agg(F.min("x").alias("a"), F.max("x").alias("b"))))  # one row
    b = k.groupBy(F.least(F.floor((F.col("x") - F.col("a")) / ((F.col("b") - F.col("a")) / 12)), F.lit(11)).alias("bin")).agg(F.median("x").alias("mx"), F.median("y").alias("my"), F.count("*").alias("n"))
    return b.where("n >= 5").agg(F.count("*").alias("bins"), rounded(F.regr_slope("my", "mx")).alias("slope"), rounded(F.regr_intercept("my", "mx"), 5).alias("intercept"))


@query("code_coverage", f"{M}, T AS (SELECT count(DISTINCT (region, coder)) AS tiles FROM M) SELECT seed, count(DISTINCT (region, coder)) AS seen, round(count(DISTINCT (region, coder)) / any_value(tiles), 6) AS share FROM M, T WHERE bytes > 95000 GROUP BY seed")
def code_coverage(spark, d):
    """Tiles that a split visits, over all tiles."""
    m = measurements(spark, d)
    tiles = m.agg(F.countDistinct("region", "coder").alias("tiles"))
    seen = m.where("bytes > 95000").groupBy("seed").agg(F.countDistinct("region", "coder").alias("seen"))
    return seen.crossJoin(F.broadcast(tiles)).select("seed", "seen", rounded(F.col("seen") / F.col("tiles")).alias("share"))  # one row


@query("bits_per_sample", f"{M} SELECT region, coder, round(sum(bytes) * 8 / (count(*) * 4096), 6) + 0.0 AS bits, round(sum(bytes) / min(bytes) - count(*), 6) + 0.0 AS overhead FROM M GROUP BY ALL")
def bits_per_sample(spark, d):
    return measurements(spark, d).groupBy("region", "coder").agg(rounded(F.sum("bytes") * 8 / (F.count("*") * 4096)).alias("bits"), rounded(F.sum("bytes") / F.min("bytes") - F.count("*")).alias("overhead"))


@query("ensemble_split", "WITH K AS (SELECT p_partkey AS id, ln(p_size + 1) AS a, ln(p_retailprice) AS b FROM part), R AS (SELECT min(a) a0, max(a) a1, min(b) b0, max(b) b1 FROM K), S AS (SELECT id, a, round((a - a0) / (a1 - a0) + (b - b0) / (b1 - b0), 9) AS s FROM K, R), Q AS (SELECT round(quantile_cont(s, 0.9), 9) AS q FROM S), O AS (SELECT id, row_number() OVER (ORDER BY a, id) AS k FROM S, Q WHERE s < q) SELECT S.id, CASE WHEN s >= q THEN 'test' WHEN k % 5 = 0 THEN 'validation' ELSE 'train' END AS role FROM S CROSS JOIN Q LEFT JOIN O ON S.id = O.id")
def ensemble_split(spark, d):
    """The far corner of the parameters is the test; of the rest in order each fifth validates."""
    k = read(spark, d, "part").select(F.col("p_partkey").alias("id"), F.log(F.col("p_size") + 1).alias("a"), F.log("p_retailprice").alias("b"))
    r = k.agg(*(f(c).alias(n) for c in "ab" for f, n in ((F.min, f"{c}0"), (F.max, f"{c}1"))))
    s = k.crossJoin(F.broadcast(r)).withColumn("s", F.round((F.col("a") - F.col("a0")) / (F.col("a1") - F.col("a0")) + (F.col("b") - F.col("b0")) / (F.col("b1") - F.col("b0")), 9))  # one row
    s = s.crossJoin(F.broadcast(s.agg(F.round(F.percentile("s", F.lit(0.9)), 9).alias("q"))))  # one row
    rest = s.where("s < q")
    # ranks over all rows, without a single task: counts by value first, then a rank within a value
    counts = rest.groupBy("a").agg(F.count("*").alias("n"))
    begins = counts.withColumn("begin", F.coalesce(F.sum("n").over(Window.orderBy("a").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    ranked = rest.withColumn("j", F.row_number().over(Window.partitionBy("a").orderBy("id"))).join(begins, "a")
    role = F.when((F.col("begin") + F.col("j")) % 5 == 0, "validation").otherwise("train")
    return ranked.select("id", role.alias("role")).union(s.where("s >= q").select("id", F.lit("test").alias("role")))
