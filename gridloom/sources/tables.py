"""Relations that the driver tables stand in for: fields, measurements, candidates, points, epochs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SIDE = 64
STEP = 0.05


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lattice(spark: SparkSession, sf_dir: str, side: int = SIDE) -> DataFrame:
    """(region, row, col, z): `side` vectors are the rows of a region; an unfinished region is left out."""
    vectors = read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    whole = vectors.agg((F.expr(f"(max(vec_id) + 1) div {side}") * side).alias("__end"))
    rows = vectors.join(F.broadcast(whole), F.col("vec_id") < F.col("__end"))  # one row
    return rows.select(
        F.expr(f"vec_id div {side}").alias("region"),
        (F.col("vec_id") % side).cast("int").alias("row"),
        F.posexplode(F.slice("embedding", 1, side)).alias("col", "z"),
    ).withColumn("z", F.col("z").cast("double"))


LATTICE_SQL = f"""L AS (SELECT vec_id // {SIDE} AS region, CAST(vec_id % {SIDE} AS INTEGER) AS row, CAST(i - 1 AS INTEGER) AS col,
 CAST(embedding[i] AS DOUBLE) AS z FROM embeddings, range(1, {SIDE + 1}) AS t(i)
 WHERE vec_id < (SELECT (max(vec_id) + 1) // {SIDE} * {SIDE} FROM embeddings))"""


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fields with their last row and column repeated: 65 nodes a side, as pages of 8 intervals and
    pyramids of two need them, so that no node of the lattice is left out."""
    repeated = lambda c: F.explode(F.when(F.col(c) == SIDE - 1, F.array(F.lit(SIDE - 1), F.lit(SIDE))).otherwise(F.array(F.col(c))))
    return lattice(spark, sf_dir).withColumn("row", repeated("row")).withColumn("col", repeated("col"))


NODES_SQL = f"""LN AS (SELECT region, CAST(row + a AS INTEGER) AS row, CAST(col + b AS INTEGER) AS col, z FROM L, range(0, 2) p(a), range(0, 2) q(b)
 WHERE (a = 0 OR row = {SIDE - 1}) AND (b = 0 OR col = {SIDE - 1}))"""


def estimate(cells: DataFrame, step: float = STEP) -> DataFrame:
    """cells with e, the height on a uniform quantiser (half to even)."""
    return cells.withColumn("e", F.rint(F.col("z") / step) * step)


ESTIMATE_SQL = f"""E AS (SELECT *, CAST(round_even(z / CAST({STEP} AS DOUBLE), 0) AS DOUBLE) * CAST({STEP} AS DOUBLE) AS e FROM L)"""


def measurements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(region, coder, bound, seed, bytes, violations): a row per measured product."""
    line, part, supplier, nation = (read(spark, sf_dir, t) for t in ("lineitem", "part", "supplier", "nation"))
    named = supplier.join(nation, supplier["s_nationkey"] == nation["n_nationkey"]).select("s_suppkey", F.col("n_name").alias("region"))
    kinds = part.select("p_partkey", F.col("p_brand").alias("coder"))
    rows = line.join(kinds, line["l_partkey"] == kinds["p_partkey"]).join(named, line["l_suppkey"] == named["s_suppkey"])
    return rows.select(
        "region", "coder", F.col("l_linenumber").alias("bound"), (F.col("l_orderkey") % 3).cast("int").alias("seed"),
        F.round(F.col("l_extendedprice")).cast("bigint").alias("bytes"), F.when(F.col("l_quantity") > 45, 1).otherwise(0).alias("violations"),
        F.round(F.col("l_discount"), 2).alias("loss"),
    )


MEASUREMENTS_SQL = """M AS (SELECT n_name AS region, p_brand AS coder, l_linenumber AS bound, CAST(l_orderkey % 3 AS INTEGER) AS seed,
 CAST(round(l_extendedprice) AS BIGINT) AS bytes, CASE WHEN l_quantity > 45 THEN 1 ELSE 0 END AS violations, round(l_discount, 2) AS loss
 FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey)"""


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, family, package, bytes, mae, worst): mae and worst are null for some."""
    p = read(spark, sf_dir, "part")
    return p.select(
        F.col("p_partkey").alias("id"), F.col("p_brand").alias("family"), F.when(F.col("p_size") % 2 == 0, "finest-per-page").otherwise("pyramid").alias("package"),
        (F.col("p_size") * 100 + F.col("p_partkey") % 97).cast("bigint").alias("bytes"),
        F.when(F.col("p_partkey") % 11 != 0, F.round(F.col("p_retailprice") / 100, 4)).alias("mae"),
        F.when(F.col("p_partkey") % 13 != 0, ((F.col("p_partkey") * 7919) % 1000).cast("double")).alias("worst"),
    )


CANDIDATES_SQL = """C AS (SELECT p_partkey AS id, p_brand AS family, CASE WHEN p_size % 2 = 0 THEN 'finest-per-page' ELSE 'pyramid' END AS package,
 CAST(p_size * 100 + p_partkey % 97 AS BIGINT) AS bytes, CASE WHEN p_partkey % 11 <> 0 THEN round(p_retailprice / 100, 4) END AS mae,
 CASE WHEN p_partkey % 13 <> 0 THEN CAST((p_partkey * 7919) % 1000 AS DOUBLE) END AS worst FROM part)"""


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, region, e, n, height): points in lattice units, some outside the lattice."""
    c = read(spark, sf_dir, "customer")
    return c.select(
        F.col("c_custkey").alias("id"), (F.col("c_nationkey") % 7).cast("bigint").alias("region"),
        (((F.col("c_custkey") * 37) % 6600) / 100.0 - 1).alias("e"), (((F.col("c_custkey") * 53) % 6600) / 100.0 - 1).alias("n"),
        (F.col("c_acctbal") / 10000.0).alias("height"),
    )


OBSERVATIONS_SQL = """P AS (SELECT c_custkey AS id, CAST(c_nationkey % 7 AS BIGINT) AS region, ((c_custkey * 37) % 6600) / 100.0::DOUBLE - 1 AS e,
 ((c_custkey * 53) % 6600) / 100.0::DOUBLE - 1 AS n, c_acctbal / 10000.0::DOUBLE AS height FROM customer)"""


def epochs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(tile, e, n, surveyed, published, method): a row per published tile."""
    o = read(spark, sf_dir, "orders")
    return o.select(
        F.col("o_orderkey").alias("tile"), ((F.col("o_orderkey") % 40) * 1000).cast("bigint").alias("e"), (F.expr("o_orderkey div 40") % 40 * 1000).cast("bigint").alias("n"),
        F.to_date("o_orderdate").alias("surveyed"), F.date_add(F.to_date("o_orderdate"), (F.col("o_custkey") % 400).cast("int")).alias("published"), F.col("o_orderpriority").alias("method"),
    )


EPOCHS_SQL = """T AS (SELECT o_orderkey AS tile, CAST((o_orderkey % 40) * 1000 AS BIGINT) AS e, CAST((o_orderkey // 40) % 40 * 1000 AS BIGINT) AS n,
 CAST(o_orderdate AS DATE) AS surveyed, CAST(o_orderdate AS DATE) + CAST(o_custkey % 400 AS INTEGER) AS published, o_orderpriority AS method FROM orders)"""
