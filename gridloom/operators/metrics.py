"""Error and agreement metrics. Sums are merged exactly; quantiles are exact and interpolated."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import rounded, ulp32


def height_metrics(cells: DataFrame, bound: float, by: tuple[str, ...] = ("region",), z: str = "z", e: str = "e") -> DataFrame:
    """Largest and mean errors, p99, bias, and violations of the bound, with and without one 32-bit ulp of slack."""
    d = F.col(e) - F.col(z)
    a = F.abs(d)
    slack = bound + ulp32(F.col(z))
    return cells.groupBy(*by).agg(
        rounded(F.max(a)).alias("max_error"),
        rounded(F.sqrt(F.avg(d * d))).alias("rmse"),
        rounded(F.avg(a)).alias("mae"),
        rounded(F.percentile(a, F.lit(0.99))).alias("p99"),
        rounded(F.avg(d)).alias("bias"),
        F.count_if(a > slack).alias("violations"),
        F.count_if(a > bound).alias("strict_violations"),
        rounded(F.greatest(F.lit(0.0), F.max(a - bound))).alias("max_excess"),
    )


def percentiles(df: DataFrame, value: Column, by: list[str]) -> DataFrame:
    p = F.percentile(value, F.array(*(F.lit(x) for x in (0.5, 0.95, 0.99))))
    return df.groupBy(*by).agg(p.alias("__p"), F.max(value).alias("top")).select(*by, *(rounded(F.get("__p", F.lit(k))).alias(n) for k, n in enumerate(("p50", "p95", "p99"))), rounded("top").alias("top"))


def overlap(pairs: DataFrame, by: list[str], a: str = "a", b: str = "b") -> DataFrame:
    """Jaccard, recall and precision of two cell sets given as booleans; null where undefined."""
    both, either = F.count_if(F.col(a) & F.col(b)), F.count_if(F.col(a) | F.col(b))
    in_a, in_b = F.count_if(F.col(a)), F.count_if(F.col(b))
    share = lambda n, d: rounded(F.when(d > 0, n / d))
    return pairs.groupBy(*by).agg(share(both, either).alias("jaccard"), share(both, in_a).alias("recall"), share(both, in_b).alias("precision"))


def entropy(df: DataFrame, symbol: str, by: list[str]) -> DataFrame:
    """Bits a symbol, and the bits of an ideal code for all of them."""
    counts = df.groupBy(*by, symbol).agg(F.count("*").alias("n"))
    total = counts.groupBy(*by).agg(F.sum("n").alias("t"), F.sum(F.col("n") * F.log2(F.col("n").cast("double"))).alias("s"), F.count("*").alias("symbols"))
    bits = F.log2(F.col("t").cast("double")) - F.col("s") / F.col("t")
    return total.select(*by, "symbols", rounded(bits).alias("bits"), rounded(bits * F.col("t"), 3).alias("code_bits"))


def interval_coverage(df: DataFrame, value: Column, low: Column, high: Column, by: list[str]) -> DataFrame:
    return df.groupBy(*by).agg(rounded(F.avg(value.between(low, high).cast("int"))).alias("coverage"), rounded(F.avg(high - low)).alias("width"))
