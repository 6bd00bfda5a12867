"""Sharding by a hypergeometric communication matrix: a uniform shuffle with exact shard sizes.

The source parts' counts and the shard sizes fix the margins of a matrix of counts. The matrix is
drawn from the law that a uniform permutation of all rows gives it (multivariate hypergeometric,
row by row). Each part is then permuted by itself, its first rows go to shard 0, the next ones to
shard 1 and so on, and each shard is permuted again. Rows see only built-in column functions; the
driver draws a matrix whose size is two parameters and does not depend on the data.
"""

from __future__ import annotations

import json
import math
import random

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import checkpointed


def hypergeometric(rng: random.Random, good: int, bad: int, draws: int) -> int:
    """How many of `draws` rows, taken without replacement, are among `good`. Inversion from the mode outwards."""
    low, high = max(0, draws - bad), min(draws, good)
    if low == high:
        return low
    mode = min(high, max(low, (draws + 1) * (good + 1) // (good + bad + 2)))
    lc = lambda n, k: math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)
    at = math.exp(lc(good, mode) + lc(bad, draws - mode) - lc(good + bad, draws))
    u, up, down, pu, pd = rng.random() - at, mode, mode, at, at
    while u > 0:
        moved = False
        if up < high:
            pu *= (good - up) * (draws - up) / ((up + 1) * (bad - draws + up + 1))
            up, u, moved = up + 1, u - pu, True
            if u <= 0:
                return up
        if down > low:
            pd *= down * (bad - draws + down) / ((good - down + 1) * (draws - down + 1))
            down, u, moved = down - 1, u - pd, True
            if u <= 0:
                return down
        if not moved or pu + pd < 1e-300:
            return mode
    return mode


def communication_matrix(counts: list[int], sizes: list[int], seed: int) -> list[list[int]]:
    """Counts from part to shard: rows sum to `counts`, columns to `sizes`."""
    rng, left, out = random.Random(seed), list(sizes), []
    for n in counts:
        row, rest, pool = [], n, sum(left)
        for s, size in enumerate(left):
            k = rest if s == len(left) - 1 else hypergeometric(rng, size, pool - size, rest)
            row.append(k)
            rest, pool = rest - k, pool - size
        left = [a - b for a, b in zip(left, row, strict=True)]
        out.append(row)
    return out


def shard_sizes(rows: int, shards: int) -> list[int]:
    return [rows // shards + (s < rows % shards) for s in range(shards)]


def shard(df: DataFrame, shards: int = 16, seed: int = 20, parts: int = 1024, cells: int = 64) -> DataFrame:
    """df with shard (int) and slot (long): counts at most one apart, slots gapless from 0.

    Any rows are fine: rows are told apart by a number that a checkpoint fixes, so null keys,
    repeated rows and hot values spread like all others. An empty df gives an empty result.
    Columns named shard or slot are replaced. Small rows should be passed (keys, not texts); df
    is shuffled twice. `parts` bounds the matrix, and `cells` times `shards` the second prefix sum.
    """
    rest = [c for c in df.columns if c not in ("shard", "slot")]
    row = checkpointed(df.select(*rest).withColumn("__uid", F.monotonically_increasing_id()))
    keyed = row.withColumn("__part", F.pmod(F.xxhash64(F.lit(seed), "__uid"), F.lit(parts)).cast("int"))
    counts = [0] * parts
    for p, n in keyed.groupBy("__part").count().collect():  # at most `parts` rows
        counts[p] = n
    matrix = communication_matrix(counts, shard_sizes(sum(counts), shards), seed)
    ends = [[sum(r[: s + 1]) for s in range(shards)] for r in matrix]
    table = lambda x: F.from_json(F.lit(json.dumps(x)), "array<array<bigint>>")
    local = Window.partitionBy("__part").orderBy(F.xxhash64(F.lit(seed + 1), "__uid"), "__uid")
    dealt = keyed.withColumn("__rank", F.row_number().over(local) - 1)
    dealt = dealt.withColumn("__ends", F.get(table(ends), F.col("__part")))
    dealt = dealt.withColumn("shard", F.size(F.filter("__ends", lambda e: e <= F.col("__rank"))).cast("int"))
    key = F.xxhash64(F.lit(seed + 2), "__uid")
    dealt = checkpointed(dealt.select(*rest, "__uid", "shard", key.alias("__key")))
    dealt = dealt.withColumn("__cell", F.pmod("__key", F.lit(cells)).cast("int"))
    held = [[0] * cells for _ in range(shards)]
    for s, c, n in dealt.groupBy("shard", "__cell").count().collect():  # at most shards * cells rows
        held[s][c] = n
    begins = [[sum(r[:c]) for c in range(cells)] for r in held]
    again = Window.partitionBy("shard", "__cell").orderBy("__key", "__uid")
    slot = F.get(F.get(table(begins), F.col("shard")), F.col("__cell")) + F.row_number().over(again) - 1
    return dealt.withColumn("slot", slot.cast("long")).drop("__uid", "__key", "__cell")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    docs = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    out = shard(docs).withColumn("law", F.lit("rows")).withColumn("grown_shard", F.lit(None).cast("int"))
    return out.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
