"""Sinks: page tables that are never overwritten, canonical JSON, and publication checks."""

from __future__ import annotations

import hashlib
import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import moved, put
from .text import nodata


def atlas(pages: DataFrame, path: str, by: tuple[str, ...] = ("region", "level"), order: tuple[str, ...] = ("y", "x")) -> None:
    """The page relation in folders by region and level, sorted by place so that row groups prune; refuses to overwrite."""
    sorted_pages = pages.repartition(*by).sortWithinPartitions(*by, *order)
    sorted_pages.write.mode("errorifexists").partitionBy(*by).parquet(path)


def canonical(value: object) -> str:
    """JSON with sorted keys and no space; NaN and infinities are refused."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def put_json(spark: SparkSession, path: str, value: object) -> None:
    """Canonical JSON in a file that is there whole or not at all: written beside its place, then moved
    over what was there."""
    text = canonical(value).encode()
    beside = f"{path}.{uuid.uuid4().hex}.part"
    put(spark, beside, text)
    moved(spark, beside, path)


def publishable(cells: DataFrame) -> DataFrame:
    """cells as they are; a field with a hole is an error that names its box."""
    holes = nodata(cells)
    said = F.concat_ws(" ", F.lit("a hole in region"), "region", F.lit("rows"), "r0", "r1", F.lit("columns"), "c0", "c1", F.lit("nodes"), "missing")
    refused = holes.select("region", F.raise_error(said).cast("boolean").alias("__no"))
    return cells.join(refused, "region", "left").where("__no IS NULL").drop("__no")


def digest(value: object) -> str:
    return hashlib.sha256(canonical(value).encode()).hexdigest()


def scrubbed(df: DataFrame, column: str, replace: dict[str, str]) -> DataFrame:
    """df with local paths replaced; a row that still holds one is an error."""
    c = F.col(column)
    for old, new in sorted(replace.items(), key=lambda x: -len(x[0])):
        c = F.replace(c, F.lit(old), F.lit(new))
    left = F.lit(False)
    for old in replace:
        left = left | F.contains(c, F.lit(old))
    return df.withColumn(column, F.when(left, F.raise_error(F.lit("a local path is left"))).otherwise(c))


def classified(files: DataFrame, rules: list[tuple[str, str]], path: str = "path", size: str = "bytes") -> DataFrame:
    """(bucket, files, bytes) by the first pattern that fits a path; a file that none fits is an error."""
    bucket = None
    for pattern, name in rules:
        fits = F.col(path).rlike(pattern)
        bucket = F.when(fits, name) if bucket is None else bucket.when(fits, name)
    bucket = bucket.otherwise(F.raise_error(F.concat(F.lit("no bucket for "), F.col(path))))
    return files.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("files"), F.sum(size).alias("bytes"))
