"""Readers of tile metadata, height benchmarks, feature markup, reports and manifests."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import checkpointed, store_of

#: The columns of the tile metadata table, as its header names them.
TILE_COLUMNS = ("Kachelname", "Aktualitaet", "Erfassungsmethode", "Fortfuehrung", "Fortfuehrungsmethode", "Genauigkeit", "Koordinatenreferenzsystem_Lage", "Koordinatenreferenzsystem_Hoehe", "Hoehenanomalie")


def manifests(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON documents under a stated schema; what does not fit it is an error."""
    return spark.read.schema(schema).option("multiLine", "true").option("mode", "FAILFAST").json(path)


def _entries(spark: SparkSession, path: str) -> Iterator[DataFrame]:
    """(path, name) of the files below a folder, a table for each depth; folders are listed by tasks, and
    neither they nor files come to the driver."""

    def listed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        for pdf in batches:
            for top in pdf["path"]:
                store, own = store_of(top)
                found = store.get_file_info(fs.FileSelector(own))
                yield pd.DataFrame({"path": [f"{top.rstrip('/')}/{x.base_name}" for x in found], "name": [x.base_name for x in found], "folder": [x.type == fs.FileType.Directory for x in found]}).astype({"path": object, "name": object, "folder": bool})

    folders = spark.createDataFrame([(path,)], "path string")
    while True:
        here = checkpointed(folders.mapInPandas(listed, "path string, name string, folder boolean"))
        yield here.where("NOT folder").select("path", "name")
        folders = here.where("folder AND NOT startswith(name, '.') AND NOT startswith(name, '_')").select("path")
        if folders.isEmpty():
            return
        folders = folders.repartition(4 * spark.sparkContext.defaultParallelism)


def reports(spark: SparkSession, folder: str) -> DataFrame:
    """(file, schema, body): every *.json below a folder; one that cannot be read stays, with nulls. Tasks list and
    read, so that what the driver gets does not grow with the files."""

    def load(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for k in range(0, len(pdf), 256):
                paths, content = pdf["path"].iloc[k : k + 256].tolist(), []
                for path in paths:
                    store, own = store_of(path)
                    with store.open_input_stream(own, compression=None) as f:
                        content.append(f.read())
                yield pd.DataFrame({"path": paths, "content": content})

    found = None
    for files in _entries(spark, folder):
        found = files if found is None else found.union(files)
    named = found.where("name LIKE '%.json' AND NOT startswith(name, '.') AND NOT startswith(name, '_')").select("path")
    raw = named.repartition(4 * spark.sparkContext.defaultParallelism).mapInPandas(load, "path string, content binary")
    body = raw.select(F.col("path").alias("file"), F.expr("try_validate_utf8(cast(content as string))").alias("text"))
    return body.select("file", F.get_json_object("text", "$.schema").alias("schema"), F.when(F.get_json_object("text", "$").isNotNull(), F.col("text")).alias("body"))


def preferred(rows: DataFrame, key: str, order: list[str], source: str = "source") -> DataFrame:
    """For each key the row from the source that comes first in `order`; other sources come last, by name."""
    rank = F.coalesce(F.array_position(F.array(*map(F.lit, order)), F.col(source)), F.lit(0))
    rank = F.when(rank == 0, len(order) + 1).otherwise(rank)
    best = rows.groupBy(key).agg(F.min(F.struct(rank.alias("rank"), F.col(source).alias("source"), F.struct(*[c for c in rows.columns if c != key]).alias("row"))).alias("b"))
    return best.select(key, "b.row.*")


def presets(layers: list[DataFrame], key: str = "name") -> DataFrame:
    """Layers of (name, config map): a later layer's entries win, one by one."""
    tagged = None
    for k, layer in enumerate(layers):
        own = layer.select(key, F.explode("config").alias("entry", "value")).withColumn("__k", F.lit(k))
        tagged = own if tagged is None else tagged.unionByName(own)
    last = tagged.groupBy(key, "entry").agg(F.max(F.struct("__k", "value")).alias("b"))
    return last.groupBy(key).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("entry", "b.value")))).alias("config"))


def benchmarks(spark: SparkSession, path: str, zone: str = "32") -> DataFrame:
    """(id, name, east, north, height): `;` between columns, a decimal comma, a zone before the easting.
    Rows without an id or a height are dropped."""
    raw = spark.read.schema("id string, name string, east string, north string, height string, gravity string").option("sep", ";").option("header", "true").option("encoding", "UTF-8").csv(path)
    number = lambda c: F.expr(f"try_cast(replace(trim({c}), ',', '.') AS DOUBLE)")
    east = F.expr(f"try_cast(replace(regexp_replace(trim(east), '^{zone}(?=[0-9]{{6}})', ''), ',', '.') AS DOUBLE)")
    return raw.select(F.trim(F.regexp_replace("id", "^﻿", "")).alias("id"), F.trim("name").alias("name"), east.alias("east"), number("north").alias("north"), number("height").alias("height")).where("id != '' AND height IS NOT NULL AND east IS NOT NULL AND north IS NOT NULL")


def survey_dates(spark: SparkSession, path: str) -> DataFrame:
    """(id, surveyed): the latest valid date (dd.mm.yyyy) of each id."""
    raw = spark.read.schema("id string, day string, height string").option("sep", ";").csv(path)
    day = F.to_date(F.try_to_timestamp("day", F.lit("dd.MM.yyyy")))
    return raw.select(F.trim(F.regexp_replace("id", "^﻿", "")).alias("id"), day.alias("day")).where("day IS NOT NULL").groupBy("id").agg(F.max("day").alias("surveyed"))


def tile_metadata(spark: SparkSession, path: str) -> DataFrame:
    """Rows of the tables in zip archives: lines before the header are key and value, and are skipped."""

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows: list[list[str | None]] = []
            for content in pdf["content"]:
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for name in sorted(z.namelist()):
                        header = None
                        for line in z.read(name).decode("utf-8-sig", "replace").splitlines():
                            parts = [x.strip() for x in line.split(";")]
                            if parts[0] == TILE_COLUMNS[0]:
                                header = parts
                            elif header and parts[0]:
                                own = dict(zip(header, parts, strict=False))
                                rows.append([own.get(c) for c in TILE_COLUMNS])
            yield pd.DataFrame(rows, columns=list(TILE_COLUMNS), dtype=object)

    raw = spark.read.format("binaryFile").load(path).select("content")
    return raw.mapInPandas(unpack, ", ".join(f"{c} string" for c in TILE_COLUMNS))


def publication_times(spark: SparkSession, path: str) -> DataFrame:
    """(name, published) of the file elements of an index in XML."""
    text = spark.read.option("wholetext", "true").text(path).select(F.regexp_replace("value", r"^\s*<\?xml[^>]*\?>", "").alias("value"))
    pairs = F.arrays_zip(F.xpath("value", F.lit("//file/@name")).alias("name"), F.xpath("value", F.lit("//file/@timestamp")).alias("published"))
    return text.select(F.explode(pairs).alias("p")).select("p.name", "p.published")


def features(spark: SparkSession, path: str, tag: str, schema: str) -> DataFrame:
    """Feature elements of GML or other XML, a row each, under a stated schema."""
    return spark.read.format("xml").schema(schema).option("rowTag", tag).option("ignoreNamespace", "true").load(path)


def ring(pos_list: str):
    """An array of (x, y) from a list of coordinates; eastings that look like northings are refused."""
    n = F.transform(F.split(F.trim(F.col(pos_list)), r"\s+"), lambda v: v.cast("double"))
    pairs = F.transform(F.sequence(F.lit(0), F.floor(F.size(n) / 2).cast("int") - 1), lambda k: F.struct(F.get(n, 2 * k).alias("x"), F.get(n, 2 * k + 1).alias("y")))
    return F.when(F.exists(pairs, lambda p: (p["x"] > 1e6) & (p["y"] < 1e6)), F.raise_error(F.lit("northing before easting"))).otherwise(pairs)


def polylines(features: DataFrame, xml: str = "xml", tag: str = "Fault") -> DataFrame:
    """(id, part, k, x, y) of the curves of features in GML, in a string column: each position list of a
    feature is a part; a list of fewer than two points is no line, one with a lone number is an error."""
    lists = features.select(F.xpath_string(xml, F.lit(f"/{tag}/@id")).alias("id"), F.posexplode(F.xpath(xml, F.lit(f"/{tag}//posList/text()"))).alias("part", "list"))
    n = F.size(F.split(F.trim("list"), r"\s+"))
    whole = lists.withColumn("list", F.when(n % 2 == 1, F.raise_error(F.lit("a position without its second coordinate"))).otherwise(F.col("list")))
    points = whole.where(n >= 4).select("id", "part", F.posexplode(ring("list")).alias("k", "p"))
    return points.select("id", "part", "k", "p.x", "p.y")


def npy_fields(spark: SparkSession, path: str) -> DataFrame:
    """(file, row, col, z) of square .npy arrays; missing nodes are an error."""

    def load(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, content in zip(pdf["path"], pdf["content"], strict=True):
                z = np.load(io.BytesIO(content), allow_pickle=False)
                if z.ndim != 2 or not np.isfinite(z).all():
                    raise ValueError(f"not a whole field: {name}")
                r, c = np.indices(z.shape)
                yield pd.DataFrame({"file": name, "row": r.ravel().astype(np.int32), "col": c.ravel().astype(np.int32), "z": z.ravel().astype(float)})

    raw = spark.read.format("binaryFile").option("pathGlobFilter", "*.npy").load(path).select("path", "content")
    return raw.mapInPandas(load, "file string, row int, col int, z double")


def merged(tiles: DataFrame) -> DataFrame:
    """One field from overlapping tiles (tile, row, col, z): the first tile by name wins, NaN is missing."""
    first = F.min(F.struct("tile", "z")).alias("b")
    return tiles.where(~F.isnan("z") & F.col("z").isNotNull()).groupBy("row", "col").agg(first).select("row", "col", F.col("b.z").alias("z"))


def nodata(cells: DataFrame) -> DataFrame:
    """Holes by region: their number and box. A field may be published if there is none."""
    return cells.where(F.col("z").isNull() | F.isnan("z")).groupBy("region").agg(F.count("*").alias("missing"), F.min("row").alias("r0"), F.max("row").alias("r1"), F.min("col").alias("c0"), F.max("col").alias("c1"))
