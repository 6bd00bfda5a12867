"""Packed page archives as a Spark data source: one file of many pages, read by byte ranges.

A file is a magic, the index's length, a JSON index (key, place, size, digest of each page) and the
pages' bytes. The reader plans partitions from the index alone, drops pages by filters on their
keys before reading them, and checks each page's digest.
"""

from __future__ import annotations

import hashlib
import json
import struct
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.types import StructType

from .shared import store_of

#: Fixed value: the archive's magic.
MAGIC = b"EATPACK1"
SCHEMA = "region bigint, level int, y int, x int, sha256 string, blob binary"
KEYS = ("region", "level", "y", "x")


def pack(pages: list[tuple[int, int, int, int, bytes]]) -> bytes:
    """An archive of (region, level, y, x, bytes), in order of the keys; a key may occur once."""
    pages = sorted(pages, key=lambda p: p[:4])
    if any(a[:4] == b[:4] for a, b in zip(pages, pages[1:], strict=False)):
        raise ValueError("a page's key occurs twice")
    index, at = [], 0
    for *key, blob in pages:
        index.append([*key, at, len(blob), hashlib.sha256(blob).hexdigest()])
        at += len(blob)
    head = json.dumps(index, separators=(",", ":")).encode()
    return MAGIC + struct.pack("<Q", len(head)) + head + b"".join(p[4] for p in pages)


@dataclass
class Pages(InputPartition):
    path: str
    pages: list


class ArchiveReader(DataSourceReader):
    def __init__(self, path: str, size: int):
        self.path, self.size, self.tests = path, size, []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        kinds = {EqualTo: lambda a, b: a == b, GreaterThan: lambda a, b: a > b, GreaterThanOrEqual: lambda a, b: a >= b, LessThan: lambda a, b: a < b, LessThanOrEqual: lambda a, b: a <= b, In: lambda a, b: a in b}
        for f in filters:
            if type(f) in kinds and f.attribute[0] in KEYS:
                self.tests.append((KEYS.index(f.attribute[0]), kinds[type(f)], f.value))
            else:
                yield f

    def partitions(self) -> list[Pages]:
        """Runs of neighbouring pages of about `size` bytes, from the indexes of all archives."""
        store, top = store_of(self.path)
        out: list[Pages] = []
        for f in self.files(store, top):
            with store.open_input_file(f.path) as s:
                head = s.read(16)
                if head[:8] != MAGIC:
                    raise ValueError(f"not an archive: {f.path}")
                n = struct.unpack("<Q", head[8:])[0]
                if n > f.size - 16:
                    raise ValueError(f"the index is longer than the file: {f.path}")
                stated = s.read(n)
                self.check(f, stated)
                index = json.loads(stated)
            run, held = [], 0
            for p in index:
                if all(test(p[k], v) for k, test, v in self.tests):
                    if run and held + p[5] > self.size:
                        out.append(Pages(f.path, run))
                        run, held = [], 0
                    run.append([*p[:4], p[4] + 16 + n, *p[5:]])
                    held += p[5]
            if run:
                out.append(Pages(f.path, run))
        return out or [Pages("", [])]

    def files(self, store, top: str) -> list:
        """The archives of a folder, or the one that the path names."""
        from pyarrow import fs

        info = store.get_file_info(top)
        found = [info] if info.is_file else [f for f in store.get_file_info(fs.FileSelector(top)) if f.is_file and not f.base_name.startswith(("_", "."))]
        return sorted(found, key=lambda f: f.path)

    def check(self, file, index: bytes) -> None:
        """For readers that know what an index has to be."""

    def read(self, partition: Pages) -> Iterator[tuple]:
        if not partition.pages:
            return
        store, _ = store_of(self.path)
        with store.open_input_file(partition.path) as s:
            for *key, at, size, digest in partition.pages:
                s.seek(at)
                blob = s.read(size)
                if hashlib.sha256(blob).hexdigest() != digest:
                    raise ValueError(f"page {key} of {partition.path} is damaged")
                yield (*key, digest, blob)


class ArchiveSource(DataSource):
    """spark.read.format("page_archive").load(file or folder)."""

    @classmethod
    def name(cls) -> str:
        return "page_archive"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> ArchiveReader:
        return ArchiveReader(self.options["path"], int(self.options.get("size", 8 << 20)))


def read(spark: SparkSession, path: str) -> DataFrame:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ArchiveSource)
    return spark.read.format("page_archive").load(path)


def page_files(spark: SparkSession, folder: str, stated: DataFrame, suffix: str = "page") -> DataFrame:
    """(region, y, x, blob) of files region_y_x.suffix that an index (region, y, x, sha256) states; one that
    is not there, or has another digest, is an error."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", f"*.{suffix}").load(folder)
    key = F.regexp_extract("path", rf"(\d+_\d+_\d+)\.{suffix}$", 1)
    files = raw.select(key.alias("key"), F.col("content").alias("blob"))
    met = stated.withColumn("key", F.concat_ws("_", "region", "y", "x")).join(files, "key", "left")
    sound = F.coalesce(F.sha2("blob", 256) == F.col("sha256"), F.lit(False))
    return met.select("region", "y", "x", F.when(sound, F.col("blob")).otherwise(F.raise_error(F.concat(F.lit("damaged or missing page "), F.col("key")))).alias("blob"))
