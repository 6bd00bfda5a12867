"""Atlases as a Spark data source: pages of all pyramid levels, published whole or not at all.

Tasks put their pages into archives of bounded size in a folder of the job's own and report each archive's
size, index digest and levels. Only the job's commit makes an atlas of them: it puts down a manifest that
lists the archives, and readers open nothing that no manifest lists. So a task that runs twice leaves a
file that nobody reads, which the commit removes, and an aborted or crashed job leaves nothing readable.
A page with a hole fails its task, and with it the publication; an atlas that is there is never replaced.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from ..functions import codecs
from . import archive
from .shared import put_from_task, store_of

MANIFEST, VERSION = "atlas.json", 1
COLUMNS = ("region", "level", "y", "x", "z")


@dataclass
class Written(WriterCommitMessage):
    parts: list


class AtlasWriter(DataSourceWriter):
    def __init__(self, options: dict[str, str], schema: StructType):
        self.top, self.quantum, self.most = options["path"].rstrip("/"), float(options.get("quantum", 0.01)), int(options.get("size", 64 << 20))
        self.places = [schema.names.index(c) for c in COLUMNS]
        self.folder = f"parts-{uuid.uuid4().hex}"
        self.refuse()

    def refuse(self) -> None:
        store, own = store_of(f"{self.top}/{MANIFEST}")
        if store.get_file_info(own).is_file:
            raise FileExistsError(f"there is an atlas: {self.top}")

    def write(self, iterator: Iterator) -> Written:
        parts, held, size = [], [], 0

        def put() -> None:
            packed = archive.pack(held)
            n = int.from_bytes(packed[8:16], "little")
            name = f"{self.folder}/{uuid.uuid4().hex}.pack"
            put_from_task(f"{self.top}/{name}", packed)
            levels = [p[1] for p in held]
            parts.append({"path": name, "bytes": len(packed), "index_sha256": hashlib.sha256(packed[16 : 16 + n]).hexdigest(), "levels": [min(levels), max(levels)], "pages": len(held)})

        for row in iterator:
            region, level, y, x, z = (row[k] for k in self.places)
            side = int(round(len(z) ** 0.5))
            if None in z or len(z) != side * side:
                raise ValueError(f"a hole in region {region}, level {level}, page {y}, {x}")
            blob = codecs.page_bytes(np.array(z, float).reshape(side, side), level, self.quantum)
            if held and size + len(blob) > self.most:
                put()
                held, size = [], 0
            held.append((region, level, y, x, blob))
            size += len(blob)
        if held:
            put()
        return Written(parts)

    def commit(self, messages: list[Written | None]) -> None:
        from pyarrow import fs

        parts = sorted((p for m in messages if m for p in m.parts), key=lambda p: p["path"])
        self.refuse()
        store, own = store_of(f"{self.top}/{self.folder}")
        listed = {p["path"].rpartition("/")[2] for p in parts}
        for f in store.get_file_info(fs.FileSelector(own, allow_not_found=True)):
            if f.base_name not in listed:
                store.delete_file(f.path)
        content = json.dumps({"parts": parts, "quantum": self.quantum, "version": VERSION}, sort_keys=True, separators=(",", ":"))
        put_from_task(f"{self.top}/{MANIFEST}", content.encode())

    def abort(self, messages: list[Written | None]) -> None:
        store, own = store_of(f"{self.top}/{self.folder}")
        if store.get_file_info(own).type.name == "Directory":
            store.delete_dir(own)


class AtlasReader(archive.ArchiveReader):
    """Pages of the archives that the manifest lists, and of no other file."""

    def files(self, store, top: str) -> list:
        with store.open_input_file(f"{top}/{MANIFEST}") as s:
            manifest = json.loads(s.read())
        if manifest["version"] != VERSION:
            raise ValueError("an atlas of another version")
        self.stated = {f"{top}/{p['path']}": p for p in manifest["parts"]}
        level = archive.KEYS.index("level")
        # an equality on levels is decided by the manifest, the rest by each archive's index
        wanted = [p for p, s in self.stated.items() if all(any(test(v, value) for v in range(s["levels"][0], s["levels"][1] + 1)) for k, test, value in self.tests if k == level)]
        return store.get_file_info(wanted)

    def check(self, file, index: bytes) -> None:
        own = self.stated[file.path]
        if file.size != own["bytes"] or hashlib.sha256(index).hexdigest() != own["index_sha256"]:
            raise ValueError(f"not the archive that the manifest lists: {file.path}")


class AtlasSource(DataSource):
    """spark.read.format("page_atlas").load(folder); df.write.format("page_atlas").mode("append").save(folder)."""

    @classmethod
    def name(cls) -> str:
        return "page_atlas"

    def schema(self) -> str:
        return archive.SCHEMA

    def reader(self, schema: StructType) -> AtlasReader:
        return AtlasReader(self.options["path"], int(self.options.get("size", 8 << 20)))

    def writer(self, schema: StructType, overwrite: bool) -> AtlasWriter:
        if overwrite:
            raise ValueError("an atlas is never replaced")
        return AtlasWriter(dict(self.options), schema)


def publish(pages: DataFrame, path: str, quantum: float = 0.01, size: int = 64 << 20) -> None:
    """Pages (region, level, y, x, z) as an atlas. Neighbours lie in one archive."""
    pages.sparkSession.dataSource.register(AtlasSource)
    ordered = pages.select(*COLUMNS).repartitionByRange("region", "level", "y", "x").sortWithinPartitions("region", "level", "y", "x")
    ordered.write.format("page_atlas").option("path", path).option("quantum", repr(quantum)).option("size", size).mode("append").save()


def read(spark: SparkSession, path: str) -> DataFrame:
    """(region, level, y, x, sha256, blob) of an atlas; filters on the keys prune archives and pages.
    Spark keeps a frame's pushed filters with its source: read anew for a query with others."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(AtlasSource)
    return spark.read.format("page_atlas").load(path)
