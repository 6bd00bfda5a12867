"""The folder that driver and executors share: checkpoints, files that are written to be read again."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; a local one only where all of Spark is one process."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
        if not named and not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        sc.setCheckpointDir(named or f"file://{tempfile.mkdtemp(prefix='gridloom-')}")
    return sc.getCheckpointDir().rstrip("/")


def checkpointed(df: DataFrame) -> DataFrame:
    """df behind a checkpoint in that folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def _at(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


@contextmanager
def folder(spark: SparkSession) -> Iterator[str]:
    """A new folder in it, which goes when the block ends: what is read from it has to be checkpointed before."""
    path = f"{shared_dir(spark)}/files-{uuid.uuid4().hex}"
    try:
        yield path
    finally:
        store, target = _at(spark, path)
        store.delete(target, True)


class Rounds:
    """Tables of a loop's rounds, written to a folder that goes when the block ends. A table read again has no
    lineage, no partitioning and none of the constraints that a checkpoint keeps, which in a loop
    multiply with each round."""

    def __init__(self, spark: SparkSession):
        self.spark, self.path, self.count = spark, f"{shared_dir(spark)}/rounds-{uuid.uuid4().hex}", 0

    def table(self, df: DataFrame) -> DataFrame:
        own, schema = f"{self.path}/{self.count}", df.schema
        self.count += 1
        df.write.parquet(own)
        return self.spark.read.schema(schema).parquet(own)

    def __enter__(self) -> "Rounds":
        return self

    def __exit__(self, *_) -> None:
        store, target = _at(self.spark, self.path)
        store.delete(target, True)


def put(spark: SparkSession, path: str, content: bytes) -> None:
    """A small file from the driver; one that is there already is an error."""
    store, target = _at(spark, path)
    out = store.create(target, False)
    try:
        out.write(bytearray(content))
    finally:
        out.close()


def moved(spark: SparkSession, path: str, to: str) -> None:
    """A file in another's place, which is replaced."""
    store, target = _at(spark, to)
    context = spark.sparkContext._jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    renames = spark.sparkContext._jvm.org.apache.hadoop.fs.Options.Rename
    how = spark.sparkContext._gateway.new_array(renames, 1)
    how[0] = renames.OVERWRITE
    context.rename(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path), target, how)


def put_from_task(path: str, content: bytes) -> None:
    """A file from a task, by any file system that pyarrow knows: written beside its place, under a name that
    readers skip, and moved there whole. A task that runs again writes the same."""
    store, own = store_of(path)
    top, _, name = own.rpartition("/")
    store.create_dir(top, recursive=True)
    beside = f"{top}/.{name}.{uuid.uuid4().hex}"
    with store.open_output_stream(beside, compression=None) as out:
        out.write(content)
    store.move(beside, own)


def store_of(path: str):
    """pyarrow's file system of a path, and the path in it."""
    from pyarrow import fs

    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
