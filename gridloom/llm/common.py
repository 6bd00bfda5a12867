"""Helpers that the text operators share: scratch tables, lambda bindings, word patterns."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, as the contracts define words: everything else belongs to a word.
WS = r"[\x20\x09-\x0D]+"
WS_CHARS = " \t\n\x0b\f\r"


def let(value: Column, body) -> Column:
    """body(value), with value computed once per row even where body uses it in a lambda."""
    return F.transform(F.array(value), body)[0]


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a local one only where none is configured."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(named)
        return named.rstrip("/")
    if (own := spark.sparkContext.getCheckpointDir()) is None:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        local = tempfile.mkdtemp(prefix="gridloom-")
        atexit.register(shutil.rmtree, local, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(f"file://{local}")
        own = spark.sparkContext.getCheckpointDir()
    return own.rstrip("/")


def checkpointed(df: DataFrame) -> DataFrame:
    """df behind a reliable checkpoint: its lineage is cut, and lost executors cost nothing."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


class Scratch:
    """Parquet tables in the shared folder, for results that are read several times.

    A table written and read again forgets its partitioning, so that a join on it gets fresh
    exchanges, which adaptive execution can split where a key is hot. Tables are dropped when the
    `with` block ends, unless they were passed to `keep`.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.root, self.made, self.kept, self.count = spark, f"{shared_dir(spark)}/tables-{uuid.uuid4().hex}", {}, set(), 0

    def table(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}-{self.count}"
        self.count += 1
        schema = df.schema
        df.write.parquet(path)
        self.made[name] = path
        return self.spark.read.schema(schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            self._delete(self.made.pop(name))

    def _delete(self, path: str) -> None:
        jvm = self.spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        self._delete(self.root)


#: Bits of the filter below, in rows of 64.
CELLS = 18


def bitmap(keys: DataFrame, h: str) -> DataFrame:
    """(cell, bits): a filter of the 64-bit hashes in column h, of 2**CELLS rows at most, whatever it holds."""
    bit = F.expr(f"shiftleft(1L, CAST({h} & 63 AS INT))")
    return keys.select(F.shiftrightunsigned(h, 64 - CELLS).alias("cell"), bit.alias("bit")).groupBy("cell").agg(F.bit_or("bit").alias("bits"))


def marked(df: DataFrame, h: str, filled: DataFrame, name: str) -> DataFrame:
    """df with boolean `name`: false only if the filter has not seen the hash in column h."""
    cells = filled.select(F.col("cell").alias("__cell"), F.col("bits").alias("__bits"))
    joined = df.join(F.broadcast(cells), F.shiftrightunsigned(h, 64 - CELLS) == F.col("__cell"), "left")  # 2**CELLS rows at most
    return joined.withColumn(name, F.coalesce(F.expr(f"shiftrightunsigned(__bits, CAST({h} & 63 AS INT)) & 1 = 1"), F.lit(False))).drop("__cell", "__bits")


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of at most a thousand rows and 16 MB, or one row: a batch is held whole, and texts
    can be long. All operators ask for the same, since a session has one such setting."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 1000)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "16m")


_kept: dict[str, object] = {}


def kept(key: str, make):
    """What a worker process builds once for all tasks of one `key`. Only the last is kept, and until
    another operator's tasks begin in the process, so that none holds what it does not need."""
    if key not in _kept:
        forget()
        _kept[key] = make()
    return _kept[key]


def forget() -> None:
    _kept.clear()
