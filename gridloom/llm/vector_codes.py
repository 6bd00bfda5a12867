"""Vector code compression: one codebook for each part of the vectors, fitted on all of them in integers.

Vectors are stored once as blocks: a few thousand vectors a row, their components transposed, so that one
component of all of them lies together. A round is an RDD treeAggregate over the blocks. In a block the
distances to all entries accumulate dimension by dimension, np.add.at counts and sums the parts of each
entry in int64, and the sums meet through a reduction tree, so that neither the driver nor any task gets
more than codebooks, whatever the number of vectors. All is integer arithmetic: the result does not
depend on how the rows lie or on the order in which sums meet.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from fractions import Fraction
from math import floor

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, checkpointed, forget, small_batches

SCALE, PARTS, ENTRIES, ROUNDS, DEPTH = 4096, 8, 16, 6, 3
#: Components in a block, at most: vectors are put together until they have so many.
BLOCK = 1 << 18
LONGEST = 2**63 - 1
BLOCKS = "n long, width long, kind string, most double, ids array<long>, labels binary, cells binary"


def _integers(cells: np.ndarray, scale: int, wide: bool) -> np.ndarray:
    """floor(scale * x), exactly: int64 where all sums fit, else Python's integers."""
    if not wide:
        return np.floor(cells.astype(np.float64) * scale).astype(np.int64)
    out = np.empty(cells.shape, object)
    out.flat = [floor(Fraction(float(x)) * scale) for x in cells.flat]
    return out


def cuts(width: int, parts: int) -> list[slice]:
    return [slice(width * p // parts, width * (p + 1) // parts) for p in range(parts)]


def assigned(cols: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For the vectors of a part (a row a dimension) the nearest entry, the first of equals, and its squared distance."""
    away = np.zeros((cols.shape[1], len(book)), cols.dtype)
    for j, col in enumerate(cols):
        apart = col[:, None] - book[:, j][None, :]
        away += apart * apart
    at = away.argmin(1)
    return at, away[np.arange(len(at)), at]


def _blocked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Columnar blocks of the vectors of a partition, a width each."""
    forget()
    held: dict[int, tuple[list, list, list]] = {}

    def block(width: int) -> pa.RecordBatch:
        ids, labels, vectors = held.pop(width)
        cells = np.ascontiguousarray(np.stack(vectors).T) if width else np.zeros((0, len(ids)))
        made = pa.RecordBatch.from_arrays([pa.concat_arrays(labels)], ["label"])
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, made.schema) as out:
            out.write_batch(made)
        most = float(np.abs(cells).max()) if cells.size else 0.0
        values = [[len(ids)], [width], [cells.dtype.str], [most], [ids], [sink.getvalue().to_pybytes()], [cells.tobytes()]]
        return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, (pa.int64(), pa.int64(), pa.string(), pa.float64(), pa.list_(pa.int64()), pa.binary(), pa.binary()), strict=True)], ["n", "width", "kind", "most", "ids", "labels", "cells"])

    for batch in batches:
        vectors, ids, labels = batch.column("vec"), batch.column("id").to_pylist(), batch.column("label")
        flat, ends = vectors.values.to_numpy(zero_copy_only=False), vectors.offsets.to_numpy()
        for k in range(batch.num_rows):
            v = flat[ends[k] : ends[k + 1]]
            own = held.setdefault(len(v), ([], [], []))
            own[0].append(ids[k])
            own[1].append(labels.slice(k, 1))
            own[2].append(v)
            if len(own[0]) * max(len(v), 64) >= BLOCK:
                yield block(len(v))
    for width in list(held):
        yield block(width)


def _cells(row, scale: int, wide: bool) -> np.ndarray:
    return _integers(np.frombuffer(row["cells"], row["kind"]).reshape(row["width"], row["n"]), scale, wide)


def _summed(blocks: DataFrame, books: list[np.ndarray], at: list[slice], scale: int, wide: bool) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each part the sums of the parts nearest to each entry, and their counts."""
    kind = object if wide else np.int64

    def zero() -> list:
        return [(np.zeros(b.shape, kind), np.zeros(len(b), np.int64)) for b in books]

    def add(sums: list | None, row) -> list:
        sums, cells = sums or zero(), _cells(row, scale, wide)
        for p, (total, count) in enumerate(sums):
            cols = cells[at[p]]
            near, _ = assigned(cols, books[p])
            np.add.at(total, near, cols.T)
            np.add.at(count, near, 1)
        return sums

    def merge(x: list | None, y: list | None) -> list | None:
        if x is None or y is None:
            return y if x is None else x
        return [(a + c, b + d) for (a, b), (c, d) in zip(x, y, strict=True)]

    return blocks.select("n", "width", "kind", "cells").rdd.treeAggregate(None, add, merge, DEPTH) or zero()


def fitted(blocks: DataFrame, books: list[np.ndarray], at: list[slice], scale: int, rounds: int, wide: bool) -> list[np.ndarray]:
    """The codebooks after some rounds; an entry that no part is nearest to stays as it is."""
    for _ in range(rounds):
        sums = _summed(blocks, books, at, scale, wide)
        books = [np.where((n > 0)[:, None], total // np.maximum(n, 1)[:, None], book) for book, (total, n) in zip(books, sums, strict=True)]
    return books


def compress(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str | None = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, list[list[list[int]]]]:
    """((vec_id, label, codes, error), codebooks): a code for each part of each kept vector.

    Left out are null vectors, those with a null, NaN or infinite component, and those that are not as
    long as the first kept one (by vec_id, nulls last, then by components). Components become
    floor(scale * x); parts are as equal as the length allows. Codebooks begin with the first kept
    vectors, so with fewer entries than asked for where there are fewer vectors; with none, there are
    no rows and no codebooks. codes has the index of the nearest entry for each part, the lower of
    equals, and error the squared distances summed over the parts, at most 2**63 - 1; components too
    large for int64 are reckoned in Python's integers. Repeated rows, and rows that share or lack a
    vec_id, are rows like others. Other columns are left out, whatever their names. vec_id has to be an
    integer.
    """
    spark = df.sparkSession
    small_batches(spark)
    kind = "array<float>" if dict(df.dtypes)[vector] == "array<float>" else "array<double>"
    own = df.select(F.col(vec_id).cast("long").alias("id"), F.col(vector).cast(kind).alias("vec"), (F.col(label) if label else F.lit(None).cast("int")).alias("label"))
    bad = F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    own = own.where(F.col("vec").isNotNull() & ~F.coalesce(bad, F.lit(False)))
    firsts = own.orderBy(F.col("id").asc_nulls_last(), "vec")
    begun = firsts.select("vec").limit(1).collect()
    width = len(begun[0].vec) if begun else 0
    own = own.where(F.size("vec") == width)
    begun = own.orderBy(F.col("id").asc_nulls_last(), "vec").select("vec").limit(entries).collect()
    label_type = own.schema["label"].dataType
    with Scratch(spark) as scratch:
        blocks = scratch.table(own.mapInArrow(_blocked, BLOCKS), "blocks")
        rows, most = blocks.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("most"), F.lit(0.0))).first()
        largest = (int(most) + 1) * scale + 1
        wide = max(4 * largest * largest * max(width, 1), largest * rows) > LONGEST
        at = cuts(width, parts)
        cells = _integers(np.array([r.vec for r in begun], np.float64).reshape(len(begun), width), scale, wide)
        books = fitted(blocks, [cells[:, c] for c in at], at, scale, rounds, wide)

        def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in batch.to_pylist():
                    ints = _cells(row, scale, wide)
                    near = [assigned(ints[c], book) for c, book in zip(at, books, strict=True)]
                    codes = np.stack([a for a, _ in near], 1).astype(np.int32)
                    error = [min(int(e), LONGEST) for e in sum(e.astype(object) for _, e in near)]
                    labels = pa.ipc.open_stream(row["labels"]).read_all().column("label").combine_chunks()
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(0, codes.size + 1, parts), pa.int32()), pa.array(codes.reshape(-1)))
                    yield pa.RecordBatch.from_arrays([pa.array(row["ids"], pa.int64()), labels, lists, pa.array(error, pa.int64())], ["vec_id", "label", "codes", "error"])

        schema = own.select(F.col("id").alias("vec_id"), "label", F.array(F.lit(0)).alias("codes"), F.lit(0).cast("long").alias("error")).schema
        for field in schema:
            field.nullable = True
        assert schema["label"].dataType == label_type
        out = checkpointed(blocks.mapInArrow(coded, schema))
    return out, [[[int(x) for x in entry] for entry in book] for book in books] if begun else []


def digest(books: list[list[list[int]]]) -> str:
    return hashlib.sha256(",".join(str(x) for book in books for entry in book for x in entry).encode()).hexdigest()


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    named = coded.select("vec_id", "label", F.concat_ws("", F.transform("codes", lambda c: F.lpad(F.lower(F.hex(c)), 2, "0"))).alias("code"), "error")
    total = named.groupBy("label").agg(F.sum(F.col("error").cast("decimal(38,0)")).alias("s"))
    total = total.select(F.col("label").alias("l"), F.least("s", F.lit(LONGEST).cast("decimal(38,0)")).cast("long").alias("label_error"))
    joined = named.join(total, F.col("label").eqNullSafe(F.col("l")))
    return joined.select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def _sql() -> str:
    keep = "embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"
    steps = []
    for k in range(ROUNDS + 1):
        steps.append(f"""d{k} AS MATERIALIZED (SELECT rid, p, a.v, min(struct_pack(d := list_sum(list_transform(list_zip(a.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), e := b.e)) AS m
  FROM parts a JOIN c{k} b USING (p) GROUP BY rid, p, a.v)""")
        if k < ROUNDS:
            steps.append(f"""u{k} AS (SELECT p, e, j, CAST(floor(sum(x)::DOUBLE / count(*)) AS BIGINT) AS q, sum(x) AS s, count(*) AS n FROM (SELECT p, m.e AS e, unnest(v) AS x, unnest(range(len(v))) AS j FROM d{k}) GROUP BY ALL)""")
            steps.append(f"""n{k} AS (SELECT p, e, list(q - CASE WHEN q * n > s THEN 1 ELSE 0 END + CASE WHEN (q + 1) * n <= s THEN 1 ELSE 0 END ORDER BY j)::BIGINT[] AS v FROM u{k} GROUP BY p, e)""")
            steps.append(f"c{k + 1} AS MATERIALIZED (SELECT p, e, coalesce(n.v, c.v) AS v FROM c{k} c LEFT JOIN n{k} n USING (p, e))")
    return f"""
WITH kept AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id, embedding) - 1 AS rid, vec_id, label, list_transform(embedding, lambda x: CAST(floor({SCALE} * x::DOUBLE) AS BIGINT)) AS z FROM embeddings WHERE {keep}),
parts AS MATERIALIZED (SELECT rid, p, z[len(z) * p // {PARTS} + 1 : len(z) * (p + 1) // {PARTS}] AS v FROM kept, (SELECT unnest(range({PARTS})) AS p)),
c0 AS MATERIALIZED (SELECT p, rid AS e, v FROM parts WHERE rid < {ENTRIES}),
{", ".join(steps)},
sums AS (SELECT rid, string_agg(printf('%02x', m.e), '' ORDER BY p) AS code, CAST(sum(m.d) AS BIGINT) AS error FROM d{ROUNDS} GROUP BY rid),
books AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY p, e)) AS h FROM c{ROUNDS})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, h AS codebooks_sha256 FROM kept JOIN sums USING (rid), books
"""


SQL = _sql()
