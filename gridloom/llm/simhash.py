"""SimHash near-duplicates by pivot distance tables.

Each distinct fingerprint gets a row of distances to many reference fingerprints. By the triangle
inequality two fingerprints within MOST bits differ by MOST at most in every coordinate, so a pair with
a larger difference in one is discarded, and what survives is verified by its own distance.

References that lie in one region of the bits, taken relative to the reference zero, spell that region,
and MOST differing bits leave all but MOST regions alone. So only fingerprints whose coordinates agree on
all but MOST regions meet: a join on those coordinates. No large bucket is expanded into pairs. Its
members meet its centre, and those that are then still apart are dealt again by finer regions, of which
the last leave twelve bits free, so that no bucket can have more than 4096 members.
"""

from __future__ import annotations

import itertools
import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, checkpointed, forget, small_batches
from .graph import components

SHINGLE, SEED, BITS, MOST = 3, 42, 64, 3
#: Reference fingerprints of the filter.
PIVOTS = 24
#: Regions of the bits: the first number that holds chance meetings below one a fingerprint, then the finer ones.
FIRST, FINER = (5, 6, 7, 8), (8, 12, 16)
#: Members of a bucket that all meet each other; those of larger ones meet its centre, then by finer regions.
SMALL = 32
#: Bytes of a text that are hashed at a time.
PIECE = 1 << 20


def _pieces(raw: bytes) -> Iterator[list[bytes]]:
    """The words of a text, some at a time; a long text is never a list as a whole."""
    at = 0
    while at < len(raw):
        end = at + PIECE
        while end < len(raw) and not raw[end : end + 1].isspace():
            end += 1
        yield raw[at:end].split()
        at = end


def fingerprint(text: str | None) -> int:
    """Each bit is 1 if it is set in over half of the shingles' hashes, repeats included."""
    left, set_bits, n = [], np.zeros(BITS, np.int64), 0
    for words in _pieces((text or "").encode().lower()):  # bytes: only A-Z, and ASCII white space
        words = left + words
        if len(words) >= SHINGLE:
            h = [xxhash.xxh64_intdigest(b" ".join(w), SEED) for w in zip(words, words[1:], words[2:], strict=False)]
            set_bits += np.unpackbits(np.array(h, ">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
            n += len(h)
        left = words[1 - SHINGLE :]
    if n:
        return int.from_bytes(np.packbits(2 * set_bits > n).tobytes(), "big")
    return xxhash.xxh64_intdigest(b" ".join(left), SEED) if left else 0


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    forget()
    for batch in batches:
        found = np.array([fingerprint(t) for t in batch.column("text").to_pylist()], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found)], ["doc_id", "fp"])


def pivots(n: int = PIVOTS, seed: int = 12) -> list[int]:
    rng = random.Random(seed)
    return [rng.getrandbits(BITS) - (1 << BITS - 1) for _ in range(n)]


def _distance(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def table(fps: DataFrame) -> DataFrame:
    """fps with a column of distances for each of the references."""
    return fps.select("*", *(_distance(F.col("fp"), F.lit(p)).cast("byte").alias(f"p{k}") for k, p in enumerate(pivots())))


def regions(n: int) -> list[int]:
    """Masks of n regions of nearly equal size."""
    cuts = [BITS * k // n for k in range(n + 1)]
    return [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in itertools.pairwise(cuts)]


def _signed_long(x: int) -> int:
    return x - (1 << BITS) if x >> BITS - 1 else x


def keys(n: int) -> Column:
    """(part, key): a bucket for each choice of MOST regions that may differ."""
    kept = [_signed_long(sum(free)) for free in ([m for m in regions(n) if m not in c] for c in itertools.combinations(regions(n), MOST))]
    return F.explode(F.array(*(F.struct(F.lit(k).alias("part"), F.col("fp").bitwiseAND(F.lit(m)).alias("bits")) for k, m in enumerate(kept))))


def first_regions(count: int) -> int:
    """The fewest regions that let a random fingerprint meet less than one other of `count` by chance."""
    for n in FIRST:
        agreed = BITS - sum(sorted((m.bit_count() for m in regions(n)), reverse=True)[:MOST])
        if sum(1 for _ in itertools.combinations(range(n), MOST)) * count / 2**agreed < 1:
            return n
    return FIRST[-1]


def near(x: str, y: str) -> Column:
    """No coordinate differs by more than MOST, and then the distance itself does not."""
    at_most = [F.abs(F.col(f"{x}.p{k}") - F.col(f"{y}.p{k}")) <= MOST for k in range(PIVOTS)]
    out = at_most[0]
    for c in at_most[1:]:
        out = out & c
    return out & (_distance(F.col(f"{x}.fp"), F.col(f"{y}.fp")) <= MOST)


def links(scratch: Scratch, fps: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(node, root) of the fingerprints (node, fp) that are not their component's smallest node.

    fps has each fingerprint once. All pairs within MOST bits are linked, directly or through others,
    and so are the `known` ones (a, b).
    """
    named = scratch.table(table(fps), "pivots")
    cols, first = ["node", "fp", *(f"p{k}" for k in range(PIVOTS))], first_regions(named.count())
    more = known
    for level, n in enumerate([first, *(x for x in FINER if x > first)]):
        last = n == FINER[-1]
        dealt = scratch.table(named.select("node", "fp", keys(n).alias("k")).select("node", "fp", "k.part", "k.bits"), f"dealt{level}")
        buckets = dealt.groupBy("part", "bits").agg(F.count("*").alias("members"), F.min_by("node", F.xxhash64("fp")).alias("centre")).where("members > 1")
        owned = scratch.table(dealt.select("node", "part", "bits").join(buckets, ["part", "bits"]), f"owned{level}")
        few = owned if last else owned.where(F.col("members") <= SMALL)
        x, y = few.alias("x"), few.alias("y")
        met = x.join(y, (F.col("x.part") == F.col("y.part")) & (F.col("x.bits") == F.col("y.bits")) & (F.col("x.node") < F.col("y.node")))
        pairs = met.select(F.col("x.node").alias("a"), F.col("y.node").alias("b"))
        many = owned.where(F.col("members") > SMALL)
        if not last:
            pairs = pairs.union(many.where("node != centre").select(F.least("centre", "node").alias("a"), F.greatest("centre", "node").alias("b")))
        found = _verified(named, pairs.distinct(), cols)
        roots = components(scratch, found if more is None else found.union(more))
        if last or many.isEmpty():
            return roots
        # what the centres can have missed: members of a large bucket that are still apart meet by finer regions
        told = scratch.table(many.join(roots.withColumnRenamed("node", "own"), F.col("node") == F.col("own"), "left").select("part", "bits", "node", F.coalesce("root", "node").alias("comp")), f"told{level}")
        apart = told.groupBy("part", "bits").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x != y").select("part", "bits")
        rest = told.join(apart, ["part", "bits"], "left_semi").select("node").distinct()
        named = scratch.table(named.join(rest, "node", "left_semi").select(*cols), f"pivots{level}")
        if named.isEmpty():
            return roots
        more = roots.select(F.col("node").alias("a"), F.col("root").alias("b"))
    return roots


def _verified(named: DataFrame, pairs: DataFrame, cols: list[str]) -> DataFrame:
    one = pairs.join(named.select(F.col("node").alias("b"), F.struct(*cols[1:]).alias("y")), "b")
    two = one.join(named.select(F.col("node").alias("a"), F.struct(*cols[1:]).alias("x")), "a")
    return two.where(near("x", "y")).select("a", "b")


def near_duplicates(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id), a row per row of df.

    Texts are linked if their fingerprints differ in three bits or fewer; component_id is the smallest
    doc_id that links reach. Null, empty and blank texts have the fingerprint zero and are linked like
    any other. Rows that share a doc_id may have several fingerprints; the doc_id joins them. A row without doc_id is linked with nothing and has a null
    component_id. Other columns are left out, whatever their names; an empty df gives an empty result.
    doc_id has to be an integer.
    """
    spark = df.sparkSession
    small_batches(spark)
    texts = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    with Scratch(spark) as scratch:
        signed = scratch.table(texts.mapInArrow(_signed, "doc_id long, fp long"), "signed")
        named = signed.where("doc_id IS NOT NULL")
        firsts = scratch.table(named.groupBy("fp").agg(F.min("doc_id").alias("first")), "firsts")
        # a doc_id with several fingerprints joins them
        low = named.groupBy("doc_id").agg(F.min("fp").alias("a"), F.max("fp").alias("z")).where("a != z").select("doc_id", "a")
        low = scratch.table(named.join(low, "doc_id").where("a != fp").select("a", F.col("fp").alias("b")).distinct(), "low")
        ends = links(scratch, firsts.select(F.col("fp").alias("node"), "fp"), low)
        owned = scratch.table(firsts.join(ends, F.col("fp") == F.col("node"), "left").select("fp", "first", F.coalesce("root", "fp").alias("comp")), "comps")
        labelled = scratch.table(owned.join(owned.groupBy("comp").agg(F.min("first").alias("component_id")), "comp").select("fp", "component_id"), "labelled")
        ids = named.join(labelled, "fp").select("doc_id", "fp", "component_id")
        alone = signed.where("doc_id IS NULL").select("doc_id", "fp", F.lit(None).cast("long").alias("component_id"))
        return checkpointed(ids.union(alone).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
