"""Best-fit-decreasing packing of token pieces into sequences.

Best fit decreasing sees nothing of a piece but its length, so the whole corpus is planned from a
histogram of at most `size` lengths: lengths are taken from long to short, and a segment tree over
remaining capacities gives the tightest open bin in logarithmic time. Bins that are alike are
handled as one range, so a plan has a bounded number of entries whatever the corpus holds. Each
piece then finds its place from its length and its rank among pieces of that length, which salted
counts give without a single-task sort.
"""

from __future__ import annotations

import sys
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import checkpointed, forget, small_batches

SIZE = 4096
END = 1
CACHE = 600_000
TOKENIZER = "word_bpe_49k.json"


#: The byte-level alphabet: printable bytes stand for themselves, the others follow from U+0100.
_PRINTED = {*range(33, 127), *range(161, 173), *range(174, 256)}
_SHOWN = {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in _PRINTED)}


def _packed(ids) -> bytes:
    held = array("I", ids)
    if sys.byteorder == "big":
        held.byteswap()
    return held.tobytes()


class Encoder:
    """Ids as little-endian unsigned 32-bit bytes. No token of this vocabulary crosses ASCII white
    space, so chunks between it are encoded by themselves and kept in a cache of bounded size."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer, self.cache = Tokenizer.from_file(path), {}
        self.model = self.tokenizer.model

    def text(self, text: str) -> bytes:
        raw = text.encode()
        if b"<|" not in raw:  # else a special token may be spelled, which case decides
            raw = raw.lower()
        chunks, cache = raw.split(), self.cache
        found = list(map(cache.get, chunks))
        if None in found:
            if len(cache) > CACHE:
                cache.clear()
            for k, v in enumerate(found):
                if v is None:
                    c = chunks[k]
                    if (v := cache.get(c)) is None:
                        v = cache[c] = self._new(c)
                    found[k] = v
        return b"".join(found)

    def _new(self, c: bytes) -> bytes:
        if c[-1:] in b".," and len(c) > 1 and self._ends_plainly(word := c[:-1]):
            # a full stop or comma behind such a letter is always a token of its own, at a chunk's end
            end, cache = c[-1:], self.cache
            if (ids := cache.get(word)) is None and (ids := self._word(word)) is None:
                return self._whole(c)
            cache[word] = ids
            if end not in cache:
                cache[end] = self._whole(end)
            return ids + cache[end]
        return self._word(c) or self._whole(c)

    @staticmethod
    def _ends_plainly(word: bytes) -> bool:
        """Whether the last character is a letter that the normaliser keeps as one letter: any other
        may leave a mark behind, which the next sign would join. The word alone decides, not the cache."""
        if word[-1] < 128:
            return word[-1:].isalpha()
        last = word.decode()[-1]
        return last.isalpha() and last < "\u0250" and last == last.lower()

    def _word(self, c: bytes) -> bytes | None:
        """A run of lower-case Latin letters is one word that nothing normalises or splits: it goes
        straight to the merges. None for anything else, capitals included: a text that may spell a
        special token comes with its case."""
        if c.isalpha() and c == c.lower():
            return _packed(t.id for t in self.model.tokenize(c.decode()))
        if (s := c.decode()).isalpha() and max(s) < "\u0250" and s == s.lower():
            return _packed(t.id for t in self.model.tokenize(c.decode("latin-1").translate(_SHOWN)))
        return None

    def _whole(self, c: bytes) -> bytes:
        return _packed(self.tokenizer.encode(c.decode(), add_special_tokens=False).ids)


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One for each worker process, whose cache serves all its tasks."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


class SegmentTree:
    """How many open bins have each remaining capacity; finds the smallest one that holds a length."""

    def __init__(self, size: int):
        self.leaves = 1 << size.bit_length()
        self.n = [0] * (2 * self.leaves)

    def add(self, at: int, k: int) -> None:
        at += self.leaves
        while at:
            self.n[at] += k
            at >>= 1

    def tightest(self, least: int) -> int | None:
        at = least + self.leaves
        if self.n[at]:
            return least
        while at > 1:
            if at % 2 == 0 and self.n[at + 1]:
                at += 1
                while at < self.leaves:
                    at = 2 * at if self.n[2 * at] else 2 * at + 1
                return at - self.leaves
            at >>= 1
        return None


def plan(counts: dict[int, int], size: int = SIZE) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, ranks, first bin, pieces a bin, place in the bin) for each run of pieces.

    What best fit decreasing does one piece at a time: a piece goes to the tightest open bin, and
    the next of its length to the same bin while it fits, for that bin is then the tightest. A
    range of equal bins at least halves its room each time it is used, so there are at most
    12 entries for each of the four ranges or fewer that a length can add.
    """
    tree, ranges, out, bins = SegmentTree(size), {}, [], 0
    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            room = tree.tightest(length)
            if room is None:
                a_bin = size // length
                first, n, room = bins, -(-left // a_bin), size
                bins += n
            else:
                first, n = ranges[room].pop()
                tree.add(room, -1)
                a_bin = room // length
            full = min(n, left // a_bin)
            rest = left - full * a_bin if full < n else 0
            put = []
            if full:
                out.append((length, rank, full * a_bin, first, a_bin, size - room))
                rank, left = rank + full * a_bin, left - full * a_bin
                put.append((room - a_bin * length, first, full))
            if rest:
                out.append((length, rank, rest, first + full, rest, size - room))
                rank, left = rank + rest, left - rest
                put.append((room - rest * length, first + full, 1))
            if (over := n - full - bool(rest)) > 0:
                put.append((room, first + full + bool(rest), over))
            for r, at, k in put:
                if r:
                    ranges.setdefault(r, []).append((at, k))
                    tree.add(r, 1)
    return out


def pieces(df: DataFrame, tokenizer: str, size: int = SIZE, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): each text's ids and a closing 1, cut every `size` ids."""
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        own = encoder(tokenizer)
        for batch in batches:
            rows: list[tuple] = []
            for key, t in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                ids = own.text(t or "") + END.to_bytes(4, "little")
                for k in range(0, len(ids), 4 * size):
                    part = ids[k : k + 4 * size]
                    rows.append((key, k // (4 * size), k // 4, len(part) // 4, zlib.crc32(part)))
            cols = list(zip(*rows, strict=True)) or [()] * 5
            kinds = (batch.schema.field("doc_id").type, pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    shaped = df.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    schema = shaped.select("doc_id", *(F.lit(None).cast(k).alias(c) for c, k in (("piece", "int"), ("start", "long"), ("length", "long"), ("ids_crc32", "long")))).schema
    return shaped.mapInArrow(run, schema)


def pack(df: DataFrame, tokenizer: str, size: int = SIZE, salts: int | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset), a row per piece.

    A null text counts as empty and is one piece of one token. Repeated rows are packed as often as
    they occur, a null doc_id like any other; of pieces of one length any may take any place. Other
    columns are left out; an empty df gives an empty result. Pieces of a length are ranked in `salts`
    groups, by default in as many as hold about a million of all pieces each, 256 at least.
    """
    spark = df.sparkSession
    cut = checkpointed(pieces(df, tokenizer, size, doc_id, text).withColumn("__uid", F.monotonically_increasing_id()))
    salts = salts or max(256, -(-cut.count() // 1_000_000))
    cut = cut.withColumn("__salt", F.pmod(F.xxhash64("__uid"), F.lit(salts)).cast("int"))
    # at most `salts` rows of each length; their prefix sums give each group the rank that it begins at
    groups = checkpointed(cut.groupBy("length", "__salt").agg(F.count("*").alias("n")))
    before = Window.partitionBy("length").orderBy("__salt").rowsBetween(Window.unboundedPreceding, -1)
    begins = groups.select("length", "__salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__begin"))
    counts = {r["length"]: r["n"] for r in groups.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `size` rows
    runs: dict[int, list] = {}
    for length, *run in plan(counts, size):
        runs.setdefault(length, []).append(run)
    sent = spark.sparkContext.broadcast({k: np.array(v, dtype=np.int64) for k, v in runs.items()})

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("__rank").to_numpy()
            bins, offset = np.empty_like(length), np.empty_like(length)
            order = np.argsort(length, kind="stable")
            cuts = np.nonzero(np.diff(length[order]))[0] + 1
            for own in np.split(order, cuts) if len(order) else []:
                of = sent.value[int(length[own[0]])]
                at = np.searchsorted(of[:, 0], rank[own], side="right") - 1
                j = rank[own] - of[at, 0]
                bins[own] = of[at, 2] + j // of[at, 3]
                offset[own] = of[at, 4] + j % of[at, 3] * length[own]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(bins), pa.array(offset)], [*batch.schema.names[:5], "sequence_id", "offset"])

    within = Window.partitionBy("length", "__salt").orderBy("__uid")
    ranked = cut.withColumn("__nth", F.row_number().over(within) - 1).join(begins, ["length", "__salt"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("__begin") + F.col("__nth")).alias("__rank"))
    schema = ranked.select(*ranked.columns[:5], F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset")).schema
    return ranked.mapInArrow(place, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return pack(docs, public_tokenizers.path(TOKENIZER))
