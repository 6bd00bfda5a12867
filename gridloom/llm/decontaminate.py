"""Benchmark decontamination by spaced-seed hashing.

A fixed mask picks some positions of a token window and ignores the others; equal hashes of the
picked tokens are a hit although an ignored token was replaced. The masks are such that any passage
that counts has a hit. Around each hit the benchmark item is laid over the document and tokens are
compared place by place.

The benchmark's hashes are a table. A filter of fixed size tells most document hashes from them
where the document is read; what passes is joined with the table, and only the texts that are left
are read again to be verified. Nothing of the benchmark's or the corpus's size reaches the driver.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import CELLS, Scratch, bitmap, checkpointed, forget, marked, small_batches

TOKEN = re.compile(r"[^\W_]+")
#: 1 picks a token, 0 ignores it. From the given window length on, up to the next one,
#: every choice of a fifth of the tokens leaves one of the masks a place without any of them.
MASKS = {20: ("1111011", "1110100011", "1110111"), 15: ("111011", "11111"), 8: ("11101", "1111")}
CACHE = 300_000
#: Contaminated texts, and ids in their lists, that are sent to all tasks.
SENT = 100_000


class Tokens:
    """64-bit hashes of lower-case tokens, with a cache of bounded size."""

    def __init__(self) -> None:
        self.cache: dict[str, int] = {}

    def of(self, text: str | None) -> np.ndarray:
        words, cache = TOKEN.findall((text or "").lower()), self.cache
        found = [cache.get(w) for w in words]
        if None in found:
            if len(cache) > CACHE:
                cache.clear()
            for k, v in enumerate(found):
                if v is None:
                    found[k] = cache[words[k]] = xxhash.xxh64_intdigest(words[k])
        return np.array(found, dtype=np.uint64)


def seeds(tokens: np.ndarray, mask: str) -> np.ndarray:
    """The hash of each window's picked tokens, in order of place."""
    n = len(tokens) - len(mask) + 1
    out = np.full(max(n, 0), len(mask), dtype=np.uint64)
    for k, bit in enumerate(mask if n > 0 else ""):
        if bit == "1":
            out = (out ^ tokens[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(29)
    return out


def masks_for(n: int, window: int = 20, share: float = 0.8) -> list[str]:
    """Masks that no allowed replacement of tokens can spoil everywhere in an item of n tokens: the
    fixed ones, or, where those are not made for a window or share, the longest run of tokens that
    must stay; under 8 tokens the window as a whole."""
    w = min(n, window)
    if w < 8:
        return ["1" * w] if w else []
    least = math.ceil(share * w)
    if w <= 20 and 5 * (w - least) <= w:
        return list(next(own for size, own in MASKS.items() if w >= size))
    return ["1" * max(1, -(-least // (w - least + 1)))]


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    tokens = Tokens()
    for batch in batches:
        found = [tokens.of(t).view(np.int64) for t in batch.column("text").to_pylist()]
        names = [c for c in batch.schema.names if c != "text"]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(found, pa.list_(pa.int64()))], [*names, "tokens"])


def _item_seeds(batches: Iterator[pa.RecordBatch], masks: list[str], window: int, share: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        parts = [(np.array([], np.uint64), 0, 0)]
        for ikey, tokens in zip(batch.column("ikey").to_pylist(), batch.column("tokens").to_pylist(), strict=True):
            own = np.array(tokens, dtype=np.int64).view(np.uint64)
            parts += [(seeds(own, m), masks.index(m), ikey) for m in masks_for(len(own), window, share)]
        size = [len(h) for h, _, _ in parts]
        of = lambda k, kind: pa.array(np.repeat(np.array([p[k] for p in parts], kind), size))
        at = pa.array(np.concatenate([np.arange(n, dtype=np.int32) for n in size]))
        yield pa.RecordBatch.from_arrays([of(1, np.int32), pa.array(np.concatenate([p[0] for p in parts]).view(np.int64)), of(2, np.int64), at], ["m", "h", "ikey", "at"])


def _doc_seeds(batches: Iterator[pa.RecordBatch], masks: list[str], bits: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Hashes that the filter lets pass; a text that the batch repeats gives them once."""
    forget()
    tokens, cells, low = Tokens(), np.uint64(64 - CELLS), np.uint64(63)
    for batch in batches:
        keys = list(zip(batch.column("k1").to_pylist(), batch.column("k2").to_pylist(), strict=True))
        first = list({k: i for i, k in reversed(list(enumerate(keys)))}.values())
        docs = [tokens.of(t) for t in batch.column("text").take(pa.array(first, pa.int64())).to_pylist()]
        every, owner = np.concatenate([np.array([], np.uint64), *docs]), np.repeat(np.array(first, np.int64), [len(d) for d in docs])
        begin = np.repeat(np.cumsum([0, *(len(d) for d in docs)])[:-1], [len(d) for d in docs])
        for k, mask in enumerate(masks):
            h = seeds(every, mask)
            at = np.nonzero(bits[(h >> cells).astype(np.int64)] >> (h & low) & np.uint64(1))[0]
            at = at[owner[at] == owner[at + len(mask) - 1]]
            rows = pa.array(owner[at])
            yield pa.RecordBatch.from_arrays([batch.column("k1").take(rows), batch.column("k2").take(rows), pa.array(np.full(len(at), k, np.int32)), pa.array(h[at].view(np.int64)), pa.array((at - begin[at]).astype(np.int32))], ["k1", "k2", "m", "h", "p"])


def _enough(batches: Iterator[pa.RecordBatch], window: int, share: float) -> Iterator[pa.RecordBatch]:
    """Candidates with enough equal tokens in some window around the hit, which lies in the middle of
    the document's tokens and the item's; null is outside of either."""

    def table(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
        flat = column.flatten()
        there = flat.is_valid().to_numpy(zero_copy_only=False).reshape(len(column), -1)
        return flat.fill_null(0).to_numpy().reshape(there.shape), there

    def sums(x: np.ndarray) -> np.ndarray:
        total = np.cumsum(np.pad(x, ((0, 0), (1, 0))), axis=1, dtype=np.int32)
        return total[:, window:] - total[:, :-window]

    for batch in batches:
        if batch.num_rows:
            (doc, here), (item, there) = table(batch.column("dw")), table(batch.column("iw"))
            w = np.minimum(batch.column("n").to_numpy(), window)[:, None]
            inside = here & there
            good = (sums(inside) == w) & (sums(inside & (doc == item)) >= np.where(w >= 8, share * w, w))
            yield batch.select(["k1", "k2", "ikey", "shift"]).filter(pa.array(good.any(axis=1)))


def _around(tokens: str, at: Column, first: Column | int, last: Column | int) -> Column:
    """Tokens from place at + first to at + last, null where there is none."""
    return F.transform(F.sequence(at + first, at + last), lambda i: F.get(F.col(tokens), i))


def _found(scratch: Scratch, texts: DataFrame, benchmark: DataFrame, window: int, share: float) -> DataFrame:
    """(k1, k2, ids, n) of the contaminated among texts (k1, k2, text)."""
    spark = texts.sparkSession
    items = benchmark.where("text IS NOT NULL AND text != ''").select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    items = items.groupBy("text").agg(F.collect_set("item_id").alias("ids")).select(F.xxhash64("text").alias("ikey"), "ids", "text")
    items = scratch.table(items.mapInArrow(_tokens, "ikey long, ids array<long>, tokens array<long>").where("size(tokens) > 0"), "items")
    sizes = [r[0] for r in items.select(F.least(F.size("tokens"), F.lit(window))).distinct().collect()]  # at most `window` numbers
    masks = sorted({m for n in sizes for m in masks_for(n, window, share)})
    own = scratch.table(items.select("ikey", "tokens").mapInArrow(lambda b: _item_seeds(b, masks, window, share), "m int, h long, ikey long, at int"), "seeds")
    bits, cells = np.zeros(1 << CELLS, np.uint64), bitmap(own, "h").toArrow()  # 2**CELLS rows at most
    bits[cells.column("cell").to_numpy()] = cells.column("bits").to_numpy().view(np.uint64)
    sent = spark.sparkContext.broadcast(bits)
    hits = texts.mapInArrow(lambda b: _doc_seeds(b, masks, sent.value), "k1 long, k2 long, m int, h long, p int")
    hits = scratch.table(hits, "hits").distinct()
    found = scratch.table(hits.join(own, ["m", "h"]).select("k1", "k2", "ikey", (F.col("p") - F.col("at")).alias("shift"), "at"), "candidates")
    # of the hits of one alignment within `step` places one stays, and windows up to `step` later are looked at
    step = max(1, window // 4)
    found = found.groupBy("k1", "k2", "ikey", "shift", F.floor(F.col("at") / step).alias("part")).agg(F.min("at").alias("at")).drop("part")
    found = scratch.table(found, "apart")
    seen = scratch.table(bitmap(found.select("k1"), "k1"), "seen")
    again = marked(texts, "k1", seen, "again").where("again").drop("again").mapInArrow(_tokens, "k1 long, k2 long, tokens array<long>")
    again = scratch.table(again.dropDuplicates(["k1", "k2"]), "texts")
    place = F.col("at") + F.col("shift")
    near = found.join(again, ["k1", "k2"]).select("k1", "k2", "ikey", "shift", "at", _around("tokens", place, 1 - window, window + step - 2).alias("dw"))
    near = near.join(items, "ikey").select("k1", "k2", "ikey", "shift", "dw", _around("tokens", F.col("at"), 1 - window, window + step - 2).alias("iw"), F.size("tokens").alias("n"))
    good = scratch.table(near.mapInArrow(lambda b: _enough(b, window, share), "k1 long, k2 long, ikey long, shift int"), "near").distinct()
    laid = good.join(items.select("ikey", "ids", F.col("tokens").alias("item")), "ikey").join(again, ["k1", "k2"])
    equal = F.size(F.filter(F.zip_with("item", _around("tokens", F.col("shift"), 0, F.size("item") - 1), lambda a, b: a == b), lambda same: same))
    laid = laid.select("k1", "k2", "ids", equal.alias("n"))
    return laid.groupBy("k1", "k2").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("ids")))).alias("ids"), F.max("n").cast("long").alias("n"))


def decontaminate(df: DataFrame, benchmark: DataFrame, text: str = "text", window: int = 20, share: float = 0.8, keep_text: bool = True, sent: int = SENT) -> DataFrame:
    """df with contaminated (boolean), item_ids (sorted list of long) and n_matched (long).

    A document is contaminated by an item if some window of `window` tokens of the item (all of a
    shorter item) lies in it with at least `share` of the tokens equal, place by place; items under
    8 tokens have to be equal. n_matched is the largest number of equal tokens over its items. Null texts and null or
    empty items match nothing; items without an id count with a null id left out of the list;
    columns of those names are replaced; an empty benchmark leaves all documents clean. Equal texts
    are verified once. df is read three times, so it should be a table. Up to `sent` contaminated
    texts are sent to all tasks; beyond that, the rows that a filter of bounded size takes for
    contaminated are shuffled, and no others.
    """
    spark = df.sparkSession
    small_batches(spark)
    rest = [c for c in df.columns if c not in ("contaminated", "item_ids", "n_matched") and (keep_text or c != text)]
    whole = F.col(text).cast("string")
    k1, k2 = F.xxhash64(whole), F.xxhash64(F.lit(1), whole)
    with Scratch(spark) as scratch:
        texts = df.where(F.col(text).isNotNull()).select(k1.alias("k1"), k2.alias("k2"), whole.alias("text"))
        found = checkpointed(_found(scratch, texts, benchmark, window, share))
        size = found.agg(F.count("*"), F.sum(F.size("ids"))).first()
        small = size[0] + (size[1] or 0) <= sent
        seen = None if small else checkpointed(bitmap(found.select("k1"), "k1"))
    row = F.struct(*(F.col(f"`{c}`") for c in rest)) if rest else F.struct(F.lit(None).alias("none"))
    keyed = df.select(row.alias("row"), *(F.when(F.col(text).isNotNull(), k).alias(name) for k, name in ((k1, "k1"), (k2, "k2"))))
    if small:
        out = keyed.join(F.broadcast(found), ["k1", "k2"], "left")
    else:
        split = marked(keyed, "k1", seen, "again")
        alone = split.where("NOT again").withColumns({"ids": F.lit(None).cast("array<long>"), "n": F.lit(None).cast("long")})
        out = split.where("again").join(found, ["k1", "k2"], "left").unionByName(alone)
    own = [F.col("n").isNotNull().alias("contaminated"), F.coalesce("ids", F.array().cast("array<long>")).alias("item_ids"), F.coalesce("n", F.lit(0)).alias("n_matched")]
    return out.select(*([F.col("row.*")] if rest else []), *own)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), keep_text=False)
    return out.select("doc_id", "contaminated", "item_ids", "n_matched", (~F.col("contaminated")).alias("kept"))


SQL = """
WITH dt AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}]+') AS ts FROM documents),
bt AS (SELECT item_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS ts FROM benchmark WHERE text <> ''),
d AS (SELECT doc_id, len(ts) AS n, unnest(ts) AS t, generate_subscripts(ts, 1) - 1 AS p FROM dt),
b AS (SELECT item_id, len(ts) AS m, unnest(ts) AS t, generate_subscripts(ts, 1) - 1 AS q FROM bt),
h AS (SELECT doc_id, item_id, n, m, p - q AS shift, q, least(m, 20) AS w FROM d JOIN b USING (t)),
many AS (SELECT doc_id, item_id, shift FROM h GROUP BY doc_id, item_id, shift, w HAVING count(*) >= CASE WHEN w >= 8 THEN 0.8 * w ELSE w END),
k AS (SELECT h.*, count(*) OVER (PARTITION BY doc_id, item_id, shift ORDER BY q RANGE BETWEEN CURRENT ROW AND w - 1 FOLLOWING) AS near,
  count(*) OVER (PARTITION BY doc_id, item_id, shift) AS equal FROM h JOIN many USING (doc_id, item_id, shift)),
ok AS (SELECT doc_id, item_id, max(equal) AS equal FROM k WHERE least(m, n - shift) - greatest(0, -shift) >= w AND near >= CASE WHEN w >= 8 THEN 0.8 * w ELSE w END GROUP BY ALL),
f AS (SELECT doc_id, list_sort(list(item_id)) AS item_ids, max(equal) AS n_matched FROM ok GROUP BY doc_id)
SELECT documents.doc_id, f.doc_id IS NOT NULL AS contaminated, coalesce(item_ids, []) AS item_ids, CAST(coalesce(n_matched, 0) AS BIGINT) AS n_matched, f.doc_id IS NULL AS kept
FROM documents LEFT JOIN f ON f.doc_id = documents.doc_id
"""
