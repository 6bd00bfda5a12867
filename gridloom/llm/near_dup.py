"""MinHash near-duplicates with tensored banding.

Two small collections of half keys are computed for each text, and a table's key is a pair of one
half from each, so that n * n tables cost 2 * n half keys. A key is only formed from halves that
another text shares. Candidates are confirmed on the full shingle sets.

No bucket is expanded into pairs. Each bucket links its members to one centre; where that leaves a
bucket in several components, its members go to an exact join by prefix filter (rarest shingles
first, with a bound from their places) that skips pairs already connected. So no link between
different texts is given up because a bucket is large.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, bitmap, checkpointed, forget, marked, small_batches
from .graph import components

SHINGLE = 5
PERCENT = 85
#: Minhashes in a half key, and the chance to share no table that a pair at the threshold may have.
ROWS, MISS = 3, 0.000025
CACHE = 300_000
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h * _MIX
    return h ^ (h >> np.uint64(29))


class Shingler:
    """Words and shingle sets of texts; word hashes are kept in a cache of bounded size."""

    def __init__(self) -> None:
        self.cache: dict[bytes, int] = {}

    def words(self, text: str | None) -> list[bytes]:
        return (text or "").encode().lower().split()  # bytes: only A-Z, and ASCII white space

    def shingles(self, words: list[bytes]) -> np.ndarray:
        """Sorted distinct 64-bit hashes of the shingles; fewer words are one shingle."""
        if not words:
            return np.array([], np.uint64)
        cache = self.cache
        found = [cache.get(w) for w in words]
        if None in found:
            if len(cache) > CACHE:
                cache.clear()
            for k, v in enumerate(found):
                if v is None:
                    found[k] = cache[words[k]] = xxhash.xxh64_intdigest(words[k])
        h = np.array(found, dtype=np.uint64)
        size = min(SHINGLE, len(h))
        n = len(h) - size + 1
        out = np.full(n, size, dtype=np.uint64)
        for k in range(size):
            out = _mixed(out ^ h[k : k + n])
        return np.unique(out)


def side_for(percent: int) -> int:
    """Half keys on a side: a pair with `percent` of its shingles shared has a half key of each side in
    common but for a chance of MISS. That is 12 at 85 percent and 16 at 80."""
    missed = 1 - (percent / 100) ** ROWS
    return max(1, math.ceil(math.log(MISS / 2) / math.log(missed))) if missed > 0 else 1


@functools.cache
def _family(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(8)
    return rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 1 << 63, n, dtype=np.uint64)


def half_keys(sets: list[np.ndarray], side: int) -> np.ndarray:
    """A row of 2 * side keys for each of the sets, none of which is empty."""
    size = np.array([len(s) for s in sets])
    every, starts = np.concatenate(sets), np.concatenate([[0], np.cumsum(size)[:-1]])
    out, (mul, add) = np.empty((len(sets), 2 * side), np.uint64), _family(2 * side * ROWS)
    for c in range(2 * side):
        key = np.full(len(sets), c, np.uint64)
        for k in range(c * ROWS, (c + 1) * ROWS):
            key = _mixed(key ^ np.minimum.reduceat(every * mul[k] + add[k], starts))
        out[:, c] = key
    return out.view(np.int64)


def _signed(batches: Iterator[pa.RecordBatch], side: int) -> Iterator[pa.RecordBatch]:
    forget()
    shingler = Shingler()
    for batch in batches:
        n = batch.num_rows
        lo, hi, size, keys = [None] * n, [None] * n, [0] * n, [None] * n
        at, sets, held = [], [], 0

        def flush() -> None:
            if sets:
                for k, own in zip(at, half_keys(sets, side), strict=True):
                    keys[k] = own

        for k, text in enumerate(batch.column("text").to_pylist()):
            if words := shingler.words(text):
                h = np.frombuffer(xxhash.xxh3_128_digest(b" ".join(words)), ">i8")
                lo[k], hi[k] = int(h[0]), int(h[1])
                s = shingler.shingles(words)
                size[k] = len(s)
                at.append(k)
                sets.append(s)
                held += len(s)
                if held > 40_000:
                    flush()
                    at, sets, held = [], [], 0
        flush()
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(lo, pa.int64()), pa.array(hi, pa.int64()), pa.array(size, pa.int64()), pa.array(keys, pa.list_(pa.int64()))], ["doc_id", "lo", "hi", "n", "keys"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    shingler = Shingler()
    for batch in batches:
        found = [shingler.shingles(shingler.words(t)).view(np.int64) for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(s) for s in found], pa.int64()), pa.array(found, pa.list_(pa.int64()))], ["doc", "n", "set"])


def _like(common, n, m, percent: int):
    """Whether sets of n and m with `common` shared elements are similar enough."""
    return 100 * common >= percent * (n + m - common)


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough. Nothing follows the last join that would
    need a key's rows together, so that a centre with many members can be split over tasks."""
    one = pairs.select("a", "b").join(sets.select(F.col("doc").alias("b"), F.col("n").alias("nb"), F.col("set").alias("sb")), "b")
    two = one.join(sets.select(F.col("doc").alias("a"), F.col("n").alias("na"), F.col("set").alias("sa")), "a")
    return two.where(_like(F.size(F.array_intersect("sa", "sb")), F.col("na"), F.col("nb"), percent)).select("a", "b")


def _rest(scratch: Scratch, tables: DataFrame, roots: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links that centres can have missed: pairs of different components within a bucket of three or
    more, found exactly by prefix filter among the members of all such buckets."""
    labelled = tables.join(roots, tables["doc"] == roots["node"], "left").select("tkey", "doc", F.coalesce("root", "doc").alias("comp"))
    labelled = scratch.table(labelled, "labelled")
    mixed = scratch.table(labelled.groupBy("tkey").agg(F.min("comp").alias("x"), F.max("comp").alias("y"), F.count("*").alias("n")).where("x != y AND n >= 3").select("tkey"), "mixed")
    hard = scratch.table(labelled.join(mixed, "tkey", "left_semi").select("doc", "comp").distinct(), "hard")
    scratch.drop("labelled", "mixed")
    own = scratch.table(sets.join(hard, "doc").select("doc", "comp", "n", "set"), "own")
    tokens = own.select("doc", F.explode("set").alias("tok"))
    often = scratch.table(tokens.groupBy("tok").agg(F.count("*").alias("df")).where("df > 1"), "often")
    ranked = tokens.join(often, "tok").groupBy("doc").agg(F.sort_array(F.collect_set(F.struct("df", "tok"))).alias("toks"))
    prefix = F.col("n") - F.floor((percent * F.col("n") + 99) / 100) + 1
    alone = F.col("n") - F.size("toks")
    ranked = own.select("doc", "comp", "n").distinct().join(ranked, "doc").withColumn("alone", alone).where(prefix > alone)
    first = ranked.select("doc", "comp", "n", "alone", F.posexplode(F.slice("toks", F.lit(1), (prefix - F.col("alone")).cast("int"))).alias("at", "t"))
    first = scratch.table(first.select("doc", "comp", "n", (F.col("at") + F.col("alone")).alias("at"), F.col("t.tok").alias("tok")), "prefix")
    x, y = first.alias("x"), first.alias("y")
    most = F.least(F.col("x.n") - F.col("x.at"), F.col("y.n") - F.col("y.at"))
    fits = (F.col("x.tok") == F.col("y.tok")) & (F.col("x.doc") < F.col("y.doc")) & (F.col("x.comp") != F.col("y.comp"))
    fits = fits & (100 * F.least("x.n", "y.n") >= percent * F.greatest("x.n", "y.n")) & _like(most, F.col("x.n"), F.col("y.n"), percent)
    pairs = scratch.table(x.join(y, fits).select(F.col("x.doc").alias("a"), F.col("y.doc").alias("b")).distinct(), "rest")
    return _verified(pairs, own.select("doc", "n", "set"), percent)


def near_duplicates(df: DataFrame, percent: int = PERCENT, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), a row per row of df.

    Texts are linked if 100 times the shingles that they share is at least `percent` times the
    shingles of either; component_id is the smallest doc_id that links reach, and kept says that it
    is the row's own. Null, empty and blank texts have no shingles and are linked with nothing.
    Rows that share a doc_id count as one document; a row without doc_id is linked with nothing,
    has a null component_id and is kept. Other columns are left out; an empty df gives an empty
    result. doc_id has to be an integer.
    """
    spark, side = df.sparkSession, side_for(percent)
    small_batches(spark)
    texts = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    with Scratch(spark) as scratch:
        signed = scratch.table(texts.mapInArrow(functools.partial(_signed, side=side), "doc_id long, lo long, hi long, n long, keys array<long>"), "signed")
        named = signed.where("lo IS NOT NULL AND doc_id IS NOT NULL")
        firsts = scratch.table(named.groupBy("lo", "hi").agg(F.min("doc_id").alias("rep")), "firsts")
        members = named.join(firsts, ["lo", "hi"]).select("doc_id", "rep", "n", F.when(F.col("doc_id") == F.col("rep"), F.col("keys")).alias("keys"))
        members = scratch.table(members, "members")
        halves = members.where("keys IS NOT NULL").select(F.col("rep").alias("doc"), F.posexplode("keys").alias("pos", "key"), "n")
        counts = scratch.table(halves.groupBy("pos", "key").agg(F.count("*").alias("shared")).where("shared > 1"), "counts")
        shared = halves.join(counts, ["pos", "key"]).groupBy("doc").agg(F.collect_set(F.struct("pos", "key")).alias("own"), F.sum("shared").alias("degree"), F.max("n").alias("n"))
        left, right = F.filter("own", lambda h: h["pos"] < side), F.filter("own", lambda h: h["pos"] >= side)
        keys = F.flatten(F.transform(left, lambda a: F.transform(right, lambda b: F.xxhash64(a["pos"], a["key"], b["pos"], b["key"]))))
        tables = scratch.table(shared.select("doc", "n", "degree", F.explode(keys).alias("tkey")), "tables")
        scratch.drop("firsts", "counts")
        order = F.shiftleft(F.least(F.col("degree"), F.lit(1 << 30)), 32) + F.xxhash64("doc").bitwiseAND(F.lit((1 << 32) - 1))
        centres = tables.groupBy("tkey").agg(F.max_by("doc", order).alias("a"), F.max_by("n", order).alias("na"), F.count("*").alias("members"))
        centres = scratch.table(centres.where("members > 1").select("tkey", "a", "na"), "centres")
        near = 100 * F.least("n", "na") >= percent * F.greatest("n", "na")
        pairs = scratch.table(tables.join(centres, "tkey").where((F.col("a") != F.col("doc")) & near).select("a", F.col("doc").alias("b")).distinct(), "pairs")
        # candidates by a filter of fixed size: no text is shuffled, and a few too many sets do no harm
        wanted = bitmap(tables.join(centres, "tkey", "left_semi").select(F.xxhash64("doc").alias("h")), "h")
        chosen = marked(texts.where("doc_id IS NOT NULL").withColumn("h", F.xxhash64("doc_id")), "h", scratch.table(wanted, "wanted"), "candidate").where("candidate")
        sets = scratch.table(chosen.select("doc_id", "text").mapInArrow(_sets, "doc long, n long, set array<long>"), "sets")
        roots = components(scratch, _verified(pairs, sets, percent))
        more = _rest(scratch, tables.select("tkey", "doc"), roots, sets, percent)
        ends = components(scratch, roots.select(F.col("node").alias("a"), F.col("root").alias("b")).union(more))
        joined = members.join(ends, members["rep"] == ends["node"], "left").select("doc_id", "n", F.coalesce("root", "rep").alias("component_id"))
        alone = signed.where("lo IS NULL OR doc_id IS NULL").select("doc_id", "n", F.col("doc_id").alias("component_id"))
        return checkpointed(joined.union(alone).select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = f"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < {SHINGLE} THEN [array_to_string(ws, ' ')]
  ELSE list_transform(range(1, len(ws) - {SHINGLE - 2}), lambda i: array_to_string(list_slice(ws, i, i + {SHINGLE - 1}), ' ')) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= {PERCENT} * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
reach(node, root) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.b, r.root FROM reach r JOIN e ON e.a = r.node),
c AS (SELECT node, min(root) AS root FROM reach GROUP BY node)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, root AS component_id, w.doc_id = root AS kept FROM w LEFT JOIN n ON n.doc_id = w.doc_id JOIN c ON c.node = w.doc_id
"""
