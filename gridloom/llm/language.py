"""Language ID, words first: known words by their log frequency in each language, unseen words by
the longest character n-grams that are known.

The tables are learned from a sample of labelled documents of a stated size (about `docs` of each
language) and hold every word and n-gram of the sample, words by a 64-bit hash; they are broadcast,
and every whole text is scored against them in one pass without a shuffle.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed, kept, small_batches

WORD = re.compile(r"[^\W\d_]+")
ORDERS = (4, 3, 2, 1)
ALPHA = 0.1
CACHE = 200_000
#: Words that are looked up together.
STEP = 20_000


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found: Counter = Counter()
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
            found.update((lang, w) for w in WORD.findall(text.lower()))
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in found], pa.string()), pa.array([k[1] for k in found], pa.string()), pa.array(list(found.values()), pa.int64())], ["lang", "word", "n"])


def _grams(word: Column) -> Column:
    """The n-grams at each place of a word between markers."""
    marked = F.concat(F.lit("^"), word, F.lit("$"))

    def of(n: int) -> Column:
        places = F.sequence(F.lit(1), F.greatest(F.length(marked) - (n - 1), F.lit(1)))
        return F.transform(places, lambda i: F.substring(marked, i, F.lit(n)))

    # a word of one letter has no 4-gram
    return F.concat(*(F.when(F.length(marked) >= n, of(n)).otherwise(F.array().cast("array<string>")) for n in ORDERS))


def _hash(word: str) -> int:
    """What F.xxhash64 gives, as an unsigned number."""
    return xxhash.xxh64_intdigest(word, 42)


def learn(labelled: DataFrame, docs: int = 3000) -> dict:
    """Tables from labelled rows (doc_id, lang, text): about `docs` documents of each language, chosen
    by a hash of doc_id, and all of their words and n-grams. Rows without lang or text teach nothing."""
    labelled = labelled.where("lang IS NOT NULL AND text IS NOT NULL").select("doc_id", "lang", "text")
    small_batches(labelled.sparkSession)
    sizes = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a row a language
    if not sizes:
        return {"langs": [], "words": np.array([], np.uint64), "rows": np.zeros((0, 0), np.float32), "grams": {}}
    share = F.create_map(*[x for k, n in sorted(sizes.items()) for x in (F.lit(k), F.lit(min(1.0, docs / n)))])
    draw = F.pmod(F.xxhash64(F.lit(6), "doc_id"), F.lit(1 << 30)) / float(1 << 30)
    sample = labelled.where(draw < F.element_at(share, F.col("lang"))).select("lang", "text")
    counts = checkpointed(sample.mapInArrow(_counts, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")))
    langs = sorted(sizes)
    code = F.array_position(F.array(*map(F.lit, langs)), F.col("lang")).cast("int") - 1
    known = counts.select(F.xxhash64("word").alias("key"), code.alias("at"), "n").toArrow()  # the sample's words
    by_gram = counts.select("lang", "n", F.explode(_grams(F.col("word"))).alias("key")).groupBy("key", "lang").agg(F.sum("n").alias("n"))
    parts = by_gram.select("key", code.alias("at"), "n").toArrow()  # the sample's n-grams

    def table(keys: np.ndarray, at: np.ndarray, rows: pa.Table) -> np.ndarray:
        m = np.zeros((len(keys), len(langs)))
        np.add.at(m, (at, rows.column("at").to_numpy()), rows.column("n").to_numpy())
        return m

    words, at = np.unique(known.column("key").to_numpy().view(np.uint64), return_inverse=True)
    m = table(words, at, known)
    logs = np.log((m + ALPHA) / (m.sum(0) + ALPHA * max(1, len(words))))
    coded = parts.column("key").combine_chunks().dictionary_encode()
    grams = coded.dictionary.to_pylist()
    g = table(grams, coded.indices.to_numpy(), parts)
    order, glogs = np.array([len(k) for k in grams]), np.zeros_like(g)
    for n in ORDERS:
        if (own := order == n).any():
            glogs[own] = np.log((g[own] + ALPHA) / (g[own].sum(0) + ALPHA * own.sum()))
    return {"langs": langs, "words": words, "rows": logs.astype(np.float32), "grams": {k: i for i, k in enumerate(grams)}, "gram_rows": glogs.astype(np.float32)}


class Scorer:
    """Scores whole texts; the rows of words that came by are kept in a cache of bounded size."""

    def __init__(self, model: dict):
        self.langs, self.grams = model["langs"], model["grams"]
        self.words = np.append(model["words"], np.uint64(0))  # so that a place behind the last word is one too
        self.known = np.vstack([model["rows"], np.zeros((1, len(self.langs)))]) if self.langs else None
        self.gram_rows = np.vstack([model["gram_rows"], np.zeros((1, len(self.langs)))]) if self.langs else None
        self.ids: dict[str, int] = {}
        self.rows = np.zeros((CACHE + STEP, len(self.langs)), np.float32)

    def unseen(self, words: list[str]) -> np.ndarray:
        """For each word the mean row of its longest known n-grams; zeros for one without any."""
        get, none, flat, starts = self.grams.get, [len(self.gram_rows) - 1], [], []
        for word in words:
            marked, own = f"^{word}$", none
            for n in ORDERS:
                if found := [k for k in map(get, [marked[i : i + n] for i in range(len(marked) - n + 1)]) if k is not None]:
                    own = found
                    break
            starts.append(len(flat))
            flat += own
        sizes = np.diff([*starts, len(flat)])
        return np.add.reduceat(self.gram_rows[flat], starts, axis=0) / sizes[:, None]

    def fill(self, new: list[str]) -> None:
        """Rows for words that the cache lacks: known ones from the table, others by their n-grams."""
        first, hashes = len(self.ids), np.array([_hash(w) for w in new], dtype=np.uint64)
        at = np.searchsorted(self.words[:-1], hashes)
        found = (self.words[at] == hashes) & (at < len(self.words) - 1)
        rows = self.rows[first : first + len(new)]
        rows[found] = self.known[at[found]]
        if not found.all():
            others = np.nonzero(~found)[0]
            rows[others] = self.unseen([new[k] for k in others])
        self.ids.update(zip(new, range(first, first + len(new)), strict=True))

    def one(self, text: str | None) -> tuple[str, float]:
        """The likeliest language of all words together, and its probability for a word of average
        evidence: that of all words would be 1 for any text of some length, however mixed."""
        if not text or not self.langs or not any(c.isalpha() for c in text):
            return "und", 0.0
        words, total = WORD.findall(text.lower()), np.zeros(len(self.langs))
        for i in range(0, len(words), STEP):
            if len(self.ids) > CACHE:
                self.ids = {}
            part, ids = words[i : i + STEP], self.ids
            at = list(map(ids.get, part))
            if None in at:
                self.fill(list(dict.fromkeys(w for w, k in zip(part, at, strict=True) if k is None)))
                at = list(map(ids.__getitem__, part))
            total += self.rows[at].sum(0, dtype=np.float64)
        best = int(total.argmax())
        return self.langs[best], 1.0 / float(np.exp((total - total[best]) / max(1, len(words))).sum())


def predicted(spark: SparkSession, model: dict) -> Callable[[Column], Column]:
    """A function from a text column to a struct (lang_pred, score). Only texts go to Python."""
    small_batches(spark)
    sent, key = spark.sparkContext.broadcast(model), uuid.uuid4().hex

    @F.arrow_udf("lang_pred string, score double")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scorer = kept(key, lambda: Scorer(sent.value))
        for batch in batches:
            found = [scorer.one(t) for t in batch.to_pylist()]
            yield pa.StructArray.from_arrays([pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], ["lang_pred", "score"])

    return lambda text: run(text.cast("string"))


def predict(df: DataFrame, model: dict, text: str = "text") -> DataFrame:
    """df's columns without the text, and lang_pred, score.

    A null text, or one without a letter, gets `und` and 0. Of languages with equal scores the
    first by name wins. Whole texts count, however long; columns named lang_pred or score are
    replaced; an empty df gives an empty result, and an empty model `und` everywhere.
    """
    rest = [F.col(f"`{c}`") for c in df.columns if c not in (text, "lang_pred", "score")]
    return df.select(*rest, predicted(df.sparkSession, model)(F.col(text)).alias("__said")).select(*rest, "__said.lang_pred", "__said.score")


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, learned from the documents that are not held out."""
    model = learn(docs.where(~held_out()))
    return predict(docs.select("doc_id", held_out().alias("held_out"), "text"), model)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "held_out", "lang_pred", "score")
