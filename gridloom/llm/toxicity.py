"""Toxicity: a factorization machine over hashed terms.

Terms are a text's words and the beginnings of its words, hashed. The machine's score has a weight
for each term and, through the terms' factors, one for each pair of terms that occur together. It
is fitted on a sample of labelled rows whose size is a parameter, over every term of the sample;
which terms and pairs count is left to the penalty. Whole texts are scored in one pass without a
shuffle.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import kept, small_batches

WORD = re.compile(r"[^\W\d_]+")
BITS = 30
STEMS = (3, 4, 5, 6)
CACHE = 300_000


def _terms(word: str) -> list[int]:
    texts = [word, *(word[:n] + "*" for n in STEMS if len(word) > n)]
    return [xxhash.xxh64_intdigest(t) >> (64 - BITS) for t in texts]


def _term_arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [sorted({h for w in set(WORD.findall((t or "").lower())) for h in _terms(w)}) for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(found, pa.list_(pa.int32()))], ["toxic", "terms"])


def sample_labels(labels: DataFrame, rows: int, seed: int = 5) -> tuple[DataFrame, dict[int, float]]:
    """(doc_id, toxic): about rows/2 documents of each class, chosen by a hash of doc_id, never more
    than `rows`; and the share taken of each class. A document with several labels is toxic if one
    says so."""
    one = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    sizes = {r["toxic"]: r["n"] for r in one.groupBy("toxic").agg(F.count("*").alias("n")).collect()}  # two rows
    shares = {label: min(1.0, 0.48 * rows / max(1, sizes.get(label, 0))) for label in (0, 1)}
    draw = F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1 << 30)) / float(1 << 30)
    return one.where(draw < F.when(F.col("toxic") == 1, shares[1]).otherwise(shares[0])).limit(rows), shares


def _sigmoid(m: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(m, -30, 30)))


def _sums(x: np.ndarray, ptr: np.ndarray) -> np.ndarray:
    """Sums of x over ptr[k]:ptr[k + 1], zero where that is empty."""
    out, full = np.zeros((len(ptr) - 1, *x.shape[1:])), np.diff(ptr) > 0
    if full.any():
        out[full] = np.add.reduceat(x, ptr[:-1][full], axis=0)
    return out


class Rows:
    """Documents as runs of columns."""

    def __init__(self, cols: np.ndarray, ptr: np.ndarray):
        self.cols, self.ptr = cols, ptr

    def __len__(self) -> int:
        return len(self.ptr) - 1

    def take(self, of: np.ndarray) -> Rows:
        size = np.diff(self.ptr)[of]
        ptr = np.concatenate([[0], np.cumsum(size)])
        return Rows(self.cols[np.repeat(self.ptr[:-1][of] - ptr[:-1], size) + np.arange(ptr[-1])], ptr)


class Machine:
    """b + sum of w over the terms + sum over pairs of the factors' products."""

    def __init__(self, terms: np.ndarray, w: np.ndarray, v: np.ndarray, b: float):
        self.terms, self.w, self.v, self.b = terms, w, v, b

    def margin(self, rows: Rows) -> np.ndarray:
        v = self.v[rows.cols]
        s = _sums(v, rows.ptr)
        return self.b + _sums(self.w[rows.cols], rows.ptr) + 0.5 * ((s * s).sum(1) - _sums((v * v).sum(1), rows.ptr))


#: Rows whose gradients are gathered at once.
BATCH = 128


def fit(rows: Rows, y: np.ndarray, width: int, rank: int = 8, epochs: int = 20, penalty: float = 0.08, start: float = 0.01, seed: int = 5) -> tuple[np.ndarray, np.ndarray, float]:
    """Weights, factors and bias, by follow-the-regularised-leader with an absolute penalty.

    A weight stays 0 until the gradients of its term add up to `penalty` times the root of the
    number of rows, an epoch: chance alone reaches that in few terms, whatever the sample's size. A
    factor starts near 0, moves once its own gradients add up to four fifths of that, and is 0 if it
    never moves. Classes count halfway to alike.
    """
    rng, n, bad = np.random.default_rng(seed), len(rows), float(y.sum())
    each = np.where(y == 1, n / (2 * max(1.0, bad)), n / (2 * max(1.0, n - bad))) ** 0.5
    flat = np.float32
    w, zw, nw = (np.zeros(width, flat) for _ in range(3))
    first = rng.normal(0, start, (rank, width)).astype(flat)
    moved, zv, nv = (np.zeros((rank, width), flat) for _ in range(3))
    b, gb, least = 0.0, 1.0, penalty * epochs * n**0.5

    def stepped(value, z, squares, g, rate, hold):
        before = np.sqrt(squares)
        squares = squares + g * g
        z = z + g - (np.sqrt(squares) - before) / rate * value
        return np.where(np.abs(z) <= hold, 0, (np.sign(z) * hold - z) * rate / (1 + np.sqrt(squares))), z, squares

    batches = []
    for part in np.array_split(rng.permutation(n), max(1, n // BATCH)):
        own = rows.take(part)
        used, at = np.unique(own.cols, return_inverse=True)
        batches.append((part, own.ptr, used.astype(np.int32), at.astype(np.int32)))
    for _ in range(epochs):
        for k in rng.permutation(len(batches)):
            part, ptr, used, at = batches[k]
            size = np.diff(ptr)
            v = [(first[f][used] + moved[f][used])[at] for f in range(rank)]
            s = [_sums(x, ptr) for x in v]
            m = b + _sums(w[used][at], ptr) + 0.5 * sum(x * x - _sums(y2 * y2, ptr) for x, y2 in zip(s, v, strict=True))
            e = (_sigmoid(m) - y[part]) * each[part]
            push = np.repeat(e, size)
            w[used], zw[used], nw[used] = stepped(w[used], zw[used], nw[used], np.bincount(at, push, minlength=len(used)), 0.2, least)
            for f in range(rank):
                g = np.bincount(at, np.repeat(e * s[f], size) - push * v[f], minlength=len(used))
                moved[f, used], zv[f, used], nv[f, used] = stepped(moved[f, used], zv[f, used], nv[f, used], g, 0.05, 0.8 * least)
            db = float(e.sum())
            gb += db * db
            b -= 0.2 * db / gb**0.5
    return w.astype(float), np.where((moved != 0).any(0), first + moved, 0).T.astype(float), b


def calibrated(m: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and offset that turn margins of rows that were not learned from into log odds."""
    bad, good = (weight * y).sum(), (weight * (1 - y)).sum()
    target = np.where(y == 1, (bad + 1) / (bad + 2), 1 / (good + 2))
    k, c = 1.0, 0.0
    for _ in range(60):
        q = _sigmoid(k * m + c)
        h = weight * q * (1 - q)
        g = np.array([(weight * (q - target) * m).sum() + 1e-2 * (k - 1), (weight * (q - target)).sum()])
        hess = np.array([[(h * m * m).sum() + 1e-2, (h * m).sum()], [(h * m).sum(), h.sum() + 1e-6]])
        k, c = np.array([k, c]) - np.clip(np.linalg.solve(hess, g), -1, 1)
    return max(k, 1e-3), c


def learn(docs: DataFrame, labels: DataFrame, rows: int = 10_000, rank: int = 8, epochs: int = 20) -> Machine:
    """Fit on at most `rows` labelled documents, over all of their terms.

    Three machines, each fitted on two thirds of them, give margins for the third that they have not
    seen; these say what margin means what probability, the classes weighed as they were before the
    sample. The machine that is returned is fitted on all. Of rows that share an id one teaches. Without
    labels of both classes the machine scores 0.5 everywhere.
    """
    spark = docs.sparkSession
    small_batches(spark)
    sample, shares = sample_labels(labels, rows)
    chosen = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")  # at most `rows` pairs of numbers
    chosen = chosen.groupBy("doc_id", "toxic").agg(F.min(F.col("text").cast("string")).alias("text"))
    arrays = chosen.select("toxic", "text").mapInArrow(_term_arrays, "toxic int, terms array<int>")
    got = arrays.toArrow().combine_chunks()  # at most `rows` rows of hashed terms
    y = np.array(got.column("toxic").to_numpy(), dtype=float)
    if not 0 < y.sum() < len(y):
        return Machine(np.array([], dtype=np.int64), np.zeros(0), np.zeros((0, rank)), 0.0)
    lists = pa.concat_arrays(got.column("terms").chunks)
    hashes, cols = np.unique(lists.flatten().to_numpy(), return_inverse=True)
    cols = cols.astype(np.int32)
    # rows arrive in any order; sorted by what they hold, the fit is the same wherever they ran
    every = Rows(cols, np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())]))
    del got, lists
    seal = [(float(t), int(c.sum()), len(c), c[:64].tobytes()) for t, c in zip(y, np.split(cols, every.ptr[1:-1]), strict=True)]
    order = np.array(sorted(range(len(y)), key=seal.__getitem__))
    every, y = every.take(order), y[order]
    del cols, seal
    weight = np.where(y == 1, 1 / shares[1], 1 / shares[0])
    fold, margins = np.random.default_rng(3).permutation(len(y)) % 3, np.zeros(len(y))
    for k in range(3):
        rest, held = np.nonzero(fold != k)[0], np.nonzero(fold == k)[0]
        if 0 < y[rest].sum() < len(rest):
            margins[held] = Machine(hashes, *fit(every.take(rest), y[rest], len(hashes), rank, epochs)).margin(every.take(held))
    k, c = calibrated(margins, y, weight)
    w, v, b = fit(every, y, len(hashes), rank, epochs)
    active = (w != 0) | (v != 0).any(1)
    return Machine(hashes[active].astype(np.int64), k * w[active], k**0.5 * v[active], k * b + c)


class Scorer:
    """Scores texts; each word's terms among the machine's are kept in a cache of bounded size."""

    def __init__(self, machine: Machine):
        self.m, self.at, self.cache = machine, {int(t): k for k, t in enumerate(machine.terms)}, {}

    def one(self, text: str | None) -> float:
        cache, at, own = self.cache, self.at, set()
        for w in set(WORD.findall((text or "").lower())):
            idx = cache.get(w)
            if idx is None:
                if len(cache) >= CACHE:
                    cache.clear()
                idx = cache[w] = tuple(k for h in _terms(w) if (k := at.get(h)) is not None)
            if idx:
                own.update(idx)
        return float(_sigmoid(self.m.margin(Rows(np.array(sorted(own), dtype=np.int64), np.array([0, len(own)]))))[0])


def score(df: DataFrame, machine: Machine, text: str = "text") -> DataFrame:
    """df's columns without the text, and score, predicted.

    Null and empty texts have no terms and get the machine's bias. Whole texts count, however
    long; repeated rows score alike; columns named score or predicted are replaced.
    """
    small_batches(df.sparkSession)
    sent, key = df.sparkSession.sparkContext.broadcast(machine), uuid.uuid4().hex

    @F.arrow_udf("double")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scorer = kept(key, lambda: Scorer(sent.value))
        for batch in batches:
            yield pa.array([scorer.one(t) for t in batch.to_pylist()], pa.float64())

    rest = [F.col(f"`{c}`") for c in df.columns if c not in (text, "score", "predicted")]
    return df.select(*rest, run(F.col(text).cast("string")).alias("score")).select(*rest, "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    machine = learn(docs.where(~held_out()), labels.where(~held_out()))
    return score(docs.withColumn("held_out", held_out()), machine).select("doc_id", "held_out", "score", "predicted")
