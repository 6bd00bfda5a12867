import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.llm import simhash
from gridloom.llm.common import Scratch


def plain(text):
    """The fingerprint, one bit and one shingle at a time."""
    import xxhash

    w = (text or "").encode().lower().split()
    found = [b" ".join(w[k : k + 3]) for k in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(g, seed=42) for g in found]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def roots(fps):
    """id -> smallest id that links reach, comparing all pairs of (id, fingerprint)."""
    u = np.array(sorted({f for _, f in fps}), np.uint64)
    parent = list(range(len(u)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(u)):
        for j in np.nonzero(np.bitwise_count(u[i + 1 :] ^ u[i]) <= 3)[0]:
            parent[find(i + 1 + int(j))] = find(i)
    at, low = {int(x): k for k, x in enumerate(u)}, {}
    for i, f in fps:
        low[find(at[f])] = min(low.get(find(at[f]), i), i)
    return {i: low[find(at[f])] for i, f in fps}


def test_equals_brute_force(docs):
    got = {r.doc_id: r for r in simhash.near_duplicates(docs).collect()}
    fps = [(r.doc_id, plain(r.text)) for r in docs.select("doc_id", "text").collect()]
    want = roots(fps)
    assert len(got) == len(fps) == docs.count()
    assert all(got[i].fingerprint == f"{f:016x}" and got[i].component_id == want[i] for i, f in fps)


def test_odd_rows(odd_docs, no_docs):
    rows = simhash.near_duplicates(odd_docs.withColumns({"fp": F.lit("x"), "node": F.lit(1), "component_id": F.lit(2)})).collect()
    assert len(rows) == odd_docs.count()
    texts = {(r.doc_id, f"{plain(r.text):016x}") for r in odd_docs.collect()}
    assert {(r.doc_id, r.fingerprint) for r in rows} == texts
    got = {r.doc_id: r.component_id for r in rows}
    assert got[1] == got[2] == got[3] == 1 and got[4] == got[5] == got[7] == 4 and got[None] is None and got[8] == got[9] == 8
    assert simhash.near_duplicates(no_docs).collect() == []


def test_ids_with_several_texts_join_their_components(spark):
    df = spark.createDataFrame([(1, "a b c d"), (2, "e f g h"), (3, "a b c d"), (3, "e f g h"), (4, "i j k l")], "doc_id long, text string")
    assert {(r.doc_id, r.component_id) for r in simhash.near_duplicates(df).collect()} == {(1, 1), (2, 1), (3, 1), (4, 4)}


def test_long_texts_are_hashed_piece_by_piece(monkeypatch):
    text = " ".join(f"Word{k % 91}" for k in range(500)) + "\t é\xa0x "
    want = plain(text)
    for size in (1, 7, 100, 1 << 20):
        monkeypatch.setattr(simhash, "PIECE", size)
        assert simhash.fingerprint(text) == want
    assert simhash.fingerprint("One two") == plain("one TWO") and simhash.fingerprint(None) == simhash.fingerprint(" \t") == 0


@pytest.mark.parametrize(("small", "spread"), [(32, 12), (2, 9), (2, 14)])
def test_dense_groups_lose_no_link(spark, monkeypatch, small, spread):
    """Many fingerprints around few, so that buckets are large and finer regions are needed."""
    monkeypatch.setattr(simhash, "SMALL", small)
    rng = random.Random(spread)
    bases = [rng.getrandbits(64) for _ in range(3)]
    fps = {0, (1 << 64) - 1}
    for base in bases:
        bits = rng.sample(range(64), spread)
        fps |= {base ^ sum(1 << b for b in rng.sample(bits, rng.randint(0, spread // 2))) for _ in range(250)}
    rows = sorted(fps)
    signed = [(f - (1 << 64) if f >> 63 else f) for f in rows]
    with Scratch(spark) as scratch:
        df = spark.createDataFrame([(s, s) for s in signed], "node long, fp long")
        found = {r.node: r.root for r in simhash.links(scratch, df).collect()}
    want = roots(list(zip(signed, rows, strict=True)))
    assert {s: found.get(s, s) for s in signed} == want


def test_references_discard_and_never_lose():
    """A coordinate never differs by more than the distance; unrelated fingerprints hardly survive."""
    refs = np.array([p % (1 << 64) for p in simhash.pivots()], np.uint64)
    rng = random.Random(3)
    kept = 0
    for _ in range(2000):
        x, y = rng.getrandbits(64), rng.getrandbits(64)
        z = x ^ sum(1 << b for b in rng.sample(range(64), 3))
        row = lambda v: np.bitwise_count(refs ^ np.uint64(v)).astype(int)
        assert np.abs(row(x) - row(z)).max() <= 3
        kept += np.abs(row(x) - row(y)).max() <= 3
    assert kept <= 2
