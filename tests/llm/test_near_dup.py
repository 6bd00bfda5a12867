import os
import random

import pytest

from gridloom.llm import near_dup
from gridloom.llm.common import Scratch
from gridloom.llm.graph import components

from . import brute


def compare(df, out):
    want = brute.components([(r.doc_id, r.text) for r in df.collect() if r.doc_id is not None])
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in out if r.doc_id is not None}
    assert got == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in out if r.doc_id is not None)


def test_documents_equal_brute_force(docs):
    compare(docs, near_dup.near_duplicates(docs).collect())


def test_odd_rows(odd_docs, no_docs):
    out = near_dup.near_duplicates(odd_docs).collect()
    compare(odd_docs, out)
    assert len(out) == odd_docs.count()
    assert all(r.component_id is None and r.kept for r in out if r.doc_id is None)
    assert near_dup.near_duplicates(no_docs).collect() == []


def test_chains_and_large_groups(spark):
    """A group of many edits of one text, chains of small edits, and texts that share a passage."""
    rng = random.Random(4)
    word = lambda: f"{rng.choice('abcdefgh')}{rng.randrange(5000)}"
    base = [word() for _ in range(120)]
    rows, k = [], 0
    for edits in [0] * 5 + [1] * 60 + [2] * 60 + [3] * 40 + [5] * 40:
        w = list(base)
        for _ in range(edits):
            if rng.random() < 0.5:
                w[rng.randrange(len(w))] = word()
            else:
                del w[rng.randrange(len(w))]
        rows.append((k, " ".join(w)))
        k += 1
    for _ in range(6):
        w = [word() for _ in range(150)]
        for _ in range(12):
            w[rng.randrange(len(w))] = word()
            rows.append((k, " ".join(w)))
            k += 1
    passage = [word() for _ in range(80)]
    for _ in range(60):
        rows.append((k, " ".join(passage + [word() for _ in range(rng.randrange(5, 30))])))
        k += 1
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    compare(df, near_dup.near_duplicates(df).collect())


def test_recall_of_the_tables():
    """The stated chance to miss a pair at the threshold."""
    for percent in (50, 70, 80, 85, 95):
        assert 2 * (1 - (percent / 100) ** near_dup.ROWS) ** near_dup.side_for(percent) < 0.0001
    assert (near_dup.side_for(85), near_dup.side_for(80), near_dup.side_for(100)) == (12, 16, 1)


def test_other_thresholds_equal_brute_force(docs):
    for percent in (80, 60):
        want = brute.components([(r.doc_id, r.text) for r in docs.collect()], percent)
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in near_dup.near_duplicates(docs, percent).collect()} == want


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(250)] + [(k, k + 1) for k in range(1000, 1200)] + [(5000, k) for k in range(5001, 5300)] + [(7, 7)]
    parent = {v: v for e in edges for v in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    with Scratch(spark) as scratch:
        df = spark.createDataFrame(edges + edges[:20], "a bigint, b bigint")
        got = {r.node: r.root for r in components(scratch, df).collect()}
        assert got == {v: find(v) for v in parent if find(v) != v}
        assert components(scratch, df.where("a < 0")).collect() == []


def test_components_of_two_graphs_in_one_scratch(spark):
    with Scratch(spark) as scratch:
        a = components(scratch, spark.createDataFrame([(1, 2), (2, 3)], "a bigint, b bigint"))
        b = components(scratch, spark.createDataFrame([(4, 5), (5, 6)], "a bigint, b bigint"))
        assert ({tuple(r) for r in a.collect()}, {tuple(r) for r in b.collect()}) == ({(2, 1), (3, 1)}, {(5, 4), (6, 4)})


def test_components_are_not_written_twice(spark, docs, monkeypatch):
    made, table = [], Scratch.table
    monkeypatch.setattr(Scratch, "table", lambda self, df, name: made.append(name) or table(self, df, name))
    near_dup.near_duplicates(docs)
    assert "edges0" in made and not {"roots", "ends"} & set(made)


def test_damaged_scratch_tables_raise(spark):
    with Scratch(spark) as scratch:
        rows = scratch.table(spark.range(1000).selectExpr("xxhash64(id) AS h").coalesce(1), "rows")
        folder = scratch.made["rows"].removeprefix("file:")
        (name,) = (f for f in os.listdir(folder) if f.endswith(".parquet"))
        data = bytearray(open(f"{folder}/{name}", "rb").read())
        data[4000] ^= 1  # within the one page of 8000 bytes
        open(f"{folder}/{name}", "wb").write(data)
        with pytest.raises(Exception, match="(?i)crc|checksum|corrupt|FAILED_READ"):
            rows.collect()
