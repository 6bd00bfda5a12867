import math
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.llm import vector_codes


def plain(vectors, parts, entries, rounds, scale=4096):
    """(codes, errors, codebooks) in Python's integers; vectors in the order of their ids."""
    z = [[math.floor(Fraction(x) * scale) for x in v] for v in vectors]
    w = len(z[0])
    cut = [(w * p // parts, w * (p + 1) // parts) for p in range(parts)]
    books = [[v[a:b] for v in z[:entries]] for a, b in cut]

    def nearest(x, book):
        away = [sum((p - q) ** 2 for p, q in zip(x, e, strict=True)) for e in book]
        return away.index(min(away)), min(away)

    for _ in range(rounds):
        for p, (a, b) in enumerate(cut):
            at = [nearest(v[a:b], books[p])[0] for v in z]
            for e in range(len(books[p])):
                if own := [v[a:b] for v, k in zip(z, at, strict=True) if k == e]:
                    books[p][e] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    found = [[nearest(v[a:b], books[p]) for p, (a, b) in enumerate(cut)] for v in z]
    return [[k for k, _ in f] for f in found], [sum(e for _, e in f) for f in found], books


@pytest.mark.parametrize(("width", "kind", "scale", "block"), [(16, "float", 1.0, 1 << 18), (13, "double", 3.0, 700), (3, "float", 1.0, 1), (8, "double", 1e14, 900), (8, "float", 1e30, 1 << 18)])
def test_equals_brute_force(spark, monkeypatch, width, kind, scale, block):
    monkeypatch.setattr(vector_codes, "BLOCK", block)
    rng = np.random.default_rng(width)
    vectors = np.round(rng.normal(size=(120, width)) * 8) / 8 * scale
    vectors = (vectors.astype(np.float32) if kind == "float" else vectors).astype(float).tolist()
    rows = list(enumerate(vectors))
    df = spark.createDataFrame([(i, v, i % 3) for i, v in reversed(rows)], f"vec_id long, embedding array<{kind}>, label int").repartition(5)
    out, books = vector_codes.compress(df, parts=4, entries=5, rounds=3)
    got = {r.vec_id: r for r in out.collect()}
    codes, errors, want = plain(vectors, 4, 5, 3)
    assert books == want and len(got) == 120
    for i in range(120):
        assert got[i].codes == codes[i] and got[i].error == min(errors[i], 2**63 - 1) and got[i].label == i % 3


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(None, [1.0, 2.0], None), (3, None, 1), (4, [nan, 1.0], 1), (5, [1.0, None], 1), (6, [inf, 1.0], 1), (7, [1.0], 1), (8, [], 2), (2, [0.5, -0.5], 2), (2, [0.5, -0.5], 2), (9, [-inf, 0.0], None), (10, [-0.0001, 0.0], None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumns({"codes": F.lit("x"), "n": F.lit(1), "id": F.lit(0)})
    out, books = vector_codes.compress(df, parts=8)
    got = sorted(out.collect(), key=repr)
    assert sorted(r.vec_id or 0 for r in got) == [0, 2, 2, 10] and len(books) == 8
    by = {r.vec_id: r for r in got}
    assert [x.codes for x in got if x.vec_id == 2] == [[0] * 8] * 2 and by[2].error == 0 and by[10].label is None
    assert sum(len(b[0]) for b in books) == 2
    empty, none = vector_codes.compress(df.where("false"))
    assert empty.collect() == [] and none == []
    out, books = vector_codes.compress(df.where("vec_id = 8"), label=None)
    assert [(r.codes, r.error, r.label) for r in out.collect()] == [([0] * 8, 0, None)] and books == [[[]]] * 8


def test_rows_may_lie_anywhere(spark, data):
    df = spark.read.parquet(f"{data}/embeddings.parquet")
    one, books = vector_codes.compress(df.repartition(1))
    many, same = vector_codes.compress(df.repartition(23))
    assert books == same and one.exceptAll(many).isEmpty() and many.exceptAll(one).isEmpty()
