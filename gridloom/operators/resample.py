"""Separable resampling as joins with weight tables: coarse = Wr * field * Wc'."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, rows: list[tuple[int, int, float]]) -> DataFrame:
    """(out, src, w), as a literal relation: its size is that of an axis."""
    values = ", ".join(f"({a}, {b}, {w!r}D)" for a, b, w in rows)
    return spark.sql(f"SELECT * FROM VALUES {values} AS t(out, src, w)")


def _keys(x: float) -> float:
    if x < 1:
        return 1.5 * x**3 - 2.5 * x**2 + 1
    return -0.5 * x**3 + 2.5 * x**2 - 4 * x + 2 if x < 2 else 0.0


#: The pole of the cubic B-spline's prefilter, and below what a weight is none.
POLE, NONE = 3**0.5 - 2, 1e-15


def _mirrored(k: int, n: int) -> int:
    if n == 1:
        return 0
    k = abs(k) % (2 * n - 2)
    return k if k < n else 2 * n - 2 - k


def _bspline(coarse: int, factor: int) -> list[tuple[int, int, float]]:
    """Prefilter and interpolation as one table. Samples are their B-spline coefficients under the taps (1, 4, 1) / 6;
    the inverse of that weighs a node k steps away by a power of the pole, over the line that
    goes on mirrored at both ends, until nothing is left of it."""
    scale = 6 * POLE / (POLE * POLE - 1)
    reach = 0
    while abs(scale * POLE**reach) > NONE:
        reach += 1

    def coefficient(j: int) -> dict[int, float]:
        own: dict[int, float] = {}
        for k in range(-reach, reach + 1):
            at = _mirrored(j + k, coarse)
            own[at] = own.get(at, 0.0) + scale * POLE ** abs(k)
        return own

    filters = [coefficient(j) for j in range(coarse)]
    out = []
    for i in range((coarse - 1) * factor + 1):
        j, r = divmod(i, factor)
        u, own = r / factor, {}
        for at, w in zip(range(j - 1, j + 3), ((1 - u) ** 3 / 6, 2 / 3 - u * u + u**3 / 2, 2 / 3 - (1 - u) ** 2 + (1 - u) ** 3 / 2, u**3 / 6), strict=True):
            for src, f in filters[_mirrored(at, coarse)].items():
                own[src] = own.get(src, 0.0) + w * f
        out += [(i, src, w) for src, w in sorted(own.items()) if abs(w) > NONE]
    return out


def weights(kind: str, side: int, factor: int) -> list[tuple[int, int, float]]:
    """(out, src, w) of an axis of `side` nodes. Observations go to every `factor`-th node and their
    weights sum to 1: `decimate` takes the node, `trapezoid` averages with half weights at the ends,
    `gaussian` has a standard deviation of half the factor, `box` averages one factor's nodes from each on.
    `bilinear` and `keys` (cubic convolution, a = -1/2) go back up; nodes beyond the edge repeat it.
    `bspline` goes up through the nodes by cubic B-splines, with mirrored ends."""
    if kind == "bspline":
        return _bspline((side - 1) // factor + 1, factor)
    if kind in ("bilinear", "keys"):
        coarse = (side - 1) // factor + 1
        out = []
        for i in range((coarse - 1) * factor + 1):
            k, r = divmod(i, factor)
            t, own = r / factor, {}
            if kind == "bilinear":
                taps = [(k, 1 - t), (k + 1, t)]
            else:
                taps = [(k - 1 + j, _keys(abs(t + 1 - j))) for j in range(4)]
            for j, w in taps:
                if w:
                    j = min(max(j, 0), coarse - 1)
                    own[j] = own.get(j, 0.0) + w
            out += [(i, j, w) for j, w in sorted(own.items())]
        return out
    if kind == "box":
        return [(o, j, 1 / len(own)) for o, at in enumerate(range(0, side, factor)) for own in [range(at, min(at + factor, side))] for j in own]
    reach = {"decimate": 0, "trapezoid": factor // 2, "gaussian": 2 * factor}[kind]
    out = []
    for o, at in enumerate(range(0, side, factor)):
        own = []
        for j in range(max(0, at - reach), min(side - 1, at + reach) + 1):
            d = abs(j - at)
            if kind == "gaussian":
                w = 2.718281828459045 ** (-0.5 * (d / (factor / 2)) ** 2)
            else:
                w = 0.5 if kind == "trapezoid" and d == reach and factor % 2 == 0 else 1.0
            own.append((o, j, w))
        total = sum(w for *_, w in own)
        out += [(o, j, w / total) for o, j, w in own]
    return out


def apply(cells: DataFrame, axis: list[tuple[int, int, float]]) -> DataFrame:
    """The field under the same weights on both axes. Rows are combined first, so that the second
    join sees a field that is already smaller, or larger by one axis only."""
    table = F.broadcast(_table(cells.sparkSession, axis))  # a literal: three numbers for each node of an axis and tap
    once = cells.join(table, F.col("row") == F.col("src")).groupBy("region", F.col("out").alias("row"), "col").agg(F.sum(F.col("w") * F.col("z")).alias("z"))
    return once.join(table, F.col("col") == F.col("src")).groupBy("region", "row", F.col("out").alias("col")).agg(F.sum(F.col("w") * F.col("z")).alias("z"))


def sql_axis(axis: list[tuple[int, int, float]], name: str) -> str:
    return f"{name}(o, s, w) AS (VALUES " + ", ".join(f"({a}, {b}, CAST({w!r} AS DOUBLE))" for a, b, w in axis) + ")"


def fingerprints(axes: DataFrame, key: str, kind: str, factor: int) -> DataFrame:
    """(key, sha256) of axes (key, side): the digest of each one's weights in order, to nine digits. An
    axis is as long as its digest's text, and a row of the result."""
    table = F.udf(lambda side: ",".join(sorted(f"{a}:{b}:{w:.9f}" for a, b, w in weights(kind, side, factor))), "string", useArrow=True)
    return axes.select(key, F.sha2(table("side"), 256).alias("sha256"))
