"""Queries whose work is sequential by nature: one dense field, page or job a group, numpy inside.

A group is a field, a page or a job of bounded size; the cells of a field are collected into it
once. What such a query returns is compared with brute force in tests.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import codecs, entropy, hydro, inference, physics, recon
from ..functions.dense import dense, long, per_field
from ..functions.scalar import rounded
from ..sources.tables import SIDE, lattice, nodes, read
from .catalog import query


@query("priority_flood")
def priority_flood(spark, d):
    out = per_field(lattice(spark, d), lambda k, z: long(k, fill=hydro.filled(z)), "region bigint, row int, col int, fill double")
    return out.select("region", "row", "col", rounded("fill", 9).alias("fill"))


@query("route")
def route(spark, d):
    """Fill, receivers, accumulation and outlets, water leaving at the edges."""

    def one(k: int, z: np.ndarray) -> pd.DataFrame:
        r = hydro.route(z)
        return long(k, receiver=r["receiver"], upstream=r["upstream"], outlet=r["outlet"])

    return per_field(lattice(spark, d), one, "region bigint, row int, col int, receiver bigint, upstream bigint, outlet bigint")


@query("fill_volume")
def fill_volume(spark, d):
    """The deepest fill, and the volume of all."""
    cells = lattice(spark, d)
    fill = per_field(cells, lambda k, z: long(k, fill=hydro.filled(z)), "region bigint, row int, col int, fill double")
    depth = F.col("fill") - F.col("z")
    return cells.join(fill, ["region", "row", "col"]).groupBy("region").agg(rounded(F.max(depth), 5).alias("deepest"), rounded(F.sum(depth), 4).alias("volume"))


@query("drainage_sensitivity")
def drainage_sensitivity(spark, d):
    """Stream agreement of a quantised field for every threshold area and boundary policy."""
    jobs = lattice(spark, d).withColumn("policy", F.explode(F.array(F.lit("edges"), F.lit("lowest-edge"))))

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        z, policy = dense(pdf), str(pdf["policy"].iloc[0])
        a, b = (hydro.route(x, policy=policy)["upstream"] for x in (z, np.rint(z / 0.05) * 0.05))
        return pd.DataFrame([{"region": int(pdf["region"].iloc[0]), "policy": policy, "area": area, "jaccard": hydro.jaccard(a >= area, b >= area)} for area in (4, 8, 16, 32)])

    return jobs.groupBy("region", "policy").applyInPandas(one, "region bigint, policy string, area int, jaccard double").withColumn("jaccard", rounded("jaccard"))


def _pages(spark, d) -> DataFrame:
    from .pages import paged

    return paged(nodes(spark, d), 8, SIDE)


@query("codec_tournament")
def codec_tournament(spark, d):
    """Every codec on every page under every bound: bytes, error, and whether the bound holds. Codecs
    whose library is absent are rows with a reason and no bytes."""
    grid = [(n, b) for n in codecs.CODECS for b in (0.01, 0.05)]
    jobs = spark.sql("SELECT * FROM VALUES " + ", ".join(f"('{n}', {b}D)" for n, b in grid) + " AS t(codec, bound)")
    todo = _pages(spark, d).crossJoin(F.broadcast(jobs))  # a row for each codec and bound

    def measure(batches):
        for pdf in batches:
            rows = []
            for r in pdf.itertuples():
                c, z = codecs.CODECS[r.codec], np.array(r.z).reshape(9, 9)
                size = most = None
                if not c.absent:
                    blob = c.encode(z, r.bound)
                    size, most = len(blob), float(np.abs(c.decode(blob, z.shape, r.bound) - z).max())
                rows.append((r.region, r.codec, r.bound, size, most, c.bounded and most is not None and most <= r.bound * (1 + 1e-9), c.absent or None))
            yield pd.DataFrame(rows, columns=["region", "codec", "bound", "bytes", "most", "held", "absent"]).astype({"bytes": "Int64"})

    rows = todo.mapInPandas(measure, "region bigint, codec string, bound double, bytes bigint, most double, held boolean, absent string")
    return rows.groupBy("codec", "bound").agg(F.count("*").alias("pages"), F.sum("bytes").alias("bytes"), rounded(F.sum("bytes") * 8 / (F.count("*") * 81)).alias("bits"), rounded(F.max("most"), 8).alias("most"), F.bool_and("held").alias("held"), F.max("absent").alias("absent"))


@query("page_roundtrip")
def page_roundtrip(spark, d):
    """Pages to bytes and back: sizes, digests and the largest error."""

    def there_and_back(batches):
        for pdf in batches:
            blobs = [codecs.page_bytes(np.array(z).reshape(9, 9), quantum=0.001) for z in pdf["z"]]
            worst = [float(np.abs(codecs.page_values(b) - np.array(z).reshape(9, 9)).max()) for b, z in zip(blobs, pdf["z"], strict=True)]
            yield pd.DataFrame({"region": pdf["region"], "y": pdf["y"], "x": pdf["x"], "blob": blobs, "worst": worst})

    out = _pages(spark, d).mapInPandas(there_and_back, "region bigint, y int, x int, blob binary, worst double")
    return out.select("region", "y", "x", F.octet_length("blob").alias("bytes"), F.sha2("blob", 256).alias("sha256"), rounded("worst", 9).alias("worst"))


@query("multilevel_bytes")
def multilevel_bytes(spark, d):
    """The multilevel coder on a field of 65 by 65: symbols, ideal and coded size, and the largest error after decoding."""

    def one(k: int, z: np.ndarray) -> pd.DataFrame:
        rows = []
        for bound in (0.01, 0.05):
            codes, tables, _ = entropy.multilevel(z, bound)
            blob = entropy.encode(codes, tables)
            back = entropy.rebuild(blob, z.shape[0], bound)
            rows.append((k, bound, len(codes), entropy.ideal_bits(codes, tables) / 8, len(blob), float(np.abs(back - z).max())))
        return pd.DataFrame(rows, columns=["region", "bound", "symbols", "ideal", "bytes", "most"])

    out = per_field(nodes(spark, d), one, "region bigint, bound double, symbols bigint, ideal double, bytes bigint, most double")
    return out.withColumns({"ideal": rounded("ideal", 3), "most": rounded("most", 7)})


@query("correction_sweep")
def correction_sweep(spark, d):
    """Cells around the reference's streams are corrected within a radius: bytes against agreement."""

    def one(k: int, z: np.ndarray) -> pd.DataFrame:
        coarse = np.rint(z / 0.1) * 0.1
        ref = hydro.route(z)["upstream"] >= 8
        rows = []
        for radius in (None, 0, 1, 2):
            got, size, cells = coarse, 0, 0
            if radius is not None:
                at = np.nonzero(hydro.dilated(ref, radius).ravel())[0]
                blob = codecs.Corrections.of(at, np.rint((z - coarse).ravel()[at] / 0.01), 0.01).to_bytes()
                got = codecs.Corrections.from_bytes(blob).applied(coarse)
                size, cells = len(blob), len(at)
            rows.append((k, -1 if radius is None else radius, cells, size, hydro.jaccard(ref, hydro.route(got)["upstream"] >= 8)))
        return pd.DataFrame(rows, columns=["region", "radius", "cells", "bytes", "jaccard"])

    return per_field(lattice(spark, d), one, "region bigint, radius int, cells bigint, bytes bigint, jaccard double").withColumn("jaccard", rounded("jaccard"))


@query("kriging_tile")
def kriging_tile(spark, d):
    """Each 16 by 16 tile from the samples in it and a margin of 8: tiles take their halo with them."""
    cells = lattice(spark, d)
    near = lambda c: F.explode(F.sequence(F.greatest(F.floor((F.col(c) - 8) / 16), F.lit(0)), F.least(F.floor((F.col(c) + 8) / 16), F.lit(SIDE // 16 - 1))))
    spread = cells.withColumn("tr", near("row")).withColumn("tc", near("col"))

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        region, tr, tc = (int(pdf[c].iloc[0]) for c in ("region", "tr", "tc"))
        seen = pdf[(pdf["row"] % 4 == 0) & (pdf["col"] % 4 == 0)].sort_values(["row", "col"])
        core = pdf[(pdf["row"] // 16 == tr) & (pdf["col"] // 16 == tc)].sort_values(["row", "col"])
        est, var = recon.krige(seen[["row", "col"]].to_numpy(float), seen["z"].to_numpy(), core[["row", "col"]].to_numpy(float), 1.0, 6.0, 0.05)
        err = est - core["z"].to_numpy()
        return pd.DataFrame([{"region": region, "tr": tr, "tc": tc, "cells": len(core), "mae": float(np.abs(err).mean()), "sd": float(np.sqrt(var).mean())}])

    out = spread.groupBy("region", "tr", "tc").applyInPandas(one, "region bigint, tr int, tc int, cells bigint, mae double, sd double")
    return out.withColumns({"mae": rounded("mae"), "sd": rounded("sd")})


@query("thin_plate")
def thin_plate(spark, d):
    def one(k: int, z: np.ndarray) -> pd.DataFrame:
        at = np.random.default_rng(k).choice(z.size, z.size // 10, replace=False)
        return long(k, u=recon.thin_plate(z.shape, at, z.ravel()[at]))

    return per_field(lattice(spark, d), one, "region bigint, row int, col int, u double").withColumn("u", rounded("u", 4))


@query("hole_infill")
def hole_infill(spark, d):
    """A hole in each field filled by the harmonic and the biharmonic surface."""

    def one(k: int, z: np.ndarray) -> pd.DataFrame:
        z, rows = z.copy(), []
        true = z[8:16, 8:16].copy()
        z[8:16, 8:16] = np.nan
        for order in (1, 2):
            rows.append((k, order, float(np.abs(recon.fill_holes(z, order)[8:16, 8:16] - true).mean())))
        return pd.DataFrame(rows, columns=["region", "order", "mae"])

    return per_field(lattice(spark, d), one, "region bigint, order int, mae double").withColumn("mae", rounded("mae"))


@query("block_choice")
def block_choice(spark, d):
    def one(k: int, z: np.ndarray) -> pd.DataFrame:
        return pd.DataFrame([(k, *b) for b in recon.choose_blocks(z, 8, 16, 6, [20261004, 8, k], 24)], columns=["region", "row", "col", "stratum", "relief"])

    return per_field(lattice(spark, d), one, "region bigint, row int, col int, stratum int, relief double").withColumn("relief", rounded("relief"))


@query("phase_kernels")
def phase_kernels(spark, d):
    """Weights that bring decimated fields up by two, fitted for each phase over all fields: a field
    gives its sums, these are added, and a row a phase is solved."""

    def sums(k: int, z: np.ndarray) -> pd.DataFrame:
        own = recon.phase_sums(z[::2, ::2], z, 2)
        at = np.indices(own.shape).reshape(4, -1)
        return pd.DataFrame({"a": at[0], "b": at[1], "i": at[2], "j": at[3], "s": own.ravel()})

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        own = np.zeros((1, 1, 9, 10))
        own[0, 0, pdf["i"], pdf["j"]] = pdf["s"]
        return pd.DataFrame([(int(pdf["a"].iloc[0]), int(pdf["b"].iloc[0]), [round(float(x), 6) + 0.0 for x in recon.phase_kernels(own)[0, 0]])], columns=["a", "b", "weights"])

    held = per_field(lattice(spark, d), sums, "a int, b int, i int, j int, s double").groupBy("a", "b", "i", "j").agg(F.sum("s").alias("s"))
    return held.groupBy("a", "b").applyInPandas(solve, "a int, b int, weights array<double>")  # ninety sums a phase


@query("landscape_step")
def landscape_step(spark, d):
    """Evolution of each field under uplift, incision and diffusion, with a ledger a step."""

    def one(k: int, z: np.ndarray) -> pd.DataFrame:
        _, ledger = physics.evolve(z, 5.0, 2.0, 0.05, 0.02, 0.05)
        return pd.DataFrame([(k, i, r["dt"], r["uplift"], r["cut"], r["moved"], r["change"], physics.closes([r])) for i, r in enumerate(ledger)], columns=["region", "step", "dt", "uplift", "cut", "moved", "change", "closed"])

    out = per_field(lattice(spark, d), one, "region bigint, step int, dt double, uplift double, cut double, moved double, change double, closed boolean")
    return out.withColumns({c: rounded(c) for c in ("uplift", "cut", "moved", "change")})


@query("ensemble")
def ensemble(spark, d):
    """A plan of simulations, a row each, and one task for each: relief and mean height at the end."""
    plan = spark.sql("SELECT a.id * 4 + b.id AS sim, (a.id + 1) * 0.01D AS uplift, (b.id + 1) * 0.01D AS k FROM range(4) a CROSS JOIN range(4) b")

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        r = pdf.iloc[0]
        z, ledger = physics.evolve(physics.terrain(17, int(r["sim"]), relief=1.0), 4.0, 2.0, float(r["uplift"]), float(r["k"]), 0.05)
        return pd.DataFrame([(int(r["sim"]), float(z.max() - z.min()), float(z.mean()), physics.closes(ledger))], columns=["sim", "relief", "mean", "closed"])

    return plan.groupBy("sim").applyInPandas(one, "sim bigint, relief double, mean double, closed boolean").withColumns({"relief": rounded("relief", 5), "mean": rounded("mean", 5)})


@query("diffusion_scenarios")
def diffusion_scenarios(spark, d):
    """Linear and nonlinear diffusion under closed, periodic and fixed edges: what is conserved."""

    def one(k: int, z: np.ndarray) -> pd.DataFrame:
        rows = []
        for boundary in ("closed", "periodic", "fixed"):
            for critical in (None, 1.2):
                u, dt = z.copy(), physics.stable_step(1.0, 1.0, critical)
                for _ in range(10):
                    u = u + dt * physics.diffusion(u, 1.0, 1.0, critical, boundary)
                rows.append((k, boundary, critical, float(u.sum() - z.sum()), float(u.var() / z.var())))
        return pd.DataFrame(rows, columns=["region", "boundary", "critical", "drift", "variance"])

    out = per_field(lattice(spark, d), one, "region bigint, boundary string, critical double, drift double, variance double")
    return out.withColumns({"drift": rounded("drift"), "variance": rounded("variance")})


@query("synthetic_terrain")
def synthetic_terrain(spark, d):
    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        return long(int(pdf["seed"].iloc[0]), z=physics.terrain(33, int(pdf["seed"].iloc[0])))

    seeds = spark.range(4).withColumnRenamed("id", "seed")
    return seeds.groupBy("seed").applyInPandas(one, "region bigint, row int, col int, z double").withColumn("z", rounded("z"))


@query("chain_diagnostics")
def chain_diagnostics(spark, d):
    """R-hat and effective sizes of every parameter of the sampled chains."""
    jobs = spark.range(4).withColumnRenamed("id", "chain")

    def sample(pdf: pd.DataFrame) -> pd.DataFrame:
        k = int(pdf["chain"].iloc[0])
        cov = np.array([[1.0, 0.6], [0.6, 2.0]])
        draws, _ = inference.metropolis(lambda x: inference.log_likelihood(x, cov), np.zeros(2), np.array([1.2, 1.6]), 400, k)
        return pd.DataFrame({"chain": k, "iter": np.repeat(np.arange(400), 2), "param": np.tile([0, 1], 400), "value": draws.ravel()})

    def judge(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf.pivot(index="chain", columns="iter", values="value").to_numpy()
        return pd.DataFrame([(int(pdf["param"].iloc[0]), inference.rhat(x), inference.ess_bulk(x), inference.ess_tail(x))], columns=["param", "rhat", "bulk", "tail"])

    draws = jobs.groupBy("chain").applyInPandas(sample, "chain bigint, iter int, param int, value double")
    return draws.groupBy("param").applyInPandas(judge, "param int, rhat double, bulk double, tail double").withColumns({c: rounded(c, 4) for c in ("rhat", "bulk", "tail")})


@query("grid_posterior")
def grid_posterior(spark, d):
    """A posterior of all parts on a grid of two parameters, a task a cell, and its marginals by sums.
    Parts of one size differ by noise alone, so a row a size is all that the likelihood needs."""
    grid = spark.sql("SELECT CAST(a.id AS INT) AS i, CAST(b.id AS INT) AS j FROM range(15) a CROSS JOIN range(15) b")
    parts = read(spark, d, "part").select("p_size", "p_retailprice").dropna()
    sizes = parts.groupBy("p_size").agg(F.count("*").alias("n"), F.avg("p_retailprice").alias("mean"), (F.var_pop("p_retailprice") * F.count("*")).alias("m2"))
    seen = sizes.agg(F.sort_array(F.collect_list(F.struct("p_size", "n", "mean", "m2"))).alias("s"))  # a row for each of the fifty sizes

    def score(batches):
        for pdf in batches:
            out = []
            for r in pdf.itertuples():
                x, n, mean, m2 = (np.array([v[c] for v in r.s], float) for c in ("p_size", "n", "mean", "m2"))
                cov = 400.0 * np.exp(-np.abs(x[:, None] - x[None, :]) / 5.0)
                res = mean - (900 + 5 * r.i) - 0.5 * (r.j - 7) * x
                out.append(inference.grouped_log_likelihood(res, n, m2, cov, 100.0))
            yield pd.DataFrame({"i": pdf["i"], "j": pdf["j"], "ll": out})

    ll = grid.crossJoin(F.broadcast(seen)).mapInPandas(score, "i int, j int, ll double")
    top = ll.agg(F.max("ll").alias("top"))
    w = ll.crossJoin(F.broadcast(top)).withColumn("w", F.exp(F.col("ll") - F.col("top")))  # one row
    total = w.agg(F.sum("w").alias("t"))
    return w.groupBy("i").agg(F.sum("w").alias("w")).crossJoin(F.broadcast(total)).select("i", rounded(F.col("w") / F.col("t"), 8).alias("p"))  # one row
