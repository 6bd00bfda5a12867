import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.functions import hydro
from gridloom.functions.scalar import varint_bytes, zigzag
from gridloom.operators import flow, masks, resample, stencils
from gridloom.plans.pages import Box, cover, page_predicate, paged, span, window
from gridloom.sources import archive, sinks, text
from gridloom.streaming import receipts


def cells_of(spark, *fields):
    rows = [(k, r, c, float(z[r, c])) for k, z in enumerate(fields) for r in range(z.shape[0]) for c in range(z.shape[1])]
    return spark.createDataFrame(rows, "region bigint, row int, col int, z double")


@pytest.fixture(scope="module")
def rough():
    return np.cumsum(np.cumsum(np.random.default_rng(3).normal(0, 0.3, (17, 17)), 0), 1)


@pytest.mark.parametrize("box", [Box(0, 0, 0, 0), Box(8, 8, 8, 8), Box(3, 8, 7, 16), Box(8, 16, 8, 16), Box(16, 16, 0, 16), Box(5, 13, 2, 9)])
def test_window_from_pages_is_whole(spark, rough, box):
    cells = cells_of(spark, rough)
    pages = paged(cells, 8, 16)
    rows = window(pages, box, 8, 2).collect()
    got = {(r.row, r.col): r.z for r in rows}
    assert len(rows) == len(got) and got == {(r, c): rough[r, c] for r in range(box.r0, box.r1 + 1) for c in range(box.c0, box.c1 + 1)}


def test_cover_is_minimal():
    for low in range(0, 20):
        for high in range(low, 20):
            a, b = span(low, high, 8)
            assert all(any(p * 8 <= k <= p * 8 + 8 for p in range(a, b + 1)) for k in range(low, high + 1))
            assert b - a <= high // 8 - low // 8


def test_cover_frame_equals_span(spark):
    df = spark.sql("SELECT id, 3 AS r0, CAST(3 + id AS INT) AS r1, 8 AS c0, CAST(8 + id AS INT) AS c1 FROM range(20)")
    for r in cover(df, 8).groupBy("id", "r0", "r1", "c0", "c1").agg(F.min("y").alias("a"), F.max("y").alias("b"), F.min("x").alias("c"), F.max("x").alias("d")).collect():
        assert (r.a, r.b) == span(r.r0, r.r1, 8) and (r.c, r.d) == span(r.c0, r.c1, 8)


def test_page_filter_reaches_the_scan(spark, rough, tmp_path):
    pages = paged(cells_of(spark, rough), 8, 16).withColumn("level", F.lit(0))
    sinks.atlas(pages, str(tmp_path / "atlas"))
    with pytest.raises(Exception, match="exist"):
        sinks.atlas(pages, str(tmp_path / "atlas"))
    need = spark.read.parquet(str(tmp_path / "atlas")).where(page_predicate(Box(0, 5, 0, 5), 8) & (F.col("region") == 0))
    plan = need._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(region" in plan and "PushedFilters: [IsNotNull(y), IsNotNull(x)" in plan
    assert need.count() == 1


def test_receivers_equal_kernel(spark, rough):
    got = {r.cell: r.receiver for r in flow.receivers(cells_of(spark, rough), 17).collect()}
    assert got == dict(enumerate(hydro.receivers(rough).ravel().tolist()))


def test_accumulation_and_outlets_equal_kernel(spark, rough):
    z = hydro.filled(rough)
    edges = flow.receivers(cells_of(spark, z), 17)
    to = hydro.receivers(z)
    up = {r.cell: r.upstream for r in flow.accumulation(edges).collect()}
    assert up == dict(enumerate(hydro.Drainage(to).upstream().ravel().tolist()))
    out = {r.cell: r.outlet for r in flow.outlets(edges).collect()}
    assert out == dict(enumerate(hydro.Drainage(to).outlet.ravel().tolist()))


def test_traced_equals_kernel(spark, rough):
    z = hydro.filled(rough)
    got = {r.cell: r for r in flow.traced(cells_of(spark, z).withColumn("q", -F.col("z")), 17, ("z", "q")).collect()}
    for v, own in (("z", z), ("q", -z)):
        to = hydro.receivers(own)
        paths = hydro.Drainage(to)
        for name, want in (("receiver", to.ravel()), ("outlet", paths.outlet), ("upstream", paths.upstream().ravel())):
            assert [got[k][f"{v}_{name}"] for k in range(z.size)] == want.tolist()


def test_stored_pages_are_pruned(spark, data):
    from gridloom.plans.registry import QUERIES

    plan = QUERIES["window_query"](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(y" in plan and "PushedFilters: [IsNotNull(x), GreaterThanOrEqual(x,2), LessThanOrEqual(x,4)" in plan and "Exchange" not in plan


def test_ties_go_to_the_first_offset(spark):
    z = np.full((3, 3), 1.0)
    z[0, 1] = z[1, 0] = 0.0
    got = {r.cell: r.receiver for r in flow.receivers(cells_of(spark, z), 3).collect()}
    assert got[4] == 1 and got[1] == -1


def test_laplacian_sums_to_zero(spark, rough):
    assert abs(stencils.laplacian(cells_of(spark, rough)).agg(F.sum("lap")).first()[0]) < 1e-9
    assert abs(stencils.flux_divergence(cells_of(spark, rough), flux=lambda g: stencils.teacher_flux(g, 1.2)).agg(F.sum("div")).first()[0]) < 1e-9


def test_dilation_equals_kernel(spark, rough):
    m = rough > np.quantile(rough, 0.95)
    got = {(r.row, r.col) for r in masks.dilate(cells_of(spark, rough).where(F.col("z") > float(np.quantile(rough, 0.95))), 2, 17).collect()}
    assert got == set(zip(*map(list, np.nonzero(hydro.dilated(m, 2))), strict=True))


def test_weights_sum_to_one():
    for kind in ("decimate", "trapezoid", "gaussian", "bilinear"):
        axis = resample.weights(kind, 61, 4)
        for o in {a for a, *_ in axis}:
            assert sum(w for a, _, w in axis if a == o) == pytest.approx(1)


def test_bilinear_keeps_planes(spark):
    z = np.add.outer(np.arange(5.0), 2 * np.arange(5.0))
    up = {(r.row, r.col): r.z for r in resample.apply(cells_of(spark, z), resample.weights("bilinear", 17, 4)).collect()}
    assert all(v == pytest.approx((r + 2 * c) / 4) for (r, c), v in up.items()) and len(up) == 289


def test_zigzag_and_varint(spark):
    df = spark.createDataFrame([(v,) for v in (0, -1, 1, 63, -64, 64, -8192, 8192)], "v bigint").select(zigzag(F.col("v")).alias("u"))
    got = df.select("u", varint_bytes(F.col("u"))).collect()
    assert [r[0] for r in got] == [0, 1, 2, 126, 127, 128, 16383, 16384] and [r[1] for r in got] == [1, 1, 1, 1, 1, 2, 2, 3]


def test_archive_prunes_and_refuses(spark, tmp_path):
    pages = [(1, 0, y, x, bytes([y, x]) * 50) for y in range(4) for x in range(4)]
    path = tmp_path / "a.pack"
    path.write_bytes(archive.pack(pages))
    got = archive.read(spark, str(path)).where("y = 2 AND x >= 1").select("y", "x", "blob").collect()
    assert sorted((r.y, r.x, bytes(r.blob)) for r in got) == [(2, x, bytes([2, x]) * 50) for x in (1, 2, 3)]
    assert archive.read(spark, str(tmp_path)).count() == 16
    with pytest.raises(ValueError):
        archive.pack(pages + pages[:1])
    raw = path.read_bytes()
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "b.pack").write_bytes(raw[:-1] + bytes([raw[-1] ^ 1]))
    with pytest.raises(Exception, match="damaged"):
        archive.read(spark, str(tmp_path / "bad")).collect()


def test_text_sources(spark, tmp_path):
    (tmp_path / "b.csv").write_text("﻿id;name;e;n;h;g\n 1 ;A;32360000,5;5700000;100,25;\n2;B;32361000;5700001;;\nx;C;no;1;2;\n", encoding="utf-8")
    assert [(r.id, r.east, r.height) for r in text.benchmarks(spark, str(tmp_path / "b.csv")).collect()] == [("1", 360000.5, 100.25)]
    (tmp_path / "d.csv").write_text("1;01.02.2020;1\n1;31.12.2019;1\n2;99.99.2020;1\n")
    assert [(r.id, str(r.surveyed)) for r in text.survey_dates(spark, str(tmp_path / "d.csv")).collect()] == [("1", "2020-02-01")]
    with zipfile.ZipFile(tmp_path / "m.zip", "w") as z:
        z.writestr("m.csv", "Title;x\nKachelname;Aktualitaet\nT1;2020-01-01\nT2;2021-01-01\n")
    assert [(r.Kachelname, r.Aktualitaet, r.Genauigkeit) for r in text.tile_metadata(spark, str(tmp_path / "m.zip")).collect()] == [("T1", "2020-01-01", None), ("T2", "2021-01-01", None)]
    (tmp_path / "i.xml").write_text('<?xml version="1.0"?><x><file name="a" timestamp="t1"/><file name="b" timestamp="t2"/></x>')
    assert [tuple(r) for r in text.publication_times(spark, str(tmp_path / "i.xml")).collect()] == [("a", "t1"), ("b", "t2")]
    np.save(tmp_path / "f.npy", np.arange(4.0).reshape(2, 2))
    assert text.npy_fields(spark, str(tmp_path / "f.npy")).count() == 4
    (tmp_path / "g.xml").write_text("<c><member><Unit><name>u</name><posList>1 2 3 4</posList></Unit></member></c>")
    f = text.features(spark, str(tmp_path / "g.xml"), "Unit", "name string, posList string").select("name", text.ring("posList").alias("r")).first()
    assert f.name == "u" and [tuple(p) for p in f.r] == [(1.0, 2.0), (3.0, 4.0)]


def test_reports_presets_and_merge(spark, tmp_path):
    (tmp_path / "r").mkdir()
    (tmp_path / "r" / "a.json").write_text('{"schema": "s1"}')
    (tmp_path / "r" / "b.json").write_text("{broken")
    got = {r.file[-6:]: r.schema for r in text.reports(spark, str(tmp_path / "r")).collect()}
    assert got == {"a.json": "s1", "b.json": None}
    a = spark.sql("SELECT 'x' AS name, map('k', '1', 'j', '2') AS config")
    b = spark.sql("SELECT 'x' AS name, map('k', '3') AS config")
    assert text.presets([a, b]).first().config == {"k": "3", "j": "2"}
    rows = spark.sql("SELECT * FROM VALUES ('n', 'old', 1), ('n', 'new', 2), ('m', 'old', 3) AS t(name, source, v)")
    assert {r.name: r.v for r in text.preferred(rows, "name", ["new", "old"]).collect()} == {"n": 2, "m": 3}
    tiles = spark.sql("SELECT * FROM VALUES ('b', 0, 0, 2D), ('a', 0, 0, 1D), ('a', 0, 1, double('NaN')), ('b', 0, 1, 5D) AS t(tile, row, col, z)")
    assert {(r.row, r.col): r.z for r in text.merged(tiles).collect()} == {(0, 0): 1.0, (0, 1): 5.0}


def test_sinks_refuse(spark):
    with pytest.raises(ValueError):
        sinks.canonical({"a": float("nan")})
    assert sinks.canonical({"b": 1, "a": [1, 2]}) == '{"a":[1,2],"b":1}' and len(sinks.digest({})) == 64
    df = spark.sql("SELECT '/home/u/x' AS p")
    assert sinks.scrubbed(df, "p", {"/home/u": "~"}).first().p == "~/x"
    files = spark.sql("SELECT * FROM VALUES ('a.json', 3), ('b.bin', 4) AS t(path, bytes)")
    assert {r.bucket: r.bytes for r in sinks.classified(files, [("json$", "meta"), (".", "rest")]).collect()} == {"meta": 3, "rest": 4}
    with pytest.raises(Exception, match="no bucket"):
        sinks.classified(files, [("json$", "meta")]).collect()


def test_streams_equal_batches(spark, data, tmp_path):
    events = spark.read.parquet(f"{data}/events.parquet")
    schema = ", ".join(f"{n} {t}" for n, t in events.dtypes)
    events.repartition(3).write.parquet(str(tmp_path / "in"))

    def run(df, mode, name):
        q = df.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
        q.awaitTermination(120)
        return spark.table(name)

    got = run(receipts.tumbling(receipts.source(spark, str(tmp_path / "in"), schema, 10)), "complete", "tumbling")
    assert got.agg(F.sum("n")).first()[0] == events.count()
    once = receipts.first_receipts(receipts.source(spark, str(tmp_path / "in"), schema, 10), ["event_id"], delay="400 days")
    assert run(once, "append", "once").count() == events.select("event_id").distinct().count()
    state = run(receipts.running_state(receipts.source(spark, str(tmp_path / "in"), schema, 1)), "update", "state")
    last = state.groupBy("user_id").agg(F.max("n").alias("n"))
    assert last.agg(F.sum("n")).first()[0] == events.count()


def test_receipts(spark):
    known = spark.sql("SELECT 'u1' AS url, 'h1' AS sha256")
    batch = spark.sql("SELECT * FROM VALUES ('u1', 'h1'), ('u1', 'h2'), ('u2', 'h3') AS t(url, sha256)")
    new, refused = receipts.accept(batch, known)
    assert [r.url for r in new.collect()] == ["u2"] and [r.sha256 for r in refused.collect()] == ["h2"]


