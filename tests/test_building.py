"""What SQL does not state of separation, fills, receipts and atlases: rounds, crashes, restarts, refusals."""

import heapq
import os
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.functions import hydro
from gridloom.operators import separation, spill
from gridloom.plans import build_queries, catalog
from gridloom.sources import atlas, shared
from gridloom.streaming import receipts


def greedy(rows, distance):
    kept = []
    for g, i, _, x, y in sorted((r for r in rows if None not in r[3:]), key=lambda r: (r[0] is not None, r[0] or 0, r[2], r[1])):
        if all(g != h or max(abs(x - a), abs(y - b)) >= distance for h, _, a, b in kept):
            kept.append((g, i, x, y))
    return {k[:2] for k in kept}


@pytest.mark.parametrize(("n", "width"), [(1200, 30), (400, 1), (300, 2000)])
def test_separation_is_the_greedy_choice_in_few_rounds(spark, n, width):
    rng = random.Random(n)
    rows = [(rng.choice([1, 2, None]), i, rng.randrange(n // 2), float(rng.randint(-width, width)), None if i % 97 == 0 else rng.uniform(-width, width)) for i in range(n)]
    log = []
    df = spark.createDataFrame(rows, "group int, id long, rank long, x double, y double")
    got = {(r["group"], r["id"]) for r in separation.separated(df, 4.0, log).collect()}
    assert got == greedy(rows, 4.0)
    assert len(log) <= 2 + 2 * np.log2(n) and sum(t for _, t in log) == len(got)
    assert separation.separated(df.where("false"), 4.0).isEmpty()


def test_points_of_one_cell_do_not_meet_in_pairs(spark):
    from .test_extra import joined_rows

    df = spark.range(20_000).select(F.lit(1).alias("group"), "id", F.xxhash64("id").alias("rank"), F.rand(1).alias("x"), F.rand(2).alias("y"))
    out = separation.separated(df, 2.0)
    assert out.count() == 1
    own = df.withColumns({"cx": F.lit(0).cast("long"), "cy": F.lit(0).cast("long")})
    left = separation.free(own, out.select("group", "x", "y"), 2.0)
    left.collect()
    assert joined_rows(left._jdf.queryExecution().executedPlan()) <= 20_000


@pytest.mark.parametrize(("side", "kind"), [(17, "noise"), (33, "plateaus"), (9, "flat"), (3, "noise"), (2, "noise")])
def test_spill_levels_equal_the_kernel(spark, side, kind):
    rng = np.random.default_rng(side)
    fields = {k: rng.normal(size=(side, side)) if kind == "noise" else rng.integers(0, 4, (side, side)).astype(float) if kind == "plateaus" else np.zeros((side, side)) for k in range(3)}
    rows = [(k, r, c, float(z[r, c])) for k, z in fields.items() for r in range(side) for c in range(side)]
    got = np.zeros((3, side, side))
    for r in spill.levels(spark.createDataFrame(rows, "region long, row int, col int, z double"), side).collect():
        got[r.region, r.row, r.col] = r.fill
    for k, z in fields.items():
        assert np.array_equal(got[k], hydro.filled(z, lift=0.0))


def _spilled(cells, side):
    """Levels of the cells {(row, col): z} that are there: by a heap, from the border."""
    heap = [(z, at) for at, z in cells.items() if not {0, side - 1}.isdisjoint(at)]
    heapq.heapify(heap)
    out = {}
    while heap:
        level, at = heapq.heappop(heap)
        if at not in out:
            out[at] = level
            for a, b in hydro.NEIGHBOURS:
                if (n := (at[0] + a, at[1] + b)) in cells and n not in out:
                    heapq.heappush(heap, (max(level, cells[n]), n))
    return out


@pytest.mark.parametrize(("tile", "holes"), [(1, 0.5), (8, 0.0), (8, 0.6), (30, 0.5)])
def test_tiles_meet_in_the_same_levels(spark, tile, holes):
    side, rng = 23, np.random.default_rng(tile)
    fields = {k: {(r, c): float(rng.normal() if k else rng.integers(3)) for r in range(side) for c in range(side) if rng.random() >= holes} for k in range(3)}
    rows = [(k, *at, z) for k, f in fields.items() for at, z in f.items()]
    got = spill.levels(spark.createDataFrame(rows, "region long, row int, col int, z double"), side, tile).collect()
    assert sorted((r.region, r.row, r.col, r.z, r.fill) for r in got) == sorted((k, *at, fields[k][at], level) for k, f in fields.items() for at, level in _spilled(f, side).items())
    assert not holes or len(got) < len(rows)  # some cells are cut off


def test_rounds_of_spill_levels_take_fewer_rows_than_there_are_cells(spark, data, monkeypatch):
    """Edges of all cells went through the first round before, about four a cell."""
    sizes, table = [], shared.Rounds.table

    def counted(self, df):
        sizes.append((out := table(self, df)).count())
        return out

    monkeypatch.setattr(shared.Rounds, "table", counted)
    cells = catalog.QUERIES["spill_levels"](spark, data).count()
    assert 0 < max(sizes) < cells / 4


def test_spill_levels_agree_with_sql_on_odd_vectors(spark, tmp_path):
    """Vectors that are not there let nothing through; a component that is not there is as low as any."""
    rng = np.random.default_rng(7)
    rows = [(k, [None if k == 20 and i in (30, 31) else float(v) for i, v in enumerate(rng.normal(size=64).round(2))]) for k in range(190) if k not in (70, 75, 100)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    want = duck.execute(f"SELECT region, row, col, fill FROM ({catalog.ORACLE_SQL['spill_levels']})").fetchall()
    got = [tuple(r) for r in catalog.QUERIES["spill_levels"](spark, str(tmp_path)).select("region", "row", "col", "fill").collect()]
    assert len(want) == (128 - 3) * 64 and sorted(got) == sorted(want)


def _run(spark, folder, allowance):
    stream = receipts.received(receipts.source(spark, f"{folder}/in", "url string, seq long, sha256 string, bytes long", 1), allowance)
    run = stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/log").trigger(availableNow=True).start()
    run.awaitTermination()
    return sorted((r.key, r.place, r.outcome.split(":")[-1].strip()) for r in spark.read.parquet(f"{folder}/out").collect())


def test_receipts_survive_a_restart(spark, tmp_path):
    spark.conf.set(build_queries._STORE, build_queries._ROCKS)
    put = lambda *rows: spark.createDataFrame(rows, "url string, seq long, sha256 string, bytes long").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    put(("a", 2, "x", 5), ("a", 1, "y", 99), ("b", 1, "p", 5), ("b", 1, "p", 5), (None, 1, "n", 1), ("c", 1, None, 1))
    first = [("a", 1, "over the allowance"), ("a", 2, "accepted"), ("b", 1, "accepted")]
    assert _run(spark, tmp_path, 10) == first
    assert _run(spark, tmp_path, 10) == first  # nothing new
    put(("a", 3, "x", 5), ("a", 4, "z", 5), ("b", 9, "p", 5), ("d", 1, "q", 1))
    put(("d", 2, "r", 1), ("d", 3, "q", 1))
    assert _run(spark, tmp_path, 10) == sorted([*first, ("a", 4, "another identity"), ("d", 1, "accepted"), ("d", 2, "another identity")])


def _pages(spark, hole=False):
    z = F.transform(F.sequence(F.lit(0), F.lit(80)), lambda k: (k * F.col("id") / 100).cast("double"))
    z = F.when((F.col("id") == 17) & F.lit(hole), F.transform(z, lambda v: F.when(v == 0, None).otherwise(v))).otherwise(z)
    return spark.range(40).select(F.lit(0).cast("long").alias("region"), (F.col("id") % 2).cast("int").alias("level"), F.col("id").cast("int").alias("y"), F.lit(0).alias("x"), z.alias("z"))


def test_an_atlas_is_there_whole_or_not_at_all(spark, tmp_path):
    path = str(tmp_path / "atlas")
    with pytest.raises(Exception, match="a hole in region 0, level 1, page 17"):
        atlas.publish(_pages(spark, hole=True), path, size=300)
    assert not list((tmp_path / "atlas").glob("parts-*/*")) and not (tmp_path / "atlas" / "atlas.json").exists()
    with pytest.raises(Exception, match="atlas.json|No such file"):
        atlas.read(spark, path).count()

    def dies(batches):
        for pdf in batches:
            if (pdf["y"] == 23).any():
                os.kill(os.getpid(), 9)
            yield pdf

    pages = _pages(spark)
    with pytest.raises(Exception, match="(?i)crashed|aborted|EOF"):
        atlas.publish(pages.mapInPandas(dies, pages.schema), path, size=300)
    assert not (tmp_path / "atlas" / "atlas.json").exists()
    atlas.publish(pages, path, size=300)
    assert {(r.level, r.y) for r in atlas.read(spark, path).collect()} == {(k % 2, k) for k in range(40)}
    assert {r.y for r in atlas.read(spark, path).where("level = 1 AND y > 20").collect()} == {k for k in range(21, 40) if k % 2}
    with pytest.raises(Exception, match="there is an atlas"):
        atlas.publish(pages, path)
    # files that the manifest does not list are not read; one that it lists has to be as it states
    part = next((tmp_path / "atlas").glob("parts-*/*.pack"))
    (part.parent / "more.pack").write_bytes(part.read_bytes())
    assert atlas.read(spark, path).count() == 40
    part.write_bytes(part.read_bytes()[:-1])
    with pytest.raises(Exception, match="not the archive that the manifest lists"):
        atlas.read(spark, path).count()


def _written(tmp_path, *docs):
    for k, doc in enumerate(docs):
        (tmp_path / f"{k}.xml").write_text(doc)
    return str(tmp_path)


def test_features_in_the_order_of_the_document(spark, tmp_path):
    from gridloom.sources import markup

    at = "<g:pos>400000 5700000</g:pos>"
    one = f"<w:All xmlns:w='w' note='a'><w:member><u:T g:id='1'><u:b> x </u:b>\n<u:c><u:b>y</u:b><d>http://z:1 q:r=&lt;</d></u:c><p>{at}</p><p><g:pos>1 2</g:pos></p></u:T></w:member><w:member/><w:member><T/></w:member></w:All>"
    got = sorted(((r.type, r.attributes, [tuple(p) for p in r.points]) for r in markup.features(spark, _written(tmp_path, one, "<w:All/>"), "w:member").collect()), key=lambda r: len(r[1]))
    assert got == [("T", {}, []), ("T", {"b": "x", "d": "http://z:1 q:r=<"}, [(400000.0, 5700000.0)])]
    swapped = one.replace("400000 5700000", "5700000 400000")
    with pytest.raises(Exception, match="not an easting and a northing"):
        markup.features(spark, _written(tmp_path, swapped), "w:member").collect()
    with pytest.raises(Exception, match="the provider refused"):
        markup.features(spark, _written(tmp_path, "<ows:ExceptionReport>no</ows:ExceptionReport>"), "w:member").collect()
    with pytest.raises(Exception, match="(?i)mismatched|not well-formed|no element|unclosed|parse"):
        markup.features(spark, _written(tmp_path, "<w:member><T><a></T></w:member>"), "w:member").collect()


def test_rings_that_are_none_are_left_out(spark, tmp_path):
    from gridloom.sources import markup

    side = lambda kind, text: f"<{kind}><LinearRing><posList>{text}</posList></LinearRing></{kind}>"
    box = "300000 5600000 300001 5600000 300001 5600001 300000 5600000"
    area = f"<Polygon>{side('exterior', box)}{side('interior', '1 2 3')}{side('interior', box[:-8])}{side('interior', box)}</Polygon>"
    doc = f"<m><U id='a'>{area}<Polygon>{side('interior', box)}</Polygon>{area}</U></m><m><U id='b'/></m><m><V id='c'>{area}</V></m>"
    rows = markup.rings(spark, _written(tmp_path, doc), "m", "U").collect()
    assert {(r.id, r.polygon, r.ring) for r in rows} == {("a", 0, 0), ("a", 0, 1), ("a", 1, 0), ("a", 1, 1)} and len(rows) == 16


def test_inventory_samples_the_least_values(spark, tmp_path):
    from gridloom.sources import markup

    doc = "".join(f"<m><T><a>{k:03d}</a><a/><g><Point srsName='s'><pos>1 2</pos></Point></g><ref xmlns:x='http://www.w3.org/1999/xlink' x:href='#{k % 2}'>t</ref></T></m>" for k in range(40))
    got = {(r.kind, r.name): (r.n, r.samples) for r in markup.inventory(spark, _written(tmp_path, doc), "m").collect()}
    assert got == {("feature", "T"): (40, []), ("field", "a"): (80, [f"{k:03d}" for k in range(12)]), ("field", "ref"): (40, ["#0", "#1"]), ("reference", "ref"): (40, []), ("geometry", "Point"): (40, []), ("srs", "s"): (40, [])}


def test_coverages_are_negotiated_by_fallbacks(spark):
    from gridloom.sources import coverages

    rows = [("a", ["a", "x:a"], "E N"), ("a", ["x:a", "b"], "northing Easting"), ("a", ["x:a", "y__a"], "x y"), ("a", [], "x y"), ("a", ["a"], None), ("a", ["a"], "x"), ("a", ["a"], "x lon"), ("a", ["p:q__a"], "e n h")]
    df = spark.createDataFrame([(k, w, v, None, a and a.split(), ["SCALEAXESBYFACTOR"] if k % 2 else []) for k, (w, v, a) in enumerate(rows)], "id int, wanted string, available array<string>, refused string, labels array<string>, accepts array<string>")
    got = [(r.coverage, r.easting, r.northing, r.refusal, r.value) for r in coverages.negotiated(df, 0.5).orderBy("id").collect()]
    assert got == [
        ("a", "E", "N", None, ""), ("x:a", "Easting", "northing", None, "Easting(0.5),northing(0.5)"), (None, "x", "y", "ambiguous: x:a y__a", None), (None, "x", "y", "absent", None),
        ("a", "x", "y", None, ""), ("a", None, None, "too few axes", None), ("a", None, None, "no easting and northing", None), ("p:q__a", "e", "n", None, "e(0.5),n(0.5)"),
    ]
    doc = spark.createDataFrame([("<a xmlns:g='g'><g:Envelope axisLabels='E N' srsName='s'/><g:low>0 1</g:low><g:high>9 20</g:high><g:pos>1.5 2</g:pos></a>",), ("<a/>",)], "xml string")
    one, none = coverages.described(doc).drop("xml").collect()
    assert tuple(one) == (["E", "N"], "s", [1.5, 2.0], [0, 1], [9, 20], [10, 20]) and set(none) == {None}


def test_queries_have_rows_of_all_kinds(spark, data):
    from gridloom.plans.registry import QUERIES

    assert {r.outcome.partition(":")[0] for r in QUERIES["receipts_streamed"](spark, data).collect()} == {"accepted", "refused"}
    refusals = {(r.refusal or "").partition(":")[0] for r in QUERIES["schema_negotiation"](spark, "/root/testdata/sf0.01").collect()}
    assert refusals == {"", "exception", "absent", "ambiguous", "no easting and northing", "too few axes"}
    assert QUERIES["level_interval"](spark, data).count() > 0


def test_projection_at_known_places(spark):
    """The meridian arc to 45 degrees on the central meridian, symmetry about it, and the way back from anywhere in reach."""
    from gridloom.operators import geodesy

    df = spark.createDataFrame([(9.0, 45.0), (9.0, 0.0), (12.0, 51.5), (6.0, 51.5), (15.0, 80.0), (3.5, -33.0)], "lon double, lat double")
    x, y = geodesy.projected(F.col("lon"), F.col("lat"))
    lon, lat = geodesy.geographic(F.col("x"), F.col("y"))
    rows = df.withColumns({"x": x, "y": y}).withColumns({"lon2": lon, "lat2": lat}).collect()
    assert abs(rows[0].y / 0.9996 - 4984944.378) < 1e-3 and rows[0].x == 500000.0 and abs(rows[1].y) < 1e-9
    assert abs(rows[2].x + rows[3].x - 1e6) < 1e-6 and abs(rows[2].y - rows[3].y) < 1e-6
    assert all(abs(r.lon - r.lon2) < 1e-9 and abs(r.lat - r.lat2) < 1e-9 for r in rows)


@pytest.mark.parametrize(("coarse", "factor"), [(17, 4), (5, 3), (2, 2), (40, 5)])
def test_splines_pass_through_the_nodes(coarse, factor):
    """The table equals the solution of the mirrored system, and gives samples back."""
    from gridloom.operators import resample

    w = np.zeros(((coarse - 1) * factor + 1, coarse))
    for o, s, v in resample.weights("bspline", (coarse - 1) * factor + 1, factor):
        w[o, s] = v
    assert np.allclose(w[::factor], np.eye(coarse), atol=1e-12) and np.allclose(w.sum(1), 1)
    a = np.zeros((coarse, coarse))
    for i in range(coarse):
        for k, v in ((-1, 1 / 6), (0, 4 / 6), (1, 1 / 6)):
            a[i, resample._mirrored(i + k, coarse)] += v
    z = np.random.default_rng(coarse).normal(size=coarse)
    c = np.linalg.solve(a, z)
    u = 0.5
    if factor % 2 == 0:
        basis = np.array([(1 - u) ** 3, 3 * u**3 - 6 * u * u + 4, -3 * u**3 + 3 * u * u + 3 * u + 1, u**3]) / 6
        for j in range(coarse - 1):
            assert np.isclose((w @ z)[j * factor + factor // 2], sum(b * c[resample._mirrored(j - 1 + k, coarse)] for k, b in enumerate(basis)))


def test_strikes_spread_without_wrapping(spark):
    from gridloom.operators import masks

    cells = spark.createDataFrame([(0, r, c) for r in range(7) for c in range(9)], "region long, row int, col int")
    faults = spark.createDataFrame([(0, 0, 0, 10.0), (0, 0, 0, 190.0), (0, 6, 8, 45.0), (0, 6, 7, 135.0), (0, 99, 0, 1.0)], "region long, row int, col int, strike double")
    got = {(r.row, r.col): r for r in masks.fault_growth(faults, cells, 5).collect()}
    assert len(got) == 63 and got[0, 0].distance == 0 and got[0, 1].distance == 1 and got[6, 0].distance == 5 and not got[6, 0].reached
    assert np.isclose(got[0, 0].sin2, np.sin(np.radians(20))) and np.isclose(got[3, 1].cos2, np.cos(np.radians(20)) * np.exp(-4 / (5 / 3)))
    assert np.isclose(got[5, 7].sin2, -np.exp(-1 / (5 / 3))) and np.isclose(got[4, 7].sin2, got[4, 7].sin2)
    assert all(r.distance == min(5, min(abs(r.row - a) + abs(r.col - b) for a, b in ((0, 0), (6, 8), (6, 7)))) for r in got.values())
    none = masks.fault_growth(faults.where("false"), cells, 2).collect()
    assert {(r.distance, r.sin2, r.reached) for r in none} == {(2, 0.0, False)}


def test_edges_give_what_a_task_gives(spark, data):
    from gridloom.operators import flow
    from gridloom.plans.flow_queries import _surfaces

    cells = _surfaces(spark, data)
    one, many = (sorted(map(tuple, flow.traced(cells, 64, ("z", "q"), most=m).drop("z", "q").collect())) for m in (1 << 24, 100))
    assert one == many


def test_valleys_lie_below_their_banks(spark):
    from gridloom.operators import points

    cells = spark.createDataFrame([(0, r, c, abs(c - 8.0)) for r in range(17) for c in range(17)], "region long, row int, col int, z double")
    line = lambda n, x: [(n, 0, k, float(x), float(k)) for k in range(2, 15)]
    df = spark.createDataFrame([*line(1, 8), *line(2, 4), (3, 0, 0, 8.0, 8.0), (3, 0, 1, 8.0, 9.0)], "line long, region long, k int, x double, y double")
    got = points.valley_floor(df, cells, 2.0, 17).first()
    assert (got.samples, got.below) == (26, 0.5)
    at = {(r.line, r.k, r.side): (r.x, r.y) for r in points.banks(df, 2.0).collect()}
    assert at[1, 5, 0] == (8.0, 5.0) and {at[1, 5, 1], at[1, 5, -1]} == {(6.0, 5.0), (10.0, 5.0)} and not any(k[0] == 3 for k in at)


def test_points_meet_fields_in_tasks_that_follow_the_cores(spark):
    from gridloom.plans.registry import QUERIES

    df = QUERIES["point_lookup"](spark, "/root/testdata/sf0.01")
    own = [len(set(p)) for p in df.rdd.mapPartitions(lambda rows: [[(r.row, r.col) for r in rows]]).collect()]
    assert len(own) >= 4 * spark.sparkContext.defaultParallelism and max(own) < sum(own) / 4


def test_points_in_many_fields_are_kept_in_few_bytes(spark, tmp_path):
    import duckdb
    from gridloom.plans.registry import ORACLE_SQL, QUERIES

    d = str(tmp_path)
    spark.sql("SELECT 64 * id + 3 AS o_orderkey, CASE WHEN id < 900 THEN 5 WHEN id < 1250 THEN 70 WHEN id < 1260 THEN NULL ELSE id END AS o_custkey FROM range(1264)").write.parquet(f"{d}/orders.parquet")
    spark.sql("SELECT id AS vec_id, transform(sequence(0, 63), x -> CAST(pmod(hash(id, x), 1000003) AS float)) AS embedding FROM range(64 * 601 + 9)").write.parquet(f"{d}/embeddings.parquet")
    QUERIES["point_lookup"](spark, d).write.parquet(f"{d}/out")
    rows, size = 1254 * 601, sum(p.stat().st_size for p in (tmp_path / "out").glob("*.parquet"))
    c = duckdb.connect()
    for name in ("orders", "embeddings"):
        c.execute(f"CREATE VIEW {name} AS SELECT * FROM '{d}/{name}.parquet/*.parquet'")
    own, there = f"SELECT id, region, row, col, z FROM '{d}/out/*.parquet'", ORACLE_SQL["point_lookup"]
    assert c.execute(f"SELECT count(*) FROM ({own})").fetchall() == [(rows,)]
    assert c.execute(f"SELECT count(*) FROM (({own}) EXCEPT ALL ({there}))").fetchall() == c.execute(f"SELECT count(*) FROM (({there}) EXCEPT ALL ({own}))").fetchall() == [(0,)]
    assert size < 0.5 * rows


def test_requests_read_only_the_names_that_they_can_mean(spark):
    from gridloom.sources import coverages

    offers = [["a", "x:a", "x:y"], ["x:a", "b", "y__a", "y__a"], []] + [[f"s:{k}" for k in range(500)]]
    told = spark.createDataFrame([(k, v, "closed" if k == 2 else None, None, ["none"]) for k, v in enumerate(offers)], "service int, available array<string>, refused string, labels array<string>, accepts array<string>")
    rows = [(i, s, w) for i, (s, w) in enumerate([(0, "a"), (0, "x:a"), (0, "y"), (0, "z"), (1, "a"), (1, "b"), (1, "y__a"), (2, "a"), (3, "7"), (3, "s:7"), (3, "s")])]
    requests = spark.createDataFrame(rows, "id int, service int, wanted string")
    met = coverages.asked(requests, told, "service")
    assert max(len(r.available) for r in met.collect()) == 3
    answers = lambda df: [(r.id, r.coverage, r.refusal, r.form) for r in coverages.negotiated(df, 0.5).orderBy("id").collect()]
    assert answers(met) == answers(requests.join(told, "service"))


def test_reports_are_listed_by_tasks(spark, tmp_path):
    from gridloom.sources import text

    for name in ("a.json", "x/b.json", "x/y/c.json", "x/y/d.txt", "x/.e.json", "_t/f.json"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text('{"schema": "s"}')
    (tmp_path / "x" / "g.json").write_bytes(b"\xff{")
    got = text.reports(spark, str(tmp_path))
    assert sorted((os.path.basename(r.file), r.schema, r.body is None) for r in got.collect()) == [("a.json", "s", False), ("b.json", "s", False), ("c.json", "s", False), ("g.json", None, True)]
    assert not got.inputFiles()


@pytest.mark.parametrize("most", [2**17, 0])
def test_vertices_stay_one_row_with_their_banks(spark, monkeypatch, most):
    from gridloom.operators import points

    monkeypatch.setattr(points, "MOST_SENT", most)
    cells = spark.createDataFrame([(g, r, c, abs(c - 8.0) + 0.01 * r) for g in (0, 1) for r in range(17) for c in range(17)], "region long, row int, col int, z double")
    axes = spark.createDataFrame([(n, n % 2, k, float((n * 37 + k * 5) % 170) / 10, float((n * 53 + k * 7) % 170) / 10) for n in range(40) for k in range(6)], "line long, region long, k int, x double, y double")
    got = {r.region: (r.samples, r.below, r.mirrored) for r in points.valley_floor(axes, cells, 1.5, 17).collect()}
    at = points.banks(axes, 1.5).select(F.struct("line", "k", "side").alias("key"), "region", F.col("y").alias("r"), F.col("x").alias("c"))
    turned = cells.withColumn("row", 16 - F.col("row"))
    for n, field in enumerate((cells, turned)):
        z = {(r.region, *r.key): r.z for r in points.bilinear(at, field, "key", 17).collect()}
        for g in (0, 1):
            own = [k for k in z if k[0] == g and k[3] == 0 and all((*k[:3], s) in z for s in (1, -1))]
            low = [z[k] <= min(z[(*k[:3], s)] for s in (1, -1)) + 1e-9 for k in own]
            assert got[g][0] == len(own) > 20 and got[g][1 + n] == pytest.approx(sum(low) / len(low))


def test_receipts_come_many_keys_to_a_batch(spark, tmp_path):
    stream = receipts.received(receipts.source(spark, str(tmp_path), "url string, seq long, sha256 string, bytes long", 1), 10)
    assert "FlatMapGroupsInPandasWithState" in stream._jdf.queryExecution().logical().toString()
