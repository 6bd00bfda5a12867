"""Queries that go through sinks, files and readers: what is written is read again and stated in SQL."""

from __future__ import annotations

import hashlib
import io
import zipfile

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from ..functions import codecs, tables
from ..functions.scalar import rounded
from ..sources import archive, sinks, text
from ..sources.shared import checkpointed, folder, put_from_task
from ..sources.tables import LATTICE_SQL, NODES_SQL, SIDE, lattice, nodes, read
from ..streaming import receipts
from .catalog import query
from .field_queries import AXES_SQL, axes
from .pages import paged

L = f"WITH {LATTICE_SQL}"
#: What a page's heights come back as, at a quantum of a thousandth.
QUANTUM = 0.001


def _put(rows, path: str, suffix: str, made=lambda lines: "".join(lines).encode()) -> None:
    """A file for each chunk of rows (folder, chunk, k, line): tasks write them, a chunk a group of bounded size."""

    def write(pdf: pd.DataFrame) -> pd.DataFrame:
        put_from_task(f"{path}/{pdf['folder'].iloc[0]}/{pdf['chunk'].iloc[0]}.{suffix}", made(pdf.sort_values("k")["line"].tolist()))
        return pdf[["chunk"]].head(1)

    rows.groupBy("folder", "chunk").applyInPandas(write, "chunk bigint").count()


@query("field_arrays", f"{L} SELECT region, row, col, z FROM L")
def field_arrays(spark, d):
    """Each field as an array file that a task writes, and all of them read again."""
    with folder(spark) as path:

        def write(pdf: pd.DataFrame) -> pd.DataFrame:
            z, out = np.zeros((SIDE, SIDE)), io.BytesIO()
            z[pdf["row"], pdf["col"]] = pdf["z"]
            np.save(out, z)
            put_from_task(f"{path}/{pdf['region'].iloc[0]}.npy", out.getvalue())
            return pdf[["region"]].head(1)

        lattice(spark, d).groupBy("region").applyInPandas(write, "region bigint").count()
        region = F.regexp_extract("file", r"(\d+)\.npy$", 1).cast("bigint")
        return checkpointed(text.npy_fields(spark, path).select(region.alias("region"), "row", "col", "z"))


def _blobs(pdf: pd.DataFrame) -> list[tuple[int, int, int, int, bytes]]:
    return [(int(r.region), 0, int(r.y), int(r.x), codecs.page_bytes(np.array(r.z).reshape(9, 9), quantum=QUANTUM)) for r in pdf.itertuples()]


def _unpacked(pages):
    """Cells of pages (region, y, x, blob)."""

    def unpack(batches):
        for pdf in batches:
            for r in pdf.itertuples():
                z = codecs.page_values(bytes(r.blob))
                at = np.indices(z.shape)
                yield pd.DataFrame({"region": r.region, "row": (r.y * 8 + at[0].ravel()).astype(np.int32), "col": (r.x * 8 + at[1].ravel()).astype(np.int32), "z": z.ravel()})

    return pages.select("region", "y", "x", "blob").mapInPandas(unpack, "region bigint, row int, col int, z double").select("region", "row", "col", rounded("z", 6).alias("z"))


_PAGED = f"{L}, {NODES_SQL} SELECT region, row, col, round(round_even(z / {QUANTUM}::DOUBLE, 0) * {QUANTUM}::DOUBLE, 6) + 0.0 AS z FROM LN"


@query("archive_scan", f"{_PAGED} WHERE row BETWEEN 16 AND 24 AND col BETWEEN 24 AND 32")
def archive_scan(spark, d):
    """A page of each field from packed archives, one a field: only its bytes are read."""
    with folder(spark) as path:

        def write(pdf: pd.DataFrame) -> pd.DataFrame:
            put_from_task(f"{path}/{pdf['region'].iloc[0]}.pack", archive.pack(_blobs(pdf)))
            return pdf[["region"]].head(1)

        paged(nodes(spark, d), 8, SIDE).groupBy("region").applyInPandas(write, "region bigint").count()
        return checkpointed(_unpacked(archive.read(spark, path).where("y = 2 AND x = 3")))


@query("page_files", f"{_PAGED} GROUP BY ALL")
def page_files(spark, d):
    """Pages in files of their own, read by the digests that an index states; a file that has another is an error."""
    with folder(spark) as path:

        def write(batches):
            for pdf in batches:
                rows = []
                for region, _, y, x, blob in _blobs(pdf):
                    put_from_task(f"{path}/{region}_{y}_{x}.page", blob)
                    rows.append((region, y, x, hashlib.sha256(blob).hexdigest()))
                yield pd.DataFrame(rows, columns=["region", "y", "x", "sha256"])

        stated = checkpointed(paged(nodes(spark, d), 8, SIDE).mapInPandas(write, "region bigint, y int, x int, sha256 string"))
        return checkpointed(_unpacked(archive.page_files(spark, path, stated)).distinct())


@query("manifest_scan", "SELECT c_custkey AS id, c_name AS name, c_nationkey AS zone FROM customer")
def manifest_scan(spark, d):
    """Documents of a thousand customers, read under a stated schema."""
    c = read(spark, d, "customer")
    line = F.to_json(F.struct(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("zone")))
    rows = c.select(F.lit("m").alias("folder"), F.floor(F.col("c_custkey") / 1000).alias("chunk"), F.col("c_custkey").alias("k"), line.alias("line"))
    with folder(spark) as path:
        _put(rows, path, "json", lambda lines: ("[" + ",".join(lines) + "]").encode())
        return checkpointed(text.manifests(spark, f"{path}/m", "id bigint, name string, zone int"))


#: Parts of consecutive keys whose reports share folders.
_IN_FOLDER = 10_000


@query("report_scan", "SELECT CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE 'schema-' || p_size END AS schema, p_partkey % 5 = 0 AS unreadable, count(*) AS files FROM part GROUP BY ALL")
def report_scan(spark, d):
    """Reports in folders below one another, one a part; those that cannot be read stay as rows of their own."""
    key, size = F.col("p_partkey"), F.col("p_size")
    whole = F.to_json(F.struct(F.concat(F.lit("schema-"), size).alias("schema"), F.col("p_name").alias("name")))
    folders = F.concat_ws("/", F.lit("r"), size.cast("string"), F.floor(key / _IN_FOLDER).cast("string"))
    made = read(spark, d, "part").select(key.alias("chunk"), folders.alias("folder"), whole.alias("whole"))
    rows = made.select("folder", "chunk", F.when(F.col("chunk") % 5 == 0, F.expr("left(whole, length(whole) - 9)")).otherwise(F.col("whole")).alias("line"))
    with folder(spark) as path:

        def write(batches):
            for pdf in batches:
                for r in pdf.itertuples():
                    put_from_task(f"{path}/{r.folder}/{r.chunk}.json", r.line.encode())
                yield pdf[["chunk"]].tail(0)

        rows.repartition(4 * spark.sparkContext.defaultParallelism).mapInPandas(write, "chunk bigint").count()
        return checkpointed(text.reports(spark, path).groupBy("schema", F.col("body").isNull().alias("unreadable")).agg(F.count("*").alias("files")))


@query("publication_index", "SELECT 'tile_' || o_orderkey AS name, strftime(o_orderdate, '%Y-%m-%d') AS published FROM orders")
def publication_index(spark, d):
    """Indexes in markup, a thousand orders each."""
    o, key = read(spark, d, "orders"), F.col("o_orderkey")
    line = F.concat(F.lit('<file name="tile_'), key.cast("string"), F.lit('" timestamp="'), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit('"/>'))
    with folder(spark) as path:
        _put(o.select(F.lit("i").alias("folder"), F.floor(key / 1000).alias("chunk"), key.alias("k"), line.alias("line")), path, "xml", lambda lines: f'<?xml version="1.0"?><index>{"".join(lines)}</index>'.encode())
        return checkpointed(text.publication_times(spark, f"{path}/i"))


def _zipped(lines: list[str]) -> bytes:
    """A table with lines before its header; where no line has a second column, its header has none."""
    head = "Kachelname;Aktualitaet" if any(";" in x for x in lines) else "Kachelname"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("t.csv", "\n".join(["Titel;x", head, *lines, ""]))
    return out.getvalue()


@query("tile_archives", "SELECT 'dgm1_' || o_orderkey AS tile, CASE WHEN o_orderkey // 1000 % 3 > 0 THEN strftime(o_orderdate, '%Y-%m-%d') END AS surveyed FROM orders")
def tile_archives(spark, d):
    """Tables in zip archives, a thousand orders each, with lines before their header; every third lacks a column."""
    o, key = read(spark, d, "orders"), F.col("o_orderkey")
    chunk = F.floor(key / 1000)
    line = F.concat(F.lit("dgm1_"), key.cast("string"), F.when(chunk % 3 > 0, F.concat(F.lit(";"), F.date_format("o_orderdate", "yyyy-MM-dd"))).otherwise(""))
    with folder(spark) as path:
        _put(o.select(F.lit("z").alias("folder"), chunk.alias("chunk"), key.alias("k"), line.alias("line")), path, "zip", _zipped)
        return checkpointed(text.tile_metadata(spark, f"{path}/z").select(F.col("Kachelname").alias("tile"), F.col("Aktualitaet").alias("surveyed")))


@query(
    "region_presets",
    "WITH A AS (SELECT n_name AS name, unnest([{'entry': 'key', 'value': CAST(n_nationkey AS VARCHAR)}, {'entry': 'zone', 'value': CAST(n_regionkey AS VARCHAR)}]) AS e FROM nation), B AS (SELECT n_name AS name, {'entry': 'zone', 'value': 'late'} AS e FROM nation WHERE n_nationkey % 2 = 0), C AS (SELECT n_name AS name, {'entry': 'more', 'value': 'x'} AS e FROM nation WHERE n_nationkey % 3 = 0), U AS (SELECT 0 AS k, * FROM A UNION ALL SELECT 1, * FROM B UNION ALL SELECT 2, * FROM C) SELECT name, e.entry AS entry, arg_max(e.value, k) AS value FROM U GROUP BY ALL",
)
def region_presets(spark, d):
    """Three layers of settings; the later wins, entry by entry."""
    n = read(spark, d, "nation").withColumn("name", F.col("n_name"))
    layers = [
        n.select("name", F.create_map(F.lit("key"), F.col("n_nationkey").cast("string"), F.lit("zone"), F.col("n_regionkey").cast("string")).alias("config")),
        n.where("n_nationkey % 2 = 0").select("name", F.create_map(F.lit("zone"), F.lit("late")).alias("config")),
        n.where("n_nationkey % 3 = 0").select("name", F.create_map(F.lit("more"), F.lit("x")).alias("config")),
    ]
    return text.presets(layers).select("name", F.explode("config").alias("entry", "value"))


@query("parts_merged", "SELECT l_linenumber AS part, count(*) AS rows, CAST(sum(l_orderkey) AS BIGINT) AS keys FROM lineitem GROUP BY ALL")
def parts_merged(spark, d):
    """Rows that parts of a run have written to files of their own, put together again."""
    with folder(spark) as path:
        rows = read(spark, d, "lineitem").select("l_linenumber", "l_orderkey")
        rows.write.partitionBy("l_linenumber").json(path)
        merged = spark.read.schema("l_orderkey bigint, l_linenumber int").json(path)
        kind = dict(rows.dtypes)["l_linenumber"]
        return checkpointed(merged.groupBy(F.col("l_linenumber").cast(kind).alias("part")).agg(F.count("*").alias("rows"), F.sum("l_orderkey").alias("keys")))


@query("published_paths", "SELECT page_id, replace(replace(url, 'http://', 'web/'), 'https://', 'web/') AS place FROM pages")
def published_paths(spark, d):
    """Local parts of paths replaced before publication; a row that keeps one would be an error."""
    return sinks.scrubbed(read(spark, d, "pages").select("page_id", F.col("url").alias("place")), "place", {"http://": "web/", "https://": "web/"})


@query("weights_in_sql", f"WITH {AXES_SQL} SELECT nation, o AS out, s AS src, w FROM AW")
def weights_in_sql(spark, d):
    """An operator's weights by a table function of SQL, along each nation's axis."""
    tables.register(spark)
    return spark.sql("SELECT nation, w.* FROM {axes}, LATERAL operator_weights('trapezoid', side, 4) w", axes=axes(spark, d))


@query("streamed_counts", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) + 0.0 AS total FROM events GROUP BY ALL")
def streamed_counts(spark, d):
    """Extension: hourly windows of a stream that ends; each batch writes all windows anew, the last remains."""
    with folder(spark) as path:
        schema = ", ".join(f"{n} {t}" for n, t in read(spark, d, "events").dtypes)
        events = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").option("maxFilesPerTrigger", 1).parquet(d)

        def store(batch, number: int) -> None:
            batch.write.mode("overwrite").parquet(f"{path}/windows")

        run = receipts.tumbling(events).writeStream.outputMode("complete").foreachBatch(store).option("checkpointLocation", f"{path}/log").trigger(availableNow=True).start()
        run.awaitTermination()
        return checkpointed(spark.read.parquet(f"{path}/windows").select(F.col("start").cast(dict(read(spark, d, "events").dtypes)["ts"]), "event_type", "n", rounded("total", 4).alias("total")))
