"""WARC archives as a Spark data source, written and read in Python.

The writer puts each record into a gzip member of its own, whose extra field states its length, so
that a reader can go on to the next record without inflating this one; a manifest lists the files
of finished tasks and, for each, places where a reader may begin. The reader plans its partitions
from the manifest, takes filters on headers, parses a record's headers first, and neither reads
nor decodes the payloads of records that the filters drop or that are not asked for.
"""

from __future__ import annotations

import base64
import hashlib
import io
import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, In, InputPartition, IsNotNull, IsNull, WriterCommitMessage
from pyspark.sql.types import StructType

from .common import Scratch, bitmap, checkpointed, marked, small_batches

SCHEMA = (
    "record_id string, record_type string, target_uri string, date string, refers_to string, "
    "payload_digest string, payload_bytes long, file string, place long, payload binary"
)
#: Names of header fields.
FIELDS = {"record_id": "warc-record-id", "record_type": "warc-type", "target_uri": "warc-target-uri", "date": "warc-date", "refers_to": "warc-refers-to", "payload_digest": "warc-payload-digest"}
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _store(path: str):
    """The file system of a path and the path in it; anything that pyarrow knows."""
    from pyarrow import fs

    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def member(record: bytes, most: int = (1 << 32) - 1) -> bytes:
    """A gzip member whose extra field `sl` states its whole length and that of the record; one that
    is too long for the field goes without, and a reader has to inflate it to pass it."""
    packer = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = packer.compress(record) + packer.flush()
    if max(len(body) + 32, len(record)) > most:
        head = b"\x1f\x8b\x08\0\0\0\0\0\0\xff"
    else:
        head = b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H2sHII", 12, b"sl", 8, len(body) + 32, len(record))
    return head + body + struct.pack("<II", zlib.crc32(record), len(record) & 0xFFFFFFFF)


def record(kind: str, record_id: str, uri: str | None, date: str, refers_to: str | None, digest: str, payload: bytes | None, length: int, media: str) -> bytes:
    """A response with its payload, or a revisit with the HTTP header alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: {media}\r\nContent-Length: {length}\r\n\r\n".encode()
    block = http + (payload or b"") if kind == "response" else http
    fields = [("WARC-Type", kind), ("WARC-Record-ID", f"<{record_id}>"), ("WARC-Date", date)]
    if uri is not None:
        fields.append(("WARC-Target-URI", uri.replace("\r", "%0D").replace("\n", "%0A")))
    fields.append(("WARC-Payload-Digest", f"sha1:{digest}"))
    if kind == "revisit":
        fields += [("WARC-Refers-To", f"<{refers_to}>"), ("WARC-Profile", PROFILE)]
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    return head.encode() + block + b"\r\n\r\n"


@dataclass
class Written(WriterCommitMessage):
    files: list


class WarcWriter(DataSourceWriter):
    """Rows (record_id, target_uri, refers_to, payload): refers_to makes a revisit."""

    def __init__(self, path: str, options: dict):
        self.path, self.date = path, options.get("date", "1970-01-01T00:00:00Z")
        self.media = options.get("media", "text/html; charset=utf-8")
        self.roll, self.step = int(options.get("roll", 256 << 20)), int(options.get("split", 8 << 20))

    def write(self, rows: Iterator) -> WriterCommitMessage:
        store, top = _store(self.path)
        store.create_dir(top, recursive=True)
        files, out, size, splits = [], None, 0, [0]
        for r in rows:
            payload = bytes(r["payload"] or b"")
            kind = "response" if r["refers_to"] is None else "revisit"
            data = member(record(kind, r["record_id"], r["target_uri"], self.date, r["refers_to"], base32_sha1(payload), payload, len(payload), self.media))
            if out is not None and size + len(data) > self.roll:
                out.close()
                files[-1] |= {"bytes": size, "splits": splits}
                out = None
            if out is None:
                name = f"part-{uuid.uuid4().hex}.warc.gz"
                files.append({"name": name})
                out, size, splits = store.open_output_stream(f"{top}/{name}", compression=None), 0, [0]
            if size - splits[-1] >= self.step:
                splits.append(size)
            out.write(data)
            size += len(data)
        if out is not None:
            out.close()
            files[-1] |= {"bytes": size, "splits": splits}
        return Written(files)

    def commit(self, messages: list) -> None:
        store, top = _store(self.path)
        store.create_dir(top, recursive=True)
        listed = [f for m in messages if m for f in m.files]
        with store.open_output_stream(f"{top}/_manifest-{uuid.uuid4().hex}.json") as out:
            out.write(json.dumps(listed).encode())

    def abort(self, messages: list) -> None:
        store, top = _store(self.path)
        for f in [f for m in messages if m for f in m.files]:
            store.delete_file(f"{top}/{f['name']}")


@dataclass
class Span(InputPartition):
    """Parts of files: (path, first byte, end)."""

    parts: list


class Damaged(ValueError):
    """A record that is cut or is none."""


class Members:
    """Records of a file from one byte to another: headers first, the rest only if asked for. A record
    that the file ends in, or bytes that are no record, raise Damaged."""

    def __init__(self, stream, start: int, end: int, name: str = "the file"):
        self.stream, self.at, self.end, self.name = stream, start, end, name
        self.size = stream.seek(0, io.SEEK_END)

    def __iter__(self):
        while self.at < self.end:
            self.stream.seek(self.at)
            head = self.stream.read(22)
            if head and not head.strip(b"\r\n"):
                self.at += len(head)
            elif head[:2] == b"\x1f\x8b":
                yield from self._gzip(head)
            elif head[:5] == b"WARC/":
                yield from self._plain()
            else:
                raise self.damaged(self.at)

    def damaged(self, place: int) -> Damaged:
        return Damaged(f"damaged record at byte {place} of {self.name}")

    def _gzip(self, head: bytes):
        start, known, took = self.at, None, 0
        if len(head) == 22 and head[3] & 4 and head[12:14] == b"sl":
            known = struct.unpack_from("<I", head, 16)[0]
            if start + known > self.size:
                raise self.damaged(start)
        inflate, seen = zlib.decompressobj(31), bytearray()
        self.stream.seek(start)

        def more(size: int, keep: bool = True) -> bool:
            """Inflates a little further; false at the member's end."""
            nonlocal took
            if not (raw := inflate.unconsumed_tail):
                raw = self.stream.read(min(size, known - took) if known else size)
                took += len(raw)
            try:
                data = inflate.decompress(raw, 1 << 20)
            except zlib.error as e:
                raise self.damaged(start) from e
            if not raw and not data and not inflate.eof:
                raise self.damaged(start)
            if keep:
                seen.extend(data)
            return not inflate.eof

        while b"\r\n\r\n" not in seen and more(4096):
            pass
        if b"\r\n\r\n" not in seen:
            raise self.damaged(start)

        def rest() -> bytes:
            while not inflate.eof:
                more(1 << 20)
            return bytes(seen)

        yield start, bytes(seen), rest
        while not known and not inflate.eof:  # the member's length is not stated: inflate it, keeping nothing
            more(1 << 20, False)
        self.at = start + (known or took - len(inflate.unused_data))

    def _plain(self):
        start, seen = self.at, bytearray()
        self.stream.seek(start)
        while b"\r\n\r\n" not in seen and (raw := self.stream.read(4096)):
            seen.extend(raw)
        if b"\r\n\r\n" not in seen or not (length := headers(bytes(seen)).get("content-length", "")).isdigit():
            raise self.damaged(start)
        total = seen.index(b"\r\n\r\n") + 4 + int(length) + 4
        if start + total > self.size:
            raise self.damaged(start)

        def rest() -> bytes:
            self.stream.seek(start)
            return self.stream.read(total)

        yield start, bytes(seen[:total]), rest
        self.at = start + total


def headers(data: bytes) -> dict[str, str]:
    lines = data[: data.index(b"\r\n\r\n")].decode("utf-8", "replace").split("\r\n")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}


class WarcReader(DataSourceReader):
    def __init__(self, path: str, options: dict):
        self.path, self.tests = path, []
        self.size = int(options.get("span", 32 << 20))
        self.payload = options.get("payload", "true") == "true"
        self.verify = options.get("verify", "false") == "true"

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Takes equality, membership and null tests on header columns."""
        for f in filters:
            name = f.attribute[0] if hasattr(f, "attribute") and len(f.attribute) == 1 else None
            if name in FIELDS and isinstance(f, EqualTo):
                self.tests.append((name, "in", [f.value]))
            elif name in FIELDS and isinstance(f, In):
                self.tests.append((name, "in", list(f.value)))
            elif name in FIELDS and isinstance(f, (IsNull, IsNotNull)):
                self.tests.append((name, "null", isinstance(f, IsNull)))
            else:
                yield f

    def partitions(self) -> list[Span]:
        """Files of the manifests, cut where these say that a record begins; of a folder without a
        manifest all *.warc and *.warc.gz, whole. Small parts share a partition."""
        from pyarrow import fs

        store, top = _store(self.path)
        found = store.get_file_info(fs.FileSelector(top, recursive=False))
        lists = [f.path for f in found if f.base_name.startswith("_manifest-")]
        sizes = {f.base_name: f.size for f in found}
        parts: list[tuple[str, int, int]] = []
        if lists:
            for name in sorted(lists):
                with store.open_input_stream(name) as s:
                    for f in json.loads(s.read()):
                        if sizes.get(f["name"], -1) < f["bytes"]:
                            raise Damaged(f"{top}/{f['name']} is cut or missing: its manifest states {f['bytes']} bytes")
                        cuts = [*f["splits"], f["bytes"]]
                        parts += [(f"{top}/{f['name']}", a, b) for a, b in zip(cuts, cuts[1:], strict=False) if b > a]
        else:
            parts = [(f.path, 0, f.size) for f in sorted(found, key=lambda f: f.path) if f.base_name.endswith((".warc", ".warc.gz"))]
        spans, own, size = [], [], 0
        for p in parts:
            if own and size + p[2] - p[1] > self.size:
                spans.append(Span(own))
                own, size = [], 0
            own.append(p)
            size += p[2] - p[1]
        return [*spans, Span(own)] if own else [Span([])]

    def _wanted(self, h: dict) -> bool:
        for name, kind, value in self.tests:
            own = field(h, name)
            if (own not in value) if kind == "in" else ((own is None) != value):
                return False
        return True

    def read(self, partition: Span) -> Iterator[tuple]:
        store, _ = _store(self.path)
        for path, start, end in partition.parts:
            with store.open_input_file(path) as raw:
                members = Members(io.BufferedReader(raw, 1 << 20), start, end, path)
                for place, seen, rest in members:
                    if not self._wanted(h := headers(seen)):
                        continue
                    kind, payload, begin = field(h, "record_type"), None, seen.index(b"\r\n\r\n") + 4
                    if not h.get("content-length", "").isdigit():
                        raise members.damaged(place)
                    stop = begin + int(h["content-length"])
                    at, full = seen.find(b"\r\n\r\n", begin, stop), None
                    if at < 0 or (kind != "revisit" and (self.payload or self.verify)):
                        full = rest()
                        if len(full) < stop:
                            raise members.damaged(place)
                        at = full.find(b"\r\n\r\n", begin, stop)
                    http = headers(b"x\r\n" + (full or seen)[begin : at + 4].partition(b"\r\n")[2]) if at >= 0 else {}
                    length = int(http["content-length"]) if http.get("content-length", "").isdigit() else -1
                    digest = field(h, "payload_digest")
                    if full is not None and kind != "revisit" and at >= 0:
                        payload = full[at + 4 : stop]
                        if self.verify and (base32_sha1(payload) != digest or length not in (-1, len(payload))):
                            raise members.damaged(place)
                        length = len(payload)
                    own = [field(h, name) for name in FIELDS]
                    yield (*own, length if length >= 0 else None, path, place, payload if self.payload else None)


def field(h: dict, name: str) -> str | None:
    """A header's value as rows have it: ids without angle brackets, digests without the algorithm."""
    value = h.get(FIELDS[name])
    if value is not None and name in ("record_id", "refers_to"):
        return value[1:-1] if value[:1] == "<" and value[-1:] == ">" else value
    return value.removeprefix("sha1:") if value is not None and name == "payload_digest" else value


class WarcSource(DataSource):
    """spark.read.format("warc").load(folder) and df.write.format("warc").mode("append").save(folder)."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> WarcReader:
        return WarcReader(self.options["path"], dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> WarcWriter:
        if overwrite:
            raise ValueError("archives are appended to, not overwritten")
        return WarcWriter(self.options["path"], dict(self.options))


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)
    small_batches(spark)


#: Repeated payloads, in rows of 40 bytes, that are sent to all tasks.
SENT = 100_000


def revisits(scratch: Scratch, pages: DataFrame, key: str, payload: str, least: int = 0, sent: int = SENT) -> DataFrame:
    """pages with __first: the smallest key with the same payload, where that is another row's.

    Payloads shorter than `least` bytes are never revisits. Rows that repeat the smallest key are
    all responses; a null key is never the smallest, so of null keys alone all are responses.
    Payloads are not shuffled if at most `sent` of them repeat; else only those that a filter of
    bounded size takes for repeated ones.
    """
    hashed = pages.withColumn("__sha1", F.sha1(F.col(payload)))
    firsts = hashed.where(F.octet_length(payload) >= least).groupBy("__sha1").agg(F.min(key).alias("__first"), F.count("*").alias("__n"))
    firsts = scratch.table(firsts.where("__n > 1").select("__sha1", "__first"), "firsts")
    other = F.col("__first").isNotNull() & ~F.coalesce(F.col("__first") == F.col(key), F.lit(False))
    if firsts.count() <= sent:
        joined = hashed.join(F.broadcast(firsts), "__sha1", "left")
    else:
        seen = scratch.table(bitmap(firsts.withColumn("__h", F.xxhash64("__sha1")), "__h"), "seen")
        split = marked(hashed.withColumn("__h", F.xxhash64("__sha1")), "__h", seen, "__again").drop("__h")
        alone = split.where("NOT __again").withColumn("__first", F.lit(None).cast(firsts.schema["__first"].dataType))
        joined = split.where("__again").join(firsts, "__sha1", "left").unionByName(alone).drop("__again")
    return joined.withColumn("__first", F.when(other, F.col("__first"))).drop("__sha1")


def archive(pages: DataFrame, folder: str, least: int = 0, key: str = "page_id", uri: str = "url", payload: str = "html") -> None:
    """Writes a record for each row: a null payload is empty, and a null uri is left out.

    A record's id is urn:page: and the key. Where a key is null or repeats, a random part follows it,
    so that no two records share an id; refers_to then names the key alone, which all of these
    begin with. Repeated rows are written each; other columns are left out.
    """
    spark = pages.sparkSession
    register(spark)
    shaped = pages.select(F.col(key).alias("key"), F.col(uri).cast("string").alias("target_uri"), F.coalesce(F.col(payload), F.lit("")).cast("binary").alias("payload"))
    named = lambda c: F.concat(F.lit("urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("null")))
    with Scratch(spark) as scratch:
        again = scratch.table(shaped.where("key IS NOT NULL").groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key", F.lit(True).alias("again")), "again")
        rows = revisits(scratch, shaped, "key", "payload", least).join(again, "key", "left")
        own = F.concat(named("key"), F.when(F.col("again") | F.col("key").isNull(), F.concat(F.lit(":"), F.uuid())).otherwise(F.lit("")))
        rows = rows.select(own.alias("record_id"), "target_uri", F.when(F.col("__first").isNotNull(), named("__first")).alias("refers_to"), "payload")
        rows.write.format("warc").mode("append").save(folder)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    with Scratch(spark) as scratch:
        archive(spark.read.parquet(f"{sf_dir}/pages.parquet"), f"{scratch.root}/warc")
        found = spark.read.format("warc").option("verify", "true").option("payload", "false").load(f"{scratch.root}/warc")
        number = lambda c: F.regexp_extract(c, r"^urn:page:(-?\d+)", 1).try_cast("bigint")
        return checkpointed(found.select(number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to").alias("refers_to")))


SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages), d AS (SELECT page_id, h, sha1(h) AS hex FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY hex) AS first FROM d)
SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((CAST('0x' || substr(hex, CAST(5 * (i // 4) + 1 AS BIGINT), 5) AS BIGINT) >> (15 - 5 * (i % 4))) & 31 AS BIGINT) + 1, 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM f
"""
