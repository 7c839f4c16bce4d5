"""WARC archives as a Spark data source, written and read by tasks in parallel.

Every record is a gzip member of its own; its header carries the member's compressed and plain
length in the `sl` extra field, so a reader can step over a member without inflating or even reading it. A reader goes through a file
piece by piece; it inflates a record's header lines first, tests the pushed predicates on them, and inflates the payload
only of records that pass, and only if payloads are asked for. Files without `sl` fields are read, too, but inflated throughout.

Files are packed into partitions by size. A task writes under names of its own attempt; the commit writes one list of the attempts that
count, and readers pass over files of other attempts. So nothing is renamed, and what lost executors left behind is never read.

Options: path (a folder, in any store that pyarrow reads; `s3a` and `s3n` count as `s3`), payload ("false": payload column null and never inflated),
roll_bytes (a file is closed once it is larger, so that many tasks can read), pack_bytes (files up to this sum are one partition).
"""

from __future__ import annotations

import base64
import re
import struct
import uuid
import zlib
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, IsNotNull, StringStartsWith, WriterCommitMessage

ROLL_BYTES, BATCH_BYTES = 64 << 20, 4 << 20
#: A partition's files: at most MOST_BYTES together, and as little as LEAST_BYTES if that gives up to PARTS partitions.
LEAST_BYTES, MOST_BYTES, PARTS = 2 << 20, 128 << 20, 200
OWN_FILE = re.compile(r"part-([0-9a-f]{32})-\d+\.warc\.gz$")
COMMITTED = "_committed-"
READ = "record_id string, record_type string, target_uri string, payload_digest string, refers_to string, payload_length long, headers map<string,string>, payload binary"
#: Columns that are header lines; predicates on them are tested before any payload.
LINES = {
    "record_id": "WARC-Record-ID",
    "record_type": "WARC-Type",
    "target_uri": "WARC-Target-URI",
    "payload_digest": "WARC-Payload-Digest",
    "refers_to": "WARC-Refers-To",
    "payload_length": "X-Payload-Length",
}
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def member(data: bytes, level: int = 1) -> bytes:
    """One gzip member with the `sl` field: compressed length and plain length."""
    packer = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = packer.compress(data) + packer.flush()
    size = 10 + 2 + 12 + len(body) + 8
    head = b"\x1f\x8b\x08\x04\x00\x00\x00\x00\x00\xff" + struct.pack("<H", 12) + b"sl" + struct.pack("<HII", 8, size, len(data) & 0xFFFFFFFF)
    return head + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


def record(record_id: str, kind: str, uri: str | None, digest: str, refers_to: str | None, payload: bytes | None, full: int) -> bytes:
    """A response or revisit record with an HTTP block; the payload of a revisit stays away."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {full}\r\n\r\n".encode()
    block = http + (payload or b"")
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{record_id}>", "WARC-Date: 2000-01-01T00:00:00Z"]
    if uri:
        lines.append(f"WARC-Target-URI: {' '.join(uri.split())}")
    lines += [f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}", f"X-Payload-Length: {full}"]
    if kind == "revisit":
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{refers_to}>"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


def inflated(data: memoryview, at: int) -> tuple[zlib._Decompress, int, int]:
    """An inflater at the body of the member that begins at `at`, the body's place, and the member's length, 0 if unknown."""
    if bytes(data[at : at + 3]) != b"\x1f\x8b\x08":
        raise ValueError(f"no gzip member at byte {at}")
    flags, place, size = data[at + 3], at + 10, 0
    if flags & 4:
        n = struct.unpack_from("<H", data, place)[0]
        end, place = place + 2 + n, place + 2
        while place + 4 <= end:
            name, length = bytes(data[place : place + 2]), struct.unpack_from("<H", data, place + 2)[0]
            if name == b"sl" and length >= 8:
                size = struct.unpack_from("<I", data, place + 4)[0]
            place += 4 + length
        place = end
    for flag in (8, 16):  # name and comment end with a zero byte
        if flags & flag:
            while data[place]:
                place += 1
            place += 1
    return zlib.decompressobj(-15), place + 2 * bool(flags & 2), size


class Window:
    """A file of which one piece is held at a time."""

    def __init__(self, file):
        self.file, self.size, self.base, self.data = file, file.size(), 0, b""

    def take(self, at: int, n: int) -> memoryview:
        """Up to n bytes from `at` on."""
        n = min(n, self.size - at)
        if not self.base <= at or at + n > self.base + len(self.data):
            self.file.seek(at)
            self.base, self.data = at, self.file.read(max(n, 1 << 20))
        return memoryview(self.data)[at - self.base : at - self.base + n]


def records(file, wanted, payload: bool):
    """(header lines, payload or None) of the records of an open file that `wanted(lines)` accepts."""
    window, at = Window(file), 0
    while at < window.size:
        z, place, size = inflated(window.take(at, 1 << 16), 0)
        end, place, rest, text = at + size - 8 if size else window.size, at + place, b"", b""
        while b"\r\n\r\n" not in text and not z.eof:
            if not rest:
                rest = window.take(place, min(end - place, 1 << 12))
                place += len(rest)
                if not rest:
                    break
            text += z.decompress(rest, 1024)
            rest = z.unconsumed_tail
        head, _, first = text.partition(b"\r\n\r\n")
        lines = dict(x.split(": ", 1) for x in head.decode("utf-8", "replace").split("\r\n")[1:] if ": " in x)
        take = wanted(lines)
        block = [first]
        while ((take and payload) or not size) and not z.eof:  # without a length only inflating finds the end
            if not rest:
                rest = window.take(place, min(end - place, 1 << 18))
                place += len(rest)
                if not rest:
                    break
            more, rest = z.decompress(rest), b""
            if take and payload:
                block.append(more)
        at = at + size if size else place - len(z.unused_data) + 8
        if take:
            body = b"".join(block)[: int(lines.get("Content-Length", 0))].partition(b"\r\n\r\n")[2] if payload else None
            yield lines, body


@dataclass
class Archive(InputPartition):
    paths: list[str]


@dataclass
class Written(WriterCommitMessage):
    attempt: str


def opened(path: str) -> tuple[fs.FileSystem, str]:
    path = re.sub(r"^s3[an]://", "s3://", path)
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


class WarcReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.payload = options["path"], options.get("payload", "true") != "false"
        self.pack = int(options.get("pack_bytes", 0))
        self.tests: list[Filter] = []

    def pushFilters(self, filters: list[Filter]):
        for f in filters:
            if isinstance(f, EqualTo | In | StringStartsWith | IsNotNull) and len(f.attribute) == 1 and f.attribute[0] in LINES and f.attribute[0] != "payload_length":
                self.tests.append(f)
            else:
                yield f

    def partitions(self):
        store, path = opened(self.path)
        found = [x for x in store.get_file_info(fs.FileSelector(path, recursive=True, allow_not_found=True)) if x.is_file]
        good = set()
        for x in found:
            if x.base_name.startswith(COMMITTED):
                with store.open_input_stream(x.path, compression=None) as f:
                    good |= set(f.read().decode().split())
        own = lambda x: OWN_FILE.search(x.base_name)
        files = sorted(((x.path, x.size) for x in found if x.path.endswith(".warc.gz") and (not own(x) or own(x)[1] in good)), key=lambda x: x[0])
        most = self.pack or min(MOST_BYTES, max(LEAST_BYTES, sum(size for _, size in files) // PARTS))
        packs, room = [], 0
        for name, size in files:
            if not packs or size > room:
                packs.append([])
                room = most
            packs[-1].append(name)
            room -= size
        return [Archive(x) for x in packs] or [Archive([])]

    def wanted(self, lines: dict[str, str]) -> bool:
        for f in self.tests:
            x = value(lines, f.attribute[0])
            if isinstance(f, IsNotNull):
                ok = x is not None
            elif isinstance(f, EqualTo):
                ok = x is not None and x == f.value
            elif isinstance(f, In):
                ok = x is not None and x in f.value
            else:
                ok = x is not None and x.startswith(f.value)
            if not ok:
                return False
        return True

    def read(self, partition: Archive):
        store, _ = opened(self.path)
        rows, size = [], 0
        for path in partition.paths:
            with store.open_input_file(path) as f:
                for lines, body in records(f, self.wanted, self.payload):
                    rows.append((lines, body))
                    size += len(body or b"") + 500
                    if size > BATCH_BYTES:
                        yield batch(rows)
                        rows, size = [], 0
        if rows:
            yield batch(rows)


def value(lines: dict[str, str], column: str) -> str | None:
    """A header line as the column shows it: digests in hex, record ids without brackets."""
    x = lines.get(LINES[column])
    if x is None:
        return None
    if column == "payload_digest":
        return base64.b32decode(x.removeprefix("sha1:")).hex()
    return x.strip("<>") if column in ("record_id", "refers_to") else x


def batch(rows: list) -> pa.RecordBatch:
    text = [pa.array([value(lines, c) for lines, _ in rows], pa.string()) for c in LINES if c != "payload_length"]
    length = pa.array([int(lines[LINES["payload_length"]]) if LINES["payload_length"] in lines else None for lines, _ in rows], pa.int64())
    headers = pa.array([list(lines.items()) for lines, _ in rows], pa.map_(pa.string(), pa.string()))
    return pa.RecordBatch.from_arrays([*text, length, headers, pa.array([b for _, b in rows], pa.binary())], names=[*LINES, "headers", "payload"])


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str]):
        self.path, self.roll = options["path"], int(options.get("roll_bytes", ROLL_BYTES))

    def write(self, iterator):
        store, path = opened(self.path)
        store.create_dir(path, recursive=True)
        attempt, out, n = uuid.uuid4().hex, None, 0
        for b in iterator:
            for r in b.to_pylist():
                if out is None:
                    out = store.open_output_stream(f"{path}/part-{attempt}-{n:05}.warc.gz", compression=None)
                    n += 1
                out.write(member(record(r["record_id"], r["record_type"], r["target_uri"], r["payload_digest"], r["refers_to"], r["payload"], r["payload_length"])))
                if out.tell() > self.roll:
                    out.close()
                    out = None
        if out is not None:
            out.close()
        return Written(attempt)

    def commit(self, messages):
        store, path = opened(self.path)
        store.create_dir(path, recursive=True)
        with store.open_output_stream(f"{path}/{COMMITTED}{uuid.uuid4().hex}", compression=None) as f:
            f.write("\n".join(m.attempt for m in messages if m).encode())

    def abort(self, messages):
        """Files of attempts that are not listed are never read; they stay until the folder goes."""


class WarcSource(DataSource):
    """format("warc"): see the module."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return READ

    def reader(self, schema) -> DataSourceReader:
        return WarcReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return WarcWriter(dict(self.options))


def register(spark: SparkSession) -> None:
    """Make format("warc") known, with pushed predicates."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


def archive_rows(pages: DataFrame, least_bytes: int = 1000) -> DataFrame:
    """WARC records for (page_id, url, html): of equal payloads of `least_bytes` or more the largest page_id is the response, others are revisits of it.

    A null html is an empty payload. Rows that share the largest page_id are all responses; a null page_id
    counts as the smallest, and a payload with null ids only has no revisits. A page of any length is one record, written and
    read by one task. Other columns are not looked at. An empty table gives no records.
    """
    payload = F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload")).withColumns(
        {"full": F.length("payload").cast("long"), "key": F.sha2("payload", 256)}
    )
    groups = rows.where(F.col("full") >= least_bytes).groupBy("key").agg(F.max("page_id").alias("first_id"), F.count("*").alias("n")).where("n > 1 and first_id is not null").select(F.col("key").alias("group"), "first_id")
    joined = rows.join(groups, rows["key"] == groups["group"], "left")
    again = F.coalesce(~F.col("page_id").eqNullSafe(F.col("first_id")) & F.col("first_id").isNotNull(), F.lit(False))
    urn = lambda c: F.concat(F.lit("urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("")))
    return joined.select(
        urn("page_id").alias("record_id"),
        F.when(again, "revisit").otherwise("response").alias("record_type"),
        F.col("url").alias("target_uri"),
        F.sha1("payload").alias("payload_digest"),
        F.when(again, urn("first_id")).alias("refers_to"),
        F.when(~again, F.col("payload")).alias("payload"),
        F.col("full").alias("payload_length"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    """op6: all `pages` as WARC archives, written to the shared folder and read back."""
    from docweave.functions.session import fresh_path, table

    register(spark)
    path = fresh_path(spark, "warc")
    archive_rows(table(spark, sf_dir, "pages")).write.format("warc").mode("append").save(path)
    number = lambda c: F.expr(f"try_cast(substring({c}, 10) as long)")
    one = lambda read, kind, size, digest: read.load(path).where(F.col("record_type") == kind).select(
        number("record_id").alias("page_id"), size.alias("payload_bytes"), digest.alias("payload_digest"), "record_type", number("refers_to").alias("refers_to")
    )
    # of a response both come from the payload itself, of a revisit from its header lines, and no payload is decoded
    responses = one(spark.read.format("warc"), "response", F.length("payload").cast("long"), F.sha1("payload"))
    revisits = one(spark.read.format("warc").option("payload", "false"), "revisit", F.col("payload_length"), F.col("payload_digest"))
    return responses.unionByName(revisits)


ORACLE = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
g AS (SELECT b, max(page_id) AS first_id FROM p WHERE octet_length(b) >= 1000 GROUP BY b HAVING count(*) > 1)
SELECT page_id, octet_length(p.b)::BIGINT AS payload_bytes, sha1(p.b) AS payload_digest,
       CASE WHEN first_id <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first_id <> page_id THEN first_id END AS refers_to
FROM p LEFT JOIN g ON p.b = g.b
"""
