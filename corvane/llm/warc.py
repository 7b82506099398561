"""WARC archives as a chunked record table.

A payload crosses Spark as rows (record identifier, chunk number, bytes) of at most ``CHUNK`` bytes, both on
the way into an archive and out of it, so neither writer nor reader ever holds a whole record; each row
carries how many bytes came so far and their digest. Archives are a Python data source: one gzip member for
each record, written task by task to the folder and listed in a manifest at commit, so files of lost
or repeated tasks are never read. The manifest also has places inside the files where readers may begin.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from .common import hot_join, written

#: Bytes of a chunk, and of archive between two places where a reader may begin.
CHUNK, SPLIT = 1 << 16, 32 << 20
MANIFEST = "_manifest.json"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

#: Rows of a record come together and in the order of their chunks.
WRITE_SCHEMA = "record_id string, record_type string, target string, refers_to string, digest string, length long, chunk int, data binary"
#: ``bytes`` and ``digest`` are those of the payload up to this chunk; ``declared`` and ``length`` come from the
#: headers and describe the full payload, also of a revisit, which has none of its own.
READ_SCHEMA = "record_id string, record_type string, target string, refers_to string, declared string, length long, chunk int, data binary, bytes long, digest string, last boolean"


def base32(hasher) -> str:
    return base64.b32encode(hasher.digest()).decode()


def _filesystem(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _line(value: str) -> str:
    """A header's value: line breaks and other controls are percent-encoded."""
    return "".join(f"%{ord(c):02X}" if ord(c) < 32 or ord(c) == 127 else c for c in value)


@dataclass
class Part(WriterCommitMessage):
    name: str
    starts: list
    size: int


@dataclass
class Piece(InputPartition):
    name: str
    start: int
    stop: int


class Writer(DataSourceArrowWriter):
    def __init__(self, path: str) -> None:
        self.path = path

    def write(self, iterator):
        filesystem, folder = _filesystem(self.path)
        filesystem.create_dir(folder, recursive=True)
        name = f"part-{uuid.uuid4().hex}.warc.gz"
        starts, size, packer = [], 0, None
        with filesystem.open_output_stream(f"{folder}/{name}", compression=None) as out:

            def put(data: bytes) -> int:
                out.write(data)
                return len(data)

            for batch in iterator:
                names = ("record_id", "record_type", "target", "refers_to", "digest", "length", "chunk", "data")
                for record_id, kind, target, refers_to, digest, length, chunk, data in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
                    if chunk == 0:
                        if packer:
                            size += put(packer.compress(b"\r\n\r\n") + packer.flush())
                        if not starts or size - starts[-1] >= SPLIT:
                            starts.append(size)
                        packer = zlib.compressobj(1, zlib.DEFLATED, 31)
                        size += put(packer.compress(header(record_id, kind, target, refers_to, digest, length)))
                    if kind != "revisit" and data:
                        size += put(packer.compress(data))
            if packer:
                size += put(packer.compress(b"\r\n\r\n") + packer.flush())
        return Part(name, starts, size)

    def commit(self, messages) -> None:
        filesystem, folder = _filesystem(self.path)
        filesystem.create_dir(folder, recursive=True)
        parts = [[m.name, m.starts, m.size] for m in messages if m is not None]
        with filesystem.open_output_stream(f"{folder}/{MANIFEST}", compression=None) as out:
            out.write(json.dumps(parts).encode())

    def abort(self, messages) -> None:
        filesystem, folder = _filesystem(self.path)
        for m in messages:
            if m is not None:
                filesystem.delete_file(f"{folder}/{m.name}")


def header(record_id: str, kind: str, target: str | None, refers_to: str | None, digest: str, length: int) -> bytes:
    """WARC and HTTP headers of a record whose full payload has *length* bytes."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{_line(record_id)}>", "WARC-Date: 1970-01-01T00:00:00Z"]
    if target is not None:
        lines.append(f"WARC-Target-URI: {_line(target)}")
    if kind == "revisit":
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{_line(refers_to)}>"]
    lines += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(http) + (length if kind != 'revisit' else 0)}", "", ""]
    return "\r\n".join(lines).encode() + http


class Reader(DataSourceReader):
    def __init__(self, path: str) -> None:
        self.path = path

    def partitions(self):
        filesystem, folder = _filesystem(self.path)
        with filesystem.open_input_stream(f"{folder}/{MANIFEST}", compression=None) as f:
            parts = json.loads(f.read())
        return [Piece(name, a, b) for name, starts, size in parts if starts for a, b in zip(starts, [*starts[1:], size], strict=True)] or [Piece("", 0, 0)]

    def read(self, partition):
        filesystem, folder = _filesystem(self.path)
        if not partition.name:
            return
        rows, size = [], 0
        with filesystem.open_input_file(f"{folder}/{partition.name}") as f:
            f.seek(partition.start)
            for row in records(f, partition.stop - partition.start):
                rows.append(row)
                size += len(row[7])
                if size >= 4 << 20 or len(rows) >= 4096:
                    yield self._batch(rows)
                    rows, size = [], 0
        if rows:
            yield self._batch(rows)

    @staticmethod
    def _batch(rows):
        import pyarrow as pa

        kinds = dict(zip([x.split()[0] for x in READ_SCHEMA.split(", ")], [x.split()[1] for x in READ_SCHEMA.split(", ")], strict=True))
        types = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "boolean": pa.bool_()}
        columns = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(c, types[k]) for c, k in zip(columns, kinds.values(), strict=True)], list(kinds))


class Stream:
    """Bytes of consecutive gzip members, decompressed as they are asked for."""

    def __init__(self, file, size: int) -> None:
        self.file, self.left, self.raw, self.ready = file, size, b"", bytearray()
        self.unpacker = zlib.decompressobj(31)

    def _more(self) -> bool:
        if self.unpacker.eof:
            self.raw, self.unpacker = self.unpacker.unused_data, zlib.decompressobj(31)
        if not self.raw:
            self.raw = self.file.read(min(CHUNK, self.left))
            self.left -= len(self.raw)
        if not self.raw:
            return False
        self.ready += self.unpacker.decompress(self.raw, 4 * CHUNK)
        self.raw = self.unpacker.unconsumed_tail
        return True

    def until(self, end: bytes) -> bytes | None:
        """Bytes up to *end*, which is taken too; None at the end of the input."""
        at = 0
        while (k := self.ready.find(end, max(0, at - len(end)))) < 0:
            at = len(self.ready)
            if not self._more():
                return None
        found = bytes(self.ready[:k])
        del self.ready[: k + len(end)]
        return found

    def some(self, n: int) -> bytes:
        """Up to *n* bytes; fewer only at the end of the input."""
        while len(self.ready) < n and self._more():
            pass
        found = bytes(self.ready[:n])
        del self.ready[:n]
        return found


def records(file, size: int):
    """Rows of READ_SCHEMA from *size* bytes of an archive that begin at a record."""
    stream = Stream(file, size)
    while (head := stream.until(b"\r\n\r\n")) is not None:
        fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
        http = stream.until(b"\r\n\r\n")
        length = int(next(x.split(b":")[1] for x in http.split(b"\r\n") if x.lower().startswith(b"content-length")))
        left = int(fields["Content-Length"]) - len(http) - 4
        refers_to = fields.get("WARC-Refers-To", "")[1:-1] or None
        known = fields["WARC-Record-ID"][1:-1], fields["WARC-Type"], fields.get("WARC-Target-URI"), refers_to, fields["WARC-Payload-Digest"].removeprefix("sha1:"), length
        hasher, chunk, done = hashlib.sha1(), 0, 0
        while True:
            data = stream.some(min(CHUNK, left))
            if left and not data:
                raise ValueError(f"the archive ends inside record {known[0]}")
            hasher.update(data)
            done += len(data)
            left -= len(data)
            yield *known, chunk, data, done, base32(hasher), not left
            chunk += 1
            if not left:
                break
        if stream.some(4) != b"\r\n\r\n":
            raise ValueError(f"record {known[0]} does not end as it should")


class WarcSource(DataSource):
    """``format("warc")``: load(path) gives READ_SCHEMA, save(path) takes WRITE_SCHEMA."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return READ_SCHEMA

    def reader(self, schema):
        return Reader(self.options["path"])

    def writer(self, schema, overwrite: bool):
        return Writer(self.options["path"])


def planned(pages: DataFrame, id_col: str = "page_id", url: str = "url", html: str = "html", least: int = 0) -> DataFrame:
    """The record table of *pages*, in WRITE_SCHEMA.

    Of pages with equal payloads of at least *least* bytes, that with the largest id is a response and
    the others are revisits of it; smaller payloads are all responses. Null payloads are empty. Rows that
    repeat the largest id are all responses; null ids are smaller than all others, and if there is no
    other id they are responses. An empty table gives no records; a long payload crosses in chunks of CHUNK bytes. Null urls give records without a target; other columns are not read.

    Only (id, target, digest, length) takes part in the search for copies, and the commonest payload is spread over
    tasks. Payloads meet the list of revisits by id and digest, and are cut into chunks where they then are.
    """
    t = pages.select(F.col(id_col).alias("id"), F.col(url).alias("target"), F.encode(F.coalesce(F.col(html), F.lit("")), "utf-8").alias("data"))
    t = t.withColumn("sha", F.unhex(F.sha1("data"))).withColumn("length", F.length("data").cast("long"))
    slim = written(t.select("id", "target", "sha", "length"), "digests")
    copies = slim.where(F.col("length") >= least).groupBy("sha").agg(F.max("id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1 and first is not null")
    copies = written(copies, "copies")
    again = hot_join(slim, copies, ["sha"], "n", F.unhex(F.hex(F.xxhash64("id", "target")))).where("first is not null and not (id <=> first)")
    again = written(again.select("id", "target", "sha", "length", "first"), "revisits")
    listed = again.select(F.col("id").alias("r_id"), F.col("sha").alias("r_sha")).distinct()
    own = t.join(listed, F.expr("id <=> r_id and sha = r_sha"), "left_anti")
    own = own.select("id", "target", "sha", "length", "data", F.explode(F.expr(f"sequence(0, cast(greatest(length - 1, 0) div {CHUNK} as int))")).alias("chunk"))
    name = "concat('urn:corvane:page:', coalesce(cast({} as string), 'null'))"
    record = lambda kind, first, chunk, data: (
        F.expr(name.format("id")).alias("record_id"), F.lit(kind).alias("record_type"), "target", F.expr(first).alias("refers_to"),
        _base32("sha").alias("digest"), "length", F.expr(chunk).alias("chunk"), F.expr(data).alias("data"))
    own = own.select(*record("response", "cast(null as string)", "chunk", f"substring(data, chunk * {CHUNK} + 1, {CHUNK})"))
    return own.union(again.select(*record("revisit", name.format("first"), "0", "cast('' as binary)")))


def _base32(sha: str):
    """RFC 4648 base32 of a 20-byte column: five bits a letter."""
    h = f"hex({sha})"
    letters = []
    for group in range(4):  # five bytes are eight letters
        value = f"cast(conv(substring({h}, {10 * group + 1}, 10), 16, 10) as bigint)"
        letters += [f"substring('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', cast((shiftright({value}, {35 - 5 * k}) & 31) + 1 as int), 1)" for k in range(8)]
    return F.expr(f"concat({', '.join(letters)})")


def write(records_table: DataFrame, path: str) -> None:
    """Writes a record table (WRITE_SCHEMA) as archives under *path*."""
    records_table.sparkSession.dataSource.register(WarcSource)
    records_table.write.format("warc").mode("append").save(path)


def read(spark, path: str) -> DataFrame:
    """The record table (READ_SCHEMA) of the archives under *path*."""
    spark.dataSource.register(WarcSource)
    return spark.read.format("warc").load(path)


def summaries(chunks: DataFrame) -> DataFrame:
    """One row per record, from its last chunk: the digest of a response is the one that was counted while
    reading, that of a revisit the declared one. ``intact``: whether a response has its declared payload.
    """
    t = chunks.where("last")
    own = "record_type <> 'revisit'"
    return t.select(
        "record_id", "record_type", "target", "refers_to", F.expr(f"if({own}, bytes, length)").alias("payload_bytes"),
        F.expr(f"if({own}, digest, declared)").alias("payload_digest"), F.expr(f"not ({own}) or (digest = declared and bytes = length)").alias("intact"))


SQL = r"""
with t as (select page_id, encode(coalesce(html, '')) p from pages),
s as (select page_id, octet_length(p)::bigint payload_bytes, sha1(p) h from t),
m as (select *, max(page_id) over (partition by h) first from s),
bits as (
  select *, array_to_string(list_transform(range(0, 32), lambda k:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
      ((('0x' || substr(h, 1 + 10 * (k // 8), 10))::bigint >> (35 - 5 * (k % 8))) & 31)::bigint + 1, 1)), '') digest from m)
select page_id, payload_bytes, digest as payload_digest, case when page_id = first then 'response' else 'revisit' end as record_type,
       case when page_id <> first then first end as refers_to
from bits
"""
