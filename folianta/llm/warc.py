"""WARC archives as a PySpark Python data source, and pages written to and read from them.

Reading: the driver plans partitions from files and, for large files, from restart points that
the writer left in its manifest. Predicates on record type and headers are pushed into the
reader. It parses a record's header first, and reads and inflates the rest of a record only if
the header passes and the payload is asked for; else it jumps to the next record by the length
in the gzip member's ``sl`` field (WARC 1.1, annex D) or by Content-Length. Members without that
field are inflated in pieces, of which none is kept for a record that isn't wanted.

Writing: each task writes files of its own and the driver commits a manifest that lists them,
so files of lost or repeated task attempts are never read.
"""

from __future__ import annotations

import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as ds
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from folianta.llm.common import fresh_path, small_batches

SCHEMA = "record_id string, record_type string, target_uri string, refers_to string, payload_digest string, payload_length long, content_length long, payload binary"
#: Columns written: the headers of a record and its payload (null for a revisit).
WRITTEN = "record_id string, record_type string, target_uri string, refers_to string, payload_digest string, payload_length long, payload binary"
#: A new file begins after so many bytes; a restart point is noted after so many.
FILE_BYTES, RESTART_BYTES = 256 << 20, 16 << 20
#: Equal payloads from this size on are stored once.
REVISIT_BYTES = 100
#: Date of records whose capture time isn't known.
DATE = "1970-01-01T00:00:00Z"

# Fixed values of the format.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_HEADER_OF = {"record_id": b"warc-record-id", "record_type": b"warc-type", "target_uri": b"warc-target-uri", "refers_to": b"warc-refers-to", "payload_digest": b"warc-payload-digest"}
_BATCH_BYTES = 4 << 20
#: Bytes of a read, and of the first piece of a member that is inflated.
_WINDOW, _FIRST = 1 << 20, 16 << 10


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """The store of a path or URI, and the path in it."""
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), re.sub(r"^file:/*", "/", uri)
    if "://" not in uri:
        return pafs.LocalFileSystem(), uri
    return pafs.FileSystem.from_uri(uri)


def gzip_member(data: bytes) -> bytes:
    """``data`` as a gzip member with its compressed and plain length in an ``sl`` extra field, if 32 bits hold them."""
    deflate = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = deflate.compress(data) + deflate.flush()
    tail = struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)
    size = 12 + 12 + len(body) + len(tail)
    if max(size, len(data)) >> 32:
        return b"\x1f\x8b\x08" + bytes(6) + b"\xff" + body + tail
    return b"\x1f\x8b\x08\x04" + bytes(5) + b"\xff" + struct.pack("<H", 12) + b"sl" + struct.pack("<HII", 8, size, len(data)) + body + tail


def record(fields: dict, payload: bytes | None) -> bytes:
    """One WARC record. A revisit's block is the HTTP head alone, which still tells the payload's length."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % (fields["payload_length"] or 0)
    block = http + (payload or b"") if fields["record_type"] != "revisit" else http
    head = [("WARC-Type", fields["record_type"]), ("WARC-Record-ID", f"<{fields['record_id']}>"), ("WARC-Date", DATE)]
    if fields["target_uri"] is not None:
        head.append(("WARC-Target-URI", re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", fields["target_uri"])))
    if fields["payload_digest"] is not None:
        head.append(("WARC-Payload-Digest", f"sha256:{fields['payload_digest']}"))
    if fields["record_type"] == "revisit":
        head += [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<{fields['refers_to']}>")]
    head += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


def parse_head(head: bytes) -> dict[bytes, bytes]:
    """Header fields by lower-case name; folded lines are joined."""
    out: dict[bytes, bytes] = {}
    name = b""
    for line in head.split(b"\r\n")[1:]:
        if line[:1] in (b" ", b"\t") and name:
            out[name] += b" " + line.strip()
        elif b":" in line:
            name, value = line.split(b":", 1)
            name = name.strip().lower()
            out[name] = value.strip()
    return out


def _text(head: dict[bytes, bytes], column: str) -> str | None:
    raw = head.get(_HEADER_OF[column])
    if raw is None:
        return None
    value = raw.decode("utf-8", "replace")
    if column in ("record_id", "refers_to"):
        return value.removeprefix("<").removesuffix(">")
    return value.split(":", 1)[-1] if column == "payload_digest" else value


class Window:
    """A file read through a window, so that neighbouring records share a read and jumps don't read what they skip."""

    def __init__(self, file) -> None:
        self.file, self.at, self.held, self.last = file, 0, b"", False

    def get(self, at: int, n: int) -> bytes:
        """Up to n bytes from ``at``, fewer at the file's end only."""
        start = at - self.at
        if start < 0 or start > len(self.held) or (start + n > len(self.held) and not self.last):
            asked = max(n, _WINDOW)
            self.held, self.at, start = self.file.read_at(asked, at), at, 0
            self.last = len(self.held) < asked
        return self.held[start : start + n]


class Plain:
    """The bytes of a record that isn't compressed."""

    def __init__(self, window: Window, at: int) -> None:
        self.window, self.at = window, at

    def read(self, n: int) -> bytes:
        """Up to n bytes, none at the end."""
        out = self.window.get(self.at, n)
        self.at += len(out)
        return out


class Member:
    """A gzip member that is inflated as far as it is read."""

    def __init__(self, window: Window, at: int) -> None:
        self.window, self.start, self.at, self.chunk = window, at, at, _FIRST
        self.inflate, self.packed = zlib.decompressobj(31), b""

    def read(self, n: int) -> bytes:
        """Up to n bytes, none at the end."""
        while not self.inflate.eof:
            if not self.packed:
                self.packed = self.window.get(self.at, self.chunk)
                if not self.packed:
                    raise ValueError(f"gzip member at {self.start} is cut off")
                self.at += len(self.packed)
                self.chunk = _WINDOW
            out = self.inflate.decompress(self.packed, n)
            self.packed = self.inflate.unconsumed_tail
            if out:
                return out
        return b""

    def end(self) -> int:
        """Where the member ends in the file; what is left of it is inflated piece by piece and dropped."""
        while self.read(_WINDOW):
            pass
        return self.at - len(self.inflate.unused_data)


def records(file, start: int, end: int, wanted, with_payload: bool) -> Iterator[tuple[dict[bytes, bytes], bytes | None, int]]:
    """(header, payload or None, payload length) of the records that begin in [start, end) and whose header ``wanted`` accepts.

    A record that is rejected, or whose payload isn't asked for, is neither read nor inflated beyond
    its head if its length is known; a member without ``sl`` is inflated to its end in pieces. A
    record that the file's end cuts off raises ValueError.
    """
    window, pos = Window(file), start
    while pos < end:
        first = window.get(pos, 24)
        if not first:
            return
        if first[:2] in (b"\r\n", b"\n\n"):
            pos += 2
            continue
        packed = first[:2] == b"\x1f\x8b"
        known = packed and len(first) == 24 and bool(first[3] & 4) and first[12:14] == b"sl"
        source = Member(window, pos) if packed else Plain(window, pos)
        data = source.read(4096)
        while (cut := data.find(b"\r\n\r\n")) < 0:
            more = source.read(len(data) or 4096)
            if not more:
                raise ValueError(f"record at {pos} has no end of header")
            data += more
        if not data.startswith(b"WARC/"):
            raise ValueError(f"no WARC record at {pos}")
        head = parse_head(data[:cut])
        length = int(head.get(b"content-length", b"0"))
        total = cut + 4 + length
        if wanted(head):
            # the HTTP head, at most the first part of the block, tells the payload's length
            need = total if with_payload else min(total, cut + 4 + 4096)
            held, have = [data], len(data)
            while have < need:
                more = source.read(need - have)
                if not more:
                    raise ValueError(f"record at {pos} is cut off")
                held.append(more)
                have += len(more)
            block = b"".join(held)[cut + 4 : total]
            is_http = head.get(b"content-type", b"").startswith(b"application/http")
            http_end = block.find(b"\r\n\r\n") if is_http else -4
            told = re.search(rb"(?i)\r\ncontent-length:\s*(\d+)", block[: max(0, http_end)]) if is_http else None
            stored = max(0, length - http_end - 4)
            yield head, block[http_end + 4 :] if with_payload else None, int(told[1]) if told else stored
        pos = pos + struct.unpack("<I", first[16:20])[0] if known else source.end() if packed else pos + total + 4


@dataclass
class FilePart(ds.InputPartition):
    """Stretches of files, each beginning and ending at a record."""

    parts: list[tuple[str, int, int]]


_TESTS = {
    ds.EqualTo: lambda f: lambda v: v is not None and v == f.value,
    ds.EqualNullSafe: lambda f: lambda v: v == f.value,
    ds.In: lambda f: lambda v, held=frozenset(f.value): v is not None and v in held,
    ds.IsNull: lambda f: lambda v: v is None,
    ds.IsNotNull: lambda f: lambda v: v is not None,
    ds.StringStartsWith: lambda f: lambda v: v is not None and v.startswith(f.value),
    ds.StringEndsWith: lambda f: lambda v: v is not None and v.endswith(f.value),
    ds.StringContains: lambda f: lambda v: v is not None and f.value in v,
}


class WarcReader(ds.DataSourceReader):
    def __init__(self, path: str, with_payload: bool, part_bytes: int) -> None:
        self.path, self.with_payload, self.part_bytes = path, with_payload, part_bytes
        self.filters: list[ds.Filter] = []

    def pushFilters(self, filters: list[ds.Filter]):  # noqa: N802
        for f in filters:
            inner = f.child if isinstance(f, ds.Not) else f
            column = inner.attribute[0] if len(getattr(inner, "attribute", ())) == 1 else None
            if column in _HEADER_OF and type(inner) in _TESTS:
                self.filters.append(f)
            else:
                yield f

    def _files(self) -> list[tuple[str, int, list[int]]]:
        store, root = filesystem(self.path)
        info = [x for x in store.get_file_info(pafs.FileSelector(root, recursive=True)) if x.is_file] if store.get_file_info(root).type == pafs.FileType.Directory else [store.get_file_info(root)]
        manifests = [x.path for x in info if x.base_name.startswith("_manifest-")]
        if manifests:
            out = []
            for m in manifests:
                with store.open_input_stream(m) as f:
                    out += [(f"{root}/{x['name']}", x["size"], x["restarts"]) for x in json.loads(f.read())]
            return sorted(out)
        return sorted((x.path, x.size, [0]) for x in info if x.path.endswith((".warc", ".warc.gz")))

    def partitions(self) -> list[FilePart]:
        """Stretches packed to about part_bytes each, large files cut at their restart points."""
        out: list[FilePart] = []
        held, size = [], 0
        for name, whole, restarts in self._files():
            for a, b in zip(restarts, [*restarts[1:], whole], strict=True):
                if b > a:
                    held.append((name, a, b))
                    size += b - a
                if size >= self.part_bytes:
                    out.append(FilePart(held))
                    held, size = [], 0
        return [*out, FilePart(held)] if held or not out else out

    def read(self, partition: FilePart) -> Iterator[pa.RecordBatch]:
        store, _ = filesystem(self.path)
        tests = []
        for f in self.filters:
            inner = f.child if isinstance(f, ds.Not) else f
            # SQL's NOT of an unknown is unknown: a missing header fails a negated test as well
            plain = _TESTS[type(inner)](inner)
            nulls_count = type(inner) in (ds.IsNull, ds.IsNotNull, ds.EqualNullSafe)
            tests.append((inner.attribute[0], plain if inner is f else (lambda v, t=plain, n=nulls_count: (n or v is not None) and not t(v))))
        wanted = lambda head: all(t(_text(head, c)) for c, t in tests)
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        types = [pa.int64() if n.endswith("_length") else pa.binary() if n == "payload" else pa.string() for n in names]
        rows, size = [], 0

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

        for path, start, end in partition.parts:
            with store.open_input_file(path) as file:
                for head, payload, payload_length in records(file, start, end, wanted, self.with_payload):
                    rows.append((*(_text(head, c) for c in names[:5]), payload_length, int(head.get(b"content-length", b"0")), payload))
                    size += 200 + len(payload or b"")
                    if size >= _BATCH_BYTES:
                        yield batch()
                        rows, size = [], 0
        if rows:
            yield batch()


@dataclass
class Wrote(ds.WriterCommitMessage):
    files: list[dict]


class WarcWriter(ds.DataSourceArrowWriter):
    def __init__(self, path: str) -> None:
        self.path, self.job = path, uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Wrote:
        store, root = filesystem(self.path)
        store.create_dir(root, recursive=True)
        files: list[dict] = []
        out = None
        for batch in iterator:
            for row in batch.to_pylist():
                if out is None:
                    files.append({"name": f"{uuid.uuid4().hex}.warc.gz", "size": 0, "restarts": [0]})
                    out = store.open_output_stream(f"{root}/{files[-1]['name']}", compression=None)
                now = files[-1]
                if now["size"] - now["restarts"][-1] >= RESTART_BYTES:
                    now["restarts"].append(now["size"])
                member = gzip_member(record(row, row["payload"]))
                out.write(member)
                now["size"] += len(member)
                if now["size"] >= FILE_BYTES:
                    out.close()
                    out = None
        if out is not None:
            out.close()
        return Wrote(files)

    def commit(self, messages: list[Wrote | None]) -> None:
        store, root = filesystem(self.path)
        store.create_dir(root, recursive=True)
        with store.open_output_stream(f"{root}/_manifest-{self.job}.json") as f:
            f.write(json.dumps([x for m in messages if m for x in m.files]).encode())

    def abort(self, messages: list[Wrote | None]) -> None:
        store, root = filesystem(self.path)
        for m in messages:
            for x in m.files if m else ():
                store.delete_file(f"{root}/{x['name']}")


class WarcDataSource(ds.DataSource):
    """``spark.read.format("warc").load(path)``.

    Options: payload ("false": the column is null and no block is inflated beyond its HTTP
    head), part_bytes (size of a partition).
    """

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> WarcReader:
        return WarcReader(self.options["path"], self.options.get("payload", "true") == "true", int(self.options.get("part_bytes", 32 << 20)))

    def writer(self, schema: StructType, overwrite: bool) -> WarcWriter:
        if overwrite:
            raise ValueError("archives are only added to; write to a new path")
        return WarcWriter(self.options["path"])


def register(spark: SparkSession) -> None:
    """Make the format known to the session and let Spark push filters into it."""
    spark.dataSource.register(WarcDataSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


_ID = "urn:folianta:page:"


def write_pages(pages: DataFrame, path: str, revisit_bytes: int = REVISIT_BYTES) -> None:
    """A WARC record for each row of ``pages`` (page_id, url, html).

    Null html is the empty payload, a null url leaves its header out. Of equal payloads of
    ``revisit_bytes`` or more, rows with the smallest page_id are responses and the others
    revisit it; rows with a null page_id are always responses. A record's id is made of the
    payload's digest and the page_id, so only repeats of a row share one. Payloads move once, by
    page_id: equal ones meet as digests only, counted on the map side first.
    """
    spark = pages.sparkSession
    register(spark)
    small_batches(spark)
    body = F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), body.alias("payload"))
    marks = rows.select("page_id", F.sha2("payload", 256).alias("digest"), F.octet_length("payload").alias("n")).filter((F.col("n") >= revisit_bytes) & F.col("page_id").isNotNull())
    owners = marks.groupBy("digest").agg(F.min("page_id").alias("owner"), F.count("*").alias("copies")).filter("copies > 1")
    again = marks.join(owners, "digest").filter("page_id <> owner").select("page_id", "digest", "owner").distinct()
    given = rows.withColumn("d", F.sha2("payload", 256)).join(again.withColumnRenamed("digest", "d"), ["page_id", "d"], "left")
    revisit = F.col("owner").isNotNull()
    out = given.select(
        F.concat(F.lit(_ID), F.col("d"), F.lit(":"), F.coalesce(F.col("page_id").cast("string"), F.lit("null"))).alias("record_id"),
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.col("url").alias("target_uri"),
        F.when(revisit, F.concat(F.lit(_ID), F.col("d"), F.lit(":"), F.col("owner").cast("string"))).alias("refers_to"),
        F.col("d").alias("payload_digest"),
        F.octet_length("payload").cast("long").alias("payload_length"),
        F.when(~revisit, F.col("payload")).alias("payload"),
    )
    out.write.format("warc").mode("append").save(path)


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Each page as the archives tell it: page_id, payload_bytes, payload_digest, record_type, refers_to.

    Length and digest of a response come from its payload; those of a revisit from its headers,
    by a scan that inflates no payload.
    """
    register(spark)
    page = lambda c: F.regexp_extract(c, r":(-?\d+)$", 1).try_cast("long")
    full = spark.read.format("warc").load(path).filter("record_type = 'response'")
    heads = spark.read.format("warc").option("payload", "false").load(path).filter("record_type = 'revisit'")
    a = full.select(page("record_id").alias("page_id"), F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_digest"), "record_type", F.lit(None).cast("long").alias("refers_to"))
    b = heads.select(page("record_id").alias("page_id"), F.col("payload_length").alias("payload_bytes"), "payload_digest", "record_type", page("refers_to").alias("refers_to"))
    return a.union(b)


def archived(pages: DataFrame) -> DataFrame:
    """``pages`` written to archives in the shared folder, and read back."""
    path = fresh_path(pages.sparkSession, "warc")
    write_pages(pages, path)
    return read_pages(pages.sparkSession, path)
