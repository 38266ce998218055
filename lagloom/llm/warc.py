"""WARC archives: a writer in tasks, and a Python data source that reads them back.

A record is stored as two gzip members, its header and its block, and the
header names the stored length of the block.  So a reader parses the header
first and steps over the block of a record it does not want without inflating
it; any WARC reader that follows concatenated members sees ordinary records.
Records from other writers, without that field, are read too.

Of pages with equal payloads the one with the largest ``page_id`` is written as
a response, the others as revisits that refer to it; payloads under
``revisit_from`` bytes are all responses.  NULL html counts as empty, NULL urls
have no target header; rows without ``page_id`` are written with a random
record id, as responses unless an equal payload has an id, and read back with a
NULL id.  Of repeated rows with the largest id each is a response.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, In, InputPartition, IsNotNull

from lagloom.llm.arrow import slices
from lagloom.llm.files import new_file, opened
from lagloom.sources.session import ship
from lagloom.sources.writers import cut_lineage, scratch_path

SCHEMA = (
    "record_type string, record_id string, target_uri string, refers_to string, payload_digest string, "
    "payload_bytes long, content_type string, payload binary"
)
FIELDS = [part.split()[0] for part in SCHEMA.split(", ")]
HEADER_OF = {
    "record_type": "warc-type", "record_id": "warc-record-id", "target_uri": "warc-target-uri",
    "refers_to": "warc-refers-to", "payload_digest": "warc-payload-digest", "content_type": "content-type",
}
STORED, PAYLOAD = "x-stored-block-length", "x-payload-length"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
URN = "<urn:page:%d>"


def gzipped(data: bytes) -> bytes:
    squeeze = zlib.compressobj(1, zlib.DEFLATED, 31)
    return squeeze.compress(data) + squeeze.flush()


def record(kind: str, record_id: str, url: str | None, digest: str, payload: bytes, refers_to: str | None) -> bytes:
    http = HTTP + b"Content-Length: %d\r\n\r\n" % len(payload)
    block = http if kind == "revisit" else http + payload
    stored = gzipped(block + b"\r\n\r\n")
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id}", "WARC-Date: 1970-01-01T00:00:00Z"]
    if url is not None:
        lines.append("WARC-Target-URI: " + re.sub(r"[\x00-\x1f]", lambda m: f"%{ord(m[0]):02X}", url))
    if refers_to is not None:
        lines += [f"WARC-Refers-To: {refers_to}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    lines += [
        "Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha1:{digest}",
        f"Content-Length: {len(block)}", f"X-Payload-Length: {len(payload)}", f"X-Stored-Block-Length: {len(stored)}",
    ]
    return gzipped("\r\n".join([*lines, "", ""]).encode()) + stored


def write_pages(pages: DataFrame, folder: str, revisit_from: int = 0) -> DataFrame:
    """One archive per task; returns the manifest (path, records) of finished tasks."""
    ship(pages.sparkSession)
    body = F.coalesce("html", F.lit(""))
    rows = pages.select(F.col("page_id").cast("long"), "url", body.alias("html"), F.sha1(body.cast("binary")).alias("digest"))
    rows = rows.withColumn("size", F.octet_length("html"))
    equal = rows.filter(F.col("size") >= revisit_from).groupBy("digest", "size")
    equal = equal.agg(F.max("page_id").alias("last"), F.count("*").alias("n")).filter("n > 1").drop("n")
    rows = rows.join(equal, ["digest", "size"], "left")
    again = F.col("last").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("last"))
    rows = rows.select("page_id", "url", "html", "digest", F.when(again, F.col("last")).alias("refers_to"))

    def write(batches):
        path, out, n = None, None, 0
        for batch in slices(batches, "html"):
            if out is None:
                path = new_file(folder, f"part-{TaskContext.get().partitionId():06d}", ".warc.gz")
                store, place = opened(path)
                out = store.open_output_stream(place, compression=None)
            for row in batch.to_pylist():
                own = f"<urn:uuid:{uuid.uuid4()}>" if row["page_id"] is None else URN % row["page_id"]
                to = row["refers_to"]
                digest = base64.b32encode(bytes.fromhex(row["digest"])).decode()
                kind = "response" if to is None else "revisit"
                out.write(record(kind, own, row["url"], digest, row["html"].encode(), None if to is None else URN % to))
                n += 1
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"path": [path], "records": [n]})

    return cut_lineage(rows.mapInArrow(write, "path string, records long"), "archives")


class Inflated:
    """Bytes of an archive from one place on, inflated member by member where it is compressed."""

    def __init__(self, file, at: int, chunk: int = 1 << 16):
        self.file, self.at, self.chunk = file, at, chunk
        self.end = file.size()
        self.raw, self.pending = b"", b""
        self.member = None
        self.packed = file.read_at(min(2, self.end - at), at) == b"\x1f\x8b" if at < self.end else False

    def more(self) -> bool:
        """Put one chunk more into ``pending``; False at the end of the file."""
        if not self.packed:
            part = self.file.read_at(min(self.chunk, self.end - self.at), self.at)
            self.at += len(part)
            self.pending += part
            return bool(part)
        if self.member is None or self.member.eof:
            if self.member is not None:
                self.raw = self.member.unused_data
            self.member = zlib.decompressobj(47)
        if not self.raw:
            self.raw = self.file.read_at(min(self.chunk, self.end - self.at), self.at)
            self.at += len(self.raw)
            if not self.raw:
                return False
        self.pending += self.member.decompress(self.raw)
        self.raw = b""
        return True

    def place(self) -> int:
        """File offset behind the member that has just ended."""
        return self.at - len(self.member.unused_data)

    def read(self, n: int) -> bytes:
        parts, have = [], 0
        while have < n:
            if not self.pending and not self.more():
                break
            part, self.pending = self.pending[: n - have], self.pending[n - have :]
            parts.append(part)
            have += len(part)
        return b"".join(parts)

    def header(self) -> dict[str, str] | None:
        while b"\r\n\r\n" not in self.pending:
            if not self.more():
                return None
        head, _, self.pending = self.pending.lstrip(b"\r\n").partition(b"\r\n\r\n")
        lines = head.decode("utf-8", "replace").split("\r\n")
        pairs = (line.partition(":") for line in lines[1:])
        return {name.strip().lower(): value.strip() for name, _, value in pairs}


def records(path: str, wanted, payloads: bool):
    """``(headers, payload or None)`` of the records whose headers ``wanted`` accepts."""
    store, place = opened(path)
    with store.open_input_file(place) as file:
        source = Inflated(file, 0)
        while (head := source.header()) is not None:
            take = wanted(head)
            length, stored = int(head.get("content-length", 0)), head.get(STORED)
            if stored is not None and source.packed and not (take and payloads):
                while not source.member.eof:
                    if not source.more():
                        break
                source = Inflated(file, source.place() + int(stored))
                if take:
                    yield head, None
                continue
            block = source.read(length)
            source.read(4)
            if take:
                yield head, block.partition(b"\r\n\r\n")[2] if payloads and head.get("warc-type") != "revisit" else None


def values(head: dict[str, str], payload: bytes | None) -> tuple:
    """A row; the size and digest of a payload that was read are its own."""
    size = head.get(PAYLOAD)
    digest = head.get("warc-payload-digest", "").removeprefix("sha1:") or None
    if payload is not None:
        size, digest = len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode()
    get = {**{k: head.get(h) for k, h in HEADER_OF.items()}, "payload_digest": digest, "payload": payload}
    return tuple(int(size) if k == "payload_bytes" and size is not None else get.get(k) for k in FIELDS)


class Archive(InputPartition):
    def __init__(self, paths):
        self.paths = paths


class WarcReader(DataSourceReader):
    def __init__(self, paths: list[str], payloads: bool, digest: bool):
        self.paths, self.payloads, self.digest, self.tests = paths, payloads, digest, []

    def pushFilters(self, filters):
        """Equality, membership and presence of header columns are judged before a block is touched."""
        for f in filters:
            name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if name in HEADER_OF and name != "payload_digest" and isinstance(f, (EqualTo, In, IsNotNull)):
                known = None if isinstance(f, IsNotNull) else {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.tests.append((HEADER_OF[name], known))
            else:
                yield f

    def partitions(self):
        """Files dealt out largest first to partitions of about 64 MB."""
        sized = []
        for path in self.paths:
            store, place = opened(path)
            sized.append((store.get_file_info(place).size or 0, path))
        groups, room = [], 0
        for size, path in sorted(sized, reverse=True):
            if not groups or room + size > 64 << 20:
                groups.append([])
                room = 0
            groups[-1].append(path)
            room += size
        return [Archive(g) for g in groups] or [Archive([])]

    def read(self, partition):
        def wanted(head):
            return all(head.get(h) is not None and (known is None or head[h] in known) for h, known in self.tests)

        for path in partition.paths:
            for head, payload in records(path, wanted, self.payloads or self.digest):
                row = values(head, payload)
                yield row if self.payloads else (*row[:-1], None)


class WarcSource(DataSource):
    """``spark.read.format("warc")``: options ``path`` (a folder, or files one a line), ``payload`` and ``digest``.

    ``payload`` false leaves payloads unread; ``digest`` true then still reads
    them to return their own size and digest in place of the declared ones.
    """

    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        from pyarrow import fs

        paths = []
        for path in self.options["path"].split("\n"):
            if path.endswith((".warc", ".warc.gz")):
                paths.append(path)
            elif path:
                store, place = opened(path)
                found = store.get_file_info(fs.FileSelector(place, allow_not_found=True))
                paths += [f"{path}/{x.base_name}" for x in found if x.base_name.endswith((".warc", ".warc.gz"))]
        flag = lambda name, default: self.options.get(name, default).lower() == "true"
        return WarcReader(sorted(paths), flag("payload", "true"), flag("digest", "false"))


def read_warc(spark: SparkSession, paths: list[str] | str, payload: bool = True, digest: bool = False) -> DataFrame:
    """Records of a folder or of the named archives."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)
    reader = spark.read.format("warc").option("payload", str(payload).lower()).option("digest", str(digest).lower())
    return reader.option("path", paths if isinstance(paths, str) else "\n".join(paths)).load()


def archived_pages(pages: DataFrame, revisit_from: int = 0) -> DataFrame:
    """Write every page, read the archives back: one row per page, payloads checked on the way."""
    spark = pages.sparkSession
    manifest = write_pages(pages, scratch_path(spark, "warc"), revisit_from)
    paths = [row.path for row in manifest.select("path").collect()]  # one short row per archive
    number = lambda c: F.regexp_extract(c, r"^<urn:page:(-?\d+)>$", 1).try_cast("long")
    return read_warc(spark, paths, payload=False, digest=True).select(
        number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        number("refers_to").alias("refers_to"),
    )
