"""WARC archives as a Spark data source in Python.

``spark.read.format("warc")`` plans one partition per run of files, parses a record's headers first,
drops records whose headers fail a pushed-down predicate and then skips their payload: a member
written here carries its own compressed length (the ``sl`` field of the gzip header), so the reader
seeks over it; other gzip members, of one record or many, are read through without parsing the payload, and
plain archives are skipped through.  What is no record (a broken header, bytes in between) is left
out up to the next line that begins with ``WARC/``.  With the option ``payload=false`` no payload is parsed at all.

``df.write.format("warc")`` writes one gzip member per record; files appear under their final
names only at commit, so what a lost executor leaves behind is never read.

Paths go through Arrow's file systems (local, HDFS, S3, ...) and must be shared by all executors.

Defined results: a null or empty payload is a record with no payload bytes; a null target is an empty
header; control characters in header values become spaces; an empty table gives an archive without
records; columns of the written table other than ``COLUMNS`` are refused.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, In, InputPartition, IsNotNull, WriterCommitMessage

from missaware.llm.common import text_or_empty
from missaware.session import scratch_path

HEADERS = {
    "record_type": "WARC-Type", "record_id": "WARC-Record-ID", "date": "WARC-Date", "target_uri": "WARC-Target-URI",
    "payload_digest": "WARC-Payload-Digest", "refers_to": "WARC-Refers-To",
}
COLUMNS = [*HEADERS, "payload_length", "payload"]
SCHEMA = ", ".join(f"{c} string" for c in HEADERS) + ", payload_length long, payload binary"
ARROW = pa.schema([*[(c, pa.string()) for c in HEADERS], ("payload_length", pa.int64()), ("payload", pa.binary())])
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Bytes of archive files in one partition, in one written file, and read at once.
PART_BYTES, FILE_BYTES, READ = 64 << 20, 256 << 20, 1 << 16
#: Rows and bytes of payload passed on at once; bytes of a record's headers.
ROWS, ROW_BYTES, HEADERS_MOST = 256, 8 << 20, 1 << 20


def file_system(path: str):
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def _clean(value) -> str:
    return "".join(" " if ord(c) < 32 or ord(c) == 127 else c for c in str(value or ""))


def member(row: dict, level: int = 1) -> bytes:
    """A record as a gzip member that tells its own length."""
    payload = row["payload"] or b""
    full = len(payload) if row["payload_length"] is None else row["payload_length"]
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {full}\r\n\r\n".encode()
    lines = [f"{name}: {_clean(row[c])}" for c, name in HEADERS.items() if row[c] is not None]
    if row["record_type"] == "revisit":
        lines.append(f"WARC-Profile: {PROFILE}")
        payload = b""
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(http) + len(payload)}"]
    raw = b"WARC/1.1\r\n" + "\r\n".join(lines).encode("utf-8") + b"\r\n\r\n" + http + payload + b"\r\n\r\n"
    pack = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = pack.compress(raw) + pack.flush()
    # FEXTRA with subfield "sl": length of the member and of the record
    head = struct.pack("<4BI2B", 0x1F, 0x8B, 8, 4, 0, 0, 255) + struct.pack("<H2sHII", 12, b"sl", 8, 24 + len(body) + 8, len(raw) & 0xFFFFFFFF)
    return head + body + struct.pack("<II", zlib.crc32(raw), len(raw) & 0xFFFFFFFF)


def headers_of(block: bytes) -> dict:
    out: dict = {}
    for line in block.decode("utf-8", "replace").split("\r\n")[1:]:
        name, colon, value = line.partition(":")
        if colon:
            out.setdefault(name.strip().lower(), value.strip())
    return out


class Records:
    """The records of one archive file: headers first, the block only when asked for."""

    def __init__(self, file):
        self.file, self.size = file, file.size()

    def __iter__(self):
        at = 0
        while at < self.size:
            self.file.seek(at)
            start = self.file.read(24)
            if start[:2] != b"\x1f\x8b":  # plain to the end of the file
                yield from in_order(Source(self.file, at))
                return
            if len(start) == 24 and start[3] == 4 and start[12:14] == b"sl":
                record = Member(self.file, at + 24, zlib.decompressobj(-15), at + struct.unpack("<I", start[16:20])[0])
                if record.headers:
                    yield record
                at = record.end
            else:  # a member of any number of records
                source = Inflated(self.file, at)
                yield from in_order(source)
                at = source.end()


class Source:
    """Bytes of a plain archive from a place on, read as they are needed."""

    def __init__(self, file, at):
        self.file, self.at, self.buffer = file, at, b""

    def more(self) -> bytes:
        self.file.seek(self.at)
        got = self.file.read(READ)
        self.at += len(got)
        return got

    def fill(self, n: int) -> bool:
        """Whether ``n`` bytes are at hand."""
        pieces, size = [self.buffer], len(self.buffer)
        while size < n and (got := self.more()):
            pieces.append(got)
            size += len(got)
        self.buffer = b"".join(pieces)
        return size >= n

    def take(self, n: int) -> bytes:
        self.fill(n)
        out, self.buffer = self.buffer[:n], self.buffer[n:]
        return out

    def skip(self, n: int) -> None:
        inside = min(n, len(self.buffer))
        self.buffer, self.at = self.buffer[inside:], self.at + n - inside


class Inflated(Source):
    """Bytes of one gzip member."""

    def __init__(self, file, at):
        super().__init__(file, at)
        self.inflate = zlib.decompressobj(31)

    def more(self) -> bytes:
        out = b""
        while not out and not self.inflate.eof:
            got = self.inflate.unconsumed_tail
            if not got:
                got = super().more()
                if not got:  # cut short: what is left inside
                    return self.inflate.flush()
            try:
                out = self.inflate.decompress(got, READ)
            except zlib.error:  # a broken member ends here, and with it the file
                self.inflate, self.at = zlib.decompressobj(31), self.file.size()
                break
        return out

    def skip(self, n: int) -> None:
        while n > 0 and (self.buffer or self.fill(1)):
            n -= len(self.take(min(n, READ)))

    def end(self) -> int:
        """The place after the member; reads what is left of it."""
        while self.more():
            pass
        return self.at - len(self.inflate.unused_data)


def in_order(source: Source):
    """The records of a source.  What is no record is left out up to the next line that begins one."""
    while source.fill(5) or source.buffer.strip(b"\r\n"):
        if source.buffer[:1] in (b"\r", b"\n"):
            source.buffer = source.buffer.lstrip(b"\r\n")
            continue
        cut = -1
        if source.buffer.startswith(b"WARC/"):
            size = READ
            while (cut := source.buffer.find(b"\r\n\r\n")) < 0 and size <= HEADERS_MOST and source.fill(size):
                size *= 2
            cut = source.buffer.find(b"\r\n\r\n")
        headers = headers_of(source.buffer[:cut]) if cut >= 0 else {}
        length = headers.get("content-length", "")
        if not length.isdigit():
            resume(source)
            continue
        source.take(cut + 4)
        record = Ordered(source, headers, int(length))
        yield record
        record.finish()


def resume(source: Source) -> None:
    """On to the next line that begins a record, or to the end."""
    source.take(1)
    while (at := source.buffer.find(b"\nWARC/")) < 0:
        if len(source.buffer) > 5:
            source.take(len(source.buffer) - 5)
        if not source.fill(len(source.buffer) + 1):
            source.buffer = b""
            return
    source.take(at + 1)


class Ordered:
    """A record that is read before the next one."""

    def __init__(self, source: Source, headers: dict, length: int):
        self.source, self.headers, self.left = source, headers, length

    def block(self) -> bytes:
        out, self.left = self.source.take(self.left), 0
        return out

    def finish(self) -> None:
        self.source.skip(self.left)
        self.left = 0


class Member:
    """A gzip member of one record that tells its length.  Inflates until the headers are whole; goes on only when asked."""

    def __init__(self, file, at, inflate, end):
        self.file, self.at, self.inflate, self.end, self.data, self.rest = file, at, inflate, end, b"", b""
        file.seek(at)
        while b"\r\n\r\n" not in self.data and not inflate.eof:
            if not self.more(4096):
                break
        self.cut = self.data.find(b"\r\n\r\n")
        self.headers = headers_of(self.data[: self.cut]) if self.cut >= 0 and self.data.startswith(b"WARC/") else {}

    def more(self, most: int = 0) -> bool:
        """``most``: bytes to inflate, 0 for all that was read."""
        got = self.inflate.unconsumed_tail or self.file.read(READ)
        if not got:
            return False
        if got is not self.inflate.unconsumed_tail:
            self.at += len(got)
        self.data += self.inflate.decompress(got, most)
        return True

    def block(self) -> bytes:
        pieces = [self.data]
        while not self.inflate.eof:
            self.data = b""
            if not self.more():
                break
            pieces.append(self.data)
        self.data = b"".join(pieces)
        return self.data[self.cut + 4 : self.cut + 4 + int(self.headers.get("content-length", 0))]


def http_parts(block: bytes) -> tuple[dict, bytes]:
    cut = block.find(b"\r\n\r\n")
    return (headers_of(block[:cut]), block[cut + 4 :]) if cut >= 0 else ({}, block)


@dataclass
class Files(InputPartition):
    files: tuple


class WarcReader(DataSourceReader):
    def __init__(self, path: str, payload: bool):
        self.path, self.payload, self.tests = path, payload, []

    def pushFilters(self, filters):
        """Takes equality, IN and IS NOT NULL on header columns; the rest stays with Spark."""
        for f in filters:
            if isinstance(f, (EqualTo, In, IsNotNull)) and len(f.attribute) == 1 and f.attribute[0] in HEADERS:
                name = HEADERS[f.attribute[0]].lower()
                values = None if isinstance(f, IsNotNull) else {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.tests.append((name, values))
            else:
                yield f

    def partitions(self):
        fs, path = file_system(self.path)
        found = fs.get_file_info(pafs.FileSelector(path, recursive=False)) if fs.get_file_info(path).type == pafs.FileType.Directory else [fs.get_file_info(path)]
        out, held = [[]], 0
        for f in sorted(found, key=lambda f: f.path):
            if f.type == pafs.FileType.File and f.path.endswith((".warc", ".warc.gz")):
                if held + f.size > PART_BYTES and out[-1]:
                    out.append([])
                    held = 0
                out[-1].append(f.path)
                held += f.size
        return [Files(tuple(x)) for x in out]

    def read(self, partition):
        fs, _ = file_system(self.path)
        rows: list[tuple] = []
        held = 0
        for name in partition.files:
            with fs.open_input_file(name) as file:
                for record in Records(file):
                    h = record.headers
                    if all(h.get(n) is not None and (v is None or h[n] in v) for n, v in self.tests):
                        length, payload = None, None
                        if self.payload or h.get("warc-type") == "revisit":  # a revisit's block has headers only
                            http, payload = http_parts(record.block())
                            length = int(http["content-length"]) if "content-length" in http else len(payload)
                            payload = payload if self.payload and h.get("warc-type") != "revisit" else None
                        rows.append((*[h.get(n.lower()) for n in HEADERS.values()], length, payload))
                        held += len(payload or b"")
                        if len(rows) >= ROWS or held >= ROW_BYTES:
                            yield batch(rows)
                            rows, held = [], 0
        if rows:
            yield batch(rows)


def batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), ARROW.types, strict=True)], schema=ARROW)


@dataclass
class Written(WriterCommitMessage):
    files: tuple


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, path: str, names: list[str]):
        if sorted(names) != sorted(COLUMNS):
            raise ValueError(f"a WARC table has the columns {COLUMNS}")
        self.path, self.run = path, uuid.uuid4().hex

    def write(self, iterator):
        fs, path = file_system(self.path)
        fs.create_dir(f"{path}/_attempts", recursive=True)
        files, out, held = [], None, 0
        for b in iterator:
            for row in b.to_pylist():
                if out is None or held >= FILE_BYTES:
                    if out is not None:
                        out.close()
                    files.append(f"{path}/_attempts/{self.run}-{uuid.uuid4().hex}.warc.gz")
                    out, held = fs.open_output_stream(files[-1], compression=None), 0
                data = member(row)
                out.write(data)
                held += len(data)
        if out is not None:
            out.close()
        return Written(tuple(files))

    def commit(self, messages):
        fs, path = file_system(self.path)
        fs.create_dir(path, recursive=True)
        for m in messages:
            for f in m.files if m else ():
                fs.move(f, f"{path}/{f.rsplit('/', 1)[1]}")

    def abort(self, messages):
        fs, _ = file_system(self.path)
        for m in messages:
            for f in m.files if m else ():
                if fs.get_file_info(f).type == pafs.FileType.File:
                    fs.delete_file(f)


class WarcDataSource(DataSource):
    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return WarcReader(self.options["path"], self.options.get("payload", "true").lower() == "true")

    def writer(self, schema, overwrite):
        return WarcWriter(self.options["path"], schema.names)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WarcDataSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def read_warc(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    register(spark)
    return spark.read.format("warc").option("payload", str(payload).lower()).load(path)


def records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = 100) -> DataFrame:
    """One record per page.  Of equal payloads of ``least`` bytes or more the smallest id is the response.

    Only digests are grouped (combined early); the pages are joined with the repeated digests alone,
    and a digest that very many pages share is split by the skew join.
    """
    payload = text_or_empty(F.col(html_col)).cast("binary")
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("target_uri"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256)).withColumn("payload_length", F.octet_length("payload").cast("long"))
    many = rows.filter(F.col("payload_length") >= least).groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first")).filter("n > 1").select("digest", "first")
    rows = rows.join(many, "digest", "left")
    again = F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first"))
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))
    return rows.select(
        F.when(again, "revisit").otherwise("response").alias("record_type"), urn(F.col("id")).alias("record_id"), F.lit("1970-01-01T00:00:00Z").alias("date"), "target_uri",
        F.concat(F.lit("sha256:"), "digest").alias("payload_digest"), F.when(again, urn(F.col("first"))).alias("refers_to"), "payload_length",
        F.when(~again, F.col("payload")).alias("payload"),
    )


def op8(spark, sf_dir):
    """Write all pages as WARC, then read them back: responses with payload, revisits by headers."""
    path = scratch_path(spark, "warc")
    register(spark)
    records(spark.read.parquet(f"{sf_dir}/pages.parquet")).write.format("warc").mode("append").save(path)
    page = lambda c: F.nullif(F.regexp_extract(c, r"^<urn:page:(.*)>$", 1), F.lit("")).cast("long")
    responses = read_warc(spark, path).filter("record_type = 'response'").select(
        page("record_id").alias("page_id"), F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_digest"), "record_type", F.lit(None).cast("long").alias("refers_to"), "target_uri"
    )
    revisits = read_warc(spark, path, payload=False).filter("record_type = 'revisit'").select(
        page("record_id").alias("page_id"), F.col("payload_length").alias("payload_bytes"), F.regexp_replace("payload_digest", "^sha256:", "").alias("payload_digest"), "record_type", page("refers_to").alias("refers_to"), "target_uri"
    )
    return responses.unionByName(revisits)


OP8_SQL = """
WITH p AS (
  SELECT page_id, url, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT payload_digest, min(page_id) AS first FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest HAVING count(*) > 1)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN first IS NOT NULL AND page_id IS DISTINCT FROM first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first IS NOT NULL AND page_id IS DISTINCT FROM first THEN first END AS refers_to, url AS target_uri
FROM p LEFT JOIN f USING (payload_digest)
"""
