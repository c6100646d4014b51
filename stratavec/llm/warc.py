"""WARC archives with a two-level capture index.

Archives are files of gzip members, a record each, written by Spark's own text writer: so they go to any store that
Spark writes to, and a lost executor's files are written again by its commit protocol. A file is closed once it has
FILE_BYTES, so it has that and a record at most. Of pages with equal payloads the one with the largest page_id is written as
response, the others as revisit records that refer to it.

The index is made from what is read back. Its lines, sorted by reversed-host key, lie in compressed blocks; a sparse
directory has a line for each block, sorted too: first and last key, file, offset and length. A lookup bisects the
directory's files and then the lines of one, by reads of a few kilobytes, then bisects a block, and reads only the byte
ranges that it needs; neither level is ever held whole.

Null html is an empty payload; a null url is an empty one. Pages of any length are written whole; a page and its record must
fit a row, 2 GB. Rows with a null page_id are written, but own no payload unless all rows with it have none; then each is a
response. Rows that share the largest page_id of a payload are all responses. Payloads below min_bytes are always responses.
No pages give no archives, an empty index and no rows. Ids are longs. Only page_id, url and html are read, so other columns
of any name don't matter."""

from __future__ import annotations

import base64
import bisect
import gzip
import hashlib
import json
import zlib
from urllib.parse import quote, urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Appended to members that don't end with a zero byte; its last byte is zero, as are those of members of less than 16 MB.
EMPTY_MEMBER = gzip.compress(b"", mtime=0)
#: Bytes at which an archive file is closed, lines of a block, blocks of a file, bytes read at once from the directory.
FILE_BYTES = 32 << 20
BLOCK_LINES, FILE_BLOCKS, PROBE = 3_000, 500, 4_096
_CAPTURE = "key string, page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, path string, offset long, length long"
_FIELDS = [f.split()[0] for f in _CAPTURE.split(", ")]
_BLOCK = (("first_key", "string"), ("last_key", "string"), ("path", "string"), ("offset", "long"), ("length", "long"))


def key_of(url: str | None) -> str:
    """Reversed host, then path and query, lower case host: http://www.a.org/x?y is org,a,www)/x?y."""
    try:
        parts = urlsplit((url or "").strip())
        host, port = parts.hostname or "", f":{parts.port}" if parts.port else ""
    except ValueError:
        return quote(url or "", safe="")
    path = quote(parts.path or "/", safe="/%:@!$&'()*+,;=~-._") + ("?" + quote(parts.query, safe="/%:@!$&'()*+,;=~-._?") if parts.query else "")
    return quote(",".join(reversed(host.split("."))), safe=",") + port + ")" + path


def _member(data: bytes) -> bytes:
    return gzip.compress(data, 6, mtime=0)


def _row(found: list[bytes]) -> bytes:
    """Members as a row of the text writer: without the zero byte that ends it, which the line separator adds."""
    data = b"".join(found)
    return (data if data.endswith(b"\0") else data + EMPTY_MEMBER)[:-1]


def members(content: bytes):
    """(offset, length, data) of each member that isn't empty."""
    view, at = memoryview(content), 0
    while at < len(view):
        unzip, parts, end = zlib.decompressobj(31), [], at
        while not unzip.eof:
            if end >= len(view):
                raise ValueError("the file ends inside a record")
            parts.append(unzip.decompress(view[end : end + (1 << 15)]))
            end = min(end + (1 << 15), len(view))
        end -= len(unzip.unused_data)
        if data := b"".join(parts):
            yield at, end - at, data
        at = end


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str) -> bytes:
    """One record: an HTTP response with the payload, or a revisit with the HTTP head alone."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{page_id}>", f"WARC-Target-URI: {quote(url or '', safe=_URL)}", f"WARC-Date: {date}", f"WARC-Payload-Digest: sha1:{digest}"]
    if refers_to is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    block = head if refers_to is not None else head + payload
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


_URL = "/%:@!$&'()*+,;=~-._?#[]"


def parse(data: bytes) -> dict:
    """A record's fields; payload is None for revisits. Raises ValueError if its digest is not its payload's."""
    top, _, rest = data.partition(b"\r\n\r\n")
    version, *lines = top.decode().split("\r\n")
    if version != "WARC/1.1":
        raise ValueError(f"not a WARC record: {version[:40]!r}")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines)
    block = rest[: int(fields["Content-Length"])]
    head, _, payload = block.partition(b"\r\n\r\n")
    size = int(head.rpartition(b"Content-Length: ")[2])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    number = lambda text: None if text == "<urn:page:None>" else int(text.removeprefix("<urn:page:").rstrip(">"))
    kind = fields["WARC-Type"]
    if kind == "response" and (len(payload) != size or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
        raise ValueError(f"payload of {fields['WARC-Record-ID']} doesn't match its digest")
    return {"page_id": number(fields["WARC-Record-ID"]), "url": fields["WARC-Target-URI"], "payload_bytes": size, "payload_digest": digest, "record_type": kind, "refers_to": number(fields["WARC-Refers-To"]) if kind == "revisit" else None, "payload": payload if kind == "response" else None}


def write(pages: DataFrame, folder: str, min_bytes: int = 0, date: str = "1970-01-01T00:00:00Z") -> None:
    """Write every page (page_id, url, html) as a record into files of folder."""
    payload = F.coalesce("html", F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("payload")).withColumn("sha", F.sha1("payload"))
    sized = rows.where(F.octet_length("payload") >= min_bytes) if min_bytes else rows
    # Only payloads that repeat have an owner; the table is kept so that its size is known and hot payloads can be split.
    owners = common.keep(sized.groupBy("sha").agg(F.max("page_id").alias("owner"), F.count("*").alias("n")).where("n > 1").select("sha", "owner"), "owners")

    def make(batches):
        out, size = [], 0
        for batch in batches:
            for page_id, url, data, sha, owner in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                digest = base64.b32encode(bytes.fromhex(sha)).decode()
                refers_to = owner if owner is not None and owner != page_id and len(data) >= min_bytes else None
                out.append(_member(record(page_id, url, data, digest, refers_to, date)))
                size += len(out[-1])
                if size >= FILE_BYTES:
                    yield pa.record_batch([pa.array([_row(out)], pa.binary())], ["value"])
                    out, size = [], 0
        if out:
            yield pa.record_batch([pa.array([_row(out)], pa.binary())], ["value"])

    made = common.bounded(rows.join(owners, "sha", "left").select("page_id", "url", "payload", "sha", "owner")).mapInArrow(make, "value binary")
    _write_rows(made, folder, 1)
    common.drop(owners)


def _write_rows(made: DataFrame, folder: str, per_file: int) -> None:
    made.select(F.col("value").cast("string")).write.option("lineSep", "\0").option("maxRecordsPerFile", per_file).text(folder)


def _files(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder).select("path", "content")


def read(spark: SparkSession, folder: str) -> DataFrame:
    """A row per record of the archives in folder: the index's fields."""

    def scan(batches):
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows = []
                for offset, length, data in members(content):
                    found = parse(data)
                    rows.append({"key": key_of(found["url"]), **{k: v for k, v in found.items() if k != "payload"}, "path": path, "offset": offset, "length": length})
                yield pa.RecordBatch.from_pylist(rows, pa.schema([(n, pa.int64() if t == "long" else pa.string()) for n, t in (f.split() for f in _CAPTURE.split(", "))]))

    files = _files(spark, folder)
    return common.bounded(files).mapInArrow(scan, _CAPTURE)


class CaptureIndex:
    """Blocks of sorted lines in files, and the sorted directory of blocks."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder, self.blocks = spark, folder, f"{folder}/blocks"
        self._listed: list[tuple[str, int]] | None = None

    @property
    def directory(self) -> DataFrame:
        """(first_key, last_key, path, offset, length) of every block."""
        line = F.split("value", "\t")
        return self.spark.read.text(f"{self.folder}/directory").select(*[line[k].cast(t).alias(n) for k, (n, t) in enumerate(_BLOCK)])

    @classmethod
    def build(cls, captures: DataFrame, folder: str) -> CaptureIndex:
        spark = captures.sparkSession

        def pack(batches):
            lines: list[str] = []
            cut = lambda some: pa.record_batch([pa.array([_row([_member("\n".join(some).encode())])], pa.binary())], ["value"])
            for batch in batches:
                for row in batch.to_pylist():
                    lines.append(row["key"] + " " + json.dumps([row[f] for f in _FIELDS[1:]]))
                    if len(lines) == BLOCK_LINES:
                        yield cut(lines)
                        lines = []
            if lines:
                yield cut(lines)

        def listed(batches):
            for batch in batches:
                for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    rows = []
                    for offset, length, data in members(content):
                        first, last = (line.split(b" ", 1)[0].decode() for line in (data, data[data.rfind(b"\n") + 1 :]))
                        rows.append({"first_key": first, "last_key": last, "path": path, "offset": offset, "length": length})
                    yield pa.RecordBatch.from_pylist(rows, pa.schema([("first_key", pa.string()), ("last_key", pa.string()), ("path", pa.string()), ("offset", pa.int64()), ("length", pa.int64())]))

        order = ["key", "page_id", "path", "offset"]  # a host or url with many captures is split too
        _write_rows(captures.select(*_FIELDS).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(pack, "value binary"), f"{folder}/blocks", FILE_BLOCKS)
        entries = common.keep(_files(spark, f"{folder}/blocks").mapInArrow(listed, ", ".join(f"{n} {t}" for n, t in _BLOCK)), "entries")
        order = ["first_key", "path", "offset"]
        entries.repartitionByRange(*order).sortWithinPartitions(*order).select(F.concat_ws("\t", *[F.col(n).cast("string") for n, _ in _BLOCK]).alias("value")).write.text(f"{folder}/directory")
        common.drop(entries)
        return cls(spark, folder)

    def rows(self) -> DataFrame:
        """Every line of every block."""

        def scan(batches):
            schema = pa.schema([(n, pa.int64() if t == "long" else pa.string()) for n, t in (f.split() for f in _CAPTURE.split(", "))])
            for batch in batches:
                for content in batch.column(1).to_pylist():
                    for _, _, data in members(content):
                        lines = [line.split(" ", 1) for line in data.decode().split("\n")]
                        yield pa.RecordBatch.from_pylist([dict(zip(_FIELDS, [key, *json.loads(rest)], strict=True)) for key, rest in lines], schema)

        return _files(self.spark, self.blocks).mapInArrow(scan, _CAPTURE)

    def _fs(self, path: str):
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return at, at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _range(self, path: str, offset: int, length: int) -> bytes:
        at, fs = self._fs(path)
        stream = fs.open(at)
        try:
            stream.seek(offset)
            return bytes(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream, length))
        finally:
            stream.close()

    def _directory_files(self) -> list[tuple[str, int]]:
        """(path, bytes) of the directory's files, in the order of their keys."""
        if self._listed is None:
            at, fs = self._fs(f"{self.folder}/directory")
            found = [(f.getPath(), f.getLen()) for f in fs.listStatus(at)]
            named = [(int(p.getName().split("-")[1]), p.toString(), n) for p, n in found if p.getName().startswith("part-") and n]
            self._listed = [(p, n) for _, p, n in sorted(named)]
        return self._listed

    def _line(self, path: str, size: int, at: int) -> tuple[int, bytes]:
        """The first line that begins at or after a place, and where; at the file's end, nothing."""
        start, data = max(at - 1, 0), b""
        while True:
            part = self._range(path, start + len(data), min(PROBE, size - start - len(data)))
            data += part
            begin = 0 if at == 0 else data.find(b"\n") + 1
            end = data.find(b"\n", begin) if begin or at == 0 else -1
            if end >= 0 or start + len(data) >= size:
                found = data[begin:end] if end >= 0 else b""
                return (start + begin, found) if found else (size, b"")

    def _entries(self, key: str):
        """Entries of the directory from the last one whose block begins before key, to the last that may hold it."""
        wanted = key.encode()
        before = lambda line: line.split(b"\t", 1)[0] < wanted
        files = self._directory_files()
        first = max(bisect.bisect_left(files, True, key=lambda f: not before(self._line(*f, 0)[1])) - 1, 0)
        for n, (path, size) in enumerate(files[first:]):
            at = 0
            if n == 0:
                low, high = 0, size  # the last line that begins in [low, high) and before key
                while low < high:
                    middle = (low + high) // 2
                    begin, line = self._line(path, size, middle)
                    if line and begin < high and before(line):
                        at, low = begin, begin + 1
                    else:
                        high = middle
            while at < size:
                begin, line = self._line(path, size, at)
                if not line:
                    break
                first_key, last_key, block, offset, length = line.decode().split("\t")
                if first_key > key:
                    return
                yield first_key, last_key, block, int(offset), int(length)
                at = begin + len(line) + 1

    def lookup(self, url: str) -> list[dict]:
        """The captures of a url by page_id."""
        key, out = key_of(url), []
        for _, last_key, path, offset, length in self._entries(key):
            if last_key < key:
                continue
            lines = gzip.decompress(self._range(path, offset, length)).decode().split("\n")
            at = bisect.bisect_left(lines, key, key=lambda line: line.split(" ", 1)[0])
            while at < len(lines) and lines[at].split(" ", 1)[0] == key:
                out.append(dict(zip(_FIELDS, [key, *json.loads(lines[at].split(" ", 1)[1])], strict=True)))
                at += 1
        return out

    def fetch(self, capture: dict) -> dict:
        """The record of a capture, read as one byte range."""
        return parse(gzip.decompress(self._range(capture["path"], capture["offset"], capture["length"])))


def archive(pages: DataFrame, folder: str, min_bytes: int = 0) -> CaptureIndex:
    """Write the archives, read them back and index them, all below folder."""
    spark = pages.sparkSession
    write(pages, f"{folder}/archives", min_bytes)
    captures = common.keep(read(spark, f"{folder}/archives"), "captures")
    index = CaptureIndex.build(captures, f"{folder}/index")
    common.drop(captures)
    return index


#: Base32 is built from the hexadecimal digest, five bits at a time.
SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
d AS (SELECT page_id, payload_bytes, array_to_string(list_transform(range(0, 32), lambda i:
        substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (((instr('0123456789abcdef', substr(h, 1 + i * 5 // 4, 1)) - 1) * 16
          + instr('0123456789abcdef', substr(h, 2 + i * 5 // 4, 1)) - 1) >> (3 - i * 5 % 4)) % 32, 1)), '') AS payload_digest
      FROM p),
o AS (SELECT payload_digest, max(page_id) AS owner FROM d GROUP BY payload_digest)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
  CASE WHEN page_id = owner THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = owner THEN NULL ELSE owner END AS refers_to
FROM d JOIN o USING (payload_digest)
"""
