"""Legacy ARC archives to WARC.

An ARC record is one line of fields, then exactly the declared number of bytes, then a line feed. The first record
of a file, ``filedesc://``, states the version: lines of version 1 have five fields, those of version 2 ten, with the
length last in both. ``scan`` walks such files and digests every record; ``decide`` finds records of equal payload; ``convert``
reads the records again at their places and writes WARC files with made-up but repeatable identifiers, 14-digit
dates turned to ISO 8601, types by URL scheme, and SHA-1 digests; ``read_warc`` reads them back.

Files lie in a folder that all executors share (any file system of pyarrow). A task writes files of its own name and
reports them; only reported files are read, so a repeated task leaves an orphan and no doubled record. A file is
closed once it is large enough, and records pass one at a time.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime, timezone
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize, shared_folder

# Field names of ARC header lines, and the WARC revisit profile.
V1 = ("URL", "IP-address", "Archive-date", "Content-type", "Archive-length")
V2 = ("URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename",
      "Archive-length")
REVISIT_PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"

FILE_BYTES = 64 << 20
COMPRESSION = 1
REVISIT_LEAST = 1000
NAMESPACE = uuid.uuid5(uuid.NAMESPACE_URL, "urn:arc-record")


def open_folder(folder: str) -> tuple[pa.fs.FileSystem, str]:
    """File system and path of a folder given as URI or path."""
    if "://" in folder or folder.startswith("file:"):
        return pa.fs.FileSystem.from_uri(folder)
    return pa.fs.LocalFileSystem(), folder


class Files:
    """Writes one task's files; ``reports`` has (path, records, bytes) of those that are complete."""

    def __init__(self, folder: str, suffix: str, head, most: int = FILE_BYTES):
        self.fs, self.folder = open_folder(folder)
        self.suffix, self.head, self.most = suffix, head, most
        self.sink, self.reports = None, []

    def write(self, record: bytes) -> tuple[str, int]:
        """Adds a record as a gzip member of its own; returns its file and offset."""
        if self.sink is None:
            self.name = f"{uuid.uuid4().hex}{self.suffix}"
            self.fs.create_dir(self.folder, recursive=True)
            self.sink, self.size, self.count = self.fs.open_output_stream(f"{self.folder}/{self.name}", compression=None), 0, 0
            self._put(self.head(self.name))
        place = self.name, self.size
        self._put(record)
        self.count += 1
        if self.size >= self.most:
            self.close()
        return place

    def _put(self, record: bytes) -> None:
        packed = gzip.compress(record, COMPRESSION, mtime=0)
        self.sink.write(packed)
        self.size += len(packed)

    def close(self) -> None:
        if self.sink is not None:
            self.sink.close()
            self.reports.append((self.name, self.count, self.size))
            self.sink = None


class Members:
    """Sequential reader over the gzip members of one file, or a plain file, in bounded memory per record."""

    def __init__(self, file, offset: int = 0):
        self.file, self.offset = file, offset
        file.seek(offset)
        self.held = b""

    def __iter__(self) -> Iterator[tuple[int, bytes]]:
        while True:
            if not self.held:
                self.held = self.file.read(1 << 20)
                if not self.held:
                    return
            start, engine, parts = self.offset, zlib.decompressobj(31), []
            while not engine.eof:
                if not self.held:
                    self.held = self.file.read(1 << 20)
                    if not self.held:
                        raise ValueError(f"the archive ends inside the member at {start}")
                size = len(self.held)
                parts.append(engine.decompress(self.held))
                self.held = engine.unused_data
                self.offset += size - len(self.held)
            yield start, b"".join(parts)


def member(file, offset: int) -> bytes:
    return next(iter(Members(file, offset)))[1]


@dataclass
class ArcRecord:
    version: int
    fields: dict[str, str]
    content: bytes


def arc_line(version: int, values: dict[str, str], length: int) -> bytes:
    names = V1 if version == 1 else V2
    row = [values.get(n) or "-" for n in names[:-1]]
    row = [quote(v, safe="/:?&=#%+,;@!$'()*[]~-._") for v in row]
    return (" ".join([*row, str(length)]) + "\n").encode("ascii")


def parse_arc(raw: bytes, version: int) -> ArcRecord:
    """A record by its version's header line. The declared length rules: longer content is cut, shorter is an error."""
    line, _, rest = raw.partition(b"\n")
    values = line.decode("utf-8", "replace").rstrip("\r").split(" ")
    names = V1 if version == 1 else V2
    if len(values) < len(names):
        raise ValueError(f"an ARC line of version {version} has {len(names)} fields: {values[:3]}")
    # addresses of old crawlers may hold spaces; all other fields are counted from the end
    extra = len(values) - len(names)
    values = [" ".join(values[:extra + 1]), *values[extra + 1:]]
    fields = dict(zip(names, values))
    length = int(fields["Archive-length"])
    if len(rest) < length:
        raise ValueError(f"the record declares {length} bytes and has {len(rest)}")
    return ArcRecord(version, fields, rest[:length])


def arc_version(raw: bytes) -> int:
    """Version by the second line of the filedesc record."""
    lines = raw.split(b"\n", 2)
    if not lines[0].startswith(b"filedesc:") or len(lines) < 2:
        raise ValueError("an ARC file begins with a filedesc record")
    return int(lines[1].split(b" ")[0])


def arc_head(version: int):
    """Maker of the filedesc record of a new file."""
    def head(name: str) -> bytes:
        body = f"{version} 0 klaxon\n{' '.join(V1 if version == 1 else V2)}\n".encode()
        return arc_line(version, {"URL": f"filedesc://{name}", "IP-address": "0.0.0.0", "Archive-date": "20240101000000",
                                  "Content-type": "text/plain", "Result-code": "200"}, len(body)) + body + b"\n"
    return head


def split_http(content: bytes) -> tuple[bytes, bytes]:
    """Head and payload of an HTTP message; content without a head is all payload."""
    if not content.startswith(b"HTTP/"):
        return b"", content
    head, mark, payload = content.partition(b"\r\n\r\n")
    return head + mark, payload


def http_field(head: bytes, name: str) -> str | None:
    for line in head.split(b"\r\n")[1:]:
        key, _, value = line.partition(b":")
        if key.strip().lower() == name.lower().encode():
            return value.strip().decode("latin-1")
    return None


def pack_arc(pages: DataFrame, folder: str, date: str = "20240101000000") -> DataFrame:
    """Writes pages as ARC files, those with even ids in version 1 and others in version 2; reports the files.

    The page id travels in the HTTP head. Null addresses are written as ``-``, null html as an empty payload.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = {v: Files(folder, ".arc.gz", arc_head(v)) for v in (1, 2)}
        for batch in batches:
            for page_id, url, html in zip(*(c for c in batch.columns)):
                payload, page_id = (html.as_py() or "").encode("utf-8"), page_id.as_py()
                named = "" if page_id is None else f"X-Page-Id: {page_id}\r\n"
                content = f"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n{named}Content-Length: {len(payload)}\r\n\r\n".encode() + payload
                version = 2 if page_id is not None and page_id % 2 else 1
                line = arc_line(version, {"URL": url.as_py(), "IP-address": "0.0.0.0", "Archive-date": date,
                                          "Content-type": "text/html", "Result-code": "200"}, len(content))
                out[version].write(line + content + b"\n")
        for files in out.values():
            files.close()
        yield _reports([r for f in out.values() for r in f.reports])

    rows = pages.selectExpr("cast(page_id as bigint)", "url", "html")
    return materialize(rows.mapInArrow(run, "file string, records bigint, bytes bigint"), "arc-files")


def _reports(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64()),
                                       pa.array([r[2] for r in rows], pa.int64())], names=["file", "records", "bytes"])


def _spread(files: DataFrame) -> DataFrame:
    """Deals files over tasks: their number is known by then."""
    return files.repartition(max(1, min(files.count(), 4096)))


def scan(files: DataFrame, folder: str) -> DataFrame:
    """One row per ARC record: its place, page id, payload size and SHA-1, and the date."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, at = open_folder(folder)
        names = ["file", "offset", "version", "page_id", "payload_bytes", "payload_sha1", "record_id"]
        for batch in batches:
            for name in batch.column("file").to_pylist():
                rows, version = [], None
                with fs.open_input_file(f"{at}/{name}") as file:
                    for offset, raw in Members(file):
                        if version is None:
                            version = arc_version(raw)
                            continue
                        record = parse_arc(raw, version)
                        head, payload = split_http(record.content)
                        page = http_field(head, "X-Page-Id")
                        rows.append((name, offset, version, None if page is None else int(page), len(payload),
                                     hashlib.sha1(payload).hexdigest(), record_id(name, offset)))
                        if len(rows) == 2000:
                            yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in rows], schema=_SCAN)
                            rows = []
                yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in rows], schema=_SCAN)

    found = _spread(files.select("file")).mapInArrow(
        run, "file string, offset bigint, version int, page_id bigint, payload_bytes bigint, payload_sha1 string, record_id string")
    return materialize(found, "arc-records")


_SCAN = pa.schema([("file", pa.string()), ("offset", pa.int64()), ("version", pa.int32()), ("page_id", pa.int64()),
                   ("payload_bytes", pa.int64()), ("payload_sha1", pa.string()), ("record_id", pa.string())])


def record_id(file: str, offset: int) -> str:
    """Identifier that depends on the record's place alone."""
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'{file}/{offset}')}>"


def decide(records: DataFrame, least: int = REVISIT_LEAST) -> DataFrame:
    """Adds ``target``: the id of the record that a record revisits, or null for a response.

    Of records of at least ``least`` bytes with equal SHA-1 and size, that with the largest page id (then record id) is the response.
    Only digests that occur twice are joined back. The grouping combines before its shuffle; the join of a
    frequent digest is split by Spark, as both sides are plain shuffles.
    """
    best = records.where(F.col("payload_bytes") >= least).groupBy("payload_sha1", "payload_bytes").agg(
        F.max(F.struct("page_id", "record_id")).alias("best"), F.count("*").alias("n")).where("n > 1")
    best = best.select("payload_sha1", "payload_bytes", F.col("best.record_id").alias("target"))
    joined = records.join(best, ["payload_sha1", "payload_bytes"], "left")
    return joined.withColumn("target", F.when(F.col("target") != F.col("record_id"), F.col("target")))


def warc_block(fields: list[tuple[str, str]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", str(len(block)))])
    return b"WARC/1.1\r\n" + head.encode("utf-8") + b"\r\n" + block + b"\r\n\r\n"


def warc_head(name: str) -> bytes:
    body = b"software: klaxon\r\nformat: WARC File Format 1.1\r\n"
    return warc_block([("WARC-Type", "warcinfo"), ("WARC-Record-ID", record_id(name, 0)), ("WARC-Date", "2024-01-01T00:00:00Z"),
                       ("WARC-Filename", name), ("Content-Type", "application/warc-fields")], body)


def iso_date(digits: str) -> str:
    """ISO 8601 of a 14-digit date; shorter ones are filled up, others become the epoch."""
    try:
        padded = digits + "00000101000000"[len(digits):] if len(digits) < 14 else digits[:14]
        return datetime.strptime(padded, "%Y%m%d%H%M%S").replace(tzinfo=timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    except ValueError:
        return "1970-01-01T00:00:00Z"


def to_warc(record: ArcRecord, own: str, target: str | None) -> bytes:
    """The equivalent WARC record; a revisit keeps the HTTP head and drops the payload."""
    head, payload = split_http(record.content)
    digest = "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode()
    url, kind = record.fields["URL"], "response" if head else "resource"
    fields = [("WARC-Record-ID", own), ("WARC-Date", iso_date(record.fields["Archive-date"])), ("WARC-Target-URI", url),
              ("WARC-IP-Address", record.fields["IP-address"]), ("WARC-Payload-Digest", digest)]
    if target is not None:
        fields = [("WARC-Type", "revisit"), *fields, ("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", target)]
        block = head
    else:
        fields, block = [("WARC-Type", kind), *fields], record.content
    fields.append(("WARC-Block-Digest", "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()))
    fields.append(("Content-Type", "application/http; msgtype=response" if head else record.fields["Content-type"]))
    return warc_block(fields, block)


def convert(decided: DataFrame, folder: str, target_folder: str) -> DataFrame:
    """Writes the WARC files; reports them. Rows of one ARC file lie together and are read in order of their offsets."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, at = open_folder(folder)
        out, name, file = Files(target_folder, ".warc.gz", warc_head), None, None
        for batch in batches:
            for row in batch.to_pylist():
                if row["file"] != name:
                    if file is not None:
                        file.close()
                    name, file = row["file"], fs.open_input_file(f"{at}/{row['file']}")
                    walk = iter(Members(file, row["offset"]))
                    place, raw = next(walk)
                while place < row["offset"]:
                    place, raw = next(walk)
                out.write(to_warc(parse_arc(raw, row["version"]), row["record_id"], row["target"]))
        if file is not None:
            file.close()
        out.close()
        yield _reports(out.reports)

    n = max(1, min(decided.select("file").distinct().count(), 4096))
    placed = decided.select("file", "offset", "version", "record_id", "target").repartitionByRange(n, "file", "offset")
    placed = placed.sortWithinPartitions("file", "offset")
    return materialize(placed.mapInArrow(run, "file string, records bigint, bytes bigint"), "warc-files")


def parse_warc(raw: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record")
    fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
    return fields, rest[:int(fields["content-length"])]


_READ = pa.schema([("record_id", pa.string()), ("record_type", pa.string()), ("url", pa.string()), ("warc_date", pa.string()),
                   ("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("target", pa.string())])


def read_warc(files: DataFrame, folder: str) -> DataFrame:
    """One row per record of the WARC files, without warcinfo.

    ``payload_digest`` is hexadecimal; payloads of responses are digested again and must agree. A revisit's size is that of its HTTP head's
    Content-Length, as the payload itself is elsewhere.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, at = open_folder(folder)
        for batch in batches:
            for name in batch.column("file").to_pylist():
                rows = []
                with fs.open_input_file(f"{at}/{name}") as file:
                    for _, raw in Members(file):
                        fields, block = parse_warc(raw)
                        if fields["warc-type"] == "warcinfo":
                            continue
                        head, payload = split_http(block)
                        digest = base64.b32decode(fields["warc-payload-digest"].removeprefix("sha1:")).hex()
                        revisit, page = fields["warc-type"] == "revisit", http_field(head, "X-Page-Id")
                        if not revisit and hashlib.sha1(payload).hexdigest() != digest:
                            raise ValueError(f"{name}: the payload of {fields['warc-record-id']} is damaged")
                        size = int(http_field(head, "Content-Length")) if revisit else len(payload)
                        url = fields["warc-target-uri"]
                        rows.append({"record_id": fields["warc-record-id"], "record_type": fields["warc-type"], "url": None if url == "-" else url,
                                     "warc_date": fields["warc-date"], "page_id": None if page is None else int(page), "payload_bytes": size,
                                     "payload_digest": digest, "target": fields.get("warc-refers-to")})
                        if len(rows) == 2000:
                            yield pa.RecordBatch.from_pylist(rows, schema=_READ)
                            rows = []
                yield pa.RecordBatch.from_pylist(rows, schema=_READ)

    ddl = ("record_id string, record_type string, url string, warc_date string, page_id bigint, payload_bytes bigint, "
           "payload_digest string, target string")
    return _spread(files.select("file")).mapInArrow(run, ddl)


def pages_through_warc(pages: DataFrame) -> DataFrame:
    """Pages into ARC files, these into WARC files, and every record read back.

    page_id, payload_bytes, payload_digest, record_type and refers_to (page id of the response that a revisit names), with url, record_id
    and warc_date. An empty table gives no row; null ids are possible and order before others.
    """
    folder = f"{shared_folder(pages.sparkSession)}/archives-{uuid.uuid4().hex}"
    arcs, warcs = f"{folder}/arc", f"{folder}/warc"
    records = scan(pack_arc(pages, arcs), arcs)
    written = convert(decide(records), arcs, warcs)
    rows = materialize(read_warc(written, warcs), "warc-records")
    named = rows.where("target is not null").groupBy("target").agg(F.lit(1).alias("one")).select(F.col("target").alias("record_id"))
    named = rows.join(named, "record_id", "left_semi").select(F.col("record_id").alias("target"), F.col("page_id").alias("refers_to"))
    return rows.join(named, "target", "left").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url",
                                                     "record_id", "warc_date")


def sql(least: int = REVISIT_LEAST) -> str:
    """Digest columns of ``pages_through_warc`` for DuckDB."""
    return f"""
with p as (select page_id, encode(coalesce(html, '')) as payload, strlen(coalesce(html, ''))::bigint as payload_bytes from pages),
d as (select page_id, payload_bytes, sha1(payload) as payload_digest from p),
m as (select *, max(page_id) over (partition by payload_digest, payload_bytes) as best from d)
select page_id, payload_bytes, payload_digest,
  case when payload_bytes >= {least} and page_id <> best then 'revisit' else 'response' end as record_type,
  case when payload_bytes >= {least} and page_id <> best then best end as refers_to from m"""
