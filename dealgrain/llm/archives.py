"""Legacy web archives (ARC, versions 1 and 2) converted to WARC.

An ARC file opens with a version record that names its header fields; each later record is one header line with a
declared length, that many bytes, and a line end. The converter reads header lines by the declared version and
synthesises what WARC asks for: record identifiers, timestamps, record types and digests. Of records with equal
payloads one becomes the response and the others revisit it.

Files are written and read by Spark: a task assembles whole archive files of bounded size, the text writer stores the
bytes, and the binary file reader returns them. Payloads are never shuffled; only digests are.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialise, work_folder
from .tables import pick

#: Bytes of archive per file, uncompressed; a larger record has a file of its own.
FILE_BYTES = 16 << 20
#: Payloads below this size are never replaced by a revisit.
REVISIT_BYTES = 1000
#: Revisit decisions up to this size are sent to all tasks; above, files and decisions are joined by file.
SENT_BYTES = 32 << 20
DECISION_BYTES = 96

FIELDS = {
    1: ["URL", "IP-address", "Archive-date", "Content-type", "Archive-length"],
    2: ["URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"],
}
HEADER = re.compile(rb"[^\x00-\x20]+(?: [^\x00-\x20]+)? [0-9]{4,14} \S.* [0-9]+\Z")
DATE = re.compile(r"[0-9]{4,14}\Z")
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DECISIONS = "array<struct<offset:bigint,refers_to:bigint,target:string>>"


@dataclass(frozen=True)
class ArcRecord:
    offset: int
    url: str
    ip: str
    date: str
    content_type: str
    block: bytes
    truncated: bool

    @property
    def kind(self) -> str:
        """The WARC record type that says the same."""
        if self.url.startswith("filedesc:"):
            return "warcinfo"
        return "response" if self.block.startswith(b"HTTP/") else "resource"

    @property
    def head(self) -> bytes:
        """The protocol header of a response, with its empty line."""
        if self.kind != "response":
            return b""
        found = re.search(rb"\r?\n\r?\n", self.block)
        return self.block[: found.end()] if found else self.block

    @property
    def payload(self) -> bytes:
        return self.block[len(self.head) :]

    @property
    def timestamp(self) -> str:
        """The 14-digit date as an ISO timestamp; missing digits count as the earliest time."""
        d = (self.date + "00000101000000"[len(self.date) :])[:14]
        return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:]}Z"

    def identifier(self, file: str) -> str:
        """Always the same for the same record of the same file."""
        name = f"{file}#{self.offset}#{self.url}#{self.date}#{hashlib.sha1(self.block).hexdigest()}"
        return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>"


def arc_field(text: str | None, empty: str = "-") -> str:
    """A header field: blanks and control characters percent-encoded."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m.group()):02X}", text) if text else empty


def arc_record(version: int, url: str, ip: str, date: str, content_type: str, block: bytes, offset: int = 0, filename: str = "-") -> bytes:
    values = [url, ip, date, content_type]
    if version == 2:
        values += ["200", hashlib.md5(block).hexdigest(), "-", str(offset), filename]
    return " ".join([*values, str(len(block))]).encode() + b"\n" + block + b"\n"


def arc_opening(version: int, filename: str, date: str) -> bytes:
    body = f"{version} 0 dealgrain\n{' '.join(FIELDS[version])}\n".encode()
    return arc_record(version, f"filedesc://{filename}", "0.0.0.0", date, "text/plain", body, 0, filename)


def read_arc(data: bytes) -> Iterator[ArcRecord]:
    """The records of one file. A line that is no header is skipped; a record cut short is marked truncated."""
    version, at = 1, 0
    while at < len(data):
        stop = data.find(b"\n", at)
        stop = len(data) if stop < 0 else stop
        line = data[at:stop].rstrip(b"\r")
        if not HEADER.match(line):
            at = stop + 1
            continue
        parts = line.decode("utf-8", "replace").split(" ")
        if DATE.match(parts[1]):  # a header without an address: the date follows the URL
            parts.insert(1, "-")
        size = int(parts[-1])
        block = data[stop + 1 : stop + 1 + size]
        opening = parts[0].startswith("filedesc:")
        if opening:
            declared = block.split(b"\n")[0].split(b" ")[0]
            version = int(declared) if declared in (b"1", b"2") else 1
        # The content type may hold blanks, so the fields after it are counted from the end.
        tail = len(FIELDS[version]) - 4 if len(parts) >= len(FIELDS[version]) else 1
        yield ArcRecord(at, parts[0], parts[1], parts[2], " ".join(parts[3 : len(parts) - tail]), block, len(block) < size)
        at = stop + 1 + size
        at += data[at : at + 2] == b"\r\n" and 2 or data[at : at + 1] == b"\n" and 1 or 0


def sha1_label(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def warc_record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    """One record; the text writer adds the last line feed."""
    lines = ["WARC/1.1", *[f"{k}: {v}" for k, v in fields], f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def convert(record: ArcRecord, file: str, refers_to: tuple[int, str] | None = None) -> bytes:
    """The WARC record of an ARC record; with ``refers_to`` (source id and identifier) a revisit without payload."""
    kind, block = record.kind, record.block
    fields = [("WARC-Type", "revisit" if refers_to else kind), ("WARC-Record-ID", record.identifier(file)), ("WARC-Date", record.timestamp)]
    if kind == "warcinfo":
        return warc_record([*fields, ("WARC-Filename", record.url[len("filedesc://") :]), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n")
    fields += [("WARC-Target-URI", record.url)]
    if record.ip not in ("-", "0.0.0.0"):
        fields.append(("WARC-IP-Address", record.ip))
    if record.truncated:
        fields.append(("WARC-Truncated", "unspecified"))
    fields.append(("WARC-Payload-Digest", sha1_label(record.payload)))
    if refers_to:
        block = record.head
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", refers_to[1]), ("X-Refers-To-Source", str(refers_to[0]))]
    fields.append(("WARC-Block-Digest", sha1_label(block)))
    fields.append(("Content-Type", "application/http; msgtype=response" if kind == "response" else record.content_type))
    return warc_record(fields, block)


def read_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (lower-case names) and block of every record, by declared lengths."""
    at = 0
    while (at := data.find(b"WARC/1.", at)) >= 0:
        stop = data.index(b"\r\n\r\n", at)
        lines = data[at:stop].decode("utf-8", "replace").split("\r\n")[1:]
        fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
        size = int(fields["content-length"])
        yield fields, data[stop + 4 : stop + 4 + size]
        at = stop + 4 + size


def unpacked(content: bytes) -> bytes:
    """The bytes of a file, whether plain or made of gzip members."""
    if content[:2] != b"\x1f\x8b":
        return content
    out = []
    while content[:2] == b"\x1f\x8b":
        member = zlib.decompressobj(31)
        out.append(member.decompress(content) + member.flush())
        content = member.unused_data
    return b"".join(out)


def _write_files(files: DataFrame, path: str) -> None:
    """One file per row of a binary column."""
    text = files.select(F.col(files.columns[0]).cast("string").alias("value"))
    text.write.option("maxRecordsPerFile", 1).option("compression", "gzip").mode("errorifexists").text(path)


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")


def _new_path(spark: SparkSession, label: str) -> str:
    return f"{work_folder(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def write_arc(
    df: DataFrame, id_column: str = "page_id", url_column: str = "url", html_column: str = "html",
    path: str | None = None, versions: tuple[int, ...] = (1,), date: str = "20000101000000", file_bytes: int = FILE_BYTES,
) -> str:
    """Pages as ARC files of about ``file_bytes`` each, of the given header versions in turn; returns their folder.

    A page is a response whose header names its id; null html is an empty payload, a null id is left out of the header and
    a null url is written as a dash. An empty table gives a folder without archives.
    """
    source = pick(df, page_id=id_column, url=url_column, html=html_column).select(F.col("page_id").cast("bigint").alias("page_id"), "url", F.col("html").cast("binary").alias("html"))
    path = path or _new_path(df.sparkSession, "arc")

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, held, size = TaskContext.get().partitionId(), 0, [], 0
        version = versions[0]
        for batch in batches:
            for page, url, html in zip(*(batch.column(i) for i in range(3))):
                if not held:
                    version = versions[(part + number) % len(versions)]
                    name = f"part-{part:05d}-{number:05d}.arc"
                    held = [arc_opening(version, name, date)]
                    size = len(held[0])
                payload = html.as_py() or b""
                own = f"X-Source-Id: {page.as_py()}\r\n" if page.is_valid else ""
                head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n{own}Content-Length: {len(payload)}\r\n\r\n"
                held.append(arc_record(version, arc_field(url.as_py()), "-", date, "text/html", head.encode() + payload, size, name))
                size += len(held[-1])
                if size >= file_bytes:
                    yield _one_file(held)
                    number, held = number + 1, []
        if held:
            yield _one_file(held)

    _write_files(source.mapInArrow(assemble, "file binary"), path)
    return path


def _one_file(records: list[bytes]) -> pa.RecordBatch:
    # The text writer ends a file with the line feed that the last record ends with.
    return pa.RecordBatch.from_arrays([pa.array([b"".join(records)[:-1]], pa.binary())], names=["file"])


def _source_id(head: bytes) -> int | None:
    found = re.search(rb"^X-Source-Id: (-?[0-9]+)\r?$", head, re.M)
    return int(found.group(1)) if found else None


def arc_index(spark: SparkSession, path: str) -> DataFrame:
    """One row per ARC record but the opening ones: path, offset, identifier, source_id, payload_bytes, digest."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                rows = []
                for r in read_arc(unpacked(content.as_py())):
                    if r.kind != "warcinfo":
                        rows.append((file, r.offset, r.identifier(file), _source_id(r.head), len(r.payload), hashlib.sha1(r.payload).digest()))
                names = ["path", "offset", "identifier", "source_id", "payload_bytes", "digest"]
                types = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array([row[i] for row in rows], t) for i, t in enumerate(types)], names=names)

    return _files(spark, path).mapInArrow(scan, "path string, offset bigint, identifier string, source_id bigint, payload_bytes bigint, digest binary")


def revisits(index: DataFrame, least: int = REVISIT_BYTES) -> DataFrame:
    """Records that repeat the payload of another: path, offset, refers_to and target (the kept record).

    Of records with equal payloads of at least ``least`` bytes the one with the largest id is kept, the later one in its
    file if ids are equal; null ids come last.
    """
    large = index.where(F.col("payload_bytes") >= least)
    place = F.struct(F.col("source_id").isNotNull().alias("known"), "source_id", "path", "offset", "identifier")
    kept = large.groupBy("digest", "payload_bytes").agg(F.max(place).alias("_kept"), F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n")
    joined = large.join(kept, ["digest", "payload_bytes"])
    other = (F.col("path") != F.col("_kept.path")) | (F.col("offset") != F.col("_kept.offset"))
    return joined.where(other).select("path", "offset", F.col("_kept.source_id").alias("refers_to"), F.col("_kept.identifier").alias("target"))


def convert_archives(spark: SparkSession, arc_path: str, path: str | None = None, least: int = REVISIT_BYTES) -> str:
    """ARC files as WARC files with the same records, one file each; returns their folder."""
    path = path or _new_path(spark, "warc")
    found = materialise(revisits(materialise(arc_index(spark, arc_path), "index"), least), "revisits")
    row = F.struct("offset", "refers_to", "target")
    decisions = found.groupBy("path").agg(F.collect_list(row).cast(DECISIONS).alias("decisions"))  # at most the records of one file
    if found.count() * DECISION_BYTES <= SENT_BYTES:
        decisions = F.broadcast(decisions)
    files = _files(spark, arc_path).join(decisions, "path", "left")

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content, decided in zip(*(batch.column(c) for c in ("path", "content", "decisions"))):
                refers = {d["offset"]: (d["refers_to"], d["target"]) for d in decided.as_py() or ()}
                name = file.as_py()
                yield _one_file([convert(r, name, refers.get(r.offset)) for r in read_arc(unpacked(content.as_py()))])

    _write_files(files.mapInArrow(rewrite, "file binary"), path)
    return path


def read_warc_files(spark: SparkSession, path: str) -> DataFrame:
    """One row per response, resource or revisit record: source_id, identifier, url, date, payload_bytes, payload_digest
    (hex SHA-1 of the full payload), record_type, refers_to (source id of the kept record) and digest_ok (null for revisits)."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                rows = []
                for fields, block in read_warc(unpacked(content.as_py())):
                    kind = fields["warc-type"]
                    if kind == "warcinfo":
                        continue
                    found = re.search(rb"\r?\n\r?\n", block) if block.startswith(b"HTTP/") else None
                    head = block[: found.end()] if found else b""
                    payload = block[len(head) :]
                    declared = re.search(rb"^Content-Length: ([0-9]+)\r?$", head, re.M)
                    size = int(declared.group(1)) if kind == "revisit" and declared else len(payload)
                    digest = base64.b32decode(fields["warc-payload-digest"].partition(":")[2])
                    good = None if kind == "revisit" else hashlib.sha1(payload).digest() == digest
                    target = fields.get("x-refers-to-source", "None")
                    rows.append((_source_id(head), fields["warc-record-id"], fields["warc-target-uri"], fields["warc-date"], size, digest.hex(), kind, None if target == "None" else int(target), good))
                names = ["source_id", "identifier", "url", "date", "payload_bytes", "payload_digest", "record_type", "refers_to", "digest_ok"]
                types = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.bool_()]
                yield pa.RecordBatch.from_arrays([pa.array([row[i] for row in rows], t) for i, t in enumerate(types)], names=names)

    schema = "source_id bigint, identifier string, url string, date string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, digest_ok boolean"
    return _files(spark, path).mapInArrow(scan, schema)
