"""Converting legacy ARC archives to WARC, with revisit records for equal payloads.

``parse_arc`` reads ARC files of both versions: the version block of the ``filedesc://`` record says which
URL-record fields a header line has (5 in version 1, 10 in version 2), and each record's last field
declares its length. ``warc_record`` synthesises the WARC equivalent: a record id (a name-based UUID of
what identifies the capture), an ISO-8601 date from the 14-digit one, the record type, and SHA-256 digests.

Spark finds which records repeat an earlier payload (a group and a join on the digest), tasks write
archives of one gzip member per record to a shared folder, and a manifest names the files that count.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cuemill.llm._common import broadcast_if_small, materialize, put_file, scratch_path

FILE_BYTES = 16 << 20
#: Shorter payloads are always written in full.
REVISIT_BYTES = 100
#: Fixed values of the formats: fields of a URL record in ARC versions 1 and 2, and the revisit profile.
ARC_FIELDS = {
    1: ["URL", "IP-address", "Archive-date", "Content-type", "Archive-length"],
    2: ["URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"],
}
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_SPACE = uuid.uuid5(uuid.NAMESPACE_URL, "urn:cuemill:warc")


@dataclass
class ArcRecord:
    url: str
    ip: str
    date: str
    mime: str
    block: bytes
    version: int

    @property
    def payload(self) -> bytes:
        """What follows the HTTP header; the whole block of other protocols."""
        head, blank, rest = self.block.partition(b"\r\n\r\n")
        return rest if blank and head.startswith(b"HTTP/") else self.block

    @property
    def http_head(self) -> bytes:
        return self.block[: len(self.block) - len(self.payload)]


def arc_header(version: int, name: str, date: str) -> bytes:
    """The ``filedesc://`` record that begins a file."""
    lines = f"{version} 0 cuemill\n{' '.join(ARC_FIELDS[version])}\n\n".encode()
    values = ["filedesc://" + name, "0.0.0.0", date, "text/plain"] + (["200", "-", "-", "0", name] if version == 2 else [])
    return " ".join([*values, str(len(lines))]).encode() + b"\n" + lines


def arc_record(version: int, url: str, ip: str, date: str, mime: str, block: bytes, name: str = "-", offset: int = 0) -> bytes:
    clean = "".join(c if 32 < ord(c) < 127 else "".join(f"%{b:02X}" for b in c.encode("utf-8", "replace")) for c in url) or "-"
    values = [clean, ip, date, mime] + (["200", "-", "-", str(offset), name] if version == 2 else [])
    return " ".join([*values, str(len(block))]).encode() + b"\n" + block + b"\n"


def parse_arc(content: bytes) -> Iterator[ArcRecord]:
    """Records of an ARC file, without its version block. Raises ValueError where a header line or length is wrong."""
    at, version = 0, None
    while at < len(content):
        if content[at : at + 1] in (b"\n", b"\r"):
            at += 1
            continue
        end = content.find(b"\n", at)
        if end < 0:
            raise ValueError(f"no end of the header line at byte {at}")
        fields = content[at:end].decode("utf-8", "replace").rstrip("\r").split(" ")
        first = fields[0].startswith("filedesc://")
        known = {len(v): k for k, v in ARC_FIELDS.items()}
        if len(fields) not in known or not fields[-1].isdigit():
            raise ValueError(f"not a URL record at byte {at}")
        size = int(fields[-1])
        block = content[end + 1 : end + 1 + size]
        if len(block) != size:
            raise ValueError(f"{size} bytes are declared at byte {at}, {len(block)} are there")
        if first:
            version = int(block.split(b" ", 1)[0])
        elif version is not None and known[len(fields)] != version:
            raise ValueError(f"a header line of another version at byte {at}")
        else:
            yield ArcRecord(fields[0], fields[1], fields[2], fields[3], block, known[len(fields)])
        at = end + 1 + size


def record_id(*identity: object) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, chr(0).join(map(str, identity)))}>"


def warc_date(arc_date: str) -> str:
    d = (arc_date + "00000101000000"[len(arc_date) :])[:14] if arc_date.isdigit() else "19700101000000"
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def warc_record(arc: ArcRecord, key: object, refers_to: object | None = None, digest: str | None = None) -> bytes:
    """The WARC record of an ARC record; a revisit, which keeps only the HTTP header, if ``refers_to`` is given."""
    payload = arc.payload
    digest = digest or hashlib.sha256(payload).hexdigest()
    block = arc.block if refers_to is None else arc.http_head
    is_http = block.startswith(b"HTTP/")
    head = [
        ("WARC-Type", "revisit" if refers_to is not None else "response" if is_http else "resource"),
        ("WARC-Record-ID", record_id(key)),
        ("WARC-Date", warc_date(arc.date)),
        ("WARC-Target-URI", arc.url),
        ("WARC-IP-Address", arc.ip),
        ("WARC-Payload-Digest", f"sha256:{digest}"),
        ("WARC-Block-Digest", f"sha256:{digest if block is payload else hashlib.sha256(block).hexdigest()}"),
        ("X-Source-Key", str(key)),
        ("X-Payload-Length", str(len(payload))),
    ]
    if refers_to is not None:
        head += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(refers_to)), ("X-Refers-To-Key", str(refers_to))]
    head += [("Content-Type", "application/http; msgtype=response" if is_http else arc.mime), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


def gzip_member(data: bytes, level: int = 3) -> bytes:
    box = zlib.compressobj(level, zlib.DEFLATED, 31)
    return box.compress(data) + box.flush()


def gzip_members(content: bytes, step: int = 1 << 16) -> Iterator[bytes]:
    """The members' contents, in time proportional to the file: the decompressor is fed by offset."""
    view, at = memoryview(content), 0
    while at < len(view):
        box, parts = zlib.decompressobj(31), []
        while not box.eof:
            if at >= len(view):
                raise ValueError("the last gzip member is cut off")
            parts.append(box.decompress(view[at : at + step]))
            at += step
        at = min(at, len(view)) - len(box.unused_data)
        yield b"".join(parts)


def parse_warc(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields and block of every record of a file of gzip members."""
    for record in gzip_members(content):
        head, _, body = record.partition(b"\r\n\r\n")
        lines = head.decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError("not a WARC record")
        fields = dict(x.split(": ", 1) for x in lines[1:])
        yield fields, body[: int(fields["Content-Length"])]


def mark_revisits(records: DataFrame, *, key: str = "key", digest: str = "digest", size: str = "size", least: int = REVISIT_BYTES) -> DataFrame:
    """``records`` with ``refers_to``: the smallest key with an equal payload of at least ``least`` bytes, else null.

    Rows that hold the smallest key of their group (repeated rows too) refer to nothing; null keys refer to
    the smallest key, if there is one.
    """
    groups = records.where(F.col(size) >= least).groupBy(F.col(digest).alias("_d")).agg(F.min(key).alias("_first"), F.count(F.lit(1)).alias("_n"))
    repeated = materialize(groups.where("_n > 1 AND _first IS NOT NULL").select("_d", "_first"), "revisits")
    later = (F.col(size) >= least) & (F.col(key).isNull() | (F.col(key) > F.col("_first")))
    return records.join(repeated, F.col(digest) == F.col("_d"), "left").withColumn("refers_to", F.when(later, F.col("_first"))).drop("_d", "_first")


def write_warc(captures: DataFrame, folder: str) -> DataFrame:
    """Write captures (key, url, ip, date, mime, payload, digest, refers_to, version) to WARC files.

    Each task first lays its captures down as ARC records of their version, then converts those: what is
    written is what the converter made of header lines and declared lengths. Returns the manifest.
    """
    spark = captures.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made, parts, size, count = TaskContext.get().partitionId(), [], [], 0, 0

        def flush() -> None:
            nonlocal parts, size, count
            if parts:
                name = f"part-{part:06d}-{len(made):05d}-{uuid.uuid4().hex[:8]}.warc.gz"
                put_file(folder, name, b"".join(parts))
                made.append((name, count))
                parts, size, count = [], 0, 0

        for batch in batches:
            for row in zip(*(c for c in batch.columns), strict=True):
                key, url, ip, date, mime, payload, digest, refers_to, version = (x.as_py() for x in row)
                payload = payload or b""
                http = f"HTTP/1.1 200 OK\r\nContent-Type: {mime}\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
                arc = arc_header(version, "capture.arc", date) + arc_record(version, url or "", ip, date, mime, http + payload)
                for record in parse_arc(arc):
                    member = gzip_member(warc_record(record, key, refers_to, digest))
                    parts.append(member)
                    size += len(member)
                    count += 1
                if size >= FILE_BYTES:
                    flush()
        flush()
        yield pa.RecordBatch.from_arrays([pa.array([m[0] for m in made], pa.string()), pa.array([m[1] for m in made], pa.int64())], ["file", "n_records"])

    rows = captures.select("key", "url", "ip", "date", "mime", "payload", "digest", "refers_to", "version")
    rows.mapInArrow(run, "file string, n_records long").write.parquet(f"{folder}/_manifest")
    return spark.read.parquet(f"{folder}/_manifest")


def read_warc(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """Records of the files that the manifest names: key, url, date, record_id, record_type, payload_bytes, payload_digest, refers_to.

    Size and digest of a response are those of the payload as read; a mismatch with its header raises.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(folder)
    files = files.select(F.element_at(F.split("path", "/"), -1).alias("file"), "content").join(broadcast_if_small(manifest.select("file")), "file")
    names = "key long, url string, date string, record_id string, record_type string, payload_bytes long, payload_digest string, refers_to long"

    def number(x: str | None) -> int | None:
        return None if x in (None, "None") else int(x)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows = []
                for head, block in parse_warc(content.as_py()):
                    size, digest = int(head["X-Payload-Length"]), head["WARC-Payload-Digest"].removeprefix("sha256:")
                    if head["WARC-Type"] != "revisit":
                        payload = block.partition(b"\r\n\r\n")[2]
                        size, own = len(payload), hashlib.sha256(payload).hexdigest()
                        if own != digest:
                            raise ValueError(f"record {head['WARC-Record-ID']} doesn't match its digest")
                    rows.append((number(head["X-Source-Key"]), head["WARC-Target-URI"], head["WARC-Date"], head["WARC-Record-ID"], head["WARC-Type"], size, digest, number(head.get("X-Refers-To-Key"))))
                kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], [x.split()[0] for x in names.split(", ")])

    return files.select("content").mapInArrow(run, names)


def archive_pages(pages: DataFrame, *, key: str = "page_id", date: str = "20240101000000") -> DataFrame:
    """Pages (key, url, html) through ARC records to WARC files and back; odd keys use ARC version 2, even ones version 1.

    Null html is an empty payload, a null url is written as "-"; every row gets a record; an empty table
    gives no rows.
    """
    spark = pages.sparkSession
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(F.col(key).cast("long").alias("key"), "url", payload.alias("payload"))
    rows = rows.withColumns({"digest": F.sha2("payload", 256), "size": F.octet_length("payload"), "ip": F.lit("0.0.0.0"), "date": F.lit(date), "mime": F.lit("text/html;charset=UTF-8"), "version": F.pmod(F.coalesce("key", F.lit(0)), F.lit(2)).cast("int") + 1})
    folder = scratch_path(spark, "warc")
    return read_warc(spark, folder, write_warc(mark_revisits(rows), folder))


def convert_archives(spark: SparkSession, paths: list[str] | str, folder: str) -> DataFrame:
    """Convert ARC files (gzip members or plain) to WARC files in ``folder``; returns what was written, as read back.

    A record's key is its place: the file's position by path times 2^32 plus its number in the file. A file with a
    wrong header line, length or gzip member is left out as a whole; ``folder``/_refused (path, error) names it.
    """
    files = spark.read.format("binaryFile").load(paths)
    # One row a file.
    order = files.select("path").distinct().withColumn("f", F.row_number().over(Window.orderBy("path")).cast("long") - 1)
    files = files.select("path", "content").join(broadcast_if_small(materialize(order, "files")), "path")
    names = ["key", "url", "ip", "date", "mime", "payload", "version", "path", "error"]
    schema = pa.schema(list(zip(names, [pa.int64(), *[pa.string()] * 4, pa.binary(), pa.int32(), pa.string(), pa.string()], strict=True)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content, f in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                try:
                    plain = b"".join(gzip_members(content)) if content[:2] == b"\x1f\x8b" else content
                    rows = [{"key": (f << 32) + n, "url": r.url, "ip": r.ip, "date": r.date, "mime": r.mime, "payload": r.payload, "version": r.version} for n, r in enumerate(parse_arc(plain))]
                except (ValueError, zlib.error) as e:
                    rows = [{"path": path, "error": str(e)}]
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    parsed = materialize(files.select("path", "content", "f").mapInArrow(run, "key long, url string, ip string, date string, mime string, payload binary, version int, path string, error string"), "captures")
    parsed.where("error IS NOT NULL").select("path", "error").write.parquet(f"{folder}/_refused")
    rows = parsed.where("error IS NULL").drop("path", "error")
    rows = rows.withColumns({"digest": F.sha2("payload", 256), "size": F.octet_length("payload")})
    return read_warc(spark, folder, write_warc(mark_revisits(rows), folder))
