"""Legacy archives (ARC 1 and 2) and their conversion to WARC.

An ARC file is a version block followed by records; each record is one header line, whose fields the version block
declares, and as many bytes as the line's last field says. The converter takes every field by the declared names,
cuts the body by its declared length, splits an HTTP response into header and payload, and writes an equivalent WARC
record with a derived identifier, an ISO timestamp, a type and a payload digest. Of equal payloads of at least
`min_bytes` the first is a response and the others are revisits that refer to it. A record is known by its file and
its offset there, and bodies stay bytes from end to end.

WARC files go through Spark's own file system: a row of the text sink is a file, whose bytes are gzip members, one
for each record; the sink's line separator is an empty gzip member.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import re
import uuid
from typing import BinaryIO
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, lean, lookup, release, shared_path, stored

# fixed values: the field lines of the two ARC versions
FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
NAMESPACE = uuid.uuid5(uuid.NAMESPACE_URL, "urn:alignscope:warc")
#: A gzip member without content.
NOTHING = gzip.compress(b"", mtime=0)
#: Files are closed at about so many bytes: ARC files before compression, WARC files after it.
ARC_BYTES, WARC_BYTES = 4 << 20, 8 << 20


def opened(data: bytes) -> BinaryIO:
    """A stream over plain bytes or over any number of gzip members."""
    return gzip.GzipFile(fileobj=io.BytesIO(data)) if data[:2] == b"\x1f\x8b" else io.BytesIO(data)


# ---------------------------------------------------------------- ARC


def version_block(version: int, name: str, date: str) -> bytes:
    body = f"{version} 0 alignscope\n{FIELDS[version]}\n".encode()
    line = {1: f"filedesc://{name} 0.0.0.0 {date} text/plain {len(body)}", 2: f"filedesc://{name} 0.0.0.0 {date} text/plain 200 - - 0 {name} {len(body)}"}[version]
    return line.encode() + b"\n" + body + b"\n"


def arc_record(version: int, url: str, date: str, body: bytes, ip: str = "0.0.0.0", kind: str = "text/html", status: int = 200, offset: int = 0, name: str = "-") -> bytes:
    """One record; the url is percent-encoded where a field cannot hold it, and an empty one becomes `-`."""
    url = quote(url, safe="%:/?#[]@!$&'()*+,;=~") or "-"
    tail = f"{len(body)}" if version == 1 else f"{status} {hashlib.sha1(body).hexdigest()} - {offset} {name} {len(body)}"
    return f"{url} {ip} {date} {kind} {tail}".encode() + b"\n" + body + b"\n"


def _fields(line: bytes) -> list[str]:
    return line.rstrip(b"\r\n").decode("utf-8", "surrogateescape").split(" ")


def parse_arc(data: bytes):
    """Yields (offset, fields by declared name, body) of every record after the version block, read as a stream.

    offset: the byte of the record's header line in the uncompressed file. Raises ValueError on bad input.
    """
    f = opened(data)
    head = _fields(f.readline())
    if not head[0].startswith("filedesc://"):
        raise ValueError("no version block")
    block = f.read(int(head[-1])).split(b"\n")
    version = int(block[0].split(b" ")[0])
    names = block[1].decode("ascii").strip().split(" ") if len(block) > 1 else []
    if version not in FIELDS or len(names) != len(FIELDS[version].split(" ")):
        raise ValueError(f"unknown ARC version {version}")
    while True:
        at = f.tell()
        line = f.readline()
        if not line:
            return
        if not line.strip(b"\r\n"):  # records are set apart by a line end
            continue
        fields = _fields(line)
        if len(fields) != len(names):
            raise ValueError(f"{len(fields)} fields at byte {at}, {len(names)} declared")
        row = dict(zip(names, fields, strict=True))
        size = int(row["Archive-length"])
        body = f.read(size)
        if len(body) < size:
            raise ValueError(f"record at byte {at} is cut short")
        yield at, row, body


# ---------------------------------------------------------------- WARC


def iso_date(arc_date: str) -> str:
    """yyyymmddhhmmss (missing digits count as the first month, day or zero) in WARC form."""
    digits = re.sub(r"\D", "", arc_date)[:14]
    d = digits + "00000101000000"[len(digits) :]
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def record_id(name: str, offset: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'{name} {offset}')}>"


def split_http(body: bytes) -> tuple[bytes, bytes]:
    """HTTP header (with its empty line) and payload; a body without one is all payload."""
    if body.startswith(b"HTTP/") and (cut := body.find(b"\r\n\r\n")) >= 0:
        return body[: cut + 4], body[cut + 4 :]
    return b"", body


def _record(head: list[tuple[str, str]], block: bytes) -> bytes:
    lines = ["WARC/1.1", *(f"{k}: {v}" for k, v in head), f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode("utf-8", "surrogateescape") + b"\r\n\r\n" + block + b"\r\n\r\n"


def warc_record(row: dict, body: bytes, name: str, offset: int, refers_to: tuple[str, str, str] | None = None) -> bytes:
    """The WARC/1.1 record of an ARC record; with refers_to (id, url, date) a revisit without its payload."""
    http, payload = split_http(body)
    head = [
        ("WARC-Type", "revisit" if refers_to else "response"),
        ("WARC-Record-ID", record_id(name, offset)),
        ("WARC-Date", iso_date(row["Archive-date"])),
        ("WARC-Target-URI", row["URL"]),
        ("WARC-IP-Address", row["IP-address"]),
        ("WARC-Payload-Digest", f"sha256:{hashlib.sha256(payload).hexdigest()}"),
    ]
    if refers_to:
        head += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", refers_to[0]), ("WARC-Refers-To-Target-URI", refers_to[1]), ("WARC-Refers-To-Date", refers_to[2])]
    head.append(("Content-Type", "application/http; msgtype=response" if http else row["Content-type"]))
    return _record(head, http if refers_to else body)


def warcinfo(name: str) -> bytes:
    """The record that describes a file of converted records; name: the ARC file of its first record."""
    return _record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", record_id(name, -1)), ("WARC-Date", iso_date("")), ("Content-Type", "application/warc-fields")], f"software: alignscope\r\nformat: WARC File Format 1.1\r\ndescription: converted from {name}\r\n".encode())


def parse_warc(data: bytes):
    """Yields (version, header fields, block) of each record, by declared lengths; raises ValueError on bad input."""
    f = opened(data)
    at = 0
    while first := f.readline():
        if not first.startswith(b"WARC/"):
            raise ValueError(f"no record at byte {at}")
        head = {}
        while (line := f.readline()) not in (b"\r\n", b""):
            k, _, v = line.rstrip(b"\r\n").decode("utf-8", "surrogateescape").partition(": ")
            head[k] = v
        size = int(head["Content-Length"])
        block = f.read(size)
        if len(block) < size or f.read(4) != b"\r\n\r\n":
            raise ValueError(f"record at byte {at} is cut short")
        yield first.strip().decode("ascii"), head, block
        at = f.tell()


# ---------------------------------------------------------------- DataFrames


def pages_to_arc(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", version: int | None = None, file_bytes: int = ARC_BYTES) -> DataFrame:
    """(name, arc): ARC files of many records, a gzip member each, closed at about file_bytes; versions 1 and 2 take turns unless given.

    The HTTP header in a body names the page. Null html is empty, a null url is `-`. File names count up within a
    task, so store the result before it is read twice.
    """

    def run(batches):
        task = TaskContext.get()
        part, n = task.partitionId() if task else 0, 0

        def closed():
            return pa.RecordBatch.from_arrays([pa.array([name], pa.string()), pa.array([b"".join(members)], pa.binary())], ["name", "arc"])

        members: list[bytes] = []
        size = 0
        for batch in batches:
            for page, url, html in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                date = f"{20000101000000 + (page or 0) % 28 * 1000000}"
                if not members:
                    name, v = f"pages-{part:06}-{n:06}.arc", version or 1 + (part + n) % 2
                    raw = version_block(v, name, date)
                    members, size, n = [gzip.compress(raw, 1, mtime=0)], len(raw), n + 1
                known = f"X-Page-Id: {page}\r\n" if page is not None else ""
                payload = (html or "").encode("utf-8", "surrogatepass")
                body = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n{known}\r\n".encode() + payload
                raw = arc_record(v, url or "", date, body, offset=size, name=name)
                members.append(gzip.compress(raw, 1, mtime=0))
                size += len(raw)
                if size >= file_bytes:
                    yield closed()
                    members = []
        if members:
            yield closed()

    return pages.select(F.col(id_col).cast("long"), url_col, html_col).mapInArrow(lean(run), "name string, arc binary")


_META = "name string, offset long, url string, date string, page_id long, payload_digest string, payload_bytes long"
_META_KINDS = pa.schema([("name", pa.string()), ("offset", pa.int64()), ("url", pa.string()), ("date", pa.string()), ("page_id", pa.int64()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64())])


def _page(http: bytes) -> int | None:
    found = re.search(rb"\r\nX-Page-Id: (-?\d+)\r\n", http)
    return int(found[1]) if found else None


def _text(url: str) -> str:
    """A header field as valid text: bytes that are not UTF-8 percent-encoded."""
    raw = url.encode("utf-8", "surrogateescape")
    try:
        return raw.decode("utf-8")
    except UnicodeDecodeError:
        return quote(raw, safe="%:/?#[]@!$&'()*+,;=~")


def _rows(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _meta(batches):
    """What choosing responses needs to know of each ARC record."""
    for batch in batches:
        for name, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            rows = []
            for offset, row, body in parse_arc(data.as_py()):
                http, payload = split_http(body)
                rows.append((name, offset, _text(row["URL"]), iso_date(row["Archive-date"]), _page(http), hashlib.sha256(payload).hexdigest(), len(payload)))
            yield _rows(rows, _META_KINDS)


def convert(arcs: DataFrame, path: str, min_bytes: int = 100, file_bytes: int = WARC_BYTES) -> None:
    """Writes gzipped WARC files from ARC files (name, arc; plain or gzipped, any number of records) below path.

    Names of ARC files must differ. Of records with equal payloads of at least min_bytes the one with the smallest page
    id (of records without one: the first by file and offset) is a response; records that share that page id are
    responses too, all others revisits. The choice is made from digests alone (with map-side combining) and joined
    back with hot digests salted. A file begins with a warcinfo record and is closed at about file_bytes.
    """
    meta = stored(arcs.select("name", "arc").mapInArrow(lean(_meta), _META), "arc-meta")
    first = (
        meta.where(F.col("payload_bytes") >= min_bytes)
        .groupBy("payload_digest")
        .agg(F.min(F.struct(F.col("page_id").isNull().alias("none"), "page_id", "name", "offset", "url", "date")).alias("first"), F.count("*").alias("n"))
        .where("n > 1")
        .drop("n")
    )
    other = F.when(F.col("first.none"), (F.col("name") != F.col("first.name")) | (F.col("offset") != F.col("first.offset"))).otherwise(F.col("page_id").isNull() | (F.col("page_id") != F.col("first.page_id")))
    again = lookup(meta.select("name", "offset", "page_id", "payload_digest"), first, "payload_digest", "offset").where(F.col("first").isNotNull() & other)
    # the revisits of one file, whose number the file bounds
    again = again.groupBy("name").agg(F.collect_list(F.struct("offset", F.col("first.name").alias("r_name"), F.col("first.offset").alias("r_offset"), F.col("first.url").alias("r_url"), F.col("first.date").alias("r_date"))).alias("again"))
    files = arcs.select("name", "arc").join(again, "name", "left").mapInArrow(lean(_files(file_bytes)), "file binary")
    files.select(F.col("file").cast("string")).write.option("maxRecordsPerFile", 1).option("encoding", "ISO-8859-1").option("lineSep", NOTHING.decode("latin-1")).text(path)


def _files(file_bytes: int):
    """Whole WARC files, one a row; ARC files come as (name, arc, revisits)."""

    def run(batches):
        members: list[bytes] = []
        size = 0
        for batch in batches:
            for i in range(batch.num_rows):
                name = batch.column(0)[i].as_py()
                refers = {a["offset"]: (record_id(a["r_name"], a["r_offset"]), a["r_url"], a["r_date"]) for a in batch.column(2)[i].as_py() or []}
                for offset, row, body in parse_arc(batch.column(1)[i].as_py()):
                    if not members:
                        members, size = [gzip.compress(warcinfo(name), 1, mtime=0)], 0
                    members.append(gzip.compress(warc_record(row, body, name, offset, refers.get(offset)), 1, mtime=0))
                    size += len(members[-1])
                    if size >= file_bytes:
                        yield pa.RecordBatch.from_arrays([pa.array([b"".join(members)], pa.binary())], ["file"])
                        members = []
        if members:
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(members)], pa.binary())], ["file"])

    return run


_READ = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_id string, record_id string"
_READ_KINDS = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_id", pa.string()), ("record_id", pa.string())])


def _read(batches):
    for batch in batches:
        for data in batch.column(0):
            rows = []
            for _, head, block in parse_warc(data.as_py()):
                if head["WARC-Type"] not in ("response", "revisit"):
                    continue
                http, payload = split_http(block)
                revisit = head["WARC-Type"] == "revisit"
                digest = head["WARC-Payload-Digest"].removeprefix("sha256:")
                if not revisit and hashlib.sha256(payload).hexdigest() != digest:
                    raise ValueError(f"payload digest of {head['WARC-Record-ID']} does not hold")
                rows.append((_page(http), _text(unquote(head["WARC-Target-URI"], errors="surrogateescape")), None if revisit else len(payload), digest, head["WARC-Type"], head.get("WARC-Refers-To"), head["WARC-Record-ID"]))
            yield _rows(rows, _READ_KINDS)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """One row per response or revisit of the WARC files below path; payload digests of responses are verified.

    payload_bytes of a revisit is null: its payload is in the record that refers_id names.
    """
    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(lean(_read), _READ)


def resolve(records: DataFrame) -> DataFrame:
    """Adds refers_to (the page id of the response that a revisit names) to read_warc, and takes payload_bytes from there."""
    whole = records.where("record_type = 'response'").select(F.col("record_id").alias("refers_id"), F.struct("page_id", "payload_bytes").alias("whole"))
    wanted = records.where("refers_id is not null").select("refers_id").distinct()
    t = lookup(records, whole.join(wanted, "refers_id", "left_semi"), "refers_id", "record_id")
    return t.select("page_id", "url", F.coalesce("payload_bytes", "whole.payload_bytes").alias("payload_bytes"), "payload_digest", "record_type", F.col("whole.page_id").alias("refers_to"), "record_id")


def archive_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = 100) -> DataFrame:
    """Pages as ARC, converted to WARC, read back: (page_id, payload_bytes, payload_digest, record_type, refers_to, record_id).

    One row per row of pages, repeated ones too. Null html is an empty payload; payloads under min_bytes are all
    responses; a null url is `-`. Of equal payloads the smallest page id is the response (every row that has it); rows
    with a null page_id come last, and of such rows alone the first archived is the response, to which the others
    refer with a null refers_to. An empty table gives an empty table; other columns are not read.
    """
    spark = pages.sparkSession
    legacy, path = shared_path(spark, "arc"), shared_path(spark, "warc")
    pages_to_arc(pages, id_col, url_col, html_col).write.parquet(legacy)
    convert(spark.read.schema("name string, arc binary").parquet(legacy), path, min_bytes)
    discard(spark, legacy)
    release(spark)
    records = stored(read_warc(spark, path), "warc-read")
    return resolve(records).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "record_id")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_pages(spark.read.parquet(f"{sf_dir}/pages.parquet")).drop("record_id")


SQL = """
with p as (select page_id, strlen(coalesce(html, '')) as payload_bytes, sha256(coalesce(html, '')) as payload_digest from pages),
f as (select *, case when payload_bytes >= 100 then min(page_id) over (partition by payload_digest) else page_id end as first_id from p)
select page_id, payload_bytes, payload_digest, case when page_id = first_id then 'response' else 'revisit' end as record_type, case when page_id <> first_id then first_id end as refers_to from f
"""
