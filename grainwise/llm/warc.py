"""Web archives: ARC 1 and 2 records in, WARC 1.1 records out and back.

An ARC file is a version block and then URL records, each a header line whose
fields depend on the version, a block of the declared length, and a newline.
The converter walks the file by declared lengths alone, so nothing in a payload
can be taken for a header. From each record it synthesises a WARC record:
identifier (a name-based UUID of URL, date and digest), date, type and SHA-1
digests in base32.

Files may be plain or gzip with any number of members; one is unpacked as a
stream, so a task holds its packed bytes and one record. Written files
have one gzip member a record, as the format wants it. They go through
Spark's text writer, so executors write them to any file system that Spark
knows: a row is the members of one file, and what the writer puts after a row is
an empty member. Spark names the files .txt; their content is that of .warc.gz.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import BinaryIO
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import checkpointed

# The field names of URL record lines, by ARC version.
ARC_FIELDS = {
    "1": ("URL", "IP-address", "Archive-date", "Content-type", "Archive-length"),
    "2": (
        "URL", "IP-address", "Archive-date", "Content-type", "Result-code",
        "Checksum", "Location", "Offset", "Filename", "Archive-length",
    ),
}
IDENTICAL = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
ARCHIVE_BYTES = 16 << 20
EPOCH = "20000101000000"
TYPE_OF_SCHEME = {"dns": "resource", "filedesc": "warcinfo", "http": "response", "https": "response"}
END = b"\r\n\r\n"
GZIP = b"\x1f\x8b"
HEADER_BYTES = 1 << 20  # more without a line's end is no header


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def base32_of_hex(digest: Column) -> Column:
    """Base32 of a digest given in hex, 20 bits (5 digits) at a time."""

    def letters(group: Column) -> Column:
        value = F.conv(F.substr(digest, group * 5 + 1, F.lit(5)), 16, 10).cast("int")
        picked = [F.substr(F.lit(BASE32), F.shiftright(value, s).bitwiseAND(31) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
        return F.concat(*picked)

    return F.concat_ws("", F.transform(F.sequence(F.lit(0), F.lit(7)), letters))


# The names of WARC headers as they are usually written; names mean the same in any case.
CANONICAL = {name.lower(): name for name in (
    "WARC-Type", "WARC-Record-ID", "WARC-Date", "Content-Length", "Content-Type", "WARC-Target-URI", "WARC-IP-Address",
    "WARC-Block-Digest", "WARC-Payload-Digest", "WARC-Profile", "WARC-Refers-To", "WARC-Refers-To-Target-URI",
    "WARC-Refers-To-Date", "WARC-Filename", "WARC-Truncated",
)}


# --- ARC ---


@dataclass
class ArcRecord:
    version: str
    fields: dict[str, str]
    block: bytes


def arc_version_block(version: str, name: str) -> bytes:
    """The record that opens an ARC file: its name, the version line and the field names of later lines."""
    if version not in ARC_FIELDS:
        raise ValueError(f"no ARC version {version}")
    body = f"{version} 0 grainwise\n{' '.join(ARC_FIELDS[version])}\n".encode()
    line = arc_line(version, f"filedesc://{name}", "text/plain", len(body))
    return line + body + b"\n"


def arc_line(version: str, url: str, content_type: str, length: int, status: int = 200, digest: str = "-") -> bytes:
    fields = [url, "0.0.0.0", EPOCH, content_type]
    if version == "2":
        fields += [str(status), digest, "-", "0", "-"]
    return (" ".join([*fields, str(length)]) + "\n").encode()


def opened(source: bytes | BinaryIO) -> BinaryIO:
    """A stream of an archive's plain bytes; all members of a packed one follow each other."""
    stream = io.BytesIO(source) if isinstance(source, bytes) else source
    packed = stream.read(2) == GZIP
    stream.seek(0)
    return io.BufferedReader(gzip.GzipFile(fileobj=stream)) if packed else stream


def _line(stream: BinaryIO, what: str, at: int) -> bytes:
    line = stream.readline(HEADER_BYTES)
    if line and not line.endswith(b"\n"):
        raise ValueError(f"unfinished {what} at byte {at}")
    return line


def _text(line: bytes) -> str:
    """Old archives hold addresses in other encodings than UTF-8."""
    try:
        return line.decode("utf-8")
    except UnicodeDecodeError:
        return line.decode("latin-1")


def arc_fields(names: tuple[str, ...], line: str) -> dict[str, str] | None:
    """The fields of a URL record line; None if there are too few.

    Content types may hold spaces before a parameter, and so may old addresses: the fields after the content
    type are counted from the end, and the date is the first field of 14 digits if the third is no number.
    """
    parts = line.split(" ")
    after = len(names) - 4
    if len(parts) < len(names):
        return None
    date = 2
    if not parts[2].isdigit() and parts[2] != "-":
        date = next((i for i in range(3, len(parts) - after - 1) if len(parts[i]) == 14 and parts[i].isdigit()), 2)
    kind = " ".join(parts[date + 1 : len(parts) - after])
    return dict(zip(names, [" ".join(parts[: date - 1]), parts[date - 1], parts[date], kind, *parts[len(parts) - after :]]))


def parse_arc(source: bytes | BinaryIO) -> Iterator[ArcRecord]:
    """The records of an ARC file, plain or packed, its version block first.

    The version is read from the opening record's second line and decides how
    many fields each later line has. A line with fewer fields, or a
    block shorter than declared, is an error: lengths after it mean nothing.
    """
    stream = opened(source)
    at, version = 0, None
    while header := _line(stream, "ARC header line", at):
        if not header.strip(b"\r\n"):  # the newline that ends a record
            at += len(header)
            continue
        line = _text(header).rstrip("\r\n")
        length = line.rpartition(" ")[2]
        if not length.isdigit():
            raise ValueError(f"no length in the ARC header line at byte {at}")
        block = stream.read(int(length))
        if len(block) != int(length):
            raise ValueError(f"ARC record at byte {at} is shorter than declared")
        if version is None:
            version = block.split(b" ", 1)[0].decode("latin-1")
            if version not in ARC_FIELDS:
                raise ValueError(f"no ARC version {version!r}")
        # The opening line of a version 2 file may have the fields of version 1.
        opening = line.startswith("filedesc:") and len(line.split(" ")) == len(ARC_FIELDS["1"])
        found = arc_fields(ARC_FIELDS["1"] if opening else ARC_FIELDS[version], line)
        if found is None:
            raise ValueError(f"too few fields in the ARC header line at byte {at}, {len(ARC_FIELDS[version])} expected")
        yield ArcRecord(version, found, block)
        at += len(header) + len(block)


# --- WARC ---


@dataclass
class WarcRecord:
    headers: dict[str, str]
    block: bytes = b""
    version: str = field(default="WARC/1.1")

    def to_bytes(self) -> bytes:
        """The record without the two line breaks that end it."""
        named = {**self.headers, "Content-Length": str(len(self.block))}
        lines = [self.version, *(f"{k}: {v}" for k, v in named.items())]
        return "\r\n".join(lines).encode() + END + self.block


def parse_warc(source: bytes | BinaryIO) -> Iterator[WarcRecord]:
    """The records of a WARC file, plain or packed, found by their declared lengths."""
    stream = opened(source)
    at = 0
    while line := _line(stream, "WARC header", at):
        if not line.strip(b"\r\n"):
            at += len(line)
            continue
        version, start = _text(line).strip(), at
        if not version.startswith("WARC/"):
            raise ValueError(f"no WARC version at byte {at}")
        at += len(line)
        headers: dict[str, str] = {}
        name = ""
        while line := _line(stream, "WARC header", start):
            at += len(line)
            text = _text(line).rstrip("\r\n")
            if not text:
                break
            if text[0] in " \t" and name:  # a value that goes on
                headers[name] += " " + text.strip()
                continue
            name, _, value = text.partition(":")
            name = CANONICAL.get(name.strip().lower(), name.strip())
            headers[name] = value.strip()
        else:
            raise ValueError(f"unfinished WARC header at byte {start}")
        length = headers.pop("Content-Length", "")
        if not length.isdigit():
            raise ValueError(f"no length in the WARC header at byte {start}")
        block = stream.read(int(length))
        if len(block) != int(length):
            raise ValueError(f"WARC record at byte {start} is shorter than declared")
        at += len(block)
        yield WarcRecord(headers, block, version)


def split_http(block: bytes) -> tuple[bytes, bytes]:
    """HTTP header (with its blank line) and payload of a record's block; no header if there is none."""
    if not block.startswith(b"HTTP/"):
        return b"", block
    stop = block.find(END)
    return (block, b"") if stop < 0 else (block[: stop + 4], block[stop + 4 :])


def _http_length(header: bytes) -> int | None:
    for line in header.decode("latin-1").split("\r\n"):
        name, _, value = line.partition(":")
        if name.lower() == "content-length" and value.strip().isdigit():
            return int(value)
    return None


def warc_date(arc_date: str) -> str:
    """ISO 8601 from an ARC date of 14 digits, or of fewer, the missing ones being the earliest."""
    digits = (arc_date + "00000101000000"[len(arc_date) :])[:14] if arc_date.isdigit() else EPOCH
    return f"{digits[:4]}-{digits[4:6]}-{digits[6:8]}T{digits[8:10]}:{digits[10:12]}:{digits[12:14]}Z"


def record_id(url: str, date: str, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{url} {date} {digest}')}>"


def to_warc(record: ArcRecord, original: str | None = None) -> WarcRecord:
    """The WARC record equivalent to an ARC record.

    The type follows the URL's scheme: ``filedesc`` opens the file (warcinfo),
    web pages are responses, all else are resources. With ``original``, the URL
    of an earlier record with the same payload, it becomes a revisit of that
    record, which keeps the HTTP header and drops the payload.
    """
    url, date = record.fields["URL"], warc_date(record.fields["Archive-date"])
    kind = TYPE_OF_SCHEME.get(url.split(":", 1)[0], "resource")
    header, payload = split_http(record.block)
    digest = base32_sha1(payload)
    headers = {"WARC-Type": kind, "WARC-Record-ID": record_id(url, date, digest), "WARC-Date": date}
    block = record.block
    if kind == "warcinfo":
        headers |= {"WARC-Filename": url.split("://", 1)[-1], "Content-Type": "application/warc-fields"}
        block = f"software: grainwise\r\nformat: WARC File Format 1.1\r\ndescription: from ARC version {record.version}\r\n".encode()
    else:
        headers |= {"WARC-Target-URI": url, "WARC-IP-Address": record.fields["IP-address"]}
        headers |= {"WARC-Payload-Digest": f"sha1:{digest}"}
        if kind == "response" and original is not None:
            headers |= {
                "WARC-Type": "revisit",
                "WARC-Profile": IDENTICAL,
                "WARC-Refers-To": record_id(original, date, digest),
                "WARC-Refers-To-Target-URI": original,
                "WARC-Refers-To-Date": date,
            }
            block = header
        headers["Content-Type"] = "application/http; msgtype=response" if header else record.fields["Content-type"]
    headers["WARC-Block-Digest"] = f"sha1:{base32_sha1(block)}"
    return WarcRecord(headers, block)


# --- Pages ---


def page_url(url: str | None, page_id: int | None) -> str:
    """The page's address as an ARC field: no white space or controls, the page's number as its fragment."""
    address = quote(url or "", safe=";/?:@&=+$,-_.!~*'()%")
    if address.split(":", 1)[0] not in ("http", "https"):
        address = "http://unknown.invalid/" + address
    return f"{address}#{'' if page_id is None else page_id}"


def page_of(uri: str) -> int | None:
    number = uri.rpartition("#")[2]
    return int(unquote(number)) if number else None


def page_arc(version: str, page_id: int | None, url: str | None, payload: bytes) -> bytes:
    """One page as an ARC record."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n"
    block = http.encode() + payload
    return arc_line(version, page_url(url, page_id), "text/html", len(block)) + block + b"\n"


def first_pages(pages: DataFrame, revisit_from: int) -> DataFrame:
    """(digest, bytes, first, first_url): the smallest page of every payload that more than one page has.

    Partial aggregation on each task leaves one row of a payload, however many
    pages share it.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    page = F.struct(F.col("page_id").isNull(), "page_id", "url")  # pages without id come last
    keyed = pages.select(page.alias("page"), F.sha1(payload).alias("digest"), F.octet_length(payload).alias("bytes"))
    found = keyed.filter(F.col("bytes") >= revisit_from).groupBy("digest", "bytes")
    found = found.agg(F.min("page").alias("page"), F.count("*").alias("n")).filter("n > 1")
    return found.select("digest", "bytes", F.col("page.page_id").alias("first"), F.col("page.url").alias("first_url"))


def packed(record: bytes) -> bytes:
    """One record as a gzip member of its own; the same record gives the same bytes."""
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress(record) + pack.flush()


def _write_archives(archives: DataFrame, path: str) -> None:
    """A file for each row of ``value``, packed records, closed by an empty member."""
    empty = packed(b"").decode("latin-1")
    writer = archives.select(F.col("value").cast("string").alias("value")).write.mode("overwrite")
    writer.option("maxRecordsPerFile", 1).option("encoding", "ISO-8859-1").option("lineSep", empty).text(path)


class _Archive:
    """Packed records of one file to be."""

    def __init__(self) -> None:
        self.parts: list[bytes] = []
        self.size = 0

    def add(self, record: WarcRecord) -> None:
        self.parts.append(packed(record.to_bytes() + END))
        self.size += len(self.parts[-1])

    def row(self) -> pa.RecordBatch:
        found = pa.RecordBatch.from_arrays([pa.array([b"".join(self.parts)], type=pa.binary())], names=["value"])
        self.parts, self.size = [], 0
        return found


def write_warc(pages: DataFrame, path: str, arc_version: str = "2", revisit_from: int = 0, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Write one WARC record per page into files under ``path``.

    Each task first lays its pages out as ARC records and then converts those. Of
    pages with equal payloads of at least ``revisit_from`` bytes, all but that
    with the smallest id become revisits of it; shorter ones are all responses. Each
    archive is a file of its own made of about ``archive_bytes`` of ARC records, or one record if
    that is longer. A null page has an empty payload; rows with the same id and
    payload are responses alike; a page without id revisits one that has
    an id. An empty table leaves no records.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    keyed = pages.select("page_id", "url", payload.alias("payload"))
    keyed = keyed.select("*", F.sha1("payload").alias("digest"), F.octet_length("payload").alias("bytes"))
    # Its own table, so that the join below can split a payload with very many pages.
    rows = keyed.join(checkpointed(first_pages(pages, revisit_from)), ["digest", "bytes"], "left")
    is_revisit = F.col("first").isNotNull() & (F.col("page_id").isNull() | (F.col("page_id") != F.col("first")))
    rows = rows.select("page_id", "url", "payload", F.when(is_revisit, F.col("first")).alias("first"), "first_url")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, parts, size, originals = 0, [], 0, []

        def archive() -> pa.RecordBatch:
            opening, *records = parse_arc(b"".join(parts))
            out = _Archive()
            out.add(to_warc(opening))
            for record, original in zip(records, originals, strict=True):
                out.add(to_warc(record, original))
            return out.row()

        for batch in batches:
            for row in range(batch.num_rows):
                page_id, url, html, first, first_url = (batch.column(c)[row].as_py() for c in range(5))
                record = page_arc(arc_version, page_id, url, html)
                if parts and size + len(record) > archive_bytes:
                    yield archive()
                    number, parts, size, originals = number + 1, [], 0, []
                if not parts:
                    parts.append(arc_version_block(arc_version, f"pages-{number}.arc"))
                parts.append(record)
                originals.append(None if first is None else page_url(first_url, first))
                size += len(record)
        if parts:
            yield archive()

    _write_archives(rows.mapInArrow(run, "value binary"), path)


def _files(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path).select("path", "content")


def convert_arc(spark: SparkSession, arc_path: str, path: str, pattern: str = "*.arc*", archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Convert the ARC files under ``arc_path``, plain or gzip, to WARC files under ``path``.

    Every record becomes one of its own: payloads are kept byte for byte, and none becomes a revisit, as ARC has
    none. A file is one task's work; its records fill files of about ``archive_bytes``, each
    opened by the file's own version block. Without ARC files there are no WARC files.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                out, opening = _Archive(), None
                for record in parse_arc(batch.column("content")[row].as_py()):
                    converted = to_warc(record)
                    opening = opening or converted
                    if out.size > archive_bytes:
                        yield out.row()
                        out.add(opening)
                    out.add(converted)
                if out.parts:
                    yield out.row()

    _write_archives(_files(spark, arc_path, pattern).mapInArrow(run, "value binary"), path)


#: Name and type of what read_records returns.
RECORD = {
    "path": pa.string(), "record_id": pa.string(), "record_type": pa.string(), "url": pa.string(), "date": pa.string(),
    "content_type": pa.string(), "http_header": pa.binary(), "payload": pa.binary(), "payload_bytes": pa.int64(),
    "payload_digest": pa.string(), "refers_to": pa.string(), "refers_to_url": pa.string(),
}
RECORD_ROWS, RECORD_BYTES = 256, 8 << 20


def _record_row(path: str, record: WarcRecord) -> tuple:
    get = record.headers.get
    header, payload = split_http(record.block)
    if get("WARC-Type") == "revisit":
        declared = get("WARC-Payload-Digest") or ""
        size, digest, payload = _http_length(header), declared.removeprefix("sha1:") or None, None
    else:
        size, digest = len(payload), base32_sha1(payload)
    return (
        path, get("WARC-Record-ID"), get("WARC-Type"), get("WARC-Target-URI"), get("WARC-Date"), get("Content-Type"),
        header, payload, size, digest, get("WARC-Refers-To"), get("WARC-Refers-To-Target-URI"),
    )


def _record_batches(path: str, records: Iterator[WarcRecord]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema(list(RECORD.items()))
    rows, size = [], 0
    for record in records:
        rows.append(_record_row(path, record))
        size += len(record.block)
        if len(rows) == RECORD_ROWS or size > RECORD_BYTES:
            yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*rows), RECORD.values())], schema=schema)
            rows, size = [], 0
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*rows), RECORD.values())], schema=schema)


def read_records(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """All records of the WARC and ARC files under ``path``, plain or gzip with any number of members, one row each.

    Which of both a file is shows in its first line; records of ARC files are converted. Columns: path, record_id,
    record_type, url, date, content_type, http_header, payload (bytes), payload_bytes, payload_digest (base32 SHA-1 without
    its name), refers_to and refers_to_url (of revisits). Sizes and digests are worked out from payloads;
    those of revisits, which have none, come from their headers and may be null.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                name, content = batch.column("path")[row].as_py(), batch.column("content")[row].as_py()
                if not content:
                    continue
                if opened(content).read(5) == b"WARC/":
                    records = parse_warc(content)
                else:
                    records = (to_warc(record) for record in parse_arc(content))
                yield from _record_batches(name, records)

    kinds = {pa.string(): "string", pa.binary(): "binary", pa.int64(): "bigint"}
    schema = ", ".join(f"{name} {kinds[kind]}" for name, kind in RECORD.items())
    return _files(spark, path, pattern).mapInArrow(run, schema)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """The pages of archives that ``write_warc`` wrote: response and revisit records, one row each.

    Columns: page_id, url, payload_bytes, payload_digest, record_type,
    refers_to (a page_id), html.
    """
    records = read_records(spark, path).filter(F.col("record_type").isin("response", "revisit"))

    def page(url: str) -> Column:
        number = F.element_at(F.split(url, "#"), -1)
        return F.when(number != "", number).cast("bigint")

    address = F.expr("left(url, length(url) - length(element_at(split(url, '#'), -1)) - 1)")
    html = F.col("payload").cast("string")
    return records.select(
        page("url").alias("page_id"), address.alias("url"), "payload_bytes", "payload_digest", "record_type",
        page("refers_to_url").alias("refers_to"), html.alias("html"),
    )
