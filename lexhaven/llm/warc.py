"""Web archives: ARC files of versions 1 and 2 turned into WARC files.

A record's header line is read by the field list of its file's version and its body by the
declared length, so bodies may hold anything. WARC identifiers are made from what identifies a
record, times and types from the header line and the body, digests from the payload; the same
archive always gives the same records. A record whose payload another one holds becomes a revisit.

Archives are written by Spark's own writer, one row for each archive of bounded size and one
compressed member for each record; a task that runs again leaves no second copy.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexhaven.llm.common import work_folder, written

# Bytes of records in one archive, after which the next begins.
ARCHIVE_BYTES = 1 << 24
# Bytes fed to the decompressor at a time.
FEED = 1 << 14
# Shorter payloads are never revisits.
LEAST_REVISIT = 1000
# The field lists of both versions of the older format.
ARC_FIELDS = {
    1: ["URL", "IP-address", "Archive-date", "Content-type", "Archive-length"],
    2: ["URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"],
}
REVISIT_PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
PAGE_HEADER = "X-Page-Id"


def member(data: bytes) -> bytes:
    """One compressed member of an archive."""
    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def members(data: bytes) -> Iterator[bytes]:
    """Content of an archive's members one by one; zero bytes after a member are padding.

    Data is fed in small parts: what a member leaves unused of a part is copied.
    """
    at, view = 0, memoryview(data)
    while at < len(data):
        if data[at] == 0:
            at += 1
            continue
        unpacker, parts = zlib.decompressobj(31), []
        while not unpacker.eof:
            if at >= len(data):
                raise ValueError("an archive ends within a member")
            parts.append(unpacker.decompress(view[at : at + FEED]))
            at += min(FEED, len(data) - at) - len(unpacker.unused_data)
        yield b"".join(parts)


def arc_file_header(name: str, date: str, version: int = 1) -> bytes:
    body = f"{version} 0 lexhaven\n{' '.join(ARC_FIELDS[version])}\n".encode()
    fields = {"URL": f"filedesc://{name}", "IP-address": "0.0.0.0", "Archive-date": date, "Content-type": "text/plain"}
    return arc_record(fields, body, version)


def arc_record(fields: dict[str, str], body: bytes, version: int = 1) -> bytes:
    """A record with its header line; empty fields are written as a dash, white space in them as %20."""
    fields = fields | {"Archive-length": str(len(body))}
    line = " ".join(re.sub(r"\s", "%20", fields.get(name) or "-") for name in ARC_FIELDS[version])
    return line.encode() + b"\n" + body + b"\n"


def read_arc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Records of an archive after its own description: header fields and body."""
    names = ARC_FIELDS[1]
    for content in members(data) if data[:2] == b"\x1f\x8b" else [data]:
        at = 0
        while at < len(content):
            end = content.find(b"\n", at)
            if end < 0:
                break
            line = content[at:end].decode("utf-8", "replace").rstrip("\r")
            at = end + 1
            if not line:
                continue
            if line.startswith("filedesc:"):
                length = int(line.rsplit(" ", 1)[1])
                version = int(content[at : at + length].split(b" ", 1)[0])
                if version not in ARC_FIELDS:
                    raise ValueError(f"no such version of the format: {version}")
                names = ARC_FIELDS[version]
                at += length
                continue
            # An address may hold white space; all other fields do not.
            values = line.rsplit(" ", len(names) - 1)
            if len(values) != len(names) or not values[-1].isdigit():
                raise ValueError(f"not a header line: {line[:200]!r}")
            fields = dict(zip(names, values, strict=True))
            length = int(fields["Archive-length"])
            if at + length > len(content):
                raise ValueError("an archive ends within a record")
            yield fields, content[at : at + length]
            at += length


def http_parts(body: bytes) -> tuple[bytes, bytes]:
    """Header lines of a stored response, with the empty one, and its payload; no headers if there are none."""
    if not body.startswith(b"HTTP/"):
        return b"", body
    found = re.search(rb"\r?\n\r?\n", body)
    return (body[: found.end()], body[found.end() :]) if found else (body, b"")


def header_of(headers: bytes, name: str) -> str | None:
    found = re.search(rb"(?im)^" + re.escape(name.encode()) + rb"[ \t]*:[ \t]*(.*?)[ \t]*\r?$", headers)
    return found[1].decode("utf-8", "replace") if found else None


def iso_date(date: str) -> str:
    """A time as WARC writes it; what is missing of the fourteen digits is the earliest."""
    d = (re.sub(r"\D", "", date) + "00000101000000"[len(re.sub(r"\D", "", date)) :])[:14]
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def record_id(url: str, date: str, headers: bytes, digest: bytes, place: str = "") -> str:
    """A record's identifier, the same whenever it is converted; `place` tells equal records apart."""
    made = hashlib.sha1(b"\0".join([url.encode(), date.encode(), headers, digest, place.encode()])).digest()
    return f"<urn:uuid:{uuid.UUID(bytes=made[:16], version=5)}>"


def warc_record(headers: dict[str, str | None], block: bytes) -> bytes:
    lines = ["WARC/1.0", *(f"{k}: {v}" for k, v in headers.items() if v is not None), f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def read_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Records of an archive: named header fields, names in lower case, and block."""
    for content in members(data) if data[:2] == b"\x1f\x8b" else [data]:
        at = 0
        while at < len(content):
            while content[at : at + 2] == b"\r\n":
                at += 2
            if at >= len(content):
                break
            if not content.startswith(b"WARC/", at):
                raise ValueError("not a WARC record")
            end = content.index(b"\r\n\r\n", at)
            lines = content[at:end].decode("utf-8", "replace").split("\r\n")[1:]
            fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
            at = end + 4
            length = int(fields["content-length"])
            yield fields, content[at : at + length]
            at += length


def base32(digest: bytes) -> str:
    return f"sha1:{base64.b32encode(digest).decode()}"


def _archives(rows: Iterable[bytes], head: Callable[[int], bytes]) -> Iterator[bytes]:
    """Members put together to archives of bounded size."""
    parts, size, number = [], 0, 0
    for data in rows:
        if not parts:
            parts.append(member(head(number)))
        parts.append(member(data))
        size += len(parts[-1])
        if size >= ARCHIVE_BYTES:
            yield b"".join(parts)
            parts, size, number = [], 0, number + 1
    if parts:
        yield b"".join(parts)


def _save(df: DataFrame, make: Callable[[pa.RecordBatch], Iterable[bytes]], head: Callable[[int, int], bytes], path: str) -> None:
    """Write one file for each archive; the zero byte after it is padding. `make` gives records of a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        records = (record for batch in batches for record in make(batch))
        for archive in _archives(records, lambda n: head(task, n)):
            yield pa.RecordBatch.from_arrays([pa.array([archive], pa.binary())], ["archive"])

    out = df.mapInArrow(run, "archive binary").select(F.col("archive").cast("string").alias("value"))
    out.write.option("lineSep", "\0").option("maxRecordsPerFile", 1).mode("overwrite").text(path)


def _load(spark: SparkSession, path: str) -> DataFrame:
    """Archives one by one, with their names; each is of bounded size."""
    return spark.read.format("binaryFile").load(path).select("content", F.col("path").alias("archive"))


def save_arc(df: DataFrame, path: str, version: int = 1) -> None:
    """Write responses `(url, date, headers, payload)` as ARC archives; `date` has fourteen digits."""

    def make(batch: pa.RecordBatch) -> Iterator[bytes]:
        for at in range(0, batch.num_rows, 256):
            for row in batch.slice(at, 256).to_pylist():
                fields = {"URL": row["url"], "IP-address": "0.0.0.0", "Archive-date": row["date"], "Content-type": "text/html"}
                yield arc_record(fields, (row["headers"] or b"") + (row["payload"] or b""), version)

    _save(df.select("url", "date", "headers", "payload"), make,
          lambda task, n: arc_file_header(f"lexhaven-{task:05}-{n:05}.arc", "20000101000000", version), path)


def _records(archive: str, content: bytes) -> Iterator[dict]:
    """Records of one ARC archive with what WARC asks for, and their place in it."""
    # The part of a file's name that Spark draws at random is no part of a record's place.
    parts = archive.rsplit("/", 1)[-1].split("-")
    named = f"{parts[1] if len(parts) > 1 else ''}-{parts[-1]}"
    for at, (fields, body) in enumerate(read_arc(content)):
        headers, payload = http_parts(body)
        digest = hashlib.sha1(payload).digest()
        page = header_of(headers, PAGE_HEADER) or ""
        date = iso_date(fields["Archive-date"])
        yield {
            "archive": archive, "at": at, "id": record_id(fields["URL"], date, headers, digest, f"{named}-{at}"), "url": fields["URL"],
            "date": date, "content_type": fields["Content-type"], "page": int(page) if re.fullmatch(r"-?\d+", page) else None,
            "headers": headers, "payload": payload, "payload_bytes": len(payload), "digest": digest,
        }


RECORD = "archive string, at int, id string, url string, date string, page long, payload_bytes long, digest binary"


def load_arc(spark: SparkSession, path: str) -> DataFrame:
    """All records of the archives below a path, without headers and payloads."""
    kinds = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    schema = pa.schema([(n, kinds[k]) for n, k in (x.split() for x in RECORD.split(", "))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content, archive in zip(batch.column(0), batch.column(1).to_pylist()):
                rows = [{n: r[n] for n in schema.names} for r in _records(archive, content.as_py())]
                yield pa.RecordBatch.from_pylist(rows, schema)

    return _load(spark, path).mapInArrow(run, RECORD)


def revisits(records: DataFrame, order: str = "page") -> DataFrame:
    """Per archive with any, its `revisits`: place of each record whose payload an `original` has.

    The original of equal payloads is the one with the largest `order`, an unknown one counting
    least, of equal ones that with the last address and place.
    """
    ranked = F.struct(order, "url", "id", "date", "archive", "at")
    long_ones = records.where(F.col("payload_bytes") >= LEAST_REVISIT)
    first = long_ones.groupBy("digest").agg(F.max(ranked).alias("original"), F.count("*").alias("n")).where("n > 1")
    again = long_ones.join(first, "digest").where("archive <> original.archive or at <> original.at")
    return again.groupBy("archive").agg(F.collect_list(F.struct("at", "original.id", "original.url", "original.date")).alias("revisits"))


def save_warc(spark: SparkSession, arc: str, chosen: DataFrame, path: str) -> None:
    """Convert the ARC archives below `arc` to WARC; `chosen` says which records are revisits.

    Decisions go to the archives, by their names; no payload leaves its archive before it is written.
    """

    def record(row: dict, original: dict | None) -> bytes:
        headers = row["headers"] or b""
        common = {
            "WARC-Type": "revisit" if original else "response" if headers else "resource", "WARC-Record-ID": row["id"],
            "WARC-Date": row["date"], "WARC-Target-URI": row["url"], "WARC-Payload-Digest": base32(row["digest"]),
        }
        block = headers if original else headers + row["payload"]
        kind = "application/http; msgtype=response" if headers else row["content_type"]
        more = {"WARC-Block-Digest": base32(hashlib.sha1(block).digest()), "Content-Type": kind}
        if original:
            more |= {"WARC-Profile": REVISIT_PROFILE, "WARC-Refers-To": original["id"],
                     "WARC-Refers-To-Target-URI": original["url"], "WARC-Refers-To-Date": original["date"]}
        return warc_record(common | more, block)

    def make(batch: pa.RecordBatch) -> Iterator[bytes]:
        for n in range(batch.num_rows):
            archive, content, found = (batch.column(c)[n] for c in ("archive", "content", "revisits"))
            originals = {r["at"]: r for r in found.as_py() or []}
            for row in _records(archive.as_py(), content.as_py()):
                yield record(row, originals.get(row["at"]))

    def head(task: int, n: int) -> bytes:
        made = hashlib.sha1(f"{path}{task}-{n}".encode()).digest()
        fields = {"WARC-Type": "warcinfo", "WARC-Record-ID": f"<urn:uuid:{uuid.UUID(bytes=made[:16], version=5)}>",
                  "WARC-Date": "2000-01-01T00:00:00Z", "WARC-Filename": f"lexhaven-{task:05}-{n:05}.warc.gz", "Content-Type": "application/warc-fields"}
        return warc_record(fields, b"software: lexhaven\r\nformat: WARC File Format 1.0\r\n")

    _save(_load(spark, arc).join(chosen, "archive", "left").select("archive", "content", "revisits"), make, head, path)


def load_warc(spark: SparkSession, path: str) -> DataFrame:
    """Per record: id, type, page, payload's size and digest (hexadecimal), id it refers to.

    The digest of a stored payload is taken of what was read and must be the declared one.
    """
    schema = pa.schema([("id", pa.string()), ("record_type", pa.string()), ("page", pa.int64()), ("payload_bytes", pa.int64()),
                        ("payload_digest", pa.string()), ("refers_id", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                rows = []
                for fields, block in read_warc(content.as_py()):
                    if fields["warc-type"] == "warcinfo":
                        continue
                    headers, payload = http_parts(block) if "http" in fields["content-type"] else (b"", block)
                    declared = base64.b32decode(fields["warc-payload-digest"].removeprefix("sha1:"))
                    revisit = fields["warc-type"] == "revisit"
                    if not revisit and hashlib.sha1(payload).digest() != declared:
                        raise ValueError(f"payload of {fields['warc-record-id']} is not what its digest says")
                    page = header_of(headers, PAGE_HEADER) or ""
                    rows.append({
                        "id": fields["warc-record-id"], "record_type": fields["warc-type"],
                        "page": int(page) if re.fullmatch(r"-?\d+", page) else None,
                        "payload_bytes": int(header_of(headers, "Content-Length") or len(payload)) if revisit else len(payload),
                        "payload_digest": declared.hex(), "refers_id": fields.get("warc-refers-to"),
                    })
                yield pa.RecordBatch.from_pylist(rows, schema)

    return _load(spark, path).mapInArrow(
        run, "id string, record_type string, page long, payload_bytes long, payload_digest string, refers_id string"
    )


def archived(df: DataFrame, html: str = "html", url: str = "url", key: str = "page_id") -> DataFrame:
    """Write pages as ARC archives, turn these into WARC archives and read them back.

    Per page: key, payload_bytes, payload_digest, record_type, refers_to. A NULL page has an empty
    payload, a NULL address is written as a dash. Keys are whole numbers. Each row is a record of its
    own: of equal payloads under one key, one is the response and the others revisit it; an unknown
    key counts as the least and is referred to as NULL. Other columns take no part; an empty table
    gives no rows.
    """
    spark = df.sparkSession
    work = work_folder(spark)
    payload = F.coalesce(df[html], F.lit("")).cast("binary")
    head = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"), F.lit(f"{PAGE_HEADER}: "), F.coalesce(df[key].cast("string"), F.lit("")),
        F.lit("\r\nContent-Length: "), F.octet_length(payload).cast("string"), F.lit("\r\n\r\n"),
    )
    pages = df.select(df[url].alias("url"), F.lit("20240101000000").alias("date"), head.cast("binary").alias("headers"), payload.alias("payload"))
    save_arc(pages, f"{work}/arc")
    save_warc(spark, f"{work}/arc", revisits(load_arc(spark, f"{work}/arc")), f"{work}/warc")
    # Written without payloads, so that the archives are read once.
    back = written(load_warc(spark, f"{work}/warc"), f"{work}/back")
    targets = back.where("record_type = 'response'").select(F.col("id").alias("refers_id"), F.col("page").alias("refers_to"))
    again = back.where("record_type = 'revisit'").join(targets, "refers_id", "left")
    columns = [F.col("page").alias(key), "payload_bytes", "payload_digest", "record_type"]
    return back.where("record_type <> 'revisit'").select(*columns, F.lit(None).cast("long").alias("refers_to")).union(
        again.select(*columns, "refers_to")
    )
