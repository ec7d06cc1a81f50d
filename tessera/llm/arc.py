"""Legacy archives: read ARC files, write equivalent WARC files, read those back.

An ARC file begins with a version block whose last line names the fields of its records' header lines; version
1 has five of them, version 2 ten.  A record is a header line, as many bytes as its last field declares, and a
line break.  For each record the converter makes the identifier (UUID 5 of address, time, digest and page), the time
(14 digits to ISO 8601), the type and the block and payload digests (SHA-1, base 32) of a WARC record.  HTTP
responses become ``response`` records, or ``revisit`` records without payload if another record with the same
payload has a smaller id; anything else becomes a ``resource``.

Archives are whole files for one task each, as their lengths chain; the writers make one per input partition.
Texts never pass a shuffle: only ids and digests do, and the revisits found are handed back to the archives by a
broadcast behind a count, or a join on the record's place beyond that.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import BROADCAST_ROWS
from tessera.session import shared_folder, stable_copy

# Field names of the two versions' header lines, and what a WARC record says.
FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
PAGE_HEADER = "X-Page-Id"  # response header that carries a page's id through both formats
CAPTURED = "20200101000000"  # pages have no capture time of their own
NAMESPACE = uuid.uuid5(uuid.NAMESPACE_URL, "warc-record")
RECORD_END = "\r\n\r\n"  # of a WARC record, and of nothing else the writer adds


def digest_of(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


# --- ARC ---


def _arc_header(version: int, url: str, kind: str, length: int) -> bytes:
    middle = "" if version == 1 else "200 - - 0 - "
    return f"{url} 0.0.0.0 {CAPTURED} {kind} {middle}{length}\n".encode()


def version_block(version: int) -> bytes:
    body = f"{version} 0 origin\n{FIELDS[version]}\n\n".encode()
    middle = "" if version == 1 else "200 - - 0 - "
    return f"filedesc://pages.arc 0.0.0.0 {CAPTURED} text/plain {middle}{len(body)}\n".encode() + body


def write_arc(pages: DataFrame, folder: str, id_column: str = "page_id", url: str = "url", body: str = "html") -> None:
    """Pages as HTTP responses in gzip-compressed ARC files below ``folder``, one per partition, versions taking turns.

    A null body is empty, a null address is a dash, a null id leaves its header out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        version, begun = TaskContext.get().partitionId() % 2 + 1, False
        for batch in batches:
            out = []
            for key, address, payload in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                data = (payload or "").encode()
                page = "" if key is None else f"{PAGE_HEADER}: {key}\r\n"
                content = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(data)}\r\n{page}\r\n".encode() + data
                record = _arc_header(version, quote(address or "-", safe=":/?#[]@!$&'()*+,;=%~"), "text/html", len(content)) + content
                out.append(record if begun else version_block(version) + b"\n" + record)
                begun = True
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["record"])

    rows = pages.select(F.col(id_column).cast("string"), F.col(url).cast("string"), F.col(body).cast("string"))
    records = rows.mapInArrow(run, "record binary").select(F.col("record").cast("string"))
    records.write.option("compression", "gzip").option("lineSep", "\n").text(folder)


def _opened(name: str, content: bytes) -> io.BufferedIOBase:
    return gzip.GzipFile(fileobj=io.BytesIO(content)) if content[:2] == b"\x1f\x8b" else io.BytesIO(content)


def arc_records(file: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """Fields by name and content of every record; the version block sets the fields of those behind it."""
    names = FIELDS[1].split()
    while line := file.readline():
        if not line.strip():
            continue
        values = line.decode("utf-8", "replace").rstrip("\r\n").split(" ")
        length = int(values[-1])  # declared, always the last field
        content = file.read(length)
        if len(content) < length:
            raise ValueError(f"a record of {length} bytes ends after {len(content)}")
        if line.startswith(b"filedesc:"):
            lines = content.decode("utf-8", "replace").splitlines()
            version = int(lines[0].split(" ")[0])
            if version not in FIELDS:
                raise ValueError(f"ARC version {version}")
            names = lines[1].split() if len(lines) > 1 and lines[1].strip() else FIELDS[version].split()
            continue
        extra = len(values) - len(names)  # an address with blanks in it has too many parts
        yield dict(zip(names, [" ".join(values[: extra + 1]), *values[extra + 1 :]], strict=False)), content


# --- WARC ---


def _http(content: bytes) -> tuple[bytes, bytes] | None:
    """Head (with its blank line) and payload of an HTTP response, None for anything else."""
    if not content.startswith(b"HTTP/"):
        return None
    ends = [(content.find(b"\r\n\r\n"), 4), (content.find(b"\n\n"), 2)]
    cut = min((at + size for at, size in ends if at >= 0), default=len(content))
    return content[:cut], content[cut:]


def _page(head: bytes) -> int | None:
    found = re.search(rb"(?im)^" + PAGE_HEADER.encode() + rb": *(-?\d+)\s*$", head)
    return int(found[1]) if found else None


def _record_id(fields: dict[str, str], digest: str, page: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, '|'.join([fields['URL'], fields['Archive-date'], digest, str(page)]))}>"


def _iso(date: str) -> str:
    d = date.ljust(14, "0")
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def warc_record(fields: dict[str, str], content: bytes, original: dict | None) -> bytes:
    """One record without its closing blank lines; ``original`` names the response that a revisit refers to."""
    http = _http(content)
    head, payload = http or (b"", content)
    digest, page = digest_of(payload), _page(head)
    block = head if original else content
    kind = "revisit" if original else "response" if http else "resource"
    mime = "application/http; msgtype=response" if http else fields.get("Content-type", "application/octet-stream")
    named = [
        ("WARC-Type", kind),
        ("WARC-Record-ID", _record_id(fields, digest, page)),
        ("WARC-Date", _iso(fields["Archive-date"])),
        ("WARC-Target-URI", fields["URL"]),
        ("WARC-IP-Address", fields.get("IP-address", "0.0.0.0")),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("WARC-Block-Digest", f"sha1:{digest_of(block)}"),
        ("Content-Type", mime),
    ]
    if original:
        named += [
            ("WARC-Profile", REVISIT_PROFILE),
            ("WARC-Refers-To", original["record_id"]),
            ("WARC-Refers-To-Target-URI", original["url"]),
            ("WARC-Refers-To-Date", _iso(original["date"])),
            ("WARC-Truncated", "length"),
            ("X-Payload-Length", str(len(payload))),
            ("X-Refers-To-Page", str(original["page"])),
        ]
    named.append(("Content-Length", str(len(block))))
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in named).encode() + b"\r\n" + block


def warc_records(file: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """Named fields (lower case) and block of every record."""
    while line := file.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC record begins with {line[:40]!r}")
        fields = {}
        while (line := file.readline()).strip():
            name, _, value = line.decode("utf-8", "replace").partition(":")
            fields[name.strip().lower()] = value.strip()
        length = int(fields["content-length"])
        block = file.read(length)
        if len(block) < length:
            raise ValueError(f"a record of {length} bytes ends after {len(block)}")
        yield fields, block


def _archives(spark: SparkSession, folder: str) -> DataFrame:
    # one archive to a task: several small ones may share it, a large one is not joined by others
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder).select("path", "content")


def convert(spark: SparkSession, source: str, target: str, least: int = 0, broadcast_rows: int = BROADCAST_ROWS) -> None:
    """ARC files below ``source`` to gzip-compressed WARC files below ``target``, one for one.

    Of responses with equal payloads of at least ``least`` bytes that with the smallest page id (then the first
    in the archives; those without an id last) is written in full, the others as revisits of it.
    """

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows = []
                for number, (fields, data) in enumerate(arc_records(_opened(path, content.as_py()))):
                    http = _http(data)
                    if http and len(http[1]) >= least:
                        digest, page = digest_of(http[1]), _page(http[0])
                        rows.append((path, number, digest, page, _record_id(fields, digest, page), fields["URL"], fields["Archive-date"]))
                yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in rows], schema)

    schema = pa.schema([("path", pa.string()), ("number", pa.int32()), ("digest", pa.string()), ("page", pa.int64()), ("record_id", pa.string()), ("url", pa.string()), ("date", pa.string())])
    archives = _archives(spark, source)
    found = stable_copy(archives.mapInArrow(summarise, "path string, number int, digest string, page long, record_id string, url string, date string"))
    first = F.struct(F.col("page").isNull().alias("no_page"), "page", "path", "number", "record_id", "url", "date")
    originals = found.groupBy("digest").agg(F.min(first).alias("o"), F.count("*").alias("n")).where("n > 1").select("digest", "o")
    repeats = found.join(originals, "digest").where((F.col("path") != F.col("o.path")) | (F.col("number") != F.col("o.number")))
    revisits = stable_copy(
        repeats.select("path", "number", F.struct(F.col("o.record_id").alias("record_id"), F.col("o.url").alias("url"), F.col("o.date").alias("date"), F.col("o.page").alias("page")).alias("original"))
    )
    # the revisits of an archive beside it: at most one entry per record of that file
    per_archive = revisits.groupBy("path").agg(F.collect_list(F.struct("number", "original")).alias("revisits"))
    hinted = F.broadcast(per_archive) if revisits.limit(broadcast_rows + 1).count() <= broadcast_rows else per_archive
    paired = archives.join(hinted, "path", "left").select("path", "content", "revisits")

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content, listed in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                originals = {r["number"]: r["original"] for r in listed or ()}
                out, size = [], 0
                for number, (fields, data) in enumerate(arc_records(_opened(path, content.as_py()))):
                    out.append(warc_record(fields, data, originals.get(number)))
                    size += len(out[-1])
                    if size > 16_000_000:
                        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["record"])
                        out, size = [], 0
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["record"])

    records = paired.mapInArrow(rewrite, "record binary").select(F.col("record").cast("string"))
    records.write.option("compression", "gzip").option("lineSep", RECORD_END).text(target)


def read_warc(spark: SparkSession, folder: str) -> DataFrame:
    """``page_id, payload_bytes, payload_digest, record_type, refers_to, url, record_id`` of every record.

    Lengths and digests of full records are measured, and must agree with what the record says.
    """
    schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string()), ("record_id", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows = []
                for fields, block in warc_records(_opened(path, content.as_py())):
                    head, payload = _http(block) or (b"", block)
                    said = fields["warc-payload-digest"].removeprefix("sha1:")
                    revisit = fields["warc-type"] == "revisit"
                    if not revisit and digest_of(payload) != said:
                        raise ValueError(f"the payload of {fields['warc-record-id']} is not what its digest says")
                    size = int(fields["x-payload-length"]) if revisit else len(payload)
                    refers = fields.get("x-refers-to-page", "None")
                    rows.append((_page(head), size, said, fields["warc-type"], None if refers == "None" else int(refers), fields["warc-target-uri"], fields["warc-record-id"]))
                columns = [list(c) for c in zip(*rows, strict=True)] or [[] for _ in schema]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types, strict=True)], schema=schema)

    return _archives(spark, folder).mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, record_id string")


def op1(pages: DataFrame) -> DataFrame:
    """Pages to ARC, ARC to WARC, WARC back to rows: ``page_id, payload_bytes, payload_digest, record_type, refers_to``."""
    spark = pages.sparkSession
    arc, warc = shared_folder(spark, "arc"), shared_folder(spark, "warc")
    write_arc(pages, arc)
    convert(spark, arc, warc)
    return read_warc(spark, warc).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
