"""WARC derivatives: metadata and plain-text conversion records of response records.

Every response record gives one ``metadata`` and one ``conversion`` record. Both refer to it by
``WARC-Refers-To`` (with its target and date) and keep its digests; the metadata record keeps the
source's HTTP status and header lines, in order, and says what was found in the body; the
conversion record holds the page's visible text. Ids are name-based, so a task that runs again
writes the same records. One pass over the records, no shuffle.
"""

import base64
import gzip
import hashlib
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import functions as F

from localstat.llm.html import visible_text
from localstat.llm.shipping import ship

VERSION = "WARC/1.1"
NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # fixed value: the name space of URLs
RECORD = "record_id string, type string, refers_to string, target_uri string, date string, content_type string, block_digest string, payload_digest string, source_block_digest string, source_payload_digest string, block binary"
COLUMNS = [c.split()[0] for c in RECORD.split(", ")]


def digest(data):
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(*names):
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, chr(10).join(names))}>"


def responses(pages, date="2024-01-01T00:00:00Z"):
    """Response records of ``pages(page_id, url, html)``: ``page_id, record_id, target_uri, date, block``.

    A null page has an empty body, a null url no target. Repeated rows are records of their own
    with equal ids.
    """
    body = F.coalesce(F.col("html").cast("string"), F.lit(""))
    head = F.format_string(
        "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n", F.octet_length(body)
    )
    name = F.sha2(F.concat_ws("\n", F.col("page_id").cast("string"), F.col("url").cast("string"), body), 256)
    parts = [F.substring(name, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return pages.select(
        F.col("page_id").cast("bigint").alias("page_id"),
        F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">")).alias("record_id"),
        F.col("url").cast("string").alias("target_uri"),
        F.lit(date).alias("date"),
        F.encode(F.concat(head, body), "utf-8").alias("block"),
    )


def split_http(block):
    """Status line, header lines and body of an HTTP response; folded lines are joined."""
    head, _, body = block.partition(b"\r\n\r\n")
    lines = head.decode("latin-1").split("\r\n")
    headers = []
    for line in lines[1:]:
        if line[:1] in (" ", "\t") and headers:
            headers[-1] += " " + line.strip()
        elif line:
            headers.append(line)
    return lines[0], headers, body


def _unchunked(body):
    out = []
    while True:
        line, _, rest = body.partition(b"\r\n")
        try:
            size = int(line.split(b";")[0], 16)
        except ValueError:
            return b"".join(out) or body
        if not size:
            return b"".join(out)
        out.append(rest[:size])
        body = rest[size + 2 :]


def decoded_body(headers, body):
    """Text of a response body: transfer and content coding undone, charset as declared."""
    named = {}
    for line in headers:
        name, _, value = line.partition(":")
        named.setdefault(name.strip().lower(), value.strip())
    if "chunked" in named.get("transfer-encoding", "").lower():
        body = _unchunked(body)
    coding = named.get("content-encoding", "").lower()
    try:
        if "gzip" in coding:
            body = gzip.decompress(body)
        elif "deflate" in coding:
            body = zlib.decompress(body)
    except (OSError, EOFError, zlib.error):
        return "", "undecodable"
    charset = named.get("content-type", "").lower().partition("charset=")[2].split(";")[0].strip(" \"'") or "utf-8"
    try:
        return body.decode(charset, "replace"), charset
    except LookupError:
        return body.decode("utf-8", "replace"), "utf-8"


def derivatives(source_id, target, date, block):
    """The metadata and the conversion record of a response, as tuples in order of ``COLUMNS``."""
    block = block or b""
    status, headers, body = split_http(block)
    source = (digest(block), digest(body))
    page, charset = decoded_body(headers, body)
    text = visible_text(page).encode("utf-8", "replace")
    fields = [f"http-status: {status}", *(f"http-header: {h}" for h in headers)]
    fields += [f"charset: {charset}", f"body-bytes: {len(body)}", f"text-bytes: {len(text)}"]
    conversion = record_id("conversion", source_id or "", source[0])
    fields += [f"conversion: {conversion}"]
    about = "".join(f"{line}\r\n" for line in fields).encode("utf-8", "replace")
    for kind, name, content_type, own in (
        ("metadata", record_id("metadata", source_id or "", source[0]), "application/warc-fields", about),
        ("conversion", conversion, "text/plain; charset=utf-8", text),
    ):
        yield (name, kind, source_id, target, date, content_type, digest(own), digest(own), *source, own)


def derive(records, keep=()):
    """Derived records of ``records(record_id, target_uri, date, block)``, two a row.

    ``keep`` names further columns that both records carry. A null block counts as empty; a
    null id or target stays null; text that does not decode is replaced, never refused.
    """
    ship(records.sparkSession)
    keep = list(keep)
    rows = records.select(*keep, "record_id", "target_uri", "date", "block")
    kept = [f for f in rows.schema.fields if f.name in keep]
    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in kept), RECORD])

    def run(batches):
        for batch in batches:
            for lo in range(0, len(batch), 256):
                part = batch.slice(lo, 256)
                columns = [part.column(c).to_pylist() for c in ("record_id", "target_uri", "date", "block")]
                found = [r for row in zip(*columns, strict=True) for r in derivatives(*row)]
                at = pa.array([i for i in range(len(part)) for _ in (0, 1)])
                own = [pa.array(c, pa.binary() if n == "block" else pa.string()) for n, c in zip(COLUMNS, zip(*found, strict=True), strict=True)]
                yield pa.RecordBatch.from_arrays([*(part.column(k).take(at) for k in keep), *own], names=[*keep, *COLUMNS])

    return rows.mapInArrow(run, schema)


def header(record):
    """WARC header of a derived record, as a column; ``record`` gives a column by name."""
    line = lambda name, value: F.when(value.isNotNull(), F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))).otherwise("")
    c = record
    return F.concat(
        F.lit(f"{VERSION}\r\n"),
        line("WARC-Type", c("type")),
        line("WARC-Record-ID", c("record_id")),
        line("WARC-Date", c("date")),
        line("WARC-Target-URI", c("target_uri")),
        line("WARC-Refers-To", c("refers_to")),
        line("WARC-Refers-To-Target-URI", c("target_uri")),
        line("WARC-Refers-To-Date", c("date")),
        line("WARC-Block-Digest", c("block_digest")),
        line("WARC-Payload-Digest", c("payload_digest")),
        line("WARC-Source-Block-Digest", c("source_block_digest")),
        line("WARC-Source-Payload-Digest", c("source_payload_digest")),
        line("Content-Type", c("content_type")),
        line("Content-Length", F.octet_length(c("block")).cast("string")),
    )


def write_warc(records, path, compression="gzip"):
    """Write derived records as WARC files, one per task, with Spark's text writer.

    Their blocks are UTF-8, and the writer's line separator is what ends a WARC record.
    """
    text = F.concat(header(F.col), F.lit("\r\n"), F.decode("block", "utf-8"))
    out = records.select(text.alias("value")).write.option("lineSep", "\r\n\r\n")
    out.option("compression", compression).mode("error").text(path)


def records_of(data):
    """``(header names and values, block)`` of each record of a WARC file's bytes."""
    at = 0
    while (at := data.find(b"WARC/", at)) >= 0:
        end = data.find(b"\r\n\r\n", at)
        if end < 0:
            return
        lines = data[at:end].decode("utf-8", "replace").split("\r\n")[1:]
        fields = [(n.strip(), v.strip()) for n, _, v in (line.partition(":") for line in lines)]
        length = next((int(v) for n, v in fields if n.lower() == "content-length" and v.isdigit()), 0)
        yield fields, data[end + 4 : end + 4 + length]
        at = end + 4 + length


def read_warc(spark, path):
    """Records of plain or gzipped WARC files: ``file, record_id, type, target_uri, date, refers_to, headers, block``.

    A file is read by one task as a whole, as it can only be cut at its records.
    """
    ship(spark)
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(batches):
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                data = gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data
                for fields, block in records_of(data):
                    first = {}
                    for n, v in fields:
                        first.setdefault(n.lower(), v)
                    own = [first.get(n) for n in ("warc-record-id", "warc-type", "warc-target-uri", "warc-date", "warc-refers-to")]
                    yield pa.RecordBatch.from_arrays(
                        [
                            *(pa.array([v], pa.string()) for v in (name, *own)),
                            pa.array([list(first.items())], pa.map_(pa.string(), pa.string())), pa.array([block], pa.binary()),
                        ],
                        names=["file", "record_id", "type", "target_uri", "date", "refers_to", "headers", "block"],
                    )

    schema = "file string, record_id string, type string, target_uri string, date string, refers_to string, headers map<string,string>, block binary"
    return files.mapInArrow(run, schema)
