"""Legacy web archives (ARC, versions 1 and 2) converted to WARC, and both formats written and read by Spark.

Archives are written by the text sink, a record a row with the format's separator as line end, gzip-compressed. Pages are dealt by their size, and each
size has as many records a file as keep it under FILE_BYTES, or one where a page alone is larger; they are read as binary files and parsed record by record along their
declared lengths, so nothing larger than a file is held. Payloads are bytes throughout.

An ARC header line has the fields that its file's version block names (those of its version where the block's list is not whole); the URL is what is left of the last of
them, so it may hold blanks. A line that is no header (garbage between records) is skipped to the next one. A record whose
block is shorter than declared (a cut file) ends its file. Null URLs are written as "-", white space in URLs
as %20; null html is an empty payload; equal rows are records of their own; an empty table makes no archive and no rows;
other columns are not read.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.common import join_hot, table_path, written

#: No file holds more bytes than this and the heads of its records, but for one larger page. Sizes of pages (at most so many bytes) and their records a file.
FILE_BYTES = 64 << 20
SIZES = tuple((most, min(4096, FILE_BYTES // most)) for most in (1 << 14, 1 << 18, 1 << 22)) + ((None, 1),)
#: Equal payloads of at least so many bytes are written once.
LEAST_REVISIT = 100
CRAWL_DATE = "20240101000000"
#: The fields of a header line by the version of the ARC format.
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
#: Fixed value: the profile of a revisit record for an equal payload.
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
BATCH_BYTES = 4 << 20


def _text(lines: DataFrame, out: str, separator: str, per_file: int) -> None:
    lines.write.option("lineSep", separator).option("compression", "gzip").option("maxRecordsPerFile", per_file).text(out)


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.txt*").option("recursiveFileLookup", True).load(path)


def _first_of_file(per_file: int) -> Column:
    """True for the row that starts each file of the sink."""
    return F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)) % per_file == 0


def write_arc(pages: DataFrame, out: str, version: int = 1, date: str = CRAWL_DATE, sizes: tuple = SIZES) -> list[tuple[str, int]]:
    """``pages`` (page_id, url, html) as ARC files: a version block, then an HTTP response a row. The folders in ``out``, one a size of page that there is, and their records a file."""
    size = F.octet_length(F.coalesce(F.col("html"), F.lit("")))
    kind = F.lit(len(sizes) - 1)
    for k, (most, _) in reversed(list(enumerate(sizes[:-1]))):
        kind = F.when(size <= most, k).otherwise(kind)
    folders = []
    for k in sorted(r.kind for r in pages.select(kind.alias("kind")).distinct().collect()):  # a row a size
        folders.append((f"{out}/size-{k}", sizes[k][1]))
        _write_arc(pages.filter(kind == k), *folders[-1], version, date)
    return folders


def _write_arc(pages: DataFrame, out: str, per_file: int, version: int, date: str) -> None:
    html = F.coalesce(F.col("html"), F.lit(""))
    url = F.coalesce(F.regexp_replace("url", r"\s", "%20"), F.lit("-"))
    block = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nX-Page-Id: "), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit("\r\nContent-Length: "), F.octet_length(html).cast("string"), F.lit("\r\n\r\n"), html)
    middle = f" 0.0.0.0 {date} text/html " + ("200 - - 0 - " if version == 2 else "")
    record = F.concat(url, F.lit(middle), F.octet_length("block").cast("string"), F.lit("\n"), F.col("block"))
    about = f"{version} 0 lectern\n{ARC_FIELDS[version]}\n"
    head = f"filedesc://pages.arc 0.0.0.0 {date} text/plain " + ("200 - - 0 pages.arc " if version == 2 else "") + f"{len(about)}\n{about}\n"
    _text(pages.select(url.alias("url"), block.alias("block")).select(F.concat(F.when(_first_of_file(per_file), head).otherwise(""), record).alias("value")), out, "\n", per_file)


def _opened(content: bytes) -> io.BufferedIOBase:
    raw = io.BytesIO(content)
    return io.BufferedReader(gzip.GzipFile(fileobj=raw)) if content[:2] == b"\x1f\x8b" else raw


def arc_records(content: bytes) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """(ordinal, version, header fields, block) of each record of an ARC file, the version block included."""
    data, version, fields, k = _opened(content), 1, ARC_FIELDS[1].split(), 0
    while line := data.readline():
        parts = line.rstrip(b"\r\n").decode("utf-8", "replace")
        values = parts.rsplit(" ", len(ARC_FIELDS[1].split()) - 1 if parts.startswith("filedesc:") and k == 0 else len(fields) - 1)
        if parts.startswith("filedesc:") and k == 0:
            # The first line is of the version that its own block declares.
            if not values[-1].isdigit():
                continue
            block = data.read(int(values[-1]))
            lines = block.decode("utf-8", "replace").splitlines()
            version = int(lines[0].split(" ")[0]) if lines and lines[0][:1].isdigit() else 1
            fields = lines[1].split() if len(lines) > 1 else []
            if not {"URL", "Archive-date"} <= set(fields) or fields[-1] != "Archive-length":
                fields = ARC_FIELDS.get(version, ARC_FIELDS[1]).split()
            values = parts.rsplit(" ", len(fields) - 1)
        elif len(values) == len(fields) and values[-1].isdigit() and re.fullmatch(r"\d{4,14}", values[fields.index("Archive-date")]):
            size = int(values[-1])
            block = data.read(size)
            if len(block) < size:
                return
        else:
            continue
        yield k, version, dict(zip(fields, values, strict=False)), block
        k += 1


def warc_date(arc: str) -> str:
    """YYYYMMDDhhmmss, the end of which may be missing, as an ISO instant."""
    full = (arc + "00000101000000"[len(arc) :])[:14]
    return f"{full[:4]}-{full[4:6]}-{full[6:8]}T{full[8:10]}:{full[10:12]}:{full[12:14]}Z"


def _split_http(block: bytes) -> tuple[bytes, bytes, dict[str, str]]:
    """HTTP head with its blank line, payload, header fields in lower case."""
    head, gap, payload = block.partition(b"\r\n\r\n")
    if not block.startswith(b"HTTP/") or not gap:
        return b"", block, {}
    fields = dict(x.split(":", 1) for x in head.decode("utf-8", "replace").split("\r\n")[1:] if ":" in x)
    return head + gap, payload, {k.strip().lower(): v.strip() for k, v in fields.items()}


CONVERTED = "record_id string, type string, url string, date string, ip string, mime string, page_id long, payload_bytes long, payload_digest string, head binary, payload binary"


def convert_arc(files: DataFrame, payloads: bool = True) -> DataFrame:
    """Rows of the ``binaryFile`` source that hold ARC files -> what WARC records need, a row each.

    The identifier is made of the file's name and the record's place in it, so a task that runs again makes the same ones.
    """

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("record_id", pa.string()), ("type", pa.string()), ("url", pa.string()), ("date", pa.string()), ("ip", pa.string()), ("mime", pa.string()), ("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("head", pa.binary()), ("payload", pa.binary())])
        rows, held = [], 0
        for batch in batches:
            for path, content in zip(batch.column(0), batch.column(1), strict=True):
                name = path.as_py().rsplit("/", 1)[-1]
                for k, _, fields, block in arc_records(content.as_py()):
                    url = fields.get("URL", "-")
                    head, payload, http = _split_http(block)
                    kind = "warcinfo" if url.startswith("filedesc:") else "response" if head else "resource"
                    page = http.get("x-page-id", "")
                    rows.append({
                        "record_id": str(uuid.UUID(bytes=hashlib.sha256(f"{name}#{k}".encode()).digest()[:16], version=5)), "type": kind, "url": url, "date": warc_date(fields.get("Archive-date", "")), "ip": fields.get("IP-address"), "mime": fields.get("Content-type"),
                        "page_id": int(page) if page.lstrip("-").isdigit() else None, "payload_bytes": len(payload), "payload_digest": hashlib.sha256(payload).hexdigest(), "head": head if payloads else None, "payload": payload if payloads else None,
                    })
                    held += len(block)
                    if held > BATCH_BYTES or len(rows) > 5000:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)

    return files.select("path", "content").mapInArrow(convert, CONVERTED)


def write_warc(records: DataFrame, revisits: DataFrame, out: str, per_file: int) -> None:
    """``records`` of convert_arc as WARC files; ``revisits`` (record_id, first_id) names the response that a record of an equal payload revisits."""
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    r = records.join(revisits, "record_id", "left")
    revisit = F.col("first_id").isNotNull()
    head, payload = F.coalesce("head", F.lit(b"")), F.when(revisit, F.lit(b"")).otherwise(F.coalesce("payload", F.lit(b"")))
    header = F.concat(
        F.lit("WARC/1.0\r\n"), line("WARC-Type", F.when(revisit, "revisit").otherwise(F.col("type"))), line("WARC-Target-URI", F.col("url")), line("WARC-Date", F.col("date")), line("WARC-Record-ID", F.concat(F.lit("<urn:uuid:"), F.col("record_id"), F.lit(">"))),
        F.coalesce(line("WARC-IP-Address", F.col("ip")), F.lit("")), line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("payload_digest"))),
        F.when(revisit, F.concat(line("WARC-Profile", F.lit(PROFILE)), line("WARC-Refers-To", F.concat(F.lit("<urn:uuid:"), F.col("first_id"), F.lit(">"))))).otherwise(""),
        line("Content-Type", F.when(F.col("type") == "warcinfo", "text/plain").when(F.octet_length(head) > 0, "application/http; msgtype=response").otherwise(F.coalesce("mime", F.lit("application/octet-stream")))), line("Content-Length", (F.octet_length(head) + F.octet_length(payload)).cast("string")), F.lit("\r\n"),
    )
    _text(r.select(F.concat(header.cast("binary"), head, payload).cast("string").alias("value")), out, "\r\n\r\n", per_file)


def warc_records(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields in lower case, block) of each record of a WARC file."""
    data = _opened(content)
    while line := data.readline():
        if not line.startswith(b"WARC/"):
            continue
        fields = {}
        while (line := data.readline()).strip():
            name, _, value = line.decode("utf-8", "replace").partition(":")
            fields[name.strip().lower()] = value.strip()
        size = int(fields.get("content-length", "0"))
        block = data.read(size)
        if len(block) < size:
            return
        yield fields, block


READ = "record_id string, type string, url string, date string, page_id long, payload_bytes long, payload_digest string, refers_to_id string"


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """record_id, type, url, date, page_id, payload_bytes, payload_digest (computed where the payload is there), refers_to_id of each record."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("record_id", pa.string()), ("type", pa.string()), ("url", pa.string()), ("date", pa.string()), ("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to_id", pa.string())])
        for batch in batches:
            for content in batch.column(0):
                rows = []
                for fields, block in warc_records(content.as_py()):
                    _, payload, http = _split_http(block)
                    whole, page = fields.get("warc-type") != "revisit", http.get("x-page-id", "")
                    rows.append({
                        "record_id": fields.get("warc-record-id", "")[10:-1], "type": fields.get("warc-type"), "url": fields.get("warc-target-uri"), "date": fields.get("warc-date"), "page_id": int(page) if page.lstrip("-").isdigit() else None,
                        "payload_bytes": len(payload) if whole else int(http.get("content-length", "0")), "payload_digest": hashlib.sha256(payload).hexdigest() if whole else fields.get("warc-payload-digest", "").removeprefix("sha256:"), "refers_to_id": fields.get("warc-refers-to", "")[10:-1] or None,
                    })
                yield pa.RecordBatch.from_pylist(rows, schema)

    return _files(spark, path).select("content").mapInArrow(parse, READ)


def archived(pages: DataFrame, version: int = 1) -> DataFrame:
    """ARC written, converted to WARC with revisits, and the WARC files' records read back."""
    spark = pages.sparkSession
    arc, warc = table_path(spark, "arc"), table_path(spark, "warc")
    folders = write_arc(pages, arc, version)
    if not folders:
        return spark.createDataFrame([], READ)
    found = convert_arc(_files(spark, arc), payloads=False).filter(f"type = 'response' and payload_bytes >= {LEAST_REVISIT}").select("payload_digest", "page_id", "record_id")
    # Who revisits whom is settled on narrow rows; payloads then move by their own record, never by a digest that many share.
    found = written(found, "digests")
    firsts = found.groupBy("payload_digest").agg(F.count("*").alias("n"), F.min(F.struct(F.col("page_id").isNull().alias("none"), "page_id", "record_id")).alias("first")).filter("n > 1").select("payload_digest", F.col("first.record_id").alias("first_id"), "n")
    revisits = written(join_hot(found, written(firsts, "firsts"), ["payload_digest"], found.count()).filter("first_id <> record_id").select("record_id", "first_id"), "revisits")
    for folder, per_file in folders:
        write_warc(convert_arc(_files(spark, folder)), revisits, f"{warc}/{folder.rsplit('/', 1)[-1]}", per_file)
    return read_warc(spark, warc)


def op3(spark, sf_dir: str) -> DataFrame:
    r = archived(spark.read.parquet(f"{sf_dir}/pages.parquet")).filter("type in ('response', 'revisit')")
    r = written(r.select("record_id", "page_id", "payload_bytes", "payload_digest", F.col("type").alias("record_type"), "refers_to_id"), "records")
    revisits, columns = r.filter("refers_to_id is not null"), ["page_id", "payload_bytes", "payload_digest", "record_type"]
    asked = revisits.groupBy("refers_to_id").agg(F.count("*").alias("n"))
    to = written(r.filter("refers_to_id is null").select(F.col("record_id").alias("refers_to_id"), F.col("page_id").alias("refers_to")).join(asked, "refers_to_id"), "originals")
    found = join_hot(revisits, to, ["refers_to_id"], r.count(), "left").select(*columns, "refers_to")
    return r.filter("refers_to_id is null").select(*columns, F.lit(None).cast("long").alias("refers_to")).union(found)


OP3_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY html) AS first_id, row_number() OVER (PARTITION BY html ORDER BY page_id NULLS LAST) AS k, strlen(html) AS n FROM p)
SELECT page_id, n::BIGINT AS payload_bytes, sha256(html) AS payload_digest, CASE WHEN n >= 100 AND k > 1 THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 100 AND k > 1 THEN first_id END AS refers_to
FROM f
"""
