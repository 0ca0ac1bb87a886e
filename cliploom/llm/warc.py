"""Legacy ARC archives converted to WARC, written and read through Spark.

Pages are first kept as ARC files: version 1 or 2 by turns of the input partition, a new file after
FILE_CHUNKS chunks of CHUNK_CHARS characters, so that no archive outgrows a task; a version block, then for each page a header line, the HTTP response of the declared length and a line end.
The converter reads the version block, parses header lines by that version's field list, and takes
exactly the declared number of bytes; it never searches payloads for separators.  Each record
becomes a WARC record: an id made from URL, date and digest, the 14-digit ARC date as a timestamp,
the type, and SHA-256 digests.

Among records with equal payloads of at least ``LEAST`` bytes the smallest page id stays a response
and the rest become ``revisit`` records without a payload, which keep its digest and length and name
the id they refer to.  Payloads are grouped by digest and length with a partial aggregate; only
ids and digests of pages move for that.  Files are gzip-compressed and read record by record.

Defined results: a null html is an empty payload, a null url an empty target; repeated rows (equal
ids) give a record each, all responses if their id is the smallest; a null page id is never chosen
as the referred record if another id has the payload, and stays a response; no pages, no records.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import uuid
from collections.abc import Iterable, Iterator
from typing import BinaryIO

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import noted, scratch, sketch, stored

LEAST = 100
#: Text gathered in one output row, and such rows in one archive.
CHUNK_CHARS, FILE_CHUNKS = 4_000_000, 16
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
_FOLDED = {ord(c): f"%{ord(c):02X}" for c in " \t\r\n\x0b\x0c%"}
_UNFOLDED = {v: chr(k) for k, v in _FOLDED.items()}


def _fold(url: str) -> str:
    """White space and per cent signs coded, so that a URL is one header field."""
    return url.translate(_FOLDED) or "-"


def _unfold(url: str) -> str:
    if url == "-":
        return ""
    out, parts = [], url.split("%")
    out.append(parts[0])
    for part in parts[1:]:
        out.append(_UNFOLDED["%" + part[:2]] + part[2:])
    return "".join(out)


def _rolled(records: Iterable[str], head: str, separator: str, chars: int, chunks: int) -> Iterator[pd.DataFrame]:
    """Rows of about ``chars`` characters; where the writer starts a file, each ``chunks`` rows, a row starts with ``head``."""
    held, size, number = [], 0, 0

    def row() -> pd.DataFrame:
        return pd.DataFrame({"value": [separator.join([head] * (number % chunks == 0) + held)]})

    for record in records:
        held.append(record)
        size += len(record)
        if size >= chars:
            yield row()
            held, size, number = [], 0, number + 1
    if held:
        yield row()


def _archives(rows: DataFrame, separator: str, path: str) -> None:
    rows.write.option("compression", "gzip").option("maxRecordsPerFile", FILE_CHUNKS).option("lineSep", separator).text(path)


def _arc_head(version: int) -> str:
    line = "1 0 cliploom" if version == 1 else "2 0 cliploom"
    body = f"{line}\n{ARC_FIELDS[version]}\n"
    return f"filedesc://pages.arc 0.0.0.0 20240101000000 text/plain {len(body)}\n{body}"


def _arc_record(version: int, page_id: str, url: str, html: str) -> str:
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nX-Page-Id: {page_id}\r\n\r\n{html}"
    size = len(block.encode("utf-8", "surrogatepass"))
    start = f"{_fold(url)} 0.0.0.0 20240101000000 text/html"
    if version == 1:
        return f"{start} {size}\n{block}"
    return f"{start} 200 - - 0 pages.arc {size}\n{block}"


def write_arc(pages: DataFrame, path: str) -> None:
    rows = pages.select(F.coalesce(F.col("page_id").cast("string"), F.lit("-")).alias("page_id"), F.coalesce("url", F.lit("")).alias("url"), F.coalesce("html", F.lit("")).alias("html"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        version = 1 + TaskContext.get().partitionId() % 2
        records = (_arc_record(version, *row) for frame in batches for row in frame.itertuples(index=False))
        yield from _rolled(records, _arc_head(version), "\n", CHUNK_CHARS, FILE_CHUNKS)

    _archives(rows.mapInPandas(run, "value string"), "\n", path)


def _archive(content: bytes) -> BinaryIO:
    return io.BufferedReader(gzip.GzipFile(fileobj=io.BytesIO(content)), 1 << 20)


def arc_records(content: bytes) -> Iterator[dict]:
    """The records of one ARC file, by the field list of its version block and the declared lengths."""
    stream = _archive(content)
    head = stream.readline().decode()
    if not head:
        return
    block = stream.read(int(head.split(" ")[-1])).decode().split("\n")
    fields = block[1].split(" ")
    version = int(block[0].split(" ")[0])
    if fields != ARC_FIELDS[version].split(" "):
        raise ValueError(f"unknown field list of ARC version {version}: {block[1]}")
    stream.readline()
    while line := stream.readline():
        values = dict(zip(fields, line.decode().rstrip("\n").split(" ")))
        body = stream.read(int(values["Archive-length"]))
        stream.readline()
        http, _, payload = body.partition(b"\r\n\r\n")
        page_id = next(x.split(b": ")[1] for x in http.split(b"\r\n") if x.startswith(b"X-Page-Id"))
        yield {
            "page_id": None if page_id == b"-" else int(page_id), "url": _unfold(values["URL"]), "date": values["Archive-date"],
            "ip": values["IP-address"], "http": http, "payload": payload,
        }


def payload_index(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, payload_digest, payload_bytes) of every ARC record."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            for content in frame["content"]:
                rows = [(r["page_id"], hashlib.sha256(r["payload"]).hexdigest(), len(r["payload"])) for r in arc_records(content)]
                made = pd.DataFrame(rows, columns=["page_id", "payload_digest", "payload_bytes"])
                yield made.astype({"page_id": "Int64"})

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInPandas(run, "page_id long, payload_digest string, payload_bytes long")


def revisits(index: DataFrame) -> DataFrame:
    """(page_id, refers_to) of the records whose payload an earlier page has."""
    long = index.where(F.col("payload_bytes") >= LEAST)
    first = long.groupBy("payload_digest").agg(F.min("page_id").alias("refers_to"), F.max("page_id").alias("last"))
    # Digests with one id only need no join, so most pages end here.
    several = first.where("refers_to < last").select("payload_digest", "refers_to")
    return long.join(several, "payload_digest").where("page_id > refers_to").select("page_id", "payload_digest", "refers_to").distinct()


def _iso(date: str) -> str:
    return f"{date[:4]}-{date[4:6]}-{date[6:8]}T{date[8:10]}:{date[10:12]}:{date[12:14]}Z"


def _warc_record(record: dict, refers_to: int | None) -> str:
    payload = record["payload"]
    digest = hashlib.sha256(payload).hexdigest()
    page = "-" if record["page_id"] is None else str(record["page_id"])
    name = uuid.uuid5(uuid.NAMESPACE_URL, f"{record['url']} {record['date']} {digest} {page}")
    block = record["http"] + b"\r\n\r\n" + (payload if refers_to is None else b"")
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:uuid:{name}>",
        f"WARC-Date: {_iso(record['date'])}", f"WARC-Target-URI: {_fold(record['url'])}", f"WARC-IP-Address: {record['ip']}",
        f"WARC-Payload-Digest: sha256:{digest}", f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}",
        "Content-Type: application/http;msgtype=response", f"X-Page-Id: {page}", f"X-Payload-Length: {len(payload)}",
    ]
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"X-Refers-To-Page: {refers_to}"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head) + "\r\n\r\n" + block.decode("utf-8", "surrogatepass")


def convert(spark: SparkSession, arc_path: str, warc_path: str) -> None:
    """Write the WARC files of the ARC files below ``arc_path``."""
    again = stored(revisits(stored(payload_index(spark, arc_path), "payload-index")), "revisits")

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            for content in frame["content"]:
                rows, size = [], 0
                for r in arc_records(content):
                    rows.append((r["page_id"], hashlib.sha256(r["payload"]).hexdigest(), r["url"], r["date"], r["ip"], r["http"], r["payload"]))
                    size += len(r["payload"])
                    if size > 8_000_000:
                        yield _arc_frame(rows)
                        rows, size = [], 0
                yield _arc_frame(rows)

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        info = "WARC/1.1\r\nWARC-Type: warcinfo\r\nContent-Type: application/warc-fields\r\nContent-Length: 20\r\n\r\nsoftware: cliploom\r\n"
        records = (
            _warc_record({"page_id": None if pd.isna(row.page_id) else int(row.page_id), "url": row.url, "date": row.date, "ip": row.ip, "http": row.http, "payload": row.payload}, None if pd.isna(row.refers_to) else int(row.refers_to))
            for frame in batches for row in frame.itertuples(index=False)
        )
        yield from _rolled(records, info, "\r\n\r\n", CHUNK_CHARS, FILE_CHUNKS)

    records = spark.read.format("binaryFile").load(arc_path).select("content").mapInPandas(
        parse, "page_id long, payload_digest string, url string, date string, ip string, http binary, payload binary"
    )
    # Only records whose page may be a revisit move for the join; the rest are written where they were read.
    marked = noted(records, "page_id", sketch(again, "page_id"))
    columns = ["page_id", "url", "date", "ip", "http", "payload", "refers_to"]
    first = marked.where("not noted").withColumn("refers_to", F.lit(None).cast("long")).select(*columns)
    joined = first.unionByName(marked.where("noted").join(again, ["page_id", "payload_digest"], "left").select(*columns))
    _archives(joined.mapInPandas(write, "value string"), "\r\n\r\n", warc_path)


def _arc_frame(rows: list[tuple]) -> pd.DataFrame:
    made = pd.DataFrame(rows, columns=["page_id", "payload_digest", "url", "date", "ip", "http", "payload"])
    return made.astype({"page_id": "Int64"})


def warc_records(content: bytes) -> Iterator[tuple[dict, bytes]]:
    """(headers, block) of each record of one WARC file, by declared lengths."""
    stream = _archive(content)
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError("a WARC record must start with its version")
        headers = {}
        while (line := stream.readline().rstrip(b"\r\n")):
            key, _, value = line.decode("utf-8", "surrogatepass").partition(": ")
            headers[key] = value
        yield headers, stream.read(int(headers["Content-Length"]))


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """One row per response or revisit record; both describe the full payload."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            for content in frame["content"]:
                rows = []
                for head, block in warc_records(content):
                    kind = head["WARC-Type"]
                    if kind == "warcinfo":
                        continue
                    page = None if head["X-Page-Id"] == "-" else int(head["X-Page-Id"])
                    if kind == "response":
                        payload = block.partition(b"\r\n\r\n")[2]
                        rows.append((page, len(payload), hashlib.sha256(payload).hexdigest(), kind, None))
                    else:
                        rows.append((page, int(head["X-Payload-Length"]), head["WARC-Payload-Digest"].partition(":")[2], kind, int(head["X-Refers-To-Page"])))
                made = pd.DataFrame(rows, columns=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])
                yield made.astype({"page_id": "Int64", "refers_to": "Int64"})

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInPandas(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def round_trip(pages: DataFrame) -> DataFrame:
    """Pages to ARC, ARC to WARC, and the WARC files read back."""
    spark = pages.sparkSession
    arc, warc = scratch(spark, "arc"), scratch(spark, "warc")
    write_arc(pages.select("page_id", "url", "html"), arc)
    convert(spark, arc, warc)
    return read_warc(spark, warc)


ORACLE = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT payload_digest AS d, min(page_id) AS first FROM p WHERE payload_bytes >= 100 GROUP BY 1)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id > first THEN first END AS refers_to
FROM p LEFT JOIN f ON d = payload_digest
"""
