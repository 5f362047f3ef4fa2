"""WARC archives: written record by record with an index, read back by coalesced byte ranges of selected records."""

from __future__ import annotations

import gzip
import hashlib
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinlink.llm.common import attach_small, open_fs
from kinlink.session import cut, scratch_path

INDEX = "path string, offset long, length long, page_id long, url string, digest string, record_type string, refers_to long"
RECORDS = "page_id long, url string, record_type string, refers_to long, digest string, payload string"


def record_types(pages: DataFrame, least: int = 1000) -> DataFrame:
    """``page_id, url, html, digest, record_type, refers_to``.

    Of pages with equal payloads of at least ``least`` bytes the one with the largest id is the response; others revisit
    it. Only digests that occur again are joined back, so no text is shuffled unless there are very many of them.
    """
    payload = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long"), "url", "html", F.sha1(payload.cast("binary")).alias("digest"), F.octet_length(payload).alias("_n"))
    again = rows.where(F.col("_n") >= least).groupBy("digest", "_n").agg(F.max("page_id").alias("_first"), F.count("*").alias("_rows"))
    again = cut(again.where("_rows > 1 AND _first IS NOT NULL").select("digest", "_n", "_first"), "warc-payloads")
    revisit = F.col("_first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_first"))
    kind = F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))
    return attach_small(rows, again, ["digest", "_n"]).select(
        "page_id", "url", "html", "digest", kind.alias("record_type"), F.when(revisit, F.col("_first")).alias("refers_to"),
    )


def record_bytes(row: dict, date: str) -> bytes:
    """One record as a gzip member; a revisit has the headers only."""
    payload = (row["html"] or "").encode() if row["record_type"] == "response" else b""
    block = b""
    if row["record_type"] == "response":
        block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode() + payload
    head = [
        "WARC/1.1", f"WARC-Type: {row['record_type']}", f"WARC-Date: {date}", f"WARC-Record-ID: <urn:page:{row['page_id']}>",
        f"WARC-Payload-Digest: sha1:{row['digest']}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    if row["url"] is not None:
        # A line break would end the header.
        head.append("WARC-Target-URI: " + row["url"].replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A"))
    if row["record_type"] == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{row['refers_to']}>"]
    return gzip.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", 6, mtime=0)


def parse_record(data: bytes) -> dict:
    """Fields and payload of one gzip member."""
    head, _, block = gzip.decompress(data).partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = block[: int(fields["Content-Length"])]
    number = lambda name: int(m[1]) if (m := re.search(r"page:(-?\d+)>", fields.get(name, ""))) else None
    url = fields.get("WARC-Target-URI")
    return {
        "page_id": number("WARC-Record-ID"), "record_type": fields["WARC-Type"], "refers_to": number("WARC-Refers-To"),
        "url": None if url is None else url.replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%"),
        "digest": fields["WARC-Payload-Digest"].removeprefix("sha1:"), "payload": block.partition(b"\r\n\r\n")[2],
    }


def write_archives(records: DataFrame, folder: str, most: int = 256 << 20, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Write rows of ``record_types`` as ``.warc.gz`` files of about ``most`` bytes; returns the written index.

    The index has path, offset, length, URL and digest of every record. A task that runs again writes new files, and only
    records of finished tasks get into the index, so it says which archives count.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = open_fs(folder)
        system.create_dir(root, recursive=True)
        out, name, at = None, "", 0
        for batch in batches:
            index = []
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                if out is None or at >= most:
                    if out is not None:
                        out.close()
                    name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                    out = system.open_output_stream(f"{root}/{name}", compression=None)
                data = record_bytes(row, date)
                out.write(data)
                index.append({"path": f"{folder.rstrip('/')}/{name}", "offset": at, "length": len(data)} | {k: row[k] for k in ("page_id", "url", "digest", "record_type", "refers_to")})
                at += len(data)
            if index:
                yield pa.RecordBatch.from_pylist(index, schema=pa.schema([("path", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("page_id", pa.int64()), ("url", pa.string()), ("digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())]))
        if out is not None:
            out.close()

    return cut(records.mapInArrow(write, INDEX), "warc-index")


def read_records(index: DataFrame, gap: int = 64 << 10, most: int = 8 << 20) -> DataFrame:
    """The records an index (or a selection of one) names: ``page_id, url, record_type, refers_to, digest, payload``.

    Records are range-partitioned and sorted by path and offset; neighbours at most ``gap`` bytes apart are fetched by one
    read of about ``most`` bytes. The digest is computed from the payload of responses and checked against the record's.
    """

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system = file = name = None
        for batch in batches:
            rows = list(zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True))
            first = 0
            while first < len(rows):
                path, start, length = rows[first]
                stop, last = start + length, first + 1
                while last < len(rows) and rows[last][0] == path and rows[last][1] - stop <= gap and rows[last][1] + rows[last][2] - start <= most:
                    stop, last = rows[last][1] + rows[last][2], last + 1
                if path != name:
                    system, inside = open_fs(path)
                    file, name = system.open_input_file(inside), path
                data = file.read_at(stop - start, start)
                found = []
                for _, at, n in rows[first:last]:
                    record = parse_record(data[at - start : at - start + n])
                    if record["record_type"] == "response":
                        digest = hashlib.sha1(record["payload"]).hexdigest()
                        if digest != record["digest"]:
                            raise ValueError(f"payload of {path} at {at} does not match its digest")
                    found.append(record | {"payload": record["payload"].decode() if record["record_type"] == "response" else None})
                yield pa.RecordBatch.from_pylist(found, schema=pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("digest", pa.string()), ("payload", pa.string())]))
                first = last

    size = index.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    n = max(int(index.sparkSession.conf.get("spark.sql.shuffle.partitions")), size // (64 << 20))
    ranges = index.select("path", "offset", "length").repartitionByRange(n, "path", "offset").sortWithinPartitions("path", "offset")
    return ranges.mapInArrow(fetch, RECORDS)


def archive_round_trip(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """``page_id, payload_bytes, payload_digest, record_type, refers_to, url`` of every page, read back from archives.

    A revisit's length comes from the response it refers to. Defined results: a null html is an empty payload; null ids
    are never referred to and revisit a response that has an id; rows that repeat the largest id of a payload are all
    responses; null URLs have no target header; an empty table gives an empty result; other columns are not read.
    """
    spark = pages.sparkSession
    index = write_archives(record_types(pages), folder or scratch_path(spark, "warc"))
    read = read_records(index).select("page_id", "url", "record_type", "refers_to", "digest", F.octet_length("payload").cast("long").alias("_n"))
    read = cut(read, "warc-read")
    revisits = read.where("record_type = 'revisit'")
    named = revisits.select(F.col("refers_to").alias("page_id"), "digest").distinct()
    full = read.where("record_type = 'response'").join(named, ["page_id", "digest"], "left_semi")
    full = cut(full.groupBy(F.col("page_id").alias("refers_to"), "digest").agg(F.max("_n").alias("_full")), "warc-referred")
    rows = attach_small(revisits, full, ["refers_to", "digest"]).withColumn("_n", F.col("_full")).drop("_full")
    return read.where("record_type = 'response'").unionByName(rows).select(
        "page_id", F.col("_n").alias("payload_bytes"), F.col("digest").alias("payload_digest"), "record_type", "refers_to", "url",
    )
