r"""WARC archives: writing captures, reading records, and assembling transactions.

Writing. A capture is a request, a response or revisit, and a metadata record; the first and last
name the middle one as concurrent. Records are text, so Spark's text writer writes them, with the
two line ends that close a record as its separator, gzipped, in files of about ``FILE_BYTES``. The
commit protocol of the writer makes the archives whole when executors are lost. Equal payloads of
``LEAST_BYTES`` and more are stored once: with the largest page id, the others revisit it. The
payloads' digests meet by partial aggregation; only digests that occur more than once are joined
back, broadcast where their written size allows, else by a shuffle whose hot keys are split.

Reading. Every file is read as a stream, record by record, by the length that each header gives;
one record is in memory at a time beside the compressed file.

Assembling. Records meet by the identifier of the response or revisit: their own, or the one they
are concurrent to. One nested row per capture follows.

Defined results: null html is an empty payload; rows without url have no target; line ends in a url
are escaped; rows of equal id and payload are captures of their own that share their records'
ids, and come back as many times; rows without id are never the one revisited unless no equal
payload has an id, then all of them are responses; records whose response is missing give a capture
with null response.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgrid.session import stage, stage_dir

LEAST_BYTES = 1000
FILE_BYTES = 32_000_000
LINE = "\r\n"
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

RECORD = (
    "record_id string, record_type string, concurrent_to string, refers_to string, target_uri string, "
    "date string, content_type string, payload_digest string, block_bytes long, payload_bytes long, "
    "payload_sha1 string, fields map<string, string>"
)


# -- writing -------------------------------------------------------------------------------------


def with_digest(pages: DataFrame) -> DataFrame:
    """(page_id, url, payload, bytes, digest) of ``pages (page_id, url, html)``."""
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("payload"))
    return rows.withColumns(
        {"bytes": F.octet_length("payload").cast("bigint"), "digest": F.sha1(F.col("payload").cast("binary"))}
    )


def with_revisits(rows: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """``rows`` with ``refers_to``, the page whose equal payload stands for a row's own."""
    large = rows.where(F.col("bytes") >= least_bytes).select("digest", "page_id")
    found = large.groupBy("digest").agg(F.count("*").alias("n"), F.max("page_id").alias("keeper"))
    found = stage(found.where("n > 1 and keeper is not null").drop("n"), "repeated")
    rows = rows.join(found, "digest", "left")
    own = F.coalesce(F.col("page_id") == F.col("keeper"), F.lit(False))
    return rows.withColumn("refers_to", F.when(~own, F.col("keeper"))).drop("keeper")


def record_name(page_id: Column, digest: Column, kind: str) -> Column:
    page = F.coalesce(page_id.cast("string"), F.lit(""))
    return F.concat(F.lit("<urn:page:"), page, F.lit(":"), digest, F.lit(f":{kind}>"))


def record(kind: Column | str, name: Column, block: Column, headers: list[tuple[str, Column | str | None]]) -> Column:
    """A record without the line ends that close it. Headers with a null value are left out."""
    lines = [
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), kind if isinstance(kind, Column) else F.lit(kind)),
        F.concat(F.lit("WARC-Record-ID: "), name),
        *(F.concat(F.lit(f"{k}: "), v if isinstance(v, Column) else F.lit(v)) for k, v in headers),
        F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")),
    ]
    return F.concat(F.concat_ws(LINE, *lines), F.lit(LINE * 2), block)


def capture_text(date: str = DATE) -> Column:
    """The three records of a row of ``with_revisits``."""
    page, digest = F.col("page_id"), F.col("digest")
    revisit = F.col("refers_to").isNotNull()
    url = F.replace(F.replace("url", F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    main = record_name(page, digest, "response")
    common = [("WARC-Target-URI", url), ("WARC-Date", date)]
    length = F.col("bytes").cast("string")
    head = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
        length,
        F.lit(LINE * 2),
    )
    host = F.coalesce(F.try_parse_url("url", F.lit("HOST")), F.lit(""))
    path = F.coalesce(F.try_parse_url("url", F.lit("FILE")), F.lit("/"))
    asked = F.concat(F.lit("GET "), path, F.lit(" HTTP/1.1\r\nHost: "), host, F.lit(LINE * 2))
    told = F.concat(F.lit("payload-length: "), length, F.lit(LINE))
    request = record(
        "request",
        record_name(page, digest, "request"),
        asked,
        [*common, ("WARC-Concurrent-To", main), ("Content-Type", "application/http;msgtype=request")],
    )
    response = record(
        F.when(revisit, "revisit").otherwise("response"),
        main,
        F.when(revisit, head).otherwise(F.concat(head, "payload")),
        [
            *common,
            ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), digest)),
            ("WARC-Profile", F.when(revisit, PROFILE)),
            ("WARC-Refers-To", F.when(revisit, record_name(F.col("refers_to"), digest, "response"))),
            ("Content-Type", "application/http;msgtype=response"),
        ],
    )
    metadata = record(
        "metadata",
        record_name(page, digest, "metadata"),
        told,
        [*common, ("WARC-Concurrent-To", main), ("Content-Type", "application/warc-fields")],
    )
    return F.concat_ws(LINE * 2, request, response, metadata)


def write_archives(pages: DataFrame, path: str, date: str = DATE, least_bytes: int = LEAST_BYTES) -> None:
    """Archives of ``pages (page_id, url, html)`` in the folder ``path``."""
    rows = with_digest(pages)
    mean = rows.agg(F.avg("bytes")).first()[0] or 0
    per_file = max(1, int(FILE_BYTES / (mean + 1000)))
    writer = with_revisits(rows, least_bytes).select(capture_text(date).alias("value")).write
    writer.option("lineSep", LINE * 2).option("maxRecordsPerFile", per_file).option("compression", "gzip").text(path)


# -- reading -------------------------------------------------------------------------------------


def parse(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers by lower-case name, block) of every record of an archive, gzipped or not."""
    gzipped = content[:2] == b"\x1f\x8b"
    stream = gzip.open(io.BytesIO(content)) if gzipped else io.BytesIO(content)
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no record begins with {line[:40]!r}")
        headers = {}
        while (line := stream.readline()).strip():
            name, _, value = line.decode().partition(":")
            headers[name.strip().lower()] = value.strip()
        size = int(headers["content-length"])
        block = stream.read(size)
        if len(block) < size:
            raise ValueError(f"record {headers.get('warc-record-id')} is cut off")
        yield headers, block


def record_row(headers: dict[str, str], block: bytes) -> tuple[tuple, bytes]:
    """A row of ``RECORD``, and the payload."""
    kind = headers.get("content-type", "")
    payload, fields = block, {}
    if kind.startswith("application/http"):
        payload = block.partition(b"\r\n\r\n")[2]
    elif kind == "application/warc-fields":
        lines = [x.partition(":") for x in block.decode().splitlines() if ":" in x]
        fields = {name.strip(): value.strip() for name, _, value in lines}
    row = (
        headers.get("warc-record-id"),
        headers.get("warc-type"),
        headers.get("warc-concurrent-to"),
        headers.get("warc-refers-to"),
        headers.get("warc-target-uri"),
        headers.get("warc-date"),
        kind or None,
        headers.get("warc-payload-digest"),
        len(block),
        len(payload),
        hashlib.sha1(payload).hexdigest(),
        fields,
    )
    return row, payload


def read_records(spark, path: str, payloads: bool = True) -> DataFrame:
    """Records of all archives in a folder, with their ``payload`` unless that is not wanted."""
    schema = RECORD + (", payload binary" if payloads else "")
    names = [x.split()[0] for x in RECORD.replace("map<string, string>", "map").split(", ")]

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for files in batches:
            for content in files["content"]:
                rows, size = [], 0
                for headers, block in parse(content):
                    row, payload = record_row(headers, block)
                    rows.append((*row, payload) if payloads else row)
                    size += len(payload) * payloads + 500
                    if size > 8_000_000:
                        yield pd.DataFrame(rows, columns=[*names, "payload"][: len(row) + payloads])
                        rows, size = [], 0
                if rows:
                    yield pd.DataFrame(rows, columns=[*names, "payload"][: len(row) + payloads])

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInPandas(read, schema)


# -- assembling ----------------------------------------------------------------------------------


def assemble(records: DataFrame) -> DataFrame:
    """(capture_id, request, response, metadata): one row per capture, each a nested record."""
    whole = F.struct(*records.columns)
    main = F.col("record_type").isin("response", "revisit")

    def of(kind: Column, name: str) -> Column:
        # the fields differ between copies in nothing that is compared, so any one will do
        return F.any_value(F.when(kind, whole), True).alias(name)

    grouped = records.groupBy(F.coalesce("concurrent_to", "record_id").alias("capture_id")).agg(
        of(F.col("record_type") == "request", "request"),
        of(main, "response"),
        of(F.col("record_type") == "metadata", "metadata"),
        F.greatest(F.count_if(main), F.lit(1)).alias("copies"),
    )
    copies = F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies")))
    return grouped.select("capture_id", "request", "response", "metadata", copies.alias("copy"))


def page_of(name: Column) -> Column:
    """Page id in a record's name."""
    found = F.regexp_extract(name, "^<urn:page:(-?[0-9]+):", 1)
    return F.when(found != "", found.cast("bigint"))


def capture_report(captures: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, intact) of captures.

    Length and digest of a response are those of the payload read; a revisit has none, so they are
    what its metadata record and its header tell of the payload.
    """
    revisit = F.col("response.record_type") == "revisit"
    told = F.regexp_replace("response.payload_digest", "^sha1:", "")
    length = F.col("metadata.fields")["payload-length"].cast("bigint")
    return captures.select(
        page_of(F.col("capture_id")).alias("page_id"),
        F.when(revisit, length).otherwise(F.col("response.payload_bytes")).alias("payload_bytes"),
        F.when(revisit, told).otherwise(F.col("response.payload_sha1")).alias("payload_digest"),
        F.col("response.record_type").alias("record_type"),
        F.when(revisit, page_of(F.col("response.refers_to"))).alias("refers_to"),
        (revisit | (told == F.col("response.payload_sha1"))).alias("intact"),
    )


def archive_and_read(pages: DataFrame) -> DataFrame:
    """Report of the captures read back from archives of ``pages``."""
    spark = pages.sparkSession
    path = f"{stage_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_archives(pages, path)
    return capture_report(assemble(read_records(spark, path, payloads=False)))
