"""WARC archives: writing captures as request, response and metadata records, and assembling them again.

Each page becomes three records. The response has the payload; where an earlier page has the same payload, a revisit
record with the payload's digest and HTTP header stands in its place and names that page's response in WARC-Refers-To. Request and
metadata name the response in WARC-Concurrent-To. Each record is a gzip member of its own, so that it can be read
alone from its place in the archive. Spark's text writer writes the archives, a member a row, so the files are committed and kept
on whatever store the folder is on; what it puts between rows is the empty gzip member. A file holds FILE_BYTES of
compressed records, or one record that is larger.

Archives are read as binary files and cut by Content-Length, so a payload may contain anything. Records of a transaction may lie in
different files; they meet by the identifier of the response. One row per capture comes out, with its payload; a
revisit has the record and the metadata of the response that it refers to.

A null payload counts as an empty one. A null or empty address has no target header. Line breaks in an address are
percent-encoded. Rows with the same payload and the same smallest page_id are all responses; a null page_id never is
the smallest. Repeated rows are captures of their own; revisits refer to one of the responses. Of a transaction without its request
or metadata, these parts are null, and so is the original of a revisit whose response is not there.
"""

from __future__ import annotations

import gzip
import io
from collections.abc import Iterator
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelfline.llm.common import new_folder, slices, stored, whole_text

#: Smaller payloads are always stored.
LEAST_REVISIT_BYTES = 100
#: Compressed bytes of a file, but for the last record in it.
FILE_BYTES = 64 << 20
#: Digests of repeated payloads that are broadcast at most; more of them meet the pages in a join.
BROADCAST_DIGESTS = 500_000
#: What stands between the members: one without content.
BETWEEN = gzip.compress(b"", mtime=0)
#: Bytes of records that the reader hands on at a time.
BATCH_BYTES = 8 << 20
#: The date of captures whose table has none.
DATE = "1970-01-01T00:00:00Z"
END = "\r\n"
EMPTY_LINES = b"\r\n\r\n"

RECORD = ("record_id string, type string, concurrent_to string, target_uri string, date string, "
          "payload_digest string, refers_to string, http_length bigint, fields map<string,string>, block_bytes bigint, "
          "payload binary")


def record(kind: str, identifier: Column, block: Column, content: str, *headers: Column) -> Column:
    """A record as text; the headers given are lines without their end, null ones are left out."""
    lines = F.concat_ws(END, F.lit("WARC/1.1"), F.lit(f"WARC-Type: {kind}"),
                        F.concat(F.lit("WARC-Record-ID: "), identifier), *headers, F.lit(f"Content-Type: {content}"),
                        F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")))
    return F.concat(lines, F.lit(END * 2), block)


def with_first_pages(pages: DataFrame, payload: str = "html", key: str = "page_id", url: str = "url",
                     broadcast_digests: int = BROADCAST_DIGESTS) -> DataFrame:
    """Pages with the digest of their payload, whether another page has it already (again), and whether revisits refer to
    this row (original)."""
    rows = pages.select(F.col(key).alias("page_id"), F.col(url).alias("url"), whole_text(payload).alias("html"))
    keyed = rows.withColumn("bytes", F.octet_length("html").cast("long")).withColumn(
        "digest", F.sha2(F.col("html").cast("binary"), 256))
    large = keyed.filter(F.col("bytes") >= LEAST_REVISIT_BYTES)
    counted = large.groupBy("digest", "page_id").agg(F.count("*").alias("rows"))
    repeated = stored(counted.groupBy("digest").agg(
        F.min("page_id").alias("first"), F.min_by("rows", "page_id").alias("firsts"), F.sum("rows").alias("copies")).filter(
        "copies > 1 and first is not null").drop("copies"), "digests")
    few = repeated.count() <= broadcast_digests
    found = keyed.join(F.broadcast(repeated) if few else repeated, "digest", "left")
    is_first = F.coalesce(F.col("page_id") == F.col("first"), F.lit(False))
    again = F.col("first").isNotNull() & ~is_first
    if repeated.filter("firsts > 1").isEmpty():
        named = found.withColumn("original", is_first)
    else:  # of repeated rows with the smallest key one is referred to
        tied = is_first & (F.col("firsts") > 1)
        one = F.row_number().over(Window.partitionBy("digest").orderBy(F.lit(0))) == 1
        named = found.filter(~tied).withColumn("original", is_first).unionByName(found.filter(tied).withColumn("original", one))
    return named.withColumn("again", again).drop("first", "firsts")


def identifier_of(digest: Column) -> Column:
    """The name of the record that holds a repeated payload, as a UUID made of its digest."""
    part = lambda start, size: F.substring(digest, start, size)
    return F.concat_ws("-", part(1, 8), part(9, 4), F.concat(F.lit("8"), part(14, 3)), F.concat(F.lit("a"), part(18, 3)), part(21, 12))


def archive_records(pages: DataFrame, date: str = DATE) -> DataFrame:
    """The records of pages with what `with_first_pages` tells, one row each."""
    address = F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A")
    target = F.when(F.length("url") > 0, F.concat(F.lit("WARC-Target-URI: "), address))
    dated = F.lit(f"WARC-Date: {date}")
    named = lambda c: F.concat(F.lit("<urn:uuid:"), c, F.lit(">"))
    rows = pages.withColumns({n: F.expr("uuid()") for n in ("request_id", "metadata_id")}).withColumn(
        "response_id", F.when(F.col("original"), identifier_of(F.col("digest"))).otherwise(F.expr("uuid()")))
    digest = F.concat(F.lit("WARC-Payload-Digest: sha256:"), F.col("digest"))
    together = F.concat(F.lit("WARC-Concurrent-To: "), named(F.col("response_id")))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{END}Content-Type: text/html; charset=utf-8{END}Content-Length: "),
                    F.col("bytes").cast("string"), F.lit(END * 2))
    path = F.coalesce(F.regexp_extract(address, "^[a-zA-Z]+://[^/]*(/[^ #]*)", 1), F.lit(""))
    asked = F.concat(F.lit("GET "), F.when(path == "", "/").otherwise(path), F.lit(f" HTTP/1.1{END}Host: "),
                     F.coalesce(F.regexp_extract(address, "^[a-zA-Z]+://([^/]*)", 1), F.lit("")), F.lit(END * 2))
    fields = F.concat_ws(END, F.concat(F.lit("page-id: "), F.col("page_id").cast("string")), F.lit(""))
    refers = F.concat(F.lit("WARC-Refers-To: "), named(identifier_of(F.col("digest"))))
    profile = F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
    main = F.when(~F.col("again"), record(
        "response", named(F.col("response_id")), F.concat(http, F.col("html")), "application/http;msgtype=response",
        dated, target, digest)).otherwise(record(
            "revisit", named(F.col("response_id")), http, "application/http;msgtype=response", dated, target, digest, profile,
            refers))
    return rows.select(F.explode(F.array(
        record("request", named(F.col("request_id")), asked, "application/http;msgtype=request", dated, target, together),
        main,
        record("metadata", named(F.col("metadata_id")), fields, "application/warc-fields", dated, target, together),
    )).alias("value"))


def write_archives(records: DataFrame, folder: str, file_bytes: int = FILE_BYTES) -> None:
    """Records as archives in a new folder that all executors see."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        volume, size = 0, 0
        for part in slices(batches):
            members, volumes = [], []
            for value in part.column("value"):
                members.append(gzip.compress(value.as_py() + EMPTY_LINES, mtime=0))
                own = len(members[-1]) + len(BETWEEN)
                if size and size + own > file_bytes:
                    volume, size = volume + 1, 0
                volumes.append(volume)
                size += own
            yield pa.RecordBatch.from_arrays([pa.array(volumes, pa.int32()), pa.array(members, pa.binary())], names=["volume", "value"])

    packed = records.select(F.col("value").cast("binary").alias("value")).mapInArrow(run, "volume int, value binary")
    (packed.select("volume", F.col("value").cast("string").alias("value")).write.partitionBy("volume")
     .option("encoding", "ISO-8859-1").option("lineSep", BETWEEN.decode("latin-1")).text(folder))


def headers_of(file: io.BufferedIOBase) -> dict[str, str] | None:
    """The next record's headers by name in lower case; None at the end of the file."""
    line = file.readline()
    while line in (b"\r\n", b"\n"):
        line = file.readline()
    if not line:
        return None
    if not line.startswith(b"WARC/"):
        raise ValueError(f"not the start of a record: {line[:40]!r}")
    found: dict[str, str] = {}
    while (line := file.readline()) not in (b"\r\n", b"\n", b""):
        name, _, value = line.decode("utf-8", errors="replace").partition(":")
        found[name.strip().lower()] = value.strip()
    return found


def parse_fields(text: bytes) -> dict[str, str]:
    lines = (x.partition(":") for x in text.decode("utf-8", errors="replace").splitlines())
    return {name.strip().lower(): value.strip() for name, sign, value in lines if sign}


def parse_archive(content: bytes) -> Iterator[dict]:
    """The records of one archive, compressed or not."""
    source = io.BytesIO(content)
    file = io.BufferedReader(gzip.GzipFile(fileobj=source)) if content[:2] == b"\x1f\x8b" else source
    while (headers := headers_of(file)) is not None:
        size = int(headers["content-length"])
        block = file.read(size)
        if len(block) != size:
            raise ValueError("an archive ends within a record")
        kind, payload, fields, length = headers.get("warc-type"), None, None, None
        if kind in ("response", "revisit", "request"):
            head, _, body = block.partition(b"\r\n\r\n")
            http = parse_fields(head)
            length = int(http["content-length"]) if "content-length" in http else None
            fields = http
            payload = body if kind == "response" else None
        elif kind == "metadata":
            fields = parse_fields(block)
        digest = headers.get("warc-payload-digest")
        yield {"record_id": headers.get("warc-record-id"), "type": kind,
               "concurrent_to": headers.get("warc-concurrent-to"), "target_uri": headers.get("warc-target-uri"),
               "date": headers.get("warc-date"), "payload_digest": digest.partition(":")[2] if digest else None,
               "refers_to": headers.get("warc-refers-to"), "http_length": length, "fields": list(fields.items()) if fields is not None else None,
               "block_bytes": size, "payload": payload}


def read_records(spark: SparkSession, folder: str) -> DataFrame:
    """The records of all archives in a folder, one row each."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    schema = to_arrow_schema(_parse_datatype_string(RECORD))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        size = 0
        for batch in batches:
            for content in batch.column("content"):
                for found in parse_archive(content.as_py()):
                    held.append(found)
                    size += found["block_bytes"] + 500
                    if size > BATCH_BYTES:
                        yield pa.RecordBatch.from_pylist(held, schema=schema)
                        held, size = [], 0
        if held:
            yield pa.RecordBatch.from_pylist(held, schema=schema)

    return spark.read.format("binaryFile").load(folder).select("content").mapInArrow(run, RECORD)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: what the records that are concurrent with one response say together.

    The digest and the length are of the payload itself where there is one. Parts that are not asked for afterwards are not
    shuffled.
    """
    main, body = F.col("type").isin("response", "revisit"), F.col("payload").isNotNull()
    of = lambda kind, name: F.max(F.when(F.col("type") == kind, F.col(name)))
    response = lambda name: F.max(F.when(main, F.col(name)))
    rows = records.filter(F.col("type").isin("request", "response", "revisit", "metadata")).withColumns({
        "capture_id": F.when(main, F.col("record_id")).otherwise(F.coalesce("concurrent_to", "record_id")),
        "pairs": F.array_sort(F.map_entries("fields")),
        "digest": F.when(body, F.sha2("payload", 256)).otherwise(F.col("payload_digest")),
        "length": F.when(body, F.octet_length("payload").cast("long")).otherwise(F.col("http_length"))})
    met = rows.groupBy("capture_id").agg(
        response("target_uri").alias("target_uri"), response("date").alias("date"),
        of("request", "record_id").alias("request_id"), of("request", "pairs").alias("request_headers"),
        response("type").alias("type"), response("digest").alias("digest"), response("length").alias("length"),
        response("refers_to").alias("refers_to"), response("payload").alias("payload"),
        of("metadata", "record_id").alias("metadata_id"), of("metadata", "pairs").alias("metadata_fields"))
    return met.select(
        "capture_id", "target_uri", "date",
        F.struct(F.col("request_id").alias("record_id"), F.map_from_entries("request_headers").alias("headers")).alias("request"),
        F.struct("type", "digest", "length", "refers_to", "payload").alias("response"),
        F.struct(F.col("metadata_id").alias("record_id"), F.map_from_entries("metadata_fields").alias("fields")).alias("metadata"))


def with_originals(captures: DataFrame) -> DataFrame:
    """captures, which should be stored, with original: what a revisit refers to (its address, date and metadata)."""
    held = captures.filter(F.col("response.type") == "response").select(
        F.col("capture_id").alias("_refers_to"), F.struct("capture_id", "target_uri", "date", "metadata").alias("original"))
    return captures.join(held, F.col("response.refers_to") == F.col("_refers_to"), "left").drop("_refers_to")


def archive_round_trip(pages: DataFrame) -> DataFrame:
    """Write the pages to archives in the shared folder, read them back, and tell what each page's capture holds."""
    spark = pages.sparkSession
    folder = new_folder(spark, "warc")
    write_archives(archive_records(with_first_pages(pages)), folder)
    found = assemble(read_records(spark, folder))
    told = found.withColumn("response", F.col("response").dropFields("payload"))  # digests tell of it, so none is shuffled
    captures = with_originals(stored(told, "captures"))
    return captures.select(
        F.col("metadata.fields")["page-id"].cast("long").alias("page_id"), F.col("response.length").alias("payload_bytes"),
        F.col("response.digest").alias("payload_digest"), F.col("response.type").alias("record_type"),
        F.col("original.metadata.fields")["page-id"].cast("long").alias("refers_to"))
