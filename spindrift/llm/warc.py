"""WARC archives and the assembly of transactions.

Writing: each page becomes a request, a response (or a revisit of an earlier equal
payload) and a metadata record, the text writer's line separator being the blank
lines that end a record. Reading: archives are taken apart by their records'
lengths, and request, response and metadata records are joined through their
concurrent-to identifiers into one nested row a capture.

Defined results: a null html counts as an empty payload, equal to other empty ones;
a null url as ``about:blank``. Of equal payloads of at least ``least`` bytes the
records with the smallest page_id are responses (all of them, if rows repeat) and
the others revisits; a null page_id never counts as smallest unless there is no
other. Rows are told apart by record identifiers of their own, so that repeated
rows and ids come back as often as they came. An empty table gives an empty
archive and an empty result. Further columns are not read.
"""

from __future__ import annotations

import gzip
import hashlib
import re
from base64 import b32encode
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import detached, materialise, remove, shared_path, table

END = "\r\n\r\n"
#: Records of an archive file at most, and bytes of their payloads: files are read
#: whole, so the longest page decides how many there may be.
FILE_RECORDS, FILE_BYTES = 6000, 256_000_000
DATE = "2026-01-01T00:00:00Z"


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1: five hexadecimal digits are four of base 32."""
    digits = F.sha1(payload)
    groups = [F.lpad(F.conv(F.substring(digits, 1 + 5 * k, 5), 16, 32), 4, "0") for k in range(8)]
    return F.translate(F.concat(*groups), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def classified(pages: DataFrame, least: int = 0) -> DataFrame:
    """Pages with payload, digest, ``first`` (page_id of the response that a revisit
    refers to, else null) and a record number. Only digests that occur more than
    once are joined back, over an exchange of their own that can be split if one
    payload is very common."""
    p = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.coalesce(F.col("url"), F.lit("about:blank")).alias("url"),
        F.coalesce(F.col("html"), F.lit("")).alias("payload"),
    )
    p = p.withColumn("bytes", F.octet_length("payload").cast("long")).withColumn("digest", base32_sha1(F.col("payload")))
    p = p.withColumn("row", F.monotonically_increasing_id())
    groups = p.where(F.col("bytes") >= least).groupBy("digest").agg(F.min("page_id").alias("low"), F.min_by("row", "page_id").alias("low_row"), F.count("*").alias("n"))
    repeated = groups.where("n > 1").select(detached(F.col("digest")).alias("d"), "low", "low_row")
    joined = p.join(repeated, F.col("digest") == F.col("d"), "left")
    revisit = F.col("low").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("low")) & (F.col("bytes") >= least)
    return joined.select("page_id", "url", "payload", "bytes", "digest", "row", F.when(revisit, F.col("low")).alias("first"), "low_row")


def _header(kind: str | Column, record: Column, length: Column, content: str, *fields: tuple[str, Column]) -> Column:
    kind = F.lit(kind) if isinstance(kind, str) else kind
    lines = [F.lit("WARC/1.1"), F.concat(F.lit("WARC-Type: "), kind), F.concat(F.lit("WARC-Record-ID: "), record), F.lit(f"WARC-Date: {DATE}")]
    # a field of a null value is left out: concat gives null, concat_ws skips it
    lines += [F.concat(F.lit(f"{name}: "), value) for name, value in fields]
    lines += [F.lit(f"Content-Type: {content}"), F.concat(F.lit("Content-Length: "), length.cast("string"))]
    return F.concat(F.concat_ws("\r\n", *lines), F.lit(END))


def records(pages: DataFrame, least: int = 0) -> DataFrame:
    """One column ``record``: the records' text without the blank lines that end it."""
    p = classified(pages, least)
    page = F.coalesce(F.col("page_id").cast("string"), F.lit("null"))

    def urn(kind: str) -> Column:
        return F.concat(F.lit(f"<urn:capture:{kind}:"), page, F.lit(":"), F.col("row").cast("string"), F.lit(">"))

    target = F.regexp_replace("url", r"[\r\n]", "")
    path = F.coalesce(F.nullif(F.regexp_extract(target, r"^[a-z]+://[^/]*(/[^#]*)", 1), F.lit("")), F.lit("/"))
    host = F.regexp_extract(target, r"^[a-z]+://([^/]*)", 1)
    ask = F.concat(F.lit("GET "), F.replace(path, F.lit(" "), F.lit("%20")), F.lit(" HTTP/1.1\r\nHost: "), host, F.lit(END))
    # a revisit keeps the headers, hence the full length, and no payload
    answer = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("bytes").cast("string"), F.lit(END))
    body = F.when(F.col("first").isNull(), F.concat(answer, F.col("payload"))).otherwise(answer)
    note = F.concat(F.lit("page-id: "), page, F.lit("\r\n"))
    uri = ("WARC-Target-URI", target)
    together = ("WARC-Concurrent-To", urn("response"))
    kind = F.when(F.col("first").isNull(), "response").otherwise("revisit")
    referred = F.concat(F.lit("<urn:capture:response:"), F.col("first").cast("string"), F.lit(":"), F.col("low_row").cast("string"), F.lit(">"))
    profile = F.when(F.col("first").isNotNull(), "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
    made = [
        F.concat(_header("request", urn("request"), F.octet_length(ask), "application/http; msgtype=request", uri, together), ask),
        F.concat(
            _header(kind, urn("response"), F.octet_length(body), "application/http; msgtype=response", uri,
                    ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))), ("WARC-Profile", profile), ("WARC-Refers-To", referred)),
            body,
        ),
        F.concat(_header("metadata", urn("metadata"), F.octet_length(note), "application/warc-fields", uri, together), note),
    ]
    return p.select(F.explode(F.array(*made)).alias("record"))


def write_archives(pages: DataFrame, path: str, least: int = 0) -> None:
    """Archives of ``pages`` under ``path``, compressed as a whole each. Numbers of
    rows come from scans alone, which a task that is run again repeats."""
    longest = pages.select(F.max(F.octet_length("html"))).first()[0] or 0
    some = max(3, min(FILE_RECORDS, 3 * FILE_BYTES // max(1, longest)))
    out = records(pages, least).write.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", some)
    out.text(path)


READ = "record_id string, kind string, concurrent_to string, refers_to string, target_uri string, digest string, http string, payload binary, payload_bytes long, payload_digest string, fields string"


def parse(data: bytes) -> Iterator[dict]:
    """Records of an archive's bytes, found by their Content-Length."""
    at, n = 0, len(data)
    while at < n:
        stop = data.index(b"\r\n\r\n", at)
        lines = data[at:stop].decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no record at byte {at}")
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        begin = stop + 4
        end = begin + int(fields["content-length"])
        if end > n:
            raise ValueError(f"the record at byte {at} is cut off")
        yield {"fields": fields, "block": data[begin:end]}
        at = end
        while data[at : at + 2] == b"\r\n" and data[at : at + 5] != b"WARC/":
            at += 2


_LENGTH = re.compile(rb"(?im)^content-length:\s*(\d+)")


def _read_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["record_id", "kind", "concurrent_to", "refers_to", "target_uri", "digest", "http", "payload", "payload_bytes", "payload_digest", "fields"]
    kinds = [pa.string()] * 7 + [pa.binary(), pa.int64(), pa.string(), pa.string()]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)

    for b in batches:
        for content in b.column(0):
            data = content.as_buffer().to_pybytes()
            data = gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data
            rows: list[tuple] = []
            held = 0
            for r in parse(data):
                f, block = r["fields"], r["block"]
                kind = f["warc-type"]
                http, payload, size, digest, text = None, None, None, None, None
                if kind in ("response", "revisit", "request"):
                    head, _, payload = block.partition(b"\r\n\r\n")
                    http = head.decode("utf-8", "replace")
                    said = f.get("warc-payload-digest", "").rpartition(":")[2]
                    if kind == "revisit":  # the payload is the referred record's; its length and digest are noted here
                        found = _LENGTH.search(head)
                        size, digest, payload = int(found[1]) if found else None, said or None, None
                    elif kind == "response":
                        size, digest = len(payload), b32encode(hashlib.sha1(payload).digest()).decode()
                        if said and said != digest:
                            raise ValueError(f"{f['warc-record-id']}: the payload does not have the digest {said}")
                else:
                    text = block.decode("utf-8", "replace")
                rows.append((f["warc-record-id"], kind, f.get("warc-concurrent-to"), f.get("warc-refers-to"), f.get("warc-target-uri"), f.get("warc-payload-digest"), http, payload, size, digest, text))
                held += len(block)
                if held > 8_000_000:
                    yield batch(rows)
                    rows, held = [], 0
            if rows:
                yield batch(rows)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Records of all archives under ``path``, payload lengths and digests computed
    from what was read and, where a record notes a digest, held against it."""
    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(_read_batches, READ)


def assemble(found: DataFrame) -> DataFrame:
    """One row a capture: its response or revisit with the request and metadata that
    name it as concurrent (null where there is none)."""
    main = found.where(F.col("kind").isin("response", "revisit"))
    request = found.where("kind = 'request'").select(F.col("concurrent_to").alias("__q"), F.struct("record_id", "http", "payload").alias("request"))
    metadata = found.where("kind = 'metadata'").select(F.col("concurrent_to").alias("__m"), F.struct("record_id", "fields").alias("metadata"))
    return (
        main.join(request, F.col("record_id") == F.col("__q"), "left")
        .join(metadata, F.col("record_id") == F.col("__m"), "left")
        .select(
            F.col("record_id").alias("capture_id"),
            "target_uri",
            F.struct("kind", "refers_to", "http", "payload", "payload_bytes", "payload_digest").alias("response"),
            "request",
            "metadata",
        )
    )


def op3_warc_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "warc")
    write_archives(table(spark, sf_dir, "pages"), path)
    # taken apart once: requests, answers and metadata are then read by their columns
    found = materialise(read_archives(spark, path), "records")
    remove(spark, path)  # what was in the archives has been read back
    captures = assemble(found)
    r = F.col("response")
    page = F.regexp_extract(F.col("metadata.fields"), r"page-id: (-?\d+)", 1)
    return captures.select(
        F.nullif(page, F.lit("")).cast("long").alias("page_id"),
        r["payload_bytes"].alias("payload_bytes"),
        r["payload_digest"].alias("payload_digest"),
        r["kind"].alias("record_type"),
        F.nullif(F.regexp_extract(r["refers_to"], r"response:(-?\d+)", 1), F.lit("")).cast("long").alias("refers_to"),
        F.col("capture_id"),
        F.col("request.record_id").alias("request_id"),
    )
