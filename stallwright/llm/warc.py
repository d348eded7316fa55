"""WARC archives: writing with revisits, reading, and transaction assembly.

Every capture is a transaction of three records: a response (or a revisit of an
equal payload), the request, and a metadata record, the last two tied to the first
by WARC-Concurrent-To. Reading parses each archive as a stream; assembly joins the
records through those identifiers and gives one nested row for each capture.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import uuid
from collections.abc import Iterator
from urllib.parse import urlsplit

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh_path, open_in, open_out, written

#: Equal payloads of at least so many bytes are stored once.
REVISIT_BYTES = 0
#: A task starts a new archive beyond so many compressed bytes.
ROLL_BYTES = 256 << 20
#: Equal rows beyond so many are spread over tasks.
COPIES = 1_000
LEVEL = 3
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORDS = "record_id string, type string, uri string, concurrent_to string, refers_to string, digest string, payload_bytes long, payload_digest string, fields map<string,string>, payload binary"
_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32(hexed):
    """Bare base-32 of a 40-digit hexadecimal column."""
    five = lambda i: F.conv(F.substring(hexed, (i // 4) * 5 + 1, 5), 16, 10).cast("int")
    digit = lambda i: F.shiftright(five(i), 15 - 5 * (i % 4)).bitwiseAND(31)
    return F.concat(*[F.substring(F.lit(_BASE32), digit(i) + 1, F.lit(1)) for i in range(32)])


def captures_to_write(pages: DataFrame, revisit_bytes: int = REVISIT_BYTES) -> DataFrame:
    """pages(page_id, url, html) -> (cap, page_id, url, payload, refers_cap), a capture
    for each row; refers_cap is a capture that holds an equal payload, of those one
    with the largest page_id. All captures with that page_id hold the payload
    themselves (refers_cap is null). A null id is smaller than any other."""
    text = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.encode(text, "UTF-8").alias("payload"))
    rows = rows.withColumn("sha", F.sha1("payload"))
    rows = rows.withColumn("cap", F.md5(F.concat_ws("|", F.coalesce(F.col("page_id").cast("string"), F.lit("null")), F.coalesce(F.concat(F.lit("u"), "url"), F.lit("")), F.col("sha"))))
    # Equal rows are counted before anything is joined; the keys carry no payload.
    keys = written(rows.groupBy("cap", "page_id", "sha").agg(F.count("*").alias("n"), F.first(F.octet_length("payload")).alias("size")), "warc-keys")
    top = written(keys.where(F.col("size") >= revisit_bytes).groupBy("sha").agg(F.max(F.struct("page_id", "cap")).alias("top")), "warc-top")
    other = F.col("top").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("top.page_id"))
    refers = keys.join(top, "sha", "left").select("cap", "n", F.when(other, F.col("top.cap")).alias("refers_cap"))
    once = rows.drop("sha").dropDuplicates(["cap"]).join(refers, "cap")
    # The copies of a row leave its task only where they are many.
    many = (keys.agg(F.max("n")).first()[0] or 0) > COPIES
    if many:
        once = once.withColumn("first", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"), F.lit(COPIES).cast("long")))).repartition("cap", "first")
    first = F.col("first") if many else F.lit(1).cast("long")
    copies = once.withColumn("copy", F.explode(F.sequence(first, F.least(F.col("n"), first + COPIES - 1))))
    cap = F.when(F.col("copy") == 1, F.col("cap")).otherwise(F.md5(F.concat_ws("|", "cap", F.lit("copy"), F.col("copy").cast("string"))))
    return copies.select(cap.alias("cap"), "page_id", "url", "payload", "refers_cap")


def _record(kind: str, record_id: str, content: bytes, mime: str, **fields: str | None) -> bytes:
    named = [f"{k.replace('_', '-')}: {v}" for k, v in fields.items() if v is not None]
    head = [f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Record-ID: {record_id}\r\nWARC-Date: {DATE}", *named, f"Content-Type: {mime}\r\nContent-Length: {len(content)}"]
    return gzip.compress("\r\n".join(head).encode() + b"\r\n\r\n" + content + b"\r\n\r\n", LEVEL, mtime=0)


def record_id(cap: str, what: int = 0) -> str:
    """Identifier of a capture's main record (0), request (1) or metadata (2)."""
    h = cap if not what else hashlib.md5(f"{cap}|{what}".encode()).hexdigest()
    return f"<urn:uuid:{h[:8]}-{h[8:12]}-{h[12:16]}-{h[16:20]}-{h[20:]}>"


def transaction(cap: str, page_id: int | None, url: str | None, payload: bytes, refers_cap: str | None) -> bytes:
    """The three records of a capture, each a gzip member."""
    uri = None if url is None else "".join(f"%{ord(c):02X}" if ord(c) < 33 or ord(c) == 127 else c for c in url)
    main = record_id(cap)
    digest = "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode()
    parts = urlsplit(uri or "")
    status = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    common = {"WARC_Target_URI": uri, "WARC_Payload_Digest": digest}
    if refers_cap is None:
        first = _record("response", main, status + payload, "application/http;msgtype=response", **common)
    else:
        first = _record("revisit", main, status, "application/http;msgtype=response", **common, WARC_Refers_To=record_id(refers_cap), WARC_Profile=PROFILE)
    request = f"GET {parts.path or '/'}{'?' + parts.query if parts.query else ''} HTTP/1.1\r\nHost: {parts.netloc}\r\n\r\n".encode()
    about = b"" if page_id is None else f"page-id: {page_id}\r\n".encode()
    tied = {"WARC_Target_URI": uri, "WARC_Concurrent_To": main}
    return first + _record("request", record_id(cap, 1), request, "application/http;msgtype=request", **tied) + _record("metadata", record_id(cap, 2), about, "application/warc-fields", **tied)


def write_warc(pages: DataFrame, folder: str, revisit_bytes: int = REVISIT_BYTES) -> DataFrame:
    """pages(page_id, url, html, ...) -> .warc.gz archives in ``folder``; returns the
    manifest (uri, n_captures), a table in ``folder``, too. A null html is an empty
    payload, a null url leaves the target out, repeated equal rows are a capture each
    (of one kind), an empty table writes nothing. A task writes under names of its own;
    files of failed attempts aren't in the manifest."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        out, uri, size, n = None, "", 0, 0
        done: list[tuple[str, int]] = []
        for b in batches:
            for row in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
                if out is None:
                    uri, size, n = f"{folder}/{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = open_out(uri)
                data = transaction(*row)
                out.write(data)
                size, n = size + len(data), n + 1
                if size >= ROLL_BYTES:
                    out.close()
                    done, out = [*done, (uri, n)], None
        if out is not None:
            out.close()
            done.append((uri, n))
        if done:
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in done]), pa.array([x[1] for x in done], pa.int64())], ["uri", "n_captures"])

    rows = captures_to_write(pages, revisit_bytes).select("cap", "page_id", "url", "payload", "refers_cap")
    return written(rows.mapInArrow(run, "uri string, n_captures long"), "warc", f"{folder}/manifest-{uuid.uuid4().hex}")


def parse_records(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """(lower-case header fields, content block) of each record of an archive."""
    with gzip.GzipFile(fileobj=stream) as f:
        f = io.BufferedReader(f, 1 << 20)
        while line := f.readline():
            if not line.strip():
                continue
            if not line.startswith(b"WARC/"):
                raise ValueError(f"not a WARC record: {line[:40]!r}")
            fields: dict[str, str] = {}
            while (line := f.readline()).strip():
                name, _, value = line.decode("utf-8", "replace").partition(":")
                fields[name.strip().lower()] = value.strip()
            yield fields, f.read(int(fields["content-length"]))


def read_warc(manifest: DataFrame, payloads: bool = True) -> DataFrame:
    """(uri) of archives -> their records (RECORDS). payload is the body of a response;
    payload_bytes and payload_digest are measured on it, digest is what the header
    says. Without ``payloads`` the bodies are measured and left out."""
    n = max(1, manifest.count())

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        def rows_of(uri: str) -> Iterator[tuple]:
            with open_in(uri) as stream:
                yield from map(row_of, parse_records(stream))

        def row_of(record: tuple[dict[str, str], bytes]) -> tuple:
            h, block = record
            kind, mime = h.get("warc-type"), h.get("content-type", "")
            body = fields = None
            if mime.startswith("application/http"):
                _, _, body = block.partition(b"\r\n\r\n")
            elif mime == "application/warc-fields":
                fields = {k.strip(): v.strip() for k, _, v in (x.partition(":") for x in block.decode("utf-8", "replace").split("\r\n") if ":" in x)}
            full = kind == "response"
            digest = base64.b32encode(hashlib.sha1(body).digest()).decode() if full else None
            return (h.get("warc-record-id"), kind, h.get("warc-target-uri"), h.get("warc-concurrent-to"), h.get("warc-refers-to"), h.get("warc-payload-digest", "").rpartition(":")[2] or None, len(body) if full else None, digest, fields, body if full and payloads else None)

        names = [x.split()[0] for x in RECORDS.replace("map<string,string>", "map").split(", ")]
        for pdf in batches:
            for uri in pdf["uri"]:
                rows, held = [], 0
                for row in rows_of(uri):
                    rows.append(row)
                    held += len(row[-1] or b"") + 500
                    if held > 4 << 20:
                        yield pd.DataFrame(rows, columns=names).astype({"payload_bytes": "Int64"})
                        rows, held = [], 0
                if rows:
                    yield pd.DataFrame(rows, columns=names).astype({"payload_bytes": "Int64"})

    return manifest.select("uri").repartitionByRange(n, "uri").mapInPandas(run, RECORDS)


def assemble(records: DataFrame) -> DataFrame:
    """Records -> one row for each capture (response or revisit): record_id, type, uri,
    refers_to, digest, payload_bytes, payload_digest, payload, request struct<record_id,
    uri>, metadata struct<record_id, fields>.

    Of several requests or metadata records that name one capture the one with the
    smallest identifier is nested; orphans() has the others, and those that name none.
    A capture without them has null structs."""
    main = records.where(F.col("type").isin("response", "revisit")).drop("concurrent_to", "fields")
    tied = lambda kind: records.where((F.col("type") == kind) & F.col("concurrent_to").isNotNull())
    requests = tied("request").groupBy("concurrent_to").agg(F.min(F.struct("record_id", "uri")).alias("request")).withColumnRenamed("concurrent_to", "record_id")
    meta = tied("metadata").groupBy("concurrent_to").agg(F.min(F.struct("record_id", F.map_entries("fields").alias("entries"))).alias("m"))
    meta = meta.select(F.col("concurrent_to").alias("record_id"), F.struct(F.col("m.record_id").alias("record_id"), F.map_from_entries("m.entries").alias("fields")).alias("metadata"))
    return main.join(requests, "record_id", "left").join(meta, "record_id", "left")


def orphans(records: DataFrame) -> DataFrame:
    """Requests and metadata records that assemble() nests in no row."""
    tied = records.where(F.col("type").isin("request", "metadata"))
    whole = assemble(records)
    used = whole.select(F.explode(F.array_compact(F.array("request.record_id", "metadata.record_id"))).alias("record_id"))
    return tied.join(used, "record_id", "left_anti")


def archived_pages(pages: DataFrame, folder: str | None = None, revisit_bytes: int = REVISIT_BYTES) -> DataFrame:
    """Writes pages, reads the archives back, assembles the transactions and resolves
    the revisits: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    spark = pages.sparkSession
    manifest = write_warc(pages, folder or fresh_path(spark, "warc"), revisit_bytes)
    records = written(read_warc(manifest, payloads=False).drop("payload"), "warc-records")
    page = F.col("metadata.fields").getItem("page-id").cast("long")
    captures = written(assemble(records).select("record_id", "type", "refers_to", "digest", "payload_bytes", "payload_digest", page.alias("page_id")), "warc-captures")
    held = captures.where("type = 'response'").select(F.col("record_id").alias("refers_to"), F.col("page_id").alias("of_page"), F.col("payload_bytes").alias("of_bytes"), F.col("payload_digest").alias("of_digest"))
    return captures.join(held, "refers_to", "left").select(
        "page_id",
        F.coalesce("payload_bytes", "of_bytes").alias("payload_bytes"),
        F.coalesce("payload_digest", F.when(F.col("digest") == F.col("of_digest"), F.col("of_digest"))).alias("payload_digest"),
        F.col("type").alias("record_type"),
        F.col("of_page").alias("refers_to"),
    )


def op6_warc_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archived_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"))


OP6_SQL = f"""
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
top AS (SELECT h, max(page_id) AS top_id FROM p WHERE payload_bytes >= {REVISIT_BYTES} GROUP BY h)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes,
  list_aggregate(list_transform(range(32), lambda i: substr('{_BASE32}',
    (1 + ((('0x' || substr(p.h, ((i // 4) * 5 + 1)::BIGINT, 5))::BIGINT >> (15 - 5 * (i % 4))::BIGINT) & 31))::BIGINT, 1)), 'string_agg', '') AS payload_digest,
  CASE WHEN top_id IS NULL OR top_id = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN top_id <> page_id THEN top_id END AS refers_to
FROM p LEFT JOIN top ON p.h = top.h
"""
QUERIES = {"op6_warc_transactions": op6_warc_transactions}
SQL = {"op6_warc_transactions": OP6_SQL}
