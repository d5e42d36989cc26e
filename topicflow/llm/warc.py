"""WARC archives: writer, monolithic-gzip normaliser with offset index, reader.

Three jobs, each leaving a written manifest of its files: tasks write archives
that are one gzip stream each (as some crawlers leave them); the normaliser
inflates such a stream once and rewrites every record as a gzip member of its
own beside a sidecar index (record id, page, type, offset, length, one JSON
line each); the reader opens records by their index entries alone. Records
with equal payloads are revisits of the one with the smallest page_id; a
revisit holds the HTTP header (with the payload's length and digest) but no
payload.

Edge cases: null html is an empty payload, which counts as a payload (empty
pages revisit the first empty page); a null page_id is a record without a page
number, a response only if its whole group has none; rows that repeat the
smallest page_id of a group are responses each; line breaks and other controls
in a url are percent-encoded, a null url becomes a urn; an empty table gives
no archive and an empty result; other columns are not read. A repeated attempt
writes files of its own, and only files named by a committed manifest are read.
"""
from __future__ import annotations

import base64
import hashlib
import json
import re
import uuid
import zlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

ARCHIVE_BYTES = 64 << 20         # payload bytes after which a task starts another archive
MIN_REVISIT = 0                  # smallest payload that may be a revisit
DATE = "1970-01-01T00:00:00Z"
CHUNK = 1 << 20
GZIP = 31                        # zlib window bits of a gzip member


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def clean_url(url: str | None, page_id) -> str:
    if not url:
        return f"urn:page:{page_id}"
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)


def record(kind: str, headers: dict, block: bytes) -> bytes:
    head = [f"WARC-Type: {kind}", *(f"{k}: {v}" for k, v in headers.items()), f"Content-Length: {len(block)}"]
    return ("WARC/1.1\r\n" + "\r\n".join(head) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


def page_record(page_id, url, payload: bytes, first_id, is_revisit: bool) -> bytes:
    http = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n").encode()
    headers = {"WARC-Record-ID": record_id(page_id), "WARC-Date": DATE, "WARC-Target-URI": clean_url(url, page_id),
               "Content-Type": "application/http; msgtype=response",
               "WARC-Payload-Digest": f"sha1:{digest(payload)}", "Page-ID": "" if page_id is None else page_id}
    if not is_revisit:
        return record("response", headers, http + payload)
    headers |= {"WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                "WARC-Refers-To": record_id(first_id), "Refers-To-Page": first_id}
    return record("revisit", headers, http)


def records(chunks):
    """(headers, block, raw record) of each record of a byte stream."""
    buf = bytearray()
    chunks = iter(chunks)

    def more() -> bool:
        got = next(chunks, None)
        if got is not None:
            buf.extend(got)
        return got is not None

    while True:
        seen = 0
        while (end := buf.find(b"\r\n\r\n", max(0, seen - 3))) < 0:
            seen = len(buf)
            if not more():
                if buf.strip():
                    raise ValueError("archive ends inside a record header")
                return
        lines = bytes(buf[:end]).decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no record begins here: {lines[0][:40]!r}")
        headers = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
        size = int(headers["Content-Length"])
        while len(buf) < end + size + 8:
            if not more():
                raise ValueError("archive ends inside a record")
        raw = bytes(buf[:end + size + 8])
        del buf[:end + size + 8]
        yield headers, raw[end + 4:end + 4 + size], raw


def inflate(stream):
    """Decompressed chunks of a gzip file, of one member or of many."""
    z, data = zlib.decompressobj(GZIP), b""
    while True:
        data = data or stream.read(CHUNK)
        if not data:
            if not z.eof:
                raise ValueError("gzip stream is cut off")
            return
        if z.eof:
            z = zlib.decompressobj(GZIP)
        out = z.decompress(data, 4 * CHUNK)
        data = z.unused_data if z.eof else z.unconsumed_tail
        if out:
            yield out


def write_archives(folder: str, most: int):
    """One gzip stream per archive; emits uri and number of records."""
    def run(batches):
        ctx = TaskContext.get()
        out = z = uri = None
        n = size = k = 0
        for b in batches:
            for page, url, html, first, revisit in zip(*(c.to_pylist() for c in b.columns)):
                if out is None:
                    uri = f"{folder}/{ctx.partitionId():06d}-{ctx.taskAttemptId()}-{k:04d}.warc.gz"
                    f, p = C.open_fs(uri)
                    out, z, n, size, k = f.open_output_stream(p, compression=None), zlib.compressobj(6, zlib.DEFLATED, GZIP), 0, 0, k + 1
                    out.write(z.compress(record("warcinfo", {
                        "WARC-Record-ID": f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, uri)}>", "WARC-Date": DATE,
                        "Content-Type": "application/warc-fields"}, b"format: WARC File Format 1.1\r\n")))
                payload = html.encode()
                out.write(z.compress(page_record(page, url, payload, first, revisit)))
                n, size = n + 1, size + len(payload)
                if size >= most:
                    out.write(z.flush())
                    out.close()
                    yield row(uri, n)
                    out = None
        if out is not None:
            out.write(z.flush())
            out.close()
            yield row(uri, n)

    def row(uri, n):
        return pa.RecordBatch.from_arrays([pa.array([uri]), pa.array([n], pa.int64())], ["uri", "n"])
    return run


def normalise(folder: str):
    """Monolithic archive -> one member per record, and a sidecar index."""
    def run(batches):
        attempt = TaskContext.get().taskAttemptId()
        for b in batches:
            for k, uri in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                target = f"{folder}/{k:06d}-{attempt}.warc.gz"
                f, p = C.open_fs(uri)
                g, q = C.open_fs(target)
                at = n = 0
                with f.open_input_stream(p, compression=None) as src, g.open_output_stream(q, compression=None) as out, \
                        g.open_output_stream(q + ".idx", compression=None) as idx:
                    for headers, _, raw in records(inflate(src)):
                        z = zlib.compressobj(6, zlib.DEFLATED, GZIP)
                        member = z.compress(raw) + z.flush()
                        out.write(member)
                        idx.write((json.dumps({"id": headers["WARC-Record-ID"], "type": headers["WARC-Type"],
                                               "page": headers.get("Page-ID"), "offset": at, "length": len(member)})
                                   + "\n").encode())
                        at, n = at + len(member), n + 1
                yield pa.RecordBatch.from_arrays([pa.array([target]), pa.array([n], pa.int64())], ["uri", "n"])
    return run


READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string"


def open_record(file, offset: int, length: int):
    """(headers, block) of the record at an index entry."""
    [(headers, block, _)] = records([zlib.decompress(file.read_at(length, offset), GZIP)])
    return headers, block


def parse_page(headers: dict, block: bytes) -> tuple:
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(re.search(rb"\r\nContent-Length: (\d+)", http)[1])
    want = headers["WARC-Payload-Digest"].removeprefix("sha1:")
    if headers["WARC-Type"] == "response" and (len(payload) != size or digest(payload) != want):
        raise ValueError(f"payload of {headers['WARC-Record-ID']} does not match its digest")
    page, first = headers.get("Page-ID"), headers.get("Refers-To-Page")
    return (int(page) if page else None, size, want, headers["WARC-Type"], int(first) if first else None,
            headers["WARC-Target-URI"])


def read_archives(batches):
    for b in batches:
        for uri in b.column(1).to_pylist():
            f, p = C.open_fs(uri)
            with f.open_input_stream(p + ".idx", compression=None) as idx:
                entries = [json.loads(x) for x in idx.read().decode().splitlines()]
            out = []
            with f.open_input_file(p) as file:
                for e in entries:
                    if e["type"] in ("response", "revisit"):
                        out.append(parse_page(*open_record(file, e["offset"], e["length"])))
            cols = list(zip(*out)) or [()] * 6
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)],
                                             ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url"])


def per_file(manifest: DataFrame) -> DataFrame:
    """(k, uri): one partition per file named by a manifest."""
    uris = sorted(r[0] for r in manifest.select("uri").collect())                        # one row per file
    frame = manifest.sparkSession.createDataFrame(list(enumerate(uris)), "k int, uri string")
    return frame.repartitionById(max(1, len(uris)), F.col("k"))


def revisits(pages: DataFrame, least: int = MIN_REVISIT) -> DataFrame:
    """page_id, url, html, first id of the payload's group, is_revisit."""
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html")) \
        .withColumn("key", F.sha2("html", 256))
    groups = p.where(F.octet_length("html") >= least).groupBy("key").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    first = groups.where("n > 1 and first is not null").select("key", "first")
    return p.join(first, "key", "left").select(
        "page_id", "url", "html", "first",
        (F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))).alias("is_revisit"))


def write(pages: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes monolithic archives; returns their manifest (uri, n)."""
    C.make_dirs(folder)
    return C.materialize(revisits(pages).mapInArrow(write_archives(folder, archive_bytes), "uri string, n long"), "warc-raw")


def rewrite(manifest: DataFrame, folder: str) -> DataFrame:
    """Normalises every archive of a manifest; returns the new manifest."""
    C.make_dirs(folder)
    return C.materialize(per_file(manifest).mapInArrow(normalise(folder), "uri string, n long"), "warc-members")


def read(manifest: DataFrame) -> DataFrame:
    return per_file(manifest).mapInArrow(read_archives, READ)


def op1_warc_normaliser(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = write(C.read(spark, sf_dir, "pages"), C.scratch(spark, "warc-raw-files"))
    return read(rewrite(raw, C.scratch(spark, "warc-files"))).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
g AS (SELECT html, min(page_id) AS first FROM p GROUP BY html),
d AS (SELECT p.page_id, octet_length(encode(p.html)) AS n, sha1(p.html) AS h, g.first FROM p JOIN g USING (html))
SELECT page_id, cast(n AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + ((cast('0x' || substr(h, cast(5 * (i // 4) + 1 AS BIGINT), 5) AS INTEGER) >> cast(15 - 5 * (i % 4) AS INTEGER)) & 31), 1)), '')
    AS payload_digest,
  CASE WHEN first IS NULL OR page_id IS NOT DISTINCT FROM first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN first IS NULL OR page_id IS NOT DISTINCT FROM first THEN NULL ELSE first END AS refers_to
FROM d
"""

QUERIES = {"op1_warc_normaliser": op1_warc_normaliser}
ORACLES = {"op1_warc_normaliser": SQL}
