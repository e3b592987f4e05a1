"""WARC archives: writing captures, reading records, and assembling transactions.

A capture of a page is a transaction of three records: the request, the response (or a revisit record, if another
capture has the same payload), and metadata about both. Request and metadata name the response in their
``WARC-Concurrent-To`` header; ``assemble`` joins the records read from archives through these identifiers into one
nested row for each capture.

Each task writes archives of its own, gzipped record by record, under names of its attempt; only the manifest, a
Parquet table that Spark commits, says which archives count, so tasks may run twice. Readers stream.

Of captures with equal payloads, of at least ``revisit_from`` bytes, the one with the largest page id is the response
and the others revisit it. That is an aggregation of digests; only digests that occur more than once are joined back.

Rows: null html counts as the empty payload; a null url leaves out the target URI, a malformed one is kept as it is (percent-encoded); a null page id orders before all
others; rows that agree in page id, url and payload are captures with one identifier and equal records, each of which
gives a row; an empty table gives no archives and no captures; other columns are not stored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebook.llm.components import kept

ARCHIVE_BYTES = 64_000_000
LEVEL = 4
DATE = "2000-01-01T00:00:00Z"
#: Names that the WARC 1.1 standard gives.
VERSION = "WARC/1.1"
SAME_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

MANIFEST = "path string, n_records long, n_bytes long"
RECORD = (
    "record_id string, record_type string, concurrent_to string, target_uri string, date string, refers_to string, "
    "payload_digest string, payload_bytes long, payload binary, fields map<string,string>"
)
ROWS_AT_ONCE = 256


def identifier(page_id: int | None, url: str | None, digest: str) -> str:
    mark = hashlib.sha1(f"{url}\n{digest}".encode("utf-8", "surrogatepass")).hexdigest()
    return f"<urn:page:{'null' if page_id is None else page_id}:{mark}>"


def record(headers: list[tuple[str, str | None]], block: bytes, level: int) -> bytes:
    lines = [VERSION, *(f"{k}: {v}" for k, v in headers if v is not None), f"Content-Length: {len(block)}"]
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    body = "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
    return packer.compress(body) + packer.flush()


def host_and_target(uri: str) -> tuple[str, str]:
    """Host and request target of a URI, cut by its first marks; whatever a crawl has for a URI gives some."""
    after = uri.partition("#")[0]
    after = after.partition("://")[2] if "://" in after else after.removeprefix("//")
    cut = min((k for k in (after.find("/"), after.find("?")) if k >= 0), default=len(after))
    target = after[cut:]
    return after[:cut], target if target.startswith("/") else f"/{target}"


def transaction(page_id, url, payload: bytes, sha1: str, of_page, of_url, revisit: bool, date: str, level: int) -> bytes:
    """The three records of one capture."""
    digest = base64.b32encode(bytes.fromhex(sha1)).decode()
    own = identifier(page_id, url, digest)
    uri = None if url is None else quote(url, safe="!#$%&'()*+,/:;=?@[]~")
    host, target = host_and_target(uri or "")
    asked = f"GET {target} HTTP/1.1\r\nHost: {host}\r\n\r\n"
    common = [("WARC-Date", date), ("WARC-Target-URI", uri)]
    linked = [("WARC-Concurrent-To", own), *common]
    answer = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    main = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", own),
        *common,
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("Content-Type", "application/http;msgtype=response"),
    ]
    if revisit:
        main += [("WARC-Profile", SAME_PAYLOAD), ("WARC-Refers-To", identifier(of_page, of_url, digest))]
    asking = [("WARC-Type", "request"), ("WARC-Record-ID", f"{own[:-1]}:request>"), *linked]
    about = [("WARC-Type", "metadata"), ("WARC-Record-ID", f"{own[:-1]}:metadata>"), *linked]
    fields = f"pageId: {'' if page_id is None else page_id}\r\npayloadBytes: {len(payload)}\r\n"
    return b"".join(
        (
            record([*asking, ("Content-Type", "application/http;msgtype=request")], asked.encode(), level),
            record(main, answer if revisit else answer + payload, level),
            record([*about, ("Content-Type", "application/warc-fields")], fields.encode(), level),
        )
    )


def write(
    pages: DataFrame,
    folder: str,
    page_id: str = "page_id",
    url: str = "url",
    html: str = "html",
    revisit_from: int = 0,
    date: str = DATE,
    level: int = LEVEL,
    archive_bytes: int = ARCHIVE_BYTES,
) -> DataFrame:
    """Writes the archives below ``folder`` and returns their manifest."""
    body = F.coalesce(F.col(html).cast("string"), F.lit(""))
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"), body.alias("html"))
    rows = rows.withColumns({"sha1": F.sha1("html"), "mark": F.xxhash64("html")})
    same = rows.where(F.octet_length("html") >= revisit_from).groupBy("sha1", "mark")
    same = same.agg(F.max(F.struct("page_id", "url")).alias("top"), F.count("*").alias("n")).where("n > 1")
    repeated = kept(same.select("sha1", "mark", "top.page_id", F.col("top.url").alias("of_url")), "payloads")
    repeated = repeated.select("sha1", "mark", F.col("page_id").alias("of_page"), "of_url", F.lit(True).alias("several"))
    placed = rows.join(repeated, ["sha1", "mark"], "left")
    revisit = F.coalesce("several", F.lit(False)) & ~F.col("page_id").eqNullSafe(F.col("of_page"))
    placed = placed.select("page_id", "url", "html", "sha1", "of_page", "of_url", revisit.alias("revisit"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sink, path, n, size = None, "", 0, 0
        done: list[tuple[str, int, int]] = []
        for batch in batches:
            for begin in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(begin, ROWS_AT_ONCE)
                for page, uri, text, *rest in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    if sink is None:
                        path, n, size = f"{folder}/archives/{uuid.uuid4().hex}.warc.gz", 0, 0
                        store, at = fs.FileSystem.from_uri(path)
                        store.create_dir(at.rpartition("/")[0], recursive=True)
                        sink = store.open_output_stream(at, compression=None)
                    packed = transaction(page, uri, text.encode("utf-8", "surrogatepass"), *rest, date, level)
                    sink.write(packed)
                    n, size = n + 3, size + len(packed)
                    if size >= archive_bytes:
                        sink.close()
                        done.append((path, n, size))
                        sink = None
        if sink is not None:
            sink.close()
            done.append((path, n, size))
        if done:
            columns = zip(zip(*done, strict=True), (pa.string(), pa.int64(), pa.int64()), strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in columns], names=["path", "n_records", "n_bytes"])

    placed.mapInArrow(run, MANIFEST).write.parquet(f"{folder}/manifest")
    return pages.sparkSession.read.schema(MANIFEST).parquet(f"{folder}/manifest")


def records_in(stream: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers, with names in lower case, and block of each record of a decompressed archive."""
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC record begins with {line[:40]!r}")
        headers: dict[str, str] = {}
        while (line := stream.readline().rstrip(b"\r\n")) != b"":
            name, _, value = line.decode().partition(":")
            headers[name.strip().lower()] = value.strip()
        block = stream.read(int(headers["content-length"]))
        if len(block) < int(headers["content-length"]):
            raise ValueError("an archive ends inside a record")
        yield headers, block


def parsed(headers: dict[str, str], block: bytes) -> dict:
    """One row of RECORD. A response's payload is what follows its HTTP headers, its digest is made of it anew."""
    kind, content = headers["warc-type"], headers.get("content-type", "")
    row = {
        "record_id": headers.get("warc-record-id"),
        "record_type": kind,
        "concurrent_to": headers.get("warc-concurrent-to"),
        "target_uri": headers.get("warc-target-uri"),
        "date": headers.get("warc-date"),
        "refers_to": headers.get("warc-refers-to"),
        "payload_digest": headers.get("warc-payload-digest", "").removeprefix("sha1:") or None,
        "payload_bytes": None,
        "payload": None,
        "fields": None,
    }
    if kind == "response":
        payload = block.partition(b"\r\n\r\n")[2]
        digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        if row["payload_digest"] not in (None, digest):
            raise ValueError(f"{row['record_id']}: the payload doesn't have its digest")
        row |= {"payload": payload, "payload_bytes": len(payload), "payload_digest": digest}
    elif content == "application/warc-fields":
        lines = (x.partition(":") for x in block.decode("utf-8", "replace").splitlines() if ":" in x)
        row["fields"] = [(k.strip(), v.strip()) for k, _, v in lines]
    return row


def read(manifest: DataFrame, tasks: int | None = None) -> DataFrame:
    """A row for each record of the archives that the manifest lists."""
    names = [x.split()[0] for x in RECORD.split(", ")]
    kinds = [pa.string()] * 7 + [pa.int64(), pa.binary(), pa.map_(pa.string(), pa.string())]
    n = tasks or max(int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch_of(rows: list[dict]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in zip(names, kinds, strict=True)], names=names)

        for batch in batches:
            for path in batch.column(0).to_pylist():
                store, at = fs.FileSystem.from_uri(path)
                with store.open_input_stream(at, compression=None, buffer_size=1 << 20) as raw:
                    rows: list[dict] = []
                    for headers, block in records_in(io.BufferedReader(gzip.GzipFile(fileobj=raw), 1 << 18)):
                        rows.append(parsed(headers, block))
                        if len(rows) >= ROWS_AT_ONCE:
                            yield batch_of(rows)
                            rows = []
                    if rows:
                        yield batch_of(rows)

    return manifest.select("path").repartition(n).mapInArrow(run, RECORD)


def assemble(records: DataFrame) -> DataFrame:
    """One row for each response or revisit record: its own fields, and ``request`` and ``metadata``, the records that
    name it in their concurrent-to header (the last by identifier if several do, null if none does).

    What is read from archives is many times what Spark knows of it, the size of their manifest; the hints keep it from
    being broadcast."""

    def side(kind: str, *fields: str) -> DataFrame:
        own = records.where((F.col("record_type") == kind) & F.col("concurrent_to").isNotNull())
        return own.groupBy(F.col("concurrent_to").alias(f"_{kind}")).agg(
            F.max_by(F.struct("record_id", "target_uri", "date", *fields), "record_id").alias(kind)
        )

    main = records.where(F.col("record_type").isin("response", "revisit")).drop("concurrent_to", "fields")
    asked, about = side("request"), side("metadata", "fields")
    joined = main.join(asked.hint("merge"), F.col("record_id") == F.col("_request"), "left")
    joined = joined.join(about.hint("merge"), F.col("record_id") == F.col("_metadata"), "left")
    return joined.drop("_request", "_metadata")
