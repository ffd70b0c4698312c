"""WARC archives written and read by tasks, and transactions put together from their records.

A capture is three records: a request and a metadata record that are concurrent to a response
or a revisit. Tasks write them as gzip members, roll files at a size, and return a manifest of
files; only files of the manifest are read, so what a lost or repeated task left is ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import uuid
import zlib

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslab.session import cut

REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
LEAST_REVISIT = 1000  # bytes of a payload from which on equal ones are revisits
ROLL = 64 << 20  # bytes of a file
FLUSH = 4 << 20  # bytes of payload in a batch of read records
RECORD = (
    "file string, type string, record_id string, concurrent_to string, refers_to string, uri string, "
    "payload_digest string, payload_bytes long, fields map<string,string>, payload binary"
)


def captures(pages: DataFrame, key: str = "page_id", url: str = "url", body: str = "html") -> DataFrame:
    """page_id, url, html, payload_digest (hex SHA-1), payload_bytes, and refers_to (page_id, url):
    of equal payloads of `LEAST_REVISIT` bytes and more, the one with the largest page_id is
    the response, and the others refer to it. A null html is empty. Rows that share the
    largest page_id are all responses; a null page_id counts as the smallest.

    Payloads that occur once never meet another row: the largest ids are aggregated from
    digests, partly in the tasks, and only digests of two or more rows are joined back."""
    rows = pages.select(F.col(key).cast("long").alias("page_id"), F.col(url).alias("url"), F.coalesce(F.col(body), F.lit("")).alias("html"))
    rows = rows.withColumn("payload_digest", F.sha1(F.col("html").cast("binary"))).withColumn("payload_bytes", F.octet_length("html").cast("long"))
    same = rows.where(F.col("payload_bytes") >= LEAST_REVISIT).groupBy("payload_digest").agg(
        F.max(F.struct("page_id", "url")).alias("largest"), F.count("*").alias("n")
    ).where("n > 1").select("payload_digest", "largest")
    own = F.col("largest.page_id").eqNullSafe(F.col("page_id"))
    return rows.join(same, "payload_digest", "left").withColumn("refers_to", F.when(F.col("largest").isNotNull() & ~own, F.col("largest"))).drop("largest")


def record_id(page_id, url, digest: str, role: str) -> str:
    """The same for the same capture, so that a repeated task writes the same ids."""
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha1(f'{page_id}|{url}|{digest}|{role}'.encode()).digest()[:16])}>"


def _record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in headers if v is not None)
    deflate = zlib.compressobj(3, zlib.DEFLATED, 31)
    data = f"WARC/1.1\r\n{head}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"
    return deflate.compress(data) + deflate.flush()


def one_line(text: str | None) -> str | None:
    return None if text is None else " ".join(text.split())


def transaction(page_id, url, html: str, digest: str, refers_to, date: str) -> bytes:
    """The three records of one capture. Its own digest column is hex; the header has base 32."""
    payload = html.encode()
    uri = one_line(url)
    main = record_id(page_id, url, digest, "response")
    shared = [("WARC-Date", date), ("WARC-Target-URI", uri)]
    b32 = "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    if refers_to is None:
        kind = [("WARC-Type", "response")]
    else:
        target = record_id(refers_to["page_id"], refers_to["url"], digest, "response")
        kind = [("WARC-Type", "revisit"), ("WARC-Profile", REVISIT), ("WARC-Refers-To", target), ("WARC-Refers-To-Target-URI", one_line(refers_to["url"]))]
        payload = b""
    host = (uri or "").split("://", 1)[-1]
    request = f"GET /{host.partition('/')[2]} HTTP/1.1\r\nHost: {host.partition('/')[0]}\r\n\r\n".encode()
    fields = b"" if page_id is None else f"pageId: {page_id}\r\n".encode()
    return b"".join([
        _record([("WARC-Type", "request"), ("WARC-Record-ID", record_id(page_id, url, digest, "request")), *shared, ("WARC-Concurrent-To", main), ("Content-Type", "application/http; msgtype=request")], request),
        _record([*kind, ("WARC-Record-ID", main), *shared, ("WARC-Payload-Digest", b32), ("Content-Type", "application/http; msgtype=response")], http + payload),
        _record([("WARC-Type", "metadata"), ("WARC-Record-ID", record_id(page_id, url, digest, "metadata")), *shared, ("WARC-Concurrent-To", main), ("Content-Type", "application/warc-fields")], fields),
    ])


def written(rows: DataFrame, folder: str, date: str = "2000-01-01T00:00:00Z") -> DataFrame:
    """Writes the rows of `captures` to files in `folder`, which all executors must reach by a
    file system that Arrow knows (a mounted folder, HDFS, an object store). Returns the
    manifest (file, captures, bytes), itself written, so that nothing is written twice."""
    columns = ["page_id", "url", "html", "payload_digest", "refers_to"]

    def write(batches):
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        name, out, n, size = None, None, 0, 0
        for batch in batches:
            # One row at a time as Python values; the batch itself stays in Arrow.
            for i in range(batch.num_rows):
                values = [c[i].as_py() for c in batch.columns]
                if out is None:
                    name, n, size = f"{root}/{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = store.open_output_stream(name, compression=None)
                data = transaction(*values, date)
                out.write(data)
                n, size = n + 1, size + len(data)
                if size >= ROLL:
                    out.close()
                    out = None
                    yield pa.RecordBatch.from_pydict({"file": [name], "captures": [n], "bytes": [size]})
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"file": [name], "captures": [n], "bytes": [size]})

    return cut(rows.select(columns).mapInArrow(write, "file string, captures long, bytes long"))


def parsed(stream: io.BufferedIOBase):
    """(headers in lower case, block) of each record of a decompressed archive."""
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:40]!r}")
        headers = {}
        while (line := stream.readline()).strip():
            k, _, v = line.decode().partition(":")
            headers[k.strip().lower()] = v.strip()
        yield headers, stream.read(int(headers["content-length"]))


def records(files: DataFrame, folder: str, payload: bool = True) -> DataFrame:
    """Records (`RECORD`) of the files in the column `file` (paths as `written` gives them). The
    digest of each response is computed from what was read, and must be the one of its header.
    payload_bytes is the length that the HTTP headers give, which a revisit has too. Without
    `payload` only digests come back. An empty list of files gives no records."""
    n = max(1, files.sparkSession.sparkContext.defaultParallelism)
    kinds = [pa.string()] * 7 + [pa.int64(), pa.map_(pa.string(), pa.string()), pa.binary()]
    names = [x.split()[0] for x in RECORD.split(", ")]

    def read(batches):
        store, _ = fs.FileSystem.from_uri(folder)
        rows, held = [], 0

        def flush():
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

        for batch in batches:
            for file in batch.column(0).to_pylist():
                with store.open_input_stream(file, compression=None) as raw, io.BufferedReader(gzip.GzipFile(fileobj=raw), 1 << 18) as stream:
                    for head, block in parsed(stream):
                        kind, digest, length, fields, body = head["warc-type"], None, None, None, None
                        if kind in ("response", "revisit"):
                            http, _, body = block.partition(b"\r\n\r\n")
                            length = next(int(x[15:]) for x in http.split(b"\r\n") if x[:15].lower() == b"content-length:")
                            digest = base64.b32decode(head["warc-payload-digest"].removeprefix("sha1:")).hex()
                            if kind == "response" and (len(body) != length or hashlib.sha1(body).hexdigest() != digest):
                                raise ValueError(f"{file}: the payload of {head['warc-record-id']} is damaged")
                        elif kind == "metadata":
                            fields = [tuple(x.decode().split(": ", 1)) for x in block.split(b"\r\n") if b": " in x]
                        held += len(body or b"") + 500
                        rows.append((file, kind, head["warc-record-id"], head.get("warc-concurrent-to"), head.get("warc-refers-to"), head.get("warc-target-uri"), digest, length, fields, body if payload and kind == "response" else None))
                        if held > FLUSH:
                            yield flush()
                            rows, held = [], 0
        if rows:
            yield flush()

    return files.select("file").repartition(n).mapInArrow(read, RECORD)


def assembled(found: DataFrame) -> DataFrame:
    """One nested row per capture: capture_id, copies (how often it was archived), response
    (struct of type, record_id, refers_to, uri, payload_digest, payload_bytes, payload),
    requests and metadata (arrays), and refers_to_page.

    Requests and metadata meet their response by the concurrent-to identifier in one
    exchange; equal records are merged in the tasks, so that a capture that was archived a
    million times is one row. Records that are concurrent to nothing found have a null
    response. Revisits then look up the capture that they refer to."""
    def of(*types: str) -> Column:
        return F.col("type").isin(*types)

    main = F.struct("type", "record_id", "refers_to", "uri", "payload_digest", "payload_bytes", "payload")
    whole = found.groupBy(F.coalesce("concurrent_to", "record_id").alias("capture_id")).agg(
        F.sum(of("response", "revisit").cast("long")).alias("copies"),
        F.first(F.when(of("response", "revisit"), main), ignorenulls=True).alias("response"),
        F.collect_set(F.when(of("request"), F.struct("record_id", "uri"))).alias("requests"),
        F.collect_set(F.when(of("metadata"), F.struct("record_id", F.map_entries("fields").alias("fields")))).alias("metadata"),
    )
    whole = cut(whole.withColumn("page", F.expr("get(transform(metadata, m -> map_from_entries(m.fields)['pageId']), 0)").cast("long")))
    origin = whole.where(F.col("response.type") == "response").select(F.col("capture_id").alias("origin"), F.col("page").alias("refers_to_page"))
    return whole.join(origin, F.col("response.refers_to") == F.col("origin"), "left").drop("origin")
