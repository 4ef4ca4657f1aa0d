"""Operator 2: WARC archives with an index that is written first and read first.

Writing: the payload digests of all pages name, of records with equal payloads, the one with
the largest id as the response; the others become revisit records without a payload. Each
task writes one archive of compressed records (a gzip member each) and returns its index:
file, offset, length, URL and digest of every record. The index is a Parquet table; an archive
that a failed or repeated attempt leaves behind has a name of its own that no index row holds.

Reading: records are selected in the index, dealt by file and stretch of bytes, sorted by
offset, and neighbouring records are fetched by one byte-range read.

The folder is any URI that pyarrow.fs opens (shared by all executors).

Defined results: null html is an empty payload, and empty payloads are equal like others; a
null id ranks below all ids, and where only null ids hold a payload all are responses; rows
that repeat an id and payload are alike; a null URL has no target URI; an empty table gives
an empty index.
"""

from __future__ import annotations

import base64
import hashlib
import posixpath
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, row_batches, shared_path

LEVEL = 4
GAP = 64 << 10  # bytes between two records that are read along rather than skipped
RANGE = 8 << 20  # most bytes of one read, unless a record is longer
DATE = "1970-01-01T00:00:00Z"
INDEX = ("page_id long, url string, digest string, payload_bytes long, record_type string, refers_to long, "
         "file string, offset long, length long")
GZIP = 31  # zlib's window bits of the gzip format


def _name(page_id: int | None) -> str:
    return f"<urn:page:{'null' if page_id is None else page_id}>"


def _id(name: str) -> int | None:
    part = name.strip("<>").rpartition(":")[2]
    return None if part == "null" else int(part)


def _uri(url: str) -> str:
    """One header line: control characters and blanks are percent-encoded."""
    return "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in url)


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC record as a gzip member. A revisit keeps the HTTP header, with the payload's length, and no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_name(page_id)}", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {_uri(url)}")
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_name(refers_to)}"]
    head += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    gz = zlib.compressobj(LEVEL, zlib.DEFLATED, GZIP)
    return gz.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + gz.flush()


def parse(member: bytes) -> tuple[dict[str, str], bytes, int]:
    """(WARC header fields, payload, payload length by the HTTP header) of one record."""
    head, _, rest = zlib.decompress(member, GZIP).partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    block = rest[:int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = next(int(x[16:]) for x in http.decode().split("\r\n") if x.startswith("Content-Length: "))
    return fields, payload, length


def verdicts(pages: DataFrame, id_col: str, html_col: str, least_bytes: int) -> DataFrame:
    """(key, last): for each id and payload that isn't a response, the id of the response. Only digests are shuffled."""
    body = F.coalesce(F.col(html_col), F.lit(""))
    rows = pages.where(F.octet_length(body) >= least_bytes).select(F.col(id_col).cast("long").alias("id"), F.sha1(body).alias("sha"))
    last = rows.groupBy("sha").agg(F.max("id").alias("last"), F.count("*").alias("n")).where("n > 1 and last is not null")
    # two plain shuffles, so that AQE can split a payload that many pages have
    last = materialize(last.select("sha", "last"), "warc-last")
    hits = rows.join(last, "sha").where(~F.col("id").eqNullSafe(F.col("last")))
    return hits.select(_key(F.col("id"), F.col("sha")), "last").distinct()


def _key(page_id, sha):
    return F.concat_ws(":", F.coalesce(page_id.cast("string"), F.lit("-")), sha).alias("key")


def write_archives(pages: DataFrame, folder: str | None = None, id_col: str = "page_id", url_col: str = "url",
                   html_col: str = "html", least_bytes: int = 0) -> DataFrame:
    """Writes every row of ``pages`` as a record; returns the index, a table in the shared folder.

    Payloads of fewer than ``least_bytes`` are always responses.
    """
    folder = folder or shared_path(pages.sparkSession, "warc")
    body = F.coalesce(F.col(html_col), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), body.alias("html"),
                        _key(F.col(id_col).cast("long"), F.sha1(body)))
    # joined on the page, not on the payload: no page id is hot
    rows = rows.join(verdicts(pages, id_col, html_col, least_bytes), "key", "left").select("page_id", "url", "html", "last", "key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        name = f"{uuid.uuid4().hex}.warc.gz"
        out, offset = None, 0
        for b in batches:
            index = []
            for page_id, url, html, last, key in zip(*(b.column(k).to_pylist() for k in range(5))):
                if out is None:
                    out = store.open_output_stream(posixpath.join(root, name), compression=None)
                payload = html.encode()
                digest = base64.b32encode(bytes.fromhex(key.rpartition(":")[2])).decode()
                member = record(page_id, url, payload, digest, last, last is not None)
                out.write(member)
                index.append((page_id, url, digest, len(payload), "response" if last is None else "revisit", last, name, offset, len(member)))
                offset += len(member)
            yield _batch(index, INDEX)
        if out is not None:
            out.close()

    row_batches(pages.sparkSession)
    index = materialize(rows.mapInArrow(run, INDEX), "warc-index")
    return index.withColumn("folder", F.lit(folder))


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    names, types = zip(*(c.split() for c in schema.split(", ")))
    cols = list(zip(*rows)) if rows else [[]] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[t]) for c, t in zip(cols, types)], list(names))


def read_records(index: DataFrame, with_payload: bool = False) -> DataFrame:
    """The records of the index rows given, from the archives: page_id, payload_bytes, payload_digest, record_type,
    refers_to and, if asked for, payload. A response whose payload doesn't have its digest raises an error."""
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * with_payload

    def fetch(rows: list[tuple]) -> list[tuple]:
        from pyarrow import fs

        folder, name = rows[0][:2]
        store, root = fs.FileSystem.from_uri(folder)
        first, end = rows[0][2], rows[-1][2] + rows[-1][3]
        with store.open_input_file(posixpath.join(root, name)) as f:
            data = f.read_at(end - first, first)
        out = []
        for _, _, offset, length in rows:
            fields, payload, size = parse(data[offset - first:offset - first + length])
            digest, kind = fields["WARC-Payload-Digest"].removeprefix("sha1:"), fields["WARC-Type"]
            if kind == "response" and base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
                raise ValueError(f"{name} at {offset}: the payload doesn't have the record's digest")
            to = _id(fields["WARC-Refers-To"]) if kind == "revisit" else None
            out.append((_id(fields["WARC-Record-ID"]), size, digest, kind, to, *[payload] * with_payload))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for b in batches:
            out = []
            for row in zip(*(b.column(k).to_pylist() for k in range(4))):
                if held and (row[:2] != held[0][:2] or row[2] - held[-1][2] - held[-1][3] > GAP or row[2] + row[3] - held[0][2] > RANGE):
                    out += fetch(held)
                    held = []
                held.append(row)
            yield _batch(out, schema)
        if held:
            yield _batch(fetch(held), schema)

    rows = index.select("folder", "file", "offset", "length").repartition("file", F.expr(f"offset div {RANGE}"))
    return rows.sortWithinPartitions("folder", "file", "offset").mapInArrow(run, schema)
