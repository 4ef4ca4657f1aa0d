import base64
import gzip
import hashlib
import os

from ledgerline.llm import queries, warc


def b32(html):
    return base64.b32encode(hashlib.sha1((html or "").encode()).digest()).decode()


def want(rows):
    last = {}
    for p, h in rows:
        if p is not None:
            last[b32(h)] = max(p, last.get(b32(h), p))
    out = []
    for p, h in rows:
        to = last.get(b32(h))
        to = None if to == p else to
        out.append((p, len((h or "").encode()), b32(h), "response" if to is None else "revisit", to))
    return sorted(out, key=str)


def got(df):
    return sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in df.collect()), key=str)


def test_query(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()
    assert got(queries.op2_warc(spark, "/root/testdata/sf0.01")) == want([(r.page_id, r.html) for r in pages])


def test_edge_rows_and_payload_round_trip(spark):
    rows = [(1, "http://a/1", "<p>é\x00日本</p>", "x"), (2, "http://a/2\r\nX: y", "<p>é\x00日本</p>", "x"), (3, None, None, "x"), (9, "u", "", "x"),
            (5, "http://h/é b", "z" * 9_000_000, "x"), (6, "c", "same", "x"), (6, "c", "same", "x"), (None, "n", "same", "x"),
            (None, "m", "only null", "x"), (None, "m", "only null", "x"), (7, "d", "WARC/1.1\r\n\r\nContent-Length: 3\r\n\r\n", "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest string")
    index = warc.write_archives(pages)
    back = warc.read_records(index, with_payload=True)
    assert got(back) == want([(r[0], r[2]) for r in rows])
    html = {b32(r[2]): (r[2] or "").encode() for r in rows}
    for r in back.collect():
        assert bytes(r.payload) == (html[r.payload_digest] if r.record_type == "response" else b"")
    assert sorted(str(r.url) for r in index.collect()) == sorted(str(r[1]) for r in rows)
    # a selection reads only its records
    one = warc.read_records(index.where("page_id = 5")).collect()
    assert [(r.page_id, r.payload_bytes) for r in one] == [(5, 9_000_000)]
    assert warc.read_records(warc.write_archives(pages.limit(0))).count() == 0


def test_archives_are_plain_warc_gz(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    index = warc.write_archives(pages).collect()
    folder = index[0].folder
    for name in {r.file for r in index}:
        data = open(os.path.join(folder.removeprefix("file://"), name), "rb").read()
        assert gzip.decompress(data).count(b"WARC-Record-ID") >= sum(r.file == name for r in index)
        assert len(data) == sum(r.length for r in index if r.file == name)


def test_least_bytes(spark):
    pages = spark.createDataFrame([(1, "a", "xx"), (2, "b", "xx"), (3, "c", "longer"), (4, "d", "longer")], "page_id long, url string, html string")
    back = warc.read_records(warc.write_archives(pages, least_bytes=4)).collect()
    assert {r.page_id: r.record_type for r in back} == {1: "response", 2: "response", 3: "revisit", 4: "response"}
