import os

from ledgerline.streaming import stream as ST


def test_stream_build_available_now(spark, tmp_out):
    src = os.path.join(tmp_out, "in")
    os.makedirs(src)
    p0 = "Customer 123456789 residential\nInvoice Date June 10, 2023\nAmount Due $10.00\n"
    p1 = "Page 2 Of 2\nOutstanding Balance $1.00\nTOTAL INTERNET $7.00\nGST 5% $1.00\nMB PST 7% $1.00\n"
    os.makedirs(os.path.join(src, "2023", "june"))
    for name in ("d0.txt", "d1.txt", "2023/june/d2.txt"):
        with open(os.path.join(src, name), "w") as f:
            f.write(p0 + "\f" + p1)
    with open(os.path.join(src, "bad.txt"), "w") as f:
        f.write(p0.replace("10.00", "11.00") + "\f" + p1)
    pages = ST.stream_pages(spark, src, "telecom")
    q = ST.start_build_stream(pages, os.path.join(tmp_out, "out"), os.path.join(tmp_out, "ck"), ["telecom"],
                              trigger_once=True)
    q.awaitTermination(120)
    out = os.path.join(tmp_out, "out")
    assert spark.read.json(os.path.join(out, "metadata")).count() == 6
    rejects = spark.read.json(os.path.join(out, "rejects")).collect()
    assert [(r["vendor"], os.path.basename(r["file"]), r["reason"]) for r in rejects] == [("telecom", "bad.txt", "balance_mismatch")]


def test_a_batch_that_runs_again_replaces_its_rows(spark, tmp_out):
    from .conftest import pages_df
    text = "Customer 123456789 residential\nInvoice Date June 10, 2023\nAmount Due $10.00\n"
    batch = pages_df(spark, [("telecom", f"{i}.txt", 0, text) for i in range(3)])
    for _ in range(2):
        ST.build_batch(batch, 7, tmp_out, ["telecom"])
    ST.build_batch(batch.limit(1), 8, tmp_out, ["telecom"])
    assert spark.read.json(os.path.join(tmp_out, "metadata")).count() == 4
