import zlib

from pyspark.sql import functions as F

from ledgerline.llm import sharding

SCHEMA = "doc_id long, text string, shard string"


def placed(docs, **options):
    return [r.asDict() for r in sharding.shard_rows(docs, **options).collect()]


def check_slots(rows, n_shards=8):
    for s in range(n_shards):
        slots = sorted(r["slot"] for r in rows if r["shard"] == s)
        assert slots == list(range(len(slots)))


def test_bytes_are_near_equal_and_slots_gapless(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = placed(docs, keep=["doc_id"])
    assert sorted(r["doc_id"] for r in rows) == sorted(r["doc_id"] for r in docs.select("doc_id").collect())
    check_slots(rows)
    held = [sum(r["size"] for r in rows if r["shard"] == s) for s in range(8)]
    assert max(held) - min(held) <= max(r["size"] for r in rows)
    again = sharding.shard_rows(docs.repartition(7), keep=["doc_id"])
    assert sorted((r["doc_id"], r["shard"], r["slot"]) for r in rows) == sorted(tuple(r) for r in again.select("doc_id", "shard", "slot").collect())


def test_equal_texts_stay_together_unless_a_group_is_too_large(spark):
    texts = [(i, f"text {i // 4} " + "x" * 50) for i in range(4000)] + [(10_000 + i, "hot " + "y" * 60) for i in range(2000)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    rows = placed(docs, tolerance=0.05)
    held = [sum(r["size"] for r in rows if r["shard"] == s) for s in range(8)]
    assert max(held) <= 1.12 * sum(held) / 8 and min(held) >= 0.88 * sum(held) / 8
    check_slots(rows)
    shards: dict = {}
    for r in rows:
        shards.setdefault(r["text"], set()).add(r["shard"])
    hot = shards.pop("hot " + "y" * 60)
    assert len(hot) >= 3  # a third of all bytes
    assert all(len(s) == 1 for s in shards.values())


def test_rows_that_repeat_are_split_and_chunks_stay_small(spark):
    docs = spark.range(0, 6000, numPartitions=4).select(F.lit(7).cast("long").alias("doc_id"), F.lit("same").alias("text"))
    rows = placed(docs, n_shards=3)
    check_slots(rows, 3)
    assert {len([r for r in rows if r["shard"] == s]) for s in range(3)} <= set(range(1985, 2016))
    keys = sharding.keyed(docs, "doc_id", "text", None)
    chunks = sharding._chunked(keys, keys.select("key")).groupBy("chunk").count().collect()
    assert max(r["count"] for r in chunks) <= sharding.HOT * sharding.CHUNK_ROWS // 2 and all(len(r["chunk"]) > 32 for r in chunks)


def test_nulls_clashing_names_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, None, "a"), (1, None, "a"), (None, "", "b"), (2, "é", "c"), (None, None, None)], SCHEMA)
    rows = placed(docs, n_shards=2)
    assert sorted(docs.columns) == ["doc_id", "shard", "text"]
    assert {(r["text"], r["size"], r["text_crc32"]) for r in rows} == {(None, 1, 0), ("", 1, 0), ("é", 3, zlib.crc32("é".encode()))}
    assert all(r["law"] == "bytes" and r["grown_shard"] is None and isinstance(r["shard"], int) for r in rows)
    check_slots(rows, 2)
    assert placed(docs.limit(0)) == []
    assert [r["shard"] for r in placed(docs.limit(1), n_shards=1)] == [0]


def test_written_shards_read_back(spark, tmp_out):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    back = sharding.write_shards(docs, tmp_out + "/shards", n_shards=4)
    assert back.count() == docs.count() and {r["shard"] for r in back.select("shard").distinct().collect()} == {0, 1, 2, 3}
    assert back.select(docs.columns).exceptAll(docs).isEmpty()
