import random

import pytest
from pyspark.sql import functions as F

from ledgerline.llm import language_id as li
from ledgerline.llm import queries


def test_held_out_accuracy(spark):
    got = queries.op9_language_id(spark, "/root/testdata/sf0.01").collect()
    lang = {r.doc_id: r.lang for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    assert len(got) == len(lang)
    held = [r for r in got if r.held_out]
    assert 150 < len(held) < 350
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.98 * len(held)
    assert sum(r.rejected for r in got) <= 0.02 * len(got)
    assert all(0 <= r.score <= 1 for r in got)


def test_a_text_is_told_alike_in_any_company(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = li.train(docs)
    texts = [li.normalised(r.text) for r in docs.collect()]
    together = model.logits(texts)[0]
    alone = [model.logits([t])[0][0] for t in texts]
    assert abs(together - alone).max() < 1e-6


def test_edge_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = li.train(docs)
    rows = [(1, None, 0.5), (2, "", 0.5), (3, "12 345 !!", 0.5), (4, "ça", 0.5), (None, "é", 0.5), (6, "the and " * 300000, 0.5), (6, "x", None)]
    odd = spark.createDataFrame(rows, "doc_id long, text string, score double")
    got = li.predict(odd, model).collect()
    assert len(got) == len(rows)
    assert [r.lang_pred for r in got[:3]] == ["und"] * 3 and all(r.rejected and r.score == 0 for r in got[:3])
    assert all(r.lang_pred in model.langs for r in got[3:])
    assert li.predict(odd.limit(0), model).count() == 0
    assert li.train(docs.limit(0)) is None
    assert {r.lang_pred for r in li.predict(odd, None).collect()} == {"und"}
    # letters of a script never seen are not told with confidence
    far = spark.createDataFrame([(1, "日本語のテキスト" * 20)], "doc_id long, text string")
    assert li.predict(far, model).first().rejected


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_unseen_scripts_and_noise_are_rejected_whatever_the_training_size(spark, sf):
    docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")
    model = li.train(docs)
    rnd = random.Random(5)
    scripts = ["日本語のテキスト", "Это русский текст о погоде ", "αυτό είναι κείμενο ", "هذا نص عربي ", "한국어 텍스트입니다 "]
    noise = ["".join(rnd.choice("abcdefghijklmnopqrstuvwxyz   ") for _ in range(200)) for _ in range(100)]
    assert model.tell([li.normalised(s * k) for s in scripts for k in (1, 20)])[2].all()
    assert model.tell([li.normalised(t) for t in noise])[2].all()
    rows = [r.text for r in docs.where("lang is not null and length(text) > 100").limit(1000).collect()]
    assert model.tell([li.normalised(t) for t in rows])[2].mean() <= 0.01
    assert model.tell([li.normalised(" ".join(t.split()[:8])) for t in rows])[2].mean() <= 0.02


def test_sample_is_bounded_though_ids_repeat(spark):
    i = F.when(F.col("id") % 2 == 0, F.lit(None)).otherwise(F.lit(7)).cast("long")
    rows = spark.range(4000).select(i.alias("doc_id"), F.concat(F.lit("text "), F.col("id")).alias("text"),
                                    F.when(F.col("id") < 3990, F.lit("en")).otherwise(F.lit("fr")).alias("lang"))
    got = li.sample(rows, {"en": 3990, "fr": 10}, 100, "doc_id", "lang").collect()
    assert sum(r.lang == "en" for r in got) == 100 and sum(r.lang == "fr" for r in got) == 10
    assert 20 < sum(r.doc_id is None for r in got) < 90
