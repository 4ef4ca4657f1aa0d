import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from ledgerline.llm import decontaminate, language_id, simhash

from . import test_decontaminate, test_line_dedup, test_mixing, test_simhash

SF = "/root/testdata/sf0.01"


def by_hand(spark, docs):
    """The stages one after another over Python rows: (doc_id, text, source)."""
    model = language_id.train(docs)
    rows = [(r.doc_id, r.text, r.source) for r in docs.collect()]
    keep = {r.doc_id for r in language_id.predict(docs, model).collect() if not r.rejected}
    rows = [r for r in rows if r[0] in keep]
    text = {i: t for i, t, _, _ in test_line_dedup.brute([r[:2] for r in rows])}
    rows = [(i, text[i], s) for i, _, s in rows]
    same = test_simhash.brute_components([(i, test_simhash.brute_fingerprint(t)) for i, t, _ in rows])
    first = {i for (i, _), c in same.items() if i == c}
    rows = [r for r in rows if r[0] in first]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    bad = {d for d, _ in test_decontaminate.brute([r[:2] for r in rows], items)}
    rows = [r for r in rows if r[0] not in bad]
    return {x[0]: x for x in test_mixing.brute(rows) if x[4] > 0}, {r[0]: r[1] for r in rows}


def test_run_equals_the_stages_by_hand(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want, text = by_hand(spark, docs)
    got = cp.run(spark, SF).collect()
    assert {r.doc_id: (r.doc_id, r["size"], r.source_size, round(r.target, 6), r.taken) for r in got} == want
    assert all(r.text == text[r.doc_id] and r.n_chars == len(r.text) for r in got)


@pytest.mark.parametrize("name, stage", cp.STAGES)
def test_stages_take_odd_rows(spark, name, stage):
    long = "the of and in that this with from " * 20000
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (None, "some words of the text here", None, "s", 3), (3, long, "en", None, 9),
            (4, "the words and that is it for the day", "en", "s", 1), (4, "the words and that is it for the day", "en", "s", 1),
            (5, "12 34", "en", "s", 1), (6, "the words and that is it for the day", "en", "s", 1)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame([(*r, "k", 7, 1.5) for r in rows], schema + ", _key string, `a b` int, score double")
    out = stage(spark, docs, SF)
    assert set(docs.columns) <= set(out.columns)
    if name != "mixing":
        assert out.columns == docs.columns
    got = out.collect()
    assert all(r["_key"] == "k" and r["a b"] == 7 and r.score == 1.5 for r in got)
    assert len(got) == {"language-id": 4, "line-dedup": 8, "near-duplicates": 5, "decontamination": 8, "mixing": 6}[name], got
    assert stage(spark, docs.limit(0), SF).count() == 0


def test_planted_copies_and_passages_go_and_clean_documents_stay(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 300")
    item = spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").first().text
    alone = {r.doc_id for r in simhash.keep_one(docs, 3, 3).collect()}
    base = {r.doc_id: r.text for r in docs.collect() if r.text.count(" ") > 900 and r.doc_id in alone}
    clean, copied = sorted(base)[0], sorted(base)[1]
    words = base[copied].split(" ")
    near = " ".join([*words[:-1], "changed"])
    extra = [(9001, base[copied]), (9002, near), (9003, " ".join(words[:60]) + " " + item + " " + " ".join(reversed(words[60:160])))]
    far = test_simhash.brute_fingerprint(near) ^ test_simhash.brute_fingerprint(base[copied])
    assert far.bit_count() <= 3
    more = docs.unionByName(spark.createDataFrame([(i, t, "en", "src0", len(t)) for i, t in extra], docs.schema))
    kept = {r.doc_id for r in simhash.keep_one(more, 3, 3).collect()}
    assert clean in kept and copied in kept and 9001 not in kept and 9002 not in kept
    kept = {r.doc_id for r in decontaminate.drop_contaminated(more, spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
    assert clean in kept and 9003 not in kept
    told = cp.keep_told_languages(spark, more, SF)
    assert told.count() >= more.count() - 2 and told.where(F.col("doc_id") == clean).count() == 1
