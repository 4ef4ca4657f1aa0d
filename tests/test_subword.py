import pytest
from pyspark.sql import functions as F

from ledgerline.operators import sequence as S
from ledgerline.operators import subword as SW

FOLDER = "/opt/tokenizers"


@pytest.fixture(scope="module")
def texts(spark):
    rows = [(0, "<s_t>b</s_t><s_an>12345-67</s_an></s>"), (1, ""), (2, None), (3, "Billing: plain text, no tag <s_none> é€"), (4, "<sep/></s></s>"),
            (5, "<s_pn>" + "9 " * 3000 + "</s_pn></s>")]
    return spark.createDataFrame(rows, "k int, sequence string")


def test_byte_level_labels_round_trip(spark, texts):
    words = SW.Subwords.load(spark, f"{FOLDER}/byte_bpe_50k.json")
    assert list(words.held) == ["Bill"]  # an entry of the vocabulary: no token to add, and no place to cut at
    assert words.new_tokens == [t for t in [*S.vocabulary(), "<sep/>", "</s>"] if t != "Bill"] and words.size == 50257 + len(words.new_tokens)
    out = words.label_ids(texts, "sequence").withColumn("back", words.decode(F.col("labels")))
    rows = {r["k"]: r for r in out.collect()}
    for k in (0, 1, 3, 4):
        assert rows[k]["back"] == rows[k]["sequence"] and not rows[k]["truncated"] and len(rows[k]["labels"]) == S.MAX_LENGTH
    assert rows[0]["labels"][0] == words.added["<s_t>"] and rows[4]["labels"][:4] == [words.added["<sep/>"]] + [words.added["</s>"]] * 2 + [-100]
    assert rows[1]["n_tokens_full"] == 0 and rows[2]["labels"] is None and rows[2]["back"] is None
    assert rows[5]["truncated"] and len(rows[5]["labels"]) == S.MAX_LENGTH and rows[5]["n_tokens_full"] > 3000
    assert words.added["</s>"] not in rows[5]["labels"]  # the cut takes the end marker


def test_labels_match_the_library_on_its_own(spark, texts):
    """The library with the same tokens added gives the same ids."""
    from tokenizers import AddedToken, Tokenizer
    own = Tokenizer.from_file(f"{FOLDER}/byte_bpe_50k.json")
    words = SW.Subwords.load(spark, f"{FOLDER}/byte_bpe_50k.json")
    own.add_tokens([AddedToken(t, normalized=False) for t in words.new_tokens])
    for k, seq, ids in texts.select("k", "sequence", words.ids(F.col("sequence"))).collect():
        assert ids == (None if seq is None else own.encode(seq, add_special_tokens=False).ids), k


def test_pieces_of_a_text_have_the_ids_of_the_text(monkeypatch):
    """Every mix of white space of both kinds, letters, digits, signs and apostrophes: the ids are the library's for the whole text."""
    import random

    from tokenizers import Tokenizer
    content = open(f"{FOLDER}/byte_bpe_50k.json", "rb").read()
    own, rng = Tokenizer.from_buffer(content), random.Random(5)
    atoms = ["a", "Bill", " ", " ", "\n", "\t", "\r", "\x0b", "\x1c", "\x85", "\u00a0", "\u2003", "\u3000", "\u200b", "'s", "'", "7", "!", "\u00e9", "\u0301", "\u4e2d", "\U0001f600"]
    texts = ["".join(rng.choices(atoms, k=rng.randint(1, 30))) for _ in range(4000)] + ["x" * 5000, "  ", "a\n" * 3000]
    whole = [own.encode(t, add_special_tokens=False).ids for t in texts]
    kept = SW._kept("json", content)
    assert SW._ids_by_pieces(own, kept, texts) == whole and kept and max(map(len, kept)) <= SW.KEPT_CHARS
    monkeypatch.setattr(SW, "CALL_CHARS", 7)
    monkeypatch.setattr(SW, "KEPT_PIECES", 50)
    assert SW._ids_by_pieces(own, {}, texts) == whole
    joined = content.replace(b'"add_prefix_space": false', b'"add_prefix_space": true').replace(b'"add_prefix_space":false', b'"add_prefix_space":true')
    assert joined != content and SW._kept("json", joined) is None and SW._kept("model", b"") is None


def test_pieces_keep_the_tokens_they_have(spark, texts):
    words = SW.Subwords.load(spark, f"{FOLDER}/piece_bpe_32k.model")
    assert words.added["</s>"] == 2 and "</s>" not in words.new_tokens and words.added[S.vocabulary()[0]] == 32000
    rows = {r["k"]: r for r in texts.select("k", "sequence", words.decode(words.ids(F.col("sequence"))).alias("back")).collect()}
    assert rows[0]["back"] == rows[0]["sequence"] and rows[3]["back"] == rows[3]["sequence"] and rows[2]["back"] is None


def test_other_files_are_refused(spark, tmp_out):
    with pytest.raises(ValueError):
        SW.Subwords.load(spark, f"{FOLDER}/byte_bpe_50k.tiktoken")


def test_bytes_of_tokens_are_the_library_s_text():
    """A batch is decoded by its tokens' bytes, padding, unknown ids and NULL rows too; broken UTF-8 is left to the library."""
    import pyarrow as pa
    from tokenizers import Tokenizer
    content = open(f"{FOLDER}/byte_bpe_50k.json", "rb").read()
    own = Tokenizer.from_buffer(content)
    table = SW._bytes_of("json", content, ((50257, "<s_t>"),))
    texts = ["12,345.67 é€ \U0001f600\n", "", "<|endoftext|> a  b", "x" * 70000]
    rows = [own.encode(t, add_special_tokens=False).ids for t in texts]
    got = SW._joined(table, pa.array([*rows, None, [50257, *rows[0], -100, 10 ** 6]], pa.list_(pa.int32()))).to_pylist()
    assert got == [*texts, None, "<s_t>" + texts[0]] and texts[2] == own.decode(rows[2], skip_special_tokens=False)
    half = own.encode("\U00013000", add_special_tokens=False).ids[:1]
    assert SW._joined(table, pa.array([half], pa.list_(pa.int32()))) is None
    assert SW._joined(table, pa.array([None, rows[0], rows[2]], pa.list_(pa.int32())).slice(1, 1)).to_pylist() == texts[:1]
    assert SW._bytes_of("model", b"", ()) is None


def test_broken_utf8_is_decoded_by_the_library(spark):
    from tokenizers import Tokenizer
    own = Tokenizer.from_file(f"{FOLDER}/byte_bpe_50k.json")
    words = SW.Subwords.load(spark, f"{FOLDER}/byte_bpe_50k.json", [])
    half = own.encode("\U00013000", add_special_tokens=False).ids[:1]
    rows = spark.createDataFrame([(half + [-100],), ([],), (None,)], "ids array<int>").coalesce(1)
    assert [r[0] for r in rows.select(words.decode(F.col("ids"))).collect()] == [own.decode(half), "", None]


def test_tokens_are_counted_by_one_run_of_the_tokenizer(spark):
    from ledgerline.plans import catalog

    from .conftest import SF_SMALL
    plan = catalog.QUERIES["t_subword_added"](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


def test_stretches_of_rows_are_bounded():
    import pyarrow as pa
    rows = pa.array(["aa", None, "b" * 9, "c", "dd", ""])
    cut = [x.to_pylist() for x in SW._cut(rows, pa.compute.binary_length(rows), 3)]
    assert cut == [["aa", None], ["b" * 9], ["c", "dd", ""]]


def test_documents_come_in_small_batches(spark):
    """A worker holds few whole texts at once, however many its task reads."""
    from ledgerline.plans import catalog

    from .conftest import SF_SMALL
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.set(key, "10000")
    catalog.QUERIES["t_subword_documents"](spark, SF_SMALL)
    assert int(spark.conf.get(key)) <= 1000
