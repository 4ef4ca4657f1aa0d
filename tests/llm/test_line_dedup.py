import pytest

from ledgerline.llm import line_dedup as ld


def key(line):
    return line.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)})


def brute(rows):
    """[(id, text)] -> sorted (id, kept text, lines, dropped); null ids are one document after all others."""
    rank = lambda i: (i is None, i or 0)
    docs, first = {}, {}
    for i, t in rows:
        for line in (t or "").split("\n"):
            k = key(line)
            if len(k) >= 10:
                docs.setdefault(k, set()).add(i)
                first[k] = min(first.get(k, i), i, key=rank)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        stay = [x for x in lines if not (key(x) in docs and len(docs[key(x)]) > 1 and first[key(x)] != i)]
        kept = None if t is None else "\n".join(stay)
        out.append((i, kept, len(lines), len(lines) - len(stay)))
    return sorted(out, key=str)


def run(df, **kw):
    return sorted(((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in ld.dedup_lines(df, **kw).collect()), key=str)


@pytest.mark.parametrize("n_batches", [1, 4, 7])
def test_equals_brute_force_however_many_batches(spark, n_batches):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    assert run(docs, n_batches=n_batches) == brute([(r.doc_id, r.text) for r in docs.collect()])


def test_edge_rows(spark):
    long = "\n".join(f"line number {i}" for i in range(20000))
    rows = [(5, None, 1, "h"), (4, "", 1, "h"), (3, "Shared line one\nown line three\n\n", 1, "h"), (2, " \tSHARED LINE ONE\x0b\nshort\nshort", 1, "h"),
            (1, "short", 1, "h"), (7, "only here twice\nonly here twice", 1, "h"), (8, "same row text", 1, "h"), (8, "same row text", 1, "h"),
            (8, "other text of eight\nsame row text", 1, "h"), (9, "same row text", 1, "h"), (None, "shared line one\nnull own line", 1, "h"),
            (None, "null own line", 1, "h"), (10, long, 1, "h"), (11, long + "\nlast of eleven", 1, "h"), (12, "été à la plage\r", 1, "h"),
            (13, "ÉTÉ À LA PLAGE", 1, "h"), (14, "é" * 9, 1, "h"), (15, "é" * 9, 1, "h"), (-3, "negative id line", 1, "h"), (3, "negative id line", 1, "h")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_lines long, h1 string")  # clashing names
    assert run(docs) == brute([(i, t) for i, t, _, _ in rows])
    out = ld.dedup_lines(docs)
    assert sorted(out.columns) == ["doc_id", "h1", "n_dropped", "n_lines", "text"] and {r.h1 for r in out.collect()} == {"h"}
    assert ld.dedup_lines(docs.limit(0)).count() == 0


def test_runs_are_compacted(spark, monkeypatch):
    written = []
    monkeypatch.setattr(ld.Runs, "_write", lambda self, df, w=ld.Runs._write: written.append((df.count(), w(self, df))) or written[-1][1])
    lines = spark.createDataFrame([(i, i % 5, b) for b in range(6) for i in range(b * 10, b * 10 + 10)], "h1 long, h2 long, batch int")
    lines = lines.withColumnRenamed("batch", "b").selectExpr("b as batch", "h1", "h2", "h1 as id")
    assert ld.owners(lines, 6).count() == 0
    sizes = [n for n, _ in written]
    assert 20 in sizes and 40 in sizes  # two runs became one, and two of those one
