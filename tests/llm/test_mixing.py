import hashlib
import re
from collections import defaultdict

from ledgerline.llm import mixing


def targets(size_of):
    """Iterative resharing: what is above three times a source's size goes to the others by weight."""
    names = sorted((s for s in size_of if s is not None), key=lambda s: [ord(c) for c in s]) + ([None] if None in size_of else [])
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, capped = sum(size_of.values()), {}
    while True:
        free = [s for s in names if s not in capped]
        rest = total - sum(capped.values())
        share = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 3 * size_of[s]]
        if not over:
            return {**share, **capped}
        capped |= {s: 3 * size_of[s] for s in over}


def brute(rows):
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    by = defaultdict(list)
    for i, t, s in rows:
        by[s].append((hashlib.md5(("" if i is None else str(i)).encode()).hexdigest(), i is not None, i or 0, size(t), i))
    total = {s: sum(x[3] for x in v) for s, v in by.items()}
    target, out = targets(total), []
    for s, v in by.items():
        words, start = min(int(target[s] + 0.5), 3 * total[s]), 0
        for _, _, _, n, i in sorted(v):
            full, part = divmod(words, total[s]) if total[s] else (0, 0)
            out.append((i, n, total[s], round(target[s], 6), full * n + max(0, min(part, start + n) - start)))
            start += n
    return sorted(out, key=str)


def got(df):
    return sorted(((r.doc_id, r["size"], r.source_size, round(r.target, 6), r.taken) for r in df.collect()), key=str)


def test_equals_closed_form(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    assert got(mixing.mix(docs)[1]) == brute([(r.doc_id, r.text, r.source) for r in docs.collect()])


def test_schedule_is_whole_and_even(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    schedule, per_doc = mixing.mix(docs, block=64)
    rows, sizes = schedule.collect(), {r.doc_id: r["size"] for r in per_doc.collect()}
    slots = defaultdict(list)
    for r in rows:
        assert 0 <= r.from_word and r.from_word + r.taken_words <= sizes[r.id] and r.taken_words > 0
        slots[r.slot].append((r.pos, r.taken_words, r.source))
    short = 0
    for pieces in slots.values():  # a slot is one block of one source, without gaps
        at = 0
        for pos, n, _ in sorted(pieces):
            assert pos == at
            at += n
        assert len({s for _, _, s in pieces}) == 1 and at <= 64
        short += at < 64
    source = {slot: p[0][2] for slot, p in slots.items()}
    assert short <= len(set(source.values()))
    # low discrepancy: any stretch of slots has each source near its share
    order = [source[s] for s in sorted(source)]
    for s in set(order):
        share = order.count(s) / len(order)
        for a, b in ((0, len(order) // 3), (len(order) // 3, len(order) // 2)):
            assert abs(order[a:b].count(s) - share * (b - a)) < 8
    words = defaultdict(int)
    for r in rows:
        words[r.source] += r.taken_words
    plan = {r.source: r.target for r in per_doc.collect()}
    assert all(abs(words[s] - plan[s]) <= 1 for s in plan)


def test_edge_rows(spark):
    rows = [(1, "a b c", "é"), (2, None, "z"), (3, "", "z"), (4, "one two\x0bthree\u00a0four", None), (4, "one two\x0bthree\u00a0four", None),
            (None, "x y", "Z"), (None, "x y", "Z"), (6, "w " * 30000, "big"), (7, "q", "aa"), (8, "r s", "aa")]
    docs = spark.createDataFrame([(*r, 5, 0.5) for r in rows], "doc_id long, text string, source string, size int, target double")
    out = mixing.mix(docs)[1]
    assert got(out) == brute(rows)
    assert all(r.taken <= 3 * r["size"] for r in out.collect())
    mixed = mixing.mixed_documents(docs).collect()
    assert all(r.taken > 0 and r.taken <= 3 * r["size"] for r in mixed) and len(mixed) == sum(r.taken > 0 for r in out.collect())
    assert got(mixing.mix(docs)[1]) == got(out)
    assert mixing.mix(docs.limit(0))[1].count() == 0 and mixing.mixed_documents(docs.limit(0)).count() == 0
    empty = docs.where("text is null or text = ''")
    assert [r.taken for r in mixing.mix(empty)[1].collect()] == [0, 0]


def test_rows_that_repeat_share_out_the_takes(spark):
    rows = [(1, "a b c", "x")] * 400 + [(2, "d e", "x"), (3, "f " * 500, "y"), (4, "g", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    want = sorted((x for x in brute(rows) if x[4] > 0), key=str)
    assert len({x[4] for x in want if x[0] == 1}) > 1  # the target ends within the group
    assert got(mixing.mixed_documents(docs)) == want
    assert mixing.mixed_documents(docs).groupBy("doc_id").count().where("doc_id = 1").first()["count"] == sum(x[0] == 1 for x in want)
