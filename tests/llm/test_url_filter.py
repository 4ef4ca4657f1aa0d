from ledgerline.llm import queries
from ledgerline.llm import url_filter as uf


def judge(spark, urls, rules):
    pages = spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate(urls)], "page_id long, url string, host string, _expr string")
    r = spark.createDataFrame(rules, "host string, path string, verdict string")
    return {x.page_id: (x.host, x.path, x.rule, x.verdict) for x in uf.judge(pages, r).collect()}


def test_parts_suffixes_prefixes_and_precedence(spark):
    urls = ["HTTP://WWW.Example.ORG/es/x?q#f", "http://example.org/en/12", "http://example.org/en/2", "https://org/", "http://org", "http://notexample.org/es/",
            "ftp://a.b.com/de/fr/", "http://a.com/FR/", "http://a.com#x/fr/", "http://a.com/fr/?x://b.org/", "no scheme", "", None, "http://", "x://y://org/",
            "http://user@example.org:80/es/", "http://É.org/é?"]
    got = judge(spark, urls, queries.RULES)
    assert got == {
        0: ("www.example.org", "/es/x", "example.org/es/", "block"), 1: ("example.org", "/en/12", "example.org/en/1", "block"),
        2: ("example.org", "/en/2", "org/", "allow"), 3: ("org", "/", "org/", "allow"), 4: ("org", "", None, "allow"),
        5: ("notexample.org", "/es/", "org/", "allow"), 6: ("a.b.com", "/de/fr/", "com/de/", "block"), 7: ("a.com", "/FR/", None, "allow"),
        8: ("a.com", "", None, "allow"), 9: ("a.com", "/fr/", "com/fr/", "allow"), 10: ("", "", None, "allow"), 11: ("", "", None, "allow"),
        12: ("", "", None, "allow"), 13: ("", "", None, "allow"), 14: ("y:", "//org/", None, "allow"),
        15: ("user@example.org:80", "/es/", None, "allow"), 16: ("É.org", "/é", "org/", "allow")}


def test_ties_bad_rules_repeats_and_empty_tables(spark):
    rules = [("a.com", "/", "allow"), ("a.com", "/", "block"), ("com", "/xx/", "allow"), (None, "/", "block"), ("b.com", None, "block"), ("c.com", "", "block")]
    got = judge(spark, ["http://a.com/", "http://c.com", "http://b.com/", "http://" + "s." * 3000 + "a.com/" + "p" * 100000], rules)
    assert [got[i][2:] for i in range(4)] == [("a.com/", "block"), ("c.com", "block"), (None, "allow"), ("a.com/", "block")]
    pages = spark.createDataFrame([(1, "http://a.com/"), (1, "http://a.com/"), (None, "http://a.com/"), (None, None)], "page_id long, url string")
    r = spark.createDataFrame(rules, "host string, path string, verdict string")
    assert sorted(str(tuple(x)) for x in uf.judge(pages, r).collect()) == sorted(
        ["(1, 'a.com', '/', 'a.com/', 'block')"] * 2 + ["(None, 'a.com', '/', 'a.com/', 'block')", "(None, '', '', None, 'allow')"])
    assert uf.judge(pages.limit(0), r).count() == 0
    assert {x.verdict for x in uf.judge(pages, r.limit(0)).collect()} == {"allow"}


def test_a_short_prefix_that_meets_is_not_a_hit(spark, monkeypatch):
    monkeypatch.setattr(uf, "PREFIX_HEX", 1)  # 4 bits: many digests share it
    rules = [(f"h{i}.com", "/", "block") for i in range(40)]
    got = judge(spark, [f"http://h{i}.com/" for i in range(80)], rules)
    assert [got[i][3] for i in range(80)] == ["block"] * 40 + ["allow"] * 40
