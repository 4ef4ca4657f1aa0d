import random

from ledgerline.llm import html_extract as hx


def lcs(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
    return t[-1][-1]


def test_alignment_is_a_longest_common_subsequence(monkeypatch):
    rnd = random.Random(3)
    for direct in (1 << 28, 20):
        monkeypatch.setattr(hx, "DIRECT_BITS", direct)
        for _ in range(300):
            a = [rnd.randrange(6) for _ in range(rnd.randrange(25))]
            b = [rnd.randrange(6) for _ in range(rnd.randrange(25))]
            got = hx.shared_lines(a, b)
            assert len(got) == lcs(a, b) and got == sorted(set(got))
            it = iter(b)
            assert all(any(a[i] == y for y in it) for i in got)


def text(page):
    return hx.extract(hx.Page("h", "/p", hx.blocks(page)), [])


def test_markup():
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
    <header><h1>Site</h1></header><nav><ul><li><a href=/>Home</a></ul></nav><!-- <p>gone</p> --><div class="ad banner">Buy</div>
    <div id="cookie-notice"><p>We use cookies</div><main><article><header><h1>A &amp; B&nbsp;&#233;</h1></header><p><b>One
    two<br>three</b><p>4 &lt; 5 and a<b>b</b>c<ul><li>x<li>y</ul><div class="post-comments"><article><p>First!</article></div>
    <form><input value="a>b"><p>mail</form><aside>also</aside><p class="notice">N</p></article></main>
    <section id="comments"><p>me too</p></section><footer>&copy; x</footer></body></html>"""
    assert text(page) == "A & B é\n\nOne two three\n\n4 < 5 and abc\n\nx\n\ny"
    assert text(None) == text("") == text("<p></p>") == ""
    assert text("no markup  at\nall") == "no markup at all"
    assert text("<p>a<div class=ad>b") == "a"
    assert text("1 < 2 <3 <p title='x>y\">q") .startswith("1 < 2 <3")
    assert text("<article><p>a</p><script>if (a<b) '</article>'</script><p>z") == "a\n\nz"


def test_class_words_never_drop_the_article():
    for box in ("article class='post comments-open'", "article class='post category-social'", "article class='post social'",
                "main class='has-sidebar'", "main class='sidebar'", "div role=main class='widget'"):
        end = box.split()[0]
        assert text(f"<nav>Menu</nav><{box}><p>a</p><div class=share>S</div><p>b</p></{end}><div class=sidebar>x</div>") == "a\n\nb", box
    for page in ("<div id='page' class='no-sidebar'>", "<div id=page class='sidebar'>", "<section id=related class=widget>"):
        for inner in ("article", "main"):
            assert text(f"{page}<p>top</p><{inner}><h1>T</h1><p>a</p><p class=ad>x</p></{inner}></div>") == "T\n\na", (page, inner)
    assert text("<main class=social><article class='post sponsor'><p>a</p><article class=comment><p>me</p></article></article></main>") == "a"
    assert text("<article><p>a</article><section id=comments><article><p>me too</article></section>") == "a"
    assert text("<aside><article><p>teaser</article></aside><div class='menu tag-x'>m</div><p>body</p>") == "body"
    assert text("<div class='no-sidebar'><p>a</p></div><div class='tag-ad'><p>b</p></div><div class='widget'>c</div>") == "a\n\nb"


def test_boxes_bound_the_page_but_shared_lines_go():
    mk = lambda own: hx.Page("h", "/x", hx.blocks(
        f"<div class=top>{own} site</div><div id='content' class='wide'><p>Share this</p><p>{own}</p><p>{own} more</p></div><p>{own} end</p>"))
    assert hx.extract(mk("one"), [mk("two")]) == "one\n\none more"
    assert hx.extract(mk("one"), []) == "Share this\n\none\n\none more"
    assert text("<div class='post-meta'>by x</div><div>body</div>") == "by x\n\nbody"


def test_differencing_without_article(spark):
    def page(body):
        return f"<body><div><p>Welcome to the site</p></div><div>{body}</div><div><p>All rights reserved</p></div></body>"

    rows = [(1, "http://a.example/x/1", page("<p>alpha one</p><p>alpha two</p>")), (2, "http://a.example/x/2", page("<p>beta one</p>")),
            (3, "http://a.example/x/2?again", page("<p>beta one</p>")), (4, "http://b.example/x/2", page("<p>alone</p>")),
            (5, None, None), (6, "http://c.example/", ""), (None, "http://a.example/x/3", page("<p>gamma</p>"))]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        got = {r.page_id: (r.url, r.text, r.n_chars) for r in hx.extract_pages(pages).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert {k: v[1] for k, v in got.items()} == {
        1: "alpha one\n\nalpha two", 2: "beta one", 3: "beta one", 4: "Welcome to the site\n\nalone\n\nAll rights reserved",
        5: "", 6: "", None: "gamma"}
    assert got[1][2] == len("alpha one\n\nalpha two") and got[5][0] is None
    assert hx.extract_pages(pages.limit(0)).count() == 0


def test_very_long_pages_are_whole():
    body = "".join(f"<p>line {i}</p>" for i in range(30000))
    a, b = (hx.Page("h", f"/{k}", hx.blocks(f"<div>top</div>{body if k else ''}<p>own {k}</p>")) for k in (1, 0))
    assert hx.extract(a, [b]).count("line") == 30000 and "top" not in hx.extract(a, [b])
    assert len(text("<p " * 50000)) >= 0 and len(text('<a "' * 20000)) >= 0


MENU = "".join(f"<div>menu {i}</div>" for i in range(30))


def site_page(body, day=0):
    return f"<body><div>Welcome</div>{MENU}<div>{body}</div><div>Printed on day {day}</div><div>All rights reserved</div></body>"


def test_neighbours_lie_beyond_copies_and_short_pages_are_no_copies():
    story = "<p>" + "a long story about one thing " * 5 + "</p><p>" + "and its end after many words " * 5 + "</p>"
    sources = [site_page("<p>alpha</p>"), site_page(story, 1), site_page(story, 1), site_page(story, 2), site_page(story, 3), site_page("<p>omega</p>")]
    rows = [(0, False, i, "u", "h", f"/x/{i}", src) for i, src in enumerate(sources)]
    got = {i: t for i, _, t, _ in hx.texts(iter(rows))}
    want = " ".join(("a long story about one thing " * 5).split()) + "\n\n" + " ".join(("and its end after many words " * 5).split())
    assert got[0] == "alpha\n\nPrinted on day 0" and got[5] == "omega\n\nPrinted on day 0"  # 30 menu lines are over 70 % of these pages
    assert got[1] == want + "\n\nPrinted on day 1" and got[2] == got[1] and got[3] == want + "\n\nPrinted on day 2"
    alone = hx.Page("h", "/x", hx.blocks(sources[1]))
    assert hx.extract(alone, [hx.Page("h", "/x", hx.blocks(sources[3]))]).startswith("Welcome")


def test_texts_do_not_depend_on_the_ranges(spark):
    rnd = random.Random(11)
    rows = []
    for i in range(300):
        host, copy = f"h{i % 3}.example", i % 10 >= 7  # runs of equal pages, some longer than a range
        body = "".join(f"<p>{' '.join(rnd.choice('abcdefgh') for _ in range(30))}</p>" for _ in range(3))
        rows.append((i, f"http://{host}/{i // 100}/{i:04d}", site_page("<p>same</p>" if copy or 100 <= i < 190 else body)))
    pages = spark.createDataFrame(rows + [(None, None, None), (7, None, site_page("<p>x</p>"))], "page_id long, url string, html string")
    found = []
    for n in (1, 3, 40):
        spark.conf.set("spark.sql.shuffle.partitions", str(n))
        try:
            found.append(sorted(map(tuple, hx.extract_pages(pages).collect()), key=str))
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert found[0] == found[1] == found[2] and len(found[0]) == 302
    assert sum("menu" in t for _, _, t, _ in found[0]) <= 1


def test_pages_with_an_article_are_differenced_too(monkeypatch):
    """The alignment runs for every page that has a neighbour; the article's shared paragraph is put back after it."""
    sources = [f"<div>Menu</div><article><p>Shared opening</p><p>own {i}</p></article><p>End {i}</p>" for i in range(3)]
    sources.insert(1, sources[0])
    aligned, real = [], hx.shared_lines
    monkeypatch.setattr(hx, "shared_lines", lambda a, b: aligned.append((a, b)) or real(a, b))
    rows = [(0, False, i, "u", "h", f"/x/{i}", src) for i, src in enumerate(sources)]
    got = {i: t for i, _, t, _ in hx.texts(iter(rows))}
    assert got == {0: "Shared opening\n\nown 0", 1: "Shared opening\n\nown 0", 2: "Shared opening\n\nown 1", 3: "Shared opening\n\nown 2"}
    pages = [hx.Page("h", "/x", hx.blocks(src)) for src in sources]
    assert len(aligned) == 4 and all(any(a == p.lines for a, _ in aligned) for p in pages)
    assert hx.template_lines(pages[0], [pages[1]]) == set()  # a copy tells nothing
    assert hx.template_lines(pages[0], [pages[2]]) == {0, 1}
