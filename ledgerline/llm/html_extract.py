"""Operator 4: main text of web pages by nearest-URL page differencing.

Pages are dealt by ranges of (host, path, page_id) and sorted, so that a page's neighbours
in its host's paths come before and after it, whatever the size of a host. Every page is cut
into text blocks; a page is paired with the neighbour that shares the longer beginning of the
path, their blocks are aligned by a longest common subsequence, and shared blocks are deleted.
Copies of a page tell nothing about the template: the neighbours are the nearest pages on either side
that are no copies, however many copies lie between. Two pages are copies if the blocks that no markup drops are the same, or if
over ``COPY`` of the text in the one's long blocks (paragraphs; menus have short ones) stands in the other.
Each range is given, beside its own pages, the nearest ones of the ranges before and after it (of equal
pages the nearest other one too), so that a page's text does not depend on where ranges end.

Differencing alone gives wrong texts (README has figures): it deletes paragraphs that two
articles share, and keeps menus or adverts that change from page to page. So the page's own
markup is an exact check on it: blocks inside elements that are menus, adverts, comments and
the like by tag, role, class or id are dropped whether shared or not, and blocks inside
``article`` or ``main`` stay though shared. A word of a class or id never drops ``main`` or what
holds it, nor ``article`` (but for one inside another, a comment mostly); an article in an
element that such a word drops counts if the page has no other. Where a page has no such element, the alignment
alone decides about every block that no markup drops (inside a box of a class or id like
``content``, if the page has one).

Defined results: null or empty html gives the empty text; a null URL has an empty host and
path; repeated rows are pages of their own and copies of each other; markup that isn't closed
ends with its parent; an empty table gives no rows. A page without a neighbour of its host that is no
copy keeps all that no markup drops. A run of copies that aren't equal byte by byte and that reaches over the end
of a range sees the last of them there, and has the neighbour on its other side only.
"""

from __future__ import annotations

import html as entities
import json
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, row_batches
from .url_filter import host_of, path_of

COPY, LONG = 0.7, 80  # share of the text in blocks of so many code points
SAMPLE = 20  # keys for each range that the driver chooses bounds from, about
DIRECT_BITS = 1 << 28  # alignments with more cells are halved first

# fixed values: names of HTML
BLOCK = frozenset("""address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption
    figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre search
    section summary table tbody td tfoot th thead tr ul""".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style noscript template title textarea iframe noframes noembed xmp svg math object canvas select".split())
DROPPED = frozenset("nav aside footer form header menu dialog button head search".split())
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
# words of class and id by which pages mark what isn't the article
DROPPED_WORDS = frozenset("""ad ads adv advert adverts advertisement advertisements advertising sponsor sponsored promo promotion
    cookie cookies consent gdpr notice notices popup modal overlay banner newsletter subscribe subscription signup login paywall
    comment comments commentlist reply replies respond discussion disqus feedback sidebar aside widget widgets related recommended
    recommendations trending menu nav navbar navigation breadcrumb breadcrumbs pagination pager masthead topbar footer copyright
    share sharing social header alert alerts toast""".split())
OWN_WORDS = frozenset("article entry post story content main".split())  # of these, a header holds the title
MAIN_ROLES = frozenset("main article".split())
# class names that tell a state or a topic of the element, not what it is
_STATES = re.compile(r"(?:has|no|not|is|with|without|category|cat|tag|hide|show)[-_].*|.*[-_](?:open|closed|enabled|disabled|on|off|active|inactive)")
# whole class names and ids that pages without article or main give to the article's box
BOXES = frozenset("""content main article post entry story main-content article-content article-body post-content post-body
    entry-content entry-body story-content story-body maincontent articlebody""".split())

# by the standard a quote opens a value only after an equals sign
_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+)*+)>""")
_PLAIN = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
_START = re.compile(r"</?[a-zA-Z]")
_OTHER = re.compile(r"<[!?/][^>]*+(?:>|\Z)")
_ATTR = re.compile(r"""(class|id|role|hidden|aria-hidden|style|itemprop)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?(?=[\s/"'>]|\Z)""", re.I)
_WORDS = re.compile(r"[a-z]+")


@dataclass
class Element:
    name: str
    dropped: int  # 2 dropped, 1 only by a word of a class or id, outside articles
    main: int  # 2 inside article or main, 1 inside a box named like them
    article: bool = False  # inside article


def _attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): (m[2] or "").strip("\"'").lower() for m in _ATTR.finditer(raw)} if raw.strip() else {}


def _element(name: str, raw: str, inside: Element) -> Element:
    a = _attributes(raw)
    names = [n for n in f"{a.get('class', '')} {a.get('id', '')}".split() if not _STATES.fullmatch(n)]
    words = set(_WORDS.findall(" ".join(names)))
    named = words & DROPPED_WORDS
    if named <= {"header", "banner", "share"} and words & OWN_WORDS:
        named = set()
    is_main = name in ("article", "main") or a.get("role") in MAIN_ROLES or a.get("itemprop") == "articlebody"
    is_article = name == "article" or a.get("role") == "article"
    if is_main and not inside.article:
        named = set()
    drop = (name in DROPPED and not (name == "header" and inside.main == 2)) or a.get("role") in DROPPED_ROLES
    drop |= "hidden" in a or a.get("aria-hidden") == "true" or "display:none" in a.get("style", "").replace(" ", "")
    whole = name in ("html", "body")
    dropped = 0 if whole else 2 if drop else (2 if inside.main == 2 else 1) if named else 0
    outer = 0 if is_main and not is_article and inside.dropped == 1 and inside.main < 2 else inside.dropped
    box = not dropped and not BOXES.isdisjoint([*a.get("class", "").split(), a.get("id", "").strip()])
    return Element(name, max(outer, dropped), max(inside.main, 2 if is_main and not drop and not named else int(box and not whole)),
                   inside.article or is_article)


def blocks(page: str | None) -> list[tuple[str, bool, int]]:
    """(text, dropped by markup, 2 inside article or main, 1 inside a box named so) of every block with text, in page order."""
    src, out, text = page or "", [], []
    stack, opened = [Element("", 0, 0)], Counter()
    tag, unclosed = _TAG, set()  # each scan to the end of the page that finds nothing is made once

    def flush() -> None:
        words = " ".join(entities.unescape("".join(text)).split())
        text.clear()
        if words:
            out.append((words, stack[-1].dropped, stack[-1].main))  # dropped is settled below

    def close(name: str, within: frozenset = frozenset()) -> None:
        if not opened[name]:
            return
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].name == name:
                flush()
                opened.subtract(e.name for e in stack[i:])
                del stack[i:]
                return
            if stack[i].name in within:
                return

    at = 0
    while at < len(src):
        lt = src.find("<", at)
        if lt < 0:
            text.append(src[at:])
            break
        text.append(src[at:lt])
        if src.startswith("<!--", lt):
            end = src.find("-->", lt + 4)
            at = len(src) if end < 0 else end + 3
            continue
        if _START.match(src, lt):
            m = tag.match(src, lt)
            if not m and tag is _TAG:  # a quote that never closes
                tag = _PLAIN
                m = tag.match(src, lt)
            if not m:  # no tag closes from here on
                text.append(src[lt:])
                break
        else:
            m = _OTHER.match(src, lt)
        if not m:
            text.append("<")
            at = lt + 1
            continue
        at = m.end()
        if m.re is _OTHER:
            continue
        name = m[2].lower()
        if m[1]:
            close(name)
            if name in BLOCK:
                flush()
            continue
        if name in RAW:
            end = None if name in unclosed else re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>", re.I).search(src, at)
            if end:
                at = end.end()
            elif name in ("script", "style", "title", "textarea"):
                at = len(src)
            else:
                unclosed.add(name)
            continue
        if name == "br":
            text.append(" ")
        if name in BLOCK:
            close("p", frozenset(("td", "th", "div", "article", "section", "li", "blockquote", "main")))
            if name in ("li", "option"):
                close(name, frozenset(("ul", "ol", "menu")))
            elif name in ("td", "th", "tr"):
                close(name, frozenset(("table",)))
            elif name in ("dt", "dd"):
                close("dt", frozenset(("dl",)))
                close("dd", frozenset(("dl",)))
            flush()
        if name not in VOID:
            element = _element(name, m[3], stack[-1])
            if (name in BLOCK or element.dropped != stack[-1].dropped or element.main != stack[-1].main
                    or element.article != stack[-1].article):
                if name not in BLOCK:
                    flush()
                opened[name] += 1
                stack.append(element)
    flush()
    least = 1 if all(dropped or main < 2 for _, dropped, main in out) else 0  # no article but in what a word drops
    return [(words, dropped > (least if main == 2 else 0), main) for words, dropped, main in out]


def _rows(a: list[int], b: list[int]) -> list[int]:
    """Bit-parallel table of the longest common subsequence: in row i, bit j is 0 where column j adds one."""
    where: dict[int, int] = {}
    for j, x in enumerate(b):
        where[x] = where.get(x, 0) | 1 << j
    full = (1 << len(b)) - 1
    v, rows = full, [full]
    for x in a:
        u = v & where.get(x, 0)
        v = ((v + u) | (v - u)) & full
        rows.append(v)
    return rows


def _lengths(a: list[int], b: list[int]) -> np.ndarray:
    """Length of the common subsequence of ``a`` with each prefix of ``b``."""
    v, where = (1 << len(b)) - 1, {}
    full = v
    for j, x in enumerate(b):
        where[x] = where.get(x, 0) | 1 << j
    for x in a:
        u = v & where.get(x, 0)
        v = ((v + u) | (v - u)) & full
    bits = np.unpackbits(np.frombuffer(v.to_bytes(len(b) // 8 + 1, "little"), np.uint8), bitorder="little")[:len(b)]
    return np.concatenate([[0], np.cumsum(1 - bits.astype(np.int64))])


def shared_lines(a: list[int], b: list[int]) -> list[int]:
    """Positions in ``a`` of a longest common subsequence of ``a`` and ``b``."""
    if not a or not b:
        return []
    if len(a) > 1 and len(a) * len(b) > DIRECT_BITS:  # halve a, and b where both halves have most in common
        mid = len(a) // 2
        at = int((_lengths(a[:mid], b) + _lengths(a[mid:][::-1], b[::-1])[::-1]).argmax())
        return shared_lines(a[:mid], b[:at]) + [mid + i for i in shared_lines(a[mid:], b[at:])]
    rows, i, j, out = _rows(a, b), len(a), len(b), []

    def common(i: int, j: int) -> int:
        return j - (rows[i] & ((1 << j) - 1)).bit_count()

    while i and j:
        if a[i - 1] == b[j - 1]:
            i, j = i - 1, j - 1
            out.append(i)
        elif common(i - 1, j) == common(i, j):
            i -= 1
        else:
            j -= 1
    return out[::-1]


@dataclass
class Page:
    host: str
    path: str
    blocks: list[tuple[str, bool, int]]

    @cached_property
    def lines(self) -> list[int]:
        return [hash(b[0]) for b in self.blocks]

    @cached_property
    def kept(self) -> list[int]:
        return [line for line, b in zip(self.lines, self.blocks) if not b[1]]

    @cached_property
    def marked(self) -> int:
        return max((main for _, dropped, main in self.blocks if not dropped), default=0)


def copies(a: Page, b: Page) -> bool:
    if a.host != b.host or a.kept == b.kept:
        return a.host == b.host
    there, long, shared = set(b.kept), 0, 0
    for line, (text, dropped, _) in zip(a.lines, a.blocks):
        if not dropped and len(text) >= LONG:
            long += len(text)
            shared += len(text) * (line in there)
    return shared > COPY * long


def likeness(a: Page, b: Page) -> int:
    """Leading parts of the path that two pages of a host share; -1 for pages of other hosts."""
    if a.host != b.host:
        return -1
    n = 0
    for x, y in zip(a.path.split("/"), b.path.split("/")):
        if x != y:
            break
        n += 1
    return n


def template_lines(page: Page, neighbours: list[Page]) -> set[int]:
    """Positions of the blocks that ``page`` shares with the nearest neighbour of its host that is no copy."""
    near = [n for n in neighbours if likeness(page, n) >= 0 and not copies(page, n)]
    return set(shared_lines(page.lines, max(near, key=lambda n: likeness(page, n)).lines)) if near else set()


def extract(page: Page, neighbours: list[Page]) -> str:
    """Every page is differenced; the markup then drops what it marks and puts back an article's shared blocks."""
    shared = template_lines(page, neighbours)
    return "\n\n".join(text for i, (text, dropped, main) in enumerate(page.blocks)
                       if not dropped and main >= page.marked and (main == 2 or i not in shared))


def texts(rows: Iterator[tuple]) -> Iterator[tuple]:
    """(id, url, text, n_chars) from sorted rows (part, context, id, url, host, path, html); context rows are neighbours only.

    Pages of a run of copies wait for the first page after it; equal ones share their blocks meanwhile.
    """
    part = before = first = last = last_src = None
    waiting: list[tuple] = []

    def settled(after: Page | None) -> Iterator[tuple]:
        for page, i, url in waiting:
            yield result(page, i, url, [n for n in (before, after) if n])
        waiting.clear()

    def result(page: Page, i, url, neighbours: list[Page]) -> tuple:
        text = extract(page, neighbours)
        return i, url, text, len(text)

    for of, context, i, url, host, path, src in rows:
        page = Page(host, path, last.blocks if last and src == last_src else blocks(src))
        last_src = src
        if of != part:
            yield from settled(None)
            part, before, first = of, None, page
        elif not copies(page, first):
            yield from settled(page)
            before, first = last, page
        last = page
        if not context:
            waiting.append((page, i, url))
    yield from settled(None)


def _bounds(rows: DataFrame, n: int) -> list[tuple]:
    """At most ``n`` - 1 ascending keys that cut the rows into ranges of about equal size.

    The keys whose hash is among the least, each once: about SAMPLE * n of them, at most four times as many.
    """
    share = SAMPLE * n / max(rows.count(), 1)
    few = rows.select("host", "path", "id")
    few = few.where(F.xxhash64("host", "path", "id") < int(min(share, 1.0) * 2 ** 64) - 2 ** 63) if share < 1 else few
    few = sorted((tuple(r) for r in few.distinct().limit(4 * SAMPLE * n).collect()),
                 key=lambda k: (k[0], k[1], k[2] is not None, k[2] if k[2] is not None else 0))
    cuts = sorted({len(few) * i // n for i in range(1, n)})
    return [few[i] for i in cuts] if few else []


def _range_of(bounds: list[tuple], fields: list[tuple[str, str]]):
    """Number of bounds that are not above a row's key: first among every so many of them, then among the next ones."""
    kind = f"array<struct<{', '.join(f'{k}: {t}' for k, t in fields)}>>"
    names, step = [k for k, _ in fields], max(1, math.isqrt(len(bounds)))
    literal = lambda some: F.from_json(F.lit(json.dumps([dict(zip(names, b)) for b in some], default=str)), kind)
    passed = lambda some: F.size(F.filter(some, lambda b: b <= F.struct(*names)))
    coarse = passed(literal(bounds[step - 1::step])) * step
    return coarse + passed(F.slice(literal(bounds), coarse + 1, step))


def _edges(keys: DataFrame) -> list[tuple]:
    """(part, key) of the pages that a part lends from others: the nearest before and after it, and the nearest unequal to those."""
    key = F.struct("host", "path", "id", "body")
    ends = keys.groupBy("part").agg(F.min(key).alias("low"), F.max(key).alias("high"))  # a row for each part
    ends = materialize(ends, "page-ends")
    other = keys.join(F.broadcast(ends), "part").groupBy("part").agg(
        F.min(F.when(F.col("body") != F.col("low.body"), key)).alias("low2"), F.max(F.when(F.col("body") != F.col("high.body"), key)).alias("high2"))
    parts = ends.join(other, "part").orderBy("part").collect()
    out = []
    for at, here in enumerate(parts):
        for way, name in ((parts[:at][::-1], "high"), (parts[at + 1:], "low")):
            for there in way:
                out.append((here["part"], there[name]))
                found = there[name + "2"]
                if there[name]["body"] == way[0][name]["body"] and found is None:
                    continue  # a part of equal pages only: on to the next
                if found is not None and there[name]["body"] == way[0][name]["body"]:
                    out.append((here["part"], found))
                break
    return out


def dealt(rows: DataFrame, n: int) -> DataFrame:
    """``rows`` with part (a range of the key) and context: every row in its part, and the edges of others that each part lends."""
    id_type = dict(rows.dtypes)["id"]
    key = [("host", "string"), ("path", "string"), ("id", id_type)]
    body = F.xxhash64("html")
    part = _range_of(_bounds(rows, n), key).alias("part")
    lent = _edges(materialize(rows.select("host", "path", "id", body.alias("body"), part), "page-keys"))
    own = rows.select(part, F.lit(False).alias("context"), *rows.columns)
    if not lent:
        return own
    lent = rows.sparkSession.createDataFrame([(p, *k) for p, k in lent], "_part int, " + ", ".join(f"_{k} {t}" for k, t in [*key, ("body", "long")]))
    # at most four rows for each part and way
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k, _ in key]
    edges = rows.join(F.broadcast(lent), [*same, body == F.col("_body")])
    edges = edges.dropDuplicates(["_part", "host", "path", "id"])
    return own.unionByName(edges.select(F.col("_part").alias("part"), F.lit(True).alias("context"), *rows.columns))


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text, n_chars) for every row of ``pages``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = None

        def rows() -> Iterator[tuple]:
            nonlocal kinds
            for b in batches:
                kinds = [b.schema.field(2).type, pa.string(), pa.string(), pa.int64()]
                yield from zip(*(b.column(k).to_pylist() for k in range(7)))

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["id", "url", "text", "n_chars"])

        out = []
        for row in texts(rows()):
            out.append(row)
            if len(out) == 1000:
                yield batch(out)
                out = []
        if out:
            yield batch(out)

    row_batches(pages.sparkSession)
    n = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), host_of(F.col(url_col)).alias("host"),
                        path_of(F.col(url_col)).alias("path"), F.col(html_col).alias("html"))
    rows = dealt(rows, n).repartitionById(n, "part").sortWithinPartitions("part", "host", "path", "id")
    out = rows.select("part", "context", "id", "url", "host", "path", "html").mapInArrow(
        run, f"id {dict(rows.dtypes)['id']}, url string, text string, n_chars long")
    return out.withColumnRenamed("id", id_col).withColumnRenamed("url", url_col)
