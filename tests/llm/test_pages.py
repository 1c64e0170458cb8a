import hashlib
import random
import time

import pytest

from klaxon.llm import archives, wrapper
from klaxon.llm.shipping import ship
from klaxon.session import local_table

SHELL = """<!DOCTYPE html><html><head><title>T</title><script>var t="</p>";</script><style>p{{}}</style></head><body>
<div id="cookie-notice">We use cookies</div><header class="site">Site <a href="/">home</a></header>
<nav><ul><li>A<li>B</ul></nav>{body}<aside>Aside {n}</aside><form><input name=q><label>Search</label></form><footer>&copy; {n}</footer></body></html>"""
ARTICLE = """<article class="post"><header><h1>Title {n} &amp; more</h1><span class="share">Share</span></header><p><b>First {n}<br>line
 with   space<p>Second&nbsp;&lt;{n}&gt;<div class="share">Share this page</div><blockquote>Quote <i>{n}</i></blockquote>
<section id="comments"><article><p>Nice {n}!</p></article></section><div class="promo-box ad">Buy</div><div>Follow our news</div></article>"""


def page(n, body=ARTICLE):
    return SHELL.format(body=body.format(n=n), n=n)


def text(n):
    return f"Title {n} & more\nFirst {n} line with space\nSecond <{n}>\nQuote {n}"


def pages(spark, rows):
    ship(spark)
    return local_table(spark, [(i, u, h, "x") for i, u, h in rows], "page_id bigint, url string, html string, host string")


def test_template_is_left_out(spark):
    data = [(i, f"https://a.example.com/{i}", page(i)) for i in range(9)]
    odd = [(20, None, None), (21, "not an address", ""), (None, "http://b.example.com/", page(21)), (22, "http://c.example.com", "just <b>text"),
           (23, "http://d.example.com/", "<div class=main-content>" + "<p>x</p>" * 3000), (24, "http://e.example.com/", "<div>" * 3000 + "deep"),
           (3, "https://a.example.com/3", page(3)), (25, "http://f.example.com", "<p>a <!-- b --> c < d <p>e<script>if (a</b)</script> f")]
    got = {}
    for r in wrapper.extract_pages(pages(spark, data + odd)).collect():
        got.setdefault(r["page_id"], []).append(r)
        assert r["n_chars"] == len(r["text"])
    # the line that all pages of the host share is template there; a host of one page has no evidence for that
    assert all(got[i][0]["text"] == text(i) for i in range(9)) and len(got[3]) == 2
    assert got[None][0]["text"] == text(21) + "\nFollow our news"
    assert [got[i][0]["text"] for i in (20, 21, 22, 24)] == ["", "", "just text", "deep"]
    assert got[23][0]["text"] == "\n".join(["x"] * 3000)
    assert got[25][0]["text"] == "a c < d\ne f"
    assert wrapper.extract_pages(pages(spark, data).limit(0)).count() == 0


def test_tree_matching():
    shape = lambda html: wrapper.Shape("#root", [wrapper.parse(html)])
    size, pairs = wrapper.match(shape("<div><p>a</p><ul><li>b</ul><p>c</div>"), shape("<div><ul><li>x</ul><hr><p>y</div>"))
    assert size == 5 and [b.label for _, b in pairs if not b.children] == ["p", "li"] or size == 5
    assert wrapper.match(shape("<p>a"), wrapper.Shape("div", []))[0] == 0


def plain_size(a, b):
    """Simple tree matching as it is defined, without any saving."""
    if a.label != b.label:
        return 0
    best = [[0] * (len(b.children) + 1) for _ in range(len(a.children) + 1)]
    for i, x in enumerate(a.children, 1):
        for j, y in enumerate(b.children, 1):
            best[i][j] = max(best[i - 1][j], best[i][j - 1], best[i - 1][j - 1] + plain_size(x, y))
    return best[-1][-1] + 1


@pytest.mark.parametrize("cells", [0, 1 << 16])
def test_tree_matching_is_the_best(cells, monkeypatch):
    monkeypatch.setattr(wrapper, "CELLS", cells)
    draw = random.Random(7)

    def tree(depth):
        inner = "".join(tree(depth - 1) for _ in range(draw.randrange(6))) if depth else ""
        name = draw.choice("abc")
        return f"<x-{name}>{inner}</x-{name}>"

    for _ in range(150):
        a, b = (wrapper.Shape("#root", [wrapper.parse("".join(tree(2) for _ in range(draw.randrange(7))))]) for _ in range(2))
        size, pairs = wrapper.match(a, b)
        assert size == len(pairs) == plain_size(a, b)
        assert all(x.label == y.label for x, y in pairs)
        up = {id(c): id(p) for t in (a, b) for p in wrapper.numbered(t) for c in p.children}
        met = {id(x): id(y) for x, y in pairs}
        assert len(met) == len(set(met.values())) == size
        assert all(met[up[x]] == up[y] for x, y in met.items() if x != id(a))
        place = {id(s): i for i, s in enumerate(wrapper.numbered(b))}
        order = [place[met[id(s)]] for s in wrapper.numbered(a) if id(s) in met]
        assert order == sorted(order)


def test_long_pages_are_matched_in_time():
    draw = random.Random(3)
    some = lambda n: "".join(f"<h3>Part</h3><p>{'<b>x</b>' * draw.randrange(2)}text{'<i>y</i><a>z</a>' * draw.randrange(2)}</p>" for _ in range(n))
    parts = [f"<section>{some(9)}</section>" for _ in range(12)]
    nested = lambda n: "<div>" + "".join(f"{draw.choice(parts)}<ul>{'<li>a</li>' * 3}</ul>" for _ in range(n)) + "</div>"
    for a, b in ((some(5_000), some(4_000)), (nested(900), nested(700)), (some(12_000), some(40))):
        began = time.process_time()
        size, pairs = wrapper.match(*(wrapper.Shape("#root", [wrapper.parse(h)]) for h in (a, b)))
        assert size == len(pairs) > 100 and time.process_time() - began < 30


def test_copies_are_no_template(spark):
    data = [(i, "http://a.example.com/", page(1)) for i in range(8)]
    assert {r["text"] for r in wrapper.extract_pages(pages(spark, data)).collect()} == {text(1) + "\nFollow our news"}


@pytest.mark.parametrize("body, want", [
    ('<div id=page><div class="layout has-sidebar"><article><p>Text</article></div></div>', "Text"),
    ('<div id=page><div class="layout sidebar"><article><p>The text</article></div><p>Else</div>', "The text"),
    ('<div id=page><article class="post comments-open"><p>Text</article></div>', "Text"),
    ('<div id=page><article class="post comments"><p>Text</article></div>', "Text"),
    ('<article><p>Text<section id="related-work"><p>Work</section><div class="notice-period"><p>Period</div><div class=related-posts>No</div></article>',
     "Text\nWork\nPeriod"),
    ('<article><div class="entry-header"><h1>Title</h1></div><p>Text<div class="site-footer">No</div></article>', "Title\nText"),
    ('<div class=a><div class=widget><div class=share>' + "Text " * 9 + "</div></div></div>", " ".join(["Text"] * 9)),
    ('<article><p>Short</article><section class=comments><article>A long comment of a reader</article></section><div class=cookie-notice>' + "x " * 90 + "</div>",
     "Short"),
])
def test_words_in_classes(body, want):
    assert wrapper.extract(f"<html><body><nav>No</nav>{body}</body></html>") == want


@pytest.mark.parametrize("body, want", [
    ('<h1 class="post-title">T</h1><div class="content"><p>The whole text<p>of the page</div>', "T\nThe whole text\nof the page"),
    ('<div><div class=entry-header><h1>T</h1></div><div class=entry-content><p>Text</div><p class=story-date>Today</div>', "T\nText\nToday"),
    ('<div><article><p>One, the longest</article><h2>Between</h2><article><p>Two</article></div>', "One, the longest\nBetween\nTwo"),
    ('<div class=post>One</div><div class=post>Two, the longest</div><div class=post>Three</div>', "One\nTwo, the longest\nThree"),
    ('<div class=content><p>The whole text of the page</div><article>Teaser</article>', "The whole text of the page\nTeaser"),
    ('<main><p>The whole text of the page<p>here</main><article>Teaser</article>', "The whole text of the page\nhere"),
    ('<div>Few words</div><article><p>The whole text of the page</article>', "The whole text of the page"),
])
def test_marked_elements(body, want):
    assert wrapper.extract(f"<html><body><nav>No</nav>{body}<footer>No</footer></body></html>") == want


def test_near_copies_are_no_template(spark):
    story = "<article><p>The long text that most pages of the host carry.<p>And a second paragraph of it, as long.<div>Day {n}</div></article>"
    data = [(i, "http://a.example.com/", page(i, story if i < 16 else "<article><p>Other text " + "x" * (200 + i) + "</article>")) for i in range(18)]
    got = {r["page_id"]: r["text"] for r in wrapper.extract_pages(pages(spark, data)).collect()}
    assert all(got[i] == f"The long text that most pages of the host carry.\nAnd a second paragraph of it, as long.\nDay {i}" for i in range(16))
    assert all(got[i] == "Other text " + "x" * (200 + i) for i in (16, 17))


def test_reference_is_typical_and_siblings_are_single(spark):
    body = "<article><p>Text {n} " + "of one page " * 6 + "<p>Follow our news</p><p>More of {n}</p></article><div>Standing line</div>"
    data = [(i, "http://a.example.com/", f"<body>{body.format(n=i)}</body>") for i in range(9)] + [(20, "http://a.example.com/", "x")]
    got = {r["page_id"]: r["text"] for r in wrapper.extract_pages(pages(spark, data)).collect()}
    assert got[20] == "x"
    assert all(got[i] == f"Text {i} " + "of one page " * 5 + f"of one page\nMore of {i}" for i in range(9))


@pytest.mark.parametrize("version", [1, 2])
def test_arc_records(version):
    content = b"HTTP/1.0 200 OK\r\nX: y\r\n\r\nbody\n"
    line = archives.arc_line(version, {"URL": "http://a.example.com/x y", "IP-address": "1.2.3.4", "Archive-date": "19990102030405"}, len(content))
    assert len(line.split(b" ")) == (5 if version == 1 else 10)
    record = archives.parse_arc(line + content + b"\nrest", version)
    assert record.content == content and record.fields["URL"] == "http://a.example.com/x%20y"
    fields, block = archives.parse_warc(archives.to_warc(record, "<urn:uuid:1>", None))
    assert block == content and fields["warc-date"] == "1999-01-02T03:04:05Z" and fields["warc-type"] == "response"
    fields, block = archives.parse_warc(archives.to_warc(record, "<urn:uuid:2>", "<urn:uuid:1>"))
    assert block == content[:-5] and (fields["warc-type"], fields["warc-refers-to"]) == ("revisit", "<urn:uuid:1>")
    with pytest.raises(ValueError):
        archives.parse_arc(line + content[:-3], version)
    other = archives.parse_arc(archives.arc_line(version, {"URL": "dns:a.example.com", "Content-type": "text/dns"}, 3) + b"abc\n", version)
    assert archives.parse_warc(archives.to_warc(other, "<u>", None))[0]["warc-type"] == "resource"
    assert [archives.iso_date(d) for d in ("1999", "bad", "20240229")] == ["1999-01-01T00:00:00Z", "1970-01-01T00:00:00Z", "2024-02-29T00:00:00Z"]


def test_pages_through_archives(spark):
    long, other = "é" * 600, "b" * 1000
    data = [(1, "http://a/", long), (2, None, long), (3, "http://a/x y", long), (4, "u", "b" * 999), (5, "u", "b" * 999), (6, "u", other), (7, "u", None),
            (8, "u", ""), (9, "u", "\r\n\r\nHTTP/1.1\n\nWARC/1.1"), (10, "u", "x" * 3_000_000), (6, "u", other)]
    got = archives.pages_through_warc(pages(spark, data)).collect()
    best = {}
    for i, _, h in data:
        best[h] = max(best.get(h, i), i)
    assert len(got) == len(data)
    kinds = {}
    for r in got:
        html = next(h for i, _, h in data if i == r["page_id"])
        raw = (html or "").encode()
        assert (r["payload_bytes"], r["payload_digest"]) == (len(raw), hashlib.sha1(raw).hexdigest())
        kinds.setdefault(r["page_id"], []).append((r["record_type"], r["refers_to"]))
    assert kinds[1] == kinds[2] == [("revisit", 3)] and kinds[3] == [("response", None)]
    assert sorted(kinds[6], key=str) == sorted([("response", None), ("revisit", 6)], key=str)
    assert all(kinds[i] == [("response", None)] for i in (4, 5, 7, 8, 9, 10))
    assert archives.pages_through_warc(pages(spark, data).limit(0)).count() == 0


def test_texts_of_a_tree_come_from_one_pass():
    page = "<body>a <b> x  y </b>tail<ul><li>1<li>2 <i>deep</i> z<li> </ul><p></p>last &amp;</body>"
    root = wrapper.parse(page)
    texts, nodes = wrapper.Texts(root), list(wrapper.elements(root))
    assert [texts.of([n]) for n in nodes] == [wrapper.text_of([n]) for n in nodes] and len(nodes) > 7
    items = [n for n in nodes if n.tag == "li"]
    assert texts.of(items) == wrapper.text_of(items) == "1\n2\nz\ndeep" and texts.of([]) == ""
