import random
from functools import lru_cache

import numpy as np

from millrace.llm import html

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p><article>x</article>";</script></head><body>
<header>Site</header><nav><ul><li><a href="/a">Menu</a></ul></nav><!-- ad --><div class="ad">Buy</div><div class="cookie-notice">We use</div>
<article><h1>A &amp; B</h1><p><b>Bold text<br>next<p>Second  line
goes on.</p><p>Fish<i>es</i> &lt;3 &eacute;</p><aside>side</aside><form>f</form><div id="comments"><p>reader</p></div></article>
<footer>&copy; site</footer>"""
TEXT = "A & B Bold text next Second line goes on. Fishes <3 é"


def found(page):
    return [(t, v) for t, v in html.lines(page) if v != html.FRAMED]


def test_lines():
    assert [t for t, _ in found(PAGE)] == ["A & B", "Bold text next", "Second line goes on.", "Fishes <3 é"]
    assert [t for t, v in html.lines(PAGE) if v == html.FRAMED] == ["Site", "Menu", "Buy", "We use", "side", "f", "reader", "© site"]
    assert html.lines("") == [] and html.lines("plain &amp; text") == [("plain & text", html.OPEN)]
    assert [t for t, _ in html.lines("<article>one<div>two</div>three <a href='x>y'>link</a>, end</article>tail")] == ["one", "two", "three link, end", "tail"]
    assert [t for t, _ in html.lines("<p>a<p>b<ul><li>c<li>d</ul><table><tr><td>e<td>f</table>")] == list("abcdef")
    assert html.lines("<script>x") == [] and html.lines("<article><p>open") == [("open", html.ARTICLE)]
    assert html.lines("<p>" * 30_000 + "deep" + "</div>" * 10) == [("deep", html.OPEN)]


def text(page):
    return " ".join(t for t, _ in found(page))


def test_frames_that_hold_the_text_are_none():
    assert text('<div class="content-sidebar-wrap"><nav>menu</nav><main><p>The text</p></main><aside>side</aside></div>') == "The text"
    assert text('<div class="layout-with-sidebar"><article>The text</article></div>') == text('<div class="has-sidebar"><p>The text</p></div>') == "The text"
    assert text('<form id="aspnetForm"><ul class="menu"><li>menu</ul><article>The whole text</article></form>') == "The whole text"
    assert text('<div class="ad-free"><p>The text</p></div>') == text('<div class="share-price-article"><p>The text</p></div>') == "The text"
    assert text('<article><div class="legal-notice"><p>The text</p></div></article>') == "The text"
    assert text("<div class='search'><p>The results, which are all that this page has</p></div><p>tail</p>") == "The results, which are all that this page has tail"


def test_frames_stay_frames():
    assert text('<article><p>Short</p><div id="comments"><p>a much longer comment</p></div></article>') == "Short"
    assert text('<article><p>The longer text</p><div class="cookie-notice">cookies</div><div class="share-buttons">share</div></article>') == "The longer text"
    assert text('<div class="sidebar-wrapper"><article>a card that is longer than the text</article></div><article>Text</article>') == "Text"
    assert text('<div class="ad ad-300x250">an advert that is longer than the text</div><article>Text</article>') == "Text"
    assert text('<form>a form that is longer than the text<input></form><main>Text</main>') == "Text"
    assert text("<nav>a menu that is longer than the text</nav><p>Text</p>") == "Text"
    assert text('<aside><article>a card</article></aside><div class="main-nav">menu</div><div id="footer-widgets">f</div><p>The text of it</p>') == "The text of it"


def test_formulas_are_text():
    assert text("<article><p>E = <math><mi>m</mi><mo>&middot;</mo><msup><mi>c</mi><mn>2</mn></msup><annotation encoding='x'>mc^2</annotation></math> ok</p></article>") == "E = m·c2 ok"


def test_shared_is_a_longest_common_subsequence(monkeypatch):
    r = random.Random(1)
    for cells in (html.CELLS, 6):
        monkeypatch.setattr(html, "CELLS", cells)
        for _ in range(200):
            a, b = ([r.randrange(4) for _ in range(r.randrange(12))] for _ in range(2))

            @lru_cache(None)
            def size(i, j):
                return 0 if not i or not j else max(size(i - 1, j), size(i, j - 1), size(i - 1, j - 1) + (a[i - 1] == b[j - 1]))

            got = html.shared(np.array(a, np.int64), np.array(b, np.int64))
            assert len(got) == size(len(a), len(b)) and got == sorted(set(got))
            rest = iter(b)
            assert all(a[i] in rest for i in got)


def test_very_long_pages_align_in_linear_memory():
    r = random.Random(2)
    a, b = (np.array([r.randrange(10**6) for _ in range(6_000)], np.int64) for _ in range(2))
    a[1::3] = b[1::3]
    assert len(html.shared(a, b)) >= 2_000


def plain(rows):
    """(page_id, text, n_shared) of every (page_id, url, html): each page against all others of its host."""
    pages = []
    for i, url, page in rows:
        rest = (url or "").partition("://")[2] or url or ""
        host, slash, path = rest.partition("/")
        pages.append((i, host.lower(), (slash + path).split("?")[0].split("#")[0], html.lines(page or "")))
    least = {}
    for _, host, path, ls in pages:
        key = (host, tuple(t for t, _ in ls))
        if ls:
            least[key] = min(path, least.get(key, path))
    out = []
    for i, host, path, ls in pages:
        key, gone = (host, tuple(t for t, _ in ls)), set()
        others = [(p, k[1]) for k, p in least.items() if k[0] == host and k != key]
        if ls and others:
            mine = least[key]
            near = max(others, key=lambda o: html.common_prefix(mine, o[0]))[1]
            x = [t for t, _ in ls]

            @lru_cache(None)
            def best(a, b):
                if a == len(x) or b == len(near):
                    return ()
                options = [best(a + 1, b), best(a, b + 1)] + [(a, *best(a + 1, b + 1))] * (x[a] == near[b])
                return max(options, key=len)

            gone = set(best(0, 0))
        gone -= {j for j in gone if ls[j][1] == html.ARTICLE}
        out.append((i, " ".join(t for j, (t, v) in enumerate(ls) if v != html.FRAMED and j not in gone), len(gone)))
    return sorted(out, key=str)


def site():
    """Pages of hosts with a frame each, marked or not, around articles that are marked or not; every path has one nearest other."""
    r = random.Random(5)
    rows = []
    for h in range(4):
        menu = "".join(f"<li>menu {h} {i}</li>" for i in range(3))
        for k in range(12):
            # two pages share the longest path, and no third comes as near
            path = f"/{'abcdef'[k // 2] * (1 + k // 2)}/story-{k // 2}-{'xy'[k % 2]}"
            frame = [f"<nav>{menu}</nav>", f"<ul>{menu}</ul>"][(h + k) % 2]
            body = "".join(f"<p>words {h} {k} {i} {r.random()}</p>" for i in range(5)) + f"<p>passage {h} {k // 2}</p>"
            body = [f"<article>{body}</article>", f"<div>{body}</div>", f"<div>{body}</div><article>card {k}</article>"][k % 3]
            page = f"<html><body>{frame}<div class='ad'>advert {k}</div>{body}<div>bottom of {h}</div><footer>own {k}</footer></body>"
            rows.append((100 * h + k, f"http://Host{h}/{path[1:]}?v=1", page))
            if k % 4 == 0:
                rows.append((1000 + 100 * h + k, f"https://host{h}{path}?v=2", page))
    return rows


def test_against_plain_version(spark):
    rows = site() + [(7000, "https://alone/x", PAGE), (7001, None, None), (7002, "http://alone2/", "<p>only"), (None, "https://nowhere/y", PAGE), (7, "http://host0/none", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS sign", "2 AS host", "3 AS texts", "4 AS shared")
    got = sorted(((r.page_id, r.text, r.n_shared) for r in html.main_text(pages).collect()), key=str)
    assert got == plain(rows) and sum(n > 0 for _, _, n in got) > 40
    # a card doesn't delete a page's body, and a shared frame without marks goes, which without differencing it wouldn't
    texts = {i: t for i, t, _ in got}
    assert texts[2].startswith("words 0 2 0") and texts[2].endswith("card 2") and "menu" not in " ".join(texts.values())
    assert sum(texts[i] != text(page) for i, _, page in rows if i in texts and page) > 40


def test_pages_over_several_runs(spark, monkeypatch):
    monkeypatch.setattr(html, "RUN", 4)
    page = lambda i: f"<div><p>Home of all</p><p>Unique {i} text</p><p>Bottom line</p></div>"
    rows = [(i, f"http://h{i % 2}/news/{i:03d}?q={i}", page(i)) for i in range(40)] + [(100, "https://alone/x", page(100)), (101, None, None), (None, "http://h0/other", PAGE), (7, "http://h1/news/007?q=7", page(7))]
    got = html.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    text = {r.page_id: (r.text, r.n_shared) for r in got}
    assert len(got) == len(rows) and all(text[i] == (f"Unique {i} text", 2) for i in range(40))
    assert text[100] == ("Home of all Unique 100 text Bottom line", 0) and text[101] == ("", 0) and text[None] == (TEXT, 0)
    assert all(r.n_chars == len(r.text) for r in got)


def test_copies_and_empty(spark):
    pages = spark.createDataFrame([(1, "u", PAGE), (1, "u", PAGE), (2, "u", "")], "page_id long, url string, html string")
    assert [(r.n_chars, r.n_shared) for r in html.main_text(pages).orderBy("page_id").collect()] == [(53, 0), (53, 0), (0, 0)]
    assert html.main_text(pages.limit(0)).count() == 0
