import html
import random
import re

from pyspark.sql import functions as F

from meadowlark.llm import html_template as H


def _text(page, fixed=frozenset()):
    return H.main_text(page, set(fixed))


def test_articles_of_the_test_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    found = {r["page_id"]: r for r in H.extract(pages.withColumn("text", F.lit("mine"))).collect()}
    for p in pages.collect():
        inner = re.search(r"<article>(.*?)</article>", p["html"], re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"</?b>", "", b)).split()) for b in re.split(r"</?(?:p|h1|br|li|div|ul)>", inner)]
        expected = "\n".join(b for b in blocks if b)
        assert found[p["page_id"]]["text"] == expected and found[p["page_id"]]["n_chars"] == len(expected)


def test_markup():
    assert _text("<article><p>a <b>b</b>\n c &amp; &#233;&nbsp;d<p>e<br>f</article><footer>x</footer>") == "a b c & é d\ne\nf"
    assert _text("<main><!-- no --><script>if (a < b) '</p>'</script><style>p{}</style><h2>T</h2>x<form>y</form><div class='comments'>z</div></main>") == "T\nx"
    assert _text("plain words") == "plain words" and _text(None) == "" and _text("<p") == "<p" and _text("1 < 2 <b>and</b> 3") == "1 < 2 and 3"
    assert _text('<body><div id="cookie-notice">c</div><aside>s</aside><nav>n</nav><header>h</header><ul class=menu><li>m</ul><p>kept</p></body>') == "kept"
    assert _text("<article><ul><li>one<li>two</ul><table><tr><td>x<td>y</table>tail") == "one\ntwo\nx\ny\ntail"
    assert _text("<P CLASS=x>Upper</P><!doctype html>") == "Upper" and _text("<p>a<!-- open") == "a"


def test_marks_in_and_around_articles():
    assert _text('<main><p>a</p><article class="comment"><p>c</p></article><div class="comment-list">d</div></main>') == "a"
    assert _text('<article><h2 id="related-work">Related work</h2><div class="search-results">found</div><div class="related-posts">more</div></article>') == "Related work\nfound"
    assert _text('<body><div class="alert">x</div><div class="gdpr">y</div><div class="adbox">z</div><ul class="commentlist"><li>c</ul><p>kept</p></body>') == "kept"
    assert _text('<article><p title="x>text</p></article>') == "text"


def test_marks_on_wrappers_count_for_nothing():
    """A class word on what holds the article, or nearly all text, is no reason to lose it; boilerplate inside still goes."""
    article = "<article><h1>Title</h1><p>The story itself.</p></article>"
    for opening, closing in (
        ('<div class="wrapper has-sidebar">', "</div>"), ('<div class="ad-free page">', "</div>"), ('<div id="page" class="menu-open">', "</div>"), ('<form id="aspnetForm">', "</form>"),
        ('<div class="popup-site"><div class="menu-left"><form>', "</form></div></div>"),
    ):
        inside = '<div class="related-posts"><article>teaser</article></div><div class="ad">Buy this now, it is cheap and it is very good for all of you</div>'
        page = f"<body>{opening}<nav>menu</nav>{article}{inside}{closing}<footer>end</footer></body>"
        assert _text(page) == "Title\nThe story itself.", opening
    assert _text('<body><nav>a long menu of many words in a row</nav><article class="newsletter"><p>One story.</p></article></body>') == "One story."
    assert _text('<body><h1>T</h1><div class="hero-banner"><p>One story that goes on.</p></div></body>') == "T\nOne story that goes on."
    assert _text('<body><div class="content search-page"><p>One story.</p><form>find <button>go</button></form></div></body>') == "One story."


def test_marks_stand_beside_a_free_article():
    """An article that is shorter than the advert beside it, or empty, doesn't void the advert's mark."""
    advert = '<div class="ad">Buy this now, it is cheap and it is very good</div>'
    assert _text(f"<body>{advert}<article><p>Hi</p></article></body>") == "Hi"
    assert _text(f"<body>{advert}<article></article></body>") == ""
    assert _text(f"<body>{advert}<p>Some words that are as long as that advert is</p></body>") == "Some words that are as long as that advert is"
    for comments in ('<div class="user-remarks"><p>so true</p></div>', '<section class="discussion"><p>so true</p></section>', '<div class="billboard">so true</div>'):
        assert _text(f"<body><article><p>Hi</p></article>{comments}</body>") == "Hi"
    comments = '<ol class="commentlist"><li><article class="comment">first of all</article><li><article class="comment">and second</article></ol>'
    assert _text(f"<body><div class=content><p>A story that is longer than its comments.</p></div>{comments}</body>") == "A story that is longer than its comments."
    assert _text('<article><p>Methods</p><section class="discussion"><p>We found it.</p></section></article>') == "Methods\nWe found it."


def test_templates_equal_brute_force(spark):
    """Occurrence vectors in plain Python, as tuples of counts over a host's distinct pages."""
    r = random.Random(6)
    rows = []
    for host in "abc":
        fixed = [f"fixed {host} {k}" for k in range(r.randint(1, 5))]
        for k in range(r.randint(2, 9)):
            body = "".join(f"<div class=t{i}><p>{t}</p></div>" for i, t in enumerate(fixed) if r.random() < 0.9)
            own = "".join(f"<p>{r.choice('uvwxyz')} {r.randint(0, 6)}</p>" for _ in range(r.randint(0, 5)))
            rows += [(len(rows), f"http://{host}/{k}", f"<html><body>{body}<div class=s>{own}</div></body></html>")] * r.choice([1, 1, 2])
    expected = {}
    for host in "abc":
        pages = {}
        for _, url, page in rows:
            if H.host_of(url) == host:
                elements, blocks = H.parse(page)
                pages["\n".join(b.text for b in blocks)] = [(e, up, False) for e, up in elements] + [(H.text_token(b), b.path, True) for b in blocks]
        vectors = {t: tuple(p.count(t) for p in pages.values()) for t in {t for p in pages.values() for t in p}}
        seen = {t: sum(map(bool, v)) for t, v in vectors.items()}
        frequent = lambda n: n >= H.LEAST_PAGES and n >= H.FREQUENT * max(seen.values())  # noqa: B023, E731
        large = [v for v in vectors.values() if list(vectors.values()).count(v) >= H.LARGE]
        around = {t[0] for t in vectors if not t[2] and frequent(seen[t])}
        expected[host] = {t[0] for t, v in vectors.items() if t[2] and v in large and frequent(seen[t]) and t[1] in around}
    found = H.templates(spark.createDataFrame(rows, "page_id long, url string, html string").select("url", "html")).collect()
    assert {f["host"]: {v & 0xFFFFFFFFFFFFFFFF for v in f["fixed"]} for f in found} == {h: v for h, v in expected.items() if v}
    assert any(expected.values())


def _page(k):
    return f"<html><body><div class=top><p>Welcome to the site</p></div><div class=story><p>story {k} with words</p><p>more {k}</p></div><div class=end><p>All our terms</p></div></body></html>"


def test_template_of_a_host(spark):
    rows = [(k, f"http://h.example/{k}", _page(k)) for k in range(6)] + [(90, "http://h.example/x", None), (91, None, "<p>no host</p>"), (92, "http://one.example/", _page(7))]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    found = {r["page_id"]: r["text"] for r in H.extract(pages).collect()}
    assert all(found[k] == f"story {k} with words\nmore {k}" for k in range(6))
    assert found[90] == "" and found[91] == "no host"
    assert found[92] == "Welcome to the site\nstory 7 with words\nmore 7\nAll our terms"  # one page makes no template


def _texts(spark, htmls):
    pages = spark.createDataFrame([(k, f"http://h.example/{k}", h) for k, h in enumerate(htmls)], "page_id long, url string, html string")
    return {r["page_id"]: r["text"] for r in H.extract(pages).collect()}


def test_the_template_decides_about_articles(spark):
    page = "<html><body><div class=top>Welcome</div><article><h2>Teaser {0}</h2><p>teaser of story number {0}</p><p>Share it</p></article><div class=story>long body {0}</div></body></html>"
    found = _texts(spark, [page.format(k) for k in range(5)])
    assert all(found[k] == f"Teaser {k}\nteaser of story number {k}\nlong body {k}" for k in range(5))


def test_near_copies_keep_their_articles(spark):
    page = "<html><body><article><p>The same long story on many pages</p><p>another part of that story</p><p>seen {0}</p></article></body></html>"
    found = _texts(spark, [page.format(k) for k in range(5)])
    assert all(found[k] == f"The same long story on many pages\nanother part of that story\nseen {k}" for k in range(5))


def test_copies_are_no_template(spark):
    page = "<html><body><div class=content>{0}<br>{0} B</div><footer>{1}</footer></body></html>"
    found = _texts(spark, [page.format("A", 1), page.format("A", 2), page.format("A", 2), page.format("other", 3)])
    assert [found[k] for k in range(4)] == ["A\nA B"] * 3 + ["other\nother B"]


def test_broadcast_and_join_agree(spark, monkeypatch):
    pages = spark.createDataFrame([(k, f"http://h.example/{k}", _page(k)) for k in range(5)] * 2, "page_id long, url string, html string")
    one = sorted(map(tuple, H.extract(pages).collect()))
    monkeypatch.setattr(H, "BROADCAST_BLOCKS", -1)
    assert sorted(map(tuple, H.extract(pages).collect())) == one and len(one) == 10


def test_hosts():
    assert [H.host_of(u) for u in ("https://A.example:80/x", "//u@b.c/x", "nothing", None, "http://h.example#t")] == ["a.example", "b.c", "", "", "h.example"]


def test_empty_table(spark):
    assert H.extract(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []
