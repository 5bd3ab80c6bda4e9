import time
from collections import defaultdict

import pytest

from leafclock.llm import html_extract


def text(source):
    return html_extract.Page(source).text(frozenset())


@pytest.mark.parametrize("source,want", [
    ("", ""),
    ("plain &amp; simple\n\n text", "plain & simple text"),
    ("<article><h1>T</h1><p>a <b>b</b>c</p><p>d&nbsp; e</p></article>", "T\na bc\nd e"),
    ("<nav>menu</nav><article><p>one<p>two<br>three</article><footer>f", "one\ntwo three"),
    ("<article><p><b>open<br></article><footer>&copy; x</footer>", "open"),
    ("<script>var t='</p>'; if (a<b) {}</script><p>kept</p><style>p{}</style>", "kept"),
    ("<script>never closed <p>x</p>", ""),
    ("<p>a<!-- no --- <p>x</p> -->b</p>", "ab"),
    ("<div class='ad'>buy</div><div>body</div><div id=cookie-notice>ok?</div>", "body"),
    ("<main><p>x</p><section class='comments'><p>first!</p></section><form><p>mail</p></form></main>", "x"),
    ("<article><header><h1>Head</h1></header><p>x</p><aside>s</aside></article><header>site</header>", "Head\nx"),
    ("<ul><li>a<li>b</ul><table><tr><td>c<td>d</table>", "a\nb\nc\nd"),
    ("<p title='a > b'>q</p>", "q"),
    ("<p title='open>q</p>", "q"),
    ("1 < 2 &lt;b&gt; &#233; &#x1F600; &unknown; &", "1 < 2 <b> é 😀 &unknown; &"),
    ("<div role=navigation>n</div><div hidden>h</div><p>x</p>", "x"),
    ("</div></p>stray<b>x", "strayx"),
    ("<article class='ad share'>stays</article>", "stays"),
    ("<article><p>Main text.</p><article class=comment><p>First!</p></article></article>", "Main text."),
    ("<article><p class='share'>Shares fell.</p><p class=ad>Buy</p></article>", "Shares fell."),
    ("<dd>a<ul><i><dt>b</dt><dt>c", "a\nb\nc"),
    ("<P>UP</P><ArTiClE>in</aRtIcLe>", "in"),
])
def test_single_pages(source, want):
    assert text(source) == want


def test_very_long_and_deep():
    assert len(text("<p>" + "word " * 100_000)) == 499_999
    assert text("<div>" * 3_000 + "x") == "x"
    assert text("<" * 20_000 + "a") == "<" * 19_999  # a tag that the end cuts off
    assert text('<a "' * 2_000) is not None


@pytest.fixture(scope="module")
def pages(spark):
    rows = []
    for i in range(40):
        body = f"<div><p>story {i} here</p></div>"
        if i % 4 == 0:
            body += "<div><p>shared quote</p></div>"
        rows.append((i, f"http://Big.example/{i}", f"<body><div><p>Site slogan</p></div>{body}<div>Call us</div></body>", "t", 1))
    rows += [(100 + i, f"http://small.example/{i}", "<div><p>Site slogan</p></div>", "t", 1) for i in range(3)]
    rows += [(200, None, "<p>x</p>", "t", 1), (201, "http://Big.example/x", None, "t", 1), (202, "", "", "t", 1),
             (None, "http://Big.example/y", "<article><div><p>Site slogan</p></div></article>", "t", 1)]
    return spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int")


def test_templates_of_a_host_go(pages):
    got = {r.page_id: r for r in html_extract.extract(pages).collect()}
    assert len(got) == pages.count()
    for i in range(40):
        assert got[i].text == f"story {i} here" + ("\nshared quote" if i % 4 == 0 else "")
    assert got[100].text == "Site slogan"  # too few pages to tell
    assert (got[200].text, got[201].text, got[202].text) == ("x", "", "")
    assert all(r.n_chars == len(r.text) for r in got.values())
    assert got[None].url == "http://Big.example/y"


def test_prose_in_an_article_is_never_a_template(spark):
    """Where it is more than the rest of the article; shorter notices go, see ``test_counts_alone_remove_templates``."""
    rows = [(i, f"http://h.example/{i}", f"<article><p>All rights reserved.</p><div>Follow us</div><p>text {i}</p></article>") for i in range(30)]
    got = html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r.text for r in got} == {f"All rights reserved.\ntext {i}" for i in range(30)}


def test_templates_of_small_hosts_and_of_a_section(spark):
    rows = [(i, f"http://small.example/{i}", f"<div>Our shop</div><div>text {i}</div>") for i in range(5)]
    for i in range(300):  # a side column on a quarter of the pages of a host
        side = "<div>Andere Seiten</div>" if i % 4 == 0 else ""
        quote = "<div>a quote</div>" if i % 4 == 1 else ""
        rows.append((1000 + i, f"http://big.example/{i}", f"<div>text {i}</div>{side}<article><p>own {i}</p>{quote}</article>" if i % 4 == 1
                     else f"<div>text {i}</div>{side}"))
    got = {r.page_id: r.text for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert [got[i] for i in range(5)] == [f"text {i}" for i in range(5)]
    for i in range(300):
        assert got[1000 + i] == (f"own {i}\na quote" if i % 4 == 1 else f"text {i}")


def test_unmatched_end_tags_take_linear_time():
    n = 1_000_000 // 12
    start = time.perf_counter()
    assert text("<div>" * n + "</span>" * n + "x") == "x"
    assert text("<dd><ul>" + "<i>" * n + "<dt></dt>" * n + "x") == "x"
    assert time.perf_counter() - start < 20


def test_counts_alone_remove_templates(spark):
    """No listed tag, class or role: menus, footers and notices go, in articles too; a quote stays."""
    rows = []
    for i in range(40):
        quote = "<p>To be or not to be, that is the question.</p>" if i % 3 else ""
        rows.append((i, f"http://h.example/{i}", f"<div><div  class='x'  id=y>Home Shop</div><article><p>Own story of page {i}, told at some length.</p>"
                     f"{quote}<p>All  rights reserved.</p></article><div>Imprint</div></div>"))
        rows.append((100 + i, f"http://k.example/{i}", f"<div><div id=y class='x'>Home</div><div>Story {i}</div><div>Imprint</div></div>"))
    docs = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html_extract.extract(docs).collect()}
    for i in range(40):
        quote = "To be or not to be, that is the question.\n" if i % 3 else ""
        assert got[i] == f"Own story of page {i}, told at some length.\n{quote}".strip()
        assert got[100 + i] == f"Story {i}"


def test_copies_of_a_page_are_no_template(spark):
    story = "<div><p>One story.</p></div>"
    rows = [(i, f"http://h.example/{i}", story) for i in range(80)]
    rows += [(100 + i, f"http://n.example/{i}", f"<article><p>A long story, told at length.</p><p>And its end.</p><p>{i}</p></article>") for i in range(80)]
    got = {r.page_id: r.text for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i] == "One story." for i in range(80))
    assert all(got[100 + i] == f"A long story, told at length.\nAnd its end.\n{i}" for i in range(80))


def test_templates_equal_a_recount(spark, pages):
    rows = pages.selectExpr("lower(regexp_extract(url, '://([^/]*)', 1)) host", "html")
    seen, size = defaultdict(set), defaultdict(set)
    outside = defaultdict(set)
    for r in rows.where("host <> ''").collect():
        page = html_extract.Page(r.html or "")
        _, inside = page.states()
        size[r.host].add(page.digests()[0])
        for i, h, whole in page.subtrees(inside):
            seen[r.host, h, inside[i] and page.elements[i][0] in html_extract.PROSE].add(whole)
            if not inside[i]:
                outside[r.host, h].add(whole)
    want = {(host, h) for (host, h, prose), x in seen.items()
            if len(x) >= 4 and len(x) >= (0.8 if prose else 0.3) * len(size[host]) or len(outside[host, h]) >= 50}
    got = {tuple(r) for r in html_extract.templates(rows).collect()}
    assert got == want and got


def test_no_pages(pages):
    assert html_extract.extract(pages.limit(0)).count() == 0
