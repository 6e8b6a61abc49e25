import html as markup
import re

from lexhaven.llm import html


def text_of(spark, *pages, host="a.example"):
    rows = [(n, f"http://{host}/{n}", p, "h", "t") for n, p in enumerate(pages)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, host string, template string")
    return [r.text for r in html.main_text(df).orderBy("page_id").collect()]


def test_given_pages(given):
    for r in html.main_text(given("pages")).join(given("pages").select("page_id", "html"), "page_id").collect():
        inner = re.search(r"<article>(.*)</article>", r.html, re.S)[1]
        parts = re.split(r"</?(?:p|h1)>", re.sub(r"</?b>", "", inner.replace("<br>", " ")))
        assert r.text == " ".join(x for x in (" ".join(markup.unescape(p).split()) for p in parts) if x)


def test_markup_that_is_not_text(spark):
    page = """<html><head><title>T</title><style>p{}</style></head><body><header><a>Home</a></header>
    <div role="navigation">menu</div><div class="cookie-notice">We use cookies</div>
    <main><article><h1>A&nbsp;title</h1><p>One <b>bold</b> &amp; two<br>three<script>var x = "<p>no</p>"</script>
    <div class="ad">Buy</div><form><label>Mail</label></form><!-- <p>hidden</p> --><p>Last &lt;p&gt;</article>
    <section id="comments"><article class="comment">Nice</article></section></main>
    <aside>More</aside><footer>&copy; me</footer></body></html>"""
    assert text_of(spark, page) == ["A title One bold & two three Last <p>"]


def test_template_of_a_host_goes_where_nothing_is_marked(spark):
    page = lambda n: f"<div class=top>Welcome to us</div><div class=x><p>Story {n} of many</p></div><div class=end>All rights</div>"
    assert text_of(spark, *[page(n) for n in range(6)]) == [f"Story {n} of many" for n in range(6)]
    # Alone on its host a page has no template.
    assert text_of(spark, page(1)) == ["Welcome to us Story 1 of many All rights"]
    # A marked main part keeps what other pages have too.
    same = "<article><p>Said everywhere</p><p>Also this</p></article>"
    assert text_of(spark, *[same] * 5) == ["Said everywhere Also this"] * 5


def test_equal_occurrence_makes_a_class(spark):
    rows = [(n, "h", [1, 2, 3 if n % 2 else 4, 10 + n], [1, 2, 1, 1]) for n in range(8)]
    pages = spark.createDataFrame(rows, "key long, host string, tokens array<long>, counts array<long>")
    row = html.templates(pages).first()
    # 1 and 2 are on the same pages, but not equally often.
    assert row is None
    pages = spark.createDataFrame([(n, "h", [1, 2, 10 + n], [1, 1, 1]) for n in range(8)], pages.schema)
    assert sorted(html.templates(pages).first().template) == [1, 2]


def test_copies_of_an_unmarked_page_keep_their_text(spark):
    page = lambda n: f"<div class=top>Welcome to us</div><div class=x><p>Story {n} of many</p><p>Its end {n}</p></div><div class=end>All rights</div>"
    # Four copies are most of the host, but one page of four different ones.
    assert text_of(spark, *[page(1)] * 4, page(2), page(3), page(4)) == [f"Story {n} of many Its end {n}" for n in (1, 1, 1, 1, 2, 3, 4)]
    # Copies alone on their host are no template.
    assert text_of(spark, *[page(1)] * 4) == ["Welcome to us Story 1 of many Its end 1 All rights"] * 4
    # Repeated rows of one page, an even number of times.
    df = spark.createDataFrame([(1, "http://a.example/", page(1))] * 4, "page_id long, url string, html string")
    assert [r.text for r in html.main_text(df).collect()] == ["Welcome to us Story 1 of many Its end 1 All rights"] * 4


def test_a_page_that_is_all_template_keeps_its_text(spark):
    page = lambda more: f"<div class=top>Welcome to us</div>{more}<div class=end>All rights</div>"
    pages = [page(f"<p>Story {n}</p>") for n in range(4)]
    assert text_of(spark, *pages, page("")) == [*(f"Story {n}" for n in range(4)), "Welcome to us All rights"]


def test_each_layout_of_a_host_has_a_template(spark):
    page = lambda kind, n: f"<div class={kind}-top>Menu of {kind}</div><div class={kind} id=e{n}><p>Story {n}</p></div><div class={kind}-end>Notes of {kind}</div>"
    # Layouts at a third each, with marked pages as the most of the host.
    pages = [page("abc"[n % 3], n) for n in range(12)] + [f"<article><p>Marked {n}</p></article>" for n in range(20)]
    want = [f"Story {n}" for n in range(12)] + [f"Marked {n}" for n in range(20)]
    assert text_of(spark, *pages) == want
    # Sites whose addresses are missing share a host, not a layout.
    df = spark.createDataFrame([(n, None, p) for n, p in enumerate(pages)], "page_id long, url string, html string")
    assert [r.text for r in html.main_text(df).orderBy("page_id").collect()] == want


def test_edges(spark):
    assert text_of(spark, None, "", "  ", "plain & text", "<p>unclosed <b>here", "<", "a < b", "<p" * 1000, "&am") == [
        "", "", "", "plain & text", "unclosed here", "<", "a < b", "", "&am"]
    long = "<article>" + "<p>word word</p>" * 50_000 + "</article>"
    assert text_of(spark, long, long) == [" ".join(["word word"] * 50_000)] * 2
    assert text_of(spark) == []
    nested = "<div>" * 3000 + "deep" + "</div>" * 3000
    assert text_of(spark, nested) == ["deep"]
    df = spark.createDataFrame([(1, None, "<p>x")] * 2, "page_id long, url string, html string")
    assert [r.text for r in html.main_text(df).collect()] == ["x", "x"]


def located(spark, *pages):
    df = spark.createDataFrame([(n, f"http://a.example/{n}", p) for n, p in enumerate(pages)], "page_id long, url string, html string")
    return [(r.text, r.located) for r in html.main_text(df).orderBy("page_id").collect()]


def test_texts_in_no_order_are_no_template(spark):
    both = "<p>Yes</p><p>No</p>", "<p>No</p><p>Yes</p>"
    page = lambda n: f"<div class=top>Welcome to us</div><div class=x>{both[n % 2]}<p>Story {n}</p></div><div class=end>All rights</div>"
    # Both are on all pages once, so their occurrence vectors are equal.
    assert text_of(spark, *map(page, range(6))) == [f"{('Yes No', 'No Yes')[n % 2]} Story {n}" for n in range(6)]
    # Parts that change places are each in one order, and a template.
    moved = "<div class=a>Our news</div><div class=b>Our shop</div>", "<div class=b>Our shop</div><div class=a>Our news</div>"
    assert text_of(spark, *(f"<div class=top>Welcome</div>{moved[n % 2]}<p>Story {n}</p>" for n in range(6))) == [f"Story {n}" for n in range(6)]


def test_a_text_is_told_apart_by_its_place(spark):
    more = lambda n: "<p>More</p>" * (n % 2)
    page = lambda n: f"<div class=top>Welcome</div><p>More</p><div class=mid>Middle</div><p>Story {n}</p>{more(n)}<div class=end>End</div>"
    assert text_of(spark, *map(page, range(6))) == [f"Story {n}" + " More" * (n % 2) for n in range(6)]


def test_classes_locate_the_article_of_marked_pages(spark):
    item = lambda n: f"<li>Link {n} a</li><li>Link {n} b</li>"
    story = lambda n: f"<h1>Title {n}</h1>" + "".join(f"<p>Part {i} of the long story {n}</p>" for i in range(n % 3 + 2))
    page = lambda n: f"<html><body><nav><ul>{item(n)}</ul></nav><article>{story(n)}</article><footer>Of {n}</footer></body></html>"
    want = [" ".join([f"Title {n}", *(f"Part {i} of the long story {n}" for i in range(n % 3 + 2))]) for n in range(6)]
    assert located(spark, *map(page, range(6))) == [(w, True) for w in want]
    # Two pages make no template, and the check decides.
    assert located(spark, *map(page, range(2))) == [(w, False) for w in want[:2]]
    # A richer part beside the article is found, and the check takes the marked part.
    beside = [page(n).replace("<footer>", f"<section><h2>{n}</h2>{'Much other text ' * 50}{n}</section><footer>") for n in range(6)]
    assert located(spark, *beside) == [(w, False) for w in want]


def test_order_and_nesting_of_classes():
    of, size, pages = {1: 7, 2: 7, 3: 8, 4: 8}, {7: 2, 8: 2}, {7: 9, 8: 5}
    said = lambda *tokens: {t: (before, invalid) for t, _, before, invalid, _, _ in html.checked(list(tokens), of, size, pages)}
    assert said(1, 3, 4, 3, 4, 2) == {1: (0, False), 2: (1, False), 3: (0, False), 4: (3, False)}
    # The weaker of two classes that cross goes.
    assert said(1, 3, 2, 4) == {1: (0, False), 2: (1, False), 3: (0, True), 4: (3, True)}
    assert {t: invalid for t, (_, invalid) in said(1, 1, 2, 2).items()} == {1: True, 2: True}
    row = lambda t, low, high, place=0: {"token": t, "class": 5, "low": low, "high": high, "invalid": 0, "low_place": 0, "high_place": place}
    assert list(html.settled([row(2, 1, 1), row(1, 0, 0), row(3, 2, 2)], True)) == [(1, 5, 0, 3), (2, 5, 1, 3), (3, 5, 2, 3)]
    # Several orders: runs of one order in a first round, nothing in the last.
    runs = list(html.settled([row(1, 0, 0), row(2, 1, 1), row(3, 2, 5), row(4, 3, 3)], False))
    assert [(t, at) for t, _, at, _ in runs] == [(1, -1), (2, -1), (3, -1), (4, -1)] and runs[0][1] == runs[1][1] != runs[2][1] == runs[3][1]
    assert {run for _, run, _, _ in html.settled([row(1, 0, 0), row(2, 1, 1), row(3, 2, 5)], True)} == {0}
    # A class at several places is not nested.
    assert list(html.settled([row(1, 0, 0, 6), row(2, 1, 1, 6)], True)) == [(1, 0, -1, 0), (2, 0, -1, 0)]
