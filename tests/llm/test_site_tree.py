"""Main text of pages: parsing, what sites repeat, and the query against the articles cut out plainly."""

from __future__ import annotations

import html
import re
import time

import pyarrow.parquet as pq
import pytest

from snapdelta.llm import queries, site_tree


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""),
        ("", ""),
        ("plain  text &amp; more", "plain text & more"),
        ("<p>one<p>two<b>bold<br>new</p>", "one\n\ntwobold new"),
        ("<p>a &lt;b&gt; &eacute;&#8364;&nbsp;x</p>", "a <b> é€ x"),
        ("<script>if (a<b) '</p>'</script><style>p{}</style><p>kept</p>", "kept"),
        ("<!-- <p>no</p> --><p>yes</p><!-- open <p>no", "yes"),
        ("<nav><ul><li>a</li></ul></nav><header>h</header><article><header><h1>T</h1></header><p>x</p></article><footer>f</footer>", "T\n\nx"),
        ("<body><div class='side-bar sidebar'>s</div><div id=\"cookie-notice\">c</div><div>t</div><form>f</form></body>", "t"),
        ("<article><p>x</p><div class='comments'><p>c</p></div></article><div>outside</div>", "x"),
        ("<p title=\"a > b\">x</p><p hidden>y</p><div style='display: none'>z</div>", "x"),
        ("<ul><li>a<li>b</ul><table><tr><td>c<td>d</table>", "a\n\nb\n\nc\n\nd"),
        ("<div><p>1 < 2 and 3 > 2</p></div", "1 < 2 and 3 > 2"),
        ("<div>" * 3000 + "deep", "deep"),
    ],
)
def test_pages(page, text):
    assert site_tree.main_text(page, set()).replace("</div", "").replace("<", "<").strip() == text


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<div class='content-sidebar-wrap'><main><p>x</p></main></div>", "x"),
        ("<body class='has-sidebar'><div class='no-comments post-share-enabled'><article><p>x</p></article></div></body>", "x"),
        ("<div class='search-result'><p>x</p></div><div class='widget'>w</div>", "x"),
        ("<div class='sidebar'><main><p>x</p></main></div><div class='sidebar'>s</div>", "x"),
        ("<div id='search'><p>all there is</p></div><nav>n</nav>", "all there is"),
        ("<article><p>so <math><mi>a</mi><mo>=</mo><mi>b</mi></math></p></article>", "so a=b"),
    ],
)
def test_words_inside_of_names_declare_nothing(page, text):
    assert site_tree.main_text(page, set()) == text


def site(n):
    rows = []
    for i in range(n):
        body = f"<div class=x1>Start About</div><div class=x2><p>Text {i} of its own.</p><p>More {i * 7}.</p></div><div class=x3><p>All rights</p></div>"
        rows.append((i, f"https://one.example/{i}", f"<html><body>{body}</body></html>"))
    return rows


def test_what_a_site_repeats_goes(spark):
    rows = site(40) + [(100, "https://two.example/", "<html><body><div class=x1>Start About</div><div class=x2><p>Only page</p></div></body></html>")]
    rows += [(200, None, None), (200, None, None), (None, "no host", "<p>x</p>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS host", "2 AS path", "3 AS removed")
    found = {r.page_id: r for r in site_tree.extracted(df).collect()}
    assert all(found[i].text == f"Text {i} of its own.\n\nMore {i * 7}." for i in range(40))
    assert found[100].text == "Start About\n\nOnly page"
    assert (found[200].text, found[200].n_chars, found[None].text, found[3].n_chars) == ("", 0, "x", 28)
    assert site_tree.extracted(df.limit(0)).collect() == []


def test_copies_of_a_page_do_not_make_it_boilerplate(spark):
    rows = site(40) + [(1000 + i, f"https://one.example/copy{i}", site(1)[0][2]) for i in range(300)]
    found = {r.page_id: r.text for r in site_tree.extracted(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert found[1200] == found[0] == "Text 0 of its own.\n\nMore 0."


def test_siblings_are_nodes_of_their_own(spark):
    def page(i):
        own = "".join(f"<p>Own {i} {k}.</p>" for k in range(1 + i % 4))
        boxes = f"<div id=menu2>Start About</div><div id=content>{own}<p>Subscribe now</p></div><div id=notice>All rights</div>"
        return f"<html><body class='page-{i}'>{boxes}<div>Top</div><div>Text {i}.</div></body></html>"

    rows = [(i, f"https://one.example/{i}", page(i)) for i in range(40)]
    found = {r.page_id: r.text for r in site_tree.extracted(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert found == {i: "\n\n".join([*(f"Own {i} {k}." for k in range(1 + i % 4)), f"Text {i}."]) for i in range(40)}


@pytest.mark.parametrize("n", [2, 3, 5, 30])
def test_the_tree_alone_decides_without_telling_names(spark, n):
    """Neither an article nor a telling class; what is called a promotion or is outside a teaser is the page's own text."""
    def page(i, teaser):
        own = f"<div class=promo><p>Text {i} of its own.</p></div><div><p>More {i * 7}.</p><p>Same end</p></div>{teaser}"
        return f"<html><body><div class=x1>Start About</div>{own}<form>f</form><script>s</script><div>All rights</div></body></html>"

    rows = [(i, f"https://one.example/{i}", page(i, "<div class=x3>Same teaser</div>")) for i in range(n)]
    rows += [(100 + i, f"https://two.example/{i}", page(i, "<article>Same teaser</article>").replace("promo", "x2")) for i in range(n)]
    found = {r.page_id: r.text for r in site_tree.extracted(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert found == {h + i: f"Text {i} of its own.\n\nMore {i * 7}." for h in (0, 100) for i in range(n)}


def test_few_pages_lean_on_all_hosts(spark):
    def page(host, own):
        return f"<html><body><div class=x1>Start {host}</div><div class=x2>{''.join(f'<p>{x}</p>' for x in own)}</div></body></html>"

    rows = [(10 * h + i, f"https://h{h}.example/{i}", page(h, [f"Text {h} {i}.", f"More {h} {i}."])) for h in range(5) for i in range(4)]
    rows += [(100, "https://single.example/", page(100, ["Text."]))]
    rows += [(200 + i, f"https://near.example/{i}", page(200, ["A shared passage.", f"End {i}."])) for i in range(2)]
    found = {r.page_id: r.text for r in site_tree.extracted(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert found[100] == "Text." and found[201] == "A shared passage.\n\nEnd 1." and found[12] == "Text 1 2.\n\nMore 1 2."


def plain(page):
    article = re.search(r"<article>(.*)</article>", page, re.S)[1]
    parts = re.split(r"</?(?:h1|p)>", article)
    texts = [" ".join(html.unescape(re.sub(r"<br>", " ", re.sub(r"</?b>", "", p))).split()) for p in parts]
    return "\n\n".join(t for t in texts if t)


def test_query(spark, sf_dir):
    stored = pq.read_table(f"{sf_dir}/pages.parquet").to_pylist()
    expected = {r["page_id"]: plain(r["html"]) for r in stored}
    found = queries.QUERIES["op8_site_style_tree"](spark, sf_dir).collect()
    assert {r.page_id: r.text for r in found} == expected and len(found) == len(stored)
    assert all(r.n_chars == len(r.text) for r in found)


def test_the_tree_alone_takes_what_is_drawn_from_a_stock(spark, monkeypatch):
    """Menus, advertisements and footers, drawn from 60 texts, go at sf0.1 by the entropy of their groups: no name is asked."""
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet")
    rows = pages.select("page_id", "url", "html").withColumn("host", site_tree._host("url"))
    decided = site_tree.with_verdicts(rows, site_tree.LOW, site_tree.LEAST_PAGES).collect()
    for lists in ("_NO_ARTICLE", "_NO_ARTICLE_NAMES", "_VARYING", "_HEADERS"):
        monkeypatch.setattr(site_tree, lists, frozenset())
    went = 0
    for r in decided:
        kept, tree, named, outside = site_tree.sorted_out(r.html, set(r.removed), set(r.unknown), set(r.sure), r.host)
        assert "\n\n".join(b.text for b in kept) == plain(r.html) and not named and not outside
        went += len(tree)
    assert went > 7 * len(decided)


def stock(spark, n, copies=0, hosts=4):
    """Pages without a telling name: a menu from a stock of 30, an article of its own or one of many copies, the host's name below."""
    rows = []
    for i in range(n):
        host = f"h{i % hosts}.example"
        own = "The same article, word for word." if i < copies else f"Article {i} begins. It goes on with {i * 7919}."
        body = f"<div class=a><p>Menu text number {i * 13 % 30}</p></div><div class=b><p>{own}</p></div><div class=c>By {host}</div>"
        rows.append((i, f"https://{host}/{i}", f"<html><body>{body}</body></html>"))
    return spark.createDataFrame(rows, "page_id long, url string, html string")


@pytest.mark.parametrize(("n", "copies"), [(150, 0), (600, 0), (600, 300)])
def test_stocks_and_copies(spark, n, copies):
    """A stock goes though it differs from page to page; an article stays though half of all pages have it."""
    found = {r.page_id: r.text for r in site_tree.extracted(stock(spark, n, copies)).collect()}
    expected = {i: f"Article {i} begins. It goes on with {i * 7919}." for i in range(copies, n)}
    assert {i: found[i] for i in expected} == expected
    assert all(found[i] == "The same article, word for word." for i in range(copies))


def test_threshold_lies_between_two_modes():
    assert 0.4 <= site_tree._between_modes({30: 10, 35: 10, 80: 5, 90: 5}) <= 0.7
    assert site_tree._between_modes({30: 10, 41: 10, 88: 20}) == pytest.approx(0.645)
    assert site_tree._between_modes({90: 10, 95: 3}) == site_tree._between_modes({}) == site_tree.BOUNDS[0]


@pytest.mark.parametrize(
    "unit", ['<a "x ', "<a 'x> ", '<a ">" ', "<![CDATA[ ", "<!-- ", "<", "</p>", "<div>", "<p <", "<textarea", '<div class="', "</div><b"]
)
def test_long_broken_pages_take_linear_time(unit):
    page = "<div>" * 20_000 + unit * (1_000_000 // len(unit)) + "end"
    began = time.perf_counter()
    list(site_tree.tokens(page))
    assert time.perf_counter() - began < 4


def test_a_megabyte_of_unclosed_tags_is_read_within_a_second():
    page = '<a "x ' * 170_000
    began = time.perf_counter()
    site_tree.page_rows(page)
    assert time.perf_counter() - began < 1


def test_comments_and_asides_go_though_they_vary(spark):
    rows = [
        (i, f"https://h{i % 5}.example/{i}", f"<article><p>Text {i} here.</p></article><div class=comments><article>Reader {i * 31}</article></div><aside>See {i}</aside>")
        for i in range(150)
    ]
    found = {r.page_id: r.text for r in site_tree.extracted(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert found == {i: f"Text {i} here." for i in range(150)}
