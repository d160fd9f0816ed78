import html
import re

import pytest

from veilspark.llm import templates as H

SF = "/root/testdata/sf0.01"


def text_of(page):
    return "\n".join(H.main_blocks(H.parse(page)[1]))


@pytest.mark.parametrize("page, want", [
    ("", ""),
    ("plain", "plain"),
    ("<p>a<p>b<br>c<b>d</b>  e\n f", "a\nb\ncd e f"),
    ("<body><header>top</header><nav>menu</nav><article><h1>T &amp; U</h1><p>x&nbsp;&#233;</p><aside>side</aside></article><footer>f</footer>", "T & U\nx é"),
    ("<div class='cookie-notice'>ok</div><main><p>m</p><form><input>f</form><section id=comments><p>c</p></section></main><p>out</p>", "m"),
    ("<script>var t='</p>';</script><p>x<!-- <p>no --> y</p><style>p{}</style><p title='a>b'>z", "x y\nz"),
    ("<article><p>one</p><div class=\"ad\">buy</div><article class='comment'>me</article><p>two</p></article>", "one\ntwo"),
    ("<p>cut off <b>here", "cut off here"),
    ("<p>a < b &lt;c&gt; &am &copy", "a < b <c> &am ©"),
    ("<ul><li>a<li>b</ul><table><tr><td>c<td>d</table>", "a\nb\nc\nd"),
    ("<nav><ul><li>a</nav><p>b</p></ul>c", "b\nc"),
    ("<p>a<script>never ends", "a"),
    ("<!-- never ends", ""),
    ("<div class=\"sidebar\"><div>a</div></div><div class=post>b</div>", "b"),
])
def test_one_page(page, want):
    assert text_of(page) == want


def test_unbalanced_quotes_and_angles_stay_linear():
    assert text_of("<p class='" + "x" * 100_000) == ""
    assert text_of("<" * 50_000 + "a") == "<" * 49_999  # a tag cut off at the end is no text
    text_of("<a href=\"" * 20_000)
    text_of("<div>" * 3000 + "x")


def article(page):
    """The article of the given pages, by their markup."""
    body = re.search(r"(?s)<article>(.*)</article>", page)[1]
    blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", x)).split()) for x in re.split(r"<(?:p|br|h1|/p|/h1)>", body)]
    return "\n".join(x for x in blocks if x)


def test_given_pages(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    want = {r.page_id: article(r.html) for r in pages.collect()}
    got = {r.page_id: r for r in H.main_text(pages).collect()}
    assert {i: r.text for i, r in got.items()} == want
    assert all(r.n_chars == len(r.text) for r in got.values())


def test_template_text_goes_and_copies_stay(spark):
    same = "<article><h1>Same title</h1><p>all of it is the same on each page</p></article>"
    rows = [(i, f"http://a.org/{i}", f"<article><h1>Title {i}</h1><p>Share this page</p><p>words {i} of the article that differ</p></article>", 0) for i in range(8)]
    rows += [(100 + i, "http://b.org/", same, 0) for i in range(5)]
    rows += [(200 + i, f"http://c.org:80/{i}", "<article><p>Share this page</p><p>few pages</p></article>", 0) for i in range(2)]
    rows += [(300, None, "<p>x</p>", 0), (None, "no address", None, 0), (301, "http://a.org/1", rows[1][2], 0), (1, "http://a.org/1", rows[1][2], 0)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, host int")
    got = [(r.page_id, r.text) for r in H.main_text(pages).collect()]
    assert len(got) == len(rows)
    by = dict(got)
    assert by[3] == "Title 3\nwords 3 of the article that differ" and by[301] == by[1] == "Title 1\nwords 1 of the article that differ"
    assert by[100] == "Same title\nall of it is the same on each page" and by[200] == "Share this page\nfew pages"
    assert by[300] == "x" and by[None] == ""
    assert H.main_text(pages.limit(0)).count() == 0


def test_vectors_equal_a_count_over_all_pages(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet").selectExpr("page_id page", "html")
    pages = pages.withColumn("host", H.F.lit("h"))
    vectors = {}
    for r in pages.collect():
        tags, blocks = H.parse(r.html)
        for t in [H.token("")] + [H.token(p) for p in tags] + [H.token(p, x) for p, x, _ in blocks]:
            vectors.setdefault(t, {}).setdefault(r.page, 0)
            vectors[t][r.page] += 1
    got = {r.token: r for r in H.occurrence_vectors(pages).collect()}
    assert len(got) == len(vectors)
    classes, want = {}, {}
    for t, v in vectors.items():
        r = got[H.signed(t)]
        assert (r.pages, r.total) == (len(v), sum(v.values()))
        classes.setdefault((r.pages, r.vector), set()).add(t)
        want.setdefault(frozenset(v.items()), set()).add(t)
    assert {frozenset(x) for x in classes.values()} == {frozenset(x) for x in want.values()}


LONG = "the text of the page, which is longer than what stands around it"


@pytest.mark.parametrize("page, want", [
    (f"<div class='layout has-sidebar'><article><p>{LONG}</p></article><div class=sidebar>s</div></div>", LONG),
    (f"<div class='no-sidebar with-menu'><p>{LONG}</p></div>", LONG),
    (f"<div class='side-by-side'><article>{LONG}</article></div>", LONG),
    (f"<main><div class='main-sidebar'><article>{LONG}</article></div></main>", LONG),
    (f"<form id=aspnetForm><div class=nav>n</div><article>{LONG}</article></form>", LONG),
    (f"<form id=aspnetForm><div class=nav>n</div><div>{LONG}</div></form>", LONG),
    (f"<main><p>{LONG}</p><article class=card>teaser</article></main>", f"{LONG}\nteaser"),
    (f"<main><p>{LONG}</p></main><article class=card>teaser</article>", LONG),
    (f"<p>{LONG}</p><article class=card>teaser</article>", f"{LONG}\nteaser"),
    (f"<article><p>{LONG}</p><div class=related><article class=card>teaser</article></div></article>", LONG),
    (f"<article>short</article><section id=comments><article>{LONG}</article></section>", "short"),
    (f"<form>search</form><article>{LONG}</article>", LONG),
])
def test_wrappers_and_teasers(page, want):
    assert text_of(page) == want


def test_roles_order_and_nesting_of_classes(spark):
    rows = []
    for i in range(8):
        own = [f"own words {i} {k} of this page alone, a line of them" for k in range(2 + i % 3)]
        # on each page once, but before the second heading on some pages and after it on others
        own[1:1] = ["Read this first", "<h2>"] if i % 4 else ["<h2>", "Read this first"]
        # on the pages with <div>, which begins before that heading, while the words stand after it
        body = "".join(x if x == "<h2>" else f"<p>{x}" for x in own)
        body = body.replace("<h2>", f"<div>u{i}</div><h2>h{i}</h2><p>So they say</p>") if i < 4 else body.replace("<h2>", f"<h2>h{i}</h2>")
        rows.append((i, f"http://a.org/{i}", f"<article><p>Share it<h1>Title {i}</h1>{body}<hr><p>Share it</article>"))
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text.split("\n") for r in H.main_text(pages).collect()}
    for i, x in got.items():
        assert "Share it" not in x, x
        assert "Read this first" in x and ("So they say" in x) == (i < 4) and f"Title {i}" in x
    twice = {r.page_id: r.text.split("\n") for r in H.main_text(pages.union(pages)).collect()}
    assert twice == got


def test_order_and_crossing_of_one_page():
    tags = {1: (7, 0, 3, 9, False), 2: (7, 1, 3, 9, False), 3: (7, 2, 3, 9, True), 4: (8, 0, 2, 5, False), 5: (8, 1, 2, 5, True)}
    assert list(H.words([1, 0, 2, 3, 1, 3, 2, 4, 5], tags)) == [(7, (1, 2, 3)), (7, (1, 3, 2)), (8, (4, 5))]
    assert list(H.words([1, 1, 2, 2, 3, 3], tags)) == [(7, None), (7, None)]
    assert H.crossing([1, 4, 2, 5, 3], tags) == {8} and H.crossing([4, 1, 2, 5, 3], tags) == {8}
    assert H.crossing([1, 2, 4, 5, 3, 4, 5, 1, 2, 3], tags) == set() and H.crossing([4, 1, 2, 3, 5], tags) == set()
    roles = H.refined([0, 1, 0, 2, 0, 4, 0, 5, 0, 3, 0], tags)
    assert roles[0] == roles[10] == 0 and len({roles[k] for k in (0, 2, 4, 6, 8)}) == 4 and roles[4] == roles[8]
    assert H.misplaced([1, 3, 2], [1, 2, 3], {3}) == [3] and H.misplaced([2, 1, 9], [1, 2, 9], {9}) != []
    assert H.misplaced([5, 1, 2, 3, 4], [1, 2, 3, 4, 5], set()) == [5]
