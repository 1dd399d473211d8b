"""HTML extraction against a regular expression on the given pages, a brute-force style tree, and odd pages."""

import html as references
import math
import re
from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from scopewise.llm import html_extraction, queries
from scopewise.llm.html_extraction import GAMMA, LEAST, REPEATS, SURE_PAGES, SURE_SHARE, Page


def text_of(page):
    return Page(page).text(set(), set())[0]


def test_articles_of_the_given_pages(spark, sf):
    """These pages mark their article, whose paragraphs hold inline marks only."""
    pages = {r.page_id: r for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    got = queries.op11_html(spark, sf).collect()
    assert sorted(r.page_id for r in got) == sorted(pages)
    for row in got:
        article = re.search(r"<article>(.*?)(?:</article>|$)", pages[row.page_id].html, re.S).group(1)
        lines = re.sub(r"<[^>]*>", "", re.sub(r"</?(?:p|h1|br)>", "\n", article)).split("\n")
        want = "\n".join(x for x in (" ".join(references.unescape(line).split()) for line in lines) if x)
        assert (row.text, row.n_chars, row.url) == (want, len(want), pages[row.page_id].url)


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("<nav>Menu <a>x</a><article><h1>T &amp; U</h1><p>one<p>two <b>bold<br>line</p><aside>no</aside><footer>f</footer></article>", "T & U\none\ntwo bold\nline"),
        ("<body class='has-sidebar'><div id=sidebar-1>side</div><h1>Head</h1><p>a&nbsp;b<span class=ad>buy</span> \n c</p><script>if(a<b)'</p>'</script>", "Head\na b c"),
        ("<div class=post><p>text</p><section class=comments><article class=comment>I say</article></section></div><form>q<input></form>", "text"),
        ('<p title="a>b">x < y &lt;b&gt; &#x41;</p><!-- c > --> tail <p', "x < y <b> A\ntail"),
        ("<main><header><h1>T</h1></header><p>x</p><ul><li>i1<li>i2</ul><table><tr><td>a<td>b</table></main><footer>no</footer>", "T\nx\ni1\ni2\na\nb"),
        ("<h1>Title</h1><div>by the way</div><article><p>body</p></article>", "Title\nbody"),
        ("<div class='cookie-notice'>We use</div><div role=navigation>m</div><div hidden>h</div><div style='display: none'>d</div><p>bad &am", "bad &am"),
        ("<form><h1>All in one form</h1><p>text</p></form>", "All in one form\ntext"),
        ("<article><header>by X</header><p>p1</p><ul class='related'><li><a>r</a></ul><p>p<i>2</i></p></article>", "p1\np2"),
        ("plain", "plain"),
        ("", ""),
        ("<title>only</title>", ""),
        ("<article><p>cut at a tag</p><p cla", "cut at a tag"),
        ("<article>&lt;script&gt;kept&lt;/script&gt;</article>", "<script>kept</script>"),
    ],
)
def test_pages(page, want):
    assert text_of(page) == want


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["<p>", "</p>", "<div class=ad>", "</div>", "<b>", "</b>", "<a href='", "\"", "x y", "&amp;", "<!--", "-->", "<li>", "<article>", "</article>", "<", ">", "<script>", "</script>", "<table><td>", "\n"]), max_size=30))
def test_any_markup_is_read(parts):
    text = text_of("".join(parts))
    assert text == "\n".join(" ".join(line.split()) for line in text.split("\n"))


def trees(pages):
    """The style tree's cuts from its definition: pages(host, html) -> (host, place, block, inside)."""
    hosts = defaultdict(dict)
    for host, page in pages:
        copy, places, blocks = Page(page).stats()
        held = hosts[host].get(copy)
        key = (sorted(places), sorted(blocks))
        hosts[host][copy] = min(held, key) if held else key
    out = set()
    for host, held in hosts.items():
        styles, found = defaultdict(list), defaultdict(list)
        for places, blocks in held.values():
            for place, style in places:
                styles[place].append(style)
            for place, block, inside in blocks:
                found[place, block].append(inside)
        for (place, block), where in found.items():
            m, n, inside = len(styles[place]), len(where), any(where)
            if m < REPEATS or n < REPEATS:
                continue
            shares = [styles[place].count(s) / m for s in set(styles[place])]
            entropy = -sum(p * math.log(p, m) for p in shares)
            own = 0 if block == html_extraction.LINKED else 1 - math.log(n, m)
            rest = GAMMA ** len(shares)
            if (m >= SURE_PAGES and n >= SURE_SHARE * m) if inside else (1 - rest) * entropy + rest * own < LEAST:
                out.add((host, place, block, inside))
    return out


def site():
    """Pages without kinds or names that tell: what repeats on all pages and link lists of one shape are the template."""
    pages = []
    for i in range(12):
        links = "".join(f"<li><a href=/{i}{k}>topic {chr(97 + (i * 7 + k) % 26)}{k}</a></li>" for k in range(3))
        own = "".join(f"<p>paragraph {'abcdefghijklmnop'[(i + k) % 16]} of story {chr(97 + i)} goes on here</p>" for k in range(1 + i % 4))
        pages.append(("site", f"<body><div class=t><ul>{links}</ul></div><div class=m><h2>Story {chr(97 + i)}</h2>{own}<p>Sent from our desk.</p></div><div class=z>All rights kept by the site {2000 + i}</div></body>"))
    # near copies of one story share their longest block: they count once
    pages += [("copies", f"<body><div><p>The long first paragraph that all copies share.</p><p>short</p><p>end {chr(97 + i)}</p></div></body>") for i in range(9)]
    pages += [("marked", f"<article><p>Read on in our shop.</p><p>The long text of page {chr(97 + i)} of ten.</p></article>") for i in range(10)]
    return pages


def test_style_trees_against_brute_force(spark):
    pages = site()
    rows = spark.createDataFrame(pages + pages[:5], "host string, html string")
    got = {tuple(r) for r in html_extraction.style_trees(rows).collect()}
    assert got == trees(pages) and got


def test_templates_are_cut(spark):
    pages = [(i, f"http://{host}/p{i}", page) for i, (host, page) in enumerate(site())]
    rows = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html_extraction.extract_text(rows).collect()}
    for i, (host, page) in enumerate(site()):
        if host == "site":
            assert got[i].startswith(f"Story {chr(97 + i)}\nparagraph") and got[i].count("\n") == 1 + i % 4
        elif host == "copies":
            assert got[i] == f"The long first paragraph that all copies share.\nshort\nend {chr(97 + i - 12)}"
        else:
            assert got[i] == f"The long text of page {page.split(' of ten')[0][-1]} of ten."


def test_html_odd_tables(spark):
    rows = [(1, None, "<p>a</p>"), (1, "no host", "<p>b</p>"), (None, "http://h/x", None), (2, "http://h/y", ""), (3, "http://h/z", "<p>" + "long text " * 200_000), (4, "HTTP://H/q", "<p>a</p>"), (4, "HTTP://H/q", "<p>a</p>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit(1) for c in ("id", "host", "text", "noise", "n")})
    got = sorted(((r.page_id, r.text, r.n_chars) for r in html_extraction.extract_text(pages).collect()), key=repr)
    want = [(1, "a", 1), (1, "b", 1), (None, "", 0), (2, "", 0), (3, ("long text " * 200_000).strip(), 1_999_999), (4, "a", 1), (4, "a", 1)]
    assert got == sorted(want, key=repr)
    assert html_extraction.extract_text(pages.limit(0)).count() == 0
