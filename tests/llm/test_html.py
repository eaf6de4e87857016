"""Main text of pages: structure, template removal, malformed markup, odd rows."""

from __future__ import annotations

import time
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from curves.llm import html_main
from curves.llm.html_main import extract, main_text

DATA = "/root/testdata/sf0.1"
PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t="</p>";</script></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href="/x">x</a></ul></nav><!-- <p>no</p> --><div class="ad">Buy</div>
<div class="cookie-notice">We use</div><article><h1>Head &amp; more</h1><p><b>First  line<br>goes on<p>Second &eacute;&#233; {n}</p>
<ul><li>one<li>two</ul><form><input name=q><p>ask</p></form><div id="comments"><p>nice</p></div></article><aside>side</aside><footer>&copy; x</footer>"""


def test_main_text():
    assert main_text(PAGE.format(n=1)) == "Head & more\n\nFirst line goes on\n\nSecond éé 1\n\none\n\ntwo"
    assert main_text("") == main_text("<nav>x</nav>") == ""
    assert main_text("plain &lt;b&gt; text") == "plain <b> text"
    assert main_text("<p>a<p>b<div>c<p>d") == "a\n\nb\n\nc\n\nd"
    assert main_text("<article><p>cut off <a href='x") == "cut off"
    assert main_text("<p>" * 5000 + "deep") == "deep" and main_text("<div>" * 5000 + "deep") == "deep"


def test_template_of_a_host_goes(spark):
    banner = "<div class='strip'><p>Welcome to our site, all of you</p></div>"
    pages = [(i, f"https://h.org/{i}", f"<body>{banner}<div><p>Own words {i}</p></div></body>") for i in range(20)]
    pages += [(100 + i, f"https://other{i}.org/", f"<body>{banner}<div><p>Own words {i}</p></div></body>") for i in range(20)]
    shared = "<article><p>The same paragraph</p><ul><li><a href='/a'>A</a></ul></article>"
    pages += [(200 + i, f"http://art.org/{i}", f"<body>{shared}<article><p>{i}</p></article></body>") for i in range(20)]
    got = {r.page_id: r.text for r in extract(spark.createDataFrame(pages, "page_id bigint, url string, html string")).collect()}
    assert all(got[i] == f"Own words {i}" for i in range(20))
    assert all(got[100 + i].startswith("Welcome") for i in range(20))
    assert all(got[200 + i] == f"The same paragraph\n\n{i}" for i in range(20))


def test_odd_rows(spark):
    rows = [(1, None, None, 0), (1, None, None, 0), (2, "not a url", "<p>x", 0), (None, "http://a.b/", "<p>y", 0), (3, "", "", 0)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, hash int")
    got = sorted((str(r.page_id), r.text, r.n_chars) for r in extract(pages).collect())
    assert got == [("1", "", 0), ("1", "", 0), ("2", "x", 1), ("3", "", 0), ("None", "y", 1)]
    assert extract(pages.limit(0)).count() == 0


def test_a_site_header_goes_without_an_article_too():
    assert main_text("<header><h1>Site</h1></header><div><p>Own</p></div>") == "Own"
    assert main_text("<header class='hero'>Site</header><p>Own</p><main></main>") == "Own"
    assert main_text("<header>Site</header><main><header>Head</header><p>Own</p></main>") == "Head\n\nOwn"


def test_copies_of_a_page_are_not_its_template(spark):
    strip = "<div class='strip'><p>Welcome to our site, all of you</p></div>"
    story = "<p>The story with <a href='/s'>a link</a></p>"
    pages = [(i, f"http://h.org/{i}", f"<body>{strip}<div><p>Own words {i}</p></div></body>") for i in range(15)]
    pages += [(100 + i, f"http://h.org/copy{i}", f"<body>{strip}<nav>{i}</nav><div><p>Copied words</p></div></body>") for i in range(30)]
    pages += [(200 + i, f"http://art.org/{i}", f"<article>{story}<p>The end</p></article>") for i in range(30)]
    got = {r.page_id: r.text for r in extract(spark.createDataFrame(pages, "page_id bigint, url string, html string")).collect()}
    assert all(got[i] == f"Own words {i}" for i in range(15))
    assert all(got[100 + i] == "Copied words" for i in range(30))
    assert all(got[200 + i] == "The story with a link\n\nThe end" for i in range(30))


@pytest.mark.parametrize("cls", ["related-work", "post-notice", "sidewalk", "adverbs", "searching-for-truth", "menus-of-1900", "shared-memory"])
def test_sections_of_an_article_with_ordinary_names_stay(cls):
    assert main_text(f"<article><p>a</p><section class='{cls}'><p>kept</p></section></article>") == "a\n\nkept"


@pytest.mark.parametrize("cls", ["ad", "ads-top", "cookie-notice", "site-notice", "notice", "related-posts", "share-buttons", "comments", "wp-block-comments-area", "x sidebar y", "newsletter-signup"])
def test_noise_of_an_article_goes_by_name(cls):
    assert main_text(f"<article><p>a</p><div class='{cls}'><p>gone</p></div></article>") == "a"


def test_parsing_takes_linear_time():
    n = 40_000
    began = time.process_time()
    for page in ("<div>" * n + "</b>" * n, "<article><p><div>" + "<span>" * n + "<h1>" * n, "<a href=\"x'>" * n + '"', "<a 'x" * n, "<ul>" + "<li><b>x" * n):
        main_text(page)
    assert time.process_time() - began < 60
    assert main_text("<article>" + "<p>w</p>" * n) == "\n\n".join(["w"] * n)


def skeleton(node):
    """Plain version: nested tuples in place of hashes; and (characters, those of links)."""
    bones, chars, links = [], 0, 0
    for c in node.children:
        if isinstance(c, str):
            chars += len(c.strip())
        else:
            bone, n, of = skeleton(c)
            if not bones or bones[-1] != bone:
                bones.append(bone)
            chars, links = chars + n, links + of
    links = chars if node.tag == "a" else links
    return (node.tag, node.attrs.get("class", ""), node.attrs.get("id", ""), links * 2 >= chars > 0, tuple(bones)), chars, links


def outside(root):
    """Subtrees of a page with an article that neither are in it nor hold it."""
    holds = lambda n: html_main.is_main(n) or any(holds(c) for c in n.children if not isinstance(c, str))
    for c in root.children:
        if not isinstance(c, str) and not html_main.is_main(c):
            if not holds(c):
                yield c
            yield from outside(c)


def test_counts_equal_plain_counts_and_the_template_step_does_the_work(spark):
    """On all pages of the test table: the hashes' counts for each host, and the text that templates alone leave."""
    pages = spark.read.parquet(f"{DATA}/pages.parquet")
    keyed = pages.select(html_main.host(F.col("url")).alias("host"), "page_id", "html").toPandas()
    contents, count, of_page = defaultdict(set), defaultdict(set), {}
    for r in keyed.itertuples():
        root, text = html_main.parse(r.html or ""), main_text(r.html or "")
        contents[r.host].add(text)
        of_page[r.page_id] = r.host, {skeleton(n)[0] for n in outside(root)}
        for s in of_page[r.page_id][1]:
            count[r.host, s].add(text)
    common = {k for k, v in count.items() if len(v) >= 10 and len(v) >= 0.2 * len(contents[k[0]])}
    made = pages.select(html_main.host(F.col("url")).alias("host"), F.col("page_id").alias("k"), F.lit(0).cast("long").alias("u"), F.coalesce("html", F.lit("")).alias("html"))
    parsed = made.mapInPandas(html_main._hashes, "host string, k long, u long, content long, hashes array<long>")
    got = html_main.template_counts(html_main.stored(parsed)).groupBy("host").count().collect()
    assert {r.host: r["count"] for r in got if r.host in {h for h, _ in common}}.keys() == {h for h, _ in common}
    with_template = {i for i, (h, bones) in of_page.items() if any((h, s) in common for s in bones)}
    assert {r.k for r in html_main.templates(made).collect()} >= with_template
    full = {r.page_id: r.text for r in extract(pages).collect()}
    alone = {r.page_id: r.text for r in extract(pages, names=False, article=False).collect()}
    bare = {r.page_id: main_text(r.html or "", names=False, article=False) for r in keyed.itertuples()}
    changed = {i for i in alone if alone[i] != bare[i]}
    assert changed == with_template and len(changed) > 100
    assert all(alone[i] == full[i] for i in changed)  # menus, adverts and footers all went, though their words differ


def test_a_very_long_page_and_clashing_names(spark):
    long = "<article>" + "<p>some words here</p>" * 50_000 + "</article>"
    pages = spark.createDataFrame([(1, "http://h.org/", long, 1, 2, 3)], "page_id bigint, url string, html string, host int, k int, `a.b` int")
    assert extract(pages).first().n_chars == 50_000 * 17 - 2


WRAPPING = ["has-sidebar", "layout with-sidebar", "right-sidebar", "no-sidebar", "site has-banner", "nav-content", "site-modal", "share-article", "wrapper-search"]


@pytest.mark.parametrize("cls", WRAPPING)
def test_a_name_never_takes_main_content_with_it(cls):
    side = "<div class='sidebar'><p>side</p></div>"
    for main in ("<article><p>Own</p></article>", "<main><p>Own</p></main>", "<main><div><article><p>Own</p></article></div></main>"):
        assert main_text(f"<div class='{cls}'>{side}{main}<div class='related-posts'><article><p>other</p></article></div></div>") == "Own"
        assert main_text(f"<body><div id='{cls}'><form>{main}</form></div></body>") == "Own"
    assert main_text(f"<main><div class='{cls}'><article><p>Own words of it</p></article></div></main>") == "Own words of it"
    # without an article: what holds most of the text stays, and its small parts of such a name go
    assert main_text(f"<div class='{cls}'><p>Most of the text of this page is here</p>{side}</div>") == "Most of the text of this page is here"


def test_wrapped_pages_of_a_host_keep_their_articles(spark):
    pages = [(i, f"http://w.org/{i}", f"<form><div class='has-sidebar'><article><p>Own words {i}</p></article></div></form>") for i in range(30)]
    got = {r.page_id: r.text for r in extract(spark.createDataFrame(pages, "page_id bigint, url string, html string")).collect()}
    assert got == {i: f"Own words {i}" for i in range(30)}


def test_hidden_text_and_teasers_go():
    hidden = ["style='display:none'", "style='color:red; display : none;'", "aria-hidden=true", "hidden", "style='visibility:hidden'"]
    for attr in hidden:
        assert main_text(f"<article><p>a</p><div {attr}><p>gone</p></div></article>") == "a"
        assert main_text(f"<p>Shown text</p><div {attr}><p>gone, though it is most of the text of the page</p></div>") == "Shown text"
    teaser = "<article><h2><a href='/x'>Another story</a></h2><p>its sum</p></article>"
    own = "<article><p>The story of this page, at some length, as it was told to us by those who saw it</p></article>"
    text = "The story of this page, at some length, as it was told to us by those who saw it"
    assert main_text(f"{own}<div class='grid'>{teaser}{teaser}</div>") == text
    assert main_text(f"<aside>{teaser}</aside>{own}<footer>{teaser}</footer>") == text
    assert main_text(teaser) == "Another story\n\nits sum"


def test_comments_go_even_where_they_are_most_of_the_text():
    long = "<article class='comment'><p>A reader says much more about it than the story itself does, as readers do</p></article>"
    assert main_text(f"<article><p>Own</p><section id='comments'>{long * 3}</section></article>") == "Own"
    assert main_text(f"<main><p>Own</p><div class='comments-area'>{long * 3}</div></main>") == "Own"
    assert main_text(f"<div><p>Own</p></div><div id='comments'><p>{'a reader says ' * 9}</p></div>") == "Own"
