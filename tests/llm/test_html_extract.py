import math
import random
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.llm import html_extract as h
from tidemark.llm.html_extract import extract_column, main_text

LONG = "This sentence stands for the long running text of an article that readers came for. "
PAGE = f"""<!DOCTYPE html><html><head><title>T</title><style>p{{a:b}}</style><script>var t="</p>";</script></head><body>
<header><a href="/">Home</a> Site name</header><nav><ul><li><a href=/a>A</a><li><a href=/b>B</a></ul></nav>
<div class="cookie-notice">We use cookies. {LONG}</div><div class="sidebar"><p>{LONG}</p></div>
<div id=content><article><h1>A &amp; B</h1><p>{LONG}&eacute;&#x41;<p><b>Unclosed   bold<br>next<p>{LONG * 3}</p><p>Short.</p>
<form><input name=q><p>Search here</p></form><div class="advert">Buy now {LONG}</div><aside>Aside {LONG}</aside></article></div>
<section id="comments"><p>Reader: {LONG * 6}</p></section><footer>&copy; me</footer></body></html>"""


def test_article_without_its_surroundings():
    s = " ".join(LONG.split())
    assert main_text(PAGE).split("\n\n") == ["A & B", f"{s} éA", "Unclosed bold next", " ".join([s] * 3), "Short."]


def test_article_without_semantic_elements():
    rows = "".join(f"<p>{LONG}{i}</p>" for i in range(6))
    page = f"<body><div class=top><a href=1>one</a><a href=2>two</a><a href=3>three</a></div><table><tr><td><div>{rows}</div></td></tr></table><div><a href=x>{LONG}</a> <a href=y>{LONG}</a></div></body>"
    assert main_text(page).split("\n\n") == [f"{LONG}{i}" for i in range(6)]


@pytest.mark.parametrize("wrap", ["<div>{}</div>", "<section>{}</section>", "<table><tr><td>{}</td></tr></table>"])
@pytest.mark.parametrize("outer", ["<div id=content>{}</div>", "{}"])
def test_article_spread_over_long_sections(wrap, outer):
    want = [f"{i} {j} {LONG * 3}".strip() for i in range(3) for j in range(20)]
    parts = ["".join(f"<p>{p}</p>" for p in want[20 * i : 20 * i + 20]) for i in range(3)]
    links = "".join(f"<a href=/{i}>{LONG}</a> " for i in range(4))
    page = "<body><div>" + links + "</div>" + outer.format("<h2>Head</h2>" + "<h3>Between</h3>".join(map(wrap.format, parts))) + "<div>" + links + "</div></body>"
    got = main_text(page).split("\n\n")
    assert [x for x in got if x not in ("Head", "Between")] == want and got[0] == "Head" and got.count("Between") == 2


ARTICLE = "".join(f"<p>{i} {LONG}</p>" for i in range(5))
ARTICLE_TEXT = "\n\n".join(f"{i} {LONG}".strip() for i in range(5))


@pytest.mark.parametrize("name", ["content has-sidebar", "no-sidebar", "site-main with-sidebar", "post type-notice", "layout-sidebar", "page_menu"])
@pytest.mark.parametrize("inner", ["<article>{}</article>", "{}", "<div class='main-widget'>{}</div>", "<form>{}</form>"])
def test_names_of_wrappers_do_not_count(name, inner):
    page = f"<body><div class=sidebar>{LONG}</div><div class='{name}'>{inner.format(ARTICLE)}<div class=share>{LONG}</div></div><div class=comments><p>{LONG}</p></div></body>"
    assert main_text(page) == ARTICLE_TEXT


def test_long_comments_are_no_wrapper():
    assert main_text(f"<body><div><h1>A</h1><p>{LONG}</p></div><div id=comments>{ARTICLE * 20}</div></body>") == f"A\n\n{LONG.strip()}"


@pytest.mark.parametrize("start", ["<html><head><title>T</title>", "<head><meta charset=x><style>p{}</style><noscript><link></noscript>", "<html><head><title>T</title><body>", "<title>T</title>", "<html><head><title>T</title></head>"])
def test_head_ends_at_the_first_content(start):
    assert main_text(start + ARTICLE) == ARTICLE_TEXT
    assert main_text(start + "Plain text.") == "Plain text."


@pytest.mark.parametrize("part", ["<section class='related'>{}</section>", "<section id=recommendations>{}</section>"])
def test_names_of_related_matter_count_only_for_links(part):
    links = "<ul>" + "".join(f"<li><a href=/{i}>Story {i}</a></li>" for i in range(4)) + "</ul>"
    text = f"<p>{LONG}Part of it.</p>"
    got = main_text(f"<body><article>{ARTICLE}{part.format(text)}{part.format(links)}</article></body>")
    assert got == f"{ARTICLE_TEXT}\n\n{LONG}Part of it."


@pytest.mark.parametrize("head", ["<h2 id='notice'>Head</h2>", "<h3 class='menu share'>Head</h3>", "<p><span class='comment'>Head</span></p>", "<p><b id=footer>Head</b></p>"])
def test_names_of_headings_and_inline_elements_do_not_count(head):
    assert main_text(f"<body><article>{ARTICLE}{head}</article></body>") == f"{ARTICLE_TEXT}\n\nHead"


@pytest.mark.parametrize("tag", ["<p class=a\">", "<p onclick=it's>", "<p title='a>b' class=\"x\">", "<p a=b'c\"d e>", "<p a = 'x>y'>", "<p a='x class=comments y'>", "<p \" '>", "<p =>", "<p a=>", "<p data-x=1/2>"])
def test_quotes_count_only_after_an_equals_sign(tag):
    assert main_text(f"<body><article>{ARTICLE}{tag}Hello.</p><p>It's \"here\".</p></article></body>") == f"{ARTICLE_TEXT}\n\nHello.\n\nIt's \"here\"."


def slow_density(x, body):
    """Characters, tags, link characters and link tags of a node by walking its whole subtree, and its density."""
    if isinstance(x, str):
        return len("".join(x.split()))
    chars = tags = link_chars = link_tags = 0
    stack = [(k, x.tag == "a") for k in x.kids]
    while stack:
        k, linked = stack.pop()
        if isinstance(k, str):
            n = len("".join(k.split()))
            chars, link_chars = chars + n, link_chars + (n if linked else 0)
        elif k.tag not in h.HIDDEN:
            tags, link_tags = tags + 1, link_tags + (k.tag == "a")
            stack += [(y, linked or k.tag == "a") for y in k.kids]
    if not chars:
        return 0.0
    if not link_chars:
        return chars / max(1, tags)
    base = math.log(chars * link_chars / max(1, chars - link_chars) + body * chars + math.e)
    return chars / max(1, tags) * max(0.0, math.log(max(1.0, chars / link_chars * max(1, tags) / max(1, link_tags)) + 1e-9, base))


@pytest.mark.parametrize("seed", range(20))
def test_densities_and_sums_equal_brute_force(seed):
    rng = random.Random(seed)

    def grow(depth):
        if depth == 0 or rng.random() < 0.2:
            return " ".join("w" * rng.randint(1, 9) for _ in range(rng.randint(1, 30)))
        tag = rng.choice(["div", "section", "ul", "a", "b", "td", "script"])
        return f"<{tag}>{''.join(grow(depth - 1) for _ in range(rng.randint(0, 5)))}</{tag}>"

    body = h.measure(h.parse(f"<body>{''.join(grow(4) for _ in range(4))}</body>"))
    stack, ratio = [body], body.link_chars / max(1, body.chars)
    while stack:
        x = stack.pop()
        below = [k for k in x.kids if isinstance(k, str) or k.tag not in h.HIDDEN]
        assert x.density == pytest.approx(slow_density(x, ratio), rel=1e-9, abs=1e-9)
        if x.chars:
            text = 0 if x.tag == "a" else sum(slow_density(k, ratio) for k in below if isinstance(k, str))
            assert x.total == pytest.approx(text + sum(slow_density(k, ratio) for k in below if not isinstance(k, str) and not k.bad))
        stack += [k for k in below if not isinstance(k, str)]


def test_threshold_keeps_sparse_nodes_out():
    links = "".join(f"<p>See <a href=/{i}>{LONG}</a></p>" for i in range(6))
    sparse = "".join(f"<div><span><i>{w}</i></span></div>" for w in "some words in very many tags".split())
    page = f"<body><div>{ARTICLE}</div><div>{sparse}</div><div>{links}</div><div>{ARTICLE}</div></body>"
    got = main_text(page).split("\n\n")
    assert got[:5] == got[-5:] == ARTICLE_TEXT.split("\n\n")
    assert main_text(f"<body><div>{sparse}</div><div>{ARTICLE}</div><div>{sparse}</div></body>") == ARTICLE_TEXT


@pytest.mark.parametrize("html", ["<b>" * 100_000 + "</x>" * 100_000 + "t", "<p>" + "<b>" * 50_000 + "<hr>" * 50_000 + "t", "<table><li>" + "<i>" * 50_000 + "<li>" * 50_000 + "t", "<a b=\"" * 30_000 + "t", "<p a='" + "<p a=" * 50_000])
def test_time_is_in_proportion_to_the_page(html):
    began = time.time()
    main_text(html)
    assert time.time() - began < 5


def test_other_columns_do_not_matter(spark):
    df = spark.createDataFrame([(1, f"<p>{LONG}</p>")], "page_id long, html string").selectExpr("*", "'c' AS text", "1 AS n_chars", "2 AS x")
    assert [r["y"]["text"] for r in df.select(extract_column(F.col("html")).alias("y")).collect()] == [LONG.strip()]


@pytest.mark.parametrize("html", [None, "", "   ", "<html></html>", "<script>x</script>", "<!-- only -->"])
def test_nothing_to_extract(html):
    assert main_text(html) == ""


def test_plain_text_and_broken_markup():
    assert main_text("1 < 2 and a <b") .startswith("1 < 2 and a")
    assert main_text("<p>a<p>b</div></p>c") == "a\n\nb\n\nc"


@settings(max_examples=80, deadline=None)
@given(st.text(alphabet="<>/pabdiv \"'=!-&;#x1\n", max_size=200))
def test_never_raises(html):
    assert isinstance(main_text(html), str)


def test_very_deep_and_long_pages():
    assert main_text("<div>" * 5000 + "deep") == "deep"
    assert len(main_text("<article>" + "<p>word word</p>" * 20000 + "</article>").split("\n\n")) == 20000


def test_column(spark):
    rows = [(1, PAGE), (1, PAGE), (2, None), (3, "")]
    got = spark.createDataFrame(rows, "page_id long, html string").select("page_id", extract_column(F.col("html")).alias("x")).select("page_id", "x.*").collect()
    assert sorted((r["page_id"], r["n_chars"] == len(r["text"])) for r in got) == [(1, True), (1, True), (2, True), (3, True)]
    assert spark.createDataFrame([], "html string").select(extract_column(F.col("html"))).count() == 0
