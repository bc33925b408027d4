import re
from html import unescape

import pytest

from scrubjay.llm import html_density, queries

PROSE = "A sentence of running text that goes on for a while, with commas and all. " * 3
PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style></head><body>
<header><a href=/>Site</a></header><nav><ul><li><a href=a>Home</a><li><a href=b>News</a></ul></nav>
<div class="cookie-banner">We use cookies. Accept?</div>
{0}
<aside><p>Related: other things to read about</p></aside><div id="comments"><p>Reader: I disagree with every word of this article and more.</p></div>
<form><input name=q><button>Go</button></form><script>var x = "<p>no</p>";</script><footer>&copy; us</footer></body></html>"""


@pytest.mark.parametrize(
    "body,want",
    [
        (f"<article><h1>Head &amp; line</h1><p>{PROSE}</p><p>{PROSE}</p></article>", f"Head & line {PROSE}{PROSE}".strip()),
        (f"<div class=x><div class=y><h2>Title</h2><p>{PROSE}<p>{PROSE}</div></div>", f"Title {PROSE}{PROSE}".strip()),
        (f"<main><section><p>{PROSE}</p><p>{PROSE}</p></section><section><p>{PROSE}</p></section></main>", (PROSE * 3).strip()),
        (f"<div>one<b>two</b> <i>three</i>\n\t four&nbsp;five<br>{PROSE}</div>", f"onetwo three four five {PROSE}".strip()),
        (f"<article><!-- no --><p><b>{PROSE}<br><p>{PROSE}</article>", (PROSE * 2).strip()),
    ],
)
def test_article_only(body, want):
    assert html_density.main_text(PAGE.format(body)) == " ".join(want.split())


def test_links_lose_to_prose():
    menu = "<div>" + "".join(f"<a href={i}>Entry number {i}</a> " for i in range(40)) + "</div>"
    assert html_density.main_text(f"<body><div>{menu}<div><p>{PROSE}</p><p>{PROSE}</p></div></div></body>") == " ".join((PROSE * 2).split())


@pytest.mark.parametrize(
    "html,want",
    [
        ("<p title=it's>b", "b"),
        ('<p title="a>b">c</p>x', "c x"),
        ("<p a=b\"c>d</p>e", "d e"),
        ('<p class="a>Hello</p><p>second', ""),  # the open quote runs to the page's end
        ("<p a='x\ny' b = \"z\">d", "d"),
        ("one</ x> two <!> three <?php x?> four<!-->five<!-- no --!>six", "one two three four five six".replace("four five six", "fourfivesix")),
        ("a < b <3 c", "a < b <3 c"),
        ("x<p class='y", "x"),
        ("<p a=>b</p>", "b"),
        ("<p/class=x>t", "t"),
    ],
)
def test_tags_as_the_standard_reads_them(html, want):
    assert html_density.main_text(html) == want


UNNAMED = """<body><div><ul><li><a href=a>Home</a><li><a href=b>News of the day</a><li><a href=c>More</a></ul></div><div>We use cookies here. Is that fine?</div>
{0}
<div><p>Reader: I disagree.</p></div><div>&copy; us, all rights to us</div></body>"""


@pytest.mark.parametrize("inner", [f"<div><h1>Head</h1>{'<p>' + PROSE + '</p>'}{'<p>' + PROSE + '</p>'}<p>Short one.</p>{'<p>' + PROSE * 2 + '</p>'}</div>", f"<section><h2>One</h2>{('<p>' + PROSE + '</p>') * 4}</section><section><h2>Two</h2>{('<p>' + PROSE + '</p>') * 3}</section>"])
def test_density_decides_without_names(inner):
    assert html_density.main_text(UNNAMED.format(inner)) == " ".join(re.sub("<[^>]*>", " ", inner).split())


def test_names_weigh_but_do_not_decide():
    """An article inside elements of such names is found; the same names beside it lose."""
    inner = f"<div><p>{PROSE}</p><p>{PROSE}</p><div class=ad>Buy this now</div><p>{PROSE}</p></div>"
    want = " ".join((PROSE * 3).split())
    for frame in ("<form id=aspnetForm>{0}</form>", "<div class='page sidebar-layout'>{0}</div>", "<div class=comments>{0}</div>", "<div id=popup>{0}</div>"):
        assert html_density.main_text(f"<body><nav><a href=x>y</a></nav>{frame.format(inner)}<footer>us</footer></body>") == want, frame
    assert html_density.main_text("<body><nav>only a menu</nav><footer>and a footer</footer></body>") == ""


def test_measures_beside_brute_force():
    """Counts, composite density and density sums from the tree by plain recursion and the formula as published."""
    import math
    import random

    rng = random.Random(7)

    def page(depth):
        if depth == 0 or rng.random() < 0.2:
            return "".join(rng.choice("abc def") for _ in range(rng.randint(0, 60)))
        return "".join(f"<{t}{' href=x' if t == 'a' else ''}{rng.choice(['', ' class=ad'])}>{page(depth - 1)}</{t}>" for t in rng.choices(["div", "section", "b", "a", "ul"], k=rng.randint(1, 4)))

    inline = html_density.INLINE
    kids = lambda n: [c for c in n.children if not isinstance(c, str)]

    def counts(n):
        c = sum(len(t) for t in n.children if isinstance(t, str) and not t.isspace())
        t = lc = lt = 0
        for k in kids(n):
            kc, kt, klc, klt = counts(k)
            c, t, lc, lt = c + kc, t + kt + (k.name not in inline or k.name == "a"), lc + klc, lt + klt
        return (c, t, c, lt + 1) if n.name == "a" else (c, t, lc, lt)

    def density(n, share):
        c, t, lc, lt = counts(n)
        if not c:
            return 0.0
        t, lt = max(1, t), max(1, lt)
        base = math.log(c / max(1, c - lc) * lc + share * c + math.e)
        x = max(1.0, c / max(1, lc) * t / lt)
        return n.weight * c / t * (math.log(x) / math.log(base) if base > 1.0001 else math.log(math.e * x))

    def below(n, share):
        return sum(below(k, share) if k.name in inline else density(k, share) for k in kids(n))

    for _ in range(60):
        root = html_density.parse(page(4))
        order = html_density.measure(root)
        c, _, lc, _ = counts(root)
        share = lc / c if c else 0.0
        for n in order:
            assert (n.chars, n.tags, n.link_chars, n.link_tags) == counts(n)
            assert n.density == pytest.approx(density(n, share), rel=1e-3) and n.below == pytest.approx(below(n, share), rel=1e-3)
        picked, threshold = html_density.chosen(root)
        if picked:
            best = max(order, key=lambda n: n.total * (not n.barred)).total
            assert any(n.total == best and (id(n) in picked or any(id(k) in picked for k in html_density.measured(n))) for n in order)
            assert threshold <= root.density


@pytest.mark.parametrize("html", [None, "", "   ", "<", "<p", "</p></p>", "<!--", "<script>", "<nav>only", "<p>" * 5000, "<div>" * 3000 + "deep", "&#x110000; &amp", "<a href='x"])
def test_odd_pages_do_not_crash(html):
    assert isinstance(html_density.main_text(html), str)


def test_plain_text_is_kept_whole():
    assert html_density.main_text("just &lt;text&gt;\n here") == "just <text> here"


def test_whole_table(spark, sf_dir):
    """Beside a reading of the tables' own template: what stands in the article, blocks in order."""
    pages = {r.page_id: r for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    rows = queries.op3_text_density(spark, sf_dir).collect()
    assert len(rows) == len(pages)
    for r in rows:
        inner = re.search(r"<article>(.*?)(?:</article>|$)", pages[r.page_id].html, re.S)[1]
        assert r.text == " ".join(unescape(re.sub(r"<[^<>]*>", " ", re.sub(r"</?b>", "", inner))).split()) and r.n_chars == len(r.text) and r.url == pages[r.page_id].url


def test_frames(spark):
    rows = spark.createDataFrame([(1, None, None, "t"), (1, None, None, "t"), (None, "u", "<p>x</p>", "t")], "page_id long, url string, html string, text string")
    assert sorted((r.page_id or 0, r.text) for r in html_density.extract(rows).collect()) == [(0, "x"), (1, ""), (1, "")]
    assert html_density.extract(rows.limit(0)).count() == 0
