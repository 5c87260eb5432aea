import random
import resource

import pytest
from pyspark.sql import functions as F

from codeatlas.llm import html_extract as h

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p {{}}</style></head><body><header class="site"><a href="/">Home</a></header>
<nav class="menu"><ul><li><a href="/a">A</a></li></ul></nav><div class="{box}"><h1>Title &amp; more</h1><p>First   paragraph with
several words, long enough to count.</p><script>var x = "<p>no</p>";</script><p>Second &eacute; paragraph<br>after a break &#8212; here.</p>
<div class="cookie-notice">We use cookies</div><form><input value="x">Sign up</form></div><aside>Related</aside>
<div class="comments"><p>I disagree with every word of this long article and say so at length.</p></div><footer>Copyright</footer></body></html>"""
TEXT = "Title & more\n\nFirst paragraph with several words, long enough to count.\n\nSecond é paragraph after a break — here."


def extract(html, paths=()):
    return h.Page(html).text(paths)


def test_pages(spark):
    rows = [(k, f"http://h{k % 2}.example/{k}", PAGE.format(box=f"content post-{k}")) for k in range(6)]
    rows += [(10, "http://h0.example/x", None), (11, None, ""), (12, "odd", "just text &lt;b&gt;"), (13, None, "<p>a<p>b<br>c"), (None, "http://h0.example/n", PAGE.format(box="content post-9")), rows[0]]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit(1)).withColumn("path", F.lit("x")).withColumn("paths", F.lit("y"))
    got = sorted((r["page_id"] is not None, r["page_id"] or 0, r["text"], r["n_chars"]) for r in h.main_text(df).collect())
    want = [(k, TEXT) for k in [*range(6), 0]] + [(None, TEXT), (10, ""), (11, ""), (12, "just text <b>"), (13, "a\n\nb c")]
    assert got == sorted((k is not None, k or 0, t, len(t)) for k, t in want)


def test_the_hosts_path_wins():
    small = '<body><div class="main">Short.</div><div class="teaser"><p>' + "A long list of teasers for other articles. " * 5 + "</p></div></body>"
    assert extract(small, {h.path_of("html", "body", "div.main")}) == "Short."
    assert extract(small, {h.path_of("html", "body", "div.other")}).startswith("A long list")


WORDS = "Some words of an article that goes on for a while. "


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ('<div class="layout has-sidebar"><article><p>One</p><p>Two</p></article><div class="sidebar">No</div></div>', "One\n\nTwo"),
        ('<div class="post no-comments"><p>One</p><p>Two</p></div>', "One\n\nTwo"),
        ('<article><div class="entry-header"><h1>Title</h1></div><p>Body</p></article>', "Title\n\nBody"),
        ('<article><p>Body</p><section id="related-work"><h2>Related work</h2><p>Others</p></section></article>', "Body\n\nRelated work\n\nOthers"),
        (f'<article><p>Lead</p><div class="body"><p>{WORDS * 5}</p></div><p>Closing</p></article>', f"Lead\n\n{(WORDS * 5).strip()}\n\nClosing"),
        (f'<body><div id="page"><div class="a"><p>{WORDS * 3}</p></div><div class="b"><p>{WORDS * 2}</p></div></div></body>', f"{(WORDS * 3).strip()}\n\n{(WORDS * 2).strip()}"),
        (f'<body><div class="a"><p>{WORDS * 3}</p></div><div class="b"><p>{WORDS * 2}</p></div></body>', f"{(WORDS * 3).strip()}\n\n{(WORDS * 2).strip()}"),
        ("<article><p>Let <math><mi>x</mi><mo>=</mo><mn>1</mn></math> be.</p></article>", "Let x=1 be."),
        ("<article><div don't><p>One</p></div><p>it's two</p></article>", "One\n\nit's two"),
        ('<form id="aspnetForm"><div id="main"><article><p>One</p></article></div><input value="x">Go</form>', "One"),
        ('<body><form id="aspnetForm"><div id="content"><p>Article about forms</p></div></form></body>', "Article about forms"),
        ('<body><form action="./"><input type="hidden" name="state" value="x"><div class="nav"><a href="/">Menu</a></div><div class="page"><h1>Title</h1><p>Body</p></div><input type="submit" value="Go"></form></body>', "Title\n\nBody"),
        (f'<body><form><div class="top"><input name="q"></div><div class="page"><p>{WORDS * 4}</p></div></form></body>', (WORDS * 4).strip()),
        (f'<body><div class="page"><p>{WORDS}</p></div><form><p>Sign up for letters</p><input name="mail"></form></body>', WORDS.strip()),
        ('<body><nav>Menu</nav><form><label>Name <input name="n"></label><select><option>a</select><p>Tell us who you are</p></form></body>', ""),
        ('<body><form class="login-form"><p>Welcome back, dear reader</p></form><p>Text</p></body>', "Text"),
        ("<article><header><h1>Title</h1><p>Standfirst</p></header><p>Body</p><footer>Foot</footer></article>", "Title\n\nStandfirst\n\nBody"),
        ('<main><article><p>Post</p><article class="comment"><p>A reader says so</p></article></article></main>', "Post"),
        ('<div class="comments"><p>All that this page has</p></div>', "All that this page has"),
        ("<nav>Menu</nav><footer>Foot</footer>", ""),
        ('<article data-x="a > b" title=\'c > d\'><p>One</p></article>', "One"),
    ],
)
def test_articles_stay_whole(html, text):
    assert extract(html) == text


def written_page(r):
    """A page made from an article that is known, with all kinds of boilerplate around and inside it."""
    word = lambda: r.choice(["alpha", "beta", "gamma", "délta", "e&amp;f", "3 &lt; 4", "it's", "x"])
    plain = lambda s: s.replace("&amp;", "&").replace("&lt;", "<")
    line = lambda: " ".join(word() for _ in range(r.randint(5, 40)))
    noise = lambda: r.choice(['<nav><ul><li><a href="/x">{}</a></li></ul></nav>', '<div class="ad">{}</div>', '<div id="cookie-banner"><p>{}</p></div>', "<script>var a = '<p>{}</p>';</script>", "<style>p {{ {} }}</style>", "<form>{}<input></form>", "<aside><p>{}</p></aside>", "<!-- {} -->", '<div class="site-footer"><p>{}</p></div>', '<section class="comments"><p>{}</p></section>', '<ul role="navigation"><li>{}</li></ul>', "<noscript>{}</noscript>"]).format(line())
    blocks, inner = [], []
    for _ in range(r.randint(3, 12)):
        text = line()
        blocks.append(" ".join(plain(text).split()))
        inner.append(r.choice(["<p>{}</p>", "<p>{}", "<div><p>{}</p></div>", "<h2>{}</h2>", "<ul><li>{}</ul>", "<section><p><b>{}</b></p></section>", "<blockquote>{}</blockquote>", "<table><tr><td>{}</table>", "<div class='has-sidebar part-7'>{}</div>"]).format(text.replace(" ", r.choice([" ", "\n ", "  "]))))
        if r.random() < 0.4:
            inner.append(noise())
    tag = r.choice(["article", "main", "article class='post header-large'"])
    html = "<html><body>" + "".join(noise() for _ in range(3)) + f"<div class='wrap'><{tag}>" + "".join(inner) + f"</{tag.split()[0]}></div>" + "".join(noise() for _ in range(3)) + "</body></html>"
    return html, "\n\n".join(blocks)


def test_written_pages(spark):
    r = random.Random(6)
    pages = [(k, f"https://h{k % 7}.example/{k}", *written_page(r)) for k in range(300)]
    df = spark.createDataFrame([p[:3] for p in pages], "page_id long, url string, html string")
    got = {x["page_id"]: x["text"] for x in h.main_text(df).collect()}
    assert got == {p[0]: p[3] for p in pages}


def test_many_hosts(spark, monkeypatch):
    """Beyond the broadcast pages go to their host's paths by a join, those of one host in several parts."""
    r = random.Random(8)
    pages = [(k, f"https://h{k % 3}.example/{k}" if k % 5 else None, written_page(r)[0]) for k in range(120)] + [(None, None, None), (7, "odd", "<p>x")] * 2
    df = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(4)
    rows = lambda: sorted((tuple(x) for x in h.main_text(df).collect()), key=repr)
    want = rows()
    monkeypatch.setattr(h, "BROADCAST_HOSTS", 0)
    assert rows() == want


def test_odd_markup():
    for text in ("<", "<<<", "</p>", "<p", "<p class='", "<!-- never closed", "<script>", "<table><tr><td>x", "a < b", "&#xFFFFFF;&bogus;", "<p/><br/>x", "\x00", "<a =''", "<a b='<c d=\""):
        assert isinstance(extract(text), str)
    assert extract("a < b") == "a < b"
    deep = "<div>" * 3000 + "x" + "</div>" * 3000
    assert extract(deep) == "x"
    assert extract("<p>" + "word " * 200_000 + "</p>") == "word " * 199_999 + "word"


def test_deep_pages_stay_small():
    """A megabyte of open elements, and as many ends that fit none of them."""
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    assert extract("<div>" * 200_000 + "x" + "</b>" * 100_000 + "<p>y") == "x\n\ny"
    assert extract("<div>a" * 50_000).startswith("a\n\na")
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 600_000  # kilobytes


def test_empty_table(spark):
    assert h.main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
