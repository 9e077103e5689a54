import random
import re
import time
from html import unescape

import pyarrow.parquet as pq

from inkstone.llm import html

SF = "/root/testdata/sf0.01"


def test_query_matches_the_articles(spark):
    """The driver's pages have one article each; its blocks read off by plain splitting."""
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    for r in html.op3_html_extraction(spark, SF).collect():
        body = pages[r.page_id].split("<article>")[1].split("</article>")[0]
        parts = re.split("</?(?:p|h1)>", re.sub("</?b>", "", body.replace("<br>", " ")))
        want = "\n\n".join(t for p in parts if (t := re.sub(r"\s+", " ", unescape(p)).strip()))
        assert r.text == want and r.n_chars == len(want)


LONG = "Words of the article that go on for quite a while, so that nobody takes them for a menu entry."


def test_without_an_article():
    page = f"""<html><head><title>T</title><style>p{{}}</style></head><body><div id=top-nav><a href=/>Home</a></div>
    <ul><li><a href=/a>One</a><li><a href=/b>Two</a></ul><div><h2>Heading</h2><p>{LONG}<p>Short &amp; sweet.&nbsp; <b>Bold</b>ly.<p>{LONG}</div>
    <div class="cookie-banner"><p>{LONG}</p></div><form><p>{LONG}</p></form><section id="comments"><p>{LONG}</p></section><footer>{LONG}</footer></body></html>"""
    assert html.main_text(page) == f"Heading\n\n{LONG}\n\nShort & sweet. Boldly.\n\n{LONG}"


def test_article_parts():
    page = f"""<header><p>{LONG}</p></header><main><article><header><h1>Title</h1><p>By someone</p></header><p>Hi.</p>
    <aside>{LONG}</aside><p title="a > b">One<br>two</p><script>var t="</p><p>x";</script><!-- <p>no</p> --><div style="display: none">hidden</div>
    <div class="share-buttons">Share</div><pre>a
    b</pre></article><article class="comment"><p>{LONG}</p></article></main><p>{LONG}</p>"""
    assert html.main_text(page) == "Title\n\nHi.\n\nOne two\n\na b"


def test_a_teaser_is_not_the_article():
    story = f"<div><h2>Story</h2><p>{LONG}</p><p>Short.</p><p>{LONG}</p></div>"
    text = f"Story\n\n{LONG}\n\nShort.\n\n{LONG}"
    menu = "<nav><a href=/>Home</a></nav><ul><li><a href=/a>One</a></li><li><a href=/b>Two</a></li></ul>"
    assert html.main_text(f'{menu}{story}<ul><li><a href=/c>Three</a></ul><ul><li><a href=/d>Four</a><li><a href=/e>Five</a></ul><article class="card"><a href=/f>Read this too</a></article>') == text
    assert html.main_text(f'<article class="card"><p>A teaser.</p></article>{menu}{story}') == text
    # A mark that holds most of the text is believed: short lines stay, text beside it goes.
    assert html.main_text(f"<div><p>{LONG}</p></div><article><h1>A</h1>{story}<p>x</p></article>") == f"A\n\n{text}\n\nx"
    # A main part may be short beside one long line, not beside a story.
    assert html.main_text(f"<main><p>Hi.</p></main><p>{LONG}</p>") == "Hi."
    assert html.main_text(f"<main><p>Hi.</p></main>{menu}{menu}{story}<p>{LONG}</p>") == f"{text}\n\n{LONG}"


def test_text_of_ordinary_markup_is_kept():
    """Apostrophes in unquoted values, names that only contain a word of furniture, link paragraphs, short beginnings."""
    assert html.main_text(f"<article><p class=a'>First {LONG}</p><p class=b'>Second {LONG}</p></article>") == f"First {LONG}\n\nSecond {LONG}"
    assert html.main_text(f"<article><p>{LONG}</p><div class='share-price'><p>Up.</p></div><p>{LONG}</p></article>") == f"{LONG}\n\nUp.\n\n{LONG}"
    assert html.main_text(f"<div class='legal-news'><p>{LONG}</p><p>{LONG}</p></div>") == f"{LONG}\n\n{LONG}"
    assert html.main_text(f"<form><div class='legal'><p>{LONG}</p><p>{LONG}</p></div></form><nav>{LONG}</nav>") == f"{LONG}\n\n{LONG}"
    assert html.main_text(f"<p>{LONG}</p><p><a href=/x>One link</a></p><p>{LONG}</p>") == f"{LONG}\n\nOne link\n\n{LONG}"
    assert html.main_text(f"<p>a b.<p>c d.<p>e f.<p>g h.<p>{LONG}") == f"a b.\n\nc d.\n\ne f.\n\ng h.\n\n{LONG}"
    # Windows decide inside a marked article too: a stretch of links is a dive, a long named part surges.
    links = "".join(f"<li><a href=/{i}>Entry {i}</a></li>" for i in range(5))
    assert html.main_text(f"<article><p>Hi.</p><ul>{links}</ul><p>{LONG}</p><ul>{links}</ul></article>") == f"Hi.\n\n{LONG}"
    long = f"{LONG} " * 10
    assert html.main_text(f"<article><p>{LONG}</p><div class=notice><p>{long}</p></div><div class=notice>Brief.</div></article>") == f"{LONG}\n\n{long.strip()}"
    assert html.main_text(f"<article><p>{LONG}</p><section class=comments><p>{long}</p></section></article>") == LONG


def test_stretches_against_brute_force():
    """Surge and dive by the definition: cut at dives, keep the pieces that have a window of the least sum."""
    rng = random.Random(2)
    for _ in range(1000):
        n = rng.randrange(12)
        weights = [rng.choice([0, 0, 5, 30, 60, 100]) for _ in range(n)]
        cuts = [rng.random() < 0.1 for _ in range(n)]
        weights = [0 if c else w for w, c in zip(weights, cuts)]
        assert html.sums(weights) == [sum(weights[i : i + html.WINDOW]) for i in range(n)]
        want = []
        for a in range(n):
            for b in range(a, n):
                # Both ends weigh something, nothing in between cuts or dives, and neither end can be moved further out.
                inside = lambda x, y: weights[x] and weights[y] and not any(cuts[x : y + 1]) and all(any(weights[i : i + html.WINDOW]) for i in range(x, y + 1))
                if inside(a, b) and not any(inside(x, y) for x in range(a + 1) for y in range(b, n) if (x, y) != (a, b)):
                    end = next((i for i in range(b, n) if cuts[i]), n)
                    if max(sum(weights[i : min(end, i + html.WINDOW)]) for i in range(a, b + 1)) >= html.SURGE:
                        want.append((a, b))
        assert html.stretches(weights, cuts) == want, (weights, cuts)


def unmarked(story: list[str], rng: random.Random, other: list[str]) -> str:
    """A page of one of several layouts, none of which marks its article."""
    tag = rng.choice(["p", "div"])
    body = "".join(f"<{tag}>{p}</{tag}>" for p in story)
    menu = "".join(f"<li><a href=/{i}>{w}</a></li>" for i, w in enumerate(rng.choice(other).split()[:7]))
    side = "".join(f"<li><a href=/s{i}>{p[:40]}</a></li>" for i, p in enumerate(rng.sample(other, 5)))
    extra = rng.choice(other)
    return rng.choice(
        [
            f"<body><nav><ul>{menu}</ul></nav><div id=content>{body}</div><footer><p>{extra}</p></footer>",
            f"<body><div class='top-nav'><ul>{menu}</ul></div><table><tr><td><ul>{side}</ul><td>{body}</table><div id=footer>{extra}</div>",
            f"<body><header><p>{extra[:60]}</p></header><ul>{menu}</ul><section>{body}</section><div class=comments><p>{extra}</p><p>{extra}</p></div><ul>{side}</ul>",
            f"<body><form><div class='menu-bar'>{menu}</div>{body}<div class='cookie-banner'>{extra}</div><aside>{extra}</aside></form>",
            f"<body><ul>{menu}</ul><div class='post-body'>{body}</div><ul>{side}</ul><div class='related-posts'>{extra}</div><div>&copy; {extra[:30]}",
        ]
    )


def test_pages_without_an_article():
    """Precision and recall by words on layouts that mark nothing; the stories are those of the driver's pages."""
    rng, hit, given, wanted = random.Random(4), 0, 0, 0
    bodies = [r["html"].split("<article>")[1].split("</article>")[0] for r in pq.read_table(f"{SF}/pages.parquet").to_pylist()]
    stories = [[t for x in re.findall("<p>([^<]+)", b) if (t := x.strip())] for b in bodies]
    stories = [s for s in stories if sum(map(len, s)) >= 200]
    other = [p for s in stories for p in s if len(p) > 40]
    for story in stories * 2:
        want = " ".join(unescape(" ".join(story)).split()).split(" ")
        got = html.main_text(unmarked(story, rng, other)).split()
        both = sum(min(got.count(w), want.count(w)) for w in set(want))
        hit, given, wanted = hit + both, given + len(got), wanted + len(want)
    assert hit / given > 0.97 and hit / wanted > 0.99, (hit / given, hit / wanted)


def test_time_follows_the_length():
    """Two megabytes of broken markup of any kind are read once."""
    for part in ("<a ", "<button>", "<span hidden>x</i>", '<a href="', "<a href='x\" ", "<!--", "</", '<div class="a', "<li><p>", "<select><"):
        took = []
        for size in (250_000, 2_000_000):
            page, began = part * (size // len(part)), time.process_time()
            html.main_text(page)
            took.append(time.process_time() - began)
        assert took[1] < 16 * took[0] + 0.5, (part, took)


def test_edges(spark):
    assert [html.main_text(x) for x in (None, "", "   ", "<p>Hi.", "no markup at all", "<p>cut <b", "a < b and 2<3", "<nav>x</nav>")] == ["", "", "", "Hi.", "no markup at all", "cut", "a < b and 2<3", ""]
    assert html.main_text("<p>a<!-->b<!--->c<!-- x -->d<button>e<p>f<script>g") == "abcde\n\nf"
    assert len(html.main_text("<p>" + "word " * 400_000)) == 5 * 400_000 - 1
    rows = [(1, None, None, "x"), (1, "u", "<p>Hi.", "x"), (1, "u", "<p>Hi.", "x"), (None, "u", "", "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    assert sorted(html.extract(df).collect(), key=str) == sorted([(1, None, "", 0), (1, "u", "Hi.", 3), (1, "u", "Hi.", 3), (None, "u", "", 0)], key=str)
    assert html.extract(df.limit(0)).collect() == []
