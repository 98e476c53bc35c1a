"""Pages with and without <article>, misleading names, hostile markup, and densities against plain recursion."""

import math
import random
import re
import time

import pytest

from tidemark.llm import html_extraction as H

SENTENCES = [f"Sentence number {i} of the story says a little more about the river, the mill and the people who lived near it." for i in range(40)]
PARAGRAPHS = [" ".join(SENTENCES[i : i + 3]) for i in range(0, 36, 3)]
LINKS = "<div class=x1><ul>" + "".join(f"<li><a href=/{i}>Link to page {i}</a></li>" for i in range(8)) + "</ul></div>"
TEASER = "<div class=x2><h3><a href=/o>Another story of the week</a></h3><p>The council met on Monday and will meet again. <a href=/o>Read more of this</a></p></div>"
BAR = '<div class="bottom">© 2024 The Paper. All rights reserved.</div>'
STORY = "<h1>The mill</h1>" + "".join(f"<p>{p}</p>" for p in PARAGRAPHS)
WANT = " ".join(["The mill", *PARAGRAPHS])


def page(body, attributes=""):
    return f"<html><head><title>t</title></head><body{attributes}>{body}</body></html>"


@pytest.mark.parametrize(
    "body",
    [
        f"{LINKS}<div class=x3>{STORY}</div>{TEASER}{BAR}",
        f"<div id=w>{LINKS}<div class=x3>{STORY}</div>{TEASER}</div>{BAR}",
        f"<main>{LINKS}<div>{STORY}</div></main>{TEASER}{BAR}",
        f"<div class='content has-sidebar'>{STORY}</div>{BAR}",
        f"<div id=page class='no-sidebar ad-free'><form id=mainForm>{STORY}</form></div>",
        f"<form id=mainForm action=/><nav>Home</nav><div>{STORY}</div></form>{BAR}",
        f"<div class=related><article>{STORY}</article></div>",
        f"<article>{STORY}</article>{LINKS}{TEASER}{BAR}",
        f"<table><tr><td>{LINKS}</td><td>{STORY}</td></tr></table>{BAR}",
        f"<div>{STORY}</div><div class=comments><p>I liked it a lot, thanks to all who wrote it.</p><p>{PARAGRAPHS[0]}</p></div>",
        f"<div class=site-header><h1>The Paper</h1></div><div>{STORY}</div><div class=site-footer>Imprint</div>",
        f"<h1>The mill</h1><div><section>{''.join(f'<p>{p}</p>' for p in PARAGRAPHS[:6])}</section><section>{''.join(f'<p>{p}</p>' for p in PARAGRAPHS[6:])}</section></div>{LINKS}",
    ],
)
def test_the_story_alone(body):
    assert H.main_text(page(body)) == WANT


@pytest.mark.parametrize("mark", ["class=related-work", "class=alert", "id=comment-on-law", "id=foot-anatomy", "class='search for truth'", "id=notice"])
def test_paragraphs_keep_their_place_whatever_their_names(mark):
    for wrap in ("<article>{}</article>", "<div>{}</div>"):
        body = STORY.replace("<p>", f"<p {mark}>", 3)
        assert H.main_text(page(wrap.format(body))) == WANT


def test_short_paragraphs_stay():
    short = STORY.replace("</h1>", "</h1><p>Yes.</p>") + "<p>Sh is.</p><ul><li>a</li><li>b</li></ul>"
    for wrap in ("<article>{}</article>", "<div>{}</div>", "{}"):
        assert H.main_text(page(wrap.format(short) + BAR)) == WANT.replace("The mill", "The mill Yes.") + " Sh is. a b"


def test_what_an_article_holds_that_is_not_its_own():
    body = f"<article>{STORY}<div class=ad>Buy now</div><div class='share-buttons'><a href=/>Share</a></div><aside>More</aside><section id=comments><p>{PARAGRAPHS[0]}</p></section>{LINKS}</article>"
    assert H.main_text(page(body)) == WANT


def densities(page):
    """Composite densities and sums of every node by plain recursion over the same tree."""
    root = H.parse(page)
    H.leave_out(root)
    out = {}

    def counts(x):
        c = t = lc = lt = 0
        for y in x.children:
            if isinstance(y, str):
                c += len(y.strip())
            elif not y.out:
                a = counts(y)
                c, t, lc, lt = c + a[0], t + a[1] + 1, lc + a[2], lt + a[3] + (y.tag == "a")
        out[id(x)] = (c, t, c if x.tag == "a" else lc, lt)
        return out[id(x)]

    counts(root)
    nodes = []

    def walk(x):
        nodes.append(x)
        for y in x.children:
            if not isinstance(y, str) and not y.out:
                walk(y)

    walk(root)
    body = out[id(next((x for x in nodes if x.tag == "body"), root))]

    def density(x):
        c, t, lc, lt = out[id(x)]
        if not c:
            return 0.0
        t1, lc1, lt1 = max(t, 1), max(lc, 1), max(lt, 1)
        base = math.log(c / max(c - lc, 1) * lc + body[2] / max(body[0], 1) * c + math.e)
        return c / t1 * max(0.0, math.log(max(c / lc1 * t1 / lt1, 1.0)) / math.log(max(base, 1.001)))

    return [(x.tag, density(x), sum(density(y) for y in x.children if not isinstance(y, str) and not y.out)) for x in nodes]


def test_densities_against_plain_recursion():
    rng = random.Random(9)
    for _ in range(60):
        parts = []
        for _ in range(rng.randrange(1, 40)):
            parts.append(rng.choice(["<div>", "</div>", "<p>", "</p>", "<a href=x>", "</a>", "<b>", "</b>", "<ul>", "</ul>", "<li>", "<br>", "some words ", "more &amp; more ", "<div class=ad>", "<nav>", "</nav>"]))
        text = page("".join(parts))
        got = [(x.tag, x.density, x.total) for x in H.measure(H.parse(text))]
        want = densities(text)
        assert [g[0] for g in got] == [w[0] for w in want]
        assert all(math.isclose(a, b, abs_tol=1e-9) for g, w in zip(got, want, strict=True) for a, b in zip(g[1:], w[1:], strict=True))


@pytest.mark.parametrize("make", [lambda n: "<a " * n, lambda n: "<div>" * n + "</span>" * n, lambda n: "<a '>' " * n, lambda n: "</ " * n, lambda n: "<p><b>" * n, lambda n: "<a \">" * n, lambda n: "<li><ul>" * n, lambda n: "&#" + "1" * n + ";", lambda n: "<span><li></li>" * n])
def test_hostile_pages_take_time_in_proportion(make):
    start = time.time()
    H.main_text(make(60_000))
    assert time.time() - start < 20


def test_character_references():
    assert H.main_text("<p>a &#65;&#0000000000000065; &#x41; &amp;lt; &#99999999999; &nosuch; &copy</p>") == "a AA A &lt; � &nosuch; ©"


def test_quotes_and_cut_off_tags():
    assert H.main_text('<p title="a > b">x</p>') == "x"
    assert H.main_text("<p title='a>x</p><p>y</p>") == "x y"
    assert H.main_text("<p>x <b class='y") == "x"
    assert H.main_text("1 < 2 </ b> 3") == "1 < 2 3"


def test_empty_tables_odd_columns_and_repeated_rows(spark):
    rows = [(1, "u", page(STORY), "x"), (1, "u", page(STORY), "y"), (None, None, None, None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    assert sorted((r.page_id or 0, r.n_chars) for r in H.extract(df).collect()) == [(0, 0), (1, len(WANT)), (1, len(WANT))]
    assert H.extract(df.limit(0)).count() == 0


P = "<p>" + "A long sentence of the article that goes on for quite some time and says something. " * 3 + "</p>"
READER = '<article class="comment-body"><p>' + "What a reader thinks of this at length, and more and more of it. " * 6 + "</p></article>"
OTHERS = "<ul>" + "".join(f'<li><a href="{i}">Other story {i}</a></li>' for i in range(4)) + "</ul>"


def plain(*parts):
    return " ".join(" ".join(re.sub("<[^>]+>", " ", p).split()) for p in parts)


@pytest.mark.parametrize(
    "page, want",
    [
        ('<div class="entry-content"><h1>Title</h1>' + P * 6 + '</div><div id="comments"><ol class="comment-list">' + f"<li>{READER}</li>" * 5 + "</ol></div>", ["Title", *[P] * 6]),
        ('<article class="post"><h1>Title</h1>' + P * 2 + '</article><ol class="commentlist">' + f"<li>{READER}</li>" * 9 + "</ol>", ["Title", P, P]),
        ('<article class="post"><h1>Title</h1>' + P * 2 + "</article>" + READER * 3, ["Title", P, P]),
        ('<article class="post"><h1>Title</h1>' + P * 2 + '</article><div class="more"><article class="teaser">' + P * 9 + "</article></div>", ["Title", P, P]),
        ("<main><article><h2>One</h2>" + P * 3 + "</article><article><h2>Two</h2>" + P * 3 + "</article></main>", ["One", P, P, P, "Two", P, P, P]),
        ("<main><article><h2>One</h2>" + P * 3 + '</article><article><a href="/">Another story, told elsewhere</a></article></main>', ["One", P, P, P]),
        ('<article class="comments-open has-comments"><h1>Title</h1>' + P + "</article>", ["Title", P]),
        ("<article><h1>Title</h1>" + P * 2 + "<h3>Read also</h3>" + OTHERS + P + "<h3>The end</h3>" + P + "</article>", ["Title", P, P, P, "The end", P]),
        ("<article><h1>Title</h1>" + P + '<div class="in-article-ad">Buy now</div>' + P + "</article>", ["Title", P, P]),
        ("<div><h1>Title</h1><div>By Ann Author</div>" + P * 2 + "<div>A hill, seen from the north</div>" + P * 2 + "</div>", ["Title", "By Ann Author", P, P, "A hill, seen from the north", P, P]),
        ("<p>Of <math><mi>x</mi></math> and more numbers this long sentence says something.</p>" + P * 2, ["Of x and more numbers this long sentence says something.", P, P]),
        ('<div class="comments-wrapper"><main><h1>Title</h1>' + P * 2 + "</main></div>", ["Title", P, P]),
    ],
)
def test_comments_teasers_and_short_blocks(page, want):
    assert H.main_text(f"<html><body>{page}</body></html>") == plain(*want)
