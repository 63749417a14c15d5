"""Main text of pages: hand-made pages, the given pages, cuts against every labelling."""

import html
import itertools
import random
import re

import pytest

from tidyloom.llm import main_text
from tidyloom.llm.queries import QUERIES

FULL = """<html><head><title>x</title></head><body><header><a href="/">Home</a> <h2>Site name</h2></header><nav>Menu</nav>
<div class="cookie-notice">We use cookies on this site. Please accept them all, they are good.</div>
<main><article><header><h1>Title of it</h1></header><p>First with a <a href=x>link</a> in it and some more words, too.
<p>Short.</p><aside>Side remark that is not wanted at all here.</aside><div class="ad">Buy now, the best there is.</div>
<p>Caf&eacute; &lt;b&gt; &#8364;5 &amp x<!-- a <p>comment</p> -->
   two</p><ul><li>One item<li>Another item</ul><form><label>Name</label><input><p>Please fill in all of the form.</p></form>
<script>var a = "<p>no</p>";</script><section id="comments"><p>Great article! I really loved every bit of it, thank you.</p></section>
</article></main><div class="sidebar"><p>Some long text in the sidebar that nobody wants to have, really.</p></div><footer>(c)</footer>"""


def test_parts_of_a_page():
    want = ["Title of it", "First with a link in it and some more words, too.", "Short.", "Café <b> €5 & x two", "One item", "Another item"]
    assert main_text.extract(FULL).split("\n") == want


@pytest.mark.parametrize("page, text", [
    (None, ""), ("", ""), ("   \n ", ""), ("<p></p><!-- only -->", ""), ("<nav>Menu of all things</nav>", ""),
    ("<article><p>cut off in the middle of a tag <b", "cut off in the middle of a tag <b"),
    ("<article><p>one &am", "one &am"), ("</div></p><article>text of it all.</article></b>", "text of it all."),
    ("<article><p>a 1 < 2 and 3 > 2 in text.</p></article>", "a 1 < 2 and 3 > 2 in text."),
    ("<article><p title='a > b'>Quoted.</p><p title=\"broken>Rest of it.</p></article>", "Quoted.\nRest of it."),
    ("<article><style>p{}</style><p>Only&nbsp;this \t here.</p>", "Only this here."),
])
def test_odd_pages(page, text):
    assert main_text.extract(page) == text


STORY = "<article><h1>Title of it</h1><p>The first paragraph of the story, long enough.</p></article>"
STORY_TEXT = "Title of it\nThe first paragraph of the story, long enough."


@pytest.mark.parametrize("page", [
    f"<html><head><title>x</title><body>{STORY}",
    f"<html><head><title>x</title><meta charset=utf-8>{STORY}",
    f"<head><title>x</title><script>1</script><noscript><link rel=a></noscript><body>{STORY}</body>",
    f"<head><title>x</title><noscript><style>p{{}}</style><body>{STORY}",
    f"<head><title>x</title><span></span>{STORY}",
    f"<head><template><p>Not to be read, as it is a template.</p></template><body>{STORY}",
])
def test_head_ends_without_its_tag(page):
    assert main_text.extract(page) == STORY_TEXT
    assert main_text.extract("<head><title>x</title>Some plain words that stand alone, on a page of no markup at all.") != ""


def test_self_closed_drawings_are_empty():
    for drawing in ('<svg class="icon" />', "<svg/>", "<math/>", '<svg width=1><title/><style/></svg>', "<svg><path d=1/></svg>"):
        assert main_text.extract(f"<body>{drawing}<div>{drawing}{STORY}</div>") == STORY_TEXT
    # A slash at the end of an unquoted value closes nothing.
    assert main_text.extract(f"<body><svg class=a/><text>Not to be read.</text></svg>{STORY}") == STORY_TEXT


def test_forms_around_a_page():
    search = "<div><label>Find</label><input><p>Please fill in all of the form, every part of it.</p></div>"
    menu = '<nav><a href="/">Home</a></nav>'
    for page in (STORY, f"<main>{STORY}</main>", f"<div>{STORY}</div>", STORY.replace("article>", "div>")):
        assert main_text.extract(f'<body><form id="aspnetForm" action="x">{menu}{page}<footer>(c)</footer></form>') == STORY_TEXT
    # Other forms stay out, as do hidden ones and what is hidden in them.
    assert main_text.extract(f"<body><form>{search}</form>{STORY}<form>{search}</form>") == STORY_TEXT
    assert main_text.extract(f"<body><form>{STORY.replace('</article>', '')}<form>{search}</form></article></form>") == STORY_TEXT
    assert main_text.extract(f"<form hidden>{STORY}</form>") == main_text.extract(f"<form><div hidden>{STORY}</div></form>") == ""


@pytest.mark.parametrize("page", [
    f"<body class='right-sidebar'>{STORY}", f"<html class='no-banner'><body>{STORY}",
    f"<div class='content-sidebar-wrap'><main>{STORY}</main></div>", f"<main aria-label='Search results'>{STORY}</main>",
    f"<div class='content-sidebar-wrap'><div>{STORY}</div></div>", f"<main><div class='content-sidebar-wrap'>{STORY}</div></main>",
    STORY.replace("<article", "<article class='post tag-social'"),
    f"<div class='content-sidebar-wrap'><main>{STORY.replace('article>', 'div>')}</main></div>",
    f"<div class='has-comments'>{STORY}</div>",
])
def test_names_around_the_article(page):
    assert main_text.extract(page) == STORY_TEXT


def test_names_beside_or_in_the_article():
    other = "<p>Another text of some length that nobody asked for, with all its many words.</p>"
    for beside in (f"<div class='sidebar'>{other}</div>", f"<div id='comments'><article class='comment'>{other}</article></div>",
                   f"<div id='comments'><article>{other * 4}</article></div>", f"<div class='related'><article>{other}</article></div>",
                   f"<div class='sidebar'><article>{other}</article></div>", f"<nav>{STORY}</nav>", f"<aside><article>{other}</article></aside>"):
        for page in (f"{STORY}{beside}", f"<main>{STORY}{beside}</main>", f"<body class='right-sidebar'><div class='sidebar-wrap'>{STORY}{beside}</div>",
                     f"<div class='sidebar-wrap'>{beside}<main>{STORY}</main></div>", STORY.replace("</article>", f"{beside}</article>"),
                     f"<main>{STORY.replace('article>', 'div>')}{beside}</main>"):
            assert main_text.extract(page) == STORY_TEXT


@pytest.mark.parametrize("rest", [
    'data-title="The hidden life of trees"', 'title="Hidden gems"', "title='A class=ad of its own'", 'data-hidden="false"', "data-hidden",
    'data-class="sidebar"', "data-a=1 title=hidden", 'title="x hidden', 'aria-hidden="false"', 'class="overflow-hidden"', 'class="post" class="sidebar"',
    "data-style='display:none'", "x-role=navigation", 'title = "id=comments" lang=en', "title='hidden'data-x", "href=/hidden/role=nav",
])
def test_only_whole_attribute_names_count(rest):
    names, hidden = main_text._marks(" " + rest)
    assert not hidden and not names & main_text.APART_NAMES
    assert main_text.extract(f"<section {rest}>{STORY}</section>") == STORY_TEXT
    assert main_text.extract(STORY.replace("<h1", f"<h1 {rest}")) == STORY_TEXT


@pytest.mark.parametrize("rest", [
    "hidden", "HIDDEN", 'hidden=""', "hidden/", 'title="x"hidden', "title=x\nhidden", 'style="color:red; display : none"', "style=display:none",
    "aria-hidden = 'true'", 'title="a=b" data-x hidden class=y', "title='' hidden", "= hidden",
])
def test_hidden_elements_stay_out(rest):
    assert main_text.extract(f"<div {rest}>{STORY}</div>") == ""


def test_pages_without_hints_keep_fluent_text():
    body = "<h1>Some head line</h1><p>This is the first paragraph of the story, long enough to be taken as text.</p><p>Then it ended.</p>" \
           "<p>And this is the last paragraph, which is also long enough, one would think.</p>"
    page = f"<body><div><a href=1>Home</a> <a href=2>News</a></div><div>{body}</div><div><a href=1>Imprint</a> | <a href=2>Contact</a></div>"
    assert main_text.extract(page).count("\n") == 3 and "Imprint" not in main_text.extract(page)


def test_minimum_cut_is_minimal():
    rng = random.Random(0)
    for _ in range(150):
        n = rng.randint(1, 7)
        source, sink = ([rng.choice((0, rng.random() * 3)) for _ in range(n)] for _ in range(2))
        links = {(a, b): rng.random() * 2 for a in range(n) for b in range(a + 1, n) if rng.random() < 0.6}

        def cost(side):
            ends = sum(sink[i] if s else source[i] for i, s in enumerate(side))
            return ends + sum(w for (a, b), w in links.items() if side[a] != side[b])

        best = min(map(cost, itertools.product((False, True), repeat=n)))
        assert cost(main_text.minimum_cut(source, sink, links)) == pytest.approx(best)


def test_minimum_cut_of_many_undecided_nodes():
    """A chain of weak terminals, against the cheapest labelling found from end to end."""
    rng = random.Random(4)
    for n, most in ((2_000, 0.3), (30_000, 0.3), (2_000, 3.0)):
        source, sink = ([rng.random() * most for _ in range(n)] for _ in range(2))
        links = {(i - 1, i): 1.0 for i in range(1, n)}
        best = [source[0], sink[0]]
        for i in range(1, n):
            best = [min(best[0], best[1] + 1) + source[i], min(best[1], best[0] + 1) + sink[i]]
        side = main_text.minimum_cut(source, sink, links)
        found = sum(b if s else a for s, a, b in zip(side, source, sink, strict=True)) + sum(a != b for a, b in itertools.pairwise(side))
        assert found == pytest.approx(min(best))


def test_long_page():
    page = "<article>" + "".join(f"<p>Paragraph number {i} of a very long page.</p>" for i in range(5000)) + "</article><footer>x</footer>"
    assert main_text.extract(page).count("\n") == 4999


def test_given_pages(spark, sf):
    def truth(page):
        inner = re.search(r"<article>(.*)</article>", page, re.S)[1]
        parts = (" ".join(html.unescape(re.sub(r"<[^>]*>", "", x)).split()) for x in re.split(r"</?(?:p|h1|br)\b[^>]*>", inner))
        return "\n".join(p for p in parts if p)

    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    rows = QUERIES["op4_main_text"](spark, sf).collect()
    assert len(rows) == len(pages)
    for r in rows:
        assert (r.text, r.n_chars) == (truth(pages[r.page_id]), len(r.text))


def test_tables(spark):
    rows = [(1, None, "x", "y"), (2, "<p>A page of text, as it is.</p>", None, "y"), (2, "<p>A page of text, as it is.</p>", None, "y"), (None, "", "x", None)]
    pages = spark.createDataFrame(rows, "page_id long, html string, text string, name string")
    found = main_text.main_text(pages)
    assert found.columns == ["page_id", "name", "text", "n_chars"]
    assert sorted(r.n_chars for r in found.collect()) == [0, 0, 25, 25]
    assert main_text.main_text(pages.limit(0)).count() == 0
