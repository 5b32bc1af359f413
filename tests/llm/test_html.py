import re
from html import unescape

import pytest

from siltstone.llm import html, queries

LONG = "The river is a line of water that runs to the sea, and it was there for as long as the hills have been in this land. "
FURNISHED = f"""<!doctype html><html><head><title>The title of the page</title><style>p{{x:y}}</style><script>var a="<article>";</script></head><body class="has-sidebar">
<header><h1>The Site</h1><form><input><button>Go</button></form></header><nav><a href=/>Home</a></nav><div id="cookie-notice">We use cookies and the like on this site for you.</div>
%s<aside><p>{LONG}</p></aside><section class="comments"><h2>Comments</h2><p>{LONG} says a reader</p></section><footer>&copy; all of it</footer></body></html>"""


def test_equals_the_article_element(spark, sf):
    """Brute force on the test pages: the text of the one article element."""
    pages = queries.read(spark, sf, "pages").collect()
    got = {r.page_id: r for r in queries.QUERIES["op3_html"](spark, sf).collect()}
    assert len(got) == len(pages)
    for p in pages:
        inner = re.search(r"<article>(.*?)</article>", p.html, re.S).group(1)
        want = " ".join(unescape(re.sub(r"<[^>]*>", " ", inner)).split())
        assert (got[p.page_id].text, got[p.page_id].n_chars, got[p.page_id].url) == (want, len(want), p.url)


@pytest.mark.parametrize("opening", ["<div>", '<div class="content no-sidebar">', '<section id=story class="post comments-open category-notice">', ""])
def test_equals_it_under_other_names(spark, sf, opening):
    """The rules find the same text where nothing says that it is an article."""
    closing = {"<d": "</div>", "<s": "</section>", "": ""}[opening[:2]]
    for p in queries.read(spark, sf, "pages").collect():
        inner = re.search(r"<article>(.*?)</article>", p.html, re.S).group(1)
        page = p.html.replace("<article>", opening).replace("</article>", closing)
        assert html.extract(page) == " ".join(unescape(re.sub(r"<[^>]*>", " ", inner)).split())


@pytest.mark.parametrize(
    "story",
    [
        '<div class="content no-sidebar">%s</div>', '<article class="post comments-open category-notice">%s</article>', "<form id=page>%s<input></form>",
        '<div class="related"><article>A teaser</article></div><div>%s</div>', f'<div class="related-stories"><article>{LONG}</article></div><div>%s</div>', "<div id=comments>%s</div>",
    ],
)
def test_names_count_as_a_whole(story):
    """A name that only holds a furniture word doesn't take the story out, nor does a name or form around all there is."""
    text = f"<h1>On rivers</h1><p>{LONG}</p><p>So it is.</p><p>{LONG}{LONG}</p>"
    page = "<header>The Site</header><nav><a href=/>Home</a></nav>" + story % text + f"<footer>{LONG}</footer>"
    assert html.extract(page) == f"On rivers {LONG.strip()} So it is. {LONG.strip()} {LONG.strip()}"


def test_readers_and_notices_go():
    page = f"<div><h1>On rivers</h1><p>{LONG}</p></div><ol class='comment-list'><li>{LONG}</li></ol><div id=cookieNotice>{LONG}</div><section class='siteSidebar'>{LONG}</section>"
    assert html.extract(page) == f"On rivers {LONG.strip()}"


def test_text_outside_of_articles():
    """Short notices beside an article go without any name, a story beside teasers stays."""
    assert html.extract(f"<p>{LONG}</p><article>{f'<p>{LONG}</p>' * 3}</article>") == " ".join([LONG.strip()] * 3)
    assert html.extract(f"<div>{f'<p>{LONG}</p>' * 3}</div><article>A teaser</article>").startswith(" ".join([LONG.strip()] * 3))


def test_headers():
    """Of the page, or of the text: those whose container goes on with prose stay, whatever holds both."""
    story = f"<p>{LONG}</p><p>{LONG}</p>"
    page = f"<body><div id=page><header><div><h1>The Site</h1></div><p>All the news of it</p></header><div class=content><div><header><h2>On rivers</h2></header>{story}</div></div></div></body>"
    assert html.extract(page) == f"On rivers {LONG.strip()} {LONG.strip()}"
    assert html.extract(f"<header><h1>The Site</h1></header>{story}") == f"{LONG.strip()} {LONG.strip()}"
    assert html.extract(f"<header><h1>The Site</h1></header><article><header><h1>On rivers</h1></header>{story}</article>") == f"On rivers {LONG.strip()} {LONG.strip()}"
    assert html.extract("<div>" + "<header>x</header>" * 20_000 + "</div>" + "<div><header>" * 2000 + "x") == ""


def test_languages_without_stop_words():
    text = "\u6cb3\u6d41\u5411\u6d77\u3002" * 40
    assert html.extract(f"<nav><a href=/>{text}</a></nav><div><h1>{text[:5]}</h1><p>{text}</p></div><footer>{text}</footer>") == f"{text[:5]} {text}"


def test_links_and_neighbours():
    links = "<p>" + "<a href=x>A link to another place</a> " * 3 + "</p>"
    page = f"<div><p>{LONG}</p><p>Near.</p></div><div>{links}<p>Beside links.</p>{links}</div><p>x</p><p>y</p><p>z</p><p>Far away.</p>"
    assert html.extract(page) == f"{LONG.strip()} Near."


def test_furniture_goes_and_short_blocks_stay():
    body = f"<article><h1>On rivers</h1><p>Short.</p><p>{LONG}</p><p>So it is.</p><div class='share'>Share this with a friend</div><p>{LONG}</p><p>End.</article>"
    want = f"On rivers Short. {LONG.strip()} So it is. {LONG.strip()} End."
    assert html.extract(FURNISHED % body) == want


def test_without_article_element():
    """Decided blocks carry the short ones next to them; what isn't near main text goes."""
    body = f"<div><h2>On rivers</h2><p>{LONG}</p><p>So it is.</p><p>{LONG}</p></div><div><p><a href=1>One link after another, long enough to be a paragraph of its own here</a></p></div>"
    assert html.extract(FURNISHED % body) == f"On rivers {LONG.strip()} So it is. {LONG.strip()}"


def test_only_block_of_an_article_is_kept():
    assert html.extract(FURNISHED % "<article><p><b>Sthe.<br></article>") == "Sthe."
    assert html.extract(FURNISHED % "<main><p>Sthe&nbsp;&amp;  x\n\ty &am</main>") == "Sthe & x y &am"


@pytest.mark.parametrize("page", ["<p>unclosed <b>bold", "<", "<<<p", "<p title='", "<script>never ends <p>x</p>", "<!-- never ends", "</div></div>", "<a href=\"<p>\">x", "&#0;&#xD800;&#99999999;", "<p>" * 3000, "<div>" * 3000 + "x", "\x00<p>\x00"])
def test_broken_markup(page):
    assert isinstance(html.extract(page), str)


def test_very_long_page():
    page = "<article>" + f"<p>{LONG}</p>" * 20_000 + "</article>"
    assert html.extract(page) == " ".join([LONG.strip()] * 20_000)
    assert isinstance(html.extract("<p a='" * 3000 + "x"), str)


def test_frames(spark):
    """Nulls, empty pages, copies, a clashing column, no rows."""
    df = spark.createDataFrame([(1, None, 5), (2, "", 6), (3, "<article>x</article>", 7), (3, "<article>x</article>", 7)], "page_id long, html string, text int")
    assert sorted((r.page_id, r.text) for r in html.extract_text(df).collect()) == [(1, ""), (2, ""), (3, "x"), (3, "x")]
    assert html.extract_text(df.where("false")).count() == 0
