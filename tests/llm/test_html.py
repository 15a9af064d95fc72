"""HTML extraction of generated pages with known article text, odd markup, and time linear in the page."""

from __future__ import annotations

import html
import random
import time

import pytest

from corpusloom.llm import html_extract

WORDS = "the of and with from that this river stone winter market letter garden paper cloud morning étude naïve straße 2024 3.5 & < >".split()
JUNK = [
    '<nav><ul><li><a href="/a">Home</a><li><a href="/b">News of the day, and more</a></ul></nav>',
    '<header><h1>Site name</h1><p>A slogan, for all, that is long enough to count.</p></header>',
    '<div id="cookie-notice"><p>We use cookies, please, accept them, all of them, right now, thanks.</p></div>',
    '<div class="ad">Buy these things now, they are good, cheap, and yours.</div>',
    '<aside class="sidebar"><p>Related, things, to read, in this sidebar, that is quite long.</p></aside>',
    '<script>var x = "<p>not text, at all, never, ever, in any way</p>";</script><style>p > a{color:red}</style>',
    '<form action="/s"><label>Search</label><input name=q><p>Type here, and press the button, please.</p><button>Go</button></form>',
    '<footer><p>&copy; All rights, reserved, by someone, somewhere, in some year.</p></footer>',
    '<div class="comments"><p>Reader says, that this, was great, and wonderful, truly so great.</p></div>',
    "<!-- a comment > with <p>markup</p> -->",
    '<div class="share-tools"><a href="x">Share this on some network</a></div>',
]
WRAPPERS = [
    "<article>{}</article>", '<div class="content">{}</div>', "<main>{}</main>", '<div class="post has-sidebar">{}</div>',
    "<div><div>{}</div></div>", '<table><tr><td class="main">{}</td></tr></table>', '<section id="story">{}</section>',
    '<form id="aspnetForm" method=post><div class="body">{}</div></form>', '<div class="left-side-content"><article>{}</article></div>',
]


def sentence(rng, least):
    words = [rng.choice(WORDS) for _ in range(rng.randint(least, least + 30))]
    return " ".join(words).capitalize() + rng.choice((".", "!", ", and so on."))


def marked(rng, text):
    """The text with inline markup, references and odd white space that must come out as it went in."""
    out = []
    for word in text.split(" "):
        shown = html.escape(word, quote=rng.random() < 0.5)
        if rng.random() < 0.1:
            tag = rng.choice(("b", "i", "em", 'span class="x"', 'a href="?a=1&b=2" title="a > b"'))
            shown = f"<{tag}>{shown}</{tag.split(' ')[0]}>"
        out.append(shown.replace("é", rng.choice(("é", "&eacute;", "&#233;", "&#xE9;"))))
    return "".join(w + rng.choice((" ", "\n  ", " ", "&nbsp;", "<!-- c -->\t")) for w in out[:-1]) + out[-1]


def made(rng):
    """A page and its article's blocks."""
    blocks, parts = [], []
    for k in range(rng.randint(3, 12)):
        kind = rng.choice(("p", "p", "p", "open", "h2", "ul", "quote", "br", "weak", "table", "figure", "short", "linked"))
        text = sentence(rng, 12)
        if kind == "table":
            cells = [[sentence(rng, 3) for _ in range(2)] for _ in range(rng.randint(1, 3))]
            parts.append("<table>" + "".join("<tr>" + "".join(f"<td>{marked(rng, x)}</td>" for x in row) + "</tr>" for row in cells) + "</table>")
            blocks += [x for row in cells for x in row]
            continue
        if kind == "figure":
            parts.append(f'<figure><img src="x.png" alt="no text"><figcaption>{marked(rng, text)}</figcaption></figure>')
            blocks.append(text)
            continue
        if kind in ("short", "linked"):
            if not 0 < len(parts) < 3:  # between others, without a full stop
                continue
            text = " ".join(rng.choice("and so it goes on here again".split()) for _ in range(4))
            parts.append(f"<p>{text}</p>" if kind == "short" else f'<p>see <a href="x">{text}</a> there</p>')
            blocks.append(text if kind == "short" else f"see {text} there")
            parts.append(f"<p>{marked(rng, (more := sentence(rng, 20)))}</p>")
            blocks.append(more)
            continue
        if kind == "ul":
            items = [sentence(rng, 4) for _ in range(rng.randint(1, 4))]
            parts.append("<ul>" + "".join(f"<li>{marked(rng, x)}" + rng.choice(("</li>", "")) for x in items) + "</ul>")
            blocks += items
            continue
        if kind == "br":
            more = sentence(rng, 8)
            parts.append(f"<p>{marked(rng, text)}<br/>{marked(rng, more)}</p>")
            blocks += [text, more]
            continue
        form = {"p": "<p>{}</p>", "open": "<p>{}\n", "h2": "<h2>{}</h2>", "quote": "<blockquote><p>{}</p></blockquote>", "weak": '<p class="share related">{}</p>'}[kind]
        parts.append(form.format(marked(rng, text)))
        blocks.append(text)
        if rng.random() < 0.2:
            parts.append(rng.choice(JUNK))
    if rng.random() < 0.4:  # the article in several containers beside each other
        article = "".join(f"<{tag}>{x}</{tag}>" if x.startswith("<p>") and "<p>" not in x[3:] and x.endswith("</p>") and len(x) > 400 else x for x in parts for tag in [rng.choice(("div", "section"))])
        article = f'<div id="outer">{article}</div>'
    else:
        article = rng.choice(WRAPPERS).format("".join(parts))
    around = [rng.choice(JUNK) for _ in range(rng.randint(0, 6))]
    at = rng.randint(0, len(around))
    body = "".join([*around[:at], article, *around[at:]])
    return f"<!DOCTYPE html><html><head><title>T</title></head><body>{body}</body></html>", blocks


@pytest.mark.parametrize("seed", range(150))
def test_generated_pages(seed):
    page, blocks = made(random.Random(seed))
    assert html_extract.main_text(page) == "\n".join(blocks)


N = 1_000_000
LONG = {
    "unclosed tags": "<a " * (N // 3),
    "unclosed quotes": "<a b=\"<a c='" * (N // 12),
    "one open quote": "<p title=\"x>" + "<b class='y'>text</b> " * (N // 22),
    "nested inline": "<b>" * (N // 14) + "<p>text</p>" * (N // 14),
    "nested text": "<i>word " * (N // 8),
    "stray end tags": "<span>" * (N // 16) + "</em></div>" * (N // 16),
    "list items": "<li><ul>" + "<b>" * (N // 20) + "<li>x</li>" * (N // 20),
    "divs": "<div>some text of a div " * (N // 24),
    "comments": "<!-- " * (N // 5),
    "scripts": "<script" * (N // 7),
    "attributes": "<p " + "class = " * (N // 8) + ">x",
    "less-than signs": "a < b " * (N // 6),
}


@pytest.mark.parametrize("name", LONG)
def test_long_pages_take_linear_time(name):
    start = time.perf_counter()
    html_extract.main_text(LONG[name])
    assert time.perf_counter() - start < 20


def test_no_block_is_lost():
    first, last = "A first block, that is rather long, with commas, and words enough to be scored.", "A short closing paragraph, in a div of its own, that ends the article."
    assert html_extract.main_text(f"<body><div><p>{first}</p><p>{first}</p></div><div><p>{last}</p></div></body>") == f"{first}\n{first}\n{last}"
    assert html_extract.main_text(f'<body><form id="f"><div><p>{first}</p><p>{last}</p><input><button>Go</button></div></form></body>') == f"{first}\n{last}"
    for name in ("side", "search", "share", "related", "tags"):
        assert html_extract.main_text(f'<article><p>{first}</p><p class="{name}">{last}</p></article>') == f"{first}\n{last}"
    assert html_extract.main_text(f'<article><p title="some hidden gems" data-id="sidebar">{first}</p><p hidden>{last}</p></article>') == first
    assert html_extract.main_text(f"<p>{first}</p><p>tail <b") == f"{first}\ntail"


LONGER = "A paragraph of the article, with commas, and words enough, so that it is scored, as it should be."


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (f"<div><p>{LONGER}</p></div><h2>Second part</h2><div><p>{LONGER}</p></div>", [LONGER, "Second part", LONGER]),
        (f"<div><p>{LONGER}</p></div><ul><li>One thing</li><li>Another thing</li></ul><div><p>{LONGER}</p></div>", [LONGER, "One thing", "Another thing", LONGER]),
        (f"<div><p>{LONGER}</p><p>{LONGER}</p></div><table><tr><td>A cell of this.</td><td>And that, too.</td></tr></table>", [LONGER, LONGER, "A cell of this.", "And that, too."]),
        (f"<h1>The title</h1><div><p>{LONGER}</p></div>", ["The title", LONGER]),
        (f"<div><p>{LONGER}</p></div><p>And so on</p><div><p>{LONGER}</p></div>", [LONGER, "And so on", LONGER]),
        (f'<div><p>{LONGER}</p></div><p><a href="x">A long link that is most of it</a> here</p><div><p>{LONGER}</p></div>', [LONGER, "A long link that is most of it here", LONGER]),
        (f"<div><p>{LONGER}</p></div> bare words <b>and bold</b> <div><p>{LONGER}</p></div>", [LONGER, "bare words and bold", LONGER]),
        (f'<div><p>{LONGER}</p></div><ul><li><a href="x">Home</a></li><li><a href="y">News</a></li></ul><div><p>{LONGER}</p></div>', [LONGER, LONGER]),
        (f"<article><header><h1>Title</h1></header><p>{LONGER}</p><header><p>{LONGER}</p></header></article>", ["Title", LONGER]),
        (f"<article><p>{LONGER}</p><div class='dialog'>She said that it was so.</div><p>{LONGER}</p></article>", [LONGER, "She said that it was so.", LONGER]),
        (f"<article><p>{LONGER}</p><p>A <label>label of words</label> in a paragraph.</p><p>{LONGER}</p></article>", [LONGER, "A label of words in a paragraph.", LONGER]),
        (f"<article><p>{LONGER}</p><p>{LONGER}</p><section class='related-work'><h2>Related work</h2><p>{LONGER}</p></section></article>", [LONGER, LONGER, "Related work", LONGER]),
        (f"<article><p>{LONGER}</p><div class='related'><h3>More</h3><a href='x'>Another story of the day, and more.</a></div></article>", [LONGER]),
        (f"<form><label>Name</label><input><p>{LONGER}</p></form><article><p>{LONGER}</p><p>{LONGER}</p></article>", [LONGER, LONGER]),
        (f"<div id=w><div class=a><div><p>{LONGER}</p><p>{LONGER}</p></div></div><div class=b><p>{LONGER}</p></div></div>", [LONGER, LONGER, LONGER]),
        (f"<nav><p>{LONGER}</p></nav><div><p>{LONGER}</p></div><footer><p>{LONGER}</p></footer><div><p>{LONGER}</p></div>", [LONGER, LONGER]),
    ],
)
def test_all_blocks_of_the_article_stay(page, text):
    assert html_extract.main_text(f"<html><body>{page}</body></html>") == "\n".join(text)


def test_an_empty_table_and_odd_rows(spark):
    kind = "page_id long, url string, html string, text string, n_chars string"
    assert html_extract.extract(spark.createDataFrame([], kind)).collect() == []
    rows = [(1, "u", None, "x", "y"), (None, None, "", "x", "y"), (2, "v", f"<p>{LONGER}</p>", "x", "y"), (2, "v", f"<p>{LONGER}</p>", "x", "y")]
    found = html_extract.extract(spark.createDataFrame(rows, kind)).collect()
    assert sorted(((r["page_id"] or 0, r["text"], r["n_chars"]) for r in found)) == [(0, "", 0), (1, "", 0), (2, LONGER, len(LONGER)), (2, LONGER, len(LONGER))]
