"""Main text of hand-made pages, each with the text a reader would call the article."""

import re
import time

import pytest

from tidelog.llm import pages

P1 = "The river rose two metres in one night, and the lower streets were closed until noon. Nobody was hurt."
P2 = "Engineers had warned of it for years; the wall, built in 1911, was never meant for such a flood."
P3 = "The council meets on Monday to decide what is rebuilt first, and who pays."
Q1 = "Bread needs four things only: flour, water, salt and time. The last one matters most."
Q2 = "Mix them in the evening, fold the dough twice, and let it stand in a cool room until morning."
Q3 = "Bake it hot, on a stone, for forty minutes."
NAV = "<nav><ul><li><a href=/>Home</a><li><a href=/news>News</a><li><a href=/about>About us</a></ul></nav>"
DIVNAV = "<div class=menu><a href=/>Home</a> <a href=/news>News</a> <a href=/about>About us, and more.</a></div>"
HEAD = "<header><a href=/>The Daily Page</a><p>All the news, every day.</p></header>"
FOOT = "<footer><p>&copy; 2024 The Daily Page, all rights reserved. Imprint.</p></footer>"
ASIDE = "<aside><h3>Most read</h3><ul><li><a href=1>One story</a><li><a href=2>Another story</a></ul></aside>"
SIDEBAR = "<div id=sidebar><h3>Archive</h3><p>Older posts, by month. See the list, please.</p></div>"
COOKIE = "<div class='cookie-banner'><p>We use cookies, as all sites do. Please accept them, or not.</p><button>Accept</button></div>"
COMMENTS = "<section class=comments><h3>Comments</h3><p>What a night, really. I was there!</p><p>Nice text, thanks. More of this, please.</p></section>"
FORM = "<form action=/mail><label>Mail</label><input name=m><p>Sign up, it is free.</p><button>Send</button></form>"
SCRIPT = "<script>var x = '<p>Not text, at all.</p>';</script><style>p > a { color: red }</style>"


def paras(*texts):
    return "".join(f"<p>{t}</p>" for t in texts)


def page(*parts):
    return "<!DOCTYPE html><html><head><title>Some title, here.</title><meta charset=utf-8></head><body>" + "".join(parts) + "</body></html>"


FLOOD, BREAD = (P1, P2, P3), (Q1, Q2, Q3)
PAGES = {
    "article": (page(HEAD, NAV, "<article><h1>Flood</h1>", paras(*FLOOD), "</article>", ASIDE, FOOT), ["Flood", *FLOOD]),
    "main": (page(NAV, "<main><h1>Bread</h1>", paras(*BREAD), "</main>", FOOT, SCRIPT), ["Bread", *BREAD]),
    "plain body": (page("<h1>Flood</h1>", paras(*FLOOD)), ["Flood", *FLOOD]),
    "div content": (page(DIVNAV, "<div id=content><h1>Bread</h1>", paras(*BREAD), "</div>", SIDEBAR, FOOT), ["Bread", *BREAD]),
    "comments after": (page(NAV, "<div class=post><h2>Flood</h2>", paras(*FLOOD), "</div>", COMMENTS, FOOT), ["Flood", *FLOOD]),
    "comments inside": (page("<article><h1>Bread</h1>", paras(*BREAD), COMMENTS, "</article>", FOOT), ["Bread", *BREAD]),
    "long comments": (page("<article><h1>Bread</h1>", paras(*BREAD), "</article><div id=comments>", paras(*FLOOD * 4), "</div>"), ["Bread", *BREAD]),
    "comment articles": (page("<article><h1>Bread</h1>", paras(*BREAD), "<section><article>", paras(P3), "</article><article>", paras(P1), "</article></section></article>"), ["Bread", *BREAD]),
    "one comment": (page("<div class=text>", paras(P3, Q3), "</div><div class=comment><p>Reader says: nice, really. Yes.</p></div>"), [P3, Q3]),
    "cookie": (page(COOKIE, "<article>", paras(*FLOOD), "</article>"), list(FLOOD)),
    "form around": (page("<form id=aspnetForm>", NAV, "<div class=body><h1>Flood</h1>", paras(*FLOOD), "</div>", FOOT, "</form>"), ["Flood", *FLOOD]),
    "form after": (page("<div class=body><h1>Bread</h1>", paras(*BREAD), "</div>", FORM), ["Bread", *BREAD]),
    "two articles": (page("<main><article class=a><h2>Flood</h2>", paras(*FLOOD), "</article><article class=b><h2>Bread</h2>", paras(*BREAD), "</article></main>"), ["Flood", *FLOOD, "Bread", *BREAD]),
    "unlike articles": (page("<article class=a><h2>Flood</h2>", paras(*FLOOD), "</article><article class=b><h2>Bread</h2>", paras(Q1), "</article>"), ["Flood", *FLOOD, "Bread", Q1]),
    "teaser": (page("<div class=content><h1>Flood</h1>", paras(*FLOOD), "</div><article class=card><p>Read on</p></article>"), ["Flood", *FLOOD]),
    "teasers": (page("<article><h1>Flood</h1>", paras(*FLOOD), "</article><div class=related><article><h3>Bread</h3><p>Four things, and time.</p></article></div>"), ["Flood", *FLOOD]),
    "has sidebar": (page("<div class='site has-sidebar'><article><h1>Flood</h1>", paras(*FLOOD), "</article></div>", SIDEBAR), ["Flood", *FLOOD]),
    "comments open": (page("<main class='post comments-open'><h1>Bread</h1>", paras(*BREAD), "</main>"), ["Bread", *BREAD]),
    "sidebar around": (page("<div class=sidebar>", paras(*FLOOD), "</div>"), list(FLOOD)),
    "post header": (page("<article><div class=post-header><h1>Bread</h1></div>", paras(*BREAD), "</article>"), ["Bread", *BREAD]),
    "header in post": (page(HEAD, "<div class=post><header><h1>Bread</h1></header>", paras(*BREAD), "</div>"), ["Bread", *BREAD]),
    "link list": (page("<article><h1>Flood</h1>", paras(*FLOOD), "<ul><li><a href=1>More on floods</a><li><a href=2>More on rain</a></ul></article>"), ["Flood", *FLOOD]),
    "text list": (page("<article><h1>Bread</h1>", paras(Q1, Q2), "<ul><li>500 g flour<li>350 g water, <a href=w>soft</a></ul>", paras(Q3), "</article>"), ["Bread", Q1, Q2, "500 g flour", "350 g water, soft", Q3]),
    "list in div": (page(DIVNAV, "<div class=c><h1>Bread</h1>", paras(Q1, Q2), "<ul><li>500 g flour<li>350 g water</ul>", paras(Q3), "</div>"), ["Bread", Q1, Q2, "500 g flour", "350 g water", Q3]),
    "advert inside": (page("<article>", paras(P1), "<div class=ad>Buy now, it is cheap. Really, do.</div>", paras(P2, P3), "</article>"), [P1, P2, P3]),
    "aside inside": (page("<article>", paras(P1), "<aside>A box, beside the text.</aside>", paras(P2, P3), "</article>"), [P1, P2, P3]),
    "title before": (page(NAV, "<h1>Flood</h1><article>", paras(*FLOOD), "</article>"), ["Flood", *FLOOD]),
    "linked title": (page("<article><h1><a href=/f>Flood</a></h1>", paras(*FLOOD), "</article>"), ["Flood", *FLOOD]),
    "quote": (page("<div class=post><p>", Q1, "</p><blockquote><p>", P2, "</p></blockquote><p>", Q2, "</p></div>", SIDEBAR), [Q1, P2, Q2]),
    "share": (page("<article><h1>Bread</h1><div class='social-share'>Share this, with friends.</div>", paras(*BREAD), "</article>"), ["Bread", *BREAD]),
    "hidden": (page("<article>", paras(*FLOOD), "<p hidden>Not shown, ever.</p><p style='display: none'>Nor this, at all.</p></article>"), list(FLOOD)),
    "role main": (page("<div role=navigation>Go home, or away.</div><div role=main><h1>Bread</h1>", paras(*BREAD), "</div><div role=contentinfo>Imprint, and so on.</div>"), ["Bread", *BREAD]),
    "unclosed": (page("<article><h1>Flood<p>", P1, "<p>", P2, "<p>", P3), ["Flood", *FLOOD]),
    "only menus": (page(NAV, FOOT, COOKIE), []),
}


@pytest.mark.parametrize("name", sorted(PAGES))
def test_page(name):
    html, want = PAGES[name]
    assert pages.main_text(html).split("\n") == (want or [""])


def test_precision_and_recall_of_words():
    words = lambda t: re.findall(r"\w+", t)
    got = [(words(pages.main_text(html)), words("\n".join(want))) for html, want in PAGES.values()]
    hit = sum(len([w for w in g if w in set(t)]) for g, t in got)
    assert hit >= 0.98 * sum(len(g) for g, _ in got)
    assert sum(len([w for w in t if w in set(g)]) for g, t in got) >= 0.98 * sum(len(t) for _, t in got)


@pytest.mark.parametrize(
    "html",
    ["<p" * 500_000, "<div>" * 200_000 + "x", "<div>a, b." * 100_000, "<div>" * 100_000 + "</p>" * 100_000, '<a =">" ' * 120_000, '<a href="x>' * 90_000, "<div class=comment>a" * 50_000, "<" * 1_000_000]
    + ["<!-- " * 200_000, "<svg>" * 200_000, "<p>" * 300_000, "<main>a b, c. " * 60_000, "<main><article>a b, c. " * 40_000, "<div " + "a=b " * 250_000 + ">", "".join(f"<div class=c{i}>text, number {i}." for i in range(25_000))],
    ids=range(15),
)
def test_a_megabyte_of_broken_markup(html):
    began = time.process_time()
    pages.main_text(html)
    assert time.process_time() - began < 4  # a second or less on a free machine


def test_open_quotes_and_tags():
    assert pages.main_text(f'<p>{P1}</p><a href="x>link</a><p>{P2}</p>') == f"{P1}\n{P2}"
    assert pages.main_text(f"<p>{P1}</p><p title=it's>{P2}</p>") == f"{P1}\n{P2}"
    assert pages.main_text(f"<p>{P1}</p><p>{P2} <a hre") == f"{P1}\n{P2}"
    assert pages.main_text("1 < 2, and 3 > 2 &lt; 4") == "1 < 2, and 3 > 2 < 4"
