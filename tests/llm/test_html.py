"""Main text of pages."""

import random
import time

import numpy as np
import pytest

from oddglass.llm import html_text as H

ARTICLE = "<article><h1>A title &amp; more</h1><p><b>First  line\n of text<br>goes on<p>Second&nbsp;one &#233; &lt;tag&gt;</p><p>Short.</p></article>"
TEXT = "A title & more\nFirst line of text goes on\nSecond one é <tag>\nShort."


def page(body):
    return f"<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t='</p><article>';</script></head><body>{body}</body></html>"


def test_chrome_goes():
    around = (
        "<header><a href='/'>Site name with several words</a></header><nav><ul><li><a href='/a'>One</a></li><li>Two words</li></ul></nav>"
        "<!-- ad <p>not this</p> --><div class=\"ad\">Buy a long list of many good things here today and tomorrow.</div><div id='cookie-notice'>We use cookies on this site.</div>{}"
        "<aside>Related reading that goes on for quite some time, with many words and no link.</aside><form>Name <input> <button>Send</button></form>"
        "<section class='comments'><p>I liked this very much, said a reader at some length, and went on.</p></section><footer>&copy; somebody</footer>")
    assert H.main_texts([page(around.format(ARTICLE))]) == [TEXT]
    inside = ARTICLE.replace("<p>Short.", "<div class='advert'>Buy this</div><p>Short.").replace("</article>", "<div class='post-comments'><p>Nice one.</p></div></article>")
    assert H.main_texts([page(around.format(inside))]) == [TEXT]


def test_without_article():
    long = " ".join(["plain words of a longer paragraph"] * 8)
    found = H.main_texts([page(f"<div><a href='/'>Home</a> <a href='/x'>Next</a></div><div><p>{long}</p><p>{long}</p></div><div><a href='/y'>About</a></div>")])
    assert found == [f"{long}\n{long}"]


def test_broken_markup():
    assert H.main_texts(["", "plain", "<p", "<!-- open", "<article>text only", "<script>never closed <p>x</p>", "</div></p><article><p>a</article>"])[4] == "text only"
    assert H.main_texts(["<article><p>1 < 2 and 3 > 2</p></article>"]) == ["1 < 2 and 3 > 2"]
    deep = "<div>" * 3000 + "<article><p>deep</p></article>"
    assert H.main_texts([deep]) == ["deep"]


def test_tree_fits_its_table():
    assert (H.tree().predict(H.LABELLED[:, :-1]) == H.LABELLED[:, -1]).all()
    assert len(H.ROWS) < 200 and set(np.unique(H.LABELLED[:, -1])) == {0, 1}


LONG = " ".join(["plain words of a longer paragraph"] * 8)


@pytest.mark.parametrize("body", [
    '<div class="content has-sidebar">{}</div>', '<div id="page" class="site sidebar-right"><article>{}</article></div>', '<form id="aspnetForm"><div id="content">{}</div></form>',
    '<div id="newsletter-archive"><article>{}</article></div>', '<div class="reply-to article">{}</div>', '<div class="widget-area"><main>{}</main></div>', '<div class="site-header-wrap">{}</div>',
])
def test_an_element_that_holds_the_page_is_no_menu(body):
    inner = f"<h1>The title</h1><p>{LONG}</p><p>Short.</p><p>{LONG}</p>"
    around = "<nav><a href='/'>Home</a></nav>{}<aside>Something else to read, said here at some length.</aside><footer>All rights</footer>"
    assert H.main_texts([page(around.format(body.format(inner)))]) == [f"The title\n{LONG}\nShort.\n{LONG}"]


def test_headers_and_notices_inside_the_text():
    body = f'<article><div class="post-header"><h1>The title</h1></div><p class="notice">Note this well.</p><p>{LONG}</p><div class="newsletter">Sign up for many letters now</div><div class="related"><p>Other things to read today</p></div></article>'
    assert H.main_texts([page(body)]) == [f"The title\nNote this well.\n{LONG}"]


def test_comments_and_teasers_in_articles_of_their_own():
    own = "".join(f'<article class="comment-body"><p>{LONG}</p></article>' for _ in range(6))
    teasers = '<div class="related"><article class="post"><h2>Other</h2><p>A teaser of some words.</p></article></div>'
    body = f'<article><h1>Title</h1><p>{LONG} {LONG}</p></article>{teasers}<section id="comments">{own}</section>'
    assert H.main_texts([page(body)]) == [f"Title\n{LONG} {LONG}"]


def test_short_blocks_between_long_ones_without_a_main_part():
    items = "<ul><li>First item</li><li>Second item</li></ul>"
    fourteen, fifteen = " ".join(["word"] * 14), " ".join(["word"] * 15)
    body = f"<div><a href='/'>Home</a></div><div><p>{LONG}</p>{items}<p>{LONG}</p><p>{fourteen}</p><p>{fifteen}</p><p>{LONG}</p></div><div><a href='/x'>About us</a></div>"
    assert H.main_texts([page(body)]) == ["\n".join([LONG, "First item", "Second item", LONG, fourteen, fifteen, LONG])]


def test_an_unclosed_button_ends_at_the_next_block():
    assert H.main_texts([f"<article><p>{LONG}</p><button>Share<p>{LONG}</p><button>Other</button></article>"]) == [f"{LONG}\n{LONG}"]
    assert H.main_texts([f"<article><p>before<button>x</button>after</p></article>"]) == ["before after"]


@pytest.mark.parametrize("piece", ["<a ", "<a href=\"", "<a '", "<div>", "</section>", "<div></p>", "<!", "<!--", "<svg>", "<button><p>", "<p class='ad'>", "<a b=\"<\" ", "<script", "&amp", "<select><div>"])
def test_time_grows_with_the_length(piece):
    """However a page is broken, twice the length is about twice the work: 1 MB in seconds."""
    text = piece * ((1 << 20) // len(piece))
    start = time.time()
    H.main_texts([text + "</button>"])
    assert time.time() - start < 8


def test_features_against_a_plain_reading():
    """Word counts, link densities and neighbours of simple pages, counted without the reader."""
    r = random.Random(4)
    for _ in range(20):
        parts = []
        for _ in range(r.randrange(1, 9)):
            words = [("w", r.random() < 0.3) for _ in range(r.randrange(1, 12))]
            parts.append(words)
        body = "".join("<p>" + " ".join(f"<a href='/'>{w}</a>" if linked else w for w, linked in p) + "</p>" for p in parts)
        x = H.features(H.blocks(body))
        n = [len(p) for p in parts]
        links = [sum(q for _, q in p) / len(p) for p in parts]
        plain = [k if q < 0.5 else 0 for k, q in zip(n, links)]
        for i in range(len(parts)):
            want = [n[i], links[i], n[i - 1] if i else 0, links[i - 1] if i else 0, n[i + 1] if i + 1 < len(n) else 0, links[i + 1] if i + 1 < len(n) else 0, 0, 0, 0, 0]
            assert x[i].tolist() == pytest.approx([*want, max(plain[max(0, i - 2):i], default=0), max(plain[i + 1:i + 3], default=0)])


def test_whole_table(spark):
    long = "<article>" + "<p>word word</p>" * 20000 + "</article>"
    made = [(1, "u", page(ARTICLE)), (1, "u", page(ARTICLE)), (2, None, None), (None, "v", ""), (3, "w", long)]
    df = spark.createDataFrame([(*m, "x", 5) for m in made], "page_id long, url string, html string, text string, n_chars int")
    got = sorted((r.page_id or 0, r.url or "", r.n_chars, r.text[:60]) for r in H.digest(df).collect())
    assert got == sorted([(1, "u", len(TEXT), TEXT[:60])] * 2 + [(2, "", 0, ""), (0, "v", 0, ""), (3, "w", 20000 * 10 - 1, ("word word\n" * 9)[:60])])
    assert H.digest(df.where("1 = 0")).count() == 0
