import html
import itertools
import random
import re
import time

import numpy as np
import pytest

from pagelattice.llm import html_text as H


@pytest.fixture(scope="module")
def field():
    return H.trained()


def _texts(page):
    return [b.text for b in H.blocks(page)]


def test_blocks():
    assert _texts("<p>a<p>b<b>c</b> d<br>e<div>f</div>g") == ["a", "bc d e", "f", "g"]
    assert _texts("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>") == ["a", "b", "c", "d"]
    assert _texts('<script>var t="</p>";</script><style>p{}</style>x<!-- <p>no -->y') == ["xy"]
    assert _texts("&lt;p&gt; &amp &eacute;&nbsp;&#8217;  z\n\t w") == ["<p> & é ’ z w"]
    assert _texts('<p title="a>b">t</p><p title=\'x>\'>u') == ["t", "u"]
    assert _texts("") == _texts(None) == _texts("<p></p> <div>\n</div>") == []
    assert _texts("a < b and c <3 <p>d") == ["a < b and c <3", "d"]
    assert _texts("<p>cut &am") == ["cut &am"] and _texts("<p>x<scr") == ["x"]
    assert _texts("<script>never closed <p>x") == [] and _texts("x<!-- open <p>y") == ["x"]
    assert _texts("<table><tr><td>a<td>b<tr><td>c</table>") == ["a", "b", "c"]
    assert _texts("</div></p>x</body>") == ["x"]


def test_paths_and_links():
    found = H.blocks('<body><div class="Menu-2 top" id=nav><a href="/x">one two</a></div><p>three <a href="#">four</a></body>')
    assert found[0].path == ("body", "div", ".menu", ".top", ".nav") and found[0].linked == 7
    assert found[1].path == ("body", "p") and found[1].linked == 4


def test_viterbi_is_the_best_of_all(field):
    rng = np.random.default_rng(2)
    pages = [p for p, _ in H.labelled_pages(60, seed=5) if 0 < len(p) <= 9]
    assert pages
    for page in pages:
        total = len(page)

        def score(labels):
            s = field.first[labels[0]]
            for n, (b, y) in enumerate(zip(page, labels)):
                key = H.text_key(b, n, total)
                names = [field._known(f) for f in H.path_features(b.node) + H.text_features(key) + H.pair_features(b.node, key)]
                s += sum(field.weights[f][y] for f in names if f in field.weights)
                s += field.moves[labels[n - 1], y] if n else 0
            return s

        best = max(itertools.product((0, 1), repeat=total), key=score)
        assert np.isclose(score(best), score(field.decode(page)))
    assert field.decode([]) == [] and rng is not None


def test_held_out_pages(field):
    right = total = 0
    for page, labels in H.labelled_pages(200, seed=77):
        right += sum(a == b for a, b in zip(field.decode(page), labels))
        total += len(labels)
    assert right / total > 0.97


def _plain(page):
    inner = re.search(r"<article>(.*?)(?:</article>|$)", page or "", re.S)
    out = []
    for part in re.split(r"</?(?:p|h1|article|footer|body|html)>", inner.group(1) if inner else ""):
        text = " ".join(html.unescape(re.sub(r"<[^>]*>", "", part.replace("<br>", " "))).split())
        if text:
            out.append(text)
    return "\n".join(out)


def test_pages_table(spark):
    sf = "/root/testdata/sf0.01"
    pages = {r.page_id: r for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    rows = H.op2_html_text(spark, sf).collect()
    assert len(rows) == len(pages)
    for r in rows:
        assert r.text == _plain(pages[r.page_id].html) and r.n_chars == len(r.text) and r.url == pages[r.page_id].url


@pytest.mark.parametrize(
    "part",
    [
        "<nav><ul><li><a href='/'>Home page</a></li><li><a href='/b'>Other things</a></li></ul></nav>", "<header><p>The site of all sites</p></header>",
        "<footer><p>Copyright 2020 by somebody</p></footer>", "<aside><p>You may also like this fine story.</p></aside>",
        '<div class="cookie-banner"><p>We use cookies on this site.</p></div>', '<div class="ad">Buy this thing now.</div>',
        "<form><p>Write your name here</p><button>Send</button></form>", '<div class="comments"><p>I think this is a very good text, thanks.</p></div>',
        '<div class="sidebar"><p>More from the author of this text.</p></div>',
    ],
)
def test_boilerplate_goes(field, part):
    body = "<h1>A title</h1><p>First sentence, with words.</p><p>Second one follows here.</p>"
    page = f"<html><body>{part}<article>{body}</article>{part}</body></html>"
    assert H.main_text(page, field)[0] == "A title\nFirst sentence, with words.\nSecond one follows here."


BODY = "<p>First sentence, with words.</p><p>Second one {} follows here.</p>"
PLAIN = "First sentence, with words.\nSecond one follows here."


@pytest.mark.parametrize("site", ["", "<header><p>The site of all sites</p></header>"])
def test_an_articles_own_head_stays(field, site):
    body = BODY.format("")
    for page in (f"<article><header><h1>A title of it</h1></header>{body}</article>", f"<main><header><h1>A title of it</h1></header>{body}</main>"):
        assert H.main_text(f"<body>{site}{page}</body>", field)[0] == f"A title of it\n{PLAIN}"


@pytest.mark.parametrize("phrase", ['<span class="ad">Buy this now!</span>', '<a class="sponsored" href="#">Some <a>other</a> page</a>', '<b class="promo">Half price</b>'])
def test_phrase_adverts_go(field, phrase):
    assert H.main_text(f"<article><h1>A title</h1>{BODY.format(phrase)}</article>", field)[0] == f"A title\n{PLAIN}"


@pytest.mark.parametrize("how", ["hidden", 'hidden=""', 'style="display: none"', "style='color:red;DISPLAY:NONE'", "style=visibility:hidden"])
def test_hidden_parts_do_not_show(field, how):
    part = f"<div {how}>Not seen <p>at all</p> here.</div>"
    page = f"<article><h1>A title</h1>{part}{BODY.format(f'<span {how}>not <span>this</span> one</span>')}{part}</article>"
    assert H.main_text(page, field)[0] == f"A title\n{PLAIN}"
    assert _texts(f'<p class="hidden" title="hidden">seen<p {how}>not') == ["seen"]


def test_deep_and_broken_pages_take_linear_time(field):
    for page in ("<div>a" * 170_000, "<x>" * 150_000 + "</y>" * 150_000, "<dd><div>" + "<x>" * 90_000 + "<dt>a</dt>" * 60_000, '<span class="ad">a' * 50_000, "<p title='" + "\"'" * 400_000):
        began = time.process_time()
        H.main_text(page, field)
        assert time.process_time() - began < 20


def _foreign(rng, words):
    """Pages in layouts that the training pages do not have: custom elements, tables, no article, long menus."""
    def sentence(low, high):
        return " ".join(rng.choice(words) for _ in range(rng.randint(low, high))).capitalize() + "."

    paragraphs = [" ".join(sentence(5, 16) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(3, 8))]
    body = "".join(f"<p>{x}</p>" for x in paragraphs)
    menu = "".join(f"<li><a href='#'>{rng.choice(words)}</a>" for _ in range(rng.randint(4, 12)))
    kind = rng.randrange(4)
    if kind == 0:
        page = f"<div role=navigation><ul>{menu}</ul></div><div role=main>{body}</div><div role=contentinfo><p>{sentence(3, 8)}</p></div>"
    elif kind == 1:
        page = f"<site-menu><ul>{menu}</ul></site-menu><story-text>{body}</story-text><footer><a href='#'>{sentence(1, 3)}</a></footer>"
    elif kind == 2:
        page = f"<table><tr><td class=nav><ul>{menu}</ul><td class=text>{body}</table><div class=copyright>&copy; 2020 {sentence(2, 4)}</div>"
    else:
        page = f"<div class=top-menu><ul>{menu}</ul></div><div class=page><div class=text>{body}</div><aside class=teasers><a href='#'>{sentence(2, 6)}</a></aside></div>"
    return f"<html><body>{page}</body></html>", paragraphs


def test_layouts_that_training_lacks(field):
    rng = random.Random(8)
    words = "the old river runs under seven stone bridges while traders count their morning coins near market gates".split()
    hit = kept = wanted = 0
    for _ in range(200):
        page, paragraphs = _foreign(rng, words)
        lines = H.main_text(page, field)[0].split("\n")
        hit += len(set(lines) & set(paragraphs))
        kept += len(lines)
        wanted += len(paragraphs)
    assert hit / wanted > 0.9 and hit / kept > 0.9, (hit / wanted, hit / kept)


def test_odd_rows(spark):
    long_page = "<article>" + "<p>A sentence of words.</p>" * 20_000 + "</article>"
    rows = [(1, "u", None), (2, None, ""), (None, "u", "<article><p>Some text here.</p></article>"), (4, "u", long_page), (4, "u", long_page), (5, "u", "plain")]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, text string")
    got = H.extract_rows(pages).collect()
    assert len(got) == 6 and all(r.n_chars == len(r.text) for r in got)
    assert [r.text for r in got if r.page_id in (1, 2)] == ["", ""]
    assert all(r.n_kept == 20_000 for r in got if r.page_id == 4)
    assert [r.text for r in got if r.page_id is None] == ["Some text here."]
    assert H.extract_rows(pages.limit(0)).collect() == []
