import time
import itertools
import re
from html import unescape

import numpy as np
import pytest

from ledgerlens.llm import htmltree as ht
from tests.llm.conftest import SF, same_columns


@pytest.fixture(scope="module")
def potentials():
    return ht.default_potentials()


def text(html, potentials):
    return ht.extract([html], potentials)[0]


def test_marginals_equal_the_sum_over_all_states():
    page = ht.parse("<body><nav><a>menu</a></nav><div><p>Some text. <b>More</b></p></div></body>")
    rng = np.random.default_rng(0)
    p = ht.Potentials(rng.normal(size=len(ht.NAMES)), rng.normal(size=(3, 2, 2)))
    f = ht.forest([page])
    n = len(f.parent)
    unary = np.bincount(f.of, p.node[f.features], minlength=n)
    weight, joint = np.zeros((n, 2)), np.zeros((n, 2, 2))
    for state in itertools.product((0, 1), repeat=n):
        w = np.exp(sum(unary[i] for i in range(n) if state[i])
                   + sum(p.edge[f.kind[i], state[f.parent[i]], state[i]] for i in range(1, n)))
        for i in range(n):
            weight[i, state[i]] += w
            if i:
                joint[i, state[f.parent[i]], state[i]] += w
    got, pairs = ht.marginals(f, p)
    assert np.allclose(got, weight[:, 1] / weight.sum(axis=1))
    assert np.allclose(pairs[1:], joint[1:] / joint[1:].sum(axis=(1, 2), keepdims=True))


def test_held_out_labelled_pages(potentials):
    pages = [ht.parse(h) for h in ht.labelled_pages(150, seed=777)]
    want = np.concatenate([ht.node_labels(p) for p in pages])
    f = ht.forest(pages)
    got = ht.marginals(f, potentials)[0] >= 0.5
    runs = f.kind == 0
    assert (got == want)[runs].mean() > 0.97


def test_articles_of_the_given_pages(spark, potentials):
    pages = spark.read.parquet(f"{SF.replace('0.001', '0.01')}/pages.parquet")
    for r in ht.extract_text(pages, potentials).collect():
        article = re.search("<article>(.*?)</article>", r["html"], re.S)[1]
        blocks = [" ".join(unescape(re.sub("<[^>]*>", " ", re.sub("</?b>", "", x))).split()) for x in re.split("</?(?:p|h1)>", article)]
        assert r["text"] == "\n\n".join(b for b in blocks if b)
        assert r["n_chars"] == len(r["text"])


def test_parts_around_the_article_go(potentials):
    around = {
        "menu": "<nav><ul><li><a href='/'>Gone home</a></li><li><a>Gone b</a></li></ul></nav>",
        "header": "<header><p>Gone title of site</p></header>", "footer": "<footer>&copy; Gone 2024. All rights.</footer>",
        "side": "<aside class='sidebar'><h3>Gone</h3><p>Gone related things to read.</p></aside>",
        "notice": "<div class='cookie-notice'><p>Gone cookies. We use them.</p></div>",
        "advert": "<div class='advert'>Gone buy now.</div>", "form": "<form class='newsletter'><label>Gone mail</label><button>Go</button></form>",
        "comments": "<section class='comments'><h3>Gone comments</h3><div class='comment'><p>Gone. I liked this a lot, thank you.</p></div></section>",
        "script": "<script>Gone = '<p>no</p>'</script><style>Gone{}</style><!-- Gone -->",
    }
    for html in around.values():
        body = "<article><h1>A title here</h1><p>First of all, some text. And more of it.</p>"
        rest = "<p>Second part of the text, also with a sentence.</p></article>"
        for page in (f"<body>{html}{body}{rest}</body>", f"<body>{body}{rest}{html}</body>"):
            assert text(page, potentials) == ("A title here\n\nFirst of all, some text. And more of it.\n\n"
                                              "Second part of the text, also with a sentence."), html


def test_lenient_parsing_and_white_space(potentials):
    page = ("<article><p>One &amp; two&nbsp;\n three&#33; <b>bold<br>next <i>x</i>.<p>No end tag, here too.</b></em>"
            "<ul><li>First item of it<li>Second item of it</ul>Loose text after the list, long enough.</article>")
    assert text(page, potentials).split("\n\n") == [
        "One & two three! bold next x.", "No end tag, here too.", "First item of it", "Second item of it",
        "Loose text after the list, long enough."]


def test_odd_pages(spark, potentials):
    long = "<article>" + "<p>A sentence of the article, with some words.</p>" * 20_000 + "</article>"
    deep = "<div>" * 3000 + "<p>text</p>"
    rows = [(1, "u", None), (2, None, ""), (3, "u", "   "), (4, "u", "<"), (5, "u", "<script>never closed <p>x"), (None, "u", long), (7, "u", deep),
            (8, "u", "no markup at all"), (8, "u", "no markup at all"), (9, "u", "<p \x00 class='\">&#xD800;&bogus; &#1114112;</p")]
    pages = spark.createDataFrame([r + ("x", "y", "z") for r in rows],
                                  "page_id bigint, url string, html string, text string, N_chars string, row string")
    found = ht.extract_text(pages, potentials)
    assert same_columns(pages, found, ["text", "n_chars"])
    got = [(r["page_id"], r["text"], r["n_chars"]) for r in found.collect()]
    assert len(got) == len(rows)
    by_id = {i: t for i, t, _ in got}
    assert by_id[1] == by_id[2] == by_id[3] == by_id[5] == ""
    assert by_id[None].count("\n\n") == 19_999
    assert all(t is not None and n == len(t) for _, t, n in got)
    assert ht.extract_text(pages.where("false"), potentials).count() == 0


def test_an_open_head_ends_where_it_must(potentials):
    article = "<article><h1>A title here</h1><p>First of all, some text. And more of it.</p></article>"
    want = "A title here\n\nFirst of all, some text. And more of it."
    inside = ("<title>Gone</title><meta name=x><link rel=y><style>Gone{}</style><script>Gone = 1</script>"
              "<noscript><img src=gone><p>Gone</p></noscript><template><div>Gone</div></template>\n ")
    for page in (f"<html><head>{inside}{article}</html>", f"<html><head>{inside}</head>{article}</html>",
                 f"<html><head>{inside}<body>{article}", f"<head><head>{inside}{article}", f"<html><head>{inside}<img src=x>{article}"):
        assert text(page, potentials) == want, page
    loose = ht.parse("<html><head><title>Gone</title>Loose text, not in an element.<p>More.</p></html>")
    assert [t for t in loose.text if t] == ["Loose text, not in an element.", "More."]


def test_unmarked_layouts():
    """Five pages on which no tag, class or id says where the article is."""
    line = "The harbour was quiet when the first boats came back that morning. Nobody had expected them before noon. "
    story = [line * n for n in (1, 2, 3, 1)]
    menu = '<div><a href="/">Home</a> <a href="/n">News</a> <a href="/s">Sport</a> <a href="/c">Contact</a></div>'
    foot = "<div>© 2024 Harbour News</div>"
    each = lambda before, after: "".join(before + x + after for x in story)
    pages = [
        menu + each("<div>", "</div>") + foot,
        f"<div>{menu}<div><div>{each('<p>', '</p>')}</div></div>{foot}</div>",
        f"<table><tr><td>{menu}</td></tr><tr><td>{'<br><br>'.join(story)}</td></tr><tr><td>{foot}</td></tr></table>",
        menu + each("<p>", "</p>") + foot,
        f"<div class='x1'><span>Harbour News</span>{menu}</div><div class='x2'>{each('<div><span>', '</span></div>')}</div>"
        "<div class='x3'><a href='/a'>About us</a> <a href='/p'>Privacy</a> © 2024</div>"]
    found = ht.extract([f"<html><body>{p}</body></html>" for p in pages], ht.default_potentials())
    assert [" ".join(t.split()) for t in found] == [" ".join("".join(story).split())] * 5


def test_deep_nesting_takes_time_in_proportion():
    text = "Deep text that is a full sentence of the story and long enough to be kept."
    start = time.perf_counter()
    page = ht.parse("<body><article><p>Above.</p>" + "<div>" * 100_000 + f"<p>{text}</p>")
    assert time.perf_counter() - start < 20 and page.text[-1] == text
    # A button hides an open paragraph from the blocks in it.
    page = ht.parse("<p>a<button>" + "<div>" * 20_000 + "b</button><li>c<li>d")
    assert [t for t in page.text if t] == ["a", "b", "c", "d"]
    assert [page.tag[page.parent[i]] for i, t in enumerate(page.text) if t] == ["p", "div", "li", "li"]
