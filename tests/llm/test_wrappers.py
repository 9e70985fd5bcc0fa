"""Wrappers by alignment: slots, constants, repeated and optional groups, main regions, names and odd pages."""

import random
import time

import pytest

from marketsig.llm import extract
from marketsig.llm.extract import CRC, KIDS, LABEL, PAGES, REPEATED, Settings, infer, main_region, main_text

S = Settings()
WORDS = [a + b for a in "ba ke li mo nu ra se ti vo zu".split() for b in "la ne ri so tu".split()]


def _words(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def _page(rng, extra=""):
    """A page without a telling name: a menu of varying links, a story, a constant line, a varying foot."""
    menu = "".join(f'<li><a href="/{i}">{_words(rng, 2)}</a></li>' for i in range(rng.randint(3, 6)))
    story = [_words(rng, 30) for _ in range(rng.randint(2, 5))]
    html = (f"<html><body><div><ul>{menu}</ul></div><div class=x>{extra}<h1>{_words(rng, 4)}</h1>" + "".join(f"<p>{p}</p>" for p in story)
            + f"<div>Read this site daily</div></div><table><tr><td>{_words(rng, 2)}</td></tr></table></body></html>")
    return html, story


def _parsers(pages, settings=S):
    return [extract.Parser(w, settings.least_pages) for w in infer(pages, settings)]


def test_alignment_makes_slots_constants_and_groups():
    rng = random.Random(1)
    made = infer([_page(rng, "<div>a note</div>" if i % 2 else "")[0] for i in range(6)], S)
    assert len(made) == 1
    region = main_region(made[0], S.least_pages)
    assert region[LABEL] == "div.x"
    shape = [(k[LABEL], k[REPEATED], k[PAGES]) for k in region[KIDS]]
    assert ("div", False, 3) in shape and ("#", False, 6) in shape and ("#", True, 6) in shape  # the optional note, the heading, the story
    assert [k[CRC] is not None for k in region[KIDS][-1][KIDS]] == [True]  # the constant line
    menu = made[0][KIDS][0][KIDS][0]
    assert menu[LABEL] == "ul" and [k[REPEATED] for k in menu[KIDS]] == [True]


def test_the_alignment_decides_the_text():
    rng = random.Random(2)
    pages = [_page(rng) for _ in range(8)]
    parsers = _parsers([h for h, _ in pages])
    for html, story in pages:
        got = main_text(html, parsers).split("\n")
        assert got[1:] == story  # heading, story; no menu, no constant line, no foot
        assert len(main_text(html, []).split("\n")) > len(got)  # without a wrapper all texts stay


def test_further_wrappers_for_other_pages():
    rng = random.Random(3)
    other = [f"<section><table><tr><td>{_words(rng, 20)}</td><td>{_words(rng, 3)}</td></tr></table></section>" for _ in range(4)]
    assert len(infer([_page(rng)[0] for _ in range(4)] + other, S)) == 2


@pytest.mark.parametrize("html, text", [
    ('<div class="layout has-sidebar"><article><p>whole story</p></article></div>', "whole story"),
    ('<div class="no-comments"><main><p>whole story</p></main></div>', "whole story"),
    ('<article class="post social-science"><p>whole story</p></article>', "whole story"),
    ('<div class="sidebar"><article><p>whole story</p></article></div><p>else</p>', "whole story"),
    ('<article><header><h1>Head</h1><div>by me</div></header><p>one <span class="notice">kept</span> sentence</p></article>', "Head\none kept sentence"),
    ('<article><p>a</p><div class="post-comments">no</div><nav>no</nav><form>no</form></article><footer>no</footer>', "a"),
    ('<aside><article><p>teaser</p></article></aside><article><p>story</p></article>', "story"),
    ('<div class="site-footer">no</div><div role="navigation">no</div><p>text<span hidden>no</span> on</p>', "text\non"),
    ("<script>var a = '<p>no</p>'</script><noscript>no</noscript><nav>no</nav>", ""),
])
def test_names(html, text):
    for parsers in ([], _parsers([html])):
        assert main_text(html, parsers) == text


def test_copies_show_nothing_and_constants_never_take_all():
    rng = random.Random(4)
    html, story = _page(rng)
    near = [html.replace("</table>", f"</table><i>{i}</i>") for i in range(5)]
    assert infer(near, S)[0][PAGES] == 1
    assert set(story) <= set(main_text(near[2], _parsers(near)).split("\n"))
    pages = [_page(rng)[0] for _ in range(4)]
    assert main_text("<div class=x><div>Read this site daily</div></div>", _parsers(pages)) == "Read this site daily"


def test_long_deep_and_broken_pages_take_linear_time():
    start = time.time()
    rng = random.Random(5)
    parsers = _parsers([_page(rng)[0] for _ in range(4)])
    long = "<article>" + "<p>some words here</p>" * 50_000 + "</article>"
    assert main_text(long, parsers).count("\n") == 49_999
    deep = "<div>" * 20_000 + "deep" + "</div>" * 20_000
    assert main_text(deep, parsers) == "deep" and infer([deep], S) == []
    broken = "<div>" * 40_000 + "</span>" * 40_000 + "text"
    assert main_text(broken, parsers) == "text"
    assert time.time() - start < 60


def test_extraction_runs_by_host(spark):
    rng = random.Random(6)
    pages = [(i, f"http://h.example/{i}", *_page(rng)) for i in range(9)]
    rows = [(i, u, h) for i, u, h, _ in pages] + [(0, *pages[0][1:3]), (50, None, None), (None, "http://h.example/", ""), (51, "http://lone.example", pages[1][2])]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], "page_id long, url string, html string, wrappers string, host string")
    got = extract.extract(df).collect()
    assert len(got) == len(rows)
    by = {r.page_id: r.text for r in got}
    assert all(by[i].split("\n")[1:] == story for i, _, _, story in pages)
    assert by[50] == by[None] == "" and set(pages[1][3]) < set(by[51].split("\n"))


def test_wrappers_are_fitted_on_every_page(spark):
    """What only a few pages of many show, long ones too, is known to the host's wrapper."""
    rng = random.Random(7)
    note = '<div class="box">This story is part of a series</div>'
    pages = [(i, "http://h.example/", *_page(rng, note if i % 30 == 0 else "")) for i in range(150)]
    long = "".join(f"<p>{_words(rng, 60)}</p><h2>{_words(rng, 3)}</h2>" for _ in range(700))
    pages.append((150, "http://h.example/", *(x if k else x.replace("<h1>", long + "<h1>") for k, x in enumerate(_page(rng)))))
    df = spark.createDataFrame([p[:3] for p in pages], "page_id long, url string, html string").repartition(5)
    got = {r.page_id: r.text.split("\n") for r in extract.extract(df).collect()}
    assert all(got[i][1:] == story for i, _, _, story in pages[:150])  # the note is constant, though on five pages only
    assert len(got[150]) > 1_400
    made = extract.wrappers(df).first().wrappers
    assert made == extract.wrappers(df.repartition(2, "html")).first().wrappers


def test_many_kids_are_counted_and_copies_of_any_page_show_nothing():
    rng = random.Random(8)
    few = Settings(most_kids=16)
    own = [_page(rng, f'<div class="{w}">{_words(rng, 8)}</div>') for w in WORDS]  # a name of each page
    made = infer([h for h, _ in own], few)
    assert all(len(k[KIDS]) <= 16 for w in made for k in [w, *w[KIDS]])
    for html, story in own:
        assert main_text(html, [extract.Parser(w, few.least_pages) for w in made]).split("\n")[-len(story):] == story
    said = _words(rng, 12)
    html, story = _page(rng, f'<div class="said">{said}</div>')
    pages = [_page(rng)[0] for _ in range(40)] + [html.replace("</table>", f"</table><i>{i}</i>") for i in range(5)]
    assert said in main_text(pages[-1], _parsers(pages)).split("\n")
