"""Pages written by hand, none from the generator that the model is trained with."""

import pytest

from aidlake.llm import html_text as h

A = "The river rose two metres overnight and the bridge was closed. Engineers said the water should fall by noon, and that the road would open again."
B = "Schools in the valley stay shut until Monday, the council said on Friday."
TOP = '<html><head><title>Flood</title><script>var x = "not text";</script></head><body><nav><ul><li><a href="/">Home</a></li><li><a href="/n">News</a></li><li><a href="/s">Sport</a></li></ul></nav>'
END = "<footer>&copy; 2024 Daily News. All rights reserved.</footer></body></html>"
LAYOUTS = {
    "section with a name": (f'<section class="story-body"><p>{A}</p></section>', A),
    "section": (f"<section><p>{A}</p></section>", A),
    "div with an id": (f'<div id="story"><p>{A}</p></div>', A),
    "columns": (f'<div class="page"><div class="row"><div class="col"><p>{A}</p></div></div></div>', A),
    "nameless divs without paragraphs": (f"<div><div>{A}</div></div>", A),
    "article with a div": (f"<article><h1>Flood</h1><div>{A}</div></article>", f"Flood {A}"),
    "article": (f"<article><p>{A}</p></article>", A),
    "no container": (f"<p>{A}</p><p>{B}</p>", f"{A} {B}"),
    "table": (f"<table><tr><td><p>{A}</p></td></tr></table>", A),
    "heading and paragraphs in a div": (f'<div class="x1"><h2>Flood</h2><p>{A}</p><p>{B}</p></div>', f"Flood {A} {B}"),
    "section in a main": (f'<main><section><div class="inner"><p>{A}</p><p>{B}</p></div></section></main>', f"{A} {B}"),
    "div paragraphs": (f'<div id="c7"><div>{A}</div><div>{B}</div><div>{A}</div></div>', f"{A} {B} {A}"),
}


@pytest.mark.parametrize("name", LAYOUTS)
def test_the_whole_article_and_nothing_else(name):
    inner, want = LAYOUTS[name]
    assert h.trained().main_text(TOP + inner + END) == want


def test_what_is_not_the_article_goes():
    side = f'<div class="sidebar"><h3>More</h3><ul><li><a href="/1">One more</a></li><li><a href="/2">Another</a></li></ul></div><div class="comments"><p>{B} I do not believe it.</p></div>'
    ad = '<div class="ad">Buy two boats and pay for one.</div><form><label>Mail</label><p>Write to us for our letter.</p></form>'
    assert h.trained().main_text(f'{TOP}<div class="wrap">{ad}<div class="inner"><p>{A}</p><p>{B}</p></div>{side}</div>{END}') == f"{A} {B}"


def test_context_by_hand():
    page = "<a href=x>link</a><p>" + "long text " * 10 + "</p><div>short</div>"
    assert h.context(h.blocks(page)) == [("share:0", "before:edge", "after:0"), ("share:4", "before:2", "after:0"), ("share:1", "before:0", "after:edge")]
