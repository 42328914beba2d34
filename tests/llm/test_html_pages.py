"""Hand-written pages, each with the text that its article has."""

import time
import tracemalloc

import pytest

from reelspark.llm import html_text

A, B = "alpha words " * 8, "beta words " * 8
a, b = A.strip(), B.strip()
PAGES = [
    (f"<div class='layout with-sidebar'><article><p>{A}</p></article></div>", a),
    (f"<div id=no-ads><p>{A}</p></div>", a),
    (f"<article><p>{A}</p><section class=share-price><p>{B}</p></section></article>", f"{a}\n\n{b}"),
    (f"<article><p>{A}</p><section class=related-work><p>{B}</p></section></article>", f"{a}\n\n{b}"),
    (f"<article><p>{A}</p><section class=related-posts><p>{B}</p></section></article>", a),
    (f"<div class=post><header><h1>Title</h1></header><div class=text><p>{A}</p></div></div>", f"Title\n\n{a}"),
    (f"<header><h1>Site</h1></header><div class=post><p>{A}</p></div>", a),
    (f"<article><div><header><h1>Title</h1></header></div><p>{A}</p></article>", f"Title\n\n{a}"),
    (f"<article><p>{A}</p><ul><li><a href=/r>A reference</a></li></ul></article>", f"{a}\n\nA reference"),
    (f"<article><p>{A}</p></article><aside><p>{B}</p></aside>", a),
    (f"<nav><ul><li><a href=/>Home</a></li></ul></nav><main><p>{A}</p></main><footer>end</footer>", a),
    (f"<main><p>{A}</p><form><p>{B}</p></form></main>", a),
    (f"<main><p>{A}</p><div class='ad-728x90'>{B}</div></main>", a),
    (f"<main><p>{A}</p><div class='cookie-notice'>{B}</div></main>", a),
    (f"<main><p>{A}</p><div role=navigation>{B}</div></main>", a),
    (f"<main><p>{A}</p><div hidden>{B}</div></main>", a),
    (f"<main><p>{A}</p><div style='display: none'>{B}</div></main>", a),
    (f"<article><p>{A}</p></article><div id=comments class=comment-list><p>{B}</p></div>", a),
    (f"<article><p>{A}<script>if (a < b) {{ x('</p>') }}</script></p></article>", a),
    (f"<article><p>{A}<!-- <p>not this</p> --></p></article>", a),
    ("<article><p>Fish &amp; chips &#8364;5 &lt;b&gt; &nbsp; x</p></article>", "Fish & chips €5 <b> x"),
    ("<article><p>one\n\t two<br>three <b>fo</b>ur</p></article>", "one two three four"),
    (f"<article><p>{A}<p>{B}</article>", f"{a}\n\n{b}"),
    (f"<article><table><tr><td>x<td>y</table><p>{A}</p></article>", f"x\n\ny\n\n{a}"),
    (f"<ARTICLE><P>{A}</P></ARTICLE>", a),
    (f"<article><p>{A}<blockquote>{B}</blockquote></article>", f"{a}\n\n{b}"),
    (f"<article><h2 id=advertising-law>Advertising law</h2><p>{A}</p></article>", f"Advertising law\n\n{a}"),
    (f"<body><div><p>{A}</p></div><div><p>{B}</p></div></body>", f"{a}\n\n{b}"),
    (f"<article><p>{A}</p></section></div></article>", a),
    (f"<article><p>{A}<!-- never closed", a),
    ("plain text only", "plain text only"),
    ("<article><p>a <a href=/x><b><i><u><s>deep link</s></u></i></b></a> b</p></article>", "a deep link b"),
]


@pytest.mark.parametrize("page, want", PAGES)
def test_page(page, want):
    assert html_text.Page(page).text(None) == want


def test_deep_link_counts_as_link():
    page = html_text.Page("<p>x <a href=/><b><i><u><s><em>linked words</em></s></u></i></b></a></p>")
    assert [n for _, _, n in page.blocks] == [len("linked words")]


@pytest.mark.parametrize("page", ["<div>" * 100_000 + A, "<div>" * 50_000 + A + "</section>" * 50_000, "<p>" * 100_000 + A, "<b>" * 100_000 + A, "<li>" * 100_000 + A, "<div class=x><p>y" * 30_000], ids=range(6))
def test_deep_pages_take_linear_time_and_memory(page):
    tracemalloc.start()
    began = time.monotonic()
    read = html_text.Page(page)
    best, _ = read.best()
    text = read.text(read.path(best))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert ("alpha" in text or text.startswith("y")) and peak < 250e6 and time.monotonic() - began < 20


def test_votes_ties_repeats_and_clashing_names(spark):
    one, two = "<body><div class=a><p>" + A + "</p></div></body>", "<body><div class=b><p>" + B + "</p></div></body>"
    rows = [(1, "http://h/1", one, "own"), (1, "http://h/1", one, "own"), (2, "http://h/2", two, "own"), (3, "http://k/1", one, None), (4, "http://k/2", two, None), (5, None, one, None)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = html_text.extract(frame, ["page_id", "text"])
    assert got.columns == ["page_id", "text_input", "text"]
    assert sorted((r.page_id, r.text) for r in got.collect()) == [(1, a), (1, a), (2, b), (3, a), (4, b), (5, a)]
    assert html_text.extract(frame.where("false"), ["page_id"]).count() == 0


@pytest.mark.parametrize("word", "sidebar newsletter-signup related-posts footer site-header notice promo share search copyright login-form popup cookie-notice comments".split())
def test_furniture_with_most_of_the_prose_is_not_the_article(word):
    furniture = "A long text beside the article. " * 17
    page = html_text.Page(f"<article><h1>News</h1><p>A short article of one line only.</p></article><div class={word}><p>{furniture}</p></div>")
    assert page.text(None) == "News\n\nA short article of one line only."
    page = html_text.Page(f"<h1>News</h1><p>A short article.</p><div class={word}><p>{furniture}</p><article>{furniture}</article></div>")
    assert page.text(None) == "News\n\nA short article."


def test_an_element_that_holds_all_the_prose_is_the_article():
    long = "The article itself stands here. " * 9
    for outside in ("", "<h1>News</h1>", "<p>Some words.</p>"):
        found = html_text.Page(f"<body>{outside}<div class=sidebar><p>{long}</p><div class=promo>Buy now.</div></div></body>").text(None)
        assert long.strip() in found and "Buy" not in found


def test_hidden_is_an_attribute_not_a_word():
    page = html_text.Page('<article><p title="the hidden valley">One.</p><section data-x="a hidden gem"><p>Two.</p></section><p hidden>Three.</p><p HIDDEN="">Four.</p><p data-hidden=1>Five.</p></article>')
    assert page.text(None) == "One.\n\nTwo.\n\nFive."


def test_deeply_marked_pages_take_linear_time():
    """Of nested marked elements those that hold more than half of the prose are shown."""
    began = time.process_time()
    text = html_text.Page("<div class=sidebar>x " * 20_000 + "the end").text(None)
    assert set(text.split()) == {"x"} and 10_000 < len(text.split()) < 10_020
    assert html_text.Page("<div class=sidebar>" * 20_000 + "text").text(None) == "text"
    assert time.process_time() - began < 20
