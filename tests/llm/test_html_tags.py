"""Elements whose content isn't shown: closed, closed at once, and not closed."""

import pytest

from mnemora.llm import html_text

OTHERS = "svg math iframe object video audio canvas select template noscript".split()
BEFORE, INSIDE = "<p>The first words of a story are here.</p>", "<p>The second words of it stand {}here.</p><ul><li>One item.<li>Two items.</ul><p>The last words.</p>"
TEXT = "The first words of a story are here. The second words of it stand here. One item. Two items. The last words."


def pages(tag):
    """A page with `tag` before the article, between its blocks, and inside a block."""
    yield f"<body>{tag}<article>{BEFORE}{INSIDE.format('')}</article></body>"
    yield f"<body><article>{BEFORE}{tag}{INSIDE.format('')}</article></body>"
    yield f"<body><article>{BEFORE}{INSIDE.format(tag)}</article></body>"


@pytest.mark.parametrize("tag", OTHERS)
def test_tags_that_nothing_closes_lose_no_text(tag):
    m = html_text.default_model()
    for one in (f"<{tag}/>", f'<{tag} class="x" />', f"<{tag.upper()} a=b>"):
        assert [m.text(p) for p in pages(one)] == [TEXT] * 3, one
        # a later element of the same name has a closing tag: it isn't the first one's
        assert m.text(f"<body>{one}<article>{BEFORE}{INSIDE.format('')}</article><{tag}></{tag}></body>") == TEXT, one


@pytest.mark.parametrize("tag", ["script", "style", "title", "textarea"])
def test_raw_tags(tag):
    m = html_text.default_model()
    assert [m.text(p) for p in pages(f"<{tag} x=y />")] == [TEXT] * 3
    assert [m.text(p) for p in pages(f"<{tag}>A <p>gone & <b>lost.</{tag}>")] == [TEXT] * 3
    assert m.text(f"<article>{BEFORE}{INSIDE.format('')}<{tag}>") == TEXT
    if tag in ("title", "textarea"):
        assert m.text(f"<head><{tag}></head><article>{BEFORE}{INSIDE.format('')}</article>") == TEXT


@pytest.mark.parametrize("tag", [t for t in OTHERS if t != "math"])
def test_closed_tags_hide_their_content(tag):
    m = html_text.default_model()
    for inner in ("Not shown here.", "<p>Not shown, with <b>more.</b><p>And more.", f"<{tag}>Twice.</{tag}> Once more.", "<path d=x /><li>x<option>y"):
        assert [m.text(p) for p in pages(f"<{tag}>{inner}</{tag}>")] == [TEXT] * 3, inner


def test_formulas_are_text():
    page = f"<article>{BEFORE}<p>The area of it is <math><mi>a</mi><mo>=</mo><mn>42</mn></math> at least, as was said.</p></article>"
    assert html_text.default_model().text(page) == "The first words of a story are here. The area of it is a=42 at least, as was said."


def test_lone_quotes_and_quoted_brackets():
    m = html_text.default_model()
    for tag in ("<p title=it's>", '<p title=5">', "<p data-x='a>b' y=\"c>d\">", "<p x = 'a > b'>", "<p it's>"):
        assert m.text(f"<body><article>{BEFORE}{INSIDE.format('').replace('<p>', tag)}</article></body>") == TEXT, tag


def test_repeated_rows(spark):
    page = next(pages(""))
    rows = spark.createDataFrame([(1, "u", page, 3)] * 2 + [(None, None, None, 3)], "page_id long, url string, html string, n_chars int")
    assert sorted(((r.page_id, r.text) for r in html_text.extracted(rows, keep=("url",)).collect()), key=str) == [(1, TEXT), (1, TEXT), (None, "")]
