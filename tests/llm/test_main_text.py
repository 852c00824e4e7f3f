"""Headlines and short parts of a container stay, menus and reader comments go, however the page is laid out."""

from __future__ import annotations

import pytest

from pagelens.llm.html_extract import main_text

LINE = "A sentence with words, and more of them, so that it is long enough to count as prose here."
P = f"<p>{LINE}</p>"


def joined(*parts: str) -> str:
    return "\n\n".join(parts)


PAGES = {
    "headline in main": (f'<main><h1>HEAD</h1><div class="body">{P * 10}</div></main>', joined("HEAD", *[LINE] * 10)),
    "headline in body": (f'<body><h1>HEAD</h1><div class="body">{P * 10}</div></body>', joined("HEAD", *[LINE] * 10)),
    "short parts": (f'<div id="content"><div class="intro"><p>short</p></div><div class="text">{P * 20}</div><div><p>short end</p></div></div>', joined("short", *[LINE] * 20, "short end")),
    "short closing section": (f'<main><div class="text">{P * 10}</div><section><p>closing</p></section></main>', joined(*[LINE] * 10, "closing")),
    "replies behind": (f'<article>{P * 4}</article><section class="replies">{P * 30}</section>', joined(*[LINE] * 4)),
    "replies inside": (f'<article>{P * 4}<section class="replies">{P * 30}</section></article>', joined(*[LINE] * 4)),
    "thread of a service": (f'<article>{P * 4}<div id="disqus_thread">{P * 30}</div></article>', joined(*[LINE] * 4)),
    "responses": (f'<article>{P * 4}</article><div id="responses">{P * 30}</div>', joined(*[LINE] * 4)),
    "menu in main": (f'<main><ul><li><a href="x">menu</a></li></ul><h1>HEAD</h1><div class="body">{P * 10}</div></main>', joined("HEAD", *[LINE] * 10)),
    "headline of the article": (f"<body><h1>Site</h1><article><h1>HEAD</h1>{P * 4}</article></body>", joined("HEAD", *[LINE] * 4)),
    "words that only resemble": (f'<article><div class="responsive-image"><p>one</p></div><div class="discussion-paper">{P * 4}</div></article>', joined("one", *[LINE] * 4)),
    "nothing to see": ("<body><script>x</script></body>", ""),
}


@pytest.mark.parametrize("name", PAGES)
def test_layouts(name):
    html, want = PAGES[name]
    assert main_text(html) == want


def test_long_pages_and_ties():
    """Two equal containers give the first with its equal neighbour; many parts take no longer than their text."""
    assert main_text(f"<div>{P * 3}</div><div>{P * 3}</div>") == joined(*[LINE] * 6)
    assert main_text(f'<main>{"<div>" + P + "</div>"}' * 1 + "<section><p>tail</p></section>" * 5000 + "</main>").count("tail") == 5000
