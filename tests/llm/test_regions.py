"""Which part of a page is its article: other stories, bars, comments in other languages, columns of links, broken markup."""

import random
import time

import pytest

from webloom.llm import html_text

LONG = " ".join(["Long text of the story that goes on."] * 12)
MORE = " ".join(["And more of it, in a paragraph of its own."] * 8)
STORY = f"<h1>Title of it</h1><p>{LONG}</p><p>{MORE}</p><p>Short end.</p>"
TEXT = f"Title of it\n{LONG}\n{MORE}\nShort end."


def test_other_stories():
    page = f"<body><main>{STORY}</main><section><article class=card><h3>Other story</h3><p>What it is about, in a sentence or two of some length, so that it stands out.</article></section>"
    assert html_text.main_text(page) == TEXT
    assert html_text.main_text(f"<main><h1>Top</h1></main><article>{STORY}</article>") == f"Top\n{TEXT}"  # the story is not in main


def test_consent_bar_without_a_word_for_it():
    for bar in ('<div id="onetrust-consent-sdk"><p>We and our partners store and read information on a device, as you agree to here or not.</p></div>', '<div id="x9"><div>Wir verwenden Dateien auf Ihrem Gerät, um Ihnen diese Seite zeigen zu können, wie Sie es wünschen.</div><a href=/>ok</a></div>'):
        for page in (f"<body>{bar}<div class=s>{STORY}</div>", f"<body><div class=s>{STORY}</div>{bar}</body>"):
            assert html_text.main_text(page) == TEXT, bar


def test_comments_in_other_languages():
    for name in ("kommentare", "leser-kommentare", "commentaires", "comentarios", "lista-comentarios"):
        if name.startswith("l"):
            name = name.replace("leser-", "").replace("lista-", "")
        assert html_text.main_text(f'<article>{STORY}<div id="{name}"><p>{MORE}</p></div></article>') == TEXT


def test_columns_of_links():
    links = "".join(f'<a href="/{k}">Link {k}</a><br>' for k in range(8))
    assert html_text.main_text(f'<body><div class="col1">{STORY}</div><div class="col2">{links}</div>') == TEXT
    items = "".join(f'<div><a href="/{k}">L{k}</a></div>' for k in range(8))
    assert html_text.main_text(f'<body><div class="col2">{items}</div><div class="col1">{STORY}</div>') == TEXT


def test_parts_of_a_story_stay():
    """A second part of several lines, or lines of the body's own, are no bar."""
    assert html_text.main_text(f"<body><div>{STORY}</div><div><p>{MORE}</p><p>{MORE}</p><p>{MORE}</p></div>") == "\n".join([TEXT, MORE, MORE, MORE])
    assert html_text.main_text(f"<body><p>{MORE}</p><div>{STORY}</div>") == f"{MORE}\n{TEXT}"


def test_nothing_stands_out(monkeypatch):
    """Where no line is content nothing is given; where only what is no article stands out, the article's lines are told apart."""
    assert html_text.main_text(f"<body><aside><p>{LONG}</p><p>{LONG}</p></aside><article><p>A short one.</p></article>") == "A short one."
    monkeypatch.setattr(html_text, "content_lines", lambda ratios: [False] * len(ratios))
    assert html_text.main_text(f"<article>{STORY}</article>") == ""


@pytest.mark.parametrize("piece", ["<!--", "</", "<a ", "<a b='", "<!", "<?", "<script>", "<p", "<title>", "&", "<div><!--"])
def test_broken_markup_takes_linear_time(piece):
    page = f"<article><p>{LONG}</p>" + piece * (2_000_000 // len(piece))
    began = time.time()
    text = html_text.main_text(page)
    assert text.startswith(LONG) and time.time() - began < 15


def test_cleaning_changes_no_text():
    r = random.Random(4)
    pieces = ["<p>one ", "two</p>", "<!-- x<p> -->", "<script>a<b</script>", "<b>three</b>", "&amp;", "<br>", "<div class='a>b'>", "</div>", "4 < 5 ", "<style>p{}</style>", "<?php x ?>", "<!DOCTYPE html>", "<textarea>no p</textarea>", "é"]
    for _ in range(300):
        page = "".join(r.choices(pieces, k=20))
        events, clean = html_text._Events(), html_text._Events()
        for e, text in ((events, page), (clean, html_text.cleaned(page))):
            e.feed(text)
            e.close()
            e.cut()
        assert " ".join(line[0] for line in events.lines).split() == " ".join(line[0] for line in clean.lines).split(), page
