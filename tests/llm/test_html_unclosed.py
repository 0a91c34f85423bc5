"""Dropped and hidden elements without an end tag leave the rest of the page."""

import time

import pytest

from cliquora.llm import html_extraction


def text(page):
    return " ".join(t for _, t in html_extraction.parse(page)[1])


@pytest.mark.parametrize("page, want", [
    ("<html><head><title>x</title><body><article><p>one</article>", "one"),
    ("<head><meta a><script>if (a<b) '<p>'</script><noscript><link></noscript><div>one</div>", "one"),
    ("<head><title>x</title></head><p>one", "one"),
    ("<head><title>x</title> one", "one"),
    ("<p>a <button>b<p>c", "a b c"), ("<p>a<svg><p>c", "a c"), ("<iframe src=x><p>c", "c"), ("<noscript><p>c", "c"), ("<select><option>b</select><p>c<select>", "c"),
    ("<button>x<button>y</button></button><p>c", "c"),
    ("<div><p hidden>a<p>b<p hidden>c<b>d</div>e", "b e"),
    ("<ul><li hidden>a<ul><li>b</ul>c<li>d<li hidden>e</ul>f", "d f"),
    ("<table><tr hidden><td>a<td>b<tr><td>c<td hidden>d<td>e</table>f", "c e f"),
    ("<dl><dt hidden>a<dd>b<dd hidden>c</dl>d", "b d"),
    ("<p hidden>a</p>b <li hidden>c</li>d", "b d"),
    ("<div hidden>a<div>b</div>c</div>d", "d"), ("<div hidden>a<p>d", "a d"), ("<span hidden>a</span>b", "b"),
    ("a<script>b<p>c", "a"), ("a<textarea>b<p>c", "a"),
])
def test_unclosed(page, want):
    assert text(page) == want


def test_article_without_head_end():
    page, _ = html_extraction.Writer(77).page()
    model = html_extraction.train()
    whole = model.extract_many([page])[0]
    assert whole and model.extract_many([page.replace("</head>", "")])[0] == whole


@pytest.mark.parametrize("tag", ["<svg>", "<div hidden>", "<p hidden>", "<li hidden><ul>", "<head>"])
def test_many_unclosed(tag):
    began = time.time()
    html_extraction.parse(tag * 20000)
    assert time.time() - began < 20


@pytest.mark.parametrize(("page", "want"), [
    ("just text", "just text"),
    ("<html><head><title>x</title></head><body>One line.<br>Another line.<p>And a paragraph.</body></html>", "One line. Another line.\nAnd a paragraph."),
    ("<body><nav><a href=x>menu</a></nav></body>", ""),
    ("<body><nav><a href=x>menu</a></nav>The text.</body>", "The text."),
])
def test_text_right_in_the_body(page, want):
    assert html_extraction.train().extract_many([page])[0] == want
