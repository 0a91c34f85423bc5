"""Long runs of white space are encoded as the vocabulary's own library does; attribute values hide nothing; open tags cost their length."""

import random
import time

import pytest
from tokenizers import Tokenizer

from cliquora.llm import html_extraction, packing, queries


@pytest.mark.parametrize("space", [" ", "\t", "\n", "\xa0", " \n", "　\t"])
def test_long_runs(space):
    """The seams: the same text with the length from which runs are cut out lowered."""
    want = Tokenizer.from_file(queries.vocabulary())
    encode = packing.encoder(queries.vocabulary())
    run = space * 20_000
    for text in (run, f"a{run}", f"{run}b", f"a {run} b", f"a{run}'s", f"a{run}1{run}é!{run}", f"a{run}<|endoftext|>{run}b", f"{run}<|endoftext|>"):
        assert encode(text) == want.encode(text, add_special_tokens=False).ids


def test_two_million(spark):
    encode = packing.encoder(queries.vocabulary())
    for space in (" ", "\t", "\n", "\xa0"):
        ids = encode(f"x{space * 2_000_000}y")
        assert Tokenizer.from_file(queries.vocabulary()).decode(ids, skip_special_tokens=False) == f"x{space * 2_000_000}y"
    rows = packing.pack_documents(spark.createDataFrame([(1, "a" + " " * 1_500_000 + "b")], "doc_id long, text string"), queries.vocabulary()).collect()
    assert sum(r.length for r in rows) == rows[0].doc_tokens


def test_runs_of_any_length(monkeypatch):
    """Every seam of short runs too: runs of two and more are cut out."""
    import re

    monkeypatch.setattr(packing, "LONG_SPACE", re.compile(packing.LONG_SPACE.pattern.replace("10000", "2")))
    r, want, encode = random.Random(4), Tokenizer.from_file(queries.vocabulary()), packing.encoder(queries.vocabulary())
    for _ in range(3000):
        text = "".join(r.choice([" ", " ", "\n", "\t", "\xa0", "a", "Zé", "1", "!", "'s", "<|endoftext|>", "\x1c", "​"]) for _ in range(r.randint(0, 14)))
        assert encode(text) == want.encode(text, add_special_tokens=False).ids, repr(text)


def text(page):
    return " ".join(t for _, t in html_extraction.parse(page)[1])


@pytest.mark.parametrize("tag, shown", [
    ("p title='the hidden door'", True), ("p class='is hidden now'", True), ("p data-note='display: none'", True), ('p alt="aria-hidden=true"', True), ("p data-hidden", True), ("p aria-hidden=false", True),
    ("p hidden", False), ("p HIDDEN=''", False), ("p class=x hidden", False), ("p style='color: red; display : none'", False), ('p aria-hidden="true"', False), ("p style=display:none", False),
])
def test_attribute_values(tag, shown):
    assert text(f"<article><{tag}>one</p><p>two</p></article>") == ("one two" if shown else "two")


@pytest.mark.parametrize("page", ["<b>" * 20_000 + "</i>" * 20_000 + "end", "<i><div>" + "<b>" * 20_000 + "</i>" * 20_000 + "end", "<b>" * 20_000 + "<hr>" * 20_000 + "end", "<div>" * 20_000 + "<li></li>" * 20_000 + "end"])
def test_open_tags_cost_their_length(page):
    began = time.time()
    assert text(page) == "end"
    assert time.time() - began < 3
