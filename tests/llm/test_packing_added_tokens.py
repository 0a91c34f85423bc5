"""Added tokens of the vocabulary file in a text have the ids that tokenizers gives them."""

import pytest
from tokenizers import Tokenizer

from cliquora.llm import packing, queries


@pytest.mark.parametrize("text", ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|endoftext|>  y\n", "  <|endoftext|>\n\n z", "<|endoftext| >", "plain  text \n"])
def test_added_tokens(text):
    want = Tokenizer.from_file(queries.vocabulary()).encode(text, add_special_tokens=False).ids
    assert packing.encoder(queries.vocabulary())(text) == want
    assert (50256 in want) == ("<|endoftext|>" in text)
