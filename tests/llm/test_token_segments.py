"""Texts in ASCII are cut by a faster pattern into the same segments, and ids are the tokenizer's own."""

import random

import numpy as np
from tokenizers import Tokenizer

from routelens.llm import tokens


def test_ascii_pattern_cuts_alike():
    rng = random.Random(5)
    for _ in range(3000):
        text = "".join(rng.choice("ab Z9_.,'!\t\n\r\x0b\x0c \x00\x1b\x7f<") for _ in range(rng.randrange(30)))
        assert tokens.SEGMENT_ASCII.findall(text) == tokens.SEGMENT.findall(text)


def test_ids_are_the_tokenizers_own():
    path = tokens.vocabulary_path()
    whole = Tokenizer.from_file(path)
    texts = ["", "a", "Hello, world. ok", "x\x1cy z", "a <|endoftext|> b", "café​ok über, na", "tab\t\n  two.\r\nend ", "1,2 .3 _a_ don't"]
    for text, raw in zip(texts, tokens.encoded(texts, path)):
        assert np.frombuffer(raw, "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids
