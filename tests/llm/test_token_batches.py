"""New segments are encoded many in one text and give the ids that they give alone."""

import random

from routelens.llm import tokens


class Counted:
    def __init__(self, tokenizer):
        self.tokenizer, self.texts = tokenizer, 0

    def encode_batch_fast(self, texts, **options):
        self.texts += len(texts)
        return self.tokenizer.encode_batch_fast(texts, **options)


def test_joined_segments_have_their_own_ids():
    rng = random.Random(4)
    letters = "abcdefgABC0189'’.,!?#-_éèßñçäЖ中文字🙂 　́½٣ \t\n"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 300))) for _ in range(400)]
    texts += [" ".join("".join(rng.choice("etaoinshré") for _ in range(rng.randint(1, 14))) for _ in range(3000)), "", " ", "  x", "a b", " it's we'll  I'm ", " <|endoftext|> x"]
    path = tokens.vocabulary_path()
    plain = tokens.Encoder(path).tokenizer
    want = [e.ids for e in plain.encode_batch_fast(texts, add_special_tokens=False)]
    got = [list(memoryview(raw).cast("I")) for raw in tokens.Encoder(path).encode(texts)]
    assert got == want


def test_words_are_not_encoded_one_by_one():
    one = tokens.Encoder(tokens.vocabulary_path())
    one.tokenizer = Counted(one.tokenizer)
    text = "".join(f" w{i}x" for i in range(5000))
    ids = list(memoryview(next(iter(one.encode([text])))).cast("I"))
    assert ids == one.tokenizer.tokenizer.encode(text, add_special_tokens=False).ids
    assert one.tokenizer.texts < 100
