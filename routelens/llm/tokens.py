"""Byte-level BPE ids through the ``tokenizers`` library.

Merges never cross white space boundaries of the vocabulary's own split pattern, so a text is
cut into segments (a word or a run of other characters with the one space before it, or a run of
white space) and each distinct segment is encoded once per worker.  The memo holds two generations of
bounded size and changes no result.  Texts with characters whose white-space class differs
between regular-expression engines, and texts that hold the string of an added token, are encoded whole.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterator

import numpy as np

VOCABULARY = "byte_bpe_50k.json"
# a word and the stop after it apart, else a run of other characters, else white space: every cut is
# one that the vocabulary's pattern makes too
SEGMENT = re.compile(r" ?[^\W\d_]+(?=[.,\s])|[.,](?=\s)| ?\S+|\s+(?!\S)|\s+")
# the same for ASCII texts, whose white space is six characters (the others of ``\s`` are ambiguous ones): sets of plain
# characters are matched faster than character classes
SEGMENT_ASCII = re.compile(r" ?[A-Za-z]+(?=[., \t-\r])|[.,](?=[ \t-\r])| ?[^ \t-\r]+|[ \t-\r]+(?![^ \t-\r])|[ \t-\r]+")
AMBIGUOUS = "\x1c\x1d\x1e\x1f\x85\u180e\u200b\u2060\ufeff"
MEMO_SEGMENTS = 600_000
LONG_SEGMENT = 64
JOINED_SEGMENTS = 1000


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


class Encoder:
    """Texts to little-endian unsigned 32-bit ids, as bytes."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.whole = [*AMBIGUOUS, *added]
        self.whole_ascii = [s for s in self.whole if s.isascii()]
        vocab = self.tokenizer.get_vocab()
        self.lengths = np.zeros(max(vocab.values(), default=0) + 1, np.int64)  # bytes of every id: its string has a character a byte
        for token, i in vocab.items():
            self.lengths[i] = len(token)
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _raw(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _raw_segments(self, segments: list[str]) -> list[bytes]:
        """As ``_raw``; segments that begin with a space go many in one text, cut again by their ids' lengths.

        The vocabulary's pattern cuts before a space that no white space follows, so no merge crosses from one to the next.
        """
        words = [s for s in segments if len(s) > 1 and s[0] == " " and not s[1].isspace()]
        rest = list(set(segments).difference(words))
        out = dict(zip(rest, self._raw(rest)))
        for lo in range(0, len(words), JOINED_SEGMENTS):
            some = words[lo:lo + JOINED_SEGMENTS]
            ids = np.array(self.tokenizer.encode_batch_fast(["".join(some)], add_special_tokens=False)[0].ids, np.uint32)
            ends = np.searchsorted(np.cumsum(self.lengths[ids]), np.cumsum([len(s.encode()) for s in some])) + 1
            raw, at = ids.tobytes(), 0
            for s, end in zip(some, (4 * ends).tolist()):
                out[s] = raw[at:end]
                at = end
        return [out[s] for s in segments]

    def _segments(self, text: str) -> list[str] | None:
        """The segments of a text, none if it is encoded whole."""
        plain = text.isascii()
        for s in self.whole_ascii if plain else self.whole:
            if s in text:
                return None
        return (SEGMENT_ASCII if plain else SEGMENT).findall(text)

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        """One id string per text, in order."""
        plain = list(map(self._segments, texts))
        young, old = self.young, self.old
        missing = []
        for s in set().union(*filter(None, plain)).difference(young):
            if (v := old.get(s)) is None:
                missing.append(s)
            else:
                young[s] = v
        young.update(zip(missing, self._raw_segments(missing)))
        for t, p in zip(texts, plain):
            yield self._raw([t])[0] if p is None else b"".join(map(young.__getitem__, p))
        for s in missing:
            if len(s) > LONG_SEGMENT:
                del young[s]
        if len(young) > MEMO_SEGMENTS:
            self.old, self.young = young, {}


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder for a vocabulary file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def encoded(texts: list[str], path: str, chunk_chars: int = 1 << 20) -> Iterator[bytes]:
    """Encode in groups of about ``chunk_chars`` characters, so memory stays flat."""
    group: list[str] = []
    size = 0
    for t in texts:
        group.append(t)
        size += len(t)
        if size >= chunk_chars:
            yield from encoder(path).encode(group)
            group, size = [], 0
    if group:
        yield from encoder(path).encode(group)
