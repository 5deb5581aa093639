"""Licence scans: an Aho-Corasick pass over the words of a text, then licence expressions.

A text becomes its words ``[0-9a-z]`` and all characters above ASCII, lower-cased, with one space
between two; one automaton holds every phrase with a space at either end, so a hit is a place where
the phrase's words stand consecutively and its word number is the number of spaces before it.
Identifier tags are phrases of the same automaton; the characters after a tag, up to the end of its
line, are read as a licence expression by a shunting-yard parser (``and``, ``or``, ``with``,
parentheses; ``with`` binds tightest, then ``and``) and evaluated to its labels and to a score.

Score: 0 without evidence, else 1 minus the product of (1 - weight) over the distinct labels, a
tag's expression weighing 0.9 when it parses and a notice phrase its table weight.  An ``or``
needs one side (the maximum), an ``and`` both (the minimum).

Defined cases: null text is empty: no words, no places, empty labels, score 0; texts are read
whole, however long; repeated rows are scanned each; null ids stay null; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import keyed_texts

# The base phrases and their labels.
BASE_PHRASES = {
    "mit license": "mit",
    "apache license": "apache",
    "general public license": "gpl",
}

# Notice phrases (as words) with label and weight.
NOTICES = {
    "licensed under the apache license": ("apache", 0.95),
    "released under the mit license": ("mit", 0.95),
    "licensed under the mit license": ("mit", 0.95),
    "permission is hereby granted free of charge": ("mit", 0.8),
    "gnu general public license": ("gpl", 0.95),
    "gnu lesser general public license": ("lgpl", 0.95),
    "gnu affero general public license": ("agpl", 0.95),
    "mozilla public license": ("mpl", 0.9),
    "eclipse public license": ("epl", 0.9),
    "redistribution and use in source and binary forms": ("bsd", 0.8),
    "bsd license": ("bsd", 0.7),
    "isc license": ("isc", 0.7),
    "boost software license": ("bsl", 0.8),
    "creative commons attribution": ("cc-by", 0.7),
    "licensed under cc by": ("cc-by", 0.9),
    "licensed under cc by sa": ("cc-by-sa", 0.95),
    "licensed under cc by nc": ("cc-by-nc", 0.95),
    "licensed under cc by nd": ("cc-by-nd", 0.95),
    "dedicated to the public domain": ("public-domain", 0.8),
    "all rights reserved": ("proprietary", 0.4),
}
BASE_WEIGHT = 0.6
TAG_WEIGHT = 0.9
UNKNOWN_WEIGHT = 0.5  # of an identifier without a known prefix; it is its own label
TAGS = ("spdx license identifier",)

# Identifier prefixes of a licence expression and their labels, the longest prefix wins.
IDENTIFIERS = {
    "mit": "mit", "apache": "apache", "gpl": "gpl", "lgpl": "lgpl", "agpl": "agpl", "mpl": "mpl", "epl": "epl",
    "bsd": "bsd", "isc": "isc", "bsl": "bsl", "cc-by": "cc-by", "cc-by-sa": "cc-by-sa", "cc-by-nc": "cc-by-nc",
    "cc-by-nd": "cc-by-nd", "cc0": "public-domain", "unlicense": "public-domain",
}
PRECEDENCE = {"or": 1, "and": 2, "with": 3}

# every byte to itself in lower case, or to a space when it is no word byte
_WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32
                    for b in range(256))
_AFTER_TAG = re.compile(rb"[^0-9A-Za-z(]*([^\n]*)")
_EXPRESSION_WORD = re.compile(r"[()]|[a-z0-9][a-z0-9.+-]*")


def words_of(text: str) -> list[bytes]:
    """The words of a whole text; A-Z are lowered, nothing else."""
    return text.encode("utf-8", "surrogatepass").translate(_WORD_BYTES).split()


def expression_postfix(text: str) -> list[str] | None:
    """Shunting-yard: a licence expression to postfix order, None when it is malformed."""
    out: list[str] = []
    stack: list[str] = []
    operand_next = True
    for word in (m[0] for m in _EXPRESSION_WORD.finditer(text.lower())):
        if word == "(":
            if not operand_next:
                break  # a remark after a complete expression
            stack.append(word)
        elif word == ")":
            if operand_next:
                return None
            if "(" not in stack:
                break  # closes a bracket around the tag
            while stack[-1] != "(":
                out.append(stack.pop())
            stack.pop()
        elif word in PRECEDENCE:
            if operand_next:
                return None
            while stack and stack[-1] != "(" and PRECEDENCE[stack[-1]] >= PRECEDENCE[word]:
                out.append(stack.pop())
            stack.append(word)
            operand_next = True
        else:
            if not operand_next:
                break  # prose after a complete expression
            out.append(word)
            operand_next = False
    if operand_next or "(" in stack:
        return None
    return out + stack[::-1]


def identifier_label(word: str) -> str | None:
    known = [p for p in IDENTIFIERS if word == p or word.startswith((p + "-", p + "."))]
    return IDENTIFIERS[max(known, key=len)] if known else None


def evaluate(postfix: list[str]) -> tuple[frozenset[str], float]:
    """Labels named by the expression and how well it is known: or takes the better side, and the worse."""
    stack: list[tuple[frozenset[str], float]] = []
    for word in postfix:
        if word not in PRECEDENCE:
            label = identifier_label(word)
            stack.append((frozenset([label or word]), TAG_WEIGHT if label else UNKNOWN_WEIGHT))
            continue
        right, left = stack.pop(), stack.pop()
        if word == "with":  # the right side names an exception to the left one's licence
            stack.append(left)
        else:
            stack.append((left[0] | right[0], (max if word == "or" else min)(left[1], right[1])))
    return stack[0]


@lru_cache(maxsize=8)
def _automaton(phrases: tuple[str, ...]):
    import ahocorasick
    a = ahocorasick.Automaton()
    for p in phrases:
        a.add_word(f" {p} ", p)
    a.make_automaton()
    return a


def scan(text: str) -> tuple[int, list[tuple[int, str]], list[tuple[int, str]], list[str]]:
    """(number of words, base places, notice places, tagged expressions); a place is (word number, phrase)."""
    raw = text.encode("utf-8", "surrogatepass")
    spaced = raw.translate(_WORD_BYTES)
    words = spaced.split()
    joined = (b" " + b" ".join(words) + b" ").decode("latin-1") if words else ""
    phrases = tuple(dict.fromkeys((*BASE_PHRASES, *NOTICES, *TAGS)))
    base, notices, tags = [], [], []
    at, number = 0, 0
    for end, phrase in _automaton(phrases).iter(joined):
        start = end - len(phrase)
        # hits come by their ends; a longer phrase may start before an earlier hit
        number += joined.count(" ", at, start) if start >= at else -joined.count(" ", start, at)
        at = start
        if phrase in BASE_PHRASES:
            base.append((number - 1, phrase))
        if phrase in NOTICES:
            notices.append((number - 1, phrase))
        if phrase in TAGS:
            tags.append(number - 1 + phrase.count(" "))  # the tag's last word
    expressions = []
    if tags:
        ends = [m.end() for m in re.finditer(rb"[^ ]+", spaced)]
        for last in tags:  # what follows the tag in its line, or in the next where the line ends with the tag
            expressions.append(_AFTER_TAG.match(raw, ends[last])[1].decode("utf-8", "replace"))
    return len(words), base, notices, expressions


def judge(text: str) -> tuple:
    """(n_words, n_base, first_word, last_word, base_labels, labels, score, expressions)."""
    n, base, notices, expressions = scan(text)
    weights: dict[str, float] = {}
    for _, p in base:
        weights[BASE_PHRASES[p]] = max(weights.get(BASE_PHRASES[p], 0.0), BASE_WEIGHT)
    base_labels = ",".join(sorted(weights))
    longest: dict[int, str] = {}
    for i, p in notices:  # of notices that start together the longest counts
        longest[i] = max(longest.get(i, p), p, key=len)
    for p in longest.values():
        label, w = NOTICES[p]
        weights[label] = max(weights.get(label, 0.0), w)
    parsed = []
    for e in expressions:
        postfix = expression_postfix(e)
        if postfix is None:
            continue
        parsed.append(" ".join(postfix))
        labels, w = evaluate(postfix)
        for label in labels:
            weights[label] = max(weights.get(label, 0.0), w)
    doubt = 1.0
    for label in sorted(weights):
        doubt *= 1 - weights[label]
    starts = [i for i, _ in base]
    return (n, len(base), min(starts, default=None), max(starts, default=None), base_labels,
            ",".join(sorted(weights)), 1 - doubt if weights else 0.0, parsed)


SCAN_SCHEMA = ("doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, "
               "labels string, score double, expressions array<string>")


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document, scanned where it is read: no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64()] * 4 + [pa.string(), pa.string(), pa.float64(), pa.list_(pa.string())]
        names = [c.split()[0] for c in SCAN_SCHEMA.split(", ")]
        for batch in batches:
            rows = [judge(t) for t in batch.column(1).to_pylist()]
            columns = list(zip(*rows)) if rows else [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(list(c), k) for c, k in zip(columns, kinds))], names)

    return keyed_texts(docs, id_col, text_col).mapInArrow(run, SCAN_SCHEMA)
