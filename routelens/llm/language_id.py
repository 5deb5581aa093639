"""Language identification by spans: script ranges, per-word scores, Viterbi with a switching penalty.

A word is a run of letters (and marks) of one script.  Its script narrows the languages to those that were
learned with that script; each candidate's score of the word is the log-probability of its letters in that
language's letter-trigram model (trigram, bigram and letter shares mixed by fixed weights, word boundaries
included).  Viterbi's best path over the words of a text, where changing the language costs ``PENALTY``,
labels them; equal neighbours form spans.  The text's language is the one with most letters in its spans.

The model is a classifier fitted on a bounded, documented sample of labelled rows: of each language the
``rows_per_language`` rows with the smallest id hashes, taken in that order while the texts before them have
less than ``letters_per_language`` characters; whole texts.  The counting runs as a Spark aggregation; the
model is bounded by the sample and travels with the tasks.  Scoring reads every text whole, in one pass without a shuffle.

Paths of all texts of a slice advance together, word by word; the steps of a slice are the words of its
longest text, its memory follows ``SLICE_BYTES`` or the longest single text.

Defined cases: a null text, or one without a letter, is ``und`` with score 0 and no span; a null id is
predicted (not held out) but never learned from; null languages are not learned; of texts with letters of
scripts no language was learned with, the language with most sampled letters is predicted, score 0; without any learned
language everything is ``und``; ties go to the alphabetically smaller language; repeated rows are predicted
each; other columns are ignored.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import lean, stage, text_slices

FOLDS, HELD_OUT = 5, 0
ROWS_PER_LANGUAGE = 2000
LETTERS_PER_LANGUAGE = 8_000_000
MIN_SHARE = 0.02     # a script counts for a language from this share of its letters
PENALTY = 12.0       # nats a change of language costs
WEIGHTS = 0.75, 0.2, 0.05  # of trigram, bigram and letter
SPLIT = 256          # parts of a language in which the sample's first cut is made
SLICE_BYTES = 4 << 20
DENSE = 1 << 22      # up to so many cells trigrams are looked up in a table, beyond by binary search
OUT = -1e6           # score of a language the script rules out
UND = "und"

# First and last code points of scripts (Unicode blocks; neighbouring ones joined)
SCRIPTS = {
    "latin": [(0x0041, 0x024F), (0x1E00, 0x1EFF), (0x2C60, 0x2C7F), (0xA720, 0xA7FF), (0xFF21, 0xFF5A)],
    "greek": [(0x0370, 0x03FF), (0x1F00, 0x1FFF)],
    "cyrillic": [(0x0400, 0x052F), (0x1C80, 0x1C8F), (0x2DE0, 0x2DFF), (0xA640, 0xA69F)],
    "armenian": [(0x0530, 0x058F)],
    "hebrew": [(0x0590, 0x05FF)],
    "arabic": [(0x0600, 0x06FF), (0x0750, 0x077F), (0x08A0, 0x08FF), (0xFB50, 0xFDFF), (0xFE70, 0xFEFF)],
    "devanagari": [(0x0900, 0x097F)],
    "bengali": [(0x0980, 0x09FF)],
    "gurmukhi": [(0x0A00, 0x0A7F)],
    "gujarati": [(0x0A80, 0x0AFF)],
    "tamil": [(0x0B80, 0x0BFF)],
    "telugu": [(0x0C00, 0x0C7F)],
    "kannada": [(0x0C80, 0x0CFF)],
    "malayalam": [(0x0D00, 0x0D7F)],
    "sinhala": [(0x0D80, 0x0DFF)],
    "thai": [(0x0E00, 0x0E7F)],
    "lao": [(0x0E80, 0x0EFF)],
    "tibetan": [(0x0F00, 0x0FFF)],
    "myanmar": [(0x1000, 0x109F)],
    "georgian": [(0x10A0, 0x10FF), (0x1C90, 0x1CBF)],
    "ethiopic": [(0x1200, 0x139F)],
    "khmer": [(0x1780, 0x17FF)],
    "kana": [(0x3040, 0x30FF), (0x31F0, 0x31FF)],
    "hangul": [(0x1100, 0x11FF), (0x3130, 0x318F), (0xAC00, 0xD7AF)],
    "han": [(0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x323AF)],
}
N_SCRIPTS = len(SCRIPTS) + 1  # 0: any other


@lru_cache(1)
def _alphabet() -> tuple[np.ndarray, np.ndarray]:
    """Of every code point: 0 no part of words, 1 mark, 2 letter; and its script."""
    kind, script = np.zeros(0x110000, np.uint8), np.zeros(0x110000, np.uint8)
    for cp in range(0x110000):
        category = unicodedata.category(chr(cp))
        kind[cp] = 2 if category[0] == "L" else category[0] == "M"
    for number, ranges in enumerate(SCRIPTS.values(), 1):
        for first, last in ranges:
            script[first:last + 1] = number
    return kind, script


@dataclass
class Words:
    """Words of a slice: their letters' code points and the two before each (0: outside the word)."""
    letters: np.ndarray
    one: np.ndarray
    two: np.ndarray
    first: np.ndarray   # first letter of each word
    size: np.ndarray    # letters, marks included
    script: np.ndarray
    text: np.ndarray    # row of the slice


def words_of(texts: pa.Array) -> Words:
    """Words of an Arrow column of texts, lower-cased; null texts have none."""
    lowered = pc.utf8_lower(texts.fill_null(""))
    rows = lowered.to_pylist()
    ends = np.cumsum([len(r) + 1 for r in rows]) if rows else np.zeros(0, np.int64)
    points = np.frombuffer("\0".join([*rows, ""]).encode("utf-32-le"), np.uint32)
    kind, script = _alphabet()
    inside = kind[points] > 0
    of, marks = script[points], kind[points] == 1
    if marks.any():  # a mark has the script of what it stands on
        of = of[np.maximum.accumulate(np.where(marks, 0, np.arange(len(points))))]
    prev = np.zeros(len(points), bool)
    prev[1:] = inside[:-1] & (of[1:] == of[:-1])
    begins = inside & ~prev
    at = np.flatnonzero(inside)
    number = np.cumsum(begins)[at] - 1
    letters = points[at].astype(np.int64)
    first = np.flatnonzero(begins[at])
    has = np.maximum.reduceat(kind[points[at]], first) == 2 if len(first) else np.zeros(0, bool)
    if not has.all():  # runs of marks alone are no words
        keep = has[number]
        at, letters, number = at[keep], letters[keep], (np.cumsum(has) - 1)[number[keep]]
        first = np.searchsorted(number, np.arange(int(has.sum())))
    back = np.arange(len(at)) - first[number] if len(at) else np.zeros(0, np.int64)
    one, two = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
    one[1:][back[1:] > 0] = letters[:-1][back[1:] > 0]
    two[2:][back[2:] > 1] = letters[:-2][back[2:] > 1]
    size = np.diff(np.append(first, len(at)))
    return Words(letters, one, two, first, size, of[at[first]] if len(first) else np.zeros(0, np.uint8),
                 np.searchsorted(ends, at[first], "right") if len(first) else np.zeros(0, np.int64))


def _key(two: np.ndarray, one: np.ndarray, letter: np.ndarray) -> np.ndarray:
    return two << 42 | one << 21 | letter


# ---------------------------------------------------------------- learning

def fold(id_column: Column) -> Column:
    return F.crc32(id_column.cast("string").cast("binary")) % FOLDS


def sample(docs: DataFrame, rows_per_language: int = ROWS_PER_LANGUAGE, letters_per_language: int = LETTERS_PER_LANGUAGE,
           id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(text, lang) of the rows that are learned from."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(lang_col).cast("string").alias("lang"),
                       F.col(text_col).cast("string").alias("text")).where(
        F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull() & (fold(F.col("doc_id")) != HELD_OUT))
    order = [F.xxhash64("doc_id"), F.col("doc_id"), F.col("n")]
    ids = rows.select("doc_id", "lang", F.char_length("text").cast("long").alias("n"))  # a few bytes a row
    for part in (["lang", F.crc32(F.col("doc_id").cast("string").cast("binary")) % SPLIT], ["lang"]):  # a hot language is cut in parts first
        ids = ids.withColumn("at", F.row_number().over(Window.partitionBy(*part).orderBy(*order))).where(F.col("at") <= rows_per_language)
    order = Window.partitionBy("lang").orderBy(*order)
    before = F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ids = stage(ids.withColumn("before", before).where(F.col("before") < letters_per_language).select("doc_id", "lang").distinct(),
                "language-sample")
    return rows.join(F.broadcast(ids), ["doc_id", "lang"]).select("text", "lang")  # rows_per_language ids a language at most


def _count_trigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, _, _ in text_slices(batch, "text"):
            langs = np.array(batch.column(1).slice(lo, hi - lo).to_pylist(), object)
            words = words_of(batch.column(0).slice(lo, hi - lo))
            owner = np.repeat(words.text, words.size)
            keys = _key(words.two, words.one, words.letters)
            for lang in set(langs):
                own, n = np.unique(keys[langs[owner] == lang], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(own), pa.string()), pa.array(own, pa.int64()), pa.array(n, pa.int64())],
                                                 ["lang", "key", "n"])


@dataclass
class LanguageModel:
    langs: list[str]
    alphabet: np.ndarray        # sorted code points; symbol = position + 1, unknown letters are one symbol
    keys: list[np.ndarray]      # sorted codes of seen trigrams, bigrams and single symbols
    scores: np.ndarray          # (all keys in this order and one row for anything else) x language
    allowed: np.ndarray         # script x language
    default: int                # the language with most sampled letters
    tables: list | None = None  # dense positions, made where it is used

    @property
    def base(self) -> int:
        return len(self.alphabet) + 2

    def letter_scores(self, words: Words) -> np.ndarray:
        """(letters x languages) log-probabilities."""
        base = self.base
        symbol = [self._symbol(x) for x in (words.two, words.one, words.letters)]
        if self.tables is None:
            offset, self.tables = 0, []
            for order, keys in zip((3, 2, 1), self.keys):
                if base ** order <= DENSE:
                    table = np.full(base ** order, -1, np.int32)
                    table[keys] = np.arange(len(keys)) + offset
                    self.tables.append(table)
                else:
                    self.tables.append(offset)
                offset += len(keys)
        row = np.full(len(words.letters), len(self.scores) - 1, np.int64)
        for order in (1, 2, 3):
            code = np.zeros(len(row), np.int64)
            for s in symbol[3 - order:]:
                code = code * base + s
            keys, table = self.keys[3 - order], self.tables[3 - order]
            if isinstance(table, np.ndarray):
                found = table[code]
                row = np.where(found >= 0, found, row)
            elif len(keys):
                at = np.minimum(np.searchsorted(keys, code), len(keys) - 1)
                row = np.where(keys[at] == code, at + table, row)
        return self.scores[row]

    def _symbol(self, points: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.alphabet, points), max(len(self.alphabet) - 1, 0))
        known = self.alphabet[at] == points if len(self.alphabet) else np.zeros(len(points), bool)
        return np.where(known, at + 1, np.where(points == 0, 0, len(self.alphabet) + 1))


def _model(lang: np.ndarray, key: np.ndarray, n: np.ndarray) -> LanguageModel:
    langs = sorted(set(lang))
    column = np.searchsorted(np.array(langs, object), lang)
    two, one, letter = key >> 42, key >> 21 & 0x1FFFFF, key & 0x1FFFFF
    alphabet = np.unique(letter)
    model = LanguageModel(langs, alphabet, [], np.zeros((0, 0)), np.zeros((0, 0)), 0)
    base, symbols = model.base, [model._symbol(x) for x in (two, one, letter)]

    def table(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keys, at = np.unique(codes, return_inverse=True)
        counts = np.zeros((len(keys), len(langs)))
        np.add.at(counts, (at, column), n)
        return keys, counts

    tri, bi, uni = (table(c) for c in ((symbols[0] * base + symbols[1]) * base + symbols[2], symbols[1] * base + symbols[2], symbols[2]))
    w3, w2, w1 = WEIGHTS
    totals = uni[1].sum(0)
    p1 = (uni[1] + 0.5) / (totals + 0.5 * (len(alphabet) + 1))
    none = 0.5 / (totals + 0.5 * (len(alphabet) + 1))

    def share(counts: np.ndarray, context: np.ndarray) -> np.ndarray:
        _, at = np.unique(context, return_inverse=True)
        sums = np.zeros((at.max() + 1, len(langs)))
        np.add.at(sums, at, counts)
        return counts / np.maximum(sums[at], 1)

    p2 = w2 * share(bi[1], bi[0] // base) + w1 * p1[np.searchsorted(uni[0], bi[0] % base)]
    p3 = w3 * share(tri[1], tri[0] // base) + p2[np.searchsorted(bi[0], tri[0] % (base * base))]
    model.keys = [tri[0], bi[0], uni[0]]
    model.scores = np.log(np.vstack([p3, p2, w1 * p1, w1 * none])).astype(np.float32)
    of, used = _alphabet()[1][letter], np.zeros((N_SCRIPTS, len(langs)))
    np.add.at(used, (of, column), n)
    model.allowed = (used >= MIN_SHARE * totals) & (used > 0)
    model.default = int(totals.argmax())
    return model


def fit(docs: DataFrame, **options) -> LanguageModel:
    """Counts of the sample (see ``sample``) by Spark; what comes to the driver is bounded by the sample."""
    counts = sample(docs, **options).mapInArrow(lean(_count_trigrams), "lang string, key long, n long").groupBy("lang", "key").agg(
        F.sum("n").alias("n")).orderBy("lang", "key").toArrow()
    if not counts.num_rows:
        return LanguageModel([], np.zeros(0, np.int64), [], np.zeros((0, 0)), np.zeros((N_SCRIPTS, 0)), 0)
    return _model(np.array(counts.column(0).to_pylist(), object), counts.column(1).to_numpy(), counts.column(2).to_numpy())


# ---------------------------------------------------------------- labelling

def word_scores(model: LanguageModel, words: Words) -> np.ndarray:
    """(words x languages): log-probability of each word; far below for languages its script rules out."""
    scores = np.add.reduceat(model.letter_scores(words).astype(np.float64), words.first, axis=0)
    allowed = model.allowed[words.script]
    known = allowed.any(axis=1)
    scores[known] = np.where(allowed[known], scores[known], OUT)
    scores[~known] = 0.0  # nothing is known of this script
    return scores


def best_path(scores: np.ndarray, text: np.ndarray, penalty: float) -> np.ndarray:
    """Label of each word: the best path through each text, all texts step by step together."""
    n_words, n_langs = scores.shape
    label = np.zeros(n_words, np.int64)
    if not n_words:
        return label
    begins = np.flatnonzero(np.diff(text, prepend=-1))
    sizes = np.diff(np.append(begins, n_words))
    order = np.argsort(-sizes, kind="stable")
    begins, sizes = begins[order], sizes[order]
    active = np.searchsorted(-sizes, -np.arange(1, sizes[0] + 1), "right")  # texts with more than t words
    stays, jump = np.zeros((n_words, n_langs), bool), np.zeros(n_words, np.int64)
    value = scores[begins].copy()
    for t in range(1, int(sizes[0])):
        m = active[t]
        at, v = begins[:m] + t, value[:m]
        top = v.argmax(axis=1)
        change = (v[np.arange(m), top] - penalty)[:, None]
        stay = v >= change
        stays[at], jump[at] = stay, top
        value[:m] = np.where(stay, v, change) + scores[at]
    state = value.argmax(axis=1)
    for t in range(int(sizes[0]) - 1, -1, -1):
        m = active[t]
        at, s = begins[:m] + t, state[:m]
        label[at] = s
        if t:
            state[:m] = np.where(stays[at, s], s, jump[at])
    return label


SPANS = "array<struct<lang:string,first_word:long,n_words:long,n_letters:long>>"
_SPAN = pa.list_(pa.struct([("lang", pa.string()), ("first_word", pa.int64()), ("n_words", pa.int64()), ("n_letters", pa.int64())]))


def _label(model: LanguageModel, texts: pa.Array, penalty: float) -> list[pa.Array]:
    """lang_pred, score and spans of each text."""
    rows, words = len(texts), words_of(texts)
    if not len(words.first) or not model.langs:
        return [pa.array([UND] * rows), pa.array(np.zeros(rows)), pa.array([[]] * rows, _SPAN)]
    scores = word_scores(model, words)
    label = best_path(scores, words.text, penalty)
    known = model.allowed[words.script].any(axis=1)
    letters = np.zeros((rows, len(model.langs)))
    np.add.at(letters, (words.text, label), words.size * known)
    every = np.bincount(words.text, words.size, rows)
    lang = np.where(letters.any(axis=1), letters.argmax(axis=1), model.default)
    share = letters[np.arange(rows), lang] / np.maximum(every, 1)
    begin = np.flatnonzero((np.diff(label, prepend=-1) != 0) | (np.diff(words.text, prepend=-1) != 0))
    first_of_text = np.searchsorted(words.text, np.arange(rows))
    span_text = words.text[begin]
    spans = pa.StructArray.from_arrays(
        [pa.array(np.array(model.langs, object)[label[begin]], pa.string()), pa.array(begin - first_of_text[span_text]),
         pa.array(np.diff(np.append(begin, len(label)))), pa.array(np.add.reduceat(words.size, begin))],
        ["lang", "first_word", "n_words", "n_letters"])
    lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(span_text, np.arange(rows + 1)).astype(np.int32)), spans)
    names = np.where(every > 0, np.array(model.langs, object)[lang], UND)
    return [pa.array(names, pa.string()), pa.array(np.where(every > 0, share, 0.0)), lists.cast(_SPAN)]


def label_spans(docs: DataFrame, model: LanguageModel, penalty: float = PENALTY, id_col: str = "doc_id",
                text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score, spans) of every row; the score is the share of letters in spans of lang_pred."""
    limit = max(SLICE_BYTES // max(len(model.langs) // 4, 1), 1 << 16)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, _, _ in text_slices(batch, "text", limit):
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([part.column(0), *_label(model, part.column(1), penalty)],
                                                 ["doc_id", "lang_pred", "score", "spans"])

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return texts.mapInArrow(lean(run), f"doc_id long, lang_pred string, score double, spans {SPANS}")


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row."""
    return label_spans(docs, model).select(
        "doc_id", F.coalesce(fold(F.col("doc_id")) == HELD_OUT, F.lit(False)).alias("held_out"), "lang_pred", "score")
