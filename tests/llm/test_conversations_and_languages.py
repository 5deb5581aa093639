"""The prefix trie, conversation repair and language spans against brute force on hostile rows."""

import hashlib
import itertools
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from routelens.llm import chat_repair, language_id, prefix_trie

TURNS = "conv_id long, turn long, role string, text string, depth string, n_words int, k1 string, kept string, gaps string"


@pytest.fixture(scope="module")
def turn_rows():
    """Shared beginnings over blocks of twenty, ties, repeats, nulls, conversations of no rebuilt turn, a long one."""
    rows = []
    for c in [*range(0, 27), 39, 40, 59, 61, 100, 2000, -3, -25]:
        for t in range((c * 7) % 6 + (c == 40) * 300):
            role = "user" if t % 2 == 0 else "assistant"
            rows.append((c, t, role, f"same start {t}." if t < 2 else f"word {c % 3} {t}"))
    rows += [(500, None, None, None), (500, 0, "user", "x?"), (500, 0, "user", "x?"), (500, 0, "assistant", ""), (500, 9, "system", "\t \n"),
             (520, 1, "user", "only"), (None, 1, "user", "lost"), (None, 2, None, "z."), (540, 3, "", "long " * 20000), (540, 3, "tool", "a!")]
    return rows


@pytest.fixture(scope="module")
def turns(spark, turn_rows):
    return spark.createDataFrame([(*r, "d", 3, "k", "x", "g") for r in turn_rows], TURNS)


@pytest.fixture(scope="module")
def no_turns(spark):
    return spark.createDataFrame([], TURNS)


def by_turn(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))


# ---------------------------------------------------------------- prefix trie

def brute_trie(rows):
    own = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            own[c].append((t, r or "", x or ""))
    own = {c: [(r, x) for _, r, x in by_turn(v)] for c, v in own.items()}
    built = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - int(np.fmod(c, 20))  # remainder with the sign of c, as in SQL
        built[c] = tuple(own.get(base, [])[:h] + v[h:])
    nodes = defaultdict(list)
    for c, seq in built.items():
        for d in range(len(seq) + 1):
            nodes[seq[:d]].append(c)
    kids = Counter(p[:-1] for p in nodes if p)
    leaves, saved = Counter(), Counter()
    for p, members in nodes.items():
        worth = (len(members) - 1) * len(re.findall("[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        for d in range(len(p) + 1):
            saved[p[:d]] += worth
            leaves[p[:d]] += not kids[p]
    out = []
    for p, members in nodes.items():
        ends = ",".join(map(str, sorted(c for c in members if built[c] == p)))
        out.append((min(members), len(p), min(nodes[p[:-1]]) if p else None, len(members), kids[p], leaves[p], saved[p],
                    hashlib.sha256(ends.encode()).hexdigest()))
    return Counter(out), nodes


@pytest.mark.parametrize("block", [prefix_trie.BLOCK, 4])
def test_trie(turns, turn_rows, monkeypatch, block):
    monkeypatch.setattr(prefix_trie, "BLOCK", block)  # end lists in several blocks
    want, nodes = brute_trie(turn_rows)
    assert Counter(tuple(r) for r in prefix_trie.node_report(turns).collect()) == want


def test_trie_names_the_turn_of_every_node(turns, turn_rows):
    _, nodes = brute_trie(turn_rows)
    own = defaultdict(list)
    for c, t, r, x in turn_rows:
        own[c].append((t, r or "", x or ""))
    rebuilt, ids = prefix_trie.rebuild(turns)
    got = Counter()
    for r in prefix_trie.node_turns(prefix_trie.prefix_trie(rebuilt, ids), rebuilt).collect():
        got[by_turn(own[r.source_conv])[r.source_pos - 1][1:] if r.depth else None] += 1
    assert got == Counter(p[-1] if p else None for p in nodes)


def test_trie_of_one_long_chain(spark):
    a, b = [c for c in range(1, 40) if zlib.crc32(str(c).encode()) % 4 == 0][:2]  # nothing is taken from a base
    rows = [(a, t, "user", f"w {t}") for t in range(5000)] + [(b, t, "user", f"w {t}") for t in range(4000)]
    got = prefix_trie.node_report(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    top = got.where("depth = 0").collect()[0]
    assert got.count() == 5001 and (top.n_leaves, top.n_convs, top.saved_tokens) == (1, 2, 8000)


# ---------------------------------------------------------------- repair

PLACES = [chat_repair.symbol(i, f) for i in "sua-" for f in (0, 1, 2)]


def brute_repair(symbols):
    """Every edit script with at most two insertions in a place, by cost, then by audit."""
    best = None
    wanted = {"": "u", "s": "u", "u": "a", "a": "u"}
    legal = {"": "su", "s": "u", "u": "a", "a": "u"}

    def walk(i, last, cost, audit, inserted):
        nonlocal best
        if best is not None and cost > best[0]:
            return
        if i == len(symbols):
            if last in ("", "a"):
                best = min(best or (cost, audit), (cost, audit))
        else:
            initial, fault = "-sua"[symbols[i] // 3], symbols[i] % 3
            walk(i + 1, last, cost + 2, audit + "D", 0)
            if fault != 2:
                walk(i + 1, wanted[last], cost + 1 + 5 * fault, audit + "R", 0)
                if initial in legal[last]:
                    walk(i + 1, initial, cost + 5 * fault, audit + "K", 0)
        if inserted < 2:
            walk(i, wanted[last], cost + 5, audit + "I", inserted + 1)

    walk(0, "", 0, "", 0)
    return best


@settings(max_examples=250, deadline=None)
@given(st.lists(st.sampled_from(PLACES), max_size=6))
def test_repair_is_the_least_of_the_cheapest(symbols):
    cost, pieces = chat_repair.repair_edits(bytes(symbols))
    assert (cost, "".join(pieces)) == brute_repair(symbols)


def forward_table(symbols):
    """The same optimum by one table over all rows with whole audits (no halves)."""
    now = {0: (0, "")}
    for s in symbols:
        after = {}
        for state, (cost, audit) in now.items():
            for end, (more, letters) in chat_repair.edits(s)[state].items():
                after[end] = min(after.get(end, (1 << 60, "")), (cost + more, audit + letters))
        now = after
    return min((c + chat_repair.TAIL[s][0], a + chat_repair.TAIL[s][1]) for s, (c, a) in now.items())


@pytest.mark.parametrize("n", [1, 2, 31, 33, 200, 3000])
def test_halves_meet_in_the_optimum(n):
    rng = np.random.default_rng(n)
    for _ in range(5):
        symbols = rng.choice(PLACES, n, p=[.1, .05, .03, .3, .06, .04, .25, .06, .04, .03, .02, .02]).tolist()
        cost, pieces = chat_repair.repair_edits(bytes(symbols))
        assert (cost, "".join(pieces)) == forward_table(symbols) and len(pieces) == n + 1


def brute_damage(rows):
    out = defaultdict(list)
    for c, t, r, x in rows:
        r, x = " " if r is None else r, " " if x is None else x
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        out[c]
        if kind:
            row = (t, "user" if kind == 4 else r, "" if kind == 1 else re.sub("[.!?]", "", x) if kind == 2 else x)
            out[c] += [row] * (2 if kind == 3 else 1)
    return {c: by_turn(v) for c, v in out.items()}


def test_repair_report(turns, turn_rows):
    got = {r.conv_id: r for r in chat_repair.repair_report(turns).collect()}
    want = brute_damage(turn_rows)
    assert set(got) == set(want)
    for c, rows in want.items():
        r, seen, symbols, faults = got[c], set(), [], Counter()
        for _, role, text in rows:
            last = text.rstrip(" \t\n\x0b\f\r")[-1:]
            fault = "blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last not in ".!?" else ""
            seen.add((role, text))
            faults[fault] += 1
            symbols.append(chat_repair.symbol(role[:1], {"": 0, "truncated": 1}.get(fault, 2)))
        ts = {t for t, *_ in rows if t is not None}
        gaps = max(ts) - min(ts) + 1 - len(ts) if ts else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
        cost, audit = forward_table(symbols)
        assert (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit) == (
            gaps, faults["blank"], faults["duplicate"], faults["truncated"], illegal, cost, audit), c
        turns_out, left, last = [], list(rows), ""
        for letter in audit:
            role, text = ("", "") if letter == "I" else left.pop(0)[1:]
            if letter != "D":
                role = role if letter == "K" else "assistant" if last == "u" else "user"
                turns_out.append(f"{role}:{text}")
                last = role[0]
        assert r.repaired_sha256 == hashlib.sha256("\n".join(turns_out).encode()).hexdigest(), c
        assert re.fullmatch("(s?(ua)+)?", "".join(t[0] for t in turns_out))


# ---------------------------------------------------------------- languages

WORDS = {"aa": ["ondre", "thing", "with", "hend", "reth"], "bb": ["lichkeit", "zuver", "schung", "über", "enein"],
         "cc": ["привет", "слово", "земля"], "dd": ["слўва", "зямля", "прывітанне"]}


@pytest.fixture(scope="module")
def documents(spark):
    rng, rows = np.random.default_rng(8), []
    for i in range(400):
        lang = list(WORDS)[i % 4]
        rows.append((i, " ".join(rng.choice(WORDS[lang], 12)) + ".", lang))
    mixed = " ".join([*WORDS["aa"] * 4, *WORDS["bb"] * 6, *WORDS["cc"] * 2])
    rows += [(1000, None, "aa"), (1001, "", "aa"), (1002, "12 -- ?", "bb"), (1003, mixed, None), (None, "with thing", "aa"),
             (1004, "漢字", "aa"), (1005, "reth hend " * 200_000, "aa"), (1003, mixed, None), (1006, "́ ̀", "cc")]
    return spark.createDataFrame([(*r, "s", 0.5) for r in rows], "doc_id long, text string, lang string, spans string, score double")


def test_languages(documents):
    model = language_id.fit(documents)
    got = language_id.identify(documents, model).collect()
    named = {r.doc_id: r for r in got}
    assert len(got) == documents.count() and all(0 <= r.score <= 1 for r in got)
    assert {r.doc_id for r in got if r.held_out} == {d for d in named if d is not None and zlib.crc32(str(d).encode()) % 5 == 0}
    assert all(named[i].lang_pred == list(WORDS)[i % 4] for i in range(400))
    assert [named[i].lang_pred for i in (1000, 1001, 1002, 1006)] == ["und"] * 4
    assert named[1004].lang_pred in WORDS and named[1004].score == 0 and named[1005].lang_pred == "aa"
    assert named[1003].lang_pred == "bb" and named[None].lang_pred == "aa"
    spans = language_id.label_spans(documents.where("doc_id = 1003"), model).first().spans
    assert [(s.lang, s.first_word, s.n_words) for s in spans] == [("aa", 0, 20), ("bb", 20, 30), ("cc", 50, 6)]
    assert sum(s.n_letters for s in spans) == sum(len(w) for w in WORDS["aa"]) * 4 + sum(len(w) for w in WORDS["bb"]) * 6 + sum(len(w) for w in WORDS["cc"]) * 2


def test_held_out_labels_are_not_learned(documents):
    held = language_id.fold(F.col("doc_id")) == language_id.HELD_OUT
    wrong = documents.withColumn("lang", F.when(held, "zz").otherwise(F.col("lang")))
    model, other = language_id.fit(documents), language_id.fit(wrong)
    assert model.langs == other.langs == list(WORDS) and np.array_equal(model.scores, other.scores)


def test_empty_and_unlabelled_tables(spark, documents, no_turns):
    none = language_id.fit(documents.limit(0))
    assert {r.lang_pred for r in language_id.identify(documents, none).collect()} == {"und"}
    assert language_id.identify(documents.limit(0), none).count() == 0
    assert prefix_trie.node_report(no_turns).count() == 0 and chat_repair.repair_report(no_turns).count() == 0


def test_sample_is_bounded(documents):
    assert language_id.sample(documents, rows_per_language=3).groupBy("lang").count().where("count > 3").count() == 0
    assert language_id.sample(documents, letters_per_language=1).count() == 4


def test_letter_scores_alike_by_table_and_search(documents, monkeypatch):
    model = language_id.fit(documents)
    words = language_id.words_of(pa.array(["Thing with слово unknown漢", None, "über Über"]))
    dense = model.letter_scores(words)
    model.tables = None
    monkeypatch.setattr(language_id, "DENSE", 0)
    assert np.array_equal(model.letter_scores(words), dense)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 5), min_size=1, max_size=4), st.integers(1, 3), st.integers(0, 1000))
def test_best_path(sizes, langs, seed):
    scores = np.random.default_rng(seed).integers(-6, 1, (sum(sizes), langs)).astype(float)
    text = np.repeat(np.arange(len(sizes)), sizes)
    label, at = language_id.best_path(scores, text, 2.0), 0
    for n in sizes:
        worth = lambda path: sum(scores[at + i, l] for i, l in enumerate(path)) - 2.0 * sum(a != b for a, b in itertools.pairwise(path))  # noqa: B023, E731, E741
        if n:
            assert worth(label[at:at + n]) == max(worth(p) for p in itertools.product(range(langs), repeat=n))
        at += n


def test_words_split_at_scripts():
    words = language_id.words_of(pa.array(["abc слово", "", "don't éa", None, "漢字かな"]))
    assert words.text.tolist() == [0, 0, 2, 2, 2, 4, 4] and words.size.tolist() == [3, 5, 3, 1, 3, 2, 2]
