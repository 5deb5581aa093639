"""Every operator against a brute-force version on hostile rows, and on an empty table."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from routelens.llm import (chat_format, common, embed_dedup, license_scan, minhash_dedup, mixing, packing, suffix_dedup,
                           token_files, tokens, topk, toxicity)
from routelens.llm.components import connected_components


def low(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


@pytest.fixture(scope="module")
def plain():
    t = Tokenizer.from_file(tokens.vocabulary_path())
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


class Union(dict):
    def __missing__(self, k):
        return k

    def top(self, k):
        while self[k] != k:
            k = self[k]
        return k

    def join(self, a, b):
        a, b = self.top(a), self.top(b)
        self[max(a, b)] = min(a, b)


# ---------------------------------------------------------------- tokens, packing, files

@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from(" \n\t.,'-sté²Ⅷ٣\x1c\x85᠎　<|>"), st.characters(exclude_categories=["Cs"]))), max_size=5))
def test_segments_encode_like_whole_texts(texts):
    t = Tokenizer.from_file(tokens.vocabulary_path()) if not hasattr(test_segments_encode_like_whole_texts, "t") else None
    if t is not None:
        test_segments_encode_like_whole_texts.t = t
    t = test_segments_encode_like_whole_texts.t
    got = [np.frombuffer(b, "<u4").tolist() for b in tokens.encoder(tokens.vocabulary_path()).encode(texts)]
    assert got == [t.encode(x, add_special_tokens=False).ids for x in texts]


def test_added_tokens_in_texts_are_encoded_as_the_library_does(spark, plain):
    texts = ["x <|endoftext|> y", "<|endoftext|>", "a <|endoftext|", "a<|endoftext|><|endoftext|> b", "plain text"]
    assert [np.frombuffer(b, "<u4").tolist() for b in tokens.encoder(tokens.vocabulary_path()).encode(texts)] == [plain(t) for t in texts]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.n_tokens for r in token_files.token_files(spark, docs).collect()}
    assert got == {i: len(plain(t)) + 1 for i, t in enumerate(texts)}


@settings(max_examples=80, deadline=None)
@given(st.dictionaries(st.integers(1, 20), st.integers(1, 4), max_size=6), st.integers(1, 24))
def test_closest_fill_is_the_largest_sum(counts, room):
    sums = {0}
    for n, c in counts.items():
        sums = {s + n * k for s in sums for k in range(c + 1)}
    got = packing.closest_fill(counts, room)
    assert sum(n * m for n, m in got.items()) == max(s for s in sums if s <= room)
    assert all(m <= counts[n] for n, m in got.items())


def test_packing_covers_every_id_once(spark, hostile, hostile_rows, plain):
    rows = packing.pack(hostile, 64, tokens.vocabulary_path(), 1).collect()
    want = Counter()
    for d, t, *_ in hostile_rows:
        ids = plain(t) + [1]
        for s in range(0, len(ids), 64):
            part = ids[s:s + 64]
            want[d, s, len(part), zlib.crc32(np.array(part, "<u4").tobytes()), len(ids)] += 1
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in rows) == want
    windows = defaultdict(list)
    for r in rows:
        windows[r.sequence_id].append((r.offset, r.length))
    for parts in windows.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 64
    assert len(windows) <= math.ceil(sum(k[2] * c for k, c in want.items()) / 64) + 2


def test_token_files_hold_the_documents(spark, hostile, hostile_rows, plain):
    got = [tuple(r) for r in token_files.token_files(spark, hostile).orderBy("start").collect()]
    at, want = 0, []
    for d, t in sorted(((d, t or "") for d, t, *_ in hostile_rows if d is not None)):
        ids = plain(t) + [0]
        want.append((d, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert got == want


def test_empty_tables(spark, no_docs):
    path = tokens.vocabulary_path()
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>")
    turns = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    for df in (packing.pack(no_docs, 64, path, 1), token_files.token_files(spark, no_docs), license_scan.license_scan(no_docs),
               suffix_dedup.repeat_report(no_docs), suffix_dedup.remove_repeats(no_docs), minhash_dedup.near_duplicates(no_docs),
               mixing.mixed(no_docs), toxicity.score(no_docs, toxicity.fit(no_docs, labels)),
               embed_dedup.embedding_duplicates(vectors), topk.top_k(vectors, vectors), chat_format.digests(chat_format.format_examples(turns)),
               connected_components(spark.createDataFrame([], "u long, v long"))):
        assert df.count() == 0


# ---------------------------------------------------------------- licences

def test_license_places(hostile, hostile_rows):
    got = Counter((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in license_scan.license_scan(hostile).collect())
    word, want = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), Counter()
    for d, t, *_ in hostile_rows:
        w = word.findall(low(t))
        hits = [(i, p) for p in license_scan.BASE_PHRASES for i in range(len(w)) if w[i:i + len(p.split())] == p.split()]
        at = [i for i, _ in hits]
        want[d, len(w), len(hits), min(at, default=None), max(at, default=None),
             ",".join(sorted({license_scan.BASE_PHRASES[p] for _, p in hits}))] += 1
    assert got == want


@pytest.mark.parametrize("text,postfix", [
    ("MIT OR Apache-2.0 AND BSD-3-Clause", ["mit", "apache-2.0", "bsd-3-clause", "and", "or"]),
    ("(MIT OR Apache-2.0) AND GPL-2.0 WITH x", ["mit", "apache-2.0", "or", "gpl-2.0", "x", "with", "and"]),
    ("MIT AND", None), ("(MIT", None), ("MIT)", ["mit"]), ("MIT (see LICENSE)", ["mit"]), ("(MIT) or (", None), ("", None), ("MIT some prose", ["mit"])])
def test_expressions(text, postfix):
    assert license_scan.expression_postfix(text) == postfix


@pytest.mark.parametrize("text,labels", [
    ("SPDX-License-Identifier: MIT (see LICENSE)", "mit"), ("(SPDX-License-Identifier: MIT)", "mit"), ("SPDX-License-\nIdentifier: MIT", "mit"),
    ("SPDX-License-Identifier:\n  Apache-2.0 OR MIT\nprose", "apache,mit"), ("SPDX-License-Identifier: Zlib", "zlib"), ("SPDX-License-Identifier", ""),
    ("é SPDX-License-Identifier: (MIT\nprose)", ""), ("# SPDX-License-Identifier: GPL-2.0 WITH Classpath-exception-2.0", "gpl")])
def test_tag_expressions(text, labels):
    assert license_scan.judge(text)[5] == labels and (license_scan.judge(text)[6] > 0) == bool(labels)


# ---------------------------------------------------------------- chat

def test_chat_reads_back(spark):
    rows = [(1, 0, "user", "a<b\\[x"), (1, 1, "assistant", "</s>[INST] \\l"), (1, 2, "user", None), (1, 3, "assistant", ""),
            (2, 0, "sys\nt\\n", "\\s\\"), (3, None, None, None), (3, 0, "assistant", "q"), (3, 0, "assistant", "q"), (None, 1, "user", "n")]
    turns = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, example int")
    examples = chat_format.format_examples(turns)
    got = {r.conv_id: r for r in chat_format.digests(examples).collect()}
    for conv in (1, 2, 3, None):
        own = sorted(((-1 if t is None else t, r or "", x or "") for c, t, r, x in rows if c == conv))
        loss = "".join(x for _, r, x in own if r == "assistant")
        digest = hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in own).encode()).hexdigest()
        r = got[conv]
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == (
            len(own), digest, len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert examples.where("conv_id = 1").count() == 2
    assert "ArrowEval" not in examples._jdf.queryExecution().toString()


# ---------------------------------------------------------------- vectors

def vectors_of(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, v string, rep string")


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(3)
    base = rng.standard_normal((12, 16))
    rows = []
    for i in range(300):
        v = base[i % 12] + (0.2 if i < 150 else 2.0) * rng.standard_normal(16)
        rows.append((i * 3, [float(np.float32(x)) for x in v]))
    rows += [(2000, rows[0][1]), (2000, rows[0][1]), (2001, rows[0][1]), (2002, None), (2003, []), (2004, [0.0] * 16),
             (2005, [float("nan")] * 16), (2006, [None] * 16), (2007, [float("inf")] + [1.0] * 15), (None, rows[1][1]), (2008, [1.0, 2.0])]
    return rows, vectors_of(spark, [(*r, 1, "v", "r") for r in rows])


def finite(v):
    return bool(v) and all(x is not None and math.isfinite(x) for x in v)


def test_links_and_components(vectors):
    rows, table = vectors
    valid = {d: np.array(v, float) for d, v in rows if d is not None and finite(v) and any(v)}
    n, up = Counter(), Union()
    for a in valid:
        for b in valid:
            if a < b and len(valid[a]) == len(valid[b]):
                x, y = valid[a], valid[b]
                if x @ y / math.sqrt(x @ x) / math.sqrt(y @ y) >= 0.9:
                    n[a] += 1
                    n[b] += 1
                    up.join(a, b)
    got = embed_dedup.embedding_duplicates(table).collect()
    named = {r.vec_id: r for r in got if r.vec_id is not None}
    assert len(got) == len(named) + 1 and set(named) == {d for d, _ in rows if d is not None}
    for d, r in named.items():
        assert (r.n_links, r.component_id, r.kept) == (n[d], up.top(d), up.top(d) == d), d


def test_top_k(spark, vectors):
    rows, table = vectors
    ints = sorted({(d, tuple(math.floor(1024 * x) for x in v)) for d, v in rows if d is not None and finite(v)})
    got = defaultdict(list)
    for r in topk.top_k(table, table.where("vec_id % 20 = 0 or vec_id = 2008"), k=4).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    for q, v in ints:
        if q % 20 == 0 or q == 2008:
            every = sorted((-sum(a * b for a, b in zip(v, w)), c) for c, w in ints if c != q and len(w) == len(v))
            assert got[q] == [(c, -s) for s, c in every[:4]], q


def test_top_k_refuses_scores_beyond_64_bits(spark):
    table = spark.createDataFrame([(0, [1e300, 1.0]), (1, [1e300, 2.0])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="too large"):
        topk.top_k(table, table).collect()


def test_top_k_lists_stop_early_and_right():
    rng = np.random.default_rng(1)
    for spread in (1, 40):
        values = rng.integers(-spread, spread + 1, (700, 8)) * 25
        lists = topk.sorted_lists(values)
        for q in (*rng.integers(-5, 6, (6, 8)), np.zeros(8, int)):
            got, total = topk.best_of_block(q, values, lists, np.arange(700), 5)
            want = np.lexsort((np.arange(700), -(values @ q)))[:5]
            assert got.tolist() == want.tolist() and total.tolist() == (values @ q)[want].tolist()


# ---------------------------------------------------------------- passages

@pytest.mark.parametrize("n,letters", [(0, 2), (1, 2), (49, 1), (300, 1), (2000, 2), (2500, 40), (2500, 256)])
def test_suffix_array(n, letters):
    t = np.random.default_rng(n).integers(0, letters, n).astype(np.uint8)
    if n > 1000:
        t[600:900] = t[100:400]
    sa, raw = suffix_dedup.suffix_array(t, 50), t.tobytes()
    heads = [raw[i:i + 50] for i in sa]
    assert sorted(sa.tolist()) == list(range(n)) and heads == sorted(heads)
    assert suffix_dedup.common_prefix_reaches(t, sa, 50).tolist() == [len(a) == 50 and a == b for a, b in zip(heads, heads[1:])]


def brute_repeats(rows, width=50):
    seen, out = {}, []
    for d, t in rows:
        raw = (t or "").encode()
        for i in range(len(raw) - width + 1) if d is not None else ():
            w = raw[i:i + width]
            seen[w] = min(seen.get(w, d), d)
    for d, t in rows:
        raw = (t or "").encode()
        gone = [False] * len(raw)
        for i in range(len(raw) - width + 1) if d is not None else ():
            if seen[raw[i:i + width]] < d:
                gone[i:i + width] = [True] * width
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        out.append((d, len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return Counter(out)


@pytest.mark.parametrize("chunk", [1 << 20, 300])
def test_repeats(hostile, hostile_rows, monkeypatch, chunk):
    monkeypatch.setattr(suffix_dedup, "CHUNK_BYTES", chunk)
    rows = [(r[0], r[1]) for r in hostile_rows if r[0] not in (7, 8)]
    got = Counter(tuple(r) for r in suffix_dedup.repeat_report(hostile.where("doc_id is null or doc_id not in (7, 8)")).collect())
    assert got == brute_repeats(rows)


def test_crowded_anchor_is_split_by_content(monkeypatch):
    monkeypatch.setattr(suffix_dedup, "CHUNK_BYTES", 256)
    rng = np.random.default_rng(5)
    middle = b"m" * 40
    texts = [rng.integers(97, 100, 30).astype(np.uint8).tobytes() + middle + rng.integers(97, 100, 30).astype(np.uint8).tobytes() for _ in range(40)]
    data, size = np.frombuffer(b"".join(texts), np.uint8), np.full(40, 100)
    whole = suffix_dedup._window_lows(data, size, np.arange(40), 50)
    best = {}
    for d, t in enumerate(texts):
        for i in range(51):
            best.setdefault(t[i:i + 50], d)
    assert whole.tolist() == [best[t[i:i + 50]] for t in texts for i in range(51)]


def test_cut_texts_stay_valid(hostile):
    got = {r.doc_id: r.text for r in suffix_dedup.remove_repeats(hostile).collect()}
    assert got[3] == "intro  outro" and got[2] == "" and got[10] == "x "


# ---------------------------------------------------------------- near duplicates

def test_near_duplicates(hostile, hostile_rows):
    word, sets = re.compile("[^\x20\x09-\x0D]+"), {}
    for d, t in sorted(((d, t or "") for d, t, *_ in hostile_rows if d is not None)):
        w = word.findall(low(t))
        sets.setdefault(d, {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()})
    up = Union()
    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                up.join(a, b)
    got = [r for r in minhash_dedup.near_duplicates(hostile).collect() if r.doc_id is not None]
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == {
        d: (len(s), up.top(d), up.top(d) == d) for d, s in sets.items()}
    kept = [r.doc_id for r in minhash_dedup.drop_near_duplicates(hostile).collect()]
    assert {2, 12, 8} & set(kept) == set() and kept.count(None) == 2


def test_words_of_equal_structure_are_told_apart(spark):
    word = "a"
    for _ in range(10):  # 1024 letters in Thue-Morse order: every polynomial modulo 2^64 takes it for its complement
        word += word.translate(str.maketrans("ab", "ba"))
    other = word.translate(str.maketrans("ab", "ba"))
    rows = [(1, word), (2, other), (3, "w x y z " + word), (4, "w x y z " + other), (5, word)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: (1, 1), 2: (1, 2), 3: (1, 3), 4: (1, 4), 5: (1, 1)}


def test_close_signatures_share_a_key():
    rng = np.random.default_rng(2)
    for errors in (0, 1, 12, 23):
        a = rng.integers(0, 1 << 16, (50, minhash_dedup.SYMBOLS)).astype(np.uint16)
        b = a.copy()
        for row in b:
            row[rng.choice(len(row), errors, False)] ^= 1
        assert (minhash_dedup.index_keys(a) == minhash_dedup.index_keys(b)).any(axis=1).all()


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(5, 5), (None, 7), (3, 2)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100 + i: 100 for i in range(30)}


# ---------------------------------------------------------------- mixing

def test_poisson_counts(spark, hostile, hostile_rows):
    rows = mixing.replicate(hostile, weights={"s0": 0.001, "s1": 0.999}, epochs=3.0).collect()
    chars = Counter()
    for _, t, _, s, *_ in hostile_rows:
        chars[s] += len(t or "")
    for r in rows:
        rate = {"s0": 0.001, "s1": 0.999}.get(r.source, 0.0) * 3 * sum(chars.values()) / chars[r.source] if chars[r.source] else 1.0
        assert math.isclose(r.mix_rate, rate)
        u = int(hashlib.md5(f"1|{'' if r.doc_id is None else r.doc_id}".encode()).hexdigest()[:13], 16) / 2 ** 52
        k, p = 0, math.exp(-rate)
        c = p
        while c <= u:
            k += 1
            p *= rate / k
            c += p
        assert r.mix_count == k and 1 <= r.mix_copy <= k
    assert {r.source for r in rows} <= {"s0", "s1", None} | {s for s in chars if not chars[s]}


def test_large_means_are_sums(spark):
    docs = spark.createDataFrame([(i, "a" if i else "b" * 3_000_000, "tiny" if i else "large") for i in range(40)], "doc_id long, text string, source string")
    counts = [r.mix_count for r in mixing.replicate(docs, weights={"tiny": 1.0, "large": 1.0}, epochs=0.03).where("mix_copy = 1 and source = 'tiny'").collect()]
    mean = 0.5 * 0.03 * 3_000_039 / 39
    assert len(counts) == 39 and mean > mixing.MAX_MEAN and abs(sum(counts) / 39 - mean) < 6 * math.sqrt(mean / 39)


# ---------------------------------------------------------------- toxicity

def test_toxicity_learns_and_ignores_held_out(spark):
    rng = np.random.default_rng(4)
    bad, good = ["vilest", "scumbag", "rotter"], [a + b for a in ("ta", "ri", "mo", "lu") for b in ("ne", "sti", "ko", "ra")]
    docs, labels = [], []
    for i in range(600):
        w = rng.choice(good, 30).tolist()
        if i % 4 == 0:
            w[3] = w[17] = str(rng.choice(bad))
        docs.append((i, " ".join(w), "x"))
        labels.append((i, int(i % 4 == 0)))
    docs += [(None, None, None), (9000, "", "x"), (9001, "vilest scumbag " * 9000, "x")]
    table = spark.createDataFrame(docs, "doc_id long, text string, f0 string")
    train = spark.createDataFrame(labels + [(None, 1), (3, None)], "doc_id long, toxic int")
    model = toxicity.fit(table, train)
    got = toxicity.score(table, model).collect()
    assert len(got) == len(docs) and all(0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out]
    assert {r.doc_id for r in held} == {d for d, *_ in docs if d is not None and zlib.crc32(str(d).encode()) % 5 == 0}
    right = sum(r.predicted == int(r.doc_id % 4 == 0) for r in held if r.doc_id < 600)
    assert right >= 0.95 * sum(r.doc_id < 600 for r in held)
    flipped = spark.createDataFrame([(d, 1 - t if zlib.crc32(str(d).encode()) % 5 == 0 else t) for d, t in labels], "doc_id long, toxic int")
    again = {r.doc_id: r.score for r in toxicity.score(table, toxicity.fit(table, flipped)).collect()}
    assert all(again[r.doc_id] == r.score for r in got)
    assert toxicity.keep_ordinary(table, model).count() == sum(r.predicted == 0 for r in got)


def test_tally_parts_add_up():
    rng = np.random.default_rng(5)
    keys = rng.integers(0, 50, 4000)
    tally, total = toxicity._Tally(), Counter()
    for i, part in enumerate(np.array_split(keys, 40)):
        tally.add(part)
        if i % 7 == 6:  # given away in parts, as the gathering does beyond HELD_KEYS
            total.update(dict(zip(*(x.tolist() for x in tally.take()))))
            assert tally.held == 0
    total.update(dict(zip(*(x.tolist() for x in tally.take()))))
    assert total == Counter(keys.tolist())
    assert [len(x) for x in tally.take()] == [0, 0]


def test_shared_counts_are_written_as_longs():
    rows = list(toxicity._rows(2, np.arange(70_000), np.full(70_000, 2**32 - 1, np.uint32)))
    assert [r.num_rows for r in rows] == [1 << 16, 70_000 - (1 << 16)]
    assert rows[1].column(2).to_pylist()[-1] == 2**32 - 1


def test_lean_passes_batches_on():
    assert list(common.lean(lambda batches: (b * 2 for b in batches))(iter([1, 2, 3]))) == [2, 4, 6]
