"""The toxicity model against dictionaries of exact contexts, more of them than a small hash holds apart."""

import math
import zlib
from collections import Counter, defaultdict

import numpy as np

from routelens.llm import toxicity


def _codes(text):
    sym = [0] * 5 + [int(toxicity._SYMBOL[b]) for b in text.encode()]
    return [tuple(sym[i - 5:i + 1]) for i in range(5, len(sym))]


def _lower(counts):
    """Interpolated probabilities of the last symbol, by order, from five-symbol counts."""
    orders = [counts]
    for _ in range(4):
        orders.append(Counter(k[1:] for k in orders[-1]))
    p = {k: n / sum(orders[-1].values()) for k, n in orders[-1].items()}
    for c in reversed(orders[:-1]):
        total, kinds = Counter(), Counter()
        for k, n in c.items():
            total[k[:-1]] += n
            kinds[k[:-1]] += 1
        p = {k: max(n - 0.75, 0) / total[k[:-1]] + 0.75 * kinds[k[:-1]] / total[k[:-1]] * p[k[1:]] for k, n in c.items()}
    return p


def test_features_of_exact_contexts(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "UNIT_BYTES", 20_000)  # several units
    rng = np.random.default_rng(8)
    texts = {i: "".join(chr(97 + c) for c in rng.integers(0, 26, 150)) for i in range(800)}
    texts[800] = texts[3][:60] + " " + texts[8][40:90]
    toxic = {i: i % 3 == 0 for i in range(800)}
    fold = {i: zlib.crc32(str(i).encode()) % 5 for i in texts}
    shared, classes = Counter(), (Counter(), Counter())
    for i, t in texts.items():
        shared.update(c[1:] for c in _codes(t))
        if i in toxic and fold[i] not in (toxicity.HELD_OUT, toxicity.CALIBRATION):
            classes[toxic[i]].update(_codes(t))
    p5 = _lower(shared)
    parts = []
    for c in classes:
        total, kinds = Counter(), Counter()
        for k, n in c.items():
            total[k[:5]] += n
            kinds[k[:5]] += 1
        parts.append((c, total, kinds))

    def ratio(k):
        probs = []
        for c, total, kinds in parts:
            back = 0.75 * kinds[k[:5]] / total[k[:5]] if total[k[:5]] else 1.0
            own = max(c[k] - 0.75, 0) / total[k[:5]] if total[k[:5]] else 0.0
            probs.append(own + back * p5[k[1:]])
        return max(-127, min(127, round(math.log(probs[1] / probs[0]) * 16))) / 16

    docs = spark.createDataFrame(sorted(texts.items()), "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(t)) for i, t in toxic.items()], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    contexts = {k[:5] for c in classes for k in c}
    assert model.cells.count() == len(contexts) > 50_000
    got = defaultdict(list)
    import pyarrow as pa

    def out(rows, f):
        return pa.RecordBatch.from_arrays([rows.column(0), *(pa.array(c) for c in f.T)], ["doc_id", "f0", "f1", "f2"])

    for r in toxicity._with_features(docs, model.cells, "text", out, "doc_id long, f0 double, f1 double, f2 double").collect():
        got[r.doc_id].append((r.f0, r.f1))
    for i in (*range(0, 800, 16), 800):
        q = [ratio(k) for k in _codes(texts[i])]
        want = sum(q) / len(q), max(sum(q[a:a + 8]) / 8 for a in range(len(q) - 7))
        assert len(got[i]) == 1 and np.allclose(got[i][0], want, atol=0.005), i
