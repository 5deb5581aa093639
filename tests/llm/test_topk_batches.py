"""The sorted lists of a block are read once for all queries, and the bounds lose no candidate."""

import numpy as np

from routelens.llm import topk


def best(query, values, ids, k):
    total = values @ query
    rows = np.lexsort((ids, -total))[:k]
    return rows.tolist(), total[rows].tolist()


def test_queries_together_equal_brute_force():
    rng = np.random.default_rng(5)
    for trial in range(120):
        n, dims, k = int(rng.integers(1, 300)), int(rng.integers(1, 10)), int(rng.integers(1, 12))
        spread = int(rng.choice([1, 3, 1000, 1 << 20, 1 << 28]))  # single precision does not hold the last two
        values = rng.integers(-spread, spread + 1, (n, dims))
        if trial % 3 == 0:
            values[:n // 2] = values[0]
        queries = np.concatenate([np.zeros((1, dims), int), values[:1], rng.integers(-spread, spread + 1, (70, dims))])
        ids = rng.permutation(n)
        got = list(topk.best_of_block_each(queries, values, topk.sorted_lists(values), ids, k))
        assert len(got) == len(queries)
        for q, (rows, total) in zip(queries, got):
            assert (rows.tolist(), total.tolist()) == best(q, values, ids, k), (trial, n, dims, k, spread)


def test_lists_are_read_once_for_all_queries(monkeypatch):
    rng = np.random.default_rng(6)
    values = rng.integers(-300, 301, (4096, 32))
    lists, queries = topk.sorted_lists(values), rng.integers(-300, 301, (256, 32))
    put, read = np.put_along_axis, []
    monkeypatch.setattr(topk.np, "put_along_axis", lambda to, rows, *rest, **kw: (read.append(rows.size), put(to, rows, *rest, **kw)))
    got = list(topk.best_of_block_each(queries, values, lists, np.arange(4096), 11))
    assert len(got) == 256 and sum(read) <= 4 * values.size  # an entry: from either end, once as a value and once as read
