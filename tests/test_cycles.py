"""Cycle cutting: components and cuts equal those of a plain walk, and rounds leave no copies of the links behind."""

import os
import random
from collections import Counter

from routelens.operators import resolve as R
from routelens.session import checkpoint_dir

SCHEMA = "repo_id string, src string, dst string, via_array boolean"


def reached(links, start):
    seen, todo = {start}, [start]
    while todo:
        for d in links.get(todo.pop(), ()):
            if d not in seen:
                seen.add(d)
                todo.append(d)
    return seen


def components(rows):
    """(repo_id, node) -> the largest name of its component, by walks from every node."""
    out, nodes = {}, set()
    for r, s, d, _ in rows:
        out.setdefault((r, s), set()).add((r, d))
        nodes |= {(r, s), (r, d)}
    far = {n: reached(out, n) for n in nodes}
    return {n: max(m for _, m in (x for x in far[n] if n in far[x])) for n in nodes}


def cuts(rows):
    scc = components(rows)
    inside = [x for x in rows if scc[x[0], x[1]] == scc[x[0], x[2]]]
    delta, arrays = Counter(), {}
    for r, s, d, via in inside:
        delta[r, s] -= 1
        delta[r, d] += 1
        arrays[r, s] = max(arrays.get((r, s), 0), int(via or 0))
    rank = lambda r, n: (delta[r, n], arrays.get((r, n), 0), n)
    return {x for x in inside if rank(x[0], x[1]) >= rank(x[0], x[2])}


def graph(seed, n=14, links=22):
    rnd = random.Random(seed)
    rows = [(rnd.choice("rs"), f"n{rnd.randrange(n)}", f"n{rnd.randrange(n)}", rnd.choice([True, False, None])) for _ in range(links)]
    for r, s, d, _ in rnd.sample(rows, 5):  # mutual pairs, also several of one node
        rows.append((r, d, s, rnd.random() < 0.5))
    return rows + rows[:5]


def test_components_and_cuts_equal_a_plain_walk(spark):
    ring = [("q", f"a{i}", f"a{(i + 1) % 3}", False) for i in range(3)]  # three groups of two, linked in a circle
    ring += [("q", f"a{i}", f"b{i}", True) for i in range(3)] + [("q", f"b{i}", f"a{i}", False) for i in range(3)]
    rows = graph(2) + ring + [("x", "x", "x", None)]
    e = spark.createDataFrame(rows, SCHEMA).coalesce(1)
    scc = R.strongly_connected(e)
    assert {(r.repo_id, r.node): r.scc for r in scc.collect()} == components(rows)
    for given in (None, scc):
        got = [tuple(r) for r in R.break_ref_cycles(e, given).collect()]
        assert len(got) == len(set(got)) and set(got) == cuts(rows)


def test_links_without_a_key_are_on_no_cycle(spark):
    rows = [(None, "a", "a", True), ("r", None, None, True), ("r", "a", "b", True), ("r", "b", "a", False), ("r", "b", None, False)]
    e = spark.createDataFrame(rows, SCHEMA)
    assert [tuple(r) for r in R.break_ref_cycles(e).collect()] == [("r", "a", "b", True)]
    assert Counter(map(tuple, R.strongly_connected(e).collect())) == Counter(
        [(None, "a", "a"), ("r", None, None), ("r", "a", "b"), ("r", "b", "b")])


def size(top):
    return sum(os.path.getsize(f"{d}/{x}") for d, _, names in os.walk(top) for x in names)


def test_rounds_leave_no_copies_of_the_links(spark, tmp_path):
    rnd = random.Random(3)
    rows = [("r", f"part_{rnd.randrange(2000)}", f"supplier_{rnd.randrange(200)}", True) for _ in range(20000)]
    rows += [("r", d, s, False) for _, s, d, _ in rows[::7]] + [("r", f"chain_{i}", f"chain_{i + 1}", False) for i in range(6)]
    e = spark.createDataFrame(rows, SCHEMA).repartition(4).cache()
    e.write.parquet(str(tmp_path / "links"))
    top = checkpoint_dir(spark).removeprefix("file:")
    before = size(top)
    assert R.break_ref_cycles(e).count() > 0
    assert size(top) - before < 4 * size(tmp_path / "links")
