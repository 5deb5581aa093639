"""The resolution loop on a small tree: rounds, files once, subtypes in the frontier, every status."""

import pytest

from routelens.operators import loop as L


@pytest.fixture(scope="module")
def tree(spark):
    df = lambda rows, cols: spark.createDataFrame([("r", *x) for x in rows], "repo_id string, " + cols)
    index = df([("A", "a.py"), ("A2", "a.py"), ("B", "b.py"), ("Sub", "s.py"), ("Bad", "bad.py"), ("Not", "b.py"), ("C", "c.py"), ("D", "d.py")], "name string, path string")
    extracted = df([("a.py", "A", True), ("a.py", "A2", True), ("b.py", "B", True), ("s.py", "Sub", True), ("bad.py", None, False), ("c.py", "C", True),
                    ("d.py", "D", True), ("b.py", None, True)], "path string, name string, ok boolean")
    refs = df([("A", "B"), ("A", "A2"), ("A2", "Gone"), ("A2", "Marked"), ("B", "A"), ("B", "string"), ("B", "Bad"), ("B", "Not"), ("Sub", "C"), ("C", "D"), ("D", "A")],
              "name string, target string")
    inherits = df([("A", "Sub"), ("A", "B")], "name string, child string")
    requests = df([("A",), ("A",), ("a2",)], "name string")
    return requests, index, extracted, refs, inherits, df([("Marked",)], "name string")


def test_rounds_and_statuses(tree):
    *args, marked = tree
    found = L.resolution_loop(*args, max_rounds=3)
    names = {r.name: (r.round, r.reason, r.parent) for r in found.names.collect()}
    assert found.names.count() == len(names) and names == {
        "A": (1, "request", None), "a2": (1, "request", None), "B": (2, "ref", "A"), "Gone": (2, "ref", "A2"), "Marked": (2, "ref", "A2"), "Sub": (2, "subtype", "A"),
        "string": (3, "ref", "B"), "Bad": (3, "ref", "B"), "Not": (3, "ref", "B"), "C": (3, "ref", "Sub"), "D": (4, "ref", "C")}
    assert {(r.path, r.round, r.ok) for r in found.files.collect()} == {
        ("a.py", 1, True), ("b.py", 2, True), ("s.py", 2, True), ("bad.py", 3, False), ("c.py", 3, True)}
    assert {r.name: r.status for r in L.classify(found, marked).collect()} == {
        "A": "resolved", "a2": "resolved", "B": "resolved", "Gone": "not_resolved", "Marked": "marked_unresolvable", "Sub": "resolved", "string": "inline",
        "Bad": "extraction_failed", "Not": "missing_in_file", "C": "resolved", "D": "max_depth"}


def test_fixpoint_and_no_requests(tree):
    requests, *rest, marked = tree
    found = L.resolution_loop(requests, *rest)
    assert {r.name: r.status for r in L.classify(found, marked).collect()}["D"] == "resolved"
    assert found.files.groupBy("path").count().where("count > 1").isEmpty()
    nothing = L.resolution_loop(requests.limit(0), *rest)
    assert nothing.names.isEmpty() and nothing.files.isEmpty() and L.classify(nothing, marked).isEmpty()
