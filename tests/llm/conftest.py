"""Small hostile tables shared by the operator tests."""

import pytest

DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " \
             "n long, rows int, spans string, score double, mix_rate string, component_id string, kept string"


@pytest.fixture(scope="session")
def hostile_rows():
    """Nulls everywhere, empty and long texts, ties, repeated rows, clashing extra columns."""
    passage = "the quick brown fox jumps over the lazy dog again and again until the long night falls upon us"
    long = " ".join(f"w{i % 997}x{i % 31}" for i in range(30_000))
    texts = [(1, passage), (2, passage), (3, f"intro {passage} outro"), (4, ""), (5, None), (6, "mit license, MIT License."),
             (7, long), (8, long + " tail"), (9, "é" * 60), (10, "x " + "é" * 60), (11, "two words"), (12, "two words"),
             (None, passage), (None, None), (13, passage), (13, passage), (14, None), (15, " \t\n "), (16, "a" * 400), (17, "b" + "a" * 400)]
    return [(d, t, None if d == 3 else "en", None if (d or 0) % 4 == 0 else f"s{(d or 0) % 3}", None, 7, 1, "s", 0.5, "r", "c", "k")
            for d, t in texts]


@pytest.fixture(scope="session")
def hostile(spark, hostile_rows):
    return spark.createDataFrame(hostile_rows, DOC_SCHEMA)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOC_SCHEMA)
