"""The pipeline over sf0.001: every stage on what its predecessor kept."""

import corpus_pipeline
from routelens.llm import queries

DIR = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.stage(stage(spark, docs, DIR), f"test-{name}")
        assert docs.columns == columns
        if name != "mixing":
            now = docs.count()
            assert now >= 0.7 * before and (now == before or name in ("toxicity", "near_duplicates"))
            before = now
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, DIR)
    first = pieces.where("start = 0").count()
    assert first == docs.count()


def test_registered():
    names = list(queries.queries())
    assert [n.split("_")[0] for n in names[:-1]] == [f"op{i}" for i in range(1, 14)] and names[-1] == "pipeline"
    assert set(queries.oracle_sql()) <= set(names)
