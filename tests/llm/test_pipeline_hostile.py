"""The pipeline's stages one after the other on hostile rows and on an empty table."""

import pytest

import corpus_pipeline

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars", "score", "component_id"]


@pytest.fixture(scope="module")
def folder(spark, hostile, tmp_path_factory):
    where = tmp_path_factory.mktemp("tables")
    spark.createDataFrame([(i, i % 3 == 0, 0) for i in range(1, 18)] + [(None, True, 1), (4, None, None)],
                          "doc_id long, toxic boolean, quality int").selectExpr("doc_id", "cast(toxic as int) as toxic", "quality").write.parquet(
        str(where / "labels.parquet"))
    hostile.select(*COLUMNS).write.parquet(str(where / "documents.parquet"))
    return str(where)


def run_stages(spark, docs, folder, tmp_path):
    kept = []
    for name, function in corpus_pipeline.STAGES:
        out = function(spark, docs, folder)
        if name != "packing":
            assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema], name
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        kept.append(docs)
    return kept


def test_hostile_rows_pass_all_stages(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    toxic, near, cut, mixed, packed = run_stages(spark, docs, folder, tmp_path)
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
    assert ids(near) <= ids(toxic) <= ids(docs) and ids(cut) == ids(near)
    assert {r.doc_id: r.n_chars for r in cut.where("text is not null and doc_id is not null").collect()} == {
        r.doc_id: len(r.text) for r in cut.where("text is not null and doc_id is not null").collect()}
    pieces = packed.collect()
    assert {r.doc_id for r in pieces} <= ids(mixed) and all(1 <= r.length <= 2048 for r in pieces)


def test_no_documents(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    assert [df.count() for df in run_stages(spark, docs, folder, tmp_path)] == [0] * 5
