"""Documents assembled, written as valid files, read back and checked; references followed to their ends."""

import glob
import json

import pytest

from routelens.operators import assembly as Y
from routelens.operators import document as D
from routelens.sources.sinks import shared_folder

PIECE = "repo_id string, section string, name string, body string"


def pieces_of(spark, document, repo="r"):
    parts = [("paths", document.get("paths", {})), *((s, document.get("components", {}).get(s, {})) for s in ("schemas", "securitySchemes"))]
    return spark.createDataFrame([(repo, s, k, json.dumps(v)) for s, part in parts for k, v in part.items()], PIECE)


def value(pieces):
    return {(r.repo_id, r.section, r.name): json.loads(r.body) for r in pieces.collect()}


@pytest.fixture(scope="module")
def document():
    ref = lambda n: {"$ref": D.REF + n}
    return {"paths": {"/a/{id}": {"post": {"operationId": "x", "requestBody": {"content": {"application/json": {"schema": ref("Two")}}}, "responses": {}}},
                      "/b": {"put": {"security": [], "requestBody": {"content": {"text/x": {"schema": {"type": "object"}}}}},
                             "patch": {"security": [], "requestBody": {"content": {"text/x": {"schema": ref("Shaped")}}}}, "post": {"security": []}}},
            "components": {"schemas": {"Two": {"allOf": [ref("One")], "nullable": True}, "One": ref("Bare"), "Bare": {"type": "object"},
                                       "Shaped": {"type": "object", "properties": {"p": ref("Two"), "q": {"$ref": D.REF + "Alias/properties/deep"},
                                                                                   "lost": {"$ref": D.REF + "Shaped/properties/none"}}},
                                       "Alias": ref("Target"), "Target": {"type": "object", "properties": {"deep": {"a/b~c": {"type": "array"}}}},
                                       "Far": {"x": {"$ref": D.REF + "Alias/properties/deep/a~1b~0c"}, "y": {"$ref": D.REF + "Alias/properties/nope"}},
                                       "Circle": {"$ref": D.REF + "Circle2/x"}, "Circle2": {"$ref": D.REF + "Circle/y"}, "Open": {"x-unresolved": True}},
                           "securitySchemes": {"token": {"type": "http"}}}}


def test_written_files_are_one_valid_document(spark, document):
    pieces = pieces_of(spark, document).unionByName(pieces_of(spark, {"paths": {"/z": {"get": {}}}}, "bare")).unionByName(
        pieces_of(spark, {"paths": {"/é\"": {}}, "components": {"securitySchemes": {"s": {}}}}, "schemes"))
    out = Y.write_documents(pieces, shared_folder(spark, "doc"))
    whole, out_files = {}, out.removeprefix("file:")
    for repo in ("r", "bare", "schemes"):
        whole[repo] = json.loads("".join(open(f, encoding="utf-8").read() for f in sorted(glob.glob(f"{out_files}/repo_id={repo}/*.txt"))))
    assert {k: whole["r"][k] for k in ("paths", "components")} == document and whole["r"]["openapi"] == "3.0.3"
    assert "components" not in whole["bare"] and whole["schemes"]["components"] == {"securitySchemes": {"s": {}}}
    assert value(Y.read_documents(spark, out)) == value(pieces)
    texts = spark.createDataFrame([(k, json.dumps(v)) for k, v in whole.items()], "repo_id string, document string")
    assert value(Y.load_documents(texts)) == value(pieces)


def test_references_and_bodies(spark, document):
    nodes = D.shred(pieces_of(spark, document)).nodes().checkpoint()
    at = "#/components/schemas/"
    assert {(r.at, r.target) for r in Y.dangling(nodes).collect()} == {
        (at + "Shaped/properties/lost", D.REF + "Shaped/properties/none"), (at + "Far/y", D.REF + "Alias/properties/nope"),
        (at + "Circle", D.REF + "Circle2/x"), (at + "Circle2", D.REF + "Circle/y")}  # refs through Alias are found
    assert {(r.path, r.method) for r in Y.opaque_bodies(nodes).collect()} == {("/a/{id}", "post"), ("/b", "put")}


def test_findings(spark, document):
    got = {(r.rule, r.subject) for r in Y.document_findings(pieces_of(spark, document)).collect() if r.rule != "dangling_ref"}
    assert got == {("array_items", "#/components/schemas/Target/properties/deep/a~1b~0c"), ("unresolved_schema", "Open"),
                   ("missing_security", "POST /a/{id}"), ("missing_body", "POST /b"), ("opaque_body", "POST /a/{id}"), ("opaque_body", "PUT /b"),
                   *(("unused_schema", n) for n in ("Far", "Circle", "Circle2", "Open", "Alias"))}


def test_parameters(spark):
    rows = [("/a/{id}/{id}/{n:int}", [("id", "query", True, None, None), ("q", "query", False, '{"type":"integer"}', "d\"q"), ("q", "query", True, None, None),
                                      ("q", "header", True, None, None)])]
    df = spark.createDataFrame(rows, "path string, declared array<struct<name:string,in:string,required:boolean,schema:string,description:string>>")
    got = [json.loads(p) for p in df.select(Y.parameter_list(df.path, df.declared).alias("p")).first().p]
    own = lambda n: {"name": n, "in": "path", "required": True, "schema": {"type": "string"}}
    assert got == [own("id"), own("n"), {"name": "q", "in": "query", "required": False, "schema": {"type": "integer"}, "description": 'd"q'},
                   {"name": "q", "in": "header", "required": True}]


def test_paths_merge_into_the_first(spark):
    pieces = pieces_of(spark, {"paths": {"/a/{x}": {"get": 1, "put": 2}, "/a/{b}": {"get": 3}, "/c": {"get": 4}}})
    merged, log = Y.merge_paths(pieces)
    assert value(merged) == {("r", "paths", "/a/{b}"): {"get": 3, "put": 2}, ("r", "paths", "/c"): {"get": 4}}
    assert {tuple(r) for r in log.collect()} == {("r", "/a/{x}", "/a/{b}", "put"), ("r", "/a/{x}", "/a/{b}", None)}


def test_components_are_filled_by_need(spark):
    paths = pieces_of(spark, {"paths": {"/x": {"a": {"$ref": D.REF + "user"}, "b": {"$ref": D.REF + "Gone"}, "c": {"$ref": D.REF + "String"}}}})
    schemas = spark.createDataFrame([("r", "User", json.dumps({"n": {"$ref": D.REF + "Next"}})), ("r", "Next", "{}"), ("r", "Idle", "{}"), ("s", "Gone", "{}")],
                                    "repo_id string, name string, body string")
    got = value(Y.component_pieces(paths, schemas))
    assert {k[2] for k in got} == {"user", "Next", "Gone"} and got["r", "schemas", "Gone"]["x-unresolved"] is True
    assert got["r", "schemas", "user"] == {"n": {"$ref": D.REF + "Next"}}
