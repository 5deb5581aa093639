"""Documents as nodes: round trips, each clean-up pass by its cases, the patch table replayed."""

import json

import pytest
from pyspark.sql import functions as F

from routelens.operators import document as D

CASES = {  # name: (section, given, cleaned)
    "leaked": ("paths", {"get": {"parameters": [{"schema": {"ref_hint": "Widget", "resolution": "import"}}, {"schema": {"ref_hint": "x", "type": "string"}}]}},
               {"get": {"parameters": [{"schema": {"$ref": D.REF + "Widget"}}, {"schema": {"ref_hint": "x", "type": "string"}}]}}),
    "primitive": ("paths", {"a": [{"$ref": D.REF + "String", "title": "t"}, {"$ref": D.REF + "Other"}]},
                  {"a": [{"type": "string", "title": "t"}, {"$ref": D.REF + "Other"}]}),
    "names": ("schemas", {"ge": 1, "minimum": 2, "min_length": 3, "minlength": 4, "lt": 5, "x": {"max_items": 1}},
              {"ge": 1, "minimum": 2, "minLength": 3, "minlength": 4, "maximum": 5, "exclusiveMaximum": True, "x": {"maxItems": 1}}),
    "untouched path": ("paths", {"ge": 1, "required": [], "x": '{"a":1}'}, {"ge": 1, "required": [], "x": '{"a":1}'}),
    "values": ("schemas", {"properties": {"a": "Integer ", "b": None, "c": True, "d": 1.5, "e": ["x"], "f": "Name_1", "g": "no name", "h": '{"lt":3}',
                                          "i": D.REF + "Q", "j": {}}},
               {"properties": {"a": {"type": "integer"}, "b": {"type": "string", "nullable": True}, "c": {"type": "boolean"}, "d": {"type": "number"},
                               "e": {"type": "array", "items": {"type": "string"}}, "f": {"$ref": D.REF + "Name_1"}, "g": {"type": "string"},
                               "h": {"maximum": 3, "exclusiveMaximum": True}, "i": {"$ref": D.REF + "Q"}, "j": {}}}),
    "parsed later": ("schemas", {"items": '{"$ref": "' + D.REF + 'String", "required": []}', "description": '{"a":1}', "enum": "[1, 2]", "not": "{oops}"},
                     {"items": {"$ref": D.REF + "String"}, "description": '{"a":1}', "enum": [1, 2], "not": "{oops}"}),
    "required": ("schemas", {"required": [], "x": [{"required": ["a"]}, {"required": []}]}, {"x": [{"required": ["a"]}, {}]}),
    "bounds": ("schemas", {"a": {"type": "string", "minimum": 2.9, "maximum": 7, "maxLength": 9}, "b": {"type": "integer", "gt": 3, "minimum": 1}},
               {"a": {"type": "string", "minLength": 2, "maximum": 7, "maxLength": 9}, "b": {"type": "integer", "minimum": 3, "exclusiveMinimum": True}}),
    "siblings": ("schemas", {"a": {"$ref": D.REF + "A", "nullable": True}, "b": {"$ref": "#/x", "title": "t"}, "c": {"allOf": [], "nullable": True}},
                 {"a": {"allOf": [{"$ref": D.REF + "A"}], "nullable": True, "type": "object"}, "b": {"allOf": [{"$ref": "#/x"}], "title": "t"},
                  "c": {"allOf": [], "nullable": True, "type": "object"}}),
    "arrays": ("paths", {"p": [{"type": "array"}, {"type": "array", "items": {}}], "n": {"nullable": True}, "m": {"nullable": False}},
               {"p": [{"type": "array", "items": {"type": "string"}}, {"type": "array", "items": {}}], "n": {"nullable": True, "type": "object"},
                "m": {"nullable": False}}),
    "deep": ("schemas", {"a": [[[{"b": {"c/d~e": {"f\n\"g": {"ge": 0, "é": [None, {}, [], "", -1.5]}}}}]]]},
             {"a": [[[{"b": {"c/d~e": {"f\n\"g": {"minimum": 0, "é": [None, {}, [], "", -1.5]}}}}]]]}),
    "scalar": ("schemas", 3, 3), "empty": ("schemas", {}, {}), "list": ("schemas", [], []),
}


@pytest.fixture(scope="module")
def pieces(spark):
    rows = [("r", section, name, json.dumps(given)) for name, (section, given, _) in CASES.items()]
    rows += [("r", "schemas", "no json", "{oops"), ("r", "schemas", "null", None), ("other", "schemas", "names", '{"le":1}')]
    return spark.createDataFrame(rows, "repo_id string, section string, name string, body string")


@pytest.fixture(scope="module")
def cleaned(pieces):
    return D.clean(pieces)


def bodies(tree):
    return {(r.repo_id, r.name): r.body for r in tree.fold().collect()}


def text(value):
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def test_round_trip(pieces):
    got = bodies(D.shred(pieces))
    assert got.pop(("other", "names")) == '{"le":1}'
    assert got == {("r", name): text(given) for name, (_, given, _) in CASES.items()}


def test_passes(cleaned):
    got = bodies(cleaned)
    assert got.pop(("other", "names")) == '{"maximum":1}'
    assert {k[1]: json.loads(v) for k, v in got.items()} == {name: want for name, (_, _, want) in CASES.items()}


def test_patches_replay(pieces, cleaned):
    assert bodies(D.replay(pieces, cleaned.patches())) == bodies(cleaned)


def test_clean_is_stable_and_logs_by_pass(spark, cleaned):
    again = D.clean(cleaned.fold())
    left = again.patches().where("name not in ('parsed later')").collect()  # refs in parsed strings are seen by the next run
    assert left == []
    assert {r["pass"] for r in cleaned.patches().select("pass").distinct().collect()} == {1, 2, 3, 4, 5, 6, 7, 8, 9, 11, 14}


def test_no_pieces(spark, pieces):
    tree = D.clean(pieces.limit(0))
    assert tree.fold().count() == 0 and tree.patches().count() == 0 and tree.nodes().count() == 0


def test_cross_references(spark):
    schemas = {"A": {"b": {"$ref": D.REF + "B"}}, "B": {"a": {"items": {"$ref": D.REF + "A"}}}, "user": {}, "Lost": {"x": {"$ref": D.REF + "Nowhere"}}}
    rows = [("r", "schemas", k, json.dumps(v)) for k, v in schemas.items()]
    rows.append(("r", "paths", "/x", json.dumps({"get": {"q": {"$ref": D.REF + "User"}, "z": {"$ref": D.REF + "Missing"}, "a": {"$ref": D.REF + "A"}}})))
    pieces = spark.createDataFrame(rows, "repo_id string, section string, name string, body string")
    refs = D.ref_nodes(D.shred(pieces).nodes())
    assert {(r.name, r.ptr, r.target) for r in refs.collect()} == {
        ("A", "/b", "B"), ("B", "/a/items", "A"), ("Lost", "/x", "Nowhere"), ("/x", "/get/q", "User"), ("/x", "/get/z", "Missing"), ("/x", "/get/a", "A")}
    cuts = spark.createDataFrame([("r", "B", "A")], "repo_id string, src string, dst string")
    renames = spark.createDataFrame([("r", "user", "User")], "repo_id string, actual string, renamed_to string")
    names = D.schema_names(D.rename_pieces(pieces, renames))
    patches = D.cycle_patches(refs, cuts).unionByName(D.case_patches(refs, renames)).unionByName(D.dangling_patches(refs, names))
    got = {k[1]: json.loads(v) for k, v in bodies(D.replay(pieces, patches)).items()}
    assert got["B"]["a"]["items"] == {"type": "object", "description": "Circular reference to A", "x-circular-ref": D.REF + "A"}
    assert got["/x"]["get"]["z"] == {"type": "object", "description": "Unresolved reference to Missing", "x-unresolved": True}
    assert got["/x"]["get"]["q"] == {"$ref": D.REF + "User"} and got["A"] == schemas["A"]
    assert {r.name for r in D.unused_schemas(pieces, refs).collect()} == {"user", "Lost"}


def test_schema_table(spark):
    rows = [("r", "schemas", "A", '{"properties":{"a":{"$ref":"#/x"},"b":{}},"required":["a"]}'), ("s", "schemas", "A", '{"x-unresolved":true}'),
            ("s", "schemas", "B", "3"), ("s", "schemas", "C", None), ("s", "paths", "/p", "{}")]
    got = D.schema_table(spark.createDataFrame(rows, "repo_id string, section string, name string, body string"))
    assert {tuple(r) for r in got.collect()} == {("r", "A", 2, 1, 1, "resolved"), ("s", "A", 0, 0, 0, "unresolved"), ("s", "B", 0, 0, 0, "resolved"),
                                                 ("s", "C", 0, 0, 0, "resolved")}


def test_equal_names_of_two_repositories_stay_apart(spark):
    from routelens.operators import resolve as G
    props = spark.createDataFrame([("r", "A", "x"), ("s", "A", "y"), ("r", "P", "p")], "repo_id string, node string, prop string")
    parents = spark.createDataFrame([("r", "A", "P"), ("r", "P", "A")], "repo_id string, src string, dst string")
    got = {(r.repo_id, r.node): (r.n_props, r.props) for r in G.property_closure(props, parents).collect()}
    assert got == {("r", "A"): (2, ["p", "x"]), ("s", "A"): (1, ["y"]), ("r", "P"): (2, ["p", "x"])}
    cols = "repo_id string, schema string, prop_ord int, name string, type string, format string, ref string, is_array boolean, nullable boolean, " \
           "enum_values array<string>, constraints_json string"
    rows = spark.createDataFrame([("r", "A", 0, "x", "string", "", "", False, False, [], "{}"), ("s", "A", 0, "y", "integer", "", "", False, False, [], "{}")], cols)
    schemas = spark.createDataFrame([("r", "A", [], ""), ("s", "A", ["y"], "")], "repo_id string, schema string, required array<string>, parent_ref string")
    texts = {r.repo_id: json.loads(r.schema_json) for r in G.props_to_json_schema(rows, schemas).collect()}
    assert texts == {"r": {"type": "object", "properties": {"x": {"type": "string"}}},
                     "s": {"type": "object", "properties": {"y": {"type": "integer"}}, "required": ["y"]}}


def test_whole_documents_equal_the_depths(spark):
    """The walk gives what the passes on tables give, depth by depth; odd texts and repeated keys go that way."""
    bodies_ = [json.dumps(given) for _, given, _ in CASES.values()]
    bodies_ += ['{"a":1e5,"b":{"minimum":1.50,"type":"string"}}', '{"x":"{\\"a\\":1e5}","y":" [1.250, -0] ","z":"{\\"a\\":1,\\"a\\":2}"}', '{"t":"\\u001f","u":"\U0001f600"}',
                '{"properties":{"a":" {\\"ge\\":0.0000001} ","b":"strING","c":"é É","d":"\\u2028"}}', '{"nullable":0,"$ref":"#/components/schemas/int, str"}',
                '{"type":"string","minimum":123456789012345678,"maximum":-0.5}', '{"x":{"ref_hint":null,"a":[{"$ref":"#/components/schemas/Float"}]}}',
                '{"properties":{"properties":{"properties":"Long"},"type":3,"items":[]},"le":1,"lt":2,"exclusiveMaximum":3}', '{"nullable":"","allOf":[]}', '"plain"', "1.50"]
    rows = [("r", section, f"{i}~/{section}", body) for i, body in enumerate(bodies_) for section in ("schemas", "paths")]
    rows += [("r", "schemas", "twice", '{"ge":1}'), ("r", "schemas", "twice", '{"le":1}'), (None, "schemas", "x", '{"ge":1}'), ("r", None, "x", '{"ge":1,"required":[]}')]
    pieces = spark.createDataFrame(rows, "repo_id string, section string, name string, body string")
    whole, depths = D.clean(pieces), D.descend(pieces, D.clean_rules())
    assert whole.rows.where("odd").count() >= 6 and whole.rows.where("not odd").count() > 40
    texts = lambda tree: sorted(map(repr, tree.fold().collect()))
    log = lambda tree: sorted(map(repr, tree.patches().select(*D.PIECE, "ptr", "depth", "pass", "seq", "key", "value").collect()))
    assert log(whole) == log(depths) and texts(whole) == texts(depths)
    again = D.replay(pieces, whole.patches())
    assert texts(again) == texts(D.descend(pieces, again.rewrite))


def test_many_documents_take_few_jobs(spark, monkeypatch):
    """A document's depth costs no rounds, and its texts are staged once."""
    stages = []
    write = D.write_stage
    monkeypatch.setattr(D, "write_stage", lambda df, name: stages.append(name) or write(df, name))
    deep = '{"properties":{"a":{"properties":{"b":{"properties":{"c":{"type":"array"}}}}}}}'
    pieces = spark.range(50).select(F.lit("r").alias("repo_id"), F.lit("schemas").alias("section"), F.col("id").cast("string").alias("name"), F.lit(deep).alias("body"))
    tree = D.clean(pieces)
    assert D.replay(pieces, tree.patches()).fold().where("body like '%\"items\":{\"type\":\"string\"}%'").count() == 50
    assert len(stages) == 2
