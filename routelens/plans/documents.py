"""Nested schema documents (F1-F9, F11, F14, F20) on ``part``.

Each part is a schema ``Part{p_partkey}`` of the repository named by its brand, four levels of properties deep; sizes
and keys decide which faults it carries.  The input text is one SQL expression that both engines understand; the
twins write the expected text and the expected edits from the table, without nodes.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from routelens.operators import document as D
from routelens.plans.catalog import made_once, query
from routelens.session import spread
from routelens.sources.tables import table

_K = "CAST(p_size AS STRING)"
_NEXT = "'Part' || CAST(p_partkey + 1 AS STRING)"
_REF = f"'{{\"$ref\":\"{D.REF}' || {_NEXT} || '\"}}'"
_Q = "chr(92) || '\"'"  # an escaped quote inside a JSON string, alike in both dialects


def _in_string(json: str) -> str:
    """SQL text of a JSON string that holds the given JSON."""
    return "'\"' || '" + json.replace('"', f"' || {_Q} || '") + "' || '\"'"


ID = f"""CASE p_size % 3 WHEN 0 THEN '"integer"' WHEN 1 THEN '{{"type":"integer","ge":' || {_K} || '}}'
  ELSE '{{"type":"integer","gt":' || {_K} || ',"minimum":1}}' END"""
OWNER = f"""CASE p_partkey % 3 WHEN 0 THEN '{{"ref_hint":"' || {_NEXT} || '","resolution":"import"}}'
  WHEN 1 THEN '{{"$ref":"{D.REF}String","title":"t"}}' ELSE '{{"nullable":true,"$ref":"{D.REF}' || {_NEXT} || '"}}' END"""
TAGS = f"""CASE WHEN p_size % 2 = 0 THEN '{{"type":"array"}}'
  ELSE {_in_string('{"type":"array","items":{"type":"string","min_length":2}}')} END"""
LEAF = """CASE WHEN p_size % 5 = 0 THEN '{"nullable":true}' ELSE '{"type":"string","x-n":12.5,"enum":["a",{"b":[]}]}' END"""
BODY = f"""'{{"type":"object"' || CASE WHEN p_size % 4 = 0 THEN ',"required":[]' ELSE ',"required":["id"]' END
  || ',"properties":{{"id":' || {ID} || ',"owner":' || {OWNER} || ',"detail":{{"type":"object","properties":{{"label":{{"type":"string","minimum":'
  || {_K} || ',"max_length":40}},"tags":' || {TAGS} || ',"inner":{{"type":"object","nullable":true,"properties":{{"leaf":' || {LEAF}
  || ',"n":null,"w":"' || {_NEXT} || '"}}}}}}}}}}}}'"""
REPO = "lower(replace(p_brand, '#', ''))"

# what the passes make of it, in key order
OUT_ID = f"""CASE p_size % 3 WHEN 0 THEN '{{"type":"integer"}}' WHEN 1 THEN '{{"minimum":' || {_K} || ',"type":"integer"}}'
  ELSE '{{"exclusiveMinimum":true,"minimum":' || {_K} || ',"type":"integer"}}' END"""
OUT_OWNER = f"""CASE p_partkey % 3 WHEN 0 THEN {_REF} WHEN 1 THEN '{{"title":"t","type":"string"}}'
  ELSE '{{"allOf":[' || {_REF} || '],"nullable":true,"type":"object"}}' END"""
OUT_TAGS = """CASE WHEN p_size % 2 = 0 THEN '{"items":{"type":"string"},"type":"array"}' ELSE '{"items":{"minLength":2,"type":"string"},"type":"array"}' END"""
OUT_LEAF = """CASE WHEN p_size % 5 = 0 THEN '{"nullable":true,"type":"object"}' ELSE '{"enum":["a",{"b":[]}],"type":"string","x-n":12.5}' END"""
OUT_BODY = f"""'{{"properties":{{"detail":{{"properties":{{"inner":{{"nullable":true,"properties":{{"leaf":' || {OUT_LEAF}
  || ',"n":{{"nullable":true,"type":"string"}},"w":' || {_REF} || '}},"type":"object"}},"label":{{"maxLength":40,"minLength":' || {_K}
  || ',"type":"string"}},"tags":' || {OUT_TAGS} || '}},"type":"object"}},"id":' || {OUT_ID} || ',"owner":' || {OUT_OWNER} || '}}'
  || CASE WHEN p_size % 4 = 0 THEN '' ELSE ',"required":["id"]' END || ',"type":"object"}}'"""
SQL_PART = f"SELECT *, {REPO} AS repo_id, 'Part' || CAST(p_partkey AS STRING) AS name FROM part"

_IN, _TAGS = "/properties/detail/properties/inner", "/properties/detail/properties/tags"
# (condition, pointer, pass, key, value): the edits of one document, in order
EXPECTED = [
    ("p_size % 4 = 0", "", 7, "required", "NULL"),
    ("p_size % 3 = 0", "/properties", 3, "id", "'{\"type\":\"integer\"}'"),
    ("p_size % 3 = 1", "/properties/id", 4, "ge", "NULL"), ("p_size % 3 = 1", "/properties/id", 4, "minimum", _K),
    ("p_size % 3 = 2", "/properties/id", 4, "gt", "NULL"), ("p_size % 3 = 2", "/properties/id", 4, "exclusiveMinimum", _K),
    ("p_size % 3 = 2", "/properties/id", 5, "minimum", _K), ("p_size % 3 = 2", "/properties/id", 5, "exclusiveMinimum", "'true'"),
    ("p_partkey % 3 = 0", "/properties/owner", 1, "ref_hint", "NULL"), ("p_partkey % 3 = 0", "/properties/owner", 1, "resolution", "NULL"),
    ("p_partkey % 3 = 0", "/properties/owner", 1, "$ref", f"'\"{D.REF}' || {_NEXT} || '\"'"),
    ("p_partkey % 3 = 1", "/properties/owner", 2, "$ref", "NULL"), ("p_partkey % 3 = 1", "/properties/owner", 2, "type", "'\"string\"'"),
    ("p_partkey % 3 = 2", "/properties/owner", 9, "allOf", f"'[' || {_REF} || ']'"), ("p_partkey % 3 = 2", "/properties/owner", 9, "$ref", "NULL"),
    ("p_partkey % 3 = 2", "/properties/owner", 9, "type", "'\"object\"'"),
    ("true", "/properties/detail/properties/label", 4, "max_length", "NULL"), ("true", "/properties/detail/properties/label", 4, "maxLength", "'40'"),
    ("true", "/properties/detail/properties/label", 8, "minimum", "NULL"), ("true", "/properties/detail/properties/label", 8, "minLength", _K),
    ("p_size % 2 = 0", _TAGS, 11, "items", "'{\"type\":\"string\"}'"),
    ("p_size % 2 = 1", "/properties/detail/properties", 3, "tags", "'{\"items\":{\"min_length\":2,\"type\":\"string\"},\"type\":\"array\"}'"),
    ("p_size % 2 = 1", _TAGS + "/items", 4, "min_length", "NULL"), ("p_size % 2 = 1", _TAGS + "/items", 4, "minLength", "'2'"),
    ("true", _IN + "/properties", 3, "n", "'{\"nullable\":true,\"type\":\"string\"}'"), ("true", _IN + "/properties", 3, "w", _REF),
    ("p_size % 5 = 0", _IN + "/properties/leaf", 14, "type", "'\"object\"'"),
]


def _sql_edits(number: int | None = None) -> str:
    rows = [(c, ptr, n, key, value) for c, ptr, n, key, value in EXPECTED if number in (None, n)]
    return " UNION ALL ".join(f"SELECT repo_id, name, '{ptr}' AS ptr, {n} AS pass, '{key}' AS key, CAST({value} AS VARCHAR) AS value FROM p WHERE {c}"
                              for c, ptr, n, key, value in rows)


def part_pieces(spark, sf_dir):
    """(repo_id, section, name, body) of every part."""
    p = spread(table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size"), "p_partkey")  # rows are short, bodies are not
    return p.select(F.expr(REPO).alias("repo_id"), F.lit("schemas").alias("section"),
                    F.concat(F.lit("Part"), F.col("p_partkey").cast("string")).alias("name"), F.expr(BODY).alias("body"))


def cleaned_parts(spark, sf_dir):
    """The cleaned tree of the part documents: staged depths, made once an application."""
    return made_once(spark, "cleaned-parts", sf_dir, lambda: D.clean(part_pieces(spark, sf_dir)))


@query("document_round_trip", sql=f"""WITH p AS ({SQL_PART}), d AS (SELECT repo_id, name, CAST({BODY} AS JSON) AS body FROM p)
SELECT repo_id, name, true AS same, (SELECT count(*) FROM json_tree(d.body)) AS n_nodes FROM d""")
def q_document_round_trip(spark, sf_dir):
    """Shredding to nodes and folding back gives the same JSON value (compared as canonical text); nodes are counted."""
    pieces = part_pieces(spark, sf_dir)
    tree = D.shred(pieces)
    n = tree.nodes().groupBy(*D.PIECE).agg(F.count(F.lit(1)).alias("n_nodes"))
    back = tree.fold().join(pieces.withColumnRenamed("body", "given"), D.PIECE).join(n, D.PIECE)
    return back.select("repo_id", "name", (F.col("body") == D.canonical(F.col("given"))).alias("same"), "n_nodes")


@query("document_clean", sql=f"WITH p AS ({SQL_PART}) SELECT repo_id, name, {OUT_BODY} AS body FROM p")
def q_document_clean(spark, sf_dir):
    """F1-F9, F11, F14 on whole nested documents: the fixed texts."""
    return cleaned_parts(spark, sf_dir).fold().select("repo_id", "name", "body")


@query("fix_log", sql=f"WITH p AS ({SQL_PART}) {_sql_edits()}")
def q_fix_log(spark, sf_dir):
    """the patch table of all passes, one row an edited member."""
    return cleaned_parts(spark, sf_dir).patches().select("repo_id", "name", "ptr", "pass", "key", "value")


@query("fix_log_replay", sql=f"WITH p AS ({SQL_PART}) SELECT repo_id, name, {OUT_BODY} AS body FROM p")
def q_fix_log_replay(spark, sf_dir):
    """the patch table put on the original documents gives the fixed ones."""
    pieces = part_pieces(spark, sf_dir)
    return D.replay(pieces, cleaned_parts(spark, sf_dir).patches()).fold().select("repo_id", "name", "body")


def _single(spark, sf_dir, edits):
    return D.descend(part_pieces(spark, sf_dir), D.one_pass(edits)).patches().select("repo_id", "name", "ptr", "key", "value")


@query("fix_leaked_hint", sql=f"WITH p AS ({SQL_PART}) SELECT repo_id, name, ptr, key, value FROM ({_sql_edits(1)})")
def q_fix_leaked_hint(spark, sf_dir):
    """objects that hold a raw ref hint and neither type nor ``$ref``, at any depth, become refs."""
    return _single(spark, sf_dir, D.leaked_hint)


@query("array_default_items", sql=f"WITH p AS ({SQL_PART}) SELECT repo_id, name, ptr, key, value FROM ({_sql_edits(11)})")
def q_array_default_items(spark, sf_dir):
    """arrays without items, at any depth, get string items."""
    return _single(spark, sf_dir, D.array_items)


@query("inline_nested_primitives", sql=f"WITH p AS ({SQL_PART}) SELECT repo_id, name, ptr, key, value FROM ({_sql_edits(2)})")
def q_inline_nested_primitives(spark, sf_dir):
    """refs to primitive names, at any depth, replaced by the inline schema; other members stay."""
    return _single(spark, sf_dir, D.primitive_ref)


@query("schema_table", sql=f"""WITH p AS ({SQL_PART}) SELECT repo_id, name, 3::BIGINT AS n_properties, CASE WHEN p_size % 4 = 0 THEN 0 ELSE 1 END::BIGINT AS n_required,
  CASE WHEN p_partkey % 3 = 0 THEN 0 ELSE 1 END::BIGINT AS n_refs, 'resolved' AS status FROM p""")
def q_schema_table(spark, sf_dir):
    """One row a schema of the raw part documents: properties, required names, refs, status."""
    return D.schema_table(part_pieces(spark, sf_dir))
