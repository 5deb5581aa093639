"""Remaining clean-up passes, quality rules and assembly steps on ``events``
(F1-F4, F6, F12, F15, F19, F20, V1-V3, V7, V8, V11, A2, A12, A13)."""

from __future__ import annotations

from pyspark.sql import functions as F

from routelens.functions import hints as T
from routelens.operators import spec as A
from routelens.plans.catalog import query
from routelens.plans.discovery import SQL_SERVER, doc_server
from routelens.plans.hints import _inlist
from routelens.plans.schema import SQL_KEPT, SQL_NODES, SQL_OP_IDS, SQL_OPS, event_ops, kept_ops, nodes
from routelens.sources.tables import table

REF = "#/components/schemas/"


_PRIM_VALUES = ", ".join(f"('{k}', '{v}')" for k, v in sorted(T.PRIMITIVE_TYPES.items()))
REF_WORDS = ("String", "Widget", "Long", "Order", "uuid", "DateTime", "Customer", "IActionResult")


@query("inline_primitive_refs", sql=f"""
WITH m AS (SELECT * FROM (VALUES {_PRIM_VALUES}) t(type_key, schema_json)),
n AS (SELECT p_partkey, {_inlist(REF_WORDS).replace('(', '[', 1)[:-1]}][(p_size % {len(REF_WORDS)}) + 1] AS name FROM part)
SELECT p_partkey, coalesce((SELECT schema_json FROM m WHERE m.type_key = lower(n.name)), '{{"$ref":"{REF}' || name || '"}}') AS schema_json FROM n""")
def q_inline_primitive_refs(spark, sf_dir):
    """``$ref`` to a primitive type name is replaced by the inline schema."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_size")
    name = F.element_at(F.array(*[F.lit(w) for w in REF_WORDS]), (F.col("p_size") % len(REF_WORDS) + 1).cast("int"))
    n = p.select("p_partkey", name.alias("name"))
    ref = F.concat(F.lit('{"$ref":"' + REF), F.col("name"), F.lit('"}'))
    return n.select("p_partkey", F.coalesce(T.primitive_schema(F.col("name")), ref).alias("schema_json"))


PROP_VALUES = ['"integer"', f'"{REF}ViewOut"', '"{\\"type\\":\\"number\\"}"', '12.5', 'true', 'null', '["a","b"]', '"ViewOut"',
               '"some text"', '7']


@query("coerce_property", sql=f"""
WITH v AS (SELECT event_id, CAST(({_inlist([x.replace("'", "''") for x in PROP_VALUES]).replace('(', '[', 1)[:-1]}])[(CAST(json_extract_string(props, '$.k') AS INTEGER) % {len(PROP_VALUES)}) + 1] AS JSON) AS j FROM events),
s AS (SELECT event_id, json_type(j) AS t, regexp_replace(json_extract_string(j, '$'), '^\\s+|\\s+$', '', 'g') AS s FROM v)
SELECT event_id, CASE WHEN t = 'NULL' THEN '{{"type":"string","nullable":true}}'
  WHEN t = 'VARCHAR' THEN CASE WHEN lower(s) IN {_inlist(A.JSON_SCHEMA_TYPES)} THEN '{{"type":"' || lower(s) || '"}}'
       WHEN starts_with(s, '{REF}') THEN '{{"$ref":"' || s || '"}}'
       WHEN starts_with(s, '{{') AND ends_with(s, '}}') AND json_valid(s) AND json_type(s) = 'OBJECT' THEN CAST(CAST(s AS JSON) AS VARCHAR)
       WHEN regexp_matches(s, '^[A-Z][A-Za-z0-9_]*$') THEN '{{"$ref":"{REF}' || s || '"}}' ELSE '{{"type":"string"}}' END
  WHEN t = 'BOOLEAN' THEN '{{"type":"boolean"}}' WHEN t IN ('DOUBLE', 'UBIGINT', 'BIGINT') THEN '{{"type":"number"}}'
  WHEN t = 'ARRAY' THEN '{{"type":"array","items":{{"type":"string"}}}}' ELSE '{{"type":"object"}}' END AS schema_json FROM s""")
def q_coerce_property(spark, sf_dir):
    """non-object property values (type words, refs, JSON text, identifiers, null,
    booleans, numbers, lists) turned into schemas."""
    e = table(spark, sf_dir, "events").select("event_id", "props")
    k = F.get_json_object("props", "$.k").cast("int")
    v = F.element_at(F.array(*[F.lit(x) for x in PROP_VALUES]), (k % len(PROP_VALUES) + 1).cast("int"))
    return e.select("event_id", A.coerce_property(F.parse_json(v)).alias("schema_json"))


def constraint_entries(spark, sf_dir):
    k = F.get_json_object("props", "$.k").cast("int")
    e = table(spark, sf_dir, "events").select("event_id", k.alias("k"))
    ent = F.array(
        F.when(F.col("k") % 2 == 0, F.struct(F.lit("ge").alias("key"), F.col("k").cast("string").alias("value"))),
        F.when(F.col("k") % 6 == 0, F.struct(F.lit("minimum").alias("key"), F.lit("1").alias("value"))),
        F.when(F.col("k") % 3 == 0, F.struct(F.lit("min_length").alias("key"), (F.col("k") % 7).cast("string").alias("value"))),
        F.when(F.col("k") % 4 == 0, F.struct(F.lit("minlength").alias("key"), (F.col("k") % 5).cast("string").alias("value"))),
        F.when(F.col("k") % 10 == 0, F.struct(F.lit("multiple_of").alias("key"), F.lit("5").alias("value"))),
        F.when(F.col("k") % 9 == 0, F.struct(F.lit("unique_items").alias("key"), F.lit("true").alias("value"))),
        F.when(F.col("k") % 8 == 0, F.struct(F.lit("maxItems").alias("key"), F.lit("3").alias("value"))),
        F.when(F.col("k") % 5 == 0, F.struct(F.lit("max_items").alias("key"), F.lit("9").alias("value"))))
    return e.select("event_id", F.map_from_entries(F.filter(ent, lambda x: x.isNotNull())).alias("m"))


SQL_ENTRIES = """(SELECT event_id, 'ge' AS key, CAST(k AS VARCHAR) AS value FROM ev WHERE k % 2 = 0
  UNION ALL SELECT event_id, 'minimum', '1' FROM ev WHERE k % 6 = 0
  UNION ALL SELECT event_id, 'min_length', CAST(k % 7 AS VARCHAR) FROM ev WHERE k % 3 = 0
  UNION ALL SELECT event_id, 'minlength', CAST(k % 5 AS VARCHAR) FROM ev WHERE k % 4 = 0
  UNION ALL SELECT event_id, 'multiple_of', '5' FROM ev WHERE k % 10 = 0
  UNION ALL SELECT event_id, 'unique_items', 'true' FROM ev WHERE k % 9 = 0
  UNION ALL SELECT event_id, 'maxItems', '3' FROM ev WHERE k % 8 = 0
  UNION ALL SELECT event_id, 'max_items', '9' FROM ev WHERE k % 5 = 0)"""
_REN = " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in A.CONSTRAINT_RENAMES)
_BLOCK = " ".join(
    f"WHEN '{a}' THEN EXISTS (SELECT 1 FROM en x WHERE x.event_id = en.event_id AND x.key IN "
    f"{_inlist([p for p, q in A.CONSTRAINT_RENAMES[:i] if q == t])})"
    for i, (a, t) in enumerate(A.CONSTRAINT_RENAMES) if [p for p, q in A.CONSTRAINT_RENAMES[:i] if q == t])


@query("constraint_rename", sql=f"""
WITH ev AS (SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events),
en AS {SQL_ENTRIES},
r AS (SELECT event_id, key, value, CASE key {_REN} END AS target, CASE key {_BLOCK} ELSE false END AS blocked FROM en),
n AS (SELECT r.event_id, CASE WHEN target IS NOT NULL AND NOT blocked AND NOT EXISTS (SELECT 1 FROM en x WHERE x.event_id = r.event_id
        AND x.key = r.target) THEN target ELSE key END AS key, value FROM r)
SELECT event_id, string_agg(key || '=' || value, ',' ORDER BY key || '=' || value) AS constraints FROM n GROUP BY 1""")
def q_constraint_rename(spark, sf_dir):
    """alias constraint keys (ge, min_length, ...) renamed unless the target already exists."""
    c = constraint_entries(spark, sf_dir).where(F.size("m") > 0)
    r = A.constraint_rename(F.col("m"))
    return c.select("event_id", F.array_join(F.array_sort(F.transform(F.map_entries(r), lambda x: F.concat(x["key"], F.lit("="), x["value"]))), ",")
                    .alias("constraints"))


def attr_rows(spark, sf_dir):
    k = F.get_json_object("props", "$.k").cast("int")
    e = table(spark, sf_dir, "events").select("event_id", k.alias("k"))
    ent = F.array(
        F.struct(F.lit("items").alias("key"), F.when(F.col("k") % 2 == 0, F.lit('{"type":"string"}')).otherwise(F.lit("{oops")).alias("value")),
        F.when(F.col("k") % 4 == 0, F.struct(F.lit("enum").alias("key"), F.lit('["a","b"]').alias("value"))),
        F.when(F.col("k") % 3 == 0, F.struct(F.lit("additionalProperties").alias("key"), F.lit(REF + "ViewOut").alias("value"))),
        F.struct(F.lit("description").alias("key"), F.lit('{"not":"parsed"}').alias("value")),
        F.struct(F.lit("example").alias("key"), F.lit(" [1, 2] ").alias("value")))
    return e.select("event_id", F.explode(F.filter(ent, lambda x: x.isNotNull())).alias("a")).select("event_id", "a.key", "a.value")


@query("parse_json_strings", sql=f"""
WITH ev AS (SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events),
a AS (SELECT event_id, 'items' AS key, CASE WHEN k % 2 = 0 THEN '{{"type":"string"}}' ELSE '{{oops' END AS value FROM ev
      UNION ALL SELECT event_id, 'enum', '["a","b"]' FROM ev WHERE k % 4 = 0
      UNION ALL SELECT event_id, 'additionalProperties', '{REF}ViewOut' FROM ev WHERE k % 3 = 0
      UNION ALL SELECT event_id, 'description', '{{"not":"parsed"}}' FROM ev
      UNION ALL SELECT event_id, 'example', ' [1, 2] ' FROM ev),
s AS (SELECT event_id, key, trim(value) AS s FROM a)
SELECT event_id, key, CASE WHEN key IN {_inlist(A.STRING_VALUE_KEYS)} THEN 'string'
  WHEN ((starts_with(s, '{{') AND ends_with(s, '}}')) OR (starts_with(s, '[') AND ends_with(s, ']'))) AND json_valid(s) AND json_type(s) = 'OBJECT' THEN 'object'
  WHEN ((starts_with(s, '{{') AND ends_with(s, '}}')) OR (starts_with(s, '[') AND ends_with(s, ']'))) AND json_valid(s) AND json_type(s) = 'ARRAY' THEN 'array'
  WHEN NOT ((starts_with(s, '{{') AND ends_with(s, '}}')) OR (starts_with(s, '[') AND ends_with(s, ']'))) AND starts_with(s, '{REF}') THEN 'ref'
  ELSE 'string' END AS kind FROM s""")
def q_parse_json_strings(spark, sf_dir):
    """string attribute values holding JSON objects/arrays or bare refs become nodes."""
    a = attr_rows(spark, sf_dir)
    return a.select("event_id", "key", A.parse_json_string(F.col("key"), F.col("value")).alias("kind"))


def case_inputs(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id")
    repo = F.concat(F.lit("svc"), (F.col("user_id") % 5).cast("string"))
    name = F.concat(F.initcap("event_type"), F.lit("Out"))
    sel = (F.col("user_id") % 5 + F.length("event_type")) % 3
    spelled = F.when(sel == 0, F.lower(name)).when(sel == 1, F.upper(name)).otherwise(name)
    schemas = e.groupBy(repo.alias("repo_id"), spelled.alias("name")).agg(F.min("event_id").alias("ord"))
    refs = kept_ops(spark, sf_dir).select("repo_id", F.concat(F.initcap(F.regexp_extract("path", "^/([a-z]+)s/", 1)), F.lit("Out")).alias("target"))
    return schemas, refs


SQL_CASE_IN = f"""
sc AS (SELECT 'svc' || CAST(user_id % 5 AS VARCHAR) AS repo_id,
         CASE (user_id % 5 + length(event_type)) % 3 WHEN 0 THEN lower(upper(event_type[1]) || event_type[2:] || 'Out')
              WHEN 1 THEN upper(upper(event_type[1]) || event_type[2:] || 'Out') ELSE upper(event_type[1]) || event_type[2:] || 'Out' END AS name,
         min(event_id) AS ord FROM events GROUP BY 1, 2),
rf AS (SELECT DISTINCT repo_id, out_ref AS target FROM {SQL_KEPT}),
fi AS (SELECT repo_id, lower(name) AS k, arg_min(name, ord) AS actual FROM sc GROUP BY 1, 2),
al AS (SELECT rf.repo_id, fi.actual, min(rf.target) AS renamed_to FROM rf JOIN fi ON fi.repo_id = rf.repo_id AND fi.k = lower(rf.target)
       WHERE NOT EXISTS (SELECT 1 FROM sc WHERE sc.repo_id = rf.repo_id AND sc.name = rf.target) AND fi.actual <> rf.target GROUP BY 1, 2)"""


@query("schema_case_align", sql="WITH " + SQL_CASE_IN.strip() + " SELECT * FROM al")
def q_schema_case_align(spark, sf_dir):
    """schema keys re-spelled to match their refs when they differ only by case."""
    s, r = case_inputs(spark, sf_dir)
    return A.schema_case_align(s, r)


@query("merge_identical_paths", sql=f"""
WITH o AS {SQL_OPS},
p AS (SELECT repo_id, path, min((file_ord, ep_ord)) AS f, regexp_replace(path, '\\{{[^}}]+\\}}', '{{_}}', 'g') AS template FROM o GROUP BY 1, 2),
c AS (SELECT repo_id, template, arg_min(path, f) AS canonical FROM p GROUP BY 1, 2),
d AS (SELECT p.repo_id, p.path, c.canonical FROM p JOIN c USING (repo_id, template) WHERE p.path <> c.canonical),
m AS (SELECT DISTINCT repo_id, path, lower(method) AS method FROM o)
SELECT d.repo_id, 'merged' AS kind, d.path, d.canonical, m.method FROM d JOIN m USING (repo_id, path)
WHERE NOT EXISTS (SELECT 1 FROM m m2 WHERE m2.repo_id = d.repo_id AND m2.path = d.canonical AND m2.method = m.method)
UNION ALL SELECT repo_id, 'removed', path, canonical, NULL FROM d""")
def q_merge_identical_paths(spark, sf_dir):
    """paths identical up to parameter names merged into the first; merged methods and removed paths logged."""
    return A.merge_identical_paths(event_ops(spark, sf_dir))


@query("drop_empty_components", sql=f"""
WITH r AS (SELECT DISTINCT repo_id FROM {SQL_OPS}),
s AS (SELECT repo_id, count(*) AS n FROM {SQL_KEPT} WHERE method IN ('POST', 'PUT') GROUP BY 1),
x AS (SELECT repo_id, count(*) AS n FROM {SQL_KEPT} WHERE protected GROUP BY 1)
SELECT r.repo_id, coalesce(s.n, 0) > 0 AS has_schemas, coalesce(x.n, 0) > 0 AS has_security_schemes,
       coalesce(s.n, 0) = 0 AND coalesce(x.n, 0) = 0 AS drop_components FROM r LEFT JOIN s USING (repo_id) LEFT JOIN x USING (repo_id)""")
def q_drop_empty_components(spark, sf_dir):
    """empty component containers (no body schemas, no security schemes) are dropped."""
    k = kept_ops(spark, sf_dir)
    r = event_ops(spark, sf_dir).select("repo_id").distinct()
    s = k.where(F.col("method").isin("POST", "PUT")).groupBy("repo_id").agg(F.count(F.lit(1)).alias("ns"))
    x = k.where("protected").groupBy("repo_id").agg(F.count(F.lit(1)).alias("nx"))
    j = r.join(s, "repo_id", "left").join(x, "repo_id", "left").fillna(0, ["ns", "nx"])
    return j.select("repo_id", (F.col("ns") > 0).alias("has_schemas"), (F.col("nx") > 0).alias("has_security_schemes"),
                    ((F.col("ns") == 0) & (F.col("nx") == 0)).alias("drop_components"))


# ---------------------------------------------------------------- findings

def findings(spark, sf_dir):
    """V1 and V3 on the flat rows ``(repo_id, rule, severity, subject)``; the rules on documents are in plans/assembly.py."""
    n = nodes(spark, sf_dir).join(event_ops(spark, sf_dir).select("event_id", "repo_id"), "event_id")
    v1 = n.where((F.col("type") == "array") & ~F.col("has_items")).select(
        "repo_id", F.lit("array_items").alias("rule"), F.lit("error").alias("severity"),
        F.concat(F.lit("#/events/"), F.col("event_id").cast("string"), F.lit("/k")).alias("subject"))
    s, r = case_inputs(spark, sf_dir)
    v3 = s.join(r.select("repo_id", F.col("target").alias("name")), ["repo_id", "name"], "left_anti").select(
        "repo_id", F.lit("unused_schema").alias("rule"), F.lit("warning").alias("severity"), F.col("name").alias("subject"))
    return v1.unionByName(v3)


@query("check_array_items", sql=f"""
SELECT 'svc' || CAST(e.user_id % 5 AS VARCHAR) AS repo_id, '#/events/' || CAST(n.event_id AS VARCHAR) || '/k' AS pointer, 'error' AS severity
FROM {SQL_NODES} n JOIN events e USING (event_id) WHERE n.type = 'array' AND NOT n.has_items""")
def q_check_array_items(spark, sf_dir):
    """V1: array schemas without items, reported with their pointer (error)."""
    f = findings(spark, sf_dir).where(F.col("rule") == "array_items")
    return f.select("repo_id", F.col("subject").alias("pointer"), "severity")


@query("check_unused", sql="WITH " + SQL_CASE_IN.strip() + """
SELECT sc.repo_id, sc.name AS schema, 'warning' AS severity FROM sc WHERE NOT EXISTS (SELECT 1 FROM rf WHERE rf.repo_id = sc.repo_id AND rf.target = sc.name)""")
def q_check_unused(spark, sf_dir):
    """V3: schemas no reference names (warning)."""
    f = findings(spark, sf_dir).where(F.col("rule") == "unused_schema")
    return f.select("repo_id", F.col("subject").alias("schema"), "severity")


# Fixed values of this binding: golden expectations (min operations, must / must-not paths).
EXPECT_MIN_OPS = 20
EXPECT_MUST = ("/views/{id}", "/clicks/{id}", "/logins/{id}")
EXPECT_FORBIDDEN_RE = ":[A-Za-z]"


@query("expectations", sql=f"""
WITH k AS {SQL_KEPT}, r AS (SELECT DISTINCT repo_id FROM k),
m AS (SELECT * FROM (VALUES {', '.join(f"('{p}')" for p in EXPECT_MUST)}) t(path))
SELECT repo_id, 'below_min_operations' AS rule, CAST(count(*) AS VARCHAR) AS subject FROM k GROUP BY 1 HAVING count(*) < {EXPECT_MIN_OPS}
UNION ALL SELECT r.repo_id, 'missing_path', m.path FROM r, m WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.repo_id = r.repo_id AND k.path = m.path)
UNION ALL SELECT DISTINCT repo_id, 'forbidden_path', path FROM k WHERE regexp_matches(path, '{EXPECT_FORBIDDEN_RE}')""")
def q_expectations(spark, sf_dir):
    """Golden expectations as data-quality rules (minimum count, must-contain, must-not-contain)."""
    k = kept_ops(spark, sf_dir)
    cnt = k.groupBy("repo_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") < EXPECT_MIN_OPS).select(
        "repo_id", F.lit("below_min_operations").alias("rule"), F.col("n").cast("string").alias("subject"))
    must = F.array(*[F.lit(p) for p in EXPECT_MUST])
    present = k.where(F.col("path").isin(*EXPECT_MUST)).groupBy("repo_id").agg(F.collect_set("path").alias("present"))
    repos = k.select("repo_id").distinct().join(present, "repo_id", "left")
    # the must-contain list is a literal array column: missing = list minus present (no join with the list)
    missing = repos.select("repo_id", F.explode(F.array_except(must, F.coalesce("present", F.array().cast("array<string>")))).alias("subject")) \
        .select("repo_id", F.lit("missing_path").alias("rule"), "subject")
    forb = k.where(F.col("path").rlike(EXPECT_FORBIDDEN_RE)).select("repo_id", F.lit("forbidden_path").alias("rule"),
                                                                   F.col("path").alias("subject")).distinct()
    return cnt.unionByName(missing).unionByName(forb)


@query("op_request_body", sql=f"""
WITH o AS (SELECT o.*, upper(e.event_type[1]) || e.event_type[2:] || 'Body' AS body_ref FROM {SQL_OPS} o JOIN events e USING (event_id) WHERE o.has_body)
SELECT event_id, 'application/json' AS content_type,
  CASE WHEN k % 3 = 0 AND k % 2 = 0 THEN '{{"type":"array","items":{{"$ref":"{REF}' || body_ref || '"}},"nullable":true}}'
       WHEN k % 3 = 0 THEN '{{"allOf":[{{"$ref":"{REF}' || body_ref || '"}}],"nullable":true}}'
       WHEN k % 2 = 0 THEN '{{"type":"array","items":{{"$ref":"{REF}' || body_ref || '"}}}}' ELSE '{{"$ref":"{REF}' || body_ref || '"}}' END AS schema_json FROM o""")
def q_op_request_body(spark, sf_dir):
    """A2: request body per operation: content type and schema (array / nullable flags applied)."""
    o = event_ops(spark, sf_dir).where("has_body").join(table(spark, sf_dir, "events").select("event_id", "event_type"), "event_id")
    o = o.select("event_id", F.concat(F.initcap("event_type"), F.lit("Body")).alias("ref"),
                 (F.col("k") % 2 == 0).alias("arr"), (F.col("k") % 3 == 0).alias("nul"))
    o = T.with_schema_for_ref(o, "ref", "arr", "nul", "schema_json")
    return o.select("event_id", F.lit("application/json").alias("content_type"), "schema_json")



# Fixed value: the editable server entry every description carries (discovered servers
# stay in the manifest).
SERVERS_JSON = '[{"url":"{server}","variables":{"server":{"default":"","description":"Target server URL"}}}]'


@query("build_servers", sql=f"""
WITH sv AS (SELECT * FROM ({SQL_SERVER}))
SELECT repo_id, '{SERVERS_JSON}' AS servers, server AS discovered_server FROM sv""")
def q_build_servers(spark, sf_dir):
    """The constant editable server variable; the discovered server is kept alongside."""
    return doc_server(spark, sf_dir).select("repo_id", F.lit(SERVERS_JSON).alias("servers"), F.col("server").alias("discovered_server"))


def assembled(spark, sf_dir):
    """A1/A3/A7/A8/A9 then F13/F16, one row per operation of the description."""
    k = A.with_final_responses(A.operation_id_dedup(kept_ops(spark, sf_dir)))
    params = A.op_parameters(F.col("path"), F.col("declared"))
    return k.select("repo_id", "path", "method", "operation_id",
                    F.array_join(F.transform("final_responses", lambda r: r["code"]), ",").alias("codes"),
                    F.size(params).alias("n_params"), "has_body")


@query("assemble", sql=f"""
WITH k AS {SQL_KEPT},
ids AS (SELECT * FROM {SQL_OP_IDS}),
r0 AS (SELECT r.event_id, r.i, r.code FROM (SELECT event_id, 0 AS i, '200' AS code FROM k
        UNION ALL SELECT event_id, 1, '404' FROM k WHERE k > 50 UNION ALL SELECT event_id, 2, '200' FROM k WHERE k % 10 = 0) r
      WHERE NOT EXISTS (SELECT 1 FROM (SELECT event_id, 1 AS i, '404' AS code FROM k WHERE k > 50
                        UNION ALL SELECT event_id, 2, '200' FROM k WHERE k % 10 = 0) q WHERE q.event_id = r.event_id AND q.code = r.code AND q.i > r.i)),
r1 AS (SELECT event_id, i, code FROM r0 UNION ALL SELECT event_id, 10, '401' FROM k WHERE protected UNION ALL SELECT event_id, 11, '403' FROM k WHERE protected),
no4 AS (SELECT event_id FROM k WHERE NOT EXISTS (SELECT 1 FROM r1 WHERE r1.event_id = k.event_id AND starts_with(r1.code, '4'))),
r2 AS (SELECT * FROM r1 UNION ALL SELECT event_id, 20, '422' FROM no4),
codes AS (SELECT event_id, string_agg(code, ',' ORDER BY i) AS codes FROM r2 GROUP BY 1)
SELECT ids.repo_id, ids.path, ids.method, ids.op_id AS operation_id, codes.codes,
       len(list_filter(regexp_extract_all(ids.path, '\\{{([^}}:]*)[^}}]*\\}}', 1), lambda x: x <> '')) + 1
         + CASE WHEN NOT list_contains(regexp_extract_all(ids.path, '\\{{([^}}:]*)[^}}]*\\}}', 1), CASE WHEN ids.even THEN 'id' ELSE 'page' END) THEN 1 ELSE 0 END AS n_params,
       ids.has_body FROM ids JOIN codes USING (event_id)""")
def q_assemble(spark, sf_dir):
    """The assembled operations (ids, response codes after auth/4xx injection, parameter counts)."""
    return assembled(spark, sf_dir)
