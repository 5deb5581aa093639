"""Whole descriptions on ``events``.

The kept operations of ``plans/schema.py`` become the documents of the repositories ``svc0`` to ``svc4``.  Every
repository has six extracted schemas whose bodies carry its number of events: ``ViewOut`` and ``ClickOut`` refer to each
other, ``purchaseout`` (asked for as ``PurchaseOut``) to itself, ``ClickBody`` and ``PurchaseBody`` lead to the bare
``ViewBody`` over one and two refs; what logins and signups return is not found.  ``Kind`` stands in a leaked hint, which
is seen only after the components are filled, so its ref leads nowhere.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from routelens.functions import hints as T
from routelens.operators import assembly as Y
from routelens.operators import document as D
from routelens.operators import spec as A
from routelens.plans.catalog import made_once, query
from routelens.plans.documents import SQL_PART, part_pieces
from routelens.plans.schema import SQL_LASTWINS, SQL_OP_IDS, SQL_OPS, event_ops, kept_ops
from routelens.session import write_stage
from routelens.sources.sinks import shared_folder
from routelens.sources.tables import table

REF = D.REF


def document_ops(spark, sf_dir, kept=True):
    """Operations with everything a document shows of them (``kept``: first of each path and method, ids made unique)."""
    o = A.operation_id_dedup(kept_ops(spark, sf_dir)) if kept else event_ops(spark, sf_dir)
    o = A.with_final_responses(o).withColumn("kind", F.initcap(F.regexp_extract("path", "^/([a-z]+)s/", 1)))
    o = o.withColumns({"out_ref": F.concat("kind", F.lit("Out")), "body_ref": F.concat("kind", F.lit("Body")), "no": F.lit(False),
                       "arr": F.col("k") % 2 == 0, "nul": F.col("k") % 3 == 0})
    o = T.with_schema_for_ref(o, "out_ref", "no", "no", "out_schema")
    o = T.with_schema_for_ref(o, "body_ref", "arr", "nul", "body_schema")
    null = F.lit(None).cast("string")
    k = F.struct(F.lit("k").alias("name"), F.lit("query").alias("in"), F.lit(False).alias("required"),
                 F.when(F.col("k") % 5 == 0, '{"ref_hint":"String"}').otherwise('{"type":"integer"}').alias("schema"),
                 F.when(F.col("k") % 4 == 0, "steps").alias("description"))
    page = F.struct(F.col("declared")[1]["name"].alias("name"), F.lit("path").alias("in"), F.lit(True).alias("required"),
                    null.alias("schema"), null.alias("description"))
    scheme = F.struct(F.when(F.col("k") % 3 == 0, "oauth").otherwise("token").alias("name"),
                      F.when(F.col("k") % 3 == 0, F.array(F.concat(F.lit("use:"), F.lower("method")))).otherwise(F.array().cast("array<string>")).alias("scopes"))
    none = F.array().cast("array<struct<name:string,scopes:array<string>>>")
    return o.select(
        "repo_id", "path", "method", "operation_id", "tag", F.array(k, page).alias("declared"), "has_body",
        F.lit("application/json").alias("content_type"), F.when(F.col("k") % 7 != 0, F.col("body_schema")).alias("body_schema"),
        F.transform("final_responses", lambda r: F.struct(r["code"], r["description"], F.when(r["ref"].isNotNull(), F.col("out_schema")).alias("schema"))).alias("responses"),
        F.when(F.col("protected"), F.array(scheme)).when(F.col("security").isNull(), None).otherwise(none).alias("security"))


def extracted_schemas(spark, sf_dir):
    """(repo_id, name, body): six schemas a repository."""
    n = table(spark, sf_dir, "events").groupBy(F.concat(F.lit("svc"), (F.col("user_id") % 5).cast("string")).alias("repo_id")).agg(
        F.count(F.lit(1)).cast("string").alias("n"))

    def out(target):
        return F.concat(F.lit('{"type":"object","required":[],"properties":{"id":"integer","kind":{"ref_hint":"Kind"},"n":{"type":"integer","ge":'), "n",
                        F.lit('},"next":{"type":"array","items":{"$ref":"' + REF + target + '"}}}}'))

    bodies = {"ViewOut": out("ClickOut"), "ClickOut": out("ViewOut"), "purchaseout": out("PurchaseOut"), "ViewBody": F.lit('{"type":"object"}'),
              "ClickBody": F.lit('{"$ref":"' + REF + 'ViewBody"}'), "PurchaseBody": F.lit('{"allOf":[{"$ref":"' + REF + 'ClickBody"}]}'),
              "SignupBody": F.lit('{"type":"object","properties":{"email":"string"}}'), "Unused": F.lit('{"type":"object"}')}
    return n.select("repo_id", F.explode(F.array(*[F.struct(F.lit(k).alias("name"), v.alias("body")) for k, v in bodies.items()])).alias("s")).select(
        "repo_id", "s.name", "s.body")


def schemes(ops):
    """One row a scheme name and repository, with the union of its scopes."""
    reqs = ops.select("repo_id", "path", "method", F.explode("security").alias("r")).select(
        "repo_id", "r.name", F.concat("path", F.lit(" "), "method").alias("ord"),
        F.when(F.col("r.name") == "oauth", "oauth2").otherwise("bearer").alias("scheme_type"), F.lit("clientCredentials").alias("flow"), "r.scopes")
    a = A.scheme_aggregate(reqs)
    null = F.lit(None).cast("string")
    return a.select("repo_id", "name", A.scheme_to_openapi(F.col("scheme_type"), F.col("flow"), null, null).alias("scheme"), "scopes")


def written_documents(spark, sf_dir):
    """The pieces of the finished documents, written once an application and read back."""
    def write():
        ops = write_stage(document_ops(spark, sf_dir), "ops")
        pieces = write_stage(Y.assemble(Y.operation_texts(ops), extracted_schemas(spark, sf_dir), schemes(ops)), "pieces")
        return Y.write_documents(Y.finish(pieces)[0], shared_folder(spark, "documents"))
    return Y.read_documents(spark, made_once(spark, "documents", sf_dir, write))


# ---------------------------------------------------------------- twins

SQL_KIND = "(upper(e.event_type[1]) || e.event_type[2:])"
SQL_DOC_OPS = f"(SELECT o.*, {SQL_KIND} AS kind FROM {SQL_OP_IDS} o JOIN events e USING (event_id))"
SQL_CODES = f"""r0 AS (SELECT r.event_id, r.code FROM {SQL_LASTWINS} r),
r1 AS (SELECT event_id, code FROM r0 UNION SELECT event_id, '401' FROM o WHERE protected UNION SELECT event_id, '403' FROM o WHERE protected),
r2 AS (SELECT * FROM r1 UNION SELECT event_id, '422' FROM o WHERE NOT EXISTS (SELECT 1 FROM r1 WHERE r1.event_id = o.event_id AND starts_with(r1.code, '4'))),
codes AS (SELECT event_id, string_agg(code, ',' ORDER BY code) AS codes FROM r2 GROUP BY 1)"""
SQL_NEEDED = f"""o AS {SQL_DOC_OPS},
pr AS (SELECT DISTINCT repo_id, kind || 'Out' AS name FROM o UNION SELECT DISTINCT repo_id, kind || 'Body' FROM o WHERE has_body AND k % 7 <> 0),
need AS (SELECT * FROM pr UNION SELECT pr.repo_id, t.dst FROM pr JOIN (VALUES ('ViewOut', 'ClickOut'), ('ClickOut', 'ViewOut'), ('ClickBody', 'ViewBody'), ('PurchaseBody', 'ClickBody'), ('PurchaseBody', 'ViewBody')) t(src, dst) ON t.src = pr.name)"""
_STUB = "'{{\"description\":\"Circular reference to {0}\",\"type\":\"object\",\"x-circular-ref\":\"" + REF + "{0}\"}}'"


def _sql_out(item):
    return (f"'{{\"properties\":{{\"id\":{{\"type\":\"integer\"}},\"kind\":{{\"$ref\":\"{REF}Kind\"}},\"n\":{{\"minimum\":' || n.n || ',\"type\":\"integer\"}},"
            f"\"next\":{{\"items\":' || {item} || ',\"type\":\"array\"}}}},\"type\":\"object\"}}'")


SQL_BODY = f"""CASE WHEN NOT has_body THEN NULL WHEN k % 7 = 0 THEN '{{"type":"object"}}'
  WHEN k % 6 = 0 THEN '{{"items":{{"$ref":"{REF}' || kind || 'Body"}},"nullable":true,"type":"array"}}'
  WHEN k % 3 = 0 THEN '{{"allOf":[{{"$ref":"{REF}' || kind || 'Body"}}],"nullable":true,"type":"object"}}'
  WHEN k % 2 = 0 THEN '{{"items":{{"$ref":"{REF}' || kind || 'Body"}},"type":"array"}}' ELSE '{{"$ref":"{REF}' || kind || 'Body"}}' END"""
SQL_PARAMS = """(WITH n AS (SELECT list_filter(regexp_extract_all(path, '\\{([^}:]*)[^}]*\\}', 1), lambda x: x <> '') AS names)
  SELECT array_to_string(list_concat(list_transform(names, lambda x: 'path:' || x || ':string'),
    ['query:k:' || CASE WHEN k % 5 = 0 THEN 'string' ELSE 'integer' END || CASE WHEN k % 4 = 0 THEN ':steps' ELSE '' END],
    CASE WHEN list_contains(names, CASE WHEN even THEN 'id' ELSE 'page' END) THEN [] ELSE ['path:' || CASE WHEN even THEN 'id' ELSE 'page' END] END), ',') FROM n)"""


@query("document_operations", sql=f"""
WITH o AS {SQL_DOC_OPS}, {SQL_CODES}
SELECT repo_id, path, lower(method) AS method, op_id AS operation_id, {SQL_PARAMS} AS params, codes.codes, {SQL_BODY} AS body_schema,
  CASE WHEN protected AND k % 3 = 0 THEN '[{{"oauth":["use:' || lower(method) || '"]}}]' WHEN protected THEN '[{{"token":[]}}]'
       WHEN security IS NULL THEN NULL ELSE '[]' END AS security
FROM o JOIN codes USING (event_id)""")
def q_document_operations(spark, sf_dir):
    """The operations of the written documents, read back: parameters with their schemas,
    response codes, request body schema, security."""
    m = lambda k: F.try_element_at("m", F.lit(k))
    text = lambda p, k: D.unquote(F.try_element_at(p, F.lit(k)))
    params = F.transform(D.elements(m("parameters")), lambda p: F.concat_ws(
        ":", text(D.members(p), "in"), text(D.members(p), "name"), F.get_json_object(p, "$.schema.type"), text(D.members(p), "description")))
    return Y.operations_of(written_documents(spark, sf_dir)).select(
        "repo_id", "path", "method", D.unquote(m("operationId")).alias("operation_id"), F.array_join(params, ",").alias("params"),
        F.array_join(F.array_sort(F.map_keys(D.members(m("responses")))), ",").alias("codes"),
        F.try_element_at(D.members(F.try_element_at(D.members(F.try_element_at(D.members(m("requestBody")), F.lit("content"))), F.lit("application/json"))),
                         F.lit("schema")).alias("body_schema"), m("security").alias("security"))


@query("document_components", sql=f"""
WITH {SQL_NEEDED}, n AS (SELECT 'svc' || CAST(user_id % 5 AS VARCHAR) AS repo_id, count(*) AS n FROM events GROUP BY 1),
sc AS (SELECT repo_id, list_sort(list(DISTINCT 'use:' || lower(method)) FILTER (k % 3 = 0)) AS scopes, bool_or(k % 3 <> 0) AS token FROM o WHERE protected GROUP BY 1)
SELECT need.repo_id, 'schemas' AS section, name, CASE name WHEN 'ViewOut' THEN {_sql_out(_STUB.format('ClickOut'))}
  WHEN 'ClickOut' THEN {_sql_out(f"'{{\"$ref\":\"{REF}ViewOut\"}}'")} WHEN 'PurchaseOut' THEN {_sql_out(_STUB.format('PurchaseOut'))}
  WHEN 'ViewBody' THEN '{{"type":"object"}}' WHEN 'ClickBody' THEN '{{"$ref":"{REF}ViewBody"}}' WHEN 'PurchaseBody' THEN '{{"allOf":[{{"$ref":"{REF}ClickBody"}}]}}'
  WHEN 'SignupBody' THEN '{{"properties":{{"email":{{"type":"string"}}}},"type":"object"}}' ELSE '{Y.NOT_FOUND}' END AS body
FROM need JOIN n USING (repo_id)
UNION ALL SELECT repo_id, 'securitySchemes', 'oauth', '{{"flows":{{"clientCredentials":{{"scopes":{{' ||
  array_to_string(list_transform(scopes, lambda x: '"' || x || '":""'), ',') || '}},"tokenUrl":""}}}},"type":"oauth2"}}' FROM sc WHERE scopes IS NOT NULL
UNION ALL SELECT repo_id, 'securitySchemes', 'token', '{{"bearerFormat":"JWT","scheme":"bearer","type":"http"}}' FROM sc WHERE token""")
def q_document_components(spark, sf_dir):
    """The components of the written documents: filled, cleaned, cycles cut, unused ones gone."""
    return written_documents(spark, sf_dir).where("section <> 'paths'").select("repo_id", "section", "name", "body")


@query("document_paths_merged", sql=f"""
WITH o AS (SELECT DISTINCT repo_id, path, lower(method) AS method FROM {SQL_OPS}),
c AS (SELECT *, min(path) OVER (PARTITION BY repo_id, regexp_replace(path, '\\{{[^}}]+\\}}', '{{_}}', 'g')) AS canonical FROM o),
f AS (SELECT repo_id, canonical, method, min(path) AS path FROM c GROUP BY 1, 2, 3)
SELECT repo_id, path AS name, canonical, method FROM f WHERE path <> canonical
UNION ALL SELECT DISTINCT repo_id, path, canonical, NULL FROM c WHERE path <> canonical""")
def q_document_paths_merged(spark, sf_dir):
    """path pieces that differ by parameter names only, merged: the moved methods and the removed paths."""
    o = event_ops(spark, sf_dir).groupBy("repo_id", "path", F.lower("method").alias("method")).agg(F.min("ep_ord").cast("string").alias("body"))
    return Y.merge_paths(Y.path_pieces(o))[1]


@query("check_unresolved", sql=f"""
WITH {SQL_NEEDED} SELECT repo_id, name AS schema, 'warning' AS severity FROM need
WHERE name NOT IN ('ViewOut', 'ClickOut', 'PurchaseOut', 'ViewBody', 'ClickBody', 'PurchaseBody', 'SignupBody')""")
def q_check_unresolved(spark, sf_dir):
    """V2: schemas of the documents that could not be resolved (warning)."""
    f = Y.document_findings(written_documents(spark, sf_dir)).where("rule = 'unresolved_schema'")
    return f.select("repo_id", F.col("subject").alias("schema"), "severity")


SQL_OPAQUE = "has_body AND method IN ('POST', 'PUT', 'PATCH') AND (k % 7 = 0 OR (k % 2 <> 0 AND kind <> 'Signup'))"


@query("check_opaque_body", sql=f"WITH o AS {SQL_DOC_OPS} SELECT repo_id, path, lower(method) AS method FROM o WHERE {SQL_OPAQUE}")
def q_check_opaque_body(spark, sf_dir):
    """V7: operations whose body is an object without structure, also behind refs and wrappers."""
    return Y.opaque_bodies(write_stage(D.shred(written_documents(spark, sf_dir)).nodes(), "nodes"))


@query("validate", sql=f"""
WITH {SQL_NEEDED},
dp AS (SELECT repo_id, method, regexp_replace(lower(regexp_replace(regexp_replace(regexp_replace(path, '\\{{[^}}]+\\}}', '_PARAM_', 'g'), '^/+', ''),
         '/+$', '')), '[/\\-_]+', '_', 'g') AS key FROM (SELECT DISTINCT repo_id, method, path FROM {SQL_OPS}) GROUP BY ALL HAVING count(*) > 1),
w AS (SELECT repo_id, 'unresolved_schema' AS rule FROM need
        WHERE name NOT IN ('ViewOut', 'ClickOut', 'PurchaseOut', 'ViewBody', 'ClickBody', 'PurchaseBody', 'SignupBody')
      UNION ALL SELECT repo_id, 'duplicate_paths' FROM dp
      UNION ALL SELECT repo_id, 'missing_security' FROM o WHERE security IS NULL
      UNION ALL SELECT repo_id, 'missing_body' FROM o WHERE method IN ('POST', 'PUT', 'PATCH') AND NOT has_body
      UNION ALL SELECT repo_id, 'opaque_body' FROM o WHERE {SQL_OPAQUE}
      UNION ALL SELECT repo_id, 'dangling_ref' FROM need WHERE name IN ('ViewOut', 'ClickOut', 'PurchaseOut'))
SELECT repo_id, rule, CASE rule WHEN 'dangling_ref' THEN 'error' ELSE 'warning' END AS severity, count(*) AS n FROM w GROUP BY 1, 2""")
def q_validate(spark, sf_dir):
    """V8: all findings on the documents (structure, refs, custom rules) and duplicate paths, counted per rule."""
    f = Y.document_findings(written_documents(spark, sf_dir)).select("repo_id", "rule", "severity")
    v4 = A.check_duplicate_paths(event_ops(spark, sf_dir)).select("repo_id", F.lit("duplicate_paths").alias("rule"), F.lit("warning").alias("severity"))
    return f.unionByName(v4).groupBy("repo_id", "rule", "severity").agg(F.count(F.lit(1)).alias("n"))


@query("check_dangling", sql=f"""
WITH p AS ({SQL_PART})
SELECT a.repo_id, '#/components/schemas/' || a.name || '/properties/owner' AS at,
       '{REF}' || CASE WHEN a.p_partkey % 3 = 1 THEN 'String' ELSE 'Part' || CAST(a.p_partkey + 1 AS VARCHAR) END AS target
FROM p a WHERE a.p_partkey % 3 = 1 OR (a.p_partkey % 3 = 2 AND NOT EXISTS (SELECT 1 FROM p b WHERE b.repo_id = a.repo_id AND b.p_partkey = a.p_partkey + 1))""")
def q_check_dangling(spark, sf_dir):
    """V8: refs of the raw part documents that lead nowhere in their repository."""
    return Y.dangling(write_stage(D.shred(part_pieces(spark, sf_dir)).nodes(), "nodes"))
