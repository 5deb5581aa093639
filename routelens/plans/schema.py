"""Assembly, clean-up and validation bindings on ``events``.

Each event is an extracted endpoint: repository ``svc{user_id % 5}``, path
``/{event_type}s/{id}`` (parameter spelled by user parity, so templates merge),
method by ``event_id % 4``, operation id = event type, protected when
``value > 25``; ``props`` (``{"k": n}``) drives responses and schema nodes.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from routelens.functions.paths import path_params
from routelens.operators import spec as A
from routelens.operators.assemble import op_keep_first, path_canonicalize
from routelens.plans.catalog import query
from routelens.sources.tables import table

RESP_T = "array<struct<code:string,description:string,ref:string>>"


def _plain_ops(spark, sf_dir):
    """What the operations of ``event_ops`` are grouped and ordered by, beside the columns the rest follows from."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value", "props")
    method = F.element_at(F.array(*[F.lit(m) for m in ("GET", "POST", "PUT", "DELETE")]), (F.col("event_id") % 4 + 1).cast("int"))
    pname = F.when(F.col("user_id") % 2 == 0, F.lit("id")).otherwise(F.concat("event_type", F.lit("Id")))
    return e.select(
        F.concat(F.lit("svc"), (F.col("user_id") % 5).cast("string")).alias("repo_id"),
        F.col("user_id").alias("file_ord"), F.col("event_id").alias("ep_ord"), method.alias("method"),
        F.concat(F.lit("/"), "event_type", F.lit("s/{"), pname, F.lit("}")).alias("path"), "event_type", "value", "props")


def _details():
    """The other columns of ``event_ops``, from the rows of ``_plain_ops``."""
    k = F.get_json_object("props", "$.k").cast("int")
    resp = F.array(F.struct(F.lit("200").alias("code"), F.lit("").alias("description"),
                            F.concat(F.initcap("event_type"), F.lit("Out")).alias("ref")))
    resp = F.when(k > 50, F.concat(resp, F.array(F.struct(F.lit("404").alias("code"), F.lit("Not found").alias("description"), F.lit(None).cast("string").alias("ref"))))).otherwise(resp)
    resp = F.when(k % 10 == 0, F.concat(resp, F.array(F.struct(F.lit("200").alias("code"), F.lit("Cached").alias("description"), F.lit(None).cast("string").alias("ref"))))).otherwise(resp)
    declared = F.array(F.struct(F.lit("k").alias("name"), F.lit("query").alias("in"), F.lit(False).alias("required")),
                       F.struct(F.when(F.col("file_ord") % 2 == 0, F.lit("id")).otherwise(F.lit("page")).alias("name"),
                                F.lit("path").alias("in"), F.lit(True).alias("required")))
    return [
        F.col("event_type").alias("operation_id"),
        F.when(F.col("file_ord") % 3 == 0, F.lit("")).otherwise(F.initcap("event_type")).alias("tag"),
        (F.col("value") > 25).alias("protected"),
        F.when(F.col("value") > 25, F.array(F.lit("bearer"))).when(F.col("value") < 2, F.lit(None).cast("array<string>"))
        .otherwise(F.array().cast("array<string>")).alias("security"),
        (F.col("method").isin("POST", "PUT") & (F.col("value") > 10)).alias("has_body"),
        resp.cast(RESP_T).alias("responses"), declared.alias("declared"), k.alias("k"),
        F.concat(F.lit("src/"), "event_type", F.lit(".py")).alias("source_file")]


def event_ops(spark, sf_dir):
    return _plain_ops(spark, sf_dir).select("repo_id", "file_ord", "ep_ord", F.col("ep_ord").alias("event_id"), "method", "path", *_details())


SQL_OPS = """(SELECT 'svc' || CAST(user_id % 5 AS VARCHAR) AS repo_id, user_id AS file_ord, event_id AS ep_ord, event_id,
   ['GET','POST','PUT','DELETE'][(event_id % 4) + 1] AS method,
   '/' || event_type || 's/{' || CASE WHEN user_id % 2 = 0 THEN 'id' ELSE event_type || 'Id' END || '}' AS path,
   event_type AS operation_id, CASE WHEN user_id % 3 = 0 THEN '' ELSE upper(event_type[1]) || event_type[2:] END AS tag,
   value > 25 AS protected, CASE WHEN value > 25 THEN ['bearer'] WHEN value < 2 THEN NULL ELSE [] END AS security,
   ['GET','POST','PUT','DELETE'][(event_id % 4) + 1] IN ('POST', 'PUT') AND value > 10 AS has_body,
   CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, user_id % 2 = 0 AS even,
   upper(event_type[1]) || event_type[2:] || 'Out' AS out_ref, 'src/' || event_type || '.py' AS source_file FROM events)"""

# response rows (event_id, i, code, description) in list order, SQL twin of the array
SQL_RESP = f"""(SELECT event_id, protected, 0 AS i, '200' AS code, '' AS description FROM {SQL_OPS}
  UNION ALL SELECT event_id, protected, 1, '404', 'Not found' FROM {SQL_OPS} WHERE k > 50
  UNION ALL SELECT event_id, protected, 2, '200', 'Cached' FROM {SQL_OPS} WHERE k % 10 = 0)"""


@query("op_parameters", sql=f"""
SELECT event_id, array_to_string(list_transform(list_filter(l, lambda x, i: list_position(l, x) = i), lambda x: x), ',') AS params
FROM (SELECT event_id, list_concat(
        list_transform(list_filter(regexp_extract_all(path, '\\{{([^}}:]*)[^}}]*\\}}', 1), lambda x: x <> ''), lambda n: 'path:' || n),
        list_filter(['query:k', 'path:' || CASE WHEN even THEN 'id' ELSE 'page' END],
                    lambda d: NOT list_contains(regexp_extract_all(path, '\\{{([^}}:]*)[^}}]*\\}}', 1), split_part(d, ':', 2)))) AS l
      FROM {SQL_OPS})""")
def q_op_parameters(spark, sf_dir):
    """A1: path parameters first, declared ones without name collisions after, first (name, in) kept."""
    o = event_ops(spark, sf_dir)
    p = A.op_parameters(F.col("path"), F.col("declared"))
    return o.select("event_id", F.array_join(F.transform(p, lambda x: F.concat(x["in"], F.lit(":"), x["name"])), ",").alias("params"))


def _codes(col):
    return F.array_join(F.transform(col, lambda r: F.concat(r["code"], F.lit("="), r["description"])), ",")


SQL_LASTWINS = f"""(SELECT r.* FROM {SQL_RESP} r WHERE NOT EXISTS (SELECT 1 FROM {SQL_RESP} q WHERE q.event_id = r.event_id
   AND q.code = r.code AND q.i > r.i))"""


@query("op_responses", sql=f"""
SELECT event_id, string_agg(code || '=' || CASE WHEN description = '' THEN 'Response ' || code ELSE description END, ',' ORDER BY i) AS codes
FROM {SQL_LASTWINS} GROUP BY event_id""")
def q_op_responses(spark, sf_dir):
    """A3: response map per operation: default descriptions, a repeated code keeps its last entry."""
    o = event_ops(spark, sf_dir)
    return o.select("event_id", _codes(A.op_responses(F.col("responses"))).alias("codes"))


@query("inject_auth_responses", sql=f"""
WITH r AS (SELECT event_id, protected, i, code, CASE WHEN description = '' THEN 'Response ' || code ELSE description END AS d FROM {SQL_LASTWINS}),
x AS (SELECT event_id, i, code, d FROM r UNION ALL
      SELECT event_id, 10, '401', 'Unauthorized' FROM {SQL_OPS} WHERE protected UNION ALL
      SELECT event_id, 11, '403', 'Forbidden' FROM {SQL_OPS} WHERE protected)
SELECT event_id, string_agg(code || '=' || d, ',' ORDER BY i) AS codes FROM x GROUP BY event_id""")
def q_inject_auth_responses(spark, sf_dir):
    """Protected operations get 401 and 403."""
    o = event_ops(spark, sf_dir).withColumn("__r1", A.op_responses(F.col("responses")))
    return o.select("event_id", _codes(A.inject_auth_responses(F.col("__r1"), F.col("protected"))).alias("codes"))


@query("add_4xx", sql=f"""
WITH r AS (SELECT event_id, i, code, CASE WHEN description = '' THEN 'Response ' || code ELSE description END AS d FROM {SQL_LASTWINS}),
n AS (SELECT o.event_id, o.protected, NOT EXISTS (SELECT 1 FROM r WHERE r.event_id = o.event_id AND starts_with(r.code, '4')) AS no4 FROM {SQL_OPS} o),
x AS (SELECT event_id, i, code, d FROM r UNION ALL
      SELECT event_id, 9, '422', 'Validation Error' FROM n WHERE no4 UNION ALL
      SELECT event_id, 10, '401', 'Unauthorized' FROM n WHERE no4 AND protected UNION ALL
      SELECT event_id, 11, '403', 'Forbidden' FROM n WHERE no4 AND protected)
SELECT event_id, string_agg(code || '=' || d, ',' ORDER BY i) AS codes FROM x GROUP BY event_id""")
def q_add_4xx(spark, sf_dir):
    """F16: operations without any 4xx get 422 (and 401/403 when protected)."""
    o = event_ops(spark, sf_dir).withColumn("__r1", A.op_responses(F.col("responses")))
    return o.select("event_id", _codes(A.add_4xx(F.col("__r1"), F.col("protected"))).alias("codes"))


def kept_ops(spark, sf_dir):
    """First operation of each path and method.

    All events are grouped by path as it is written, in one pass over their few plain columns; spellings are merged
    on what is left, and lists, structs and what is parsed from JSON are made for the rows that were kept.
    """
    written, _ = op_keep_first(_plain_ops(spark, sf_dir), path_col="path")
    c = path_canonicalize(written)
    kept, _ = op_keep_first(c.drop("path").withColumnRenamed("canonical_path", "path"), path_col="path", seen="n_seen")
    return kept.select("repo_id", "path", "method", "template", "file_ord", "ep_ord", F.col("ep_ord").alias("event_id"), *_details(), "n_seen")


SQL_KEPT = f"""(WITH o AS (SELECT *, regexp_replace(path, '\\{{[^}}]*\\}}', '{{_}}', 'g') AS template FROM {SQL_OPS}),
c AS (SELECT o.* EXCLUDE (path), f.canonical AS path FROM o JOIN (SELECT repo_id, template, arg_min(path, (file_ord, ep_ord)) AS canonical
      FROM o GROUP BY 1, 2) f USING (repo_id, template))
SELECT * EXCLUDE (rn), n_seen FROM (SELECT *, row_number() OVER (PARTITION BY repo_id, path, method ORDER BY file_ord, ep_ord) AS rn,
      count(*) OVER (PARTITION BY repo_id, path, method) AS n_seen FROM c) WHERE rn = 1)"""


# F13 over the kept operations; the assembled description shares it
SQL_OP_IDS = f"""(WITH k AS {SQL_KEPT},
a AS (SELECT *, count(*) OVER (PARTITION BY repo_id, operation_id) AS n FROM k),
b AS (SELECT *, CASE WHEN n > 1 THEN (CASE WHEN coalesce(tag, '') <> '' THEN tag
        ELSE replace(trim(path, '/'), '/', '_') END) || '_' || operation_id ELSE operation_id END AS id1 FROM a),
c AS (SELECT *, row_number() OVER (PARTITION BY repo_id, operation_id, id1 ORDER BY file_ord, ep_ord) AS kk FROM b)
SELECT *, CASE WHEN n > 1 AND kk > 1 THEN id1 || '_' || substr(md5(path || ':' || method), 1, 6) ELSE id1 END AS op_id FROM c)"""


@query("operation_id_dedup", sql=f"SELECT repo_id, path, method, op_id AS operation_id FROM {SQL_OP_IDS}")
def q_operation_id_dedup(spark, sf_dir):
    """after A7/A8, unique operation ids (tag prefix, then an md5 suffix)."""
    d = A.operation_id_dedup(kept_ops(spark, sf_dir))
    return d.select("repo_id", "path", "method", "operation_id")


@query("check_duplicate_paths", sql=f"""
WITH k AS (SELECT DISTINCT repo_id, method, path, regexp_replace(lower(regexp_replace(regexp_replace(regexp_replace(path, '\\{{[^}}]+\\}}', '_PARAM_', 'g'),
              '^/+', ''), '/+$', '')), '[/\\-_]+', '_', 'g') AS key FROM {SQL_OPS})
SELECT repo_id, method, key, count(*) AS n, 'Potential duplicate ' || upper(method) || ' paths: ' || string_agg(path, ', ' ORDER BY path)
       || ' (normalized to same pattern)' AS message FROM k GROUP BY 1, 2, 3 HAVING count(*) > 1""")
def q_check_duplicate_paths(spark, sf_dir):
    """V4: path spellings that collapse to one dedup key per method."""
    return A.check_duplicate_paths(event_ops(spark, sf_dir))


@query("check_missing_security", sql=f"SELECT repo_id, path, method FROM {SQL_KEPT} WHERE security IS NULL")
def q_check_missing_security(spark, sf_dir):
    """V5: kept operations that declare no security at all."""
    return kept_ops(spark, sf_dir).where(F.col("security").isNull()).select("repo_id", "path", "method")


@query("check_missing_body", sql=f"SELECT repo_id, path, method FROM {SQL_KEPT} WHERE method IN ('POST', 'PUT', 'PATCH') AND NOT has_body")
def q_check_missing_body(spark, sf_dir):
    """V6: POST/PUT/PATCH operations without a request body."""
    k = kept_ops(spark, sf_dir)
    return k.where(F.col("method").isin("POST", "PUT", "PATCH") & ~F.col("has_body")).select("repo_id", "path", "method")


@query("endpoint_listing", sql=f"""
WITH k AS {SQL_KEPT}
SELECT repo_id, method, path, operation_id, CASE WHEN len(coalesce(security, [])) > 0 THEN array_to_string(security, ',') ELSE 'public' END AS auth,
       len(list_filter(regexp_extract_all(path, '\\{{([^}}:]*)[^}}]*\\}}', 1), lambda x: x <> '')) AS n_path_params, has_body,
       n_seen FROM k""")
def q_endpoint_listing(spark, sf_dir):
    """One listing row per kept operation (auth names or ``public``)."""
    k = kept_ops(spark, sf_dir)
    auth = F.when(F.size(F.coalesce("security", F.array().cast("array<string>"))) > 0, F.array_join("security", ",")).otherwise(F.lit("public"))
    return k.select("repo_id", "method", "path", "operation_id", auth.alias("auth"),
                    F.size(path_params(F.col("path"))).alias("n_path_params"), "has_body", "n_seen")


def _schemas(spark, sf_dir):
    """Extracted schemas: ``ViewOut``/``ClickOut`` spelled exactly, ``purchaseout`` in lower case."""
    e = table(spark, sf_dir, "events").select("event_type").distinct()
    nm = F.when(F.col("event_type") == "purchase", F.lit("purchaseout")).otherwise(F.concat(F.initcap("event_type"), F.lit("Out")))
    return e.where(F.col("event_type").isin("view", "click", "purchase")).select(nm.alias("name"))


@query("populate_components", sql=f"""
WITH need AS (SELECT DISTINCT repo_id, out_ref AS name FROM {SQL_KEPT}
              UNION SELECT DISTINCT repo_id, 'String' FROM {SQL_KEPT} WHERE has_body),
s AS (SELECT DISTINCT CASE WHEN event_type = 'purchase' THEN 'purchaseout' ELSE upper(event_type[1]) || event_type[2:] || 'Out' END AS name
      FROM events WHERE event_type IN ('view', 'click', 'purchase')),
np AS (SELECT * FROM need WHERE lower(name) NOT IN {tuple(A.primitive_keys())})
SELECT np.repo_id, np.name, CASE WHEN EXISTS (SELECT 1 FROM s WHERE s.name = np.name) THEN 'exact'
  WHEN EXISTS (SELECT 1 FROM s WHERE lower(s.name) = lower(np.name)) THEN 'case_insensitive' ELSE 'unresolved' END AS source FROM np""")
def q_populate_components(spark, sf_dir):
    """A10 + A11: schemas referenced by kept operations, minus primitives, filled exactly,
    case-insensitively, or with an unresolved placeholder."""
    k = kept_ops(spark, sf_dir)
    need = k.select("repo_id", F.concat(F.initcap(F.regexp_extract("path", "^/([a-z]+)s/", 1)), F.lit("Out")).alias("name"))
    need = need.unionByName(k.where("has_body").select("repo_id", F.lit("String").alias("name"))).distinct()
    need = need.where(~F.lower("name").isin(*A.primitive_keys()))
    s = _schemas(spark, sf_dir)
    exact = s.select(F.col("name"), F.lit(1).alias("e"))
    ci = s.select(F.lower("name").alias("lk"), F.lit(1).alias("c")).distinct()
    j = need.join(F.broadcast(exact), "name", "left").join(F.broadcast(ci), F.lower(need["name"]) == F.col("lk"), "left")
    return j.select("repo_id", "name", F.when(F.col("e").isNotNull(), "exact").when(F.col("c").isNotNull(), "case_insensitive")
                    .otherwise("unresolved").alias("source"))


@query("scheme_aggregate", sql=f"""
WITH r AS (SELECT repo_id, CASE WHEN k % 3 = 0 THEN 'oauth' ELSE 'token' END AS name, ep_ord AS ord,
                  CASE WHEN k % 3 = 0 THEN 'oauth2' ELSE 'bearer' END AS scheme_type, CASE WHEN k % 2 = 0 THEN 'clientCredentials' ELSE '' END AS flow,
                  operation_id || ':' || method AS scope FROM {SQL_OPS} WHERE protected)
SELECT repo_id, name, arg_min(scheme_type, ord) AS scheme_type, arg_min(flow, ord) AS flow,
       array_to_string(list_sort(list(DISTINCT scope)), ',') AS scopes FROM r GROUP BY 1, 2""")
def q_scheme_aggregate(spark, sf_dir):
    """A5: one entry per scheme name: first requirement's fields, union of scopes (sorted)."""
    o = event_ops(spark, sf_dir).where("protected")
    r = o.select("repo_id", F.when(F.col("k") % 3 == 0, "oauth").otherwise("token").alias("name"), F.col("ep_ord").alias("ord"),
                 F.when(F.col("k") % 3 == 0, "oauth2").otherwise("bearer").alias("scheme_type"),
                 F.when(F.col("k") % 2 == 0, "clientCredentials").otherwise("").alias("flow"),
                 F.array(F.concat_ws(":", "operation_id", "method")).alias("scopes"))
    a = A.scheme_aggregate(r)
    return a.select("repo_id", "name", "scheme_type", "flow", F.array_join("scopes", ",").alias("scopes"))


@query("scheme_to_openapi", sql="""
WITH t AS (SELECT DISTINCT ['bearer', 'basic', 'apikey', 'oauth2', 'cookie', 'custom'][(user_id % 6) + 1] AS st,
                  ['', 'implicit', 'clientCredentials', 'authorizationCode'][(user_id % 4) + 1] AS flow,
                  CASE WHEN user_id % 5 = 0 THEN 'token' ELSE '' END AS kn,
                  CASE WHEN user_id % 3 = 0 THEN 'query' ELSE 'header' END AS kin FROM events)
SELECT st, flow, kn, kin,
       CASE WHEN st IN ('apikey', 'cookie') THEN 'apiKey' WHEN st = 'oauth2' THEN 'oauth2' ELSE 'http' END AS type,
       CASE WHEN st = 'basic' THEN 'basic' WHEN st IN ('apikey', 'cookie', 'oauth2') THEN NULL ELSE 'bearer' END AS scheme,
       CASE WHEN st = 'bearer' THEN 'JWT' END AS bearer_format,
       CASE WHEN st = 'apikey' THEN kin WHEN st = 'cookie' THEN 'cookie' END AS "in",
       CASE WHEN st = 'apikey' THEN coalesce(nullif(kn, ''), 'X-API-Key') WHEN st = 'cookie' THEN 'session' END AS name,
       CASE WHEN st = 'oauth2' THEN CASE WHEN flow IN ('authorizationCode', 'clientCredentials', 'implicit') THEN flow
            ELSE 'password' END END AS oauth_flow FROM t""")
def q_scheme_to_openapi(spark, sf_dir):
    """OpenAPI security scheme objects (bearer/JWT, basic, apiKey, oauth2 flows, cookie; else bearer)."""
    e = table(spark, sf_dir, "events").select("user_id")
    st = F.element_at(F.array(*[F.lit(x) for x in ("bearer", "basic", "apikey", "oauth2", "cookie", "custom")]),
                      (F.col("user_id") % 6 + 1).cast("int"))
    fl = F.element_at(F.array(*[F.lit(x) for x in ("", "implicit", "clientCredentials", "authorizationCode")]),
                      (F.col("user_id") % 4 + 1).cast("int"))
    t = e.select(st.alias("st"), fl.alias("flow"), F.when(F.col("user_id") % 5 == 0, "token").otherwise("").alias("kn"),
                 F.when(F.col("user_id") % 3 == 0, "query").otherwise("header").alias("kin")).distinct()
    s = A.scheme_to_openapi(F.col("st"), F.col("flow"), F.col("kn"), F.col("kin"))
    return t.select("st", "flow", "kn", "kin", s["type"].alias("type"), s["scheme"].alias("scheme"),
                    s["bearer_format"].alias("bearer_format"), s["in"].alias("in"), s["name"].alias("name"),
                    s["flow"].alias("oauth_flow"))


def completeness_inputs(spark, sf_dir):
    # the event type is the first path segment of the kept operation (no join back to events)
    k = kept_ops(spark, sf_dir).withColumn("event_type", F.regexp_extract("path", "^/([a-z]+)s/", 1))
    k = A.with_final_responses(k)
    ops = k.select("repo_id", "security", F.transform("final_responses", lambda r: r["code"]).alias("codes"), "source_file")
    out = k.select("repo_id", F.concat(F.initcap("event_type"), F.lit("Out")).alias("name"))
    body = k.where("has_body").select("repo_id", F.concat(F.initcap("event_type"), F.lit("Body")).alias("name"))
    refs = out.unionByName(body).distinct()
    known = _schemas(spark, sf_dir).select(F.lower("name").alias("lk")).distinct().withColumn("known", F.lit(True))
    schemas = (refs.where(~F.lower("name").isin(*A.primitive_keys()))
               .join(F.broadcast(known), F.lower(F.col("name")) == F.col("lk"), "left")
               .select("repo_id", "name", F.col("known").isNull().alias("unresolved")))
    rf = (table(spark, sf_dir, "events").groupBy(F.concat(F.lit("svc"), (F.col("user_id") % 5).cast("string")).alias("repo_id"))
          .agg((F.count_distinct("event_type") + 1).alias("n_route_files")))
    return ops, schemas, refs, rf


SQL_COMPLETENESS = f"""
WITH k AS (SELECT kk.*, e.event_type FROM {SQL_KEPT} kk JOIN events e USING (event_id)),
refs AS (SELECT DISTINCT repo_id, upper(event_type[1]) || event_type[2:] || 'Out' AS name FROM k
         UNION SELECT DISTINCT repo_id, upper(event_type[1]) || event_type[2:] || 'Body' FROM k WHERE has_body),
sch AS (SELECT repo_id, name, lower(name) NOT IN ('viewout', 'clickout', 'purchaseout') AS unresolved FROM refs
        WHERE lower(name) NOT IN {tuple(A.primitive_keys())}),
o AS (SELECT repo_id, count(*) AS n_ops, bool_or(coalesce(len(security), 0) > 0) AS any_scheme, bool_and(security IS NOT NULL) AS all_auth,
             bool_and(NOT (security IS NULL OR len(security) > 0) OR protected) AS err_ok, count(DISTINCT source_file) AS n_files FROM k GROUP BY 1),
s AS (SELECT repo_id, count(*) AS n_schemas, count(*) FILTER (WHERE unresolved) AS n_unresolved FROM sch GROUP BY 1),
rf AS (SELECT 'svc' || CAST(user_id % 5 AS VARCHAR) AS repo_id, count(DISTINCT event_type) + 1 AS n_route_files FROM events GROUP BY 1),
c AS (SELECT o.repo_id, n_ops > 0 AS has_endpoints, any_scheme AS has_security_schemes, all_auth AND n_ops > 0 AS endpoints_have_auth,
             err_ok AS has_error_responses, true AS has_request_bodies, coalesce(n_schemas, 0) > 0 AS has_schemas,
             coalesce(n_unresolved, 0) = 0 AS no_unresolved_refs, true AS has_servers,
             least(1.0, n_files / CASE WHEN coalesce(n_route_files, 0) > 0 THEN n_route_files ELSE 1 END) AS route_coverage
      FROM o LEFT JOIN s USING (repo_id) LEFT JOIN rf USING (repo_id))"""


@query("completeness", sql=SQL_COMPLETENESS + " SELECT * FROM c")
def q_completeness(spark, sf_dir):
    """V9: the completeness checklist (endpoints, schemes, auth, 4xx, bodies, schemas, refs, servers, coverage)."""
    ops, schemas, refs, rf = completeness_inputs(spark, sf_dir)
    return A.completeness(ops, schemas, refs, rf)


_SEV = " ".join(f"WHEN '{c}' THEN '{sv}'" for c, _, sv in A.COMPLETENESS_CHECKS)
_LAB = " ".join(f"WHEN '{c}' THEN '{lab.replace(chr(39), chr(39) * 2)}'" for c, lab, _ in A.COMPLETENESS_CHECKS)


@query("completeness_severity", sql=SQL_COMPLETENESS + f"""
, u AS (UNPIVOT c ON {', '.join(c for c, _, _ in A.COMPLETENESS_CHECKS)} INTO NAME "check" VALUE passed)
SELECT repo_id, "check", CASE "check" {_LAB} END AS label, CASE "check" {_SEV} END AS severity FROM u WHERE NOT passed""")
def q_completeness_severity(spark, sf_dir):
    """Failed checklist items with their label and severity."""
    ops, schemas, refs, rf = completeness_inputs(spark, sf_dir)
    return A.completeness_severity(A.completeness(ops, schemas, refs, rf))


# ------------------------------------------------------------- schema nodes

def nodes(spark, sf_dir):
    """Flat schema-property nodes from ``props``: one property ``k`` per event schema row."""
    e = table(spark, sf_dir, "events").select("event_id", "event_type", "value", "props")
    k = F.get_json_object("props", "$.k").cast("int")
    typ = F.element_at(F.array(*[F.lit(t) for t in ("integer", "string", "array", "object", "")]), (k % 5 + 1).cast("int"))
    return e.select("event_id", k.alias("k"), typ.alias("type"),
                    F.when(k % 3 == 0, k.cast("double")).alias("exclusive_minimum"),
                    F.when(k % 4 == 0, F.lit(1)).otherwise(F.lit(None)).cast("int").alias("minimum"),
                    F.when(k % 7 == 0, k).alias("maximum"),
                    (F.col("value") > 30).alias("nullable"), (k % 2 == 0).alias("has_items"),
                    F.when(k % 6 == 0, F.lit(0)).otherwise(F.lit(None)).cast("int").alias("n_required"),
                    F.when(k % 9 == 0, F.concat(F.initcap("event_type"), F.lit("Out"))).alias("ref"))


SQL_NODES = """(SELECT event_id, k, ['integer', 'string', 'array', 'object', ''][(k % 5) + 1] AS type,
   CASE WHEN k % 3 = 0 THEN CAST(k AS DOUBLE) END AS exclusive_minimum, CASE WHEN k % 4 = 0 THEN 1 END AS minimum,
   CASE WHEN k % 7 = 0 THEN k END AS maximum, value > 30 AS nullable, k % 2 = 0 AS has_items,
   CASE WHEN k % 6 = 0 THEN 0 END AS n_required, CASE WHEN k % 9 = 0 THEN upper(event_type[1]) || event_type[2:] || 'Out' END AS ref
 FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events))"""


@query("exclusive_bounds", sql=f"""SELECT event_id, CASE WHEN exclusive_minimum IS NOT NULL THEN exclusive_minimum ELSE minimum END AS minimum,
  exclusive_minimum IS NOT NULL AS exclusive_minimum FROM {SQL_NODES}""")
def q_exclusive_bounds(spark, sf_dir):
    """a numeric ``exclusiveMinimum`` becomes ``minimum`` plus the boolean flag."""
    n = nodes(spark, sf_dir)
    return n.select("event_id", F.when(F.col("exclusive_minimum").isNotNull(), F.col("exclusive_minimum"))
                    .otherwise(F.col("minimum").cast("double")).alias("minimum"),
                    F.col("exclusive_minimum").isNotNull().alias("exclusive_minimum"))


@query("strip_empty_required", sql=f"SELECT event_id, nullif(n_required, 0) AS n_required FROM {SQL_NODES}")
def q_strip_empty_required(spark, sf_dir):
    """``required: []`` is removed (NULL)."""
    return nodes(spark, sf_dir).select("event_id", F.nullif("n_required", F.lit(0)).alias("n_required"))


@query("string_length_bounds", sql=f"""SELECT event_id, CASE WHEN type = 'string' THEN minimum END AS min_length,
  CASE WHEN type = 'string' THEN maximum END AS max_length, CASE WHEN type <> 'string' THEN minimum END AS minimum,
  CASE WHEN type <> 'string' THEN maximum END AS maximum FROM {SQL_NODES}""")
def q_string_length_bounds(spark, sf_dir):
    """F8: minimum/maximum on strings become minLength/maxLength."""
    n = nodes(spark, sf_dir)
    s = F.col("type") == "string"
    return n.select("event_id", F.when(s, F.col("minimum")).alias("min_length"), F.when(s, F.col("maximum")).alias("max_length"),
                    F.when(~s, F.col("minimum")).alias("minimum"), F.when(~s, F.col("maximum")).alias("maximum"))


@query("nullable_needs_type", sql=f"""SELECT event_id, CASE WHEN nullable AND type = '' AND ref IS NULL THEN 'object' ELSE type END AS type
  FROM {SQL_NODES}""")
def q_nullable_needs_type(spark, sf_dir):
    """nullable nodes with neither type nor ``$ref`` become objects."""
    n = nodes(spark, sf_dir)
    return n.select("event_id", F.when(F.col("nullable") & (F.col("type") == "") & F.col("ref").isNull(), F.lit("object"))
                    .otherwise(F.col("type")).alias("type"))


@query("wrap_ref_siblings", sql=f"""SELECT event_id, CASE WHEN ref IS NOT NULL AND (nullable OR type <> '') THEN
  '{{"allOf":[{{"$ref":"#/components/schemas/' || ref || '"}}]' || CASE WHEN nullable THEN ',"nullable":true,"type":"object"' ELSE '' END || '}}'
  WHEN ref IS NOT NULL THEN '{{"$ref":"#/components/schemas/' || ref || '"}}' END AS node FROM {SQL_NODES} WHERE ref IS NOT NULL""")
def q_wrap_ref_siblings(spark, sf_dir):
    """a ``$ref`` with siblings is wrapped in ``allOf``; a nullable wrapper gets ``type: object``."""
    n = nodes(spark, sf_dir).where(F.col("ref").isNotNull())
    ref = F.concat(F.lit('{"$ref":"#/components/schemas/'), F.col("ref"), F.lit('"}'))
    wrapped = F.concat(F.lit('{"allOf":['), ref, F.lit("]"),
                       F.when(F.col("nullable"), F.lit(',"nullable":true,"type":"object"')).otherwise(F.lit("")), F.lit("}"))
    return n.select("event_id", F.when(F.col("nullable") | (F.col("type") != ""), wrapped).otherwise(ref).alias("node"))


@query("dedup_key_collisions", sql=f"""
SELECT repo_id, count(DISTINCT path) AS n_spellings, count(DISTINCT regexp_replace(path, '\\{{[^}}]*\\}}', '{{_}}', 'g')) AS n_templates
FROM {SQL_OPS} GROUP BY 1""")
def q_dedup_key_collisions(spark, sf_dir):
    """identical paths - spellings vs templates per repository (merged by template)."""
    o = event_ops(spark, sf_dir)
    return o.groupBy("repo_id").agg(F.count_distinct("path").alias("n_spellings"),
                                    F.count_distinct(F.regexp_replace("path", r"\{[^}]*\}", "{_}")).alias("n_templates"))



def hint_rows(spark, sf_dir):
    o = event_ops(spark, sf_dir).join(table(spark, sf_dir, "events").select("event_id", "event_type"), "event_id")
    body = o.where("has_body").select("repo_id", "source_file", "ep_ord", F.lit(0).alias("src_ord"),
                                      F.concat(F.initcap("event_type"), F.lit("Body")).alias("name"), F.lit("request_body").alias("source"))
    resp = o.select("repo_id", "source_file", "ep_ord", F.lit(1).alias("src_ord"),
                    F.concat(F.initcap("event_type"), F.lit("Out")).alias("name"), F.lit("response").alias("source"))
    return body.unionByName(resp).withColumn("import_line", F.lit("")).withColumn("namespace", F.lit(""))


SQL_HINT_ROWS = f"""(SELECT o.repo_id, o.source_file, o.ep_ord, 0 AS src_ord, upper(e.event_type[1]) || e.event_type[2:] || 'Body' AS name,
   'request_body' AS source FROM {SQL_OPS} o JOIN events e USING (event_id) WHERE o.has_body
 UNION ALL SELECT o.repo_id, o.source_file, o.ep_ord, 1, o.out_ref, 'response' FROM {SQL_OPS} o)"""
SQL_COLLECTED = f"""(SELECT repo_id, source_file, name, '' AS import_line, '' AS namespace, arg_min(source, (ep_ord, src_ord)) AS source,
   min(ep_ord) AS first_ep FROM {SQL_HINT_ROWS} GROUP BY 1, 2, 3)"""


@query("ref_hints_collect", sql=f"SELECT * FROM {SQL_COLLECTED}")
def q_ref_hints_collect(spark, sf_dir):
    """Request-body and response refs per file, each key once, tagged with its first source."""
    from routelens.operators.resolve import ref_hints_collect
    return ref_hints_collect(hint_rows(spark, sf_dir))


@query("ref_hints_dedup", sql=f"""
WITH c AS {SQL_COLLECTED}, f AS (SELECT repo_id, source_file, min(ep_ord) AS file_ord FROM {SQL_OPS} GROUP BY 1, 2)
SELECT c.repo_id, c.name, c.import_line, c.namespace, arg_min(c.source_file, (f.file_ord, c.first_ep)) AS source_file,
       arg_min(c.source, (f.file_ord, c.first_ep)) AS source FROM c JOIN f USING (repo_id, source_file) GROUP BY 1, 2, 3, 4""")
def q_ref_hints_dedup(spark, sf_dir):
    """The same hint across a repository keeps the first file's entry (files in first-seen order)."""
    from routelens.operators.resolve import ref_hints_collect, ref_hints_dedup
    c = ref_hints_collect(hint_rows(spark, sf_dir))
    f = event_ops(spark, sf_dir).groupBy("repo_id", "source_file").agg(F.min("ep_ord").alias("file_ord"))
    return ref_hints_dedup(c.join(f, ["repo_id", "source_file"]))


@query("op_security", sql=f"""
SELECT event_id, CASE WHEN security IS NULL THEN NULL WHEN len(security) = 0 THEN '[]'
  ELSE '[' || array_to_string(list_transform(security, lambda s: '{{"' || s || '":[]}}'), ',') || ']' END AS security_json FROM {SQL_OPS}""")
def q_op_security(spark, sf_dir):
    """A4: ``[]`` marks a public operation (never omitted); otherwise one object per requirement."""
    o = event_ops(spark, sf_dir)
    js = F.when(F.col("security").isNull(), F.lit(None).cast("string")).when(F.size("security") == 0, F.lit("[]")).otherwise(
        F.concat(F.lit("["), F.array_join(F.transform("security", lambda s: F.concat(F.lit('{"'), s, F.lit('":[]}'))), ","), F.lit("]")))
    return o.select("event_id", js.alias("security_json"))
