"""Operation assembly, clean-up passes and quality rules.

Operations live in ``spec_ops(repo_id, path, method, operation_id, tag, protected,
has_body, body_ref, responses ARRAY<STRUCT<code, description, ref>>, ...)``;
schema properties live as flat node rows. Every pass is a column expression or
a keyed aggregation; per-repository results come from ``groupBy(repo_id)``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from routelens.functions.hints import PRIMITIVE_TYPES
from routelens.functions.paths import path_dedup_key, path_params

# OpenAPI security scheme shapes (A6): bearer is http/bearer/JWT, apikey
# defaults its name to X-API-Key, basic is http/basic, oauth2 keeps one of
# authorizationCode / clientCredentials / implicit (else password), cookie is an
# apiKey cookie named "session", anything else is http/bearer.
OAUTH_FLOWS = ("authorizationCode", "clientCredentials", "implicit")


def op_parameters(path: Column, declared: Column) -> Column:
    """A1: path parameters (required strings) first, then declared ones whose name is
    not a path parameter; the first of each ``(name, in)`` is kept.

    ``declared``: ``array<struct<name string, in string, required boolean>>``.
    """
    pp = F.transform(path_params(path), lambda n: F.struct(n.alias("name"), F.lit("path").alias("in"),
                                                           F.lit(True).alias("required")))
    rest = F.filter(declared, lambda p: ~F.array_contains(path_params(path), p["name"]))
    allp = F.concat(pp, rest)
    empty = F.array().cast("array<struct<name:string,in:string,required:boolean>>")
    return F.aggregate(allp, empty, lambda acc, p: F.when(
        F.exists(acc, lambda q: (q["name"] == p["name"]) & (q["in"] == p["in"])), acc).otherwise(F.concat(acc, F.array(p))))


def op_responses(responses: Column) -> Column:
    """A3: code -> (description, ref); default description ``Response {code}``;
    no responses -> ``200 OK``; a repeated code keeps its last entry.

    ``responses``: ``array<struct<code string, description string, ref string>>``.
    """
    idx = F.transform(responses, lambda r, i: F.struct(r["code"].alias("code"), i.alias("i"),
                                                       F.coalesce(F.nullif(r["description"], F.lit("")),
                                                                  F.concat(F.lit("Response "), r["code"])).alias("description"),
                                                       r["ref"].alias("ref")))
    last = F.filter(idx, lambda r: ~F.exists(idx, lambda q: (q["code"] == r["code"]) & (q["i"] > r["i"])))
    out = F.transform(last, lambda r: F.struct(r["code"].alias("code"), r["description"].alias("description"), r["ref"].alias("ref")))
    ok = F.array(F.struct(F.lit("200").alias("code"), F.lit("OK").alias("description"), F.lit(None).cast("string").alias("ref")))
    return F.when(F.size(responses) > 0, out).otherwise(ok)


def inject_auth_responses(responses: Column, protected: Column) -> Column:
    """A protected operation gets 401 and 403 when they are missing."""
    def add(arr, code, desc):
        return F.when(protected & ~F.exists(arr, lambda r: r["code"] == code),
                      F.concat(arr, F.array(F.struct(F.lit(code).alias("code"), F.lit(desc).alias("description"),
                                                     F.lit(None).cast("string").alias("ref"))))).otherwise(arr)
    return add(add(responses, "401", "Unauthorized"), "403", "Forbidden")


def add_4xx(responses: Column, protected: Column) -> Column:
    """F16: no 4xx (and non-empty responses) -> 422, plus 401/403 when protected."""
    no4 = (F.size(responses) > 0) & ~F.exists(responses, lambda r: r["code"].startswith("4"))
    with422 = F.concat(responses, F.array(F.struct(F.lit("422").alias("code"), F.lit("Validation Error").alias("description"),
                                                   F.lit(None).cast("string").alias("ref"))))
    return F.when(no4, inject_auth_responses(with422, protected)).otherwise(responses)


def with_final_responses(ops: DataFrame, responses: str = "responses", protected: str = "protected",
                         out: str = "final_responses") -> DataFrame:
    """A3 -> A9 -> F16 staged over three projections.

    Each step reads the previous step's column, so the optimizer keeps them as
    separate projections instead of inlining a response array expression into
    every place the next step references it.
    """
    return (ops.withColumn("__r1", op_responses(F.col(responses)))
            .withColumn("__r2", inject_auth_responses(F.col("__r1"), F.col(protected)))
            .withColumn(out, add_4xx(F.col("__r2"), F.col(protected))).drop("__r1", "__r2"))


def scheme_to_openapi(scheme_type: Column, flow: Column, apikey_name: Column, apikey_in: Column) -> Column:
    """struct(type, scheme, bearer_format, in, name, flow) of an OpenAPI security scheme."""
    t = scheme_type
    null = F.lit(None).cast("string")
    typ = (F.when(t.isin("apikey", "cookie"), F.lit("apiKey")).when(t == "oauth2", F.lit("oauth2")).otherwise(F.lit("http")))
    sch = F.when(t == "basic", F.lit("basic")).when(t.isin("apikey", "cookie", "oauth2"), null).otherwise(F.lit("bearer"))
    fmt = F.when(t == "bearer", F.lit("JWT")).otherwise(null)
    where = F.when(t == "apikey", apikey_in).when(t == "cookie", F.lit("cookie")).otherwise(null)
    name = (F.when(t == "apikey", F.coalesce(F.nullif(apikey_name, F.lit("")), F.lit("X-API-Key")))
            .when(t == "cookie", F.lit("session")).otherwise(null))
    fl = F.when(t == "oauth2", F.when(flow.isin(*OAUTH_FLOWS), flow).otherwise(F.lit("password"))).otherwise(null)
    return F.struct(typ.alias("type"), sch.alias("scheme"), fmt.alias("bearer_format"), where.alias("in"),
                    name.alias("name"), fl.alias("flow"))


def scheme_aggregate(reqs: DataFrame) -> DataFrame:
    """A5: per (repo, scheme name): the first requirement's fields and the sorted union of scopes."""
    s = reqs.select("repo_id", "name", "ord", "scheme_type", "flow", F.explode_outer("scopes").alias("scope"))
    return s.groupBy("repo_id", "name").agg(
        F.min_by(F.struct("scheme_type", "flow"), "ord").alias("first"),
        F.array_sort(F.collect_set("scope")).alias("scopes")).select(
        "repo_id", "name", "first.scheme_type", "first.flow", "scopes")


def operation_id_dedup(ops: DataFrame, order_cols=("file_ord", "ep_ord")) -> DataFrame:
    """colliding operation ids get a ``{tag}_`` prefix (or a path prefix when
    there is no tag: the path without outer slashes, inner ones as ``_``); within one
    colliding id, equal new ids get ``_`` + 6 hex of md5(``path:method``) on every
    occurrence after the first (ids of different groups are not compared, Q8).

    Collision counts and "first occurrence" are aggregates joined back on the id,
    not windows, so a hot id is split by AQE's skew join instead of one task.
    """
    o = F.struct(*order_cols)
    n = ops.groupBy("repo_id", "operation_id").agg(F.count(F.lit(1)).alias("__n"))
    x = ops.join(n, ["repo_id", "operation_id"])
    prefix = F.when(F.coalesce(F.col("tag"), F.lit("")) != "", F.col("tag")).otherwise(
        F.translate(F.btrim(F.col("path"), F.lit("/")), "/", "_"))
    x = x.withColumn("__id", F.when(F.col("__n") > 1, F.concat(prefix, F.lit("_"), F.col("operation_id"))).otherwise(F.col("operation_id")))
    first = x.groupBy("repo_id", "operation_id", "__id").agg(F.min(o).alias("__first"))
    x = x.join(first, ["repo_id", "operation_id", "__id"])
    suffix = F.substring(F.md5(F.concat_ws(":", "path", "method")), 1, 6)
    later = (F.col("__n") > 1) & ~o.eqNullSafe(F.col("__first"))
    x = x.withColumn("operation_id", F.when(later, F.concat(F.col("__id"), F.lit("_"), suffix)).otherwise(F.col("__id")))
    return x.drop("__n", "__id", "__first")


def check_duplicate_paths(ops: DataFrame) -> DataFrame:
    """V4: more than one path per (method, P4 key) -> one warning row."""
    k = ops.select("repo_id", "method", "path", path_dedup_key(F.col("path")).alias("key")).distinct()
    g = k.groupBy("repo_id", "method", "key").agg(F.count(F.lit(1)).alias("n"),
                                                   F.array_join(F.sort_array(F.collect_list("path")), ", ").alias("paths"))
    return g.where(F.col("n") > 1).select("repo_id", "method", "key", "n", F.concat(
        F.lit("Potential duplicate "), F.upper("method"), F.lit(" paths: "), F.col("paths"),
        F.lit(" (normalized to same pattern)")).alias("message"))


# The completeness checklist - check, label, severity when it fails.
COMPLETENESS_CHECKS = (
    ("has_endpoints", "Endpoints discovered", "critical"),
    ("has_security_schemes", "Security schemes defined", "warning"),
    ("endpoints_have_auth", "Endpoints have auth", "warning"),
    ("has_error_responses", "Error responses (4xx)", "info"),
    ("has_request_bodies", "Request bodies", "info"),
    ("has_schemas", "Schemas extracted", "warning"),
    ("no_unresolved_refs", "All $refs resolved", "warning"),
    ("has_servers", "Server URLs", "info"),
)


def completeness(ops: DataFrame, schemas: DataFrame, refs: DataFrame, route_files: DataFrame) -> DataFrame:
    """V9: the completeness checklist per repository.

    ``ops(repo_id, security, codes ARRAY, source_file)`` (final response codes),
    ``schemas(repo_id, name, unresolved)``, ``refs(repo_id, name)`` (body and
    response refs), ``route_files(repo_id, n_route_files)``. Error responses are
    required on every operation whose security is absent or non-empty; request
    bodies and servers are always present (the editable server entry).
    """
    sec_set = F.size(F.coalesce("security", F.array().cast("array<string>"))) > 0
    needs_err = F.col("security").isNull() | sec_set
    has_err = F.exists("codes", lambda c: c.isin("401", "403"))
    o = ops.groupBy("repo_id").agg(
        F.count(F.lit(1)).alias("n_ops"), F.bool_or(sec_set).alias("any_scheme"),
        F.bool_and(F.col("security").isNotNull()).alias("all_auth"),
        F.bool_and(~needs_err | has_err).alias("err_ok"), F.count_distinct("source_file").alias("n_files"))
    s = schemas.groupBy("repo_id").agg(F.count(F.lit(1)).alias("n_schemas"), F.count_if(F.col("unresolved")).alias("n_unresolved"))
    miss = (refs.select("repo_id", "name").distinct().join(schemas.select("repo_id", "name"), ["repo_id", "name"], "left_anti")
            .groupBy("repo_id").agg(F.count(F.lit(1)).alias("n_missing")))
    j = (o.join(s, "repo_id", "left").join(miss, "repo_id", "left").join(route_files, "repo_id", "left")
         .fillna(0, ["n_schemas", "n_unresolved", "n_missing"]))
    total = F.when(F.coalesce("n_route_files", F.lit(0)) > 0, F.col("n_route_files")).otherwise(F.lit(1))
    return j.select(
        "repo_id", (F.col("n_ops") > 0).alias("has_endpoints"), F.col("any_scheme").alias("has_security_schemes"),
        (F.col("all_auth") & (F.col("n_ops") > 0)).alias("endpoints_have_auth"), F.col("err_ok").alias("has_error_responses"),
        F.lit(True).alias("has_request_bodies"), (F.col("n_schemas") > 0).alias("has_schemas"),
        ((F.col("n_unresolved") == 0) & (F.col("n_missing") == 0)).alias("no_unresolved_refs"),
        F.lit(True).alias("has_servers"), F.least(F.lit(1.0), F.col("n_files") / total).alias("route_coverage"))


def completeness_severity(checklist: DataFrame) -> DataFrame:
    """Failed checks with their label and severity (unpivot + fixed severity table)."""
    names = [c for c, _, _ in COMPLETENESS_CHECKS]
    u = checklist.unpivot("repo_id", names, "check", "passed").where(~F.col("passed"))
    label = F.create_map(*[x for c, lab, _ in COMPLETENESS_CHECKS for x in (F.lit(c), F.lit(lab))])
    sev = F.create_map(*[x for c, _, sv in COMPLETENESS_CHECKS for x in (F.lit(c), F.lit(sv))])
    return u.select("repo_id", "check", F.element_at(label, F.col("check")).alias("label"),
                    F.element_at(sev, F.col("check")).alias("severity"))


def primitive_keys() -> list[str]:
    return sorted(PRIMITIVE_TYPES)


# Constraint keyword aliases and their JSON-Schema names (F4), in rename order.
CONSTRAINT_RENAMES = (
    ("ge", "minimum"), ("le", "maximum"),
    ("gt", "exclusiveMinimum"), ("lt", "exclusiveMaximum"),
    ("multiple_of", "multipleOf"),
    ("min_length", "minLength"), ("max_length", "maxLength"),
    ("minlength", "minLength"), ("maxlength", "maxLength"),
    ("min_items", "minItems"), ("max_items", "maxItems"),
    ("minitems", "minItems"), ("maxitems", "maxItems"),
    ("unique_items", "uniqueItems"),
    ("min_properties", "minProperties"), ("max_properties", "maxProperties"),
)
# JSON-Schema type words and keys whose string values stay strings.
JSON_SCHEMA_TYPES = ("string", "integer", "number", "boolean", "array", "object")
STRING_VALUE_KEYS = ("$ref", "type", "format", "description", "pattern", "title", "default", "example", "x-circular-ref")


def constraint_rename(m: Column) -> Column:
    """alias keys renamed to their JSON-Schema names unless the target (or an earlier
    alias of the same target) is already present; the existing key wins."""
    def target(k):
        t = F.lit(None).cast("string")
        for a, b in CONSTRAINT_RENAMES:
            t = F.when(k == a, F.lit(b)).otherwise(t)
        return t

    def blocked(k):
        # an alias earlier in rename order with the same target is present
        b = F.lit(False)
        for i, (a, t) in enumerate(CONSTRAINT_RENAMES):
            earlier = [x for x, y in CONSTRAINT_RENAMES[:i] if y == t]
            if earlier:
                cond = F.lit(False)
                for x in earlier:
                    cond = cond | F.map_contains_key(m, F.lit(x))
                b = F.when(k == a, cond).otherwise(b)
        return b

    def new_key(e):
        t = target(e["key"])
        return F.when(t.isNotNull() & ~F.map_contains_key(m, t) & ~blocked(e["key"]), t).otherwise(e["key"])

    return F.map_from_entries(F.transform(F.map_entries(m), lambda e: F.struct(new_key(e).alias("key"), e["value"].alias("value"))))


def coerce_property(v: Column) -> Column:
    """JSON text of the schema for a non-object property value (VARIANT input)."""
    t = F.schema_of_variant(v)
    s = F.regexp_replace(F.try_variant_get(v, "$", "string"), r"^\s+|\s+$", "")
    low = F.lower(s)
    parsed = F.try_parse_json(s)
    is_obj_text = (s.startswith("{") & s.endswith("}")) & parsed.isNotNull() & F.schema_of_variant(parsed).startswith("OBJECT")
    ident = s.rlike(r"^[A-Z][A-Za-z0-9_]*$")

    def as_ref(target):
        quoted = F.regexp_replace(F.to_json(F.array(target)), r"^\[|\]$", "")  # JSON-escaped string
        return F.concat(F.lit('{"$ref":'), quoted, F.lit("}"))

    string_case = (F.when(low.isin(*JSON_SCHEMA_TYPES), F.concat(F.lit('{"type":"'), low, F.lit('"}')))
                   .when(s.startswith("#/components/schemas/"), as_ref(s))
                   .when(is_obj_text, F.to_json(parsed))
                   .when(ident, as_ref(F.concat(F.lit("#/components/schemas/"), s)))
                   .otherwise(F.lit('{"type":"string"}')))
    return (F.when(v.isNull() | (t == "VOID"), F.lit('{"type":"string","nullable":true}'))
            .when(t == "STRING", string_case)
            .when(t == "BOOLEAN", F.lit('{"type":"boolean"}'))
            .when(t.rlike("^(BIGINT|INT|SMALLINT|TINYINT|DOUBLE|FLOAT|DECIMAL)"), F.lit('{"type":"number"}'))
            .when(t.startswith("ARRAY"), F.lit('{"type":"array","items":{"type":"string"}}'))
            .when(t.startswith("OBJECT"), F.to_json(v))
            .otherwise(F.lit('{"type":"object"}')))


def parse_json_string(key: Column, value: Column) -> Column:
    """kind of a string attribute after clean-up: ``object``/``array`` when it holds
    JSON of that shape, ``ref`` for a bare schema ref, else ``string`` (allow-listed
    keys always stay strings)."""
    s = F.regexp_replace(value, r"^\s+|\s+$", "")
    braced = (s.startswith("{") & s.endswith("}")) | (s.startswith("[") & s.endswith("]"))
    p = F.try_parse_json(s)
    kind = (F.when(braced & p.isNotNull() & F.schema_of_variant(p).startswith("OBJECT"), "object")
            .when(braced & p.isNotNull() & F.schema_of_variant(p).startswith("ARRAY"), "array")
            .when(~braced & s.startswith("#/components/schemas/"), "ref")
            .otherwise("string"))
    return F.when(key.isin(*STRING_VALUE_KEYS), F.lit("string")).otherwise(kind)


def schema_case_align(schemas: DataFrame, refs: DataFrame) -> DataFrame:
    """schema keys renamed to the spelling their refs use when they differ only by case.

    ``schemas(repo_id, name, ord)``, ``refs(repo_id, target)``. The first spelling per
    lower-cased name is the actual key; a key is renamed once (smallest target wins).
    """
    first = schemas.groupBy("repo_id", F.lower("name").alias("k")).agg(F.min_by("name", "ord").alias("actual"))
    missing = refs.select("repo_id", "target").distinct().join(
        schemas.select("repo_id", F.col("name").alias("target")), ["repo_id", "target"], "left_anti")
    j = missing.withColumn("k", F.lower("target")).join(first, ["repo_id", "k"]).where(F.col("actual") != F.col("target"))
    return j.groupBy("repo_id", "actual").agg(F.min("target").alias("renamed_to"))


def merge_identical_paths(ops: DataFrame, order_cols=("file_ord", "ep_ord")) -> DataFrame:
    """paths equal under P2 merge into the first one; the log lists merged methods
    (absent from the canonical path) and removed duplicate paths."""
    o = F.struct(*order_cols)
    paths = ops.groupBy("repo_id", "path").agg(F.min(o).alias("o")).withColumn(
        "template", F.regexp_replace("path", r"\{[^}]+\}", "{_}"))
    canon = paths.groupBy("repo_id", "template").agg(F.min_by("path", "o").alias("canonical"))
    p = paths.join(canon, ["repo_id", "template"]).where(F.col("path") != F.col("canonical"))
    meth = ops.select("repo_id", "path", F.lower("method").alias("method")).distinct()
    dup_m = p.join(meth, ["repo_id", "path"])
    can_m = meth.select("repo_id", F.col("path").alias("canonical"), "method")
    merged = dup_m.join(can_m, ["repo_id", "canonical", "method"], "left_anti").select(
        "repo_id", F.lit("merged").alias("kind"), "path", "canonical", "method")
    removed = p.select("repo_id", F.lit("removed").alias("kind"), "path", "canonical", F.lit(None).cast("string").alias("method"))
    return merged.unionByName(removed)
