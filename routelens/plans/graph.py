"""Schema-graph bindings.

The reference graph is built from the key relationships of the star schema:
``customer -> nation``, ``supplier -> nation``, ``nation -> region`` (allOf-like
parents) and, from ``lineitem``, ``part -> supplier`` (through array items) plus
``supplier -> part`` for some pairs, which closes cycles. One repository
(``tpch``) holds all of it; every join is keyed by node as well, so the single
repository value is never a shuffle key on its own.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from routelens.functions.hints import PRIMITIVE_TYPES, build_ref, hint_parse
from routelens.operators import resolve as G
from routelens.operators.rules import rule_table
from routelens.plans.catalog import query
from routelens.plans.hints import _INNER, SQL_BUILD, SQL_HINTS, part_hints
from routelens.session import spread
from routelens.sources.tables import table

REPO = "tpch"


def _node(prefix, key):
    return F.concat(F.lit(prefix + "_"), F.col(key).cast("string"))


def ref_edges(spark, sf_dir):
    """``schema_edges(repo_id, src, dst, via_array)``."""
    c = table(spark, sf_dir, "customer").select(_node("customer", "c_custkey").alias("src"),
                                                 _node("nation", "c_nationkey").alias("dst"), F.lit(False).alias("via_array"))
    s = table(spark, sf_dir, "supplier").select(_node("supplier", "s_suppkey").alias("src"),
                                                 _node("nation", "s_nationkey").alias("dst"), F.lit(False).alias("via_array"))
    n = table(spark, sf_dir, "nation").select(_node("nation", "n_nationkey").alias("src"),
                                               _node("region", "n_regionkey").alias("dst"), F.lit(False).alias("via_array"))
    li = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey")
    li = spread(li, "l_partkey", "l_suppkey", rows=li.count()).distinct()
    ps = li.select(_node("part", "l_partkey").alias("src"), _node("supplier", "l_suppkey").alias("dst"),
                   F.lit(True).alias("via_array"))
    sp = li.where((F.col("l_partkey") + F.col("l_suppkey")) % 7 == 0).select(
        _node("supplier", "l_suppkey").alias("src"), _node("part", "l_partkey").alias("dst"), F.lit(False).alias("via_array"))
    return c.unionByName(s).unionByName(n).unionByName(ps).unionByName(sp).withColumn("repo_id", F.lit(REPO))


SQL_EDGES = """(SELECT 'tpch' AS repo_id, * FROM (
  SELECT 'customer_' || c_custkey AS src, 'nation_' || c_nationkey AS dst, false AS via_array FROM customer
  UNION ALL SELECT 'supplier_' || s_suppkey, 'nation_' || s_nationkey, false FROM supplier
  UNION ALL SELECT 'nation_' || n_nationkey, 'region_' || n_regionkey, false FROM nation
  UNION ALL SELECT DISTINCT 'part_' || l_partkey, 'supplier_' || l_suppkey, true FROM lineitem
  UNION ALL SELECT DISTINCT 'supplier_' || l_suppkey, 'part_' || l_partkey, false FROM lineitem
            WHERE (l_partkey + l_suppkey) % 7 = 0))"""


def seeds(spark, sf_dir):
    """Endpoint-referenced schemas: customers with the highest balances and some parts."""
    c = table(spark, sf_dir, "customer").where(F.col("c_acctbal") > 9000).select(_node("customer", "c_custkey").alias("node"))
    p = table(spark, sf_dir, "part").where(F.col("p_size") == 1).select(_node("part", "p_partkey").alias("node"))
    return c.unionByName(p).withColumn("repo_id", F.lit(REPO))


SQL_SEEDS = """(SELECT 'customer_' || c_custkey AS node FROM customer WHERE c_acctbal > 9000
  UNION SELECT 'part_' || p_partkey FROM part WHERE p_size = 1)"""


@query("reference_closure", sql=f"""
WITH RECURSIVE r(node, depth) AS (
  SELECT node, 0 FROM {SQL_SEEDS}
  UNION SELECT e.dst, r.depth + 1 FROM r JOIN {SQL_EDGES} e ON e.src = r.node WHERE r.depth < 60)
SELECT 'tpch' AS repo_id, node, min(depth) AS depth FROM r GROUP BY node""")
def q_reference_closure(spark, sf_dir):
    """Schemas reachable from the referenced ones, with their round."""
    return G.closure(seeds(spark, sf_dir), ref_edges(spark, sf_dir))


@query("transitive_refs", sql=f"""
WITH RECURSIVE r(node) AS (SELECT lower(node) FROM {SQL_SEEDS} UNION SELECT lower(e.dst) FROM r JOIN {SQL_EDGES} e ON lower(e.src) = r.node)
SELECT 'tpch' AS repo_id, node FROM r""")
def q_transitive_refs(spark, sf_dir):
    """Unbounded closure (to the fixpoint) with case-insensitive names."""
    e = ref_edges(spark, sf_dir).select("repo_id", F.lower("src").alias("src"), F.lower("dst").alias("dst"))
    s = seeds(spark, sf_dir).select("repo_id", F.lower("node").alias("node"))
    return G.closure(s, e, max_rounds=None).select("repo_id", "node")


@query("subtype_expand", sql=f"""
WITH RECURSIVE r(node, depth) AS (
  SELECT node, 0 FROM {SQL_SEEDS}
  UNION SELECT e.dst, r.depth + 1 FROM r JOIN {SQL_EDGES} e ON e.src = r.node WHERE r.depth < 60),
v AS (SELECT DISTINCT node FROM r),
inh AS (SELECT DISTINCT 'supplier_' || l_suppkey AS parent, 'part_' || l_partkey AS child FROM lineitem WHERE (l_partkey + l_suppkey) % 5 = 0)
SELECT DISTINCT 'tpch' AS repo_id, child AS node FROM inh JOIN v ON inh.parent = v.node WHERE child NOT IN (SELECT node FROM v)""")
def q_subtype_expand(spark, sf_dir):
    """Subtypes of found schemas (inheritance children) that join the next frontier."""
    visited = G.closure(seeds(spark, sf_dir), ref_edges(spark, sf_dir))
    li = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey")
    inh = li.where((F.col("l_partkey") + F.col("l_suppkey")) % 5 == 0).select(
        F.lit(REPO).alias("repo_id"), _node("supplier", "l_suppkey").alias("node"), _node("part", "l_partkey").alias("child"))
    new = inh.join(visited.select("repo_id", "node"), ["repo_id", "node"], "left_semi").select("repo_id", F.col("child").alias("node"))
    return new.distinct().join(visited.select("repo_id", "node"), ["repo_id", "node"], "left_anti")


# --------------------------------------------------------------- type index

def source_lines(spark, sf_dir):
    """Synthetic source lines derived from ``part``: one class per part."""
    p = spread(table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size"), "p_partkey")
    name = F.replace(F.initcap("p_name"), F.lit(" "), F.lit(""))
    path = F.concat(F.lit("catalog/"), F.lower(F.replace("p_type", F.lit(" "), F.lit("/"))), F.lit("/"),
                    F.lower(F.replace("p_brand", F.lit("#"), F.lit(""))), F.lit("/"), F.lower(name), F.lit(".ts"))
    parents = F.when(F.col("p_size") % 4 == 0, F.lit("")).otherwise(
        F.concat(F.lit(" extends "), F.replace("p_brand", F.lit("#"), F.lit("")), F.lit(", "), F.initcap("p_type")))
    line = F.when(F.col("p_size") % 10 == 0, F.concat(F.lit("interface "), name, F.lit(" {"))).otherwise(
        F.concat(F.lit("export class "), name, parents, F.lit(" {")))
    return p.select(F.lit(REPO).alias("repo_id"), path.alias("path"), F.col("p_partkey").alias("line_no"), line.alias("line"))


SQL_NAME = "array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || w[2:]), '')"
SQL_LINES = f"""(SELECT 'tpch' AS repo_id,
  'catalog/' || lower(replace(p_type, ' ', '/')) || '/' || lower(replace(p_brand, '#', '')) || '/' || lower({SQL_NAME}) || '.ts' AS path,
  p_partkey AS line_no,
  CASE WHEN p_size % 10 = 0 THEN 'interface ' || {SQL_NAME} || ' {{'
       ELSE 'export class ' || {SQL_NAME} || CASE WHEN p_size % 4 = 0 THEN '' ELSE ' extends ' || replace(p_brand, '#', '')
            || ', ' || upper(substr(lower(p_type), 1, 1)) || substr(lower(p_type), 2) END || ' {{' END AS line FROM part)"""

# Fixed values of this binding: definition rules (name in group 1, parents in group 2).
TYPEDEF_RULES = [
    (0, r"^export class ([A-Za-z0-9_]+)(?: extends ([A-Za-z0-9_, ]+))? \{", "class"),
    (1, r"^interface ([A-Za-z0-9_]+)() \{", "interface"),
]


def type_defs(spark, sf_dir):
    return G.typedef_scan(source_lines(spark, sf_dir), TYPEDEF_RULES)


SQL_DEFS = f"""(SELECT repo_id, CASE WHEN starts_with(line, 'interface') THEN regexp_extract(line, '^interface ([A-Za-z0-9_]+)', 1)
   ELSE regexp_extract(line, '^export class ([A-Za-z0-9_]+)', 1) END AS name, path, line_no AS line,
   CASE WHEN starts_with(line, 'interface') THEN 'interface' ELSE 'class' END AS kind,
   CASE WHEN starts_with(line, 'interface') THEN '' ELSE regexp_extract(line, '^export class [A-Za-z0-9_]+(?: extends ([A-Za-z0-9_, ]+))? \\{{', 1) END AS inherits
 FROM {SQL_LINES})"""


@query("type_def_index", sql=f"SELECT * FROM {SQL_DEFS}")
def q_type_def_index(spark, sf_dir):
    """G1: class / interface definitions found by rule regexes over source lines."""
    return type_defs(spark, sf_dir)


@query("inheritance_edges", sql=f"""
SELECT repo_id, trim(p) AS parent, count(*) AS n_children FROM (SELECT repo_id, unnest(string_split(inherits, ',')) AS p FROM {SQL_DEFS})
WHERE trim(p) <> '' GROUP BY 1, 2""")
def q_inheritance_edges(spark, sf_dir):
    """Parent -> child edges, counted per parent."""
    e = G.inheritance_edges(type_defs(spark, sf_dir))
    return e.groupBy("repo_id", "parent").agg(F.count(F.lit(1)).alias("n_children"))


@query("name_collision", sql=f"SELECT repo_id, name, count(DISTINCT path) AS n_files FROM {SQL_DEFS} GROUP BY 1, 2 HAVING count(DISTINCT path) > 1")
def q_name_collision(spark, sf_dir):
    """Class names defined in more than one file."""
    return G.name_collision(type_defs(spark, sf_dir))


SQL_QUALIFIED = f"""
WITH d AS (SELECT DISTINCT repo_id, name, path FROM {SQL_DEFS}
           WHERE name IN (SELECT name FROM {SQL_DEFS} GROUP BY repo_id, name HAVING count(DISTINCT path) > 1)),
x AS (SELECT repo_id, name, path, unnest(list_reverse(string_split(path, '/')[1:-2])) AS comp,
             generate_subscripts(list_reverse(string_split(path, '/')[1:-2]), 1) AS depth FROM d),
n AS (SELECT repo_id, name, count(*) AS n_files FROM d GROUP BY 1, 2),
per AS (SELECT repo_id, name, depth FROM x JOIN n USING (repo_id, name) WHERE depth <= 12 GROUP BY repo_id, name, depth, n.n_files
        HAVING count(DISTINCT comp) = n.n_files AND count(*) = n.n_files),
best AS (SELECT repo_id, name, min(depth) AS depth FROM per GROUP BY 1, 2)
SELECT d.repo_id, d.name, d.path, best.depth,
       CASE WHEN x.comp IS NOT NULL THEN x.comp || '_' || d.name ELSE replace(regexp_replace(d.path, '\\.[^./]*$', ''), '/', '_') END AS qualified
FROM d LEFT JOIN best USING (repo_id, name) LEFT JOIN x ON x.repo_id = d.repo_id AND x.name = d.name AND x.path = d.path AND x.depth = best.depth"""


@query("qualified_names", sql=SQL_QUALIFIED)
def q_qualified_names(spark, sf_dir):
    """Colliding names qualified by the first directory level that tells their files apart."""
    return G.qualified_names(type_defs(spark, sf_dir))


def refs(spark, sf_dir):
    """References to resolve: one per part, with an import fragment naming its type directory."""
    p = spread(table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type"), "p_partkey")
    name = F.replace(F.initcap("p_name"), F.lit(" "), F.lit(""))
    frag = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("catalog/"), F.lower(F.replace("p_type", F.lit(" "), F.lit("/")))))
    return p.select(F.lit(REPO).alias("repo_id"), F.col("p_partkey").alias("ref_id"), name.alias("name"), frag.alias("fragment"))


SQL_RESOLVE_INDEXED = f"""
WITH r AS (SELECT 'tpch' AS repo_id, p_partkey AS ref_id, {SQL_NAME} AS name,
                  CASE WHEN p_partkey % 3 = 0 THEN 'catalog/' || lower(replace(p_type, ' ', '/')) END AS fragment FROM part),
c AS (SELECT r.*, d.path, d.line, lower(regexp_extract(d.path, '([^/]*?)(\\.[^./]*)?$', 1)) AS stem FROM r JOIN {SQL_DEFS} d USING (repo_id, name)),
s AS (SELECT *, CASE WHEN fragment IS NOT NULL AND fragment <> '' AND contains(path, fragment) THEN 0 ELSE 1 END AS tier,
             CASE WHEN stem = lower(name) THEN 2 WHEN contains(stem, lower(name)) THEN 1 ELSE 0 END AS score FROM c)
SELECT repo_id, ref_id, name, arg_min(path, (tier, -score, path, line)) AS path, arg_min(line, (tier, -score, path, line)) AS line,
       count(*) AS n_candidates,
       CASE WHEN count(*) = 1 THEN 'single' WHEN arg_min(tier, (tier, -score, path, line)) = 0 THEN 'import' ELSE 'stem' END AS how
FROM s GROUP BY 1, 2, 3"""


@query("resolve_indexed", sql=SQL_RESOLVE_INDEXED)
def q_resolve_indexed(spark, sf_dir):
    """Each reference resolved to one definition (import fragment, then stem score, then order)."""
    return G.resolve_indexed(refs(spark, sf_dir), type_defs(spark, sf_dir))


@query("case_alias", sql=f"""
WITH rq AS (SELECT DISTINCT 'tpch' AS repo_id, CASE WHEN p_partkey % 2 = 0 THEN upper({SQL_NAME}) ELSE {SQL_NAME} END AS requested FROM part),
ex AS (SELECT DISTINCT repo_id, name AS schema FROM {SQL_DEFS})
SELECT rq.repo_id, rq.requested, min(ex.schema) AS schema FROM rq JOIN ex ON rq.repo_id = ex.repo_id AND lower(rq.requested) = lower(ex.schema)
WHERE rq.requested <> ex.schema AND rq.requested NOT IN (SELECT schema FROM ex) GROUP BY 1, 2""")
def q_case_alias(spark, sf_dir):
    """Requested names matching an extracted schema only case-insensitively."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    name = F.replace(F.initcap("p_name"), F.lit(" "), F.lit(""))
    rq = p.select(F.lit(REPO).alias("repo_id"), F.when(F.col("p_partkey") % 2 == 0, F.upper(name)).otherwise(name).alias("name")).distinct()
    return G.case_alias(rq, type_defs(spark, sf_dir).select("repo_id", "name").distinct())


@query("schema_refs", sql=SQL_BUILD + """
SELECT hint_id, unnest(regexp_extract_all(schema_json, '"\\$ref"\\s*:\\s*"#/components/schemas/([^"]+)"', 1)) AS target FROM b""")
def q_schema_refs(spark, sf_dir):
    """Every ``$ref`` target inside the built schemas."""
    h = part_hints(spark, sf_dir).select("hint_id", build_ref(F.col("hint")).alias("schema_json"))
    return h.select("hint_id", F.explode(G.schema_refs(F.col("schema_json"))).alias("target"))


SQL_PROPS = """(SELECT 'customer_' || c_custkey AS node, lower(c_mktsegment) AS prop FROM customer
  UNION ALL SELECT 'nation_' || n_nationkey, lower(n_name) FROM nation
  UNION ALL SELECT 'region_' || r_regionkey, lower(r_name) FROM region
  UNION ALL SELECT 'supplier_' || s_suppkey, 'supplier' FROM supplier)"""


@query("property_closure", sql=f"""
WITH RECURSIVE e AS (SELECT src, dst FROM {SQL_EDGES} WHERE NOT starts_with(src, 'part_') AND NOT starts_with(dst, 'part_')),
r(root, node) AS (SELECT node, node FROM (SELECT DISTINCT node FROM {SQL_PROPS}) UNION SELECT r.root, e.dst FROM r JOIN e ON e.src = r.node)
SELECT root AS node, count(DISTINCT p.prop) AS n_props, array_to_string(list_sort(list(DISTINCT p.prop)), ',') AS props
FROM r JOIN {SQL_PROPS} p ON p.node = r.node GROUP BY root""")
def q_property_closure(spark, sf_dir):
    """M4: property names of a schema including those of its allOf parents, transitively."""
    e = ref_edges(spark, sf_dir).where(~F.col("src").startswith("part_") & ~F.col("dst").startswith("part_"))
    props = (table(spark, sf_dir, "customer").select(_node("customer", "c_custkey").alias("node"), F.lower("c_mktsegment").alias("prop"))
             .unionByName(table(spark, sf_dir, "nation").select(_node("nation", "n_nationkey").alias("node"), F.lower("n_name").alias("prop")))
             .unionByName(table(spark, sf_dir, "region").select(_node("region", "r_regionkey").alias("node"), F.lower("r_name").alias("prop")))
             .unionByName(table(spark, sf_dir, "supplier").select(_node("supplier", "s_suppkey").alias("node"), F.lit("supplier").alias("prop"))))
    out = G.property_closure(props.withColumn("repo_id", F.lit(REPO)), e)
    return out.select("node", "n_props", F.array_join("props", ",").alias("props"))


def schema_set(spark, sf_dir):
    """Schemas that exist: every node of the graph except parts with an even key."""
    e = ref_edges(spark, sf_dir)
    nodes = e.select("repo_id", F.col("src").alias("name")).unionByName(e.select("repo_id", F.col("dst").alias("name"))).distinct()
    return nodes.where(~(F.col("name").startswith("part_") & (F.regexp_extract("name", "([0-9]+)$", 1).cast("long") % 2 == 0)))


SQL_SCHEMAS = f"""(SELECT DISTINCT repo_id, name FROM (SELECT repo_id, src AS name FROM {SQL_EDGES} UNION ALL SELECT repo_id, dst FROM {SQL_EDGES})
  WHERE NOT (starts_with(name, 'part_') AND CAST(regexp_extract(name, '([0-9]+)$', 1) AS BIGINT) % 2 = 0))"""


@query("fix_dangling_refs", sql=f"""
SELECT DISTINCT 'tpch' AS repo_id, 'part_' || l_partkey AS name FROM lineitem WHERE l_partkey % 2 = 0 AND l_linenumber = 1
  AND 'part_' || l_partkey NOT IN (SELECT name FROM {SQL_SCHEMAS})""")
def q_fix_dangling_refs(spark, sf_dir):
    """refs under paths (first line items) to schemas that do not exist get a stub."""
    li = table(spark, sf_dir, "lineitem").where((F.col("l_partkey") % 2 == 0) & (F.col("l_linenumber") == 1))
    path_refs = li.select(F.lit(REPO).alias("repo_id"), _node("part", "l_partkey").alias("dst"))
    return G.dangling_refs(path_refs, schema_set(spark, sf_dir))


@query("remove_unused_schemas", sql=f"""
SELECT s.repo_id, s.name FROM {SQL_SCHEMAS} s WHERE s.name IN (SELECT dst FROM {SQL_EDGES})
  OR s.name IN (SELECT 'customer_' || o_custkey FROM orders)""")
def q_remove_unused_schemas(spark, sf_dir):
    """schemas kept because a path (orders -> customer) or any schema references them."""
    o = table(spark, sf_dir, "orders").select(F.lit(REPO).alias("repo_id"), _node("customer", "o_custkey").alias("dst"))
    refs_all = ref_edges(spark, sf_dir).select("repo_id", "dst").unionByName(o)
    kept, _ = G.remove_unused(schema_set(spark, sf_dir), refs_all)
    return kept


@query("schema_summary", sql=f"""
WITH s AS {SQL_SCHEMAS}, e AS {SQL_EDGES}
SELECT s.repo_id, split_part(s.name, '_', 1) AS kind, count(*) AS n_schemas,
       sum((SELECT count(*) FROM e WHERE e.src = s.name)) AS n_refs,
       count(*) FILTER (WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.src = s.name)) AS n_leaf
FROM s GROUP BY 1, 2""")
def q_schema_summary(spark, sf_dir):
    """Per schema kind: number of schemas, outgoing refs and leaf schemas."""
    s = schema_set(spark, sf_dir)
    out = ref_edges(spark, sf_dir).groupBy("repo_id", F.col("src").alias("name")).agg(F.count(F.lit(1)).alias("n_out"))
    j = s.join(out, ["repo_id", "name"], "left").fillna(0, ["n_out"])
    return j.groupBy("repo_id", F.split_part("name", F.lit("_"), F.lit(1)).alias("kind")).agg(
        F.count(F.lit(1)).alias("n_schemas"), F.sum("n_out").alias("n_refs"), F.count_if(F.col("n_out") == 0).alias("n_leaf"))


@query("break_ref_cycles")
def q_break_ref_cycles(spark, sf_dir):
    """edges cut to make the reference graph acyclic (rows-only; property-tested)."""
    return G.break_ref_cycles(ref_edges(spark, sf_dir))


# ------------------------------------------------------ registrations and scans

def registration_lines(spark, sf_dir):
    """Model registrations by call (ORM style) derived from ``part``."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type", "p_size")
    name = F.replace(F.initcap("p_name"), F.lit(" "), F.lit(""))
    path = F.concat(F.lit("models/"), F.lower(F.replace("p_type", F.lit(" "), F.lit("_"))), F.lit(".js"))
    line = (F.when(F.col("p_size") % 5 == 0, F.concat(F.lit("const "), name, F.lit("Model = mongoose.model('"), name, F.lit("', schema);")))
            .when(F.col("p_size") % 5 == 1, F.concat(F.lit("const "), name, F.lit(" = db.define('"), F.lower(name), F.lit("', {});")))
            .otherwise(F.concat(F.lit("// "), name)))
    return p.select(F.lit(REPO).alias("repo_id"), path.alias("path"), F.col("p_partkey").alias("line_no"), line.alias("line"))


# Fixed values of this binding: call-style model registration rule.
MODEL_RULES = [(0, r"^const [A-Za-z0-9_]+ = [a-z]+\.(?:model|define)\('([A-Za-z0-9_]+)'()", "model")]


@query("model_registration_index", sql=f"""
SELECT 'tpch' AS repo_id, regexp_extract(line, '^const [A-Za-z0-9_]+ = [a-z]+\\.(?:model|define)\\(''([A-Za-z0-9_]+)''', 1) AS name, path,
       line_no AS line, 'model' AS kind, '' AS inherits
FROM (SELECT 'models/' || lower(replace(p_type, ' ', '_')) || '.js' AS path, p_partkey AS line_no,
        CASE WHEN p_size % 5 = 0 THEN 'const ' || {SQL_NAME} || 'Model = mongoose.model(''' || {SQL_NAME} || ''', schema);'
             WHEN p_size % 5 = 1 THEN 'const ' || {SQL_NAME} || ' = db.define(''' || lower({SQL_NAME}) || ''', {{}});'
             ELSE '// ' || {SQL_NAME} END AS line FROM part)
WHERE regexp_matches(line, '^const [A-Za-z0-9_]+ = [a-z]+\\.(?:model|define)\\(''')""")
def q_model_registration_index(spark, sf_dir):
    """Models defined by registration calls, found by an extra rule of the type index."""
    return G.typedef_scan(registration_lines(spark, sf_dir), MODEL_RULES)


def brand_lines(spark, sf_dir):
    """Constants files defining each brand (``BrandN = ...``), plus import lines that must not count."""
    p = table(spark, sf_dir, "part").select("p_brand").distinct()
    b = F.replace(F.col("p_brand"), F.lit("#"), F.lit(""))
    n = F.regexp_extract("p_brand", "([0-9]+)$", 1).cast("long")
    main = p.select(F.lit(REPO).alias("repo_id"), F.lit("catalog/brands.ts").alias("path"), n.alias("line_no"),
                    F.concat(F.lit("export const "), b, F.lit(" = Object.freeze({});")).alias("line"))
    legacy = p.where(n % 2 == 0).select(F.lit(REPO).alias("repo_id"), F.lit("legacy/brands.js").alias("path"), n.alias("line_no"),
                                        F.concat(b, F.lit(" = {};")).alias("line"))
    imports = p.select(F.lit(REPO).alias("repo_id"), F.lit("app/index.ts").alias("path"), n.alias("line_no"),
                       F.concat(F.lit("import { "), b, F.lit(" } from './brands';")).alias("line"))
    return main.unionByName(legacy).unionByName(imports)


# Fixed values of this binding: definition scan rules (name in group 1).
SCAN_RULES = [(0, r"(?:class|interface|const|let|var)\s+([A-Za-z0-9_]+)"), (1, r"^([A-Za-z0-9_]+)\s*=")]


def brand_refs(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    b = F.replace(F.col("p_brand"), F.lit("#"), F.lit(""))
    frag = F.when(F.col("p_partkey") % 4 == 0, F.lit("legacy"))
    return p.select(F.lit(REPO).alias("repo_id"), F.col("p_partkey").alias("ref_id"), b.alias("name"), frag.alias("fragment"))


SQL_BRAND_LINES = """(SELECT DISTINCT 'catalog/brands.ts' AS path, CAST(regexp_extract(p_brand, '([0-9]+)$', 1) AS BIGINT) AS line_no,
     'export const ' || replace(p_brand, '#', '') || ' = Object.freeze({});' AS line FROM part
   UNION ALL SELECT DISTINCT 'legacy/brands.js', CAST(regexp_extract(p_brand, '([0-9]+)$', 1) AS BIGINT), replace(p_brand, '#', '') || ' = {};'
     FROM part WHERE CAST(regexp_extract(p_brand, '([0-9]+)$', 1) AS BIGINT) % 2 = 0)"""
SQL_SCAN = f"""(SELECT r.ref_id, r.name, arg_min(l.path, (CASE WHEN r.fragment IS NOT NULL AND contains(l.path, r.fragment) THEN 0 ELSE 1 END,
     l.path, l.line_no)) AS path, arg_min(l.line_no, (CASE WHEN r.fragment IS NOT NULL AND contains(l.path, r.fragment) THEN 0 ELSE 1 END,
     l.path, l.line_no)) AS line
 FROM (SELECT p_partkey AS ref_id, replace(p_brand, '#', '') AS name, CASE WHEN p_partkey % 4 = 0 THEN 'legacy' END AS fragment FROM part) r
 JOIN {SQL_BRAND_LINES} l ON l.line LIKE 'export const ' || r.name || ' =%' OR l.line LIKE r.name || ' =%'
 GROUP BY 1, 2)"""


@query("resolve_by_scan", sql=f"SELECT 'tpch' AS repo_id, * FROM {SQL_SCAN}")
def q_resolve_by_scan(spark, sf_dir):
    """Brand names resolved by one definition scan over source lines (import lines ignored)."""
    return G.resolve_by_scan(brand_refs(spark, sf_dir), brand_lines(spark, sf_dir), SCAN_RULES)


@query("resolve_type", sql=f"""
SELECT 'index' AS how, count(*) AS n_refs, count(DISTINCT path) AS n_files FROM ({SQL_RESOLVE_INDEXED})
UNION ALL SELECT 'scan', count(*), count(DISTINCT path) FROM {SQL_SCAN}""")
def q_resolve_type(spark, sf_dir):
    """Part names resolve through the index; brand names, which the index lacks, through the line scan."""
    rules = SCAN_RULES
    brands = brand_refs(spark, sf_dir).withColumn("ref_id", F.col("ref_id") + 10_000_000_000)
    r = G.resolve_type(refs(spark, sf_dir).unionByName(brands), type_defs(spark, sf_dir), brand_lines(spark, sf_dir), rules)
    return r.groupBy("how").agg(F.count(F.lit(1)).alias("n_refs"), F.count_distinct("path").alias("n_files"))


@query("dotted_alias", sql=f"""
WITH r AS (SELECT p_partkey AS ref_id, CASE WHEN p_partkey % 2 = 0 THEN {SQL_NAME} ELSE replace(p_brand, '#', '') END AS outr,
                  {SQL_NAME} AS leaf, CASE WHEN p_partkey % 3 = 0 THEN 'catalog/' || lower(replace(p_type, ' ', '/')) END AS fragment FROM part),
d AS (SELECT *, CASE WHEN kind = 'class' THEN 'catalog.' || regexp_extract(path, '/(brand[0-9]+)/', 1) END AS scope,
             regexp_extract(path, '([^/]*)\\.ts$', 1) AS stem FROM {SQL_DEFS}),
c AS (SELECT r.*, d.path, d.line, coalesce(contains(d.path, r.fragment), false) AS imported,
             CASE WHEN d.scope LIKE '%' || lower(r.outr) THEN 0 WHEN d.stem = lower(r.outr) THEN 1 END AS level
      FROM r JOIN d ON d.name = r.leaf),
pick AS (SELECT *, row_number() OVER (PARTITION BY ref_id ORDER BY level, CASE WHEN level = 0 AND imported THEN 0 ELSE 1 END, path, line) AS k
         FROM c WHERE level IS NOT NULL)
SELECT ref_id, lower(outr) || '.' || leaf AS dotted, leaf, path FROM pick WHERE k = 1""")
def q_dotted_alias(spark, sf_dir):
    """``outer.Name`` requests (outer: the brand, or the lower-case name itself) alias the leaf schema they
    resolve to. Classes have their brand directory as scope; interfaces have none and are found by file name only."""
    brand = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("ref_id"), F.replace(F.lower("p_brand"), F.lit("#"), F.lit("")).alias("brand"))
    r = refs(spark, sf_dir).join(brand, "ref_id")
    outer = F.when(F.col("ref_id") % 2 == 0, F.lower("name")).otherwise(F.col("brand"))
    r = r.withColumn("name", F.concat_ws(".", outer, "name")).drop("brand")
    d = type_defs(spark, sf_dir)
    d = d.withColumn("scope", F.when(F.col("kind") == "class", F.concat(F.lit("catalog."), F.regexp_extract("path", "/(brand[0-9]+)/", 1))))
    return G.dotted_alias(G.resolve_indexed(r, d))


@query("ref_rewrite", sql=f"""
WITH r AS ({SQL_RESOLVE_INDEXED}), q AS ({SQL_QUALIFIED})
SELECT r.ref_id, r.name, coalesce(q.qualified, r.name) AS rewritten FROM r LEFT JOIN q ON q.name = r.name AND q.path = r.path""")
def q_ref_rewrite(spark, sf_dir):
    """A reference is rewritten to the qualified name of the file it resolved to."""
    d = type_defs(spark, sf_dir)
    r = G.resolve_indexed(refs(spark, sf_dir), d)
    q = G.qualified_names(d).select("repo_id", "name", "path", "qualified")
    return r.join(q, ["repo_id", "name", "path"], "left").select("ref_id", "name", F.coalesce("qualified", "name").alias("rewritten"))


def part_props(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type", "p_size", "p_retailprice")
    schema = F.concat(F.lit("Part"), F.col("p_partkey").cast("string"))
    brand = F.replace(F.col("p_brand"), F.lit("#"), F.lit(""))
    empty = F.array().cast("array<string>")

    def row(o, name, typ, fmt, ref, arr, nullable, enum, cons):
        return F.struct(F.lit(o).alias("prop_ord"), F.lit(name).alias("name"), F.lit(typ).alias("type"), F.lit(fmt).alias("format"),
                        ref.alias("ref"), arr.alias("is_array"), nullable.alias("nullable"), enum.alias("enum_values"), cons.alias("constraints_json"))
    props = F.array(
        row(0, "size", "integer", "int32", F.lit(""), F.lit(False), F.lit(False), empty,
            F.when(F.col("p_size") > 25, F.lit('{"minimum":1}')).otherwise(F.lit("{}"))),
        row(1, "price", "number", "double", F.lit(""), F.lit(False), F.col("p_retailprice") > 1500, empty, F.lit("{}")),
        row(2, "brand", "object", "", brand, F.col("p_size") % 2 == 0, F.lit(False), empty, F.lit("{}")),
        row(3, "kind", "string", "", F.lit(""), F.lit(False), F.lit(False), F.split(F.lower("p_type"), " "), F.lit("{}")))
    repo = F.lower(brand).alias("repo_id")
    pr = p.select(repo, schema.alias("schema"), F.explode(props).alias("x")).select("repo_id", "schema", "x.*")
    sc = p.select(repo, schema.alias("schema"),
                  F.when(F.col("p_size") % 3 == 0, F.array(F.lit("size"))).otherwise(empty).alias("required"),
                  F.when(F.col("p_size") % 4 != 0, brand).otherwise(F.lit("")).alias("parent_ref"))
    return pr, sc


@query("props_to_json_schema", sql="""
WITH p AS (SELECT 'Part' || CAST(p_partkey AS VARCHAR) AS schema, p_size, p_retailprice, replace(p_brand, '#', '') AS brand,
                  lower(p_type) AS t FROM part),
o AS (SELECT schema, '{"type":"object","properties":{'
       || '"size":{"type":"integer","format":"int32"' || CASE WHEN p_size > 25 THEN ',"minimum":1' ELSE '' END || '}'
       || ',"price":{"type":"number","format":"double"' || CASE WHEN p_retailprice > 1500 THEN ',"nullable":true' ELSE '' END || '}'
       || ',"brand":' || CASE WHEN p_size % 2 = 0 THEN '{"type":"array","items":{"$ref":"#/components/schemas/' || brand || '"}}'
                              ELSE '{"$ref":"#/components/schemas/' || brand || '"}' END
       || ',"kind":{"type":"string","enum":' || CAST(to_json(string_split(t, ' ')) AS VARCHAR) || '}'
       || '}' || CASE WHEN p_size % 3 = 0 THEN ',"required":["size"]' ELSE '' END || '}' AS obj, p_size, brand FROM p)
SELECT lower(brand) AS repo_id, schema, CASE WHEN p_size % 4 <> 0 THEN '{"allOf":[{"$ref":"#/components/schemas/' || brand || '"},' || obj || ']}' ELSE obj END AS schema_json FROM o""")
def q_props_to_json_schema(spark, sf_dir):
    """Property rows assembled into JSON Schema (ref / enum / type+format, arrays,
    nullable, constraints last, required list, parent -> allOf)."""
    pr, sc = part_props(spark, sf_dir)
    return G.props_to_json_schema(pr, sc)
