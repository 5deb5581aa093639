"""Type-hint bindings (T1-T9) on ``part``.

Every part yields one hint string whose shape cycles with ``p_partkey``
(collections, arrays, map wrappers, Optional, unions, stale ``$ref`` prefixes,
bare comma lists); names are the PascalCase part name and brand.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from routelens.functions import hints as T
from routelens.plans.catalog import query
from routelens.session import spread
from routelens.sources.tables import table

SHAPES = 12


def part_hints(spark, sf_dir):
    p = spread(table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_size"), "p_partkey")
    name = F.replace(F.initcap("p_name"), F.lit(" "), F.lit(""))
    brand = F.replace(F.col("p_brand"), F.lit("#"), F.lit(""))
    k = F.col("p_partkey") % SHAPES
    shapes = [
        F.concat(F.lit("List<"), name, F.lit(">")),
        F.concat(name, F.lit("[]")),
        F.concat(F.lit("[]"), name),
        F.concat(name, F.lit(" list")),
        F.concat(F.lit("Optional["), name, F.lit("]")),
        F.concat(F.lit("Map<String, "), name, F.lit(">")),
        F.concat(F.lit("Task<List<"), name, F.lit(">>")),
        F.concat(F.lit(T.REF_PREFIX + T.REF_PREFIX), name),
        F.concat(F.lit("Union["), name, F.lit(", "), brand, F.lit("]")),
        F.concat(name, F.lit(", "), brand),
        F.concat(F.lit("Dict[str, "), name, F.lit("]")),
        F.concat(F.lit("Union[List["), name, F.lit("], Map<String, "), brand, F.lit(">, int]")),
    ]
    hint = F.element_at(F.array(*shapes), (k + 1).cast("int"))
    return p.select(F.col("p_partkey").alias("hint_id"), hint.alias("hint"),
                    (F.col("p_size") % 5 == 0).alias("is_array"), (F.col("p_size") % 3 == 0).alias("is_nullable"))


SQL_NAME = "array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || w[2:]), '')"
SQL_BRAND = "replace(p_brand, '#', '')"
SQL_HINTS = f"""(SELECT p_partkey AS hint_id, [
  'List<' || n || '>', n || '[]', '[]' || n, n || ' list', 'Optional[' || n || ']', 'Map<String, ' || n || '>',
  'Task<List<' || n || '>>', '{T.REF_PREFIX}{T.REF_PREFIX}' || n, 'Union[' || n || ', ' || b || ']', n || ', ' || b,
  'Dict[str, ' || n || ']', 'Union[List[' || n || '], Map<String, ' || b || '>, int]'][(p_partkey % {SHAPES}) + 1] AS hint,
  p_size % 5 = 0 AS is_array, p_size % 3 = 0 AS is_nullable
 FROM (SELECT p_partkey, p_size, {SQL_NAME} AS n, {SQL_BRAND} AS b FROM part))"""


def sql_strip(x):
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def sql_sanitize(x):
    return sql_strip(f"regexp_replace({x}, '^(#/components/schemas/)+', '')")


def _inlist(vals):
    return "(" + ", ".join("'" + v + "'" for v in vals) + ")"


GEN = r"^([A-Za-z0-9_]+)\s*[\[<](.+)[\]>]$"


def sql_hint_parse(x):
    """(is_array, inner) SQL expressions for T2 over column expression ``x``."""
    n0 = sql_sanitize(x)
    n = (rf"(CASE WHEN regexp_matches({n0}, '^Optional\[(.+)\]$') THEN "
         rf"{sql_strip(chr(39).join(['regexp_extract(' + n0 + ', ', r'^Optional\[(.+)\]$', ', 1)']))} ELSE {n0} END)")
    w = f"regexp_extract({n}, '{GEN}', 1)"
    gi = sql_strip(f"regexp_extract({n}, '{GEN}', 2)")
    head = sql_strip(f"regexp_extract({n}, '^(.*) ([^ ]*)$', 1)")
    tail = f"lower(regexp_extract({n}, '^(.*) ([^ ]*)$', 2))"
    first = sql_strip(f"string_split({n}, ',')[1]")
    gm = f"regexp_matches({n}, '{GEN}')"
    conds = [
        (rf"regexp_matches({n}, '^\[\].+$')", "true", sql_strip(f"substr({n}, 3)")),
        (rf"regexp_matches({n}, '^.+\[\]$')", "true", sql_strip(rf"regexp_replace({n}, '\[\]$', '')")),
        (f"{gm} AND {w} IN {_inlist(T.MAP_WRAPPERS)}", "false", "''"),
        (f"{gm} AND {w} IN {_inlist(T.COLLECTION_WRAPPERS)}", "true", gi),
        (gm, "false", gi),
        (f"contains({n}, ' ') AND {tail} IN {_inlist(T.SPACE_COLLECTION_SUFFIXES)}", "true", head),
        (f"contains({n}, ',') AND NOT contains({n}, '[') AND NOT contains({n}, '<')", "false",
         f"(CASE WHEN {first} <> '' THEN {first} ELSE {n} END)"),
    ]
    arr = "CASE " + " ".join(f"WHEN {c} THEN {a}" for c, a, _ in conds) + " ELSE false END"
    inner = "CASE " + " ".join(f"WHEN {c} THEN {i}" for c, _, i in conds) + f" ELSE {n} END"
    return arr, inner


def sql_depth_split(src: str, key: str, text: str) -> str:
    """CTE body: ``(key, idx, part)`` rows of the depth-aware comma split of ``text``."""
    return f"""
ch AS (SELECT {key} AS k, unnest(string_split({text}, '')) AS c, generate_subscripts(string_split({text}, ''), 1) AS i FROM {src}),
dp AS (SELECT *, sum(CASE WHEN c IN ('[', '<') THEN 1 WHEN c IN (']', '>') THEN -1 ELSE 0 END) OVER (PARTITION BY k ORDER BY i) AS d FROM ch),
gp AS (SELECT *, c = ',' AND d = 0 AS cut, sum(CASE WHEN c = ',' AND d = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY k ORDER BY i) AS g FROM dp),
pt AS (SELECT k, g, {sql_strip("coalesce(string_agg(c, '' ORDER BY i) FILTER (WHERE NOT cut), '')")} AS part FROM gp GROUP BY k, g),
mx AS (SELECT k, max(g) AS mg FROM pt GROUP BY k),
sp AS (SELECT pt.k, pt.g, pt.part FROM pt JOIN mx USING (k) WHERE pt.g < mx.mg OR pt.part <> '')"""


@query("hint_sanitize", sql=f"SELECT hint_id, {sql_sanitize('hint')} AS sanitized FROM {SQL_HINTS}")
def q_hint_sanitize(spark, sf_dir):
    """Stale ``#/components/schemas/`` prefixes removed."""
    return part_hints(spark, sf_dir).select("hint_id", T.hint_sanitize("hint").alias("sanitized"))


_ARR, _INNER = sql_hint_parse("hint")


@query("hint_parse", sql=f"SELECT hint_id, hint, {_ARR} AS is_array, {_INNER} AS inner FROM {SQL_HINTS}")
def q_hint_parse(spark, sf_dir):
    """(is_array, inner) for every hint shape."""
    h = part_hints(spark, sf_dir)
    p = T.hint_parse(F.col("hint"))
    return h.select("hint_id", "hint", p["is_array"].alias("is_array"), p["inner"].alias("inner"))


@query("generic_args_split", sql=f"""
WITH g AS (SELECT hint_id, regexp_extract(hint, '{GEN}', 2) AS args FROM {SQL_HINTS} WHERE regexp_matches(hint, '{GEN}')),
{sql_depth_split('g', 'hint_id', 'args').strip()}
SELECT g.hint_id, coalesce(array_to_string(list(sp.part ORDER BY sp.g), '|'), '') AS parts, count(sp.part) AS n_parts
FROM g LEFT JOIN sp ON sp.k = g.hint_id GROUP BY g.hint_id""")
def q_generic_args_split(spark, sf_dir):
    """T4: bracket-aware split of generic arguments."""
    h = part_hints(spark, sf_dir).where(F.col("hint").rlike(GEN))
    parts = T.depth_split(F.regexp_extract("hint", GEN, 2))
    return h.select("hint_id", F.array_join(parts, "|").alias("parts"), F.size(parts).alias("n_parts"))


@query("union_split", sql=f"""
WITH u AS (SELECT hint_id, regexp_extract({sql_sanitize('hint')}, '^Union\\[(.+)\\]$', 1) AS args FROM {SQL_HINTS}
           WHERE regexp_matches({sql_sanitize('hint')}, '^Union\\[(.+)\\]$')),
{sql_depth_split('u', 'hint_id', 'args').strip()}
SELECT u.hint_id, coalesce(array_to_string(list(sp.part ORDER BY sp.g) FILTER (WHERE sp.part <> ''), '|'), '') AS parts
FROM u LEFT JOIN sp ON sp.k = u.hint_id GROUP BY u.hint_id""")
def q_union_split(spark, sf_dir):
    """Union members, depth-aware (``Map<String, B>`` stays whole)."""
    h = part_hints(spark, sf_dir)
    parts = T.union_split(F.col("hint"))
    return h.where(parts.isNotNull()).select("hint_id", F.array_join(parts, "|").alias("parts"))


@query("hint_decompose")
def q_hint_decompose(spark, sf_dir):
    """T5: resolvable type names per hint (rows-only; worked cases in tests)."""
    d = T.hint_decompose(part_hints(spark, sf_dir))
    return d.select(F.col("id").alias("hint_id"), F.array_join(F.col("path").cast("array<string>"), ".").alias("path"), "name")


def _sql_plain_ref(x):
    a, i = sql_hint_parse(x)
    ref = f"""'{{"$ref":' || to_json('{T.REF_PREFIX}' || ({i})) || '}}'"""
    return (f"(CASE WHEN ({i}) = '' THEN '{T.UNRESOLVED_PLACEHOLDER}' WHEN {a} THEN "
            f"""'{{"type":"array","items":' || {ref} || '}}' ELSE {ref} END)""")


SQL_BUILD = f"""
WITH h AS {SQL_HINTS},
u AS (SELECT hint_id, regexp_extract({sql_sanitize('hint')}, '^Union\\[(.+)\\]$', 1) AS args FROM h
      WHERE regexp_matches({sql_sanitize('hint')}, '^Union\\[(.+)\\]$')),
{sql_depth_split('u', 'hint_id', 'args').strip()},
one AS (SELECT k AS hint_id, '{{"oneOf":[' || string_agg({_sql_plain_ref('part')}, ',' ORDER BY g) || ']}}' AS j
        FROM sp WHERE part <> '' GROUP BY k),
b AS (SELECT h.hint_id, h.is_array, h.is_nullable, coalesce(one.j, {_sql_plain_ref('h.hint')}) AS schema_json
      FROM h LEFT JOIN one USING (hint_id))"""


@query("build_ref", sql=SQL_BUILD + " SELECT hint_id, schema_json FROM b")
def q_build_ref(spark, sf_dir):
    """``$ref`` / array / ``oneOf`` / placeholder JSON per hint."""
    return part_hints(spark, sf_dir).select("hint_id", T.build_ref(F.col("hint")).alias("schema_json"))


@query("build_schema_for_ref", sql=SQL_BUILD + """,
a AS (SELECT *, CASE WHEN is_array THEN '{"type":"array","items":' || schema_json || '}' ELSE schema_json END AS arr FROM b)
SELECT hint_id, CASE WHEN is_nullable THEN (CASE WHEN starts_with(arr, '{"$ref":') THEN '{"allOf":[' || arr || '],"nullable":true}'
  ELSE regexp_replace(arr, '\\}$', '') || CASE WHEN arr = '{}' THEN '' ELSE ',' END || '"nullable":true}' END)
  WHEN is_array THEN arr ELSE schema_json END AS schema_json FROM a""")
def q_build_schema_for_ref(spark, sf_dir):
    """Structured array / nullable flags applied over T6 (nullable ``$ref`` -> ``allOf``)."""
    h = part_hints(spark, sf_dir)
    return T.with_schema_for_ref(h, "hint", "is_array", "is_nullable", "schema_json").select("hint_id", "schema_json")


_PRIM_VALUES = ", ".join(f"('{k}', '{v}')" for k, v in sorted(T.PRIMITIVE_TYPES.items()))
# candidate names: every hint's inner name plus a primitive word chosen by size
PRIM_WORDS = ("String", "int", "Long", "uuid", "DateTime", "str, Any", "Double", "IActionResult", "Widget", "bool, int")


@query("primitive_map", sql=f"""
WITH m AS (SELECT * FROM (VALUES {_PRIM_VALUES}) t(type_key, schema_json)),
n AS (SELECT p_partkey, {_inlist(PRIM_WORDS).replace('(', '[', 1)[:-1]}][(p_size % {len(PRIM_WORDS)}) + 1] AS name FROM part)
SELECT p_partkey, name, coalesce((SELECT schema_json FROM m WHERE m.type_key = lower(n.name)),
  CASE WHEN contains(name, ', ') AND list_bool_and(list_transform(string_split(name, ','),
       lambda q: lower({sql_strip('q')}) IN {_inlist(sorted(T.PRIMITIVE_TYPES))})) THEN '{T.OPAQUE}' END) AS schema_json FROM n""")
def q_primitive_map(spark, sf_dir):
    """Primitive names inlined (case-insensitive); comma lists of primitives become objects."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_size")
    words = F.array(*[F.lit(w) for w in PRIM_WORDS])
    n = p.select("p_partkey", F.element_at(words, (F.col("p_size") % len(PRIM_WORDS) + 1).cast("int")).alias("name"))
    return n.select("p_partkey", "name", T.primitive_schema(F.col("name")).alias("schema_json"))


SQL_IMPORTS = """(SELECT p_partkey, lower(replace(p_type, ' ', '')) AS t, {n} AS n, [
   'from app.' || lower(replace(p_type, ' ', '')) || '.models import ' || {n},
   'import {{ ' || {n} || ' }} from ''../models/' || lower(replace(p_type, ' ', '')) || '''',
   'const ' || {n} || ' = require(''./lib/' || lower(replace(p_type, ' ', '')) || ''')',
   'using App.' || replace(p_type, ' ', '') || '.Models;',
   'use App\\Models\\' || {n} || ';',
   'use crate::models::' || lower(replace(p_type, ' ', '')) || ';',
   'import "github.com/shop/' || lower(replace(p_type, ' ', '')) || '"',
   'import com.shop.' || lower(replace(p_type, ' ', '')) || '.' || {n} || ';',
   'Shop.' || replace(p_type, ' ', '') || '.' || {n},
   'no import here'][(p_partkey % 10) + 1] AS stmt FROM part)""".format(n=SQL_NAME)


def part_imports(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type")
    n = F.replace(F.initcap("p_name"), F.lit(" "), F.lit(""))
    t = F.lower(F.replace(F.col("p_type"), F.lit(" "), F.lit("")))
    tt = F.replace(F.col("p_type"), F.lit(" "), F.lit(""))
    forms = [
        F.concat(F.lit("from app."), t, F.lit(".models import "), n),
        F.concat(F.lit("import { "), n, F.lit(" } from '../models/"), t, F.lit("'")),
        F.concat(F.lit("const "), n, F.lit(" = require('./lib/"), t, F.lit("')")),
        F.concat(F.lit("using App."), tt, F.lit(".Models;")),
        F.concat(F.lit("use App\\Models\\"), n, F.lit(";")),
        F.concat(F.lit("use crate::models::"), t, F.lit(";")),
        F.concat(F.lit('import "github.com/shop/'), t, F.lit('"')),
        F.concat(F.lit("import com.shop."), t, F.lit("."), n, F.lit(";")),
        F.concat(F.lit("Shop."), tt, F.lit("."), n),
        F.lit("no import here"),
    ]
    return p.select("p_partkey", F.element_at(F.array(*forms), (F.col("p_partkey") % 10 + 1).cast("int")).alias("stmt"))


def _lit(rx: str) -> str:
    return "'" + rx.replace("'", "''") + "'"


def sql_import_fragment(s):
    """Twin of T9: one CASE over the grammar rows, on the words of the statement."""
    word = lambda n: f"coalesce(string_split_regex(trim({s}), '\\s+')[{n}], '')"
    rows = []
    for first, also, place, letters, separator in T.IMPORT_GRAMMAR:
        module = f"regexp_replace(regexp_extract({word(place)}, {_lit(f'^{letters}+')}), {_lit(T.OWN_ROOTS)}, '')"
        fits = f"{word(1)} = '{first}' AND {module} <> ''" + (f" AND regexp_matches(trim({s}), {_lit(also)})" if also else "")
        rows.append(f"WHEN {fits} THEN replace({module}, {_lit(separator)}, '/')")
    dotted = f"WHEN regexp_matches(trim({s}), {_lit(r'^[A-Za-z0-9_]+([.][A-Za-z0-9_]+)+$')}) THEN replace(trim({s}), '.', '/')"
    quoted = f"regexp_replace(nullif(regexp_extract({s}, {_lit(T.QUOTED_MODULE)}, 1), ''), {_lit(T.OWN_ROOTS)}, '')"
    return f"coalesce({quoted}, CASE {' '.join(rows)} {dotted} END)"


@query("import_fragment", sql=f"SELECT p_partkey, stmt, {sql_import_fragment('stmt')} AS fragment FROM {SQL_IMPORTS}")
def q_import_fragment(spark, sf_dir):
    """Path fragment of import statements in eight syntaxes (NULL when none applies)."""
    return part_imports(spark, sf_dir).select("p_partkey", "stmt", T.import_fragment(F.col("stmt")).alias("fragment"))
