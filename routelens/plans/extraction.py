"""Extraction bindings.

* Sketches, batch extraction, quarantine, context documents and coverage run on
  ``pages`` (links are the endpoints).
* Mount resolution, re-extraction merge and registry exclusion run on ``part``:
  each ``p_type`` is a repository, every part has a route file
  ``src/routes/<name>_<key>.js``, and each brand has a registry file that mounts
  part names (camelCase keys, or the exact file stem) under ``/api/<name>``.
* Known-context selection and condensation run on ``documents``.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from routelens.functions.paths import path_score_key
from routelens.operators import extract as E
from routelens.plans.catalog import query
from routelens.plans.sqlbits import documents_files, pages_files
from routelens.plans.graph import SQL_LINES, source_lines
from routelens.sources.tables import documents_as_files, explode_lines, pages_as_files, table

# Fixed values of this binding: sketch rules (method, regex with path and handler groups).
SKETCH_RULES = [(0, "GET", r'<a href="(/[^"]*)">([^<]*)</a>'), (1, "POST", r"track\(([0-9]+)\)()")]


def page_files(spark, sf_dir):
    return pages_as_files(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def sketches(spark, sf_dir):
    lines = explode_lines(page_files(spark, sf_dir))
    return E.endpoint_sketch(lines, SKETCH_RULES)


SQL_PAGE_LINES = f"""(SELECT repo_id, path, file_ord, unnest(string_split(content, chr(10))) AS line,
   generate_subscripts(string_split(content, chr(10)), 1) AS line_no FROM {pages_files()})"""
SQL_SKETCH = f"""(SELECT repo_id, path AS source_file, file_ord, line_no, rule_ord, method,
   unnest(regexp_extract_all(line, regex, 1)) AS sketch_path, unnest(regexp_extract_all(line, regex, 2)) AS handler,
   generate_subscripts(regexp_extract_all(line, regex, 1), 1) - 1 AS pos
 FROM {SQL_PAGE_LINES} l JOIN (VALUES (0, 'GET', '<a href="(/[^"]*)">([^<]*)</a>'), (1, 'POST', 'track\\(([0-9]+)\\)()'))
      r(rule_ord, method, regex) ON regexp_matches(l.line, r.regex))"""


@query("endpoint_sketch", sql=f"SELECT source_file, line_no, pos, rule_ord, method, sketch_path, handler, count(*) AS n FROM {SQL_SKETCH} GROUP BY ALL")
def q_endpoint_sketch(spark, sf_dir):
    """(method, path, handler) sketches found by rule scan (per file, line and position)."""
    s = sketches(spark, sf_dir)
    return s.groupBy("source_file", "line_no", "pos", "rule_ord", "method", "sketch_path", "handler").agg(F.count(F.lit(1)).alias("n"))


def extracted(spark, sf_dir):
    return E.batch_extract(page_files(spark, sf_dir), sketches(spark, sf_dir), E.rule_extractor)


# the registered extractors as SQL: links of whole sketched pages, and pages cut off before their end
SQL_SKETCHED = f"""(SELECT repo_id, path, content, contains(coalesce(content, ''), '</html>') AS ok FROM {pages_files()} f
  WHERE EXISTS (SELECT 1 FROM {SQL_SKETCH} s WHERE s.repo_id = f.repo_id AND s.source_file = f.path))"""
SQL_LINK = """'<a href="(/[^"]*)">([^<]*)</a>'"""
SQL_LINK_PATH = r"regexp_replace(regexp_replace(p, '/[0-9]+(/|$)', '/{id}\1', 'g'), '/[0-9]+(/|$)', '/{id}\1', 'g')"


@query("batch_extract", sql=f"""
SELECT repo_id, source_file, true AS ok, CAST(i - 1 AS INTEGER) AS ep_ord, 'GET' AS method, {SQL_LINK_PATH} AS path, handler
FROM (SELECT repo_id, path AS source_file, unnest(regexp_extract_all(content, {SQL_LINK}, 1)) AS p, unnest(regexp_extract_all(content, {SQL_LINK}, 2)) AS handler,
             generate_subscripts(regexp_extract_all(content, {SQL_LINK}, 1), 1) AS i FROM {SQL_SKETCHED} WHERE ok)""")
def q_batch_extract(spark, sf_dir):
    """The pluggable extractor over every sketched page."""
    good, _ = E.failed_quarantine(extracted(spark, sf_dir))
    return good


@query("failed_quarantine", sql=f"SELECT DISTINCT repo_id, path AS source_file, 'truncated document' AS error FROM {SQL_SKETCHED} WHERE NOT ok")
def q_failed_quarantine(spark, sf_dir):
    """Files whose extraction failed, kept apart from the good rows."""
    _, bad = E.failed_quarantine(extracted(spark, sf_dir))
    return bad


def _model_file_extractor(pdf):
    import re

    import pandas as pd
    rows = []
    for repo, path, content in zip(pdf["repo_id"], pdf["path"], pdf["content"]):
        m = re.match(r"export class (\w+)(?: extends ([\w, ]+))? \{", content or "")
        if not m:
            rows.append((repo, path, False, "no class definition", None, None, None, None))
            continue
        for i, parent in enumerate([p.strip() for p in (m.group(2) or "").split(",") if p.strip()]):
            rows.append((repo, path, True, None, i, "PROP", parent.lower(), m.group(1)))
    return pd.DataFrame(rows, columns=["repo_id", "source_file", "ok", "error", "ep_ord", "method", "path", "handler"]).astype(
        {"ep_ord": "Int32"})


_CLASS = r"'^export class ([A-Za-z0-9_]+)(?: extends ([A-Za-z0-9_, ]+))? \{'"


@query("schema_extract_batch", sql=f"""
WITH l AS (SELECT *, regexp_matches(line, {_CLASS}) AS ok FROM {SQL_LINES}),
p AS (SELECT repo_id, path, regexp_extract(line, {_CLASS}, 1) AS name,
        list_filter(list_transform(string_split(regexp_extract(line, {_CLASS}, 2), ','), lambda x: trim(x)), lambda x: x <> '') AS parents FROM l WHERE ok)
SELECT repo_id, path AS source_file, false AS ok, 'no class definition' AS error, NULL::INTEGER AS ep_ord, NULL::VARCHAR AS method,
       NULL::VARCHAR AS path, NULL::VARCHAR AS handler FROM l WHERE NOT ok
UNION ALL SELECT repo_id, path, true, NULL, CAST(i - 1 AS INTEGER), 'PROP', lower(parent), name
FROM (SELECT repo_id, path, name, unnest(parents) AS parent, generate_subscripts(parents, 1) AS i FROM p)""")
def q_schema_extract_batch(spark, sf_dir):
    """The same extractor surface for model files: class definitions -> property rows."""
    src = source_lines(spark, sf_dir).select("repo_id", "path", F.col("line").alias("content"))
    sk = src.select("repo_id", F.col("path").alias("source_file"))
    return E.batch_extract(src, sk, _model_file_extractor)


@query("known_context_select", sql=f"""
WITH k AS (SELECT 'src' || CAST(item_id % 20 AS VARCHAR) AS repo_id, regexp_extract(text, '^([A-Za-z0-9_]+)', 1) AS name,
                  item_id % 3 <> 0 AS resolved FROM benchmark),
t AS (SELECT DISTINCT repo_id, path, unnest(regexp_extract_all(content, '[A-Za-z0-9_]+', 0)) AS name FROM {documents_files()})
SELECT DISTINCT t.repo_id, t.path, t.name FROM t JOIN k ON k.repo_id = t.repo_id AND k.name = t.name WHERE k.resolved""")
def q_known_context_select(spark, sf_dir):
    """Per document, the resolved known schema names of its source that it mentions as whole words."""
    d = documents_as_files(table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text"))
    # each benchmark item is a known schema of one source (item_id spread over the 20 sources)
    known = table(spark, sf_dir, "benchmark").select(
        F.concat(F.lit("src"), (F.col("item_id") % 20).cast("string")).alias("repo_id"),
        F.regexp_extract("text", "^([A-Za-z0-9_]+)", 1).alias("name"), (F.col("item_id") % 3 == 0).alias("unresolved"))
    return E.known_context_select(d, known).select("repo_id", "path", "name")


@query("effective_prefix", sql=f"""
WITH p AS (SELECT file_ord AS page_id, '/api/' AS base, CASE WHEN file_ord % 3 = 0 THEN '' ELSE '/' || lang END AS mount,
                  CASE WHEN file_ord % 2 = 0 THEN lang ELSE 'v1/' || lang END AS fp FROM {pages_files()}),
q AS (SELECT *, regexp_replace(base, '/+$', '') || CASE WHEN regexp_replace(regexp_replace(mount, '^/+', ''), '/+$', '') <> ''
             THEN '/' || regexp_replace(regexp_replace(mount, '^/+', ''), '/+$', '') ELSE '' END AS eff,
             regexp_replace(regexp_replace(fp, '^/+', ''), '/+$', '') AS f FROM p),
r AS (SELECT *, CASE WHEN regexp_replace(regexp_replace(eff, '^/+', ''), '/+$', '') <> ''
                 THEN string_split(regexp_replace(regexp_replace(eff, '^/+', ''), '/+$', ''), '/') ELSE [] END AS es,
             string_split(f, '/') AS fs FROM q)
SELECT page_id, coalesce(nullif(CASE WHEN f <> '' AND (CASE WHEN len(es) >= len(fs) THEN es[len(es) - len(fs) + 1:] ELSE es END) <> fs
       THEN eff || '/' || f ELSE eff END, ''), nullif(fp, ''), base) AS effective_prefix FROM r""")
def q_effective_prefix(spark, sf_dir):
    """E5: base + mount + file prefix, the file prefix skipped when already trailing."""
    f = page_files(spark, sf_dir).select(F.col("file_ord").alias("page_id"), "lang")
    mount = F.when(F.col("page_id") % 3 == 0, F.lit("")).otherwise(F.concat(F.lit("/"), "lang"))
    fp = F.when(F.col("page_id") % 2 == 0, F.col("lang")).otherwise(F.concat(F.lit("v1/"), "lang"))
    return f.select("page_id", E.effective_prefix(F.lit("/api/"), mount, fp).alias("effective_prefix"))


@query("scheme_name_map", sql="""
SELECT st, CASE lower(st) WHEN 'bearer' THEN 'BearerAuth' WHEN 'apikey' THEN 'ApiKeyAuth' WHEN 'cookie' THEN 'CookieAuth'
  WHEN 'basic' THEN 'BasicAuth' WHEN 'oauth2' THEN 'OAuth2' ELSE 'BearerAuth' END AS scheme_name, count(*) AS n
FROM (SELECT ['bearer', 'ApiKey', 'cookie', 'basic', 'OAuth2', 'digest'][(user_id % 6) + 1] AS st FROM events) GROUP BY 1, 2""")
def q_scheme_name_map(spark, sf_dir):
    """Scheme type -> canonical scheme name (unknown -> BearerAuth)."""
    e = table(spark, sf_dir, "events").select("user_id")
    st = F.element_at(F.array(*[F.lit(x) for x in ("bearer", "ApiKey", "cookie", "basic", "OAuth2", "digest")]),
                      (F.col("user_id") % 6 + 1).cast("int"))
    return e.select(st.alias("st")).groupBy("st", E.scheme_name(F.col("st")).alias("scheme_name")).agg(F.count(F.lit(1)).alias("n"))


@query("extract_context_doc", sql=f"""
WITH s AS (SELECT repo_id, source_file, row_number() OVER (PARTITION BY repo_id, source_file ORDER BY file_ord, line_no, rule_ord, pos) AS i,
                  method || ' ' || sketch_path || ' → handler: ' || handler AS t FROM (SELECT DISTINCT * FROM {SQL_SKETCH})),
f AS (SELECT DISTINCT repo_id, path, lang FROM {pages_files()})
SELECT f.repo_id, f.path, concat_ws(chr(10), '## Code Observations', '- Base prefix: /' || f.lang,
       CASE WHEN f.lang = 'en' THEN '## Global Auth Context' || chr(10) || 'token header' ELSE '## Auth: none detected' END,
       '## Endpoint Checklist (' || CAST(count(s.i) AS VARCHAR) || ' endpoints)',
       coalesce(string_agg('  ' || CAST(s.i AS VARCHAR) || '. ' || s.t, chr(10) ORDER BY s.i), '')) AS doc
FROM f LEFT JOIN s ON s.repo_id = f.repo_id AND s.source_file = f.path GROUP BY f.repo_id, f.path, f.lang""")
def q_extract_context_doc(spark, sf_dir):
    """Per-file context text: observations, auth section, numbered endpoint checklist."""
    s = sketches(spark, sf_dir).distinct()
    items = s.groupBy(F.col("repo_id").alias("r"), "source_file").agg(F.sort_array(F.collect_list(F.struct(
        "file_ord", "line_no", "rule_ord", "pos", F.concat_ws(" ", "method", "sketch_path", F.lit("→ handler:"), "handler").alias("t")))).alias("l"))
    f = page_files(spark, sf_dir).select("repo_id", "path", "lang").distinct()
    j = f.join(items, (f["repo_id"] == items["r"]) & (f["path"] == items["source_file"]), "left")
    lines = F.transform(F.coalesce("l", F.array().cast(items.schema["l"].dataType)),
                        lambda x, i: F.concat(F.lit("  "), (i + 1).cast("string"), F.lit(". "), x["t"]))
    auth = F.when(F.col("lang") == "en", F.lit("## Global Auth Context\ntoken header")).otherwise(F.lit("## Auth: none detected"))
    doc = F.concat_ws("\n", F.lit("## Code Observations"), F.concat(F.lit("- Base prefix: /"), "lang"), auth,
                      F.concat(F.lit("## Endpoint Checklist ("), F.size(lines).cast("string"), F.lit(" endpoints)")),
                      F.array_join(lines, "\n"))
    return j.select("repo_id", "path", doc.alias("doc"))


@query("sketch_coverage", sql=f"""
WITH s AS (SELECT DISTINCT repo_id, method, sketch_path, regexp_replace(CASE WHEN lower(regexp_replace(sketch_path, '/+$', '')) = '' THEN '/'
             ELSE lower(regexp_replace(sketch_path, '/+$', '')) END, '\\{{[^}}]+\\}}', '{{_}}', 'g') AS norm_path, length(handler) AS hl FROM {SQL_SKETCH})
SELECT DISTINCT repo_id, method, norm_path FROM s a WHERE NOT EXISTS (SELECT 1 FROM s b WHERE b.hl > 3 AND b.repo_id = a.repo_id
  AND b.method = a.method AND b.norm_path = a.norm_path)""")
def q_sketch_coverage(spark, sf_dir):
    """Sketched endpoints missing from the extracted set (here: links with a text of more than 3 characters)."""
    s = sketches(spark, sf_dir).withColumn("norm_path", path_score_key(F.col("sketch_path")))
    got = s.where(F.length("handler") > 3)
    return E.sketch_coverage(s, got).select("repo_id", "method", "norm_path").distinct()


# ---------------------------------------------------------------- mounts on part

def mount_inputs(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size")
    snake = F.replace(F.lower("p_name"), F.lit(" "), F.lit("_"))
    routes = p.select(F.col("p_type").alias("repo_id"),
                      F.concat(F.lit("src/routes/"), snake, F.lit("_"), F.col("p_partkey").cast("string"), F.lit(".js")).alias("path"),
                      F.col("p_partkey").alias("file_ord"))
    words = F.split("p_name", " ")
    camel = F.concat(words[0], F.initcap(F.array_join(F.slice(words, 2, 10), "")))
    key = F.when(F.col("p_size") % 7 == 0, F.concat(snake, F.lit("_"), F.col("p_partkey").cast("string"))).otherwise(camel)
    src = F.concat(F.lit("src/registry/"), F.lower(F.replace("p_brand", F.lit("#"), F.lit(""))), F.lit(".js"))
    m = (p.where(F.col("p_size") <= 10)
         .select(F.col("p_type").alias("repo_id"), src.alias("source_file"),
                 F.regexp_extract("p_brand", "([0-9]+)$", 1).cast("int").alias("src_ord"),
                 F.col("p_partkey").alias("key_ord"), key.alias("key"),
                 F.concat(F.lit("/api/"), F.replace("p_name", F.lit(" "), F.lit("-"))).alias("prefix")))
    return m, routes


SQL_MOUNT_IN = """
rt AS (SELECT p_type AS repo_id, 'src/routes/' || replace(lower(p_name), ' ', '_') || '_' || CAST(p_partkey AS VARCHAR) || '.js' AS path,
              p_partkey AS file_ord FROM part),
mo AS (SELECT p_type AS repo_id, 'src/registry/' || lower(replace(p_brand, '#', '')) || '.js' AS source_file,
              CAST(regexp_extract(p_brand, '([0-9]+)$', 1) AS INTEGER) AS src_ord, p_partkey AS key_ord,
              CASE WHEN p_size % 7 = 0 THEN replace(lower(p_name), ' ', '_') || '_' || CAST(p_partkey AS VARCHAR)
                   ELSE split_part(p_name, ' ', 1) || array_to_string(list_transform(string_split(p_name, ' ')[2:], lambda w: upper(w[1]) || lower(w[2:])), '') END AS key,
              '/api/' || replace(p_name, ' ', '-') AS prefix FROM part WHERE p_size <= 10),
f AS (SELECT *, regexp_replace(regexp_extract(path, '([^/]*)$', 1), '\\.[^.]*$', '') AS stem FROM rt),
f2 AS (SELECT *, regexp_replace(lower(stem), '[_.-]', '', 'g') AS stem_norm,
              list_filter(list_distinct(list_transform(regexp_extract_all(stem, '[A-Z]?[a-z]+|[A-Z]|[0-9]+', 0), lambda t: lower(t))),
                          lambda t: t NOT IN ('register', 'routes', 'route', 'router', 'controller', 'handler')) AS stem_tok FROM f),
m2 AS (SELECT *, regexp_replace(lower(key), '[_.-]', '', 'g') AS key_norm,
              list_filter(list_distinct(list_transform(regexp_extract_all(key, '[A-Z]?[a-z]+|[A-Z]|[0-9]+', 0), lambda t: lower(t))),
                          lambda t: t NOT IN ('register', 'routes', 'route', 'router', 'controller', 'handler')) AS key_tok,
              lower(string_split(regexp_replace(regexp_replace(prefix, '^/+', ''), '/+$', ''), '/')[-1]) AS pstem FROM mo),
j AS (SELECT m2.repo_id, m2.source_file, m2.src_ord, m2.key_ord, m2.key, m2.prefix, f2.path, f2.file_ord, m2.key_norm = f2.stem_norm AS exact,
             CASE WHEN m2.key_norm = f2.stem_norm THEN 100 ELSE greatest(
               CASE WHEN len(key_tok) > 0 AND len(stem_tok) > 0 THEN len(list_intersect(key_tok, stem_tok)) * 10 ELSE 0 END,
               CASE WHEN pstem <> '' AND contains(stem_norm, pstem) THEN length(pstem) + 5 ELSE 0 END) END AS score
      FROM m2 JOIN f2 ON m2.repo_id = f2.repo_id AND m2.source_file <> f2.path),
b AS (SELECT repo_id, source_file, src_ord, key_ord, key, prefix, arg_min(path, (NOT exact, -score, file_ord)) AS path,
             arg_min(score, (NOT exact, -score, file_ord)) AS score FROM j WHERE score > 0 GROUP BY ALL),
pf AS (SELECT repo_id, path, arg_min(prefix, (src_ord, key_ord)) AS prefix, arg_min(source_file, (src_ord, key_ord)) AS mounted_by,
              arg_min(key, (src_ord, key_ord)) AS key, arg_min(score, (src_ord, key_ord)) AS score FROM b GROUP BY 1, 2)"""


@query("mount_resolve", sql="WITH " + SQL_MOUNT_IN.strip() + " SELECT * FROM pf")
def q_mount_resolve(spark, sf_dir):
    """Registry mount keys matched to route files; each file takes its first mount prefix."""
    m, routes = mount_inputs(spark, sf_dir)
    return E.mount_resolve(m, routes)


def _rounds(spark, sf_dir):
    m, routes = mount_inputs(spark, sf_dir)
    pf = E.mount_resolve(m, routes)
    stem = F.regexp_replace(F.regexp_extract("path", "([^/]*)$", 1), r"\.[^.]*$", "")
    regs = m.select("repo_id", F.col("source_file").alias("path")).distinct()
    r1 = routes.select("repo_id", "path").unionByName(regs).select(
        "repo_id", "path", F.lit(True).alias("ok"), F.concat(F.lit("/"), stem).alias("endpoint"))
    r2 = pf.join(routes, ["repo_id", "path"]).select(
        "repo_id", "path", (F.col("file_ord") % 11 != 0).alias("ok"), F.concat("prefix", F.lit("/"), stem).alias("endpoint"))
    return m, pf, E.reextract_merge(r1, r2)


SQL_ROUNDS = SQL_MOUNT_IN + """,
regs AS (SELECT DISTINCT repo_id, source_file AS path FROM mo),
r1 AS (SELECT repo_id, path, true AS ok, '/' || regexp_replace(regexp_extract(path, '([^/]*)$', 1), '\\.[^.]*$', '') AS endpoint, 1 AS round
       FROM (SELECT repo_id, path FROM rt UNION ALL SELECT * FROM regs)),
r2 AS (SELECT pf.repo_id, pf.path, rt.file_ord % 11 <> 0 AS ok,
              pf.prefix || '/' || regexp_replace(regexp_extract(pf.path, '([^/]*)$', 1), '\\.[^.]*$', '') AS endpoint, 2 AS round
       FROM pf JOIN rt USING (repo_id, path)),
u AS (SELECT * FROM r1 UNION ALL SELECT * FROM r2),
mg AS (SELECT repo_id, path, arg_max(ok, (ok::INT, round)) AS ok, arg_max(endpoint, (ok::INT, round)) AS endpoint,
              arg_max(round, (ok::INT, round)) AS round FROM u GROUP BY 1, 2)"""


@query("mount_reextract_merge", sql="WITH " + SQL_ROUNDS.strip() + " SELECT * FROM mg")
def q_mount_reextract_merge(spark, sf_dir):
    """Round-2 results (with the mount prefix) replace round 1 unless they failed."""
    _, _, merged = _rounds(spark, sf_dir)
    return merged


@query("registry_exclude", sql="WITH " + SQL_ROUNDS.strip() + """
SELECT mg.* FROM mg WHERE NOT (mg.path IN (SELECT path FROM regs r WHERE r.repo_id = mg.repo_id)
                               AND mg.repo_id IN (SELECT repo_id FROM pf))""")
def q_registry_exclude(spark, sf_dir):
    """Registry files are dropped once any file of the repository received a prefix."""
    m, pf, merged = _rounds(spark, sf_dir)
    return E.registry_exclude(merged, m, pf)


# ------------------------------------------------------------ condensation

SIG_RE = "(Licen[cs]e|token = |@mail)"


def condense_inputs(spark, sf_dir):
    d = documents_as_files(table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text"))
    lines = explode_lines(d)
    sig = lines.where(F.col("line").rlike(SIG_RE))
    keep = sig.select("repo_id", "path", F.greatest(F.col("line_no") - 1, F.lit(1)).alias("start"), F.col("line_no").alias("end"))
    pre = sig.select("repo_id", "path").distinct().select("repo_id", "path", F.lit(1).alias("start"), F.lit(1).alias("end"))
    total = d.select("repo_id", "path", F.length("content").alias("original_chars"))
    return lines, keep.unionByName(pre), total


@query("condense_source", sql=f"""
WITH l AS (SELECT repo_id, path, unnest(string_split(content, chr(10))) AS line, generate_subscripts(string_split(content, chr(10)), 1) AS line_no
           FROM {documents_files()}),
sig AS (SELECT * FROM l WHERE regexp_matches(line, '{SIG_RE}')),
k AS (SELECT DISTINCT * FROM (SELECT repo_id, path, greatest(line_no - 1, 1) AS s, line_no AS e FROM sig
      UNION ALL SELECT repo_id, path, 1, 1 FROM sig)),
w AS (SELECT *, max(e) OVER (PARTITION BY repo_id, path ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pe FROM k),
g AS (SELECT *, sum(CASE WHEN pe IS NULL OR s > pe + 2 THEN 1 ELSE 0 END) OVER (PARTITION BY repo_id, path ORDER BY s, e
             ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS island FROM w),
isl AS (SELECT repo_id, path, island, min(s) AS s, max(e) AS e FROM g GROUP BY 1, 2, 3),
ch AS (SELECT i.repo_id, i.path, i.island, string_agg(l.line, chr(10) ORDER BY l.line_no) AS chunk FROM isl i JOIN l
         ON l.repo_id = i.repo_id AND l.path = i.path AND l.line_no BETWEEN i.s AND i.e GROUP BY 1, 2, 3),
t AS (SELECT repo_id, path, string_agg(chunk, chr(10) || chr(10) ORDER BY island) AS filtered, count(*) AS n_chunks FROM ch GROUP BY 1, 2),
o AS (SELECT f.repo_id, f.path, length(f.content) AS original_chars, t.filtered, t.n_chunks FROM {documents_files()} f LEFT JOIN t USING (repo_id, path))
SELECT repo_id, path, filtered IS NOT NULL AND length(filtered) < 0.9 * original_chars AS was_filtered, coalesce(n_chunks, 0) AS n_chunks,
       CASE WHEN filtered IS NOT NULL AND length(filtered) < 0.9 * original_chars THEN length(filtered) ELSE original_chars END AS filtered_chars,
       original_chars, CASE WHEN filtered IS NOT NULL AND length(filtered) < 0.9 * original_chars THEN md5(filtered) END AS filtered_md5
FROM o""")
def q_condense_source(spark, sf_dir):
    """Documents condensed to their signature lines (plus one line of look-back and the
    preamble), islands merged across gaps of two lines; kept whole when saving < 10%."""
    lines, keep, total = condense_inputs(spark, sf_dir)
    c = E.condense_source(lines, keep, total)
    return c.select("repo_id", "path", "was_filtered", "n_chunks", "filtered_chars", "original_chars",
                    F.md5("filtered").alias("filtered_md5"))
