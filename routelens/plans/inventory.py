"""Endpoint inventory over ``pages``.

Binding: one repository per URL host; every page is a GET-able endpoint whose
path is the URL path with numeric segments turned into parameters; the HTTP
method cycles with ``page_id`` so that (path, method) collisions occur.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from routelens.functions.paths import (
    numeric_segments_to_params, path_dedup_key, path_normalize, path_params, path_score_key,
    path_syntax_convert, path_template,
)
from routelens.operators.assemble import op_keep_first, path_canonicalize
from routelens.plans.catalog import query
from routelens.plans.sqlbits import HOST, PATH, numeric_params, template
from routelens.sources.tables import pages_as_files, table


def page_endpoints(spark, sf_dir):
    """``endpoints(repo_id, file_ord, ep_ord, method, path)`` from pages."""
    f = pages_as_files(table(spark, sf_dir, "pages").select("page_id", "url"))
    return f.select(
        "repo_id", "file_ord", F.lit(0).alias("ep_ord"),
        F.element_at(F.array(*[F.lit(m) for m in ("GET", "POST", "PUT", "DELETE")]),
                     (F.col("file_ord") % 4 + 1).cast("int")).alias("method"),
        numeric_segments_to_params(F.col("path")).alias("path"), "lang")


SQL_EP = f"""(SELECT {HOST} AS repo_id, page_id AS file_ord,
   ['GET','POST','PUT','DELETE'][(page_id % 4) + 1] AS method,
   {numeric_params(PATH)} AS path,
   regexp_extract({PATH}, '^/([^/]*)', 1) AS lang
 FROM pages)"""


def sql_clean_braces(p: str) -> str:
    p = rf"regexp_replace({p}, '\{{([^}}:]*):[^}}]*\}}', '{{\1}}', 'g')"
    p = rf"regexp_replace({p}, '\{{([^}}]*)\?\}}', '{{\1}}', 'g')"
    p = rf"regexp_replace({p}, '\{{([^}}=]*)=[^}}]*\}}', '{{\1}}', 'g')"
    return rf"regexp_replace({p}, '\{{\*([^}}]*)\}}', '{{\1}}', 'g')"


def sql_path_normalize(base: str, path: str, compat: bool = False) -> str:
    b = f"regexp_replace({base}, '/+$', '')"
    ep = f"regexp_replace({path}, '^/+', '')"
    brel = f"regexp_replace({b}, '^/+', '')"
    pre = f"starts_with({ep}, {brel})"
    if not compat:
        pre = f"({pre} AND substr({ep}, length({brel}) + 1, 1) IN ('', '/'))"
    full = f"(CASE WHEN {b} <> '' AND {pre} THEN '/' || {ep} ELSE {b} || '/' || {ep} END)"
    full = f"regexp_replace({full}, '/{{2,}}', '/', 'g')"
    full = f"(CASE WHEN starts_with({full}, '/') THEN {full} ELSE '/' || {full} END)"
    full = sql_clean_braces(full)
    return f"(CASE WHEN length({full}) > 1 AND ends_with({full}, '/') THEN regexp_replace({full}, '/+$', '') ELSE {full} END)"


PARAMS_SQL = r"array_to_string(list_filter(regexp_extract_all({p}, '\{{([^}}:]*)[^}}]*\}}', 1), lambda x: x <> ''), ',')"


@query("endpoint_inventory", sql=f"""
WITH n AS (SELECT repo_id, file_ord, {sql_path_normalize("''", "path")} AS path FROM {SQL_EP})
SELECT repo_id, {template('path')} AS path_key, arg_min(path, file_ord) AS canonical_path,
       count(*) AS n_pages, min(file_ord) AS first_page_id,
       {PARAMS_SQL.format(p='arg_min(path, file_ord)')} AS params
FROM n GROUP BY 1, 2""")
def endpoint_inventory(spark, sf_dir):
    """Flagship endpoint inventory - per host, one row per distinct path template."""
    ep = page_endpoints(spark, sf_dir).withColumn("path", path_normalize(F.lit(""), F.col("path")))
    g = (ep.groupBy("repo_id", path_template(F.col("path")).alias("path_key"))
         .agg(F.min_by("path", "file_ord").alias("canonical_path"),
              F.count(F.lit(1)).alias("n_pages"), F.min("file_ord").alias("first_page_id")))
    return g.withColumn("params", F.array_join(path_params(F.col("canonical_path")), ","))


def _decorated(path_col):
    p = F.regexp_replace(path_col, r"/[0-9]+\.html", "/{page?}")
    return F.regexp_replace(p, r"/[0-9]+", "/{id:[0-9]+}")


SQL_DECORATED = rf"regexp_replace(regexp_replace({PATH}, '/[0-9]+\.html', '/{{page?}}', 'g'), '/[0-9]+', '/{{id:[0-9]+}}', 'g')"
SQL_BASE = r"""(CASE page_id % 3 WHEN 0 THEN '/' || lang || '/' WHEN 1 THEN ''
           ELSE '/' || substr(lang, 1, 1) END)"""


@query("path_normalize", sql=f"""
WITH p AS (SELECT page_id, {HOST} AS repo_id, regexp_extract({PATH}, '^/([^/]*)', 1) AS lang,
                  {SQL_DECORATED} AS raw FROM pages),
b AS (SELECT page_id, repo_id, raw, {SQL_BASE} AS base FROM p)
SELECT page_id, repo_id, base, raw, {sql_path_normalize('base', 'raw')} AS normalized,
       {sql_path_normalize('base', 'raw', compat=True)} AS normalized_compat FROM b""")
def q_path_normalize(spark, sf_dir):
    """Three base shapes - segment prefix, empty, and a non-segment prefix (Q1)."""
    f = pages_as_files(table(spark, sf_dir, "pages").select("page_id", "url"))
    b = f.select(F.col("file_ord").alias("page_id"), "repo_id", "lang", _decorated(F.col("path")).alias("raw"))
    base = (F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("/"), "lang", F.lit("/")))
            .when(F.col("page_id") % 3 == 1, F.lit(""))
            .otherwise(F.concat(F.lit("/"), F.substring("lang", 1, 1))))
    b = b.withColumn("base", base)
    return b.select("page_id", "repo_id", "base", "raw",
                    path_normalize(F.col("base"), F.col("raw")).alias("normalized"),
                    path_normalize(F.col("base"), F.col("raw"), compat=True).alias("normalized_compat"))


@query("path_template", sql=f"""
SELECT file_ord AS page_id, repo_id, path, {template('path')} AS template FROM {SQL_EP}""")
def q_path_template(spark, sf_dir):
    """Every parameter becomes ``{_}`` (OpenAPI path identity)."""
    ep = page_endpoints(spark, sf_dir)
    return ep.select(F.col("file_ord").alias("page_id"), "repo_id", "path", path_template(F.col("path")).alias("template"))


@query("path_params", sql=f"""
SELECT page_id, {PARAMS_SQL.format(p='raw')} AS params,
       len(list_filter(regexp_extract_all(raw, '\\{{([^}}:]*)[^}}]*\\}}', 1), lambda x: x <> '')) AS n_params
FROM (SELECT page_id, {SQL_DECORATED} || '/{{:x}}' AS raw FROM pages)""")
def q_path_params(spark, sf_dir):
    """Decorated paths; a trailing ``{:x}`` has an empty name and is dropped."""
    f = pages_as_files(table(spark, sf_dir, "pages").select("page_id", "url"))
    raw = F.concat(_decorated(F.col("path")), F.lit("/{:x}"))
    pp = path_params(raw)
    return f.select(F.col("file_ord").alias("page_id"), F.array_join(pp, ",").alias("params"),
                    F.size(pp).alias("n_params"))


@query("path_dedup_key", sql=r"""
SELECT file_ord AS page_id, method, path,
  regexp_replace(lower(regexp_replace(regexp_replace(regexp_replace(path, '\{[^}]+\}', '_PARAM_', 'g'), '^/+', ''), '/+$', '')),
                 '[/\-_]+', '_', 'g') AS dedup_key
FROM (SELECT file_ord, method, replace(replace(path, '/{id}', '-{id}'), '/{page}', '/{page}/') AS path FROM """ + SQL_EP + ")")
def q_path_dedup_key(spark, sf_dir):
    """Separators collapse, so ``/en-{id}`` and ``/en/{id}`` share a key."""
    ep = page_endpoints(spark, sf_dir)
    p = F.replace(F.replace(F.col("path"), F.lit("/{id}"), F.lit("-{id}")), F.lit("/{page}"), F.lit("/{page}/"))
    ep = ep.select(F.col("file_ord").alias("page_id"), "method", p.alias("path"))
    return ep.withColumn("dedup_key", path_dedup_key(F.col("path")))


@query("path_score_key", sql=r"""
SELECT page_id, raw, regexp_replace(CASE WHEN lower(regexp_replace(raw, '/+$', '')) = '' THEN '/'
       ELSE lower(regexp_replace(raw, '/+$', '')) END, '\{[^}]+\}', '{_}', 'g') AS score_key
FROM (SELECT page_id, CASE WHEN page_id % 5 = 0 THEN '/' ELSE upper(""" + SQL_DECORATED + ") || '/' END AS raw FROM pages)")
def q_path_score_key(spark, sf_dir):
    """P5: upper-cased decorated paths with a trailing slash; every 5th page is the root."""
    f = pages_as_files(table(spark, sf_dir, "pages").select("page_id", "url"))
    raw = F.when(F.col("file_ord") % 5 == 0, F.lit("/")).otherwise(
        F.concat(F.upper(_decorated(F.col("path"))), F.lit("/")))
    return f.select(F.col("file_ord").alias("page_id"), raw.alias("raw")).withColumn(
        "score_key", path_score_key(F.col("raw")))


def _styled(path_col, lang_col):
    """Numeric segments spelled in the framework syntax chosen by language."""
    def sub(rep):
        return F.regexp_replace(F.regexp_replace(path_col, r"^/", ""), r"[0-9]+", rep)
    return (F.when(lang_col == "en", sub(":id")).when(lang_col == "de", sub("<id>"))
            .when(lang_col == "fr", sub("{id:int}")).when(lang_col == "es", sub("{id{int}}"))
            .otherwise(path_col))


SQL_STYLED = r"""(CASE lang WHEN 'en' THEN regexp_replace(regexp_replace(p, '^/', ''), '[0-9]+', ':id', 'g')
  WHEN 'de' THEN regexp_replace(regexp_replace(p, '^/', ''), '[0-9]+', '<id>', 'g')
  WHEN 'fr' THEN regexp_replace(regexp_replace(p, '^/', ''), '[0-9]+', '{id:int}', 'g')
  WHEN 'es' THEN regexp_replace(regexp_replace(p, '^/', ''), '[0-9]+', '{id{int}}', 'g')
  ELSE p END)"""


def sql_syntax_convert(p: str) -> str:
    w = "[A-Za-z0-9_]+"
    p = rf"regexp_replace({p}, ':({w})', '{{\1}}', 'g')"
    p = rf"regexp_replace({p}, '<({w})>', '{{\1}}', 'g')"
    p = rf"regexp_replace({p}, '\{{({w}):[^}}]+\}}', '{{\1}}', 'g')"
    p = rf"regexp_replace({p}, '\{{({w})\{{[^}}]*\}}\}}', '{{\1}}', 'g')"
    return f"(CASE WHEN {p} = '' OR starts_with({p}, '/') THEN {p} ELSE '/' || {p} END)"


@query("path_syntax_convert", sql=f"""
SELECT page_id, styled, {sql_syntax_convert('styled')} AS converted FROM (
  SELECT page_id, {SQL_STYLED} AS styled FROM (
    SELECT page_id, {PATH} AS p, regexp_extract({PATH}, '^/([^/]*)', 1) AS lang FROM pages))""")
def q_path_syntax_convert(spark, sf_dir):
    """Express ``:id``, Flask ``<id>``, ASP.NET ``{id:int}`` and nested braces."""
    f = pages_as_files(table(spark, sf_dir, "pages").select("page_id", "url"))
    s = f.select(F.col("file_ord").alias("page_id"), _styled(F.col("path"), F.col("lang")).alias("styled"))
    return s.withColumn("converted", path_syntax_convert(F.col("styled")))


# The probe patterns of the find_endpoint query (method, regex).
FIND_PATTERNS = [
    ("GET", r"^/en/\{id\}$"),
    ("POST", r"\{page\}"),
    ("GET", r"^/de/"),
    ("DELETE", r"^/(fr|es)/"),
    ("PUT", r"/\{id\}/$"),
]


def find_endpoint(endpoints, patterns):
    """First endpoint (by ``file_ord``) per (repo, method, pattern) whose path matches.

    A literal pattern list becomes one filter per pattern with a literal regex
    (compiled once per task); a pattern DataFrame is broadcast and joined on the
    method with the regex as a join condition. "First" is a partial
    aggregation either way - no window over a possibly hot repository.
    """
    if isinstance(patterns, list):
        parts = [endpoints.where((F.upper("method") == m.upper()) & F.col("path").rlike(p))
                 .select("repo_id", "file_ord", "path", F.lit(m).alias("p_method"), F.lit(p).alias("pattern"))
                 for m, p in patterns]
        j = parts[0]
        for x in parts[1:]:
            j = j.unionByName(x)
    else:
        j = endpoints.join(F.broadcast(patterns),
                           (F.upper(endpoints["method"]) == F.upper(patterns["p_method"]))
                           & F.regexp_like(endpoints["path"], patterns["pattern"]))
    return (j.groupBy("repo_id", "p_method", "pattern")
            .agg(F.min_by(F.struct("file_ord", "path"), "file_ord").alias("m"))
            .select("repo_id", F.col("p_method").alias("method"), "pattern",
                    F.col("m.file_ord").alias("page_id"), F.col("m.path").alias("path")))


_PAT_SQL = " UNION ALL ".join(f"SELECT '{m}' AS p_method, '{p}' AS pattern" for m, p in FIND_PATTERNS)


@query("find_endpoint", sql=f"""
SELECT repo_id, p_method AS method, pattern, min(file_ord) AS page_id, arg_min(path, file_ord) AS path
FROM {SQL_EP} e JOIN ({_PAT_SQL}) r ON upper(e.method) = upper(r.p_method) AND regexp_matches(e.path, r.pattern)
GROUP BY 1, 2, 3""")
def q_find_endpoint(spark, sf_dir):
    """First endpoint per (host, method, pattern) whose path matches the pattern."""
    return find_endpoint(page_endpoints(spark, sf_dir), FIND_PATTERNS)


@query("path_canonicalize", sql=f"""
WITH e AS (SELECT *, {template('path')} AS template FROM {SQL_EP})
SELECT e.file_ord AS page_id, e.repo_id, e.method, e.template, f.canonical_path
FROM e JOIN (SELECT repo_id, template, arg_min(path, file_ord) AS canonical_path FROM e GROUP BY 1, 2) f
  USING (repo_id, template)""")
def q_path_canonicalize(spark, sf_dir):
    """``/en/{id}`` and ``/en/{page}`` share a template; the first spelling wins."""
    c = path_canonicalize(page_endpoints(spark, sf_dir), order_cols=("file_ord",))
    return c.select(F.col("file_ord").alias("page_id"), "repo_id", "method", "template", "canonical_path")


@query("op_keep_first", sql=f"""
WITH e AS (SELECT *, {template('path')} AS template FROM {SQL_EP}),
c AS (SELECT e.*, f.canonical_path FROM e JOIN (SELECT repo_id, template, arg_min(path, file_ord) AS canonical_path
      FROM e GROUP BY 1, 2) f USING (repo_id, template))
SELECT repo_id, canonical_path, method, min(file_ord) AS page_id, arg_min(path, file_ord) AS spelling,
       count(*) AS n_seen, count(*) - 1 AS n_dropped
FROM c GROUP BY 1, 2, 3""")
def q_op_keep_first(spark, sf_dir):
    """After A7, one operation per (canonical path, method); the rest are logged."""
    c = path_canonicalize(page_endpoints(spark, sf_dir), order_cols=("file_ord",))
    kept, _dup = op_keep_first(c.select("repo_id", "canonical_path", "method", "file_ord", "path"),
                               order_cols=("file_ord",))
    return kept.select("repo_id", "canonical_path", "method", F.col("file_ord").alias("page_id"),
                       F.col("path").alias("spelling"), "n_seen", (F.col("n_seen") - 1).alias("n_dropped"))
