"""Discovery and corpus-scan bindings.

Corpora: ``documents`` (repository = ``source``, file = ``lang/doc_id``) and
``pages`` (repository = URL host, file = URL path). Rule tables below are this
binding's rules, written for the text the test tables contain (license lines,
tokens, mail addresses, links).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from routelens.operators import detect as D
from routelens.operators.rules import rule_table
from routelens.plans.catalog import query
from routelens.plans.sqlbits import documents_files, pages_files
from routelens.sources import corpus as S
from routelens.sources.tables import documents_as_files, explode_lines, pages_as_files, table

# Fixed values of this binding ------------------------------------------------
FRAMEWORK_RULES = [  # eco_ord, rule_ord, file_regex, mode, needle, framework, language
    (0, 0, "^en/", "contains", "MIT License", "mit", None),
    (0, 1, ".*", "regex", "Apache License, Version [0-9.]+", "apache", None),
    (1, 0, ".*", "word", "gnu", "gpl", None),
    (1, 1, "^(fr|de|es)/", "contains", "MIT License", "mit", None),
    (2, 0, ".*", "contains", "CC BY", "creative-commons", "en"),
]
FRAMEWORK_SCHEMA = "eco_ord int, rule_ord int, file_regex string, mode string, needle string, framework string, language string"
ROUTE_RULES = [  # framework, rule_ord, path_regex, line_regex
    ("mit", 0, "^en/", 'token = "[0-9a-f]+"'),
    ("mit", 1, ".*", r"@mail[0-9]+\.example\.com"),
    ("apache", 0, ".*", 'token = "'),
    ("gpl", 0, "^(de|fr)/", r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+"),
    ("creative-commons", 0, ".*", "Licen[cs]e"),
    ("", 0, ".*", "Licen[cs]e"),
]
AUTH_RULES = [  # rule_ord, line_regex, mode
    (0, 'token = "[0-9a-f]+"', "all"),
    (1, r"@mail[0-9]+\.example\.com", "per-endpoint"),
    (2, r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+", "skip"),
]
PORT_RULES = [(0, r"@mail([0-9]+)\.example\.com"), (1, r"[0-9]+\.[0-9]+\.[0-9]+\.([0-9]+)")]
DEFAULT_PORTS = [("en", 8080), ("fr", 8000), ("de", 3000), ("es", 5000)]
BASE_RULES = [(0, 'href="(/[^"]*)"'), (1, r"track\(([0-9]+)\)")]
SWEEP_RE = 'href="/[A-Za-z]{9,}"'
GREP_RE = "Licen[cs]e"


def _vals(rows):
    def lit(v):
        if v is None:
            return "NULL"
        if isinstance(v, str):
            return "'" + v.replace("'", "''") + "'"
        return str(v)
    return "VALUES " + ", ".join("(" + ", ".join(lit(v) for v in r) + ")" for r in rows)


def _sq(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def doc_files(spark, sf_dir):
    return documents_as_files(table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text"))


def page_files(spark, sf_dir):
    return pages_as_files(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def fw_rules(spark):
    return FRAMEWORK_RULES


# ------------------------------------------------------------------ S1-S7

@query("corpus_scan", sql=f"""
SELECT repo_id, path, file_ord, length(content) AS n_chars
FROM (SELECT repo_id, CASE WHEN file_ord % 9 = 0 THEN 'node_modules/' || path WHEN file_ord % 9 = 1
             THEN '.cache/' || path ELSE path END AS path, file_ord, content FROM {documents_files()})
WHERE NOT regexp_matches(path, {_sq(S.prune_regex())})""")
def q_corpus_scan(spark, sf_dir):
    """Hidden and vendored directories are pruned from the listing."""
    f = doc_files(spark, sf_dir)
    f = f.withColumn("path", F.when(F.col("file_ord") % 9 == 0, F.concat(F.lit("node_modules/"), "path"))
                     .when(F.col("file_ord") % 9 == 1, F.concat(F.lit(".cache/"), "path")).otherwise(F.col("path")))
    return S.corpus_scan(f).select("repo_id", "path", "file_ord", F.length("content").alias("n_chars"))


GLOBS = ["/{en,de}/*.html", "/fr/**/*/"]


@query("glob_filter", sql=f"""
SELECT repo_id, count(*) AS n_files, min(file_ord) AS first_page FROM {pages_files()}
WHERE regexp_matches(path, {_sq("|".join(f"(?:{S.glob_to_regex(g)})" for g in GLOBS))}) GROUP BY 1""")
def q_glob_filter(spark, sf_dir):
    """Brace globs compiled to one regex; per host the number of matching pages."""
    g = S.glob_filter(page_files(spark, sf_dir), GLOBS)
    return g.groupBy("repo_id").agg(F.count(F.lit(1)).alias("n_files"), F.min("file_ord").alias("first_page"))


LANG_EXT = [("en", "html"), ("de", "html"), ("fr", "")]


@query("language_filter", sql=f"""
WITH f AS (SELECT *, lower(regexp_extract(path, '\\.([A-Za-z0-9]+)$', 1)) AS ext FROM {pages_files()}),
rl AS (SELECT repo_id, arg_min(lang, file_ord) AS language FROM f GROUP BY 1),
le AS (SELECT * FROM ({_vals(LANG_EXT)}) t(language, ext)),
j AS (SELECT f.*, rl.language FROM f LEFT JOIN rl USING (repo_id))
SELECT repo_id, path, file_ord, language FROM j
WHERE EXISTS (SELECT 1 FROM le WHERE le.language = j.language AND le.ext = j.ext)
   OR NOT EXISTS (SELECT 1 FROM le WHERE le.language = j.language)""")
def q_language_filter(spark, sf_dir):
    """S3: keep files whose extension fits the host's language (first page's language)."""
    f = page_files(spark, sf_dir)
    rl = f.groupBy("repo_id").agg(F.min_by("lang", "file_ord").alias("language"))
    le = rule_table(spark, LANG_EXT, "language string, ext string")
    return S.language_filter(f, rl, le).select("repo_id", "path", "file_ord", "language")


@query("capped_read", sql="""
SELECT doc_id, length(coalesce(text, '')) AS n_chars, length(substr(coalesce(text, ''), 1, 16000)) AS n_capped_16k,
       md5(coalesce(text, '')) AS content_md5 FROM documents""")
def q_capped_read(spark, sf_dir):
    """NULL-safe whole content (hash and length) and the length the 16k read cap would keep."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    whole = S.capped_read(F.col("text"))
    return d.select("doc_id", F.length(whole).alias("n_chars"),
                    F.length(S.capped_read(F.col("text"), 16000)).alias("n_capped_16k"), F.md5(whole).alias("content_md5"))


SQL_DOC_LINES = f"""(SELECT repo_id, path, file_ord, unnest(string_split(content, chr(10))) AS line,
   generate_subscripts(string_split(content, chr(10)), 1) AS line_no FROM {documents_files()})"""


@query("line_range", sql=f"""
WITH l AS {SQL_DOC_LINES},
r AS (SELECT repo_id, path, line_no - 1 AS start, line_no + 1 AS "end" FROM l WHERE regexp_matches(line, '{GREP_RE}'))
SELECT l.repo_id, l.path, r.start, l.line_no, CAST(l.line_no AS VARCHAR) || ': ' || regexp_replace(l.line, '\\s+$', '') AS numbered
FROM l JOIN r ON l.repo_id = r.repo_id AND l.path = r.path
WHERE l.line_no BETWEEN r.start AND least(r."end", r.start + 99)""")
def q_line_range(spark, sf_dir):
    """Numbered context lines (one before, one after) around every license line."""
    lines = explode_lines(doc_files(spark, sf_dir))
    ranges = lines.where(F.col("line").rlike(GREP_RE)).select(
        "repo_id", "path", (F.col("line_no") - 1).alias("start"), (F.col("line_no") + 1).alias("end"))
    return S.line_range(lines, ranges).select("repo_id", "path", "start", "line_no", "numbered")


@query("corpus_grep", sql=f"""
SELECT repo_id, path, line_no, line, rank FROM (
  SELECT repo_id, path, line_no, substr(regexp_replace(line, '\\s+$', ''), 1, 200) AS line,
         row_number() OVER (PARTITION BY repo_id ORDER BY path, line_no) AS rank
  FROM {SQL_DOC_LINES} WHERE regexp_matches(line, '{GREP_RE}')) WHERE rank <= 50""")
def q_corpus_grep(spark, sf_dir):
    """The grep tool: first 50 matching lines per repository, cut to 200 characters."""
    return S.corpus_grep(explode_lines(doc_files(spark, sf_dir)), GREP_RE, max_matches=50, cut=200)


SQL_RAW_PATHS = f"""(SELECT page_id, repo_id,
   CASE page_id % 4 WHEN 0 THEN '  ./' || path || '  ' WHEN 1 THEN '/srv/' || repo_id || path
        WHEN 2 THEN '..' || path ELSE './.' || path END AS raw, '/srv/' || repo_id AS root
 FROM (SELECT file_ord AS page_id, repo_id, path FROM {pages_files()}))"""


@query("path_relativize", sql=f"""
WITH p AS (SELECT page_id, raw, root, trim(raw) AS t, regexp_replace(root, '/+$', '') AS r FROM {SQL_RAW_PATHS}),
q AS (SELECT page_id, raw, CASE WHEN r <> '' AND starts_with(t, r || '/') THEN substr(t, length(r) + 2) ELSE t END AS x FROM p),
s AS (SELECT page_id, raw, regexp_replace(regexp_replace(x, '^(\\./)+', ''), '^/+', '') AS y FROM q)
SELECT page_id, raw, CASE WHEN regexp_matches(y, '(^|/)\\.\\.(/|$)') THEN NULL ELSE y END AS relative FROM s""")
def q_path_relativize(spark, sf_dir):
    """Tool paths made relative to the repository root; traversal outside it is rejected (NULL)."""
    f = page_files(spark, sf_dir).select(F.col("file_ord").alias("page_id"), "repo_id", "path")
    raw = (F.when(F.col("page_id") % 4 == 0, F.concat(F.lit("  ./"), "path", F.lit("  ")))
           .when(F.col("page_id") % 4 == 1, F.concat(F.lit("/srv/"), "repo_id", "path"))
           .when(F.col("page_id") % 4 == 2, F.concat(F.lit(".."), "path"))
           .otherwise(F.concat(F.lit("./."), "path")))
    f = f.select("page_id", raw.alias("raw"), F.concat(F.lit("/srv/"), "repo_id").alias("root"))
    return f.select("page_id", "raw", S.path_relativize(F.col("raw"), F.col("root")).alias("relative"))


# ------------------------------------------------------------------ S13-S15

@query("stale_snapshot", sql="""
WITH pinned AS (SELECT source AS repo_id, CAST(max(doc_id) AS VARCHAR) AS "commit" FROM documents GROUP BY 1),
ing AS (SELECT d.source AS repo_id, CAST(max(l.doc_id) AS VARCHAR) AS ingested_commit
        FROM labels l JOIN documents d USING (doc_id) WHERE l.quality = 1 GROUP BY 1)
SELECT p.repo_id, p."commit", i.ingested_commit, CASE WHEN i.ingested_commit IS NULL THEN 'missing' ELSE 'stale' END AS reason
FROM pinned p LEFT JOIN ing i USING (repo_id) WHERE i.ingested_commit IS NULL OR i.ingested_commit <> p."commit" """)
def q_stale_snapshot(spark, sf_dir):
    """Pinned snapshot = newest document per source; ingested = newest good labelled one."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source")
    pinned = d.groupBy(F.col("source").alias("repo_id")).agg(F.max("doc_id").cast("string").alias("commit"))
    lab = table(spark, sf_dir, "labels").where("quality = 1").join(d, "doc_id")
    ing = lab.groupBy(F.col("source").alias("repo_id")).agg(F.max("doc_id").cast("string").alias("commit"))
    return S.stale_snapshot(pinned, ing).select("repo_id", "commit", "ingested_commit", "reason")


@query("repo_ref_parse", sql=f"""
WITH r AS (SELECT page_id, CASE page_id % 3 WHEN 0 THEN url WHEN 1 THEN repo_id || '/' || lang
                               ELSE 'git@' || repo_id || ':team/' || lang || '.git' END AS ref
           FROM (SELECT file_ord AS page_id, repo_id, lang, regexp_replace(p.url, '[?#].*$', '') AS url
                 FROM {pages_files()} f JOIN pages p ON p.page_id = f.file_ord)),
c AS (SELECT page_id, ref, regexp_matches(ref, '^(https://|http://|git@|ssh://)') AS sch,
             len(string_split(ref, '/')) = 2 AS two FROM r),
u AS (SELECT page_id, ref, sch OR (NOT sch AND two) AS is_url,
             CASE WHEN NOT sch AND two THEN 'https://github.com/' || ref || '.git' ELSE ref END AS url FROM c)
SELECT page_id, ref, is_url, url, regexp_replace(regexp_extract(regexp_replace(url, '/+$', ''), '([^/]*)$', 1), '\\.git$', '') AS name FROM u""")
def q_repo_ref_parse(spark, sf_dir):
    """Classify clone targets (URL, owner/repo shorthand, scp-style) and derive names."""
    p = table(spark, sf_dir, "pages").select("page_id", "url")
    f = pages_as_files(p).select(F.col("file_ord").alias("page_id"), "repo_id", "lang")
    f = f.join(p.select("page_id", F.regexp_replace("url", "[?#].*$", "").alias("url")), "page_id")
    ref = (F.when(F.col("page_id") % 3 == 0, F.col("url"))
           .when(F.col("page_id") % 3 == 1, F.concat_ws("/", "repo_id", "lang"))
           .otherwise(F.concat(F.lit("git@"), "repo_id", F.lit(":team/"), "lang", F.lit(".git"))))
    r = f.select("page_id", ref.alias("ref")).withColumn("p", S.repo_ref_parse(F.col("ref")))
    return r.select("page_id", "ref", "p.is_url", "p.url", "p.name")


@query("secret_mask", sql="""
WITH t AS (SELECT doc_id, text, regexp_extract(text, 'token = "([0-9a-f]+)"', 1) AS secret FROM documents)
SELECT doc_id, secret, md5(CASE WHEN secret = '' THEN text ELSE replace(text, secret, '***') END) AS masked_md5,
       length(CASE WHEN secret = '' THEN text ELSE replace(text, secret, '***') END) AS masked_len
FROM t WHERE secret <> '' """)
def q_secret_mask(spark, sf_dir):
    """Each document's token value redacted from its whole text."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    d = d.withColumn("secret", F.regexp_extract("text", 'token = "([0-9a-f]+)"', 1)).where(F.col("secret") != "")
    m = S.secret_mask(F.col("text"), F.col("secret"))
    return d.select("doc_id", "secret", F.md5(m).alias("masked_md5"), F.length(m).alias("masked_len"))


# ------------------------------------------------------------------ D1-D16

SQL_FW_RULES = f"(SELECT * FROM ({_vals(FRAMEWORK_RULES)}) t(eco_ord, rule_ord, file_regex, mode, needle, framework, language))"
SQL_FW_HITS = f"""(SELECT f.repo_id, f.path, f.file_ord, f.lang, r.eco_ord, r.rule_ord, r.framework, r.language
 FROM {documents_files()} f JOIN {SQL_FW_RULES} r ON regexp_matches(f.path, r.file_regex)
 WHERE CASE r.mode WHEN 'contains' THEN contains(f.content, r.needle)
                   WHEN 'word' THEN regexp_matches(lower(f.content), '(^|[^A-Za-z0-9_])' || r.needle || '([^A-Za-z0-9_]|$)')
                   WHEN 'regex' THEN regexp_matches(f.content, r.needle) ELSE false END)"""
SQL_FRAMEWORK = f"""
WITH h AS {SQL_FW_HITS},
pf AS (SELECT repo_id, framework, min((eco_ord, file_ord, rule_ord)) AS o,
              arg_min(coalesce(language, lang), (eco_ord, file_ord, rule_ord)) AS language FROM h GROUP BY 1, 2),
agg AS (SELECT repo_id, arg_min(framework, o) AS framework, arg_min(language, o) AS language, count(*) AS n,
               list(framework ORDER BY o) AS fws FROM pf GROUP BY 1),
repos AS (SELECT repo_id, arg_min(lang, file_ord) AS first_lang FROM {documents_files()} GROUP BY 1),
m AS (SELECT r.repo_id, coalesce(a.framework, '') AS framework, coalesce(a.language, r.first_lang) AS language,
             coalesce(a.n, 0) AS n_frameworks,
             list_filter(coalesce(a.fws, []), lambda x: x <> a.framework) AS oth
      FROM repos r LEFT JOIN agg a USING (repo_id))
SELECT repo_id, framework, language, n_frameworks, array_to_string(oth, ',') AS others,
       CASE WHEN n_frameworks > 1 THEN 'multiple frameworks; also found: ' || array_to_string(oth, ', ') ELSE '' END AS warning
FROM m"""


def doc_manifest(spark, sf_dir):
    return D.framework_detect(doc_files(spark, sf_dir), fw_rules(spark))


@query("framework_detect", sql=SQL_FRAMEWORK)
def q_framework_detect(spark, sf_dir):
    """D1 + D4 + D5: license family per source in rule priority order, other hits, fallback language."""
    return doc_manifest(spark, sf_dir)


@query("multi_framework_warn", sql=f"SELECT repo_id, framework, others, warning FROM ({SQL_FRAMEWORK}) WHERE n_frameworks > 1")
def q_multi_framework_warn(spark, sf_dir):
    """Repositories where more than one framework rule fired."""
    return doc_manifest(spark, sf_dir).where(F.col("n_frameworks") > 1).select("repo_id", "framework", "others", "warning")


@query("language_fallback", sql=f"SELECT repo_id, language FROM ({SQL_FRAMEWORK}) WHERE framework = ''")
def q_language_fallback(spark, sf_dir):
    """No framework found; the language comes from the first file."""
    return doc_manifest(spark, sf_dir).where(F.col("framework") == "").select("repo_id", "language")


@query("language_override", sql=f"""
SELECT m.repo_id, m.framework, CASE WHEN k.repo_id IS NOT NULL THEN 'es' ELSE m.language END AS language
FROM ({SQL_FRAMEWORK}) m LEFT JOIN (SELECT DISTINCT repo_id FROM {documents_files()} WHERE regexp_matches(path, '^es/')) k
USING (repo_id)""")
def q_language_override(spark, sf_dir):
    """D3: a marker file (any ``es/`` document) overrides the detected language."""
    m = D.language_override(doc_manifest(spark, sf_dir), doc_files(spark, sf_dir), "^es/", "es")
    return m.select("repo_id", "framework", "language")


SQL_ROUTE_RULES = f"(SELECT * FROM ({_vals(ROUTE_RULES)}) t(fw, rule_ord, path_regex, line_regex))"
SQL_ROUTES = f"""(SELECT f.repo_id, f.path, min(f.file_ord) AS file_ord, min(r.rule_ord) AS rule_ord
 FROM {documents_files()} f JOIN ({SQL_FRAMEWORK}) m USING (repo_id)
 JOIN {SQL_ROUTE_RULES} r ON m.framework = r.fw AND regexp_matches(f.path, r.path_regex)
 WHERE NOT regexp_matches(f.path, {_sq(D.exclude_regex())}) AND regexp_matches(f.content, '(?m)' || r.line_regex)
 GROUP BY 1, 2)"""


def doc_routes(spark, sf_dir):
    return D.route_file_detect(doc_files(spark, sf_dir), doc_manifest(spark, sf_dir), ROUTE_RULES)


@query("route_file_detect", sql=f"SELECT * FROM {SQL_ROUTES}")
def q_route_file_detect(spark, sf_dir):
    """Files matching a (path, line) rule of their repository's framework, once each."""
    return doc_routes(spark, sf_dir)


SQL_STYLED_PATHS = f"""(SELECT repo_id, CASE file_ord % 7 WHEN 0 THEN 'tests/' || path WHEN 1 THEN path || '.test.js'
   WHEN 2 THEN 'node_modules/' || path WHEN 3 THEN 'src/' || path || '_test.go' ELSE 'src/' || path || '.py' END AS path,
   file_ord FROM {documents_files()})"""


@query("exclude_filter", sql=f"""
SELECT repo_id, path, file_ord, regexp_matches(path, {_sq(D.exclude_regex())}) AS excluded,
       regexp_matches(path, {_sq(D.exclude_regex(anchored=True))}) AS excluded_anchored FROM {SQL_STYLED_PATHS}""")
def q_exclude_filter(spark, sf_dir):
    """Exclusion flags for test/vendored/build paths, unanchored (default) and anchored (Q3)."""
    f = doc_files(spark, sf_dir)
    p = (F.when(F.col("file_ord") % 7 == 0, F.concat(F.lit("tests/"), "path"))
         .when(F.col("file_ord") % 7 == 1, F.concat("path", F.lit(".test.js")))
         .when(F.col("file_ord") % 7 == 2, F.concat(F.lit("node_modules/"), "path"))
         .when(F.col("file_ord") % 7 == 3, F.concat(F.lit("src/"), "path", F.lit("_test.go")))
         .otherwise(F.concat(F.lit("src/"), "path", F.lit(".py"))))
    f = f.select("repo_id", p.alias("path"), "file_ord")
    kept = D.exclude_filter(f).select("repo_id", "path").withColumn("__k", F.lit(True))
    kept_a = D.exclude_filter(f, anchored=True).select("repo_id", "path").withColumn("__ka", F.lit(True))
    out = f.join(kept, ["repo_id", "path"], "left").join(kept_a, ["repo_id", "path"], "left")
    return out.select("repo_id", "path", "file_ord", F.col("__k").isNull().alias("excluded"),
                      F.col("__ka").isNull().alias("excluded_anchored"))


SQL_PAGE_KNOWN = f"(SELECT repo_id, path FROM {pages_files()} WHERE file_ord % 5 = 0)"


def page_known(f):
    return f.where(F.col("file_ord") % 5 == 0).select("repo_id", "path")


@query("importer_detect", sql=f"""
WITH f AS (SELECT regexp_extract(repo_id, '([^.]+\\.[^.]+)$', 1) AS repo_id, repo_id || path AS path, file_ord, content FROM {pages_files()}),
known AS (SELECT DISTINCT repo_id, path FROM f WHERE file_ord % 7 = 0),
targets AS (SELECT DISTINCT f.repo_id, unnest(regexp_extract_all(f.content, 'href="/([^"]*)"', 1)) AS target
            FROM f JOIN known k ON f.repo_id = k.repo_id AND f.path = k.path),
parts AS (SELECT repo_id, regexp_extract(target, '([^/]*)$', 1) AS base, regexp_extract(target, '([^/]+)/[^/]*$', 1) AS parent FROM targets),
stems AS (SELECT *, regexp_replace(base, '([^.])\\.[^.]*$', '\\1') AS stem FROM parts),
terms AS (SELECT DISTINCT repo_id, term FROM (SELECT repo_id, unnest([base, CASE WHEN contains(stem, '.') THEN stem END,
            CASE WHEN parent <> '' THEN parent || '/' || stem END, CASE WHEN parent <> '' AND ends_with(base, '.go') THEN parent END]) AS term FROM stems)
          WHERE length(term) >= 6)
SELECT f.repo_id, f.path, min(f.file_ord) AS file_ord FROM f JOIN terms t ON t.repo_id = f.repo_id
  AND (contains(f.content, '"' || t.term) OR contains(f.content, '/' || t.term) OR contains(f.content, chr(39) || t.term))
WHERE NOT regexp_matches(f.path, '(\\.spec\\.|\\.test\\.|\\.module\\.(ts|js)$)')
  AND NOT EXISTS (SELECT 1 FROM known k WHERE k.repo_id = f.repo_id AND k.path = f.path)
GROUP BY 1, 2""")
def q_importer_detect(spark, sf_dir):
    """Pages of a domain (a repository of all its hosts) that mention what a known page links to."""
    f = page_files(spark, sf_dir)
    f = f.select(F.regexp_extract("repo_id", r"([^.]+\.[^.]+)$", 1).alias("repo_id"), F.concat("repo_id", "path").alias("path"), "file_ord", "content")
    known = f.where(F.col("file_ord") % 7 == 0).select("repo_id", "path").distinct()
    targets = (f.join(known, ["repo_id", "path"], "left_semi")
               .select("repo_id", F.explode(F.regexp_extract_all("content", F.lit('href="/([^"]*)"'), 1)).alias("path")))
    return D.importer_detect(f, D.route_terms(targets), known)


@query("verb_sweep", sql=f"""
WITH f AS (SELECT repo_id, path, min(file_ord) AS file_ord FROM {pages_files()}
           WHERE NOT regexp_matches(path, {_sq(D.exclude_regex())}) AND NOT regexp_matches(path, '(\\.spec\\.|\\.test\\.)')
             AND regexp_matches(content, '(?m){SWEEP_RE}') GROUP BY 1, 2)
SELECT * FROM f WHERE NOT EXISTS (SELECT 1 FROM {SQL_PAGE_KNOWN} k WHERE k.repo_id = f.repo_id AND k.path = f.path)""")
def q_verb_sweep(spark, sf_dir):
    """Pages with a long link literal that are not known yet."""
    f = page_files(spark, sf_dir)
    return D.verb_sweep(f, page_known(f), SWEEP_RE)


SQL_AUTH_RULES = f"(SELECT * FROM ({_vals(AUTH_RULES)}) t(rule_ord, line_regex, mode))"
SQL_AUTH_HEAD = f"""
WITH l AS (SELECT * FROM {SQL_DOC_LINES} x WHERE NOT regexp_matches(path, {_sq(D.exclude_regex())})
           AND NOT EXISTS (SELECT 1 FROM {{routes}} r WHERE r.repo_id = x.repo_id AND r.path = x.path)),"""
SQL_AUTH_TAIL = f"""
j AS (SELECT l.repo_id, l.path, l.line_no, arg_min(r.mode, r.rule_ord) AS mode, arg_min(l.line, r.rule_ord) AS line
      FROM l JOIN {SQL_AUTH_RULES} r ON regexp_matches(l.line, r.line_regex) GROUP BY 1, 2, 3),
t AS (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY CASE WHEN starts_with(path, 'de/') THEN 0 ELSE 1 END,
             path, line_no) AS rk FROM j)
SELECT repo_id, CASE max(CASE mode WHEN 'all' THEN 2 WHEN 'per-endpoint' THEN 1 ELSE 0 END) WHEN 2 THEN 'all'
              WHEN 1 THEN 'per-endpoint' ELSE '' END AS auth_mode,
       string_agg(path || ': ' || trim(line), chr(10) ORDER BY rk) AS auth_hint, count(*) AS n_hits
FROM t WHERE rk <= 8 GROUP BY 1"""
# route files are not auth candidates (they are described separately)
SQL_AUTH = SQL_AUTH_HEAD.replace("{routes}", SQL_ROUTES) + SQL_AUTH_TAIL


def doc_auth(spark, sf_dir):
    lines = explode_lines(doc_files(spark, sf_dir))
    prio = F.when(F.col("path").startswith("de/"), F.lit(0)).otherwise(F.lit(1))
    return D.auth_context(lines, AUTH_RULES, exclude=doc_routes(spark, sf_dir), priority=prio, max_hits=8)


@query("auth_context", sql=SQL_AUTH)
def q_auth_context(spark, sf_dir):
    """Auth mode and the first eight evidence lines per source (German files first, route files skipped)."""
    return doc_auth(spark, sf_dir)


SQL_SERVER = f"""
WITH f AS (SELECT *, CASE WHEN lang = 'en' THEN 0 ELSE 1 END AS tier FROM {documents_files()}),
r AS (SELECT * FROM ({_vals(PORT_RULES)}) t(rule_ord, regex)),
h AS (SELECT f.repo_id, f.tier, f.file_ord, r.rule_ord, TRY_CAST(regexp_extract(f.content, r.regex, 1) AS INTEGER) AS port
      FROM f JOIN r ON regexp_matches(f.content, r.regex)),
b AS (SELECT repo_id, arg_min(port, (tier, file_ord, rule_ord)) AS found_port FROM h WHERE port IS NOT NULL GROUP BY 1),
m AS (SELECT repo_id, arg_min(lang, file_ord) AS language FROM {documents_files()} GROUP BY 1),
d AS (SELECT * FROM ({_vals(DEFAULT_PORTS)}) t(language, port))
SELECT m.repo_id, coalesce(b.found_port, d.port) AS port,
       CASE WHEN coalesce(b.found_port, d.port) IS NOT NULL THEN 'http://localhost:' || CAST(coalesce(b.found_port, d.port) AS VARCHAR) END AS server,
       CASE WHEN b.found_port IS NOT NULL THEN 'config' WHEN d.port IS NOT NULL THEN 'default' ELSE 'none' END AS port_source
FROM m LEFT JOIN b USING (repo_id) LEFT JOIN d USING (language)"""


def doc_server(spark, sf_dir):
    f = doc_files(spark, sf_dir)
    m = f.groupBy("repo_id").agg(F.min_by("lang", "file_ord").alias("language"))
    return D.server_port(f, PORT_RULES, m,
                         rule_table(spark, DEFAULT_PORTS, "language string, port int"),
                         tier=F.when(F.col("lang") == "en", F.lit(0)).otherwise(F.lit(1)))


@query("server_port", sql=SQL_SERVER)
def q_server_port(spark, sf_dir):
    """Port from the first rule hit in (tier, file, rule) order, else the language default."""
    return doc_server(spark, sf_dir)


SQL_BASE = f"""
WITH f AS (SELECT *, CASE WHEN lang = 'en' THEN 0 ELSE 1 END AS tier FROM {pages_files()}),
r AS (SELECT * FROM ({_vals(BASE_RULES)}) t(rule_ord, regex)),
x AS (SELECT f.repo_id, f.tier, f.file_ord, r.rule_ord, unnest(regexp_extract_all(f.content, r.regex, 1)) AS bp,
             generate_subscripts(regexp_extract_all(f.content, r.regex, 1), 1) - 1 AS pos
      FROM f JOIN r ON regexp_matches(f.content, r.regex)),
y AS (SELECT repo_id, tier, file_ord, rule_ord, pos, CASE WHEN starts_with(bp, '/') THEN bp ELSE '/' || bp END AS bp
      FROM x WHERE bp <> '')
SELECT repo_id, arg_min(bp, (NOT contains(lower(bp), 'api'), length(bp), tier, file_ord, rule_ord, pos)) AS base_path,
       count(*) AS n_candidates FROM y GROUP BY 1"""


@query("base_path_select", sql=SQL_BASE)
def q_base_path_select(spark, sf_dir):
    """Shortest link or tracker path per host (``api`` paths preferred)."""
    f = page_files(spark, sf_dir)
    return D.base_path_select(f, BASE_RULES,
                              tier=F.when(F.col("lang") == "en", F.lit(0)).otherwise(F.lit(1)))


def doc_prescan(spark, sf_dir):
    """Manifest per source composed from D1, D6, D8, D9, D10 and D11."""
    f = doc_files(spark, sf_dir)
    m = doc_manifest(spark, sf_dir)
    routes = doc_routes(spark, sf_dir)
    terms = routes.join(f, ["repo_id", "path"]).select(
        "repo_id", F.regexp_extract("content", 'token = "([0-9a-f]{6})', 1).alias("term"))
    imp = D.importer_detect(f, terms, routes)
    sweep = D.verb_sweep(f, routes, r"@mail[0-9]+\.example\.com")
    n = lambda df, c: df.groupBy("repo_id").agg(F.count(F.lit(1)).alias(c))
    out = (m.join(n(routes, "n_route_files"), "repo_id", "left").join(n(imp, "n_importers"), "repo_id", "left")
           .join(n(sweep, "n_sweep"), "repo_id", "left")
           .join(doc_auth(spark, sf_dir).select("repo_id", "auth_mode", "auth_hint"), "repo_id", "left")
           .join(doc_server(spark, sf_dir).select("repo_id", "server"), "repo_id", "left"))
    return out.fillna(0, ["n_route_files", "n_importers", "n_sweep"]).fillna("", ["auth_mode", "auth_hint"])


SQL_PRESCAN = f"""
WITH m AS ({SQL_FRAMEWORK}), routes AS {SQL_ROUTES},
f AS {documents_files()},
terms AS (SELECT DISTINCT r.repo_id, regexp_extract(f.content, 'token = "([0-9a-f]{{6}})', 1) AS term
          FROM routes r JOIN f USING (repo_id, path)),
t1 AS (SELECT repo_id, path, file_ord, unnest(regexp_extract_all(content, '["''/]([A-Za-z0-9_.-]+)', 1)) AS tok
       FROM f),
toks AS (SELECT DISTINCT repo_id, path, tok FROM (SELECT repo_id, path, tok FROM t1 UNION ALL
         SELECT repo_id, path, regexp_replace(tok, '\\.[^.]*$', '') FROM t1)),
imp AS (SELECT DISTINCT repo_id, path FROM toks WHERE EXISTS (SELECT 1 FROM terms WHERE terms.repo_id = toks.repo_id
          AND terms.term = substr(toks.tok, 1, 6) AND length(terms.term) >= 6)
          AND NOT regexp_matches(path, '(\\.spec\\.|\\.test\\.|\\.module\\.(ts|js)$)')
          AND NOT EXISTS (SELECT 1 FROM routes r WHERE r.repo_id = toks.repo_id AND r.path = toks.path)),
sw AS (SELECT DISTINCT repo_id, path FROM f WHERE NOT regexp_matches(path, {_sq(D.exclude_regex())})
         AND NOT regexp_matches(path, '(\\.spec\\.|\\.test\\.)') AND regexp_matches(content, '(?m)@mail[0-9]+\\.example\\.com')
         AND NOT EXISTS (SELECT 1 FROM routes r WHERE r.repo_id = f.repo_id AND r.path = f.path)),
au AS ({SQL_AUTH}), sv AS ({SQL_SERVER})
SELECT m.*, coalesce((SELECT count(*) FROM routes r WHERE r.repo_id = m.repo_id), 0) AS n_route_files,
       coalesce((SELECT count(*) FROM imp i WHERE i.repo_id = m.repo_id), 0) AS n_importers,
       coalesce((SELECT count(*) FROM sw s WHERE s.repo_id = m.repo_id), 0) AS n_sweep,
       coalesce(au.auth_mode, '') AS auth_mode, coalesce(au.auth_hint, '') AS auth_hint, sv.server
FROM m LEFT JOIN au USING (repo_id) LEFT JOIN sv USING (repo_id)"""


@query("prescan", sql=SQL_PRESCAN)
def q_prescan(spark, sf_dir):
    """The composed manifest per source (framework, route files, importers, sweep, auth, server)."""
    return doc_prescan(spark, sf_dir)


@query("prescan_report", sql=f"""
SELECT repo_id, concat_ws(chr(10), 'framework: ' || coalesce(framework, '-'), 'language: ' || coalesce(language, '-'),
  'route files: ' || CAST(n_route_files AS VARCHAR), 'importers: ' || CAST(n_importers AS VARCHAR),
  'sweep files: ' || CAST(n_sweep AS VARCHAR), 'auth mode: ' || coalesce(auth_mode, '-'),
  'server: ' || coalesce(server, '-'), 'base path: -') AS report FROM ({SQL_PRESCAN})""")
def q_prescan_report(spark, sf_dir):
    """The text summary of each source's manifest."""
    return D.prescan_report(doc_prescan(spark, sf_dir).withColumn("base_path", F.lit(None).cast("string")))


@query("manifest_project", sql=f"""
SELECT repo_id, coalesce(nullif(framework, ''), 'unknown') AS framework, coalesce(nullif(language, ''), 'unknown') AS language,
       coalesce(nullif(server, ''), 'unknown') AS server, auth_mode, n_route_files FROM ({SQL_PRESCAN})""")
def q_manifest_project(spark, sf_dir):
    """The manifest with ``unknown`` defaults."""
    m = D.manifest_project(doc_prescan(spark, sf_dir))
    return m.select("repo_id", "framework", "language", "server", "auth_mode", "n_route_files")


@query("auth_context_propagate", sql=f"""
SELECT repo_id, CASE WHEN coalesce(auth_hint, '') = '' THEN 'from-manifest: ' || framework ELSE auth_hint END AS auth_hint
FROM ({SQL_PRESCAN})""")
def q_auth_context_propagate(spark, sf_dir):
    """The detector hint is kept; empty hints are filled from another source."""
    m = doc_prescan(spark, sf_dir).withColumn("other", F.concat(F.lit("from-manifest: "), "framework"))
    return D.auth_context_propagate(m, "auth_hint", "other").select("repo_id", "auth_hint")


def include_files(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type")
    inc = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("\n-r reqs/"), (F.col("p_partkey") + 1).cast("string"), F.lit(".txt"))) \
        .when(F.col("p_partkey") % 3 == 1, F.concat(F.lit("\n-c reqs/"), (F.col("p_partkey") + 2).cast("string"), F.lit(".txt"))).otherwise(F.lit(""))
    return p.select(F.col("p_type").alias("repo_id"), F.concat(F.lit("reqs/"), F.col("p_partkey").cast("string"), F.lit(".txt")).alias("path"),
                    F.concat(F.lower("p_name"), inc).alias("content"))


@query("manifest_includes", sql="""
WITH f AS (SELECT p_type AS repo_id, 'reqs/' || CAST(p_partkey AS VARCHAR) || '.txt' AS path, lower(p_name) ||
             CASE p_partkey % 3 WHEN 0 THEN chr(10) || '-r reqs/' || CAST(p_partkey + 1 AS VARCHAR) || '.txt'
                                WHEN 1 THEN chr(10) || '-c reqs/' || CAST(p_partkey + 2 AS VARCHAR) || '.txt' ELSE '' END AS content FROM part),
i AS (SELECT repo_id, path, regexp_extract(content, '(?m)^-[rc]\\s+(\\S+)', 1) AS target FROM f WHERE regexp_matches(content, '(?m)^-[rc]\\s+'))
SELECT f.repo_id, f.path, CASE WHEN t.path IS NULL THEN 0 ELSE 1 END AS n_includes,
       md5(CASE WHEN t.path IS NULL THEN f.content ELSE f.content || chr(10) || t.content END) AS content_md5
FROM f LEFT JOIN i ON i.repo_id = f.repo_id AND i.path = f.path LEFT JOIN f t ON t.repo_id = i.repo_id AND t.path = i.target""")
def q_manifest_includes(spark, sf_dir):
    """``-r``/``-c`` includes of requirement-style manifests appended one level deep."""
    m = D.manifest_includes(include_files(spark, sf_dir))
    return m.select("repo_id", "path", "n_includes", F.md5("content").alias("content_md5"))


# Fixed values of this binding: one framework rule per match mode (D1a-D1h shapes).
MODE_RULES = [
    (0, 0, r"package\.json$", "key", "k", "node-service", "javascript"),
    (1, 0, "^en/", "word", "license", "python-service", "python"),
    (2, 0, ".*", "contains", "Apache License", "jvm-service", "java"),
    (3, 0, ".*", "regex", "token = \"[0-9a-f]{8}", "go-service", "go"),
]


def manifest_corpus(spark, sf_dir):
    """Documents plus one JSON manifest per source built from ``events.props``."""
    docs = doc_files(spark, sf_dir)
    ev = table(spark, sf_dir, "events").select("event_id", "user_id", "props")
    man = ev.select(F.concat(F.lit("src"), (F.col("user_id") % 20).cast("string")).alias("repo_id"),
                    F.concat(F.lit("svc"), (F.col("event_id") % 3).cast("string"), F.lit("/package.json")).alias("path"),
                    F.col("event_id").alias("file_ord"), F.lit("json").alias("lang"),
                    F.concat(F.lit('{"dependencies": '), F.col("props"), F.lit("}")).alias("content"))
    return docs.unionByName(man)


@query("framework_rule_modes", sql=f"""
WITH f AS (SELECT repo_id, path, content FROM {documents_files()}
           UNION ALL SELECT 'src' || CAST(user_id % 20 AS VARCHAR), 'svc' || CAST(event_id % 3 AS VARCHAR) || '/package.json',
                            '{{"dependencies": ' || props || '}}' FROM events),
r AS (SELECT * FROM ({_vals(MODE_RULES)}) t(eco_ord, rule_ord, file_regex, mode, needle, framework, language))
SELECT f.repo_id, r.mode, r.framework, count(*) AS n_hits FROM f JOIN r ON regexp_matches(f.path, r.file_regex)
WHERE CASE r.mode WHEN 'contains' THEN contains(f.content, r.needle)
               WHEN 'word' THEN regexp_matches(lower(f.content), '(^|[^A-Za-z0-9_])' || r.needle || '([^A-Za-z0-9_]|$)')
               WHEN 'regex' THEN regexp_matches(f.content, r.needle)
               WHEN 'key' THEN list_contains(list_concat(coalesce(json_keys(json_extract(f.content, '$.dependencies')), []),
                                   coalesce(json_keys(json_extract(f.content, '$.devDependencies')), []),
                                   coalesce(json_keys(json_extract(f.content, '$.require')), [])), r.needle) END
GROUP BY 1, 2, 3""")
def q_framework_rule_modes(spark, sf_dir):
    """D1a-D1h: the four rule match modes - JSON dependency key, whole word, substring, regex."""
    hits = D.framework_hits(manifest_corpus(spark, sf_dir), MODE_RULES)
    rules = rule_table(spark, MODE_RULES, FRAMEWORK_SCHEMA).select("framework", "mode")
    return hits.join(F.broadcast(rules), "framework").groupBy("repo_id", "mode", "framework").agg(F.count(F.lit(1)).alias("n_hits"))


def doc_route_files(spark, sf_dir):
    """D13 list form: importers first, then rule hits, then sweep hits; each file once
    (its first list), ordered by (list, file order) - rows, not one collected array."""
    f = doc_files(spark, sf_dir)
    routes = doc_routes(spark, sf_dir)
    terms = routes.join(f, ["repo_id", "path"]).select(
        "repo_id", F.regexp_extract("content", 'token = "([0-9a-f]{6})', 1).alias("term"))
    imp = D.importer_detect(f, terms, routes)
    sweep = D.verb_sweep(f, routes, r"@mail[0-9]+\.example\.com")
    u = (imp.select("repo_id", "path", "file_ord", F.lit(0).alias("list_ord"))
         .unionByName(routes.select("repo_id", "path", "file_ord", F.lit(1).alias("list_ord")))
         .unionByName(sweep.select("repo_id", "path", "file_ord", F.lit(2).alias("list_ord"))))
    first = u.groupBy("repo_id", "path").agg(F.min_by(F.struct("list_ord", "file_ord"), F.struct("list_ord", "file_ord")).alias("w"))
    src = F.element_at(F.array(F.lit("importer"), F.lit("rule"), F.lit("sweep")), (F.col("w.list_ord") + 1).cast("int"))
    return first.select("repo_id", "path", F.col("w.list_ord").alias("list_ord"), F.col("w.file_ord").alias("file_ord"), src.alias("source"))


@query("prescan_route_files", sql=SQL_PRESCAN.split("au AS (")[0] + """
u AS (SELECT i.repo_id, i.path, 0 AS list_ord, (SELECT min(file_ord) FROM f WHERE f.repo_id = i.repo_id AND f.path = i.path) AS file_ord FROM imp i
      UNION ALL SELECT repo_id, path, 1, file_ord FROM routes
      UNION ALL SELECT s.repo_id, s.path, 2, (SELECT min(file_ord) FROM f WHERE f.repo_id = s.repo_id AND f.path = s.path) FROM sw s)
SELECT repo_id, path, arg_min(list_ord, (list_ord, file_ord)) AS list_ord, arg_min(file_ord, (list_ord, file_ord)) AS file_ord,
       ['importer', 'rule', 'sweep'][arg_min(list_ord, (list_ord, file_ord)) + 1] AS source FROM u GROUP BY 1, 2""")
def q_prescan_route_files(spark, sf_dir):
    """D13 (lists): the route-file list of each source - importers first, rule hits, sweep hits."""
    return doc_route_files(spark, sf_dir)
