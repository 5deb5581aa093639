"""Corpus scans and sources S1-S9, S13-S15.

Source trees are read once with Spark's text source (one row per file) and
then handled as the ``files`` table; everything after the read is a DataFrame
transformation. Read caps of the single-machine original are *not* applied by
default: whole texts are scanned (``cap_chars`` stays available).
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Directories skipped while walking a tree (hidden dirs too).
SKIP_DIRS = ("node_modules", "__pycache__", ".git", "venv", ".venv", "dist", "build")


def prune_regex(skip_dirs=SKIP_DIRS) -> str:
    alts = "|".join(re.escape(d) for d in skip_dirs)
    return rf"(^|/)(\.[^/]*|{alts})/"


def scan_directory(spark: SparkSession, root: str, skip_dirs=SKIP_DIRS, repo_id: str | None = None) -> DataFrame:
    """``files`` from a directory tree: relative path, pruned dirs, file order.

    ``wholetext`` gives one row per file; ``repo_id`` defaults to the first path
    component under ``root`` so one read covers a corpus of repositories.
    ``file_ord`` is the path itself (sorted listing order).
    """
    raw = (spark.read.option("recursiveFileLookup", "true").option("wholetext", "true").text(root)
           .select(F.col("_metadata.file_path").alias("abs"), F.col("value").alias("content")))
    root_uri = root.rstrip("/") + "/"
    rel = F.regexp_replace(F.regexp_replace("abs", "^file:", ""), "^" + re.escape(root_uri.replace("file:", "")), "")
    df = raw.select(rel.alias("rel"), "content").where(~F.col("rel").rlike(prune_regex(skip_dirs)))
    if repo_id is None:
        df = df.select(F.regexp_extract("rel", "^([^/]*)/", 1).alias("repo_id"),
                       F.regexp_replace("rel", "^[^/]*/", "").alias("path"), "content")
    else:
        df = df.select(F.lit(repo_id).alias("repo_id"), F.col("rel").alias("path"), "content")
    df = df.withColumn("lang", F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1)))
    # order is a column: the sorted listing order is the path order itself, so no
    # window over a (possibly huge) repository is needed to number files
    return df.withColumn("file_ord", F.col("path"))


def corpus_scan(files: DataFrame, skip_dirs=SKIP_DIRS) -> DataFrame:
    """S1 on an existing ``files`` table: drop hidden/vendored directories."""
    return files.where(~F.col("path").rlike(prune_regex(skip_dirs)))


def glob_to_regex(glob: str) -> str:
    """Glob with ``{a,b}`` alternatives -> anchored regex (RE2/Java compatible).

    ``**/`` matches zero or more directories; ``*`` and ``?`` stay inside one
    path segment.
    """
    out, i = [], 0
    while i < len(glob):
        c = glob[i]
        if glob.startswith("**/", i):
            out.append("(?:[^/]*/)*")
            i += 3
            continue
        if glob.startswith("**", i):
            out.append(".*")
            i += 2
            continue
        if c == "*":
            out.append("[^/]*")
        elif c == "?":
            out.append("[^/]")
        elif c == "{":
            j = glob.index("}", i)
            out.append("(?:" + "|".join(re.escape(a) for a in glob[i + 1:j].split(",")) + ")")
            i = j + 1
            continue
        else:
            out.append(re.escape(c))
        i += 1
    return "^" + "".join(out) + "$"


def glob_filter(files: DataFrame, globs) -> DataFrame:
    """Files matching any glob, each file once (one compiled alternation)."""
    rx = "|".join(f"(?:{glob_to_regex(g)})" for g in globs)
    return files.where(F.col("path").rlike(rx))


def file_extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))


def language_filter(files: DataFrame, repo_lang: DataFrame, lang_ext: DataFrame) -> DataFrame:
    """S3: keep the files whose extension belongs to the repository's language.

    ``repo_lang(repo_id, language)``; ``lang_ext(language, ext)`` is a small rule
    table (broadcast). Repositories whose language has no extension rows keep
    every file (the fallback).
    """
    known = lang_ext.select("language").distinct().withColumn("__known", F.lit(True))
    f = (files.withColumn("ext", file_extension(F.col("path")))
         .join(repo_lang, "repo_id", "left")
         .join(F.broadcast(known), "language", "left"))
    allowed = F.broadcast(lang_ext.select(F.col("language").alias("__l"), F.col("ext").alias("__e")))
    matched = f.join(allowed, (f["language"] == F.col("__l")) & (f["ext"] == F.col("__e")), "left_semi")
    fallback = f.where(F.col("__known").isNull())
    return matched.unionByName(fallback).drop("__known")


def capped_read(content: Column, cap_chars: int | None = None) -> Column:
    """NULL-safe content, optionally cut to ``cap_chars`` characters."""
    c = F.coalesce(content, F.lit(""))
    return F.substring(c, 1, cap_chars) if cap_chars else c


def line_range(lines: DataFrame, ranges: DataFrame, max_lines: int | None = None) -> DataFrame:
    """Inclusive line ranges, whole or at most ``max_lines`` lines each, numbered ``n: text``.

    ``ranges(repo_id, path, start, end)``; joined on the file key, so each file's
    lines meet only their own ranges.
    """
    j = lines.join(ranges, ["repo_id", "path"])
    last = F.col("end") if max_lines is None else F.least(F.col("end"), F.col("start") + (max_lines - 1))
    j = j.where(F.col("line_no").between(F.col("start"), last))
    return j.withColumn("numbered", F.concat(F.col("line_no").cast("string"), F.lit(": "),
                                             F.regexp_replace("line", r"\s+$", "")))


def corpus_grep(lines: DataFrame, pattern: str, max_matches: int | None = None, cut: int | None = None) -> DataFrame:
    """Regex search; all, or the first ``max_matches``, hits per repository in (path, line) order.

    The rank filter sits right above the window, so Spark plans a
    ``WindowGroupLimit`` that keeps only the top rows per repository on the map
    side before the shuffle: a hot repository does not ship all its hits.
    """
    text = F.regexp_replace("line", r"\s+$", "")
    hits = lines.where(F.col("line").rlike(pattern)).select(
        "repo_id", "path", "line_no", (F.substring(text, 1, cut) if cut else text).alias("line"))
    if max_matches is None:
        return hits
    w = Window.partitionBy("repo_id").orderBy("path", "line_no")
    return hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= max_matches)


def path_relativize(raw: Column, root: Column) -> Column:
    """Trim, drop ``./`` and the root prefix; NULL when the path escapes the root."""
    p = F.trim(raw)
    r = F.regexp_replace(root, "/+$", "")
    p = F.when((r != "") & p.startswith(F.concat(r, F.lit("/"))), F.substring(p, F.length(r) + 2, 1 << 30)).otherwise(p)
    p = F.regexp_replace(p, r"^(\./)+", "")
    p = F.regexp_replace(p, "^/+", "")
    escapes = p.rlike(r"(^|/)\.\.(/|$)")
    return F.when(escapes, F.lit(None).cast("string")).otherwise(p)


def repo_ref_parse(ref: Column) -> Column:
    """struct(is_url, url, name) of a clone target.

    URL if it has a scheme or ``git@``; ``owner/repo`` (exactly one slash)
    expands to a GitHub URL; the name is the last segment without ``.git``.
    """
    scheme = ref.rlike(r"^(https://|http://|git@|ssh://)")
    shorthand = (~scheme) & (F.size(F.split(ref, "/")) == 2)
    url = F.when(shorthand, F.concat(F.lit("https://github.com/"), ref, F.lit(".git"))).otherwise(ref)
    name = F.regexp_replace(F.regexp_extract(F.regexp_replace(url, "/+$", ""), "([^/]*)$", 1), r"\.git$", "")
    return F.struct((scheme | shorthand).alias("is_url"), url.alias("url"), name.alias("name"))


def secret_mask(text: Column, secret: Column, mask: str = "***") -> Column:
    """Every literal occurrence of ``secret`` replaced by ``mask``."""
    return F.when((secret.isNull()) | (secret == ""), text).otherwise(F.replace(text, secret, F.lit(mask)))


def stale_snapshot(pinned: DataFrame, ingested: DataFrame) -> DataFrame:
    """Pinned repositories missing from the ingested set or on another commit."""
    j = pinned.join(ingested.withColumnRenamed("commit", "ingested_commit"), "repo_id", "left")
    return (j.where(F.col("ingested_commit").isNull() | (F.col("ingested_commit") != F.col("commit")))
            .withColumn("reason", F.when(F.col("ingested_commit").isNull(), F.lit("missing")).otherwise(F.lit("stale"))))
