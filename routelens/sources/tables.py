"""Input tables and the file/line model.

``files(repo_id, path, file_ord, lang, content)`` is the corpus table every
scan operator works on; ``lines`` is its one-row-per-line explosion. The test
tables hold no source trees, so two bindings turn them into corpora:
``pages`` (one repository per URL host, one file per page) and ``documents``
(one repository per ``source``, one file per document).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations")

# Host and path of an absolute URL. Regex extraction keeps Spark and the SQL
# oracle byte-identical (parse_url differs between engines on odd inputs).
URL_HOST_RE = r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)"
URL_PATH_RE = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Parquet table of the test set; Catalyst prunes columns and pushes filters."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def register_views(spark: SparkSession, sf_dir: str, names=TABLES) -> None:
    for n in names:
        table(spark, sf_dir, n).createOrReplaceTempView(n)


def url_host(url: Column) -> Column:
    return F.regexp_extract(url, URL_HOST_RE, 1)


def url_path(url: Column) -> Column:
    return F.regexp_extract(url, URL_PATH_RE, 1)


def pages_as_files(pages: DataFrame) -> DataFrame:
    """One repository per host; ``path`` is the URL path, ``lang`` its first segment."""
    path = url_path(F.col("url"))
    return pages.select(
        url_host(F.col("url")).alias("repo_id"),
        path.alias("path"),
        F.col("page_id").alias("file_ord"),
        F.regexp_extract(path, r"^/([^/]*)", 1).alias("lang"),
        (F.col("html") if "html" in pages.columns else F.lit(None).cast("string")).alias("content"),
    )


def documents_as_files(documents: DataFrame) -> DataFrame:
    """One repository per ``source``; ``path`` is ``lang/doc_id``."""
    return documents.select(
        F.col("source").alias("repo_id"),
        F.concat_ws("/", F.col("lang"), F.col("doc_id").cast("string")).alias("path"),
        F.col("doc_id").alias("file_ord"),
        F.col("lang"),
        F.col("text").alias("content"),
    )


def explode_lines(files: DataFrame, cap_chars: int | None = None, keep=("repo_id", "path", "file_ord")) -> DataFrame:
    """``lines(repo_id, path, file_ord, line_no, line)``: 1-based line numbers.

    A narrow transformation (no shuffle): each file is exploded where it was read,
    so a repository holding a third of all files is still spread over every scan
    task. ``cap_chars`` applies a read cap *before* the split, as the reference's
    capped reads do.
    """
    content = F.col("content")
    if cap_chars is not None:
        content = F.substring(content, 1, cap_chars)
    cols = [F.col(c) for c in keep]
    return (files.select(*cols, F.posexplode(F.split(content, "\n", -1)).alias("pos", "line"))
            .select(*cols, (F.col("pos") + 1).alias("line_no"), "line"))
