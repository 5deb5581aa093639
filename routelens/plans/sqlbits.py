"""Shared DuckDB fragments for the oracle SQL (RE2 dialect: no lookaheads)."""

HOST = r"regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)"
PATH = r"regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1)"


def numeric_params(p: str) -> str:
    """SQL twin of ``numeric_segments_to_params``: loops because RE2 has no lookahead."""
    p = rf"regexp_replace({p}, '/[0-9]+\.html(/|$)', '/{{page}}\1', 'g')"
    # two passes: adjacent numeric segments share a slash
    p = rf"regexp_replace({p}, '/[0-9]+(/|$)', '/{{id}}\1', 'g')"
    return rf"regexp_replace({p}, '/[0-9]+(/|$)', '/{{id}}\1', 'g')"


def pages_files() -> str:
    return f"""(SELECT {HOST} AS repo_id, {PATH} AS path, page_id AS file_ord,
                regexp_extract({PATH}, '^/([^/]*)', 1) AS lang, html AS content FROM pages)"""


def documents_files() -> str:
    return """(SELECT source AS repo_id, lang || '/' || CAST(doc_id AS VARCHAR) AS path,
               doc_id AS file_ord, lang, text AS content FROM documents)"""


def template(p: str) -> str:
    return rf"regexp_replace({p}, '\{{[^}}]*\}}', '{{_}}', 'g')"
