"""Path operators P1-P7 as Column expressions (JVM-side, inside codegen).

All of them are compositions of ``regexp_replace`` / ``regexp_extract_all`` and
string functions, so they run wherever the rows are, with no Python worker.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def clean_param_braces(path) -> Column:
    """``{p:c}``, ``{p?}``, ``{p=d}``, ``{*p}`` -> ``{p}``, applied in that order."""
    p = _c(path)
    p = F.regexp_replace(p, r"\{([^}:]*):[^}]*\}", "{$1}")   # constraint suffix
    p = F.regexp_replace(p, r"\{([^}]*)\?\}", "{$1}")         # optional marker
    p = F.regexp_replace(p, r"\{([^}=]*)=[^}]*\}", "{$1}")    # default value
    p = F.regexp_replace(p, r"\{\*([^}]*)\}", "{$1}")         # catch-all prefix
    return p


def path_normalize(base, path, compat: bool = False) -> Column:
    """Join base and endpoint path into one clean OpenAPI path.

    The base is not repeated when the path already starts with it. ``compat``
    keeps the plain string-prefix test (base ``/api`` swallows ``/apifoo``);
    the default only accepts a whole-segment prefix.
    """
    b = F.regexp_replace(_c(base), "/+$", "")
    ep = F.regexp_replace(_c(path), "^/+", "")
    b_rel = F.regexp_replace(b, "^/+", "")
    prefixed = ep.startswith(b_rel)
    if not compat:
        nxt = F.substring(ep, F.length(b_rel) + 1, 1)
        prefixed = prefixed & ((nxt == "") | (nxt == "/"))
    full = F.when((b != "") & prefixed, F.concat(F.lit("/"), ep)).otherwise(F.concat(b, F.lit("/"), ep))
    full = F.regexp_replace(full, "/{2,}", "/")
    full = F.when(full.startswith("/"), full).otherwise(F.concat(F.lit("/"), full))
    full = clean_param_braces(full)
    return F.when((F.length(full) > 1) & full.endswith("/"), F.regexp_replace(full, "/+$", "")).otherwise(full)


def path_template(path) -> Column:
    """Every ``{...}`` becomes ``{_}`` (identity of OpenAPI paths)."""
    return F.regexp_replace(_c(path), r"\{[^}]*\}", "{_}")


def path_params(path) -> Column:
    """Ordered parameter names, constraint suffix cut, empty names dropped."""
    names = F.regexp_extract_all(_c(path), F.lit(r"\{([^}:]*)[^}]*\}"), 1)
    return F.filter(names, lambda x: x != "")


def path_dedup_key(path) -> Column:
    """Params -> ``_PARAM_``, outer slashes off, lower case, runs of ``/-_`` -> ``_``."""
    p = F.regexp_replace(_c(path), r"\{[^}]+\}", "_PARAM_")
    p = F.lower(F.regexp_replace(F.regexp_replace(p, "^/+", ""), "/+$", ""))
    return F.regexp_replace(p, r"[/\-_]+", "_")


def path_score_key(path) -> Column:
    """P5: trailing slashes off, lower case, empty -> ``/``, params -> ``{_}``."""
    p = F.lower(F.regexp_replace(_c(path), "/+$", ""))
    p = F.when(p == "", F.lit("/")).otherwise(p)
    return F.regexp_replace(p, r"\{[^}]+\}", "{_}")


def path_syntax_convert(path) -> Column:
    """``:p`` and ``<p>`` -> ``{p}``; ``{p:c}`` and ``{p{c}}`` -> ``{p}``; leading ``/`` if non-empty."""
    word = "[A-Za-z0-9_]+"
    p = F.regexp_replace(_c(path), f":({word})", "{$1}")
    p = F.regexp_replace(p, f"<({word})>", "{$1}")
    p = F.regexp_replace(p, "\\{(" + word + "):[^}]+\\}", "{$1}")
    p = F.regexp_replace(p, "\\{(" + word + ")\\{[^}]*\\}\\}", "{$1}")
    return F.when((p == "") | p.startswith("/"), p).otherwise(F.concat(F.lit("/"), p))


def numeric_segments_to_params(path) -> Column:
    """Binding helper: digit-only segments become ``{id}``; ``N.html`` becomes ``{page}``."""
    p = F.regexp_replace(_c(path), r"/[0-9]+\.html(/|$)", "/{page}$1")
    # two passes: neighbouring numeric segments share a slash (no lookahead, to
    # stay expressible in the RE2 oracle)
    p = F.regexp_replace(p, r"/[0-9]+(/|$)", "/{id}$1")
    return F.regexp_replace(p, r"/[0-9]+(/|$)", "/{id}$1")
