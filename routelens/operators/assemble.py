"""Assembly operators A1-A13 over the ``endpoints`` fact table.

First-wins rules of the reference ("first seen spelling", "first (path, method)")
become ordinal columns resolved with ``min_by`` aggregations: partial
aggregation runs map-side, so a repository holding a third of all endpoints
never lands in a single task the way a ``row_number`` window over it would.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from routelens.functions.paths import path_template


def _ord(order_cols) -> Column:
    cols = [F.col(c) if isinstance(c, str) else c for c in order_cols]
    return F.struct(*cols) if len(cols) > 1 else cols[0]


def path_canonicalize(endpoints: DataFrame, order_cols=("file_ord", "ep_ord"), path_col="path") -> DataFrame:
    """Paths equal under P2 merge into the first spelling seen.

    Adds ``template`` and ``canonical_path``. The first spelling per
    ``(repo_id, template)`` is an aggregate (map-side partial), joined back on the
    group key; AQE's skew join splits a hot group on the large side.
    """
    ep = endpoints.withColumn("template", path_template(F.col(path_col)))
    first = (ep.groupBy("repo_id", "template")
             .agg(F.min_by(F.col(path_col), _ord(order_cols)).alias("canonical_path")))
    return ep.join(first, ["repo_id", "template"], "inner")


def op_keep_first(endpoints: DataFrame, order_cols=("file_ord", "ep_ord"), path_col="canonical_path", seen: str | None = None):
    """The first ``(path, method)`` wins; returns ``(kept, duplicates)``.

    ``kept`` has one row per ``(repo_id, path, method)`` carrying the winning
    row's columns plus ``n_seen``; ``duplicates`` are the losing rows (they feed
    the findings log). ``seen`` names a column with the number of rows that a row
    stands for, where rows were put together before.
    """
    keys = ["repo_id", path_col, "method"]
    others = [c for c in endpoints.columns if c not in keys and c != seen]
    o = F.struct(*[F.col(c) for c in order_cols])
    win = (endpoints.groupBy(*keys)
           .agg(F.min_by(F.struct(*[F.col(c) for c in others]), o).alias("w"),
                (F.sum(seen) if seen else F.count(F.lit(1))).alias("n_seen")))
    kept = win.select(*keys, "w.*", "n_seen")
    first = win.select(*keys, F.struct(*[F.col(f"w.{c}") for c in order_cols]).alias("__first"))
    dup = (endpoints.join(first, keys, "inner")
           .where(~o.eqNullSafe(F.col("__first")))
           .drop("__first"))
    return kept, dup
