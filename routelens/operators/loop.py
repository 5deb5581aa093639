"""The resolution loop (G11 with G12) and what became of every name.

Names are resolved to files, files are extracted, the extracted schemas name further types and have subtypes, and so
on.  Two delta tables drive it: the names of a round and the files it adds.  A name is asked for once, a file is
extracted once; only the deltas are written each round, the history is their union.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from routelens.functions.hints import primitive_schema
from routelens.session import spread, write_stage

NAME, FILE = ["repo_id", "name"], ["repo_id", "path"]


@dataclass
class Resolution:
    """``names(repo_id, name, round, reason, parent, path)``: requests in the round they were made (the last round's may be
    left over); ``files(repo_id, path, round, ok)``; ``schemas(repo_id, name, path, round)``; ``rounds``: how many ran."""
    names: DataFrame
    files: DataFrame
    schemas: DataFrame
    rounds: int
    max_rounds: int | None


def _all(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def resolution_loop(requests: DataFrame, index: DataFrame, extracted: DataFrame, refs: DataFrame, inherits: DataFrame,
                    max_rounds: int | None = None) -> Resolution:
    """Run the loop to its fixpoint, or for ``max_rounds``.

    ``requests(repo_id, name)``; ``index(repo_id, name, path)``: one file a name; ``extracted(repo_id, path, name, ok)``: what the
    extractor makes of a file, one row a schema, and one with a null name and ok false for a file that fails;
    ``refs(repo_id, name, target)``: names in a schema; ``inherits(repo_id, name, child)``.

    A round: names that are no primitives meet the index; files not seen before are extracted; what their schemas
    refer to, and their subtypes, are the next round's names unless they were asked for or extracted before.  A
    name that both a ref and a subtype lead to counts as ref; its parent is the first in name order.
    """
    null = F.lit(None).cast("string")
    links = refs.select("repo_id", "name", "target", F.lit("ref").alias("reason")).unionByName(
        inherits.select("repo_id", "name", F.col("child").alias("target"), F.lit("subtype").alias("reason")))
    links = write_stage(links, "loop-all-links")  # a table before it is dealt, as in ``closure``
    rows = links.count()
    links = write_stage(spread(links, *NAME, rows=rows).distinct(), "loop-links")
    fresh = requests.select(*NAME).distinct().withColumns({"reason": F.lit("request"), "parent": null})
    names, files, schemas, done = [], [], [], 0
    while True:
        done += 1
        plain = primitive_schema(F.col("name")).isNull()
        asked = write_stage(fresh.withColumn("__p", plain).join(index, NAME, "left").select(
            *NAME, F.lit(done).alias("round"), "reason", "parent", F.when(F.col("__p"), F.col("path")).alias("path")), "loop-names")
        names.append(asked)
        if (max_rounds is not None and done > max_rounds) or asked.isEmpty():
            break
        new = asked.where("path is not null").select(*FILE).distinct()
        if files:
            new = new.join(_all(files).select(*FILE), FILE, "left_anti")
        made = write_stage(new.join(extracted, FILE).withColumn("round", F.lit(done)), "loop-files")
        files.append(made.groupBy(*FILE, "round").agg(F.bool_and("ok").alias("ok")))
        schemas.append(made.where("ok and name is not null").select(*NAME, "path", "round"))
        found = schemas[-1].select(*NAME).join(spread(links, *NAME, rows=rows), NAME).groupBy("repo_id", F.col("target").alias("name")).agg(
            F.min(F.struct("reason", F.col("name").alias("parent"))).alias("by")).select("repo_id", "name", "by.reason", "by.parent")
        known = _all([_all(names).select(*NAME), _all(schemas).select(*NAME)])
        fresh = found.join(known, NAME, "left_anti")
    return Resolution(_all(names), _all(files) if files else extracted.limit(0).select(*FILE, F.lit(0).alias("round"), "ok"),
                      _all(schemas) if schemas else extracted.limit(0).select(*NAME, "path", F.lit(0).alias("round")), done - 1, max_rounds)


def classify(found: Resolution, marked: DataFrame) -> DataFrame:
    """(repo_id, name, round, reason, parent, status), one row a requested name.

    inline: a primitive; resolved: extracted under this name, in any spelling; max_depth: asked for after the last
    round; marked_unresolvable / not_resolved: no file, with and without a mark ``(repo_id, name)``; extraction_failed:
    its file failed; missing_in_file: the file was extracted and does not hold it.
    """
    have = found.schemas.select("repo_id", F.lower("name").alias("low")).distinct().withColumn("have", F.lit(True))
    flags = marked.select(*NAME).distinct().withColumn("marked", F.lit(True))
    state = found.files.select(*FILE, F.col("ok").alias("file_ok"))
    j = (found.names.withColumn("low", F.lower("name")).join(have, ["repo_id", "low"], "left").join(flags, NAME, "left").join(state, FILE, "left"))
    late = F.lit(False) if found.max_rounds is None else F.col("round") > found.max_rounds
    status = (F.when(primitive_schema(F.col("name")).isNotNull(), "inline").when(F.col("have"), "resolved").when(late, "max_depth")
              .when(F.col("path").isNull() & F.col("marked"), "marked_unresolvable").when(F.col("path").isNull(), "not_resolved")
              .when(~F.col("file_ok"), "extraction_failed").otherwise("missing_in_file"))
    return j.select(*NAME, "round", "reason", "parent", status.alias("status"))
