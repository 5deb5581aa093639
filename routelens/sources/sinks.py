"""API-description sources and sinks.

A repository's description is stored as JSON Lines: one line per path holding
that path's operations, in files partitioned by ``repo_id``. The document of a
repository is the concatenation of its partition, so writing never gathers a
whole repository into one task, and reading splits like any other JSON source.
YAML output is produced per line with ``mapInPandas``; gzip is a writer option.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from routelens.functions.paths import path_score_key
from routelens.session import checkpoint_dir

HTTP_VERBS = ("get", "post", "put", "patch", "delete", "head", "options")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder under the cluster's shared checkpoint location."""
    return os.path.join(checkpoint_dir(spark), f"{name}-{uuid.uuid4().hex[:10]}")


def spec_lines(ops: DataFrame) -> DataFrame:
    """S10 body: ``(repo_id, path, item)``; ``item`` is the JSON object ``{method: operation}``.

    Grouping is by (repo, path), at most seven methods per group.
    """
    op = F.struct(F.col("operation_id").alias("operationId"), F.col("security").alias("security"),
                  F.col("responses").alias("responses"))
    g = ops.groupBy("repo_id", "path").agg(F.map_from_entries(F.collect_list(F.struct(F.lower("method"), op))).alias("m"))
    return g.select("repo_id", "path", F.to_json("m").alias("item"))


def write_spec(lines: DataFrame, out_dir: str, fmt: str = "json", compression: str | None = None) -> str:
    """Write spec lines partitioned by repository (``json`` or ``yaml``)."""
    if fmt == "yaml":
        def to_yaml(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            import json

            import yaml
            for pdf in batches:
                text = [yaml.safe_dump({p: json.loads(i)}, sort_keys=False, allow_unicode=True)
                        for p, i in zip(pdf["path"], pdf["item"])]
                yield pd.DataFrame({"repo_id": pdf["repo_id"], "value": text})
        w = lines.mapInPandas(to_yaml, "repo_id string, value string").write
    else:
        w = lines.select("repo_id", F.to_json(F.struct("path", F.col("item"))).alias("value")).write
    if compression:
        w = w.option("compression", compression)
    w.mode("overwrite").partitionBy("repo_id").text(out_dir)
    return out_dir


def spec_load(spark: SparkSession, spec_dir: str) -> DataFrame:
    """Read spec lines back and list ``(repo_id, METHOD, P5 path)`` for the seven HTTP verbs."""
    raw = spark.read.text(spec_dir)  # repo_id comes back from the partition folders
    parsed = raw.select("repo_id", F.from_json("value", "path string, item string").alias("l"))
    ops = parsed.select("repo_id", "l.path", F.explode(F.from_json("l.item", "map<string,string>")).alias("method", "op"))
    ops = ops.where(F.lower("method").isin(*HTTP_VERBS))
    return ops.select("repo_id", F.upper("method").alias("method"), path_score_key(F.col("path")).alias("path"), "op")


def golden_load(golden_json: DataFrame, id_cols=("repo_id",)) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Golden endpoints, schemas and security schemes from JSON documents.

    Schema entries are either a bare name or ``{name, properties}`` (properties
    default to empty). Parsed as VARIANT so both shapes share one column.
    """
    v = golden_json.select(*id_cols, F.parse_json("golden").alias("g"))
    eps = v.select(*id_cols, F.explode(F.expr("cast(variant_get(g, '$.endpoints') as array<variant>)")).alias("e")).select(
        *id_cols, F.upper(F.expr("variant_get(e, '$.method', 'string')")).alias("method"),
        F.expr("variant_get(e, '$.path', 'string')").alias("path"),
        F.coalesce(F.expr("variant_get(e, '$.has_auth', 'boolean')"), F.lit(False)).alias("has_auth"))
    sch = v.select(*id_cols, F.explode(F.expr("cast(variant_get(g, '$.schemas') as array<variant>)")).alias("s"))
    is_obj = F.expr("schema_of_variant(s)").startswith("OBJECT")
    sch = sch.select(*id_cols,
                     F.lower(F.when(is_obj, F.expr("variant_get(s, '$.name', 'string')")).otherwise(F.expr("cast(s as string)"))).alias("name"),
                     F.when(is_obj, F.coalesce(F.expr("variant_get(s, '$.properties', 'array<string>')"),
                                               F.array().cast("array<string>"))).otherwise(F.array().cast("array<string>")).alias("properties"))
    sec = v.select(*id_cols, F.explode(F.expr("cast(variant_get(g, '$.security_schemes') as array<variant>)")).alias("x")).select(
        *id_cols, F.lower(F.expr("variant_get(x, '$.name', 'string')")).alias("name"),
        F.lower(F.expr("variant_get(x, '$.type', 'string')")).alias("type"))
    return eps, sch, sec


def artifact_sink(artifacts: dict[str, DataFrame], out_dir: str) -> int:
    """Append every artifact as a parquet table under ``run_id = max(run_id) + 1``.

    The next run id comes from one aggregate over the existing partition column;
    earlier runs are never overwritten.
    """
    spark = next(iter(artifacts.values())).sparkSession
    runs = os.path.join(out_dir, "_runs")
    try:
        prev = spark.read.parquet(runs).agg(F.max("run_id")).first()[0] or 0
    except AnalysisException as e:  # first run: nothing written yet; any other error stops the sink
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        prev = 0
    run = int(prev) + 1
    for name, df in artifacts.items():
        # dynamic partition overwrite: a retried run replaces only its own partition
        (df.withColumn("run_id", F.lit(run)).write.option("partitionOverwriteMode", "dynamic").mode("overwrite")
         .partitionBy("run_id").parquet(os.path.join(out_dir, name)))
    # the run is registered last, so an interrupted run is retried under the same id
    spark.createDataFrame([(run,)], "run_id int").write.mode("append").parquet(runs)
    return run
