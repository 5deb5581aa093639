"""Source/sink bindings (S8-S12): write API descriptions derived from the tables
into the shared checkpoint folder, read them back, and check the round trip."""

from __future__ import annotations

from pyspark.sql import functions as F

from routelens.plans.catalog import query
from routelens.plans.schema import SQL_KEPT, kept_ops
from routelens.sources import sinks as S
from routelens.sources.tables import table


def _written(spark, sf_dir, fmt="json", compression=None):
    out = S.shared_folder(spark, "spec")
    S.write_spec(S.spec_lines(kept_ops(spark, sf_dir)), out, fmt=fmt, compression=compression)
    return out


@query("spec_sink", sql=f"""
SELECT repo_id, path, string_agg(lower(method), ',' ORDER BY lower(method)) AS methods FROM {SQL_KEPT} GROUP BY 1, 2""")
def q_spec_sink(spark, sf_dir):
    """One JSON line per (repo, path) written partitioned by repository, read back."""
    out = _written(spark, sf_dir)
    r = spark.read.text(out).select("repo_id", F.from_json("value", "path string, item string").alias("l"))
    return r.select("repo_id", "l.path", F.array_join(F.array_sort(F.map_keys(F.from_json("l.item", "map<string,string>"))), ",")
                    .alias("methods"))


@query("spec_load", sql=f"""
SELECT DISTINCT repo_id, upper(method) AS method, regexp_replace(CASE WHEN lower(regexp_replace(path, '/+$', '')) = '' THEN '/'
  ELSE lower(regexp_replace(path, '/+$', '')) END, '\\{{[^}}]+\\}}', '{{_}}', 'g') AS path FROM {SQL_KEPT}""")
def q_spec_load(spark, sf_dir):
    """A written description loaded back as (repo, METHOD, normalised path) for the seven verbs."""
    return S.spec_load(spark, _written(spark, sf_dir)).select("repo_id", "method", "path").distinct()


@query("compressed_sink", sql=f"SELECT repo_id, count(DISTINCT path) AS n_paths FROM {SQL_KEPT} GROUP BY 1")
def q_compressed_sink(spark, sf_dir):
    """The gzip-compressed description, read back (paths per repository)."""
    out = _written(spark, sf_dir, compression="gzip")
    return spark.read.text(out).groupBy("repo_id").agg(F.count(F.lit(1)).alias("n_paths"))


@query("spec_sink_yaml", sql=f"SELECT repo_id, count(DISTINCT path) AS n_paths FROM {SQL_KEPT} GROUP BY 1")
def q_spec_sink_yaml(spark, sf_dir):
    """S10 (YAML): per-path YAML documents written by ``mapInPandas``; path keys counted back."""
    out = _written(spark, sf_dir, fmt="yaml")
    lines = spark.read.text(out)
    return lines.where(F.col("value").startswith("/")).groupBy("repo_id").agg(F.count(F.lit(1)).alias("n_paths"))


@query("artifact_sink", sql=f"""
WITH k AS {SQL_KEPT}
SELECT 'endpoints' AS artifact, r AS run_id, (SELECT count(*) FROM k) AS n_rows FROM (VALUES (1), (2)) t(r)
UNION ALL SELECT 'repos', r, (SELECT count(DISTINCT repo_id) FROM k) FROM (VALUES (1), (2)) t(r)""")
def q_artifact_sink(spark, sf_dir):
    """Two runs of the artifact writer land in run_id 1 and 2, never overwriting."""
    out = S.shared_folder(spark, "artifacts")
    k = kept_ops(spark, sf_dir).select("repo_id", "path", "method")
    arts = {"endpoints": k, "repos": k.select("repo_id").distinct()}
    S.artifact_sink(arts, out)
    S.artifact_sink(arts, out)
    res = None
    for name in arts:
        d = spark.read.parquet(f"{out}/{name}").groupBy("run_id").agg(F.count(F.lit(1)).alias("n_rows"))
        d = d.select(F.lit(name).alias("artifact"), "run_id", "n_rows")
        res = d if res is None else res.unionByName(d)
    return res


def golden_docs(spark, sf_dir):
    """Golden JSON per labelled document (schemas alternate between bare names and objects)."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars")
    lab = table(spark, sf_dir, "labels")
    j = d.join(lab, "doc_id")
    ep = F.to_json(F.array(F.struct(F.lit("get").alias("method"), F.concat(F.lit("/docs/"), F.col("doc_id").cast("string")).alias("path"),
                                    (F.col("toxic") == 1).alias("has_auth"))))
    sch = F.when(F.col("doc_id") % 2 == 0, F.to_json(F.array(F.initcap("lang")))).otherwise(
        F.to_json(F.array(F.struct(F.concat(F.lit("Doc"), F.col("source")).alias("name"),
                                   F.array(F.initcap("lang"), F.lit("N_chars")).alias("properties")))))
    sec = F.to_json(F.array(F.struct(F.lit("BearerAuth").alias("name"), F.lit("HTTP").alias("type"))))
    golden = F.concat(F.lit('{"endpoints":'), ep, F.lit(',"schemas":'), sch, F.lit(',"security_schemes":'), sec, F.lit("}"))
    return j.select(F.col("source").alias("repo_id"), "doc_id", golden.alias("golden"))


@query("golden_load", sql="""
SELECT d.source AS repo_id, d.doc_id, CASE WHEN d.doc_id % 2 = 0 THEN lower(d.lang) ELSE lower('Doc' || d.source) END AS name,
       CASE WHEN d.doc_id % 2 = 0 THEN '' ELSE lower(d.lang) || ',n_chars' END AS properties, 1 AS n_endpoints, 1 AS n_schemes
FROM documents d JOIN labels l USING (doc_id)""")
def q_golden_load(spark, sf_dir):
    """Golden JSON parsed as VARIANT; schema entries may be a bare name or {name, properties}."""
    g = golden_docs(spark, sf_dir)
    eps, sch, sec = S.golden_load(g, id_cols=("repo_id", "doc_id"))
    ne = eps.groupBy("repo_id", "doc_id").agg(F.count(F.lit(1)).alias("n_endpoints"))
    ns = sec.groupBy("repo_id", "doc_id").agg(F.count(F.lit(1)).alias("n_schemes"))
    s = sch.select("repo_id", "doc_id", "name", F.array_join(F.transform("properties", F.lower), ",").alias("properties"))
    return s.join(ne, ["repo_id", "doc_id"]).join(ns, ["repo_id", "doc_id"])
