"""The resolution loop (G11, G12, G17) on the table graph.

Types are customers, suppliers, nations, regions and parts; five neighbouring keys share a file.  The index does not
know parts of type PROMO and suppliers in debt; files that hold a part of Brand#13 fail, parts of size 50 are
not found in their files.  References are the graph's edges, and regions name a primitive; some parts are subtypes of
suppliers.  PROMO parts smaller than 10 are marked unresolvable.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from routelens.operators import loop as L
from routelens.plans.catalog import made_once, query
from routelens.plans.graph import REPO, SQL_EDGES, ref_edges
from routelens.sources.tables import table

MAX_ROUNDS = 2  # what the second round finds is left over

SQL_SEEDS = """(SELECT 'customer_' || c_custkey AS node FROM customer WHERE c_acctbal > 9000
  UNION SELECT 'part_' || p_partkey FROM part WHERE p_size IN (1, 2, 50) AND p_retailprice < 950 UNION SELECT 'String' FROM part)"""


def seeds(spark, sf_dir):
    """Requested names: rich customers, some parts, a primitive."""
    c = table(spark, sf_dir, "customer").where("c_acctbal > 9000").select(F.concat(F.lit("customer_"), F.col("c_custkey").cast("string")).alias("name"))
    p = table(spark, sf_dir, "part").where("p_size in (1, 2, 50) and p_retailprice < 950").select(F.concat(F.lit("part_"), F.col("p_partkey").cast("string")).alias("name"))
    plain = table(spark, sf_dir, "part").select(F.lit("String").alias("name")).distinct()
    return c.unionByName(p).unionByName(plain).withColumn("repo_id", F.lit(REPO))


def _types(spark, sf_dir):
    """(name, path, known, held, fails) of every type."""
    def rows(name, key, prefix, known, held, fails):
        return table(spark, sf_dir, name).select(
            F.concat(F.lit(prefix + "_"), F.col(key).cast("string")).alias("name"), F.concat(F.lit(prefix + "/"), F.floor(F.col(key) / 5).cast("string")).alias("path"),
            known.alias("known"), held.alias("held"), fails.alias("fails"))
    yes, no = F.lit(True), F.lit(False)
    out = rows("part", "p_partkey", "part", F.col("p_type") != "PROMO", F.col("p_size") != 50, F.col("p_brand") == "Brand#13")
    for args in (("customer", "c_custkey", "customer", yes), ("supplier", "s_suppkey", "supplier", F.col("s_acctbal") >= 0),
                 ("nation", "n_nationkey", "nation", yes), ("region", "r_regionkey", "region", yes)):
        out = out.unionByName(rows(*args, yes, no))
    return out.withColumn("repo_id", F.lit(REPO))


def resolution(spark, sf_dir):
    def run():
        t = _types(spark, sf_dir)
        index = t.where("known").select("repo_id", "name", "path")
        bad = t.groupBy("repo_id", "path").agg(F.bool_or("fails").alias("fails"))
        j = t.join(bad.withColumnRenamed("fails", "bad"), ["repo_id", "path"])
        extracted = j.where("known and held and not bad").select("repo_id", "path", "name", F.lit(True).alias("ok")).unionByName(
            bad.select("repo_id", "path", F.lit(None).cast("string").alias("name"), (~F.col("fails")).alias("ok")))
        refs = ref_edges(spark, sf_dir).select("repo_id", F.col("src").alias("name"), F.col("dst").alias("target"))
        refs = refs.unionByName(t.where("name like 'region%'").select("repo_id", "name", F.lit("String").alias("target")))
        li = table(spark, sf_dir, "lineitem").where((F.col("l_partkey") + F.col("l_suppkey")) % 5 == 0)
        inherits = li.select(F.lit(REPO).alias("repo_id"), F.concat(F.lit("supplier_"), F.col("l_suppkey").cast("string")).alias("name"),
                             F.concat(F.lit("part_"), F.col("l_partkey").cast("string")).alias("child"))
        return L.resolution_loop(seeds(spark, sf_dir), index, extracted, refs, inherits, MAX_ROUNDS)
    return made_once(spark, "resolution", sf_dir, run)


SQL_LOOP = f"""ty AS (SELECT 'part_' || p_partkey AS name, 'part/' || (p_partkey // 5) AS path, p_type <> 'PROMO' AS known, p_size <> 50 AS held,
     p_brand = 'Brand#13' AS fails, p_type = 'PROMO' AND p_size < 10 AS marked FROM part
  UNION ALL SELECT 'customer_' || c_custkey, 'customer/' || (c_custkey // 5), true, true, false, false FROM customer
  UNION ALL SELECT 'supplier_' || s_suppkey, 'supplier/' || (s_suppkey // 5), s_acctbal >= 0, true, false, false FROM supplier
  UNION ALL SELECT 'nation_' || n_nationkey, 'nation/' || (n_nationkey // 5), true, true, false, false FROM nation
  UNION ALL SELECT 'region_' || r_regionkey, 'region/' || (r_regionkey // 5), true, true, false, false FROM region),
bad AS (SELECT path, bool_or(fails) AS bad FROM ty GROUP BY 1),
ix AS (SELECT name, path FROM ty WHERE known),
ext AS (SELECT name, path FROM ty JOIN bad USING (path) WHERE known AND held AND NOT bad),
links AS (SELECT DISTINCT src, dst, 'ref' AS reason FROM {SQL_EDGES} UNION SELECT name, 'String', 'ref' FROM ty WHERE name LIKE 'region%'
  UNION SELECT DISTINCT 'supplier_' || l_suppkey, 'part_' || l_partkey, 'subtype' FROM lineitem WHERE (l_partkey + l_suppkey) % 5 = 0),
onward AS (SELECT DISTINCT ext.path AS src, ix.path AS dst FROM ext JOIN links l ON l.src = ext.name JOIN ix ON ix.name = l.dst),
walk(path, r) AS (SELECT DISTINCT ix.path, 1 FROM {SQL_SEEDS} s JOIN ix ON ix.name = s.node
  UNION SELECT o.dst, w.r + 1 FROM walk w JOIN onward o ON o.src = w.path WHERE w.r < {MAX_ROUNDS}),
fr AS (SELECT path, min(r) AS r FROM walk GROUP BY 1),
sch AS (SELECT ext.name, fr.r FROM ext JOIN fr USING (path)),
cand AS (SELECT l.dst AS name, s.r + 1 AS round, l.reason, l.src AS parent FROM sch s JOIN links l ON l.src = s.name),
low AS (SELECT name, min(round) AS round FROM cand GROUP BY 1),
req AS (SELECT node AS name, 1 AS round, 'request' AS reason, NULL::VARCHAR AS parent FROM {SQL_SEEDS}
  UNION ALL SELECT c.name, c.round, min((c.reason, c.parent))[1], min((c.reason, c.parent))[2] FROM cand c JOIN low USING (name, round)
    WHERE c.name NOT IN (SELECT node FROM {SQL_SEEDS}) AND NOT EXISTS (SELECT 1 FROM sch WHERE sch.name = c.name AND sch.r < c.round) GROUP BY 1, 2)"""


@query("resolution_loop", sql=f"WITH RECURSIVE {SQL_LOOP} SELECT '{REPO}' AS repo_id, name, round, reason, parent FROM req")
def q_resolution_loop(spark, sf_dir):
    """G11 with G12: every requested name with its round, and the schema and reason that led to it."""
    return resolution(spark, sf_dir).names.select("repo_id", "name", "round", "reason", "parent")


@query("resolution_files", sql=f"WITH RECURSIVE {SQL_LOOP} SELECT '{REPO}' AS repo_id, path, r AS round, NOT bad AS ok FROM fr JOIN bad USING (path)")
def q_resolution_files(spark, sf_dir):
    """The files the loop extracted, each once, in the round that asked for them."""
    return resolution(spark, sf_dir).files


@query("unresolved_classify", sql=f"""WITH RECURSIVE {SQL_LOOP}
SELECT '{REPO}' AS repo_id, q.name, CASE WHEN lower(q.name) = 'string' THEN 'inline' WHEN s.name IS NOT NULL THEN 'resolved'
  WHEN q.round > {MAX_ROUNDS} THEN 'max_depth' WHEN ix.path IS NULL AND m.marked THEN 'marked_unresolvable' WHEN ix.path IS NULL THEN 'not_resolved'
  WHEN bad.bad THEN 'extraction_failed' ELSE 'missing_in_file' END AS status
FROM req q LEFT JOIN sch s ON s.name = q.name LEFT JOIN ix ON ix.name = q.name LEFT JOIN bad ON bad.path = ix.path LEFT JOIN ty m ON m.name = q.name""")
def q_unresolved_classify(spark, sf_dir):
    """One status a requested name, folded from the loop's own record."""
    marked = table(spark, sf_dir, "part").where((F.col("p_type") == "PROMO") & (F.col("p_size") < 10)).select(
        F.lit(REPO).alias("repo_id"), F.concat(F.lit("part_"), F.col("p_partkey").cast("string")).alias("name"))
    return L.classify(resolution(spark, sf_dir), marked).select("repo_id", "name", "status")
