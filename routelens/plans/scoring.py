"""Scoring bindings.

* Endpoint-style sets: each ``source`` is a repository; a labelled document is
  an "endpoint". Predicted = a rule on ``documents.text``; golden = ``labels``.
* Schema matching: each ``p_type`` is a repository; actual schemas are part
  names with their brands as properties, golden schemas are re-spelled names
  with an overlapping brand set.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from routelens.operators.score import (
    auth_accuracy, missing_extra, name_tokens, optimal_match, pair_components, pair_scores,
    schema_prf_weighted, set_prf,
)
from routelens.plans.catalog import query
from routelens.sources.tables import table

# Prediction rules of the document binding.
JUNK_RE = r"(###|\$\$\$|%%%|\*\*\*|!!)"
ABUSE_RE = r"(idiot|moron|clown|worthless|stupid|loser)"
STRICT_MIN_CHARS = 200


def predictions(spark, sf_dir, strict: bool = False):
    """Labelled documents with rule predictions: ``(repo_id, doc_id, lang, pred_*, quality, toxic)``."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text", "n_chars")
    lab = table(spark, sf_dir, "labels")
    good = ~F.col("text").rlike(JUNK_RE)
    if strict:
        good = good & (F.col("n_chars") >= STRICT_MIN_CHARS)
    return (d.join(lab, "doc_id")
            .select(F.col("source").alias("repo_id"), "doc_id", "lang",
                    good.alias("pred_quality"), F.col("text").rlike(ABUSE_RE).alias("pred_toxic"),
                    (F.col("quality") == 1).alias("quality"), (F.col("toxic") == 1).alias("toxic")))


def repos(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.col("source").alias("repo_id")).distinct()


SQL_PRED = r"""(SELECT d.source AS repo_id, d.doc_id, d.lang,
   NOT regexp_matches(d.text, '(###|\$\$\$|%%%|\*\*\*|!!)') {strict} AS pred_quality,
   regexp_matches(d.text, '(idiot|moron|clown|worthless|stupid|loser)') AS pred_toxic,
   l.quality = 1 AS quality, l.toxic = 1 AS toxic
 FROM documents d JOIN labels l USING (doc_id))"""
PRED = SQL_PRED.format(strict="")
PRED_STRICT = SQL_PRED.format(strict="AND d.n_chars >= 200")

SQL_PRF = """
WITH a AS (SELECT DISTINCT repo_id, {k} FROM {pred} WHERE {acond}),
e AS (SELECT DISTINCT repo_id, {k} FROM {pred} WHERE {econd}),
j AS (SELECT coalesce(a.repo_id, e.repo_id) AS repo_id, a.repo_id IS NOT NULL AS ina, e.repo_id IS NOT NULL AS ine
      FROM a FULL OUTER JOIN e ON a.repo_id = e.repo_id AND {on}),
c AS (SELECT r.repo_id, count(j.repo_id) FILTER (WHERE ina AND ine) AS tp,
             count(j.repo_id) FILTER (WHERE ina AND NOT ine) AS fp,
             count(j.repo_id) FILTER (WHERE NOT ina AND ine) AS fn
      FROM (SELECT DISTINCT source AS repo_id FROM documents) r LEFT JOIN j USING (repo_id) GROUP BY r.repo_id),
m AS (SELECT repo_id, tp, fp, fn,
        CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END AS precision,
        CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END AS recall FROM c)
SELECT repo_id, tp, fp, fn, {p} AS precision, {r} AS recall, {f} AS f1 FROM m"""

_F1 = "CASE WHEN precision + recall = 0 THEN 0.0 ELSE 2 * precision * recall / (precision + recall) END"


def _prf_sql(k, acond, econd, on, empty_perfect=False, pred=PRED):
    if empty_perfect:
        e = "tp + fp + fn = 0"
        p, r, f = (f"CASE WHEN {e} THEN 1.0 ELSE precision END", f"CASE WHEN {e} THEN 1.0 ELSE recall END",
                   f"CASE WHEN {e} THEN 1.0 ELSE {_F1} END")
    else:
        p, r, f = "precision", "recall", _F1
    return SQL_PRF.format(k=k, acond=acond, econd=econd, on=on, p=p, r=r, f=f, pred=pred)


@query("endpoint_prf", sql=_prf_sql("doc_id", "pred_quality", "quality", "a.doc_id = e.doc_id"))
def endpoint_prf(spark, sf_dir):
    """M1: predicted-good vs labelled-good documents per source (TP/FP/FN, P/R/F1)."""
    p = predictions(spark, sf_dir)
    return set_prf(p.where("pred_quality"), p.where("quality"), ["doc_id"], repos(spark, sf_dir))


@query("auth_accuracy", sql="""
WITH a AS (SELECT repo_id, doc_id // 2 AS pair, arg_max(pred_toxic, doc_id) AS ha FROM """ + PRED + """ WHERE pred_quality GROUP BY 1, 2),
e AS (SELECT repo_id, doc_id // 2 AS pair, arg_max(toxic, doc_id) AS he FROM """ + PRED + """ WHERE quality GROUP BY 1, 2),
c AS (SELECT repo_id, count(*) AS total, count(*) FILTER (WHERE ha = he) AS correct,
             count(*) FILTER (WHERE NOT ha AND he) AS missing_auth, count(*) FILTER (WHERE ha AND NOT he) AS spurious_auth
      FROM a JOIN e USING (repo_id, pair) GROUP BY 1)
SELECT r.repo_id, coalesce(total, 0) AS total, coalesce(correct, 0) AS correct,
       coalesce(missing_auth, 0) AS missing_auth, coalesce(spurious_auth, 0) AS spurious_auth,
       CASE WHEN coalesce(total, 0) > 0 THEN correct / total ELSE 0.0 END AS accuracy
FROM (SELECT DISTINCT source AS repo_id FROM documents) r LEFT JOIN c USING (repo_id)""")
def q_auth_accuracy(spark, sf_dir):
    """M2: on pairs of documents both sides call good, agreement of the toxic flag of the last one (0 if none matched)."""
    p = predictions(spark, sf_dir).withColumn("pair", F.floor(F.col("doc_id") / 2))
    a = p.where("pred_quality").select("repo_id", "pair", "doc_id", F.col("pred_toxic").alias("has_auth"))
    e = p.where("quality").select("repo_id", "pair", "doc_id", F.col("toxic").alias("has_auth"))
    return auth_accuracy(a, e, ["pair"], repos=repos(spark, sf_dir), order="doc_id")


@query("scheme_prf", sql=_prf_sql("lower(lang) AS lang", "pred_toxic", "toxic", "a.lang = e.lang", empty_perfect=True))
def scheme_prf(spark, sf_dir):
    """M3: set of languages with abusive documents, predicted vs labelled; both empty = 1.0."""
    p = predictions(spark, sf_dir).withColumn("lang", F.lower("lang"))
    return set_prf(p.where("pred_toxic"), p.where("toxic"), ["lang"], repos(spark, sf_dir), empty_is_perfect=True)


@query("missing_extra", sql="""
WITH a AS (SELECT DISTINCT repo_id, CAST(doc_id AS VARCHAR) AS item FROM """ + PRED + """ WHERE pred_quality),
e AS (SELECT DISTINCT repo_id, CAST(doc_id AS VARCHAR) AS item FROM """ + PRED + """ WHERE quality)
SELECT repo_id, 'missing' AS kind, item FROM (SELECT * FROM e EXCEPT SELECT * FROM a)
UNION ALL SELECT repo_id, 'extra' AS kind, item FROM (SELECT * FROM a EXCEPT SELECT * FROM e)""")
def q_missing_extra(spark, sf_dir):
    """Labelled-good documents the rule missed, and extra ones it accepted."""
    p = predictions(spark, sf_dir)
    return missing_extra(p.where("pred_quality"), p.where("quality"), F.col("doc_id").cast("string"))


def _thousandths(num, den):
    return F.when(den > 0, F.floor((num * 2000 + den) / (den * 2))).otherwise(F.lit(0)).cast("long")


def rollup_scores(prf):
    """M12 core: per-repo rounded (3 dp) P/R/F1 and an unweighted mean row ``__mean__``."""
    t = prf.select("repo_id",
                   _thousandths(F.col("tp"), F.col("tp") + F.col("fp")).alias("p_k"),
                   _thousandths(F.col("tp"), F.col("tp") + F.col("fn")).alias("r_k"),
                   _thousandths(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")).alias("f_k"))
    g = t.rollup("repo_id").agg(F.avg("p_k").alias("p"), F.avg("r_k").alias("r"), F.avg("f_k").alias("f"),
                                F.grouping("repo_id").alias("g"))
    return g.select(F.when(F.col("g") == 1, F.lit("__mean__")).otherwise(F.col("repo_id")).alias("repo_id"),
                    (F.col("p") / 1000.0).alias("precision"), (F.col("r") / 1000.0).alias("recall"),
                    (F.col("f") / 1000.0).alias("f1"))


def _k(num, den):
    return f"(CASE WHEN ({den}) > 0 THEN CAST(floor((({num}) * 2000 + ({den})) / (({den}) * 2)) AS BIGINT) ELSE 0 END)"


SQL_ROLLUP = """
WITH s AS ({prf}),
t AS (SELECT repo_id, {pk} AS p_k, {rk} AS r_k, {fk} AS f_k FROM s)
SELECT coalesce(repo_id, '__mean__') AS repo_id, avg(p_k) / 1000.0 AS precision, avg(r_k) / 1000.0 AS recall,
       avg(f_k) / 1000.0 AS f1
FROM t GROUP BY ROLLUP (repo_id)"""


def _rollup_sql(pred=PRED):
    return SQL_ROLLUP.format(prf=_prf_sql("doc_id", "pred_quality", "quality", "a.doc_id = e.doc_id", pred=pred),
                             pk=_k("tp", "tp + fp"), rk=_k("tp", "tp + fn"), fk=_k("2 * tp", "2 * tp + fp + fn"))


@query("score_rollup", sql=_rollup_sql())
def score_rollup(spark, sf_dir):
    """Per-source rounded scores plus the unweighted mean (round, then average)."""
    p = predictions(spark, sf_dir)
    return rollup_scores(set_prf(p.where("pred_quality"), p.where("quality"), ["doc_id"], repos(spark, sf_dir)))


@query("checkpoint_delta", sql=f"""
WITH c1 AS ({_rollup_sql()}), c2 AS ({_rollup_sql(PRED_STRICT)}),
u AS (SELECT 'cp1' AS checkpoint, precision, recall, f1 FROM c1 WHERE repo_id = '__mean__'
      UNION ALL SELECT 'cp2', precision, recall, f1 FROM c2 WHERE repo_id = '__mean__'),
l AS (UNPIVOT u ON precision, recall, f1 INTO NAME metric VALUE value)
SELECT metric, checkpoint, value, value - lag(value) OVER (PARTITION BY metric ORDER BY checkpoint) AS delta FROM l""")
def checkpoint_delta(spark, sf_dir):
    """Mean metrics at two rule checkpoints and the change between them."""
    def mean(strict, name):
        p = predictions(spark, sf_dir, strict=strict)
        r = rollup_scores(set_prf(p.where("pred_quality"), p.where("quality"), ["doc_id"], repos(spark, sf_dir)))
        return r.where(F.col("repo_id") == "__mean__").select(F.lit(name).alias("checkpoint"), "precision", "recall", "f1")
    u = mean(False, "cp1").unionByName(mean(True, "cp2"))
    long = u.select("checkpoint", F.expr("stack(3, 'precision', precision, 'recall', recall, 'f1', f1) AS (metric, value)"))
    w = Window.partitionBy("metric").orderBy("checkpoint")
    return long.select("metric", "checkpoint", "value", (F.col("value") - F.lag("value").over(w)).alias("delta"))


# ------------------------------------------------------------- schema matching

def part_schemas(spark, sf_dir):
    """(actual, golden) schema tables ``(repo_id, name, props)`` from ``part``."""
    p = table(spark, sf_dir, "part").select("p_name", "p_brand", "p_type", "p_size")
    actual = (p.where(F.col("p_size") <= 25)
              .groupBy(F.col("p_type").alias("repo_id"), F.col("p_name").alias("name"))
              .agg(F.array_sort(F.collect_set(F.lower("p_brand"))).alias("props")))
    gname = F.when(F.length("p_name") % 2 == 0, F.replace(F.col("p_name"), F.lit(" "), F.lit("_"))).otherwise(
        F.split_part(F.col("p_name"), F.lit(" "), F.lit(2)))
    golden = (p.where(F.col("p_size") > 15)
              .groupBy(F.col("p_type").alias("repo_id"), gname.alias("name"))
              .agg(F.array_sort(F.collect_set(F.lower("p_brand"))).alias("props")))
    return actual, golden


SQL_SCHEMAS = r"""
a AS (SELECT p_type AS repo_id, p_name AS name, list_sort(list(DISTINCT lower(p_brand))) AS props
      FROM part WHERE p_size <= 25 GROUP BY 1, 2),
g AS (SELECT p_type AS repo_id, CASE WHEN length(p_name) % 2 = 0 THEN replace(p_name, ' ', '_')
             ELSE split_part(p_name, ' ', 2) END AS name, list_sort(list(DISTINCT lower(p_brand))) AS props
      FROM part WHERE p_size > 15 GROUP BY 1, 2),
pr AS (SELECT a.repo_id, a.name AS a_name, g.name AS e_name,
         list_distinct(regexp_extract_all(lower(a.name), '[a-z]+|[0-9]+', 0)) AS ta,
         list_distinct(regexp_extract_all(lower(g.name), '[a-z]+|[0-9]+', 0)) AS te,
         a.props AS pa, g.props AS pe FROM a JOIN g USING (repo_id)),
sc AS (SELECT repo_id, a_name, e_name,
         CASE WHEN len(list_distinct(list_concat(ta, te))) > 0
              THEN len(list_intersect(ta, te)) / len(list_distinct(list_concat(ta, te))) ELSE 0.0 END AS name_sim,
         CASE WHEN len(pa) + len(pe) > 0 THEN 2 * len(list_intersect(pa, pe)) / (len(pa) + len(pe)) ELSE 0.0 END AS prop_dice,
         len(pe) AS n_pe FROM pr),
s AS (SELECT *, CASE WHEN n_pe = 0 THEN name_sim ELSE 0.3 * name_sim + 0.7 * prop_dice END AS score FROM sc)"""


@query("name_tokens", sql=r"""
SELECT p_partkey, array_to_string(list_sort(list_distinct(regexp_extract_all(lower(p_name || ' ' || p_brand),
       '[a-z]+|[0-9]+', 0))), ',') AS tokens FROM part""")
def q_name_tokens(spark, sf_dir):
    """M5: lower-cased word tokens of ``p_name p_brand`` (sorted for display)."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand")
    return p.select("p_partkey", F.array_join(F.array_sort(name_tokens(F.concat_ws(" ", "p_name", "p_brand"))), ",")
                    .alias("tokens"))


@query("name_jaccard", sql="WITH " + SQL_SCHEMAS.strip() + " SELECT repo_id, a_name, e_name, name_sim FROM s WHERE name_sim > 0")
def q_name_jaccard(spark, sf_dir):
    """M6: token Jaccard of actual vs golden schema names (pairs sharing a token)."""
    a, g = part_schemas(spark, sf_dir)
    s = pair_scores(a, g)
    return s.where(F.col("name_sim") > 0).select("repo_id", "a_name", "e_name", "name_sim")


@query("property_dice", sql="WITH " + SQL_SCHEMAS.strip() + " SELECT repo_id, a_name, e_name, prop_dice FROM s WHERE prop_dice > 0")
def q_property_dice(spark, sf_dir):
    """M7: Dice coefficient of property sets (pairs sharing a property)."""
    a, g = part_schemas(spark, sf_dir)
    s = pair_scores(a, g)
    return s.where(F.col("prop_dice") > 0).select("repo_id", "a_name", "e_name", "prop_dice")


@query("composite_score", sql="WITH " + SQL_SCHEMAS.strip() + " SELECT repo_id, a_name, e_name, score FROM s WHERE score > 0")
def q_composite_score(spark, sf_dir):
    """M8: 0.3 x name Jaccard + 0.7 x property Dice (name only when the golden has no properties)."""
    a, g = part_schemas(spark, sf_dir)
    return pair_scores(a, g).where(F.col("score") > 0).select("repo_id", "a_name", "e_name", "score")


@query("optimal_match")
def q_optimal_match(spark, sf_dir):
    """M9: maximum-weight one-to-one schema matching, solved per connected component of
    the candidate graph (rows-only check; tests compare with brute force)."""
    a, g = part_schemas(spark, sf_dir)
    s = pair_components(pair_scores(a, g).where(F.col("score") > 0))
    return optimal_match(s, component="comp")


@query("schema_prf_weighted")
def q_schema_prf_weighted(spark, sf_dir):
    """Weighted schema precision/recall/F1 from the M9 matches."""
    a, g = part_schemas(spark, sf_dir)
    s = pair_components(pair_scores(a, g).where(F.col("score") > 0))
    return schema_prf_weighted(optimal_match(s, component="comp"), a, g)



@query("f1", sql="""
WITH p AS (SELECT d.lang, l.toxic = 1 AS t, regexp_matches(d.text, '(idiot|moron|clown|worthless|stupid|loser)') AS pr
           FROM documents d JOIN labels l USING (doc_id)),
c AS (SELECT lang, count(*) FILTER (WHERE t AND pr) AS tp, count(*) FILTER (WHERE pr AND NOT t) AS fp,
             count(*) FILTER (WHERE t AND NOT pr) AS fn FROM p GROUP BY 1),
r AS (SELECT lang, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END AS precision,
             CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END AS recall FROM c)
SELECT lang, precision, recall, CASE WHEN precision + recall = 0 THEN 0.0 ELSE 2 * precision * recall / (precision + recall) END AS f1 FROM r""")
def q_f1(spark, sf_dir):
    """Harmonic mean of precision and recall (0 when both are 0), per language of the abuse rule."""
    from routelens.operators.score import f1, ratio
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    p = d.join(table(spark, sf_dir, "labels"), "doc_id").select(
        "lang", (F.col("toxic") == 1).alias("t"), F.col("text").rlike(ABUSE_RE).alias("pr"))
    c = p.groupBy("lang").agg(F.count_if(F.col("t") & F.col("pr")).alias("tp"), F.count_if(F.col("pr") & ~F.col("t")).alias("fp"),
                              F.count_if(F.col("t") & ~F.col("pr")).alias("fn"))
    r = c.select("lang", ratio(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"),
                 ratio(F.col("tp"), F.col("tp") + F.col("fn")).alias("recall"))
    return r.withColumn("f1", f1(F.col("precision"), F.col("recall")))
