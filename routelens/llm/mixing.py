"""Mixing sources to target weights by Poisson replication.

Each source gets a mean repetition rate: its target share of the output characters over the
characters it has.  A document's count is the quantile of a Poisson distribution with that mean at
a uniform number hashed from the document and the seed, so it needs no state, does not depend on
partitioning and repeats exactly after a lost executor.  Documents are exploded by their counts and
ordered by a hash of (document, copy, seed), a global shuffle by ranges.

A source's inverse table is its list of cumulative probabilities, computed once per source from
the mean by a running product; sources are joined by name and not broadcast by hint, a hot source is
split by the skew join.  The only driver value is the total, one number.

Defined cases: a null source is a source of its own; null and empty texts count no characters, a
source with no characters gets rate 1; a null id hashes as the empty string; repeated rows share
their count and their copies stand together; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_MEAN = 500.0  # exp(-mean) must stay a normal number; a larger mean is a sum of equal smaller ones
ADDED = ("mix_rate", "mix_count", "mix_copy", "mix_order")
DIGITS = 13       # hexadecimal digits of the hash in a uniform number: 52 bits


def uniform(seed: int, *parts: Column) -> Column:
    """A number in [0, 1) from the MD5 digest of the seed and the parts."""
    text = F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, DIGITS), 16, 10).cast("double") / float(1 << 4 * DIGITS)


def cumulative(mean: Column) -> Column:
    """Array of P(count <= k), k = 0.., up to where doubles no longer tell it from 1.

    The length is a bound in the mean alone: mean + 12 standard deviations + 20.
    """
    top = (mean + 12 * F.sqrt(mean) + 20).cast("int")
    start = F.struct(F.exp(-mean).alias("p"), F.exp(-mean).alias("c"), F.array(F.exp(-mean)).alias("all"))

    def step(acc: Column, k: Column) -> Column:
        p = acc["p"] * mean / k
        return F.struct(p.alias("p"), (acc["c"] + p).alias("c"), F.concat(acc["all"], F.array(acc["c"] + p)).alias("all"))

    return F.aggregate(F.sequence(F.lit(1), top), start, step, lambda acc: acc["all"])


def source_rates(docs: DataFrame, weights: Mapping[str, float] | None, exponent: float, epochs: float,
                 source_col: str = "source", text_col: str = "text") -> DataFrame:
    """(source, chars, rate): the mean count that brings each source to its share of the output.

    ``weights`` gives targets by source name (others weigh nothing); without it a source weighs its
    characters to the power ``exponent``.  The output has about ``epochs`` times the input's characters.
    """
    sizes = (docs.select(F.col(source_col).alias("source"), F.coalesce(F.char_length(text_col), F.lit(0)).alias("n"))
             .groupBy("source").agg(F.sum("n").cast("long").alias("chars")))
    if weights is None:
        weight = F.pow(F.col("chars").cast("double"), F.lit(float(exponent)))
    else:
        weight = F.lit(0.0)
        for name, w in weights.items():
            weight = F.when(F.col("source") == F.lit(name), F.lit(float(w))).otherwise(weight)
    weighed = sizes.withColumn("weight", weight)
    # sums of doubles in a fixed order do not depend on how rows are split: round to integers first
    total, mass = weighed.agg(F.sum("chars"), F.sum(F.round(F.col("weight") * 1e6).cast("decimal(38,0)"))).first()
    if not total or not mass:
        return sizes.withColumn("rate", F.lit(1.0))
    share = F.round(F.col("weight") * 1e6).cast("double") / F.lit(float(mass))
    rate = share * F.lit(float(epochs)) * F.lit(float(total)) / F.col("chars")
    return weighed.select("source", "chars", F.when(F.col("chars") == 0, F.lit(1.0)).otherwise(rate).alias("rate"))


def replicate(docs: DataFrame, weights: Mapping[str, float] | None = None, exponent: float = 0.5,
              epochs: float = 1.0, seed: int = 1, id_col: str = "doc_id", source_col: str = "source",
              text_col: str = "text") -> DataFrame:
    """``docs`` exploded by Poisson counts, plus mix_rate, mix_count, mix_copy and the order mix_order."""
    rates = source_rates(docs, weights, exponent, epochs, source_col, text_col)
    parts = F.greatest(F.ceil(F.col("rate") / F.lit(MAX_MEAN)), F.lit(1)).cast("int")
    tables = rates.select(F.col("source").alias("_src"), F.col("rate").alias("mix_rate"), parts.alias("_parts")).withColumn(
        "_cdf", cumulative(F.col("mix_rate") / F.col("_parts")))
    own = docs.drop("_src", "_cdf", "_u", "_parts", *ADDED).withColumn("_u", uniform(seed, F.col(id_col)))
    joined = own.join(tables, own[source_col].eqNullSafe(tables["_src"]))
    quantile = lambda u: F.size(F.filter("_cdf", lambda c: c <= u)).cast("long")
    more = F.aggregate(F.sequence(F.lit(1), F.col("_parts") - 1), F.lit(0).cast("long"),
                       lambda n, part: n + quantile(uniform(seed, F.col(id_col), F.lit("part"), part)))
    counted = joined.withColumn("mix_count", quantile(F.col("_u")) + F.when(F.col("_parts") > 1, more).otherwise(0))
    copies = counted.where("mix_count > 0").withColumn(
        "mix_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("mix_count"))))
    return (copies.withColumn("mix_order", uniform(seed + 1, F.col(id_col), F.col("mix_copy")))
            .drop("_src", "_cdf", "_u", "_parts"))


def mixed(docs: DataFrame, **options) -> DataFrame:
    """``replicate`` in its global order: ranges of the order key, sorted inside (ties by id and copy)."""
    id_col = options.get("id_col", "doc_id")
    return replicate(docs, **options).orderBy("mix_order", id_col, "mix_copy")
