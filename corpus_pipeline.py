"""From raw documents to packed training windows, one operator after the other.

Each stage takes (spark, docs, sf_dir) and returns a table that is written as Parquet and read again
as the next stage's ``docs``.  All stages but the last return the columns of ``docs``.

1. toxicity: documents that the class-conditional models predict toxic go.
2. near_duplicates: of each group of near-duplicates the smallest id stays.
3. repeated_passages: 50-byte strings that a smaller document holds too are cut out of the texts;
   ``n_chars`` follows the text.
4. mixing: documents are replicated towards the square root of their sources' sizes and shuffled.
5. packing: what is left is encoded and packed into windows of 2048 ids.

Defined cases, as in the operators: null texts are empty; rows with a null id pass the filters; rows
that share an id stay or go together; an empty table gives an empty result; further columns of the
documents pass through the first four stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from routelens.llm import minhash_dedup, mixing, packing, suffix_dedup, toxicity
from routelens.llm.common import stage
from routelens.llm.queries import MIX, PACK_END, WINDOW_TOKENS
from routelens.llm.tokens import vocabulary_path

ORACLE_SQL = None  # the toxicity model and the tokenizer cannot be stated in SQL


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: rows predicted toxic are dropped; texts are scored where they are read."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.keep_ordinary(docs, toxicity.fit(docs, labels))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: rows whose id is not its component's smallest are dropped."""
    return minhash_dedup.drop_near_duplicates(docs, width=5, percent=75)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: texts lose the bytes that smaller documents hold."""
    cut = suffix_dedup.remove_repeats(docs, width=50)
    if "n_chars" in docs.columns:
        cut = cut.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return cut


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: Poisson copies in a global random order."""
    return mixing.mixed(docs, **MIX).select(*docs.columns)


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: pieces of 2048-id windows."""
    return packing.pack(docs, WINDOW_TOKENS, vocabulary_path(), PACK_END)


STAGES = [
    ("toxicity", reject_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("repeated_passages", cut_repeated_passages),
    ("mixing", mix_sources),
    ("packing", pack_windows),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is a table in the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, function in STAGES:
        docs = stage(function(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
