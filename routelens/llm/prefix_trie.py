"""Prefix trie of rebuilt conversations by whole-sequence collapse.

Conversations are rebuilt so that neighbours share their first turns: the first ``h`` turns of a
conversation come from its block's base, ``h`` hashed from its id.  Identical rebuilt conversations are
collapsed into one weighted sequence, named by its smallest conversation; sequences that are proper
prefixes of others are dropped by an anti-join, what is left are the leaves; the weighted prefixes are
then summed into nodes.  The root is the empty prefix.

A node is keyed by its depth and two 64-bit lanes, the running exclusive-or of hashes of (depth, SHA-256
of the turn); it is named by (conv_id, depth), conv_id being its smallest member.  Every node belongs to
the sequence of that member.  The nodes of one sequence are a stretch of its path down to its end, so sums
over a subtree need no pair of node and ancestor: they are the totals of all sequences through the node,
less what its own sequence holds above it.

Plan: texts cross one shuffle, to be numbered inside their conversation (a streaming, spilling window);
after it only digests travel.  Sums per node are hash aggregates with map-side partial sums, so a prefix
that a third of all conversations share is no hot task.  Node tables meet by their unique key; the join of
children with their parents may have a hot key, which AQE splits.  End lists are kept in blocks of at most
``BLOCK`` members.

Defined cases: turns are ordered by (turn, role, text), null turns first; null role or text is empty;
repeated rows are turns of their own; rows with a null conversation id take no part; a conversation without
rebuilt turns is a member of the root only; an empty table has no node; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stage

BLOCK = 4096  # members in one row of an end list
KEY = ["depth", "k1", "k2"]
WORD = r"[^\x20\x09-\x0D]+"


def head_turns(conv_id: Column, most: int) -> Column:
    """How many turns a conversation takes from its base: 0 to ``most``."""
    return (F.crc32(conv_id.cast("string").cast("binary")) % (most + 1)).cast("long")


def rebuild(conversations: DataFrame, every: int = 20, most: int = 3) -> tuple[DataFrame, DataFrame]:
    """Rebuilt turns (conv_id, depth, digest, n_words, source_conv, source_pos) and all ids (conv_id, n_own)."""
    role = F.coalesce(F.col("role").cast("string"), F.lit(""))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn",
                                                             role.alias("role"), text.alias("text"))
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    own = stage(rows.select(
        "conv_id", F.row_number().over(order).cast("long").alias("pos"),
        F.sha2(F.concat(F.char_length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"), 256).alias("digest"),
        F.regexp_count("text", F.lit(WORD)).cast("long").alias("n_words")), "trie-turns")
    convs = own.groupBy("conv_id").agg(F.max("pos").alias("n_own")).withColumns(
        {"base": F.col("conv_id") - F.col("conv_id") % every, "h": head_turns(F.col("conv_id"), most)})
    bases = convs.select(F.col("conv_id").alias("base"), F.col("n_own").alias("n_base"))
    convs = convs.join(bases, "base", "left").withColumn("k", F.least("h", F.coalesce("n_base", F.lit(0))))
    heads = own.where(F.col("pos") <= most).withColumnRenamed("conv_id", "base").join(convs.select("conv_id", "base", "k"), "base")
    heads = heads.where(F.col("pos") <= F.col("k")).select(
        "conv_id", F.col("pos").alias("depth"), "digest", "n_words", F.col("base").alias("source_conv"), F.col("pos").alias("source_pos"))
    rest = own.where(F.col("pos") > head_turns(F.col("conv_id"), most)).join(convs.select("conv_id", "h", "k"), "conv_id").select(
        "conv_id", (F.col("pos") - F.col("h") + F.col("k")).alias("depth"), "digest", "n_words",
        F.col("conv_id").alias("source_conv"), F.col("pos").alias("source_pos"))
    return heads.unionByName(rest), convs.select("conv_id", "n_own")


@dataclass
class Trie:
    """``nodes``: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and the key.
    ``ends``: key, block, members; the conversations that end at a node, ascending in and over the blocks."""
    nodes: DataFrame
    ends: DataFrame


def _prefixes(turns: DataFrame, ids: DataFrame) -> DataFrame:
    """(conv_id, depth, k1, k2, x1, x2, n_words): every prefix of every conversation, the empty one at depth 0."""
    upto = Window.partitionBy("conv_id").orderBy("depth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    lanes = {f"x{i}": F.xxhash64(F.lit(i), "depth", "digest") for i in (1, 2)}
    keyed = turns.withColumns(lanes).select("conv_id", "depth", F.bit_xor("x1").over(upto).alias("k1"),
                                            F.bit_xor("x2").over(upto).alias("k2"), "x1", "x2", "n_words")
    zero = F.lit(0).cast("long")
    root = ids.select("conv_id", zero.alias("depth"), zero.alias("k1"), zero.alias("k2"), zero.alias("x1"), zero.alias("x2"), zero.alias("n_words"))
    return keyed.unionByName(root)


def prefix_trie(turns: DataFrame, ids: DataFrame) -> Trie:
    """The trie of sequences given as turns (conv_id, depth from 1, digest, n_words); ``ids`` names all of them."""
    prefixes = stage(_prefixes(turns, ids.select("conv_id")), "trie-prefixes")
    whole = prefixes.groupBy("conv_id").agg(F.max_by(F.struct(*KEY), "depth").alias("end")).select("conv_id", "end.*")
    ends = whole.groupBy(*KEY, F.floor(F.col("conv_id") / BLOCK).alias("block")).agg(F.sort_array(F.collect_list("conv_id")).alias("members"))

    # identical conversations collapse into one weighted sequence
    sequences = whole.groupBy(*KEY).agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("weight"))
    paths = prefixes.join(sequences.select("conv_id", "weight", F.col("depth").alias("length")), "conv_id")
    proper = paths.where(F.col("depth") < F.col("length")).select(*KEY).distinct()
    leaves = sequences.join(proper, KEY, "left_anti").select("conv_id", F.lit(1).cast("long").alias("leaf"))
    paths = stage(paths.join(leaves, "conv_id", "left").select(
        "conv_id", *KEY, "x1", "x2", "n_words", "weight", F.coalesce("leaf", F.lit(0).cast("long")).alias("leaf")), "trie-paths")

    # weighted prefixes
    nodes = paths.groupBy(*KEY).agg(
        F.min("conv_id").alias("conv_id"), F.sum("weight").alias("n_convs"), F.sum("leaf").alias("n_leaves"),
        F.max("n_words").alias("n_words"), F.max("x1").alias("x1"), F.max("x2").alias("x2"))
    nodes = stage(nodes.select(
        "conv_id", *KEY, "n_convs", "n_leaves", ((F.col("n_convs") - 1) * F.col("n_words")).alias("saved"),
        (F.col("depth") - 1).alias("p_depth"), F.col("k1").bitwiseXOR(F.col("x1")).alias("p1"),
        F.col("k2").bitwiseXOR(F.col("x2")).alias("p2")), "trie-nodes")
    held = nodes.groupBy("conv_id").agg(F.sum("saved").alias("held"))
    through = paths.join(held, "conv_id").groupBy(*KEY).agg(F.sum("held").alias("through"))
    children = nodes.where("depth > 0").groupBy(F.col("p_depth").alias("depth"), F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(
        F.count(F.lit(1)).alias("n_children"))
    above = Window.partitionBy("conv_id").orderBy("depth").rowsBetween(Window.unboundedPreceding, -1)
    full = (nodes.withColumn("above", F.coalesce(F.sum("saved").over(above), F.lit(0).cast("long")))
            .join(through, KEY).join(children, KEY, "left"))
    parents = nodes.select(F.col("depth").alias("p_depth"), F.col("k1").alias("p1"), F.col("k2").alias("p2"),
                           F.col("conv_id").alias("parent_conv_id"))
    out = full.join(parents, ["p_depth", "p1", "p2"], "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0).cast("long")).alias("n_children"),
        "n_leaves", (F.col("through") - F.col("above")).alias("saved_tokens"), "k1", "k2")
    return Trie(out, ends)


def _digest_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks sorted by key and block, joined by commas and hashed as they pass."""
    names = [*KEY, "ends_sha256"]
    now, digest = None, None
    for batch in batches:
        done = []
        for *key, text in zip(*(batch.column(i).to_pylist() for i in range(4))):
            if key != now:
                if now is not None:
                    done.append((*now, digest.hexdigest()))
                now, digest = key, hashlib.sha256()
            else:
                digest.update(b",")
            digest.update(text.encode())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done)], names)
    if now is not None:
        yield pa.RecordBatch.from_arrays([pa.array([v]) for v in (*now, digest.hexdigest())], names)


def end_digests(ends: DataFrame) -> DataFrame:
    """(depth, k1, k2, ends_sha256): a node's members as decimal ids, joined by commas; one block in memory at a time."""
    joined = ends.select(*KEY, F.array_join(F.col("members").cast("array<string>"), ",").alias("text"), "block")
    return joined.repartition(*KEY).sortWithinPartitions(*KEY, "block").mapInArrow(
        _digest_rows, "depth long, k1 long, k2 long, ends_sha256 string")


def node_turns(trie: Trie, turns: DataFrame) -> DataFrame:
    """Nodes with the conversation and position of the turn that stands for their last one (null at the root)."""
    at = turns.select("conv_id", "depth", "source_conv", "source_pos")
    return trie.nodes.join(at, ["conv_id", "depth"], "left")


def node_report(conversations: DataFrame, every: int = 20, most: int = 3) -> DataFrame:
    """One row a node of the rebuilt conversations, with the digest of its end list."""
    turns, ids = rebuild(conversations, every, most)
    trie = prefix_trie(turns, ids)
    nothing = hashlib.sha256(b"").hexdigest()
    return trie.nodes.join(end_digests(trie.ends), KEY, "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(nothing)).alias("ends_sha256"))
