"""Embedding near-duplicates: random-hyperplane sign hashing, exact cosines, connected components.

Vectors with the same components are one class; its smallest id goes on.  Each of several tables
hashes a vector to the signs of its products with random hyperplanes; the number of signs follows
the number of vectors, so buckets keep their size, and the number of tables follows from it and the
wanted chance to meet a pair at the threshold.  Vectors that share a bucket are compared in blocks
by exact cosines in double precision.  A pair is counted in the first table in which it meets, which
both vectors' signs tell, so pairs are neither written nor made distinct: a block returns each
vector's number of links and a spanning forest of them, both no longer than the block.

Crowded buckets are cut into blocks of bounded size, and every pair of blocks is a group of its own.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components link with
nothing (0 links, a component of their own); vectors of different lengths are not compared; a null
id takes no part (0 links, component null, kept true); rows that share an id and a vector count
once, rows that share an id with different vectors are linked as one id; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U, constants, ids_of, mix, signed, stage
from .components import connected_components

BUCKET_ROWS = 24     # vectors a bucket holds when directions are spread evenly
BLOCK = 2048
RECALL = 0.999       # chance to meet a pair whose cosine is just the threshold


def table_shape(vectors: int, threshold: float, recall: float = RECALL) -> tuple[int, int]:
    """(signs per table, tables) for a number of vectors."""
    bits = max(6, min(60, math.ceil(math.log2(max(2, vectors) / BUCKET_ROWS))))
    agree = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, math.ceil(math.log(1 - recall) / math.log(1 - agree))


def valid_vectors(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, v) of the vectors that take part: components as doubles, finite, not all zero."""
    v = F.col(vector_col).cast("array<double>")
    named = vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v"))
    fine = F.forall("v", lambda x: x.isNotNull() & (F.abs(x) < float("inf")) & ~F.isnan(x))
    return named.where("vec_id is not null and v is not null and size(v) > 0").where(fine).where(
        F.exists("v", lambda x: x != 0))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().reshape(len(column), -1)


def _unit(v: np.ndarray) -> np.ndarray:
    v = v / np.abs(v).max(axis=1, keepdims=True)  # no overflow in the norm
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def _hashed(reps: DataFrame, bits: int, tables: int, seed: int) -> DataFrame:
    """(vec_id, weight, v, keys): the bucket of each table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salt = constants(tables, seed)
        planes: dict[int, np.ndarray] = {}
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                part = batch.slice(lo, 1024)
                size = pa.compute.list_value_length(part.column(2)).to_numpy()
                for dim in np.unique(size):
                    rows = part.filter(pa.array(size == dim))
                    if dim not in planes:
                        planes[dim] = np.random.default_rng([seed, int(dim)]).standard_normal((int(dim), tables * bits))
                    sign = (_unit(_matrix(rows.column(2))) @ planes[dim] >= 0).reshape(rows.num_rows, tables, bits)
                    code = sign.astype(np.uint64) @ (U(1) << np.arange(bits, dtype=np.uint64))
                    keys = signed(mix(mix(code * salt + salt) + U(dim)))
                    yield pa.RecordBatch.from_arrays(
                        [*rows.columns, pa.ListArray.from_arrays(
                            pa.array(np.arange(0, keys.size + 1, tables), pa.int32()), pa.array(keys.reshape(-1)))],
                        ["vec_id", "weight", "v", "keys"])

    return reps.mapInArrow(run, "vec_id long, weight long, v array<double>, keys array<long>")


def _forest(left: np.ndarray, right: np.ndarray, n: int) -> np.ndarray:
    """Indices of pairs that connect what earlier pairs had not, over nodes 0 .. n - 1."""
    top = list(range(n))
    kept = []
    for k, (a, b) in enumerate(zip(left.tolist(), right.tolist())):
        while top[a] != a:
            top[a] = top[top[a]]
            a = top[a]
        while top[b] != b:
            top[b] = top[top[b]]
            b = top[b]
        if a != b:
            top[max(a, b)] = min(a, b)
            kept.append(k)
    return np.array(kept, np.int64)


def _compare(threshold: float):
    """From rows sorted by (key, i, j): (a, b, links): links of a (b null) and forest edges a - b (links 0)."""

    def group(t: pa.Table) -> Iterator[pa.RecordBatch]:
        doc, weight, block, table = (t.column(c).to_numpy() for c in ("vec_id", "weight", "block", "t"))
        i, j, t0 = t.column("i")[0].as_py(), t.column("j")[0].as_py(), int(table[0])
        unit = _unit(_matrix(t.column("v").combine_chunks()))
        keys = _matrix(t.column("keys").combine_chunks())
        left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
        links = np.zeros(len(doc), np.int64)
        edges = []
        for lo in range(0, len(left), 256):
            part = left[lo:lo + 256]
            cosine = unit[part] @ unit[right].T
            a, b = np.nonzero(cosine >= threshold - 1e-9)
            a, b = part[a], right[b]
            once = a < b if i == j else np.ones(len(a), bool)
            a, b = a[once], b[once]
            # near the threshold the sum is taken in one order for all pairs
            exact = np.einsum("ij,ij->i", unit[a], unit[b]) >= threshold
            a, b = a[exact], b[exact]
            for k in range(0, len(a), 1 << 15):
                x, y = a[k:k + (1 << 15)], b[k:k + (1 << 15)]
                new = ~(keys[x, :t0] == keys[y, :t0]).any(axis=1)  # not met in an earlier table
                np.add.at(links, x[new], weight[y[new]])
                np.add.at(links, y[new], weight[x[new]])
                forest = _forest(x[new], y[new], len(doc))
                edges.append((x[new][forest], y[new][forest]))
        if edges:
            x, y = np.concatenate([e[0] for e in edges]), np.concatenate([e[1] for e in edges])
            forest = _forest(x, y, len(doc))
            x, y = doc[x[forest]], doc[y[forest]]
            linked = np.flatnonzero(links)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([doc[linked], x])), pa.array([None] * len(linked) + y.tolist(), pa.int64()),
                 pa.array(np.concatenate([links[linked], np.zeros(len(x), np.int64)]))], ["a", "b", "links"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            t = pa.Table.from_batches([batch])
            held = t if held is None else pa.concat_tables([held, t])
            cut = [0, *_group_starts(held), held.num_rows]
            for lo, hi in zip(cut[:-2], cut[1:-1]):
                yield from group(held.slice(lo, hi - lo))
            held = held.slice(cut[-2])
        if held is not None:
            yield from group(held)

    return run


def _group_starts(t: pa.Table) -> list[int]:
    new = np.zeros(t.num_rows, bool)
    for c in ("key", "i", "j"):
        x = t.column(c).to_numpy()
        new[1:] |= x[1:] != x[:-1]
    return np.flatnonzero(new).tolist()


def embedding_duplicates(vectors: DataFrame, threshold: float = 0.9, recall: float = RECALL, seed: int = 5,
                         id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row per vector id: vec_id, n_links, component_id (smallest reachable id), kept."""
    valid = valid_vectors(vectors, id_col, vector_col).distinct()
    member = stage(valid.withColumn("h", F.md5(F.to_json(F.struct("v")).cast("binary"))).select("vec_id", "h", "v"), "embed-vectors")
    classes = member.groupBy("h").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("weight"))
    reps = stage(member.join(classes, "h").where("vec_id = rep").select("vec_id", "h", "weight", "v")
                 .dropDuplicates(["h"]), "embed-classes")
    bits, tables = table_shape(reps.count(), threshold, recall)
    # a class stands under a number of its own: one id may hold several vectors
    numbered = reps.select(F.xxhash64("h").alias("vec_id"), "weight", "v")
    hashed = stage(_hashed(numbered, bits, tables, seed), "embed-hashed")
    entries = hashed.select("vec_id", F.posexplode("keys").alias("t", "key"))
    full = entries.groupBy("key").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1")
    crowded = entries.join(full, "key").select("vec_id", "t", "key", "rows")
    blocks = F.ceil(F.col("rows") / F.lit(float(BLOCK))).cast("int")
    mine = F.pmod(F.xxhash64("vec_id"), blocks).cast("int")
    facing = F.explode(F.transform(F.sequence(F.lit(0), blocks - 1), lambda k: F.struct(
        F.least(k, mine).alias("i"), F.greatest(k, mine).alias("j"))))
    rows = (crowded.join(hashed, "vec_id").select("key", "t", facing.alias("f"), mine.alias("block"), "vec_id", "weight", "v", "keys")
            .select("key", "t", "f.i", "f.j", "block", "vec_id", "weight", "v", "keys"))
    rows = rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "vec_id")
    found = stage(rows.mapInArrow(_compare(threshold), "a long, b long, links long"), "embed-links")

    numbers = reps.select("h", F.xxhash64("h").alias("number"), F.col("weight"))
    links = found.where("b is null").groupBy(F.col("a").alias("number")).agg(F.sum("links").alias("near"))
    # edges join class numbers; each class also joins its members' ids, told apart from numbers by kind
    ids = member.join(numbers, "h").select("vec_id", "number", "weight")
    low = ids.groupBy("number").agg(F.min("vec_id").alias("low"))
    edges = found.where("b is not null").select("a", "b").join(
        low.select(F.col("number").alias("a"), F.col("low").alias("u")), "a").join(
        low.select(F.col("number").alias("b"), F.col("low").alias("v")), "b").select("u", "v")
    own = ids.join(low, "number").where("vec_id != low").select(F.col("vec_id").alias("u"), F.col("low").alias("v"))
    parts = stage(connected_components(edges.unionByName(own)), "embed-components")
    counted = (ids.join(links, "number", "left")
               .groupBy("vec_id").agg(F.sum(F.coalesce("near", F.lit(0)) + F.col("weight") - 1).alias("n_links")))
    every = vectors.select(F.col(id_col).cast("long").alias("vec_id"))
    named = every.where("vec_id is not null").distinct()
    placed = (named.join(counted, "vec_id", "left").join(parts.withColumnRenamed("node", "vec_id"), "vec_id", "left")
              .select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                      F.coalesce("component", "vec_id").alias("component_id")))
    unnamed = every.where("vec_id is null").select("vec_id", F.lit(0).cast("long").alias("n_links"),
                                                   F.lit(None).cast("long").alias("component_id"))
    return placed.unionByName(unnamed).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
