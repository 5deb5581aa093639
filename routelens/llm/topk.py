"""Exact top-k by inner product with no random access to candidates.

Candidates and queries lie in blocks of bounded size and every pair of blocks is a group.  For each
query a block offers one list per dimension, ordered by what the candidate's component adds to the
score.  The lists are read from the top in parallel, a stretch at a time, and a stretch serves all
queries of the group.  What has been read gives
every candidate a lower bound (unread components at their list's worst) and an upper bound (unread
components at their list's present value); reading stops when all candidates but a few are below the
k-th lower bound, and the final scores of those few are resolved.  A block's best k go on to a
ranking per query, whose map side keeps k rows.

Scores are integers: products of floor(scale * component), all in 64 bits.

Defined cases: vectors that are null, empty or hold null or non-finite components take no part, on
either side; a null id takes no part; vectors of different lengths are not compared; ties go to the
smaller id; a query is not its own candidate (equal ids); rows repeated as a whole count once; with
fewer than k candidates all are returned; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CANDIDATE_BLOCK = 8192
QUERY_BLOCK = 1024
QUERY_BATCH = 64  # queries whose bounds are computed at once
FEW = 8  # reading also stops when no more than FEW * k candidates are left to resolve


def integer_vectors(vectors: DataFrame, scale: float, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, v) with v = floor(scale * component), of the vectors that take part."""
    v = F.col(vector_col).cast("array<double>")
    named = vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).where(
        "vec_id is not null and v is not null and size(v) > 0")
    fine = F.forall("v", lambda x: x.isNotNull() & (F.abs(x) < float("inf")) & ~F.isnan(x))
    bound = F.sqrt(F.lit(float(1 << 62)) / F.size("v"))  # below it no score of two vectors leaves 64 bits
    wide = F.raise_error(F.lit("a component is too large for a 64-bit score"))
    return named.where(fine).select("vec_id", F.transform("v", lambda x: F.when(
        F.abs(x * F.lit(float(scale))) >= bound, wide).otherwise(F.floor(x * F.lit(float(scale))))).alias("v")).distinct()


def sorted_lists(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per dimension the block's rows in order of their component, and the components in that order."""
    order = np.argsort(values, axis=0, kind="stable").T
    return np.ascontiguousarray(order.astype(np.int32)), np.take_along_axis(values.T, order, axis=1).astype(np.float64)


def best_of_block(query: np.ndarray, values: np.ndarray, lists: tuple[np.ndarray, np.ndarray], ids: np.ndarray,
                  k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and scores of the k best of a block for one query."""
    return next(best_of_block_each(query[None], values, lists, ids, k))


def best_of_block_each(queries: np.ndarray, values: np.ndarray, lists: tuple[np.ndarray, np.ndarray], ids: np.ndarray,
                       k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each query the rows and scores of the k best of a block, by reading its sorted lists.

    A stretch of the lists is read once for all queries.  A list is read from both ends: queries with a
    positive component there take its upper end, the others its lower end.
    """
    n, dims = values.shape
    every = np.arange(n)
    left = [every] * len(queries)
    open_ = np.flatnonzero(queries.any(axis=1)) if n > k else every[:0]
    order, sorted_values = lists
    # rows 0 to dims - 1: what the upper ends have told, the rest: the lower ends
    halves = np.concatenate([np.maximum(queries, 0), np.minimum(queries, 0)], axis=1).astype(np.float32)
    worst = np.concatenate([sorted_values[:, :1], sorted_values[:, -1:]]).astype(np.float32)
    low, read = np.repeat(worst, n, axis=1), np.zeros((2 * dims, n), bool)
    # bounds are in single precision, so they are widened by more than its rounding
    sums = np.abs(queries).astype(np.float64) @ np.abs(sorted_values[:, [0, -1]]).max(axis=1)
    room = (2 * dims + 8) * 2.0 ** -22 * sums
    lo, hi = 0, max(k, n // 4)
    while len(open_):
        hi = min(n, hi)
        ends = order[:, n - hi:n - lo], order[:, lo:hi]
        told = sorted_values[:, n - hi:n - lo], sorted_values[:, lo:hi]
        for half, rows, value in zip((slice(0, dims), slice(dims, 2 * dims)), ends, told):
            np.put_along_axis(low[half], rows, value.astype(np.float32), axis=1)  # the lower bound: what was read, else the worst
            np.put_along_axis(read[half], rows, True, axis=1)
        # unread components can reach their list's present value instead of its worst
        front = np.concatenate([sorted_values[:, n - hi], sorted_values[:, hi - 1]]).astype(np.float32)
        high = np.where(read, low, front[:, None])
        on = []
        for at in range(0, len(open_), QUERY_BATCH):
            some = open_[at:at + QUERY_BATCH]
            bar = np.partition(halves[some] @ low, n - k, axis=1)[:, n - k] - room[some]
            reach = halves[some] @ high >= bar.astype(np.float32)[:, None]
            done = (np.count_nonzero(reach, axis=1) <= FEW * k) | (hi == n)
            for i in np.flatnonzero(done):
                left[some[i]] = np.flatnonzero(reach[i])
            on.append(some[~done])
        open_ = np.concatenate(on)
        lo, hi = hi, hi + max(1, n // 8)
    for query, rows in zip(queries, left):
        total = values[rows] @ query
        first = np.lexsort((ids[rows], -total))[:k]
        yield rows[first], total[first]


def _blocks(vectors: DataFrame, rows: int) -> tuple[Column, int]:
    n = max(1, -(-vectors.count() // rows))
    return F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int"), n


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, scale: float = 1024.0,
          id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for each query the k candidates of ``vectors`` with the highest scores."""
    candidates = integer_vectors(vectors, scale, id_col, vector_col)
    asked = integer_vectors(queries, scale, id_col, vector_col)
    c_block, n_c = _blocks(candidates, CANDIDATE_BLOCK)
    q_block, n_q = _blocks(asked, QUERY_BLOCK)
    dim = F.size("v").alias("dim")
    own = candidates.select(c_block.alias("c"), F.explode(F.sequence(F.lit(0), F.lit(n_q - 1))).alias("q"), dim, "vec_id", "v")
    theirs = asked.select(F.explode(F.sequence(F.lit(0), F.lit(n_c - 1))).alias("c"), q_block.alias("q"), dim, "vec_id", "v")

    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def run(cand: pa.Table, ask: pa.Table) -> pa.Table:
        if not cand.num_rows or not ask.num_rows:
            return schema.empty_table()
        cand = cand.sort_by("vec_id")
        ids, qids = cand.column("vec_id").to_numpy(), ask.column("vec_id").to_numpy()
        values = cand.column("v").combine_chunks().flatten().to_numpy().reshape(len(ids), -1).astype(np.int64)
        queries_ = ask.column("v").combine_chunks().flatten().to_numpy().reshape(len(qids), -1).astype(np.int64)
        lists = sorted_lists(values)
        parts = []
        for qid, (got, total) in zip(qids, best_of_block_each(queries_, values, lists, ids, k + 1)):  # one more, as it may meet itself
            keep = ids[got] != qid
            got, total = got[keep][:k], total[keep][:k]
            parts.append((np.full(len(got), qid), ids[got], total))
        return pa.Table.from_arrays([pa.array(np.concatenate(c)) for c in zip(*parts)], schema=schema)

    found = own.groupBy("c", "q", "dim").cogroup(theirs.groupBy("c", "q", "dim")).applyInArrow(
        run, "query_id long, vec_id long, score long")
    ranked = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")
