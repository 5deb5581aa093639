"""Packing token sequences into fixed windows by minimum bin slack.

Documents are encoded once, where they are read; full windows are cut off and what remains is
shorter than a window.  The windows for the remainders are chosen on the histogram of their
lengths, which has at most ``capacity`` entries whatever the corpus: the longest length left is
fixed, a bitset subset-sum finds the multiset of remaining lengths that comes closest to filling
the rest, the counts are traced back through the bitsets, and the pattern is used as often as the
counts allow.  Every piece then finds its window by its rank among the pieces of its length; ranks
are a rank inside the task plus a prefix sum over (task, length) counts, so no length is one task.

Defined cases: null text is empty and gives one piece, its end id; repeated ids and rows are
documents of their own; an empty table gives no piece; a null id stays null; other columns are
ignored.  A document's length is bounded by one row only.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import keyed_texts, lean, stage
from .tokens import encoded

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, task long, nth long"


def closest_fill(counts: dict[int, int], room: int) -> dict[int, int]:
    """The multiset of lengths (at most ``counts`` of each) whose sum is the largest not over ``room``."""
    mask = (1 << (room + 1)) - 1
    reach, steps = 1, []
    for length in sorted((n for n in counts if n <= room), reverse=True):
        left, take = min(counts[length], room // length), 1
        while left and not reach >> room & 1:
            take = min(take, left)
            steps.append((length, take, reach))
            reach |= reach << (length * take) & mask
            left -= take
            take *= 2
        if reach >> room & 1:
            break
    at, chosen = reach.bit_length() - 1, {}
    for length, take, before in reversed(steps):
        if not before >> at & 1:
            chosen[length] = chosen.get(length, 0) + take
            at -= length * take
    return chosen


def window_plan(counts: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """(lengths and how many of each in a window, number of such windows), using every count up."""
    left = {n: c for n, c in counts.items() if c}
    plan = []
    while left:
        seed = max(left)
        rest = dict(left)
        rest[seed] -= 1
        pattern = closest_fill({n: c for n, c in rest.items() if c}, capacity - seed)
        pattern[seed] = pattern.get(seed, 0) + 1
        times = min(left[n] // m for n, m in pattern.items())
        plan.append((pattern, times))
        for n, m in pattern.items():
            left[n] -= m * times
            if not left[n]:
                del left[n]
    return plan


def _places(plan: list[tuple[dict[int, int], int]]) -> dict[int, np.ndarray]:
    """Per length the rows (first rank, windows' first id, pieces per window, offset in the window)."""
    rows: dict[int, list[tuple[int, int, int, int]]] = {}
    used: dict[int, int] = {}
    window = 0
    for pattern, times in plan:
        offset = 0
        for n in sorted(pattern, reverse=True):
            m = pattern[n]
            rows.setdefault(n, []).append((used.get(n, 0), window, m, offset))
            used[n] = used.get(n, 0) + m * times
            offset += n * m
        window += times
    return {n: np.array(r, np.int64) for n, r in rows.items()}


def cut_pieces(docs: DataFrame, capacity: int, vocabulary: str, end_id: int,
               id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every text, append ``end_id`` and cut it into pieces of at most ``capacity`` ids."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        end = np.uint32(end_id).tobytes()
        for batch in batches:
            cols: dict[str, list] = {k: [] for k in ("row", "start", "length", "ids_crc32", "doc_tokens", "nth")}
            for i, raw in enumerate(encoded(batch.column(1).to_pylist(), vocabulary)):
                raw += end
                total = len(raw) // 4
                for start in range(0, total, capacity):
                    n = min(capacity, total - start)
                    cols["row"].append(i)
                    cols["start"].append(start)
                    cols["length"].append(n)
                    cols["ids_crc32"].append(zlib.crc32(raw[4 * start:4 * (start + n)]))
                    cols["doc_tokens"].append(total)
                    cols["nth"].append(int(seen[n]))
                    seen[n] += 1
            ids = batch.column(0).take(pa.array(cols.pop("row"), pa.int64()))
            arrays = {k: pa.array(v, pa.int64()) for k, v in cols.items()}
            nth = arrays.pop("nth")
            yield pa.RecordBatch.from_pydict(
                {"doc_id": ids, **arrays, "task": pa.array([task] * len(ids), pa.int64()), "nth": nth})

    return keyed_texts(docs, id_col, text_col).mapInArrow(lean(cut), PIECES)


def pack(docs: DataFrame, capacity: int, vocabulary: str, end_id: int,
         id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: its document and place there, its window (``sequence_id``) and place there."""
    pieces = stage(cut_pieces(docs, capacity, vocabulary, end_id, id_col, text_col), "pack-pieces")
    per_task = pieces.groupBy("task", "length").agg(F.count(F.lit(1)).alias("n"))
    histogram = {r["length"]: r["n"] for r in per_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    places = _places(window_plan(histogram, capacity))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    bases = per_task.select("task", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column(2).to_numpy(), batch.column(5).to_numpy()
            seq, off = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for n in np.unique(length):
                at = np.flatnonzero(length == n)
                table = places[int(n)]
                row = table[np.searchsorted(table[:, 0], rank[at], "right") - 1]
                step = rank[at] - row[:, 0]
                seq[at] = row[:, 1] + step // row[:, 2]
                off[at] = row[:, 3] + step % row[:, 2] * n
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(seq), pa.array(off)],
                                             ["doc_id", "start", "length", "ids_crc32", "doc_tokens",
                                              "sequence_id", "offset"])

    ranked = (pieces.join(bases, ["task", "length"])
              .select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("base") + F.col("nth")).alias("rank")))
    return ranked.mapInArrow(lean(place), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
                                    "sequence_id long, offset long")
