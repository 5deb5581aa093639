"""Toxicity from two class-conditional Kneser-Ney models over letters.

Texts are read as symbols of a 64-letter alphabet (a-z, digit, separator, classes of UTF-8 bytes).
Each class, toxic and ordinary, has an interpolated model whose top order predicts a symbol from the
five before it; what a class has not seen often backs off, by absolute discounting, to lower orders
that both classes share: five-symbol counts over all documents, then Kneser-Ney continuation counts
(how many different symbols precede) of four, three and two.  For an expression neither class knows,
both models thus give the same shared probability and the comparison stays near zero.

A document's features are the length-normalised difference of the two log-likelihoods (their mean
over its symbols) and the largest difference over a short stretch of it; a logistic curve over them,
fitted on labelled rows the models have not seen, is the score.

Sizes: classes are counted over all labelled rows that are neither held out nor kept for the curve,
shared counts over all documents.  All counts are keyed by the exact symbols, and the model is a table
of contexts that grows with them.  Texts are never shuffled: the model is dealt out by ranges of contexts
and staged in packed blocks, and texts are scored where they are read, in units of about ``UNIT_BYTES``.
A unit reads the blocks one after the other and keeps what they hold of its own distinct contexts, so
memory follows the unit, not the model.  What says no more than a missing entry does stays out of the
blocks.  The curve has four parameters and is fitted on at most ``rows_per_class`` rows of each class
(those with the smallest id hashes).

Defined cases: null text is empty; an empty text has features 0 and gets the curve's value there;
a null id is scored (not held out) but never a label; conflicting labels of one id count as toxic;
null labels are ignored; with no labelled row of either class the score is the share of toxic
labels (0 without labels); repeated rows are scored each; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import keyed_texts, lean, open_folder, release, shared_path, stage, text_slices

SCALE = 16          # log-ratios are stored in sixteenths
WINDOW = 8          # symbols of the short stretch
DISCOUNT = 0.75
PAD = 5
FOLDS, HELD_OUT, CALIBRATION = 5, 0, 4
ROWS_PER_CLASS = 50_000
HELD_KEYS = 1 << 20  # counts held before they are given to the shuffle
UNIT_BYTES = 32 << 20
READ_BYTES = 1 << 20
FIVE = (1 << 30) - 1  # the last five symbols of a cell

# symbol classes: 0 separator, 1-26 letters, 27 digit, 28-31 lead bytes, 32-63 continuation bytes
_SYMBOL = np.array([b - 96 if 97 <= b <= 122 else b - 64 if 65 <= b <= 90 else 27 if 48 <= b <= 57 else
                    0 if b < 128 else 32 + b % 32 if b < 192 else 28 + b % 4 for b in range(256)], np.int64)


def fold(id_column: Column) -> Column:
    return F.crc32(id_column.cast("string").cast("binary")) % FOLDS


def symbols(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of a slice with ``PAD`` separators before each text, and where each text's own begin in it."""
    n = len(offsets) - 1
    owner = np.repeat(np.arange(n), np.diff(offsets))
    out = np.zeros(len(data) + PAD * n, np.int64)
    out[np.arange(len(data)) + PAD * (owner + 1)] = _SYMBOL[data]
    return out, offsets[:-1] + PAD * np.arange(1, n + 1)


def codes(sym: np.ndarray) -> np.ndarray:
    """For positions PAD.. : the exact code of the symbol and the five before it, 36 bits."""
    n = len(sym) - PAD
    code = np.zeros(n, np.int64)
    for j in range(PAD + 1):
        code = code << 6 | sym[j:j + n]
    return code


def _cells(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The codes of all symbols of a slice, text after text, without those of the padding."""
    sym, begin = symbols(data, offsets)
    own = np.ones(len(sym) - PAD, bool)
    own[(begin[1:, None] - 2 * PAD + np.arange(PAD)).ravel()] = False  # padding is context only
    return codes(sym)[own]


def _counted(keys: list[np.ndarray], sums: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    key, inverse = np.unique(np.concatenate(keys), return_inverse=True)
    return key, np.bincount(inverse, np.concatenate(sums), len(key)).astype(np.int64)


class _Tally:
    """Sparse counts of a bounded number of keys."""

    def __init__(self):
        self.keys: list[np.ndarray] = []
        self.sums: list[np.ndarray] = []
        self.held = 0

    def add(self, keys: np.ndarray) -> None:
        k, n = np.unique(keys, return_counts=True)
        self.keys.append(k)
        self.sums.append(n)
        self.held += len(k)

    def take(self) -> tuple[np.ndarray, np.ndarray]:
        """The counts so far, which are then left to the partial sums of the shuffle."""
        if not self.keys:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        k, n = _counted(self.keys, self.sums)
        self.keys, self.sums, self.held = [], [], 0
        return k, n


def _rows(kind: int, keys: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
    for i in range(0, len(keys), 1 << 16):
        k, n = keys[i:i + (1 << 16)], counts[i:i + (1 << 16)].astype(np.int64)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(k), kind, np.int32)), pa.array(k), pa.array(n)], ["kind", "key", "n"])


def _files(folder: str) -> Iterator[pq.ParquetFile]:
    """The files of a staged table, one after the other, read by small buffers."""
    fs, root = open_folder(folder)
    for info in fs.get_file_info(pa.fs.FileSelector(root)):
        if info.path.endswith(".parquet"):
            with fs.open_input_file(info.path) as f:
                yield pq.ParquetFile(f, buffer_size=READ_BYTES)


def _marks(folder: str, doc_id: pa.Array) -> np.ndarray:
    """The label of each row of a batch, 1 toxic, 0 ordinary, -1 none, from a staged table (doc_id, toxic) of unique ids.

    The table is dealt out by ranges of ids, so that files whose ids all lie elsewhere are passed over.
    """
    out = np.full(len(doc_id), -1, np.int8)
    given = np.flatnonzero(doc_id.is_valid().to_numpy(zero_copy_only=False))
    if not len(given):
        return out
    ids, inverse = np.unique(doc_id.drop_null().to_numpy(), return_inverse=True)
    mark = np.full(len(ids), -1, np.int8)
    for file in _files(folder):
        for g in range(file.metadata.num_row_groups):
            has = file.metadata.row_group(g).column(0).statistics
            if has is not None and has.has_min_max and (has.max < ids[0] or has.min > ids[-1]):
                continue
            for rows in file.iter_batches(1 << 16, row_groups=[g], columns=["doc_id", "toxic"]):
                got, toxic = (c.to_numpy(zero_copy_only=False) for c in rows.columns)
                at = np.minimum(np.searchsorted(ids, got), len(ids) - 1)
                hit = ids[at] == got
                mark[at[hit]] = toxic[hit]
    out[given] = mark[inverse]
    return out


def _gather(texts: DataFrame, labelled: DataFrame, path: str) -> DataFrame:
    """(kind, key, n), a table at ``path``: kind 2 five-symbol counts of all documents, 0 and 1 six-symbol counts of the two classes.

    Each text is read once and where it lies; its label is looked up in the staged labels.
    """
    folder = shared_path(texts.sparkSession, "toxicity-training")
    stage(labelled.select("doc_id", "toxic").repartitionByRange("doc_id").sortWithinPartitions("doc_id"), "toxicity-training", folder)

    def give(kind: int, tally: _Tally) -> Iterator[pa.RecordBatch]:
        k, n = tally.take()
        if len(k) > HELD_KEYS // 2:
            yield from _rows(kind, k, n)
        else:  # mostly repeats: the sums are held on
            tally.keys, tally.sums, tally.held = [k], [n], len(k)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tallies = _Tally(), _Tally(), _Tally()
        for batch in batches:
            marks = _marks(folder, batch.column(0))
            for lo, hi, data, offsets in text_slices(batch, "text"):
                cells, of = _cells(data, offsets), np.repeat(marks[lo:hi], np.diff(offsets))
                for kind, (tally, own) in enumerate(zip(tallies, (cells[of == 0], cells[of == 1], cells & FIVE))):
                    tally.add(own)
                    if tally.held > HELD_KEYS:
                        yield from give(kind, tally)
        for kind, tally in enumerate(tallies):
            yield from _rows(kind, *tally.take())

    counted = texts.select("doc_id", "text").mapInArrow(lean(count), "kind int, key long, n long")
    return stage(counted.groupBy("kind", "key").agg(F.sum("n").alias("n")), "toxicity-counts", path)


def _shared_model(counts: DataFrame) -> DataFrame:
    """(five, p5): the interpolated probability of the last symbol of each seen five-symbol code."""
    d = F.lit(DISCOUNT)

    def smoothed(df: DataFrame, n: str, ctx: Column, lower: str) -> Column:
        w = Window.partitionBy(ctx)
        total, kinds = F.sum(n).over(w), F.count(F.lit(1)).over(w)
        return F.greatest(F.col(n) - d, F.lit(0.0)) / total + d * kinds / total * F.col(lower)

    five = counts.where("kind = 2").select(F.col("key").alias("five"), "n")
    four = five.groupBy(F.col("five").bitwiseAND(F.lit((1 << 24) - 1)).alias("four")).agg(F.count(F.lit(1)).alias("n4"))
    three = four.groupBy(F.col("four").bitwiseAND(F.lit((1 << 18) - 1)).alias("three")).agg(F.count(F.lit(1)).alias("a"))
    two = three.groupBy(F.col("three").bitwiseAND(F.lit((1 << 12) - 1)).alias("two")).agg(F.count(F.lit(1)).alias("b"))
    one = two.groupBy(F.col("two").bitwiseAND(F.lit(63)).alias("one")).agg(F.count(F.lit(1)).alias("c"))
    p1 = one.crossJoin(one.agg(F.sum("c").alias("all"))).select("one", (F.col("c") / F.col("all")).alias("p1"))  # one row
    two = two.withColumn("one", F.col("two").bitwiseAND(F.lit(63))).join(p1, "one")
    two = two.select("two", smoothed(two, "b", F.shiftright("two", 6), "p1").alias("p2"))
    three = three.withColumn("two", F.col("three").bitwiseAND(F.lit((1 << 12) - 1))).join(two, "two")
    three = three.select("three", smoothed(three, "a", F.shiftright("three", 6), "p2").alias("p3"))
    four = four.withColumn("three", F.col("four").bitwiseAND(F.lit((1 << 18) - 1))).join(three, "three")
    four = four.select("four", smoothed(four, "n4", F.shiftright("four", 6), "p3").alias("p4"))
    five = five.withColumn("four", F.col("five").bitwiseAND(F.lit((1 << 24) - 1))).join(four, "four")
    return five.select("five", smoothed(five, "n", F.shiftright("five", 6), "p4").alias("p5"))


def _log_ratios(counts: DataFrame) -> DataFrame:
    """(ctx, unseen, cells): per context the quantised log-ratio of a symbol neither class has seen there,
    and of the others symbol << 8 | log-ratio + 128."""
    cells = (counts.where("kind < 2").groupBy("key")
             .agg(F.sum(F.when(F.col("kind") == 1, F.col("n")).otherwise(0)).alias("t"),
                  F.sum(F.when(F.col("kind") == 0, F.col("n")).otherwise(0)).alias("o")))
    cells = cells.withColumns({"ctx": F.shiftright("key", 6), "five": F.col("key").bitwiseAND(F.lit(FIVE))})
    w = Window.partitionBy("ctx")

    def back(n: str) -> tuple[Column, Column]:
        total = F.sum(n).over(w)
        kinds = F.sum((F.col(n) > 0).cast("int")).over(w)
        return total, F.when(total > 0, F.lit(DISCOUNT) * kinds / total).otherwise(F.lit(1.0))

    (all_t, back_t), (all_o, back_o) = back("t"), back("o")
    cells = cells.withColumns({"all_t": all_t, "back_t": back_t, "all_o": all_o, "back_o": back_o})
    own = lambda n: F.when(F.col(f"all_{n}") > 0, F.greatest(F.col(n) - F.lit(DISCOUNT), F.lit(0.0)) / F.col(f"all_{n}")).otherwise(0.0)
    ratio = F.log((own("t") + F.col("back_t") * F.col("p5")) / (own("o") + F.col("back_o") * F.col("p5")))
    step = lambda c: F.greatest(F.lit(-127), F.least(F.lit(127), F.round(c * SCALE))).cast("int")
    code = F.col("key").bitwiseAND(F.lit(63)) * 256 + step(ratio) + 128
    priced = cells.join(_shared_model(counts), "five").groupBy("ctx").agg(
        F.max(step(F.log(F.col("back_t") / F.col("back_o")))).cast("byte").alias("unseen"),
        F.sort_array(F.collect_list(code.cast("short"))).alias("cells"))
    return stage(priced, "toxicity-model")


def _packed(ctx: np.ndarray, unseen: np.ndarray, sizes: np.ndarray, cells: np.ndarray) -> bytes:
    """A block of ascending contexts: their distances, ratios, numbers of cells and cells, compressed."""
    raw = b"".join((np.uint32(len(ctx)).tobytes(), np.diff(ctx, prepend=0).astype(np.uint32).tobytes(),
                    unseen.astype(np.int8).tobytes(), sizes.astype(np.uint8).tobytes(), cells.astype(np.int16).tobytes()))
    return np.uint32(len(raw)).tobytes() + pa.compress(raw, "zstd", asbytes=True)


def _unpacked(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    raw = pa.decompress(blob[4:], int(np.frombuffer(blob, np.uint32, 1)[0]), "zstd", asbytes=True)
    n = int(np.frombuffer(raw, np.uint32, 1)[0])
    return (np.cumsum(np.frombuffer(raw, np.uint32, n, 4), dtype=np.int64), np.frombuffer(raw, np.int8, n, 4 + 4 * n),
            np.frombuffer(raw, np.uint8, n, 4 + 5 * n), np.frombuffer(raw, np.int16, -1, 4 + 6 * n))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (ctx, unseen, cells) in order of their context, a packed row a batch with its least and largest context."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ctx, unseen, cells = batch.columns
        ctx, sizes = ctx.to_numpy(), pa.compute.list_value_length(cells).to_numpy(zero_copy_only=False)
        blob = _packed(ctx, unseen.to_numpy(zero_copy_only=False), sizes, cells.flatten().to_numpy())
        yield pa.RecordBatch.from_arrays(
            [pa.array([ctx[0]]), pa.array([ctx[-1]]), pa.array([blob], pa.binary())], ["lo", "hi", "block"])


def _asked(folder: str, asked: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """What the staged blocks hold of the ascending contexts ``asked``; one block at a time is in memory."""
    for file in _files(folder):
        for rows in file.iter_batches(batch_size=1):
            (lo,), (hi,), (blob,) = (c.to_pylist() for c in rows.columns)
            a, b = np.searchsorted(asked, (lo, hi + 1))
            if a == b:
                continue
            ctx, unseen, sizes, cells = _unpacked(blob)
            at = np.minimum(np.searchsorted(ctx, asked[a:b]), len(ctx) - 1)
            known = np.zeros(len(ctx), bool)
            known[at[ctx[at] == asked[a:b]]] = True
            yield ctx[known], unseen[known], sizes[known], cells[np.repeat(known, sizes)]


class _Known:
    """The part of the model that a unit asked for."""

    def __init__(self, answers: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]):
        if not answers:
            self.ctx = self.key = np.zeros(0, np.int64)
            return
        ctx, unseen, sizes, cells = (np.concatenate(c) for c in zip(*answers))
        symbol = cells.astype(np.int64)
        key = np.repeat(ctx, sizes) << 6 | symbol >> 8
        self.ctx, at = np.unique(ctx, return_index=True)
        self.unseen = unseen[at].astype(np.int64)
        self.key, at = np.unique(key, return_index=True)
        self.q = (symbol[at] & 255) - 128

    def ratios(self, cells: np.ndarray) -> np.ndarray:
        out = np.zeros(len(cells), np.int64)
        if not len(self.ctx):
            return out
        rest = np.arange(len(cells))
        if len(self.key):
            at = np.minimum(np.searchsorted(self.key, cells), len(self.key) - 1)
            hit = self.key[at] == cells
            out[hit] = self.q[at[hit]]
            rest = np.flatnonzero(~hit)
        at = np.minimum(np.searchsorted(self.ctx, cells[rest] >> 6), len(self.ctx) - 1)
        hit = self.ctx[at] == cells[rest] >> 6
        out[rest[hit]] = self.unseen[at[hit]]
        return out


def features(known: _Known, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(mean log-ratio, largest mean over WINDOW symbols, log of length) of each text of a slice."""
    n = len(offsets) - 1
    out = np.zeros((n, 3))
    run = np.concatenate(([0], np.cumsum(known.ratios(_cells(data, offsets)))))
    for k in range(n):
        size = int(offsets[k + 1] - offsets[k])
        if not size:
            continue
        r = run[offsets[k]:offsets[k + 1] + 1]
        m = min(WINDOW, size)
        out[k] = ((r[-1] - r[0]) / size / SCALE, (r[m:] - r[:-m]).max() / WINDOW / SCALE, np.log1p(size))
    return out


def _with_features(docs: DataFrame, cells: DataFrame, text_col: str, out: Callable, schema) -> DataFrame:
    """``out(rows, features)`` of all rows, piece by piece.

    The texts stay in the tasks that read them: the model lies in the shared folder in packed blocks of ascending contexts,
    and a unit of texts reads them one after the other and keeps the contexts that it has.
    """
    # a cell equal to its context's ratio says nothing, nor does a context of ratio zero without cells
    telling = cells.withColumn("cells", F.filter("cells", lambda c: c.bitwiseAND(F.lit(255).cast("short")) - 128 != F.col("unseen"))
                               ).where("unseen <> 0 or size(cells) > 0")
    folder = shared_path(docs.sparkSession, "toxicity-blocks")
    stage(telling.select("ctx", "unseen", "cells").repartitionByRange("ctx").sortWithinPartitions("ctx")
          .mapInArrow(lean(_blocks), "lo long, hi long, block binary"), "toxicity-blocks", folder)

    def unit(pieces: list[pa.RecordBatch], asked: np.ndarray) -> Iterator[pa.RecordBatch]:
        known = _Known(list(_asked(folder, asked)))
        for rows in pieces:
            parts = [features(known, data, offsets) for _, _, data, offsets in text_slices(rows, text_col)]
            yield out(rows, np.concatenate(parts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces: list[pa.RecordBatch] = []
        none = np.zeros(0, np.int64)
        asked, held = none, 0
        for batch in batches:
            for lo, hi, data, offsets in text_slices(batch, text_col):
                pieces.append(batch.slice(lo, hi - lo))
                asked = np.union1d(asked, np.unique(_cells(data, offsets) >> 6))
                held += len(data)
                if held >= UNIT_BYTES:
                    yield from unit(pieces, asked)
                    pieces, asked, held = [], none, 0
        if pieces:
            yield from unit(pieces, asked)

    return docs.mapInArrow(lean(run), schema)


def _fit_logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Newton steps for a lightly penalised logistic curve (bounded sample, three features)."""
    scale = np.maximum(x.std(0), 1e-9)
    z = np.column_stack([np.ones(len(x)), x / scale])
    w = np.zeros(z.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        h = (z * (p * (1 - p))[:, None]).T @ z + 1e-2 * np.eye(len(w))
        w += np.linalg.solve(h, z.T @ (y - p) - 1e-2 * w)
    w[1:] /= scale
    return w


@dataclass
class ToxicityModel:
    cells: DataFrame
    curve: np.ndarray


def _logistic(curve: np.ndarray, f: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(curve[0] + f @ curve[1:], -30, 30)))


def labelled_rows(labels: DataFrame, id_col: str = "doc_id", label_col: str = "toxic") -> DataFrame:
    """(doc_id, toxic, fold), one row per labelled id, none held out."""
    return (labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("toxic"))
            .where("doc_id is not null and toxic is not null").groupBy("doc_id").agg((F.max("toxic") > 0).alias("toxic"))
            .withColumn("fold", fold(F.col("doc_id"))).where(F.col("fold") != HELD_OUT))


def fit(docs: DataFrame, labels: DataFrame, rows_per_class: int = ROWS_PER_CLASS, id_col: str = "doc_id",
        text_col: str = "text", label_col: str = "toxic") -> ToxicityModel:
    """Gather the counts, build the table of log-ratios and fit the curve on the calibration fold."""
    texts = keyed_texts(docs, id_col, text_col)
    rows = stage(labelled_rows(labels, id_col, label_col), "toxicity-labels")
    sizes = {(r.cal, r.toxic): r.n for r in rows.groupBy((F.col("fold") == CALIBRATION).alias("cal"), "toxic")
             .agg(F.count(F.lit(1)).alias("n")).collect()}  # four rows
    curve, total = np.zeros(4), sum(sizes.values())
    share = sum(n for (_, toxic), n in sizes.items() if toxic) / max(total, 1)
    curve[0] = np.log(max(share, 1e-9) / max(1 - share, 1e-9))
    if len(sizes) < 4:  # a class is missing on one of the sides
        none = docs.sparkSession.createDataFrame([], "ctx long, unseen byte, cells array<short>")
        return ToxicityModel(none, curve)
    spark = docs.sparkSession
    path = shared_path(spark, "toxicity-counts")
    counts = _gather(texts, rows.where(F.col("fold") != CALIBRATION).select("doc_id", "toxic"), path)
    release(spark)
    cells = _log_ratios(counts)
    release(spark, path)  # the model is a table of its own
    kept = rows.where(F.col("fold") == CALIBRATION)
    parts = [kept.where(c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows_per_class) for c in ("toxic", "not toxic")]
    sample = parts[0].unionByName(parts[1]).select("doc_id", "toxic")  # at most 2 * rows_per_class small rows

    def out(batch: pa.RecordBatch, f: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*batch.columns[:2], *(pa.array(c) for c in f.T)], ["doc_id", "toxic", "f0", "f1", "f2"])

    got = _with_features(texts.join(F.broadcast(sample), "doc_id").select("doc_id", "toxic", "text"), cells, "text", out,
                         "doc_id long, toxic boolean, f0 double, f1 double, f2 double").toArrow()  # rows of the bounded sample
    x = np.column_stack([got.column(i).to_numpy() for i in (2, 3, 4)])
    y = got.column(1).to_numpy().astype(float)
    if len(set(y)) == 2:
        order = np.lexsort((*x.T, got.column(0).to_numpy()))
        curve = _fit_logistic(x[order], y[order])
    return ToxicityModel(cells, curve)


def score(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document."""
    curve = model.curve

    def out(batch: pa.RecordBatch, f: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(_logistic(curve, f))], ["doc_id", "score"])

    return _with_features(keyed_texts(docs, id_col, text_col), model.cells, "text", out, "doc_id long, score double").select(
        "doc_id", F.coalesce(fold(F.col("doc_id")) == HELD_OUT, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_ordinary(docs: DataFrame, model: ToxicityModel, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic, all columns as they are."""
    curve = model.curve

    def out(batch: pa.RecordBatch, f: np.ndarray) -> pa.RecordBatch:
        return batch.filter(pa.array(_logistic(curve, f) < 0.5))

    return _with_features(docs, model.cells, text_col, out, docs.schema)
