"""Helpers shared by the training-data operators: staged tables, text slices, 64-bit hashing.

Texts arrive in Arrow batches; ``text_slices`` exposes them as flat byte arrays, so the
per-byte work is done by numpy over about a megabyte at a time (one very long text is a slice
of its own, so memory follows the longest single text).
"""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from routelens.session import checkpoint_dir

U = np.uint64
SLICE_BYTES = 1 << 20

_BASE = 0x9E3779B97F4A7C15
_BASE_INV = pow(_BASE, -1, 1 << 64)


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder that the session names in ``spark.checkpoint.dir``."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: the lineage ends there."""
    path = path or shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def open_folder(path: str) -> tuple[pa.fs.FileSystem, str]:
    """The file system of a shared folder (``file:``, ``hdfs:``, ``s3:``, ``gs:`` or a plain path) and the path in it."""
    return pa.fs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1).replace("s3n://", "s3://", 1))


def release(spark: SparkSession, *paths: str) -> None:
    """Remove staged tables that no later table is computed from, and let the driver collect what it no longer
    refers to: Spark deletes the shuffle files of the jobs that wrote them only then."""
    for path in paths:
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    spark.sparkContext._jvm.System.gc()


def keyed_texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, text) with null texts empty; every other column of ``docs`` stays out of the way."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"),
                       F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def mix(h: np.ndarray) -> np.ndarray:
    """Finalise 64-bit values: a bijection whose output bits all depend on all input bits."""
    h = h ^ (h >> U(30))
    h = h * U(0xBF58476D1CE4E5B9)
    h ^= h >> U(27)
    h *= U(0x94D049BB133111EB)
    h ^= h >> U(31)
    return h


def constants(n: int, seed: int) -> np.ndarray:
    """``n`` fixed odd 64-bit multipliers."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) * U(_BASE) + U(seed)) | U(1)


_powers: dict[int, np.ndarray] = {}


def powers(n: int, inverse: bool = False) -> np.ndarray:
    """Powers of the rolling-hash base (or of its inverse modulo 2^64), at least ``n`` of them."""
    have = _powers.get(inverse)
    if have is None or len(have) < n:
        p = np.full(max(n, SLICE_BYTES + 1), U(_BASE_INV if inverse else _BASE))
        p[0] = U(1)
        have = np.multiply.accumulate(p)
        if n <= SLICE_BYTES + 1:  # the table of a text longer than a slice is not kept
            _powers[inverse] = have
    return have


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of every ``data[s:e]``, equal for equal bytes wherever they stand."""
    prefix = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + U(1)) * powers(len(data))[:len(data)], out=prefix[1:])
    return mix((prefix[ends] - prefix[starts]) * powers(len(data) + 1, True)[starts]
               + (ends - starts).astype(np.uint64))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of words (non-empty spans that do not overlap), equal for equal bytes.

    The sum of a well-mixed number for each (byte, place in the word): unlike a polynomial it has no structure that
    periodic or doubled words could defeat.
    """
    if not len(starts):
        return np.zeros(0, np.uint64)
    sizes = ends - starts
    first = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    place = np.arange(int(sizes.sum())) - np.repeat(first, sizes)
    cells = place.astype(np.uint64) << U(8) | data[place + np.repeat(starts, sizes)]
    return mix(np.add.reduceat(mix(cells * U(_BASE) + U(0x5851F42D4C957F2D)), first) + sizes.astype(np.uint64))


def lean(run: Callable) -> Callable:
    """``run`` for mapInArrow that gives freed memory back when its partition ends.

    Python workers are reused; what their allocators hold back stays beside the executor's heap
    through later stages, also those without Python.
    """

    def leaner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
        if trim is not None:
            trim(0)

    return leaner


def text_slices(batch: pa.RecordBatch, column: str,
                limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Yield (first row, end row, bytes, offsets) pieces of a string column, about ``limit`` bytes each."""
    col = batch.column(batch.schema.get_field_index(column))
    if col.null_count:
        col = col.fill_null("")
    if not len(col):
        return
    wide = pa.types.is_large_string(col.type)
    _, offs, data = col.buffers()
    offs = np.frombuffer(offs, np.int64 if wide else np.int32)[col.offset:col.offset + len(col) + 1].astype(np.int64)
    flat = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(col):
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + limit, "right")) - 1)
        hi = min(hi, len(col))
        yield lo, hi, flat[offs[lo]:offs[hi]], offs[lo:hi + 1] - offs[lo]
        lo = hi


def ids_of(batch: pa.RecordBatch, column: str = "doc_id") -> np.ndarray:
    """A non-null long column as numpy."""
    return batch.column(batch.schema.get_field_index(column)).to_numpy(zero_copy_only=False).astype(np.int64)


def word_spans(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the runs of word bytes, which no text boundary crosses, and the first word of each text."""
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = is_word[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    starts = np.flatnonzero(inside[1:] & (~inside[:-1] | edge))
    ends = np.flatnonzero(inside[:-1] & (~inside[1:] | edge))
    return starts, ends, np.searchsorted(starts, offsets)


def signed(a: np.ndarray) -> np.ndarray:
    """64-bit hashes as the signed longs Spark holds."""
    return np.ascontiguousarray(a).view(np.int64)
