"""Token-id files: flat unsigned integers plus 64-bit document offsets, read through a memory map.

``write_token_files`` sorts the documents by id over ranges; each task streams one ``.bin`` (ids,
16 bits wide when the vocabulary allows, else 32) and one ``.idx`` file (64-bit: number of
documents, ids, then the n + 1 offsets).  A file's place in the whole sequence is the prefix sum
of the sizes before it.  Every attempt writes files of its own and only those named in the staged
manifest count, so a lost executor or a repeated task leaves at most unused files.

Folders are opened with ``pyarrow.fs`` (``file:``, ``hdfs:``, ``s3:``, ``gs:`` and plain paths).
Files on a mounted folder are memory-mapped, those of an object store are read document range by
document range.

Defined cases: null text is empty (its document holds the end id only); a null id cannot be
stored, such rows are left out; repeated ids and repeated rows are documents of their own, ordered
by id and text; an empty table gives an empty manifest; other columns are ignored.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import keyed_texts, open_folder, shared_path, stage
from .tokens import encoded, vocabulary_path

FILE_FIELDS = "bin string, idx string, width int, n_docs long, n_ids long, first_id long"
READ_BYTES = 8 << 20
WRITE_BYTES = 4 << 20


def write_token_files(docs: DataFrame, folder: str, vocabulary: str, end_id: int = 0, width: int | None = None,
                      id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write ``docs`` as token files below ``folder``; one manifest row per file with its ``base``."""
    spark = docs.sparkSession
    if width is None:
        from tokenizers import Tokenizer
        width = 2 if max(Tokenizer.from_file(vocabulary).get_vocab_size() - 1, end_id) < 1 << 16 else 4

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = open_folder(folder)
        name, end = f"{root}/ids-{uuid.uuid4().hex}", np.uint32(end_id).tobytes()
        ids: list[np.ndarray] = []
        sizes: list[int] = []
        out = None
        for batch in batches:
            if not batch.num_rows:
                continue
            if out is None:
                fs.create_dir(root, recursive=True)
                out = fs.open_output_stream(name + ".bin")
            ids.append(batch.column(0).to_numpy())
            held, size = [], 0
            for raw in encoded(batch.column(1).to_pylist(), vocabulary):
                held += (raw, end)
                size += len(raw)
                sizes.append(len(raw) // 4 + 1)
                if size > WRITE_BYTES:
                    out.write(np.frombuffer(b"".join(held), "<u4").astype(f"<u{width}"))
                    held, size = [], 0
            if held:
                out.write(np.frombuffer(b"".join(held), "<u4").astype(f"<u{width}"))
        if out is None:
            return
        out.close()
        docs_here = np.concatenate(ids)
        offsets = np.zeros(len(sizes) + 1, "<i8")
        np.cumsum(sizes, out=offsets[1:])
        with fs.open_output_stream(name + ".idx") as index:
            index.write(np.int64(len(sizes)).tobytes() + docs_here.astype("<i8").tobytes() + offsets.tobytes())
        yield pa.RecordBatch.from_pydict(
            {"bin": [name + ".bin"], "idx": [name + ".idx"], "width": pa.array([width], pa.int32()),
             "n_docs": [len(sizes)], "n_ids": [int(offsets[-1])], "first_id": [int(docs_here[0])]})

    ordered = (keyed_texts(docs, id_col, text_col).where("doc_id is not null")
               .repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text"))
    files = stage(ordered.mapInArrow(write, FILE_FIELDS), "token-manifest")
    # one row per file: the prefix sums are small, whatever the corpus
    rows = sorted(files.collect(), key=lambda r: r["first_id"])
    bases = np.concatenate(([0], np.cumsum([r["n_ids"] for r in rows], dtype=np.int64)))
    listed = [(folder, *r, int(b)) for r, b in zip(rows, bases)]
    return spark.createDataFrame(listed, f"folder string, {FILE_FIELDS}, base long")


def _document_ids(row: dict) -> Iterator[tuple[int, int, np.ndarray]]:
    """(doc id, first position in the file, ids) of every document of one file."""
    fs, _ = open_folder(row["folder"])
    with fs.open_input_file(row["idx"]) as f:
        index = np.frombuffer(f.read(), "<i8")
    n = int(index[0])
    doc_ids, offsets = index[1:n + 1], index[n + 1:]
    kind = np.dtype(f"<u{row['width']}")
    if isinstance(fs, pa.fs.LocalFileSystem):
        ids = np.memmap(row["bin"], kind, "r")
        for i in range(n):
            yield int(doc_ids[i]), int(offsets[i]), ids[offsets[i]:offsets[i + 1]]
        return
    with fs.open_input_file(row["bin"]) as f:
        lo = 0
        while lo < n:
            hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + READ_BYTES // kind.itemsize, "right")) - 1)
            hi = min(hi, n)
            ids = np.frombuffer(f.read_at(int(offsets[hi] - offsets[lo]) * kind.itemsize,
                                          int(offsets[lo]) * kind.itemsize), kind)
            for i in range(lo, hi):
                yield int(doc_ids[i]), int(offsets[i]), ids[offsets[i] - offsets[lo]:offsets[i + 1] - offsets[lo]]
            lo = hi


def read_token_files(manifest: DataFrame, with_ids: bool = False) -> DataFrame:
    """One row per document, read back from the files: doc_id, start, n_tokens, ids_crc32 (and the ids).

    ``start`` counts all ids before the document; the checksum is taken over the ids as
    little-endian unsigned 32-bit integers, whatever the width in the file.
    """
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<long>" if with_ids else "")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "start", "n_tokens", "ids_crc32"] + ["ids"] * with_ids
        for batch in batches:
            for row in batch.to_pylist():
                out: list[tuple] = []
                for doc, at, ids in _document_ids(row):
                    crc = zlib.crc32(ids.astype("<u4").tobytes())
                    out.append((doc, row["base"] + at, len(ids), crc) + ((ids.tolist(),) if with_ids else ()))
                    if len(out) >= 4096:
                        yield pa.RecordBatch.from_pydict(dict(zip(names, map(list, zip(*out)))))
                        out = []
                if out:
                    yield pa.RecordBatch.from_pydict(dict(zip(names, map(list, zip(*out)))))

    spread = manifest.repartition(max(1, manifest.sparkSession.sparkContext.defaultParallelism), F.rand(7))
    return spread.mapInArrow(read, schema)


def token_files(spark: SparkSession, docs: DataFrame, end_id: int = 0, **columns: str) -> DataFrame:
    """Write ``docs`` to a new folder of the shared area and return what the files hold."""
    manifest = write_token_files(docs, shared_path(spark, "token-files"), vocabulary_path(), end_id, **columns)
    return read_token_files(manifest)
