"""MinHash near-duplicates by a multi-index Hamming join of b-bit signatures.

A document's set is its distinct ``shingle`` -word shingles.  Its signature holds 16 bits of each of
60 minimum hashes, cut into 12 chunks of 5 symbols.  By the pigeonhole principle two signatures that
differ in at most 23 symbols agree in some chunk up to one error, so each chunk is entered once for
every symbol left out (5 keys of 64 bits): an equi-join on the 60 keys finds all pairs under the
distance 23, and of the pairs at similarity 0.75 all but about one in 150,000 (those further apart
whose chunks all happen to hold two errors).  Candidates are confirmed on the full sets.

Copies: documents with equal sets are one class, and only its smallest id goes on.  Within a bucket
of a key no pairs are formed at first: every member is checked against the bucket's smallest id
(one candidate per document, the one most of its keys agree on).  The components of the confirmed
links then leave few buckets with members of different components.  There signatures are compared
in blocks of bounded size; documents with close signatures form families (a block returns a forest,
not its pairs).  A family's texts are brought together, in blocks of bounded size again, and every
pair of different components whose signatures are close is confirmed on the full sets; a block
returns a forest of the components it joined.  Pairs inside a component cannot change the result,
so none is lost and no pair is written.

Defined cases: null text is empty and, like a text without words, linked with nothing
(n_shingles 0); a text with fewer words than a shingle is one shingle of all its words; a null id
takes no part (component null, kept true); rows that share an id are one document, whose shingles
are those of its first row in text order; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import U, constants, ids_of, keyed_texts, lean, mix, signed, stage, text_slices, word_hashes, word_spans
from .components import connected_components

CHUNKS, CHUNK = 12, 5
SYMBOLS = CHUNKS * CHUNK
FAR = 34     # differing symbols beyond which similarity 0.75 has a probability under 1e-7
BLOCK_ROWS = 1024             # documents of a bucket compared by signature at once, twice over
BLOCK_SHINGLES = 1 << 20     # shingles of a family compared in full at once, twice over

_A, _B = constants(SYMBOLS, 11), constants(SYMBOLS, 12)
_KEY = constants(SYMBOLS, 13)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_WORD = np.ones(256, bool)
_IS_WORD[[0x20, 9, 10, 11, 12, 13]] = False


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int) -> list[np.ndarray]:
    """The sorted distinct 64-bit shingle hashes of each text of a slice."""
    data = _LOWER[data]
    starts, ends, first = word_spans(data, offsets, _IS_WORD)
    words = word_hashes(data, starts, ends)
    weights = constants(width, 14)
    n = max(0, len(words) - width + 1)
    rolled = np.zeros(n, np.uint64)
    for j in range(width):
        rolled += words[j:j + n] * weights[j]
    rolled = mix(rolled)
    out = []
    for a, b in zip(first[:-1], first[1:]):
        if b - a >= width:
            s = np.sort(rolled[a:b - width + 1])
            out.append(s[np.concatenate(([True], s[1:] != s[:-1]))])
        elif b > a:  # the whole sequence, told from others by its length
            out.append(mix(np.array([(words[a:b] * weights[:b - a]).sum(dtype=np.uint64) + U(b - a)])))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """16 bits of the minimum of each of the hash functions, one row per non-empty set."""
    out = np.zeros((len(sets), SYMBOLS), np.uint16)
    if not sets:
        return out
    flat = np.concatenate(sets)
    at = np.concatenate(([0], np.cumsum([len(s) for s in sets])[:-1]))
    for j in range(SYMBOLS):
        out[:, j] = mix(np.minimum.reduceat(flat * _A[j] + _B[j], at)) >> U(48)
    return out


def index_keys(sig: np.ndarray) -> np.ndarray:
    """The 60 keys of each signature: every chunk with one symbol left out in turn."""
    s = sig.astype(np.uint64).reshape(len(sig), CHUNKS, CHUNK)
    out = np.empty((len(sig), CHUNKS, CHUNK), np.uint64)
    for hole in range(CHUNK):
        key = np.zeros(s.shape[:2], np.uint64)
        for j in range(CHUNK):
            if j != hole:
                key = key << U(16) | s[:, :, j]
        out[:, :, hole] = key
    return mix(out.reshape(len(sig), SYMBOLS) + _KEY) if len(sig) else out.reshape(0, SYMBOLS)


def _sketch(texts: DataFrame, width: int) -> DataFrame:
    """(doc_id, n, f1, f2, sig): set size, order-free fingerprints of the set, signature (null when empty)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for lo, hi, data, offsets in text_slices(batch, "text"):
                sets = shingle_sets(data, offsets, width)
                full = [s for s in sets if len(s)]
                sigs = iter(signatures(full))
                f1 = np.array([mix(s).sum(dtype=np.uint64) for s in sets], np.uint64)
                f2 = np.array([np.bitwise_xor.reduce(mix(s + U(77))) for s in sets], np.uint64)
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(lo, hi - lo), pa.array([len(s) for s in sets], pa.int64()), pa.array(signed(f1)),
                     pa.array(signed(f2)), pa.array([next(sigs).tobytes() if len(s) else None for s in sets], pa.binary())],
                    ["doc_id", "n", "f1", "f2", "sig"])

    return texts.mapInArrow(lean(run), "doc_id long, n long, f1 long, f2 long, sig binary")


def _keys(reps: DataFrame) -> DataFrame:
    """(key, doc, n): the index rows of the class representatives."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 2048):
                part = batch.slice(lo, 2048)
                sig = np.frombuffer(b"".join(part.column(2).to_pylist()), np.uint16).reshape(-1, SYMBOLS)
                keys = index_keys(sig)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(signed(keys.reshape(-1))), pa.array(np.repeat(ids_of(part), SYMBOLS)),
                     pa.array(np.repeat(ids_of(part, "n"), SYMBOLS))], ["key", "doc", "n"])

    return reps.select("doc_id", "n", "sig").mapInArrow(lean(run), "key long, doc long, n long")


def _similar_sizes(percent: int, a: str, b: str):
    return (100 * F.least(a, b)) >= (percent * F.greatest(a, b))


def _confirm(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """The (u, v) of ``pairs`` whose full sets reach the similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            right = text_slices(batch, "text_v", 1 << 19)
            for r_lo, r_hi, data, offsets in right:
                vs = shingle_sets(data, offsets, width)
                part = batch.slice(r_lo, r_hi - r_lo)
                for lo, hi, data_u, offsets_u in text_slices(part, "text_u", 1 << 19):
                    us = shingle_sets(data_u, offsets_u, width)
                    keep = []
                    for a, b in zip(us, vs[lo:hi]):
                        at = np.searchsorted(b, a)
                        both = int((b[np.minimum(at, len(b) - 1)] == a).sum()) if len(b) else 0
                        keep.append(100 * both >= percent * (len(a) + len(b) - both) and both > 0)
                    yield part.slice(lo, hi - lo).select([0, 1]).filter(pa.array(keep))

    needed = texts.join(pairs.select(F.explode(F.array("u", "v")).alias("doc_id")).distinct(), "doc_id", "left_semi")
    needed = stage(needed, "minhash-texts")
    both = (pairs.select("u", "v").join(needed.select(F.col("doc_id").alias("v"), F.col("text").alias("text_v")), "v")
            .join(needed.select(F.col("doc_id").alias("u"), F.col("text").alias("text_u")), "u")
            .select("u", "v", "text_u", "text_v"))
    return both.mapInArrow(lean(run), "u long, v long")


def _merge(label: np.ndarray, x: int, others: np.ndarray) -> np.ndarray:
    """Give everything linked with ``x`` one label; one of ``others`` for each label that was new."""
    roots, at = np.unique(label[others], return_index=True)
    fresh = roots != label[x]
    label[np.isin(label, roots[fresh])] = label[x]
    return others[at[fresh]]


def _grouped(batches: Iterator[pa.RecordBatch], columns: tuple[str, ...]) -> Iterator[pa.Table]:
    """Whole groups of equal ``columns`` from rows that lie in their order."""
    held: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        t = pa.Table.from_batches([batch])
        held = t if held is None else pa.concat_tables([held, t])
        new = np.zeros(held.num_rows, bool)
        for c in columns:
            x = held.column(c).to_numpy()
            new[1:] |= x[1:] != x[:-1]
        cut = [0, *np.flatnonzero(new).tolist()]
        for lo, hi in zip(cut[:-1], cut[1:]):
            yield held.slice(lo, hi - lo).combine_chunks()
        held = held.slice(cut[-1])
    if held is not None and held.num_rows:
        yield held.combine_chunks()


def _close(sig: np.ndarray, n: np.ndarray, x: int, others: np.ndarray, percent: int) -> np.ndarray:
    """Those of ``others`` whose sizes allow the similarity and whose signatures are close enough to matter."""
    low, high = np.minimum(n[others], n[x]), np.maximum(n[others], n[x])
    others = others[100 * low >= percent * high]
    return others[(sig[others] != sig[x]).sum(1) <= FAR] if len(others) else others


def _edges(found: list[tuple[int, int]]) -> pa.RecordBatch:
    e = np.array(found, np.int64).reshape(-1, 2)
    return pa.RecordBatch.from_arrays([pa.array(e[:, 0]), pa.array(e[:, 1])], ["u", "v"])


def _families(rows: DataFrame, percent: int) -> DataFrame:
    """Edges that connect documents with close signatures of different components, a forest per block pair.

    From rows (key, i, j, block, doc, n, comp, sig) sorted by (key, i, j): no longer than its input.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple[int, int]] = []
        for t in _grouped(batches, ("key", "i", "j")):
            i, j = t.column("i")[0].as_py(), t.column("j")[0].as_py()
            block, doc, n, comp = (t.column(c).to_numpy() for c in ("block", "doc", "n", "comp"))
            sig = np.frombuffer(b"".join(t.column("sig").to_pylist()), np.uint16).reshape(-1, SYMBOLS)
            label = np.arange(len(doc))
            right = np.flatnonzero(block == j)
            for x in np.flatnonzero(block == i):
                others = right[right > x] if i == j else right
                others = _close(sig, n, x, others[(comp[others] != comp[x]) & (label[others] != label[x])], percent)
                if len(others):
                    found += [(int(doc[x]), int(doc[y])) for y in _merge(label, x, others)]
            if len(found) >= 1 << 14:
                yield _edges(found)
                found = []
        if found:
            yield _edges(found)

    return rows.mapInArrow(lean(run), "u long, v long")


def _confirm_families(rows: DataFrame, width: int, percent: int) -> DataFrame:
    """(u, v) components that a confirmed pair links, a forest per block pair.

    From rows (family, i, j, block, doc, n, comp, sig, text) sorted by (family, i, j).  Pairs of
    components that the task has joined already are not compared again.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _grouped(batches, ("family", "i", "j")):
            i, j = t.column("i")[0].as_py(), t.column("j")[0].as_py()
            block, n, comp = (t.column(c).to_numpy() for c in ("block", "n", "comp"))
            sig = np.frombuffer(b"".join(t.column("sig").to_pylist()), np.uint16).reshape(-1, SYMBOLS)
            sets: list[np.ndarray] = []
            for batch in t.select(["text"]).to_batches():
                for _, _, data, offsets in text_slices(batch, "text"):
                    sets += shingle_sets(data, offsets, width)
            sizes = np.array([len(s) for s in sets])
            label = np.unique(comp, return_inverse=True)[1]
            right = np.flatnonzero(block == j)
            found: list[tuple[int, int]] = []
            for x in np.flatnonzero(block == i):
                others = right[right > x] if i == j else right
                others = _close(sig, n, x, others[label[others] != label[x]], percent)
                own = sets[x]
                for lo in range(0, len(others), 256):
                    part = others[lo:lo + 256]
                    part = part[label[part] != label[x]]
                    if not len(part):
                        continue
                    flat = np.concatenate([sets[y] for y in part])
                    hit = own[np.minimum(np.searchsorted(own, flat), len(own) - 1)] == flat
                    both = np.add.reduceat(hit, np.cumsum(sizes[part]) - sizes[part], dtype=np.int64)
                    linked = part[100 * both >= percent * (len(own) + sizes[part] - both)]
                    if len(linked):
                        found += [(int(comp[x]), int(comp[y])) for y in _merge(label, x, linked)]
            if found:
                yield _edges(found)

    return rows.mapInArrow(lean(run), "u long, v long")


def _block_of(blocks: Column) -> Column:
    """The block of a row's document, which its id decides."""
    return F.pmod(F.xxhash64("doc"), blocks).cast("int")


def _facing(blocks: Column, mine: Column) -> Column:
    """Explode to the (i, j) pairs of blocks that a row of block ``mine`` takes part in."""
    return F.explode(F.transform(F.sequence(F.lit(0), blocks - 1), lambda k: F.struct(
        F.least(k, mine).alias("i"), F.greatest(k, mine).alias("j"))))


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 75, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (its smallest reachable id), kept."""
    texts = keyed_texts(docs, id_col, text_col)
    every = stage(_sketch(texts, width), "minhash-sketches")
    sketches = every.where("doc_id is not null")
    # rows that share an id are one document
    one = sketches.groupBy("doc_id").agg(F.min(F.struct("n", "f1", "f2", "sig")).alias("s")).select("doc_id", "s.*")
    classes = one.where("n > 0").groupBy("f1", "f2", "n").agg(F.min(F.struct("doc_id", "sig")).alias("m"))
    reps = stage(classes.select("m.doc_id", "n", "m.sig", "f1", "f2"), "minhash-classes")
    keys = _keys(reps)
    buckets = stage(keys.groupBy("key").agg(F.min("doc").alias("low"), F.count(F.lit(1)).alias("rows")).where("rows > 1"),
                    "minhash-buckets")
    members = stage(keys.join(buckets, "key").select("key", "doc", "n", "low", "rows"), "minhash-members")

    # first: every document against the smallest member that most of its keys agree on
    sizes = reps.select(F.col("doc_id").alias("low"), F.col("n").alias("n_low"))
    stars = members.where("doc != low").groupBy("doc", "n", "low").agg(F.count(F.lit(1)).alias("c"))
    stars = stars.join(sizes, "low").where(_similar_sizes(percent, "n", "n_low"))
    stars = stars.groupBy("doc").agg(F.max_by("low", F.struct("c", -F.col("low"))).alias("u"))
    links = stage(_confirm(stars.select("u", F.col("doc").alias("v")), texts, width, percent), "minhash-links")
    near = stage(connected_components(links), "minhash-near")

    # then: buckets that still hold several components
    placed = members.join(near.withColumnRenamed("node", "doc"), "doc", "left").withColumn(
        "comp", F.coalesce("component", "doc")).drop("component")
    mixed = placed.groupBy("key").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1")).where("c0 < c1").select("key")
    blocks = F.ceil(F.col("rows") / F.lit(float(BLOCK_ROWS))).cast("int")
    rows = (placed.join(mixed, "key", "left_semi")
            .join(reps.select(F.col("doc_id").alias("doc"), "sig"), "doc")
            .select("key", _facing(blocks, _block_of(blocks)).alias("f"), _block_of(blocks).alias("block"), "doc", "n", "comp", "sig")
            .select("key", "f.i", "f.j", "block", "doc", "n", "comp", "sig"))
    rows = rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    families = stage(connected_components(_families(rows, percent)), "minhash-families")
    of = near.select(F.col("node").alias("doc"), F.col("component"))
    held = (families.select(F.col("node").alias("doc"), F.col("component").alias("family"))
            .join(reps.select(F.col("doc_id").alias("doc"), "n", "sig"), "doc").join(of, "doc", "left")
            .withColumn("comp", F.coalesce("component", "doc")).drop("component"))
    weight = held.groupBy("family").agg(F.sum("n").alias("weight"))
    blocks = F.ceil(F.col("weight") / F.lit(float(BLOCK_SHINGLES))).cast("int")
    rows = (held.join(weight, "family").join(texts.withColumnRenamed("doc_id", "doc"), "doc")
            .select("family", _facing(blocks, _block_of(blocks)).alias("f"), _block_of(blocks).alias("block"), "doc", "n", "comp", "sig", "text")
            .select("family", "f.i", "f.j", "block", "doc", "n", "comp", "sig", "text"))
    rows = rows.repartition("family", "i", "j").sortWithinPartitions("family", "i", "j")
    merged = _confirm_families(rows, width, percent)
    final = connected_components(merged).select(F.col("node").alias("comp"), F.col("component").alias("top"))

    rep_class = (reps.join(near.withColumnRenamed("node", "doc_id"), "doc_id", "left")
                 .select("f1", "f2", "n", F.coalesce("component", "doc_id").alias("comp"))
                 .join(final, "comp", "left").select("f1", "f2", "n", F.coalesce("top", "comp").alias("component_id")))
    placed_docs = one.drop("sig").join(rep_class, ["f1", "f2", "n"], "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))
    unnamed = every.where("doc_id is null").select("doc_id", F.col("n").alias("n_shingles"),
                                                   F.lit(None).cast("long").alias("component_id"))
    return placed_docs.unionByName(unnamed).withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def drop_near_duplicates(docs: DataFrame, width: int = 5, percent: int = 75, id_col: str = "doc_id",
                         text_col: str = "text") -> DataFrame:
    """``docs`` without the rows whose id is not the smallest of its component, all columns as they are."""
    gone = (near_duplicates(docs, width, percent, id_col, text_col).where("not kept")
            .select(F.col("doc_id").alias("_gone")))
    gone = stage(gone, "minhash-gone")
    own = docs.drop("_gone") if "_gone" in docs.columns else docs
    return own.join(gone, own[id_col].cast("long") == gone["_gone"], "left_anti")
