"""Repeated-passage removal with suffix arrays built by two-stage sorting.

Every byte of a document that lies in a ``width``-byte string which also starts in a document with
a smaller id is removed; matches never cross documents and are judged on the input.

Which strings must be compared is found by winnowing: the smallest hash of the ``width - GRAM + 1``
``GRAM``-byte strings of a window depends on the window alone, so equal windows have equal anchors.
Anchors are dealt by hash as packed arrays, those met in one text only are dropped, and the rest go
back to their texts.  The runs of windows that share an anchor, as byte segments, are dealt by anchor
again: all equal windows of the corpus meet in one bucket.  There a suffix array over the distinct
segments is sorted in two stages: suffixes smaller than their successors are sorted directly, the
others are induced by a scan over the first-byte buckets; neighbours with a common prefix of
``width`` bytes form classes, and a class's smallest document decides.

Hot content: a batch sends a segment once, for its smallest document; within the batch larger
documents with the same segment are decided on the spot.  Copies of a whole text are one text.  A
bucket's distinct segments are sorted in chunks; a single anchor with more segments than a chunk
has its windows dealt by content into several.

Defined cases: null text is empty; texts shorter than ``width`` lose nothing; rows with a null id are
returned whole and compared with nothing; rows that share an id are judged each against smaller ids
only; repeated rows get equal results; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import U, ids_of, lean, mix, powers, signed, span_hashes, stage, text_slices

GRAM = 20
MAX_RUN = 256
CHUNK_BYTES = 1 << 20
BUCKET_BYTES = 16 << 20
MAX_BUCKETS = 1 << 18
BATCH_ROWS = 1 << 14
TEXT_ROWS = 1 << 10     # texts packed or unpacked at once
PACK_LEVEL = 6          # of the compression of texts that cross a shuffle


# ---------------------------------------------------------------- suffix arrays

def _words(t: np.ndarray, width: int) -> np.ndarray:
    """The eight bytes from each position on as one number; positions past the end count as zeros."""
    padded = np.zeros(len(t) + width + 16, np.uint8)
    padded[:len(t)] = t
    return np.ndarray((len(t) + width + 8,), ">u8", padded.tobytes(), strides=(1,)).astype(np.uint64)


def _direct_sort(at: np.ndarray, words: np.ndarray, depth: int) -> np.ndarray:
    """Positions ``at`` ordered by the ``depth`` bytes that follow, refining ties eight bytes at a time."""
    if not len(at):
        return at
    order = at[np.argsort(words[at], kind="stable")]
    tied = np.arange(len(order))
    group = np.zeros(len(order), np.int64)
    key = words[order]
    for offset in range(8, depth, 8):
        change = np.concatenate(([True], (key[1:] != key[:-1]) | (group[1:] != group[:-1])))
        group = np.cumsum(change)
        alone = change & np.concatenate((change[1:], [True]))
        tied, group = tied[~alone], group[~alone]
        if not len(tied):
            break
        part = order[tied]
        key = words[part + offset]
        inner = np.lexsort((key, group))
        order[tied] = part[inner]
        key = key[inner]
    return order


def suffix_array(t: np.ndarray, depth: int) -> np.ndarray:
    """All suffixes of ``t`` in order of (at least) their first ``depth`` bytes, by two-stage sorting."""
    n = len(t)
    if not n:
        return np.zeros(0, np.int64)
    step = np.diff(t.astype(np.int16), append=-1)
    later = np.flatnonzero(step)
    smaller = step[later[np.searchsorted(later, np.arange(n))]] > 0  # smaller than its successor
    words = _words(t, depth + 8)
    direct = _direct_sort(np.flatnonzero(smaller), words, depth + 8)
    ends = np.searchsorted(t[direct], np.arange(257))
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    waiting[t[-1]].append(np.array([n - 1]))
    out: list[np.ndarray] = []

    def induce(found: np.ndarray, here: int) -> np.ndarray:
        """Deal the predecessors that are larger than ``found`` to their buckets; those of this one come back."""
        before = found[found > 0] - 1
        before = before[~smaller[before]]
        first = t[before]
        order = np.argsort(first, kind="stable")
        before, first = before[order], first[order]
        cut = np.flatnonzero(np.diff(first)) + 1
        own = np.zeros(0, np.int64)
        for part in np.split(before, cut) if len(before) else ():
            if t[part[0]] == here:
                own = part
            else:
                waiting[t[part[0]]].append(part)
        return own

    for c in range(256):
        found = np.concatenate(waiting[c]) if waiting[c] else np.zeros(0, np.int64)
        while len(found):
            out.append(found)
            found = induce(found, c)
        found = direct[ends[c]:ends[c + 1]]
        if len(found):
            out.append(found)
            induce(found, c)
    return np.concatenate(out)


def common_prefix_reaches(t: np.ndarray, sa: np.ndarray, width: int) -> np.ndarray:
    """For each neighbour pair of the suffix array: is their common prefix ``width`` bytes or longer."""
    words = _words(t, width)
    same = np.ones(max(0, len(sa) - 1), bool)
    for offset in [*range(0, width - 7, 8), width - 8]:
        at = np.flatnonzero(same)
        same[at] = words[sa[at] + offset] == words[sa[at + 1] + offset]
    return same & (sa[1:] + width <= len(t)) & (sa[:-1] + width <= len(t))


def _window_lows(data: np.ndarray, sizes: np.ndarray, low: np.ndarray, width: int) -> np.ndarray:
    """For each window of the segments in ``data``: the smallest ``low`` of a segment that holds it."""
    begin = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    windows = sizes - width + 1
    slot = np.full(len(data), -1, np.int64)
    starts = np.repeat(begin, windows) + _ramps(windows)
    slot[starts] = np.arange(len(starts))
    owner = np.repeat(low, windows)
    sa = suffix_array(data, width)
    classes = np.concatenate(([0], np.cumsum(~common_prefix_reaches(data, sa, width))))
    real = slot[sa] >= 0
    at, classes = slot[sa[real]], classes[real]
    if not len(at):
        return owner
    cut = np.concatenate(([0], np.flatnonzero(np.diff(classes)) + 1))
    least = np.minimum.reduceat(owner[at], cut)
    out = np.empty(len(starts), np.int64)
    out[at] = np.repeat(least, np.diff(np.append(cut, len(at))))
    return out


def _ramps(sizes: np.ndarray) -> np.ndarray:
    """0, 1, .. size - 1 for each size, one after the other."""
    total = int(sizes.sum())
    return np.arange(total) - np.repeat(np.cumsum(sizes) - sizes, sizes)


# ---------------------------------------------------------------- anchors

def _runs(data: np.ndarray, offsets: np.ndarray, width: int, buckets: int) -> tuple[np.ndarray, ...]:
    """(text, start in ``data``, windows, code) of each run of windows with one anchor."""
    spread = width - GRAM + 1
    n = len(data) - width + 1
    if n <= 0:
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    prefix = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + U(1)) * powers(len(data))[:len(data)], out=prefix[1:])
    low = mix((prefix[GRAM:] - prefix[:-GRAM]) * powers(len(data) + 1, True)[:len(data) - GRAM + 1])
    have = 1
    while have * 2 <= spread:
        low = np.minimum(low[:-have], low[have:])
        have *= 2
    if have < spread:
        low = np.minimum(low[:len(low) - (spread - have)], low[spread - have:])
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[:n]
    inside = np.arange(n) + width <= offsets[1:][text]
    cut = np.ones(n, bool)
    cut[1:] = (low[1:] != low[:-1]) | (text[1:] != text[:-1]) | ~inside[:-1]
    cut |= (np.arange(n) - offsets[:-1][text]) % MAX_RUN == 0
    cut &= inside
    start = np.flatnonzero(cut)
    # a run ends where the next begins or where its text has no window left
    stop = np.minimum(np.append(start[1:], n), offsets[1:][text[start]] - width + 1)
    value = low[start]
    code = ((value >> U(40)) % U(buckets) << U(32) | (value & U(0xFFFFFFFF))).astype(np.int64)
    return text[start], start, stop - start, code


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo in range(0, batch.num_rows, BATCH_ROWS):
            yield batch.slice(lo, BATCH_ROWS)


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed string; each is stored byte plane by byte plane, which compresses better."""
    import zstandard
    parts = [np.array([len(arrays)], np.int64).tobytes()]
    for a in arrays:
        a = np.ascontiguousarray(a)
        parts += [np.array([len(a), a.dtype.itemsize, ord(a.dtype.kind)], np.int64).tobytes(),
                  a.view(np.uint8).reshape(len(a), a.dtype.itemsize).T.tobytes()]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(parts))


def _unpack(raw: bytes) -> list[np.ndarray]:
    import zstandard
    raw = zstandard.ZstdDecompressor().decompress(raw)
    out, at = [], 8
    for _ in range(int(np.frombuffer(raw, np.int64, 1)[0])):
        n, size, kind = (int(x) for x in np.frombuffer(raw, np.int64, 3, at))
        planes = np.frombuffer(raw, np.uint8, n * size, at + 24).reshape(size, n)
        out.append(np.ascontiguousarray(planes.T).reshape(-1).view(f"{chr(kind)}{size}"))
        at += 24 + n * size
    return out


def _anchor_blobs(width: int, buckets: int):
    """Per batch and bucket the anchors with the text they stand in; those of several texts are marked."""
    if buckets > MAX_BUCKETS:
        raise ValueError(f"at most {MAX_BUCKETS} buckets")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _batches(batches):
            tids = ids_of(batch, "tid")
            fresh = np.zeros(len(tids), bool)
            fresh[np.unique(tids, return_index=True)[1]] = True  # a copy adds nothing
            keys = []
            for lo, _, data, offsets in text_slices(batch, "text"):
                text, _, _, code = _runs(data, offsets, width, buckets)
                mine = fresh[lo + text]
                # 18 bits of bucket, 32 of code and 14 of row: all 64, hence unsigned
                keys.append(np.unique(code[mine].astype(U) << U(14) | (lo + text[mine]).astype(U)))
            if not keys:
                continue
            keys = np.sort(np.concatenate(keys))
            code, text = (keys >> U(14)).astype(np.int64), (keys & U(BATCH_ROWS - 1)).astype(np.int64)
            first = np.concatenate(([True], code[1:] != code[:-1])) if len(code) else np.zeros(0, bool)
            several = ~(first & np.concatenate((first[1:], [True]))) if len(code) else first
            cut = np.searchsorted(code, np.arange(buckets + 1) << 32)
            out_bucket, out_blob = [], []
            for b in np.flatnonzero(np.diff(cut)):
                part = slice(cut[b], cut[b + 1])
                low = (code[part] & 0xFFFFFFFF).astype(np.int64)
                out_bucket.append(int(b))
                used, local = np.unique(text[part], return_inverse=True)
                out_blob.append(_pack(tids[used], np.diff(low, prepend=0).astype(np.uint32), local.astype(np.uint16),
                                      (several[part] * 2 + first[part]).astype(np.uint8)))
            yield pa.RecordBatch.from_arrays([pa.array(out_bucket, pa.int64()), pa.array(out_blob, pa.binary())],
                                             ["bucket", "blob"])

    return run


def _per_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[dict], pa.RecordBatch | None]]:
    """Rows with a blob, bucket by bucket, from rows sorted by bucket; rows without one come at once."""
    held, bucket = [], None
    for batch in batches:
        blobs = batch.column(batch.schema.get_field_index("blob"))
        plain = batch.filter(blobs.is_null())
        if plain.num_rows:
            yield -1, [], plain
        for row in batch.filter(blobs.is_valid()).select(["bucket", "blob"]).to_pylist():
            if row["bucket"] != bucket and held:
                yield bucket, held, None
                held = []
            bucket = row["bucket"]
            held.append(row)
    if held:
        yield bucket, held, None


def _shared_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(tid, code) of every anchor that stands in several texts."""
    for bucket, rows, _ in _per_bucket(batches):
        lows, tids = [], []
        for row in rows:
            tid, low, local, mark = _unpack(row["blob"])
            low = np.cumsum(low, dtype=np.int64)
            known = mark >= 2  # met twice in its own batch: decided, one of them also stands for the batch
            if known.any():
                yield _codes(bucket, tid[local[known]], low[known])
            lead = mark % 2 == 1
            lows.append(low[lead])
            tids.append(tid[local[lead]])
        low, tid = np.concatenate(lows), np.concatenate(tids)
        order = np.lexsort((tid, low))
        low, tid = low[order], tid[order]
        cut = np.concatenate(([0], np.flatnonzero(np.diff(low)) + 1)) if len(low) else np.zeros(0, np.int64)
        size = np.diff(np.append(cut, len(low)))
        several = np.repeat(tid[cut] != tid[cut + size - 1], size)
        yield _codes(bucket, tid[several], low[several])


def _codes(bucket: int, tid: np.ndarray, low: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(tid), pa.array(low | bucket << 32)], ["tid", "code"])


# ---------------------------------------------------------------- segments

SEGMENT_ROWS = "bucket long, blob binary, doc_id long, tid long, lo long, hi long"


def _ranges(doc: np.ndarray, tid: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> pa.RecordBatch:
    n = len(doc)
    return pa.RecordBatch.from_arrays(
        [pa.array(doc % 4096, pa.int64()), pa.nulls(n, pa.binary()), *(pa.array(x, pa.int64()) for x in (doc, tid, lo, hi))],
        ["bucket", "blob", "doc_id", "tid", "lo", "hi"])


def _segment_blobs(width: int, buckets: int):
    """The segments at shared anchors, packed per bucket; ranges that the batch itself decides pass by."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _batches(batches):
            docs, tids = ids_of(batch), ids_of(batch, "tid")
            wanted = batch.column(batch.schema.get_field_index("codes"))
            cols: dict[str, list[np.ndarray]] = {k: [] for k in ("row", "at", "n", "code", "h")}
            pieces: list[np.ndarray] = []
            for lo, _, data, offsets in text_slices(batch, "text"):
                text, start, n, code = _runs(data, offsets, width, buckets)
                keep = np.zeros(len(text), bool)
                cut = np.searchsorted(text, np.arange(len(offsets)))
                for k in np.flatnonzero(np.diff(cut)):
                    part = slice(cut[k], cut[k + 1])
                    codes = np.sort(wanted[int(lo + k)].values.to_numpy())
                    at = np.minimum(np.searchsorted(codes, code[part]), len(codes) - 1)
                    keep[part] = codes[at] == code[part]
                text, start, n, code = text[keep], start[keep], n[keep], code[keep]
                cols["row"].append(lo + text)
                cols["at"].append(start - offsets[text])
                cols["n"].append(n)
                cols["code"].append(code)
                cols["h"].append(signed(span_hashes(data, start, start + n + width - 1)))
                size = n + width - 1
                pieces.append(data[np.repeat(start, size) + _ramps(size)])
            if not cols["row"]:
                continue
            row, at, n, code, h = (np.concatenate(cols[k]).astype(np.int64) for k in ("row", "at", "n", "code", "h"))
            if not len(row):
                continue
            data = np.concatenate(pieces)
            size = n + width - 1
            begin = np.cumsum(size) - size
            doc = docs[row]
            order = np.lexsort((at, doc, h, code))
            first = np.concatenate(([True], (code[order][1:] != code[order][:-1]) | (h[order][1:] != h[order][:-1])))
            group = np.cumsum(first) - 1
            least = doc[order][first][group]
            decided = order[doc[order] > least]
            if len(decided):  # the same segment stands in a smaller document of the batch
                decided = decided[np.lexsort((at[decided], row[decided]))]
                r, lo_b, hi_b = row[decided], at[decided], at[decided] + size[decided]
                new = np.concatenate(([True], (r[1:] != r[:-1]) | (lo_b[1:] > hi_b[:-1])))
                cut = np.flatnonzero(new)
                yield _ranges(docs[r[cut]], tids[r[cut]], lo_b[cut], np.maximum.reduceat(hi_b, cut))
            sent = doc[order] == least
            entry, lead, group = order[sent], order[first], group[sent]
            cut_e = np.searchsorted(code[entry], np.arange(buckets + 1) << 32)
            cut_s = np.searchsorted(code[lead], np.arange(buckets + 1) << 32)
            names, blobs = [], []
            for b in np.flatnonzero(np.diff(cut_e)):
                e, s = entry[cut_e[b]:cut_e[b + 1]], lead[cut_s[b]:cut_s[b + 1]]
                names.append(int(b))
                blobs.append(_pack(code[s], h[s], n[s].astype(np.uint16), data[np.repeat(begin[s], size[s]) + _ramps(size[s])],
                                   (group[cut_e[b]:cut_e[b + 1]] - cut_s[b]).astype(np.uint32), doc[e], tids[row[e]], at[e]))
            k = len(names)
            yield pa.RecordBatch.from_arrays(
                [pa.array(names, pa.int64()), pa.array(blobs, pa.binary()), *(pa.nulls(k, pa.int64()) for _ in range(4))],
                ["bucket", "blob", "doc_id", "tid", "lo", "hi"])

    return run


def _decide(width: int):
    """(doc_id, tid, lo, hi) of repeated ranges: a suffix array over each bucket's distinct segments."""

    def lows(data: np.ndarray, begin: np.ndarray, size: np.ndarray, low: np.ndarray, code: np.ndarray) -> np.ndarray:
        """Smallest document per window, segment after segment; segments come sorted by anchor code."""
        windows = size - width + 1
        place = np.cumsum(windows) - windows
        out = np.empty(int(windows.sum()), np.int64)
        cut = np.append(np.concatenate(([0], np.flatnonzero(np.diff(code)) + 1)), len(code))
        i = 0
        while i < len(cut) - 1:
            j = i + 1
            weight = int(size[cut[i]:cut[j]].sum())
            while j < len(cut) - 1 and weight + int(size[cut[j]:cut[j + 1]].sum()) <= CHUNK_BYTES:
                weight += int(size[cut[j]:cut[j + 1]].sum())
                j += 1
            s = slice(cut[i], cut[j])
            here = slice(place[s][0], place[s][0] + int(windows[s].sum()))
            if weight <= 4 * CHUNK_BYTES:
                chunk = data[np.repeat(begin[s], size[s]) + _ramps(size[s])]
                out[here] = _window_lows(chunk, size[s], low[s], width)
            else:  # one crowded anchor: its windows by content, each a segment of its own
                at = np.repeat(begin[s], windows[s]) + _ramps(windows[s])
                owner = np.repeat(low[s], windows[s])
                share = 1 + len(at) * width // CHUNK_BYTES
                which = np.empty(len(at), np.int64)
                for k in range(0, len(at), CHUNK_BYTES):
                    w = np.repeat(at[k:k + CHUNK_BYTES], width) + np.tile(np.arange(width), len(at[k:k + CHUNK_BYTES]))
                    ends = np.arange(1, len(w) // width + 1) * width
                    which[k:k + CHUNK_BYTES] = (span_hashes(data[w], ends - width, ends) % U(share)).astype(np.int64)
                got = np.empty(len(at), np.int64)
                for k in range(share):
                    pick = np.flatnonzero(which == k)
                    one = np.full(len(pick), width)
                    got[pick] = _window_lows(data[np.repeat(at[pick], width) + _ramps(one)], one, owner[pick], width)
                out[here] = got
            i = j
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows, plain in _per_bucket(batches):
            if plain is not None:
                yield plain.select(["doc_id", "tid", "lo", "hi"])
                continue
            cols: list[list[np.ndarray]] = [[] for _ in range(8)]
            shift = 0
            for row in rows:
                parts = _unpack(row["blob"])
                parts[4] = parts[4].astype(np.int64) + shift
                shift += len(parts[0])
                for c, p in zip(cols, parts):
                    c.append(p)
            code, h, n, data, entry, doc, tid, at = (np.concatenate(c) for c in cols)
            size = n.astype(np.int64) + width - 1
            begin = np.cumsum(size) - size
            order = np.lexsort((h, code))
            first = np.concatenate(([True], (code[order][1:] != code[order][:-1]) | (h[order][1:] != h[order][:-1])))
            of = np.empty(len(code), np.int64)
            of[order] = np.cumsum(first) - 1
            lead = order[first]
            mine = of[entry]
            low = np.full(len(lead), np.iinfo(np.int64).max)
            np.minimum.at(low, mine, doc)
            window = lows(data, begin[lead], size[lead], low, code[lead])
            windows = size[lead] - width + 1
            place = np.cumsum(windows) - windows
            for k in range(0, len(mine), 1 << 16):  # entries against their segment's windows
                m, d = mine[k:k + (1 << 16)], doc[k:k + (1 << 16)]
                count = windows[m]
                ramp = _ramps(count)
                hit = window[np.repeat(place[m], count) + ramp] < np.repeat(d, count)
                owner = np.repeat(np.arange(len(m)), count)
                opens = hit & (np.concatenate(([True], ~hit[:-1])) | (ramp == 0))
                closes = hit & (np.concatenate((~hit[1:], [True])) | np.concatenate((ramp[1:] == 0, [True])))
                a, b = np.flatnonzero(opens), np.flatnonzero(closes)
                e = owner[a] + k
                yield _ranges(doc[e], tid[e], at[e] + ramp[a], at[e] + ramp[b] + width).select(["doc_id", "tid", "lo", "hi"])

    return run


# ---------------------------------------------------------------- the operator

def _tid(text: Column) -> Column:
    return F.xxhash64(text)


def _packed(df: DataFrame, column: str) -> DataFrame:
    """``df`` with the texts of ``column`` compressed one by one: so they cross a shuffle in half the bytes."""
    at = df.columns.index(column)
    schema = T.StructType([T.StructField(f.name, T.BinaryType() if i == at else f.dataType) for i, f in enumerate(df.schema)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard
        press = zstandard.ZstdCompressor(level=PACK_LEVEL, write_checksum=False, write_dict_id=False)
        for batch in batches:
            for lo in range(0, batch.num_rows, TEXT_ROWS):
                columns = list(batch.slice(lo, TEXT_ROWS).columns)
                columns[at] = pa.array([None if t is None else press.compress(t) for t in columns[at].cast(pa.binary()).to_pylist()], pa.binary())
                yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return df.mapInArrow(lean(run), schema)


def _texts(batches: Iterator[pa.RecordBatch], column: str, rows: int) -> Iterator[pa.RecordBatch]:
    """Batches with the packed texts of ``column`` as strings again, some rows at a time."""
    import zstandard
    press = zstandard.ZstdDecompressor()
    for batch in batches:
        at = batch.schema.get_field_index(column)
        for lo in range(0, batch.num_rows, rows):
            columns = list(batch.slice(lo, rows).columns)
            raw = (None if not t.is_valid else press.decompress(t.as_buffer()) for t in columns[at])
            columns[at] = pa.array(raw, pa.large_binary()).cast(pa.large_string())
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)


def repeated_ranges(docs: DataFrame, width: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, tid, spans): for texts with repeats the byte ranges (sorted, they may overlap), by id and text hash."""
    if width < GRAM + 4:
        raise ValueError(f"width must be at least {GRAM + 4}")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = (docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"))
            .where("doc_id is not null").withColumn("tid", _tid(F.col("text"))))
    listed = stage(rows.select("doc_id", "tid", F.md5(F.col("text").cast("binary")).alias("md5"),
                               F.octet_length("text").cast("long").alias("size")), "suffix-texts")
    classes = listed.groupBy("tid", "md5", "size").agg(F.min("doc_id").alias("low"))
    copies = (listed.join(classes, ["tid", "md5", "size"]).where(f"doc_id > low and size >= {width}")
              .select("doc_id", "tid", F.array(F.struct(F.lit(0).cast("long").alias("lo"), F.col("size").alias("hi"))).alias("spans"))
              .dropDuplicates(["doc_id", "tid"]))
    total = classes.agg(F.sum("size")).first()[0] or 0
    buckets = int(min(MAX_BUCKETS, max(16, total // BUCKET_BYTES)))
    dealt = rows.select("tid", "text").mapInArrow(lean(_anchor_blobs(width, buckets)), "bucket long, blob binary")
    shared = (dealt.repartition(min(buckets, 8192), "bucket").sortWithinPartitions("bucket")
              .mapInArrow(lean(_shared_anchors), "tid long, code long")
              .groupBy("tid").agg(F.collect_set("code").alias("codes")))
    first = classes.groupBy("tid").agg(F.min("low").alias("doc_id"))
    cut = _segment_blobs(width, buckets)
    texts = _packed(rows, "text").join(shared.join(first, "tid").select("doc_id", F.col("tid").alias("t"), "codes"), "doc_id")
    segments = texts.where("tid = t").select("doc_id", "tid", "text", "codes").mapInArrow(
        lean(lambda batches: cut(_texts(batches, "text", BATCH_ROWS // 4))), SEGMENT_ROWS)
    ranges = (segments.repartition(min(buckets, 8192), "bucket").sortWithinPartitions("bucket")
              .mapInArrow(lean(_decide(width)), "doc_id long, tid long, lo long, hi long"))
    spans = ranges.groupBy("doc_id", "tid").agg(F.sort_array(F.collect_list(F.struct("lo", "hi"))).alias("spans"))
    return stage(spans.unionByName(copies), "suffix-spans")


def _merged(spans: list[dict]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s in spans:
        if out and s["lo"] <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], s["hi"]))
        else:
            out.append((s["lo"], s["hi"]))
    return out


def _cut(raw: bytes, spans: list[tuple[int, int]]) -> bytes:
    at, parts = 0, []
    for lo, hi in spans:
        parts.append(raw[at:lo])
        at = hi
    return b"".join([*parts, raw[at:]])


def _with_spans(docs: DataFrame, width: int, id_col: str, text_col: str) -> DataFrame:
    """``docs`` with packed texts and the spans found in them (``_spans``, null: none)."""
    found = repeated_ranges(docs, width, id_col, text_col).withColumnsRenamed({"doc_id": "_id", "tid": "_tid", "spans": "_spans"})
    own = docs.drop("_id", "_tid", "_spans").withColumns({
        "_own_id": F.col(id_col).cast("long"), "_own_tid": _tid(F.coalesce(F.col(text_col).cast("string"), F.lit(""))),
        text_col: F.col(text_col).cast("string")})
    packed = _packed(own, text_col)
    return packed.join(found, (F.col("_own_id") == F.col("_id")) & (F.col("_own_tid") == F.col("_tid")), "left")


def remove_repeats(docs: DataFrame, width: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the repeated bytes cut out of its texts; a character cut in two goes whole."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _texts(batches, text_col, TEXT_ROWS):
            spans = batch.column(batch.num_columns - 1).to_pylist()
            texts = [t if not s else _cut(t.encode(), _merged(s)).decode("utf-8", "ignore")
                     for t, s in zip(batch.column(at).to_pylist(), spans)]
            columns = list(batch.columns[:-1])
            columns[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names[:-1])

    joined = _with_spans(docs, width, id_col, text_col)
    return joined.select(*docs.columns, "_spans").mapInArrow(lean(run), docs.schema)


def repeat_report(docs: DataFrame, width: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: n_bytes, n_removed, n_spans and the SHA-256 of the bytes that stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard
        press = zstandard.ZstdDecompressor()
        for batch in batches:
            rows = []
            for text, found in zip(batch.column(1), batch.column(2).to_pylist()):
                raw, spans = press.decompress(text.as_buffer()) if text.is_valid else b"", _merged(found or [])
                rows.append((len(raw), sum(b - a for a, b in spans), len(spans), hashlib.sha256(_cut(raw, spans)).hexdigest()))
            n = list(zip(*rows)) or [[]] * 4
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(list(c), pa.int64()) for c in n[:3]), pa.array(list(n[3]), pa.string())],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    joined = _with_spans(docs, width, id_col, text_col)
    return joined.select(F.col("_own_id").alias("doc_id"), F.col(text_col).alias("text"), "_spans").mapInArrow(
        lean(run), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
