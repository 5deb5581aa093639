"""Anchor keys of the bucket counts that only very large inputs have."""

import numpy as np
import pyarrow as pa
import pytest

from routelens.llm import suffix_dedup


def test_anchors_in_the_upper_half_of_the_buckets():
    rng = np.random.default_rng(3)
    raw = [rng.integers(97, 123, 3000).astype(np.uint8).tobytes() for _ in range(30)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(30), pa.int64()), pa.array([r.decode() for r in raw])], ["tid", "text"])
    buckets = suffix_dedup.MAX_BUCKETS
    want = set()
    for tid, r in enumerate(raw):
        code = suffix_dedup._runs(np.frombuffer(r, np.uint8), np.array([0, len(r)]), 50, buckets)[3]
        want |= {(tid, int(c)) for c in code}
    got = set()
    for out in suffix_dedup._anchor_blobs(50, buckets)(iter([batch])):
        for row in out.to_pylist():
            tid, low, local, _ = suffix_dedup._unpack(row["blob"])
            got |= {(int(t), int(c) | row["bucket"] << 32) for t, c in zip(tid[local], np.cumsum(low, dtype=np.int64))}
    assert max(c >> 32 for _, c in want) >= 1 << 17
    assert got == want
    with pytest.raises(ValueError):
        suffix_dedup._anchor_blobs(50, 2 * buckets)
