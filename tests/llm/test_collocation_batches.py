"""Counting tasks send small batches, whatever the number of phrases of a block."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from llm import collocations as C


def test_counts_come_in_small_batches():
    hashes = np.concatenate([np.arange(3 * C.BATCH, dtype=np.uint64), np.arange(10, dtype=np.uint64)])
    parts = list(C.tallied(hashes))
    assert len(parts) == 3 and all(len(found) <= C.BATCH for found, _ in parts)
    counted = dict(zip(pa.concat_arrays([f for f, _ in parts]).to_pylist(), pa.concat_arrays([n for _, n in parts]).to_pylist(), strict=True))
    assert counted == {i: 2 if i < 10 else 1 for i in range(3 * C.BATCH)}
