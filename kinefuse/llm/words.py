"""Words of whole texts as hashes in flat arrays: a word is a run of anything but space, tab, line feed, vertical tab, form feed and carriage return."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc

#: Texts are taken in runs of about this many bytes, which bounds a task's memory.
RUN_BYTES = 8_000_000

M1, M2, M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads every input bit over the 64 output bits (the finaliser of SplitMix64)."""
    x = (x ^ (x >> np.uint64(30))) * M2
    x = (x ^ (x >> np.uint64(27))) * M3
    return x ^ (x >> np.uint64(31))


def coded_words(texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Code of each word, the distinct words by code, and where each text's words begin (one more entry than texts)."""
    lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    at = lists.offsets.to_numpy().astype(np.int64)
    flat = lists.flatten()
    full = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)
    coded = flat.filter(pa.array(full)).dictionary_encode()
    begins = np.concatenate(([0], np.cumsum(full)))[at - at[0]]
    return coded.indices.to_numpy(), coded.dictionary, begins


def hashed_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word, the same in every process, and where each text's words begin."""
    codes, words, begins = coded_words(texts)
    if len(words) == 0:
        return np.empty(0, np.uint64), begins
    return pd.util.hash_array(words.to_numpy(zero_copy_only=False).astype(object), categorize=False)[codes], begins


def runs(batches: Iterator[pa.RecordBatch], column: str = "text", run_bytes: int = RUN_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows in slices of about run_bytes of text, one row at least."""
    for batch in batches:
        sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 64)
        start = 0
        while start < batch.num_rows:
            stop = int(np.searchsorted(sizes, (sizes[start - 1] if start else 0) + run_bytes))
            stop = min(batch.num_rows, max(stop, start + 1))
            yield batch.slice(start, stop - start)
            start = stop
