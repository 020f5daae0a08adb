"""Words and five-word shingles of whole texts, batch by batch.

A word is a maximal run of ASCII letters and digits and of the bytes of other
alphabets, lower-cased; a shingle is the 64-bit hash of consecutive words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from hearth.llm import _arrow as A

SHINGLE = 5


@dataclass
class Words:
    """Words of a run of documents: hashes, byte lengths, first word of each document (docs + 1)."""

    rows: pa.RecordBatch
    hashes: np.ndarray
    sizes: np.ndarray
    first: np.ndarray

    def shingles(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hash of every shingle, its first word, and first shingle of each
        document (docs + 1).  A text of one to four words is one shingle."""
        n, docs = SHINGLE, len(self.first) - 1
        counts = np.diff(self.first)
        doc = np.repeat(np.arange(docs), counts)
        start = np.arange(max(0, len(self.hashes) - n + 1))
        start = start[doc[start] == doc[start + n - 1]] if len(start) else start
        h = A.grams(self.hashes, n)[start]
        short = np.flatnonzero((counts > 0) & (counts < n))
        if len(short):
            own = np.array([A.mix(A.grams(self.hashes[self.first[d]: self.first[d + 1]], int(counts[d])) + np.uint64(counts[d]))[0] for d in short], np.uint64)
            at = np.searchsorted(start, self.first[short])
            h, start = np.insert(h, at, own), np.insert(start, at, self.first[short])
        return h, start, np.searchsorted(start, self.first)


def words(batches: Iterator[pa.RecordBatch], text_col: str) -> Iterator[Words]:
    for batch in batches:
        at = batch.schema.names.index(text_col)
        low = batch.set_column(at, text_col, pc.utf8_lower(batch.column(at)))
        done = 0
        for rows, data, offsets in A.slices(low, text_col):
            starts, ends, first, mask = A.runs(data, offsets, A.ALNUM)
            ids, distinct = A.encode(data, mask, ends - starts)
            hashes = A.stable_hashes(distinct)
            yield Words(batch.slice(done, rows.num_rows), hashes[ids] if len(ids) else np.zeros(0, np.uint64), ends - starts, first)
            done += rows.num_rows
