"""Vectorised text helpers for Arrow batches (run inside Spark tasks).

Everything works on the UTF-8 bytes of a whole batch at once: a flat byte
array plus one offset per document.  Separators are ASCII, so cutting bytes
never cuts a code point.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

#: Text bytes handled at once inside a task; one longer document is handled alone.
SLICE_BYTES = 4 << 20


def lut(chars: bytes) -> np.ndarray:
    """Lookup table: True for the listed bytes."""
    table = np.zeros(256, dtype=bool)
    table[list(chars)] = True
    return table


#: ``[^\x20\x09-\x0D]``: the bytes of a word.
NOT_SPACE = ~lut(b" \t\n\x0b\x0c\r")
#: Letters, digits and every byte of a non-ASCII code point.
ALNUM = lut(bytes(range(48, 58)) + bytes(range(65, 91)) + bytes(range(97, 123)) + bytes(range(128, 256)))


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary array; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset: column.offset + len(column) + 1]
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None else np.zeros(0, np.uint8)
    return data[offsets[0]: offsets[-1]], offsets - offsets[0]


def slices(batch: pa.RecordBatch, text_col: str, most: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Cut a batch into runs of rows of at most ``most`` text bytes (one row at
    least): (rows, bytes, offsets)."""
    data, offsets = flat(batch.column(text_col))
    row, rows = 0, batch.num_rows
    while row < rows:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + most, side="right")) - 1)
        yield batch.slice(row, end - row), data[offsets[row]: offsets[end]], offsets[row: end + 1] - offsets[row]
        row = end


def runs(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of bytes in ``table``, cut at document bounds: starts, ends,
    first run of each document (length docs + 1), and the byte mask."""
    mask = table[data]
    before = np.empty_like(mask)
    before[1:], before[:1] = mask[:-1], False
    heads = offsets[:-1][offsets[:-1] < len(data)]
    before[heads] = False
    starts = np.flatnonzero(mask & ~before)
    after = np.empty_like(mask)
    after[:-1], after[-1:] = mask[1:], False
    after[heads[heads > 0] - 1] = False
    ends = np.flatnonzero(mask & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets), mask


def encode(data: np.ndarray, mask: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """Dense ids of the masked runs (exact, by their bytes) and the distinct runs."""
    ends = np.zeros(len(lengths) + 1, dtype=np.int64)
    np.cumsum(lengths, out=ends[1:])
    body = np.ascontiguousarray(data[mask])
    column = pa.Array.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(ends), pa.py_buffer(body)])
    coded = column.dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary


def stable_hashes(values: pa.Array) -> np.ndarray:
    """64-bit hashes of distinct byte strings, the same in every task."""
    return np.fromiter((xxhash.xxh3_64_intdigest(v) for v in values.to_pylist()), dtype=np.uint64, count=len(values))


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of uint64 values (wrapping multiply and shift rounds)."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n consecutive words from each word on (empty if too few)."""
    count = len(hashes) - n + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(count, np.uint64)
    for k in range(n):
        out = (out ^ hashes[k: k + count]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return mix(out)


def per_doc(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum of ``values`` between consecutive bounds."""
    total = np.zeros(len(values) + 1, dtype=np.int64)
    np.cumsum(values, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]
