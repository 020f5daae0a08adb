"""Benchmark decontamination by SimHash windows and multi-index Hamming blocks.

For every benchmark item, every item-sized window of a text that shares a
shingle with an item of that size gets a 128-bit SimHash of its weighted
shingles (a window that shares none has similarity 0).  Each occurrence of a
repeated shingle counts as a feature of its own, so that the fingerprints of
two windows of similarity 0.8 are near whatever their counts.  They are cut into 16 blocks of 8 bits: two fingerprints within 47 bits agree within 2
bits in one block at least, so looking up each block's neighbours finds all
items within the radius.  Candidates are settled by their exact weighted
Jaccard similarity over shingle counts.

The similarity 0.8 means about 19 of 128 bits on average; the radius lies more
than six standard deviations above.  The benchmark is a stated query set: it
goes to the tasks in blocks of at most ``block_bytes`` of text, one pass over
the documents per block, so what is broadcast has a fixed bound.

Defined results: null and empty texts and items match nothing; an item of one
to four words is one shingle of its own length and is found wherever a text
has these words in a row (raise ``least_words`` where a benchmark has answers
that any text may hold); a text shorter than an item is one window; of equally
similar windows the first is reported; repeated rows and items each get their
rows; empty tables give an empty result; other columns pass through untouched.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from hearth.llm import _arrow as A
from hearth.llm._shingles import SHINGLE, Words, words

BITS, BLOCKS, NEAR = 128, 16, 2
RADIUS = BLOCKS * (NEAR + 1) - 1
#: Windows of one document whose bit sums are held at once.
RUN = 1 << 15


@dataclass(frozen=True)
class LeakRules:
    similarity: float = 0.8
    block_bytes: int = 8 << 20
    #: Items with fewer words are left out.
    least_words: int = 1


def _bits(shingles: np.ndarray) -> np.ndarray:
    """+1 or -1 for each of the 128 bits of a shingle."""
    pair = np.column_stack([A.mix(shingles ^ np.uint64(0xA5A5A5A5)), A.mix(shingles + np.uint64(0x5BD1E995))])
    raw = np.unpackbits(pair.astype("<u8").view(np.uint8).reshape(len(shingles), 16), axis=1)
    return raw.astype(np.float64) * 2 - 1


def _features(h: np.ndarray, occurrence: np.ndarray) -> np.ndarray:
    """A shingle's n-th occurrence (from 0) as a shingle of its own; the first is the shingle itself."""
    return np.where(occurrence > 0, A.mix(h + occurrence.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), h)


def _occurrences(h: np.ndarray) -> np.ndarray:
    """How many equal values stand before each."""
    order = np.argsort(h, kind="stable")
    first = np.flatnonzero(np.diff(h[order], prepend=~h[order[:1]]))
    out = np.empty(len(h), np.int64)
    out[order] = np.arange(len(h)) - np.repeat(first, np.diff(np.append(first, len(h))))
    return out


def window_sums(h: np.ndarray, w: np.ndarray, size: int) -> np.ndarray:
    """Weighted bit sums of every window of ``size`` shingles."""
    if len(np.unique(h)) == len(h):
        sums = np.zeros((len(h) + 1, BITS))
        np.cumsum(_bits(h) * w[:, None], axis=0, out=sums[1:])
        return sums[size:] - sums[:-size]
    # a shingle that comes in is its window's next occurrence, one that goes was the last
    held: dict[int, int] = {}
    at, number, sign, window = [], [], [], []
    for k, x in enumerate(h.tolist()):
        if k >= size:
            old = int(h[k - size])
            held[old] -= 1
            at.append(k - size)
            number.append(held[old])
            sign.append(-1.0)
            window.append(k - size + 1)
        at.append(k)
        number.append(held.get(x, 0))
        sign.append(1.0)
        window.append(max(0, k - size + 1))
        held[x] = held.get(x, 0) + 1
    at = np.array(at)
    step = _bits(_features(h[at], np.array(number))) * (w[at] * np.array(sign))[:, None]
    total = np.cumsum(step, axis=0)
    return total[np.searchsorted(window, np.arange(len(h) - size + 1), "right") - 1]


def weight(sizes: np.ndarray) -> np.ndarray:
    """Weight of a shingle by the bytes of its words."""
    return 1 + np.log(np.maximum(sizes, 1))


def short_shingles(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words from each word on, for n below a shingle's length."""
    return A.mix(A.grams(hashes, n) + np.uint64(n))


@dataclass
class Item:
    item_id: int | None
    n_words: int
    shingles: np.ndarray  # distinct, sorted
    counts: np.ndarray
    weights: np.ndarray
    total: float
    print_: np.ndarray  # 16 bytes


class ItemIndex:
    """Items of one block, by their length in words."""

    def __init__(self, ids: list, texts: list, least_words: int = 1) -> None:
        self.items: list[Item] = []
        batch = pa.RecordBatch.from_arrays([pa.array(range(len(ids)), pa.int64()), pa.array(texts, pa.string())], names=["k", "t"])
        for w in words(iter([batch]), "t"):
            for d, k in enumerate(w.rows.column("k").to_pylist()):
                span = slice(w.first[d], w.first[d + 1])
                n = w.first[d + 1] - w.first[d]
                if n < least_words:
                    continue
                if 0 < n < SHINGLE:
                    self.items.append(Item(ids[k], int(n), short_shingles(w.hashes[span], int(n)), np.ones(1, np.int64), np.ones(1), 1.0, np.zeros(16, np.uint8)))
                elif n >= SHINGLE:
                    h = A.grams(w.hashes[span], SHINGLE)
                    size = np.convolve(w.sizes[span], np.ones(SHINGLE, np.int64), "valid")
                    uniq, at, counts = np.unique(h, return_index=True, return_counts=True)
                    own = weight(size)
                    mark = np.packbits((_bits(_features(h, _occurrences(h))) * own[:, None]).sum(axis=0) > 1e-9)
                    self.items.append(Item(ids[k], int(n), uniq, counts, own[at], float((own[at] * counts).sum()), mark))
        self.short: dict[int, dict[int, list[int]]] = {}  # words -> shingle -> items
        for k, item in enumerate(self.items):
            if item.n_words < SHINGLE:
                self.short.setdefault(item.n_words, {}).setdefault(int(item.shingles[0]), []).append(k)
        pairs = sorted((int(h), k) for k, item in enumerate(self.items) if item.n_words >= SHINGLE for h in item.shingles)
        self.shingles = np.array([h for h, _ in pairs], np.uint64)
        self.owners = np.array([k for _, k in pairs], np.int64)
        self.lengths = np.array([item.n_words for item in self.items], np.int64)
        self.by_length = {int(n): np.flatnonzero(self.lengths == n) for n in np.unique(self.lengths) if n >= SHINGLE}
        marks = np.array([item.print_ for item in self.items], np.uint8).reshape(len(self.items), BLOCKS)
        self.marks = marks
        near = np.unpackbits((np.arange(256)[:, None] ^ np.arange(256)[None, :]).astype(np.uint8)[..., None], axis=2).sum(axis=2) <= NEAR
        #: [length][block]: for each byte value, one bit per item of that length whose block is near it
        self.tables = {n: [np.packbits(near[:, marks[own, b]], axis=1) for b in range(BLOCKS)] for n, own in self.by_length.items()}

    def within(self, prints: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(window, item) of all fingerprints within the radius, items of length n."""
        found = np.zeros((len(prints), self.tables[n][0].shape[1]), np.uint8)
        for b, table in enumerate(self.tables[n]):
            found |= table[prints[:, b]]
        some = np.flatnonzero(found.any(axis=1))
        window, item = np.nonzero(np.unpackbits(found[some], axis=1, count=len(self.by_length[n])))
        window, item = some[window], self.by_length[n][item]
        far = np.unpackbits(prints[window] ^ self.marks[item], axis=1).sum(axis=1)
        near = far <= RADIUS
        return window[near], item[near]


def _leaks_of(h: np.ndarray, w: np.ndarray, index: ItemIndex, least: float) -> list[tuple[int, float, int, int]]:
    """(item, similarity, first word, words) of one document; ``h``, ``w``: all its shingles."""
    lo, hi = np.searchsorted(index.shingles, h, "left"), np.searchsorted(index.shingles, h, "right")
    hit = np.flatnonzero(hi > lo)
    owners = np.concatenate([index.owners[lo[p]: hi[p]] for p in hit])
    at = np.repeat(hit, (hi - lo)[hit])
    lengths = index.lengths[owners]
    best: dict[int, tuple[float, int, int]] = {}
    for n in np.unique(lengths):
        size = min(int(n) - SHINGLE + 1, len(h))  # shingles of a window
        last = len(h) - size
        mark = np.zeros(last + 2, np.int64)
        own = at[lengths == n]
        np.add.at(mark, np.clip(own - size + 1, 0, last), 1)
        np.add.at(mark, np.minimum(own, last) + 1, -1)
        starts = np.flatnonzero(np.cumsum(mark[:-1]) > 0)
        for part in np.split(starts, np.flatnonzero((np.diff(starts) > 1)) + 1):
            for k in range(0, len(part), RUN):
                run = part[k: k + RUN]
                a, b = run[0], run[-1] + size
                prints = np.packbits(window_sums(h[a:b], w[a:b], size) > 1e-9, axis=1)
                for window, k2 in zip(*index.within(prints, int(n)), strict=True):
                    s, item = int(a + window), index.items[k2]
                    sim = similarity(h[s: s + size], w[s: s + size], item)
                    if sim >= least and sim > best.get(int(k2), (0.0,))[0] + 1e-12:
                        best[int(k2)] = (sim, s, size + SHINGLE - 1)
    return [(k, *v) for k, v in sorted(best.items())]


def similarity(h: np.ndarray, w: np.ndarray, item: Item) -> float:
    """Exact weighted Jaccard over shingle counts."""
    uniq, at, counts = np.unique(h, return_index=True, return_counts=True)
    where = np.searchsorted(item.shingles, uniq)
    where[where == len(item.shingles)] = 0
    same = item.shingles[where] == uniq
    shared = float((item.weights[where[same]] * np.minimum(counts[same], item.counts[where[same]])).sum())
    return shared / (float((w[at] * counts).sum()) + item.total - shared)


def leaks_in(batch: Words, index: ItemIndex, least: float) -> dict[int, list[tuple[int, float, int, int]]]:
    """Leaks of each document of the batch that has any."""
    out: dict[int, list[tuple[int, float, int, int]]] = {}
    if len(index.shingles) and len(batch.hashes) >= SHINGLE:
        h = A.grams(batch.hashes, SHINGLE)
        at = np.minimum(np.searchsorted(index.shingles, h), len(index.shingles) - 1)
        hits = np.flatnonzero(index.shingles[at] == h)
        docs = np.searchsorted(batch.first, hits, "right") - 1
        docs = np.unique(docs[hits + SHINGLE <= batch.first[docs + 1]])
        for d in docs:
            a, b = batch.first[d], batch.first[d + 1]
            size = np.convolve(batch.sizes[a:b], np.ones(SHINGLE, np.int64), "valid")
            if found := _leaks_of(h[a: b - SHINGLE + 1], weight(size), index, least):
                out[int(d)] = found
    for n, items in index.short.items():
        h = short_shingles(batch.hashes, n)
        hits = np.flatnonzero(np.isin(h, np.array(list(items), np.uint64)))
        docs = np.searchsorted(batch.first, hits, "right") - 1
        inside = hits + n <= batch.first[docs + 1]
        seen: set[tuple[int, int]] = set()
        for p, d in zip(hits[inside].tolist(), docs[inside].tolist(), strict=True):
            for k in items[int(h[p])]:
                if (d, k) not in seen:
                    seen.add((d, k))
                    out.setdefault(d, []).append((k, 1.0, p - int(batch.first[d]), n))
    return out


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, rules: LeakRules) -> Iterator[tuple[list, list]]:
    """The benchmark in blocks of bounded size."""
    items = benchmark.select(F.col(item_col).alias("i"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    size = items.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    blocks = size // rules.block_bytes + 1
    for k in range(blocks):
        rows = items.filter(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == k).collect()
        yield [r["i"] for r in rows], [r["t"] for r in rows]


def _mapped(docs: DataFrame, text_col: str, block: tuple[list, list], schema: T.StructType,
            out: Callable[[Words, ItemIndex, dict], pa.RecordBatch], rules: LeakRules) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast(block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = ItemIndex(*sent.value, rules.least_words)
        for w in words(batches, text_col):
            yield out(w, index, leaks_in(w, index, rules.similarity))

    return docs.mapInArrow(run, schema)


def leaks(docs: DataFrame, benchmark: DataFrame, rules: LeakRules = LeakRules(), id_col: str = "doc_id",
          text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, similarity, first_word, n_words) of every leak: the best
    window of each document for each item."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("t"))
    schema = T.StructType([rows.schema["doc_id"], T.StructField("item_id", benchmark.schema[item_col].dataType),
                           *(T.StructField(n, k) for n, k in (("similarity", T.DoubleType()), ("first_word", T.LongType()), ("n_words", T.LongType())))])

    kind = to_arrow_type(schema["item_id"].dataType)

    def out(w: Words, index: ItemIndex, found: dict) -> pa.RecordBatch:
        flat = [(d, *x) for d, own in found.items() for x in own]
        ids = w.rows.column("doc_id")
        return pa.RecordBatch.from_arrays(
            [ids.take(pa.array([x[0] for x in flat], pa.int64())),
             pa.array([index.items[x[1]].item_id for x in flat], kind), pa.array([x[2] for x in flat], pa.float64()),
             pa.array([x[3] for x in flat], pa.int64()), pa.array([x[4] for x in flat], pa.int64())], names=schema.names)

    parts = [_mapped(rows, "t", b, schema, out, rules) for b in _blocks(benchmark, item_col, item_text_col, rules)]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


def drop_leaks(docs: DataFrame, benchmark: DataFrame, rules: LeakRules = LeakRules(), text_col: str = "text",
               item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The documents without a leak, with their columns as they were."""
    names = docs.columns
    rows = docs.select(*(F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(names)))

    def out(w: Words, index: ItemIndex, found: dict) -> pa.RecordBatch:
        clean = np.ones(w.rows.num_rows, dtype=bool)
        clean[list(found)] = False
        return w.rows.filter(pa.array(clean))

    for block in _blocks(benchmark, item_col, item_text_col, rules):
        rows = _mapped(rows, f"c{names.index(text_col)}", block, rows.schema, out, rules)
    return rows.select(*(F.col(f"c{k}").alias(n) for k, n in enumerate(names)))
