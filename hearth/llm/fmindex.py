"""Substring dedup by matching statistics over one compressed FM-index per shard.

A word goes if a window of 50 words that covers it also starts in a document
with a smaller id.

1. Sampling.  Every window has a least hash among its 12-word grams; equal
   windows have the same one.  Hashes held by one document only are done:
   their windows stand nowhere else.
2. Shards.  Neighbouring windows with the same (shared) least hash form a
   segment, at most 64 windows long, and all segments of a hash go to one
   shard, so equal windows always meet.  Equal segments are merged before the
   shuffle, keeping the smallest id.  A hash that many documents hold is dealt
   out further by the hash of the whole window.
3. Index.  A shard sorts the suffixes of its segments, takes their
   Burrows-Wheeler transform and keeps it in a wavelet matrix of packed bits
   over the shard's words.  Segments are then streamed through it from their
   last word to the first, all in step: backward search puts a word before the
   match, a match of 50 words is cut back to 49 before that, and one that can't
   be extended gives up words at its end.  These matching statistics tell each
   window's interval of suffixes; the interval's smallest id is the answer.
4. Runs of equal answers return to the chunks of texts, which cut the covered
   words.

The index compares words, not hashes.  A task holds one chunk of texts or one
shard.

Defined results: null and empty texts have no words; repeated rows have equal
ids, so neither loses to the other; ids are integers, and a document without
one neither loses words nor costs others theirs; texts under 50 words lose
nothing; an empty table gives an empty result; other columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hearth.llm import _arrow as A
from hearth.llm._store import SMALL_GROUPS, materialise

WINDOW = 50
GRAM = 12
#: Windows of a segment.
STRETCH = 64
_BASE = 0x9E3779B97F4A7C15  # odd multiplier of the rolling hash
_NONE = np.iinfo(np.int64).max


@dataclass(frozen=True)
class FmRules:
    #: Text bytes of a chunk (one longer document is a chunk by itself).
    chunk_bytes: int = 2 << 20
    #: Words that a shard should hold; more words make more shards.
    shard_words: int = 1 << 19
    #: Documents with the same least hash from which on it is dealt out further.
    hot_docs: int = 1 << 11


# ---- chunks --------------------------------------------------------------

def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    size, step = 1, np.uint64(base)
    while size < n:  # doubling: out[size + k] = out[k] * base ** size
        more = min(size, n - size)
        out[size: size + more] = out[:more] * step
        step, size = step * step, size * 2
    return out


class Rolling:
    """Hashes of all runs of n words, from prefix sums modulo 2**64."""

    power = inverse = np.zeros(0, np.uint64)

    def __init__(self, hashes: np.ndarray) -> None:
        np.seterr(over="ignore")
        n = len(hashes) + 1
        if len(Rolling.power) < n:
            Rolling.power, Rolling.inverse = _powers(_BASE, n), _powers(pow(_BASE, -1, 1 << 64), n)
        self.sums = np.zeros(n, np.uint64)
        np.cumsum(hashes * Rolling.power[: n - 1], out=self.sums[1:])

    def at(self, where: np.ndarray | slice, n: int) -> np.ndarray:
        s = self.sums[:-n] if isinstance(where, slice) else self.sums[where]
        e = self.sums[n:] if isinstance(where, slice) else self.sums[where + n]
        inv = Rolling.inverse[: len(s)] if isinstance(where, slice) else Rolling.inverse[where]
        return A.mix((e - s) * inv)


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """Least of each run of ``width`` values."""
    out, size = values, 1
    while size < width:
        step = min(size, width - size)
        out = np.minimum(out[: len(out) - step], out[step:])
        size += step
    return out


class Texts:
    """The words of a chunk's documents."""

    def __init__(self, row: dict) -> None:
        self.ids = np.array([_NONE if i is None else i for i in row["ids"]], np.int64)
        self.has_id = np.array([i is not None for i in row["ids"]], dtype=bool)
        data = np.frombuffer(zstandard.ZstdDecompressor().decompress(row["blob"]), np.uint8)
        offsets = np.concatenate([[0], np.cumsum(row["sizes"])]).astype(np.int64)
        starts, ends, self.first, mask = A.runs(data, offsets, A.NOT_SPACE)
        sizes = ends - starts
        ids, distinct = A.encode(data, mask, sizes)
        self.hashes = A.stable_hashes(distinct)[ids] if len(ids) else np.zeros(0, np.uint64)
        # every word followed by one space
        self.at = np.concatenate([[0], np.cumsum(sizes + 1)])
        self.plain = np.full(int(self.at[-1]), 32, np.uint8)
        inside = np.ones(len(self.plain), dtype=bool)
        inside[self.at[1:] - 1] = False
        self.plain[inside] = data[mask]
        self.n_words = np.diff(self.first)

    def windows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First word, document and least gram hash of every window."""
        count = np.maximum(self.n_words - WINDOW + 1, 0)
        doc = np.repeat(np.arange(len(count)), count)
        start = np.repeat(self.first[:-1] - np.cumsum(count) + count, count) + np.arange(int(count.sum()))
        if not len(start):
            return start, doc, np.zeros(0, np.uint64)
        self.rolling = Rolling(self.hashes)
        grams = self.rolling.at(slice(None), GRAM)
        return start, doc, _least(grams, WINDOW - GRAM + 1)[start]

    def samples(self) -> tuple[np.ndarray, np.ndarray]:
        """The least hashes, and how many documents of the chunk hold each."""
        _, doc, least = self.windows()
        new = np.ones(len(least), dtype=bool)
        new[1:] = (least[1:] != least[:-1]) | (doc[1:] != doc[:-1])
        pairs = np.unique(np.stack([least[new], doc[new].astype(np.uint64)], axis=1), axis=0) if new.any() else np.zeros((0, 2), np.uint64)
        return np.unique(pairs[:, 0], return_counts=True)

    def segments(self, shared: np.ndarray, levels: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
        """First word, windows, document, route and number of each segment, and
        the keys of the numbers (equal segments of a chunk have the same).

        ``shared`` are the hashes that several documents hold, sorted; 2 **
        level ways lead from one of them."""
        start, doc, least = self.windows()
        at = np.minimum(np.searchsorted(shared, least), max(len(shared) - 1, 0))
        keep = shared[at] == least if len(shared) else np.zeros(len(least), dtype=bool)
        start, doc, least, level = start[keep], doc[keep], least[keep], levels[at[keep]] if len(shared) else levels[:0]
        route = A.mix(least)  # least hashes are small numbers, their mix is spread evenly
        hot = np.flatnonzero(level > 0)
        if len(hot):
            way = self.rolling.at(start[hot], WINDOW) >> (np.uint64(64) - level[hot].astype(np.uint64))
            route[hot] = A.mix(least[hot] + (way + np.uint64(1)) * np.uint64(_BASE))
        new = np.ones(len(start), dtype=bool)
        new[1:] = (start[1:] != start[:-1] + 1) | (doc[1:] != doc[:-1]) | (route[1:] != route[:-1])
        run = np.flatnonzero(new)
        inside = np.arange(len(start)) - np.repeat(run, np.diff(np.append(run, len(start))))
        new |= inside % STRETCH == 0
        run = np.flatnonzero(new)
        n = np.diff(np.append(run, len(start)))
        s = start[run]
        body, a, e = self.plain.tobytes(), self.at[s], self.at[s + n + WINDOW - 1] - 1
        keys: dict[bytes, int] = {}
        number = np.fromiter((keys.setdefault(xxhash.xxh3_128_digest(body[i:j]), len(keys)) for i, j in zip(a.tolist(), e.tolist(), strict=True)), np.int64, len(a))
        return s, n, doc[run], route[run], number, list(keys)


def _chunks(docs: DataFrame, id_col: str, text_col: str, rules: FmRules) -> DataFrame:
    """chunk, ids, sizes, blob (the texts as one zstd frame, as the joins may move it)."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8").alias("b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        held: list[tuple[pa.Array, np.ndarray, np.ndarray]] = []
        size = 0

        def out() -> pa.RecordBatch:
            sizes = np.concatenate([np.diff(h[2]) for h in held])
            one = pa.array([0, len(sizes)], pa.int32())
            return pa.RecordBatch.from_arrays(
                [pa.array([(part << 32) + number], pa.int64()), pa.ListArray.from_arrays(one, pa.concat_arrays([h[0] for h in held])),
                 pa.ListArray.from_arrays(one, pa.array(sizes)), pa.array([zstandard.ZstdCompressor(level=3).compress(b"".join(h[1].tobytes() for h in held))], pa.binary())],
                names=["chunk", "ids", "sizes", "blob"])

        for batch in batches:
            for piece, data, offsets in A.slices(batch, "b", rules.chunk_bytes):
                if held and size + len(data) > rules.chunk_bytes:
                    yield out()
                    number, held, size = number + 1, [], 0
                held.append((piece.column("id"), data, offsets))
                size += len(data)
        if held:
            yield out()

    return materialise(rows.mapInArrow(run, "chunk bigint, ids array<bigint>, sizes array<bigint>, blob binary"), "texts", SMALL_GROUPS)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for k in range(batch.num_rows):
            yield batch.slice(k, 1).to_pylist()[0]


def _shared(row: dict) -> tuple[np.ndarray, np.ndarray]:
    hashes = np.sort(np.array(row["shared"] or [], np.int64).view(np.uint64))
    levels = np.zeros(len(hashes), np.int64)
    for f in row["hot"] or []:
        levels[np.searchsorted(hashes, np.int64(f["sample"]).view(np.uint64))] = f["level"]
    return hashes, levels


# ---- the index of a shard ------------------------------------------------

class Wavelet:
    """Wavelet matrix: one row of packed bits per binary digit of the symbols,
    highest first; each row sends zeros before ones to the next."""

    def __init__(self, symbols: np.ndarray, top: int) -> None:
        self.digits = max(1, int(top).bit_length())
        self.rows: list[tuple[np.ndarray, np.ndarray, int]] = []
        now = symbols
        for digit in reversed(range(self.digits)):
            bit = (now >> digit & 1).astype(np.uint8)
            padded = np.zeros((len(bit) // 64 + 1) * 64, np.uint8)
            padded[: len(bit)] = bit
            words = np.packbits(padded, bitorder="little").view(np.uint64)
            ones = np.zeros(len(words) + 1, np.int32)
            np.cumsum(np.bitwise_count(words), out=ones[1:])
            ones_first = len(bit) - int(ones[-1])
            self.rows.append((words, ones, ones_first))
            one = bit.astype(bool)
            now = np.concatenate([now[~one], now[one]])
        # where each symbol's occurrences begin in the last row (any place for one without)
        self.begin = np.zeros(top + 2, np.int64)
        values, first = np.unique(now, return_index=True)
        self.begin[values] = first

    def before(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol (one that occurs) stands before each place."""
        place = at
        for digit, (words, ones, zeros) in zip(reversed(range(self.digits)), self.rows, strict=True):
            block = place >> 6
            low = (np.uint64(1) << (place & 63).astype(np.uint64)) - np.uint64(1)
            rank = ones[block] + np.bitwise_count(words[block] & low)
            place = np.where(symbols >> digit & 1, zeros + rank, place - rank)
        return place - self.begin[symbols]


def _ranks(pairs: np.ndarray) -> np.ndarray:
    _, out = np.unique(pairs, return_inverse=True)
    return out.astype(np.int64)


class FmIndex:
    """Suffixes of ``text`` (words from 1 on, 0 between segments) to the depth of a window."""

    def __init__(self, text: np.ndarray, owner: np.ndarray) -> None:
        n = len(text)

        def after(r: np.ndarray, k: int) -> np.ndarray:
            out = np.zeros(n, np.int64)
            out[: max(n - k, 0)] = r[k:]
            return out

        rank, depth = text.astype(np.int64), 1
        self.ranks = [rank.astype(np.int32)]
        while depth * 2 <= WINDOW - 1:  # ranks of twice as many words from two ranks
            rank, depth = _ranks(rank * (int(rank.max(initial=0)) + 1) + after(rank, depth)), depth * 2
            self.ranks.append(rank.astype(np.int32))
        top = int(rank.max(initial=0)) + 1
        whole, less = after(rank, WINDOW - depth), after(rank, WINDOW - 1 - depth)
        order = np.argsort(rank * top + whole, kind="stable")
        new = np.ones(n, dtype=bool)
        new[1:] = rank[order][1:] != rank[order][:-1]
        short = new.copy()
        short[1:] |= less[order][1:] != less[order][:-1]
        new[1:] |= whole[order][1:] != whole[order][:-1]
        #: Classes of suffixes that agree in a window, and in a window without its last word.
        self.class_of = np.cumsum(new) - 1
        self.least = np.minimum.reduceat(owner[order], np.flatnonzero(new)) if n else owner
        self.short_of = np.cumsum(short) - 1
        self.short = np.append(np.flatnonzero(short), n)
        self.order, self.heads = order, {}
        words = int(text.max(initial=0))
        self.wavelet = Wavelet(text[order - 1] if n else text, words)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=words + 1))])
        self.size = n

    def _common(self) -> np.ndarray:
        """How many words (up to a window) each suffix has in common with the one before it, in sorted order."""
        n = self.size
        out = np.zeros(n + 1, np.int64)
        for k in reversed(range(len(self.ranks))):
            r = np.append(self.ranks[k], np.full(WINDOW, -1, np.int32))
            same = r[self.order[1:] + out[1:n]] == r[self.order[:-1] + out[1:n]]
            out[1:n] += same << k
        return out

    def _shorter(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The next wider intervals, of the longest beginning of each match that
        more suffixes share, and its length."""
        if not self.heads:
            self.common = self._common()
        depth = np.maximum(self.common[low], self.common[high])
        low, high = low.copy(), high.copy()
        for d in np.unique(depth):
            if d not in self.heads:  # few lengths; only for texts that the index doesn't hold
                self.heads[d] = np.append(np.flatnonzero(self.common[: self.size] < d) if d else np.zeros(1, np.int64), self.size)
            k = np.flatnonzero(depth == d)
            c = np.searchsorted(self.heads[d], low[k], "right") - 1
            low[k], high[k] = self.heads[d][c], self.heads[d][c + 1]
        return low, high, depth

    def _extended(self, word: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        both = self.wavelet.before(np.concatenate([word, word]), np.concatenate([low, high]))
        return self.first[word] + both[: len(word)], self.first[word] + both[len(word):]

    def stream(self, text: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """For each place where a window of a segment starts, the smallest id of
        the documents that hold it; the largest number elsewhere.

        The match that starts at a word is the longest that the index holds, up
        to a window: a word is put before it, and where that fails the match
        gives up words at its end."""
        out = np.full(len(text), _NONE)
        if not self.size:
            return out
        order = np.argsort(starts - ends, kind="stable")  # longest first: those still running are a prefix
        at, start = ends[order].copy(), starts[order]
        length = ends[order] - start
        low, high, size = np.zeros(len(at), np.int64), np.full(len(at), self.size), np.zeros(len(at), np.int64)
        known = np.append(np.diff(self.first) > 0, False)
        for step in range(int(length.max(initial=0))):
            n = int(np.searchsorted(-length, -step, "left"))
            at, low, high, size = at[:n] - 1, low[:n], high[:n], size[:n]
            full = np.flatnonzero(size == WINDOW)  # keep all but the last word of the match
            c = self.short_of[low[full]]
            low[full], high[full], size[full] = self.short[c], self.short[c + 1], WINDOW - 1
            word = np.minimum(text[at], len(known) - 1)
            todo = np.flatnonzero(known[word])
            none = np.flatnonzero(~known[word])
            low[none], high[none], size[none] = 0, self.size, 0
            while len(todo):
                a, e = self._extended(word[todo], low[todo], high[todo])
                found = a < e
                hit = todo[found]
                low[hit], high[hit], size[hit] = a[found], e[found], size[hit] + 1
                todo = todo[~found]
                if len(todo):
                    low[todo], high[todo], size[todo] = self._shorter(low[todo], high[todo])
            full = np.flatnonzero(size == WINDOW)
            out[at[full]] = self.least[self.class_of[low[full]]]
        return out


def _shard(table: pa.Table) -> pa.Table:
    """Index of a shard's segments, and what it says of each: key, n, docs (runs of
    equal answers)."""
    data, offsets = A.flat(table["text"])
    starts, ends, first, mask = A.runs(data, offsets, A.NOT_SPACE)
    ids, _ = A.encode(data, mask, ends - starts)
    n = len(first) - 1
    place = np.arange(len(ids)) + np.repeat(np.arange(n), np.diff(first))
    text = np.zeros(len(ids) + n, np.int64)
    text[place] = ids + 1
    doc = table["doc"].to_numpy()
    owner = np.repeat(doc, np.diff(first) + 1)
    index = FmIndex(text, owner)
    begin = first[:-1] + np.arange(n)
    answer = index.stream(text, begin, begin + np.diff(first))
    windows = np.diff(first) - WINDOW + 1
    spread = np.repeat(begin - np.cumsum(windows) + windows, windows) + np.arange(int(windows.sum()))
    answer = answer[spread]
    head = np.cumsum(windows) - windows
    new = np.ones(len(answer), dtype=bool)
    new[1:] = answer[1:] != answer[:-1]
    new[head] = True
    at = np.flatnonzero(new)
    # a segment that one document alone holds, all of it for the first time, needs no answer
    tells = (A.per_doc(answer != np.repeat(doc, windows), np.append(head, len(answer))) > 0) | (table["holders"].to_numpy() > 1)
    lists = pa.array(np.append(np.searchsorted(at, head), len(at)).astype(np.int32))
    return pa.table([table["key"], pa.ListArray.from_arrays(lists, pa.array(np.diff(np.append(at, len(answer))).astype(np.int32))),
                     pa.ListArray.from_arrays(lists, pa.array(answer[at]))], names=["key", "n", "docs"]).filter(pa.array(tells))


# ---- the operator --------------------------------------------------------

_SEGMENT = "chunk bigint, number bigint, key binary, route bigint, doc bigint, holders bigint, words bigint, text binary"


def dedup(docs: DataFrame, rules: FmRules = FmRules(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, n_spans, and the kept
    words joined by one space."""
    chunks = _chunks(docs, id_col, text_col, rules)

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            hashes, held = Texts(row).samples()
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(hashes), row["chunk"])), pa.array(hashes.view(np.int64)), pa.array(held.astype(np.int64))],
                                             names=["chunk", "sample", "docs"])

    samples = materialise(chunks.mapInArrow(sample, "chunk bigint, sample bigint, docs bigint"), "samples")
    counted = samples.groupBy(F.col("sample").alias("s")).agg(F.sum("docs").alias("n")).filter("n > 1")
    level = F.ceil(F.log2(F.greatest(F.col("n") / rules.hot_docs, F.lit(1.0)))).cast("long")
    replies = samples.join(counted.select("s", level.alias("level")), F.col("sample") == F.col("s"))
    hot = F.collect_list(F.when(F.col("level") > 0, F.struct("sample", "level")))
    replies = materialise(replies.groupBy(F.col("chunk").alias("c")).agg(F.collect_list("sample").alias("shared"), hot.alias("hot")), "shared")
    work = _beside(chunks, replies)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            texts = Texts(row)
            start, n, doc, route, number, keys = texts.segments(*_shared(row))
            least, first, holders = np.full(len(keys), _NONE), np.zeros(len(keys), np.int64), np.bincount(number, minlength=len(keys))
            np.minimum.at(least, number, texts.ids[doc])
            first[number[::-1]] = np.arange(len(number))[::-1]
            body, a, e = texts.plain.tobytes(), texts.at[start[first]], texts.at[start[first] + n[first] + WINDOW - 1] - 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(keys), row["chunk"]), pa.int64()), pa.array(np.arange(len(keys))), pa.array(keys, pa.binary()),
                 pa.array(route[first].view(np.int64)), pa.array(least), pa.array(holders), pa.array(n[first] + WINDOW - 1),
                 pa.array([body[i:j] for i, j in zip(a.tolist(), e.tolist(), strict=True)], pa.binary())],
                names=["chunk", "number", "key", "route", "doc", "holders", "words", "text"])

    segments = materialise(work.filter("shared IS NOT NULL").mapInArrow(send, _SEGMENT), "segments", {**SMALL_GROUPS, "compression": "zstd"})
    total = segments.agg(F.sum("words")).first()[0] or 0
    bits = max(0, int(total // rules.shard_words).bit_length())
    shard = F.shiftrightunsigned("route", 64 - bits) if bits else F.lit(0).cast("long")
    once = segments.groupBy("key").agg(F.min("doc").alias("doc"), F.sum("holders").alias("holders"), F.first("route").alias("route"), F.first("text").alias("text"))
    answers = once.select(shard.alias("shard"), "key", "doc", "holders", "text").groupBy("shard").applyInArrow(_shard, "key binary, n array<int>, docs array<bigint>")
    answers = materialise(answers, "answers")
    back = segments.select("chunk", "number", F.col("key").alias("k")).join(answers, F.col("k") == F.col("key"))
    back = back.select(F.col("chunk").alias("c"), F.struct("number", "n", "docs").alias("a")).groupBy("c").agg(F.collect_list("a").alias("answers"))
    back = materialise(back, "back")
    work = _beside(work, back)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            yield _kept(Texts(row), row)

    schema = T.StructType([*(T.StructField(n, T.LongType()) for n in ("doc_id", "n_words", "n_removed", "n_spans")), T.StructField("kept", T.StringType())])
    return work.mapInArrow(cut, schema)


def _beside(rows: DataFrame, side: DataFrame) -> DataFrame:
    """The side grows with the texts: the join is left to the optimizer, which moves the compressed chunks."""
    return rows.join(side, F.col("chunk") == F.col("c"), "left").drop("c")


def _kept(texts: Texts, row: dict) -> pa.RecordBatch:
    words = len(texts.hashes)
    cover = np.zeros(words + 1, np.int64)
    if row["answers"]:
        start, _, doc, _, number, _ = texts.segments(*_shared(row))
        known = {a["number"]: (a["n"], a["docs"]) for a in row["answers"]}
        for s, d, k in zip(start.tolist(), doc.tolist(), number.tolist(), strict=True):
            if k in known and texts.has_id[d]:
                at = s
                for m, least in zip(*known[k], strict=True):
                    if least < texts.ids[d]:
                        cover[at] += 1
                        cover[at + m + WINDOW - 1] -= 1
                    at += m
    gone = np.cumsum(cover[:-1]) > 0
    before = np.zeros(words, dtype=bool)
    before[1:] = gone[:-1]
    before[texts.first[:-1][texts.n_words > 0]] = False
    removed = A.per_doc(gone, texts.first)
    spans = A.per_doc(gone & ~before, texts.first)
    sizes = np.diff(texts.at)
    keep = np.repeat(~gone, sizes)
    left = np.flatnonzero(~gone)
    doc_of = np.searchsorted(texts.first, left, "right") - 1
    last = np.flatnonzero(np.diff(doc_of, append=-1)) if len(left) else left
    keep[texts.at[left[last] + 1] - 1] = False  # no space behind a document's last word
    ends = np.concatenate([[0], np.cumsum(keep)])[texts.at[texts.first]]
    kept = pa.Array.from_buffers(pa.large_binary(), len(texts.ids), [None, pa.py_buffer(np.ascontiguousarray(ends)), pa.py_buffer(np.ascontiguousarray(texts.plain[keep]))])
    ids = pa.array(texts.ids, mask=~texts.has_id)
    return pa.RecordBatch.from_arrays([ids, pa.array(texts.n_words), pa.array(removed), pa.array(spans), kept.cast(pa.large_string()).cast(pa.string())],
                                      names=["doc_id", "n_words", "n_removed", "n_spans", "kept"])
