"""Exact substring dedup by blockwise suffix sorting over a difference cover.

A byte goes if some 200-byte string that covers it starts anywhere else.  Only
whether two suffixes agree in their first 200 bytes matters, so suffixes are
sorted to that depth:

1. Cover sample.  The offsets whose residue modulo 133 lies in a difference
   cover are sampled (9 % of all).  Any two offsets have a common shift below
   133 that takes both to sampled ones; so two equal 200-byte strings contain,
   at the same shift, equal 68-byte strings at sampled offsets.  The sample is
   ranked first: which of its 68-byte strings occur more than once.
2. Suffix buckets.  A suffix that meets no repeated sample string within its
   first 133 bytes ties with no other; these, nearly all, are done.  Ties inside
   a chunk are settled there.  Those that meet a string of another chunk go to
   buckets by their leading fingerprint bits, and each bucket is sorted by
   itself, the only thing a task holds; they are counted before the number of
   buckets is chosen.
3. Suffixes that tie to the depth of 200 bytes are repeated; the bytes that
   they cover are cut out.

Fingerprints (64 and 32 bits beside the bucket's) stand for letters in both
sorts: their order groups equal strings as the alphabet's does.  A task sends
each distinct value of its chunk of texts once, so a string that a third of
all documents share takes one entry per chunk.  Answers return as bitmaps in
the order of what was sent.  Of equal whole texts only one takes part.

Defined results: null and empty texts keep nothing to remove; texts shorter
than 200 bytes lose nothing; repeated rows are copies like others; an empty
table gives an empty result; other columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hearth.llm import _arrow as A
from hearth.llm._store import SMALL_GROUPS, materialise, small

DEPTH = 200
#: A perfect difference set modulo 133 (every residue is a difference of two).
CYCLE = 133
COVER = (1, 10, 11, 13, 27, 31, 68, 75, 83, 110, 115, 121)
SAMPLE = DEPTH - CYCLE + 1
#: Positions whose fingerprints are computed at once.
SPAN = 1 << 19
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)  # odd multipliers of the two fingerprints


@dataclass(frozen=True)
class SuffixRules:
    #: Text bytes of a chunk (one longer document is a chunk by itself).
    chunk_bytes: int = 384 << 10
    #: Entries that a bucket should hold; more entries make more buckets.
    bucket_entries: int = 1 << 20


def difference_cover_holds() -> bool:
    return {(a - b) % CYCLE for a in COVER for b in COVER} == set(range(CYCLE))


class Fingerprints:
    """Rolling fingerprints of fixed-length strings, by prefix sums modulo 2**64."""

    def __init__(self, base: int) -> None:
        n = SPAN + DEPTH + 1
        self.power = self._powers(base, n)
        self.inverse = self._powers(pow(base, -1, 1 << 64), n)

    @staticmethod
    def _powers(base: int, n: int) -> np.ndarray:
        out = np.ones(n, np.uint64)
        size, step = 1, np.uint64(base)
        while size < n:  # doubling: out[size + k] = out[k] * base ** size
            more = min(size, n - size)
            out[size: size + more] = out[:more] * step
            step, size = step * step, size * 2
        return out

    def at(self, data: np.ndarray, positions: np.ndarray, length: int) -> np.ndarray:
        """Fingerprints of ``data[p: p + length]``; positions ascend."""
        out = np.empty(len(positions), np.uint64)
        k = 0
        while k < len(positions):
            a = int(positions[k])
            e = int(np.searchsorted(positions, a + SPAN, "left"))
            here = positions[k:e] - a
            part = data[a: a + int(here[-1]) + length]
            sums = np.zeros(len(part) + 1, np.uint64)
            np.cumsum((part.astype(np.uint64) + np.uint64(1)) * self.power[: len(part)], out=sums[1:])
            out[k:e] = A.mix((sums[here + length] - sums[here]) * self.inverse[here])
            k = e
        return out


class Chunk:
    """The documents of one chunk row and their share of the work."""

    prints: tuple[Fingerprints, Fingerprints] | None = None

    def __init__(self, row: dict) -> None:
        if Chunk.prints is None:
            np.seterr(over="ignore")
            Chunk.prints = (Fingerprints(_BASES[0]), Fingerprints(_BASES[1]))
        self.data = np.frombuffer(row["blob"], np.uint8)
        self.sizes = np.array(row["sizes"], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)])
        copies = row["copies"] or []
        self.copied = np.zeros(len(self.sizes), dtype=bool)
        self.takes_part = self.sizes >= DEPTH
        for c in copies:
            self.copied[c["pos"]] = True
            if not c["first"]:
                self.takes_part[c["pos"]] = False

    def samples(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Sampled positions, their rank entry, the distinct entries (sorted), and which repeat here."""
        cover = np.array(COVER, np.int64)
        parts = []
        for d in np.flatnonzero(self.takes_part):
            p = (np.arange(self.sizes[d] // CYCLE + 1)[:, None] * CYCLE + cover).ravel()
            parts.append(self.starts[d] + p[p + SAMPLE <= self.sizes[d]])
        where = np.concatenate(parts) if parts else np.zeros(0, np.int64)
        value = Chunk.prints[0].at(self.data, where, SAMPLE)
        distinct, entry, counts = np.unique(value, return_inverse=True, return_counts=True)
        return where, entry.ravel(), distinct, counts > 1

    def near(self, hits: np.ndarray) -> np.ndarray:
        """Suffixes that meet a sampled position of ``hits`` within their first 133 bytes."""
        near = np.zeros(len(self.data) + 2, np.int32)
        doc = np.searchsorted(self.starts, hits, "right") - 1
        np.add.at(near, np.maximum(hits - (CYCLE - 1), self.starts[doc]), 1)
        np.add.at(near, hits + 1, -1)
        found = np.flatnonzero(np.cumsum(near[:-2]) > 0)
        doc = np.searchsorted(self.starts, found, "right") - 1
        return found[found + DEPTH <= self.starts[doc + 1]]

    def to_send(self, rows: list[dict] | None) -> int:
        """At most so many entries go to the buckets (copies in this chunk counted)."""
        where, entry, distinct, _ = self.samples()
        return len(self.near(where[_bits(rows, len(distinct))[entry]]))

    def suffixes(self, rows: list[dict] | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Suffixes that meet a repeated sample string: positions, entry of each,
        distinct entries (two fingerprints, sorted), which repeat here, and which
        may repeat in other chunks."""
        where, entry, distinct, here = self.samples()
        repeated = _bits(rows, len(distinct))
        away = self.near(where[repeated[entry]])
        found = self.near(where[(repeated | here)[entry]])
        a, b = (p.at(self.data, found, DEPTH) for p in Chunk.prints)
        b = (b >> np.uint64(32)).astype(np.uint32)
        order, same = sorted_ties(a, b)
        first = np.ones(len(found), dtype=bool)
        first[1:] = ~same
        entry = np.empty(len(found), np.int64)
        entry[order] = np.cumsum(first) - 1
        counts = np.bincount(entry, minlength=int(first.sum()))
        sent = np.zeros(len(counts), dtype=bool)
        sent[entry[np.searchsorted(found, away)]] = True  # ``away`` lies within ``found``
        return found, entry, a[order][first], b[order][first], counts > 1, sent


def sorted_ties(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by both fingerprints, and which sorted neighbours agree in both."""
    order = np.argsort(a, kind="stable")
    same = a[order][1:] == a[order][:-1]
    tie = same & (b[order][1:] == b[order][:-1])
    if (same & ~tie).any():  # one fingerprint alone does not tell them apart
        order = np.lexsort((b, a))
        tie = (a[order][1:] == a[order][:-1]) & (b[order][1:] == b[order][:-1])
    return order, tie


def _bits(rows: list[dict] | None, count: int) -> np.ndarray:
    """The answers of all buckets in the order of the entries that were sent."""
    if not rows:
        return np.zeros(count, dtype=bool)
    parts = [np.unpackbits(np.frombuffer(r["bits"], np.uint8), count=r["n"]) for r in sorted(rows, key=lambda r: r["bucket"])]
    return np.concatenate(parts).astype(bool)


def _chunks(docs: DataFrame, id_col: str, text_col: str, rules: SuffixRules) -> DataFrame:
    """chunk, ids, sizes, keys (md5 of each text), blob."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.unhex(F.md5(text)).alias("key"), F.encode(text, "UTF-8").alias("b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        held: list[tuple[pa.RecordBatch, np.ndarray, np.ndarray]] = []
        size = 0

        def out() -> pa.RecordBatch:
            table = pa.Table.from_batches([h[0] for h in held]).combine_chunks()
            sizes = np.concatenate([np.diff(h[2]) for h in held])
            one = pa.array([0, len(sizes)], pa.int32())
            return pa.RecordBatch.from_arrays(
                [pa.array([part * (1 << 32) + number], pa.int64()),
                 *(pa.ListArray.from_arrays(one, c) for c in (table["id"].combine_chunks(), pa.array(sizes), table["key"].combine_chunks())),
                 pa.array([b"".join(h[1].tobytes() for h in held)], pa.large_binary()).cast(pa.binary())],
                names=["chunk", "ids", "sizes", "keys", "blob"])

        for batch in batches:
            for piece in A.slices(batch, "b", rules.chunk_bytes):
                if held and size + len(piece[1]) > rules.chunk_bytes:
                    yield out()
                    number, held, size = number + 1, [], 0
                held.append(piece)
                size += len(piece[1])
        if held:
            yield out()

    kind = rows.schema["id"].dataType
    schema = T.StructType([T.StructField("chunk", T.LongType()), T.StructField("ids", T.ArrayType(kind)),
                           T.StructField("sizes", T.ArrayType(T.LongType())), T.StructField("keys", T.ArrayType(T.BinaryType())),
                           T.StructField("blob", T.BinaryType())])
    return materialise(rows.mapInArrow(run, schema), "chunks", SMALL_GROUPS)


def _copies(chunks: DataFrame) -> DataFrame:
    """chunk, copies: the documents that have equal ones, and whether they stand for them."""
    docs = chunks.select("chunk", F.posexplode("keys").alias("pos", "key"), "sizes")
    docs = docs.filter(F.element_at("sizes", F.col("pos") + 1) >= DEPTH).drop("sizes")
    groups = docs.groupBy(F.col("key").alias("k")).agg(F.min(F.struct("chunk", "pos")).alias("one"), F.count("*").alias("n")).filter("n > 1")
    rows = docs.join(groups, F.col("key") == F.col("k"))
    flag = F.struct("pos", (F.struct("chunk", "pos") == F.col("one")).alias("first"))
    return materialise(rows.groupBy(F.col("chunk").alias("c")).agg(F.collect_list(flag).alias("copies")), "copies")


def _buckets(entries: float, rules: SuffixRules) -> int:
    """Leading bits that choose the bucket."""
    bits = 0
    while entries > rules.bucket_entries << bits:
        bits += 1
    return bits


def _sent(chunk: int, bits: int, a: np.ndarray, more: np.ndarray | None, width: int) -> pa.RecordBatch:
    """The sorted entries of a chunk, one row for each bucket that has any."""
    bucket = (a >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(a), np.int64)
    cuts = np.flatnonzero(np.diff(bucket, prepend=-1)) if len(a) else np.zeros(0, np.int64)
    ends = np.append(cuts[1:], len(a))[: len(cuts)]
    values = a if width == 8 else ((a << np.uint64(bits)) >> np.uint64(32)).astype(np.uint32)
    return pa.RecordBatch.from_arrays(
        [pa.array(bucket[cuts], pa.int64()), pa.array(np.full(len(cuts), chunk), pa.int64()),
         pa.array([values[s:e].tobytes() for s, e in zip(cuts, ends, strict=True)], pa.binary()),
         pa.array([b"" if more is None else more[s:e].tobytes() for s, e in zip(cuts, ends, strict=True)], pa.binary())],
        names=["bucket", "chunk", "a", "b"])


_SENT = "bucket bigint, chunk bigint, a binary, b binary"


def _repeated(sent: DataFrame, width: int, name: str) -> DataFrame:
    """Sorts each bucket by itself; per chunk the bitmap of entries that others have too."""

    def sort_bucket(table: pa.Table) -> pa.Table:
        a = [np.frombuffer(x.as_py(), np.uint64 if width == 8 else np.uint32) for x in table["a"]]
        b = [np.frombuffer(x.as_py(), np.uint32) for x in table["b"]]
        whole = np.concatenate(a)
        second = np.concatenate(b) if sum(map(len, b)) else np.zeros(len(whole), np.uint32)
        order, tie = sorted_ties(whole, second)
        hit = np.zeros(len(whole) + 1, dtype=bool)
        hit[1:-1] = tie
        found = np.zeros(len(whole), dtype=bool)
        found[order] = hit[1:] | hit[:-1]
        cuts = np.cumsum([0, *map(len, a)])
        bits = [np.packbits(found[s:e]).tobytes() for s, e in zip(cuts[:-1], cuts[1:], strict=True)]
        hits = [int(found[s:e].sum()) for s, e in zip(cuts[:-1], cuts[1:], strict=True)]
        return pa.table([table["chunk"], table["bucket"], pa.array(np.diff(cuts)), pa.array(hits, pa.int64()), pa.array(bits, pa.binary())],
                        names=["chunk", "bucket", "n", "hits", "bits"])

    answers = sent.groupBy("bucket").applyInArrow(sort_bucket, "chunk bigint, bucket bigint, n bigint, hits bigint, bits binary")
    rows = answers.groupBy(F.col("chunk").alias("c")).agg(F.collect_list(F.struct("bucket", "n", "hits", "bits")).alias(name))
    return materialise(rows, name)


def _weight(name: str):
    return F.lit(64) + F.aggregate(name, F.lit(0).cast("long"), lambda s, x: s + 32 + F.octet_length(x["bits"]))


def dedup(docs: DataFrame, rules: SuffixRules = SuffixRules(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, and the bytes
    that are kept (cuts may fall inside a code point)."""
    chunks = _chunks(docs, id_col, text_col, rules)
    total = chunks.agg(F.sum(F.octet_length("blob"))).first()[0] or 0
    copies = _copies(chunks)

    def with_side(rows: DataFrame, side: DataFrame, size) -> DataFrame:
        return rows.join(small(side, size), F.col("chunk") == F.col("c"), "left").drop("c")

    work = with_side(chunks, copies, F.lit(64) + 16 * F.size("copies"))

    samples = total * len(COVER) / CYCLE
    bits1 = _buckets(samples, rules)
    width = 4 if samples < 1 << 28 else 8  # a false tie here only lets more suffixes through

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in (batch.slice(k, 1).to_pylist()[0] for k in range(batch.num_rows)):
                yield _sent(row["chunk"], bits1, Chunk(row).samples()[2], None, width)

    ranks = _repeated(work.select("chunk", "sizes", "blob", "copies").mapInArrow(rank, _SENT), width, "ranks")
    work = with_side(work, ranks, _weight("ranks"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in (batch.slice(k, 1).to_pylist()[0] for k in range(batch.num_rows)):
                yield pa.RecordBatch.from_arrays([pa.array([Chunk(row).to_send(row["ranks"])], pa.int64())], names=["n"])

    # sample strings alone do not tell: each may stand at many places of its chunk
    ranked = work.select("chunk", "sizes", "blob", "copies", "ranks")
    entries = ranked.drop("chunk").filter("ranks IS NOT NULL").mapInArrow(count, "n bigint").agg(F.sum("n")).first()[0] or 0
    bits2 = _buckets(entries, rules)

    def suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in (batch.slice(k, 1).to_pylist()[0] for k in range(batch.num_rows)):
                _, _, a, b, _, sent = Chunk(row).suffixes(row["ranks"])
                yield _sent(row["chunk"], bits2, a[sent], b[sent], 8)

    ties = _repeated(ranked.mapInArrow(suffixes, _SENT), 8, "ties")
    work = with_side(work, ties, _weight("ties"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                one = batch.slice(k, 1)
                row = one.drop_columns(["ids"]).to_pylist()[0]
                yield _kept(Chunk(row), row, one.column("ids").flatten())

    kind = chunks.schema["ids"].dataType.elementType
    schema = T.StructType([T.StructField("doc_id", kind), *(T.StructField(n, T.LongType()) for n in ("n_bytes", "n_removed", "n_spans")),
                           T.StructField("kept", T.BinaryType())])
    return work.select("ids", "sizes", "blob", "copies", "ranks", "ties").mapInArrow(cut, schema)


def _kept(chunk: Chunk, row: dict, ids: pa.Array) -> pa.RecordBatch:
    where, entry, _, _, again, sent = chunk.suffixes(row["ranks"])
    again[sent] |= _bits(row["ties"], int(sent.sum()))
    found = where[again[entry]]
    cover = np.zeros(len(chunk.data) + 1, np.int32)
    cover[found] += 1  # positions are distinct
    cover[found + DEPTH] -= 1
    gone = np.cumsum(cover[:-1]) > 0
    for d in np.flatnonzero(chunk.copied):  # the whole text is there again
        gone[chunk.starts[d]: chunk.starts[d + 1]] = True
    before = np.zeros(len(gone), dtype=bool)
    before[1:] = gone[:-1]
    heads = chunk.starts[:-1][chunk.sizes > 0]
    before[heads] = False
    removed = A.per_doc(gone, chunk.starts)
    spans = A.per_doc(gone & ~before, chunk.starts)
    ends = np.concatenate([[0], np.cumsum(chunk.sizes - removed)])
    kept = pa.Array.from_buffers(pa.large_binary(), len(ids), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(chunk.data[~gone]))])
    return pa.RecordBatch.from_arrays([ids, pa.array(chunk.sizes), pa.array(removed), pa.array(spans), kept.cast(pa.binary())],
                                      names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])
