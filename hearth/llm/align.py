"""Cross-tokenizer alignment with external spill counting.

Two tokenizers cut the same bytes; offsets where tokens of both end cut them
into groups, and every token of A in a group is linked to every token of B in
it.  A pair's count is the number of documents that hold it linked.

1. Every chunk of texts is tokenised and aligned once.  Its pair-document
   records are summed into one sorted run for each radix of the A id: zstd
   frames of (pair, documents).  Beside the run lie the records of who holds
   which pair how often.
2. Runs of a radix are merged ``fan_in`` at a time, level by level, by a heap
   of frame ends; only one frame of each run is held open.  Pairs come out
   side-major, A id first, so an id's highest count is known when the next id
   begins.
3. The counts stream back, radix by radix, to the runs of the chunks and from
   there to their documents as sums.

A text is cut before each single space between words.  No token of either
side may reach over such a place: the pattern of A breaks before the space,
and B's pieces hold a space only at their start (checked when the model is
loaded; else whole texts are encoded).  So only a chunk's distinct pieces are
tokenised.

Memory: a task holds one chunk (4 MB of text, or one longer document), or
``fan_in`` compressed runs and one frame of each, or a radix's counts, which
the vocabularies bound.  Hot ids are summed before every shuffle.

Defined results: null and empty texts, and texts that a side does not give
back byte for byte, have no tokens; repeated rows are documents of their own;
an empty table gives an empty result; other columns are never read.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hearth.llm import _arrow as A
from hearth.llm._store import SMALL_GROUPS, materialise

TOKENIZERS = "/opt/tokenizers"


@dataclass(frozen=True)
class AlignRules:
    #: Files of the two tokenizers; the driver reads them and Spark sends them to the tasks.
    a_path: str = f"{TOKENIZERS}/byte_bpe_50k.json"
    b_path: str = f"{TOKENIZERS}/piece_bpe_32k.model"
    #: Partitions by A id.
    radix: int = 8
    #: Runs that one merge reads.
    fan_in: int = 64
    #: Records of a frame.
    frame: int = 1 << 13


# ---- the two sides -------------------------------------------------------

def byte_alphabet() -> dict[str, int]:
    """Characters that stand for bytes in byte-level vocabularies: printable
    ones for themselves, the others from U+0100 on, in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


#: Fixed value: how byte-level vocabularies of this kind cut a text before merging.
WORD = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class Side:
    """Encoder of strings that begin with a space, and the bytes of every id."""

    table: pa.Array
    sizes: np.ndarray

    def _fill(self, entries: list[bytes]) -> None:
        self.table = pa.array(entries, pa.large_binary())
        self.sizes = np.array([len(e) for e in entries], np.int64)

    def __len__(self) -> int:
        return len(self.sizes)

    def encode(self, texts: list[str]) -> list[list[int]]:
        raise NotImplementedError

    def joined(self, text: str) -> np.ndarray:
        """The ids of plain pieces written one after the other."""
        return np.array(self.encode([text])[0], np.int64)


class ByteLevel(Side):
    def __init__(self, raw: bytes) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(raw.decode())
        self.tokenizer.encode_special_tokens = True
        alphabet = byte_alphabet()
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        entries = [b""] * (max(vocabulary.values()) + 1)
        for entry, k in vocabulary.items():
            known = all(c in alphabet for c in entry)
            entries[k] = bytes(alphabet[c] for c in entry) if known else entry.encode()
        self._fill(entries)
        self.ranks = self._as_ranks(json.loads(raw), vocabulary, alphabet)

    @staticmethod
    def _as_ranks(file: dict, vocabulary: dict[str, int], alphabet: dict[str, int]):
        """The same vocabulary with ids as merge ranks, if the file's merges come in the order of their ids."""
        import tiktoken

        model, cut = file["model"], file.get("pre_tokenizer") or {}
        merges = ["".join(m if isinstance(m, list) else m.split(" ")) for m in model.get("merges", [])]
        ids = [vocabulary.get(m, -1) for m in merges]
        usual = (model["type"] == "BPE" and not file.get("normalizer") and cut.get("type") == "ByteLevel"
                 and cut.get("use_regex", True) and not cut.get("add_prefix_space"))
        if not usual or min(ids, default=0) < 0 or any(a >= b for a, b in zip(ids, ids[1:], strict=False)):
            return None
        own = [(m, vocabulary[m]) for m in {*merges, *alphabet} if m in vocabulary]
        return tiktoken.Encoding("a", pat_str=WORD, mergeable_ranks={bytes(alphabet[c] for c in m): k for m, k in own}, special_tokens={})

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def joined(self, text: str) -> np.ndarray:
        return super().joined(text) if self.ranks is None else np.array(self.ranks.encode_ordinary(text), np.int64)


class Pieces(Side):
    SPACE = "▁"

    def __init__(self, raw: bytes) -> None:
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_proto=raw)
        names = [self.model.id_to_piece(k) for k in range(self.model.vocab_size())]
        self._fill([bytes([int(p[3:5], 16)]) if self.model.is_byte(k) else p.replace(self.SPACE, " ").encode()
                    for k, p in enumerate(names)])
        #: No piece holds a space behind another character, and spaces are kept as they are.
        self.cuts_at_spaces = not any(self.SPACE in p.lstrip(self.SPACE) for p in names) and \
            self.model.encode("a  b ") == self.model.encode("a") + self.model.encode(" b ")

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode([t[1:] for t in texts], num_threads=1)  # it adds the space itself


class Sides:
    """Both tokenizers, built once in each Python worker."""

    built: dict[str, Sides] = {}

    def __init__(self, raw_a: bytes, raw_b: bytes) -> None:
        self.a, self.b = ByteLevel(raw_a), Pieces(raw_b)
        n = len(self.a), len(self.b)
        numbers = [[f"{k}{mark}".encode() for k in range(m)] for m, marks in zip(n, (",|", ",;"), strict=True) for mark in marks]
        self.written = pa.array([x for part in numbers for x in part], pa.large_binary())
        self.shift = np.cumsum([0, n[0], n[0], n[1]])  # "a,", "a|", "b,", "b;"

    @classmethod
    def of(cls, key: str, sent) -> Sides:
        if key not in cls.built:
            cls.built[key] = cls(*sent.value)
        return cls.built[key]


# ---- alignment of a chunk ------------------------------------------------

_SPACES = A.lut(b" \t\n\x0b\x0c\r")


def _pieces(data: np.ndarray, offsets: np.ndarray, cut: bool) -> np.ndarray:
    """Starts of the pieces: documents, and (if ``cut``) each space between a
    character that is no white space and one that is none in ASCII."""
    heads = offsets[:-1]
    if not cut or len(data) < 3:
        return heads
    at = np.flatnonzero(data[1:-1] == 32) + 1
    before, after = data[at - 1], data[at + 1]
    two = data[np.maximum(at - 2, 0)]
    three = data[np.maximum(at - 3, 0)]
    # other white space of Unicode ends in C2 85, C2 A0, or is one of three bytes from E1, E2 or E3
    safe = ((before > 32) & (before < 127)) | ((before >= 128) & (two != 0xC2) & ((three < 0xE1) | (three > 0xE3)))
    at = at[safe & ~_SPACES[after]]
    inner = np.zeros(len(data) + 1, dtype=bool)
    inner[at] = True
    inner[heads + 1] = False  # a text's own first space stays with the added one
    inner[offsets[1:] - 1] = False
    inner[heads] = True
    return np.flatnonzero(inner)


def _taken(table: pa.Array, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return A.flat(table.take(pa.array(index)))


def _spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for each run, one after the other."""
    ends = np.cumsum(counts)
    return np.repeat(starts - ends + counts, counts) + np.arange(int(ends[-1]) if len(ends) else 0)


#: Bytes of text that A's two encoders cut alike whatever their Unicode tables: ASCII without controls, Latin letters.
_SIMPLE = A.lut(bytes([9, 10, *range(32, 127), *range(0x80, 0xC0), *range(0xC3, 0xCA)]))


def _plain(body: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Pieces that may be written one after the other and encoded at once: one
    space, no white space behind it, and none at the end."""
    starts, ends = bounds[:-1], bounds[1:]
    ok = (ends - starts > 1) & (A.per_doc(~_SIMPLE[body], bounds) == 0)
    at = np.flatnonzero(ok)
    ok[at] &= (body[starts[at]] == 32) & ~_SPACES[body[starts[at] + 1]] & ~_SPACES[body[ends[at] - 1]]
    return ok


#: Bytes of pieces that are encoded at once.
_JOINED = 1 << 16


def _encoded(side: Side, pieces: pa.Array, plain: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all pieces, one after the other, and how many each has."""
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    alone = [np.flatnonzero(~plain)]
    at = np.flatnonzero(plain)
    body, bounds = A.flat(pieces.filter(pa.array(plain)))
    k = 0
    while k < len(at):
        e = max(k + 1, int(np.searchsorted(bounds, bounds[k] + _JOINED, "right")) - 1)
        text = body[bounds[k]: bounds[e]]
        ids = side.joined(text.tobytes().decode())
        ends = bounds[k] + np.cumsum(side.sizes[ids])
        cuts = np.searchsorted(ends, bounds[k + 1: e + 1])
        if len(ids) and ends[-1] == bounds[e] and (ends[np.minimum(cuts, len(ids) - 1)] == bounds[k + 1: e + 1]).all():
            found.append((at[k:e], ids, np.diff(cuts, prepend=-1)))
        else:  # some piece is not given back; each by itself tells which
            alone.append(at[k:e])
        k = e
    rest = np.concatenate(alone)
    lists = side.encode(pieces.take(pa.array(rest)).cast(pa.large_string()).to_pylist()) if len(rest) else []
    found.append((rest, np.array([x for ids in lists for x in ids], np.int64), np.array([len(x) for x in lists], np.int64)))
    of, ids, counts = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.argsort(of, kind="stable")
    return ids[_spread((np.cumsum(counts) - counts)[order], counts[order])], counts[order]


class Pairs:
    """Groups, links and written groups of distinct pieces."""

    def __init__(self, sides: Sides, pieces: pa.Array) -> None:
        body, bounds = A.flat(pieces)
        n = len(pieces)
        self.ok = np.ones(n, dtype=bool)
        found = []
        plain = _plain(body, bounds) if sides.b.cuts_at_spaces else np.zeros(n, dtype=bool)
        for side in (sides.a, sides.b):
            ids, counts = _encoded(side, pieces, plain)
            found.append((side, ids, counts))
            self.ok &= self._gives_back(side, ids, counts, body, bounds)
        ends, ids, counts = [], [], []
        for side, x, c in found:
            x = x[np.repeat(self.ok, c)]
            ids.append(x)
            counts.append(np.where(self.ok, c, 0))
            ends.append(np.cumsum(side.sizes[x]))
        (a, b), (self.n_a, self.n_b) = ids, counts
        cuts = np.intersect1d(ends[0], ends[1], assume_unique=True)
        groups = [np.searchsorted(cuts, e) for e in ends]
        in_a, in_b = (np.bincount(g, minlength=len(cuts)) for g in groups)
        piece_ends = np.cumsum(np.where(self.ok, np.diff(bounds), 0))
        piece = np.searchsorted(piece_ends, cuts)  # of each group; pieces without tokens end where another does
        self.n_groups = np.bincount(piece, minlength=n)
        self.n_links = np.zeros(n, np.int64)
        np.add.at(self.n_links, piece, in_a * in_b)
        self._links(a, b, groups[0], in_a, in_b, piece, n)
        # written groups: A's ids, a bar, B's ids, a semicolon
        at_a, at_b = np.cumsum(in_a) - in_a, np.cumsum(in_b) - in_b
        last_a, last_b = np.zeros(len(a), dtype=bool), np.zeros(len(b), dtype=bool)
        last_a[at_a + in_a - 1] = True
        last_b[at_b + in_b - 1] = True
        order = np.empty(len(a) + len(b), np.int64)
        shift = sides.shift
        order[np.arange(len(a)) + at_b[groups[0]]] = a + np.where(last_a, shift[1], shift[0])
        order[np.arange(len(b)) + (at_a + in_a)[groups[1]]] = b + np.where(last_b, shift[3], shift[2])
        text, at = _taken(sides.written, order)
        tokens = np.concatenate([[0], np.cumsum(self.n_a + self.n_b)])
        self.written = pa.Array.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(np.ascontiguousarray(at[tokens])), pa.py_buffer(np.ascontiguousarray(text))])

    @staticmethod
    def _gives_back(side: Side, ids: np.ndarray, counts: np.ndarray, body: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Pieces whose tokens' bytes are the piece's."""
        sizes = A.per_doc(side.sizes[ids], np.concatenate([[0], np.cumsum(counts)]))
        ok = sizes == np.diff(bounds)
        same, _ = _taken(side.table, ids[np.repeat(ok, counts)])
        off = same != body[np.repeat(ok, np.diff(bounds))]
        ok[ok] = A.per_doc(off, np.concatenate([[0], np.cumsum(np.diff(bounds)[ok])])) == 0
        return ok

    def _links(self, a, b, group_a, in_a, in_b, piece, n) -> None:
        """pair (A id << 32 | B id), times and first link of each piece."""
        first_a, first_b = np.cumsum(in_a) - in_a, np.cumsum(in_b) - in_b
        wide = in_a * in_b > 4096
        one = ~wide[group_a]
        times = in_b[group_a[one]]
        pair = (np.repeat(a[one], times) << 32) | b[_spread(first_b[group_a[one]], times)]
        of = np.repeat(piece[group_a[one]], times)
        mult = np.ones(len(pair), np.int64)
        for g in np.flatnonzero(wide):  # ids of a long group by their numbers, not by all occurrences
            ua, ca = np.unique(a[first_a[g]: first_a[g] + in_a[g]], return_counts=True)
            ub, cb = np.unique(b[first_b[g]: first_b[g] + in_b[g]], return_counts=True)
            pair = np.concatenate([pair, ((ua[:, None] << 32) | ub).ravel()])
            mult = np.concatenate([mult, (ca[:, None] * cb).ravel()])
            of = np.concatenate([of, np.full(len(ua) * len(ub), piece[g])])
        order = np.argsort(of, kind="stable")
        self.pair, self.mult = pair[order], mult[order]
        self.first = np.searchsorted(of[order], np.arange(n + 1))


def _packed(*columns: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(b"".join(np.ascontiguousarray(c).tobytes() for c in columns))


def _unpacked(blob: bytes, *kinds) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n = len(raw) // sum(np.dtype(k).itemsize for k in kinds)
    out, at = [], 0
    for k in kinds:
        out.append(np.frombuffer(raw, k, n, at))
        at += n * np.dtype(k).itemsize
    return out


def frames(pairs: np.ndarray, counts: np.ndarray, size: int) -> list[bytes]:
    """A sorted run as frames of (differences of pairs, counts)."""
    return [_packed(np.diff(pairs[k: k + size], prepend=0), counts[k: k + size].astype(np.int64)) for k in range(0, len(pairs), size)]


def _opened(frame: bytes) -> tuple[np.ndarray, np.ndarray]:
    steps, counts = _unpacked(frame, np.int64, np.int64)
    return np.cumsum(steps), counts


def merged(runs: list[list[bytes]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """K-way merge of sorted runs with equal pairs summed: blocks in order.

    The heap holds the last pair of each run's open frame.  Everything up to
    the smallest of them is in the open frames, so it can go out; then that
    frame's run opens its next one.
    """
    rest = [iter(r) for r in runs]
    open_ = [_opened(f) if (f := next(r, None)) is not None else None for r in rest]
    heap = [(int(o[0][-1]), k) for k, o in enumerate(open_) if o is not None]
    heapq.heapify(heap)
    while heap:
        fence = heap[0][0]
        parts = []
        for k, o in enumerate(open_):
            if o is not None and o[0][0] <= fence:
                e = int(np.searchsorted(o[0], fence, "right"))
                parts.append((o[0][:e], o[1][:e]))
                open_[k] = (o[0][e:], o[1][e:]) if e < len(o[0]) else None
        while heap and heap[0][0] == fence:
            _, k = heapq.heappop(heap)
            if (f := next(rest[k], None)) is not None:
                open_[k] = _opened(f)
                heapq.heappush(heap, (int(open_[k][0][-1]), k))
        pairs = np.concatenate([p for p, _ in parts])
        order = np.argsort(pairs, kind="stable")
        pairs, counts = pairs[order], np.concatenate([c for _, c in parts])[order]
        new = np.flatnonzero(np.diff(pairs, prepend=-1))
        yield pairs[new], np.add.reduceat(counts, new)


def with_best(blocks: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Blocks in side-major order with a mark on each A id's highest counts;
    the last id of a block waits for the next one."""
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def done(pairs: np.ndarray, counts: np.ndarray):
        ids = pairs >> 32
        first = np.flatnonzero(np.diff(ids, prepend=-1))
        most = np.maximum.reduceat(counts, first)
        return pairs, counts, counts == np.repeat(most, np.diff(np.append(first, len(ids))))

    for block in blocks:
        held.append(block)
        pairs, counts = (np.concatenate(x) for x in zip(*held, strict=True))
        cut = int(np.searchsorted(pairs, (pairs[-1] >> 32) << 32))
        if cut:
            yield done(pairs[:cut], counts[:cut])
        held = [(pairs[cut:], counts[cut:])]
    if held:
        yield done(*held[0])


_STATS = ("n_a", "n_b", "n_groups", "n_links")


def _aligned(sides: Sides, rows: pa.RecordBatch, chunk: int, rules: AlignRules) -> pa.RecordBatch:
    """One chunk's documents, and its runs."""
    data, offsets = A.flat(rows.column("text"))
    docs = rows.num_rows
    starts = _pieces(data, offsets, sides.b.cuts_at_spaces)
    of = np.searchsorted(offsets, starts, "right") - 1
    bounds = np.append(starts, len(data)).astype(np.int64)
    column = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(data))])
    coded = column.dictionary_encode()
    index = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    pieces = Pairs(sides, coded.dictionary)
    fine = np.diff(offsets) > 1
    fine[of[~pieces.ok[index]]] = False
    keep = fine[of]
    index, of = index[keep], of[keep]
    first = np.searchsorted(of, np.arange(docs + 1))
    stats = [A.per_doc(getattr(pieces, n)[index], first) for n in _STATS]
    text, at = _taken(pieces.written, index)
    view, digests = memoryview(np.ascontiguousarray(text)), []
    for d in range(docs):
        s, e = int(at[first[d]]), int(at[first[d + 1]])
        digests.append(hashlib.sha256(view[s: e - 1]).hexdigest() if e > s else "")
    # dense pairs of the chunk; one record for each document and pair
    dense, code = np.unique(pieces.pair, return_inverse=True)
    counts = np.diff(pieces.first)[index]
    link = _spread(pieces.first[:-1][index], counts)
    key = np.repeat(of, counts) * max(1, len(dense)) + code[link]
    order = np.argsort(key, kind="stable")
    new = np.flatnonzero(np.diff(key[order], prepend=-1))
    held = key[order][new]
    times = np.add.reduceat(pieces.mult[link][order], new) if len(new) else np.zeros(0, np.int64)
    doc, pair = held // max(1, len(dense)), held % max(1, len(dense))
    per_pair = np.bincount(pair, minlength=len(dense))
    here = per_pair > 0  # pieces of documents without tokens leave pairs that nobody holds
    radix = (dense >> 32) % rules.radix
    runs = []
    for r in range(rules.radix):
        mine = np.flatnonzero((radix == r) & here)
        if not len(mine):
            continue
        place = np.full(len(dense), -1, np.int64)
        place[mine] = np.arange(len(mine))
        at_pair = place[pair]
        got = at_pair >= 0
        runs.append({"radix": r, "n": len(mine), "run": frames(dense[mine], per_pair[mine], rules.frame),
                     "back": _packed(doc[got].astype(np.int32), at_pair[got].astype(np.int32), times[got])})
    one = pa.array([0, docs], pa.int32())
    lists = [rows.column("id"), *(pa.array(s) for s in stats), pa.array(digests, pa.string())]
    return pa.RecordBatch.from_arrays(
        [pa.array([chunk], pa.int64()), *(pa.ListArray.from_arrays(one, x) for x in lists), pa.array([runs], _RUNS)],
        names=["chunk", "ids", *_STATS, "groups_sha256", "runs"])


_RUNS = pa.list_(pa.struct([("radix", pa.int32()), ("n", pa.int64()), ("run", pa.list_(pa.binary())), ("back", pa.binary())]))


def _chunks(docs: DataFrame, rules: AlignRules, id_col: str, text_col: str) -> DataFrame:
    """One row per chunk: its documents' figures and its runs."""
    spark = docs.sparkSession
    raw = []
    for path in (rules.a_path, rules.b_path):
        with open(path, "rb") as f:
            raw.append(f.read())
    key = hashlib.sha256(raw[0] + raw[1]).hexdigest()
    sent = spark.sparkContext.broadcast(tuple(raw))  # two vocabulary files
    rows = docs.select(F.col(id_col).alias("id"), F.concat(F.lit(" "), F.coalesce(F.col(text_col), F.lit(""))).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides, part, number = Sides.of(key, sent), TaskContext.get().partitionId(), 0
        held: list[pa.RecordBatch] = []
        size = 0

        def out() -> pa.RecordBatch:
            table = pa.Table.from_batches(held).combine_chunks()
            return _aligned(sides, table.to_batches()[0], (part << 32) + number, rules)

        for batch in batches:
            done = 0
            for piece, data, _ in A.slices(batch, "text"):
                if held and size + len(data) > A.SLICE_BYTES:
                    yield out()
                    number, held, size = number + 1, [], 0
                held.append(batch.slice(done, piece.num_rows))
                size += len(data)
                done += piece.num_rows
        if held:
            yield out()

    many = [T.StructField(n, T.ArrayType(T.LongType())) for n in _STATS]
    runs = T.ArrayType(T.StructType([T.StructField("radix", T.IntegerType()), T.StructField("n", T.LongType()),
                                     T.StructField("run", T.ArrayType(T.BinaryType())), T.StructField("back", T.BinaryType())]))
    schema = T.StructType([T.StructField("chunk", T.LongType()), T.StructField("ids", T.ArrayType(rows.schema["id"].dataType)), *many,
                           T.StructField("groups_sha256", T.ArrayType(T.StringType())), T.StructField("runs", runs)])
    return materialise(rows.mapInArrow(run, schema), "aligned", SMALL_GROUPS)


def _counts(runs: DataFrame, chunks: int, rules: AlignRules) -> DataFrame:
    """One row per radix: the pairs, how many documents hold each, and the best marks."""

    def merge(table: pa.Table) -> pa.Table:
        out: list[bytes] = []
        for pairs, counts in merged(table["run"].to_pylist()):
            out += frames(pairs, counts, rules.frame)
        return pa.table([pa.array([table["radix"][0].as_py()], pa.int32()), pa.array([table["into"][0].as_py()], pa.int64()), pa.array([out], pa.list_(pa.binary()))],
                        names=["radix", "part", "run"])

    def last(table: pa.Table) -> pa.Table:
        blocks = list(with_best(merged(table["run"].to_pylist())))
        blob = [_packed(p, c, b) for p, c, b in blocks]
        return pa.table([pa.array([table["radix"][0].as_py()], pa.int32()), pa.array([blob], pa.list_(pa.binary()))], names=["radix", "counts"])

    level, parts = runs.select("radix", F.xxhash64("chunk").alias("part"), "run"), chunks
    while parts > rules.fan_in:
        parts = -(-parts // rules.fan_in)
        into = F.pmod(F.col("part"), F.lit(parts))
        level = level.withColumn("into", into).groupBy("radix", "into").applyInArrow(merge, "radix int, part bigint, run array<binary>")
        level = materialise(level, "merged", SMALL_GROUPS)
    return materialise(level.groupBy("radix").applyInArrow(last, "radix int, counts array<binary>"), "counts", SMALL_GROUPS)


def align(docs: DataFrame, rules: AlignRules = AlignRules(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_a, n_b, n_groups, n_links, n_best,
    count_sum, groups_sha256."""
    chunks = _chunks(docs, rules, id_col, text_col)
    n_chunks = chunks.count()
    runs = chunks.select("chunk", F.explode("runs").alias("r")).select("chunk", "r.*")
    counts = _counts(runs, n_chunks, rules)
    groups = max(1, -(-n_chunks // rules.fan_in))

    def back(mine: pa.Table, total: pa.Table) -> pa.Table:
        blocks = [_unpacked(f, np.int64, np.int64, np.bool_) for f in total["counts"][0].as_py()] if total.num_rows else []
        out = []
        if blocks:
            pairs, counts, best = (np.concatenate(x) for x in zip(*blocks, strict=True))
        for chunk, run, held in zip(mine["chunk"], mine["run"], mine["back"], strict=True):
            own = np.concatenate([_opened(f)[0] for f in run.as_py()])
            at = np.searchsorted(pairs, own)
            doc, pair, times = _unpacked(held.as_py(), np.int32, np.int32, np.int64)
            first = np.flatnonzero(np.diff(doc, prepend=-1))
            sums = np.add.reduceat(counts[at][pair] * times, first)
            bests = np.add.reduceat(best[at][pair] * times, first)
            out.append(pa.RecordBatch.from_arrays([pa.array(np.full(len(first), chunk.as_py()), pa.int64()), pa.array(doc[first]), pa.array(bests), pa.array(sums)],
                                                  names=["chunk", "pos", "n_best", "count_sum"]))
        schema = pa.schema([("chunk", pa.int64()), ("pos", pa.int32()), ("n_best", pa.int64()), ("count_sum", pa.int64())])
        return pa.Table.from_batches(out, schema=schema)

    mine = runs.withColumn("part", F.pmod(F.xxhash64("chunk"), F.lit(groups)))
    total = counts.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))))
    sums = (mine.groupBy("radix", "part").cogroup(total.groupBy("radix", "part"))
            .applyInArrow(back, "chunk bigint, pos int, n_best bigint, count_sum bigint")
            .groupBy("chunk", "pos").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum")))
    rows = chunks.select("chunk", F.posexplode(F.arrays_zip("ids", *_STATS, "groups_sha256")).alias("pos", "d"))
    rows = rows.select("chunk", "pos", F.col("d.ids").alias("doc_id"), *(F.col(f"d.{n}").alias(n) for n in (*_STATS, "groups_sha256")))
    zero = F.lit(0).cast("long")
    return rows.join(sums, ["chunk", "pos"], "left").select(
        "doc_id", *_STATS, F.coalesce("n_best", zero).alias("n_best"), F.coalesce("count_sum", zero).alias("count_sum"), "groups_sha256")
