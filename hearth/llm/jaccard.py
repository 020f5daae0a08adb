"""N-gram Jaccard join with Bayesian candidate pruning.

Equal texts are one node.  Every node gets 128 MinHash values of its set of
five-word shingles; 32 bands of 4 values make candidate buckets (a pair of
similarity 0.8 shares none with probability 5e-8).  Inside a bucket the values
of a pair are compared 16 at a time, and a pair is dropped as soon as the
posterior probability that its similarity reaches the threshold falls below
``tolerance``; the others are settled by their exact shingle sets.

A pair is judged in the first band it shares only, so nothing is counted
twice and no list of pairs is ever shuffled: tasks return links per node and
one edge per node to its local group.  A bucket larger than ``block`` nodes is
cut into blocks, and every pair of blocks is a task group of its own, so a
bucket with a third of all nodes never meets in one task.

Defined results: a null text is an empty one; texts without words have no
shingles and link to nothing (equal ones share a class); a text of one to four
words is one shingle; repeated rows count as copies; the class id is the
smallest document id of the class, null only if all are null; an empty table
gives an empty result; other columns pass through untouched.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearth.llm import _arrow as A
from hearth.llm._shingles import words
from hearth.llm._store import bounded, materialise

HASHES, BANDS, STEP = 128, 32, 16
ROWS = HASHES // BANDS
#: Pairs compared at once inside a task.
PAIRS = 1 << 15
_RNG = np.random.default_rng(20240607)
_MUL = _RNG.integers(1 << 32, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _RNG.integers(0, 1 << 63, HASHES, dtype=np.uint64)


@dataclass(frozen=True)
class JoinRules:
    similarity: float = 0.8
    tolerance: float = 1e-8
    block: int = 512


def least_matches(rules: JoinRules) -> dict[int, int]:
    """For n compared values: the fewest equal ones at which the posterior
    probability of reaching the threshold is still at least the tolerance
    (uniform prior; two different 8-bit values agree by chance in 1 of 256)."""
    grid = (np.arange(20000) + 0.5) / 20000
    p = grid + (1 - grid) / 256
    out = {}
    for n in range(STEP, HASHES + 1, STEP):
        for m in range(n + 1):
            log = m * np.log(p) + (n - m) * np.log1p(-p)
            like = np.exp(log - log.max())
            if like[grid >= rules.similarity].sum() >= rules.tolerance * like.sum():
                out[n] = m
                break
    return out


def minhashes(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """(documents with shingles, 128) smallest 32-bit hashes."""
    out = np.empty((len(first) - 1, HASHES), np.uint32)
    d = 0
    while d < len(first) - 1:  # a few documents at a time stay in the cache
        e = max(d + 1, int(np.searchsorted(first, first[d] + (1 << 14), "right")) - 1)
        part, cuts = h[first[d]: first[e]], first[d:e] - first[d]
        for k in range(HASHES):
            v = ((part * _MUL[k] + _ADD[k]) >> np.uint64(32)).astype(np.uint32)
            out[d:e, k] = np.minimum.reduceat(v, cuts)
        d = e
    return out


def bands_of(values: np.ndarray) -> np.ndarray:
    """64-bit key of each band (the band's number is part of it)."""
    out = np.empty((len(values), BANDS), np.uint64)
    for b in range(BANDS):
        key = np.full(len(values), b + 1, np.uint64)
        for r in range(ROWS):
            key = A.mix(key * np.uint64(0x9E3779B97F4A7C15) ^ values[:, b * ROWS + r].astype(np.uint64))
        out[:, b] = key
    return out


def _blobs(rows: np.ndarray) -> pa.Array:
    """Each row of a 2-d array as a binary value."""
    raw = np.ascontiguousarray(rows)
    width = raw.itemsize * raw.shape[1]
    ends = np.arange(len(raw) + 1, dtype=np.int32) * width
    return pa.Array.from_buffers(pa.binary(), len(raw), [None, pa.py_buffer(ends), pa.py_buffer(raw)])


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    """The other way round: binary values of one size, or lists of 64-bit keys."""
    if pa.types.is_list(column.type):
        return column.combine_chunks().flatten().to_numpy().view(np.uint64).reshape(len(column), BANDS)
    return A.flat(column)[0].reshape(len(column), HASHES)


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for w in words(batches, "t"):
        h, _, first = w.shingles()
        full = np.flatnonzero(np.diff(first))
        cuts = np.append(first[full], first[-1])
        keys = w.rows.column("key").take(pa.array(full))
        values = minhashes(h, cuts) if len(full) else np.zeros((0, HASHES), np.uint32)
        buckets = bands_of(values)
        ends = np.arange(len(buckets) + 1, dtype=np.int32) * BANDS
        lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(buckets.view(np.int64).ravel()))
        yield pa.RecordBatch.from_arrays([keys, _blobs((values & 0xFF).astype(np.uint8)), lists], names=["key", "sig", "bands"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for w in words(batches, "t"):
        h, _, first = w.shingles()
        own = [np.unique(h[a:b]).tobytes() for a, b in zip(first[:-1], first[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([w.rows.column("key"), pa.array(own, pa.binary())], names=["key", "shingles"])


def whole_groups(batches: Iterator[pa.RecordBatch], by: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Batches sorted by ``by``, regrouped so that no group is cut: (rows, group bounds)."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        new = _changes(batch, by)
        if held and all(held[-1].column(c)[-1].equals(batch.column(c)[0]) for c in by):
            cut = int(new[1]) if len(new) > 1 else batch.num_rows
        else:
            cut = 0
        if cut < batch.num_rows:
            if cut:
                held.append(batch.slice(0, cut))
            if held:
                yield _table(held, by)
            last = int(new[-1])
            if last > cut:
                yield _table([batch.slice(cut, last - cut)], by)
            held = [batch.slice(max(last, cut))]
        else:
            held.append(batch)
    if held:
        yield _table(held, by)


def _changes(batch: pa.RecordBatch, by: list[str]) -> np.ndarray:
    """Rows at which a new group starts (0 included)."""
    new = np.zeros(batch.num_rows, dtype=bool)
    new[:1] = True
    for c in by:
        v = batch.column(c).to_numpy(zero_copy_only=False)
        new[1:] |= v[1:] != v[:-1]
    return np.flatnonzero(new)


def _table(held: list[pa.RecordBatch], by: list[str]) -> tuple[pa.Table, np.ndarray]:
    table = pa.Table.from_batches(held).combine_chunks()
    return table, np.append(_changes(table.to_batches()[0], by), table.num_rows)


def group_pairs(bounds: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of rows inside the groups, in portions of bounded size."""
    sizes = np.diff(bounds)
    for size in np.unique(sizes[sizes > 1]):
        a, b = np.triu_indices(size, 1)
        starts = bounds[:-1][sizes == size]
        per = max(1, PAIRS // len(a))
        for k in range(0, len(starts), per):
            base = starts[k: k + per, None]
            left, right = (base + a).ravel(), (base + b).ravel()
            for j in range(0, len(left), PAIRS):
                yield left[j: j + PAIRS], right[j: j + PAIRS]


def live_pairs(table: pa.Table, bounds: np.ndarray, limits: dict[int, int]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of a bucket that share no earlier band and survive the pruning."""
    sig, bands = _matrix(table["sig"]), _matrix(table["bands"])
    bucket, chunk = table["bucket"].to_numpy().view(np.uint64), table["chunk"].to_numpy()
    mixed = table["i"].to_numpy() != table["j"].to_numpy()
    for a, b in group_pairs(bounds):
        if mixed.any():
            ok = ~mixed[a] | (chunk[a] != chunk[b])
            a, b = a[ok], b[ok]
        first = (bands[a] == bands[b]).argmax(axis=1)
        ok = bands[a, first] == bucket[a]
        a, b = a[ok], b[ok]
        same = np.zeros(len(a), np.int64)
        for n in range(STEP, HASHES + 1, STEP):
            same += (sig[a, n - STEP: n] == sig[b, n - STEP: n]).sum(axis=1)
            ok = same >= limits[n]
            a, b, same = a[ok], b[ok], same[ok]
        if len(a):
            yield a, b


def _similar(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray, least: float) -> np.ndarray:
    """Exact test of the pairs: shared >= least * union."""
    sizes = np.array([len(s) for s in sets], np.int64)
    used, back = np.unique(np.concatenate([a, b]), return_inverse=True)
    total = int(sizes[used].sum())
    if len(used) ** 2 * total / max(1, len(used)) * 1e-10 < len(a) * 3e-5 and len(a) > len(used):
        # many pairs among few sets: count shared shingles by matrix products
        owner = np.repeat(np.arange(len(used)), sizes[used])
        _, ids, counts = np.unique(np.concatenate([sets[k] for k in used]), return_inverse=True, return_counts=True)
        often = counts[ids] > 1
        owner, ids = owner[often], (np.cumsum(counts > 1) - 1)[ids[often]]
        order = np.argsort(ids, kind="stable")
        owner, ids = owner[order], ids[order]
        shared = np.zeros((len(used), len(used)), np.float32)
        width = int(ids[-1]) + 1 if len(ids) else 0
        for k in range(0, width, 4096):
            lo, hi = np.searchsorted(ids, [k, k + 4096])
            part = np.zeros((len(used), min(4096, width - k)), np.float32)
            part[owner[lo:hi], ids[lo:hi] - k] = 1
            shared += part @ part.T
        both = shared[back[: len(a)], back[len(a):]].astype(np.int64)
    else:
        both = np.array([len(np.intersect1d(sets[x], sets[y], assume_unique=True)) for x, y in zip(a, b, strict=True)], np.int64)
    return both >= least * (sizes[a] + sizes[b] - both) - 1e-9


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest row that each row is connected to."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = np.minimum(new, new[new])
        if (new == root).all():
            return root
        root = new


_BY = ["bucket", "i", "j"]


def _grouped(rows: DataFrame, run: Callable, schema: str) -> DataFrame:
    dealt = rows.repartition(*_BY).sortWithinPartitions(*_BY)
    return dealt.mapInArrow(run, schema)


@dataclass
class Joined:
    """classes: key, copy_id, n_copies; links: key, n_links (nodes that have any);
    edges: key, root (a smaller node of the same group)."""

    texts: DataFrame
    classes: DataFrame
    links: DataFrame
    edges: DataFrame


def join(docs: DataFrame, rules: JoinRules, id_col: str, text_col: str) -> Joined:
    text = F.coalesce(F.col(text_col), F.lit(""))
    texts = docs.select(F.col(id_col).alias("id"), F.unhex(F.md5(text)).alias("key"), text.alias("t"))
    classes = materialise(texts.groupBy("key").agg(F.min("id").alias("copy_id"), F.count("*").alias("n_copies")), "classes")
    nodes = materialise(texts.select("key", "t").mapInArrow(_signed, "key binary, sig binary, bands array<bigint>")
                        .dropDuplicates(["key"]), "signatures")

    # buckets with two nodes or more, cut into pairs of blocks
    buckets = nodes.select("key", F.explode("bands").alias("bucket"))
    shared = buckets.groupBy("bucket").count().filter("count > 1").withColumnRenamed("bucket", "of")
    rows = buckets.join(shared, F.col("bucket") == F.col("of")).select(
        "bucket", "key", F.ceil(F.col("count") / rules.block).alias("n"))
    rows = rows.withColumn("chunk", F.pmod(F.xxhash64("key"), F.col("n")))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1))).select(
        "key", "bucket", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"), "chunk")
    rows = materialise(rows, "candidates")
    limits, least = least_matches(rules), rules.similarity

    def prune(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, bounds in whole_groups(batches, _BY):
            live = np.zeros(table.num_rows, dtype=bool)
            for a, b in live_pairs(table, bounds, limits):
                live[a] = live[b] = True
            yield from table.select(["key", *_BY, "chunk"]).filter(pa.array(live)).to_batches()

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, bounds in whole_groups(batches, _BY):
            data, at = A.flat(table["shingles"])
            sets = [data[x:y].view(np.uint64) for x, y in zip(at[:-1], at[1:], strict=True)]
            count, left, right = np.zeros(table.num_rows, np.int64), [], []
            for a, b in live_pairs(table, bounds, limits):
                ok = _similar(sets, a, b, least)
                a, b = a[ok], b[ok]
                np.add.at(count, a, 1)
                np.add.at(count, b, 1)
                left.append(a)
                right.append(b)
            if count.any():
                root = _roots(table.num_rows, np.concatenate(left), np.concatenate(right))
                has = np.flatnonzero(count)
                key = table["key"].combine_chunks()
                yield pa.RecordBatch.from_arrays([key.take(pa.array(has)), pa.array(count[has]), key.take(pa.array(root[has]))],
                                                 names=["key", "n", "root"])

    fields = "key binary, bucket bigint, i bigint, j bigint, chunk bigint"
    node = nodes.withColumnRenamed("key", "node")
    live = materialise(_grouped(rows.join(node, F.col("key") == F.col("node")).drop("node"), prune, fields), "live")
    # texts of the nodes that are left: one row for each, found by key and smallest id
    need = live.select(F.col("key").alias("k")).distinct()
    need = materialise(need.join(classes, F.col("k") == F.col("key")).select("k", "copy_id"), "needed")
    chosen = texts.join(bounded(need, 64), (F.col("key") == F.col("k")) & F.col("id").eqNullSafe(F.col("copy_id")), "left_semi")
    sets = materialise(chosen.select("key", "t").dropDuplicates(["key"]).mapInArrow(_sets, "key binary, shingles binary"), "shingles")
    full = live.join(node, F.col("key") == F.col("node")).drop("node")
    full = full.join(sets.withColumnRenamed("key", "node"), F.col("key") == F.col("node")).drop("node")
    found = materialise(_grouped(full, settle, "key binary, n bigint, root binary"), "links")
    links = found.groupBy("key").agg(F.sum("n").alias("n_links"))
    return Joined(texts, classes, links, found.filter("key <> root").select("key", "root").distinct())


def components(edges: DataFrame) -> DataFrame:
    """(key, label): the smallest key that each key is connected to, by
    neighbour minima and pointer jumping; each round is written once."""
    both = materialise(edges.select("key", F.col("root").alias("other")).unionByName(
        edges.select(F.col("root").alias("key"), F.col("key").alias("other"))), "edges")
    labels = materialise(both.groupBy("key").agg(F.least(F.min("other"), F.first("key")).alias("label")), "labels")
    while True:
        seen = labels.select(F.col("key").alias("k"), F.col("label").alias("l"))
        near = both.join(seen, F.col("other") == F.col("k")).groupBy("key").agg(F.min("l").alias("low"))
        low = labels.join(near.withColumnRenamed("key", "k"), F.col("key") == F.col("k")).select(
            "key", F.col("label").alias("old"), F.least("label", "low").alias("low"))
        new = low.join(seen, F.col("low") == F.col("k")).select("key", "old", F.least("low", "l").alias("label"))
        new = materialise(new, "labels")
        changed = not new.filter("label <> old").isEmpty()
        labels = new.select("key", "label")
        if not changed:
            return labels


def node_classes(found: Joined) -> DataFrame:
    """One row per distinct text: key, copy_id, n_copies, n_links, class_id."""
    labels = components(found.edges).withColumnRenamed("key", "k")
    rows = found.classes.join(labels, F.col("key") == F.col("k"), "left").withColumn("label", F.coalesce("label", "key")).drop("k")
    best = rows.groupBy(F.col("label").alias("l")).agg(F.min("copy_id").alias("class_id"))
    rows = rows.join(best, F.col("label") == F.col("l")).drop("l")
    links = found.links.withColumnRenamed("key", "k")
    return materialise(rows.join(links, F.col("key") == F.col("k"), "left").drop("k").withColumn(
        "n_links", F.coalesce("n_links", F.lit(0).cast("long"))), "text-classes")


def similar_classes(docs: DataFrame, rules: JoinRules = JoinRules(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: class_id (smallest id of all texts connected by
    links), n_links (other texts with similarity reached), copy_id (smallest id
    with the same text) and n_copies."""
    found = join(docs, rules, id_col, text_col)
    info = node_classes(found).withColumnRenamed("key", "k")
    return found.texts.select("id", "key").join(bounded(info, 96), F.col("key") == F.col("k")).select(
        F.col("id").alias("doc_id"), "class_id", "n_links", "copy_id", "n_copies")


def one_per_class(docs: DataFrame, rules: JoinRules = JoinRules(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The document with the smallest id of each class, with its columns as they were."""
    names = docs.columns
    id_at, text_at = f"c{names.index(id_col)}", f"c{names.index(text_col)}"
    docs = docs.toDF(*(f"c{k}" for k in range(len(names))))  # so that no column clashes with one of ours
    found = join(docs, rules, id_at, text_at)
    classes = node_classes(found)
    # of texts that share the smallest id, the smallest key stays
    stay = classes.filter(F.col("copy_id").eqNullSafe(F.col("class_id"))).groupBy("label").agg(F.min("key").alias("_k"), F.min("copy_id").alias("_id"))
    same = found.texts.groupBy(F.col("key").alias("k"), F.col("id").alias("i")).agg(F.count("*").alias("_n"))
    stay = materialise(stay.join(same, (F.col("_k") == F.col("k")) & F.col("_id").eqNullSafe(F.col("i"))).select("_k", "_id", "_n"), "kept")
    key = F.unhex(F.md5(F.coalesce(F.col(text_at), F.lit(""))))
    on = (key == F.col("_k")) & F.col(id_at).eqNullSafe(F.col("_id"))
    rows = docs.join(bounded(stay, 64), on).drop("_id")
    repeated = rows.filter("_n > 1").dropDuplicates(["_k"])  # a row that is there several times
    return rows.filter("_n = 1").unionByName(repeated).drop("_k", "_n").toDF(*names)
