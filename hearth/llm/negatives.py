"""Hard-negative mining over a GNAT-style multiway hyperplane tree.

Scores are integer inner products of quantised vectors.  With one more
coordinate that brings every row to the same length (queries have 0 there),
a score is a distance and a window of scores is an annulus around the query.

1. Classes.  Rows with equal vector and label stand together with their
   smallest ids; more than ``positives + 1`` can't be among anybody's first.
   So a vector that a third of all rows share is one row of the index, and
   one query.
2. Tree.  Split points are fitted on a bounded sample (``sample`` classes of
   the smallest hashes).  Every class of the corpus descends to the child of
   the nearest split point; for each split point and each sibling subtree the
   least and greatest distance over *all* classes is kept.
3. Search.  A query's annulus, met with those ranges, eliminates siblings; the
   leaves that remain are scanned exactly, so the result is exact whatever the
   sample.  Leaves stand together on shelves, each of which a query visits once
   with the list of its leaves that remain: in near-random vectors nearly all
   of them do, and a copy of the query for each would outgrow any memory.  Each
   search runs twice: in the query's home leaf, for a first bound on its k-th
   best, then in every leaf that may hold a better row.
4. Positives first, as the k best of the same label; their scores are the
   windows for the negatives.

The driver holds the split points, ranges and leaf sizes, all bounded by the
sample.  A task routes a bounded number of (query, leaf) at a time, and holds
one shelf and a part of its queries; it scores a few hundred of them at once.

Defined results: rows with a null label, a null vector, a null or non-finite
component, or one of 2**20 or more (its scores would leave the range of a
long) take no part; shorter vectors are filled up with zeros; ids are
integers, null ids are no anchors and come last among ties; repeated rows are
rows of their own, and an anchor leaves out itself only; an empty table gives
an empty result; other columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hearth.llm._store import SMALL_GROUPS, bounded, materialise

_FAR = 1 << 62
#: Distances are compared with this room for rounding, times the lengths of the vectors.
_ROOM = 1e-6
#: (query, leaf) that a task routes at once, visits that it hands on at once, queries that it scores at once.
_ROUTED, _HANDED, _SCORED = 1 << 20, 4096, 256


@dataclass(frozen=True)
class MiningRules:
    positives: int = 5
    negatives: int = 5
    #: A negative's score lies between ``low`` and ``high`` percent of the positive's.
    low: int = 80
    high: int = 100
    scale: int = 256
    #: Classes that the split points are fitted on, and children of a split.
    sample: int = 4096
    fanout: int = 16
    #: Classes that a leaf should hold, at least ``sample`` leaves permitting.
    leaf_rows: int = 1024
    #: Classes and queries of a block, and blocks of either that one task holds.
    block_rows: int = 4096
    block_queries: int = 4096
    held_blocks: int = 4


# ---- tree ----------------------------------------------------------------

class Tree:
    """Nodes of ``fanout`` split points; children are nodes, or leaves as ``-1 - leaf``."""

    def __init__(self, points: np.ndarray, top: float, leaf_points: int, fanout: int) -> None:
        self.top = top
        self.splits: list[np.ndarray] = []
        self.children: list[list[int]] = []
        self.leaves = 0
        self.low: list[np.ndarray] = []
        self.high: list[np.ndarray] = []
        self.root = self._grow(raised(points, top), leaf_points, fanout)

    def _grow(self, x: np.ndarray, leaf_points: int, fanout: int) -> int:
        if len(x) <= max(leaf_points, 1) or (x == x[0]).all():
            self.leaves += 1
            return -self.leaves
        # split points far from each other, greedily from the first
        chosen, gap = [0], distances(x, x[:1])[:, 0]
        while len(chosen) < min(fanout, len(x)) and gap.max() > 0:
            chosen.append(int(np.argmax(gap)))
            gap = np.minimum(gap, distances(x, x[chosen[-1:]])[:, 0])
        own = x[chosen]
        of = np.argmin(distances(x, own), axis=1)
        node = len(self.splits)
        self.splits.append(own)
        self.children.append([])
        self.low.append(np.full((len(own), len(own)), np.inf))
        self.high.append(np.full((len(own), len(own)), -np.inf))
        kids = [self._grow(x[of == j], leaf_points, fanout) for j in range(len(own))]
        self.children[node] = kids
        return node

    def homes(self, x: np.ndarray, note: bool = False) -> np.ndarray:
        """The leaf of each row; ``note`` widens the ranges by the rows."""
        leaf = np.zeros(len(x), np.int64)
        todo = [(self.root, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            if node < 0:
                leaf[rows] = -1 - node
                continue
            d = distances(x[rows], self.splits[node])
            of = np.argmin(d, axis=1)
            for j, kid in enumerate(self.children[node]):
                mine = of == j
                if mine.any():
                    if note:
                        self.low[node][:, j] = np.minimum(self.low[node][:, j], d[mine].min(axis=0))
                        self.high[node][:, j] = np.maximum(self.high[node][:, j], d[mine].max(axis=0))
                    todo.append((kid, rows[mine]))
        return leaf

    def reached(self, q: np.ndarray, near: np.ndarray, far: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, leaf) for all leaves that may hold a row between ``near`` and ``far`` of the query."""
        out = []
        room = _ROOM * (1 + np.sqrt(self.top) + np.sqrt((q * q).sum(axis=1).max(initial=0)))
        todo = [(self.root, np.arange(len(q)))]
        while todo:
            node, rows = todo.pop()
            if node < 0:
                out.append((rows, np.full(len(rows), -1 - node)))
                continue
            d = distances(q[rows], self.splits[node])[:, :, None]
            most = d + far[rows, None, None] + room
            least = np.maximum(near[rows, None, None] - d, d - far[rows, None, None]) - room
            alive = ((self.low[node] <= most) & (self.high[node] >= least)).all(axis=1)
            for j, kid in enumerate(self.children[node]):
                if alive[:, j].any():
                    todo.append((kid, rows[alive[:, j]]))
        if not out:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate([r for r, _ in out]), np.concatenate([x for _, x in out])


def raised(x: np.ndarray, top: float) -> np.ndarray:
    """Rows with the coordinate that brings their squared length to ``top``."""
    x = x.astype(np.float64)
    return np.hstack([x, np.sqrt(np.maximum(top - (x * x).sum(axis=1), 0))[:, None]])


def level(q: np.ndarray) -> np.ndarray:
    return np.hstack([q.astype(np.float64), np.zeros((len(q), 1))])


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    d = (x * x).sum(axis=1)[:, None] + (y * y).sum(axis=1) - 2 * (x @ y.T)
    return np.sqrt(np.maximum(d, 0))


def _distance_of(norms: np.ndarray, top: float, score: np.ndarray) -> np.ndarray:
    """The distance at which a row of that score lies from a query."""
    return np.sqrt(np.maximum(norms + top - 2.0 * score.astype(np.float64), 0))


def _matrix(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    flat = pa.concat_arrays([c.flatten() for c in column.chunks]) if isinstance(column, pa.ChunkedArray) else column.flatten()
    return flat.to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), width)


def scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact inner products: in floating point where every partial sum fits, else in integers."""
    most = q.shape[1] * float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0))
    if most < 2.0 ** 24:
        return (q.astype(np.float32) @ x.T.astype(np.float32)).astype(np.int64)
    if most < 2.0 ** 52:
        return (q.astype(np.float64) @ x.T.astype(np.float64)).astype(np.int64)
    return q.astype(np.int64) @ x.T.astype(np.int64)


def _packed(x: np.ndarray) -> pa.Array:
    """A binary value per row: its components, which are below 2**31, as 32-bit integers."""
    ends = np.arange(len(x) + 1, dtype=np.int32) * (4 * x.shape[1])
    return pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(x, np.int32))])


def _unpacked(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """The rows of all values, one after the other."""
    return np.frombuffer(b"".join(column.to_pylist()), np.int32).reshape(-1, width)


# ---- index ---------------------------------------------------------------

def quantised(rows: DataFrame, rules: MiningRules, id_col: str, vec_col: str, label_col: str) -> DataFrame:
    """id, label, q: the rows that take part."""
    v = F.col(f"`{vec_col}`").cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & (F.abs(x) < 2.0 ** 20))  # NaN is greater than any number
    out = rows.filter(F.col(f"`{label_col}`").isNotNull() & F.col(f"`{vec_col}`").isNotNull() & fine)
    return out.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{label_col}`").cast("long").alias("label"),
                      F.transform(v, lambda x: F.floor(x * rules.scale).cast("long")).alias("q"))


class Index:
    """Blocks of the leaves in the shared folder, and the tree over them."""

    def __init__(self, classes: DataFrame, width: int, rules: MiningRules) -> None:
        self.rules, self.width = rules, width
        seen = classes.agg(F.count("*").alias("n"), F.max("norm").alias("top")).first()
        n, self.top = seen["n"], float(seen["top"] or 0)
        sample = classes.orderBy("key").limit(rules.sample).select("q").toArrow()
        share = min(1.0, rules.sample / max(n, 1))
        points = _matrix(sample["q"], width) if len(sample) else np.zeros((1, width), np.int64)
        tree = Tree(points, self.top, int(rules.leaf_rows * share), rules.fanout)
        spark = classes.sparkSession
        sent = spark.sparkContext.broadcast(tree)  # bounded by the sample

        def descend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = sent.value
            for k in range(len(own.splits)):
                own.low[k][:], own.high[k][:] = np.inf, -np.inf
            names = ["leaf", "node", "child", "low", "high", "key", "label", "q", "ids"]
            for batch in batches:
                if not batch.num_rows:
                    continue
                x = raised(_matrix(batch.column("q"), width), own.top)
                rows, none = batch.num_rows, pa.nulls(batch.num_rows, pa.int32())
                far = pa.nulls(rows, pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([pa.array(own.homes(x, True)), none, none, far, far, *(batch.column(c) for c in names[5:])], names=names)
            edges = [(k, j) for k, s in enumerate(own.splits) for j in range(len(s)) if np.isfinite(own.low[k][0, j])]
            if edges:
                yield pa.RecordBatch.from_arrays(
                    [pa.nulls(len(edges), pa.int64()), pa.array([k for k, _ in edges], pa.int32()), pa.array([j for _, j in edges], pa.int32()),
                     pa.array([own.low[k][:, j] for k, j in edges], pa.list_(pa.float64())), pa.array([own.high[k][:, j] for k, j in edges], pa.list_(pa.float64())),
                     *(pa.nulls(len(edges), t) for t in (pa.string(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())))], names=names)

        placed = materialise(classes.select("key", "label", "q", "ids").mapInArrow(
            descend, "leaf bigint, node int, child int, low array<double>, high array<double>, key string, label bigint, q array<bigint>, ids array<bigint>"), "placed")
        ranges = placed.filter("leaf IS NULL").select("node", "child", F.posexplode(F.arrays_zip("low", "high")).alias("i", "r"))
        for r in ranges.groupBy("node", "child", "i").agg(F.min("r.low").alias("low"), F.max("r.high").alias("high")).collect():  # bounded by the tree
            tree.low[r["node"]][r["i"], r["child"]], tree.high[r["node"]][r["i"], r["child"]] = r["low"], r["high"]
        self.tree = spark.sparkContext.broadcast(tree)
        rows = placed.filter("leaf IS NOT NULL")
        most = rules.block_rows * rules.held_blocks
        sizes = {r["leaf"]: r["n"] for r in rows.groupBy("leaf").agg(F.count("*").alias("n")).collect()}  # bounded by the tree
        self.shelves = _shelves([sizes.get(leaf, 0) for leaf in range(tree.leaves)], most)
        of = [(leaf, int(first), int(n)) for leaf, (first, n) in enumerate(zip(*self.shelves, strict=True)) if n]
        of_leaf = spark.createDataFrame(of, "leaf bigint, first bigint, n bigint")
        shelf = F.col("first") + F.pmod(F.xxhash64("key"), F.col("n"))
        rows = rows.join(F.broadcast(of_leaf), "leaf").withColumn("shelf", shelf)

        def pack(table: pa.Table) -> pa.Table:
            x = _matrix(table["q"], width)
            one = pa.array([0, table.num_rows], pa.int32())
            return pa.table([table["shelf"][:1], table["leaf"][:1], pa.array([x.astype(np.int32).tobytes()], pa.binary()),
                             *(pa.ListArray.from_arrays(one, table[c].combine_chunks()) for c in ("label", "ids"))],
                            names=["shelf", "leaf", "x", "labels", "ids"])

        self.packed = materialise(rows.select("shelf", "leaf", "q", "label", "ids").groupBy("shelf", "leaf").applyInArrow(
            pack, "shelf bigint, leaf bigint, x binary, labels array<bigint>, ids array<array<bigint>>"), "leaves", SMALL_GROUPS)

    def routed(self, queries: DataFrame, home: bool) -> DataFrame:
        """shelf and its leaves beside the query: those of its home, or of every leaf that meets its windows."""
        sent, width, shelves = self.tree, self.width, self.shelves
        names = ["key", "label", "lows", "highs"]

        def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tree = sent.value
            step = max(1, _ROUTED // max(1, int(shelves[1].sum())))
            for batch in (b.slice(k, step) for b in batches for k in range(0, b.num_rows, step)):
                q = _matrix(batch.column("q"), width)
                x = level(q)
                if home:
                    of, leaf = np.arange(len(q)), tree.homes(x)
                else:
                    norms = (x * x).sum(axis=1)
                    low = np.array([min(v) for v in batch.column("lows").to_pylist()], np.int64)
                    high = np.array([max(v) for v in batch.column("highs").to_pylist()], np.int64)
                    of, leaf = tree.reached(x, _distance_of(norms, tree.top, high), _distance_of(norms, tree.top, low))
                of, leaf, shelf = _visited(of, leaf, shelves)
                heads = np.flatnonzero(np.append(True, (of[1:] != of[:-1]) | (shelf[1:] != shelf[:-1]))[: len(of)])
                ends = np.append(heads, len(of))
                packed = _packed(q)
                for k in range(0, len(heads), _HANDED):
                    mine, upto = heads[k: k + _HANDED], ends[k: k + _HANDED + 1]
                    at = pa.array(of[mine])
                    leaves = pa.ListArray.from_arrays(pa.array(upto - upto[0], pa.int32()), pa.array(leaf[upto[0]: upto[-1]], pa.int32()))
                    out = batch.take(at)
                    yield pa.RecordBatch.from_arrays([pa.array(shelf[mine], pa.int64()), leaves, packed.take(at), *(out.column(c) for c in names)], names=["shelf", "leaves", "q", *names])

        return queries.select(*names, "q").mapInArrow(
            route, "shelf bigint, leaves array<int>, q binary, key string, label bigint, lows array<bigint>, highs array<bigint>")

    def search(self, queries: DataFrame, same_label: bool, k: int, home: bool) -> DataFrame:
        """key, w (number of the window), found: the first k rows of each window, as (score, id)."""
        width = self.width
        visits = materialise(self.routed(queries, home), "visits")
        most = self.rules.block_queries * self.rules.held_blocks
        asked = materialise(visits.groupBy("shelf").agg(F.ceil(F.count("*") / most).cast("long").alias("parts")), "asked")
        asked = bounded(asked, 16)
        left = visits.join(asked, "shelf").withColumn("part", F.pmod(F.xxhash64("key"), F.col("parts"))).drop("parts")
        upto = F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))
        right = self.packed.join(asked, "shelf").select("shelf", upto.alias("part"), "leaf", "x", "labels", "ids")

        def scan(asking: pa.Table, shelf: pa.Table) -> pa.Table:
            out: list[tuple[str, int, list[tuple[int, int | None]]]] = []
            if asking.num_rows and shelf.num_rows:
                held = {leaf: k for k, leaf in enumerate(shelf["leaf"].to_pylist())}
                x, sizes = _unpacked(shelf["x"], width), [len(v) for v in shelf["labels"].to_pylist()]
                starts = np.append(0, np.cumsum(sizes))
                labels = shelf["labels"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
                ids = shelf["ids"].combine_chunks().flatten()
                q, met = _unpacked(asking["q"], width), [[held[leaf] for leaf in leaves if leaf in held] for leaves in asking["leaves"].to_pylist()]
                asks = list(zip(*(asking[c].to_pylist() for c in ("key", "label", "lows", "highs")), strict=True))
                order = sorted(range(len(asks)), key=met.__getitem__)  # those of the same leaves together
                for some in (order[n: n + _SCORED] for n in range(0, len(order), _SCORED)):
                    leaves = sorted({leaf for n in some for leaf in met[n]})
                    rows = np.concatenate([np.arange(starts[leaf], starts[leaf + 1]) for leaf in leaves] or [np.zeros(0, np.int64)])
                    found, of_rows = scores(q[some], x[rows]), labels[rows]
                    for s, (key, label, lows, highs) in zip(found, (asks[n] for n in some), strict=True):
                        mine = np.flatnonzero(((of_rows == label) == same_label) & (s >= min(lows)) & (s <= max(highs)))
                        s = s[mine]
                        for w, (low, high) in enumerate(zip(lows, highs, strict=True)):
                            at = np.flatnonzero((s >= low) & (s <= high))
                            if len(at) > k:  # with all ties of the k-th
                                at = at[s[at] >= np.partition(s[at], len(at) - k)[len(at) - k]]
                            best = sorted(((int(s[a]), i) for a in at for i in ids[int(rows[mine[a]])].as_py()), key=_place)[:k]
                            if best:
                                out.append((key, w, best))
            pairs = pa.list_(pa.struct([("score", pa.int64()), ("id", pa.int64())]))
            return pa.table([pa.array([o[0] for o in out], pa.string()), pa.array([o[1] for o in out], pa.int32()),
                             pa.array([[{"score": s, "id": i} for s, i in o[2]] for o in out], pairs)], names=["key", "w", "found"])

        hits = (left.groupBy("shelf", "part").cogroup(right.groupBy("shelf", "part"))
                .applyInArrow(scan, "key string, w int, found array<struct<score:bigint,id:bigint>>"))
        rows = hits.select("key", "w", F.explode("found").alias("f"))
        order = Window.partitionBy("key", "w").orderBy(F.col("f.score").desc(), F.col("f.id").asc_nulls_last())
        first = rows.withColumn("at", F.row_number().over(order)).filter(F.col("at") <= k)
        found = first.groupBy("key", "w").agg(F.sort_array(F.collect_list(F.struct("at", "f"))).alias("l"))
        return materialise(found.select("key", "w", F.transform("l", lambda x: x["f"]).alias("found")), "found")


def _place(f: tuple[int, int | None]) -> tuple[int, bool, int]:
    return -f[0], f[1] is None, f[1] or 0


def _shelves(sizes: list[int], most: int) -> tuple[np.ndarray, np.ndarray]:
    """Each leaf's first shelf, and how many it is dealt over: neighbours share
    one of at most ``most`` rows, a leaf of more has shelves of its own."""
    first, count = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    shelf = held = 0
    for leaf, n in enumerate(sizes):
        if held and held + n > most:
            shelf, held = shelf + 1, 0
        first[leaf], count[leaf] = shelf, -(-n // most)
        held += n
        if n > most:
            shelf, held = shelf + int(count[leaf]), 0
    return first, count


def _visited(of: np.ndarray, leaf: np.ndarray, shelves: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, leaf, shelf) for every shelf of the leaves, by query and shelf."""
    first, count = (x[leaf] for x in shelves)
    of, leaf = np.repeat(of, count), np.repeat(leaf, count)
    shelf = np.repeat(first - (np.cumsum(count) - count), count) + np.arange(len(of))
    order = np.lexsort((leaf, shelf, of))
    return of[order], leaf[order], shelf[order]


# ---- mining --------------------------------------------------------------

def classes_of(rows: DataFrame, keep: int) -> DataFrame:
    """key, label, q, norm, ids: equal rows together, with their ``keep`` smallest ids."""
    key = F.md5(F.concat_ws("|", F.col("label"), F.array_join("q", ",")))
    keyed = rows.withColumn("key", key)
    first = Window.partitionBy("key").orderBy(F.col("id").asc_nulls_last())
    some = keyed.withColumn("at", F.row_number().over(first)).filter(F.col("at") <= keep)
    out = some.groupBy("key").agg(F.first("label").alias("label"), F.first("q").alias("q"),
                                  F.sort_array(F.collect_list(F.struct("at", "id"))).alias("l"))
    norm = F.aggregate("q", F.lit(0).cast("long"), lambda s, x: s + x * x)
    return out.select("key", "label", "q", norm.alias("norm"), F.transform("l", lambda x: x["id"]).alias("ids"))


def mine(rows: DataFrame, is_anchor: Column, rules: MiningRules = MiningRules(), id_col: str = "vec_id",
         vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """One row per anchor, positive and hard negative: anchor_id, positive_id,
    rank, negative_id, positive_score, negative_score.

    ``is_anchor`` is a condition on the column ``id`` (a long).
    """
    wide = quantised(rows, rules, id_col, vec_col, label_col)
    width = wide.agg(F.max(F.size("q"))).first()[0] or 0
    zeros = F.array_repeat(F.lit(0).cast("long"), F.lit(width) - F.size("q"))
    full = materialise(wide.withColumn("q", F.concat("q", zeros)), "quantised")
    classes = materialise(classes_of(full, rules.positives + 1), "classes")
    key = F.md5(F.concat_ws("|", F.col("label"), F.array_join("q", ",")))
    anchors = materialise(full.filter(F.col("id").isNotNull() & is_anchor).select("id", key.alias("key")), "anchors")
    index = Index(classes, width, rules)
    queries = materialise(classes.join(anchors.select("key").distinct(), "key", "left_semi").select("key", "label", "q", "norm"), "queries")

    def windows(lows: Column, highs: Column, of: DataFrame) -> DataFrame:
        return of.select("key", "label", "q", lows.alias("lows"), highs.alias("highs"))

    # positives: k best of the same label; the home leaf's k-th best bounds the search
    k = rules.positives + 1
    one = F.array(F.lit(_FAR))
    home = index.search(windows(F.array(F.lit(-_FAR)), one, queries), True, k, True)
    bound = F.when(F.size("found") >= k, F.element_at("found", k)["score"]).otherwise(F.lit(-_FAR))
    bounded = queries.join(home, "key", "left").select("key", "label", "q", F.coalesce(bound, F.lit(-_FAR)).alias("low"))
    best = index.search(windows(F.array("low"), one, bounded), True, k, False).select("key", F.col("found").alias("best"))

    # negatives: a window below each positive score
    tops = F.sort_array(F.array_distinct(F.transform("best", lambda f: f["score"])))
    tops = F.filter(tops, lambda s: rules.low * s <= rules.high * s)
    highs = F.expr(f"transform(tops, s -> ({rules.high} * s - pmod({rules.high} * s, 100)) div 100)")  # rounded down
    lows = F.expr(f"transform(tops, s -> ({rules.low} * s + pmod(-{rules.low} * s, 100)) div 100)")  # rounded up
    asked = queries.join(best, "key").select("key", "label", "q", tops.alias("tops")).filter(F.size("tops") > 0)
    asked = materialise(asked.select("key", "label", "q", "tops", lows.alias("lows"), highs.alias("highs")), "asked")
    near = index.search(asked, False, rules.negatives, True)
    seen = near.groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("w", "found"))).alias("seen"))
    kth = F.transform("lows", lambda low, w: F.coalesce(
        F.when(F.size(F.try_element_at("seen", w)) >= rules.negatives, F.try_element_at("seen", w)[rules.negatives - 1]["score"]), low))
    closer = asked.join(seen, "key", "left").select("key", "label", "q", kth.alias("lows"), "highs")
    hard = index.search(closer, False, rules.negatives, False)
    hard = hard.join(asked.select(F.col("key").alias("k"), "tops"), F.col("key") == F.col("k")).select(
        "key", F.element_at("tops", F.col("w") + 1).alias("top"), F.col("found").alias("hard"))

    # back to the anchors: each leaves itself out of its class's list
    lists = best.join(queries.select("key", "norm"), "key").select(F.col("key").alias("k"), "norm", "best")
    own = F.array_position("best", F.struct(F.col("norm").alias("score"), F.col("id").alias("id")))
    others = F.filter("best", lambda f, i: (own == 0) | (i + 1 != own))
    pairs = anchors.join(lists, F.col("key") == F.col("k")).select(
        F.col("id").alias("anchor_id"), "key", F.explode(F.slice(others, 1, rules.positives)).alias("p"))
    hard = hard.select(F.col("key").alias("k"), "top", "hard")
    out = pairs.join(hard, (F.col("key") == F.col("k")) & (F.col("p.score") == F.col("top")))
    return out.select("anchor_id", F.col("p.id").alias("positive_id"), F.posexplode("hard").alias("rank", "n"), F.col("p.score").alias("positive_score")).select(
        "anchor_id", "positive_id", (F.col("rank") + 1).alias("rank"), F.col("n.id").alias("negative_id"), "positive_score", F.col("n.score").alias("negative_score"))
