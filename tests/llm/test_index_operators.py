"""Substring dedup, token alignment and hard negatives against plain Python."""

import collections
import hashlib
import math
import random
import re

import numpy as np
import pyarrow.parquet as pq
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from hearth.llm import align, fmindex, negatives, queries

SF = "/root/testdata/sf0.001"


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


# ---- FM-index ------------------------------------------------------------

def brute_windows(rows):
    """[(id, n_words, n_removed, kept)] by comparing the words of all windows."""
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    least = {}
    for (d, _), w in zip(rows, words, strict=True):
        for i in range(len(w) - fmindex.WINDOW + 1):
            key = tuple(w[i: i + fmindex.WINDOW])
            least[key] = min(least.get(key, math.inf), math.inf if d is None else d)
    out = []
    for (d, _), w in zip(rows, words, strict=True):
        gone = set()
        for i in range(len(w) - fmindex.WINDOW + 1):
            if d is not None and least[tuple(w[i: i + fmindex.WINDOW])] < d:
                gone.update(range(i, i + fmindex.WINDOW))
        out.append((d, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return sorted(out, key=str)


def windows_fixture():
    rng = random.Random(11)
    word = lambda: rng.choice("abcdefghij") * rng.randrange(1, 4) + rng.choice(["", "é", "日", "7"])
    text = lambda n: [word() for _ in range(n)]
    passage, other, long = text(70), text(50), text(3000)
    rows = []
    for d in range(60):
        parts = [text(rng.randrange(0, 120)), passage if d % 3 == 0 else [], text(rng.randrange(0, 40)),
                 other[: 49 + d % 2] if d % 5 == 0 else [], ["spam"] * (rng.randrange(0, 160) if d % 7 == 0 else 0)]
        rng.shuffle(parts)
        rows.append((d, rng.choice([" ", "  ", "\n", "\t \r\n"]).join(x for p in parts for x in p)))
    rows += [(100 + k, " ".join(long[k * 40:])) for k in range(3)] + [(90, " ".join(passage))] * 3
    rows += [(None, " ".join(passage)), (91, None), (92, ""), (93, " \n "), (0, " ".join(passage)), (-5, "x " + " ".join(passage[:50])), (94, " ".join(other) + " ")]
    return rows


def removed(spark, rows, rules):
    frame = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("chunk", F.lit(1)).withColumn("shared", F.lit("x")).repartition(5)
    return sorted((tuple(r) for r in fmindex.dedup(frame, rules).select("doc_id", "n_words", "n_removed", "kept").collect()), key=str)


@pytest.mark.parametrize("rules", [fmindex.FmRules(), fmindex.FmRules(chunk_bytes=2000, shard_words=500, hot_docs=2)])
def test_substrings_like_brute_force(spark, rules):
    rows = windows_fixture()
    got = removed(spark, rows, rules)
    assert got == brute_windows(rows)
    assert sum(r[2] for r in got) > 2000


def test_substrings_by_shuffled_joins(spark, monkeypatch):
    from hearth.llm import _store

    monkeypatch.setattr(_store, "BROADCAST_BYTES", -1)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = windows_fixture()[:30]
        assert removed(spark, rows, fmindex.FmRules(chunk_bytes=4000, shard_words=2000)) == brute_windows(rows)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_no_documents_no_substrings(spark):
    assert removed(spark, [], fmindex.FmRules()) == []
    assert removed(spark, [(1, None), (2, "a b c")], fmindex.FmRules()) == [(1, 0, 0, ""), (2, 3, 0, "a b c")]


def test_wavelet_counts_symbols():
    rng = np.random.default_rng(5)
    for top in (1, 2, 7, 300):
        x = rng.integers(0, top + 1, 1000)
        w = fmindex.Wavelet(x, top)
        at, symbol = rng.integers(0, 1001, 400), rng.integers(0, top + 1, 400)
        at, symbol = at[np.isin(symbol, x)], symbol[np.isin(symbol, x)]
        assert w.before(symbol, at).tolist() == [int((x[:p] == s).sum()) for p, s in zip(at, symbol, strict=True)]


def test_stream_finds_only_what_the_index_holds():
    """Documents that are not in the index: matches break off and start again."""
    rng = np.random.default_rng(6)
    held, owner = rng.integers(1, 5, 400), np.full(400, 3)
    held[399] = 0
    index = fmindex.FmIndex(held, owner)
    asked = np.concatenate([rng.integers(1, 5, 80), held[100:230], [9], held[20:75], rng.integers(1, 5, 90), held[300:399], held[:60], held[130:200]])
    found = index.stream(asked, np.array([0]), np.array([len(asked)]))
    have = {tuple(held[i: i + 50]) for i in range(350)}
    assert [int(f) == 3 for f in found[: len(asked) - 49]] == [tuple(asked[i: i + 50]) in have for i in range(len(asked) - 49)]


# ---- token alignment -----------------------------------------------------

def brute_alignment(rows):
    a_side = Tokenizer.from_file(align.AlignRules.a_path)
    a_side.encode_special_tokens = True
    b_side = sentencepiece.SentencePieceProcessor(model_file=align.AlignRules.b_path)
    alphabet = align.byte_alphabet()

    def a_bytes(i):
        return bytes(alphabet[c] for c in a_side.id_to_token(i))

    def b_bytes(i):
        p = b_side.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if b_side.is_byte(i) else p.replace("▁", " ").encode()

    docs, held = [], collections.Counter()
    for d, text in rows:
        a = [(i, a_bytes(i)) for i in a_side.encode(" " + text, add_special_tokens=False).ids] if text else []
        b = [(i, b_bytes(i)) for i in b_side.encode(text)] if text else []
        if not text or any(b"".join(x for _, x in side) != (" " + text).encode() for side in (a, b)):
            docs.append((d, [], [], []))
            continue
        ends = [np.cumsum([len(x) for _, x in side]).tolist() for side in (a, b)]
        groups, low = [], 0
        for cut in sorted(set(ends[0]) & set(ends[1])):
            groups.append(tuple([i for (i, _), e in zip(side, es, strict=True) if low < e <= cut] for side, es in zip((a, b), ends, strict=True)))
            low = cut
        links = [(x, y) for ga, gb in groups for x in ga for y in gb]
        held.update(set(links))
        docs.append((d, a, b, (groups, links)))
    best = collections.Counter()
    for (x, _), n in held.items():
        best[x] = max(best[x], n)
    out = []
    for d, a, b, found in docs:
        if not found:
            out.append((d, 0, 0, 0, 0, 0, 0, ""))
            continue
        groups, links = found
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out.append((d, len(a), len(b), len(groups), len(links), sum(held[p] == best[p[0]] for p in links), sum(held[p] for p in links), sha(text)))
    return sorted(out, key=str)


def aligned(spark, rows, rules=align.AlignRules()):
    frame = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("chunk", F.lit(1)).withColumn("pos", F.lit("x")).repartition(7)
    return sorted((tuple(r) for r in align.align(frame, rules).collect()), key=str)


def test_alignment_like_brute_force(spark):
    rng = random.Random(3)
    bits = [" ", "  ", "\n", "\t", " \n ", "a", "b", "word", "Ünïcode", "日本語", "かな", " ", " ", "　", "▁", "<s>", "</s>", "<unk>",
            "<|endoftext|>", "<0x41>", "'s", "'re", "12", "3.5", "!!", "😀", "\r\n", "É ", "x" * 30, "\x00", "\u0085", "   ", "."]
    rows = [(i, "".join(rng.choice(bits) for _ in range(rng.randrange(25)))) for i in range(800)]
    rows += [(5000, None), (5001, ""), (5002, " "), (5003, "  "), (None, "plain text here"), (5005, "plain text here"), (5005, "plain text here"),
             (5006, "a "), (5007, " a"), (5008, "ab" * 5000 + " x"), (5009, "\n"), (5010, "word " * 20000), (5011, "日" * 3000)]
    assert aligned(spark, rows, align.AlignRules(fan_in=2, frame=16)) == brute_alignment(rows)


def test_alignment_of_the_documents(spark):
    rows = [tuple(r.values()) for r in pq.read_table(f"{SF}/documents.parquet", columns=["doc_id", "text"]).to_pylist()]
    got = sorted((tuple(r) for r in queries.QUERIES["op12_token_alignment"](spark, SF).collect()), key=str)
    assert got == brute_alignment(rows)


def test_no_documents_no_alignment(spark):
    assert aligned(spark, []) == []


def test_runs_merge_in_frames():
    rng = np.random.default_rng(2)
    total, runs = collections.Counter(), []
    for _ in range(9):
        pairs = np.unique(rng.integers(0, 5000, rng.integers(0, 900)))
        counts = rng.integers(1, 9, len(pairs))
        total.update(dict(zip(pairs.tolist(), counts.tolist(), strict=True)))
        runs.append(align.frames(pairs, counts, 32))
    got = [(int(p), int(c)) for ps, cs in align.merged(runs) for p, c in zip(ps, cs, strict=True)]
    assert got == sorted(total.items())


# ---- hard negatives ------------------------------------------------------

def brute_negatives(rows):
    """rows: (id, vector or None, label or None)."""
    fine = []
    for i, v, label in rows:
        if label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        fine.append((i, [math.floor(256 * float(np.float32(x))) for x in v], label))
    out = []
    for k, (a, v, label) in enumerate(fine):
        if a is None or a % 100:
            continue
        scored = sorted(((-sum(x * y for x, y in zip(v, w, strict=False)), i is None, i or 0, i, m == label) for j, (i, w, m) in enumerate(fine) if j != k), key=lambda s: s[:3])
        for s in [s for s in scored if s[4]][:5]:
            hard = [n for n in scored if not n[4] and 80 * -s[0] <= 100 * -n[0] <= 100 * -s[0]][:5]
            out += [(a, s[3], r, n[3], -s[0], -n[0]) for r, n in enumerate(hard, 1)]
    return sorted(out, key=str)


def vectors_fixture(n=1500, width=6):
    rng = np.random.default_rng(13)
    centres = rng.normal(size=(8, width))
    rows = []
    for i in range(n):
        v = centres[i % 8] + rng.normal(size=width) * 0.2
        rows.append((i, [round(float(x), 3) for x in v], int(rng.integers(0, 4))))
    same = [0.5] * width
    rows += [(10_000 + i, same, i % 3) for i in range(400)]  # one vector in a fifth of all rows
    rows += [(20_000, None, 1), (20_100, [0.1] * width, None), (20_200, [float("nan")] * width, 1), (20_300, [None] * width, 1), (20_400, [float("inf")] * width, 1),
             (20_500, [0.25] * 3, 2), (20_600, [], 2), (300, rows[300][1], rows[300][2]), (300, rows[300][1], rows[300][2]), (400, rows[401][1], rows[400][2]), (None, rows[5][1], 0)]
    return rows


def mined(spark, rows, rules=negatives.MiningRules()):
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int").withColumn("key", F.lit(1)).withColumn("q", F.lit(2)).repartition(6)
    return sorted((tuple(r) for r in negatives.mine(frame, F.col("id") % 100 == 0, rules).collect()), key=str)


@pytest.mark.parametrize("rules", [negatives.MiningRules(), negatives.MiningRules(sample=200, fanout=4, leaf_rows=40, block_rows=25, block_queries=3)])
def test_negatives_like_brute_force(spark, rules):
    rows = vectors_fixture()
    want = brute_negatives(rows)
    assert mined(spark, rows, rules) == want and len(want) > 100


def test_no_vectors_no_negatives(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(0, [1.0], 1), (100, [1.0], 2)]) == []


def test_ranges_eliminate_leaves():
    """Far clusters: few leaves meet a small ball, and none that holds one of its rows is left out."""
    rng = np.random.default_rng(4)
    x = (rng.normal(size=(20, 8))[rng.integers(0, 20, 4000)] * 300 + rng.normal(size=(4000, 8)) * 10).astype(np.int64)
    top = float((x * x).sum(axis=1).max())
    tree = negatives.Tree(x[:1000], top, 20, 8)
    home = tree.homes(negatives.raised(x, top), note=True)
    q, far = negatives.level(x[:50]), np.full(50, 0.0)
    d = negatives.distances(q, negatives.raised(x, top))
    far = np.sort(d, axis=1)[:, 5]
    of, leaf = tree.reached(q, np.zeros(50), far)
    met = set(zip(of.tolist(), leaf.tolist(), strict=True))
    assert all((k, int(home[j])) in met for k in range(50) for j in np.flatnonzero(d[k] <= far[k]))
    assert len(met) < 0.5 * 50 * len(set(home.tolist()))


def test_large_components_stay_exact():
    q = np.array([[1 << 27, 3]]), np.array([[(1 << 27) - 1, 5], [2, 1]])
    assert negatives.scores(*q).tolist() == [[(1 << 27) * ((1 << 27) - 1) + 15, (1 << 28) + 3]]


def test_a_query_visits_a_shelf_of_leaves_once(spark):
    """Near-random vectors, whose ranges eliminate hardly a leaf: no copy of a query for each leaf."""
    rng = np.random.default_rng(6)
    rows = [(i, [round(float(x), 3) for x in v], i % 3) for i, v in enumerate(rng.normal(size=(900, 16)))]
    rules = negatives.MiningRules(sample=300, fanout=4, leaf_rows=10, block_rows=50, block_queries=8)
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int")
    classes = negatives.classes_of(negatives.quantised(frame, rules, "vec_id", "embedding", "label"), 6).cache()
    index = negatives.Index(classes, 16, rules)
    lows, highs = F.array(F.lit(-(1 << 62))).alias("lows"), F.array(F.lit(1 << 62)).alias("highs")
    asked = classes.filter(F.col("ids")[0] % 9 == 0).select("key", "label", "q", lows, highs)
    visits = index.routed(asked, False).select("key", "shelf", "leaves").toPandas()
    # every class stands on one shelf, and a shelf holds no more than a task may
    sizes = {}
    for r in index.packed.selectExpr("shelf", "leaf", "size(labels) AS n").collect():
        sizes[r.shelf] = sizes.get(r.shelf, 0) + r.n
    assert sum(sizes.values()) == 900 and max(sizes.values()) <= 200 and index.tree.value.leaves > 4 * len(sizes)
    # all windows are open, so each query meets every leaf: by one visit per shelf
    assert len(visits) == 100 * len(sizes) and not visits.duplicated(["key", "shelf"]).any()
    assert visits.groupby("key")["leaves"].apply(lambda v: sorted(x for leaves in v for x in leaves)).map(len).eq(index.packed.select("leaf").distinct().count()).all()


def test_leaves_share_shelves_or_have_several():
    first, count = negatives._shelves([3, 0, 4, 5, 25, 2, 9], 10)
    assert first.tolist() == [0, 0, 0, 1, 2, 5, 6] and count.tolist() == [1, 0, 1, 1, 3, 1, 1]
    of, leaf, shelf = negatives._visited(np.array([1, 0, 1, 0]), np.array([4, 2, 0, 1]), (first, count))
    assert list(zip(of.tolist(), leaf.tolist(), shelf.tolist(), strict=True)) == [(0, 2, 0), (1, 0, 0), (1, 4, 2), (1, 4, 3), (1, 4, 4)]


def test_negatives_in_small_portions(spark, monkeypatch):
    for name, value in (("_ROUTED", 40), ("_HANDED", 3), ("_SCORED", 2)):
        monkeypatch.setattr(negatives, name, value)
    rows = vectors_fixture(500)
    assert mined(spark, rows, negatives.MiningRules(sample=100, fanout=4, leaf_rows=20, block_rows=9, block_queries=2)) == brute_negatives(rows)
