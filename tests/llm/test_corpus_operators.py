"""Joins over the corpus, archives, conversations and the pipeline against plain Python."""

import collections
import hashlib
import io
import itertools
import os
import re

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import zstandard
from pyspark.sql import functions as F

import corpus_pipeline
from hearth.llm import _shingles, chat, decontam, jaccard, lines, packing, quality, suffix, warc

SF = "/root/testdata/sf0.001"
TOKEN = r"[A-Za-z0-9]+|[^A-Za-z0-9\x20\x09-\x0D]"
WORDS = [f"{a}{b}{c}" for a in "bdfgk" for b in "aeiou" for c in "lmnrst"]


def text_of(rng, n):
    return " ".join(rng.choice(WORDS, n))


def edited(rng, text, k):
    w = text.split()
    for at in rng.integers(0, len(w), k):
        w[at] = "changed" + str(rng.integers(1000))
    return " ".join(w)


def low_share(n, total, z):
    """Lower Wilson bound of n of total."""
    p = n / total
    return (p + z * z / 2 / total - z * ((p * (1 - p) + z * z / 4 / total) / total) ** 0.5) / (1 + z * z / total)


def words_of(x):
    return re.findall(r"[a-z0-9\x80-\U0010ffff]+", (x or "").lower())


# ---- Jaccard join --------------------------------------------------------

def shingles(x):
    w = words_of(x)
    return frozenset(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute_classes(rows):
    """{(id, text): (class_id, n_links, copy_id, n_copies)} by comparing all texts."""
    ids = collections.defaultdict(list)
    for d, t in rows:
        ids[t or ""].append(d)
    texts = list(ids)
    sets = [shingles(t) for t in texts]
    links, group = collections.Counter(), list(range(len(texts)))
    for a, b in itertools.combinations(range(len(texts)), 2):
        both = len(sets[a] & sets[b])
        if both and both >= 0.8 * (len(sets[a]) + len(sets[b]) - both) - 1e-9:
            links[a] += 1
            links[b] += 1
            x, y = sorted((group[a], group[b]))
            group = [x if g == y else g for g in group]
    out = {}
    for k, t in enumerate(texts):
        own = [d for d in ids[t] if d is not None]
        all_ = [d for j, u in enumerate(texts) if group[j] == group[k] for d in ids[u] if d is not None]
        for d in ids[t]:
            out[d, t] = (min(all_, default=None), links[k], min(own, default=None), len(ids[t]))
    return out


@pytest.fixture(scope="module")
def near_copies():
    rng = np.random.default_rng(11)
    rows = []
    for base in range(8):
        origin = text_of(rng, int(rng.integers(40, 200)))
        rows += [(len(rows) + k, edited(rng, origin, int(k * rng.integers(0, 3)))) for k in range(12)]
    hot = text_of(rng, 300)
    rows += [(1000 + k, edited(rng, hot, 3)) for k in range(60)]  # one large group
    rows += [(2000 + k, rows[3][1]) for k in range(20)]  # copies
    rows += [(3000, None), (3001, ""), (3002, "one two"), (3003, "One, two!"), (3004, "..."), (None, text_of(rng, 30)), (3005, rows[0][1])]
    rows += [(3005, rows[0][1]), (3006, text_of(rng, 20_000))]
    return rows


@pytest.mark.parametrize("block", [512, 7])
def test_jaccard_join_loses_no_link(spark, near_copies, block):
    docs = spark.createDataFrame([(*r, "k") for r in near_copies], "doc_id long, text string, key string")
    want = brute_classes(near_copies)
    rules = jaccard.JoinRules(block=block)
    got = collections.Counter((r.doc_id, r.class_id, r.n_links, r.copy_id, r.n_copies) for r in jaccard.similar_classes(docs, rules).collect())
    assert got == collections.Counter((d, *want[d, t or ""]) for d, t in near_copies)
    assert sum(w[1] for w in want.values()) > 1500
    if block == 512:
        kept = jaccard.one_per_class(docs, rules)
        assert kept.columns == docs.columns
        assert sorted(kept.select("doc_id").collect(), key=str) == sorted(((c,) for c in {want[k][0] for k in want}), key=str)
        assert jaccard.similar_classes(docs.limit(0)).count() == 0 and jaccard.one_per_class(docs.limit(0)).count() == 0


def test_pruning_keeps_pairs_at_the_threshold():
    least = jaccard.least_matches(jaccard.JoinRules())
    rng = np.random.default_rng(0)
    drawn = np.cumsum(rng.random((20_000, jaccard.HASHES)) < 0.8 + 0.2 / 256, axis=1)
    assert all((drawn[:, n - 1] >= m).all() for n, m in least.items())
    assert least[jaccard.HASHES] > jaccard.HASHES // 2  # and drops dissimilar ones


# ---- decontamination -----------------------------------------------------

def weighted(words, counts):
    return sum((1 + np.log(sum(len(w.encode()) for w in g))) * c for g, c in counts.items())


def brute_leaks(docs, items, least=0.8):
    out = {}
    for (d, t), (i, q) in itertools.product(docs, items):
        w, v = words_of(t), words_of(q)
        if 0 < len(v) < 5:  # one shingle of its own length
            at = [s for s in range(len(w) - len(v) + 1) if w[s:s + len(v)] == v]
            if at:
                out[d, i] = (1.0, at[0], len(v))
        if len(v) < 5 or len(w) < 5:
            continue
        size = min(len(v), len(w))
        target = collections.Counter(tuple(v[k:k + 5]) for k in range(len(v) - 4))
        for s in range(len(w) - size + 1):
            own = collections.Counter(tuple(w[s + k:s + k + 5]) for k in range(size - 4))
            both = weighted(w, own & target)
            sim = both / (weighted(w, own) + weighted(v, target) - both)
            if sim >= least and sim > out.get((d, i), (0,))[0] + 1e-12:
                out[d, i] = (sim, s, size)
    return out


def test_leaks_equal_brute_force(spark):
    rng = np.random.default_rng(2)
    items_of_four = text_of(rng, 4)
    items = [(k, text_of(rng, int(rng.integers(12, 40)))) for k in range(12)] + [(50, "too short here"), (51, None), (52, ""), (53, "ba ba ba ba ba ba ba ba"),
                                                                                   (55, "Yes!"), (56, "zu zu"), (57, items_of_four)]
    items.append((54, items[0][1]))
    docs = [(k, text_of(rng, 80)) for k in range(20)]
    for k, (_, q) in enumerate(items[:12]):
        docs.append((100 + k, f"{text_of(rng, 30)}. {q.upper()}! {text_of(rng, 10)}"))
        docs.append((200 + k, f"{text_of(rng, 7)} {edited(rng, q, 1)} {text_of(rng, 9)}"))
        docs.append((300 + k, " ".join(q.split()[:-2])))
    docs += [(500, f"{text_of(rng, 9)} yes {items_of_four}, yes"), (501, items_of_four), (502, "zu zu zu"), (503, "zu"), (504, "yes")]
    docs += [(400, None), (401, ""), (402, items[1][1] + " " + items[1][1]), (402, items[1][1]), (403, "ba " * 400), (404, text_of(rng, 30_000) + " " + items[2][1])]
    frame = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, item_id int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = brute_leaks([d for d in docs if d[0] not in (402, 404)], items)
    for rules in (decontam.LeakRules(), decontam.LeakRules(block_bytes=300)):
        rows = decontam.leaks(frame, bench, rules).collect()
        got = {(r.doc_id, r.item_id): (r.similarity, r.first_word, r.n_words) for r in rows if r.doc_id not in (402, 404)}
        assert got.keys() == want.keys()
        assert all(abs(got[k][0] - want[k][0]) < 1e-9 and got[k][1:] == want[k][1:] for k in want)
        assert sorted(r.item_id for r in rows if r.doc_id == 402) == [1, 1] and [r.item_id for r in rows if r.doc_id == 404] == [2]
    clean = decontam.drop_leaks(frame, bench, decontam.LeakRules(block_bytes=300))
    dirty = {d for d, _ in want} | {402, 404}
    assert clean.columns == frame.columns and sorted(r.doc_id for r in clean.collect()) == sorted(d for d, _ in docs if d not in dirty)
    assert decontam.leaks(frame.limit(0), bench).count() == 0 and decontam.leaks(frame, bench.limit(0)).count() == 0


def test_repeated_shingles_are_within_the_radius():
    """One shingle many times on either side: similar enough, so the fingerprints must be near."""
    rng = np.random.default_rng(6)
    for _ in range(40):
        both = list(rng.choice(WORDS, 170))
        a, b = both + ["foo"] * 16, both + ["bar"] * 16
        index = decontam.ItemIndex([1], [" ".join(a)])
        sim = brute_leaks([(0, " ".join(b))], [(1, " ".join(a))])[0, 1][0]
        assert sim >= 0.8
        batch = pa.RecordBatch.from_arrays([pa.array([" ".join(["lead"] * 3 + b + ["tail"] * 9)])], names=["t"])
        found = decontam.leaks_in(next(_shingles.words(iter([batch]), "t")), index, 0.8)
        assert [x[0] for x in found[0]] == [0] and found[0][0][1] >= sim - 1e-9


def test_window_sums_count_occurrences():
    rng = np.random.default_rng(7)
    h, w = rng.integers(0, 6, 60).astype(np.uint64), rng.random(60)
    w = w[h.astype(int)]  # equal shingles weigh the same
    for size in (1, 4, 17, 60):
        got = decontam.window_sums(h, w, size)
        for s in range(60 - size + 1):
            x = h[s: s + size]
            want = (decontam._bits(decontam._features(x, decontam._occurrences(x))) * w[s: s + size, None]).sum(axis=0)
            assert np.allclose(got[s], want)


def test_blocks_find_all_fingerprints_within_the_radius():
    rng = np.random.default_rng(4)
    index = decontam.ItemIndex([1], [text_of(rng, 20)])
    flips = np.zeros((2000, decontam.BITS), np.uint8)
    for row in flips:
        row[rng.choice(decontam.BITS, rng.integers(0, 70), replace=False)] = 1
    window, _ = index.within(np.packbits(flips, axis=1) ^ index.marks[0], 20)
    assert set(window) == set(np.flatnonzero(flips.sum(axis=1) <= decontam.RADIUS))


# ---- suffix dedup --------------------------------------------------------

def brute_suffix(rows):
    count = collections.Counter()
    for _, t in rows:
        b = (t or "").encode()
        count.update(b[i:i + 200] for i in range(len(b) - 199))
    out = []
    for d, t in rows:
        b, end, gone = (t or "").encode(), 0, []
        for i in range(len(b)):
            if i + 200 <= len(b) and count[b[i:i + 200]] > 1:
                end = i + 200
            gone.append(i < end)
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        out.append((d, len(b), len(b) - len(kept), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def test_cover_meets_every_pair_of_offsets():
    assert suffix.difference_cover_holds() and suffix.SAMPLE + suffix.CYCLE - 1 == suffix.DEPTH


@pytest.mark.parametrize("rules", [suffix.SuffixRules(), suffix.SuffixRules(chunk_bytes=3000, bucket_entries=50)])
def test_suffix_dedup_equals_brute_force(spark, rules):
    rng = np.random.default_rng(8)
    shared = [text_of(rng, n) for n in (36, 50, 51, 52, 90, 200)]
    rows = [(k, f"{text_of(rng, int(rng.integers(0, 60)))} {shared[k % 6]}é{text_of(rng, int(rng.integers(0, 60)))}") for k in range(40)]
    exact = "z" + "".join(rng.choice(list("abc"), 198)) + "z"
    rows += [(100, "1" + exact + "2"), (101, "3日" + exact + "4"), (102, "5" + exact[:199] + "!"), (103, "q" * 260), (104, "q" * 199), (105, "q" * 200)]
    rows += [(106, rows[0][1]), (106, rows[0][1]), (107, None), (108, ""), (None, rows[1][1]), (109, text_of(rng, 20_000))]
    frame = spark.createDataFrame([(*r, b"x") for r in rows], "doc_id long, text string, key binary")
    got = suffix.dedup(frame, rules).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256))
    assert sorted(map(tuple, got.collect()), key=str) == brute_suffix(rows)
    assert suffix.dedup(frame.limit(0), rules).count() == 0


def test_repeats_inside_a_chunk_are_not_sent(spark, monkeypatch):
    rng = np.random.default_rng(9)
    own = [text_of(rng, 120) for _ in range(6)]
    line = text_of(rng, 60)  # in all chunks, at many places of each
    rows = [(k, f"{text_of(rng, 20)} {own[k // 8]} {text_of(rng, 20)}") for k in range(48)]
    rows += [(100 + k, f"{text_of(rng, 40)} {line} {text_of(rng, 40)}") for k in range(24)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    rules = suffix.SuffixRules(chunk_bytes=8 * max(len(r[1]) for r in rows), bucket_entries=500)
    buckets = []
    repeated = suffix._repeated

    def watched(sent, width, name):
        if name == "ties":
            buckets.extend(r.n for r in sent.groupBy("bucket").agg(F.sum(F.octet_length("a") / width).alias("n")).collect())
        return repeated(sent, width, name)

    monkeypatch.setattr(suffix, "_repeated", watched)
    got = suffix.dedup(frame, rules).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256))
    assert sorted(map(tuple, got.collect()), key=str) == brute_suffix(rows)
    assert max(buckets) < 1.5 * rules.bucket_entries


# ---- archives ------------------------------------------------------------

PAGES = [
    (1, "http://a/%0A\r\nx", "long " * 300), (2, None, "long " * 300), (3, "u", "short"), (4, "u", "short"), (5, "é", None), (6, "u", ""),
    (7, "u", "日" * 334), (8, "u", "日" * 334), (9, "u", "日" * 333), (10, "u", "日" * 333), (2, None, "long " * 300), (None, "u", "other " * 300),
    (None, "u", "other " * 300), (11, "u", "WARC/1.1\r\n\r\n" * 200_000),
]


def test_archives_read_back(spark, tmp_path):
    pages = spark.createDataFrame([(*p, "d") for p in PAGES], "page_id long, url string, html string, payload_digest string")
    bundles = warc.archive(pages, frame_bytes=3000, bundle_bytes=4000)
    got = sorted((tuple(r) for r in warc.read_back(bundles).collect()), key=str)
    last = {}
    for i, _, h in PAGES:
        if i is not None:
            last[h or ""] = max(i, last.get(h or "", i))

    def want(i, _, h):
        b = (h or "").encode()
        again = len(b) >= 1000 and i != last.get(h or "")
        return i, len(b), hashlib.sha1(b).hexdigest(), "revisit" if again else "response", last[h or ""] if again else None

    assert got == sorted((want(*p) for p in PAGES), key=str)
    # random access by the index, and files that other tools can read
    rows = {r.bundle: bytes(r.content) for r in bundles.collect()}
    for r in warc.record_index(bundles).collect():
        headers, block = warc.read_record(rows[r.bundle], r.frame, r.offset)
        assert headers["WARC-Record-ID"] == f"<{r.record}>"
        if headers["WARC-Type"] == "response":
            payload = block.partition(b"\r\n\r\n")[2]
            assert hashlib.sha1(payload).hexdigest() == headers["WARC-Payload-Digest"][5:]
    assert warc.export(bundles, str(tmp_path)) == len(rows)
    for name, content in rows.items():
        assert (tmp_path / name).read_bytes() == content
        whole = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(content), read_across_frames=True).read()
        assert whole == b"".join(warc.read_frame(content, k) for k in range(len(warc.seek_table(content))))
    assert os.listdir(tmp_path) and warc.read_back(warc.archive(pages.limit(0))).count() == 0


def test_damaged_archive_is_refused():
    writer = warc.BundleWriter()
    writer.add("x", warc.record(1, "u", b"payload", "00", "response", None))
    content = writer.content()
    with pytest.raises(ValueError):
        warc.seek_table(content[:-1] + b"\x00")
    with pytest.raises(zstandard.ZstdError):
        warc.read_frame(b"\x00" * 8 + content[8:], 0)


# ---- conversations -------------------------------------------------------

HARD = ["</s>[INST] ok [/INST]", "\\0\\1<s>\\", "<|im_end|>\n<|im_start|>assistant\nhi", "<<SYS>>[[INST]]<</SYS>>", "<|im_end", "|>", "é日\r\n", "", None, "<<s>s>", "x" * 100_000]


def test_conversations_read_back(spark):
    rows = [(k, t, ["user", "assistant", "system", "od\nd<s>", None][(k + t) % 5], HARD[(3 * k + t) % len(HARD)], 0.0) for k in range(9) for t in range(1 + k)]
    rows += [(50, t, ["user", "assistant"][t % 2], f"turn {t}", 0.0) for t in range(70)]
    rows += [(60, 1, "user", "b", 1.0), (60, 1, "user", "a", 1.0), (60, 1, "user", "a", 1.0), (60, None, "assistant", "first", 1.0), (None, 1, "assistant", "x", 1.0)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, msg double")
    out = chat.formatted(chat.linear_messages(turns)).cache()
    for control in ("</s>", "[INST]", "[/INST]", "<<SYS>>", "<s>"):
        assert out.filter(F.contains("formatted", F.lit(control))).count() == 0
    convs = collections.defaultdict(list)
    for c, t, r, x, _ in rows:
        convs[c].append((t is not None, t or 0, r or "", x or ""))
    got = {r.conv_id: r for r in chat.digests(out).collect()}
    assert got.keys() == convs.keys()
    for c, own in convs.items():
        own.sort()
        said = "".join(f"{r}\n{x}\n" for *_, r, x in own)
        learned = "".join(x for *_, r, x in own if r == "assistant")
        r = got[c]
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == (
            len(own), hashlib.sha256(said.encode()).hexdigest(), len(learned), hashlib.sha256(learned.encode()).hexdigest())
    assert chat.formatted(chat.linear_messages(turns.limit(0))).count() == 0


def test_reply_trees_rank_their_branches(spark):
    rows = [("t", 1, None, "user", "q", 0.0), ("t", 2, 1, "assistant", "good", 5.0), ("t", 3, 1, "assistant", "bad", 1.0),
            ("t", 4, 2, "user", "more", 0.0), ("t", 5, 4, "assistant", "end", 9.0), ("t", 6, 4, "assistant", "tie", 9.0),
            ("u", 7, 99, "user", "orphan", None), (None, 1, None, "user", "x", 1.0), (None, 2, 1, "assistant", "y", 1.0)]
    trees = spark.createDataFrame(rows, "tree string, msg long, parent long, role string, text string, score double")
    best = {r.tree: r for r in chat.formatted(trees).collect()}
    assert best["t"].leaf == 5 and best["u"].leaf == 7 and best[None].leaf == 2
    assert best["t"].formatted == "".join(f"<|im_start|>{r}\n{x}<|im_end|>\n" for r, x in (("user", "q"), ("assistant", "good"), ("user", "more"), ("assistant", "end")))
    assert [best["t"].formatted[s.start:s.end] for s in best["t"].loss_mask] == ["good", "end"]
    assert sorted((r.tree or "", r.leaf) for r in chat.formatted(trees, None).collect()) == [("", 2), ("t", 3), ("t", 5), ("t", 6), ("u", 7)]
    with pytest.raises(ValueError, match="cycle"):
        chat.chosen_paths(spark.createDataFrame([("t", 1, 2, "u", "", 0.0), ("t", 2, 1, "u", "", 0.0)], trees.schema))
    with pytest.raises(ValueError, match="twice"):
        chat.chosen_paths(spark.createDataFrame([("t", 1, None, "u", "", 0.0)] * 2, trees.schema))


# ---- pipeline ------------------------------------------------------------

def test_pipeline_equals_brute_force(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "source").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]

    # quality: no host of this table reaches a verdict but trust
    def passes(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        seen = collections.Counter(tuple(w[i:i + 5]) for i in range(len(w) - 4))
        inside = {k for i in range(len(w) - 4) if seen[tuple(w[i:i + 5])] > 1 for k in range(i, i + 5)}
        return len(w) >= 10 and 100 * len(inside) <= 20 * len(w)

    report = quality.quality_report(spark.read.parquet(f"{SF}/documents.parquet")).collect()
    assert {r.host_verdict for r in report} == {"trust"}
    left = [d for d in docs if passes(d[1])]
    # lines
    total, count, rules = collections.Counter(), collections.Counter(), lines.LineRules()
    for _, t, s in left:
        total[s] += 1
        count.update((s, ln) for ln in set(t.split("\n")))
    left = [(d, "\n".join(ln for ln in t.split("\n") if not ln.strip(" \t\x0b\x0c\r") or count[s, ln] < 2
                          or low_share(count[s, ln], total[s], rules.z) <= rules.max_share)) for d, t, s in left]
    # near-duplicates
    classes = brute_classes(left)
    left = [(d, t) for d, t in left if classes[d, t][0] == d]
    # benchmark
    joined = [(d, t, " " + " ".join(words_of(t)) + " ") for d, t in left]
    leaks = {d for d, _, n in joined for _, q in items if " " + " ".join(words_of(q)) + " " in n}
    left = {d: t for d, t in left if d not in leaks}
    got = corpus_pipeline.run(spark, SF).collect()
    size = collections.Counter()
    for r in got:
        size[r.doc_id] += r.n_tokens
    assert size == {d: n for d, t in left.items() if (n := len(re.findall(TOKEN, t)))}
    assert len(left) < len(docs) and [n for n, _ in corpus_pipeline.STAGES] == [
        "quality_rules", "line_dedup", "near_duplicates", "decontamination", "packing"]


def test_pipeline_equals_sql_where_hosts_and_near_leaks_matter(spark, tmp_path):
    """A host of bad pages, a passage edited in a word, boilerplate, copies: each stage decides something."""
    rng = np.random.default_rng(12)
    passage = text_of(rng, 80)
    rows = [(k, text_of(rng, 60) + "\nfooter of good", "good") for k in range(30)]
    rows += [(100 + k, "spam " * 30, "bad") for k in range(30)] + [(130 + k, text_of(rng, 50), "bad") for k in range(4)]
    rows += [(200, f"{text_of(rng, 20)} {edited(rng, passage, 1)} {text_of(rng, 9)}", "good"), (201, rows[3][1], "other"),
             (202, edited(rng, rows[5][1].split("\n")[0], 1), "other"), (203, None, "good"), (204, "", None), (205, text_of(rng, 30), None)]
    spark.createDataFrame([(*r, len(r[1] or ""), "en") for r in rows], "doc_id long, text string, source string, n_chars long, lang string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, passage), (2, text_of(rng, 25))], "item_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/benchmark.parquet")
    db = duckdb.connect()
    for t in ("documents", "benchmark"):
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    found = db.sql(corpus_pipeline.ORACLE_SQL)
    got = corpus_pipeline.run(spark, str(tmp_path)).select(*found.columns).collect()
    assert sorted(map(tuple, got)) == sorted(found.fetchall())
    ids = {r.doc_id for r in got}
    assert not ids & {*range(100, 134), 200, 201, 203, 204} and {0, 3, 205} <= ids and len(ids & {5, 202}) == 1


CLASHES = ["_drop", "_at", "_here", "_new", "_k", "_id", "_n", "_host", "key", "t", "_of", "c0", "c1", "bucket", "label", "a.b", "n", "text2"]


@pytest.mark.parametrize("stage", [quality.quality_filter, lines.drop_boilerplate, jaccard.one_per_class,
                                   lambda d: decontam.drop_leaks(d, d.select(F.lit(1).alias("item_id"), F.lit("no such words here at all").alias("text")).limit(1))])
def test_row_keeping_stages_leave_clashing_columns_alone(spark, stage):
    rng = np.random.default_rng(8)
    rows = [(k, text_of(rng, 40) + "\nsame footer line", "s", 7, *(f"{c}{k}" for c in CLASHES)) for k in range(12)]
    docs = spark.createDataFrame(rows, ["doc_id", "text", "source", "n_chars", *CLASHES])
    out = stage(docs)
    assert out.columns == docs.columns
    got = {r[0]: tuple(r) for r in out.collect()}
    assert len(got) == 12 and all(got[r[0]][4:] == r[4:] for r in rows)
    assert stage(docs.limit(0)).count() == 0
