"""Measures, line dedup, packing, URLs and personal data against plain Python."""

import collections
import math
import hashlib
import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from hearth.llm import _arrow as A
from hearth.llm import lines, packing, pii, quality, urls

DOCS = "doc_id long, text string, source string, _host string, label string"


def frame(spark, rows, schema=DOCS):
    width = len(schema.split(","))
    return spark.createDataFrame([tuple(r) + (None,) * (width - len(r)) for r in rows], schema)


# ---- quality -------------------------------------------------------------

def measures(text):
    x = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", x)
    seen = collections.Counter(tuple(w[i:i + 5]) for i in range(len(w) - 4))
    inside = {k for i in range(len(w) - 4) if seen[tuple(w[i:i + 5])] > 1 for k in range(i, i + 5)}
    rows = [ln for ln in x.split("\n") if re.search(r"[^\x20\x09-\x0D]", ln)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", x)), len(rows), len(rows) - len(set(rows)), len(inside)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="ab é\n\t\x0b#|\u2003日", max_size=60)), max_size=8))
def test_measures_equal_brute_force(texts):
    batch = pa.record_batch([pa.array(texts, pa.string())], names=["t"])
    got = []
    for _, data, offsets in A.slices(batch, "t", 40):
        found = quality.measure_slice(data, offsets)
        got += list(zip(*(found[m].tolist() for m in quality.MEASURES), strict=True))
    assert got == [measures(t) for t in texts]


def test_long_text_is_measured_whole():
    text = " ".join(f"w{k}" for k in range(300_000)) + " end of a text end of a text"
    batch = pa.record_batch([pa.array(["x", text, ""])], names=["t"])
    got = [quality.measure_slice(d, o) for _, d, o in A.slices(batch, "t", 1000)]
    assert [int(v) for g in got for v in g["n_words"]] == [1, 300_008, 0]
    assert sum(int(g["n_repeat_words"].sum()) for g in got) == measures(text)[-1]


def test_host_verdicts_reach_documents(spark):
    good = "the quick brown fox jumps over the lazy dog near the river bank today"
    noisy = " ".join(f"{w}###" for w in good.split())
    rows = [(k, f"{good} {k}", "fine") for k in range(30)] + [(100 + k, noisy, "bad") for k in range(30)]
    rows += [(200, f"{good} x", "bad"), (201, "too short", "fine"), (202, None, "fine"), (203, f"{good} y", None),
             (203, f"{good} y", None), (204, noisy, "fine")]
    docs = frame(spark, rows)
    got = {r.doc_id: r for r in quality.quality_report(docs).collect()}
    assert got[0].kept and got[203].kept and got[204].kept  # a noisy page of a trusted host stays
    assert got[100].host_verdict == "block" and not got[100].kept and not got[200].kept
    assert got[201].base_failed and got[202].base_failed and got[202].n_words == 0
    kept = quality.quality_filter(docs)
    assert kept.columns == docs.columns
    want = sorted(r[0] for r in rows if got[r[0]].kept)
    assert sorted(r.doc_id for r in kept.collect()) == want and want.count(203) == 2
    assert quality.quality_report(docs.limit(0)).count() == 0 and quality.quality_filter(docs.limit(0)).count() == 0


# ---- lines ---------------------------------------------------------------

def test_line_dedup_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    pool = ["menu", "All rights reserved.", "", "  ", "x", "y\r", "é"]
    rows = []
    for k in range(120):
        host = [None, "a", "b"][k % 3]
        own = [f"line {k} {j}" for j in range(3)] + list(rng.choice(pool, 3, p=[.02, .3, .2, .2, .1, .1, .08]))
        rows.append((k, "\n".join(rng.permutation(own)), host, "h", "l"))
    rows += [(500, None, "a", "h", "l"), (501, "", "a", "h", "l"), (500, None, "a", "h", "l"), (502, "menu\nmenu", "new", "h", "l")]
    docs = frame(spark, rows)
    rows += [(600 + k, f"two pages\nown {k}", "small", "h", "l") for k in range(2)] + [(610 + k, f"few pages {k // 2}\nall of few\nown {k}", "few", "h", "l") for k in range(9)]
    docs = frame(spark, rows)
    rules = lines.LineRules(max_share=0.2)
    total, count = collections.Counter(), collections.Counter()
    for r in rows:
        total[r[2]] += 1
        for ln in set((r[1] or "").split("\n")):
            count[r[2], ln] += 1

    def low(n, of):
        p, zz = n / of, rules.z ** 2
        return (p + zz / 2 / of - rules.z * math.sqrt((p * (1 - p) + zz / 4 / of) / of)) / (1 + zz / of)

    def cut(r):
        return [ln for ln in (r[1] or "").split("\n") if not (
            ln.strip(" \t\n\x0b\x0c\r") and count[r[2], ln] > 1 and low(count[r[2], ln], total[r[2]]) > 0.2)]

    assert cut(rows[-10]) == ["own 1"] and cut(rows[-1]) == ["few pages 4", "own 8"]  # small hosts have boilerplate too

    got = sorted((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in lines.line_report(docs, rules).collect())
    want = sorted((r[0], len((r[1] or "").split("\n")), len((r[1] or "").split("\n")) - len(cut(r)), "\n".join(cut(r))) for r in rows)
    assert got == want and any(g[2] for g in got)
    out = lines.drop_boilerplate(docs.withColumn("n_chars", F.length("text").cast("long")), rules)
    assert out.columns == [*docs.columns, "n_chars"]
    for r in out.collect():
        assert (r.text is None) == (r.doc_id == 500) and r.n_chars == (None if r.text is None else len(r.text)) and r._host == "h"
    assert lines.line_report(docs.limit(0), rules).count() == 0


# ---- packing -------------------------------------------------------------

def padding(lengths, bounds):
    return sum(min(b for b in bounds if b >= n) - n for n in lengths)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 12), min_size=1, max_size=20), st.integers(1, 4))
def test_bounds_are_optimal(lengths, buckets):
    import itertools

    uniq = sorted(set(lengths))
    bounds = packing.best_bounds(np.array(uniq), np.array([lengths.count(u) for u in uniq]), buckets)
    best = min(padding(lengths, c) for k in range(1, buckets + 1) for c in itertools.combinations(uniq, k) if c[-1] == uniq[-1])
    assert len(bounds) <= buckets and padding(lengths, bounds) == best


def test_packing_keeps_every_token(spark):
    rows = [(k, "w " * (k % 23), "s") for k in range(200)] + [(7, "w " * 95), (8, None), (9, ""), (None, "a, b!"), (None, "a, b!")]
    docs = frame(spark, rows)
    got = []
    for cell in (10, 10_000):  # the number of cells has no influence
        rules = packing.PackRules(buckets=3, max_length=20, budget=50, cell_rows=cell)
        got.append(sorted(packing.packed(docs, rules).collect(), key=str))
    assert got[0] == got[1]
    size = collections.Counter()
    for r in got[0]:
        size[r.doc_id] += r.n_tokens
        assert r.n_tokens <= r.bucket <= 20 and r.padding == r.bucket - r.n_tokens and r.first_token == 20 * r.piece
    want = collections.Counter()
    for d, t, *_ in rows:
        want[d] += len(re.findall(r"[A-Za-z0-9]+|[^A-Za-z0-9\x20\x09-\x0D]", t or ""))
    assert size == +want
    batches = collections.Counter((r.bucket, r.batch) for r in got[0])
    assert len(set((r.bucket, r.batch, r.slot) for r in got[0])) == len(got[0])
    for b in {r.bucket for r in got[0]}:
        own = [n for (x, _), n in sorted(batches.items()) if x == b]
        assert all(n == max(1, 50 // b) for n in own[:-1]) and own[-1] * b <= max(50, b)
    assert packing.packed(docs.limit(0)).count() == 0


# ---- urls ----------------------------------------------------------------

CASES = [
    (1, "http://WWW.Example.COM/en/x?q=1#f", "www.example.com", "/en/x", "www.example.com/en/", "allow"),
    (2, "https://a.example.com/en/", "a.example.com", "/en/", "example.com/en/", "block"),
    (3, "https://a.example.com/de/xxx", "a.example.com", "/de/xxx", "com/", "allow"),
    (4, "https://b.net/fr/1", "b.net", "/fr/1", "net/fr/", "block"),
    (5, "https://b.net/en/porn.html", "b.net", "/en/porn.html", None, "block"),
    (6, "https://b.net/pornography", "b.net", "/pornography", None, "allow"),
    (7, "https://b.net/casino?x=POKER", "b.net", "/casino", None, "block"),
    (8, "https://b.net/casino/casino", "b.net", "/casino/casino", None, "allow"),
    (9, None, "", "", None, "allow"),
    (10, "no scheme/xxx", "", "", None, "block"),
    (11, "ftp://?q", "", "", None, "allow"),
    (11, "ftp://?q", "", "", None, "allow"),
    (12, "http://example.com", "example.com", "", None, "allow"),
    (13, "x://ÄB.org/" + "a" * 50_000, "Äb.org", "/" + "a" * 50_000, None, "allow"),
    (14, "a://b://c/d", "b:", "//c/d", None, "allow"),
    (15, "", "", "", None, "allow"),
]


def test_url_verdicts(spark):
    pages = spark.createDataFrame([c[:2] + ("h",) for c in CASES], "page_id long, url string, host string")
    got = sorted(urls.url_verdicts(pages).collect(), key=lambda r: r.page_id)
    assert [(r.page_id, r.host, r.path, r.rule, r.verdict) for r in got] == [(c[0], *c[2:]) for c in CASES]
    assert urls.url_verdicts(pages.limit(0)).count() == 0


# ---- personal data -------------------------------------------------------

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def check_digit(d):
    v = [int(c) for c in reversed(d)]
    return (sum(v[::2]) + sum(sum(divmod(2 * c, 10)) for c in v[1::2])) % 10 == 0


def base_spans(x):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, x or ""):
            d = re.sub("[^0-9]", "", m.group())
            if {"email": True, "ip": all(int(p) <= 255 for p in m.group().split(".")) if kind == "ip" else None,
                    "card": 13 <= len(d) <= 19 and check_digit(d), "phone": 9 <= len(d) <= 15}[kind]:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


TRICKY = [
    None, "", "a.b@c.d_e@f.g", "x@y.z.w@q.r-s..t", "é日 user@host.example 1.2.3.4.5.6.7.8 999.1.1.1 0001.2.3.255",
    "4111 1111 1111 1111 and 4111-1111-1111-1112 or 4111111111111111", "+1 (555) 010-9999 ++44 20 7946 0958+1 2", "+1" + "-" * 3000,
    "5500 0000 0000 0004" * 200, "@" * 500 + "a@b.c", "1." * 4000, "a@b.c " * 300 + "日" + " 10.0.0.1" * 300, "+123456789 12", "7" * 20_000,
]


def test_base_spans_equal_brute_force(spark):
    rng = np.random.default_rng(1)
    soup = ["".join(rng.choice(list("ab01.@+-() é"), 40)) for _ in range(300)]
    texts = TRICKY + soup
    rows = list(enumerate(texts)) + [(0, None), (4, TRICKY[4])]
    docs = spark.createDataFrame([(*r, "m") for r in rows], "doc_id long, text string, masked string")
    got = pii.pii_spans(docs, judge=pii.Judge()).collect()
    assert len(got) == len(rows)
    for r in got:
        want = base_spans(texts[r.doc_id])
        assert r.spans == ",".join(want) and r.base_sha256 == hashlib.sha256(r.spans.encode()).hexdigest()
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(w.startswith(k + ":") for w in want) for k in pii.KINDS]
    assert pii.pii_spans(docs.limit(0), judge=pii.Judge()).count() == 0


def test_trees_add_what_looks_like_personal_data(spark):
    """Phones after a context word are personal data, with or without a plus; groups elsewhere are not."""
    rng = np.random.default_rng(5)

    def digits():
        return f"{rng.integers(100, 999)} {rng.integers(100, 999)} {rng.integers(1000, 9999)}"

    rows = [(k, f"please phone: +{digits()} now") for k in range(600)] + [(1000 + k, f"result table {digits()} rows") for k in range(600)]
    rows.append((5000, "please phone: 123 456 7890 now"))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    judge = pii.fit(docs, pii.PiiRules(trees=3, precision=0.9))
    got = {r.doc_id: r for r in pii.pii_spans(docs, judge=judge).collect()}
    assert got[5000].spans == "phone:14:26" and got[5000].n_phone == 0 and got[5000].added_phone == 1
    assert all(got[k].n_phone == 1 and got[k].added_phone == 0 for k in range(600))
    assert all(got[1000 + k].spans == "" for k in range(600))


@pytest.mark.parametrize("mentions", [0, 300])
def test_ratio_of_base_spans_to_candidates_decides_nothing(spark, mentions):
    """Spelled-out emails among many plain ones are added, few dates and number groups among many phones are not."""
    rng = np.random.default_rng(6)

    def name():
        return "".join(rng.choice(list("bcdfgklmn"), 6))

    rows = [(k, f"mine is {name()}@{name()}.org now") for k in range(2000)]
    rows += [(10_000 + k, f"mine is {name()} at {name()} dot org now") for k in range(150)]
    rows += [(10_150 + k, f"mine is {name()}[at]{name()}.org now") for k in range(150)]
    rows += [(20_000 + k, f"reach +{rng.integers(100, 999)} {rng.integers(100, 999)} {rng.integers(1000, 9999)} now") for k in range(500)]
    rows += [(30_000 + k, f"reach {rng.integers(100, 999)} {rng.integers(100, 999)} {rng.integers(1000, 9999)} now") for k in range(12)]
    rows += [(30_100 + k, f"reach 2024-05-{10 + k} 10.30 now") for k in range(12)]
    rows += [(40_000 + k, f"we look at {name()}.org now") for k in range(mentions)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    judge = pii.fit(docs, pii.PiiRules(trees=3))
    for r in pii.pii_spans(docs, judge=judge).collect():
        assert (r.added_email, r.added_ip, r.added_card, r.added_phone) == (int(10_000 <= r.doc_id < 20_000), 0, 0, 0), r


def test_prior_judges_without_trees(spark):
    rows = [
        (1, "ann [at] site [dot] org", "email:0:23"), (2, "contact: ann at site.org", "email:9:24"), (3, "look at site.org", ""),
        (4, "we met at 10.30", ""), (5, "see 10[.]0[.]0[.]1", "ip:4:18"), (6, "see 10[.]0[.]0[.]999", ""),
        (7, "4111.1111.1111.1111", "card:0:19"), (8, "4111.1111.1111.1112", ""), (9, "call 020 7946 0958", "phone:5:18"),
        (10, "rows 020 7946 0958", ""), (11, "call 2024-05-12 10.30", ""),
    ]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    got = {r.doc_id: r.spans for r in pii.pii_spans(docs, judge=pii.fit(docs)).collect()}
    assert got == {r[0]: r[2] for r in rows}


def test_training_sample_is_bounded_full_and_repeatable(spark):
    rows = [(k % 1900, f"text {k}") for k in range(2000)] + [(None, "copy")] * 500
    got = []
    for parts in (1, 7):
        docs = spark.createDataFrame(rows[::-1] if parts == 1 else rows, "doc_id long, text string").repartition(parts)
        got.append([sorted(map(tuple, pii.sample(docs, pii.PiiRules(train_docs=n)).collect()), key=str) for n in (1, 40, 2400, 5000)])
        assert [len(g) for g in got[-1]] == [1, 40, 2400, 2500]
    assert got[0] == got[1] and pii.sample(docs.limit(0)).count() == 0


def test_trees_and_thresholds_count_every_document(spark, monkeypatch):
    """The bound of ``sample`` bounds no fit: all stand-ins and decoys count, and one query scans the texts once."""
    rows = [(k, f"phone +{200_000_000 + k} now") for k in range(300)] + [(1000 + k, f"day 2024-05-{10 + k % 15} {k % 24:02d}.30 now") for k in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    scans, judges, real, learn = [], [], pii.spans, pii.learn
    monkeypatch.setattr(pii, "spans", lambda *a, **k: scans.append(1) or real(*a, **k))
    monkeypatch.setattr(pii, "learn", lambda *a, **k: judges.append(learn(*a, **k)) or judges[-1])
    pii.pii_spans(docs, pii.PiiRules(train_docs=40, trees=2))
    assert judges[0].seen["phone"] > 80 and len(scans) == 1  # 40 documents can't show more than 40 of either


def test_trees_learn_from_decoys_and_stand_ins(spark):
    """Where a corpus shows both, the trees outweigh the prior: orders of 16 digits in
    fours, whose check digits fail, look like cards to the prior and not to the trees."""
    rng = np.random.default_rng(9)

    def card(good):
        while True:
            d = "4" + "".join(rng.choice(list("0123456789"), 15))
            if check_digit(d) == good:
                return d

    fours = lambda d, sep: sep.join(d[k:k + 4] for k in range(0, 16, 4))
    rows = [(k, f"paid with card {fours(card(True), ' ')} today") for k in range(1500)]
    rows += [(10_000 + k, f"order no {fours(card(False), '.')}/7 shipped") for k in range(1500)]
    rows += [(20_000 + k, f"order no {fours(card(True), '.')}/7 shipped") for k in range(30)]
    rows += [(30_000 + k, f"paid with card {fours(card(True), '.')} today") for k in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    judge = pii.fit(docs, pii.PiiRules(trees=5))
    assert judge.trees and judge.seen["card"] > 1000
    got = {r.doc_id: r for r in pii.pii_spans(docs, judge=judge).collect()}
    assert all(got[30_000 + k].added_card == 1 and got[20_000 + k].spans == "" for k in range(30))
    prior = {r.doc_id: r for r in pii.pii_spans(docs.filter("doc_id >= 20000 AND doc_id < 20030"), judge=pii.Judge()).collect()}
    assert sum(r.added_card for r in prior.values()) == 30  # which the prior alone would add


def test_most_probable_of_overlapping_candidates_stays(spark):
    """A number that a card and a phone generator propose is one span, and spans never overlap."""
    texts = ["call 4111.1111.1111.1111 now", "card 4111-1111 1111.1111 or 020 7946 0958", "tel 020 7946 0958 4111 1111 1111 1111",
             "contact: ann @ site . org", "e-mail ann at site.org at noon.org", "phone 0207946095812", "ip 10 . 0 . 0 . 1"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in pii.pii_spans(docs, judge=pii.Judge()).collect():
        places = sorted(tuple(map(int, x.split(":")[1:])) for x in r.spans.split(",") if x)
        assert (places or r.doc_id == 2) and all(a[1] <= b[0] for a, b in zip(places, places[1:], strict=False)), r


def test_thresholds_follow_one_formula():
    rules = pii.PiiRules()
    assert pii._threshold({}, rules) == pii.SURE
    assert pii._threshold({0.5: (10_000, 3), 0.6: (9_000, 0)}, rules) == 0.5
    assert pii._threshold({s: (0, 50) for s in pii.STEPS}, rules) == 1.0


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "a@b.c")], "doc_id long, text string")
    assert pii.fit(docs) == pii.Judge() and pii.fit(docs.limit(0)) == pii.Judge()


def test_redaction(spark):
    row = spark.createDataFrame([("é mail a@b.c now",)], "t string").select(pii.redact(
        F.col("t"), F.array(F.struct(F.lit(7).cast("long").alias("start"), F.lit(12).cast("long").alias("end"), F.lit("email").alias("label"))))).first()
    assert row[0] == "é mail [EMAIL] now"


@pytest.mark.parametrize("digits", ["4111111111111111", "79927398713", "79927398710", "0", ""])
def test_luhn(spark, digits):
    got = spark.createDataFrame([(digits,)], "d string").select(pii.luhn(F.col("d"))).first()[0]
    assert got == (bool(digits) and check_digit(digits))


# ---- URL vocabulary from a table -----------------------------------------

def test_large_vocabulary_equals_brute_force(spark):
    rng = np.random.default_rng(21)
    letters = np.array(list("abcdefghij"))
    terms = sorted({"".join(rng.choice(letters, n)) for n in rng.integers(2, 7, 160_000)})[:100_000]
    kinds = {t: ("strict" if k % 50 == 0 else "soft", int(1 + k % 3)) for k, t in enumerate(terms)}
    table = spark.createDataFrame([(t.upper() if k % 2 else t, *kinds[t]) for k, t in enumerate(terms)] + [("", "soft", 9), (None, "strict", 1), ("zz", "other", 1)],
                                  "term string, list string, weight int")
    vocabulary = urls.read_vocabulary(table, min_soft=4)
    assert len(vocabulary.strict) + len(vocabulary.soft) == len(terms)
    soft = [t for t in terms if kinds[t][0] == "soft"]
    pages = []
    for k in range(120):
        words = list(rng.choice(soft, 3)) + [terms[50 * int(rng.integers(len(terms) // 50))]] * (k % 4 == 0)
        words = [w + rng.choice(["", "x", "9"]) if k % 3 else w for w in words]
        pages.append((k, f"https://h{k}.org/" + rng.choice(["/", "-", ".", ""]).join(words).upper() + "?q=" + rng.choice(letters)))
    got = {r.page_id: (r.n_strict, r.n_soft, r.verdict) for r in urls.url_verdicts(spark.createDataFrame(pages, "page_id long, url string"), (), vocabulary).collect()}
    own = set(terms)
    for k, url in pages:
        text = url.lower()
        found = {w for w in re.split("[^a-z0-9]+", text) if w in own}  # terms of letters only stand between boundaries as whole runs
        strict = {t for t in found if kinds[t][0] == "strict"}
        weight = sum(kinds[t][1] for t in found - strict)
        assert got[k] == (len(strict), len(found - strict), "block" if strict or weight >= 4 else "allow"), url
    assert {v[2] for v in got.values()} == {"block", "allow"}


def test_vocabulary_tables_with_repeats(spark):
    table = spark.createDataFrame([("a b", "soft", None), ("a b", "soft", 3), ("C", "soft", 1), ("c", "strict", 1)], "term string, list string, weight int")
    vocabulary = urls.read_vocabulary(table)
    assert (vocabulary.strict, vocabulary.soft, dict(vocabulary.weights)) == (("c",), ("a b",), {"a b": 3})
    pages = spark.createDataFrame([(1, "x://y/a b"), (2, "x://y/C"), (3, None), (4, "x://y/ab")], "page_id long, url string")
    assert {r.page_id: r.verdict for r in urls.url_verdicts(pages, (), vocabulary).collect()} == {1: "block", 2: "block", 3: "allow", 4: "allow"}
    empty = urls.read_vocabulary(table.limit(0))
    assert {r.verdict for r in urls.url_verdicts(pages, (), empty).collect()} == {"allow"}
