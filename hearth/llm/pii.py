"""Personal data: high-recall candidates, boosted trees, calibrated thresholds
[DataFrame functions only].

Base spans are exact formats (email, IPv4, card with its check digit, phone
with a plus sign) and always stay.  Wider generators, several for each kind,
then run over the text with the base spans masked out and propose spans that
may overlap, within a kind and across kinds: spelled-out or spaced emails, IPs
with bracketed or spaced dots, cards with other separators or groups, phone
numbers without a plus.  Every candidate gets a probability; those that reach
their kind's threshold compete, and of overlapping ones the most probable stays.

The probability is one formula at any size of the corpus,

    (n * tree + prior_weight * prior) / (n + prior_weight).

``tree`` comes from gradient-boosted trees over features of format and
context.  They learn from spans whose nature is known: base spans, taken as
they would look without the marks that make them base ones, and decoys,
candidates that fail a test which no feature repeats (check digit, octets,
mail domain, a date, a number of digits no phone has).  ``n`` is twice the rarer
of the two in the kind's training spans.  ``prior`` is what checks of format and
context say (``likely``): 0.995 or 0.005.  So with nothing to learn from the
prior decides, and the more the corpus shows of both the more the trees do.

A kind's threshold is the least probability whose precision over held-out spans
reaches ``precision``; it is read from Beta-shrunk counts too, with
``prior_spans`` spans of the precision that the prior expects.

Trees, counts and thresholds come from the spans of all documents.  The texts
are scanned once: their spans are written, the trees are fitted on them and
then, as column expressions, judge them without a shuffle.

Defined results: a null text is an empty one; spans are in code points, end
exclusive; spans of one kind do not overlap, those of different kinds may;
repeated rows each get their row; an empty table gives an empty result; other
columns are never read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearth.llm._store import materialise

KINDS = ("email", "ip", "card", "phone")
#: The base formats.  Look-behinds and possessive loops only save backtracking:
#: a match starts at the head of its run, or where the match before it ended.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?=[0-9])(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_AT = r"(?:@|\x20?[(\[{]\x20?(?i:at)\x20?[)\]}]\x20?|\x20(?i:at)\x20)"
_DOT = r"(?:\.|\x20?[(\[{]\x20?(?:\.|(?i:dot))\x20?[)\]}]\x20?|\x20(?i:dot)\x20)"
WIDE = {
    "email": (
        rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++{_AT}[A-Za-z0-9-]++(?:{_DOT}[A-Za-z0-9-]++)++",
        r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\x20?@\x20?[A-Za-z0-9-]++(?:\x20?\.\x20?[A-Za-z0-9-]++)++",
    ),
    "ip": (
        rf"(?=[0-9])(?<![0-9])[0-9]{{1,3}}(?:{_DOT}[0-9]{{1,3}}){{3}}(?![0-9])",
        r"(?=[0-9])(?<![0-9])[0-9]{1,3}(?:\x20?\.\x20?[0-9]{1,3}){3}(?![0-9])",
    ),
    "card": (
        r"(?=[0-9])(?<![0-9])[0-9]{4}(?:[\x20./_-]{0,2}[0-9]){9,15}(?![0-9])",
        r"(?=[0-9])(?<![0-9])[0-9]{4,6}(?:[\x20./_-]{1,3}[0-9]{2,6}){2,4}(?![0-9])",
    ),
    "phone": (
        r"(?=[(0-9])(?<![0-9A-Za-z])\(?[0-9]{2,5}\)?(?:[\x20./-]\(?[0-9]{2,5}\)?){1,5}(?![0-9])",
        r"(?=0)(?<![0-9A-Za-z.,])0[0-9]{8,13}(?![0-9A-Za-z])",
    ),
}
#: Every match of a format holds a match of these; texts without one are not scanned further.
_NEEDS = {
    "base": {"email": "@", "ip": r"[0-9]\.[0-9]", "card": "[0-9]", "phone": r"\+[0-9]"},
    "wide": {"email": rf"{_AT}[A-Za-z0-9-]++{_DOT}[A-Za-z0-9-]|@\x20?[A-Za-z0-9-]++\x20?\.", "ip": rf"[0-9]{_DOT}[0-9]|[0-9]\x20?\.\x20?[0-9]",
             "card": r"[0-9]{4}[\x20./_-]{0,3}[0-9]", "phone": r"[0-9]\)?[\x20./-]\(?[0-9]|0[0-9]{8}"},
}
#: Context words before a span.
CUES = (
    r"(?i)(?:e-?mail|mailto|contact|write)[^\n]{0,12}$",
    r"(?i)(?:\bip\b|host|server|address)[^\n]{0,12}$",
    r"(?i)(?:card|visa|master|credit|debit|iban)[^\n]{0,12}$",
    r"(?i)(?:tel|phone|call|mobile|cell|fax|whatsapp|sms)[^\n]{0,12}$",
)
#: Marks that spell out or bracket what base formats write plainly.
_BRACKETED = r"[(\[{]\x20?(?i:at|dot|\.)\x20?[)\]}]"
_SPELLED = r"\x20(?i:at)\x20.*\x20(?i:dot)\x20"
_MAIL = r"^[A-Za-z0-9._%+-]+@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}$"
_DATE = (r"(?:^|[^0-9])(?:(?:19|20)[0-9]{2}([./\x20-])(?:0?[1-9]|1[0-2])\1(?:0?[1-9]|[12][0-9]|3[01])"
         r"|(?:0?[1-9]|[12][0-9]|3[01])([./\x20-])(?:0?[1-9]|[12][0-9]|3[01])\2(?:19|20)[0-9]{2})(?:[^0-9]|$)")
_FOURS = r"^[3-6][0-9]{3}(?:[^0-9]+[0-9]{4}){3}$"
_MASK = "\u0001"
_STRIDE = 256


@dataclass(frozen=True)
class PiiRules:
    #: Documents that ``sample`` takes (``fit`` uses whatever it is given, whole).
    train_docs: int = 20_000
    trees: int = 20
    depth: int = 3
    #: Precision that a kind's threshold must reach on held-out spans.
    precision: float = 0.99
    #: Training spans that the prior of a candidate is worth, and held-out spans that a threshold's is worth.
    prior_weight: float = 200.0
    prior_spans: float = 100.0


@dataclass(frozen=True)
class Judge:
    """Fitted trees as (weight, nested splits); per kind the training spans they
    rest on, and its threshold."""

    trees: tuple = ()
    seen: dict[str, float] = field(default_factory=dict)
    thresholds: dict[str, float] = field(default_factory=dict)
    prior_weight: float = PiiRules.prior_weight


#: Probabilities that a threshold may take, and the one from which on the prior expects full precision.
STEPS = (0.5, 0.6, 0.7, 0.8, 0.85, 0.9, 0.95, 0.98)
SURE = 0.9
_YES, _NO = 0.995, 0.005


def _running(steps: Column) -> Column:
    """Sums of all earlier elements; two levels keep the work near linear."""
    def sums(values: Column, step) -> Column:
        zero = F.struct(F.lit(0).cast("long").alias("s"), F.array().cast("array<bigint>").alias("o"))
        return F.aggregate(values, zero, lambda a, x: F.struct((a["s"] + step(x)).alias("s"), F.array_append(a["o"], a["s"]).alias("o")))

    blocks = F.transform(F.sequence(F.lit(0), F.floor(F.size(steps) / _STRIDE).cast("int")),
                         lambda b: sums(F.slice(steps, b * _STRIDE + 1, F.lit(_STRIDE)), lambda x: x))
    heads = sums(blocks, lambda x: x["s"])["o"]
    return F.flatten(F.zip_with(blocks, heads, lambda b, h: F.transform(b["o"], lambda v: v + h)))


def _matches(rows: DataFrame, text: str, pattern: str, needs: str, name: str) -> DataFrame:
    """Adds column ``name``: array of (start, end, m, before, after) of all matches."""
    gaps, hits, heads, may = f"_g_{name}", f"_h_{name}", f"_s_{name}", F.col(text).rlike(needs)
    rows = rows.withColumn(hits, F.when(may, F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0))).otherwise(F.array().cast("array<string>")))
    rows = rows.withColumn(gaps, F.when(F.size(hits) > 0, F.split(F.col(text), pattern, -1)))
    steps = F.transform(hits, lambda h, i: (F.length(F.get(gaps, i)) + F.length(h)).cast("long"))
    rows = rows.withColumn(heads, F.when(F.size(hits) > 0, _running(steps)))
    span = F.transform(hits, lambda h, i: F.struct(
        (F.get(heads, i) + F.length(F.get(gaps, i))).alias("start"),
        (F.get(heads, i) + F.length(F.get(gaps, i)) + F.length(h)).alias("end"),
        h.alias("m"), F.right(F.get(gaps, i), F.lit(32)).alias("before"), F.left(F.get(gaps, i + 1), F.lit(8)).alias("after")))
    return rows.withColumn(name, span)


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """The check-digit test of a string of digits."""
    places = F.transform(F.sequence(F.lit(1), F.length(digits)), lambda i: F.substring(F.reverse(digits), i, F.lit(1)).cast("int"))
    total = F.aggregate(
        F.transform(places, lambda d, i: F.when(i % 2 == 0, d).when(d > 4, 2 * d - 9).otherwise(2 * d)), F.lit(0), lambda a, d: a + d)
    return F.when(F.length(digits) > 0, total % 10 == 0).otherwise(False)


def _octets(m: Column) -> Column:
    """Every number of the span is at most 255 (by its significant digits)."""
    return F.forall(F.regexp_extract_all(m, F.lit("[0-9]+"), F.lit(0)),
                    lambda p: F.length(F.ltrim(p, F.lit("0"))).between(0, 3) & (F.lpad(F.ltrim(p, F.lit("0")), 3, "0") <= "255"))


def valid(kind: str, m: Column) -> Column:
    n = F.length(_digits(m))
    return {
        "email": F.lit(True),
        "ip": _octets(m),
        "card": F.when(n.between(13, 19), luhn(_digits(m))).otherwise(False),
        "phone": n.between(9, 15),
    }[kind]


def _is_valid(kind: str):
    return lambda x: valid(kind, x["m"])


def _masked(text: Column, kind: str) -> Column:
    """``text`` with the valid base spans of a kind replaced by as many marks."""
    gaps, hits = F.split(text, BASE[kind], -1), F.regexp_extract_all(text, F.lit(BASE[kind]), F.lit(0))
    filled = F.transform(hits, lambda h: F.when(valid(kind, h), F.repeat(F.lit(_MASK), F.length(h))).otherwise(h))
    return F.array_join(F.zip_with(gaps, filled, lambda g, h: F.concat(g, F.coalesce(h, F.lit("")))), "")


def _plain(kind: str, m: Column) -> Column:
    """The span without what tells base ones from candidates."""
    if kind in ("email", "ip"):
        m = F.regexp_replace(F.regexp_replace(m, r"\x20?[(\[{]?\x20?(?:@|(?i:\bat\b))\x20?[)\]}]?\x20?", "@"), r"\x20?[(\[{]?\x20?(?:\.|(?i:\bdot\b))\x20?[)\]}]?\x20?", ".")
    return m if kind in ("email", "ip") else F.regexp_replace(F.regexp_replace(m, r"[^0-9]+", " "), r"^\x20", "")


def _marked(kind: str, m: Column) -> Column:
    """The span has marks that no plain text has by chance."""
    if kind == "email":
        return m.rlike(_BRACKETED) | m.rlike(_SPELLED)
    return m.rlike(_BRACKETED) | m.rlike(r"\x20(?i:dot)\x20") if kind == "ip" else F.lit(False)


def likely(kind: str, x: Column) -> Column:
    """The checks of format and context that label a candidate."""
    m, cue = x["m"], x["before"].rlike(CUES[KINDS.index(kind)])
    return {
        "email": lambda: _plain(kind, m).rlike(_MAIL) & (_marked(kind, m) | cue),
        "ip": lambda: _octets(m) & (_marked(kind, m) | cue),
        "card": lambda: valid(kind, m) & (m.rlike(_FOURS) | cue),
        "phone": lambda: valid(kind, m) & ~m.rlike(_DATE) & cue,
    }[kind]()


def passes(kind: str, m: Column) -> Column:
    """The test that tells decoys; none of the features repeats it."""
    return {
        "email": lambda: _plain("email", m).rlike(_MAIL),
        "ip": lambda: _octets(m),
        "card": lambda: valid("card", m),
        "phone": lambda: valid("phone", m) & ~m.rlike(_DATE),
    }[kind]()


def features(kind: str, x: Column, stand_in: bool = False) -> Column:
    """Format and context of a span as numbers; a stand-in is taken for a candidate."""
    m = _plain(kind, x["m"])
    marked = F.lit(kind in ("email", "ip")) if stand_in else _marked(kind, x["m"])
    groups = F.transform(F.regexp_extract_all(m, F.lit("[0-9]+"), F.lit(0)), F.length)
    numbers = [
        F.lit(KINDS.index(kind)), F.size(groups), F.coalesce(F.array_max(groups), F.lit(0)), F.coalesce(F.array_min(groups), F.lit(0)),
        F.coalesce(F.get(groups, F.lit(0)), F.lit(0)), F.length(F.substring_index(m, "@", 1)), F.size(F.split(m, r"\.")), m.startswith("0"),
        m.contains("-"), m.contains("/"), m.contains("("), m.rlike(r"\x20"),
        x["before"].rlike("[A-Za-z0-9]$"), x["before"].rlike(r"(^|[\x20\n])$"), x["before"].rlike(r"[:=]\x20?$"),
        x["after"].rlike("^[A-Za-z0-9]"), x["after"].rlike(r"^($|[\x20\n.,;])"),
        *(x["before"].rlike(c) for c in CUES), marked,
    ]
    return F.array(*(F.coalesce(n.cast("double"), F.lit(0.0)) for n in numbers))


def _leaf_or_split(node) -> float | tuple:
    if node.getClass().getSimpleName() == "LeafNode":
        return float(node.prediction())
    split = node.split()
    return int(split.featureIndex()), float(split.threshold()), _leaf_or_split(node.leftChild()), _leaf_or_split(node.rightChild())


def _tree(node: float | tuple, f: Column) -> Column:
    if not isinstance(node, tuple):
        return F.lit(node)
    k, most, left, right = node
    return F.when(F.get(f, F.lit(k)) <= most, _tree(left, f)).otherwise(_tree(right, f))


def score(judge: Judge, f: Column) -> Column:
    """Sum of the weighted trees (the logit's half)."""
    total = F.lit(0.0)
    for weight, tree in judge.trees:
        total = total + weight * _tree(tree, f)
    return total


def spans(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, per kind ``base_<kind>`` (valid base spans) and ``wide_<kind>`` (candidates off them)."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    for kind in KINDS:
        rows = _matches(rows, "t", BASE[kind], _NEEDS["base"][kind], f"all_{kind}")
        rows = rows.withColumn(f"base_{kind}", F.filter(f"all_{kind}", _is_valid(kind)))
    rows = rows.withColumn("masked", F.col("t"))
    for kind in KINDS:  # one kind after the other, on what the kinds before left
        rows = rows.withColumn("masked", F.when(F.size(f"base_{kind}") > 0, _masked(F.col("masked"), kind)).otherwise(F.col("masked")))
    for kind in KINDS:
        for k, pattern in enumerate(WIDE[kind]):
            rows = _matches(rows, "masked", pattern, _NEEDS["wide"][kind], f"wide_{kind}{k}")
        found = F.concat(*(f"wide_{kind}{k}" for k in range(len(WIDE[kind]))))
        # what two generators propose alike is one candidate
        rows = rows.withColumn(f"wide_{kind}", F.when(F.size(found) > 0, F.array_distinct(found)).otherwise(found))
    return rows.select("doc_id", *(f"base_{k}" for k in KINDS), *(f"wide_{k}" for k in KINDS))


def probability(judge: Judge, kind: str, x: Column, f: Column, prior: Column | None = None) -> Column:
    """The docstring's formula, to three digits."""
    says = F.when(likely(kind, x) if prior is None else prior, _YES).otherwise(_NO)
    n, m = judge.seen.get(kind, 0.0), judge.prior_weight
    if not judge.trees or n == 0:
        return F.round(says, 3)  # the same with a weight of nothing
    tree = 1 / (1 + F.exp(-2 * score(judge, f)))
    return F.round((n * tree + m * says) / (n + m), 3)


def _labelled(column: str, kind: str, wide: bool) -> Column:
    """Spans to learn from: label 1 for stand-ins, 0 for decoys, none for what is yet to be judged."""
    label = (lambda x: F.when(passes(kind, x["m"]), F.lit(None).cast("double")).otherwise(0.0)) if wide else (lambda x: F.lit(1.0))
    prior = (lambda x: likely(kind, x)) if wide else (lambda x: F.lit(True))
    return F.transform(column, lambda x: F.struct(
        F.lit(kind).alias("kind"), F.xxhash64(x["m"]).alias("h"), label(x).alias("label"), prior(x).alias("prior"), features(kind, x, not wide).alias("f")))


def _chosen(judge: Judge) -> Column:
    """The candidates of all kinds that reach their thresholds; of overlapping
    ones the most probable, then the longest, then the first."""

    def judged(k: int, kind: str) -> Column:
        each = F.transform(f"wide_{kind}", lambda x: F.struct(x.alias("x"), features(kind, x).alias("f")))
        each = F.transform(each, lambda y: F.struct(
            (-probability(judge, kind, y["x"], y["f"])).alias("against"), (y["x"]["start"] - y["x"]["end"]).alias("shorter"),
            y["x"]["start"].alias("start"), y["x"]["end"].alias("end"), F.lit(k).alias("kind")))
        return F.filter(each, lambda c: c["against"] <= -judge.thresholds.get(kind, SURE))

    judged_all = [judged(k, kind) for k, kind in enumerate(KINDS)]
    ranked = F.array_sort(F.concat(*judged_all))
    none = F.filter(ranked, lambda _: F.lit(False))
    apart = lambda c, o: (o["end"] <= c["start"]) | (o["start"] >= c["end"])
    return F.aggregate(ranked, none, lambda kept, c: F.when(F.forall(kept, lambda o: apart(c, o)), F.array_append(kept, c)).otherwise(kept))


def _threshold(counts: dict[float, tuple[int, int]], rules: PiiRules) -> float:
    """The least step whose precision over held-out spans, shrunk to what the
    prior expects of it, is enough; ``counts``: right and wrong at or above it."""
    for s in STEPS:
        right, wrong = counts.get(s, (0, 0))
        expected = _YES if s >= SURE else s
        if (right + rules.prior_spans * expected) / (right + wrong + rules.prior_spans) >= rules.precision:
            return s
    return 1.0  # no step is precise enough


def sample(docs: DataFrame, rules: PiiRules = PiiRules(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The ``train_docs`` documents of the smallest hashes, the same ones at any order of the rows."""
    rows = docs.select(id_col, text_col, F.xxhash64(id_col, text_col).alias("_hash"))
    least = rows.select("_hash").orderBy("_hash").limit(rules.train_docs)
    last = least.groupBy("_hash").count().orderBy(F.desc("_hash")).first()
    if last is None:
        return docs.select(id_col, text_col).limit(0)
    # rows of the last hash are copies of one another: any of them will do
    return rows.filter(F.col("_hash") < last["_hash"]).unionByName(
        rows.filter(F.col("_hash") == last["_hash"]).limit(last["count"])).drop("_hash")


def fit(docs: DataFrame, rules: PiiRules = PiiRules(), id_col: str = "doc_id", text_col: str = "text") -> Judge:
    """Learns the trees and thresholds on the spans of all ``docs``."""
    return learn(spans(docs, id_col, text_col), rules)


def learn(found: DataFrame, rules: PiiRules = PiiRules()) -> Judge:
    """``fit`` on rows of ``spans``."""
    labelled = F.concat(*(_labelled(f"{side}_{k}", k, side == "wide") for side in ("base", "wide") for k in KINDS))
    table = materialise(found.select(F.inline(labelled)).filter("label IS NOT NULL").hint("rebalance"), "pii-training")
    held = F.pmod("h", F.lit(4)) == 0
    seen = {(r["kind"], r["label"]): r["count"] for r in table.filter(~held).groupBy("kind", "label").count().collect()}
    if len({label for _, label in seen}) < 2:
        return Judge(prior_weight=rules.prior_weight)  # one label has nothing to tell: n is 0 for every kind
    data = table.filter(~held).withColumn("features", array_to_vector("f"))
    model = GBTClassifier(maxIter=rules.trees, maxDepth=rules.depth, seed=7, cacheNodeIds=False).fit(data)
    trees = tuple((float(w), _leaf_or_split(t._call_java("rootNode"))) for w, t in zip(model.treeWeights, model.trees, strict=True))
    judge = Judge(trees, {k: 2.0 * min(seen.get((k, 0.0), 0), seen.get((k, 1.0), 0)) for k in KINDS}, {}, rules.prior_weight)
    p = F.lit(0.0)
    for kind in KINDS:
        p = F.when(F.col("kind") == kind, probability(judge, kind, F.col("f"), F.col("f"), F.col("prior"))).otherwise(p)
    scored = table.filter(held).select("kind", "label", p.alias("p"))
    right = [F.count_if((F.col("p") >= s) & (F.col("label") == 1)).alias(f"r{k}") for k, s in enumerate(STEPS)]
    wrong = [F.count_if((F.col("p") >= s) & (F.col("label") == 0)).alias(f"w{k}") for k, s in enumerate(STEPS)]
    counts = {r["kind"]: r for r in scored.groupBy("kind").agg(*right, *wrong).collect()}  # one row per kind
    for kind in KINDS:
        own = counts.get(kind)
        judge.thresholds[kind] = _threshold({s: (own[f"r{k}"], own[f"w{k}"]) for k, s in enumerate(STEPS)} if own else {}, rules)
    return judge


def _text(kind: str, xs: Column) -> Column:
    return F.transform(xs, lambda x: F.concat_ws(":", F.lit(kind), x["start"], x["end"]))


def pii_spans(docs: DataFrame, rules: PiiRules = PiiRules(), id_col: str = "doc_id", text_col: str = "text",
              judge: Judge | None = None) -> DataFrame:
    """One row per document: counts of base spans, the digest of their list, all
    spans as text, and ``added_*``, the number of candidates among them."""
    rows = spans(docs, id_col, text_col)
    if judge is None:
        rows = materialise(rows, "pii-spans")
        judge = learn(rows, rules)
    some = F.lit(False)
    for kind in KINDS:
        some = some | (F.size(f"wide_{kind}") > 0)
    chosen = _chosen(judge)
    rows = rows.withColumn("chosen", F.when(some, chosen))

    def of_kind(k: int) -> Column:
        own = F.transform(F.filter("chosen", lambda c: c["kind"] == k), lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end")))
        return F.coalesce(own, F.array().cast("array<struct<start:bigint,end:bigint>>"))

    rows = rows.withColumns({f"added_{kind}": of_kind(k) for k, kind in enumerate(KINDS)})
    base = F.concat(*(_text(k, F.col(f"base_{k}")) for k in KINDS))
    places = lambda k: F.transform(f"base_{k}", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end")))
    # struct order sorts by start within a kind
    every = F.concat(*(_text(k, F.when(F.size(f"added_{k}") > 0, F.array_sort(F.concat(places(k), f"added_{k}"))).otherwise(places(k))) for k in KINDS))
    return rows.select("doc_id", *(F.size(f"base_{k}").cast("long").alias(f"n_{k}") for k in KINDS),
                       F.sha2(F.array_join(base, ","), 256).alias("base_sha256"), F.array_join(every, ",").alias("spans"),
                       *(F.size(f"added_{k}").cast("long").alias(f"added_{k}") for k in KINDS))


def redact(text: Column, kind_spans: Column) -> Column:
    """``text`` with the given (start, end, label) spans, sorted and apart, replaced by ``[LABEL]``."""
    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))
    done = F.aggregate(kind_spans, start, lambda a, x: F.struct(
        x["end"].alias("at"), F.concat(a["out"], F.substring(text, (a["at"] + 1).cast("int"), (x["start"] - a["at"]).cast("int")),
                                       F.lit("["), F.upper(x["label"]), F.lit("]")).alias("out")))
    return F.concat(done["out"], F.substring(text, (done["at"] + 1).cast("int"), F.length(text)))
