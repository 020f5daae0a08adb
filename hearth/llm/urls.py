"""URL filter: host/path rules first, then a weighted vocabulary.

An Aho-Corasick automaton finds all strict and soft terms of a URL in one
scan; a hit counts only between boundaries (no ASCII letter or digit on
either side).  One strict term, or distinct soft ones whose weights reach
``min_soft`` (weight 1 each: so many terms), block a URL that no rule decides.

A vocabulary comes from a table (``read_vocabulary``) or from the short default
list.  It is the job's parameter, bounded by ``MOST_TERMS``; Spark sends it to
each executor once, and a Python worker builds the automaton once.

Defined results: a null URL or one without ``://`` has an empty host and path
and no term hits unless the text itself holds them; repeated rows each get a
row; of two rules that fit, the longer ``host + path`` wins, of two equally
long ones that with the longer host; an empty table gives an empty result;
other columns are never read.
"""

from __future__ import annotations

import string
import uuid
from collections.abc import Iterator, Mapping
from dataclasses import dataclass, field

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_EDGE = frozenset(string.ascii_lowercase + string.digits)


@dataclass(frozen=True)
class UrlRule:
    verdict: str  # allow or block
    host: str
    path: str


#: Bound of a vocabulary table's rows.
MOST_TERMS = 2_000_000


@dataclass(frozen=True)
class Vocabulary:
    """Terms in lower case; ``weights`` of soft terms (1 if not given)."""

    strict: tuple[str, ...] = ("porn", "xxx", "hentai", "camgirls", "warez", "phishing")
    soft: tuple[str, ...] = ("adult", "bet", "bonus", "casino", "dating", "escort", "free", "nude", "poker", "sex", "slots", "torrent")
    min_soft: int = 2
    weights: Mapping[str, int] = field(default_factory=dict)

    def is_bad(self, strict: set[str], soft: set[str]) -> bool:
        return bool(strict) or sum(self.weights.get(t, 1) for t in soft) >= self.min_soft


def read_vocabulary(table: DataFrame, min_soft: int = 2) -> Vocabulary:
    """From rows (term, list, weight): ``list`` is strict or soft, a null weight is 1.

    A-Z is lower-cased; null and empty terms and other lists are left out; a term in
    both lists is strict, of several weights the greatest counts."""
    term = F.translate(F.col("term"), string.ascii_uppercase, string.ascii_lowercase)
    rows = table.select(term.alias("term"), "list", F.coalesce(F.col("weight").cast("int"), F.lit(1)).alias("weight")).filter("term <> '' AND list IN ('strict', 'soft')")
    rows = rows.groupBy("term").agg(F.max(F.col("list") == "strict").alias("strict"), F.max("weight").alias("weight"))
    held = rows.limit(MOST_TERMS + 1).collect()  # bounded, and refused beyond the bound
    if len(held) > MOST_TERMS:
        raise ValueError(f"more than {MOST_TERMS} terms")
    soft = {r["term"]: r["weight"] for r in held if not r["strict"]}
    return Vocabulary(tuple(sorted(r["term"] for r in held if r["strict"])), tuple(sorted(soft)), min_soft, {t: w for t, w in soft.items() if w != 1})


RULES = (
    UrlRule("allow", "com", "/"),
    UrlRule("block", "example.com", "/en/"),
    UrlRule("allow", "www.example.com", "/en/"),
    UrlRule("block", "net", "/es/"),
    UrlRule("block", "net", "/fr/"),
)


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end; only A-Z lower-cased."""
    host = F.regexp_extract(_rest(url), "^[^/?#]*", 0)
    return F.coalesce(F.translate(host, string.ascii_uppercase, string.ascii_lowercase), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_rest(url), "^[^/?#]*([^?#]*)", 1), F.lit(""))


_BUILT: dict[str, ahocorasick.Automaton] = {}


def _kept_automaton(key: str, vocabulary: Vocabulary) -> ahocorasick.Automaton:
    """One automaton in each Python worker."""
    if key not in _BUILT:
        _BUILT.clear()
        _BUILT[key] = _automaton(vocabulary)
    return _BUILT[key]


def _automaton(vocabulary: Vocabulary) -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for kind, terms in (("soft", vocabulary.soft), ("strict", vocabulary.strict)):
        for term in terms:  # a term in both lists is strict
            found.add_word(term, (kind, term))
    found.make_automaton()
    return found


def term_hits(url: str, automaton: ahocorasick.Automaton) -> tuple[set[str], set[str]]:
    """Distinct (strict, soft) terms of a URL between boundaries."""
    text = url.translate(_LOWER)
    hits: dict[str, set[str]] = {"strict": set(), "soft": set()}
    for end, (kind, term) in (automaton.iter(text) if len(automaton) else ()):
        start = end - len(term) + 1
        if (start == 0 or text[start - 1] not in _EDGE) and (end + 1 == len(text) or text[end + 1] not in _EDGE):
            hits[kind].add(term)
    return hits["strict"], hits["soft"]


_LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def best_rule(host: str, path: str, by_host: dict[str, list[tuple[str, str]]]) -> tuple[str, str] | None:
    """(rule, verdict) of the longest rule whose host is ``host`` or a parent of it."""
    best: tuple[int, int, str, str] | None = None
    rest = host
    while True:
        for start, verdict in by_host.get(rest, ()):
            if path.startswith(start):
                best = max(best or (-1, -1, "", ""), (len(rest) + len(start), len(rest), rest + start, verdict))
        cut = rest.find(".")
        if cut < 0:
            return best and best[2:]
        rest = rest[cut + 1:]


def url_verdicts(pages: DataFrame, rules: tuple[UrlRule, ...] = RULES, vocabulary: Vocabulary = Vocabulary(),
                 id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per page: host, path, rule, strict and soft terms found, verdict."""
    by_host: dict[str, list[tuple[str, str]]] = {}
    for r in rules:
        by_host.setdefault(r.host, []).append((r.path, r.verdict))
    url = F.col(url_col)
    rows = pages.select(F.col(id_col).alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"),
                        F.coalesce(url, F.lit("")).alias("url"))

    sent, key = pages.sparkSession.sparkContext.broadcast(vocabulary), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = sent.value
        automaton = _kept_automaton(key, vocabulary)
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for host, path, text in zip(*(batch.column(c).to_pylist() for c in ("host", "path", "url")), strict=True):
                strict, soft = term_hits(text, automaton)
                rule = best_rule(host, path, by_host)
                bad = vocabulary.is_bad(strict, soft)
                for k, v in enumerate((rule[0] if rule else None, len(strict), len(soft),
                                       rule[1] if rule else ("block" if bad else "allow"))):
                    out[k].append(v)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(out[0], pa.string()), pa.array(out[1], pa.int64()),
                 pa.array(out[2], pa.int64()), pa.array(out[3], pa.string())],
                names=["page_id", "host", "path", "rule", "n_strict", "n_soft", "verdict"])

    kind = rows.schema["page_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"page_id {kind}, host string, path string, rule string, n_strict bigint, n_soft bigint, verdict string")
