"""Registered queries of the training-data operators, and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hearth.llm import align, chat, decontam, fmindex, jaccard, lines, negatives, packing, pii, quality, suffix, urls, warc
from hearth.sources.tables import read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def _query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return register


@_query()
def op1_pii_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's personal data: base spans, and those the trees add."""
    return pii.pii_spans(read_table(spark, sf_dir, "documents", ["doc_id", "text"]))


_ESCAPED = r"""regexp_replace(regexp_replace(regexp_replace(replace(coalesce({}, ''), '\', '\0'),
  '<(/?s>|</?SYS>>|\|[A-Za-z0-9_]+\|>)', '\\1\1', 'g'), '<(/?s>|</?SYS>>|\|[A-Za-z0-9_]+\|>)', '\\1\1', 'g'),
  '\[(/?INST\])', '\\2\1', 'g')"""


@_query(rf"""
WITH t AS (
  SELECT conv_id, turn, role, text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
p AS (
  SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS x, {_ESCAPED.format('text')} AS e,
         {_ESCAPED.format('role')} AS er FROM t)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(r || chr(10) || x || chr(10), '' ORDER BY turn NULLS FIRST, r, x)) AS turns_sha256,
  CAST(coalesce(sum(length(x)) FILTER (r = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(x, '' ORDER BY turn NULLS FIRST, r, x) FILTER (r = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length('<|im_start|>') + length(replace(er, chr(10), '\3')) + 1 + length(e) + length('<|im_end|>') + 1) AS BIGINT) AS formatted_chars
FROM p GROUP BY conv_id""")
def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and one made of control strings, formatted and read back."""
    turns = read_table(spark, sf_dir, "conversations", ["conv_id", "turn", "role", "text"])
    hard = "</s>[INST] ok [/INST]"
    probe = spark.createDataFrame([(-1, 0, "user", hard), (-1, 1, "assistant", hard)], turns.schema)
    return chat.digests(chat.formatted(chat.linear_messages(turns.unionByName(probe))))


_RULES = quality.HostRules()


@_query(rf"""
WITH d AS (SELECT doc_id, source, row_number() OVER () AS row, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
g AS (SELECT row, i, unnest(list_transform(range(1, len(ws) - 3), lambda k: ws[k:k+4])) AS gram,
             unnest(range(1, len(ws) - 3)) AS pos FROM (SELECT row, ws, 0 AS i FROM w WHERE len(ws) >= 5)),
twice AS (SELECT row, pos FROM g QUALIFY count(*) OVER (PARTITION BY row, gram) > 1),
covered AS (SELECT row, count(DISTINCT pos + k) AS n FROM twice, range(5) AS r(k) GROUP BY row),
l AS (SELECT row, unnest(string_split(t, chr(10))) AS line FROM d),
ln AS (SELECT row, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n FROM l
       WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY row),
m AS (
  SELECT doc_id, source, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(length(list_aggregate(ws, 'string_agg', '')), 0) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    coalesce(n_lines, 0) AS n_lines, coalesce(ln.n, 0) AS n_dup_lines, coalesce(covered.n, 0) AS n_repeat_words
  FROM w LEFT JOIN covered USING (row) LEFT JOIN ln USING (row)),
f AS (
  SELECT *, n_words < {_RULES.min_words} OR 100 * n_repeat_words > {_RULES.max_repeat_pct} * n_words AS base_failed,
    n_symbols > {_RULES.max_symbols_per_word} * n_words OR n_dup_lines > {_RULES.max_dup_line_share} * n_lines
    OR word_chars < {_RULES.word_length[0]} * n_words OR word_chars > {_RULES.word_length[1]} * n_words AS soft_failed FROM m),
h AS (SELECT source, count(*) AS n, count(*) FILTER (base_failed OR soft_failed) AS x FROM f GROUP BY source),
s AS (SELECT count(*) AS k, sum(n) AS n, (sum(x) + 0.5::DOUBLE) / (sum(n) + 1) AS mean,
        greatest(0, sum(n * (x / n) * (x / n)) / sum(n) - (sum(x) / sum(n)) * (sum(x) / sum(n))) AS var FROM h),
p AS (SELECT mean, least(greatest(mean * (1 - mean) / greatest(var - mean * (1 - mean) * k / n, 1e-6) - 1, 1), 1e6) AS strength FROM s),
v AS (SELECT source, (x + mean * strength) / (n + strength) AS rate FROM h, p)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND rate < {_RULES.block} AND NOT (rate >= {_RULES.watch} AND soft_failed) AS kept,
  CASE WHEN rate >= {_RULES.block} THEN 'block' WHEN rate >= {_RULES.watch} THEN 'watch' ELSE 'trust' END AS host_verdict
FROM f JOIN v ON f.source IS NOT DISTINCT FROM v.source""")
def op3_host_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's measures, base verdict and verdict after its host's."""
    docs = read_table(spark, sf_dir, "documents", ["doc_id", "text", "source"])
    return quality.quality_report(docs, _RULES).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "host_verdict")


_LEAKS = decontam.LeakRules()
_WORDS = r"regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9\x{80}-\x{10FFFF}]+')"
_GRAMS = """list_transform(range(1, len(ws) - 3), lambda k: ws[k:k+4])"""


@_query(rf"""
WITH d AS (SELECT doc_id, row_number() OVER () AS row, {_WORDS} AS ws FROM documents),
i AS (SELECT item_id, row_number() OVER () AS item, {_WORDS} AS ws FROM benchmark),
g AS (SELECT row, len(ws) - 4 AS shingles, unnest({_GRAMS}) AS gram, unnest(range(len(ws) - 4)) AS pos FROM d WHERE len(ws) >= 5),
q AS (SELECT item, len(ws) - 4 AS shingles, unnest({_GRAMS}) AS gram FROM i WHERE len(ws) >= 5),
qc AS (SELECT item, shingles, gram, count(*) AS c, 1 + ln(list_sum(list_transform(gram, lambda w: strlen(w)))) AS w FROM q GROUP BY ALL),
qt AS (SELECT item, sum(c * w) AS total FROM qc GROUP BY item),
h AS (SELECT DISTINCT g.row, item, least(g.shingles, qc.shingles) AS size, unnest(range(greatest(0, pos - least(g.shingles, qc.shingles) + 1),
        least(pos, g.shingles - least(g.shingles, qc.shingles)) + 1)) AS s FROM g JOIN qc ON g.gram = qc.gram),
o AS (SELECT h.row, h.item, h.size, h.s, g.gram, count(*) AS c FROM h JOIN g ON g.row = h.row AND g.pos BETWEEN h.s AND h.s + h.size - 1 GROUP BY ALL),
m AS (SELECT o.row, o.item, o.size, o.s, sum(o.c * (1 + ln(list_sum(list_transform(o.gram, lambda w: strlen(w)))))) AS own,
             sum(coalesce(qc.w * least(o.c, qc.c), 0)) AS both_ FROM o LEFT JOIN qc ON qc.item = o.item AND qc.gram = o.gram GROUP BY ALL),
v AS (SELECT m.*, both_ / (own + total - both_) AS sim FROM m JOIN qt USING (item)),
b AS (SELECT * FROM v WHERE sim >= {_LEAKS.similarity} QUALIFY row_number() OVER (PARTITION BY row, item ORDER BY round(sim, 9) DESC, s) = 1),
si AS (SELECT item, ws, len(ws) AS n FROM i WHERE len(ws) BETWEEN {_LEAKS.least_words} AND 4),
sn AS (SELECT DISTINCT n FROM si),
sg AS (SELECT row, n, unnest(list_transform(range(len(ws) - n + 1), lambda k: ws[k+1:k+n])) AS gram, unnest(range(len(ws) - n + 1)) AS s FROM d JOIN sn ON len(ws) >= n),
sb AS (SELECT row, item, min(s) AS s, sg.n FROM sg JOIN si ON si.n = sg.n AND si.ws = gram GROUP BY ALL),
o2 AS (SELECT row, item, sim, s, size + 4 AS n FROM b UNION ALL SELECT row, item, 1.0, s, n FROM sb)
SELECT doc_id, item_id, round(sim, 6) AS similarity, s AS first_word, n AS n_words FROM o2 JOIN d USING (row) JOIN i USING (item)""")
def op4_simhash_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark passage in the documents: (doc_id, item_id) and where it lies."""
    docs = read_table(spark, sf_dir, "documents", ["doc_id", "text"])
    found = decontam.leaks(docs, read_table(spark, sf_dir, "benchmark", ["item_id", "text"]), _LEAKS)
    return found.withColumn("similarity", F.round("similarity", 6))


_LINES = lines.LineRules()


@_query(rf"""
WITH d AS (SELECT doc_id, source, row_number() OVER () AS row, coalesce(text, '') AS t FROM documents),
l AS (SELECT row, source, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) AS pos FROM d),
c AS (SELECT source, line, count(DISTINCT row) AS n FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY ALL),
h AS (SELECT source, count(*) AS total FROM d GROUP BY source),
bad AS (SELECT c.source, c.line FROM c JOIN h ON c.source IS NOT DISTINCT FROM h.source
        WHERE n > 1 AND (n / total + {_LINES.z * _LINES.z}::DOUBLE / (2 * total) - {_LINES.z}::DOUBLE
          * sqrt((n / total * (1 - n / total) + {_LINES.z * _LINES.z}::DOUBLE / (4 * total)) / total)) / (1 + {_LINES.z * _LINES.z}::DOUBLE / total) > {_LINES.max_share}::DOUBLE),
j AS (SELECT l.*, bad.line IS NOT NULL AS gone FROM l LEFT JOIN bad ON l.source IS NOT DISTINCT FROM bad.source AND l.line = bad.line),
a AS (SELECT row, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
             coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '') AS text FROM j GROUP BY row)
SELECT doc_id, source, n_lines, n_dropped, text FROM a JOIN d USING (row)""")
def op5_site_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the lines that are boilerplate of its source."""
    return lines.line_report(read_table(spark, sf_dir, "documents", ["doc_id", "text", "source"]), _LINES)


_PACK = packing.PackRules()


def packing_sql(rules: packing.PackRules = _PACK) -> str:
    """The same packing in SQL: the dynamic program is one step per bucket."""
    top = rules.max_length
    steps = ["p0 AS (SELECT 0::BIGINT AS j, 0::BIGINT AS cost, []::BIGINT[] AS bounds)"]
    for k in range(1, rules.buckets + 1):
        steps.append(f"""p{k} AS (
  SELECT b.j, min(a.cost + b.l * (b.n - x.n) - (b.s - x.s)) AS cost,
         list_append(arg_min(a.bounds, (a.cost + b.l * (b.n - x.n) - (b.s - x.s)) * 1000000 + a.j), b.l) AS bounds
  FROM p{k - 1} a JOIN h x ON x.j = a.j JOIN h b ON b.j > a.j GROUP BY b.j, b.l)""")
    last = " UNION ALL ".join(f"SELECT {k} AS k, cost, bounds FROM p{k} WHERE j = (SELECT max(j) FROM h)" for k in range(1, rules.buckets + 1))
    return rf"""
WITH n AS (SELECT doc_id, CAST(len(regexp_extract_all(text, '[A-Za-z0-9]+|[^A-Za-z0-9\x20\x09-\x0D]')) AS BIGINT) AS n FROM documents),
pieces AS (SELECT doc_id, n, unnest(range((n - 1) // {top} + 1)) AS piece FROM n WHERE n > 0),
q AS (SELECT doc_id, piece, piece * {top} AS first_token, least({top}, n - piece * {top}) AS n_tokens FROM pieces),
c AS (SELECT n_tokens AS l, count(*) AS c FROM q GROUP BY 1),
h AS (SELECT row_number() OVER (ORDER BY l) AS j, l, CAST(sum(c) OVER (ORDER BY l) AS BIGINT) AS n, CAST(sum(c * l) OVER (ORDER BY l) AS BIGINT) AS s FROM c
      UNION ALL SELECT 0, 0, 0, 0),
{', '.join(steps)},
best AS (SELECT bounds FROM ({last}) ORDER BY cost, k LIMIT 1),
r AS (SELECT q.*, list_filter(bounds, lambda x: x >= n_tokens)[1] AS bucket,
             md5(concat_ws('|', coalesce(CAST(doc_id AS VARCHAR), ''), piece, n_tokens)) AS key FROM q, best),
o AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY key, doc_id NULLS FIRST, piece, n_tokens) - 1 AS pos FROM r)
SELECT doc_id, piece, first_token, n_tokens, bucket, CAST(pos // greatest(1, {rules.budget} // bucket) AS BIGINT) AS batch,
  CAST(pos % greatest(1, {rules.budget} // bucket) AS BIGINT) AS slot, bucket - n_tokens AS padding FROM o"""


@_query(packing_sql())
def op6_length_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces in the length buckets with the least padding."""
    return packing.packed(read_table(spark, sf_dir, "documents", ["doc_id", "text"]), _PACK)


_JOIN = jaccard.JoinRules()


@_query(rf"""
WITH RECURSIVE t AS (SELECT coalesce(text, '') AS t, min(doc_id) AS copy_id, count(*) AS n_copies FROM documents GROUP BY 1),
w AS (SELECT copy_id, regexp_extract_all(lower(t), '[a-z0-9\x{{80}}-\x{{10FFFF}}]+') AS ws FROM t),
s AS (SELECT DISTINCT copy_id AS id, unnest(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda k: ws[k:k+4])
                                                 WHEN len(ws) > 0 THEN [ws] ELSE [] END) AS g FROM w),
n AS (SELECT id, count(*) AS n FROM s GROUP BY id),
p AS (SELECT a.id AS a, b.id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.id <> b.id GROUP BY 1, 2),
l AS (SELECT p.a, p.b FROM p JOIN n x ON x.id = p.a JOIN n y ON y.id = p.b WHERE c >= {_JOIN.similarity} * (x.n + y.n - c)),
r AS (SELECT copy_id AS id, copy_id AS low FROM t UNION SELECT l.b, r.low FROM r JOIN l ON l.a = r.id),
c AS (SELECT id, min(low) AS class_id FROM r GROUP BY id),
k AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT doc_id, class_id, coalesce(k.n, 0) AS n_links, t.copy_id, t.n_copies
FROM documents d JOIN t ON coalesce(d.text, '') = t.t JOIN c ON c.id = t.copy_id LEFT JOIN k ON k.a = t.copy_id""")
def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's class of near-duplicates and its number of links."""
    return jaccard.similar_classes(read_table(spark, sf_dir, "documents", ["doc_id", "text"]), _JOIN)


@_query(rf"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b, sha1(encode(coalesce(html, ''))) AS h FROM pages),
x AS (SELECT *, octet_length(b) AS n, max(page_id) OVER (PARTITION BY h) AS first FROM p)
SELECT page_id, n AS payload_bytes, h AS payload_digest,
  CASE WHEN n >= {warc.MIN_REVISIT} AND page_id < first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= {warc.MIN_REVISIT} AND page_id < first THEN first END AS refers_to FROM x""")
def op8_warc_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page archived in seekable bundles and read back from them."""
    return warc.read_back(warc.archive(read_table(spark, sf_dir, "pages", ["page_id", "url", "html"])))


@_query(f"""
WITH b AS (SELECT doc_id, row_number() OVER () AS row, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
w AS (SELECT row, i, md5(substr(h, 2 * i + 1, {2 * suffix.DEPTH})) AS k
      FROM (SELECT row, h, unnest(range(greatest(n - {suffix.DEPTH - 1}, 0))) AS i FROM b)),
r AS (SELECT row, i FROM w QUALIFY count(*) OVER (PARTITION BY k) > 1),
j AS (SELECT row, i, coalesce(i > lag(i) OVER (PARTITION BY row ORDER BY i) + {suffix.DEPTH}, true) AS new FROM r),
s AS (SELECT row, min(i) AS a, max(i) + {suffix.DEPTH} AS e
      FROM (SELECT row, i, sum(CAST(new AS INTEGER)) OVER (PARTITION BY row ORDER BY i) AS span FROM j) GROUP BY row, span),
c AS (SELECT row, a, e FROM s UNION ALL SELECT row, n, n FROM b),
p AS (SELECT row, a, e, lag(e, 1, 0) OVER (PARTITION BY row ORDER BY a, e) AS done FROM c),
t AS (SELECT row, string_agg(substr(h, 2 * done + 1, 2 * (a - done)), '' ORDER BY a, e) AS kept FROM p JOIN b USING (row) GROUP BY row),
x AS (SELECT row, CAST(sum(e - a) AS BIGINT) AS gone, count(*) AS spans FROM s GROUP BY row)
SELECT doc_id, n AS n_bytes, coalesce(gone, 0) AS n_removed, coalesce(spans, 0) AS n_spans, sha256(unhex(kept)) AS kept_sha256
FROM b JOIN t USING (row) LEFT JOIN x USING (row)""")
def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the bytes of 200-byte strings that start elsewhere too."""
    rows = suffix.dedup(read_table(spark, sf_dir, "documents", ["doc_id", "text"]))
    return rows.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def _terms(terms: tuple[str, ...]) -> str:
    return " + ".join(f"CAST(regexp_matches(u, '(^|[^a-z0-9]){t}([^a-z0-9]|$)') AS BIGINT)" for t in terms)


_VOCABULARY = urls.Vocabulary()
_ORDERED = sorted(urls.RULES, key=lambda r: -len(r.host + r.path))
_FIRST_RULE = " ".join(
    f"WHEN (host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}') THEN {k}" for k, r in enumerate(_ORDERED))


@_query(rf"""
WITH a AS (SELECT page_id, coalesce(url, '') AS url, instr(url, '://') AS pos FROM pages),
b AS (SELECT page_id, url, CASE WHEN pos > 0 THEN substr(url, pos + 3) ELSE '' END AS rest,
             translate(url, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS u FROM a),
c AS (SELECT page_id, u, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM b),
d AS (SELECT *, CASE {_FIRST_RULE} END AS r, {_terms(_VOCABULARY.strict)} AS n_strict, {_terms(_VOCABULARY.soft)} AS n_soft FROM c)
SELECT page_id, host, path, {str([r.host + r.path for r in _ORDERED])}[r + 1] AS rule, n_strict, n_soft,
  coalesce({str([r.verdict for r in _ORDERED])}[r + 1],
           CASE WHEN n_strict > 0 OR n_soft >= {_VOCABULARY.min_soft} THEN 'block' ELSE 'allow' END) AS verdict FROM d""")
def op10_url_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page URL judged by the rules, else by its terms."""
    return urls.url_verdicts(read_table(spark, sf_dir, "pages", ["page_id", "url"]))


@_query()
def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's groups and links between two tokenizers, and its links' corpus-wide counts."""
    return align.align(read_table(spark, sf_dir, "documents", ["doc_id", "text"]))


@_query(r"""
WITH v AS (
  SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM (SELECT * FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)),
s AS (SELECT a.id AS anchor_id, b.id, a.label = b.label AS same,
             CAST(list_inner_product(a.q::DOUBLE[], b.q::DOUBLE[]) AS BIGINT) AS score
      FROM v a JOIN v b ON a.id % 100 = 0 AND a.id <> b.id),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) AS INTEGER) AS rank,
  id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
QUALIFY rank <= 5""")
def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every hundredth vector, searched among all."""
    rows = read_table(spark, sf_dir, "embeddings", ["vec_id", "embedding", "label"])
    shifted = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(rows.withColumn("label", shifted), F.col("id") % 100 == 0)


@_query(rf"""
WITH d AS (SELECT doc_id, row_number() OVER () AS row, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
w AS (SELECT doc_id, row, i, md5(array_to_string(ws[i + 1: i + {fmindex.WINDOW}], ' ')) AS k
      FROM (SELECT doc_id, row, ws, unnest(range(greatest(len(ws) - {fmindex.WINDOW - 1}, 0))) AS i FROM d)),
r AS (SELECT row, i FROM w QUALIFY doc_id > min(doc_id) OVER (PARTITION BY k)),
g AS (SELECT DISTINCT row, i + j AS pos FROM r, range({fmindex.WINDOW}) AS x(j)),
t AS (SELECT doc_id, row, unnest(ws) AS w, generate_subscripts(ws, 1) - 1 AS pos FROM d),
k AS (SELECT row, count(g.pos) AS gone, coalesce(string_agg(w, ' ' ORDER BY t.pos) FILTER (g.pos IS NULL), '') AS kept
      FROM t LEFT JOIN g USING (row, pos) GROUP BY row)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(gone, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (row)""")
def op11_substring_fm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the words of 50-word windows that an earlier document holds too."""
    rows = fmindex.dedup(read_table(spark, sf_dir, "documents", ["doc_id", "text"]))
    return rows.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
