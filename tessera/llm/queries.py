"""The queries of the corpus operators, and SQL for those that SQL can express."""

from __future__ import annotations

from . import bpe, html, lm, mixing, pii, quality, rollup, runs, sharding, simhash, tiff, warc
from .base import documents

#: Words of a text, in DuckDB.
SQL_WORDS = r"regexp_extract_all(text, '[^\x20\x09-\x0D]+')"


def op1_quality(spark, sf_dir):
    return quality.report(documents(spark, sf_dir)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op2_rollup(spark, sf_dir):
    return rollup.totals(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op3_mix(spark, sf_dir):
    return mixing.digest(documents(spark, sf_dir))


def op4_shards(spark, sf_dir):
    return sharding.digest(documents(spark, sf_dir))


def op5_lm(spark, sf_dir):
    return lm.scores(documents(spark, sf_dir))


def op6_warc(spark, sf_dir):
    return warc.round_trip(spark.read.parquet(f"{sf_dir}/pages.parquet")).drop("error")


def op7_tiff(spark, sf_dir):
    return tiff.digests(documents(spark, sf_dir))


def op8_pii(spark, sf_dir):
    return pii.digest(documents(spark, sf_dir))


def op9_simhash(spark, sf_dir):
    return simhash.digest(documents(spark, sf_dir))


def op10_bpe(spark, sf_dir):
    import public_tokenizers

    return bpe.round_trip(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op11_runs(spark, sf_dir):
    return runs.digest(documents(spark, sf_dir))


def op12_html(spark, sf_dir):
    return html.extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))


QUERIES = {"op1_quality": op1_quality, "op2_rollup": op2_rollup, "op3_mix": op3_mix, "op4_shards": op4_shards, "op5_lm": op5_lm, "op6_warc": op6_warc, "op7_tiff": op7_tiff, "op8_pii": op8_pii, "op9_simhash": op9_simhash, "op10_bpe": op10_bpe, "op11_runs": op11_runs, "op12_html": op12_html}


def quality_sql(table: str = "documents", limits: quality.Limits = quality.Limits()) -> str:
    lengths = ", ".join(f"({n})" for n in [3, *(n for n, _ in limits.ngrams)])
    over = " OR ".join(f"(n = {n} AND 100 * chars > {most} * word_chars)" for n, most in limits.ngrams)
    return rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM {table}),
w AS (SELECT rid, doc_id, text, {SQL_WORDS} AS ws, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
m AS (
  SELECT rid, doc_id, ws, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
    (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
    length(array_to_string(ls, '')) AS line_chars, length(array_to_string(ls, '')) - length(array_to_string(list_distinct(ls), '')) AS dup_chars
  FROM w),
g AS (SELECT rid, n, p, array_to_string(ws[p:p + n - 1], ' ') AS g FROM (SELECT rid, ws, n, unnest(range(1, len(ws) - n + 2)) AS p FROM m, (VALUES {lengths}) AS t(n))),
r AS (SELECT rid, n, p FROM g QUALIFY count(*) OVER (PARTITION BY rid, n, g) > 1),
c AS (SELECT DISTINCT rid, n, unnest(range(p, p + n)) AS q FROM r),
s AS (SELECT c.rid, n, count(*) AS k, sum(length(m.ws[q])) AS chars, any_value(word_chars) AS word_chars FROM c JOIN m ON c.rid = m.rid GROUP BY c.rid, n),
v AS (SELECT rid, coalesce(max(k) FILTER (n = 3), 0)::BIGINT AS n_repeat_words, bool_or({over}) AS repeated FROM s GROUP BY rid),
j AS (SELECT m.*, coalesce(v.n_repeat_words, 0)::BIGINT AS n_repeat_words, coalesce(v.repeated, false) AS repeated FROM m LEFT JOIN v ON m.rid = v.rid)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (n_words < {limits.min_words} OR 100 * n_repeat_words > {limits.repeat_words} * n_words) AS base_failed,
  NOT (n_words < {limits.min_words} OR 100 * n_repeat_words > {limits.repeat_words} * n_words OR repeated
    OR 100 * dup_chars > {limits.line_chars} * line_chars OR 100 * n_symbols > {limits.symbols} * n_words) AS kept
FROM j"""


PII_CHECKS = {
    "email": "true",
    "ip": "list_bool_and(list_transform(string_split(v, '.'), lambda p: length(ltrim(p, '0')) <= 3 AND coalesce(try_cast(nullif(ltrim(p, '0'), '') AS INTEGER), 0) <= 255))",
    "card": """length(regexp_replace(v, '[ -]', '', 'g')) BETWEEN 13 AND 19 AND list_sum(list_transform(
      list_reverse(string_split(regexp_replace(v, '[ -]', '', 'g'), '')),
      lambda d, i: CASE WHEN i % 2 = 1 THEN d::INTEGER WHEN d::INTEGER > 4 THEN 2 * d::INTEGER - 9 ELSE 2 * d::INTEGER END)) % 10 = 0""",
    "phone": "length(regexp_replace(v, '[^0-9]', '', 'g')) BETWEEN 9 AND 15",
    "iban": """list_reduce(list_prepend(0, list_transform(string_split(substr(replace(v, ' ', ''), 5) || substr(replace(v, ' ', ''), 1, 4), ''), lambda c: ascii(c))),
      lambda a, c: CASE WHEN c < 58 THEN a * 10 + c - 48 ELSE a * 100 + c - 55 END % 97) = 1""",
    "ssn": "NOT regexp_matches(v, '^(000|666|9..)|-00-|-0000$')",
}


def pii_sql(table: str = "documents") -> str:
    parts, counts = [], []
    for k in pii.KINDS:
        parts.append(rf"""
    SELECT rid, {len(parts)} AS ord, '{k.name}' AS kind, {k.base} AS base, s, s + length(v) AS e FROM (
      SELECT *, substr(text, greatest(s - {pii.NEAR}, 0) + 1, least(s, {pii.NEAR})) || chr(10) || substr(text, s + length(v) + 1, {pii.NEAR}) AS near FROM (
        SELECT rid, text, hits[i] AS v, list_sum(list_transform(gaps[1:i], lambda x: length(x)))::BIGINT + coalesce(list_sum(list_transform(hits[1:i - 1], lambda x: length(x))), 0)::BIGINT AS s
        FROM (SELECT rid, text, hits, gaps, unnest(range(1, len(hits) + 1)) AS i FROM (
          SELECT rid, text, regexp_extract_all(text, '{k.plain}') AS hits, string_split_regex(text, '{k.plain}') AS gaps FROM d)))
    ) WHERE ({PII_CHECKS[k.name]}) AND ({k.base} OR {k.score} + CASE WHEN regexp_matches(near, '(?i)({k.context})') THEN {pii.BONUS} ELSE 0 END >= {pii.THRESHOLD})""")
        if k.base:
            counts.append(f"(count(*) FILTER (kind = '{k.name}'))::BIGINT AS n_{k.name}")
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM {table}),
f AS ({" UNION ALL ".join(parts)})
SELECT any_value(doc_id) AS doc_id, {", ".join(counts)},
  sha256(coalesce(string_agg(kind || ':' || s || ':' || e, ',' ORDER BY ord, s) FILTER (base), '')) AS base_sha256,
  coalesce(string_agg(kind || ':' || s || ':' || e, ',' ORDER BY ord, s), '') AS spans
FROM d LEFT JOIN f USING (rid) GROUP BY rid"""


MIX_SQL = rf"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text FROM documents),
r AS (
  SELECT doc_id, source, md5(text) AS digest, len({SQL_WORDS})::BIGINT AS size, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS symbols
  FROM d),
q AS (
  SELECT *, -ln((('0x' || substr(md5('{mixing.SEED}:' || coalesce(doc_id::VARCHAR, 'null') || ':' || digest), 1, 13))::BIGINT + 0.5) / 4503599627370496)
    / (1 + (size >= 50)::INTEGER + (chars >= 3 * size AND chars <= 12 * size)::INTEGER + (10 * symbols <= size)::INTEGER) AS k
  FROM r),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM r GROUP BY source),
w AS (SELECT *, [5, 2, 1][((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1)::INTEGER] AS w, sum(source_size) OVER () AS total FROM s),
c AS (
  SELECT *, 4 * source_size * sum(w) OVER (need ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
    <= w * (3 * total - 4 * coalesce(sum(source_size) OVER (need ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS capped
  FROM w WINDOW need AS (ORDER BY source_size / w, source IS NULL, source)),
t AS (
  SELECT source, source_size, CASE WHEN capped THEN (2 * source_size)::DOUBLE
    ELSE (w * (3 * total - 4 * coalesce(sum(source_size) FILTER (capped) OVER (), 0)))::DOUBLE / (2 * sum(w) FILTER (NOT capped) OVER ())::DOUBLE END AS target
  FROM c),
e AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS epochs FROM t),
b AS (SELECT *, round(target - epochs * source_size)::BIGINT AS budget FROM e),
p AS (
  SELECT q.doc_id, q.size, b.source_size, b.target, b.epochs,
    b.budget - coalesce(sum(q.size) OVER (PARTITION BY q.source ORDER BY q.k, q.doc_id, q.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS room
  FROM q JOIN b ON q.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, size, source_size, target, (epochs * size + least(greatest(room, 0), size))::BIGINT AS taken FROM p"""


def _base32(digest: str) -> str:
    """Base 32 of a hexadecimal column in SQL: five digits give four letters."""
    letter = "substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((('0x' || substr({d}, 5 * g + 1, 5))::BIGINT >> {shift}) & 31) + 1)::INTEGER, 1)"
    four = " || ".join(letter.format(d=digest, shift=s) for s in (15, 10, 5, 0))
    return f"array_to_string(list_transform(range(8), lambda g: {four}), '')"


WARC_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY html) AS first FROM p)
SELECT page_id, strlen(html)::BIGINT AS payload_bytes, {_base32('hex')} AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
FROM f"""


ROLLUP_SQL = rf"""
SELECT source, lang, 'marks-2' AS tokenizer, count(*)::BIGINT AS docs,
  sum(len(regexp_extract_all(coalesce(text, ''), '\p{{L}}+|\p{{N}}+|[^\p{{L}}\p{{N}}\x20\x09-\x0D]')))::BIGINT AS tokens
FROM documents WHERE doc_id IS NULL OR doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1 AND doc_id IS NOT NULL)
GROUP BY source, lang"""


#: n1, n2, n3: how often other documents have the word, with the one before, with the two before.
LM_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {SQL_WORDS.replace("text", "coalesce(text, '')")} AS ws FROM documents),
w AS (SELECT rid, unnest(ws) AS c, generate_subscripts(ws, 1) AS p FROM d),
g AS (SELECT rid, p, c, lag(c) OVER (PARTITION BY rid ORDER BY p) AS b, lag(c, 2) OVER (PARTITION BY rid ORDER BY p) AS a FROM w),
n AS (
  SELECT rid, p, count(*) OVER () - count(*) OVER (PARTITION BY rid) AS n0, count(*) OVER (PARTITION BY c) - count(*) OVER (PARTITION BY rid, c) AS n1,
    CASE WHEN p > 1 THEN count(*) OVER (PARTITION BY b, c) - count(*) OVER (PARTITION BY rid, b, c) END AS n2,
    CASE WHEN p > 2 THEN count(*) OVER (PARTITION BY a, b, c) - count(*) OVER (PARTITION BY rid, a, b, c) END AS n3
  FROM g),
m AS (SELECT *, lag(n1) OVER (PARTITION BY rid ORDER BY p) AS m1, lag(n2) OVER (PARTITION BY rid ORDER BY p) AS m2 FROM n),
s AS (
  SELECT rid, sum(CASE WHEN n3 > 0 THEN log10(n3 / m2) WHEN n2 > 0 THEN log10(n2 / m1) + CASE WHEN p > 2 THEN log10({lm.BACKOFF}) ELSE 0 END
    ELSE log10(greatest(n1, 1) / greatest(n0, 1)) + least(p - 1, 2) * log10({lm.BACKOFF}) END) AS score
  FROM m GROUP BY rid)
SELECT doc_id, len(ws)::BIGINT AS n_words, round(coalesce(score, 0), 4) AS log_score, CASE WHEN len(ws) > 0 THEN round(score / len(ws), 4) END AS log_per_word
FROM d LEFT JOIN s USING (rid)"""


#: What the articles of the given pages hold; the operator itself knows nothing of their layout.
HTML_SQL = r"""
WITH a AS (SELECT page_id, url, regexp_replace(regexp_extract(coalesce(html, ''), '(?s)<article>(.*)</article>', 1), '<[^>]*>', ' ', 'g') AS t FROM pages),
d AS (SELECT page_id, url, replace(regexp_replace(regexp_replace(regexp_replace(t, '&quot;?', '"', 'g'), '&lt;?', '<', 'g'), '&gt;?', '>', 'g'), '&#x27;', chr(39)) AS t FROM a),
s AS (SELECT page_id, url, trim(regexp_replace(regexp_replace(t, '&amp;?', '&', 'g'), '\s+', ' ', 'g')) AS text FROM d)
SELECT page_id, url, text, length(text)::BIGINT AS n_chars FROM s"""


ORACLES = {"op12_html": HTML_SQL, "op5_lm": LM_SQL, "op2_rollup": ROLLUP_SQL, "op6_warc": WARC_SQL, "op3_mix": MIX_SQL, "op1_quality": quality_sql(), "op8_pii": pii_sql()}
