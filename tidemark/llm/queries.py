"""Registered corpus queries: thin digests over the operators, whole tables, production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import ann, bpe, html_text, line_dedup, ngram_join, ordinal, packing, quality_rules, sharding, suffix_dedup
from .common import table


def op1_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), lambda vec_id: vec_id % 20 == 0)


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"))


def op4_ordinal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordinal.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.digest_report(table(spark, sf_dir, "documents"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digest_report(table(spark, sf_dir, "documents"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents"))


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_ann, op2_html_text, op3_bpe, op4_ordinal, op5_sharding, op6_line_dedup, op7_packing, op8_suffix_dedup, op9_quality_rules, op10_ngram_join)}

_BARS = ", ".join(f"'{b}'" for b in sorted(quality_rules.BARS))
_ENDS = "[.!?:;\"'')\\]}…”»’。！？]$"
_BOILERPLATE = quality_rules.BOILERPLATE.pattern

ORACLES: dict[str, str] = {
    "op5_sharding": r"""
WITH RECURSIVE tab(tab) AS (SELECT list(v ORDER BY i) FROM (SELECT i, list_reduce(list_prepend(i::UBIGINT, range(8)), lambda c, b: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END) AS v FROM range(256) r(i))),
d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
y AS (SELECT doc_id, length(x) // 2 + 1 AS size, list_transform(regexp_extract_all(x, '..'), lambda h: ('0x' || h)::UBIGINT) AS bytes FROM d),
c AS (SELECT doc_id, size, xor(list_reduce(list_prepend(4294967295::UBIGINT, bytes), lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255)::BIGINT + 1])), 4294967295::UBIGINT)::BIGINT AS text_crc32 FROM y, tab),
z0 AS (SELECT doc_id, ((doc_id::UHUGEINT + 11400714819323198485::UHUGEINT) % 18446744073709551616::UHUGEINT)::UBIGINT AS z FROM documents),
z1 AS (SELECT doc_id, (xor(z, z >> 30)::UHUGEINT * 13787848793156543929::UHUGEINT % 18446744073709551616::UHUGEINT)::UBIGINT AS z FROM z0),
z2 AS (SELECT doc_id, (xor(z, z >> 27)::UHUGEINT * 10723151780598845931::UHUGEINT % 18446744073709551616::UHUGEINT)::UBIGINT AS z FROM z1),
j(doc_id, n, b, j, key) AS (
  SELECT doc_id, n, -1::BIGINT, 0::BIGINT, xor(z, z >> 31) FROM z2, (VALUES (8), (9)) t(n)
  UNION ALL
  SELECT doc_id, n, j, floor((j + 1) * (2147483648.0::DOUBLE / ((k >> 33)::DOUBLE + 1.0::DOUBLE)))::BIGINT, k
  FROM (SELECT *, ((key::UHUGEINT * 2862933555777941757::UHUGEINT + 1) % 18446744073709551616::UHUGEINT)::UBIGINT AS k FROM j WHERE j < n)),
s AS (SELECT doc_id, max(b) FILTER (n = 8)::INT AS shard, max(b) FILTER (n = 9)::INT AS grown_shard FROM j GROUP BY doc_id),
k0 AS (SELECT doc_id, ((xor(doc_id::UBIGINT, text_crc32::UBIGINT)::UHUGEINT + 11400714819323198485::UHUGEINT) % 18446744073709551616::UHUGEINT)::UBIGINT AS z FROM c),
k1 AS (SELECT doc_id, (xor(z, z >> 30)::UHUGEINT * 13787848793156543929::UHUGEINT % 18446744073709551616::UHUGEINT)::UBIGINT AS z FROM k0),
k2 AS (SELECT doc_id, (xor(z, z >> 27)::UHUGEINT * 10723151780598845931::UHUGEINT % 18446744073709551616::UHUGEINT)::UBIGINT AS z FROM k1)
SELECT doc_id, size, text_crc32, 'key' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY xor(z, z >> 31) >> 54, doc_id, text_crc32, size) - 1 AS slot, grown_shard
FROM c JOIN s USING (doc_id) JOIN k2 USING (doc_id)
""",
    "op8_suffix_dedup": r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
b AS (SELECT doc_id, x, length(x) // 2 AS n FROM d),
p AS (SELECT doc_id, x, unnest(range(1, n - 198)) AS i FROM b WHERE n >= 200),
m AS (SELECT doc_id, i, md5_number(substr(x, 2 * i - 1, 400)) AS m FROM p),
r AS (SELECT doc_id, i FROM m WHERE m IN (SELECT m FROM m GROUP BY m HAVING count(*) > 1)),
o AS (SELECT doc_id, i, i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS gap FROM r),
g AS (SELECT doc_id, i, count(*) FILTER (gap IS NULL OR gap > 200) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM o),
s AS (SELECT doc_id, g, min(i) AS a, max(i) + 200 AS z FROM g GROUP BY ALL),
k AS (SELECT s.doc_id, s.g, s.z, substr(b.x, 2 * coalesce(lag(s.z) OVER w, 1) - 1, 2 * (s.a - coalesce(lag(s.z) OVER w, 1))) AS part, s.z - s.a AS gone FROM s JOIN b USING (doc_id) WINDOW w AS (PARTITION BY s.doc_id ORDER BY s.g)),
t AS (SELECT doc_id, string_agg(part, '' ORDER BY g) AS kept, CAST(sum(gone) AS BIGINT) AS n_removed, count(*) AS n_spans, max(z) AS z FROM k GROUP BY doc_id)
SELECT b.doc_id, b.n AS n_bytes, coalesce(t.n_removed, 0) AS n_removed, coalesce(t.n_spans, 0) AS n_spans,
       sha256(unhex(CASE WHEN t.doc_id IS NULL THEN b.x ELSE t.kept || substr(b.x, 2 * t.z - 1) END)) AS kept_sha256
FROM b LEFT JOIN t USING (doc_id)
""",
    "op9_quality_rules": rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
l AS (SELECT doc_id, k, line, list_filter(string_split_regex(line, '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM d)),
f AS (SELECT *, len(words) AS n, row_number() OVER (PARTITION BY doc_id, line ORDER BY k) AS nth,
  len(list_filter(words, lambda w: w IN ({_BARS}))) AS bars, list_aggregate(list_transform(words, lambda w: length(w)), 'sum') AS chars,
  len(list_filter(words, lambda w: regexp_matches(w, '(!!|\?\?)$'))) AS shouted,
  length(line) - length(regexp_replace(line, '[#*$%&|<>]', '', 'g')) AS symbols,
  len(list_filter(words, lambda w: regexp_matches(w, '[.!?…。]$'))) AS stops FROM l),
v AS (SELECT *, n > 0 AND (bars >= 2 AND bars * 6 >= n OR NOT regexp_matches(words[-1], '{_ENDS}') AND NOT (n >= 10 AND stops > 0) OR shouted * 3 > n OR symbols * {quality_rules.SYMBOL_SHARE} > chars
  OR n <= 30 AND regexp_matches(line, '(?i){_BOILERPLATE}') OR len(regexp_extract_all(line, '{quality_rules.MARKUP.pattern}')) * 5 > n) AS fails FROM f),
c AS (SELECT doc_id, CAST(sum(n) AS BIGINT) AS n_words, CAST(coalesce(sum(chars), 0) AS BIGINT) AS word_chars, CAST(count(*) FILTER (n > 0 AND nth > 1) AS BIGINT) AS n_dup_lines,
  CAST(count(*) FILTER (fails) AS BIGINT) AS n_lines_removed, CAST(coalesce(sum(chars) FILTER (fails), 0) AS BIGINT) AS chars_lost FROM v GROUP BY doc_id),
w AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY k, j) AS i, word FROM (SELECT doc_id, k, unnest(words) AS word, generate_subscripts(words, 1) AS j FROM l)),
e AS (SELECT doc_id, i, CASE WHEN lead(word, 7) OVER s IS NOT NULL THEN concat_ws(' ', word, lead(word, 1) OVER s, lead(word, 2) OVER s, lead(word, 3) OVER s, lead(word, 4) OVER s, lead(word, 5) OVER s, lead(word, 6) OVER s, lead(word, 7) OVER s) END AS gram FROM w WINDOW s AS (PARTITION BY doc_id ORDER BY i)),
h AS (SELECT doc_id, i, gram IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, gram) > 1 AS hit FROM e),
q AS (SELECT doc_id, bool_or(hit) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) AS hit FROM h),
r AS (SELECT doc_id, count(*) FILTER (hit) AS n_repeat_words FROM q GROUP BY doc_id),
a AS (SELECT c.*, coalesce(r.n_repeat_words, 0) AS n_repeat_words, CAST(length(d.text) - length(regexp_replace(d.text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols FROM d JOIN c USING (doc_id) LEFT JOIN r USING (doc_id)),
z AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM a)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND chars_lost <= 0.5 * word_chars AS kept, n_lines_removed, chars_lost FROM z
""",
    "op10_ngram_join": r"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
g AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM d),
k AS (SELECT doc_id, len(s) AS n, md5(array_to_string(list_sort(s), chr(10))) AS name, s FROM g),
c AS (SELECT name, min(doc_id) AS rep, count(*) AS size, any_value(n) AS n, any_value(s) AS s FROM k GROUP BY name),
u AS (SELECT rep, size, n, unnest(s) AS gram FROM c),
b AS (SELECT a.rep AS a, b.rep AS b, any_value(a.n) AS na, any_value(b.n) AS nb, any_value(b.size) AS size, count(*) AS m FROM u a JOIN u b ON a.gram = b.gram AND a.rep <> b.rep GROUP BY 1, 2),
e AS (SELECT a, b, size FROM b WHERE m >= 0.8 * (na + nb - m) - 1e-9),
t(rep, low) AS (SELECT rep, rep FROM c UNION SELECT e.b, t.low FROM t JOIN e ON e.a = t.rep),
f AS (SELECT rep, min(low) AS class_id FROM t GROUP BY rep),
x AS (SELECT a AS rep, CAST(sum(size) AS BIGINT) AS links FROM e GROUP BY a)
SELECT k.doc_id, f.class_id, c.size - 1 + coalesce(x.links, 0) AS n_links, c.rep AS text_class FROM k JOIN c USING (name) JOIN f ON f.rep = c.rep LEFT JOIN x ON x.rep = c.rep
""",
    "op6_line_dedup": r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM d),
n AS (SELECT doc_id, line, k, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
h AS (SELECT key, max(doc_id) AS last FROM n WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
m AS (SELECT n.doc_id, n.line, n.k, h.key IS NOT NULL AND n.doc_id <> h.last AS gone FROM n LEFT JOIN h ON n.key = h.key)
SELECT doc_id, count(*) AS n_lines, CAST(sum(gone::INT) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY k) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
""",
}
