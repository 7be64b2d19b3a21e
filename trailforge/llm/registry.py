"""The corpus operators' queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import classifier, licenses, linededup, media, packing, pieces, pii, quality, simhash, wavelet
from .common import documents


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(documents(spark, sf_dir))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(documents(spark, sf_dir))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir))


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode_documents(documents(spark, sf_dir), keep_ids=False)


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.line_report(documents(spark, sf_dir))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classifier.classify(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wavelet.token_files(documents(spark, sf_dir))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(documents(spark, sf_dir))


def op9_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_columns(documents(spark, sf_dir), keep_media=False)


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pii_spans(documents(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality_rules": op1_quality_rules,
        "op2_license_scan": op2_license_scan,
        "op3_packing": op3_packing,
        "op4_sentencepiece": op4_sentencepiece,
        "op5_line_dedup": op5_line_dedup,
        "op6_quality_classifier": op6_quality_classifier,
        "op7_token_files": op7_token_files,
        "op8_simhash": op8_simhash,
        "op9_media_columns": op9_media_columns,
        "op10_pii": op10_pii,
    }


OP1_SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
l AS (SELECT doc_id, source, text, w, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
tri AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS t FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
often AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, t) AS n FROM tri) WHERE n > 1),
rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM often) GROUP BY doc_id),
c AS (SELECT l.doc_id, source, len(w)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
  (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, len(lines)::BIGINT AS n_lines,
  (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words
  FROM l LEFT JOIN rep USING (doc_id)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  100 * n_repeat_words > 50 * n_words OR 100 * n_symbols > 10 * n_words OR 100 * n_dup_lines > 30 * n_lines AS strict1,
  100 * n_repeat_words > 25 * n_words OR 100 * n_symbols > 5 * n_words OR 100 * n_dup_lines > 15 * n_lines AS strict2 FROM c),
h AS (SELECT source AS host, count(*) AS n, count(*) FILTER (base_failed OR strict1) AS bad FROM f GROUP BY source),
m AS (SELECT avg(bad / n) AS m, var_samp(bad / n) AS v FROM h),
p AS (SELECT CASE WHEN ok THEN m * (m * (1 - m) / v - 1) ELSE 1 END AS a, CASE WHEN ok THEN (1 - m) * (m * (1 - m) / v - 1) ELSE 1 END AS b
  FROM (SELECT m, v, coalesce(v > 0 AND m > 0 AND m < 1 AND v < m * (1 - m), false) AS ok FROM m)),
r AS (SELECT host, (bad + a) / (n + a + b) AS rate FROM h, p)
SELECT doc_id, source, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR CASE WHEN rate > 0.5 THEN strict2 ELSE strict1 END) AS kept
FROM f JOIN r ON f.source IS NOT DISTINCT FROM r.host
"""


OP5_SQL = r"""
WITH l AS (SELECT doc_id, unnest(range(len(s))) AS ln, unnest(s) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents)),
w AS (SELECT *, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS words FROM l),
c AS (SELECT *, sum(words) OVER (PARTITION BY doc_id ORDER BY ln) AS upto FROM w),
p AS (SELECT a.doc_id, a.ln, b.ln AS last FROM c a JOIN c b ON a.doc_id = b.doc_id AND b.ln >= a.ln AND b.upto - a.upto + a.words >= 50),
e AS (SELECT doc_id, ln, min(last) AS last FROM p GROUP BY doc_id, ln UNION SELECT doc_id, max(ln) AS ln, last FROM p GROUP BY doc_id, last),
r AS (SELECT e.doc_id, e.ln, e.last, string_agg(md5(x.line), ',' ORDER BY x.ln) AS run FROM e JOIN l x ON e.doc_id = x.doc_id AND x.ln BETWEEN e.ln AND e.last GROUP BY e.doc_id, e.ln, e.last),
late AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY doc_id, ln) AS k FROM r) WHERE k > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(ln, last + 1)) AS ln FROM late),
k AS (SELECT l.doc_id, count(*) AS n_lines, count(gone.ln) AS n_removed, coalesce(string_agg(line, chr(10) ORDER BY l.ln) FILTER (gone.ln IS NULL), '') AS text
  FROM l LEFT JOIN gone ON l.doc_id = gone.doc_id AND l.ln = gone.ln GROUP BY l.doc_id)
SELECT d.doc_id, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_removed, 0)::BIGINT AS n_removed, length(k.text)::BIGINT AS n_chars, md5(k.text) AS text_md5
FROM documents d LEFT JOIN k ON d.doc_id = k.doc_id
"""


def _op2_sql() -> str:
    rows = ", ".join(f"('{n}', {sorted(set(t.split()))}, {licenses.block_words(t)})" for n, t in licenses.TEMPLATES.items())
    phrases = ", ".join(f"('{p}', {p.split()}, '{label}')" for p, label in licenses.PHRASES.items())
    return rf"""
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM d),
p(phrase, parts, label) AS (VALUES {phrases}),
b AS (SELECT doc_id, label, i FROM (SELECT doc_id, w, parts, label, unnest(range(0, len(w) - len(parts) + 1)) AS i FROM w, p) WHERE w[i + 1 : i + len(parts)] = parts),
g AS (SELECT doc_id, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, list(DISTINCT label) AS base FROM b GROUP BY doc_id),
tm(template, t, reach) AS (VALUES {rows}),
s AS (SELECT doc_id, template, tm.t, reach, w, unnest(range(1, len(w) + 1)) AS i FROM w, tm WHERE len(list_intersect(list_distinct(w), tm.t)) >= ceil({licenses.THRESHOLD} * len(tm.t) - 1e-9)),
m AS (SELECT doc_id, template, len(list_intersect(list_distinct(w[i : i + reach - 1]), t)) / len(t) AS c FROM s WHERE list_contains(t, w[i])),
k AS (SELECT doc_id, list(DISTINCT template) AS met, max(c) AS best FROM m JOIN tm USING (template) WHERE c >= ceil({licenses.THRESHOLD} * len(tm.t) - 1e-9) / len(tm.t) GROUP BY doc_id)
SELECT w.doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
  array_to_string(list_sort(coalesce(base, []::VARCHAR[])), ',') AS base_labels,
  array_to_string(list_sort(list_concat(coalesce(base, []::VARCHAR[]), coalesce(met, []::VARCHAR[]))), ',') AS labels,
  CASE WHEN n_base > 0 THEN 1.0 ELSE coalesce(best, 0) END::DOUBLE AS score
FROM w LEFT JOIN g USING (doc_id) LEFT JOIN k USING (doc_id)
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_quality_rules": OP1_SQL, "op2_license_scan": _op2_sql(), "op5_line_dedup": OP5_SQL}
