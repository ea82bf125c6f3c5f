"""The registered query of each corpus operator, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import (
    alignment, attention_lm, decontaminate, html_text, jaccard_join, langid, packing,
    periodic_runs, pii, quality_rules, substring_trees, suffix_dedup, warc,
)
from .common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(spark, table(spark, sf_dir, "pages"))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove(table(spark, sf_dir, "documents")).drop("kept")


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.detect(table(spark, sf_dir, "documents"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.matches(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.link(table(spark, sf_dir, "documents"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept")


def op10_substring_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_trees.remove(table(spark, sf_dir, "documents")).drop("kept")


def op11_attention_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attention_lm.score(table(spark, sf_dir, "documents"))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(table(spark, sf_dir, "documents"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.analyse(table(spark, sf_dir, "documents"), planted=True).drop(
        "runs", "collapsed")


def quality_sql(rules: quality_rules.Rules = quality_rules.Rules()) -> str:
    """The verdict of ``quality_rules.judge`` as SQL; the parameters are written into it."""
    words = ", ".join(f"('{w}')" for w in quality_rules.vocabulary_of(rules))
    langs = ", ".join(f"'{x}'" for x in rules.common_words)
    classes = quality_rules.CHAR_CLASSES
    counted = ", ".join(
        "(length(body) - length(regexp_replace(body, '%s', '', 'g')))::DOUBLE AS c_%s"
        % (c.replace("'", "''"), n) for n, c in classes.items())
    names = [f"c_{n}" for n in classes]
    k = rules.window
    return f"""
WITH src AS (
  SELECT doc_id, coalesce(text, '') AS body,
         CASE WHEN lang IN ({langs}) THEN lang ELSE '' END AS lang FROM documents),
tokens AS (
  SELECT doc_id, body, lang, list_filter(
    string_split_regex(body, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w,
    list_filter(string_split(body, chr(10)),
                lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM src),
windows AS (
  SELECT doc_id, i, list_slice(w, i, i + {k - 1}) AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - {k - 2})) AS i FROM tokens)),
twice AS (SELECT doc_id, i FROM (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM windows) WHERE n > 1),
covered AS (SELECT doc_id, count(DISTINCT i + j) AS n
  FROM twice, range({k}) AS r(j) GROUP BY doc_id),
bins AS (SELECT doc_id, {counted}, length(body)::DOUBLE AS total FROM src),
chars AS (
  SELECT doc_id, unnest(['other', {", ".join(f"'{n}'" for n in names)}]) AS bin,
         unnest([total - {" - ".join(names)}, {", ".join(names)}]) AS n FROM bins),
vocabulary(w) AS (VALUES {words}),
listed AS (
  SELECT doc_id, w AS bin, count(*)::DOUBLE AS n
  FROM (SELECT doc_id, unnest(string_split_regex(lower(body), '[^\\p{{L}}]+')) AS w FROM src)
  SEMI JOIN vocabulary USING (w) GROUP BY ALL),
others AS (
  SELECT t.doc_id, '' AS bin, greatest(0, len(t.w) - coalesce(l.n, 0))::DOUBLE AS n
  FROM tokens t LEFT JOIN (SELECT doc_id, sum(n) AS n FROM listed GROUP BY 1) l USING (doc_id)),
histograms AS (
  SELECT 'c' AS kind, * FROM chars UNION ALL SELECT 'w', * FROM listed
  UNION ALL SELECT 'w', * FROM others),
refs AS (
  SELECT kind, lang, bin, sum(n) AS n FROM histograms JOIN src USING (doc_id) GROUP BY ALL
  UNION ALL SELECT kind, 'all', bin, sum(n) FROM histograms WHERE EXISTS (
    FROM src WHERE lang <> '') GROUP BY ALL),
q AS (SELECT kind, lang, bin, n / sum(n) OVER (PARTITION BY kind, lang) AS q
      FROM refs WHERE lang <> ''),
own AS (SELECT kind, doc_id, sum(n) AS total FROM histograms GROUP BY ALL HAVING sum(n) > 0),
p AS (SELECT kind, doc_id, bin, n / total AS p FROM histograms JOIN own USING (kind, doc_id)),
pairs AS (
  SELECT o.kind, o.doc_id, q.lang, q.q, coalesce(p.p, 0) AS p
  FROM own o JOIN q ON q.kind = o.kind
  LEFT JOIN p ON p.kind = o.kind AND p.doc_id = o.doc_id AND p.bin = q.bin),
apart AS (
  SELECT kind, doc_id, lang, sqrt(greatest(0, sum(
    CASE WHEN p > 0 THEN p * log2(2 * p / (p + q)) ELSE 0 END
    + CASE WHEN q > 0 THEN q * log2(2 * q / (p + q)) ELSE 0 END) / 2)) AS d
  FROM pairs GROUP BY ALL),
nearest AS (
  SELECT kind, doc_id, min(d) AS d, any_value(total) AS total
  FROM apart JOIN own USING (kind, doc_id) GROUP BY ALL),
counts AS (
  SELECT t.doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(
           w, lambda x: length(x))), 0)::BIGINT AS word_chars,
         (length(body) - length(translate(body, '{quality_rules.SYMBOLS}', '')))::BIGINT
           AS n_symbols,
         (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
         coalesce(c.n, 0)::BIGINT AS n_repeat_words
  FROM tokens t LEFT JOIN covered c ON c.doc_id = t.doc_id),
judged AS (
  SELECT *, n_words < {rules.min_words}
         OR 100 * n_repeat_words > {rules.max_repeat_percent} * n_words AS base_failed FROM counts)
SELECT j.*, NOT base_failed
    AND NOT coalesce(c.total >= {rules.min_chars} AND c.d > {rules.max_char_distance}, false)
    AND NOT coalesce(w.total >= {rules.min_text_words} AND w.d >
                     {rules.max_word_distance} + {rules.word_scatter} / sqrt(w.total), false) AS kept
FROM judged j
LEFT JOIN nearest c ON c.kind = 'c' AND c.doc_id = j.doc_id
LEFT JOIN nearest w ON w.kind = 'w' AND w.doc_id = j.doc_id
"""


QUERIES: dict[str, Query] = {
    "op1_warc": op1_warc,
    "op2_suffix_dedup": op2_suffix_dedup,
    "op3_best_fit_packing": op3_best_fit_packing,
    "op4_html_extraction": op4_html_extraction,
    "op5_pii": op5_pii,
    "op6_decontamination": op6_decontamination,
    "op7_language_id": op7_language_id,
    "op8_jaccard_join": op8_jaccard_join,
    "op9_quality_rules": op9_quality_rules,
    "op10_substring_trees": op10_substring_trees,
    "op11_attention_lm": op11_attention_lm,
    "op12_token_alignment": op12_token_alignment,
    "op13_periodic_runs": op13_periodic_runs,
}

WARC_SQL = f"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
q AS (SELECT page_id, octet_length(body) AS n, sha1(body) AS digest FROM p),
heads AS (SELECT digest, max(page_id) AS head FROM q WHERE n >= {warc.LEAST_REVISIT} GROUP BY 1)
SELECT page_id, n::BIGINT AS payload_bytes, digest AS payload_digest,
       CASE WHEN page_id < head THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id < head THEN head END AS refers_to
FROM q LEFT JOIN heads USING (digest)
"""

PASSAGES_SQL = """
WITH t AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'),
                             lambda x: x <> '') AS w FROM documents),
words AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM t),
windows AS (
  SELECT doc_id, i, w[i:i + 19] AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM t)),
later AS (SELECT doc_id, i FROM (
  SELECT doc_id, i, row_number() OVER (PARTITION BY g ORDER BY doc_id, i) AS n FROM windows)
  WHERE n > 1),
gone AS (SELECT DISTINCT doc_id, i + j AS i FROM later, range(20) AS r(j)),
left_over AS (
  SELECT w.doc_id, string_agg(word, ' ' ORDER BY w.i) FILTER (g.i IS NULL) AS kept, count(g.i) AS n
  FROM words w LEFT JOIN gone g ON g.doc_id = w.doc_id AND g.i = w.i GROUP BY w.doc_id)
SELECT t.doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed,
       sha256(coalesce(kept, '')) AS kept_sha256
FROM t LEFT JOIN left_over USING (doc_id)
"""

JACCARD_SQL = """
WITH RECURSIVE t AS (
  SELECT doc_id, list_filter(string_split_regex(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, list_slice(w, i, i + 2) AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS i FROM t
        WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c
  FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (
  SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b
  WHERE 100 * c >= 90 * (x.n + y.n - c)),
pairs AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (
  SELECT doc_id, doc_id AS other FROM t
  UNION SELECT r.doc_id, e.b FROM reach r JOIN pairs e ON e.a = r.other)
SELECT t.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id
FROM t LEFT JOIN n USING (doc_id)
JOIN (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY 1) c USING (doc_id)
"""

ORACLES: dict[str, str] = {
    "op1_warc": WARC_SQL,
    "op8_jaccard_join": JACCARD_SQL,
    "op9_quality_rules": quality_sql(),
    "op10_substring_trees": PASSAGES_SQL,
}
