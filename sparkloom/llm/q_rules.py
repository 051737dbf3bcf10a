"""op2: quality rules over ``documents``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sparkloom.llm.quality_rules import RULES, STOP_WORDS, quality_rules
from sparkloom.session import table


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"))


def _broken() -> str:
    parts = []
    for r in RULES:
        out = [f"{r.measure} < {r.low}" for _ in [0] if r.low is not None] + [f"{r.measure} > {r.high}" for _ in [0] if r.high is not None]
        parts.append(f"CASE WHEN n_words >= {r.from_words} AND ({' OR '.join(out)}) THEN '{r.name}' END")
    return f"array_to_string([x FOR x IN [{', '.join(parts)}] IF x IS NOT NULL], ',')"


_STOP = ", ".join(f"'{w}'" for w in sorted({w for line in STOP_WORDS.values() for w in line.split()}))

QUALITY_SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t,
         [x FOR x IN string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+') IF x <> ''] AS w,
         [x FOR x IN string_split(coalesce(text, ''), chr(10)) IF regexp_matches(x, '[^\x20\x09-\x0D]')] AS lines
  FROM documents),
g AS (SELECT r, i, array_to_string(w[i : i + 4], ' ') AS g FROM (SELECT r, w, unnest(range(1, len(w) - 3)) AS i FROM d)),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM g) WHERE n > 1),
rep AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + 5)) AS p FROM twice) GROUP BY r),
m AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
         len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols, len(regexp_extract_all(t, '!'))::BIGINT AS n_bangs,
         len([x FOR x IN w IF x IN ({_STOP})])::BIGINT AS n_stop_words, len(lines)::BIGINT AS n_lines,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words,
         len([x FOR x IN lines IF rtrim(x) LIKE '%...']) AS n_ell, len([x FOR x IN lines IF regexp_matches(x, '^[\x20\x09-\x0D]*[-*•‣●]')]) AS n_bul
  FROM d LEFT JOIN rep USING (r)),
v AS (
  SELECT *, word_chars / greatest(n_words, 1) AS mean_word_chars, n_symbols / greatest(n_words, 1) AS symbol_ratio,
         n_bangs / greatest(n_words, 1) AS bang_ratio, n_stop_words / greatest(n_words, 1) AS stop_ratio,
         n_dup_lines / greatest(n_lines, 1) AS dup_line_ratio, n_ell / greatest(n_lines, 1) AS ellipsis_line_ratio,
         n_bul / greatest(n_lines, 1) AS bullet_line_ratio,
         (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed
  FROM m),
b AS (SELECT *, {_broken()} AS broken_rules FROM v)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       (NOT base_failed AND broken_rules = '') AS kept, n_stop_words, n_bangs, n_lines, broken_rules
FROM b"""

QUERIES = {"op2_quality_rules": op2_quality_rules}
SQL = {"op2_quality_rules": QUALITY_SQL}
