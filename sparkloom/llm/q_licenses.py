"""op3: license scans over ``documents``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sparkloom.llm.license_scan import TEMPLATES, Template, license_scan
from sparkloom.session import table


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"))


def _row(n: int, t: Template) -> str:
    must = sorted({i for at, k in t.keys for i in range(at, at + k)})
    return f"({n}, '{t.label}', {str(t.base).lower()}, {list(t.words)}, {must})"


_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LICENSE_SQL = rf"""
WITH t(n, label, base, words, must) AS (VALUES {', '.join(_row(n, t) for n, t in enumerate(TEMPLATES))}),
d AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
p AS (SELECT r, unnest(w) AS word, unnest(range(0, len(w))) AS i FROM d WHERE list_has_any(w, {sorted({t.words[min(at for at, _ in t.keys)] for t in TEMPLATES})})),
c AS (SELECT r, n, i - must[1] AS pos FROM p JOIN t ON p.word = words[must[1] + 1]),
m AS (
  SELECT r, label, base, pos, len([j FOR j IN range(0, len(words)) IF pos + j >= 0 AND w[pos + j + 1] = words[j + 1]]) / len(words) AS coverage
  FROM c JOIN t USING (n) JOIN d USING (r)
  WHERE len([j FOR j IN must IF pos + j >= 0 AND w[pos + j + 1] = words[j + 1]]) = len(must)),
a AS (
  SELECT r, count(*) FILTER (base) AS n_base, min(pos) FILTER (base) AS first_word, max(pos) FILTER (base) AS last_word,
         string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels,
         max(coverage) AS score
  FROM m WHERE coverage >= 0.6 GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0)::DOUBLE AS score
FROM d LEFT JOIN a USING (r)"""

QUERIES = {"op3_license_scan": op3_license_scan}
SQL = {"op3_license_scan": LICENSE_SQL}
