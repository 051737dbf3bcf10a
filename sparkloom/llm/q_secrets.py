"""op5: secret scans over ``documents``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sparkloom.llm.secret_scan import KINDS, ROLES, SCOPE, Kind, secret_scan
from sparkloom.session import table


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan(table(spark, sf_dir, "documents"))


def _found(order: int, k: Kind) -> str:
    pattern = k.pattern.replace("'", "''")
    tests = [f"length(v) >= {k.least}"] + [f"regexp_matches(v, '{p}')" for p in k.also]
    return f"""
SELECT r, {order} AS kind, {ROLES.index(k.role)} AS role, sum(gap) OVER o + coalesce(sum(n) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start, n, v
FROM (SELECT r, unnest(range(1, len(m) + 1)) AS i, unnest([length(x) FOR x IN g[1 : len(m)]]) AS gap, unnest([length(x) FOR x IN m]) AS n, unnest(v) AS v
      FROM (SELECT r, string_split_regex(t, '{pattern}') AS g, regexp_extract_all(t, '{pattern}') AS m, regexp_extract_all(t, '{pattern}', {k.group}) AS v
            FROM d WHERE regexp_matches(t, '{pattern}')))
WINDOW o AS (PARTITION BY r ORDER BY i) QUALIFY {' AND '.join(tests)}"""


_STRONG = sum(k.strong for k in KINDS)
_NAMES = "[" + ", ".join(f"'{k.name}'" for k in KINDS) + "]"
SECRET_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
p AS (SELECT r, kind, role, start::BIGINT AS start, (start + n)::BIGINT AS stop FROM ({' UNION ALL '.join(f'({_found(i, k)})' for i, k in enumerate(KINDS))})),
s AS (
  SELECT *, {_NAMES}[kind + 1] AS name FROM p
  WHERE kind < {_STRONG} OR (
    EXISTS (SELECT 1 FROM p q WHERE q.r = p.r AND q.role <> p.role AND q.stop >= p.start - {SCOPE} AND q.start <= p.stop + {SCOPE})
    AND NOT EXISTS (SELECT 1 FROM p q WHERE q.r = p.r AND q.kind < {_STRONG} AND q.stop > p.start AND q.start < p.stop))),
a AS (
  SELECT r, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
         string_agg(name || ':' || start || ':' || stop, ',' ORDER BY start, kind) FILTER (kind < {_STRONG}) AS base,
         string_agg(name || ':' || start || ':' || stop, ',' ORDER BY start, kind) AS spans
  FROM s GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN a USING (r)"""

QUERIES = {"op5_secret_scan": op5_secret_scan}
SQL = {"op5_secret_scan": SECRET_SQL}
