"""op7: URL filters over ``pages``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sparkloom.llm.url_filter import OWN_RULES, RULES, url_filter
from sparkloom.session import table


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter(table(spark, sf_dir, "pages"))


_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_VALUES = ", ".join(f"({tier}, '{r.host}', '{r.path}', '{r.name}', '{r.verdict}')" for tier, rules in enumerate((RULES, OWN_RULES)) for r in rules)
URL_SQL = f"""
WITH rules(tier, h, p, name, verdict) AS (VALUES {_VALUES}),
u AS (SELECT row_number() OVER () AS r, page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
k AS (SELECT r, page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM u),
x AS (SELECT r, page_id, translate(raw, '{_UPPER}', '{_UPPER.lower()}') AS host, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM k),
f AS (
  SELECT x.r, arg_max(name, length(name)) FILTER (tier = 0) AS rule, arg_max(verdict, length(name)) FILTER (tier = 0) AS given,
         arg_max(verdict, length(name)) FILTER (tier = 1) AS own
  FROM x JOIN rules ON (host = h OR host LIKE '%.' || h) AND starts_with(path, p) GROUP BY x.r)
SELECT page_id, host, path, rule, coalesce(given, own, 'allow') AS verdict FROM x LEFT JOIN f USING (r)"""

QUERIES = {"op7_url_filter": op7_url_filter}
SQL = {"op7_url_filter": URL_SQL}
