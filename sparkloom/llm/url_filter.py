"""URL filters: a sort-merge range join of URLs with nested prefix rules.

A rule (host, path prefix) covers its host and all subdomains.  Hosts are
reversed ("org.example"), so that a URL looks up one canonical key per ancestor
of its host, (reversed ancestor, path), and a rule is the interval of keys
that its own key starts.  Intervals of one host nest.  A sorted sweep over the
rules keeps the stack of active ones and cuts each host's keys into segments
with the innermost rule; then URL keys and segment bounds are sorted together
and each key takes the last bound before it.  Over all ancestors of a host the
longest rule wins.

A popular host's keys are split over salts: as many as its rows need, but no more than its rows
are times its bounds, so that the copies of the bounds never outgrow the keys.  Bounds go only to the salts of
their own host, hosts without URLs drop out, and a host of a few URLs has one salt.  The rules may be many: they
are sorted host by host and written as a table.

Defined results: a null URL, or one without ``://``, has an empty host and path
and fits no rule; hosts of any length are looked up only as deep as rules go;
repeated rows come back as often as they came; an empty table gives an empty result; without rules every verdict is the default; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkloom.session import materialize


@dataclass(frozen=True)
class UrlRule:
    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path

    @property
    def reversed_host(self) -> str:
        return ".".join(reversed(self.host.split(".")))


#: The rules that fit first.
RULES: tuple[UrlRule, ...] = (
    UrlRule("org", "/", "allow"),
    UrlRule("example.org", "/es/", "block"),
    UrlRule("example.org", "/en/1", "block"),
    UrlRule("com", "/fr/", "allow"),
    UrlRule("com", "/de/", "block"),
)
#: The filter's own rules, for URLs that no rule above fits; what remains is allowed.
OWN_RULES: tuple[UrlRule, ...] = (
    UrlRule("spam-farm.example.com", "/", "block"),
    UrlRule("spam-farm.example.net", "/", "block"),
    UrlRule("spam-farm.example.org", "/", "block"),
)
#: URL keys of a host that are swept in one group.
ROWS_PER_SALT = 20_000


def _after(prefix: str) -> str | None:
    """The first path, in code-point order, behind all those that start with ``prefix``; None if there is none."""
    prefix = prefix.rstrip("\U0010FFFF")
    if not prefix:
        return None
    last = ord(prefix[-1]) + 1
    return prefix[:-1] + chr(0xE000 if last == 0xD800 else last)


def segments(rules: Sequence[UrlRule], tier: int) -> list[tuple]:
    """Bounds (tier, reversed host, path, rule, verdict, length) from a sweep with a stack."""
    hosts: dict[str, dict[str, UrlRule]] = {}
    for rule in rules:
        hosts.setdefault(rule.reversed_host, {})[rule.path] = rule
    out: list[tuple] = []
    for host in sorted(hosts):
        stack: list[UrlRule] = []

        def bound(path: str | None, host: str = host, stack: list[UrlRule] = stack) -> None:
            if path is None:  # nothing comes behind
                return
            top = stack[-1] if stack else None
            row = (tier, host, path, top and top.name, top and top.verdict, len(top.name) if top else None)
            if out and out[-1][:3] == row[:3]:
                out[-1] = row
            else:
                out.append(row)

        for _, rule in sorted(hosts[host].items()):
            while stack and not rule.path.startswith(stack[-1].path):
                end = _after(stack.pop().path)
                bound(end)
            stack.append(rule)
            bound(rule.path)
        while stack:
            top = stack.pop()
            if top.path:  # a rule for all paths of a host never ends
                bound(_after(top.path))
    return out


def url_parts(df: DataFrame, url_col: str, id_col: str) -> DataFrame:
    """Columns ``id``, ``host`` and ``path`` by the rules' reading of a URL."""
    url = F.coalesce(F.col(url_col).cast("string"), F.lit(""))
    at = F.instr(url, "://")
    out = df.select(F.col(id_col).alias("id"), F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("").alias("rest"))
    out = out.withColumn("raw", F.regexp_extract("rest", r"^[^/?#]*", 0))
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    path = F.regexp_extract(F.substring("rest", F.length("raw") + 1, F.length("rest")), r"^[^?#]*", 0)
    return out.select("id", F.translate("raw", upper, upper.lower()).alias("host"), path.alias("path"))


def url_filter(
    df: DataFrame,
    url_col: str = "url",
    id_col: str = "page_id",
    rules: Sequence[UrlRule] = RULES,
    own_rules: Sequence[UrlRule] = OWN_RULES,
    default: str = "allow",
) -> DataFrame:
    """One row per input row: id, host, path, the longest fitting rule and the verdict."""
    spark: SparkSession = df.sparkSession
    # The scan's partition spreads rows that are alike in everything.
    pages = url_parts(df, url_col, id_col).withColumn("spot", F.spark_partition_id())
    columns = "tier int, anc string, key string, rule string, verdict string, length int"
    bounds = materialize(spark.createDataFrame(segments(rules, 0) + segments(own_rules, 1), columns).coalesce(1), "rules")
    depth = max((r.host.count(".") + 1 for r in (*rules, *own_rules)), default=1)
    labels = F.slice(F.reverse(F.split("host", r"\.")), 1, depth)
    tails = pages.withColumn("labels", labels).withColumn("anc", F.explode(F.transform("labels", lambda _, i: F.array_join(F.slice("labels", F.lit(1), i + 1), "."))))
    hosts = bounds.groupBy("tier", "anc").agg(F.count("*").alias("bounds"))
    seen = tails.groupBy("anc").agg(F.count("*").alias("rows"))
    most = F.greatest(F.col("bounds"), F.lit(ROWS_PER_SALT))
    dealt = materialize(seen.join(hosts, "anc").select("tier", "anc", F.ceil(F.col("rows") / most).cast("long").alias("salts")), "salts")
    looks = tails.join(dealt, "anc").select(
        *("tier", "anc", F.col("path").alias("key"), F.lit(1).alias("side"), "id", "host"),
        F.lit(None).cast("struct<length:int,rule:string,verdict:string>").alias("bound"),
        F.pmod(F.xxhash64("id", "host", "path", "spot"), F.col("salts")).alias("salt"),
    )
    spread = bounds.join(dealt, ["tier", "anc"]).select(
        *("tier", "anc", "key", F.lit(0).alias("side"), F.lit(None).cast(df.schema[id_col].dataType).alias("id"), F.lit(None).cast("string").alias("host")),
        F.struct("length", "rule", "verdict").alias("bound"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt"),
    )
    order = Window.partitionBy("tier", "anc", "salt").orderBy("key", "side").rowsBetween(Window.unboundedPreceding, 0)
    swept = looks.unionByName(spread).withColumn("active", F.last("bound", ignorenulls=True).over(order)).where("side = 1 AND active.rule IS NOT NULL")
    hits = swept.select("id", "host", F.col("key").alias("path"), F.lit(0).cast("long").alias("copies"), *[F.when(F.col("tier") == t, F.col("active")).alias(name) for t, name in enumerate(("given", "own"))])
    none = F.lit(None).cast("struct<length:int,rule:string,verdict:string>")
    every = pages.select("id", "host", "path", F.lit(1).cast("long").alias("copies"), none.alias("given"), none.alias("own"))
    best = every.unionAll(hits).groupBy("id", "host", "path").agg(F.sum("copies").alias("copies"), F.max("given").alias("given"), F.max("own").alias("own"))
    return best.select(
        F.col("id").alias(id_col),
        *("host", "path", F.col("given.rule").alias("rule")),
        F.coalesce("given.verdict", "own.verdict", F.lit(default)).alias("verdict"),
        F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("__copy"),
    ).drop("__copy")
