"""Secret scans: spans of credentials, with weak parts linked across a scope.

Strong kinds (``assign``, ``access``, ``hex``) are reported wherever they stand.
Weak kinds (``login``, ``opaque``, ``endpoint``) are parts that say little alone;
one is reported only if a part of another role (identifier, secret, endpoint)
lies within its scope, an interval of ``SCOPE`` code points around it.  The
interval join is a sort-merge sweep over one text's parts: sorted by start, a
forward pass carries the furthest end seen of each role and a backward pass the
nearest start, so each part meets its neighbours in linear time, however many matches a text has.
All of it is built-in expressions over one row; nothing is shuffled.

Defined results: a null text counts as empty (no spans); an empty table gives an empty result; texts of any length are
scanned whole; repeated rows are scanned alike; other columns are ignored or, in
:func:`redact_secrets`, passed through.  A weak part that overlaps a strong one
is dropped, as the strong one covers it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.llm._rows import carry, fenced, scan, uncarry

#: Code points on either side of a weak part within which a complement counts.
SCOPE = 200
#: Code points of a chunk of a text that is cut up.
CHUNK = 1024


@dataclass(frozen=True)
class Kind:
    """A pattern; ``group`` and ``least`` drop matches whose group is shorter; ``also`` must match as well."""

    name: str
    role: str
    pattern: str
    strong: bool
    group: int = 0
    least: int = 0
    also: tuple[str, ...] = ()


def _any_case(words: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in words)


QUOTE = "[\"']?"
#: In the order that ties of a start follow.
KINDS: tuple[Kind, ...] = (
    Kind("assign", "secret", f"(?:{_any_case('password|passwd|secret|token|api_?key')}){QUOTE}\\x20*[:=]\\x20*{QUOTE}([A-Za-z0-9+/_.=-]+)", True, 1, 8),
    Kind("access", "identifier", "AKIA[A-Z0-9]{12,}", True),
    Kind("hex", "secret", "[0-9a-f]{32,}", True),
    Kind("login", "identifier", f"(?:{_any_case('username|login|client_id|account')}){QUOTE}\\x20*[:=]\\x20*{QUOTE}[A-Za-z0-9_.@-]+", False),
    Kind("opaque", "secret", "[A-Za-z0-9+/_=-]{32,}", False, also=("[0-9]", "[A-Za-z]")),
    Kind("endpoint", "endpoint", "[a-z][a-z0-9+]*://[A-Za-z0-9._~:/?#@!$&()*+,;=%-]+", False),
)
ROLES = ("identifier", "secret", "endpoint")
#: Cheap substring tests that each match of a kind passes.
NEEDS = {"access": "AKIA", "endpoint": "://"}

_PART = "struct<start:bigint,kind:int,end:bigint>"
_STEP = "struct<n:int,ok:boolean,gap:int>"


def kind_steps(text: Column, kind: Kind) -> Column:
    """The matches of one kind, each with its length, the length of the piece before it and whether it counts.

    ``split`` and ``regexp_extract_all`` walk the same leftmost non-overlapping
    matches, so lengths of pieces and matches add up to code-point offsets.
    """
    pattern = F.lit(kind.pattern)
    gaps, found = F.split(text, kind.pattern, -1), F.regexp_extract_all(text, pattern, F.lit(0))
    value = F.regexp_extract_all(text, pattern, F.lit(kind.group)) if kind.group else found
    checked = lambda v: F.length(v) >= kind.least
    if kind.also:
        checked = lambda v: _all([v.rlike(p) for p in kind.also])
    steps = F.zip_with(F.zip_with(found, value, lambda m, v: F.struct(F.length(m).alias("n"), checked(v).alias("ok"))), gaps, lambda m, g: F.struct(m["n"].alias("n"), m["ok"].alias("ok"), F.length(g).alias("gap")))
    test = text.rlike(kind.pattern)
    if kind.name in NEEDS:
        test = text.contains(NEEDS[kind.name]) & test
    return F.when(test, steps).otherwise(F.array().cast(f"array<{_STEP}>"))


def kind_spans(steps: str, order: int) -> Column:
    """The spans of the matches in the column ``steps``: a running sum places them."""

    def step(acc: Column, x: Column) -> tuple[dict[str, Column], Column]:
        begin = acc["at"] + x["gap"]
        span = F.struct(begin.alias("start"), F.lit(order).alias("kind"), (begin + x["n"]).alias("end"))
        # The piece after the last match has no match of its own: n is null there.
        return {"at": begin + F.coalesce(x["n"], F.lit(0))}, F.when(x["ok"], F.array(span)).otherwise(F.array().cast(f"array<{_PART}>"))

    none = F.array().cast(f"array<{_PART}>")
    return F.when(F.size(steps) > 0, scan(steps, {"at": F.lit(0).cast("long")}, step, _PART)).otherwise(none)


def _all(tests: list[Column]) -> Column:
    out = tests[0]
    for t in tests[1:]:
        out = out & t
    return out


def _any(tests: list[Column]) -> Column:
    out = tests[0]
    for t in tests[1:]:
        out = out | t
    return out


def _role(kind: Column) -> Column:
    return F.element_at(F.array(*[F.lit(ROLES.index(k.role)) for k in KINDS]), kind + 1)


def _strong(kind: Column) -> Column:
    return kind < sum(k.strong for k in KINDS)


def _sweep(parts: str, ahead: bool, scope: int) -> Column:
    """For each part, in the order of ``parts``: is a complement near, does a strong part overlap.

    Backward, the roles' nearest starts take the part of the furthest ends.
    """
    far = F.lit(-(2**62) if ahead else 2**62).cast("long")

    def step(acc: Column, p: Column) -> tuple[dict[str, Column], Column]:
        role = _role(p["kind"])
        best = F.greatest if ahead else F.least
        edge = p["end"] if ahead else p["start"]
        reach = (lambda x: x >= p["start"] - scope) if ahead else (lambda x: x <= p["end"] + scope)
        near = _any([(role != i) & reach(acc[r]) for i, r in enumerate(ROLES)])
        covered = acc["strong"] > p["start"] if ahead else acc["strong"] < p["end"]
        after = {r: F.when(role == i, best(acc[r], edge)).otherwise(acc[r]) for i, r in enumerate(ROLES)}
        after["strong"] = F.when(_strong(p["kind"]), best(acc["strong"], edge)).otherwise(acc["strong"])
        return after, F.array(F.struct(near.alias("near"), covered.alias("covered")))

    swept = scan(parts, {r: far for r in (*ROLES, "strong")}, step, "struct<near:boolean,covered:boolean>")
    return F.when(F.col(parts).isNotNull(), swept)


def find(df: DataFrame, text_col: str, scope: int = SCOPE) -> DataFrame:
    """Every row (as ``__row``) with ``__text``, ``__base`` and ``__spans`` sorted by start and kind."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    out = carry(df, __text=text)
    out = out.withColumns({f"__steps{i}": kind_steps(F.col("__text"), k) for i, k in enumerate(KINDS)})
    spans = [kind_spans(f"__steps{i}", i) for i in range(len(KINDS))]
    strong = [s for s, k in zip(spans, KINDS, strict=True) if k.strong]
    weak = [s for s, k in zip(spans, KINDS, strict=True) if not k.strong]
    out = out.withColumns({"__base": F.sort_array(F.concat(*strong)), "__weak": F.concat(*weak)}).drop(*[f"__steps{i}" for i in range(len(KINDS))])
    out = out.withColumn("__parts", F.when(F.size("__weak") > 0, F.sort_array(F.concat("__base", "__weak")))).drop("__weak")
    out = out.withColumn("__turned", F.reverse("__parts"))
    out = out.withColumns({"__fore": _sweep("__parts", True, scope), "__back": _sweep("__turned", False, scope)})
    out = out.withColumn("__back", F.reverse("__back"))
    linked = F.col("__parts")
    judged = F.filter(
        linked,
        lambda p, i: _strong(p["kind"])
        | ((F.get("__fore", i)["near"] | F.get("__back", i)["near"]) & ~F.get("__fore", i)["covered"] & ~F.get("__back", i)["covered"]),
    )
    return out.withColumn("__spans", F.coalesce(judged, F.col("__base")))


def _told(spans: Column) -> Column:
    names = F.array(*[F.lit(k.name) for k in KINDS])
    return F.array_join(F.transform(spans, lambda p: F.concat_ws(":", F.element_at(names, p["kind"] + 1), p["start"], p["end"])), ",")


def secret_scan(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", scope: int = SCOPE) -> DataFrame:
    """One row per input row: counts of the strong kinds, their digest and all spans."""
    count = lambda i: F.size(F.filter("__base", lambda p: p["kind"] == i)).cast("long")
    names = [k.name for k in KINDS if k.strong]
    found = find(df, text_col, scope).select(
        F.col(f"__row.`{id_col}`").alias(id_col),
        *[count(i).alias(f"n_{name}") for i, name in enumerate(names)],
        F.sha2(_told(F.col("__base")), 256).alias("base_sha256"),
        _told(F.col("__spans")).alias("spans"),
    )
    return fenced(found)


def redact_secrets(df: DataFrame, text_col: str = "text", mark: str = "[REDACTED]", scope: int = SCOPE) -> DataFrame:
    """The same rows with every reported span replaced by ``mark``.

    A column ``n_chars``, where there is one, becomes the new length of a changed text.
    """
    out = find(df, text_col, scope)
    hit = F.size("__spans") > 0
    # Chunks of a fixed number of code points: pieces are cut out without counting from the start of the text.
    out = out.withColumn("__chunks", F.when(hit, F.regexp_extract_all("__text", F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0))))

    def piece(a: Column, b: Column) -> Column:
        """Code points a to b."""
        first = F.floor(a / CHUNK)
        part = F.array_join(F.slice("__chunks", (first + 1).cast("int"), (F.floor(F.greatest(b - 1, a) / CHUNK) - first + 1).cast("int")), "")
        # A second mention of the column keeps the optimizer from cutting the text anew for each piece.
        return F.when(F.size("__chunks") > 0, F.substring(part, (a - first * CHUNK + 1).cast("int"), F.greatest(b - a, F.lit(0)).cast("int")))

    def step(acc: Column, p: Column) -> tuple[dict[str, Column], Column]:
        fresh = p["start"] >= acc["at"]  # else it overlaps the span before
        new = F.when(fresh, F.array(piece(acc["at"], p["start"]), F.lit(mark))).otherwise(F.array().cast("array<string>"))
        return {"at": F.greatest(acc["at"], p["end"])}, new

    out = out.withColumn("__pieces", F.when(hit, scan("__spans", {"at": F.lit(0).cast("long")}, step, "string")))
    last = F.array_max(F.transform("__spans", lambda p: p["end"]))
    clean = F.array_join(F.concat("__pieces", F.array(piece(last, F.length("__text").cast("long")))), "")
    out = out.withColumn("__clean", F.when(hit, clean).otherwise(F.col(f"__row.`{text_col}`")))
    row = F.col("__row").withField(text_col, F.col("__clean"))
    if "n_chars" in df.columns:
        row = row.withField("n_chars", F.when(hit, F.length("__clean").cast(df.schema["n_chars"].dataType)).otherwise(F.col("__row.n_chars")))
    return uncarry(out.select(row.alias("__row")))
