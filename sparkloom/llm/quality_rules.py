"""Quality rules: a threshold table compiled into one Spark projection.

Every measure is a built-in expression over one row, so the operator is a
narrow projection: no shuffle, no user function, any row order.

Defined results: a null text counts as an empty one (no words: it fails
``base_failed``); an empty table gives an empty result; texts of any length are measured whole; repeated rows are judged
one by one and alike; other columns are ignored or, in :func:`quality_filter`,
passed through.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.llm._rows import carry, fenced, keep_where

SPACE = r"[\x20\x09-\x0D]+"
#: Everything but the counted symbols and exclamation marks.
MARKLESS = r"[^#*$%&|<>!]+"

#: Common function words of the four languages the rules know (fixed values).
STOP_WORDS = {
    "en": "the of and to in is that it for was on are as with be by this at from or an a have not what",
    "fr": "le la les de des du et est un une en que qui dans pour par sur au avec ne pas",
    "de": "der die das und ist in den von zu mit sich auf für als dem nicht ein eine im es",
    "es": "el la los las de y en que un una es por con para se del al lo su no",
}


@dataclass(frozen=True)
class Rule:
    """Reject a text of ``from_words`` words or more whose ``measure`` lies outside ``[low, high]``."""

    name: str
    measure: str
    low: float | None = None
    high: float | None = None
    from_words: int = 0


#: The production table. Ratios follow the usual published web-text heuristics.
RULES: tuple[Rule, ...] = (
    Rule("word_length", "mean_word_chars", 1.5, 15.0),
    Rule("symbols", "symbol_ratio", high=0.1),
    Rule("shouting", "bang_ratio", high=0.1),
    Rule("stop_words", "stop_ratio", low=0.02, from_words=30),
    Rule("duplicate_lines", "dup_line_ratio", high=0.5),
    Rule("ellipsis_lines", "ellipsis_line_ratio", high=0.3),
    Rule("bullet_lines", "bullet_line_ratio", high=0.9),
)


def word_array(text: Column) -> Column:
    """White-space separated words of a text; null gives none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def compile_rules(rules: Sequence[Rule]) -> Column:
    """The names of the rules a row breaks, as one array expression."""
    checks = []
    for rule in rules:
        value, out = F.col(rule.measure), F.lit(False)
        if rule.low is not None:
            out = out | (value < rule.low)
        if rule.high is not None:
            out = out | (value > rule.high)
        checks.append(F.when(out & (F.col("n_words") >= rule.from_words), F.lit(rule.name)))
    return F.array_compact(F.array(*checks))


def measure(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", rules: Sequence[Rule] = RULES) -> DataFrame:
    """Every row (as ``__row``) with its counts, ratios, broken rules and verdict."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    stop = sorted({w for line in STOP_WORDS.values() for w in line.split()})
    out = carry(df, __id=F.col(id_col), __text=text).withColumn("__words", word_array(F.col("__text")))
    w = F.col("__words")
    out = out.withColumns(
        {
            "__joined": F.array_join(w, " "),
            "__marks": F.regexp_replace("__text", MARKLESS, ""),
            "__lines": F.filter(F.split("__text", "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]")),
            "n_words": F.size(w).cast("long"),
            "n_stop_words": F.size(F.filter(w, lambda x: x.isin(stop))).cast("long"),
        }
    )
    # The windows of five words, as 64-bit hashes: eight bytes a word, however long the words.
    windows = F.transform(
        F.slice(w, F.lit(1), F.greatest(F.size(w) - 4, F.lit(0))),
        lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2), F.get(w, i + 3), F.get(w, i + 4)),
    )
    out = out.withColumn("__windows", windows).drop("__words")
    # Only texts with a repeated window pay for the sort that locates the repeats.
    h = F.col("__windows")
    pairs = F.when(F.size(F.array_distinct(h)) < F.size(h), F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("at")))))
    out = out.withColumn("__pairs", pairs).drop("__windows")
    p = F.col("__pairs")
    twice = F.filter(p, lambda x, k: (x["h"] == F.get(p, k - 1)["h"]) | (x["h"] == F.get(p, k + 1)["h"]))
    starts = F.sort_array(F.transform(twice, lambda x: x["at"].cast("long")))
    covered = F.aggregate(
        starts,
        F.struct(F.lit(-5).cast("long").alias("last"), F.lit(0).cast("long").alias("n")),
        lambda acc, s: F.struct(s.alias("last"), (acc["n"] + F.least(F.lit(5).cast("long"), s - acc["last"])).alias("n")),
        lambda acc: acc["n"],
    )
    lines, n = F.col("__lines"), F.greatest(F.col("n_words"), F.lit(1))
    out = out.withColumns(
        {
            "word_chars": F.when(F.col("n_words") > 0, F.length("__joined") - F.col("n_words") + 1).otherwise(0).cast("long"),
            "n_symbols": F.length(F.translate("__marks", "!", "")).cast("long"),
            "n_bangs": (F.length("__marks") - F.length(F.translate("__marks", "!", ""))).cast("long"),
            "n_lines": F.size(lines).cast("long"),
            "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
            "n_repeat_words": F.coalesce(covered, F.lit(0).cast("long")),
            "__ellipses": F.size(F.filter(lines, lambda x: F.rtrim(x).endswith("..."))),
            "__bullets": F.size(F.filter(lines, lambda x: x.rlike(r"^[\x20\x09-\x0D]*[-*•‣●]"))),
        }
    )
    n_lines = F.greatest(F.col("n_lines"), F.lit(1))
    out = out.withColumns(
        {
            "mean_word_chars": F.col("word_chars") / n,
            "symbol_ratio": F.col("n_symbols") / n,
            "bang_ratio": F.col("n_bangs") / n,
            "stop_ratio": F.col("n_stop_words") / n,
            "dup_line_ratio": F.col("n_dup_lines") / n_lines,
            "ellipsis_line_ratio": F.col("__ellipses") / n_lines,
            "bullet_line_ratio": F.col("__bullets") / n_lines,
            "base_failed": (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")),
        }
    )
    out = out.withColumn("broken", compile_rules(rules))
    return out.withColumn("kept", ~F.col("base_failed") & (F.size("broken") == 0))


def quality_rules(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", rules: Sequence[Rule] = RULES) -> DataFrame:
    """One row per input row: id, counts, broken rules (comma-joined) and ``kept``."""
    out = measure(df, text_col, id_col, rules).select(
        F.col("__id").alias(id_col),
        *("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"),
        *("n_stop_words", "n_bangs", "n_lines"),
        F.array_join("broken", ",").alias("broken_rules"),
    )
    return fenced(out)


def quality_filter(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", rules: Sequence[Rule] = RULES) -> DataFrame:
    """The rows that the rules keep, with all their columns."""
    return keep_where(measure(df, text_col, id_col, rules), F.col("kept"))
