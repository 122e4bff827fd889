"""Risk rules as data, flags and levels as column expressions.

The rules are known when the query is built, so they become one projection of
substring tests over a single lower-cased text.  A join against a rule table
would be a nested loop that multiplies wide rows.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark import fixed_values as fv


# Joins flags for a moment; no readable flag holds it.
SEPARATOR = "\x1f"


@dataclass(frozen=True)
class RiskRule:
    pattern: str
    flag: str
    kind: str = "literal"  # or "regex"; both ignore case


def keyword_flag(keyword: str) -> str:
    """Flag name of a keyword: the fixed one, else derived from its spelling."""
    derived = keyword.lower().translate(str.maketrans({" ": "_", "(": None}))
    return fv.KEYWORD_FLAGS.get(keyword, derived)


def keyword_flag_column(keyword: Column) -> Column:
    """The same naming for keywords that live in a table."""
    fixed = F.create_map(*[F.lit(x) for pair in fv.KEYWORD_FLAGS.items() for x in pair])
    return F.coalesce(F.element_at(fixed, keyword), F.translate(F.lower(keyword), " (", "_"))


DEFAULT_RULES: tuple[RiskRule, ...] = tuple(
    [RiskRule(k, keyword_flag(k)) for k in fv.HIGH_RISK_KEYWORDS + fv.MEDIUM_RISK_KEYWORDS]
    + [RiskRule(k, f) for k, f in fv.EXTRA_LITERALS.items()]
)
# Also catches a download piped into a shell with an address in between.
EXTENDED_RULES = DEFAULT_RULES + (RiskRule(fv.PIPED_SHELL_PATTERN, "remote_shell", "regex"),)


def content_flags(df: DataFrame, content: str = "content", rules=DEFAULT_RULES) -> DataFrame:
    """Add ``content_flags``: sorted distinct flags raised by the text alone."""
    lowered = df.withColumn("_lower", F.lower(F.col(content)))
    low = F.col("_lower")

    def hit(rule: RiskRule) -> Column:
        if rule.kind == "regex":
            return low.rlike("(?i)" + rule.pattern)
        return F.contains(low, F.lit(rule.pattern.lower()))

    if any(SEPARATOR in rule.flag for rule in rules):
        raise ValueError("a flag cannot hold the separator of flags")
    by_flag: dict[str, list[Column]] = {}
    for rule in rules:
        by_flag.setdefault(rule.flag, []).append(hit(rule))
    # sorted and grouped while building, so nothing is sorted or de-duplicated per row
    raised = [F.when(reduce(Column.__or__, hits), F.lit(flag)) for flag, hits in sorted(by_flag.items())]
    # concat_ws skips what is not raised and, unlike a higher-order filter, stays inside generated code
    joined = lowered.withColumn("_joined", F.concat_ws(SEPARATOR, *raised))
    listed = F.when(F.col("_joined") == "", F.array().cast("array<string>")).otherwise(F.split("_joined", SEPARATOR))
    return joined.withColumn("content_flags", listed).drop("_lower", "_joined")


def risk_flags(flags: Column, has_scripts: Column) -> Column:
    """All flags of a file: those of its text plus the one for a scripts directory."""
    with_scripts = F.array_sort(F.array_distinct(F.array_append(flags, F.lit(fv.SCRIPTS_FLAG))))
    return F.when(F.coalesce(has_scripts, F.lit(False)), with_scripts).otherwise(flags)


def risk_level(flags: Column, content_is_empty: Column | None = None) -> Column:
    high = F.array(*[F.lit(f) for f in fv.HIGH_RISK_FLAGS])
    level = F.when(F.arrays_overlap(flags, high), "high").when(F.size(flags) > 0, "medium").otherwise("low")
    return level if content_is_empty is None else F.when(content_is_empty, "unknown").otherwise(level)


def risk_description(level: Column) -> Column:
    texts = F.create_map(*[F.lit(x) for pair in fv.RISK_DESCRIPTIONS.items() for x in pair])
    return F.coalesce(F.element_at(texts, level), F.lit(fv.RISK_DESCRIPTIONS["unknown"]))


def scan(df: DataFrame, content: str = "content", has_scripts: Column | None = None, rules=DEFAULT_RULES) -> DataFrame:
    """Add ``risk_flags`` and ``risk_level``; empty text is ``unknown`` without flags."""
    empty = F.coalesce(F.col(content) == "", F.lit(True))
    flagged = content_flags(df, content, rules)
    scripts = F.lit(False) if has_scripts is None else has_scripts
    none = F.array().cast("array<string>")
    flags = F.when(empty, none).otherwise(risk_flags(F.col("content_flags"), scripts))
    return (
        flagged.withColumn("risk_flags", flags)
        .withColumn("risk_level", risk_level(F.col("risk_flags"), empty))
        .drop("content_flags")
    )
