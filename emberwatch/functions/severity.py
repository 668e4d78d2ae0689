"""Severity words, ranks and scores as Column expressions (SCA-04, SCA-05, SCA-06)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Canonical levels in rising order.
LEVELS = ("informational", "low", "medium", "high", "critical")

# Words accepted by the parsers.
PARSER_WORDS = {
    "critical": "critical", "fatal": "critical", "emerg": "critical", "emergency": "critical",
    "alert": "critical", "crit": "critical",
    "high": "high", "err": "high", "error": "high", "sev1": "high", "p1": "high",
    "medium": "medium", "med": "medium", "warn": "medium", "warning": "medium",
    "sev2": "medium", "p2": "medium",
    "low": "low", "notice": "low", "info": "low", "informational": "low", "sev3": "low", "p3": "low",
    "debug": "informational", "trace": "informational",
}

# Words and numbers accepted in detection rules.
RULE_WORDS = {
    "critical": "critical", "crit": "critical", "high": "high", "medium": "medium", "med": "medium",
    "low": "low", "informational": "informational", "info": "informational",
    "1": "critical", "2": "high", "3": "medium", "4": "low", "5": "informational",
}

# Weight of a level in risk scores.
LEVEL_SCORES = {"critical": 1.0, "high": 0.8, "medium": 0.5, "low": 0.3, "informational": 0.1}


def as_col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def lookup(c: Column | str, table: dict, default=None) -> Column:
    """CASE over a small fixed table; stays inside whole-stage codegen."""
    c = as_col(c)
    grouped: dict = {}
    for key, value in table.items():
        grouped.setdefault(value, []).append(key)
    out = None
    for value, keys in grouped.items():
        cond = c.isin(*keys)
        out = F.when(cond, F.lit(value)) if out is None else out.when(cond, F.lit(value))
    return out.otherwise(default if isinstance(default, Column) else F.lit(default))


def map_severity(c: Column | str, default: str = "low", number: Column | None = None) -> Column:
    """Parser mapping; ``number`` is the value as int where the payload held a JSON number."""
    text = F.lower(F.trim(as_col(c)))
    words = lookup(text, PARSER_WORDS, default)
    if number is None:
        return words
    return (
        F.when(number.isNull(), words)
        .when(number <= 1, "critical").when(number == 2, "high").when(number == 3, "medium")
        .otherwise("low")
    )


def rule_severity(c: Column | str) -> Column:
    return lookup(F.lower(F.trim(as_col(c))), RULE_WORDS, "medium")


def severity_rank(c: Column | str, default: int | None = 0) -> Column:
    return lookup(as_col(c), {name: i for i, name in enumerate(LEVELS)}, default)


def severity_name(rank: Column | str) -> Column:
    return lookup(as_col(rank), dict(enumerate(LEVELS)), "informational")


def severity_score(c: Column | str, default: float = 0.5) -> Column:
    return lookup(as_col(c), LEVEL_SCORES, default)
