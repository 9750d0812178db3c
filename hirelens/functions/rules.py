"""Ordered (pattern, label) rules for the sector and the seniority of a posting.

A rule list becomes one SQL ``CASE``: the branches are tried in order and the
rest is skipped once one fits.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# One category that is decided before any sector pattern.
SECTOR_EXCEPTIONS = {"marketing / public relations": "Others"}

# Sector patterns on the lower-cased category, first match wins.
SECTOR_RULES = (
    (
        "finance|banking|legal|accounting|consult|insurance|audit|tax|risk|compliance|professional",
        "Financial & Professional",
    ),
    (
        "health|doctor|nurs|medical|educat|social|gov|public|community",
        "Public Service, Education & Health",
    ),
    (
        "software|programming|cyber|data|it |telecom|technology|digital|information tech",
        "Modern Services (ICT)",
    ),
    (
        "manufact|engin|logistics|construct|supply|energy|shipping|warehouse|architecture",
        "Industrial & Infrastructure",
    ),
    (
        "retail|hospitality|entertainment|beauty|f&b|food|travel|tourism|events|marketing|fashion",
        "Consumer & Lifestyle",
    ),
    (
        "general management|admin|administrative|human resources",
        "HR, General Administration and Management",
    ),
)
SECTOR_DEFAULT = "Others"

# Seniority patterns on the lower-cased position levels.
SENIORITY_RULES = (
    ("fresh/entry level|junior", "Entry / Junior"),
    ("senior management", "Senior Management"),
    ("middle management|manager|professional", "Manager / Professional"),
    ("non-executive", "Others"),
)
SENIORITY_DEFAULT = "Executive / Senior Executive"

# More alternatives than these are tested as an array.
WRITTEN_OUT = 3

# The level text that makes a posting Non-PMET, and the two flags.
NON_PMET_MARK = "non-executive"
PMET, NON_PMET = "PMET", "Non-PMET"
REPOST_YES, REPOST_NO = "Y", "N"


def name(column: str) -> str:
    """A column name quoted for SQL text."""
    return "`" + column.replace("`", "``") + "`"


def literal(value: str | None) -> str:
    """A string quoted for SQL text."""
    if value is None:
        return "NULL"
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def case(branches: Iterable[tuple[str, str]], default: str) -> Column:
    """``CASE`` over (SQL condition, label) branches."""
    tests = " ".join(f"WHEN {test} THEN {literal(label)}" for test, label in branches)
    return F.expr(f"CASE {tests} ELSE {literal(default)} END")


def occurs(column: str, pattern: str) -> str:
    """SQL test whether a pattern occurs in a text column.

    A pattern made of plain alternatives is tested as substrings, which costs
    a fraction of the regular expression; any other one stays an expression.
    Many alternatives are data of one test: written out, the code that Spark
    generates for a row outgrows the 8,000 bytes that the JVM compiles.
    """
    if set(pattern) & set("\\^$.?*+()[]{}"):
        return f"{name(column)} RLIKE {literal(pattern)}"
    words = pattern.split("|")
    if len(words) > WRITTEN_OUT:
        listed = ", ".join(literal(w) for w in words)
        return f"exists(array({listed}), w -> contains({name(column)}, w))"
    return "(" + " OR ".join(f"contains({name(column)}, {literal(w)})" for w in words) + ")"


def first_match(lowered: str, rules: Iterable[tuple[str, str]], default: str) -> Column:
    """Label of the first rule whose pattern occurs in a lower-cased column.

    A null text matches no rule and gets the default.
    """
    return case(((occurs(lowered, p), label) for p, label in rules), default)


def sector_of(lowered_category: str) -> Column:
    column = name(lowered_category)
    branches = [(f"{column} = {literal(c)}", label) for c, label in SECTOR_EXCEPTIONS.items()]
    branches += [(occurs(lowered_category, p), label) for p, label in SECTOR_RULES]
    return case(branches, SECTOR_DEFAULT)


def seniority_of(lowered_levels: str) -> Column:
    return first_match(lowered_levels, SENIORITY_RULES, SENIORITY_DEFAULT)


def pmet_of(lowered_levels: str) -> Column:
    marked = f"contains({name(lowered_levels)}, {literal(NON_PMET_MARK)})"
    return case([(marked, NON_PMET)], PMET)


def repost_flag(repost_count: str) -> Column:
    return case([(f"{name(repost_count)} > 0", REPOST_YES)], REPOST_NO)
