"""Titles, embedded category names, dates and period labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .rules import literal, name

# Patterns and the default of the text clean-up.
LEADING_JUNK = r"^[^a-zA-Z0-9]+"
BLANKS = r"(?U)\s+"  # (?U): Unicode blanks such as U+00A0 count as blanks
CATEGORY_NAME = r'(?U)"category":\s*"([^"]+)"'
CATEGORY_DEFAULT = "General / Others"


def clean_title(title: str) -> Column:
    """Strip leading non-alphanumerics, collapse blanks, trim; may become ''."""
    stripped = f"regexp_replace({name(title)}, {literal(LEADING_JUNK)}, '')"
    return F.expr(f"trim(regexp_replace({stripped}, {literal(BLANKS)}, ' '))")


def first_category(text: str) -> Column:
    """First category name inside JSON-like text, or the default.

    The text may use a doubled single quote where JSON has a double quote, so
    it need not be valid JSON: a pattern is matched instead of parsing it.
    """
    doubled, quote = literal("''"), literal('"')
    quoted = f"replace(cast({name(text)} AS string), {doubled}, {quote})"
    found = f"regexp_extract({quoted}, {literal(CATEGORY_NAME)}, 1)"
    return F.expr(f"coalesce(nullif({found}, ''), {literal(CATEGORY_DEFAULT)})")


def parse_date(text: str, formats: tuple[str, ...] = ()) -> Column:
    """Timestamp of a text, null where it cannot be read.

    Without ``formats`` the text has to start with a full ISO date; else the
    first format that fits is used. (The cast behind the ISO case also takes a
    bare year, or a time of day, which would become today's date: both lack
    the two dashes.)
    """
    c = name(text)
    if formats:
        tries = ", ".join(f"try_to_timestamp({c}, {literal(f)})" for f in formats)
        return F.expr(f"coalesce({tries})")
    dashes = f"substr(ltrim({c}), 5, 1) = '-' AND locate('-', ltrim({c}), 6) > 0"
    return F.expr(f"CASE WHEN {dashes} THEN try_to_timestamp({c}) END")


def period_labels(ts: str, sortable_weeks: bool = False) -> dict[str, Column]:
    """Label column per grain.

    The week label joins the *calendar* year with the ISO week and is not
    padded, so it sorts as text (W10 before W2). ``sortable_weeks`` pads it.
    """
    c = name(ts)
    week = f"lpad(weekofyear({c}), 2, '0')" if sortable_weeks else f"weekofyear({c})"
    labels = {
        "Weekly": f"concat(year({c}), '-W', {week})",
        "Monthly": f"date_format({c}, 'yyyy-MM')",
        "Quarterly": f"concat(year({c}), '-Q', quarter({c}))",
        "Yearly": f"cast(year({c}) AS string)",
    }
    return {grain: F.expr(sql) for grain, sql in labels.items()}
