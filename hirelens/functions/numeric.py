"""Ratios, rounding and number-to-text with the rules the reports rely on.

All of these are plain column expressions: they stay inside whole-stage
code generation and never call Python per row. Operands are SQL expressions,
mostly just column names; the ``_sql`` functions return such an expression.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

def total(col: str | Column) -> Column:
    """Sum that is 0, not null, over no rows or only nulls."""
    return F.coalesce(F.sum(col), F.lit(0))


def count_where(condition: Column, col: str | Column | None = None) -> Column:
    """Rows (or non-null values of ``col``) for which the condition holds."""
    counted = F.lit(1) if col is None else F.col(col) if isinstance(col, str) else col
    return F.count(F.when(condition, counted))


def ratio_sql(num: str, den: str, on_zero: str = "ieee") -> str:
    """Floating-point quotient with an explicit rule for a zero denominator.

    ``ieee``        x/0 is +-infinity and 0/0 is NaN
    ``nan_to_zero`` x/0 is +-infinity and 0/0 is 0
    ``null``        x/0 is null
    ``zero``        x/0, null/x and x/null are all 0
    """
    n, d = f"double({num})", f"double({den})"
    quotient = f"try_divide({n}, {d})"
    if on_zero == "null":
        return quotient
    if on_zero == "zero":
        return f"coalesce({quotient}, 0D)"
    if on_zero not in ("ieee", "nan_to_zero"):
        raise ValueError(f"unknown rule {on_zero!r}")
    undefined = "0D" if on_zero == "nan_to_zero" else "double('NaN')"
    infinite = f"WHEN {n} > 0 THEN double('Infinity') WHEN {n} < 0 THEN -double('Infinity')"
    at_zero = f"CASE {infinite} WHEN {n} = 0 THEN {undefined} END"
    return f"CASE WHEN {d} = 0 THEN {at_zero} ELSE {quotient} END"


def round_sql(value: str, digits: int) -> str:
    """Round to ``digits`` decimals, halves to the even neighbour."""
    scale = f"{float(10**digits)!r}D"
    return f"(rint(({value}) * {scale}) / {scale})"


def ratio(
    num: str, den: str, on_zero: str = "ieee", times: int = 1, digits: int | None = None
) -> Column:
    """``ratio_sql`` as a column, optionally multiplied (percentages) and rounded."""
    sql = ratio_sql(num, den, on_zero)
    if times != 1:
        sql = f"({sql}) * {times}"
    return F.expr(sql if digits is None else round_sql(sql, digits))


def round_even(value: str, digits: int) -> Column:
    return F.expr(round_sql(value, digits))


def _finite_text(value: str, text: str) -> Column:
    return F.expr(
        f"CASE WHEN {value} IS NULL OR isnan({value}) THEN 'nan' "
        f"WHEN {value} = double('Infinity') THEN 'inf' "
        f"WHEN {value} = -double('Infinity') THEN '-inf' ELSE {text} END"
    )


def grouped_text(value: str, digits: int = 0) -> Column:
    """``1,234.5``: thousands separators, fixed decimals; null and NaN print as nan."""
    v = f"double({value})"
    return _finite_text(v, f"format_number({v}, {digits})")


def fixed_text(value: str, digits: int = 1) -> Column:
    """``1234.5``: fixed decimals without separators; null and NaN print as nan."""
    v = f"double({value})"
    return _finite_text(v, f"translate(format_number({v}, {digits}), ',', '')")
