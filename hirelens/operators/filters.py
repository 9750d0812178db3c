"""The parametrised filters of a report."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.rules import REPOST_NO
from ..schema import DEFAULT_GRAIN, POSTINGS, PostingColumns

ALL = "All"


@dataclass(frozen=True)
class FilterSpec:
    """What to keep. ``All`` and ``None`` mean no restriction.

    ``period_range`` is inclusive and compares the labels of ``grain`` as text.
    """

    sector: str = ALL
    pmet: str = ALL
    level: str = ALL
    exclude_reposts: bool = False
    grain: str = DEFAULT_GRAIN
    period_range: tuple[str, str] | None = None


def apply_filters(
    postings: DataFrame, spec: FilterSpec, c: PostingColumns = POSTINGS
) -> DataFrame:
    """All filters of the spec, joined by AND, as predicates the scan can take."""
    out = postings
    for column, wanted in ((c.sector, spec.sector), (c.pmet, spec.pmet), (c.level, spec.level)):
        if wanted != ALL:
            out = out.where(F.col(column) == wanted)
    if spec.exclude_reposts:
        out = out.where(F.col(c.repost) == REPOST_NO)
    if spec.period_range is not None:
        out = in_period(out, spec.grain, *spec.period_range, c=c)
    return out


def in_period(
    postings: DataFrame, grain: str, lo: str, hi: str, c: PostingColumns = POSTINGS
) -> DataFrame:
    """Rows whose period label lies between ``lo`` and ``hi``, both included.

    Every label starts with its year. So a range at any grain implies a range
    of years; it is added as a second predicate, which prunes directories
    where the table is partitioned by year and row groups where it is not.
    """
    out = postings.where(F.col(c.period(grain)).between(lo, hi))
    yearly = c.period("Yearly")
    if grain != "Yearly" and yearly in postings.columns and _has_year(lo) and _has_year(hi):
        out = out.where(F.col(yearly).between(lo[:4], hi[:4]))
    return out


def _has_year(label: str) -> bool:
    return re.match(r"\d{4}-", label) is not None


def with_categories(
    postings: DataFrame, chosen: Sequence[str], c: PostingColumns = POSTINGS
) -> DataFrame:
    """Rows of the chosen sub-sectors. An empty choice gives no rows."""
    if not chosen:
        return postings.where(F.lit(False))
    return postings.where(F.col(c.category).isin(list(chosen)))


def matching(postings: DataFrame, keys: DataFrame, on: str | list[str]) -> DataFrame:
    """Rows whose key occurs in ``keys``: a left-semi join, nothing is collected."""
    return postings.join(keys, on, "left_semi")
