"""One reduction of the postings that several reports are derived from.

A row stands for a sub-sector, its sector, a seniority and a bin of the salary.
It carries sums and the number of salaries, so everything above it is a sum of
its rows: sectors, totals, ranks, and the bins that hold a median or quartile.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import count_where, total
from ..functions.rules import REPOST_YES
from ..operators.quantile import bin_counts, quantiles_with_parent
from ..schema import POSTINGS, PostingColumns
from ..sources.shared import scratch_folder, stored

MEDIANS = {"median_salary": ("parent_median", 0.5)}


def measures(c: PostingColumns = POSTINGS) -> dict[str, Column]:
    """The sums that a reduction may carry."""
    return {
        "postings": F.count(c.job_id),
        "vacancies": total(c.vacancies),
        "applications": total(c.applications),
        "views": total(c.views),
        "job_reposts": count_where(F.col(c.repost) == REPOST_YES),
        "_years": total(c.experience),
        "_with_years": F.count(c.experience),
    }


def reduce_postings(
    postings: DataFrame,
    sums: Sequence[str],
    by_level: bool = True,
    c: PostingColumns = POSTINGS,
) -> DataFrame:
    """(sub-sector, sector, seniority if asked for, _bin, sums, n), written when called."""
    keys = [c.category, c.sector, *([c.level] if by_level else [])]
    known = measures(c)
    return bin_counts(postings, keys, c.salary, [known[n].alias(n) for n in sums])


def rolled_up(reduced: DataFrame, keys: Sequence[str], sums: Sequence[str]) -> DataFrame:
    """The sums of a reduction at a coarser level."""
    return reduced.groupBy(*keys).agg(*[F.sum(n).alias(n) for n in sums])


def medians(
    postings: DataFrame,
    reduced: DataFrame,
    only: DataFrame | None = None,
    c: PostingColumns = POSTINGS,
) -> DataFrame:
    """Median salary of every sub-sector, or of those in ``only``, and of its sector."""
    return quantiles_with_parent(
        postings, [c.category], [c.sector], c.salary, MEDIANS, "linear", reduced, only
    )


def stored_medians(
    postings: DataFrame, reduced: DataFrame, c: PostingColumns = POSTINGS
) -> DataFrame:
    """The medians of all sub-sectors, written when called, for reports that share them."""
    found = medians(postings, reduced, None, c)
    return stored(found, scratch_folder(postings.sparkSession, "medians"))
