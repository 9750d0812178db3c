"""Distinct values: what can be chosen in a filter."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import DEFAULT_GRAIN, POSTINGS, PostingColumns


def subsector_list(postings: DataFrame, c: PostingColumns = POSTINGS) -> DataFrame:
    """Sorted distinct sub-sectors."""
    return postings.select(c.category).distinct().orderBy(c.category)


def option_triples(postings: DataFrame, c: PostingColumns = POSTINGS) -> DataFrame:
    """Distinct (sector, seniority, PMET) combinations."""
    return postings.select(c.sector, c.level, c.pmet).distinct()


def filter_options(postings: DataFrame, c: PostingColumns = POSTINGS) -> DataFrame:
    """Sorted distinct values of each of the three dimensions, as (dimension, value).

    The postings are scanned once, for the triples; the rest works on those.
    """
    dims = [
        F.struct(F.lit(name).alias("dimension"), F.col(column).alias("value"))
        for name, column in (("sector", c.sector), ("level", c.level), ("pmet", c.pmet))
    ]
    return (
        option_triples(postings, c)
        .select(F.inline(F.array(*dims)))
        .distinct()
        .orderBy("dimension", "value")
    )


def sector_map(postings: DataFrame, c: PostingColumns = POSTINGS) -> DataFrame:
    """Each sector with its sorted sub-sectors, joined by a comma.

    The pairs are made distinct first, so the list is built from names that
    occur once each and not from rows.
    """
    names = F.sort_array(F.collect_list(c.category))
    return (
        postings.select(c.sector, c.category)
        .distinct()
        .groupBy(c.sector)
        .agg(F.array_join(names, ", ").alias("categories"))
        .orderBy(c.sector)
    )


def period_domain(
    postings: DataFrame, grain: str = DEFAULT_GRAIN, c: PostingColumns = POSTINGS
) -> DataFrame:
    """Sorted distinct labels of a grain, in text order."""
    return (
        postings.select(F.col(c.period(grain)).alias("period")).distinct().orderBy("period")
    )


def period_bounds(
    postings: DataFrame, grain: str = DEFAULT_GRAIN, c: PostingColumns = POSTINGS
) -> DataFrame:
    """First and last label of a grain in text order: the default range."""
    label = c.period(grain)
    return postings.agg(F.min(label).alias("lo"), F.max(label).alias("hi"))
