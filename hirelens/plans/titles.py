"""Most frequent job titles, whatever their upper and lower case."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import clean_title
from ..operators.ranking import argmax, top_per_group
from ..schema import POSTINGS, PostingColumns


def distinct_roles(
    postings: DataFrame, clean: bool = False, c: PostingColumns = POSTINGS
) -> DataFrame:
    """One row per sub-sector and lower-cased title: its dominant spelling.

    Spellings are counted first, combined before the shuffle. The counted ones
    are dealt by (sub-sector, lower-cased title) and sorted by it once; both
    halves of the next aggregate run on that. Ties go to the spelling that sorts
    first.
    ``clean`` cleans the shown title again, but not the lower-cased key.
    """
    shown = clean_title(c.title) if clean else F.col(c.title)
    spellings = (
        postings.select(
            c.category, shown.alias("title"), F.lower(c.title).alias("lower_title")
        )
        .groupBy(c.category, "lower_title", "title")
        .agg(F.count(F.lit(1)).alias("n"))
        .repartition(c.category, "lower_title")
    )
    return argmax(spellings, [c.category, "lower_title"], by="n", pick="title")


def frequent_titles(
    postings: DataFrame, k: int = 3, clean: bool = False, c: PostingColumns = POSTINGS
) -> DataFrame:
    """The ``k`` most frequent roles of each sub-sector, joined by a comma."""
    order = [F.col("n").desc(), F.col("title")]
    top = top_per_group(distinct_roles(postings, clean, c), [c.category], order, k)
    ranked = F.array_sort(F.collect_list(F.struct("rank", "title")))
    names = F.transform(ranked, lambda r: r["title"])
    return top.groupBy(c.category).agg(F.array_join(names, ", ").alias("titles"))
