"""The market map: supply, interest and competition of every sub-sector."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import ratio, total
from ..operators.ranking import top_rows, whole_frame
from ..schema import POSTINGS, PostingColumns
from .reduced import measures

# The four corners of the map, by (high interest, high supply).
ZONES = {
    (True, True): "Hotspot",
    (True, False): "Niche",
    (False, True): "Opportunity",
    (False, False): "Quiet",
}

SUMS = ["vacancies", "applications", "views", "postings"]


def market_map(postings: DataFrame, c: PostingColumns = POSTINGS) -> DataFrame:
    """One row per sub-sector. A sub-sector has one sector, so ``min`` is that one."""
    # Sums alone are hashed; a minimum of texts would sort every posting first.
    known = measures(c)
    return market_of_sums(
        postings.groupBy(c.category, c.sector).agg(*[known[n].alias(n) for n in SUMS]), c
    )


def market_of_sums(sums: DataFrame, c: PostingColumns = POSTINGS) -> DataFrame:
    """``market_map`` from sums by sub-sector and sector."""
    views = ratio("views", "postings", "ieee", digits=2)
    apps = ratio("applications", "vacancies", "ieee", digits=2)
    return (
        sums.groupBy(c.category)
        .agg(
            F.min(c.sector).alias(c.sector),
            *(F.sum(n).alias(n) for n in SUMS),
        )
        .withColumns(
            {
                "views_per_posting": F.nanvl(views, F.lit(0.0)),
                "apps_per_vacancy": F.nanvl(apps, F.lit(0.0)),
            }
        )
    )


def weighted_avg_views(postings: DataFrame, c: PostingColumns = POSTINGS) -> DataFrame:
    """Views per posting over everything, one row."""
    return postings.agg(
        total(c.views).alias("views"), F.count(c.job_id).alias("postings")
    ).select(_average_views("views", "postings"))


def _average_views(views: str, postings: str) -> Column:
    return F.coalesce(ratio(views, postings, "ieee"), F.lit(0.0)).alias("weighted_avg_views")


def most_competitive(
    market: DataFrame, n: int = 3, c: PostingColumns = POSTINGS
) -> DataFrame:
    """The sub-sectors with the most applications per vacancy."""
    return top_rows(market, n, F.col("apps_per_vacancy").desc(), F.col(c.category))


def flag_most_competitive(
    market: DataFrame, n: int = 3, c: PostingColumns = POSTINGS
) -> DataFrame:
    """The market map with a flag on its ``n`` most competitive sub-sectors.

    The map has one row per sub-sector; ranking it needs no second scan of
    the postings, as joining the flags back on would.
    """
    order = whole_frame().orderBy(F.col("apps_per_vacancy").desc(), F.col(c.category))
    return market.withColumn("top_competitive", F.row_number().over(order) <= n)


def market_zones(market: DataFrame, c: PostingColumns = POSTINGS) -> DataFrame:
    """The market map with the zone of each sub-sector.

    Interest is high above the average views over all postings, supply is high
    above the median of the vacancies.
    """
    split = market.withColumns(
        {
            "weighted_avg_views": _average_views("sum(views) OVER ()", "sum(postings) OVER ()"),
            "median_vacancies": F.median("vacancies").over(whole_frame()),
        }
    )
    interest = F.col("views_per_posting") > F.col("weighted_avg_views")
    supply = F.col("vacancies") > F.col("median_vacancies")
    zone = (
        F.when(interest & supply, F.lit(ZONES[True, True]))
        .when(interest, F.lit(ZONES[True, False]))
        .when(supply, F.lit(ZONES[False, True]))
        .otherwise(F.lit(ZONES[False, False]))
    )
    return split.withColumn("zone", zone)
