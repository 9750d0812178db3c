"""Repost friction and pay premium of the sub-sectors with most vacancies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import ratio, ratio_sql, round_even
from ..operators.quantile import attach, exact_median
from ..operators.ranking import top_rows, whole_frame
from ..schema import POSTINGS, PostingColumns
from .reduced import medians, reduce_postings, rolled_up

SUMS = ["postings", "vacancies", "applications", "job_reposts"]

# The quadrants, by (pays a premium, high friction).
QUADRANTS = {
    (True, True): "Talent Scarcity",
    (False, True): "Retention Risk",
    (True, False): "Premium Stability",
    (False, False): "High-Fluidity Roles",
}


def sector_median(postings: DataFrame, c: PostingColumns = POSTINGS) -> DataFrame:
    """Median salary of every sector, null where no salary is known."""
    return exact_median(postings, [c.sector], c.salary, "sector_median")


def friction_premium(
    postings: DataFrame,
    n: int = 10,
    c: PostingColumns = POSTINGS,
    reduced: DataFrame | None = None,
    pay: DataFrame | None = None,
) -> DataFrame:
    """Friction, premium over the sector median and competition, top ``n`` by vacancies.

    Salaries are read for the ``n`` sub-sectors and their sectors alone, unless
    ``pay`` holds all medians already.
    """
    keys = [c.category, c.sector]
    if reduced is None:
        reduced = reduce_postings(postings, SUMS, by_level=False, c=c)
    top = top_rows(rolled_up(reduced, keys, SUMS), n, F.col("vacancies").desc(), *keys)
    if pay is None:
        pay = medians(postings, reduced, top.select(*keys), c)
    rows = attach(top, pay, keys).withColumnsRenamed(
        {"parent_median": "sector_median", "job_reposts": "repost_count"}
    )

    premium = f"({ratio_sql('median_salary', 'sector_median', 'ieee')} - 1) * 100"
    return rows.select(
        *keys,
        "postings",
        "vacancies",
        "applications",
        "median_salary",
        "repost_count",
        "sector_median",
        round_even(premium, 2).alias("salary_premium_pct"),
        ratio("repost_count", "postings", "ieee", 100, 2).alias("friction_pct"),
        ratio("applications", "vacancies", "null", digits=2).alias("apps_per_vac"),
    ).orderBy(F.col("vacancies").desc(), *keys)


def friction_median(friction: DataFrame) -> DataFrame:
    """Median friction of the rows of a friction table (a handful), one row."""
    return friction.agg(F.median("friction_pct").alias("friction_median"))


def friction_zones(friction: DataFrame, c: PostingColumns = POSTINGS) -> DataFrame:
    """The friction table with its median and the quadrant of each row."""
    rows = friction.withColumn("friction_median", F.median("friction_pct").over(whole_frame()))
    pays = F.coalesce(F.col("salary_premium_pct") > 0, F.lit(False))
    hard = F.coalesce(F.col("friction_pct") > F.col("friction_median"), F.lit(False))
    zone = (
        F.when(pays & hard, F.lit(QUADRANTS[True, True]))
        .when(hard, F.lit(QUADRANTS[False, True]))
        .when(pays, F.lit(QUADRANTS[True, False]))
        .otherwise(F.lit(QUADRANTS[False, False]))
    )
    return rows.withColumn("zone", zone)
