"""The detailed table of sub-sectors, its parts and its texts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import fixed_text, grouped_text, ratio, total
from ..functions.rules import name
from ..operators.quantile import attach, bin_counts, selected
from ..operators.ranking import argmax, top_rows
from ..schema import POSTINGS, PostingColumns
from .reduced import medians, measures, reduce_postings, rolled_up
from .titles import frequent_titles

ALL = "all"
MOST_COMPETITIVE = "most_competitive"
MOST_VACANCIES = "most_vacancies"

# Fixed value: a difference in mean years up to this counts as similar.
SIMILAR_YEARS = 0.2

# Display name of every column of the report, in its order.
DISPLAY_NAMES = {
    "category": "Sub-sector",
    "sector": "Parent Broad Sector",
    "vacancies": "Vacancies",
    "pct_vacancies": "% Share Vacs",
    "applications": "Total App",
    "pct_applications": "% Share Apps",
    "apps_per_vac": "Apps/Vac",
    "median_salary": "Median $",
    "salary_vs_sector": "vs. Broad Sector",
    "parent_median": "Broad Sector Median",
    "avg_exp": "Avg Exp",
    "exp_vs_sector": "vs. Sector Exp",
    "parent_avg_exp": "Broad Sector Avg Exp",
    "top_seniority": "Most Popular Seniority",
    "views": "Total Views",
    "views_per_post": "Views per Post",
    "job_reposts": "Total Reposts",
    "pct_reposts": "Job Repost Rate",
    "titles": "Most Frequent Roles",
}


def market_totals(postings: DataFrame, c: PostingColumns = POSTINGS) -> DataFrame:
    """Total vacancies and applications, 1 in place of 0: safe denominators."""
    return postings.agg(
        _or_one(F.sum(c.vacancies)).alias("total_vacancies"),
        _or_one(F.sum(c.applications)).alias("total_applications"),
    )


def _or_one(sum_: Column) -> Column:
    return F.coalesce(F.nullif(sum_, F.lit(0)), F.lit(1))


def parent_benchmarks(postings: DataFrame, c: PostingColumns = POSTINGS) -> DataFrame:
    """Median salary and mean experience of every sector."""
    years = ["_years", "_with_years"]
    bins = bin_counts(postings, [c.sector], c.salary, [measures(c)[n].alias(n) for n in years])
    means = rolled_up(bins, [c.sector], years).withColumn(
        "parent_avg_exp", ratio("_years", "_with_years", "null")
    )
    medians = selected(postings, bins, [c.sector], c.salary, {"parent_median": 0.5}, "linear")
    return attach(means, medians, [c.sector]).select(c.sector, "parent_median", "parent_avg_exp")


def top_seniority(postings: DataFrame, c: PostingColumns = POSTINGS) -> DataFrame:
    """Seniority with the most applications in every sub-sector."""
    sums = postings.groupBy(c.category, c.level).agg(total(c.applications).alias("applications"))
    return argmax(sums, [c.category], by="applications", pick=c.level).select(
        c.category, F.col(c.level).alias("top_seniority")
    )


def _sums(reduced: DataFrame, c: PostingColumns) -> DataFrame:
    """All sums of the table from the reduction of the postings.

    Parent means, the leading seniority and the market totals are windows over
    few rows instead of further scans.
    """
    levels = [c.category, c.sector, c.level]
    fine = rolled_up(reduced.repartition(c.category), levels, list(measures(c)))
    at_level = F.sum("applications").over(Window.partitionBy(c.category, c.level))
    leading = F.min(F.struct((-F.col("_at_level")).alias("neg"), F.col(c.level).alias("pick")))
    rows = (
        fine.withColumn("_at_level", at_level)
        .withColumn("_leading", leading.over(Window.partitionBy(c.category)))
        .groupBy(c.category, c.sector)
        .agg(
            *[F.sum(n).alias(n) for n in measures(c)],
            F.min("_leading.pick").alias("top_seniority"),
        )
    )
    sector = f"OVER (PARTITION BY {name(c.sector)})"
    years, with_years = f"sum(_years) {sector}", f"sum(_with_years) {sector}"
    return rows.withColumns(
        {
            "avg_exp": ratio("_years", "_with_years", "null"),
            "parent_avg_exp": ratio(years, with_years, "null"),
            "_all_vacancies": _or_one(F.expr("sum(vacancies) OVER ()")),
            "_all_applications": _or_one(F.expr("sum(applications) OVER ()")),
        }
    )


def sectoral_table(
    postings: DataFrame,
    mode: str = ALL,
    categories: Sequence[str] | None = None,
    n: int = 10,
    titles: bool = True,
    c: PostingColumns = POSTINGS,
    reduced: DataFrame | None = None,
    pay: DataFrame | None = None,
) -> DataFrame:
    """The sectoral table with benchmarks, indicators and frequent titles.

    ``mode`` picks the rows: the ``n`` most competitive, the ``n`` with most
    vacancies, or all. ``categories`` restricts ``all`` to chosen sub-sectors
    (sorted by sector then). Shares and benchmarks always refer to everything.

    ``reduced`` (all sums, by seniority) and ``pay`` (all medians) are made
    here if they are not there already: two scans, and one for the titles.
    """
    if mode not in (ALL, MOST_COMPETITIVE, MOST_VACANCIES):
        raise ValueError(f"unknown mode {mode!r}")
    keys = [c.category, c.sector]
    if reduced is None:
        reduced = reduce_postings(postings, list(measures(c)), c=c)
    rows = _sums(reduced, c).withColumns(
        {
            "pct_vacancies": _percent("vacancies", "_all_vacancies"),
            "pct_applications": _percent("applications", "_all_applications"),
            "apps_per_vac": ratio("applications", "vacancies", "ieee", digits=1),
            "views_per_post": ratio("views", "postings", "ieee", digits=1),
            "pct_reposts": _percent("job_reposts", "postings"),
        }
    )
    if mode == MOST_COMPETITIVE:
        order = [F.col("apps_per_vac").desc(), *keys]
        rows = top_rows(rows, n, *order)
    elif mode == MOST_VACANCIES:
        order = [F.col("vacancies").desc(), *keys]
        rows = top_rows(rows, n, *order)
    elif categories is not None:
        order = [c.sector, c.category]
        rows = rows.where(F.col(c.category).isin(list(categories)) if categories else F.lit(False))
    else:
        order = keys

    rows = attach(rows, medians(postings, reduced, c=c) if pay is None else pay, keys)
    out = [
        *keys,
        "postings",
        "vacancies",
        "pct_vacancies",
        "applications",
        "pct_applications",
        "apps_per_vac",
        "median_salary",
        salary_indicator("median_salary", "parent_median").alias("salary_vs_sector"),
        "parent_median",
        "avg_exp",
        experience_indicator("avg_exp", "parent_avg_exp").alias("exp_vs_sector"),
        "parent_avg_exp",
        "top_seniority",
        "views",
        "views_per_post",
        "job_reposts",
        "pct_reposts",
    ]
    if titles:
        rows = rows.join(frequent_titles(postings, c=c), c.category, "left")
        out.append("titles")
    return rows.select(*out).orderBy(*order)


def _percent(part: str, whole: str) -> Column:
    return ratio(part, whole, "ieee", 100, 1)


def salary_indicator(own: str, parent: str) -> Column:
    """higher, lower or match; match also where one of the two is unknown."""
    diff = F.nanvl(F.col(own) - F.col(parent), F.lit(0.0))
    return (
        F.when(diff > 0, F.lit("higher")).when(diff < 0, F.lit("lower")).otherwise(F.lit("match"))
    )


def experience_indicator(own: str, parent: str) -> Column:
    """more, less or similar, with a band in which years count as similar."""
    diff = F.nanvl(F.col(own) - F.col(parent), F.lit(0.0))
    return (
        F.when(diff > SIMILAR_YEARS, F.lit("more"))
        .when(diff < -SIMILAR_YEARS, F.lit("less"))
        .otherwise(F.lit("similar"))
    )


def report(
    table: DataFrame, display_names: bool = False, c: PostingColumns = POSTINGS
) -> DataFrame:
    """The 19 columns of the report in order, under plain or display names."""
    source = {"category": c.category, "sector": c.sector}
    return table.select(
        *[
            F.col(source.get(n, n)).alias(shown if display_names else source.get(n, n))
            for n, shown in DISPLAY_NAMES.items()
        ]
    )


def formatted(table: DataFrame) -> DataFrame:
    """The table with its numbers as texts."""

    def money(column):
        known = F.col(column).isNotNull() & ~F.isnan(column)
        return F.when(known, F.concat(F.lit("S$ "), grouped_text(column, 0))).otherwise(F.lit("-"))

    def years(column):
        return F.concat(fixed_text(column, 1), F.lit(" yrs"))

    def percent(column):
        return F.concat(fixed_text(column, 1), F.lit("%"))

    def whole(column):
        return grouped_text(column, 0)

    texts = {
        "median_salary": money,
        "parent_median": money,
        "avg_exp": years,
        "parent_avg_exp": years,
        "vacancies": whole,
        "pct_vacancies": percent,
        "applications": whole,
        "pct_applications": percent,
        "views": whole,
        "job_reposts": whole,
        "apps_per_vac": fixed_text,
        "views_per_post": fixed_text,
        "pct_reposts": percent,
    }
    return table.withColumns({n: make(n) for n, make in texts.items()})


def vacancies_by_sector(postings: DataFrame, c: PostingColumns = POSTINGS) -> DataFrame:
    return postings.groupBy(c.sector).agg(total(c.vacancies).alias("vacancies"))


def vacancies_and_median(postings: DataFrame, c: PostingColumns = POSTINGS) -> DataFrame:
    """Total vacancies and the median salary over everything, one row."""
    bins = bin_counts(postings, [], c.salary, [total(c.vacancies).alias("vacancies")])
    sums = bins.agg(total("vacancies").alias("vacancies"))
    return attach(
        sums, selected(postings, bins, [], c.salary, {"median_salary": 0.5}, "linear"), []
    )


def salary_by_experience(postings: DataFrame, c: PostingColumns = POSTINGS) -> DataFrame:
    """Median salary and number of postings by required years of experience."""
    keys = [c.experience]
    bins = bin_counts(postings, keys, c.salary, [F.count(F.lit(1)).alias("postings")])
    medians = selected(postings, bins, keys, c.salary, {"median_salary": 0.5}, "linear")
    return attach(rolled_up(bins, keys, ["postings"]), medians, keys).orderBy(c.experience)
