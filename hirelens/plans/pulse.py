"""Key figures, timeline and shares: the overview."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import count_where, fixed_text, grouped_text, ratio, total
from ..functions.rules import REPOST_YES
from ..operators.ranking import share_of_total
from ..schema import DEFAULT_GRAIN, POSTINGS, PostingColumns


def _kpis(c: PostingColumns) -> list[Column]:
    return [
        total(c.vacancies).alias("vacancies"),
        total(c.applications).alias("applications"),
        total(c.views).alias("views"),
        F.count(F.lit(1)).alias("posts"),
        count_where(F.col(c.repost) == REPOST_YES, c.job_id).alias("reposts"),
    ]


def kpi_summary(postings: DataFrame, c: PostingColumns = POSTINGS) -> DataFrame:
    """Five totals and the two ratios from them, one row, also over no rows."""
    return _with_ratios(postings.agg(*_kpis(c)))


def reduced(
    postings: DataFrame, grain: str = DEFAULT_GRAIN, c: PostingColumns = POSTINGS
) -> DataFrame:
    """Postings summed to (period, PMET, sector, seniority): all that the overview needs.

    Sums keep the names of their columns, so ``timeline`` and ``apps_by_*`` take
    these rows in place of the postings; ``posts`` and ``reposts`` are counts.
    """
    return postings.groupBy(c.period(grain), c.pmet, c.sector, c.level).agg(
        *(total(n).alias(n) for n in (c.vacancies, c.applications, c.views)), *_kpis(c)[3:]
    )


def _sums_of_reduced(c: PostingColumns) -> list[Column]:
    names = {c.vacancies: "vacancies", c.applications: "applications", c.views: "views"}
    return [total(n).alias(a) for n, a in (names | {"posts": "posts", "reposts": "reposts"}).items()]


def kpi_of_reduced(rows: DataFrame, c: PostingColumns = POSTINGS) -> DataFrame:
    """``kpi_summary`` from the rows of ``reduced``."""
    return _with_ratios(rows.agg(*_sums_of_reduced(c)))


def _with_ratios(sums: DataFrame) -> DataFrame:
    return sums.withColumns(
        {
            "apps_per_vacancy": _if_positive("applications", "vacancies"),
            "views_per_post": _if_positive("views", "posts"),
        }
    )


def _if_positive(num: str, den: str) -> Column:
    return F.when(F.col(den) > 0, ratio(num, den, "zero")).otherwise(F.lit(0.0))


def kpi_cards(postings: DataFrame, c: PostingColumns = POSTINGS) -> DataFrame:
    """The key figures as (position, label, value) text rows."""
    return cards_of(kpi_summary(postings, c))


def cards_of(kpis: DataFrame) -> DataFrame:
    """The row of ``kpi_summary`` as cards."""
    # The labels of the five cards, in order.
    cards = (
        ("Total Vacancies", grouped_text("vacancies", 0)),
        ("Total Applications", grouped_text("applications", 0)),
        ("Apps/Vac", fixed_text("apps_per_vacancy", 2)),
        ("Job Reposts", grouped_text("reposts", 0)),
        ("Views/Post", fixed_text("views_per_post", 1)),
    )
    rows = [
        F.struct(F.lit(i).alias("position"), F.lit(label).alias("label"), value.alias("value"))
        for i, (label, value) in enumerate(cards, 1)
    ]
    return kpis.select(F.inline(F.array(*rows)))


def timeline_sums(
    postings: DataFrame, grain: str = DEFAULT_GRAIN, c: PostingColumns = POSTINGS
) -> DataFrame:
    """Vacancies and applications by period and PMET flag, in period order."""
    return (
        postings.groupBy(F.col(c.period(grain)).alias("period"), c.pmet)
        .agg(
            total(c.vacancies).alias("vacancies"),
            total(c.applications).alias("applications"),
        )
        .orderBy("period", c.pmet)
    )


def timeline(
    postings: DataFrame, grain: str = DEFAULT_GRAIN, c: PostingColumns = POSTINGS
) -> DataFrame:
    """The timeline with applications per vacancy, exact and as plotted."""
    rule = ("applications", "vacancies", "nan_to_zero")
    return timeline_sums(postings, grain, c).withColumns(
        {"apps_per_vacancy": ratio(*rule), "apps_per_vacancy_plotted": ratio(*rule, digits=2)}
    )


def applications_by(
    postings: DataFrame, dimension: str, c: PostingColumns = POSTINGS
) -> DataFrame:
    """Applications per value of a dimension with their share of all applications."""
    grouped = postings.groupBy(dimension).agg(total(c.applications).alias("applications"))
    return grouped.withColumn("share", share_of_total(grouped, "applications"))


def apps_by_seniority(postings: DataFrame, c: PostingColumns = POSTINGS) -> DataFrame:
    return applications_by(postings, c.level, c)


def apps_by_sector(postings: DataFrame, c: PostingColumns = POSTINGS) -> DataFrame:
    return applications_by(postings, c.sector, c)


def pulse(
    postings: DataFrame, grain: str = DEFAULT_GRAIN, c: PostingColumns = POSTINGS
) -> DataFrame:
    """Key figures, timeline and both shares from one scan, as one long table.

    ``grouping`` tells the parts apart: 3 is (period, PMET), 13 is sector,
    14 is seniority and 15 the grand total, which is there over no rows, too.
    Postings are reduced to the finest of these groups first; only those few
    rows are multiplied by the grouping sets.
    """
    return pulse_of_reduced(reduced(postings, grain, c), grain, c)


def pulse_of_reduced(
    rows: DataFrame, grain: str = DEFAULT_GRAIN, c: PostingColumns = POSTINGS
) -> DataFrame:
    """``pulse`` from the rows of ``reduced``."""
    rows = rows.withColumnRenamed(c.period(grain), "period")
    dims = ["period", c.pmet, c.sector, c.level]
    sums = _sums_of_reduced(c)
    sets = [["period", c.pmet], [c.sector], [c.level]]
    parts = rows.groupingSets([[F.col(n) for n in s] for s in sets], *dims).agg(
        F.grouping_id(*dims).alias("grouping"), *sums
    )
    nothing = [F.lit(None).cast("string").alias(n) for n in dims]
    everything = F.lit(15).cast("long").alias("grouping")
    whole = rows.agg(*sums).select("*", *nothing, everything)
    return parts.unionByName(whole)
