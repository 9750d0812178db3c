"""Raw postings to cleaned postings: one narrow plan, no shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..functions import rules, text
from ..schema import GRAINS, POSTINGS, PostingColumns

# Fixed value: postings with this many vacancies or more are bulk-hire outliers.
BULK_VACANCIES = 10


def drop_outliers(raw: DataFrame, c: PostingColumns = POSTINGS) -> DataFrame:
    """Keep postings with few vacancies (0 included) and a maximum salary above 0."""
    return raw.where((F.col(c.vacancies) < BULK_VACANCIES) & (F.col(c.max_salary) > 0))


def observed(
    raw: DataFrame,
    seen: Observation,
    c: PostingColumns = POSTINGS,
    date_formats: tuple[str, ...] = (),
) -> DataFrame:
    """``raw`` with counts taken on the way: rows, and those that cleaning will drop, by reason.

    They are there when an action on what follows has ended; nothing is scanned
    for them. A row that is dropped for two reasons counts for the first.
    """
    in_range = (F.col(c.vacancies) < BULK_VACANCIES) & (F.col(c.max_salary) > 0)
    inside = F.coalesce(in_range, F.lit(False))
    dated = text.parse_date(c.posted_text, date_formats).isNotNull()
    return raw.observe(
        seen,
        F.count(F.lit(1)).alias("rows_read"),
        F.count_if(~inside).alias("outliers"),
        F.count_if(inside & ~dated).alias("unreadable_dates"),
        F.count_if(inside & dated).alias("rows_kept"),
        F.count_if(F.col(c.salary).isNull()).alias("without_salary"),
    )


def with_categories(postings: DataFrame, c: PostingColumns = POSTINGS) -> DataFrame:
    """Add the sub-sector: the first embedded category."""
    return postings.withColumn(c.category, text.first_category(c.categories_text))


def with_labels(
    postings: DataFrame, c: PostingColumns = POSTINGS, sortable_weeks: bool = False
) -> DataFrame:
    """Add sector, PMET flag, seniority and the label of every grain.

    PMET and seniority are decided independently of each other. Lower-casing
    happens once per row, in front of all the rules.
    """
    periods = text.period_labels(c.posted_at, sortable_weeks)
    return (
        postings.withColumns(
            {
                "_category": F.lower(c.category),
                "_levels": F.lower(F.col(c.levels_text).cast("string")),
            }
        )
        .withColumns(
            {
                c.sector: rules.sector_of("_category"),
                c.pmet: rules.pmet_of("_levels"),
                c.level: rules.seniority_of("_levels"),
            }
            | {c.period(g): periods[g] for g in GRAINS}
        )
        .drop("_category", "_levels")
    )


def clean_postings(
    raw: DataFrame,
    c: PostingColumns = POSTINGS,
    date_formats: tuple[str, ...] = (),
    sortable_weeks: bool = False,
) -> DataFrame:
    """The whole cleaning pipeline; the columns are those of ``c.clean_types``."""
    dated = (
        drop_outliers(raw, c)
        .withColumns(
            {
                c.posted_at: text.parse_date(c.posted_text, date_formats),
                c.title: text.clean_title(c.title),
                c.repost: rules.repost_flag(c.repost_count),
                c.category: text.first_category(c.categories_text),
            }
        )
        .where(F.col(c.posted_at).isNotNull())
    )
    return with_labels(dated, c, sortable_weeks).select(*c.clean_types)
