"""

Every query derives its postings from the given tables, whole, and runs one
operator of ``hirelens`` on them.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks.oracle import statements
from hirelens import POSTINGS, FilterSpec, apply_filters, clean_postings
from hirelens.functions import rules, text
from hirelens.operators import domains
from hirelens.plans import cleaning, competition, friction, market, pulse, summary, titles
from hirelens.plans.cube import build_cube, dashboard_from_cube, filter_catalogue
from hirelens.plans.dashboard import dashboard
from hirelens.schema import GRAINS
from hirelens.sources.clean_store import (
    build_clean,
    ensure_clean,
    kept,
    stored_bounds,
    write_clean,
)
from hirelens.sources.raw_csv import read_csv_where, write_csv
from hirelens.sources.shared import scratch_folder, stored
from hirelens.sources.star_tables import raw_postings

try:
    import hirelens.llm.registry as training_data
except ModuleNotFoundError as missing:  # the subpackage is optional
    if missing.name not in ("hirelens.llm", "hirelens.llm.registry", "corpus_pipeline"):
        raise
    training_data = None

C = POSTINGS
Query = Callable[[SparkSession, str], DataFrame]

# The filters of the registered filter queries.
EVERY_FILTER = FilterSpec(
    sector="Industrial & Infrastructure",
    pmet="PMET",
    level="Manager / Professional",
    exclude_reposts=True,
    grain="Quarterly",
    period_range=("1996-Q2", "2000-Q3"),
)
WEEKS = FilterSpec(grain="Weekly", period_range=("1997-W10", "1999-W2"))
NOTHING = FilterSpec(grain="Quarterly", period_range=("1900-Q1", "1900-Q2"))
# What the structure of sub-sectors and the sectoral table read of the postings.
OF_STRUCTURE = (C.category, C.sector, C.level, C.salary, C.experience, C.vacancies, C.applications)
OF_TABLE = (*OF_STRUCTURE, C.job_id, C.views, C.repost, C.title)
CHOSEN = ("Insurance", "Logistics / Supply Chain", "F&B")


def postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cleaned postings with the columns that reports read."""
    return clean_postings(raw_postings(spark, sf_dir)).select(*C.read_columns)


def _on_postings(report: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: report(postings(spark, sf_dir))


def _on_stored(columns: Sequence[str], report: Callable[[DataFrame], DataFrame]) -> Query:
    """For a report that reads its postings more than once: joined and cleaned once."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        needed = postings(spark, sf_dir).select(*columns)
        return report(stored(needed, scratch_folder(spark, "postings")))

    return run


def _on_raw(step: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: step(raw_postings(spark, sf_dir))


def _labelled(raw: DataFrame) -> DataFrame:
    """Every raw posting with its labels; nothing is filtered out."""
    dated = cleaning.with_categories(raw).withColumn(C.posted_at, text.parse_date(C.posted_text))
    return cleaning.with_labels(dated)


def _counted(df: DataFrame, *columns) -> DataFrame:
    return df.groupBy(*columns).agg(F.count(F.lit(1)).alias("postings"))


def ingest_csv_to_parquet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw postings to CSV files, those through the ingest job to Parquet, and its scan."""
    folder = scratch_folder(spark)
    write_csv(raw_postings(spark, sf_dir), f"{folder}/raw_csv")
    return build_clean(
        spark,
        f"{folder}/raw_csv",
        f"{folder}/clean",
        multi_line=False,  # no cell of these tables has a line break
        partition_by_year=True,
        sort_within=(C.sector, C.category),
    )


def ingest_if_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table built from CSV files on first use, and what a second use reads of it."""
    folder = scratch_folder(spark)
    write_csv(raw_postings(spark, sf_dir), f"{folder}/raw_csv")
    for _ in range(2):
        table = ensure_clean(spark, f"{folder}/raw_csv", f"{folder}/clean")
    return table


def ingest_line_breaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ingest job on CSV files whose titles hold line breaks, laid out by year."""
    folder = scratch_folder(spark)
    broken = F.translate(C.title, " ", "\n")
    raw = raw_postings(spark, sf_dir).withColumn(C.title, broken)
    write_csv(raw, f"{folder}/raw_csv", compression="gzip")  # a file is one task in any case
    return build_clean(
        spark,
        f"{folder}/raw_csv",
        f"{folder}/clean",
        partition_by_year=True,
        sort_within=(C.sector, C.category),
        clustered=True,
    )


def period_bounds_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First and last label of every grain of a written table, from its file statistics."""
    folder = scratch_folder(spark)
    write_clean(clean_postings(raw_postings(spark, sf_dir)), folder, partition_by_year=True)
    rows = None
    for grain in GRAINS:
        found = stored_bounds(spark, folder, grain).select(F.lit(grain).alias("grain"), "lo", "hi")
        rows = found if rows is None else rows.unionAll(found)
    return rows


def csv_filtered_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw postings without reposts, cut while their CSV files are read."""
    folder = scratch_folder(spark)
    raw = raw_postings(spark, sf_dir).select(C.job_id, C.repost_count, C.vacancies)
    write_csv(raw, f"{folder}/raw_csv")
    found = read_csv_where(
        spark, f"{folder}/raw_csv", {C.repost_count: 0}, raw.schema, multi_line=False
    )
    return _counted(found, C.vacancies)


def ingest_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the ingest job read, kept and dropped, counted by the job itself."""
    folder = scratch_folder(spark)
    write_csv(raw_postings(spark, sf_dir), f"{folder}/raw_csv")
    counts: dict[str, int] = {}
    build_clean(spark, f"{folder}/raw_csv", f"{folder}/clean", multi_line=False, counts=counts)
    return spark.createDataFrame([counts], ", ".join(f"{n} long" for n in counts))


def ingest_day_first_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ingest job on CSV files that mix day-first and ISO dates."""
    folder = scratch_folder(spark)
    iso = F.col(C.posted_text)
    day_first = F.regexp_replace(iso, r"^(\d{4})-(\d\d)-(\d\d)$", "$3/$2/$1")
    mixed = F.when(F.col(C.repost_count) == 0, iso).otherwise(day_first)
    write_csv(raw_postings(spark, sf_dir).withColumn(C.posted_text, mixed), f"{folder}/raw_csv")
    return build_clean(
        spark,
        f"{folder}/raw_csv",
        f"{folder}/clean",
        multi_line=False,
        cleaning={"date_formats": ("dd/MM/yyyy", "yyyy-MM-dd")},
    )


def kept_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two reports of postings that are kept in memory meanwhile."""
    with kept(postings(spark, sf_dir)) as held:
        sectors = pulse.apps_by_sector(held).withColumnRenamed(C.sector, "value")
        levels = pulse.apps_by_seniority(held).withColumnRenamed(C.level, "value")
        return stored(sectors.unionAll(levels), scratch_folder(spark, "kept"))


def _structure(p: DataFrame) -> DataFrame:
    return competition.contested_structure(p, 5)


# What names a row of each report of a dashboard; all its other columns are figures or texts.
REPORTED = {
    "kpi_cards": ("label",),
    "pulse": ("period", C.pmet, C.sector, C.level, "grouping"),
    "timeline": ("period", C.pmet),
    "apps_by_seniority": (C.level,),
    "apps_by_sector": (C.sector,),
    "market": (C.category,),
    "competition_top": (C.category,),
    "hierarchy": ("id",),
    "friction": (C.category,),
    "table": (C.category, C.sector),
}


def _long(parts: dict[str, DataFrame]) -> DataFrame:
    """All figures and texts of all reports as one long table."""
    parts = parts | {"table": summary.report(parts["table"])}
    long = None
    for report, names in REPORTED.items():
        cells = []
        for n, kind in parts[report].dtypes:
            if n in names:
                continue
            number = F.lit(None) if kind == "string" else F.col(n)
            words = F.col(n) if kind == "string" else F.lit(None)
            cells.append(
                F.struct(
                    F.lit(n).alias("measure"),
                    number.cast("double").alias("number"),
                    words.cast("string").alias("text"),
                )
            )
        rows = parts[report].select(
            F.lit(report).alias("report"),
            F.concat_ws("|", *names).alias("item"),
            F.inline(F.array(*cells)),
        )
        long = rows if long is None else long.unionAll(rows)
    return long


def dashboard_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All reports of one request over postings that are scanned once, with every figure."""
    with dashboard(postings(spark, sf_dir), FilterSpec(grain="Quarterly")) as parts:
        return stored(_long(parts), scratch_folder(spark, "dashboard"))


def dashboard_of_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All reports under every filter, from a roll-up of all postings."""
    every = stored(postings(spark, sf_dir), scratch_folder(spark, "postings"))
    with dashboard_from_cube(every, build_cube(every), EVERY_FILTER) as parts:
        return stored(_long(parts), scratch_folder(spark, "dashboard"))


def entry(spark: SparkSession) -> DataFrame:
    """Vacancies and applications by quarter and PMET flag on the smallest tables."""
    return pulse.timeline(postings(spark, "/root/testdata/sf0.001"), "Quarterly")


def queries() -> dict[str, Query]:
    on, raw, table = _on_postings, _on_raw, partial(_on_stored, OF_TABLE)

    def structure(report: Callable[[DataFrame], DataFrame]) -> Query:
        return _on_stored(OF_STRUCTURE, lambda p: report(_structure(p)))

    extra = training_data.queries() if training_data else {}
    return extra | {
        # cleaning
        "clean_postings": postings,
        "ingest_csv_to_parquet": ingest_csv_to_parquet,
        "ingest_if_missing": ingest_if_missing,
        "ingest_line_breaks": ingest_line_breaks,
        "ingest_counts": ingest_counts,
        "ingest_day_first_dates": ingest_day_first_dates,
        "csv_filtered_scan": csv_filtered_scan,
        "outlier_filter": raw(
            lambda r: cleaning.drop_outliers(r)
            .groupBy(C.vacancies)
            .agg(
                F.count(F.lit(1)).alias("postings"), F.min(C.max_salary).alias("min_max_salary")
            )
        ),
        "title_rules": raw(
            lambda r: _counted(
                r, F.col(C.title).alias("raw_title"), text.clean_title(C.title).alias("title")
            )
        ),
        "category_rules": raw(
            lambda r: _counted(
                r, C.categories_text, text.first_category(C.categories_text).alias(C.category)
            )
        ),
        "sector_rules": raw(lambda r: _counted(_labelled(r), C.category, C.sector)),
        "seniority_rules": raw(
            lambda r: _counted(_labelled(r), C.levels_text, C.level, C.pmet)
        ),
        "repost_flags": raw(
            lambda r: _counted(
                r, C.repost_count, rules.repost_flag(C.repost_count).alias(C.repost)
            )
        ),
        "period_labels": raw(
            lambda r: _counted(
                clean_postings(r).withColumn(
                    C.posted_text, F.date_format(C.posted_at, "yyyy-MM-dd")
                ),
                C.posted_text,
                *C.periods,
            )
        ),
        "sortable_week_labels": raw(
            lambda r: _counted(clean_postings(r, sortable_weeks=True), C.period("Weekly"))
        ),
        # domains
        "subsector_list": on(domains.subsector_list),
        "option_triples": on(domains.option_triples),
        "filter_options": on(domains.filter_options),
        "sector_map": on(domains.sector_map),
        "period_domain": on(lambda p: domains.period_domain(p, "Quarterly")),
        "filter_catalogue": on(lambda p: filter_catalogue(build_cube(p, GRAINS))),
        "period_bounds": on(lambda p: domains.period_bounds(p, "Weekly")),
        "period_bounds_stored": period_bounds_stored,
        # pulse
        "kpi_summary": on(pulse.kpi_summary),
        "kpi_of_sector": on(
            lambda p: pulse.kpi_summary(apply_filters(p, FilterSpec(sector=EVERY_FILTER.sector)))
        ),
        "kpi_of_pmet": on(
            lambda p: pulse.kpi_summary(apply_filters(p, FilterSpec(pmet=EVERY_FILTER.pmet)))
        ),
        "kpi_of_level": on(
            lambda p: pulse.kpi_summary(apply_filters(p, FilterSpec(level=EVERY_FILTER.level)))
        ),
        "kpi_without_reposts": on(
            lambda p: pulse.kpi_summary(apply_filters(p, FilterSpec(exclude_reposts=True)))
        ),
        "kpi_filtered": on(lambda p: pulse.kpi_summary(apply_filters(p, EVERY_FILTER))),
        "kpi_week_range": on(lambda p: pulse.kpi_summary(apply_filters(p, WEEKS))),
        "kpi_no_rows": on(lambda p: pulse.kpi_summary(apply_filters(p, NOTHING))),
        "kpi_cards": on(pulse.kpi_cards),
        "timeline_sums": on(pulse.timeline_sums),
        "timeline_weekly": on(lambda p: pulse.timeline(p, "Weekly")),
        "timeline_monthly": on(lambda p: pulse.timeline(p, "Monthly")),
        "timeline_quarterly": on(lambda p: pulse.timeline(p, "Quarterly")),
        "timeline_yearly": on(lambda p: pulse.timeline(p, "Yearly")),
        "apps_by_seniority": on(pulse.apps_by_seniority),
        "apps_by_sector": on(pulse.apps_by_sector),
        "pulse_grouping_sets": on(pulse.pulse),
        "dashboard_reports": dashboard_reports,
        "dashboard_from_cube": dashboard_of_cube,
        "kept_reports": kept_reports,
        "pulse_no_rows": on(lambda p: pulse.pulse(apply_filters(p, NOTHING))),
        # market
        "market_map": on(market.market_map),
        "weighted_avg_views": on(market.weighted_avg_views),
        "top3_competitive": on(lambda p: market.flag_most_competitive(market.market_map(p))),
        "most_competitive": on(lambda p: market.most_competitive(market.market_map(p))),
        "market_zones": on(lambda p: market.market_zones(market.market_map(p))),
        # competition
        "sector_level_benchmarks": on(competition.sector_level_benchmarks),
        "competition_stats": on(competition.competition_stats),
        "top5_contested": on(competition.top_contested),
        "competition_top10": on(competition.competition_top),
        "top5_postings": on(lambda p: pulse.kpi_summary(competition.postings_of_contested(p))),
        "top5_structure": structure(lambda s: s),
        "positioning_labels": structure(competition.with_positioning),
        "positioning_labels_dollar": structure(
            lambda s: competition.with_positioning(s, "dollar")
        ),
        "hierarchy": structure(
            lambda s: competition.hierarchy(competition.with_positioning(s))
        ),
        # titles
        "frequent_titles": on(titles.frequent_titles),
        "frequent_titles_recleaned": on(lambda p: titles.frequent_titles(p, clean=True)),
        "distinct_roles": on(titles.distinct_roles),
        # friction
        "sector_median": on(friction.sector_median),
        "friction_premium": on(friction.friction_premium),
        "friction_median": on(lambda p: friction.friction_median(friction.friction_premium(p))),
        "friction_zones": on(lambda p: friction.friction_zones(friction.friction_premium(p))),
        # table
        "market_totals": on(summary.market_totals),
        "parent_benchmarks": on(summary.parent_benchmarks),
        "top_seniority": on(summary.top_seniority),
        "table_all": table(summary.sectoral_table),
        "table_top_competitive": table(
            lambda p: summary.sectoral_table(p, summary.MOST_COMPETITIVE)
        ),
        "table_top_vacancies": table(lambda p: summary.sectoral_table(p, summary.MOST_VACANCIES)),
        "table_selected": table(lambda p: summary.sectoral_table(p, categories=CHOSEN)),
        "table_formatted": table(
            lambda p: summary.formatted(summary.report(summary.sectoral_table(p)))
        ),
        "vacancies_by_sector": on(summary.vacancies_by_sector),
        "vacancies_and_median": on(summary.vacancies_and_median),
        "salary_by_experience": on(summary.salary_by_experience),
    }


def oracle_sql() -> dict[str, str]:
    return statements() | (training_data.oracle_sql() if training_data else {})
