"""The cleaned postings as a Parquet table: build, write, read, keep in memory."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from ..functions import text
from ..operators.domains import period_bounds
from ..plans.cleaning import clean_postings, observed
from ..schema import DEFAULT_GRAIN, POSTINGS, PostingColumns, struct_of
from .raw_csv import read_raw_csv

STORED_DAY = "posted_day"


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a path (or a glob) exists on its own file system."""
    jvm = spark.sparkContext._jvm
    hadoop_path = jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = fs.globStatus(hadoop_path)
    return found is not None and len(found) > 0


def write_clean(
    postings: DataFrame,
    path: str,
    mode: str = "errorifexists",
    partition_by_year: bool = False,
    sort_within: Sequence[str] = (),
    c: PostingColumns = POSTINGS,
    clustered: bool = False,
) -> None:
    """Write cleaned postings as Parquet, straight from the executors.

    ``partition_by_year`` gives one directory per year for partition pruning.
    ``clustered`` brings the rows of a year together first, by one shuffle that
    Spark splits or merges to tasks of its advisory size: the files per year
    then follow from the data of the year, not from the number of tasks, and a
    year with most of the rows is many tasks.
    ``sort_within`` sorts each task's rows without a shuffle: sectors or
    periods then sit together, and row groups can be skipped by their min/max.
    With both, rows are sorted by year first: the writer needs that order and
    would else sort again and lose the other one.
    Low-cardinality strings are dictionary-encoded by the Parquet writer.

    The day of posting is stored besides, for :func:`stored_bounds`: Parquet
    keeps no exact minimum of a text or an INT96 time.
    """
    year = [c.period("Yearly")] if partition_by_year else []
    out = postings.withColumn(STORED_DAY, F.to_date(c.posted_at))
    if clustered:
        out = out.hint("rebalance", F.col(c.period("Yearly")))
    if sort_within:
        out = out.sortWithinPartitions(*year, *sort_within)
    writer = out.write.mode(mode)
    if partition_by_year:
        writer = writer.partitionBy(c.period("Yearly"))
    writer.parquet(path)


def stored_bounds(
    spark: SparkSession, path: str, grain: str = DEFAULT_GRAIN, c: PostingColumns = POSTINGS
) -> DataFrame:
    """``period_bounds`` of a whole table that :func:`write_clean` wrote, as one row (lo, hi).

    The first and last day come from the Parquet footers; no rows are read. Weeks
    are not padded and sort as text, so they need the rows of the first and the
    last year, and no others. A table without rows gives nulls.
    """
    lo, hi = footer_days(spark, path).first()
    table = read_clean(spark, path, c)
    if grain == "Weekly":
        # Labels start with the year, so the bounds lie in the outer years.
        years = {str(day.year) for day in (lo, hi) if day}
        return period_bounds(table.where(F.col(c.period("Yearly")).isin(*years)), grain, c)
    days = spark.createDataFrame([(lo, hi)], "lo date, hi date")
    return days.select(*(text.period_labels(n)[grain].alias(n) for n in days.columns))


def footer_days(spark: SparkSession, path: str) -> DataFrame:
    """First and last stored day, as (lo, hi), by aggregates that the Parquet reader answers.

    A session of its own carries the settings: push-down needs the reader of
    the second kind, and the caller's session stays as it is. The schema comes
    from a file: push-down finds a column in the footer by its place there.
    """
    own = spark.newSession()
    own.conf.set("spark.sql.sources.useV1SourceList", "")
    own.conf.set("spark.sql.parquet.aggregatePushdown", "true")
    days = own.read.parquet(path)
    return days.agg(F.min(STORED_DAY).alias("lo"), F.max(STORED_DAY).alias("hi"))


def read_clean(
    spark: SparkSession, path: str, c: PostingColumns = POSTINGS, all_columns: bool = False
) -> DataFrame:
    """Scan the cleaned table, cut to the columns that the reports use.

    The schema is given: no footer has to be read to plan, and year
    directories stay text instead of being inferred as numbers.
    """
    table = spark.read.schema(struct_of(c.clean_types)).parquet(path)
    return table if all_columns else table.select(*c.read_columns)


def build_clean(
    spark: SparkSession,
    csv_path: str,
    out_path: str,
    mode: str = "errorifexists",
    multi_line: bool | None = None,
    c: PostingColumns = POSTINGS,
    cleaning: Mapping[str, object] | None = None,
    counts: dict[str, int] | None = None,
    **layout,
) -> DataFrame:
    """CSV to cleaned Parquet in one job; returns the new scan.

    The job has no shuffle unless the layout is ``clustered``. ``multi_line``
    as in ``read_raw_csv``: by default a pass over the text comes first, to see
    if the files can be split.

    ``counts``, if given, is filled with what the job saw: rows read, kept, and
    dropped as outliers or for a date that cannot be read.

    ``cleaning`` holds options of ``clean_postings``, such as ``date_formats``
    for dates that are not ISO, or ``sortable_weeks``.
    """
    raw, options = read_raw_csv(spark, csv_path, c, multi_line), cleaning or {}
    seen = Observation("ingest")
    if counts is not None:
        raw = observed(raw, seen, c, options.get("date_formats", ()))
    write_clean(clean_postings(raw, c, **options), out_path, mode, c=c, **layout)
    if counts is not None:
        counts.update(seen.get)
    return read_clean(spark, out_path, c)


def ensure_clean(
    spark: SparkSession,
    csv_path: str,
    out_path: str,
    c: PostingColumns = POSTINGS,
    **options,
) -> DataFrame:
    """The cleaned table: read if it is complete, else built from the CSV.

    Only a table with its ``_SUCCESS`` marker counts as complete, so a build
    that died half-way is done again.
    """
    if path_exists(spark, f"{out_path}/_SUCCESS"):
        return read_clean(spark, out_path, c)
    if not path_exists(spark, csv_path):
        raise FileNotFoundError(f"neither {out_path} nor {csv_path} exists")
    return build_clean(spark, csv_path, out_path, "overwrite", c=c, **options)


@contextmanager
def kept(
    postings: DataFrame, level: StorageLevel = StorageLevel.MEMORY_AND_DISK
) -> Iterator[DataFrame]:
    """Keep a frame for several reports and release it afterwards.

    Worth it when more than one report reads the same filtered rows. For one
    report leave it out: the filters then go down into the Parquet scan.
    """
    held = postings.persist(level)
    try:
        yield held
    finally:
        held.unpersist()
