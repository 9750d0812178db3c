"""CSV scans of raw postings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import POSTINGS, PostingColumns, struct_of


def _options(spark: SparkSession, path: str, multi_line: bool | None) -> dict[str, str]:
    if multi_line is None:
        multi_line = not lines_are_closed(spark, path)
    # JSON inside a cell holds quotes; they are written doubled. A missing cell
    # is null and a quoted empty one an empty text, which the reader only tells
    # apart if null has a mark of its own.
    return {
        "header": "true",
        "nullValue": "\u0000",
        "quote": '"',
        "escape": '"',
        "multiLine": str(multi_line).lower(),
    }


def lines_are_closed(spark: SparkSession, path: str) -> bool:
    """Whether no cell of the CSV holds a line break, so that its files can be split.

    Quotes inside a cell are doubled. If every line holds an even number of
    them, each line starts outside a cell, by induction from the first. A stray
    single quote in an unquoted cell also gives ``False``: it is a proof, not a
    guess. One narrow pass over the text in splits, which ends early where a
    line is found; empty files are closed.
    """
    lines = spark.read.text(path)
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    return lines.where(quotes % 2 == 1).isEmpty()


def read_raw_csv(
    spark: SparkSession,
    path: str,
    c: PostingColumns = POSTINGS,
    multi_line: bool | None = None,
) -> DataFrame:
    """The 14 required columns of a CSV, by header name, bad cells as null.

    Only the header line is read up front; no pass to infer types. Further
    columns of the file may exist in any place and are not parsed; a missing
    required one fails at once. Whole numbers are read through double, so that
    ``3.0`` counts as 3.

    Large files are split if :func:`lines_are_closed` proves that no cell has a
    line break, which costs a pass over the text; else one file is one task: give
    such data as many files. ``multi_line`` says it instead, without the pass:
    ``False`` is the caller's word that no cell has a line break.
    """
    options = _options(spark, path, multi_line)
    types = c.raw_types
    header = spark.read.options(**options).csv(path).columns
    missing = [n for n in types if n not in header]
    if missing:
        raise ValueError(f"{path}: required columns are missing: {missing}")
    whole = (T.LongType(), T.IntegerType())
    as_read = {
        n: T.DoubleType() if types.get(n) in whole else types.get(n, T.StringType())
        for n in header
    }
    scan = (
        spark.read.options(**options)
        .option("mode", "PERMISSIVE")
        .option("enforceSchema", "false")  # fail when files disagree on the header
        .schema(struct_of(as_read))
        .csv(path)
    )
    return scan.select(
        *[F.col(n).try_cast(t).alias(n) if t in whole else F.col(n) for n, t in types.items()]
    )


def read_csv_where(
    spark: SparkSession,
    path: str,
    equals: dict[str, object],
    schema: T.StructType | str | None = None,
    multi_line: bool | None = None,
) -> DataFrame:
    """A CSV with parsed dates, cut to the rows where the given columns are equal.

    The predicates reach the CSV reader (``PushedFilters``). Without a schema
    types and dates are inferred, which costs one more pass over the file.
    ``multi_line`` as in :func:`read_raw_csv`.
    """
    reader = spark.read.options(**_options(spark, path, multi_line))
    reader = reader.schema(schema) if schema is not None else reader.option("inferSchema", "true")
    rows = reader.csv(path)
    for column, wanted in equals.items():
        rows = rows.where(F.col(column) == F.lit(wanted))
    return rows


def write_csv(
    df: DataFrame, path: str, mode: str = "errorifexists", compression: str = "none"
) -> None:
    """Write rows as CSV files that :func:`read_raw_csv` reads back unchanged.

    A compressed file is read by one task: meant for cells with line breaks,
    whose files cannot be split in any case.
    """
    options = {"header": True, "quote": '"', "escape": '"', "compression": compression}
    df.write.mode(mode).options(**options).csv(path)
