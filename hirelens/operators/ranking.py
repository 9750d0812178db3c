"""Top-k over a frame and within groups, always with a total order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def whole_frame() -> WindowSpec:
    """A window over all rows of a frame, in one task.

    Used only on frames that hold one row per sector, level or sub-sector,
    never on postings.
    """
    return Window.partitionBy()


def top_rows(df: DataFrame, n: int, *order: Column | str) -> DataFrame:
    """The first ``n`` rows: each task keeps ``n``, the rest is a merge."""
    return df.orderBy(*order).limit(n)


def top_per_group(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, rank: str = "rank"
) -> DataFrame:
    """The first ``n`` rows of each group, with their rank.

    The limit on ``row_number`` is applied on the map side too, so that each
    task sends at most ``n`` rows of a group, however large the group is.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= n)


def argmax(df: DataFrame, keys: Sequence[str], by: str, pick: str) -> DataFrame:
    """Per group the ``pick`` with the highest ``by``; ties go to the lowest ``pick``.

    A minimum of texts, for which Spark sorts the rows by their keys first; a
    caller with many rows deals them by the keys before, so that they are
    sorted once. Also returns the winning ``by``.
    """
    best = F.min(F.struct((-F.col(by)).alias("neg"), F.col(pick).alias("pick")))
    return (
        df.groupBy(*keys)
        .agg(best.alias("_best"))
        .select(
            *keys,
            F.col("_best.pick").alias(pick),
            (-F.col("_best.neg")).alias(by),
        )
    )


def share_of_total(df: DataFrame, value: str) -> Column:
    """A group's part of the sum over all groups; 0 where that sum is 0."""
    whole = F.sum(value).over(whole_frame())
    return F.coalesce(F.try_divide(F.col(value).cast("double"), whole), F.lit(0.0))
