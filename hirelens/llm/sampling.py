"""Bounded samples that do not depend on how rows are laid out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = 1 << 30


def small_hashes(df: DataFrame, hashed: Column, total: int, rows: int) -> DataFrame:
    """``df`` cut to about ``rows`` of ``total`` distinct hashes (1.3 times as many), one row each.

    The cut is a plain filter; sorting and a limit may follow on what is left.
    """
    share = min(1.0, 1.3 * (rows + 20) / max(total, 1))
    place = F.pmod(hashed, F.lit(SPACE))
    chosen = df if share >= 1 else df.where(place < int(share * SPACE))
    return chosen.withColumn("__hash", hashed).dropDuplicates(["__hash"])
