"""SimHash near-dedup by a segment-popcount embedding.

A fingerprint becomes the vector of the bit counts of its 16 four-bit segments.
The Manhattan distance of two vectors never exceeds the bits that differ. The
vectors lie on a grid: two of them at distance 2 or less share a grid point that
is at distance 1 or less from both, so an equi-join on those points is the whole
range join. What meets there is verified bit by bit.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hirelens.llm.links import components
from hirelens.sources.shared import scratch_folder, stored

SEED = 42
BLOCK = 1 << 15
# A grid point with more fingerprints than this links them through shared bit neighbours.
PAIRED = 24
# A fingerprint with more than one in so many of all rows is sent to all tasks.
HOT_SHARE = 1024


def fingerprint(text: str, words: int = 3) -> int:
    """64 majority bits of the shingles' XXH64, as a signed number; 0 without words."""
    from xxhash import xxh64_intdigest as digest

    found = text.encode().lower().split()  # bytes: ASCII letters and blanks only
    if not found:
        return 0
    runs = zip(*(found[i:] for i in range(words))) if len(found) >= words else iter([found])
    ones, n = np.zeros(64, np.int64), 0
    while block := [digest(b" ".join(run), SEED) for run in islice(runs, BLOCK)]:
        bits = np.unpackbits(np.array(block, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
        n += len(block)
    value = np.packbits(2 * ones > n, bitorder="little").view("<u8")[0]
    return int(value.astype(np.int64))


def fingerprint_column(text: str, words: int = 3) -> Column:
    def marked(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([fingerprint(t, words) for t in texts], dtype="int64")

    return F.pandas_udf(marked, "long")(F.coalesce(text, F.lit("")))


def _counts(fp: Column) -> Column:
    """The bit counts of the 16 segments, four bits each: the vector in one number."""
    ones = F.lit(0x1111111111111111)
    return sum(
        (F.shiftrightunsigned(fp, j).bitwiseAND(ones) for j in range(1, 4)), fp.bitwiseAND(ones)
    )


def _grid_points(fp: Column) -> Column:
    """The vector's own grid point and those one step away; a count lies in 0 to 4."""
    own = _counts(fp)
    points = [own]
    for i in range(16):
        at = F.shiftrightunsigned(own, 4 * i).bitwiseAND(F.lit(15))
        points += [F.when(at < 4, own + (1 << 4 * i)), F.when(at > 0, own - (1 << 4 * i))]
    return F.array_compact(F.array(*points))


def _bit_neighbours(fp: Column) -> Column:
    """``fp`` and its 64 neighbours at one bit."""
    flips = [1 << i for i in range(63)] + [-(1 << 63)]
    return F.array(fp, *(fp.bitwiseXOR(F.lit(x)) for x in flips))


def near_links(fingerprints: DataFrame, max_bits: int = 2) -> DataFrame:
    """Links (a, b) that connect the fingerprints (fp, distinct) as all true links do.

    Every returned link differs in at most ``max_bits`` (0 to 2) bits. Pairs
    that meet at a grid point of few fingerprints are verified one by one. Where
    many meet, two of them within 2 bits share a neighbour at 1 bit, and all
    that share one are within 2 bits of each other: each is linked to the
    smallest there, so a dense group costs 65 rows each instead of all pairs.
    """
    if not 0 <= max_bits <= 2:
        raise ValueError("max_bits must be 0, 1 or 2: grid points one step away reach no farther")
    near = lambda a, b: F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= max_bits
    points = fingerprints.select("fp", F.explode(_grid_points(F.col("fp"))).alias("point"))
    meeting = points.groupBy("point").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    points = stored(
        points.join(meeting, "point"), scratch_folder(fingerprints.sparkSession, "points")
    )
    few = points.where(F.col("n") <= PAIRED)
    pairs = (
        few.select("point", F.col("fp").alias("a"))
        .join(few.select("point", F.col("fp").alias("b")), "point")
        .where((F.col("a") < F.col("b")) & near("a", "b"))
        .select("a", "b")
    )
    many = points.where(F.col("n") > PAIRED).select("fp").distinct()
    if max_bits < 2:  # a shared neighbour says 2 bits; for fewer, the neighbour itself must be there
        steps = many.select("fp", F.explode(_bit_neighbours(F.col("fp"))).alias("b"))
        dense = steps.join(many.select(F.col("fp").alias("b")), "b").select(F.col("fp").alias("a"), "b")
        return pairs.unionAll(dense.where("a < b").where(near("a", "b"))).distinct()
    steps = many.select("fp", F.explode(_bit_neighbours(F.col("fp"))).alias("shared"))
    low = steps.groupBy("shared").agg(F.min("fp").alias("low"), F.count(F.lit(1)).alias("n"))
    dense = (
        steps.join(low.where("n > 1"), "shared")
        .where("fp <> low")
        .select(F.col("low").alias("a"), F.col("fp").alias("b"))
    )
    return pairs.unionAll(dense).distinct()


def _grouped(docs: DataFrame, words: int, max_bits: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, fp) of all rows, and (fp, first, n, component_id) of all fingerprints, both written."""
    spark = docs.sparkSession
    marked = stored(
        docs.select("doc_id", fingerprint_column("text", words).alias("fp")),
        scratch_folder(spark, "fingerprints"),
    )
    first = stored(
        marked.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")),
        scratch_folder(spark, "distinct"),
    )
    groups = components(near_links(first.select("fp"), max_bits))
    named = first.join(groups.withColumnRenamed("node", "fp"), "fp", "left").withColumn(
        "component", F.coalesce("component", "fp")
    )
    smallest = named.groupBy("component").agg(F.min("first").alias("component_id"))
    by_fingerprint = named.join(smallest, "component").drop("component")
    return marked, stored(by_fingerprint, scratch_folder(spark, "groups"))


def near_groups(docs: DataFrame, *, words: int = 3, max_bits: int = 2) -> DataFrame:
    """(doc_id, fp, component_id) for every row of ``docs`` (doc_id, text).

    component_id is the smallest doc_id that links reach. Texts without words
    (null, empty, blanks) have fingerprint 0 and link like any other. Repeated
    rows come back as often; a null doc_id is never the smallest of a group
    that has other ids. No rows give no rows.
    """
    marked, by_fingerprint = _grouped(docs, words, max_bits)
    rows = by_fingerprint.agg(F.sum("n")).first()[0] or 0
    # Fewer than HOT_SHARE fingerprints can have more than that share of all rows: they are sent
    # to all tasks, and no other fingerprint is much for the task it is dealt to.
    hot = F.col("n") * HOT_SHARE > rows
    common = F.broadcast(by_fingerprint.where(hot).select("fp", "component_id"))
    others = by_fingerprint.where(~hot).select("fp", "component_id")
    parts = marked.join(common, "fp"), marked.join(common, "fp", "left_anti").join(others, "fp")
    return parts[0].unionAll(parts[1]).select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, *, words: int = 3, max_bits: int = 2) -> DataFrame:
    """``docs`` with the smallest doc_id of each group only; rows that repeat it stay once.

    Rows with a null doc_id stay only if their group has no other id, one for each
    fingerprint. No rows give no rows.
    """
    _, by_fingerprint = _grouped(docs, words, max_bits)
    # The smallest id of a group is the smallest of its own fingerprint.
    kept = by_fingerprint.where(F.col("first").eqNullSafe(F.col("component_id")))
    # A repeated id with other texts: only the text whose fingerprint is kept.
    rows = docs.select(
        F.struct("*").alias("row"), "doc_id", fingerprint_column("text", words).alias("fp")
    )
    same = rows.doc_id.eqNullSafe(kept["first"]) & (rows.fp == kept.fp)
    chosen = rows.join(kept, same, "left_semi").dropDuplicates(["doc_id", "fp"])
    return chosen.select(*(F.col(f"row.`{c}`").alias(c) for c in docs.columns))
