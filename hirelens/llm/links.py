"""Connected components of a table of links, as rounds of joins."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hirelens.sources.shared import scratch_folder, stored


def components(links: DataFrame) -> DataFrame:
    """(node, component) of all nodes of ``links`` (a, b: long); component is the smallest node.

    Alternating star rounds: each node's neighbours are linked to its smallest
    one, first all larger neighbours, then all smaller ones, until nothing
    changes. Every round is written to the shared folder; the minima are partial
    aggregates, and a node with very many links is split by the skewed join.
    """
    folder = scratch_folder(links.sparkSession, "components")
    start = links.where("a <> b").select(
        F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")
    )
    now = stored(start.distinct(), f"{folder}/0")
    seen = None
    for number in count(1):
        state = now.agg(
            F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
        ).first()
        if state == seen or not state[0]:
            break
        seen = state
        both = now.unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("low"))
        large = (
            both.where("v > u")
            .join(low, "u")
            .select(F.col("v").alias("u"), F.least("u", "low").alias("v"))
            .distinct()
        )
        low = large.groupBy("u").agg(F.min("v").alias("low"))
        small = (
            large.join(low, "u")
            .select(
                F.explode(
                    F.array(
                        F.struct(F.col("u").alias("u"), F.col("low").alias("v")),
                        F.struct(F.col("v").alias("u"), F.col("low").alias("v")),
                    )
                ).alias("x")
            )
            .select("x.u", "x.v")
            .where("u <> v")
            .distinct()
        )
        now = stored(small, f"{folder}/{number}")
    smallest = now.groupBy("u").agg(F.min("v").alias("component"))
    roots = smallest.select(F.col("component").alias("u"), "component").distinct()
    return smallest.unionAll(roots).select(F.col("u").alias("node"), "component")
