"""Embedding near-dedup with an inverted multi-index.

Two independent codebooks, one for each half of the vectors, form a product
grid. Each vector is filed in its cell and visits the cells nearest to it in the
order of the sum of both distances (multi-sequence order), as many as the target
recall needs for the true links of a set of queries, which are found by brute
force. Where visitors meet members, cosines are computed exactly.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hirelens.llm.links import components
from hirelens.llm.sampling import small_hashes
from hirelens.sources.shared import scratch_folder, stored

BLOCK = 2048
QUERIES = 2000  # vectors whose true links are found by brute force
RANKED = 128  # rows whose cells are ranked at a time
TINY = 1e-300


@dataclass(frozen=True)
class MultiIndex:
    first: np.ndarray  # centroids of the first halves
    second: np.ndarray
    visits: int  # cells per query

    @property
    def half(self) -> int:
        return self.first.shape[1]

    def order(self, x: np.ndarray, visits: int | None = None) -> np.ndarray:
        """The nearest cells of each row, nearest first.

        Cell (i, j), counted by rank in each half, has at least (i+1)(j+1) - 1
        cells before it, so only ranks with (i+1)(j+1) <= visits are looked at.
        """
        visits = min(visits or self.visits, len(self.first) * len(self.second))
        a, b = distances(x[:, : self.half], self.first), distances(x[:, self.half :], self.second)
        near_a, near_b = np.argsort(a, axis=1, kind="stable"), np.argsort(b, axis=1, kind="stable")
        i, j = np.divmod(np.arange(a.shape[1] * b.shape[1]), b.shape[1])
        kept = (i + 1) * (j + 1) <= visits
        i, j = i[kept], j[kept]
        sums = np.take_along_axis(a, near_a[:, i], 1) + np.take_along_axis(b, near_b[:, j], 1)
        nearest = np.argsort(sums, axis=1, kind="stable")[:, :visits]
        cells = near_a[:, i] * b.shape[1] + near_b[:, j]
        return np.take_along_axis(cells, nearest, 1)

    def ranks(self, x: np.ndarray, cells: np.ndarray) -> np.ndarray:
        """The place of one cell in the whole order of each row, by counting the cells before it.

        Sums grow along each half, so those before the cell are a prefix for
        every centroid of the first half, found by bisection: no cell is sorted.
        """
        out = np.empty(len(x), np.int64)
        for at in range(0, len(x), RANKED):
            rows, cell = x[at : at + RANKED], np.asarray(cells[at : at + RANKED])[:, None]
            a, b = distances(rows[:, : self.half], self.first), distances(rows[:, self.half :], self.second)
            near_a, near_b = np.argsort(a, axis=1, kind="stable"), np.argsort(b, axis=1, kind="stable")
            i = (near_a == cell // b.shape[1]).argmax(1)[:, None]
            j = (near_b == cell % b.shape[1]).argmax(1)[:, None]
            a, b = np.take_along_axis(a, near_a, 1), np.take_along_axis(b, near_b, 1)
            total = np.take_along_axis(a, i, 1) + np.take_along_axis(b, j, 1)
            ties = np.arange(a.shape[1]) < i  # of equal sums, those of nearer first centroids come before
            low, high = np.zeros(a.shape, np.int64), np.full(a.shape, b.shape[1])
            while (low < high).any():
                middle = (low + high) // 2
                sums = a + np.take_along_axis(b, np.minimum(middle, b.shape[1] - 1), 1)
                before = (low < high) & ((sums < total) | (ties & (sums == total)))
                low, high = np.where(before, middle + 1, low), np.where(before, high, middle)
            np.put_along_axis(low, i, j, 1)
            out[at : at + RANKED] = low.sum(1)
        return out


def distances(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return (x * x).sum(1)[:, None] - 2 * x @ centroids.T + (centroids * centroids).sum(1)


def k_means(x: np.ndarray, k: int, rounds: int = 8, seed: int = 7) -> np.ndarray:
    """Lloyd's rounds from rows drawn at random; empty centroids stay."""
    rng = np.random.default_rng(seed)
    centroids = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        near = distances(x, centroids).argmin(1)
        counts = np.bincount(near, minlength=len(centroids))
        sums = np.zeros_like(centroids)
        np.add.at(sums, near, x)
        centroids[counts > 0] = sums[counts > 0] / counts[counts > 0, None]
    return centroids


def fit(x: np.ndarray, k: int, min_cosine: float, recall: float, queries: int = 400) -> MultiIndex:
    """Codebooks from the sample ``x`` (rows of length 1), and least visits for the target recall.

    The visits are measured on partners at exactly ``min_cosine``, in random
    directions. True partners differ where the data vary and cross more borders
    of cells: ``_true_ranks`` measures them, this is for data without links.
    """
    half = x.shape[1] // 2
    index = MultiIndex(k_means(x[:, :half], k), k_means(x[:, half:], k, seed=8), 1)
    rng = np.random.default_rng(9)
    a = x[rng.choice(len(x), min(queries, len(x)), replace=False)]
    away = rng.normal(size=a.shape)
    away -= (away * a).sum(1)[:, None] * a
    away /= np.maximum(np.linalg.norm(away, axis=1)[:, None], TINY)
    b = min_cosine * a + math.sqrt(1 - min_cosine**2) * away
    to_b = index.ranks(a, index.order(b, 1)[:, 0])
    to_a = index.ranks(b, index.order(a, 1)[:, 0])
    needed = np.quantile(np.minimum(to_a, to_b), recall, method="higher")
    return MultiIndex(index.first, index.second, int(needed) + 1)


def _true_ranks(distinct: DataFrame, shared, min_cosine: float) -> dict[int, int]:
    """How many links of the queries need which rank, from the side that finds them sooner.

    Every vector meets every query, in blocks. ``shared`` is a broadcast of the
    index, the queries and their nodes. High ranks are rounded up to ten binary
    digits, so that only a few thousand counts come to the driver.
    """

    def ranked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index, queries, nodes = shared.value
        home = index.order(queries, 1)[:, 0]
        for batch in batches:
            for at in range(0, len(batch), 1024):
                part = batch.iloc[at : at + 1024]
                x = unit(part["vector"])
                linked = (x @ queries.T >= min_cosine) & (part["node"].to_numpy()[:, None] != nodes[None, :])
                i, j = np.nonzero(linked)
                if not len(i):
                    continue
                some, i = np.unique(i, return_inverse=True)
                x = x[some]
                cell = index.order(x, 1)[:, 0]
                ranks = _ranks_once(index, queries, j, cell[i])
                far = np.nonzero(ranks)[0]
                ranks[far] = np.minimum(ranks[far], _ranks_once(index, x, i[far], home[j[far]]))
                step = 1 << np.maximum(np.frexp(ranks)[1] - 10, 0)
                rank, n = np.unique(-(-ranks // step) * step, return_counts=True)
                yield pd.DataFrame({"rank": rank, "n": n})

    found = distinct.select("node", "vector").mapInPandas(ranked, "rank long, n long")
    return {r["rank"]: r["n"] for r in found.groupBy("rank").agg(F.sum("n").alias("n")).collect()}


def _ranks_once(index: MultiIndex, x: np.ndarray, rows: np.ndarray, cells: np.ndarray) -> np.ndarray:
    """Ranks of ``cells`` for the rows ``x[rows]``; equal pairs are ranked once."""
    pairs, place = np.unique(np.stack([rows, cells]), axis=1, return_inverse=True)
    return index.ranks(x[pairs[0]], pairs[1])[place.ravel()]


def enough_visits(ranks: dict[int, int], recall: float) -> int:
    """Visits that find the share ``recall`` of all links, if the ranks of a sample of them are these.

    1.64 standard errors are added to the share: the sample's own quantile would
    be too low half the time.
    """
    total = sum(ranks.values())
    wanted = min(total, total * recall + 1.64 * math.sqrt(total * recall * (1 - recall)))
    found = 0
    for rank, n in sorted(ranks.items()):
        found += n
        if found >= wanted:
            return rank + 1
    return 1


def unit(vectors) -> np.ndarray:
    x = np.stack([np.asarray(v, np.float64) for v in vectors])
    x /= np.abs(x).max(1)[:, None]  # squares of huge or tiny components stay finite
    return x / np.linalg.norm(x, axis=1)[:, None]


def usable(vector: Column) -> Column:
    """Not null, no null or non-finite component, not zero (nor empty)."""
    finite = F.forall(
        vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))
    )
    return F.coalesce(finite & F.exists(vector, lambda v: v != 0), F.lit(False))


def _met(min_cosine: float):
    """Counts and links of a block of members with a block of visitors of their cell."""

    def met(members: pd.DataFrame, visitors: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"a": [], "b": [], "n": []})
        if not len(members) or not len(visitors):
            return empty
        v, m = unit(visitors["vector"]), unit(members["vector"])
        v_node, m_node = visitors["node"].to_numpy(), members["node"].to_numpy()
        linked = (v @ m.T >= min_cosine) & (v_node[:, None] != m_node[None, :])
        i, j = np.nonzero(linked)
        if not len(i):
            return empty
        # The member finds the visitor by itself if it visits the visitor's own cell; else it counts here.
        visits = np.stack(members["visits"].to_numpy())
        alone = np.ones(len(i), bool)
        home = visitors["cell_of"].to_numpy()[i]
        for c in range(visits.shape[1]):
            alone &= visits[j, c] != home
        v_count = np.bincount(i, members["copies"].to_numpy()[j], len(v))
        m_count = np.bincount(j[alone], visitors["copies"].to_numpy()[i[alone]], len(m))
        # Smallest label over the links, until stable: one star per linked group, not all its pairs.
        low_v = v_node.copy()
        while True:
            low_m = m_node.copy()
            np.minimum.at(low_m, j, low_v[i])
            new = low_v.copy()
            np.minimum.at(new, i, low_m[j])
            if (new == low_v).all():
                break
            low_v = new
        nodes = np.concatenate([v_node, m_node])
        low = np.concatenate([low_v, low_m])
        star = nodes != low
        out = pd.DataFrame({"a": nodes, "b": low, "n": np.concatenate([v_count, m_count])})
        return out[star | (out["n"] > 0)].astype({"a": "int64", "b": "int64", "n": "int64"})

    return met


def _fitted(distinct: DataFrame, total: int, min_cosine: float, recall: float, sample: int) -> MultiIndex:
    """The index of ``distinct``: its codebooks and its visits."""
    context = distinct.sparkSession.sparkContext
    chosen = (
        small_hashes(distinct.select("node", "vector"), F.xxhash64("vector"), total, sample + QUERIES)
        .orderBy("__hash")
        .limit(sample + QUERIES)
        .collect()
    )
    k = int(min(1024, max(1, round(math.sqrt(total / 32)))))
    x = unit([r.vector for r in chosen])
    index = fit(x[:sample], k, min_cosine, recall)
    if len(index.first) * len(index.second) == 1:
        return index
    # The last of the chosen: where there are enough vectors, none that the codebooks were fitted on.
    queries, nodes = x[-QUERIES:], np.array([r.node for r in chosen[-QUERIES:]])
    shared = context.broadcast((index, queries, nodes))
    visits = enough_visits(_true_ranks(distinct, shared, min_cosine), recall)
    shared.unpersist()
    cells = len(index.first) * len(index.second)
    return replace(index, visits=min(cells, max(index.visits, visits)))


def _of_one_size(distinct: DataFrame, total: int, min_cosine: float, recall: float, sample: int) -> DataFrame:
    """(a, b, n): partial counts n of links of node a, and links a-b where they differ.

    ``distinct``: node, vector, copies; all vectors of one size.
    """
    spark = distinct.sparkSession
    shared = spark.sparkContext.broadcast(_fitted(distinct, total, min_cosine, recall, sample))

    @F.pandas_udf("array<int>")
    def visited(vectors: pd.Series) -> pd.Series:
        index, out = shared.value, []
        for at in range(0, len(vectors), 256):
            out += list(index.order(unit(vectors.iloc[at : at + 256])).astype(np.int32))
        return pd.Series(out, dtype=object)

    folder = scratch_folder(spark, "cells")
    filed = stored(
        distinct.withColumn("visits", visited("vector")).withColumn("cell_of", F.get("visits", F.lit(0))),
        folder,
    )
    again = spark.read.schema(filed.schema).parquet(folder)  # both sides of a cogroup need their own scan
    members = filed.groupBy(F.col("cell_of").alias("cell")).agg(
        F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("member_blocks")
    )
    visitors = filed.select(F.explode("visits").alias("cell"))
    visitors = visitors.groupBy("cell").agg(
        F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("visitor_blocks")
    )
    cells = members.join(visitors, "cell")

    def dealt(rows: DataFrame, own: str, other: str) -> DataFrame:
        """Rows of a cell by hash into blocks of their side, once for each block of the other."""
        own_block = F.pmod(F.xxhash64("node"), F.col(f"{own}_blocks")).cast("int").alias(own)
        others = F.explode(F.sequence(F.lit(0), F.col(f"{other}_blocks") - 1)).alias(other)
        return rows.join(cells, "cell").select("*", own_block, others)

    inside = dealt(filed.withColumn("cell", F.col("cell_of")), "member", "visitor").select(
        "cell", "member", "visitor", "node", "copies", "vector", "visits"
    )
    coming = dealt(
        again.select("node", "copies", "vector", "cell_of", F.explode("visits").alias("cell")), "visitor", "member"
    ).select("cell", "member", "visitor", "node", "copies", "vector", "cell_of")
    keys = ["cell", "member", "visitor"]
    return (
        inside.groupBy(*keys)
        .cogroup(coming.groupBy(*keys))
        .applyInPandas(_met(min_cosine), "a long, b long, n long")
    )


def near_groups(
    vectors: DataFrame, *, min_cosine: float = 0.95, recall: float = 0.99, sample: int = 10_000
) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of ``vectors`` (vec_id, embedding).

    Two rows link if their cosine in double precision is ``min_cosine`` or more
    and the index finds it; equal vectors always do. Rows with a null, zero or
    non-finite vector, or with a null component, link with nothing; vectors of
    different sizes do not link. ``sample`` bounds the vectors that the
    codebooks are fitted on, for each vector size. ``recall`` is the share of all
    links between distinct vectors that the index is to find, measured on all
    links of up to 2,000 of them.
    """
    spark = vectors.sparkSession
    rows = vectors.select("vec_id", "embedding", usable(F.col("embedding")).alias("usable"))
    grouped = (
        rows.where("usable")
        .groupBy(F.col("embedding").alias("vector"))
        .agg(F.min("vec_id").alias("first"), F.count(F.lit(1)).alias("copies"))
    )
    distinct = stored(
        grouped.select(
            F.monotonically_increasing_id().alias("node"), "vector", "first", "copies", F.size("vector").alias("size")
        ),
        scratch_folder(spark, "vectors"),
    )
    met = None
    for size, total in distinct.groupBy("size").count().orderBy("size").collect():
        part = distinct.where(F.col("size") == size).select("node", "vector", "copies")
        found = _of_one_size(part, total, min_cosine, recall, sample)
        met = found if met is None else met.unionAll(found)
    if met is None:
        met = spark.createDataFrame([], "a long, b long, n long")
    met = stored(met, scratch_folder(spark, "met"))
    counts = met.groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n"))
    groups = components(met.where("a <> b").select("a", "b"))
    named = (
        distinct.select("node", "vector", "first", "copies")
        .join(counts, "node", "left")
        .join(groups, "node", "left")
        .withColumn("component", F.coalesce("component", "node"))
    )
    smallest = named.groupBy("component").agg(F.min("first").alias("smallest"))
    named = named.join(smallest, "component").select(
        "vector", "smallest", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n")
    )
    alone = ~F.col("usable")
    joined = rows.where("usable").join(named, F.col("embedding") == F.col("vector")).select(
        "vec_id", F.col("n").alias("n_links"), F.col("smallest").alias("component_id")
    )
    rest = rows.where(alone).select(
        "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")
    )
    return joined.unionAll(rest).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
