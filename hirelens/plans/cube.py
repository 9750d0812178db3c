"""A stored roll-up of the postings from which every report can be answered.

A row stands for a sub-sector, sector, seniority, PMET flag, repost flag, the
periods of some grains and a bin of the salary. All filters are on these
columns, so they are put to the cube; postings are only read for the salaries
around a wanted median or quartile, and for the titles.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import count_where
from ..functions.rules import REPOST_YES
from ..operators.filters import FilterSpec, apply_filters
from ..operators.quantile import bin_counts
from ..schema import GRAINS, POSTINGS, PostingColumns
from ..sources.clean_store import kept
from .dashboard import reports
from .reduced import measures

DIMENSIONS = ("sector", "level", "pmet", "category")


def build_cube(
    postings: DataFrame,
    grains: Sequence[str] = ("Quarterly", "Yearly"),
    c: PostingColumns = POSTINGS,
) -> DataFrame:
    """One scan of the postings, written when called; ``grains`` can be filtered by later.

    Its size is bounded by the labels and bins there are, not by the postings.
    """
    keys = [c.category, c.sector, c.level, c.pmet, c.repost, *(c.period(g) for g in grains)]
    counts = {
        "posts": F.count(F.lit(1)),
        "reposts": count_where(F.col(c.repost) == REPOST_YES, c.job_id),
    }
    sums = [column.alias(n) for n, column in (measures(c) | counts).items()]
    return bin_counts(postings, keys, c.salary, sums)


def overview(cube: DataFrame, grain: str, c: PostingColumns = POSTINGS) -> DataFrame:
    """The rows of ``pulse.reduced`` from a cube."""
    sums = {c.vacancies: "vacancies", c.applications: "applications", c.views: "views"}
    sums |= {n: n for n in ("posts", "reposts")}
    return cube.groupBy(c.period(grain), c.pmet, c.sector, c.level).agg(
        *[F.sum(n).alias(shown) for shown, n in sums.items()]
    )


@contextmanager
def dashboard_from_cube(
    postings: DataFrame,
    cube: DataFrame,
    spec: FilterSpec | None = None,
    c: PostingColumns = POSTINGS,
) -> Iterator[dict[str, DataFrame]]:
    """All reports under the filters of ``spec``, whose grain the cube must have."""
    spec = spec or FilterSpec()
    if c.period(spec.grain) not in cube.columns:
        raise ValueError(f"the cube has no periods of grain {spec.grain!r}")
    chosen = apply_filters(cube, spec, c)
    filtered = apply_filters(postings, spec, c)
    with kept(overview(chosen, spec.grain, c)) as summed:
        yield reports(filtered, spec.grain, c, summed, chosen)


def filter_catalogue(cube: DataFrame, c: PostingColumns = POSTINGS) -> DataFrame:
    """All that can be chosen in a filter, as (dimension, value, parent), in one pass.

    Dimensions are sector, level, pmet, category (its parent is the sector) and
    the grains of the cube; ``first`` and ``last`` of a grain are its default range.
    """
    grains = [g for g in GRAINS if c.period(g) in cube.columns]
    columns = {n: getattr(c, n) for n in DIMENSIONS} | {g.lower(): c.period(g) for g in grains}
    sets = [[c.category, c.sector] if n == "category" else [column] for n, column in columns.items()]
    used = list(dict.fromkeys([c.category, *columns.values()]))
    names = cube.groupBy(*used).agg(F.lit(1).alias("one"))
    found = names.groupingSets([[F.col(x) for x in s] for s in sets], *used).agg(
        F.grouping_id(*used).alias("grouping")
    )
    rows = None
    for (dimension, column), own in zip(columns.items(), sets):
        number = sum(1 << (len(used) - 1 - i) for i, n in enumerate(used) if n not in own)
        parent = F.col(c.sector) if dimension == "category" else F.lit(None).cast("string")
        shown = F.struct(F.lit(dimension).alias("dimension"), F.col(column).alias("value"), parent.alias("parent"))
        rows = F.when(F.col("grouping") == number, shown) if rows is None else rows.when(F.col("grouping") == number, shown)
    listed = found.select(rows.alias("x")).select("x.*")
    bounds = (
        listed.where(F.col("dimension").isin([g.lower() for g in grains]))
        .groupBy("dimension")
        .agg(F.min("value").alias("first"), F.max("value").alias("last"))
        .select(
            "dimension",
            F.inline(
                F.array(
                    F.struct(F.col("first").alias("value"), F.lit("first").alias("parent")),
                    F.struct(F.col("last").alias("value"), F.lit("last").alias("parent")),
                )
            ),
        )
    )
    return listed.unionAll(bounds).orderBy("dimension", "value", "parent")
