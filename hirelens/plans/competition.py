"""Competition, pay ranges and the structure of the most contested sub-sectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import fixed_text, grouped_text, ratio, round_sql, total
from ..functions.rules import name
from ..operators.filters import matching
from ..operators.quantile import (
    approx_quantiles,
    attach,
    bin_counts,
    quantiles_with_parent,
    selected,
)
from ..operators.ranking import top_rows, whole_frame
from ..schema import POSTINGS, PostingColumns
from ..sources.shared import scratch_folder, stored
from .reduced import measures, reduce_postings, rolled_up

QUARTILES = {"q1": 0.25, "q3": 0.75}
YEARS = ["_years", "_with_years"]
SUMS = ["applications", "vacancies", *YEARS]


def sector_level_benchmarks(
    postings: DataFrame, c: PostingColumns = POSTINGS, approx: bool = False
) -> DataFrame:
    """Pay quartiles (nearest value) and mean experience by sector and seniority."""
    keys = [c.sector, c.level]
    if approx:
        means = postings.groupBy(*keys).agg(F.avg(c.experience).alias("broad_avg_exp"))
        quartiles = approx_quantiles(postings, keys, c.salary, QUARTILES)
    else:
        bins = bin_counts(postings, keys, c.salary, [measures(c)[n].alias(n) for n in YEARS])
        means = rolled_up(bins, keys, YEARS).withColumn("broad_avg_exp", ratio(*YEARS, "null"))
        quartiles = selected(postings, bins, keys, c.salary, QUARTILES)
    quartiles = quartiles.withColumnsRenamed({"q1": "broad_q1", "q3": "broad_q3"})
    return attach(means, quartiles, keys).select(*keys, "broad_q1", "broad_q3", "broad_avg_exp")


def competition_sums(postings: DataFrame, c: PostingColumns = POSTINGS) -> DataFrame:
    """Applications per vacancy by sub-sector, without the medians: one cheap pass."""
    return (
        postings.groupBy(c.category, c.sector)
        .agg(
            total(c.applications).alias("applications"),
            total(c.vacancies).alias("vacancies"),
            F.avg(c.experience).alias("avg_exp"),
        )
        .withColumn("apps_per_vac", ratio("applications", "vacancies", "zero"))
    )


def by_competition(c: PostingColumns = POSTINGS):
    """Most contested first, then by name: a total order."""
    return [F.col("apps_per_vac").desc(), F.col(c.category), F.col(c.sector)]


def _reduced_stats(reduced: DataFrame, c: PostingColumns) -> DataFrame:
    """``competition_sums`` from a reduction of the postings."""
    return rolled_up(reduced, [c.category, c.sector], SUMS).withColumns(
        {
            "avg_exp": ratio(*YEARS, "null"),
            "apps_per_vac": ratio("applications", "vacancies", "zero"),
        }
    )


def _with_median(stats: DataFrame, pay: DataFrame, c: PostingColumns) -> DataFrame:
    keys = [c.category, c.sector]
    label = F.concat(
        F.col(c.category),
        F.lit(" ("),
        fixed_text(round_sql("apps_per_vac", 1), 1),
        F.lit(")"),
    )
    return attach(stats, pay.select(*keys, "median_salary"), keys).select(
        *keys,
        "applications",
        "vacancies",
        "median_salary",
        "avg_exp",
        "apps_per_vac",
        label.alias("category_with_ratio"),
    )


def competition_stats(postings: DataFrame, c: PostingColumns = POSTINGS) -> DataFrame:
    """Sums, median pay, mean experience, ratio and its label by sub-sector."""
    reduced = reduce_postings(postings, SUMS, by_level=False, c=c)
    return _with_median(_reduced_stats(reduced, c), _median(postings, reduced, c), c)


def _median(
    postings: DataFrame, reduced: DataFrame, c: PostingColumns, only: DataFrame | None = None
) -> DataFrame:
    keys = [c.category, c.sector]
    q = {"median_salary": 0.5}
    return selected(postings, reduced, keys, c.salary, q, "linear", only=only)


def top_contested(postings: DataFrame, n: int = 5, c: PostingColumns = POSTINGS) -> DataFrame:
    """Names of the ``n`` sub-sectors with the most applications per vacancy."""
    return top_rows(competition_sums(postings, c), n, *by_competition(c)).select(c.category)


def competition_top(
    postings: DataFrame,
    n: int = 10,
    c: PostingColumns = POSTINGS,
    reduced: DataFrame | None = None,
    pay: DataFrame | None = None,
) -> DataFrame:
    """The ``n`` most contested sub-sectors, least contested first, with bar texts.

    Pay is read for their postings alone, unless ``pay`` holds all medians.
    """
    if reduced is None:
        reduced = reduce_postings(postings, SUMS, by_level=False, c=c)
    top = top_rows(_reduced_stats(reduced, c), n, *by_competition(c))
    if pay is None:
        pay = _median(postings, reduced, c, top.select(c.category, c.sector))
    rows = _with_median(top, pay, c).withColumns(
        {
            "salary_text": F.concat(F.lit("$"), grouped_text("median_salary", 0)),
            "experience_text": F.concat(fixed_text("avg_exp", 1), F.lit("y")),
        }
    )
    return rows.orderBy(
        F.col("apps_per_vac"), F.col(c.category).desc(), F.col(c.sector).desc()
    )


def contested_structure(
    postings: DataFrame,
    n: int = 5,
    c: PostingColumns = POSTINGS,
    reduced: DataFrame | None = None,
) -> DataFrame:
    """Pay and experience by seniority inside the ``n`` most contested
    sub-sectors, next to the benchmark of their sector and seniority.

    The postings are read twice: once for all sums and bins, and once for the
    salaries around the quartiles of these sub-sectors and their benchmarks.
    Which sub-sectors are contested and what their sector requires are windows
    over the few reduced rows.
    """
    keys = [c.category, c.sector, c.level]
    if reduced is None:
        reduced = reduce_postings(postings, SUMS, c=c)
    fine = rolled_up(reduced, keys, SUMS).withColumnRenamed("applications", "_applications")
    within = f"OVER (PARTITION BY {name(c.category)}, {name(c.sector)})"
    parent = f"OVER (PARTITION BY {name(c.sector)}, {name(c.level)})"
    sums = fine.select(
        "*",
        ratio(f"sum(_applications) {within}", f"sum(vacancies) {within}", "zero").alias(
            "apps_per_vac"
        ),
        ratio("_years", "_with_years", "null").alias("avg_exp"),
        ratio(f"sum(_years) {parent}", f"sum(_with_years) {parent}", "null").alias(
            "broad_avg_exp"
        ),
    )
    place = F.dense_rank().over(whole_frame().orderBy(*by_competition(c)))
    contested = sums.withColumn("_place", place).withColumn(
        "_best", F.min("_place").over(Window.partitionBy(c.category))
    )
    contested = stored(
        contested.where(F.col("_best") <= n), scratch_folder(postings.sparkSession, "contested")
    )
    quartiles = quantiles_with_parent(
        postings,
        [c.category],
        [c.sector, c.level],
        c.salary,
        {"q1": ("broad_q1", QUARTILES["q1"]), "q3": ("broad_q3", QUARTILES["q3"])},
        bins=reduced,
        only=contested.select(*keys),
    )
    return attach(contested, quartiles, keys).select(
        *keys, "q1", "q3", "avg_exp", "vacancies", "broad_q1", "broad_q3", "broad_avg_exp"
    )


def postings_of_contested(
    postings: DataFrame, n: int = 5, c: PostingColumns = POSTINGS
) -> DataFrame:
    """The postings inside the ``n`` most contested sub-sectors."""
    return matching(postings, F.broadcast(top_contested(postings, n, c)), c.category)  # n rows


def with_positioning(
    structure: DataFrame, style: str = "k", c: PostingColumns = POSTINGS
) -> DataFrame:
    """Add whether pay lies above the sector (``up``/``down``) and a text on it.

    ``style="k"`` writes pay in thousands, ``"dollar"`` in whole dollars with
    missing numbers as 0.
    """
    if style not in ("k", "dollar"):
        raise ValueError(f"style must be 'k' or 'dollar', got {style!r}")
    middle = (F.col("q1") + F.col("q3")) / 2
    broad_middle = (F.col("broad_q1") + F.col("broad_q3")) / 2
    above = F.coalesce(middle > broad_middle, F.lit(False))
    icon = F.when(above, F.lit("up")).otherwise(F.lit("down"))

    if style == "k":
        def pay(column):
            return F.concat(fixed_text(f"{column} / 1000", 1), F.lit("k"))

        def years(column):
            return fixed_text(column, 1)
    else:
        def pay(column):
            return grouped_text(f"try_cast(coalesce({column}, 0D) AS bigint)", 0)

        def years(column):
            return fixed_text(round_sql(f"coalesce({column}, 0D)", 1), 1)

    def side(title, q1, q3, exp):
        pay_range = [F.lit("Pay: $"), pay(q1), F.lit("-$"), pay(q3)]
        return [title, F.lit(" "), *pay_range, F.lit(" | Exp: "), years(exp), F.lit("y ")]

    own = F.concat(F.lit("Sub-sector ("), F.col(c.level), F.lit("):"))
    text = F.concat(
        *side(own, "q1", "q3", "avg_exp"),
        *side(F.lit("Sector Benchmark:"), "broad_q1", "broad_q3", "broad_avg_exp"),
        F.lit("("),
        icon,
        F.lit(" Market Positioning)"),
    )
    return structure.withColumns({"positioning": icon, "salary_comparison": text})


def hierarchy(positioned: DataFrame, n: int = 5, c: PostingColumns = POSTINGS) -> DataFrame:
    """Root, sub-sector, seniority and data leaf as (id, label, parent, value).

    Each row contributes to its four nodes and the nodes are summed, so the
    structure is computed once and a parent always equals its children.
    """
    category, level = F.col(c.category), F.col(c.level)
    level_id = F.concat_ws("|", category, level)

    def node(depth, node_id, label, parent):
        return F.struct(
            F.lit(depth).alias("depth"),
            node_id.alias("id"),
            label.alias("label"),
            parent.alias("parent"),
        )

    nodes = F.array(
        node(0, F.lit("root"), F.lit(f"Top {n}"), F.lit("")),
        node(1, category, category, F.lit("root")),
        node(2, level_id, level, category),
        node(3, F.concat_ws("|", level_id, F.lit("data")), F.col("salary_comparison"), level_id),
    )
    return (
        positioned.select("vacancies", F.inline(nodes))
        .groupBy("depth", "id", "label", "parent")
        .agg(total("vacancies").alias("value"))
        .orderBy("depth", "id", "label")
    )
