"""All reports for one choice of filters, from postings that are kept meanwhile."""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row

from ..operators.filters import FilterSpec, apply_filters
from ..schema import POSTINGS, PostingColumns
from ..sources.clean_store import kept
from . import competition, friction, market, pulse, summary
from .reduced import measures, reduce_postings, rolled_up, stored_medians


def reports(
    filtered: DataFrame,
    grain: str,
    c: PostingColumns = POSTINGS,
    overview: DataFrame | None = None,
    reduced: DataFrame | None = None,
) -> dict[str, DataFrame]:
    """Every report as a frame. ``overview`` holds the rows of ``pulse.reduced``.

    ``reduced`` holds all sums by sub-sector, seniority and salary bin, or
    finer. It is written when this is called if it is not there, and so are the
    medians: the reports on the market, competition, friction and the table
    share both.
    """
    if overview is None:
        overview = pulse.reduced(filtered, grain, c)
    if reduced is None:
        reduced = reduce_postings(filtered, list(measures(c)), c=c)
    by_category = rolled_up(reduced, [c.category, c.sector], market.SUMS)
    pay = stored_medians(filtered, reduced, c)
    structure = competition.contested_structure(filtered, c=c, reduced=reduced)
    structure = competition.with_positioning(structure, c=c)
    premium = friction.friction_premium(filtered, c=c, reduced=reduced, pay=pay)
    return {
        "kpi_cards": pulse.cards_of(pulse.kpi_of_reduced(overview, c)),
        "pulse": pulse.pulse_of_reduced(overview, grain, c),
        "timeline": pulse.timeline(overview, grain, c),
        "apps_by_seniority": pulse.apps_by_seniority(overview, c),
        "apps_by_sector": pulse.apps_by_sector(overview, c),
        "market": market.flag_most_competitive(
            market.market_zones(market.market_of_sums(by_category, c), c), c=c
        ),
        "competition_top": competition.competition_top(filtered, c=c, reduced=reduced, pay=pay),
        "hierarchy": competition.hierarchy(structure, c=c),
        "friction": friction.friction_zones(premium, c),
        "table": summary.formatted(
            summary.sectoral_table(filtered, c=c, reduced=reduced, pay=pay)
        ),
    }


@contextmanager
def dashboard(
    postings: DataFrame, spec: FilterSpec | None = None, c: PostingColumns = POSTINGS
) -> Iterator[dict[str, DataFrame]]:
    """The reports over filtered postings that are scanned once and kept.

    The filters go into the scan; what is left is kept for all reports and
    released when the block ends. So are the few rows that the overview (key
    figures, timeline, shares, pulse) is made of.
    """
    spec = spec or FilterSpec()
    needed = [n for n in c.read_columns if n not in c.periods or n == c.period(spec.grain)]
    with (
        kept(apply_filters(postings, spec, c).select(*needed)) as held,
        kept(pulse.reduced(held, spec.grain, c)) as overview,
    ):
        yield reports(held, spec.grain, c, overview)


def collect_all(frames: Mapping[str, DataFrame], at_once: int = 8) -> dict[str, list[Row]]:
    """Run several reports at the same time and return their rows.

    The jobs of one report are short and leave cores idle between them; those
    of the others fill the gaps. Meant for reports, whose rows are few.
    """
    with ThreadPoolExecutor(at_once) as pool:
        rows = {name: pool.submit(df.collect) for name, df in frames.items()}
        return {name: future.result() for name, future in rows.items()}
