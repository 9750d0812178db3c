"""Headline timings on one machine; prints one JSON line.

Environment: ``BENCH_SF_DIR`` (tables), ``BENCH_CPUS`` (cores), ``BENCH_RUNS``.

The path of a user is followed: raw CSV files go through the ingest job into
the cleaned Parquet table, the table is loaded once, and reports are asked of
it. Raw files are derived from the given tables beforehand, untimed. Every
report runs once to warm up; its value is the median of the further runs.
"""

from __future__ import annotations

import json
import os
import statistics
import tempfile
import time

from checks.session import local_session
from hirelens import (
    FilterSpec,
    apply_filters,
    build_clean,
    collect_all,
    dashboard,
    read_clean,
    write_csv,
)
from hirelens.plans import competition, friction, market, pulse, summary, titles
from hirelens.sources.star_tables import raw_postings

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = int(os.environ.get("BENCH_RUNS", "3"))

FILTERS = FilterSpec(
    sector="Industrial & Infrastructure",
    pmet="PMET",
    exclude_reposts=True,
    period_range=("1996-Q2", "2000-Q3"),
)


def timed(action, runs: int = RUNS, warm_up: bool = True) -> float:
    if warm_up:
        action()
    seconds = []
    for _ in range(runs):
        start = time.perf_counter()
        action()
        seconds.append(time.perf_counter() - start)
    return round(statistics.median(seconds), 3)


def main() -> None:
    spark = local_session(CPUS, os.environ.get("BENCH_MEMORY", "8g"))
    folder = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    csv, out = f"{folder}/raw_csv", f"{folder}/clean"
    pieces = spark.sparkContext.defaultParallelism
    write_csv(raw_postings(spark, SF_DIR).repartition(pieces), csv)
    times: dict[str, float] = {}

    def ingest():
        build_clean(spark, csv, out, mode="overwrite")

    times["ingest_csv_to_parquet"] = timed(ingest)

    def intake():
        read_clean(spark, out).write.format("noop").mode("overwrite").save()

    times["data_intake"] = timed(intake)

    # Reports straight from Parquet: filters and columns go into the scan.
    stored = read_clean(spark, out)
    times["kpi_filtered_from_parquet"] = timed(
        lambda: pulse.kpi_summary(apply_filters(stored, FILTERS)).collect()
    )
    times["table_from_parquet"] = timed(lambda: summary.sectoral_table(stored).collect())

    # Reports on postings that are loaded once and kept.
    held = read_clean(spark, out).persist()
    rows = held.count()
    reports = {
        "pulse_one_pass": lambda: pulse.pulse(held),
        "kpi_filtered": lambda: pulse.kpi_summary(apply_filters(held, FILTERS)),
        "timeline_weekly": lambda: pulse.timeline(held, "Weekly"),
        "market_zones": lambda: market.market_zones(market.market_map(held)),
        "competition_top10": lambda: competition.competition_top(held),
        "hierarchy": lambda: competition.hierarchy(
            competition.with_positioning(competition.contested_structure(held))
        ),
        "frequent_titles": lambda: titles.frequent_titles(held),
        "friction_zones": lambda: friction.friction_zones(friction.friction_premium(held)),
        "table_all": lambda: summary.formatted(summary.sectoral_table(held)),
    }
    for name, report in reports.items():
        times[name] = timed(lambda report=report: report().collect())
    held.unpersist()

    def everything():
        with dashboard(stored, FILTERS) as parts:
            collect_all(parts)

    times["whole_dashboard_filtered"] = timed(everything)
    print(
        json.dumps(
            {
                "metric": "total time of the headline reports",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": SF_DIR.rstrip("/").rsplit("sf", 1)[-1],
                "postings": rows,
                "cpus": CPUS,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
