"""The reports on a few postings made for one point each."""

from __future__ import annotations

import math
import re

from conftest import dicts, plan
from pyspark.sql import functions as F

from hirelens import FilterSpec, apply_filters, collect_all, dashboard
from hirelens.operators import domains, filters
from hirelens.plans import competition, friction, market, pulse, summary, titles


def by(df, *keys):
    return {tuple(r[k] for k in keys) if len(keys) > 1 else r[keys[0]]: r for r in dicts(df)}


# filters and domains


def test_filters_keep_only_what_is_asked_for(clean):
    p = clean(
        {"metadata_jobPostId": "a"},
        {"metadata_jobPostId": "b", "broad_sector": "Others"},
        {"metadata_jobPostId": "c", "PMET": "Non-PMET"},
        {"metadata_jobPostId": "d", "position_level": "Others"},
        {"metadata_jobPostId": "e", "job_repost": "Y"},
        {"metadata_jobPostId": "f", "Period_Quarterly": "2024-Q1", "Period_Yearly": "2024"},
        {"metadata_jobPostId": "g", "broad_sector": None},
    )

    def left(**spec):
        kept = apply_filters(p, FilterSpec(**spec))
        return "".join(sorted(r.metadata_jobPostId for r in kept.collect()))

    assert left() == "abcdefg"
    assert left(sector="Industrial & Infrastructure") == "acdef"
    assert left(pmet="PMET") == "abdefg"
    assert left(level="Manager / Professional") == "abcefg"
    assert left(exclude_reposts=True) == "abcdfg"
    assert left(period_range=("2023-Q1", "2023-Q4")) == "abcdeg"
    assert left(
        sector="Industrial & Infrastructure", pmet="PMET", level="Manager / Professional",
        exclude_reposts=True, period_range=("2023-Q1", "2023-Q1"),
    ) == "a"


def test_period_range_compares_text(clean):
    weeks = ["2023-W1", "2023-W2", "2023-W9", "2023-W10", "2023-W52", "2024-W1"]
    p = clean(*[{"Period_Weekly": w, "Period_Yearly": w[:4]} for w in weeks])
    got = filters.in_period(p, "Weekly", "2023-W10", "2023-W2")
    assert sorted(r.Period_Weekly for r in got.collect()) == ["2023-W10", "2023-W2"]
    assert [r.period for r in domains.period_domain(p, "Weekly").collect()] == sorted(weeks)
    assert dicts(domains.period_bounds(p, "Weekly")) == [{"lo": "2023-W1", "hi": "2024-W1"}]


def test_chosen_categories(clean):
    p = clean({"category": "A"}, {"category": "B"}, {"category": "C"})
    assert filters.with_categories(p, ["A", "C"]).count() == 2
    assert filters.with_categories(p, []).count() == 0


def test_domains(clean):
    p = clean(
        {"category": "B", "broad_sector": "s"},
        {"category": "A", "broad_sector": "s"},
        {"category": "A", "broad_sector": "s", "PMET": "Non-PMET"},
        {"category": "C", "broad_sector": "t"},
    )
    assert [r.category for r in domains.subsector_list(p).collect()] == ["A", "B", "C"]
    assert domains.option_triples(p).count() == 3
    options = [tuple(r) for r in domains.filter_options(p).collect()]
    assert options == [
        ("level", "Manager / Professional"), ("pmet", "Non-PMET"), ("pmet", "PMET"),
        ("sector", "s"), ("sector", "t"),
    ]
    assert [tuple(r) for r in domains.sector_map(p).collect()] == [("s", "A, B"), ("t", "C")]


# overview


def test_kpis(clean):
    p = clean(
        {"numberOfVacancies": 2, "metadata_totalNumberJobApplication": 5},
        {"numberOfVacancies": None, "job_repost": "Y"},
        {"metadata_jobPostId": None, "job_repost": "Y"},
    )
    (row,) = dicts(pulse.kpi_summary(p))
    assert row == {
        "vacancies": 3, "applications": 11, "views": 30, "posts": 3, "reposts": 1,
        "apps_per_vacancy": 11 / 3, "views_per_post": 10.0,
    }
    cards = [(r.label, r.value) for r in pulse.kpi_cards(p).collect()]
    assert cards == [
        ("Total Vacancies", "3"), ("Total Applications", "11"), ("Apps/Vac", "3.67"),
        ("Job Reposts", "1"), ("Views/Post", "10.0"),
    ]


def test_kpis_of_nothing_are_zero(clean):
    (row,) = dicts(pulse.kpi_summary(clean()))
    assert set(row.values()) == {0}
    assert dicts(summary.market_totals(clean())) == [
        {"total_vacancies": 1, "total_applications": 1}
    ]


def test_timeline_keeps_infinity_and_zeroes_nan(clean):
    p = clean(
        {"numberOfVacancies": 0, "metadata_totalNumberJobApplication": 5},
        {"numberOfVacancies": 0, "metadata_totalNumberJobApplication": 0, "PMET": "Non-PMET"},
        {"Period_Quarterly": "2022-Q4", "numberOfVacancies": 8,
         "metadata_totalNumberJobApplication": 1},
    )
    rows = dicts(pulse.timeline(p))
    assert [(r["period"], r["PMET"], r["apps_per_vacancy"]) for r in rows] == [
        ("2022-Q4", "PMET", 0.125), ("2023-Q1", "Non-PMET", 0.0), ("2023-Q1", "PMET", math.inf),
    ]
    assert rows[0]["apps_per_vacancy_plotted"] == 0.12


def test_shares_without_applications_are_zero(clean):
    p = clean({"metadata_totalNumberJobApplication": 0})
    assert [r["share"] for r in dicts(pulse.apps_by_sector(p))] == [0.0]


def test_pulse_over_no_rows_has_its_grand_total(clean):
    (row,) = dicts(pulse.pulse(clean()))
    assert row["grouping"] == 15 and row["period"] is None
    assert row["vacancies"] == row["applications"] == row["views"] == row["posts"] == row["reposts"] == 0


# market


def test_market_map_flags_and_zones(clean):
    def posts(category, vacancies, applications, views, n=1):
        return [{
            "category": category, "numberOfVacancies": vacancies,
            "metadata_totalNumberJobApplication": applications,
            "metadata_totalNumberOfView": views,
        }] * n

    p = clean(
        *posts("hot", 9, 90, 100, 3), *posts("niche", 1, 50, 100), *posts("supply", 9, 9, 1, 3),
        *posts("quiet", 1, 0, 1), *posts("none", 0, 0, 1), *posts("free", 0, 4, 1),
    )
    table = market.market_map(p)
    got = by(market.market_zones(market.flag_most_competitive(table)), "category")
    assert {k: r["zone"] for k, r in got.items()} == {
        "hot": "Hotspot", "niche": "Niche", "supply": "Opportunity", "quiet": "Quiet",
        "none": "Quiet", "free": "Quiet",
    }
    assert got["none"]["apps_per_vacancy"] == 0.0 and got["free"]["apps_per_vacancy"] == math.inf
    assert {k for k, r in got.items() if r["top_competitive"]} == {"free", "niche", "hot"}
    top = [r["category"] for r in dicts(market.most_competitive(table))]
    assert top == ["free", "niche", "hot"]
    average = dicts(market.weighted_avg_views(p))[0]["weighted_avg_views"]
    assert average == (300 + 100 + 3 + 1 + 1 + 1) / 10 == got["hot"]["weighted_avg_views"]
    empty = dicts(market.weighted_avg_views(clean()))[0]["weighted_avg_views"]
    assert math.isnan(empty)


# competition


def test_competition_without_vacancies_is_zero(clean):
    p = clean({"numberOfVacancies": 0, "metadata_totalNumberJobApplication": 5})
    (row,) = dicts(competition.competition_stats(p))
    assert row["apps_per_vac"] == 0.0 and row["category_with_ratio"] == "Engineering (0.0)"
    (bar,) = dicts(competition.competition_top(p))
    assert (bar["salary_text"], bar["experience_text"]) == ("$4,000", "2.0y")


def structure_postings(clean):
    rows = []
    for i in range(8):
        for level, salary in (("L1", 1000.0 * (i + 1)), ("L2", 3000.0)):
            for _ in range(2):
                rows.append({
                    "category": f"c{i}", "position_level": level, "average_salary": salary,
                    "metadata_totalNumberJobApplication": 10 * i, "minimumYearsExperience": i,
                })
    return clean(*rows)


def test_structure_of_the_most_contested(clean):
    got = competition.contested_structure(structure_postings(clean), 5)
    rows = by(got, "category", "position_level")
    assert {k[0] for k in rows} == {"c3", "c4", "c5", "c6", "c7"} and len(rows) == 10
    row = rows["c7", "L1"]
    assert (row["q1"], row["q3"], row["vacancies"], row["avg_exp"]) == (8000.0, 8000.0, 2, 7.0)
    # the benchmark covers all eight sub-sectors: ranks round(3.75) and round(11.25) of 16
    assert (row["broad_q1"], row["broad_q3"], row["broad_avg_exp"]) == (3000.0, 6000.0, 3.5)
    members = competition.postings_of_contested(structure_postings(clean), 5)
    assert {r.category for r in members.collect()} == {k[0] for k in rows}


def test_positioning_texts(clean):
    p = structure_postings(clean)
    rows = by(competition.with_positioning(competition.contested_structure(p)),
              "category", "position_level")
    assert rows["c7", "L1"]["positioning"] == "up" and rows["c3", "L2"]["positioning"] == "down"
    assert rows["c7", "L1"]["salary_comparison"] == (
        "Sub-sector (L1): Pay: $8.0k-$8.0k | Exp: 7.0y "
        "Sector Benchmark: Pay: $3.0k-$6.0k | Exp: 3.5y (up Market Positioning)"
    )
    unknown = clean({"average_salary": None, "minimumYearsExperience": None})
    structure = competition.contested_structure(unknown)
    (k,) = dicts(competition.with_positioning(structure))
    (dollar,) = dicts(competition.with_positioning(structure, "dollar"))
    assert k["positioning"] == "down" and "Pay: $nank-$nank | Exp: nany" in k["salary_comparison"]
    assert "Pay: $0-$0 | Exp: 0.0y" in dollar["salary_comparison"]


def test_hierarchy_parents_are_the_sum_of_their_children(clean):
    positioned = competition.with_positioning(
        competition.contested_structure(structure_postings(clean))
    )
    nodes = by(competition.hierarchy(positioned), "id")
    assert nodes["root"]["value"] == 20 and len(nodes) == 1 + 5 + 10 + 10
    for node_id, node in nodes.items():
        children = [n["value"] for n in nodes.values() if n["parent"] == node_id]
        assert not children or sum(children) == node["value"]


# titles


def test_titles_take_the_dominant_spelling(clean):
    p = clean(
        *[{"title": "Nurse"}] * 3, *[{"title": "NURSE"}] * 2, {"title": "Cook"},
        *[{"category": "tie", "title": t} for t in ("nurse", "nurse", "Nurse", "Nurse")],
        *[{"category": "many", "title": t} for t in "aabbccdd"],
    )
    assert {k: r["titles"] for k, r in by(titles.frequent_titles(p), "category").items()} == {
        "Engineering": "Nurse, Cook", "tie": "Nurse", "many": "a, b, c",
    }
    roles = titles.distinct_roles(p).where("category = 'Engineering'")
    assert sorted((r.lower_title, r.title, r.n) for r in roles.collect()) == [
        ("cook", "Cook", 1), ("nurse", "Nurse", 3),
    ]


def test_titles_cleaned_again_keep_the_uncleaned_key(clean):
    p = clean({"title": "** Cook"}, {"title": "Cook"}, {"title": "Cook"})
    (row,) = dicts(titles.frequent_titles(p, clean=True))
    assert row["titles"] == "Cook, Cook"
    (plain,) = dicts(titles.frequent_titles(p))
    assert plain["titles"] == "Cook, ** Cook"


def test_top_titles_are_limited_before_the_shuffle(clean):
    assert "WindowGroupLimit" in plan(titles.frequent_titles(clean({})))


# friction


def test_friction_without_vacancies_stays_null(clean):
    p = clean(
        {"numberOfVacancies": 0, "job_repost": "Y", "average_salary": 6000.0},
        {"category": "B", "average_salary": 2000.0},
    )
    rows = by(friction.friction_premium(p), "category")
    row = rows["Engineering"]
    assert row["apps_per_vac"] is None and row["friction_pct"] == 100.0
    assert row["sector_median"] == 4000.0 and row["salary_premium_pct"] == 50.0
    zones = by(friction.friction_zones(friction.friction_premium(p)), "category")
    assert zones["Engineering"]["zone"] == "Talent Scarcity"
    assert zones["B"]["zone"] == "High-Fluidity Roles"


def test_friction_keeps_the_largest(clean):
    p = clean(*[{"category": f"c{i:02}", "numberOfVacancies": i % 10} for i in range(15)])
    rows = dicts(friction.friction_premium(p))
    assert [r["vacancies"] for r in rows] == [9, 8, 7, 6, 5, 4, 4, 3, 3, 2]
    assert [r["category"] for r in rows[5:7]] == ["c04", "c14"]


def test_sector_without_salaries_has_a_null_median(clean):
    p = clean({"broad_sector": "s", "average_salary": None}, {"broad_sector": "t"})
    medians = {r["broad_sector"]: r["sector_median"] for r in dicts(friction.sector_median(p))}
    assert medians == {"s": None, "t": 4000.0}


# table


def test_indicators(spark):
    df = spark.createDataFrame(
        [(1.0, 0.0), (0.0, 1.0), (1.0, 1.0), (None, 1.0), (math.nan, 1.0)], "a double, b double"
    )
    got = [r[0] for r in df.select(summary.salary_indicator("a", "b")).collect()]
    assert got == ["higher", "lower", "match", "match", "match"]
    df = spark.createDataFrame([(0.2, 0.0), (0.21, 0.0), (0.0, 0.3), (None, 0.0)], "a double, b double")
    got = [r[0] for r in df.select(summary.experience_indicator("a", "b")).collect()]
    assert got == ["similar", "more", "less", "similar"]


def table_postings(clean):
    rows = []
    for i in range(12):
        rows += [{
            "category": f"c{i:02}", "broad_sector": "even" if i % 2 == 0 else "odd",
            "position_level": level, "numberOfVacancies": i, "average_salary": 1000.0 * (i + 1),
            "metadata_totalNumberJobApplication": apps, "minimumYearsExperience": i,
            "job_repost": "Y" if level == "L1" else "N",
        } for level, apps in (("L1", 5), ("L2", 7))]
    return clean(*rows)


def test_sectoral_table(clean):
    p = table_postings(clean)
    rows = dicts(summary.sectoral_table(p))
    assert [r["category"] for r in rows] == [f"c{i:02}" for i in range(12)]
    row = rows[4]
    assert row == {
        "category": "c04", "broad_sector": "even", "postings": 2, "vacancies": 8,
        "pct_vacancies": 6.1, "applications": 12, "pct_applications": 8.3, "apps_per_vac": 1.5,
        "median_salary": 5000.0, "salary_vs_sector": "lower", "parent_median": 6000.0,
        "avg_exp": 4.0, "exp_vs_sector": "less", "parent_avg_exp": 5.0, "top_seniority": "L2",
        "views": 20, "views_per_post": 10.0, "job_reposts": 1, "pct_reposts": 50.0,
        "titles": "Nurse",
    }
    assert rows[0]["apps_per_vac"] == math.inf
    competitive = dicts(summary.sectoral_table(p, summary.MOST_COMPETITIVE))
    assert [r["category"] for r in competitive] == [f"c{i:02}" for i in range(10)]
    largest = dicts(summary.sectoral_table(p, summary.MOST_VACANCIES, n=3))
    assert [r["category"] for r in largest] == ["c11", "c10", "c09"]
    chosen = dicts(summary.sectoral_table(p, categories=["c04", "c01", "c02"]))
    assert [r["category"] for r in chosen] == ["c02", "c04", "c01"]
    assert chosen[1] == row  # shares and benchmarks do not depend on the choice
    assert summary.sectoral_table(p, categories=[]).count() == 0


def test_report_and_its_texts(clean):
    p = table_postings(clean).withColumn(
        "average_salary", F.when(F.col("category") != "c00", F.col("average_salary"))
    ).withColumn(
        "minimumYearsExperience",
        F.when(F.col("category") != "c00", F.col("minimumYearsExperience")),
    )
    table = summary.report(summary.sectoral_table(p))
    shown = summary.report(summary.sectoral_table(p), display_names=True)
    assert shown.columns == list(summary.DISPLAY_NAMES.values()) and len(table.columns) == 19
    rows = by(summary.formatted(table), "category")
    assert rows["c00"]["median_salary"] == "-" and rows["c00"]["avg_exp"] == "nan yrs"
    assert rows["c00"]["apps_per_vac"] == "inf"
    assert rows["c04"]["median_salary"] == "S$ 5,000" and rows["c04"]["avg_exp"] == "4.0 yrs"
    assert rows["c04"]["pct_vacancies"] == "6.1%" and rows["c04"]["views"] == "20"


def test_small_reports(clean):
    p = clean(
        {"minimumYearsExperience": None, "average_salary": 1.0},
        {"average_salary": 3.0, "broad_sector": "s", "numberOfVacancies": 4},
    )
    assert dicts(summary.vacancies_and_median(p)) == [{"vacancies": 5, "median_salary": 2.0}]
    assert dicts(summary.salary_by_experience(p)) == [
        {"minimumYearsExperience": None, "postings": 1, "median_salary": 1.0},
        {"minimumYearsExperience": 2, "postings": 1, "median_salary": 3.0},
    ]
    assert by(summary.vacancies_by_sector(p), "broad_sector")["s"]["vacancies"] == 4
    assert by(summary.top_seniority(p), "category")["Engineering"]["top_seniority"] == (
        "Manager / Professional"
    )
    assert len(dicts(summary.parent_benchmarks(p))) == 2


def test_parts_add_up_to_the_whole(clean):
    p = table_postings(clean)
    kpi = dicts(pulse.kpi_summary(p))[0]
    for part in (pulse.timeline_sums(p), pulse.apps_by_sector(p), pulse.apps_by_seniority(p),
                 summary.sectoral_table(p)):
        assert sum(r["applications"] for r in dicts(part)) == kpi["applications"]
    assert abs(sum(r["share"] for r in dicts(pulse.apps_by_sector(p))) - 1) < 1e-12
    long = by(pulse.pulse(p), "grouping", "period", "PMET", "broad_sector", "position_level")
    assert long[15, None, None, None, None]["vacancies"] == kpi["vacancies"]
    assert {k[0] for k in long} == {3, 13, 14, 15}


def test_spellings_are_sorted_once(clean):
    text = plan(titles.distinct_roles(table_postings(clean)))
    assert len(re.findall(r"\bSort \[", text)) == 1, text


def test_pay_of_the_contested_is_cut_before_counting(clean):
    assert "LeftSemi" in plan(competition.competition_top(table_postings(clean)))


def test_dashboard_keeps_and_releases(spark, clean):
    p = table_postings(clean)
    with dashboard(p, FilterSpec(level="L1")) as reports:
        cards = {r.label: r.value for r in reports["kpi_cards"].collect()}
        assert cards["Total Applications"] == "60" and cards["Job Reposts"] == "12"
        rows = collect_all(reports)
        assert rows.keys() == reports.keys() and all(rows.values())
        assert rows["timeline"] == reports["timeline"].collect()
        assert "InMemoryTableScan" in plan(reports["timeline"])
    assert spark.sparkContext._jsc.getPersistentRDDs().isEmpty()
