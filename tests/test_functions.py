"""Labels, texts, ratios and rounding on single values."""

from __future__ import annotations

import math
import random

import pytest
from conftest import dicts
from pyspark.sql import functions as F

from hirelens.functions import numeric, rules, text


def apply(spark, values, make, type_="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {type_}")
    return [r.o for r in df.withColumn("o", make).orderBy("i").collect()]


SECTORS = {
    "Banking and Finance": "Financial & Professional",
    "Accounting / Auditing / Taxation": "Financial & Professional",
    "Risk Management in Technology": "Financial & Professional",
    "Professional Services": "Financial & Professional",
    "Healthcare / Pharmaceutical": "Public Service, Education & Health",
    "Public / Civil Service": "Public Service, Education & Health",
    "Social Media Data": "Public Service, Education & Health",
    "Information Technology": "Modern Services (ICT)",
    "Telecommunications": "Modern Services (ICT)",
    "IT Support": "Modern Services (ICT)",
    "IT": "Others",
    "Building and Construction": "Industrial & Infrastructure",
    "Engineering": "Industrial & Infrastructure",
    "Logistics / Supply Chain": "Industrial & Infrastructure",
    "Sales / Retail": "Consumer & Lifestyle",
    "F&B": "Consumer & Lifestyle",
    "Marketing": "Consumer & Lifestyle",
    "Marketing / Public Relations": "Others",
    "MARKETING / PUBLIC RELATIONS": "Others",
    "General Management": "HR, General Administration and Management",
    "Human Resources": "HR, General Administration and Management",
    "Sciences / Laboratory / R&D": "Others",
    "General / Others": "Others",
}


def test_sector_rules(spark):
    got = apply(spark, [n.lower() for n in SECTORS], rules.sector_of("v"))
    assert dict(zip(SECTORS, got)) == SECTORS


LEVELS = {
    "Fresh/entry level": ("Entry / Junior", "PMET"),
    "Junior Executive": ("Entry / Junior", "PMET"),
    "Senior Management": ("Senior Management", "PMET"),
    "Middle Management": ("Manager / Professional", "PMET"),
    "Manager": ("Manager / Professional", "PMET"),
    "Professional": ("Manager / Professional", "PMET"),
    "Non-executive": ("Others", "Non-PMET"),
    "Junior Executive, Non-executive": ("Entry / Junior", "Non-PMET"),
    "Executive": ("Executive / Senior Executive", "PMET"),
    None: ("Executive / Senior Executive", "PMET"),
}


def test_seniority_and_pmet_are_independent(spark):
    lowered = [n and n.lower() for n in LEVELS]
    levels = apply(spark, lowered, rules.seniority_of("v"))
    flags = apply(spark, lowered, rules.pmet_of("v"))
    assert dict(zip(LEVELS, zip(levels, flags))) == LEVELS


def test_rules_with_real_patterns_stay_regular_expressions(spark):
    assert "RLIKE" in rules.occurs("v", "it$|^data")
    assert "RLIKE" not in rules.occurs("v", "finance|f&b|it ")
    got = apply(spark, ["unit", "item", None], rules.first_match("v", [("it$", "x")], "y"))
    assert got == ["x", "y", "y"]


def test_many_alternatives_are_one_test(spark):
    pattern = "finance|f&b|it |o'neill"
    assert rules.occurs("v", pattern).count("contains(") == 1
    got = apply(spark, ["f&b", "unit 4", "o'neill", "unit", "", None], rules.first_match("v", [(pattern, "x")], "y"))
    assert got == ["x", "x", "x", "y", "y", "y"]


def test_labels_and_names_are_quoted(spark):
    got = apply(spark, ["o'neill\\x"], rules.first_match("v", [("o'neill\\\\x", "it's `a`")], "n"))
    assert got == ["it's `a`"]
    assert rules.name("a`b") == "`a``b`"


def test_repost_flag(spark):
    assert apply(spark, [0, 1, 7, None], rules.repost_flag("v"), "long") == ["N", "Y", "Y", "N"]


def test_first_category(spark):
    cases = {
        '[{"id":6,"category":"Building and Construction"},{"id":11,"category":"Engineering"}]':
            "Building and Construction",
        '[{"id":6,"category":   "F&B"}]': "F&B",
        "[{''category'':''Insurance''}]": "Insurance",
        "[]": "General / Others",
        '[{"category":""}]': "General / Others",
        None: "General / Others",
    }
    assert apply(spark, list(cases), text.first_category("v")) == list(cases.values())


def test_clean_title(spark):
    cases = {
        "** Senior   Nurse ": "Senior Nurse",
        "###": "",
        "Site  Engineer": "Site Engineer",
        "\tTab\nbreak": "Tab break",
        "Cook (part-time)": "Cook (part-time)",
        None: None,
    }
    assert apply(spark, list(cases), text.clean_title("v")) == list(cases.values())


def test_parse_date(spark):
    values = ["2021-01-01", "2021-01-01 10:20:30", "2021-01-01T10:20:30", " 2021-1-2", "n/a",
              "2021", "2021-05", "12:34:56", "2021-13-01", "", None]
    got = apply(spark, values, text.parse_date("v").cast("string"))
    assert got == ["2021-01-01 00:00:00", "2021-01-01 10:20:30", "2021-01-01 10:20:30",
                   "2021-01-02 00:00:00"] + [None] * 7


def test_parse_date_with_formats(spark):
    got = apply(spark, ["31/12/2020", "20200102", "2020-01-01"],
                text.parse_date("v", ("dd/MM/yyyy", "yyyyMMdd")).cast("string"))
    assert got == ["2020-12-31 00:00:00", "2020-01-02 00:00:00", None]


@pytest.mark.parametrize(
    ("day", "weekly", "monthly", "quarterly", "yearly"),
    [
        ("2021-01-01", "2021-W53", "2021-01", "2021-Q1", "2021"),
        ("2024-12-30", "2024-W1", "2024-12", "2024-Q4", "2024"),
        ("2023-03-06", "2023-W10", "2023-03", "2023-Q1", "2023"),
        ("2023-01-10", "2023-W2", "2023-01", "2023-Q1", "2023"),
    ],
)
def test_period_labels(spark, day, weekly, monthly, quarterly, yearly):
    df = spark.sql(f"SELECT timestamp'{day}' AS t")
    labels = text.period_labels("t")
    row = df.select(*[c.alias(g) for g, c in labels.items()]).first()
    assert row.asDict() == {
        "Weekly": weekly, "Monthly": monthly, "Quarterly": quarterly, "Yearly": yearly
    }
    padded = df.select(text.period_labels("t", sortable_weeks=True)["Weekly"]).first()[0]
    assert len(padded) == 8 and padded.replace("W0", "W") == weekly


def ratios(spark, on_zero):
    df = spark.createDataFrame([(5, 2), (5, 0), (0, 0), (None, 2), (5, None)], "n long, d long")
    return [r[0] for r in df.select(numeric.ratio("n", "d", on_zero)).collect()]


def test_ratio_rules(spark):
    ieee = ratios(spark, "ieee")
    assert ieee[:2] == [2.5, math.inf] and math.isnan(ieee[2]) and ieee[3:] == [None, None]
    assert ratios(spark, "nan_to_zero") == [2.5, math.inf, 0.0, None, None]
    assert ratios(spark, "null") == [2.5, None, None, None, None]
    assert ratios(spark, "zero") == [2.5, 0.0, 0.0, 0.0, 0.0]
    with pytest.raises(ValueError):
        numeric.ratio("n", "d", "other")


def test_totals_and_counts(spark):
    df = spark.createDataFrame([(None, "a"), (None, None)], "v long, s string")
    got = df.agg(
        numeric.total("v").alias("t"),
        numeric.count_where(F.lit(True), "s").alias("s"),
        numeric.count_where(F.lit(True)).alias("n"),
    )
    assert dicts(got) == [{"t": 0, "s": 1, "n": 2}]
    assert dicts(df.limit(0).agg(numeric.total("v").alias("t"))) == [{"t": 0}]


def test_round_even(spark):
    values = [0.25, 0.35, -0.25, 2.5, 1.005, None, math.inf]
    got = apply(spark, values, numeric.round_even("v", 1), "double")
    assert got == [0.2, 0.4, -0.2, 2.5, 1.0, None, math.inf]


def test_number_texts_are_those_of_python(spark):
    rng = random.Random(1)
    values = [0.15, 0.25, 0.35, 2.5, 3.5, 3.45, 1234.5, 1235.5, -0.04, 1e7, 12345678.0, 0.0]
    values += [round(rng.uniform(0, 20000), rng.randint(0, 3)) for _ in range(500)]
    for digits in (0, 1, 2):
        grouped = apply(spark, values, numeric.grouped_text("v", digits), "double")
        fixed = apply(spark, values, numeric.fixed_text("v", digits), "double")
        assert grouped == [f"{v:,.{digits}f}" for v in values]
        assert fixed == [f"{v:.{digits}f}" for v in values]
    odd = [math.nan, math.inf, -math.inf, None]
    assert apply(spark, odd, numeric.fixed_text("v"), "double") == ["nan", "inf", "-inf", "nan"]
