"""Exact quantiles against brute force, and the plans they are computed by."""

from __future__ import annotations

import math
import random

import pytest
from conftest import dicts, plan
from hypothesis import given, settings
from hypothesis import strategies as st

from hirelens.operators.quantile import (
    approx_quantiles,
    bin_counts,
    exact_median,
    exact_quantiles,
    quantiles_with_parent,
    value_bin,
)


def nearest(values, q):
    ordered = sorted(v for v in values if v is not None)
    return ordered[math.floor((len(ordered) - 1) * q + 0.5)] if ordered else None


def median(values):
    ordered = sorted(v for v in values if v is not None)
    if not ordered:
        return None
    half = len(ordered) // 2
    return ordered[half] if len(ordered) % 2 else ordered[half - 1] * 0.5 + ordered[half] * 0.5


def sample(seed, n=3000):
    """One group with half of all rows, repeated values, all signs, a group without values."""
    rng = random.Random(seed)
    rows = []
    for _ in range(n):
        key = "hot" if rng.random() < 0.5 else rng.choice("abcdefg")
        kind = rng.random()
        value = (
            None if kind < 0.1
            else float(rng.choice([0, 1000, 4000, -50])) if kind < 0.5
            else round(rng.lognormvariate(8, 1.5), 2) * rng.choice([1, 1, 1, -1])
        )
        rows.append((key, rng.choice(["x", "y"]), value))
    return [*rows, ("none", "x", None), ("none", "x", None), (None, "y", 7.5)]


def groups(rows, position):
    out = {}
    for row in rows:
        out.setdefault(tuple(row[i] for i in position), []).append(row[2])
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    rows = sample(seed)
    df = spark.createDataFrame(rows, "k string, p string, v double")
    qs = {"q1": 0.25, "q3": 0.75, "lo": 0.0, "hi": 1.0}
    got = {(r["k"],): r for r in dicts(exact_quantiles(df, ["k"], "v", qs))}
    expected = groups(rows, [0])
    assert got.keys() == expected.keys()
    for key, values in expected.items():
        assert {n: got[key][n] for n in qs} == {n: nearest(values, q) for n, q in qs.items()}
    medians = exact_quantiles(df, ["k", "p"], "v", {"m": 0.5}, "linear")
    assert {(r["k"], r["p"]): r["m"] for r in dicts(medians)} == {
        k: median(v) for k, v in groups(rows, [0, 1]).items()
    }
    whole = exact_quantiles(df, [], "v", {"m": 0.5}, "linear")
    assert dicts(whole) == [{"m": median([r[2] for r in rows])}]


def test_with_parent(spark):
    rows = sample(3)
    df = spark.createDataFrame(rows, "k string, p string, v double")
    got = quantiles_with_parent(
        df, ["k"], ["p"], "v", {"q1": ("pq1", 0.25), "q3": ("pq3", 0.75)}
    )
    parents = groups(rows, [1])
    expected = {
        key: {
            "q1": nearest(values, 0.25),
            "q3": nearest(values, 0.75),
            "pq1": nearest(parents[key[1:]], 0.25),
            "pq3": nearest(parents[key[1:]], 0.75),
        }
        for key, values in groups(rows, [0, 1]).items()
    }
    assert {(r.pop("k"), r.pop("p")): r for r in dicts(got)} == expected


def test_nearest_rounds_half_away_and_median_averages(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (10.0,)], "v double")
    got = exact_quantiles(df, [], "v", {"q1": 0.25, "half": 0.5, "q3": 0.75})
    assert dicts(got) == [{"q1": 2.0, "half": 3.0, "q3": 3.0}]
    assert dicts(exact_quantiles(df, [], "v", {"m": 0.5}, "linear")) == [{"m": 2.5}]


def test_infinities_and_nan_sort_last(spark):
    df = spark.createDataFrame([(math.nan,), (math.inf,), (-math.inf,), (0.0,)], "v double")
    row = exact_quantiles(
        df, [], "v", {"a": 0.0, "b": 1 / 3, "c": 2 / 3, "d": 1.0}
    ).first()
    assert (row.a, row.b, row.c) == (-math.inf, 0.0, math.inf) and math.isnan(row.d)


def test_no_rows(spark):
    df = spark.createDataFrame([], "k string, v double")
    assert dicts(exact_quantiles(df, ["k"], "v", {"q": 0.5})) == []
    assert dicts(exact_quantiles(df, [], "v", {"q": 0.5})) == [{"q": None}]


@settings(max_examples=15, deadline=None)
@given(st.lists(st.floats(allow_nan=False), min_size=2, max_size=200))
def test_bins_never_decrease(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "v double")
    rows = df.selectExpr("v", f"{value_bin('v')} AS bin").collect()
    ordered = sorted(rows, key=lambda r: (r.v, r.bin))
    assert all(a.bin <= b.bin for a, b in zip(ordered, ordered[1:]))


def test_powers_of_two_and_their_neighbours_stay_ordered(spark):
    values = sorted(
        x for e in range(-30, 60) for x in (math.nextafter(2.0**e, 0), 2.0**e,
                                            math.nextafter(2.0**e, math.inf))
    )
    df = spark.createDataFrame([(v,) for v in values], "v double").coalesce(1)
    bins = [r.bin for r in df.selectExpr(f"{value_bin('v')} AS bin").collect()]
    assert bins == sorted(bins)


def stored_values(spark, tmp_path):
    spark.range(1000).selectExpr("id % 3 AS k", "id % 2 AS p", "double(id) AS v").write.parquet(
        str(tmp_path / "t")
    )
    return spark.read.parquet(str(tmp_path / "t"))


def test_values_are_shuffled_only_from_wanted_bins(spark, tmp_path):
    """Between the scan of the rows and the first exchange lies the join with the wanted bins."""
    df = stored_values(spark, tmp_path)
    for found in (
        exact_quantiles(df, ["k"], "v", {"q": 0.5}),
        quantiles_with_parent(df, ["k"], ["p"], "v", {"q": ("pq", 0.5)}),
    ):
        lines = plan(found).splitlines()
        scan = next(n for n, x in enumerate(lines) if "FileScan" in x and str(tmp_path) in x)
        nearest = next(n for x in lines[scan::-1] for n in ("Join", "Exchange") if n in x)
        assert nearest == "Join"
        assert "BroadcastHashJoin" in plan(found) and "SortMergeJoin" not in plan(found)
        assert sum("FileScan" in x and str(tmp_path) in x for x in lines) == 1


def test_more_wanted_bins_than_may_be_sent_are_joined_by_shuffle(spark, tmp_path):
    df = stored_values(spark, tmp_path)
    expected = dicts(exact_quantiles(df, ["k"], "v", {"q": 0.5}))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = exact_quantiles(df, ["k"], "v", {"q": 0.5})
        assert "SortMergeJoin" in plan(found)
        assert sorted(dicts(found), key=str) == sorted(expected, key=str)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_first_scan_shuffles_one_row_per_group_and_bin(spark, tmp_path):
    rows = 20_000
    df = spark.range(rows).selectExpr("id % 3 AS k", "4000 + id % 400 / 7.0D AS v")
    assert bin_counts(df, ["k"], "v").count() < 30


def test_no_window_or_exchange_holds_a_group_of_values(spark, tmp_path):
    """Values are windowed by (group, bin) only; windows by group see sums of bins."""
    found = plan(exact_median(stored_values(spark, tmp_path), ["k"], "v", "m"))
    windows = [x for x in found.splitlines() if "Window [" in x and "_v#" in x]
    assert windows and all("_bin#" in x.split("windowspecdefinition(")[1] for x in windows)


def test_only_some_groups(spark):
    rows = sample(4)
    df = spark.createDataFrame(rows, "k string, p string, v double")
    only = spark.createDataFrame([("hot", "x"), ("none", "x"), (None, "y")], "k string, p string")
    got = quantiles_with_parent(df, ["k"], ["p"], "v", {"m": ("pm", 0.5)}, "linear", only=only)
    own, parents = groups(rows, [0, 1]), groups(rows, [1])
    assert {(r["k"], r["p"]): (r["m"], r["pm"]) for r in dicts(got)} == {
        k: (median(own[k]), median(parents[k[1:]])) for k in [("hot", "x"), ("none", "x"), (None, "y")]
    }


def test_approximation_has_the_same_shape(spark):
    df = spark.createDataFrame(sample(5), "k string, p string, v double")
    got = approx_quantiles(df, ["k"], "v", {"q1": 0.25, "q3": 0.75})
    assert got.columns == ["k", "q1", "q3"]
    assert got.count() == df.select("k").distinct().count()
