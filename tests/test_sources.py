"""Cleaning, CSV scans and the Parquet store."""

from __future__ import annotations

import pytest
from conftest import SF_DIR, dicts, plan
from pyspark.sql import functions as F

from hirelens import (
    POSTINGS,
    FilterSpec,
    PostingColumns,
    apply_filters,
    build_clean,
    clean_postings,
    ensure_clean,
    kept,
    lines_are_closed,
    read_clean,
    read_csv_where,
    read_raw_csv,
    stored_bounds,
    write_clean,
    write_csv,
)
from hirelens.operators import domains
from hirelens.plans import pulse
from hirelens.schema import GRAINS
from hirelens.sources.clean_store import STORED_DAY, footer_days
from hirelens.sources.star_tables import raw_postings


def ids(df):
    return "".join(sorted(r.metadata_jobPostId for r in df.collect()))


def test_cleaning_drops_outliers_and_undated(raw):
    p = clean_postings(raw(
        {"metadata_jobPostId": "a", "numberOfVacancies": 9},
        {"metadata_jobPostId": "b", "numberOfVacancies": 10},
        {"metadata_jobPostId": "c", "numberOfVacancies": 0},
        {"metadata_jobPostId": "d", "numberOfVacancies": None},
        {"metadata_jobPostId": "e", "salary_maximum": 0.0},
        {"metadata_jobPostId": "f", "salary_maximum": None},
        {"metadata_jobPostId": "g", "metadata_newPostingDate": "n/a"},
        {"metadata_jobPostId": "h", "metadata_newPostingDate": None},
    ))
    assert ids(p) == "ac"
    assert p.columns == list(POSTINGS.clean_types)
    assert [f.dataType for f in p.schema] == list(POSTINGS.clean_types.values())


def test_cleaning_labels_every_row(raw):
    (row,) = dicts(clean_postings(raw({
        "title": "** Site  Engineer", "positionLevels": "Junior Executive, Non-executive",
        "categories": "[{''category'':''Engineering''}]", "metadata_repostCount": 2,
        "metadata_newPostingDate": "2021-01-01",
    })))
    expected = {
        "title": "Site Engineer", "PMET": "Non-PMET", "position_level": "Entry / Junior",
        "category": "Engineering", "broad_sector": "Industrial & Infrastructure",
        "job_repost": "Y", "Period_Weekly": "2021-W53", "Period_Monthly": "2021-01",
        "Period_Quarterly": "2021-Q1", "Period_Yearly": "2021",
    }
    assert {k: row[k] for k in expected} == expected
    assert str(row["metadata_jobPostingDate"]) == "2021-01-01 00:00:00"


def test_cleaning_is_one_narrow_plan(raw):
    assert "Exchange" not in plan(clean_postings(raw({})))


def test_other_column_names(spark, raw):
    names = PostingColumns(salary="pay", sector="branch", period_prefix="p_")
    renamed = raw({}, {"average_salary": 6000.0}).withColumnRenamed("average_salary", "pay")
    p = clean_postings(renamed, names)
    assert dicts(pulse.apps_by_sector(p, names)) == [
        {"branch": "Financial & Professional", "applications": 6, "share": 1.0}
    ]
    assert pulse.timeline(p, "Yearly", names).first().period == "2023"
    with pytest.raises(ValueError):
        names.period("Daily")


HEADER = ",".join(["extra", *reversed(list(POSTINGS.raw_types))])


def csv_line(extra="x", **values):
    defaults = {
        "metadata_jobPostId": "J", "title": "Nurse", "average_salary": "4000.5",
        "salary_maximum": "5000", "numberOfVacancies": "3", "minimumYearsExperience": "2",
        "categories": '"[{""id"":6,""category"":""Insurance""}]"',
        "metadata_newPostingDate": "2023-03-06",
    }
    cells = defaults | values
    return ",".join([extra, *[cells.get(n, "") for n in reversed(list(POSTINGS.raw_types))]])


def write_text(path, *lines):
    path.write_text("\n".join([HEADER, *lines]) + "\n")
    return str(path)


def test_csv_is_read_by_name_with_bad_cells_as_null(spark, tmp_path):
    path = write_text(
        tmp_path / "a.csv",
        csv_line(metadata_jobPostId="a"),
        csv_line(metadata_jobPostId="b", numberOfVacancies="many", average_salary="?"),
        csv_line(metadata_jobPostId="c", numberOfVacancies="4.0", title='"Two\nlines, ""quoted"""'),
    )
    df = read_raw_csv(spark, path)
    assert df.columns == list(POSTINGS.raw_types)
    assert [f.dataType for f in df.schema] == list(POSTINGS.raw_types.values())
    rows = {r["metadata_jobPostId"]: r for r in dicts(df)}
    assert rows["a"]["numberOfVacancies"] == 3 and rows["a"]["average_salary"] == 4000.5
    assert rows["a"]["categories"] == '[{"id":6,"category":"Insurance"}]'
    assert rows["b"]["numberOfVacancies"] is None and rows["b"]["average_salary"] is None
    assert rows["b"]["minimumYearsExperience"] == 2
    assert rows["c"]["numberOfVacancies"] == 4 and rows["c"]["title"] == 'Two\nlines, "quoted"'
    assert clean_postings(df).count() == 2


def test_csv_without_a_required_column_fails(spark, tmp_path):
    (tmp_path / "a.csv").write_text("title,average_salary\nNurse,1\n")
    with pytest.raises(ValueError, match="numberOfVacancies"):
        read_raw_csv(spark, str(tmp_path / "a.csv"))


def test_csv_filter_reaches_the_reader(spark, tmp_path):
    (tmp_path / "a.csv").write_text(
        "sector,day,n\nTechnology,2024-01-02,1\nFinance,2024-01-03,2\n"
    )
    df = read_csv_where(spark, str(tmp_path / "a.csv"), {"sector": "Technology"})
    assert [str(r.day) + str(r.n) for r in df.collect()] == ["2024-01-021"]
    assert dict(df.dtypes)["day"] == "date"
    assert "EqualTo(sector,Technology)" in plan(df)
    typed = read_csv_where(
        spark, str(tmp_path / "a.csv"), {"n": 2}, schema="sector string, day date, n int"
    )
    assert typed.count() == 1


def test_csv_round_trip(spark, tmp_path, raw):
    rows = raw(
        {"title": 'a "b", c\nd', "positionLevels": None, "average_salary": None},
        {"title": "", "categories": "[{''id'':1,''category'':''F&B''}]"},
    )
    write_csv(rows, str(tmp_path / "csv"))
    back = read_raw_csv(spark, str(tmp_path / "csv"))
    assert sorted(map(str, back.collect())) == sorted(map(str, rows.collect()))


def test_compressed_csv_round_trip(spark, tmp_path, raw):
    rows = raw({"title": "a\nb", "categories": "[{''id'':1,''category'':''F&B''}]"}, {"title": ""})
    write_csv(rows, str(tmp_path / "csv"), compression="gzip")
    assert not list(tmp_path.glob("csv/*.csv")) and list(tmp_path.glob("csv/*.csv.gz"))
    back = read_raw_csv(spark, str(tmp_path / "csv"))
    assert sorted(map(str, back.collect())) == sorted(map(str, rows.collect()))


def test_build_and_ensure(spark, tmp_path):
    csv, out = write_text(tmp_path / "a.csv", csv_line(metadata_jobPostId="a")), str(tmp_path / "p")
    assert ids(ensure_clean(spark, csv, out)) == "a"
    write_text(tmp_path / "a.csv", csv_line(metadata_jobPostId="b"))
    assert ids(ensure_clean(spark, csv, out)) == "a"  # complete: not built again
    (tmp_path / "p" / "_SUCCESS").unlink()
    assert ids(ensure_clean(spark, csv, out)) == "b"  # incomplete: built again
    assert ids(ensure_clean(spark, str(tmp_path / "missing.csv"), out)) == "b"
    with pytest.raises(FileNotFoundError):
        ensure_clean(spark, str(tmp_path / "missing.csv"), str(tmp_path / "q"))
    with pytest.raises(Exception, match="(?i)exists"):
        build_clean(spark, csv, out)


def test_store_round_trip_and_pruning(spark, tmp_path):
    p = clean_postings(raw_postings(spark, SF_DIR))
    for name, layout in {
        "plain": {},
        "years": {"partition_by_year": True, "sort_within": ("broad_sector", "category")},
    }.items():
        path = str(tmp_path / name)
        write_clean(p, path, **layout)
        back = read_clean(spark, path)
        assert back.columns == POSTINGS.read_columns
        assert dict(back.dtypes)["Period_Yearly"] == "string"
        wanted = p.select(*POSTINGS.read_columns)
        assert back.count() == p.count() and back.exceptAll(wanted).isEmpty()
        full = read_clean(spark, path, all_columns=True)
        assert set(full.columns) == set(POSTINGS.clean_types)
        spec = FilterSpec(
            sector="Industrial & Infrastructure", period_range=("1996-Q2", "1997-Q1")
        )
        kpi = pulse.kpi_summary(apply_filters(back, spec))
        assert dicts(kpi) == dicts(pulse.kpi_summary(apply_filters(wanted, spec)))
        text = plan(kpi)
        assert "EqualTo(broad_sector,Industrial & Infrastructure)" in text
        assert "GreaterThanOrEqual(Period_Quarterly,1996-Q2)" in text
        assert "title" not in text.split("ReadSchema")[1]
        if name == "years":
            scan = text.split("PartitionFilters: ")[1]
            assert "Period_Yearly" in scan.split("PushedFilters")[0]


def test_kept_frames_are_released(spark, raw):
    with kept(clean_postings(raw({}))) as held:
        assert held.count() == 1 and held.is_cached
    assert not held.is_cached


def test_derived_postings_reach_every_case(spark):
    raw = raw_postings(spark, SF_DIR)
    assert raw.count() == spark.read.parquet(f"{SF_DIR}/lineitem.parquet").count()
    p = clean_postings(raw)
    assert p.select("broad_sector").distinct().count() == 7
    assert p.select("position_level").distinct().count() == 5
    assert p.select("PMET").distinct().count() == 2
    assert not p.where("numberOfVacancies = 0").isEmpty()
    assert not p.where("average_salary IS NULL").isEmpty()


def test_files_are_split_only_where_every_line_is_closed(spark, tmp_path):
    many = [csv_line(metadata_jobPostId=f"j{i}", title='"A ""b"", c"') for i in range(300)]
    closed = write_text(tmp_path / "closed.csv", *many)
    broken = write_text(tmp_path / "broken.csv", *many, csv_line(title='"Two\nlines"'))
    assert lines_are_closed(spark, closed) and not lines_are_closed(spark, broken)
    # A break between doubled quotes leaves an odd number in each half.
    doubled = write_text(tmp_path / "doubled.csv", csv_line(title='"a ""\n"" b"'))
    assert not lines_are_closed(spark, doubled)
    (tmp_path / "empty.csv").write_text("")
    assert lines_are_closed(spark, str(tmp_path / "empty.csv"))
    size = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(size)
    spark.conf.set(size, "8k")
    try:
        split, whole = read_raw_csv(spark, closed), read_raw_csv(spark, broken)
        assert split.rdd.getNumPartitions() > 1 and split.count() == 300
        assert whole.rdd.getNumPartitions() == 1 and whole.count() == 301
        titles = {r.title for r in whole.select("title").collect()}
        assert titles == {'A "b", c', "Two\nlines"}
    finally:
        spark.conf.set(size, before)


def test_bounds_come_from_file_statistics(spark, tmp_path, raw):
    p = clean_postings(raw_postings(spark, SF_DIR))
    for name, layout in {"plain": {}, "years": {"partition_by_year": True}}.items():
        path = str(tmp_path / name)
        write_clean(p, path, **layout)
        for grain in GRAINS:
            found = stored_bounds(spark, path, grain)
            assert dicts(found) == dicts(domains.period_bounds(p, grain)), (name, grain)
    text = plan(footer_days(spark, str(tmp_path / "plain")))
    assert f"MIN({STORED_DAY}), MAX({STORED_DAY})" in text
    assert "spark.sql.parquet.aggregatePushdown" not in [
        r.key for r in spark.sql("SET").collect()
    ]
    none = str(tmp_path / "none")
    write_clean(p.where("false"), none)
    for grain in GRAINS:
        assert dicts(stored_bounds(spark, none, grain)) == [{"lo": None, "hi": None}]


def test_clustered_layout_bounds_the_files_of_a_year(spark, tmp_path):
    p = clean_postings(raw_postings(spark, SF_DIR)).repartition(24)
    keys = ("broad_sector", "category")

    def files(name, **layout):
        path = tmp_path / name
        write_clean(p, str(path), partition_by_year=True, sort_within=keys, **layout)
        return {y.name: sorted(y.glob("*.parquet")) for y in path.glob("Period_Yearly=*")}

    spread, close = files("spread"), files("close", clustered=True)
    assert spread.keys() == close.keys()
    assert max(map(len, spread.values())) > 10
    assert max(map(len, close.values())) == 1  # small years are one file each
    for group in close.values():
        rows = [tuple(r) for r in spark.read.parquet(str(group[0])).select(*keys).collect()]
        assert rows == sorted(rows)
    # A year above the advisory size is split between tasks.
    size = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    before = spark.conf.get(size)
    spark.conf.set(size, "32k")
    try:
        assert max(map(len, files("split", clustered=True).values())) > 1
    finally:
        spark.conf.set(size, before)
    back = read_clean(spark, str(tmp_path / "split"))
    assert back.count() == p.count() and back.exceptAll(p.select(*POSTINGS.read_columns)).isEmpty()
