from __future__ import annotations

import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))

from checks.session import local_session  # noqa: E402
from hirelens.schema import POSTINGS, struct_of  # noqa: E402

SF_DIR = "/root/testdata/sf0.001"

# A cleaned posting in the middle of everything; tests override what they are about.
CLEAN_DEFAULTS = {
    "metadata_jobPostId": "J",
    "title": "Nurse",
    "postedCompany_name": "X",
    "employmentTypes": "Full Time",
    "average_salary": 4000.0,
    "salary_maximum": 5000.0,
    "numberOfVacancies": 1,
    "minimumYearsExperience": 2,
    "metadata_totalNumberJobApplication": 3,
    "metadata_repostCount": 0,
    "metadata_totalNumberOfView": 10,
    "metadata_jobPostingDate": None,
    "job_repost": "N",
    "PMET": "PMET",
    "category": "Engineering",
    "broad_sector": "Industrial & Infrastructure",
    "position_level": "Manager / Professional",
    "Period_Weekly": "2023-W10",
    "Period_Monthly": "2023-03",
    "Period_Quarterly": "2023-Q1",
    "Period_Yearly": "2023",
}

RAW_DEFAULTS = {
    "metadata_jobPostId": "J",
    "title": "Nurse",
    "postedCompany_name": "X",
    "employmentTypes": "Full Time",
    "positionLevels": "Manager",
    "average_salary": 4000.0,
    "salary_maximum": 5000.0,
    "numberOfVacancies": 1,
    "minimumYearsExperience": 2,
    "metadata_totalNumberJobApplication": 3,
    "metadata_repostCount": 0,
    "metadata_totalNumberOfView": 10,
    "categories": '[{"id":6,"category":"Insurance"}]',
    "metadata_newPostingDate": "2023-03-06",
}


@pytest.fixture(scope="session")
def spark():
    session = local_session("4", "4g")
    session.conf.set("spark.sql.maxMetadataStringLength", 10000)  # whole plans in texts
    yield session
    session.stop()


def _frame(spark, types, defaults, rows):
    unknown = {k for r in rows for k in r} - set(defaults)
    assert not unknown, unknown
    return spark.createDataFrame(
        [tuple((defaults | r)[n] for n in types) for r in rows], struct_of(types)
    )


@pytest.fixture
def clean(spark):
    """Make cleaned postings from dicts of what differs from the default."""
    return lambda *rows: _frame(spark, POSTINGS.clean_types, CLEAN_DEFAULTS, rows)


@pytest.fixture
def raw(spark):
    return lambda *rows: _frame(spark, POSTINGS.raw_types, RAW_DEFAULTS, rows)


def dicts(df):
    return [r.asDict() for r in df.collect()]


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()
