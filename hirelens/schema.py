"""Column binding and schemas of the posting tables.

Every operator takes its column names from a :class:`PostingColumns`, so the
same plans run on any table of postings: build one with other names and pass
it as ``c``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

# The time grains a posting is labelled with.
GRAINS = ("Weekly", "Monthly", "Quarterly", "Yearly")
DEFAULT_GRAIN = "Quarterly"


@dataclass(frozen=True)
class PostingColumns:
    """Names of the columns the operators read and write."""

    # raw
    job_id: str = "metadata_jobPostId"
    title: str = "title"
    company: str = "postedCompany_name"
    employment: str = "employmentTypes"
    levels_text: str = "positionLevels"
    salary: str = "average_salary"
    max_salary: str = "salary_maximum"
    vacancies: str = "numberOfVacancies"
    experience: str = "minimumYearsExperience"
    applications: str = "metadata_totalNumberJobApplication"
    repost_count: str = "metadata_repostCount"
    views: str = "metadata_totalNumberOfView"
    categories_text: str = "categories"
    posted_text: str = "metadata_newPostingDate"
    # derived
    posted_at: str = "metadata_jobPostingDate"
    repost: str = "job_repost"
    pmet: str = "PMET"
    category: str = "category"
    sector: str = "broad_sector"
    level: str = "position_level"
    period_prefix: str = "Period_"

    def period(self, grain: str = DEFAULT_GRAIN) -> str:
        """Name of the label column of a grain."""
        if grain not in GRAINS:
            raise ValueError(f"grain must be one of {GRAINS}, got {grain!r}")
        return self.period_prefix + grain

    @property
    def periods(self) -> list[str]:
        return [self.period(g) for g in GRAINS]

    @property
    def raw_types(self) -> dict[str, T.DataType]:
        """The required raw columns with their types, in order."""
        return {
            self.job_id: T.StringType(),
            self.title: T.StringType(),
            self.company: T.StringType(),
            self.employment: T.StringType(),
            self.levels_text: T.StringType(),
            self.salary: T.DoubleType(),
            self.max_salary: T.DoubleType(),
            self.vacancies: T.LongType(),
            self.experience: T.IntegerType(),
            self.applications: T.LongType(),
            self.repost_count: T.LongType(),
            self.views: T.LongType(),
            self.categories_text: T.StringType(),
            self.posted_text: T.StringType(),
        }

    @property
    def clean_types(self) -> dict[str, T.DataType]:
        """All columns of the cleaned table, in the order they are written."""
        raw = self.raw_types
        dropped = (self.categories_text, self.levels_text, self.posted_text)
        kept = {n: t for n, t in raw.items() if n not in dropped}
        labels = [self.repost, self.pmet, self.category, self.sector, self.level]
        return (
            kept
            | {self.posted_at: T.TimestampType()}
            | {n: T.StringType() for n in labels + self.periods}
        )

    @property
    def read_columns(self) -> list[str]:
        """The columns the reports need; the scan of the cleaned table stops here."""
        return [
            self.vacancies,
            self.applications,
            self.views,
            self.job_id,
            self.repost_count,
            self.salary,
            self.sector,
            self.category,
            self.level,
            self.pmet,
            self.repost,
            self.title,
            self.experience,
            *self.periods,
        ]


POSTINGS = PostingColumns()


def struct_of(types: dict[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in types.items()])
