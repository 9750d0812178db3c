"""Raw postings derived from an orders/lineitem/part star schema.

Public posting data of this shape does not exist, so tests, the registered
queries and the benchmark take every line item as one posting. The mapping is
chosen to reach all cases: every sector and seniority level, missing values,
both spellings of embedded category text, unreadable dates and untidy titles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..functions.rules import literal, name
from ..schema import POSTINGS, PostingColumns

# Category name by brand number (25 has none).
CATEGORY_OF_BRAND = {
    1: "Banking and Finance",
    2: "Accounting / Auditing / Taxation",
    3: "Consulting",
    4: "Insurance",
    5: "Healthcare / Pharmaceutical",
    6: "Education and Training",
    7: "Social Services",
    8: "Public / Civil Service",
    9: "Information Technology",
    10: "Telecommunications",
    11: "Building and Construction",
    12: "Engineering",
    13: "Logistics / Supply Chain",
    14: "Manufacturing",
    15: "F&B",
    16: "Hospitality",
    17: "Travel / Tourism",
    18: "Marketing / Public Relations",
    19: "Sales / Retail",
    20: "General Management",
    21: "Admin / Secretarial",
    22: "Human Resources",
    23: "Sciences / Laboratory / R&D",
    24: "Wholesale Trade",
}

# Position levels by order priority, for return flag A, N, other.
LEVELS_OF_PRIORITY = {
    "1-URGENT": ("Senior Management", "Senior Management", "Senior Management"),
    "2-HIGH": ("Middle Management", "Manager", "Manager"),
    "3-MEDIUM": ("Professional", "Senior Executive", "Executive"),
    "4-NOT SPECIFIED": (None, "Non-executive", "Non-executive"),
    "5-LOW": ("Fresh/entry level", "Junior Executive", "Junior Executive, Non-executive"),
}


def _levels() -> str:
    branches = " ".join(
        f"WHEN o_orderpriority = {literal(priority)} THEN CASE l_returnflag "
        f"WHEN 'A' THEN {literal(a)} WHEN 'N' THEN {literal(n)} ELSE {literal(other)} END"
        for priority, (a, n, other) in LEVELS_OF_PRIORITY.items()
    )
    return f"CASE {branches} END"


def _categories() -> str:
    pairs = ", ".join(f"{b}, {literal(n)}" for b, n in CATEGORY_OF_BRAND.items())
    category = f"try_element_at(map({pairs}), brand)"
    single = [literal("[{''id'':"), "brand", literal(",''category'':''"), category, literal("''}]")]
    double = [
        literal('[{"id":'),
        "brand",
        literal(',"category": "'),
        category,
        literal('"},{"id":99,"category":"Second"}]'),
    ]
    return (
        f"CASE WHEN l_linenumber % 2 = 0 THEN concat({', '.join(single)}) "
        f"ELSE concat({', '.join(double)}) END"
    )


TITLE = """CASE l_linenumber % 5
    WHEN 0 THEN p_name
    WHEN 1 THEN upper(p_name)
    WHEN 2 THEN concat('** ', p_name)
    WHEN 3 THEN concat(upper(substr(p_name, 1, 1)), substr(p_name, 2))
    ELSE replace(p_name, ' ', '   ') END"""


def raw_postings(spark: SparkSession, sf_dir: str, c: PostingColumns = POSTINGS) -> DataFrame:
    """One raw posting per line item.

    Both joins are on keys of growing tables and carry no broadcast hint: the
    optimizer broadcasts a side only if its size allows, and splits skewed
    partitions at run time otherwise.
    """
    lines, orders, parts = (
        spark.read.parquet(f"{sf_dir}/{table}.parquet") for table in ("lineitem", "orders", "part")
    )
    rows = (
        lines.join(orders, lines["l_orderkey"] == orders["o_orderkey"])
        .join(parts, lines["l_partkey"] == parts["p_partkey"])
        .selectExpr("*", "cast(substr(p_brand, 7) AS int) AS brand")
    )
    columns = {
        c.job_id: "concat('JOB-', l_orderkey, '-', l_linenumber)",
        c.title: TITLE,
        c.company: "concat('Supplier#', l_suppkey)",
        c.employment: "CASE l_returnflag WHEN 'A' THEN 'Permanent' WHEN 'N' THEN 'Full Time' "
        "ELSE 'Contract' END",
        c.levels_text: _levels(),
        c.salary: "CASE WHEN p_size % 23 <> 0 THEN l_extendedprice / 10 END",
        c.max_salary: "CASE WHEN l_discount = 0 THEN 0 ELSE l_extendedprice / 8 END",
        c.vacancies: "cast(l_quantity AS bigint) % 12",
        c.experience: "CASE WHEN p_size % 17 <> 0 THEN p_size % 11 END",
        c.applications: "l_orderkey % 37",
        c.repost_count: "l_suppkey % 3",
        c.views: "l_partkey % 211",
        c.categories_text: _categories(),
        c.posted_text: "CASE WHEN l_orderkey % 50 = 0 THEN 'n/a' "
        "ELSE cast(cast(o_orderdate AS date) AS string) END",
    }
    return rows.selectExpr(
        *[
            f"cast({columns[n]} AS {t.simpleString()}) AS {name(n)}"
            for n, t in c.raw_types.items()
        ]
    )
