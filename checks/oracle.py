"""The registered queries once more, as plain SQL for an independent engine.

Written from the definitions and not from the Spark plans: medians are the
engine's own, quartiles count rows in order, titles are ranked by windows.
Every statement starts from the same derived postings.
"""

from __future__ import annotations

from hirelens.functions.rules import SECTOR_RULES, SENIORITY_RULES
from hirelens.sources.star_tables import CATEGORY_OF_BRAND, LEVELS_OF_PRIORITY


def _text(value: str | None) -> str:
    return "NULL" if value is None else "'" + value.replace("'", "''") + "'"


_BRANDS = ", ".join(f"({b}, {_text(n)})" for b, n in CATEGORY_OF_BRAND.items())
_LEVELS = "\n".join(
    f"WHEN o_orderpriority = {_text(p)} THEN CASE l_returnflag "
    f"WHEN 'A' THEN {_text(a)} WHEN 'N' THEN {_text(n)} ELSE {_text(o)} END"
    for p, (a, n, o) in LEVELS_OF_PRIORITY.items()
)
_SECTORS = "\n".join(
    f"WHEN regexp_matches(lower(category), {_text(p)}) THEN {_text(s)}" for p, s in SECTOR_RULES
)
_SENIORITY = "\n".join(
    f"WHEN regexp_matches(lower(levels_text), {_text(p)}) THEN {_text(s)}"
    for p, s in SENIORITY_RULES
)

POSTINGS_CTE = f"""
WITH brand_category(b, name) AS (VALUES {_BRANDS}),
raw AS (
  SELECT 'JOB-' || l_orderkey || '-' || l_linenumber AS job_id,
    CASE l_linenumber % 5 WHEN 0 THEN p_name WHEN 1 THEN upper(p_name)
      WHEN 2 THEN '** ' || p_name
      WHEN 3 THEN upper(substr(p_name, 1, 1)) || substr(p_name, 2)
      ELSE replace(p_name, ' ', '   ') END AS raw_title,
    CASE {_LEVELS} END AS levels_text,
    CASE WHEN p_size % 23 = 0 THEN NULL ELSE l_extendedprice / 10 END AS salary,
    CASE WHEN l_discount = 0 THEN 0 ELSE l_extendedprice / 8 END AS max_salary,
    cast(l_quantity AS bigint) % 12 AS vac,
    CASE WHEN p_size % 17 = 0 THEN NULL ELSE p_size % 11 END AS years,
    l_orderkey % 37 AS apps, l_suppkey % 3 AS repost_count, l_partkey % 211 AS views,
    CASE WHEN name IS NULL THEN NULL
      WHEN l_linenumber % 2 = 0
        THEN '[{{''''id'''':' || b || ',''''category'''':''''' || name || '''''}}]'
      ELSE '[{{"id":' || b || ',"category": "' || name || '"}},{{"id":99,"category":"Second"}}]'
      END AS categories_text,
    CASE WHEN l_orderkey % 50 = 0 THEN 'n/a' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS posted
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
    LEFT JOIN brand_category ON cast(substr(p_brand, 7) AS integer) = b
),
extracted AS (
  SELECT *, try_cast(posted AS timestamp) AS posted_at,
    trim(regexp_replace(regexp_replace(raw_title, '^[^a-zA-Z0-9]+', ''),
      '[\\s\\p{{Z}}]+', ' ', 'g')) AS title,
    CASE WHEN repost_count > 0 THEN 'Y' ELSE 'N' END AS repost,
    CASE WHEN contains(lower(levels_text), 'non-executive') THEN 'Non-PMET' ELSE 'PMET' END AS pmet,
    coalesce(nullif(regexp_extract(replace(categories_text, '''''', '"'),
      '"category":\\s*"([^"]+)"', 1), ''), 'General / Others') AS category,
    CASE {_SENIORITY} ELSE 'Executive / Senior Executive' END AS level
  FROM raw
),
labelled AS (
  SELECT *, CASE WHEN lower(category) = 'marketing / public relations' THEN 'Others'
      {_SECTORS} ELSE 'Others' END AS sector,
    year(posted_at) || '-W' || week(posted_at) AS weekly,
    strftime(posted_at, '%Y-%m') AS monthly,
    year(posted_at) || '-Q' || quarter(posted_at) AS quarterly,
    cast(year(posted_at) AS varchar) AS yearly
  FROM extracted
),
postings AS (
  SELECT * FROM labelled WHERE vac < 10 AND max_salary > 0 AND posted_at IS NOT NULL
)
"""


def _big(expression: str) -> str:
    return f"cast(coalesce({expression}, 0) AS bigint)"


def _round(expression: str, digits: int) -> str:
    scale = f"1{'0' * digits}.0::double"
    return f"(round_even(({expression}) * {scale}, 0) / {scale})"


def _finite_text(expression: str, spec: str) -> str:
    return f"coalesce(format('{{:{spec}}}', ({expression})::double), 'nan')"


_VAC, _APPS, _VIEWS = _big("sum(vac)"), _big("sum(apps)"), _big("sum(views)")
_REPOSTS = "count(job_id) FILTER (WHERE repost = 'Y')"
_KPIS = (
    f"{_VAC} AS vacancies, {_APPS} AS applications, {_VIEWS} AS views, "
    f"count(*) AS posts, {_REPOSTS} AS reposts"
)
_KPI_RATIOS = (
    "*, CASE WHEN vacancies > 0 THEN applications / vacancies ELSE 0.0::double END AS apps_per_vacancy, "
    "CASE WHEN posts > 0 THEN views / posts ELSE 0.0::double END AS views_per_post"
)


def _kpi(where: str = "true") -> str:
    return f"SELECT {_KPI_RATIOS} FROM (SELECT {_KPIS} FROM postings WHERE {where})"


def _timeline(label: str) -> str:
    ratio = "(CASE WHEN vacancies = 0 AND applications = 0 THEN 0 ELSE applications / vacancies END)"
    return f"""SELECT *, {ratio} AS apps_per_vacancy, {_round(ratio, 2)} AS apps_per_vacancy_plotted
      FROM (SELECT {label} AS period, pmet AS "PMET", {_VAC} AS vacancies, {_APPS} AS applications
        FROM postings GROUP BY ALL)"""


def _pulse(where: str = "true") -> str:
    return f"""SELECT quarterly AS period, pmet AS "PMET", sector AS broad_sector,
      level AS position_level, cast(grouping(quarterly, pmet, sector, level) AS bigint) AS grouping, {_KPIS}
      FROM postings WHERE {where} GROUP BY GROUPING SETS ((quarterly, pmet), (sector), (level), ())"""


def _share(column: str, name: str) -> str:
    return f"""SELECT {column} AS {name}, {_APPS} AS applications,
      {_APPS} / (SELECT cast(sum(apps) AS bigint) FROM postings) AS share FROM postings GROUP BY {column}"""


_MARKET = f"""market AS (
  SELECT *, CASE WHEN isnan(v) THEN 0 ELSE v END AS views_per_posting,
    CASE WHEN isnan(a) THEN 0 ELSE a END AS apps_per_vacancy
  FROM (SELECT *, {_round("views / postings", 2)} AS v, {_round("applications / vacancies", 2)} AS a
    FROM (SELECT category, min(sector) AS broad_sector, {_VAC} AS vacancies, {_APPS} AS applications,
      {_VIEWS} AS views, count(job_id) AS postings FROM postings GROUP BY category)))"""
_MARKET_COLUMNS = (
    "category, broad_sector, vacancies, applications, views, postings, "
    "views_per_posting, apps_per_vacancy"
)


def _quartiles(name: str, keys: str, source: str, prefix: str = "") -> str:
    """Quartiles as the value whose rank is the nearest to (n-1)q."""
    return f"""{name} AS (
      SELECT {keys}, min(CASE WHEN i = round((n - 1) * 0.25) THEN salary END) AS {prefix}q1,
        min(CASE WHEN i = round((n - 1) * 0.75) THEN salary END) AS {prefix}q3
      FROM (SELECT {keys}, salary,
          row_number() OVER (PARTITION BY {keys} ORDER BY salary) - 1 AS i,
          count(*) OVER (PARTITION BY {keys}) AS n
        FROM {source} WHERE salary IS NOT NULL)
      GROUP BY {keys})"""


_BENCHMARKS = f"""{_quartiles("broad_quartiles", "sector, level", "postings", "broad_")},
benchmarks AS (
  SELECT m.sector, m.level, broad_q1, broad_q3, broad_avg_exp
  FROM (SELECT sector, level, avg(years) AS broad_avg_exp FROM postings GROUP BY ALL) m
  LEFT JOIN broad_quartiles q ON m.sector = q.sector AND m.level = q.level)"""

_COMPETITION = f"""competition AS (
  SELECT *, category || ' (' || {_finite_text(_round("apps_per_vac", 1), ".1f")} || ')' AS category_with_ratio
  FROM (SELECT *, CASE WHEN vacancies = 0 THEN 0 ELSE applications / vacancies END AS apps_per_vac
    FROM (SELECT category, sector AS broad_sector, {_APPS} AS applications, {_VAC} AS vacancies,
      median(salary) AS median_salary, avg(years) AS avg_exp
      FROM postings GROUP BY category, sector)))"""

_STRUCTURE = f"""{_BENCHMARKS}, {_COMPETITION},
inside AS (SELECT * FROM postings WHERE category IN
  (SELECT category FROM competition ORDER BY apps_per_vac DESC, category LIMIT 5)),
{_quartiles("own_quartiles", "category, sector, level", "inside")},
structure AS (
  SELECT s.category, s.sector AS broad_sector, s.level AS position_level, q1, q3, avg_exp, vacancies,
    broad_q1, broad_q3, broad_avg_exp
  FROM (SELECT category, sector, level, avg(years) AS avg_exp, {_VAC} AS vacancies
    FROM inside GROUP BY ALL) s
  LEFT JOIN own_quartiles q ON s.category = q.category AND s.sector = q.sector AND s.level = q.level
  LEFT JOIN benchmarks b ON s.sector = b.sector AND s.level = b.level)"""
_UP = "CASE WHEN (q1 + q3) / 2 > (broad_q1 + broad_q3) / 2 THEN 'up' ELSE 'down' END"


def _comparison(style: str) -> str:
    if style == "k":
        def pay(n):
            return _finite_text(f"{n} / 1000", ".1f") + " || 'k'"

        def exp(n):
            return _finite_text(n, ".1f")
    else:
        def pay(n):
            return f"format('{{:,}}', cast(trunc(coalesce({n}, 0)) AS bigint))"

        def exp(n):
            return _finite_text(_round(f"coalesce({n}, 0)", 1), ".1f")
    return (
        f"'Sub-sector (' || position_level || '): Pay: $' || {pay('q1')} || '-$' || {pay('q3')}"
        f" || ' | Exp: ' || {exp('avg_exp')} || 'y Sector Benchmark: Pay: $' || {pay('broad_q1')}"
        f" || '-$' || {pay('broad_q3')} || ' | Exp: ' || {exp('broad_avg_exp')} || 'y (' || {_UP}"
        " || ' Market Positioning)'"
    )


_HIERARCHY = f""", {_STRUCTURE}, leaves AS (SELECT *, {_comparison("k")} AS text FROM structure)
SELECT 0 AS depth, 'root' AS id, 'Top 5' AS label, '' AS parent, {_big("sum(vacancies)")} AS value FROM leaves
UNION ALL SELECT 1, category, category, 'root', {_big("sum(vacancies)")} FROM leaves GROUP BY category
UNION ALL SELECT 2, category || '|' || position_level, position_level, category, {_big("sum(vacancies)")}
  FROM leaves GROUP BY category, position_level
UNION ALL SELECT 3, category || '|' || position_level || '|data', text, category || '|' || position_level,
  vacancies FROM leaves"""


def _titles(name: str, shown: str) -> str:
    return f"""{name}_spellings AS (
      SELECT category, {shown} AS title, lower(title) AS lower_title, count(*) AS n
      FROM postings GROUP BY ALL),
    {name}_roles AS (SELECT category, lower_title, title, n FROM {name}_spellings
      QUALIFY row_number() OVER (PARTITION BY category, lower_title ORDER BY n DESC, title) = 1),
    {name} AS (SELECT category, string_agg(title, ', ' ORDER BY rk) AS titles
      FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY n DESC, title) AS rk
        FROM {name}_roles) WHERE rk <= 3 GROUP BY category)"""


_CLEANED_AGAIN = (
    "trim(regexp_replace(regexp_replace(title, '^[^a-zA-Z0-9]+', ''), '[\\s\\p{Z}]+', ' ', 'g'))"
)
_TITLES = _titles("titles", "title")

_FRICTION = f"""sector_medians AS (
  SELECT sector, median(salary) AS sector_median FROM postings GROUP BY sector),
friction AS (
  SELECT category, sector AS broad_sector, postings, vacancies, applications, median_salary, repost_count,
    sector_median, {_round("(median_salary / sector_median - 1) * 100", 2)} AS salary_premium_pct,
    {_round("repost_count / postings * 100", 2)} AS friction_pct,
    {_round("applications / nullif(vacancies, 0)", 2)} AS apps_per_vac
  FROM (SELECT category, sector, count(job_id) AS postings, {_VAC} AS vacancies, {_APPS} AS applications,
      median(salary) AS median_salary, count(*) FILTER (WHERE repost = 'Y') AS repost_count
    FROM postings GROUP BY category, sector) JOIN sector_medians USING (sector)
  ORDER BY vacancies DESC, category LIMIT 10)"""

_PARENTS = """parents AS (
  SELECT sector, median(salary) AS parent_median, avg(years) AS parent_avg_exp
  FROM postings GROUP BY sector)"""
_TOTALS = (
    "totals AS (SELECT cast(coalesce(nullif(sum(vac), 0), 1) AS bigint) AS total_vacancies, "
    "cast(coalesce(nullif(sum(apps), 0), 1) AS bigint) AS total_applications FROM postings)"
)
_TOP_SENIORITY = f"""top_levels AS (
  SELECT category, level AS top_seniority
  FROM (SELECT category, level, {_APPS} AS a FROM postings GROUP BY ALL)
  QUALIFY row_number() OVER (PARTITION BY category ORDER BY a DESC, level) = 1)"""


def _indicator(diff: str, band: float, names: tuple[str, str, str]) -> str:
    high, low, same = names
    return (
        f"CASE WHEN {diff} > {band} THEN '{high}' WHEN {diff} < -{band} THEN '{low}' "
        f"ELSE '{same}' END"
    )


_TABLE = f"""{_PARENTS}, {_TOTALS}, {_TOP_SENIORITY}, {_TITLES},
sums AS (
  SELECT category, sector, count(job_id) AS postings, {_VAC} AS vacancies, {_APPS} AS applications,
    {_VIEWS} AS views, count(*) FILTER (WHERE repost = 'Y') AS job_reposts,
    median(salary) AS median_salary, avg(years) AS avg_exp
  FROM postings GROUP BY category, sector),
full_table AS (
  SELECT category, sector AS broad_sector, postings, vacancies,
    {_round("vacancies / total_vacancies * 100", 1)} AS pct_vacancies, applications,
    {_round("applications / total_applications * 100", 1)} AS pct_applications,
    {_round("applications / vacancies", 1)} AS apps_per_vac, median_salary,
    {_indicator("median_salary - parent_median", 0, ("higher", "lower", "match"))} AS salary_vs_sector,
    parent_median, avg_exp,
    {_indicator("avg_exp - parent_avg_exp", 0.2, ("more", "less", "similar"))} AS exp_vs_sector,
    parent_avg_exp, top_seniority, views, {_round("views / postings", 1)} AS views_per_post, job_reposts,
    {_round("job_reposts / postings * 100", 1)} AS pct_reposts, titles
  FROM sums CROSS JOIN totals JOIN parents USING (sector) JOIN top_levels USING (category)
    LEFT JOIN titles USING (category))"""


def _formatted() -> str:
    money = "CASE WHEN {0} IS NULL THEN '-' ELSE 'S$ ' || format('{{:,.0f}}', {0}) END AS {0}"
    columns = [money.format(n) for n in ("median_salary", "parent_median")]
    columns += [f"{_finite_text(n, '.1f')} || ' yrs' AS {n}" for n in ("avg_exp", "parent_avg_exp")]
    columns += [
        f"{_finite_text(n, ',.0f')} AS {n}"
        for n in ("vacancies", "applications", "views", "job_reposts")
    ]
    columns += [f"{_finite_text(n, '.1f')} AS {n}" for n in ("apps_per_vac", "views_per_post")]
    columns += [
        f"{_finite_text(n, '.1f')} || '%' AS {n}"
        for n in ("pct_vacancies", "pct_applications", "pct_reposts")
    ]
    return f", {_TABLE} SELECT * EXCLUDE (postings) REPLACE ({', '.join(columns)}) FROM full_table"


_CLEAN = f"""SELECT vac AS "numberOfVacancies", apps AS "metadata_totalNumberJobApplication",
  views AS "metadata_totalNumberOfView", job_id AS "metadata_jobPostId",
  repost_count AS "metadata_repostCount", salary AS average_salary, sector AS broad_sector, category,
  level AS position_level, pmet AS "PMET", repost AS job_repost, title,
  years AS "minimumYearsExperience", weekly AS "Period_Weekly", monthly AS "Period_Monthly",
  quarterly AS "Period_Quarterly", yearly AS "Period_Yearly" FROM postings"""


# Rows of the whole dashboard: report, its statement, what names a row, figures, texts.
_DASHBOARD = (
    ("kpi_cards", "kpi_cards", "label", "position", "value"),
    (
        "pulse", "pulse_grouping_sets", 'period, "PMET", broad_sector, position_level, grouping',
        "vacancies applications views posts reposts", "",
    ),
    (
        "timeline", "timeline_quarterly", 'period, "PMET"',
        "vacancies applications apps_per_vacancy apps_per_vacancy_plotted", "",
    ),
    ("apps_by_seniority", "apps_by_seniority", "position_level", "applications share", ""),
    ("apps_by_sector", "apps_by_sector", "broad_sector", "applications share", ""),
    (
        "market", "market_zones", "category",
        "vacancies applications views postings views_per_posting apps_per_vacancy weighted_avg_views median_vacancies",
        "broad_sector zone",
    ),
    ("market", "top3_competitive", "category", "top_competitive", ""),
    (
        "competition_top", "competition_top10", "category",
        "applications vacancies median_salary avg_exp apps_per_vac",
        "broad_sector category_with_ratio salary_text experience_text",
    ),
    ("hierarchy", "hierarchy", "id", "depth value", "label parent"),
    (
        "friction", "friction_zones", "category",
        "postings vacancies applications median_salary repost_count sector_median salary_premium_pct"
        " friction_pct apps_per_vac friction_median",
        "broad_sector zone",
    ),
    (
        "table", "table_formatted", "category, broad_sector", "",
        "vacancies pct_vacancies applications pct_applications apps_per_vac median_salary salary_vs_sector"
        " parent_median avg_exp exp_vs_sector parent_avg_exp top_seniority views views_per_post job_reposts"
        " pct_reposts titles",
    ),
)


def _dashboard(bodies: dict[str, str]) -> str:
    parts = []
    for report, body, item, figures, texts in _DASHBOARD:
        inner = bodies[body].strip()
        inner = "WITH " + inner[1:] if inner.startswith(",") else inner
        for n in (*figures.split(), *texts.split()):
            number = f"cast({n} AS double)" if n in figures.split() else "NULL::double"
            text = f"{n}" if n in texts.split() else "NULL::varchar"
            parts.append(
                f"SELECT '{report}' AS report, concat_ws('|', {item}) AS item, '{n}' AS measure, "
                f"{number} AS number, {text} AS text FROM ({inner})"
            )
    return " UNION ALL ".join(parts)


# The catalogue of filters: names and grains, and the default range of each grain.
_CATALOGUE = " UNION ALL ".join(
    [
        f"SELECT DISTINCT '{n}' AS dimension, {n} AS value, NULL::varchar AS parent FROM postings"
        for n in ("sector", "level", "pmet", "weekly", "monthly", "quarterly", "yearly")
    ]
    + ["SELECT DISTINCT 'category', category, sector FROM postings"]
    + [
        f"SELECT '{n}', {f}({n}), '{shown}' FROM postings"
        for n in ("weekly", "monthly", "quarterly", "yearly")
        for f, shown in (("min", "first"), ("max", "last"))
    ]
)

_FILTERED_CTE = (
    POSTINGS_CTE.replace("postings AS (", "every_posting AS (")
    + """, postings AS (SELECT * FROM every_posting WHERE sector = 'Industrial & Infrastructure'
      AND pmet = 'PMET' AND level = 'Manager / Professional' AND repost = 'N'
      AND quarterly BETWEEN '1996-Q2' AND '2000-Q3')
    """
)


def statements() -> dict[str, str]:
    bodies = {
        # cleaning
        "clean_postings": _CLEAN,
        "ingest_csv_to_parquet": _CLEAN,
        "ingest_if_missing": _CLEAN,
        "ingest_line_breaks": _CLEAN,
        "ingest_day_first_dates": _CLEAN,
        "ingest_counts": """SELECT count(*) AS rows_read,
          count(*) FILTER (NOT coalesce(vac < 10 AND max_salary > 0, false)) AS outliers,
          count(*) FILTER (vac < 10 AND max_salary > 0 AND posted = 'n/a') AS unreadable_dates,
          (SELECT count(*) FROM postings) AS rows_kept,
          count(*) FILTER (salary IS NULL) AS without_salary FROM raw""",
        "csv_filtered_scan": 'SELECT vac AS "numberOfVacancies", count(*) AS postings FROM raw '
        "WHERE repost_count = 0 GROUP BY vac",
        "outlier_filter": "SELECT vac AS \"numberOfVacancies\", count(*) AS postings, min(max_salary) AS "
        "min_max_salary FROM raw WHERE vac < 10 AND max_salary > 0 GROUP BY vac",
        "title_rules": "SELECT raw_title, title, count(*) AS postings FROM extracted GROUP BY ALL",
        "category_rules": "SELECT categories_text AS categories, category, count(*) AS postings "
        "FROM extracted GROUP BY ALL",
        "sector_rules": "SELECT category, sector AS broad_sector, count(*) AS postings FROM labelled "
        "GROUP BY ALL",
        "seniority_rules": "SELECT levels_text AS \"positionLevels\", level AS position_level, pmet AS "
        "\"PMET\", count(*) AS postings FROM labelled GROUP BY ALL",
        "repost_flags": "SELECT repost_count AS \"metadata_repostCount\", repost AS job_repost, "
        "count(*) AS postings FROM extracted GROUP BY ALL",
        "period_labels": "SELECT posted AS \"metadata_newPostingDate\", yearly AS \"Period_Yearly\", "
        "quarterly AS \"Period_Quarterly\", monthly AS \"Period_Monthly\", weekly AS \"Period_Weekly\", "
        "count(*) AS postings FROM postings GROUP BY ALL",
        "sortable_week_labels": "SELECT yearly || '-W' || lpad(cast(week(posted_at) AS varchar), 2, '0') "
        "AS \"Period_Weekly\", count(*) AS postings FROM postings GROUP BY ALL",
        # domains
        "subsector_list": "SELECT DISTINCT category FROM postings",
        "option_triples": 'SELECT DISTINCT sector AS broad_sector, level AS position_level, pmet AS "PMET" '
        "FROM postings",
        "filter_options": "SELECT DISTINCT 'sector' AS dimension, sector AS value FROM postings "
        "UNION ALL SELECT DISTINCT 'level', level FROM postings "
        "UNION ALL SELECT DISTINCT 'pmet', pmet FROM postings",
        "sector_map": "SELECT sector AS broad_sector, string_agg(category, ', ' ORDER BY category) AS categories "
        "FROM (SELECT DISTINCT sector, category FROM postings) GROUP BY sector",
        "period_domain": "SELECT DISTINCT quarterly AS period FROM postings",
        "filter_catalogue": _CATALOGUE,
        "period_bounds": "SELECT min(weekly) AS lo, max(weekly) AS hi FROM postings",
        "period_bounds_stored": " UNION ALL ".join(
            f"SELECT '{grain}' AS grain, min({grain}) AS lo, max({grain}) AS hi FROM postings"
            for grain in ("Weekly", "Monthly", "Quarterly", "Yearly")
        ),
        # pulse
        "kpi_summary": _kpi(),
        "kpi_of_sector": _kpi("sector = 'Industrial & Infrastructure'"),
        "kpi_of_pmet": _kpi("pmet = 'PMET'"),
        "kpi_of_level": _kpi("level = 'Manager / Professional'"),
        "kpi_without_reposts": _kpi("repost = 'N'"),
        "kpi_filtered": _kpi(
            "sector = 'Industrial & Infrastructure' AND pmet = 'PMET' AND level = 'Manager / Professional' "
            "AND repost = 'N' AND quarterly BETWEEN '1996-Q2' AND '2000-Q3'"
        ),
        "kpi_week_range": _kpi("weekly BETWEEN '1997-W10' AND '1999-W2'"),
        "kpi_no_rows": _kpi("quarterly BETWEEN '1900-Q1' AND '1900-Q2'"),
        "kpi_cards": f"""SELECT unnest([1, 2, 3, 4, 5]) AS position,
          unnest(['Total Vacancies', 'Total Applications', 'Apps/Vac', 'Job Reposts', 'Views/Post']) AS label,
          unnest([format('{{:,}}', vacancies), format('{{:,}}', applications),
            format('{{:.2f}}', apps_per_vacancy), format('{{:,}}', reposts),
            format('{{:.1f}}', views_per_post)]) AS value FROM ({_kpi()})""",
        "timeline_sums": 'SELECT period, "PMET", vacancies, applications FROM '
        f"({_timeline('quarterly')})",
        "timeline_weekly": _timeline("weekly"),
        "timeline_monthly": _timeline("monthly"),
        "timeline_quarterly": _timeline("quarterly"),
        "timeline_yearly": _timeline("yearly"),
        "apps_by_seniority": _share("level", "position_level"),
        "apps_by_sector": _share("sector", "broad_sector"),
        "pulse_grouping_sets": _pulse(),
        "pulse_no_rows": _pulse("quarterly BETWEEN '1900-Q1' AND '1900-Q2'"),
        # market
        "market_map": f", {_MARKET} SELECT {_MARKET_COLUMNS} FROM market",
        "weighted_avg_views": f"SELECT {_VIEWS} / count(job_id) AS weighted_avg_views FROM postings",
        "top3_competitive": f", {_MARKET} SELECT {_MARKET_COLUMNS}, row_number() OVER "
        "(ORDER BY apps_per_vacancy DESC, category) <= 3 AS top_competitive FROM market",
        "most_competitive": f", {_MARKET} SELECT {_MARKET_COLUMNS} FROM market "
        "ORDER BY apps_per_vacancy DESC, category LIMIT 3",
        "market_zones": f""", {_MARKET}, split AS (
          SELECT (SELECT {_VIEWS} / count(job_id) FROM postings) AS weighted_avg_views,
            median(vacancies) AS median_vacancies FROM market)
          SELECT {_MARKET_COLUMNS}, weighted_avg_views, median_vacancies,
            CASE WHEN views_per_posting > weighted_avg_views
              THEN CASE WHEN vacancies > median_vacancies THEN 'Hotspot' ELSE 'Niche' END
              ELSE CASE WHEN vacancies > median_vacancies THEN 'Opportunity' ELSE 'Quiet' END END AS zone
          FROM market CROSS JOIN split""",
        # competition
        "sector_level_benchmarks": f", {_BENCHMARKS} SELECT sector AS broad_sector, level AS position_level, "
        "broad_q1, broad_q3, broad_avg_exp FROM benchmarks",
        "competition_stats": f", {_COMPETITION} SELECT * FROM competition",
        "top5_contested": f", {_COMPETITION} SELECT category FROM competition "
        "ORDER BY apps_per_vac DESC, category LIMIT 5",
        "competition_top10": f""", {_COMPETITION} SELECT *, '$' || {_finite_text("median_salary", ",.0f")}
          AS salary_text, {_finite_text("avg_exp", ".1f")} || 'y' AS experience_text
          FROM competition ORDER BY apps_per_vac DESC, category LIMIT 10""",
        "top5_postings": f", {_STRUCTURE} SELECT {_KPI_RATIOS} FROM (SELECT {_KPIS} FROM inside)",
        "top5_structure": f", {_STRUCTURE} SELECT * FROM structure",
        "positioning_labels": f", {_STRUCTURE} SELECT *, {_UP} AS positioning, {_comparison('k')} "
        "AS salary_comparison FROM structure",
        "positioning_labels_dollar": f", {_STRUCTURE} SELECT *, {_UP} AS positioning, "
        f"{_comparison('dollar')} AS salary_comparison FROM structure",
        "hierarchy": _HIERARCHY,
        # titles
        "frequent_titles": f", {_TITLES} SELECT * FROM titles",
        "frequent_titles_recleaned": f", {_titles('recleaned', _CLEANED_AGAIN)} SELECT * FROM recleaned",
        "distinct_roles": f", {_TITLES} SELECT * FROM titles_roles",
        # friction
        "sector_median": f", {_FRICTION} SELECT sector AS broad_sector, sector_median FROM sector_medians",
        "friction_premium": f", {_FRICTION} SELECT * FROM friction",
        "friction_median": f", {_FRICTION} SELECT median(friction_pct) AS friction_median FROM friction",
        "friction_zones": f""", {_FRICTION}, split AS (SELECT median(friction_pct) AS friction_median FROM friction)
          SELECT *, CASE WHEN friction_pct > friction_median
            THEN CASE WHEN salary_premium_pct > 0 THEN 'Talent Scarcity' ELSE 'Retention Risk' END
            ELSE CASE WHEN salary_premium_pct > 0 THEN 'Premium Stability' ELSE 'High-Fluidity Roles' END
            END AS zone FROM friction CROSS JOIN split""",
        # table
        "market_totals": f", {_TOTALS} SELECT * FROM totals",
        "parent_benchmarks": f", {_PARENTS} SELECT sector AS broad_sector, parent_median, parent_avg_exp "
        "FROM parents",
        "top_seniority": f", {_TOP_SENIORITY} SELECT * FROM top_levels",
        "table_all": f", {_TABLE} SELECT * FROM full_table",
        "table_top_competitive": f", {_TABLE} SELECT * FROM full_table ORDER BY apps_per_vac DESC, category LIMIT 10",
        "table_top_vacancies": f", {_TABLE} SELECT * FROM full_table ORDER BY vacancies DESC, category LIMIT 10",
        "table_selected": f", {_TABLE} SELECT * FROM full_table WHERE category IN "
        "('Insurance', 'Logistics / Supply Chain', 'F&B')",
        "table_formatted": _formatted(),
        "vacancies_by_sector": f"SELECT sector AS broad_sector, {_VAC} AS vacancies FROM postings GROUP BY sector",
        "vacancies_and_median": f"SELECT {_VAC} AS vacancies, median(salary) AS median_salary FROM postings",
        "salary_by_experience": 'SELECT years AS "minimumYearsExperience", count(*) AS postings, '
        "median(salary) AS median_salary FROM postings GROUP BY years",
    }
    bodies["kept_reports"] = " UNION ALL ".join(
        f"SELECT {column} AS value, applications, share FROM ({_share(n, column)})"
        for n, column in (("sector", "broad_sector"), ("level", "position_level"))
    )
    whole = _dashboard(bodies)
    bodies["dashboard_reports"] = whole
    complete = {name: POSTINGS_CTE + body for name, body in bodies.items()}
    return complete | {"dashboard_from_cube": _FILTERED_CTE + whole}
