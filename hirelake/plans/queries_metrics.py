"""Metric and KPI queries on the lineitem star."""

from __future__ import annotations

from pyspark.sql import SparkSession

from hirelake.operators import kpis, metrics
from hirelake.plans.registry import register
from hirelake.spec import UNASSIGNED
from hirelake.plans.tables import (LINEITEM_STAR, NULL_KEYS_SQL, REPORT_YEAR,
                                   lineitem_with_null_keys, table)

Y = REPORT_YEAR

# Names of a hire's department and job, by scalar lookups on the unique keys.
_NAMED = """SELECT quarter(l_shipdate) AS q,
    (SELECT s_name FROM supplier WHERE s_suppkey = l_suppkey) AS d,
    (SELECT p_name FROM part WHERE p_partkey = l_partkey) AS j
  FROM {fact} WHERE l_shipdate >= TIMESTAMP '{y}-01-01' AND l_shipdate < TIMESTAMP '{z}-01-01'"""


def _pivot_sql(fact: str, department: str, job: str, keep: str) -> str:
    quarters = ", ".join(f"count(*) FILTER (q = {i}) AS q{i}" for i in range(1, 5))
    return (f"SELECT {department} AS department, {job} AS job, {quarters} "
            f"FROM ({_NAMED.format(fact=fact, y=Y, z=Y + 1)}) named WHERE {keep} GROUP BY 1, 2")


QUARTERLY_SQL = _pivot_sql("lineitem", "d", "j", "d IS NOT NULL AND j IS NOT NULL")
QUARTERLY_NULLS_SQL = _pivot_sql(f"{NULL_KEYS_SQL} nulled", f"ifnull(d, '{UNASSIGNED}')", f"ifnull(j, '{UNASSIGNED}')", "true")

# Every department with its number of hires of the year, zero included.
PER_DEPARTMENT_SQL = f"""
SELECT s_suppkey AS id, s_name AS department,
       (SELECT count(*) FROM lineitem WHERE l_suppkey = s_suppkey AND year(l_shipdate) = {Y}) AS hired
FROM supplier"""
HIRES_CTE = f"hires AS ({PER_DEPARTMENT_SQL})"

ABOVE_SQL = f"""
SELECT id, department, hired FROM (
  SELECT *, sum(hired) OVER () AS total, count(*) OVER () AS n FROM ({PER_DEPARTMENT_SQL}) x) y
WHERE hired * n > total
"""


def _quarterly(spark: SparkSession, sf: str):
    return metrics.quarterly_hires(table(spark, sf, "lineitem"), table(spark, sf, "supplier"),
                                   table(spark, sf, "part"), Y, LINEITEM_STAR)


def _above(spark: SparkSession, sf: str):
    return metrics.above_average(table(spark, sf, "lineitem"), table(spark, sf, "supplier"),
                                 Y, LINEITEM_STAR)


@register("quarterly_hires", QUARTERLY_SQL)
def quarterly_hires(spark, sf):
    return _quarterly(spark, sf)


@register("quarterly_hires_nulls", QUARTERLY_NULLS_SQL)
def quarterly_hires_nulls(spark, sf):
    return metrics.quarterly_hires(lineitem_with_null_keys(spark, sf), table(spark, sf, "supplier"),
                                   table(spark, sf, "part"), Y, LINEITEM_STAR, include_nulls=True)


@register("above_average", ABOVE_SQL)
def above_average(spark, sf):
    return _above(spark, sf)


_QT = f"""qt AS (
  SELECT CAST(COALESCE(SUM(q1), 0) AS BIGINT) AS q1, CAST(COALESCE(SUM(q2), 0) AS BIGINT) AS q2,
         CAST(COALESCE(SUM(q3), 0) AS BIGINT) AS q3, CAST(COALESCE(SUM(q4), 0) AS BIGINT) AS q4
  FROM ({QUARTERLY_SQL}))"""


@register("quarter_totals", f"WITH {_QT} SELECT q1, q2, q3, q4, q1 + q2 + q3 + q4 AS total FROM qt")
def quarter_totals(spark, sf):
    return kpis.quarter_totals(_quarterly(spark, sf))


_QLONG = f"""{_QT}, ql AS (
  SELECT 'Q1' AS quarter, q1 AS hires, 1 AS idx FROM qt UNION ALL
  SELECT 'Q2', q2, 2 FROM qt UNION ALL SELECT 'Q3', q3, 3 FROM qt UNION ALL
  SELECT 'Q4', q4, 4 FROM qt)"""


@register("quarter_kpis", f"""
WITH {_QLONG},
peak AS (SELECT quarter, hires FROM ql ORDER BY hires DESC, idx ASC LIMIT 1)
SELECT q1 + q2 + q3 + q4 AS total, peak.quarter AS peak_quarter, peak.hires AS peak_hires,
       q4 - q1 AS variation,
       CASE WHEN q4 - q1 >= 0 THEN '+' ELSE '-' END || CAST(abs(q4 - q1) AS VARCHAR) AS variation_label
FROM qt, peak
""")
def quarter_kpis(spark, sf):
    return kpis.quarter_kpis(_quarterly(spark, sf))


@register("quarter_share", f"""
WITH {_QLONG}
SELECT quarter, hires, hires / (SELECT SUM(hires) FROM ql) AS share FROM ql
""")
def quarter_share(spark, sf):
    return kpis.quarter_share(_quarterly(spark, sf))


@register("top10_groups", f"""
SELECT department, job, total, position FROM (
  SELECT department, job, q1 + q2 + q3 + q4 AS total,
         row_number() OVER (ORDER BY q1 + q2 + q3 + q4 DESC, department ASC, job ASC) AS position
  FROM ({QUARTERLY_SQL})) WHERE position <= 10
""")
def top10_groups(spark, sf):
    return kpis.top_groups(_quarterly(spark, sf))


@register("top10_departments", f"""
SELECT id, department, hired, position FROM (
  SELECT id, department, hired,
         row_number() OVER (ORDER BY hired DESC, id ASC) AS position
  FROM ({ABOVE_SQL})) WHERE position <= 10
""")
def top10_departments(spark, sf):
    return kpis.top_departments(_above(spark, sf))


@register("department_kpis", f"""
WITH a AS ({ABOVE_SQL}),
top AS (SELECT department, hired FROM a ORDER BY hired DESC, id ASC LIMIT 1)
SELECT CAST(COALESCE((SELECT SUM(hired) FROM a), 0) AS BIGINT) AS total_hires,
       (SELECT department FROM top) AS top_department,
       (SELECT hired FROM top) AS top_hired,
       (SELECT COUNT(*) FROM a) AS departments_above
""")
def department_kpis(spark, sf):
    return kpis.department_kpis(_above(spark, sf))


@register("department_share", f"""
WITH a AS ({ABOVE_SQL})
SELECT id, department, hired, hired / (SELECT SUM(hired) FROM a) AS share FROM a
""")
def department_share(spark, sf):
    return kpis.department_share(_above(spark, sf))
