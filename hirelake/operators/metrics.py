"""Analytic queries over a star: quarterly pivot and above-average groups.

Plan shape: the fact is filtered by a half-open year range (pushed into the
Parquet scan).  The pivot resolves the names and then aggregates once: pairs
of department and job ids rarely repeat within a task, names do, so the
partial aggregate runs map-side on the names.  The above-average query counts
per department id before its join (R6), as one id repeats in every task.
Dimension joins are left to Spark: AQE broadcasts a side whose measured
size is under ``spark.sql.autoBroadcastJoinThreshold`` and keeps a
sort-merge join, whose hot keys it splits, otherwise.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hirelake.functions.scalar import year_range
from hirelake.spec import HIRING, UNASSIGNED, Star

QUARTERS = ("q1", "q2", "q3", "q4")


def quarterly_hires(fact: DataFrame, departments: DataFrame, jobs: DataFrame, year: int,
                    star: Star = HIRING, include_nulls: bool = False,
                    label: str = UNASSIGNED) -> DataFrame:
    """Hires of ``year`` per department name and job name, one column per
    quarter, ordered by department then job (A1, A2, J1-J3, P6, O1).

    ``include_nulls=False`` keeps only hires whose two keys match a
    dimension row; ``True`` keeps every dated hire of the year and labels
    a missing or unmatched side with ``label``.
    """
    s = star
    hires = fact.where(F.col(s.fact_ts).isNotNull() & year_range(s.fact_ts, year))
    if not include_nulls:
        hires = hires.where(F.col(s.fact_dep).isNotNull() & F.col(s.fact_job).isNotNull())
    hires = hires.select(F.col(s.fact_dep).alias("_dep"), F.col(s.fact_job).alias("_job"),
                         F.quarter(s.fact_ts).alias("_q"))
    dep = departments.select(F.col(s.dep_key).alias("_dk"), F.col(s.dep_name).alias("_dn"))
    job = jobs.select(F.col(s.job_key).alias("_jk"), F.col(s.job_name).alias("_jn"))
    how = "left" if include_nulls else "inner"
    joined = (hires.join(dep, F.col("_dep") == F.col("_dk"), how)
              .join(job, F.col("_job") == F.col("_jk"), how))
    if include_nulls:
        department = F.coalesce(F.col("_dn"), F.lit(label))
        job_col = F.coalesce(F.col("_jn"), F.lit(label))
    else:
        department, job_col = F.col("_dn"), F.col("_jn")
    return (joined.groupBy(department.alias("department"), job_col.alias("job"))
            .agg(*[F.count_if(F.col("_q") == i + 1).alias(name) for i, name in enumerate(QUARTERS)])
            .orderBy("department", "job"))


def hires_per_department(fact: DataFrame, departments: DataFrame, year: int,
                         star: Star = HIRING) -> DataFrame:
    """Every department with its hire count for ``year`` (0 when none):
    the ``hires`` CTE of the above-average query (F2, J4, A3, A4)."""
    s = star
    counted = (fact.where(F.col(s.fact_dep).isNotNull() & F.col(s.fact_ts).isNotNull()
                          & year_range(s.fact_ts, year))
               .groupBy(F.col(s.fact_dep).alias("_dep"))
               .agg(F.count(s.fact_id).alias("_n")))
    dep = departments.select(F.col(s.dep_key).alias("id"), F.col(s.dep_name).alias("department"))
    # One output row per department row: the dimension drives the join.
    return (dep.join(counted, F.col("id") == F.col("_dep"), "left")
            .select("id", "department", F.coalesce(F.col("_n"), F.lit(0)).cast("bigint").alias("hired")))


def above_average(fact: DataFrame, departments: DataFrame, year: int,
                  star: Star = HIRING) -> DataFrame:
    """Departments that hired strictly more than the mean over all
    departments (zeros included), most hires first, then by id (A6, J5,
    F9, O2).

    The mean is a one-row scalar subquery computed once; the comparison
    ``hired * n > total`` is exact in integers, so no rounding of the
    average can move a department across the line.
    """
    hires = hires_per_department(fact, departments, year, star)
    stats = hires.agg(F.struct(F.sum("hired").alias("total"),
                               F.count(F.lit(1)).alias("n")).alias("s")).scalar()
    return (hires.where(F.col("hired") * stats.getField("n") > stats.getField("total"))
            .orderBy(F.desc("hired"), F.asc("id")))
