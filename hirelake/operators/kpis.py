"""Dashboard figures derived from the two metric queries (A8-A13, O3-O6,
P14, P15).  Each works on the (small) output of a metric query and never
collects it: totals are one-row aggregates used as scalar subqueries, and
top-k lists are TakeOrderedAndProject.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hirelake.functions.scalar import signed_label
from hirelake.operators.metrics import QUARTERS

TOP_K = 10  # top lists show ten rows


def _row_total():
    return sum((F.col(q) for q in QUARTERS[1:]), F.col(QUARTERS[0]))


def quarter_totals(quarterly: DataFrame) -> DataFrame:
    """One row: hires per quarter over all groups, and their sum."""
    sums = [F.coalesce(F.sum(q), F.lit(0)).cast("bigint").alias(q) for q in QUARTERS]
    return quarterly.agg(*sums).withColumn("total", _row_total())


def _quarters_long(totals: DataFrame) -> DataFrame:
    return totals.unpivot([], [F.col(q).alias(f"Q{i + 1}") for i, q in enumerate(QUARTERS)],
                          "quarter", "hires")


def quarter_kpis(quarterly: DataFrame) -> DataFrame:
    """Total, peak quarter (earliest wins a tie) and the signed change from
    Q1 to Q4 (A9, A10, P14)."""
    totals = quarter_totals(quarterly)
    long = _quarters_long(totals).withColumn("_idx", F.substring("quarter", 2, 1).cast("int"))
    peak = long.agg(F.max_by(F.struct("quarter", "hires"),
                             F.struct(F.col("hires"), -F.col("_idx"))).alias("p")).scalar()
    return totals.select(
        F.col("total"),
        peak.getField("quarter").alias("peak_quarter"),
        peak.getField("hires").alias("peak_hires"),
        (F.col("q4") - F.col("q1")).alias("variation"),
        signed_label(F.col("q4") - F.col("q1")).alias("variation_label"))


def quarter_share(quarterly: DataFrame) -> DataFrame:
    """Distribution of the year's hires over the four quarters."""
    long = _quarters_long(quarter_totals(quarterly))
    total = long.agg(F.sum("hires")).scalar()
    return long.select("quarter", "hires", (F.col("hires") / total).alias("share"))


def top_groups(quarterly: DataFrame, k: int = TOP_K) -> DataFrame:
    """Top ``k`` (department, job) by yearly total; ties keep the report's
    department/job order (O4, O6, P15)."""
    order = [F.desc("total"), F.asc("department"), F.asc("job")]
    top = (quarterly.select("department", "job", _row_total().alias("total"))
           .orderBy(*order).limit(k))
    # The window only ever sees the k rows left after the limit.
    return top.withColumn("position", F.row_number().over(Window.orderBy(*order)))


def top_departments(above: DataFrame, k: int = TOP_K) -> DataFrame:
    """Top ``k`` departments of the above-average list."""
    order = [F.desc("hired"), F.asc("id")]
    top = above.select("id", "department", "hired").orderBy(*order).limit(k)
    return top.withColumn("position", F.row_number().over(Window.orderBy(*order)))


def department_kpis(above: DataFrame) -> DataFrame:
    """Total hires, the top department (first by hires desc, id asc) and
    the number of departments above average (A9, A11, A12)."""
    top = F.max_by(F.struct("department", "hired"), F.struct(F.col("hired"), -F.col("id")))
    return (above.agg(F.coalesce(F.sum("hired"), F.lit(0)).cast("bigint").alias("total_hires"),
                      top.alias("_top"), F.count(F.lit(1)).alias("departments_above"))
            .select("total_hires", F.col("_top.department").alias("top_department"),
                    F.col("_top.hired").alias("top_hired"), "departments_above"))


def department_share(above: DataFrame) -> DataFrame:
    """Each above-average department's share of their summed hires."""
    total = above.agg(F.sum("hired")).scalar()
    return above.select("id", "department", "hired", (F.col("hired") / total).alias("share"))
