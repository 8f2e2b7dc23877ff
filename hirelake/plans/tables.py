"""Reading the driver's Parquet tables and the star binding over them.

The driver's TPC-H-like tables stand in for the hiring star (SURVEY 7.3):
``lineitem`` is the hires fact (``l_shipdate`` the hire time,
``l_suppkey`` the department, ``l_partkey`` the job), ``supplier`` the
departments and ``part`` the jobs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hirelake.spec import Star

LINEITEM_STAR = Star(fact_id="l_orderkey", fact_ts="l_shipdate", fact_dep="l_suppkey",
                     fact_job="l_partkey", dep_key="s_suppkey", dep_name="s_name",
                     job_key="p_partkey", job_name="p_name")

# Year every metric query reports on.
REPORT_YEAR = 1996


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def lineitem_with_null_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fact with some foreign keys set to NULL, as hires with no
    department or job (every tenth supplier key, every tenth part key
    ending in 5)."""
    li = table(spark, sf_dir, "lineitem")
    return li.withColumns({
        "l_suppkey": F.when(F.col("l_suppkey") % 10 != 0, F.col("l_suppkey")),
        "l_partkey": F.when(F.col("l_partkey") % 10 != 5, F.col("l_partkey")),
    })


NULL_KEYS_SQL = """(SELECT l_orderkey, l_shipdate,
    CASE WHEN l_suppkey % 10 = 0 THEN NULL ELSE l_suppkey END AS l_suppkey,
    CASE WHEN l_partkey % 10 = 5 THEN NULL ELSE l_partkey END AS l_partkey
  FROM lineitem)"""
