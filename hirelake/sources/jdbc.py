"""Relational tables over JDBC.

The service reads its tables from PostgreSQL with optional SSL.  Here the
same connection settings become Spark JDBC options, and a table is read in
parallel by ranges of its integer key (``partitionColumn`` with bounds),
so no single task pulls the whole table.  Bounds, when not given, come
from one ``min/max`` query (a single row).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from hirelake.spec import table_spec


def jdbc_properties(user: str | None = None, password: str | None = None,
                    sslmode: str | None = None, sslrootcert: str | None = None,
                    driver: str | None = None, fetchsize: int = 10_000) -> dict[str, str]:
    """Connection properties; SSL settings are passed to the driver as-is."""
    props = {"fetchsize": str(fetchsize)}
    for k, v in (("user", user), ("password", password), ("sslmode", sslmode),
                 ("sslrootcert", sslrootcert), ("driver", driver)):
        if v:
            props[k] = v
    return props


def read_jdbc_table(spark: SparkSession, url: str, table: str, properties: dict[str, str],
                    key: str = "id", lower: int | None = None, upper: int | None = None,
                    num_partitions: int | None = None) -> DataFrame:
    """Read one whitelisted table, split into ``num_partitions`` key ranges."""
    spec = table_spec(table)
    n = num_partitions or spark.sparkContext.defaultParallelism
    if lower is None or upper is None:
        bounds = spark.read.jdbc(url, f"(SELECT MIN({key}) AS lo, MAX({key}) AS hi FROM {table}) b",
                                 properties=properties).first()
        if bounds is None or bounds["lo"] is None:
            return spark.createDataFrame([], spec.schema)
        lower, upper = int(bounds["lo"]), int(bounds["hi"])
    df = spark.read.jdbc(url, table, column=key, lowerBound=lower, upperBound=upper + 1,
                         numPartitions=n, properties=properties)
    return df.select(*[df[c].cast(f.spark_type).alias(c) for c, f in
                       ((f.name, f) for f in spec.fields)])
