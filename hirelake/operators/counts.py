"""Row counts per table (A5, J4p)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(tabla, registros): one global COUNT(*) per table, unioned.  Each
    count is a partial aggregate with a single-row exchange."""
    parts = [df.agg(F.lit(name).alias("tabla"), F.count(F.lit(1)).alias("registros"))
             for name, df in tables.items()]
    return reduce(DataFrame.unionByName, parts)
