"""Primary-key uniqueness (V5) and the duplicate policy of an upsert."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class DuplicateKeyError(ValueError):
    pass


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once, with their count.  The count is a
    partial aggregate, so a hot key is combined map-side."""
    return (df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
            .where(F.col("n") > 1))


def keep_last(df: DataFrame, key: str, order: str) -> DataFrame:
    """One row per ``key``: the one with the greatest ``order`` (the last
    occurrence in a payload).  ``max_by`` aggregates partially."""
    cols = [c for c in df.columns if c != key]
    best = F.max_by(F.struct(*cols), F.col(order)).alias("_r")
    return df.groupBy(key).agg(best).select(key, *[F.col(f"_r.{c}").alias(c) for c in cols])
