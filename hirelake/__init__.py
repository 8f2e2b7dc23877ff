"""Spark-native ingestion, quality and analytics for star-schema hiring data.

Every operator takes and returns DataFrames; column names come from a
:class:`~hirelake.spec.Star` binding, so the same code runs on the hiring
tables and on any fact table with a timestamp and two dimensions.
"""

from hirelake.session import build_session, scratch_dir
from hirelake.spec import HIRING, SPECS, Star, TableSpec

__all__ = ["build_session", "scratch_dir", "HIRING", "SPECS", "Star", "TableSpec"]
