"""Backup files: reading them back (S4, S5) and listing them.

A backup is ``<dir>/<table>_<YYYYmmdd>_<HHMMSS>.<avro|parquet>``; Spark
writes it as a directory of part files, and a single file of that name
(as other tools write) is read the same way.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hirelake.session import list_names
from hirelake.spec import BACKUP_FORMATS, BACKUP_NAME, TableSpec, table_spec

CATALOG_SCHEMA = "tabla string, archivo string, ruta string, fecha string, formato string"


class AvroUnavailable(RuntimeError):
    pass


def avro_available(spark: SparkSession) -> bool:
    """True when the session can load the ``avro`` data source."""
    try:
        spark.read.format("avro").load("/nonexistent-hirelake-probe")
    except Exception as e:  # noqa: BLE001
        return "PATH_NOT_FOUND" in str(e) or "does not exist" in str(e)
    return True


def read_backup(spark: SparkSession, path: str, spec: TableSpec, fmt: str) -> DataFrame:
    """The rows of one backup with the backup schema (timestamps as
    ISO text, every FK nullable)."""
    if fmt not in BACKUP_FORMATS:
        raise ValueError(f"format must be one of {BACKUP_FORMATS}")
    if fmt == "avro" and not avro_available(spark):
        raise AvroUnavailable("the avro data source is not on this session's classpath")
    return spark.read.schema(spec.backup_schema).format(fmt).load(path)


def read_backup_positions(spark: SparkSession, path: str, spec: TableSpec, fmt: str) -> DataFrame:
    """The rows of one backup with ``indice``, their position in it: part files
    in name order, rows in file order.  Only one count per part file is
    gathered.  Avro files give no row numbers; rows keep the order of the scan."""
    rows = read_backup(spark, path, spec, fmt)
    if fmt != "parquet":
        return rows.withColumn("indice", F.monotonically_increasing_id())
    rows = rows.withColumns({"_file": F.col("_metadata.file_path"), "_row": F.col("_metadata.row_index")})
    before = Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)
    files = rows.groupBy("_file").agg(F.count(F.lit(1)).alias("_n"))
    starts = files.select("_file", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    return rows.join(starts, "_file").select(*spec.columns, (F.col("_start") + F.col("_row")).alias("indice"))


def backup_totals(listed: DataFrame) -> DataFrame:
    """Whether a listing has any backup, and how many files."""
    n = F.count(F.lit(1))
    return listed.agg((n > 0).alias("existen"), n.alias("total_archivos"))


def _entry_pattern(tabla: str) -> str:
    return "^" + re.escape(tabla) + BACKUP_NAME


def list_backups(spark: SparkSession, directory: str, tabla: str,
                 day: str | None = None) -> DataFrame:
    """Backups of ``tabla`` in ``directory`` as (tabla, archivo, ruta,
    fecha, formato), newest first.  ``day`` ("YYYYmmdd") keeps one day
    only (F12).  A missing directory lists nothing.

    One shallow listing of the folder (its entries, not the part files
    inside each backup), so the cost follows the number of backups."""
    table_spec(tabla)  # whitelist
    d = directory.rstrip("/")
    names = list_names(spark, d)
    if not names:
        return spark.createDataFrame([], CATALOG_SCHEMA)
    entries = spark.createDataFrame([(n,) for n in names], "archivo string")
    pat = _entry_pattern(tabla)
    out = (entries.where(F.col("archivo").rlike(pat))
           .select(F.lit(tabla).alias("tabla"), "archivo",
                   F.concat(F.lit(d + "/"), F.col("archivo")).alias("ruta"),
                   F.regexp_extract("archivo", pat, 1).alias("fecha"),
                   F.regexp_extract("archivo", pat, 2).alias("formato")))
    if day is not None:
        out = out.where(F.col("fecha") == day)
    return out.orderBy(F.desc("archivo"))
