"""Composite jobs (J1p-J4p, W1-W3, W10): historical CSV load, payload
ingest, backup, guarded wipe and restore.

Each job is a short sequence of Spark jobs over DataFrames.  Work that a
job reads more than once (the exploded payload records, the validated
batch of a table) is checkpointed to the session's checkpoint directory,
which is shared storage on a cluster: a lost executor does not force the
payload files to be parsed again, and lineage stays short.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from hirelake.functions.scalar import iso_string
from hirelake.operators import foreign_keys, validate
from hirelake.operators.validate import ERROR_COLUMNS, ERROR_SCHEMA
from hirelake.session import materialize, spread
from hirelake.sinks.table_store import TableStore
from hirelake.sources import backups as bk
from hirelake.sources.csv_files import read_dimension_csv, read_hires_csv
from hirelake.sources.payloads import payload_records
from hirelake.spec import (BACKUP_DAY, BACKUP_FORMATS, BACKUP_STAMP, DEPARTMENTS, HIRES, JOBS, SPECS, TABLE_ORDER,
                           TableSpec, table_spec)

SUMMARY_SCHEMA = "tabla string, recibidos bigint, validos bigint, upsert bigint"


def _union(frames: list[DataFrame], spark: SparkSession, schema: str) -> DataFrame:
    return reduce(DataFrame.unionByName, frames) if frames else spark.createDataFrame([], schema)


# ---------------------------------------------------------------------------
# Validation of one table batch against the store (V1-V4)
# ---------------------------------------------------------------------------
def check_batch(store: TableStore, spec: TableSpec, validated: DataFrame, label: str) -> tuple[DataFrame, int, int]:
    """Add the FK stage to a V1-validated batch: ``ok`` is true when the
    record passed every rule and every FK.  FK lookups use the store's
    current dimension tables (dimensions of the same run are already in).

    The batch is written out once before, as it is read for its FK values,
    its errors and its valid rows.  Returns it with the records received and valid."""
    validated = materialize(validated, label)
    empty = F.array().cast(validate.ERR_TYPE)
    if spec.foreign_keys:
        dims = {f.references: store.read(SPECS[f.references]).select("id")
                for f in spec.foreign_keys}
        # Only records that passed V1 report FK errors, as in the service.
        checked = foreign_keys.check_foreign_keys(validated, spec, dims)
        validated = checked.withColumn(
            "fk_errs", F.when(F.size("errs") == 0, F.col("fk_errs")).otherwise(empty))
    else:
        validated = validated.withColumn("fk_errs", empty)
    checked = validated.withColumn("ok", (F.size("errs") == 0) & (F.size("fk_errs") == 0))
    n = checked.agg(F.count(F.lit(1)).alias("recibidos"), F.count_if("ok").alias("validos")).first()
    return checked, n["recibidos"], n["validos"]


def batch_errors(checked: DataFrame, tabla: str) -> DataFrame:
    model = validate.error_rows(checked, tabla, "modelo")
    quality = validate.error_rows(checked.drop("errs").withColumnRenamed("fk_errs", "errs"),
                                  tabla, "calidad")
    return model.unionByName(quality)


@dataclass
class IngestResult:
    summary: DataFrame   # tabla, recibidos, validos, upsert
    errors: DataFrame    # tabla, indice, etapa, campo, regla, valor (+ payload)
    rejected: DataFrame  # payload, motivo


def _repeated(valid: DataFrame, spec: TableSpec) -> DataFrame:
    """V5: keys that occur more than once in one group, with the last position."""
    return (valid.groupBy("payload", "orden", spec.key)
            .agg(F.count(F.lit(1)).alias("n"), F.max("indice").alias("indice")).where("n > 1"))


def ingest_records(store: TableStore, records: DataFrame, on_duplicate: str = "error",
                   batch: tuple[str, int] | None = None) -> IngestResult:
    """J2p over exploded records (payload, orden, tabla, indice, raw): per table
    in whitelist order, validate (V1), check FKs (V2/V3), upsert the valid
    rows (W7-W9) and count (V4).  Each table commits on its own, so a
    failure in a later table keeps the earlier ones, as in the service.

    Payloads stand alone: an id that occurs twice in one group fails that group
    (``on_duplicate="error"``: an error row, none of its rows written) or
    its last occurrence counts (``"last"``); the same id in a later payload
    replaces the row, as a later request would.

    ``batch`` names a stream and its batch number; each table records it with the
    rows, so a batch that is run again after a failure writes only what it hadn't."""
    if on_duplicate not in ("error", "last"):
        raise ValueError(f"unknown duplicate policy {on_duplicate!r}")
    spark = records.sparkSession
    # Written once, in one folder per table: each table's pass below reads
    # only its own records (partition pruning).  Then spread: JSON parsing
    # of the records is the costly step.
    records = spread(materialize(records, "ingest-records", partition_by="tabla"))
    present = {r[0] for r in records.select("tabla").distinct().collect()}  # <= 3 names
    summary, errors = [], []
    for tabla in TABLE_ORDER:
        if tabla not in present:
            continue
        spec = table_spec(tabla)
        recs = records.where(F.col("tabla") == tabla)
        checked, received, passed = check_batch(store, spec, validate.validate_json(recs, "raw", spec), f"ingest-{tabla}")
        valid = (checked.where(F.col("ok"))
                 .withColumn("_pos", F.struct("orden", "indice")))
        errors.append(batch_errors(checked, tabla))
        if on_duplicate == "error":
            repeated = _repeated(valid, spec)
            errors.append(repeated.select(
                F.lit(tabla).alias("tabla"), "indice", F.lit("carga").alias("etapa"), F.lit(spec.key).alias("campo"),
                F.lit("duplicate_key").alias("regla"), F.col(spec.key).cast("string").alias("valor")))
            valid = valid.join(repeated.select("payload", "orden").distinct(), ["payload", "orden"], "left_anti")
        n = store.upsert(spec, valid, on_duplicate="last", order="_pos", materialized=True, batch=batch)
        summary.append((tabla, received, passed, n))
    return IngestResult(
        spark.createDataFrame(summary, SUMMARY_SCHEMA),
        _union(errors, spark, ERROR_SCHEMA),
        spark.createDataFrame([], "payload string, motivo string"))


def ingest_payloads(store: TableStore, payloads: DataFrame, on_duplicate: str = "error",
                    max_rows: int | None = 1000) -> IngestResult:
    """J2p from raw payload documents (see ``sources.payloads``)."""
    p = payload_records(payloads, max_rows=max_rows)
    result = ingest_records(store, p.records, on_duplicate)
    result.rejected = p.rejected
    return result


# ---------------------------------------------------------------------------
# Historical CSV load (J1p) and counts (J4p)
# ---------------------------------------------------------------------------
@dataclass
class LoadResult:
    counts: DataFrame
    errors: DataFrame
    preview: DataFrame


def check_constraints(store: TableStore, spec: TableSpec, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """V2, V3, V7 on loaded rows with their position (``indice``): (rows that the
    schema allows, error rows).

    What the service's tables forbid is no text longer than its column and
    no key without its dimension row; ids of any sign are allowed there."""
    line = F.concat_ws(",", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in spec.columns])
    long = [(F.char_length(f.name) > f.max_len, validate._err(f.name, F.lit("string_too_long"), line))
            for f in spec.fields if f.max_len is not None]
    checked = materialize(rows.withColumns({"errs": validate.collect_errors(long), "_line": line}), f"load-{spec.name}")
    if spec.foreign_keys:
        dims = {f.references: store.read(SPECS[f.references]).select("id") for f in spec.foreign_keys}
        checked = foreign_keys.check_foreign_keys(checked, spec, dims)
        checked = checked.withColumn("fk_errs", F.transform("fk_errs", lambda e: e.withField("valor", F.col("_line"))))
    else:
        checked = checked.withColumn("fk_errs", F.array().cast(validate.ERR_TYPE))
    checked = checked.withColumn("ok", (F.size("errs") == 0) & (F.size("fk_errs") == 0))
    return checked.where("ok").select(*spec.columns), batch_errors(checked, spec.name)


def full_load(store: TableStore, departments_csv: str, jobs_csv: str, hires_csv: str) -> LoadResult:
    """J1p: recreate the three tables, then append departments, jobs and
    hires from their CSV files (dimensions first).  Rows that the schema
    forbids (V2, V3, V7) become error rows."""
    spark = store.spark
    for name in TABLE_ORDER:
        store.recreate(SPECS[name])
    errs = []
    for name, path, read in ((DEPARTMENTS, departments_csv, read_dimension_csv), (JOBS, jobs_csv, read_dimension_csv),
                             (HIRES, hires_csv, read_hires_csv)):
        load = read(spark, path, SPECS[name])
        good, bad = check_constraints(store, SPECS[name], load.numbered)
        store.append(SPECS[name], good)
        errs += [load.errors.select(*ERROR_COLUMNS), bad.select(*ERROR_COLUMNS)]
    return LoadResult(verify_counts(store), _union(errs, spark, ERROR_SCHEMA), store.read(SPECS[HIRES]).limit(5))


def verify_counts(store: TableStore) -> DataFrame:
    """J4p: one COUNT(*) per table, from the tables' states."""
    return store.spark.createDataFrame([(n, store.count(SPECS[n])) for n in TABLE_ORDER], "tabla string, registros bigint")


# ---------------------------------------------------------------------------
# Backups (W1-W3), guarded wipe (W10), restore (J3p)
# ---------------------------------------------------------------------------
def to_backup_rows(df: DataFrame, spec: TableSpec) -> DataFrame:
    """The table's rows in the backup schema (timestamps as ISO text)."""
    return df.select(*[(iso_string(F.col(f.name)) if f.kind == "datetime" else F.col(f.name))
                       .cast(bf.dataType).alias(f.name)
                       for f, bf in zip(spec.fields, spec.backup_schema.fields)])


def backup_tables(store: TableStore, fmt: str, directory: str, tables: list[str] | None = None,
                  now: dt.datetime | None = None) -> DataFrame:
    """Back up each table to ``<dir>/<table>_<stamp>.<fmt>`` with one
    shared stamp; returns (tabla, formato, ruta, registros).  Every name is
    checked before anything is written; an existing backup of the same
    second is never overwritten.

    All tables are backed up as of one moment: their states are pinned before
    the first is written, the fact's before its dimensions', so that rows written
    meanwhile leave no hire in the set without its department or job."""
    spark = store.spark
    if fmt not in BACKUP_FORMATS:
        raise ValueError(f"format must be one of {BACKUP_FORMATS}")
    names = list(tables) if tables is not None else list(TABLE_ORDER)
    if not names:
        raise ValueError("tables must be a non-empty list")
    specs = [table_spec(n) for n in names]
    if fmt == "avro" and not bk.avro_available(spark):
        raise bk.AvroUnavailable("the avro data source is not on this session's classpath")
    stamp = (now or dt.datetime.now()).strftime(BACKUP_STAMP)
    pinned = {s.name: store.snapshot(s) for s in sorted(specs, key=lambda s: not s.foreign_keys)}
    out = []
    for spec in specs:
        ruta = f"{directory.rstrip('/')}/{spec.name}_{stamp}.{fmt}"
        obs = Observation(f"backup_{spec.name}")
        rows = to_backup_rows(store.read(spec, at=pinned[spec.name]), spec).observe(obs, F.count(F.lit(1)).alias("n"))
        rows.write.mode("errorifexists").format(fmt).save(ruta)
        out.append((spec.name, fmt, ruta, int(obs.get["n"])))
    return spark.createDataFrame(out, "tabla string, formato string, ruta string, registros bigint")


def backup_records_total(report: DataFrame) -> DataFrame:
    """Rows written over all tables of a backup report."""
    return report.agg(F.coalesce(F.sum("registros"), F.lit(0)).cast("bigint").alias("registros"))


class GuardError(RuntimeError):
    pass


def wipe_table(store: TableStore, tabla: str, directory: str, only_today: bool = True,
               today: dt.date | None = None) -> DataFrame:
    """Delete every row of ``tabla`` only when a backup of it exists
    (of today, by default) and - for a dimension - no hire still points to
    one of its rows (V6).  Returns (tabla, borrados, total_archivos, respaldos):
    the rows deleted and the backups found, newest first."""
    spec = table_spec(tabla)
    spark = store.spark
    day = (today or dt.date.today()).strftime(BACKUP_DAY) if only_today else None
    found = [r["archivo"] for r in bk.list_backups(spark, directory, tabla, day).collect()]  # names only
    if not found:
        when = "of today " if only_today else ""
        raise GuardError(f"no backup {when}for {tabla!r} in {directory!r}")
    hires = SPECS[HIRES]
    for f in hires.foreign_keys:
        if f.references == tabla:
            used = foreign_keys.referenced_rows(store.read(hires), f.name, store.read(spec))
            if not used.isEmpty():
                raise GuardError(f"{tabla!r} rows are still referenced by {HIRES}.{f.name}")
    n = store.truncate(spec)
    return spark.createDataFrame([(tabla, n, len(found), ",".join(found))],
                                 "tabla string, borrados bigint, total_archivos bigint, respaldos string")


@dataclass
class RestoreResult:
    summary: DataFrame  # tabla, restaurados, recibidos, validos
    errors: DataFrame


def restore_table(store: TableStore, tabla: str, path: str, fmt: str,
                  on_duplicate: str = "last") -> RestoreResult:
    """J3p: read a backup, validate it as a payload would be (V1-V3) and
    upsert the valid rows.  A merge, not a replace: stored rows missing from
    the backup stay."""
    spec = table_spec(tabla)
    spark = store.spark
    rows = bk.read_backup_positions(spark, path, spec, fmt)
    checked, received, passed = check_batch(store, spec, validate.validate_typed(rows, spec), f"restore-{tabla}")
    n = store.upsert(spec, checked.where(F.col("ok")), on_duplicate=on_duplicate, order="indice", materialized=True)
    summary = spark.createDataFrame([(tabla, n, received, passed)],
                                    "tabla string, restaurados bigint, recibidos bigint, validos bigint")
    return RestoreResult(summary, batch_errors(checked, tabla).select(*ERROR_COLUMNS))
