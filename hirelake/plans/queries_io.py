"""Source, sink and job queries on the driver's tables.

Each query writes what it needs (CSV files, payloads, tables, backups)
under a fresh folder of the session's checkpoint directory, runs the
operator and returns a DataFrame over the result.  Dimension stand-ins:
``customer`` for departments, ``part`` for jobs; ``orders`` for hires
(unique key, a date, a department key).
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hirelake.functions.scalar import iso_string, iso_timestamp
from hirelake.plans import jobs
from hirelake.plans.registry import register
from hirelake.plans.tables import table
from hirelake.session import materialize, scratch_dir, spread
from hirelake.sinks.table_store import TableStore
from hirelake.sources.backups import list_backups
from hirelake.sources.csv_files import read_dimension_csv, read_hires_csv, read_records, write_csv
from hirelake.sources.payloads import payload_records, read_payloads
from hirelake.spec import BACKUP_DAY, BACKUP_STAMP, DEPARTMENTS, HIRES, JOBS, SPECS, TABLE_ORDER

# Clock of the backup queries (a parameter, so results repeat).
BACKUP_CLOCK = dt.datetime(2024, 1, 2, 3, 4, 5)
PAYLOAD_GROUP = 1000  # records per payload group, the service's maximum


ABSENT_JOB = 100_000_000  # added to a job id, it names no job


def departments_rows(spark, sf) -> DataFrame:
    return table(spark, sf, "customer").select(F.col("c_custkey").cast("int").alias("id"),
                                                F.col("c_name").alias("departamento"))


def jobs_rows(spark, sf) -> DataFrame:
    return table(spark, sf, "part").select(F.col("p_partkey").cast("int").alias("id"),
                                            F.col("p_name").alias("trabajo"))


def hires_rows(spark, sf) -> DataFrame:
    """``orders`` as hires.  The job is the smallest part of the order's
    lines; orders without lines have none, and every eleventh order points
    to a job that doesn't exist."""
    job = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.min("l_partkey").alias("_job"))
    k = F.col("o_orderkey")
    return table(spark, sf, "orders").join(job, "o_orderkey", "left").select(
        k.cast("int").alias("id"), F.col("o_orderpriority").alias("nombre"),
        F.col("o_orderdate").alias("fecha_hora"), F.col("o_custkey").cast("int").alias("id_departamento"),
        F.when(k % 11 == 4, F.col("_job") + ABSENT_JOB).otherwise(F.col("_job")).cast("int").alias("id_trabajo"))


def _store(spark, name: str) -> TableStore:
    """A fresh table store.  These tables hold one scale factor of a TPC-H
    table, so one bucket per core is enough; a production store passes
    buckets sized to ~1 GB each."""
    return TableStore(spark, scratch_dir(spark, name),
                      default_buckets=spark.sparkContext.defaultParallelism)


# The hires, and which of their rows pass every rule, in SQL.
HIRES_SQL = f"""(SELECT CAST(o_orderkey AS INTEGER) AS id, o_orderpriority AS nombre, o_orderdate AS fecha_hora,
    CAST(o_custkey AS INTEGER) AS id_departamento,
    CAST(CASE WHEN o_orderkey % 11 = 4 THEN job + {ABSENT_JOB} ELSE job END AS INTEGER) AS id_trabajo
  FROM orders LEFT JOIN (SELECT l_orderkey, min(l_partkey) AS job FROM lineitem GROUP BY l_orderkey) j
    ON l_orderkey = o_orderkey)"""
_VALID_DEPT = "c_custkey > 0 AND length(c_name) BETWEEN 1 AND 50"
_VALID_JOB = "p_partkey > 0 AND length(p_name) BETWEEN 1 AND 200"
_FIELDS_OK = "id > 0 AND ifnull(id_departamento, 1) > 0 AND ifnull(id_trabajo, 1) > 0"
_DEPT_OK = f"(id_departamento IS NULL OR id_departamento IN (SELECT c_custkey FROM customer WHERE {_VALID_DEPT}))"
_JOB_OK = f"(id_trabajo IS NULL OR id_trabajo IN (SELECT p_partkey FROM part WHERE {_VALID_JOB}))"
_VALID_HIRE = f"{_FIELDS_OK} AND {_DEPT_OK} AND {_JOB_OK}"


# --------------------------------------------------------------------------
# CSV round trips
# --------------------------------------------------------------------------
@register("csv_roundtrip_dim", """
SELECT CAST(s_suppkey AS INTEGER) AS id, s_name AS departamento FROM supplier
""")
def csv_roundtrip_dim(spark, sf):
    path = scratch_dir(spark, "csv-dim")
    write_csv(table(spark, sf, "supplier").select("s_suppkey", "s_name"), path, header=False)
    return read_dimension_csv(spark, path, SPECS[DEPARTMENTS]).rows


def _hires_csv(spark, sf) -> str:
    """``orders`` as hires CSV files in key order: padded names, dates in four
    spellings (``T`` form, ``.000Z`` fraction, one-digit parts, and a
    trailing ``Z`` without fraction that the loader cannot parse), and a
    non-numeric job id on every ninth order."""
    k = F.col("o_orderkey")
    d = F.col("o_orderdate")
    iso = iso_string(d)
    date_txt = (F.when(k % 5 == 0, F.concat(iso, F.lit("Z")))
                .when(k % 5 == 1, F.concat(iso, F.lit(".000Z")))
                .when(k % 5 == 2, F.format_string("%d-%d-%d %d:%d:%d", F.year(d), F.month(d),
                                                  F.dayofmonth(d), F.hour(d), F.minute(d),
                                                  F.second(d)))
                .otherwise(iso))
    rows = table(spark, sf, "orders").orderBy("o_orderkey").select(
        k.cast("string").alias("id"),
        F.concat(F.lit("  "), F.col("o_orderpriority"), F.lit(" ")).alias("nombre"),
        date_txt.alias("fecha_hora"), F.col("o_custkey").cast("string").alias("id_departamento"),
        F.when(k % 9 == 0, F.lit("abc")).alias("id_trabajo"))
    path = scratch_dir(spark, "csv-hires")
    write_csv(rows, path, header=True)
    return path


_ISO_SQL = "strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S')"
# The date as the CSV file spells it.
_DATE_SQL = f"""CASE o_orderkey % 5 WHEN 0 THEN {_ISO_SQL} || 'Z' WHEN 1 THEN {_ISO_SQL} || '.000Z'
  WHEN 2 THEN concat(year(o_orderdate), '-', month(o_orderdate), '-', day(o_orderdate), ' ', hour(o_orderdate), ':',
                     minute(o_orderdate), ':', CAST(second(o_orderdate) AS INTEGER))
  ELSE {_ISO_SQL} END"""
_LINE_SQL = f"""o_orderkey || ',  ' || o_orderpriority || ' ,' || ({_DATE_SQL}) || ',' || o_custkey || ','
  || CASE WHEN o_orderkey % 9 = 0 THEN 'abc' ELSE '' END"""


@register("csv_roundtrip_fact", """
SELECT CAST(o_orderkey AS INTEGER) AS id, o_orderpriority AS nombre,
       CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderdate END AS fecha_hora,
       CAST(o_custkey AS INTEGER) AS id_departamento, CAST(NULL AS INTEGER) AS id_trabajo
FROM orders WHERE o_orderkey % 9 <> 0
""")
def csv_roundtrip_fact(spark, sf):
    return read_hires_csv(spark, _hires_csv(spark, sf), SPECS[HIRES]).rows


@register("csv_load_errors", f"""
SELECT 'empleados_contratados' AS tabla, indice, 'csv' AS etapa,
       'id_trabajo' AS campo, 'int_parsing' AS regla, {_LINE_SQL} AS valor
FROM (SELECT *, row_number() OVER (ORDER BY o_orderkey) - 1 AS indice FROM orders) WHERE o_orderkey % 9 = 0
""")
def csv_load_errors(spark, sf):
    """The report of a bad row holds the row and its position in the load."""
    return read_hires_csv(spark, _hires_csv(spark, sf), SPECS[HIRES]).errors


_QUOTED = "{c} || chr(10) || 'line \"two\", and, ,three'"


@register("csv_quoted_dim", f"""
SELECT CAST(s_suppkey AS INTEGER) AS id, {_QUOTED.format(c='s_name')} AS departamento FROM supplier
""")
def csv_quoted_dim(spark, sf):
    """Names with line breaks, quotes and commas survive the round trip."""
    path = scratch_dir(spark, "csv-quoted")
    name = F.concat("s_name", F.lit('\nline "two", and, ,three'))
    write_csv(table(spark, sf, "supplier").select("s_suppkey", name.alias("s_name")), path, header=False)
    return read_dimension_csv(spark, path, SPECS[DEPARTMENTS]).rows


@register("csv_quoted_fact", f"""
SELECT CAST(o_orderkey AS INTEGER) AS id, {_QUOTED.format(c='o_orderpriority')} AS nombre, o_orderdate AS fecha_hora,
       CAST(o_custkey AS INTEGER) AS id_departamento, CAST(NULL AS INTEGER) AS id_trabajo
FROM orders
""")
def csv_quoted_fact(spark, sf):
    path = scratch_dir(spark, "csv-quoted")
    rows = table(spark, sf, "orders").select(
        "o_orderkey", F.concat("o_orderpriority", F.lit('\nline "two", and, ,three')).alias("nombre"),
        iso_string(F.col("o_orderdate")).alias("fecha_hora"), "o_custkey", F.lit(None).cast("string").alias("j"))
    write_csv(rows, path, header=True)
    return read_hires_csv(spark, path, SPECS[HIRES]).rows


@register("csv_documents", r"""
SELECT row_number() OVER (ORDER BY doc_id) - 1 AS indice, 3 AS campos, CAST(doc_id AS VARCHAR) AS id,
       sha256(regexp_replace(coalesce(text, ''), '\r\n?', chr(10), 'g')) AS texto, coalesce(source, '') AS fuente
FROM documents
""")
def csv_documents(spark, sf):
    """Whole texts, with their quotes, commas and line breaks, through CSV files
    that are read in splits: every record at its position, every field as it was."""
    path = scratch_dir(spark, "csv-documents")
    write_csv(table(spark, sf, "documents").orderBy("doc_id").select("doc_id", "text", "source"), path, header=True)
    field = [F.get("fields", F.lit(i)) for i in range(3)]
    return read_records(spark, path, header=True).select(
        "indice", F.size("fields").alias("campos"), field[0].alias("id"), F.sha2(field[1], 256).alias("texto"),
        field[2].alias("fuente"))


QUOTES = 2000  # doubled quotes in a name, enough to exhaust a recursive parser's stack


@register("csv_many_quotes", f"""
SELECT 'fila' AS tipo, CAST(s_suppkey AS BIGINT) AS id, sha256(s_name || repeat('"', {QUOTES})) AS valor
FROM supplier WHERE s_suppkey % 3 <> 1
UNION ALL
SELECT 'error', indice, sha256(s_suppkey || ',' || s_name || repeat('"', {QUOTES}))
FROM (SELECT *, row_number() OVER (ORDER BY s_suppkey) - 1 AS indice FROM supplier) WHERE s_suppkey % 3 = 1
""")
def csv_many_quotes(spark, sf):
    """Names with thousands of quotes: rows of one field too many are cut, and a
    number that doesn't parse is reported with its row."""
    path = scratch_dir(spark, "csv-quotes")
    k = F.col("s_suppkey")
    name = F.concat("s_name", F.repeat(F.lit('"'), F.lit(QUOTES)))
    quoted = F.concat(F.lit('"'), F.replace(name, F.lit('"'), F.lit('""')), F.lit('"'))
    extra = F.when(k % 3 == 0, F.concat(F.lit(","), quoted)).otherwise(F.lit(""))
    number = F.when(k % 3 == 1, F.concat(F.lit("no"), k)).otherwise(k.cast("string"))
    (table(spark, sf, "supplier").orderBy("s_suppkey")
     .select(F.concat(number, F.lit(","), quoted, extra).alias("value")).write.text(path))
    load = read_dimension_csv(spark, path, SPECS[DEPARTMENTS])
    return (load.rows.select(F.lit("fila").alias("tipo"), F.col("id").cast("long").alias("id"),
                             F.sha2("departamento", 256).alias("valor"))
            .unionAll(load.errors.select(F.lit("error"), "indice", F.sha2(F.regexp_replace("valor", "^no", ""), 256))))


# --------------------------------------------------------------------------
# JSON payload ingest (S6, S7, F11, J2p, V1-V4, W7-W9)
# --------------------------------------------------------------------------
def _payload_records(df: DataFrame, tabla: str) -> DataFrame:
    """(tabla, chunk, k, r): one JSON record per row, chunked by key range."""
    rec = F.to_json(F.struct(*[F.col(c) for c in df.columns]))
    return spread(df).select(F.lit(tabla).alias("tabla"),
                             F.floor(F.col("id") / PAYLOAD_GROUP).alias("_chunk"),
                             F.col("id").alias("k"), rec.alias("r"))


# The payload files of a session's tables: several queries read the same.
_payload_paths: dict[tuple, str] = {}


def write_payloads(spark, sf) -> str:
    """The three tables as JSON Lines payloads, one document per table and
    key range of 1000 (keys are unique, so no group exceeds the service's
    maximum); records inside a group are in key order."""
    known = (spark.sparkContext.applicationId, sf)
    if known in _payload_paths:
        return _payload_paths[known]
    path = scratch_dir(spark, "payloads")
    h = hires_rows(spark, sf).withColumn("fecha_hora", iso_string("fecha_hora"))
    recs = (_payload_records(departments_rows(spark, sf), DEPARTMENTS)
            .unionByName(_payload_records(jobs_rows(spark, sf), JOBS))
            .unionByName(_payload_records(h, HIRES)))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("k", "r"))), lambda x: x["r"])
    lines = (recs.groupBy("tabla", "_chunk").agg(ordered.alias("_r"))
             .select(F.concat(F.lit('{"'), F.col("tabla"), F.lit('": ['),
                              F.array_join("_r", ", "), F.lit("]}")).alias("value")))
    lines.write.text(path)
    _payload_paths[known] = path
    return path


def run_json_ingest(spark, sf):
    store = _store(spark, "ingest-store")
    result = jobs.ingest_payloads(store, read_payloads(spark, write_payloads(spark, sf), multi_line=False))
    return store, result


INGEST_SUMMARY_SQL = f"""
SELECT 'departamentos' AS tabla, COUNT(*) AS recibidos,
       COUNT(*) FILTER (WHERE {_VALID_DEPT}) AS validos,
       COUNT(*) FILTER (WHERE {_VALID_DEPT}) AS upsert FROM customer
UNION ALL
SELECT 'trabajos', COUNT(*), COUNT(*) FILTER (WHERE {_VALID_JOB}),
       COUNT(*) FILTER (WHERE {_VALID_JOB}) FROM part
UNION ALL
SELECT 'empleados_contratados', COUNT(*), COUNT(*) FILTER (WHERE {_VALID_HIRE}),
       COUNT(*) FILTER (WHERE {_VALID_HIRE}) FROM {HIRES_SQL} h
"""


@register("json_batch_ingest", INGEST_SUMMARY_SQL)
def json_batch_ingest(spark, sf):
    return run_json_ingest(spark, sf)[1].summary


@register("json_ingest_table", f"SELECT * FROM {HIRES_SQL} h WHERE {_VALID_HIRE}")
def json_ingest_table(spark, sf):
    store, _ = run_json_ingest(spark, sf)
    return store.read(SPECS[HIRES])


@register("json_ingest_dimensions", f"""
SELECT 'departamentos' AS tabla, CAST(c_custkey AS INTEGER) AS id, c_name AS nombre FROM customer WHERE {_VALID_DEPT}
UNION ALL SELECT 'trabajos', CAST(p_partkey AS INTEGER), p_name FROM part WHERE {_VALID_JOB}
""")
def json_ingest_dimensions(spark, sf):
    """The other two stored tables, row by row."""
    store, _ = run_json_ingest(spark, sf)
    return (store.read(SPECS[DEPARTMENTS]).select(F.lit(DEPARTMENTS).alias("tabla"), "id", F.col("departamento").alias("nombre"))
            .unionAll(store.read(SPECS[JOBS]).select(F.lit(JOBS), "id", "trabajo")))


def _pos(key: str) -> str:
    return f"row_number() OVER (PARTITION BY floor({key} / {PAYLOAD_GROUP}) ORDER BY {key}) - 1"


def _fields_sql(source: str, tabla: str, *columns: tuple[str, str]) -> str:
    return " UNION ALL ".join(
        f"SELECT '{tabla}' AS tabla, pos AS indice, 'modelo' AS etapa, '{name}' AS campo, 'greater_than' AS regla, "
        f"CAST({column} AS VARCHAR) AS valor FROM {source} WHERE {column} <= 0" for column, name in columns)


@register("json_ingest_errors", f"""
WITH c AS (SELECT *, {_pos('c_custkey')} AS pos FROM customer),
     p AS (SELECT *, {_pos('p_partkey')} AS pos FROM part),
     h AS (SELECT *, {_pos('id')} AS pos FROM {HIRES_SQL} x)
{_fields_sql('c', 'departamentos', ('c_custkey', 'id'))}
UNION ALL {_fields_sql('p', 'trabajos', ('p_partkey', 'id'))}
UNION ALL {_fields_sql('h', 'empleados_contratados', ('id', 'id'), ('id_departamento', 'id_departamento'),
                       ('id_trabajo', 'id_trabajo'))}
UNION ALL SELECT 'empleados_contratados', pos, 'calidad', 'id_departamento', 'fk_missing', CAST(id_departamento AS VARCHAR)
FROM h WHERE {_FIELDS_OK} AND NOT {_DEPT_OK}
UNION ALL SELECT 'empleados_contratados', pos, 'calidad', 'id_trabajo', 'fk_missing', CAST(id_trabajo AS VARCHAR)
FROM h WHERE {_FIELDS_OK} AND NOT {_JOB_OK}
""")
def json_ingest_errors(spark, sf):
    """Error rows of the ingest (``indice`` = position in the payload group)."""
    _, result = run_json_ingest(spark, sf)
    return result.errors


# --------------------------------------------------------------------------
# Payloads that repeat ids, and rejected payloads (J2p, V5, F11, S6, T1)
# --------------------------------------------------------------------------
def _write_documents(spark, records: DataFrame, path: str, per: int) -> None:
    """``(id, k, r)`` as JSON Lines: one departments group per ``per`` ids."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("id", "k", "r"))), lambda x: x["r"])
    (records.groupBy(F.floor(F.col("id") / per).alias("g")).agg(ordered.alias("rs"))
     .select(F.concat(F.lit('{"departamentos": ['), F.array_join("rs", ", "), F.lit("]}")).alias("value"))
     .write.text(path))


def _repeating_ingest(spark, sf, on_duplicate: str):
    """Three waves of payloads about the same departments, one after the
    other: all of them; every third renamed; every fifth twice in one group."""
    base = scratch_dir(spark, "repeating")
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").cast("int").alias("id"), "s_name")

    def records(df, prefix, times=1):
        named = F.struct("id", F.concat(F.lit(prefix), F.col("k").cast("string"), F.lit(" "), F.col("s_name")).alias("departamento"))
        return df.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(times)))).select("id", "k", F.to_json(named).alias("r"))

    waves = ((records(s, "first"), "w1"), (records(s.where("id % 3 = 0"), "renamed"), "w2"),
             (records(s.where("id % 5 = 0"), "twice", 2), "w3"))
    for rows, name in waves:
        _write_documents(spark, rows, f"{base}/{name}", 20)
    store = _store(spark, "repeating-store")
    paths = [f"{base}/{name}" for _, name in waves]
    result = jobs.ingest_payloads(store, read_payloads(spark, paths, multi_line=False), on_duplicate=on_duplicate)
    return store, result


def _winner_sql(fifth: str) -> str:
    return f"""SELECT CAST(s_suppkey AS INTEGER) AS id,
  CASE {fifth} WHEN s_suppkey % 3 = 0 THEN 'renamed1 ' ELSE 'first1 ' END || s_name AS departamento
FROM supplier WHERE s_suppkey > 0"""


@register("ingest_repeated_ids", _winner_sql(""))
def ingest_repeated_ids(spark, sf):
    """V5: an id twice in one group fails that group alone; the same id in a
    later payload replaces the row."""
    return _repeating_ingest(spark, sf, "error")[0].read(SPECS[DEPARTMENTS])


@register("ingest_repeated_last", _winner_sql("WHEN s_suppkey % 5 = 0 THEN 'twice2 '"))
def ingest_repeated_last(spark, sf):
    """With the policy "last", the last occurrence in the latest payload wins."""
    return _repeating_ingest(spark, sf, "last")[0].read(SPECS[DEPARTMENTS])


@register("ingest_repeated_errors", """
SELECT 'departamentos' AS tabla, 2 * row_number() OVER (PARTITION BY floor(s_suppkey / 20) ORDER BY s_suppkey)
         - 1 + CASE WHEN s_suppkey < 20 AND z THEN 2 ELSE 0 END AS indice,
       'carga' AS etapa, 'id' AS campo, 'duplicate_key' AS regla, CAST(s_suppkey AS VARCHAR) AS valor
FROM supplier, (SELECT count(*) > 0 AS z FROM supplier WHERE s_suppkey = 0) WHERE s_suppkey % 5 = 0 AND s_suppkey > 0
""")
def ingest_repeated_errors(spark, sf):
    """One error row per repeated id, at its last position in the group (an
    invalid id 0 before it takes two places)."""
    return _repeating_ingest(spark, sf, "error")[1].errors.where("etapa = 'carga'")


REJECT_MAX = 3


@register("ingest_rejected", f"""
WITH n AS (SELECT o_orderkey % 7 AS k FROM orders)
SELECT CASE k WHEN 2 THEN 'no known table group' WHEN 3 THEN 'unknown table' WHEN 4 THEN 'group too small'
            WHEN 5 THEN 'group too large' ELSE 'group is not a list or document is not valid JSON' END AS motivo, COUNT(*) AS n
FROM n WHERE k BETWEEN 2 AND 6 GROUP BY 1
UNION ALL SELECT 'registros departamentos', COUNT(*) FROM n WHERE k = 1
UNION ALL SELECT 'registros trabajos', COUNT(*) + COUNT(*) FILTER (WHERE k = 1) FROM n WHERE k IN (0, 1)
""")
def ingest_rejected(spark, sf):
    """One document per order, of seven forms: a single group, two
    groups and an unknown key, none known, an unknown table, none, too many
    records, no list.  Why payloads are rejected, and the records of the rest."""
    k, key = F.col("o_orderkey") % 7, F.col("o_orderkey").cast("string")
    rec = F.concat(F.lit('{"id": '), key, F.lit(', "trabajo": "x"}'))
    forms = (("{\"tabla\": \"trabajos\", \"registros\": [", rec, "]}"),
             ('{"departamentos": [', rec, '], "trabajos": [', rec, ", ", rec, '], "otro": [1]}'),
             ('{"otro": [', rec, "]}"), ('{"tabla": "nada", "registros": [', rec, "]}"), ('{"departamentos": []}',),
             ('{"trabajos": [', *[rec, ", "] * REJECT_MAX, rec, "]}"), ('{"tabla": "trabajos", "registros": ', rec, "}"))
    value = F.lit(None).cast("string")
    for i, parts in enumerate(forms):
        value = F.when(k == i, F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts])).otherwise(value)
    path = scratch_dir(spark, "rejected")
    spread(table(spark, sf, "orders").select("o_orderkey")).select(value.alias("value")).write.text(path)
    p = payload_records(read_payloads(spark, path, multi_line=False), max_rows=REJECT_MAX)
    return (p.rejected.groupBy("motivo").agg(F.count("*").alias("n"))
            .unionAll(p.records.groupBy(F.concat(F.lit("registros "), F.col("tabla"))).agg(F.count("*"))))


# --------------------------------------------------------------------------
# Upsert (W7-W9, J7)
# --------------------------------------------------------------------------
UPSERT_SPLIT = "1996-07-01 00:00:00"   # batch: orders from this date on, renamed
TARGET_END = "1997-01-01 00:00:00"     # target: orders before this date


@register("upsert", f"""
SELECT id, CASE WHEN fecha_hora >= TIMESTAMP '{UPSERT_SPLIT}' THEN o_orderstatus ELSE nombre END AS nombre,
       fecha_hora, id_departamento, id_trabajo
FROM {HIRES_SQL} h JOIN orders ON o_orderkey = id
""")
def upsert(spark, sf):
    """Load the older orders, then upsert the newer ones (overlapping half
    a year) with a changed name: matched keys are replaced, new keys
    inserted, the rest kept."""
    store = _store(spark, "upsert-store")
    spec = SPECS[HIRES]
    rows = hires_rows(spark, sf)
    ts = F.col("fecha_hora")
    store.append(spec, rows.where(ts < F.lit(TARGET_END).cast("timestamp_ntz")))
    batch = (rows.where(ts >= F.lit(UPSERT_SPLIT).cast("timestamp_ntz"))
             .join(table(spark, sf, "orders").select(F.col("o_orderkey").cast("int").alias("id"),
                                                      "o_orderstatus"), "id")
             .withColumn("nombre", F.col("o_orderstatus")).drop("o_orderstatus"))
    store.upsert(spec, batch)
    return store.read(spec)


@register("upsert_reopened", f"""
WITH h AS (SELECT * FROM {HIRES_SQL} x),
second AS (SELECT id, NULL AS nombre, fecha_hora, NULL AS id_departamento, id_trabajo FROM h WHERE id % 3 = 0),
third AS (SELECT id, 'third' AS nombre, fecha_hora, id_departamento, NULL AS id_trabajo FROM h WHERE id % 4 = 0)
SELECT * FROM third
UNION ALL SELECT * FROM second WHERE id NOT IN (SELECT id FROM third)
UNION ALL SELECT * FROM h WHERE id % 2 = 0 AND id NOT IN (SELECT id FROM third) AND id NOT IN (SELECT id FROM second)
""")
def upsert_reopened(spark, sf):
    """Three stores of different bucket counts on one table: one creates it,
    the others open it again and upsert, also NULLs over values."""
    root, spec = scratch_dir(spark, "reopened-store"), SPECS[HIRES]
    h = hires_rows(spark, sf)
    none = lambda c: F.lit(None).cast(h.schema[c].dataType)
    first = TableStore(spark, root, default_buckets=8)
    first.create_if_missing(spec)
    TableStore(spark, root, default_buckets=3).upsert(spec, h.where("id % 2 = 0"))
    TableStore(spark, root, default_buckets=5).upsert(
        spec, h.where("id % 3 = 0").withColumns({c: none(c) for c in ("nombre", "id_departamento")}))
    first.upsert(spec, h.where("id % 4 = 0").withColumns({"nombre": F.lit("third"), "id_trabajo": none("id_trabajo")}))
    return TableStore(spark, root, default_buckets=2).read(spec)


@register("upsert_deltas", f"""
WITH h AS (SELECT *, id % 97 AS k FROM {HIRES_SQL} x)
SELECT id, CASE WHEN k >= 6 THEN nombre ELSE 'delta ' || CAST(k AS INTEGER) END AS nombre,
       fecha_hora, CASE WHEN k >= 6 THEN id_departamento END AS id_departamento, id_trabajo
FROM h WHERE id % 2 = 0 OR k < 6
""")
def upsert_deltas(spark, sf):
    """Half of the hires, then many small upserts (new and stored keys, each row
    touched twice), read while some buckets have deltas and others are compacted."""
    store = TableStore(spark, scratch_dir(spark, "delta-store"), default_buckets=4, max_parts=5)
    spec, h = SPECS[HIRES], hires_rows(spark, sf)
    store.append(spec, h.where("id % 2 = 0"))
    for k in (0, 1, 2, 3, 4, 5):
        nothing = F.lit(None).cast("int")
        named = h.where(f"id % 97 IN ({k}, {min(k + 1, 5)})").withColumns(
            {"nombre": F.concat(F.lit("delta "), (F.col("id") % 97).cast("string")), "id_departamento": nothing})
        store.upsert(spec, named)
    return store.read(spec)


#: Months in which the orders are loaded one after the other.
LOAD_MONTHS = 12


def _yearly_store(spark, sf) -> TableStore:
    """The hires, loaded a year at a time, with late corrections of every 50th."""
    store = TableStore(spark, scratch_dir(spark, "yearly-store"), default_buckets=4)
    spec = SPECS[HIRES]
    h = materialize(hires_rows(spark, sf), "yearly-hires")
    for year in range(1992, 1999):
        store.append(spec, h.where(F.year("fecha_hora") == year))
    store.append(spec, h.where((F.year("fecha_hora") < 1992) | (F.year("fecha_hora") > 1998) | F.col("fecha_hora").isNull()))
    moved = h.where("id % 50 = 7").withColumn("fecha_hora", F.add_months("fecha_hora", LOAD_MONTHS).cast("timestamp_ntz"))
    store.upsert(spec, moved)
    return store


_YEARLY_SQL = f"""(SELECT id, nombre, CASE WHEN id % 50 = 7 THEN CAST(date_trunc('day', fecha_hora) + INTERVAL {LOAD_MONTHS} MONTH AS TIMESTAMP)
  ELSE fecha_hora END AS fecha_hora, id_departamento, id_trabajo FROM {HIRES_SQL} x)"""


@register("stored_year", f"""
SELECT * FROM {_YEARLY_SQL} h WHERE fecha_hora >= TIMESTAMP '1996-01-01' AND fecha_hora < TIMESTAMP '1997-01-01'
""")
def stored_year(spark, sf):
    """F1 on a stored table: only the parts that may hold rows of the year are
    opened; rows that a correction moved into or out of it count by their new time."""
    return _yearly_store(spark, sf).read(SPECS[HIRES], dt.datetime(1996, 1, 1), dt.datetime(1997, 1, 1))


@register("stored_counts", f"""
SELECT 'total' AS momento, COUNT(*) AS registros FROM {HIRES_SQL} h
UNION ALL SELECT 'compactada', COUNT(*) FROM {HIRES_SQL} h
""")
def stored_counts(spark, sf):
    """J4p from the states: with corrections that may replace rows, and compacted."""
    store, spec = _yearly_store(spark, sf), SPECS[HIRES]
    before = store.count(spec)
    store.compact(spec)
    return spark.createDataFrame([("total", before), ("compactada", store.count(spec))], "momento string, registros bigint")


# --------------------------------------------------------------------------
# Backup -> guarded wipe -> restore (W1, W3, W10, S4, J3p) and catalog
# --------------------------------------------------------------------------
def _loaded_store(spark, sf, name) -> TableStore:
    store = _store(spark, name)
    store.append(SPECS[DEPARTMENTS], departments_rows(spark, sf))
    store.append(SPECS[JOBS], jobs_rows(spark, sf))
    store.append(SPECS[HIRES], hires_rows(spark, sf))
    return store


def _backup_wipe_restore(spark, sf):
    store = _loaded_store(spark, sf, "restore-store")
    directory = scratch_dir(spark, "backups")
    made = jobs.backup_tables(store, "parquet", directory, [HIRES], now=BACKUP_CLOCK).first()
    jobs.wipe_table(store, HIRES, directory, only_today=True, today=BACKUP_CLOCK.date())
    result = jobs.restore_table(store, HIRES, made["ruta"], "parquet")
    return store, result


# A restore is checked against the stored dimensions, which hold every id.
_RESTORED = (f"{_FIELDS_OK} AND (id_departamento IS NULL OR id_departamento IN (SELECT c_custkey FROM customer)) "
             "AND (id_trabajo IS NULL OR id_trabajo IN (SELECT p_partkey FROM part))")


@register("backup_restore_parquet", f"SELECT * FROM {HIRES_SQL} h WHERE {_RESTORED}")
def backup_restore_parquet(spark, sf):
    """Backup the hires, wipe them (guarded by that backup), restore: the
    rows that pass the restore's rules come back unchanged."""
    store, _ = _backup_wipe_restore(spark, sf)
    return store.read(SPECS[HIRES])


@register("restore_summary", f"""
SELECT 'empleados_contratados' AS tabla, COUNT(*) FILTER (WHERE {_RESTORED}) AS restaurados,
       COUNT(*) AS recibidos, COUNT(*) FILTER (WHERE {_RESTORED}) AS validos
FROM {HIRES_SQL} h
""")
def restore_summary(spark, sf):
    return _backup_wipe_restore(spark, sf)[1].summary


@register("restore_error_positions", f"""
SELECT COUNT(*) AS filas, COUNT(DISTINCT id) AS posiciones, true AS dentro
FROM {HIRES_SQL} h WHERE NOT ({_RESTORED})
""")
def restore_error_positions(spark, sf):
    """Every row that a restore refuses has a position of its own, within the
    backup (rows of a distributed backup have no order that SQL knows)."""
    _, result = _backup_wipe_restore(spark, sf)
    n = F.lit(result.summary.first()["recibidos"])
    return result.errors.groupBy("indice").agg(F.count("*").alias("e")).agg(
        F.count("*").alias("filas"), F.count_distinct("indice").alias("posiciones"),
        F.coalesce((F.min("indice") >= 0) & (F.max("indice") < n), F.lit(True)).alias("dentro"))


@register("wipe_guarded", f"""
SELECT 'empleados_contratados' AS tabla, COUNT(*) AS borrados, 1 AS total_archivos,
       'empleados_contratados_{BACKUP_CLOCK.strftime(BACKUP_STAMP)}.parquet' AS respaldos FROM orders
""")
def wipe_guarded(spark, sf):
    """Back up the hires, then wipe them; the guard finds that day's
    backup and the report gives the number of rows deleted."""
    store = _loaded_store(spark, sf, "wipe-store")
    directory = scratch_dir(spark, "backups")
    jobs.backup_tables(store, "parquet", directory, [HIRES], now=BACKUP_CLOCK)
    return jobs.wipe_table(store, HIRES, directory, only_today=True, today=BACKUP_CLOCK.date())


_STAMP = BACKUP_CLOCK.strftime(BACKUP_STAMP)
_DAY = BACKUP_CLOCK.strftime(BACKUP_DAY)


@register("backup_catalog", " UNION ALL ".join(
    f"SELECT '{t}' AS tabla, '{t}_{_STAMP}.parquet' AS archivo, '{_DAY}' AS fecha, "
    f"'parquet' AS formato, (SELECT COUNT(*) FROM {src}) AS registros"
    for t, src in zip(TABLE_ORDER, ("customer", "part", "orders"))))
def backup_catalog(spark, sf):
    """Back up all three tables, then list each table's backups of that day
    and join the listing to the backup report."""
    store = _loaded_store(spark, sf, "catalog-store")
    directory = scratch_dir(spark, "backups")
    made = jobs.backup_tables(store, "parquet", directory, now=BACKUP_CLOCK)
    listed = None
    for t in TABLE_ORDER:
        one = list_backups(spark, directory, t, day=_DAY)
        listed = one if listed is None else listed.unionByName(one)
    return (listed.join(made.select("ruta", "registros"), "ruta")
            .select("tabla", "archivo", "fecha", "formato", "registros"))


# --------------------------------------------------------------------------
# ISO timestamps
# --------------------------------------------------------------------------
@register("timestamp_iso", """
SELECT 'events' AS src, event_id AS id,
       CASE WHEN epoch_us(ts) % 1000000 = 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S')
            ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') END AS iso, ts AS back
FROM events
UNION ALL
SELECT 'orders', o_orderkey,
       CASE WHEN epoch_us(o_orderdate) % 1000000 = 0 THEN strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S')
            ELSE strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.%f') END, o_orderdate
FROM orders
""")
def timestamp_iso(spark, sf):
    ev = table(spark, sf, "events").select(F.lit("events").alias("src"), F.col("event_id").alias("id"),
                                            F.col("ts"))
    od = table(spark, sf, "orders").select(F.lit("orders").alias("src"), F.col("o_orderkey").alias("id"),
                                            F.col("o_orderdate").alias("ts"))
    both = ev.unionByName(od).withColumn("iso", iso_string("ts"))
    return both.select("src", "id", "iso", iso_timestamp(F.col("iso")).alias("back"))


@register("backup_total", """
SELECT (SELECT COUNT(*) FROM customer) + (SELECT COUNT(*) FROM part)
       + (SELECT COUNT(*) FROM orders) AS registros
""")
def backup_total(spark, sf):
    """Total records written by a backup of the three tables."""
    store = _loaded_store(spark, sf, "total-store")
    made = jobs.backup_tables(store, "parquet", scratch_dir(spark, "backups"), now=BACKUP_CLOCK)
    return jobs.backup_records_total(made)


# --------------------------------------------------------------------------
# Historical CSV load (J1p, W4-W6, W12, A5, L1)
# --------------------------------------------------------------------------
def _full_load(spark, sf):
    base = scratch_dir(spark, "csv-load")
    write_csv(table(spark, sf, "supplier").select("s_suppkey", "s_name"), f"{base}/departments", False)
    write_csv(table(spark, sf, "part").select("p_partkey", "p_name"), f"{base}/jobs", False)
    store = _store(spark, "load-store")
    return jobs.full_load(store, f"{base}/departments", f"{base}/jobs", _hires_csv(spark, sf))


_LOADED_SQL = "o_orderkey % 9 <> 0 AND o_custkey IN (SELECT s_suppkey FROM supplier)"


@register("full_load_counts", f"""
SELECT 'departamentos' AS tabla, COUNT(*) AS registros FROM supplier WHERE length(s_name) <= 50
UNION ALL SELECT 'trabajos', COUNT(*) FROM part WHERE length(p_name) <= 200
UNION ALL SELECT 'empleados_contratados', COUNT(*) FROM orders WHERE {_LOADED_SQL}
""")
def full_load_counts(spark, sf):
    """Load departments (the suppliers), jobs and hires from CSV into fresh
    tables, then count each table (the loader's report).  Hires of customers
    who are no supplier point to no department and aren't loaded."""
    return _full_load(spark, sf).counts


@register("full_load_errors", """
WITH o AS (SELECT *, row_number() OVER (ORDER BY o_orderkey) - 1 AS indice FROM orders)
SELECT 'csv' AS etapa, 'id_trabajo' AS campo, 'int_parsing' AS regla, indice FROM o WHERE o_orderkey % 9 = 0
UNION ALL
SELECT 'calidad', 'id_departamento', 'fk_missing', indice FROM o
WHERE o_orderkey % 9 <> 0 AND o_custkey NOT IN (SELECT s_suppkey FROM supplier)
""")
def full_load_errors(spark, sf):
    """Every refused row with its position in the hires files."""
    return _full_load(spark, sf).errors.select("etapa", "campo", "regla", "indice")


@register("full_load_preview", f"""
SELECT LEAST(5, COUNT(*)) AS filas, LEAST(5, COUNT(*)) AS cargadas FROM orders WHERE {_LOADED_SQL}
""")
def full_load_preview(spark, sf):
    """L1: the preview's five rows of the loaded hires (no order), and how many
    of them are rows of the orders."""
    preview = _full_load(spark, sf).preview
    orders = table(spark, sf, "orders").select(
        F.col("o_orderkey").cast("int").alias("id"), F.col("o_custkey").cast("int").alias("id_departamento"),
        F.col("o_orderpriority").alias("nombre"), F.lit(True).alias("found"))
    return preview.join(orders, ["id", "id_departamento", "nombre"], "left").agg(
        F.count("*").alias("filas"), F.count("found").alias("cargadas"))
