"""Validation, FK and key queries on the driver's
tables.

``part`` and ``orders`` are turned into JSON payload records of the jobs
and hires tables, with fields damaged by fixed rules on their keys (a
negative id, a missing id, a too-long name, a number where text belongs,
an unparsable date, ...).  The Spark side parses those records and runs
the compiled rules; the oracle writes the expected outcome of each damage
rule directly in SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hirelake.functions.scalar import iso_string
from hirelake.operators import counts, foreign_keys, keys, validate
from hirelake.plans.registry import register
from hirelake.plans.tables import table
from hirelake.session import spread
from hirelake.spec import FK_MESSAGE_SUFFIX, HIRES, JOBS, FieldSpec, TableSpec, table_spec


def json_text(c: Column) -> Column:
    """A JSON string literal (quoted and escaped) for text column ``c``."""
    return F.regexp_replace(F.to_json(F.array(c)), r"^\[|\]$", "")


def _member(name: str, value: Column) -> Column:
    return F.concat(F.lit(f'"{name}": '), value)


def _record(*members: Column) -> Column:
    return F.concat(F.lit("{"), F.concat_ws(", ", *members), F.lit("}"))


def job_records(spark: SparkSession, sf: str) -> DataFrame:
    """``part`` as raw JSON records of the jobs table (indice = p_partkey)."""
    k = F.col("p_partkey")
    id_m = (F.when(k % 13 == 0, F.lit(None))
            .when(k % 7 == 0, _member("id", (-k).cast("string")))
            .when(k % 11 == 0, _member("id", F.concat(F.lit('" '), k.cast("string"), F.lit(' "'))))
            .otherwise(_member("id", k.cast("string"))))
    name_m = (F.when(k % 17 == 0, _member("trabajo", F.lit('""')))
              .when(k % 19 == 0, _member("trabajo", json_text(F.rpad("p_name", 201, "*"))))
              .when(k % 23 == 0, _member("trabajo", F.col("p_size").cast("string")))
              .otherwise(_member("trabajo", json_text(F.col("p_name")))))
    return spread(table(spark, sf, "part")).select(k.alias("indice"), _record(id_m, name_m).alias("raw"))


def hire_records(spark: SparkSession, sf: str) -> DataFrame:
    """``orders`` as raw JSON records of the hires table (indice = o_orderkey)."""
    k = F.col("o_orderkey")
    iso = iso_string(F.col("o_orderdate"))
    id_m = (F.when(k % 7 == 0, _member("id", (k + 2147483648).cast("string")))
            .when(k % 29 == 0, _member("id", F.concat(k.cast("string"), F.lit(".5"))))
            .otherwise(_member("id", k.cast("string"))))
    name_m = (F.when(k % 11 == 0, _member("nombre", json_text(F.rpad("o_orderpriority", 101, "*"))))
              .when(k % 37 == 0, F.lit(None))
              .otherwise(_member("nombre", json_text(F.col("o_orderpriority")))))
    date_m = (F.when(k % 13 == 0, _member("fecha_hora", F.lit('"not a date"')))
              .when(k % 31 == 0, _member("fecha_hora", json_text(F.concat(iso, F.lit("Z")))))
              .otherwise(_member("fecha_hora", json_text(iso))))
    dep_m = _member("id_departamento",
                    F.when(k % 17 == 0, F.lit("0")).otherwise(F.col("o_custkey").cast("string")))
    job_m = F.when(k % 19 == 0, _member("id_trabajo", F.lit('"abc"')))
    return spread(table(spark, sf, "orders")).select(
        k.alias("indice"), _record(id_m, name_m, date_m, dep_m, job_m).alias("raw"))


def _validated_jobs(spark, sf):
    return validate.validate_json(job_records(spark, sf), "raw", table_spec(JOBS))


def _validated_hires(spark, sf):
    return validate.validate_json(hire_records(spark, sf), "raw", table_spec(HIRES))


_ERR_COLS = "tabla, indice, etapa, campo, regla, valor"

VALIDATE_DIM_SQL = f"""
SELECT {_ERR_COLS} FROM (
  SELECT 'trabajos' AS tabla, p_partkey AS indice, 'modelo' AS etapa, 'id' AS campo,
         CASE WHEN p_partkey % 13 = 0 THEN 'missing' ELSE 'greater_than' END AS regla,
         CASE WHEN p_partkey % 13 = 0 THEN NULL ELSE CAST(-p_partkey AS VARCHAR) END AS valor
  FROM part WHERE p_partkey % 13 = 0 OR p_partkey % 7 = 0
  UNION ALL
  SELECT 'trabajos', p_partkey, 'modelo', 'trabajo',
         CASE WHEN p_partkey % 17 = 0 THEN 'string_too_short'
              WHEN p_partkey % 19 = 0 THEN 'string_too_long' ELSE 'string_type' END,
         CASE WHEN p_partkey % 17 = 0 THEN ''
              WHEN p_partkey % 19 = 0 THEN rpad(p_name, 201, '*')
              ELSE CAST(p_size AS VARCHAR) END
  FROM part WHERE p_partkey % 17 = 0 OR p_partkey % 19 = 0 OR p_partkey % 23 = 0)
"""

_ISO = "strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S')"

VALIDATE_FACT_SQL = f"""
SELECT {_ERR_COLS} FROM (
  SELECT 'empleados_contratados' AS tabla, o_orderkey AS indice, 'modelo' AS etapa, 'id' AS campo,
         CASE WHEN o_orderkey % 7 = 0 THEN 'int_parsing' ELSE 'int_from_float' END AS regla,
         CASE WHEN o_orderkey % 7 = 0 THEN CAST(o_orderkey + 2147483648 AS VARCHAR)
              ELSE CAST(o_orderkey AS VARCHAR) || '.5' END AS valor
  FROM orders WHERE o_orderkey % 7 = 0 OR o_orderkey % 29 = 0
  UNION ALL
  SELECT 'empleados_contratados', o_orderkey, 'modelo', 'nombre', 'string_too_long',
         rpad(o_orderpriority, 101, '*')
  FROM orders WHERE o_orderkey % 11 = 0
  UNION ALL
  SELECT 'empleados_contratados', o_orderkey, 'modelo', 'fecha_hora', 'datetime_parsing',
         CASE WHEN o_orderkey % 13 = 0 THEN 'not a date' ELSE {_ISO} || 'Z' END
  FROM orders WHERE o_orderkey % 13 = 0 OR o_orderkey % 31 = 0
  UNION ALL
  SELECT 'empleados_contratados', o_orderkey, 'modelo', 'id_departamento', 'greater_than', '0'
  FROM orders WHERE o_orderkey % 17 = 0 OR o_custkey = 0
  UNION ALL
  SELECT 'empleados_contratados', o_orderkey, 'modelo', 'id_trabajo', 'int_parsing', 'abc'
  FROM orders WHERE o_orderkey % 19 = 0)
"""


@register("validate_dim", VALIDATE_DIM_SQL)
def validate_dim(spark, sf):
    return validate.error_rows(_validated_jobs(spark, sf), JOBS, "modelo")


@register("validate_fact", VALIDATE_FACT_SQL)
def validate_fact(spark, sf):
    return validate.error_rows(_validated_hires(spark, sf), HIRES, "modelo")


# --- coercion: number and date spellings ------------------------------------
# (spelling of the number n, error code or None) by event_id % length.
NUMBERS = (("{n}", None), ("{n}.0", None), ("{n}.0000001", "int_from_float"), ("{n}e0", None),
           ("0.0000001", "int_from_float"), ("{n}.5", "int_from_float"), ("-{n}", "greater_than"),
           ("1e40", "int_parsing"), ("true", "int_type"))
DATES = (("2021-07-27T16:02:08", True), ("2021-07-27 16:02:08.25", True), ("2021-07-27", True), ("2021-07-27T16:02", True),
         ("2021", False), ("2021-07", False), ("2021-7-2", False), ("+12021-01-01", False), ("2021-07-27T16:02:08 UTC", False),
         ("2021-07-27T16:02:08 Europe/Madrid", False), ("2021-07-27T16:02:08GMT+8", False), ("2021-02-30", False),
         ("2021-07-27T16:02:08Z", False), ("16:02:08", False))
_CYCLE = len(NUMBERS)


_CODES = " ".join(f"WHEN {i} THEN '{c}'" for i, (_, c) in enumerate(NUMBERS) if c)
_BAD_DATES = ", ".join(str(i) for i, (_, ok) in enumerate(DATES) if not ok)


@register("coercion_errors", f"""
SELECT event_id AS indice, 'id' AS campo, CASE event_id % {_CYCLE} {_CODES} END AS regla
FROM events WHERE CASE event_id % {_CYCLE} {_CODES} END IS NOT NULL
UNION ALL
SELECT event_id, 'fecha_hora', 'datetime_parsing' FROM events WHERE event_id % {len(DATES)} IN ({_BAD_DATES})
""")
def coercion_errors(spark, sf):
    """V1, P5: which spellings of whole numbers and ISO dates pass."""
    k = F.col("event_id")
    number, date = F.lit(None).cast("string"), F.lit(None).cast("string")
    for i, (form, _) in enumerate(NUMBERS):
        number = F.when(k % _CYCLE == i, F.replace(F.lit(form), F.lit("{n}"), (k + 1).cast("string"))).otherwise(number)
    for i, (text, _) in enumerate(DATES):
        date = F.when(k % len(DATES) == i, F.lit(text)).otherwise(date)
    raw = _record(_member("id", number), _member("fecha_hora", json_text(date)))
    rows = table(spark, sf, "events").select(k.alias("indice"), raw.alias("raw"))
    return validate.error_rows(validate.validate_json(rows, "raw", table_spec(HIRES)), HIRES, "modelo") \
        .select("indice", "campo", "regla")


@register("validate_fact_rows", f"""
SELECT CAST(o_orderkey AS INTEGER) AS id,
       CASE WHEN o_orderkey % 37 = 0 THEN NULL ELSE o_orderpriority END AS nombre,
       o_orderdate AS fecha_hora, CAST(o_custkey AS INTEGER) AS id_departamento,
       CAST(NULL AS INTEGER) AS id_trabajo
FROM orders
WHERE NOT (o_orderkey % 7 = 0 OR o_orderkey % 29 = 0 OR o_orderkey % 11 = 0 OR o_orderkey % 13 = 0
           OR o_orderkey % 31 = 0 OR o_orderkey % 17 = 0 OR o_orderkey % 19 = 0 OR o_custkey = 0)
""")
def validate_fact_rows(spark, sf):
    """The typed rows that pass every rule (V1 routing)."""
    return validate.valid_rows(_validated_hires(spark, sf), table_spec(HIRES))


@register("validation_summary", """
SELECT 'trabajos' AS tabla, COUNT(*) AS recibidos,
       COUNT(*) FILTER (WHERE NOT (p_partkey % 13 = 0 OR p_partkey % 7 = 0 OR p_partkey % 17 = 0
                                   OR p_partkey % 19 = 0 OR p_partkey % 23 = 0)) AS validos
FROM part
UNION ALL
SELECT 'empleados_contratados', COUNT(*),
       COUNT(*) FILTER (WHERE NOT (o_orderkey % 7 = 0 OR o_orderkey % 29 = 0 OR o_orderkey % 11 = 0
                                   OR o_orderkey % 13 = 0 OR o_orderkey % 31 = 0
                                   OR o_orderkey % 17 = 0 OR o_orderkey % 19 = 0
                                   OR o_custkey = 0))
FROM orders
""")
def validation_summary(spark, sf):
    return validate.summary_counts(_validated_jobs(spark, sf), JOBS).unionByName(
        validate.summary_counts(_validated_hires(spark, sf), HIRES))


# --- foreign keys: lineitem against narrower dimensions --------------------
# Departments = suppliers in good standing (balance >= 0); jobs = parts of
# size 45 or less.  Hires pointing at the others are orphans.
LINEITEM_FK_SPEC = TableSpec("lineitem", (
    FieldSpec("l_suppkey", "int", required=False, references="supplier"),
    FieldSpec("l_partkey", "int", required=False, references="part"),
))

_FK_DIMS_SQL = """s AS (SELECT s_suppkey FROM supplier WHERE s_acctbal >= 0),
p AS (SELECT p_partkey FROM part WHERE p_size <= 45)"""


def _fk_checked(spark, sf):
    dims = {
        "supplier": table(spark, sf, "supplier").where(F.col("s_acctbal") >= 0)
        .select(F.col("s_suppkey").alias("id")),
        "part": table(spark, sf, "part").where(F.col("p_size") <= 45)
        .select(F.col("p_partkey").alias("id")),
    }
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey")
    return foreign_keys.check_foreign_keys(rows, LINEITEM_FK_SPEC, dims)


_NE = FK_MESSAGE_SUFFIX


@register("fk_check_errors", f"""
WITH {_FK_DIMS_SQL}
SELECT l_orderkey, l_linenumber, 'l_suppkey' AS campo, 'fk_missing' AS regla,
       CAST(l_suppkey AS VARCHAR) AS valor, 'l_suppkey ' || l_suppkey || ' {_NE}' AS detalle
FROM lineitem WHERE l_suppkey IS NOT NULL AND NOT EXISTS (SELECT 1 FROM s WHERE s_suppkey = l_suppkey)
UNION ALL
SELECT l_orderkey, l_linenumber, 'l_partkey', 'fk_missing', CAST(l_partkey AS VARCHAR),
       'l_partkey ' || l_partkey || ' {_NE}'
FROM lineitem WHERE l_partkey IS NOT NULL AND NOT EXISTS (SELECT 1 FROM p WHERE p_partkey = l_partkey)
""")
def fk_check_errors(spark, sf):
    return (_fk_checked(spark, sf).select("l_orderkey", "l_linenumber", F.explode("fk_errs").alias("e"))
            .select("l_orderkey", "l_linenumber", "e.campo", "e.regla", "e.valor",
                    foreign_keys.fk_detail(F.col("e.campo"), F.col("e.valor")).alias("detalle")))


@register("fk_check_valid", f"""
WITH {_FK_DIMS_SQL}
SELECT l_orderkey, l_linenumber, l_suppkey, l_partkey FROM lineitem
WHERE (l_suppkey IS NULL OR EXISTS (SELECT 1 FROM s WHERE s_suppkey = l_suppkey))
  AND (l_partkey IS NULL OR EXISTS (SELECT 1 FROM p WHERE p_partkey = l_partkey))
""")
def fk_check_valid(spark, sf):
    return (_fk_checked(spark, sf).where(F.size("fk_errs") == 0)
            .select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey"))


@register("distinct_fk", """
SELECT DISTINCT 'l_suppkey' AS campo, l_suppkey AS valor FROM lineitem WHERE l_suppkey IS NOT NULL
UNION ALL
SELECT DISTINCT 'l_partkey', l_partkey FROM lineitem WHERE l_partkey IS NOT NULL
""")
def distinct_fk(spark, sf):
    return foreign_keys.distinct_foreign_keys(table(spark, sf, "lineitem"), ["l_suppkey", "l_partkey"])


@register("duplicate_keys", """
SELECT l_orderkey, l_linenumber, COUNT(*) AS n FROM lineitem
GROUP BY l_orderkey, l_linenumber HAVING COUNT(*) > 1
""")
def duplicate_keys(spark, sf):
    return keys.duplicate_keys(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


@register("dedupe_last", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber DESC,
                               l_partkey DESC, l_suppkey DESC) AS rn
  FROM lineitem) WHERE rn = 1
""")
def dedupe_last(spark, sf):
    """Duplicate policy "last": one row per order, the greatest line
    number (ties by part then supplier) standing in for payload position."""
    li = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        F.struct("l_linenumber", "l_partkey", "l_suppkey").alias("_pos"))
    return keys.keep_last(li, "l_orderkey", "_pos").drop("_pos")


@register("table_counts", """
SELECT 'supplier' AS tabla, COUNT(*) AS registros FROM supplier
UNION ALL SELECT 'part', COUNT(*) FROM part
UNION ALL SELECT 'lineitem', COUNT(*) FROM lineitem
UNION ALL SELECT 'orders', COUNT(*) FROM orders
UNION ALL SELECT 'customer', COUNT(*) FROM customer
""")
def table_counts(spark, sf):
    names = ["supplier", "part", "lineitem", "orders", "customer"]
    return counts.table_counts({n: table(spark, sf, n) for n in names})


@register("referential_guard", """
SELECT s_suppkey, s_name FROM supplier
WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_suppkey = s_suppkey)
""")
def referential_guard(spark, sf):
    """V6: suppliers a hire still points to; deleting any of them would
    break the fact's foreign key."""
    return foreign_keys.referenced_rows(table(spark, sf, "lineitem"), "l_suppkey",
                                        table(spark, sf, "supplier"), "s_suppkey") \
        .select("s_suppkey", "s_name")
