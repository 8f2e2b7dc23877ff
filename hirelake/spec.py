"""Table specifications: schema, key, field rules and star bindings.

The three hiring tables are declared once here; the schema, the
validation rules, the backup schema and the upsert key all derive from
these declarations.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Fixed values that must match the reference's behaviour.
# ---------------------------------------------------------------------------
# Label for a missing department or job in the outer-join quarterly report.
UNASSIGNED = "Sin asignar"
# Message of a foreign-key error: "<column> <value> no existe".
FK_MESSAGE_SUFFIX = "no existe"
# Backup name: <table>_<YYYYmmdd>_<HHMMSS>.<format>
BACKUP_STAMP = "%Y%m%d_%H%M%S"
BACKUP_DAY = "%Y%m%d"
BACKUP_NAME = r"_(\d{8})_\d{6}\.(avro|parquet)$"
BACKUP_FORMATS = ("avro", "parquet")
# Batch intake: records per group, inclusive bounds.
GROUP_MIN_ROWS = 1
GROUP_MAX_ROWS = 1000
# Rate limit defaults: window in seconds and accepted requests per window.
RATE_WINDOW_SECONDS = 60
RATE_MAX_REQUESTS = 100
# Table names in the order a multi-group payload is processed.
DEPARTMENTS = "departamentos"
JOBS = "trabajos"
HIRES = "empleados_contratados"
TABLE_ORDER = (DEPARTMENTS, JOBS, HIRES)


@dataclass(frozen=True)
class FieldSpec:
    """One column: its type and the rules a record must meet."""

    name: str
    kind: str                      # "int" | "str" | "datetime"
    required: bool = True          # missing / null is an error
    positive: bool = False         # int must be > 0 when present
    min_len: int | None = None     # in characters (code points)
    max_len: int | None = None
    references: str | None = None  # table whose key this column points to

    @property
    def spark_type(self) -> T.DataType:
        return {"int": T.IntegerType(), "str": T.StringType(),
                "datetime": T.TimestampNTZType()}[self.kind]


@dataclass(frozen=True)
class TableSpec:
    name: str
    fields: tuple[FieldSpec, ...]
    key: str = "id"

    @property
    def schema(self) -> T.StructType:
        return T.StructType([T.StructField(f.name, f.spark_type, not f.required)
                             for f in self.fields])

    @property
    def backup_schema(self) -> T.StructType:
        """Backups keep timestamps as ISO-8601 text; FKs stay nullable."""
        return T.StructType([
            T.StructField(f.name, T.StringType() if f.kind == "datetime" else f.spark_type,
                          not f.required)
            for f in self.fields])

    @property
    def columns(self) -> list[str]:
        return [f.name for f in self.fields]

    @property
    def foreign_keys(self) -> list[FieldSpec]:
        return [f for f in self.fields if f.references]

    def field(self, name: str) -> FieldSpec:
        for f in self.fields:
            if f.name == name:
                return f
        raise KeyError(name)


SPECS: dict[str, TableSpec] = {
    DEPARTMENTS: TableSpec(DEPARTMENTS, (
        FieldSpec("id", "int", positive=True),
        FieldSpec("departamento", "str", min_len=1, max_len=50),
    )),
    JOBS: TableSpec(JOBS, (
        FieldSpec("id", "int", positive=True),
        FieldSpec("trabajo", "str", min_len=1, max_len=200),
    )),
    HIRES: TableSpec(HIRES, (
        FieldSpec("id", "int", positive=True),
        FieldSpec("nombre", "str", required=False, max_len=100),
        FieldSpec("fecha_hora", "datetime", required=False),
        FieldSpec("id_departamento", "int", required=False, positive=True,
                  references=DEPARTMENTS),
        FieldSpec("id_trabajo", "int", required=False, positive=True, references=JOBS),
    )),
}


def table_spec(name: str) -> TableSpec:
    """Whitelist lookup: raises before any job starts."""
    try:
        return SPECS[name]
    except KeyError:
        raise ValueError(f"unsupported table: {name!r}; expected one of {list(SPECS)}") from None


@dataclass(frozen=True)
class Star:
    """Column names of a fact with a timestamp and two dimensions."""

    fact_id: str
    fact_ts: str
    fact_dep: str
    fact_job: str
    dep_key: str
    dep_name: str
    job_key: str
    job_name: str


HIRING = Star(fact_id="id", fact_ts="fecha_hora", fact_dep="id_departamento",
              fact_job="id_trabajo", dep_key="id", dep_name="departamento",
              job_key="id", job_name="trabajo")
