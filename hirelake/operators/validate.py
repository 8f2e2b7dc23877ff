"""Record validation (V1, V4, V7) compiled to native Column expressions.

A record is seen as, per field, its text (``_t``) and its JSON or Spark
type name (``_k``).  Records from a JSON payload get both from one VARIANT
parse; typed DataFrames (backups, CSV after casting) get them from their
schema.  Each field spec compiles to one CASE chain giving the first
broken rule (or NULL) and to one typed value; a record's errors are the
non-NULL codes.  No Python runs per row.

Error codes follow the names pydantic reports for the same failures.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hirelake.functions.scalar import iso_string, iso_timestamp, strip_ws
from hirelake.spec import FieldSpec, TableSpec

ERROR_SCHEMA = "tabla string, indice bigint, etapa string, campo string, regla string, valor string"
ERROR_COLUMNS = ["tabla", "indice", "etapa", "campo", "regla", "valor"]
ROOT_FIELD = "__root__"

_NUMBER_KIND = r"^(TINYINT|SMALLINT|INT|BIGINT|FLOAT|DOUBLE|DECIMAL.*)$"
_NULL_KINDS = ("VOID", "NULL")


def _t(name: str) -> str:
    return f"_t_{name}"


def _k(name: str) -> str:
    return f"_k_{name}"


# --------------------------------------------------------------------------
# Field access: (text, kind) per field
# --------------------------------------------------------------------------
def access_json(df: DataFrame, raw: str, spec: TableSpec) -> DataFrame:
    """Parse the JSON text in ``raw`` once as VARIANT and expose, per field
    of ``spec``, its text and JSON type; ``_obj`` tells whether the record
    is a JSON object at all."""
    # The parse is its own column: every field below reads it, so Catalyst
    # keeps one projection for it instead of re-parsing per field.
    df = df.withColumn("_v", F.try_parse_json(F.col(raw)))
    v = F.col("_v")
    cols = {"_obj": F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))}
    for f in spec.fields:
        path = f"$.{f.name}"
        cols[_t(f.name)] = F.try_variant_get(v, path, "string")
        cols[_k(f.name)] = F.schema_of_variant(F.try_variant_get(v, path, "variant"))
    return df.withColumns(cols)


def _kind_of(dt: T.DataType) -> str:
    if isinstance(dt, (T.StringType, T.VarcharType, T.CharType)):
        return "STRING"
    return dt.simpleString().upper()


def access_typed(df: DataFrame, spec: TableSpec) -> DataFrame:
    """Expose typed columns of ``df`` (named as in ``spec``) as text + kind.
    Timestamps become ISO text so they follow the same parse rule."""
    types = {f.name: f.dataType for f in df.schema.fields}
    cols = {"_obj": F.lit(True)}
    for f in spec.fields:
        if f.name not in types:
            cols[_t(f.name)] = F.lit(None).cast("string")
            cols[_k(f.name)] = F.lit(None).cast("string")
            continue
        dt = types[f.name]
        c = F.col(f.name)
        if isinstance(dt, (T.TimestampType, T.TimestampNTZType, T.DateType)):
            cols[_t(f.name)] = iso_string(c.cast("timestamp_ntz"))
            kind = "STRING"
        else:
            cols[_t(f.name)] = c.cast("string")
            kind = _kind_of(dt)
        cols[_k(f.name)] = F.when(c.isNotNull(), F.lit(kind))
    return df.withColumns(cols)


# --------------------------------------------------------------------------
# Rule compilation
# --------------------------------------------------------------------------
def _absent(f: FieldSpec) -> Column:
    return F.col(_t(f.name)).isNull() | F.col(_k(f.name)).isin(*_NULL_KINDS)


def _n(name: str) -> str:
    return f"_n_{name}"


def _val(name: str) -> str:
    return f"_val_{name}"


def _code(name: str) -> str:
    return f"_c_{name}"


# Text of a number without a fraction, and of one with an exponent.
_WHOLE = r"^[+-]?\d+(\.0*)?$"
_EXPONENT = r"^[+-]?(\d+\.?\d*|\.\d+)[eE][+-]?\d+$"
FRACTION = "fraction"


def _stage_numbers(f: FieldSpec) -> dict[str, Column]:
    """Stage 1: an int field's number as whole-number text, or ``FRACTION``.
    The text itself is looked at, as any numeric type would round it."""
    if f.kind != "int":
        return {}
    kind, txt = F.col(_k(f.name)), F.col(_t(f.name))
    double = txt.try_cast("double")
    number = (F.when(txt.rlike(_WHOLE), F.regexp_replace(txt, r"\.0*$", ""))
              .when(txt.rlike(_EXPONENT) & (double == F.rint(double)),
                    F.coalesce(double.try_cast("decimal(38,0)").cast("string"), txt))
              .otherwise(FRACTION))
    return {_n(f.name): F.when(kind.rlike(_NUMBER_KIND), F.coalesce(number, F.lit(FRACTION)))}


def _stage_value(f: FieldSpec) -> Column:
    """Stage 2: the typed value (NULL when absent or unreadable)."""
    txt, kind = F.col(_t(f.name)), F.col(_k(f.name))
    if f.kind == "int":
        num = F.col(_n(f.name))
        value = (F.when(kind == "STRING", strip_ws(txt).try_cast("int"))
                 .when(num != FRACTION, num.try_cast("int")))
    elif f.kind == "str":
        value = F.when(kind == "STRING", txt)
    elif f.kind == "datetime":
        value = F.when(kind == "STRING", iso_timestamp(txt))
    else:  # pragma: no cover - spec error
        raise ValueError(f.kind)
    return value.cast(f.spark_type)


def _stage_code(f: FieldSpec) -> Column:
    """Stage 3: the first broken rule of the field, or NULL."""
    txt, kind, value = F.col(_t(f.name)), F.col(_k(f.name)), F.col(_val(f.name))
    code = F.when(_absent(f), F.lit("missing") if f.required else F.lit(None).cast("string"))
    if f.kind == "int":
        num = F.col(_n(f.name))
        code = (code.when((kind != "STRING") & num.isNull() & ~kind.rlike(_NUMBER_KIND), "int_type")
                .when(num == FRACTION, "int_from_float")
                .when(value.isNull(), "int_parsing"))
        if f.positive:
            code = code.when(value <= 0, "greater_than")
    elif f.kind == "str":
        code = code.when(kind != "STRING", "string_type")
        if f.min_len is not None:
            code = code.when(F.char_length(txt) < f.min_len, "string_too_short")
        if f.max_len is not None:
            code = code.when(F.char_length(txt) > f.max_len, "string_too_long")
    else:
        code = (code.when(kind != "STRING", "datetime_type")
                .when(value.isNull(), "datetime_parsing"))
    return code


ERR_TYPE = "array<struct<campo:string,regla:string,valor:string>>"


def _err(campo: str, regla: Column, valor: Column) -> Column:
    return F.struct(F.lit(campo).alias("campo"), regla.alias("regla"),
                    valor.cast("string").alias("valor"))


def collect_errors(pairs: list[tuple[Column, Column]]) -> Column:
    """Array of the error structs whose condition holds, in field order.

    Built as ``concat`` of zero- or one-element arrays: unlike a
    higher-order ``filter`` it stays inside generated code."""
    empty = F.array().cast(ERR_TYPE)
    if not pairs:
        return empty
    return F.concat(*[F.when(cond, F.array(err)).otherwise(empty) for cond, err in pairs])


def apply_rules(accessed: DataFrame, spec: TableSpec) -> DataFrame:
    """Add the typed spec columns and ``errs`` (array of campo/regla/valor)
    to a DataFrame prepared by :func:`access_json` / :func:`access_typed`.

    The work is split in projections (numbers, values, codes, errors) so
    that each expression is written once and referenced by column; the
    generated code stays small enough to compile."""
    staged = accessed
    numbers = {k: v for f in spec.fields for k, v in _stage_numbers(f).items()}
    if numbers:
        staged = staged.withColumns(numbers)
    staged = staged.withColumns({_val(f.name): _stage_value(f) for f in spec.fields})
    staged = staged.withColumns({_code(f.name): _stage_code(f) for f in spec.fields})
    errs = [(F.col(_code(f.name)).isNotNull(),
             _err(f.name, F.col(_code(f.name)), F.col(_t(f.name)))) for f in spec.fields]
    not_object = F.array(_err(ROOT_FIELD, F.lit("not_an_object"), F.lit(None)))
    errs_col = F.when(F.col("_obj"), collect_errors(errs)).otherwise(not_object)
    out = staged.withColumns({f.name: F.col(_val(f.name)) for f in spec.fields}) \
        .withColumn("errs", errs_col)
    helper = [c for c in out.columns
              if c.startswith(("_t_", "_k_", "_n_", "_val_", "_c_")) or c in ("_obj", "_v")]
    return out.drop(*helper)


def validate_json(df: DataFrame, raw: str, spec: TableSpec) -> DataFrame:
    """V1 over raw JSON records: keeps the other columns of ``df``."""
    return apply_rules(access_json(df.drop(*spec.columns), raw, spec), spec)


def validate_typed(df: DataFrame, spec: TableSpec) -> DataFrame:
    """V1 over an already typed DataFrame (backup, CSV)."""
    return apply_rules(access_typed(df, spec), spec)


# --------------------------------------------------------------------------
# Routing (V4)
# --------------------------------------------------------------------------
def is_valid() -> Column:
    return F.size("errs") == 0


def valid_rows(validated: DataFrame, spec: TableSpec, keep: tuple[str, ...] = ()) -> DataFrame:
    """Records without errors.  Routed through a generated column (see
    :func:`error_rows`) so the rules are evaluated once."""
    cols = [*keep, *spec.columns]
    return _route(validated, cols, is_valid())


def _route(validated: DataFrame, cols: list[str], cond: Column) -> DataFrame:
    # explode of a one-element array: the NULL test sits above the Generate
    # and cannot be rewritten into the rule projections below it.
    row = F.when(cond, F.struct(*[F.col(c) for c in cols]))
    routed = validated.select(F.explode(F.array(row)).alias("_r"))
    return routed.where(F.col("_r").isNotNull()).select("_r.*")


def error_rows(validated: DataFrame, tabla: str, etapa: str, index: str = "indice") -> DataFrame:
    """One row per broken rule: tabla, indice, etapa, campo, regla, valor.

    Routing happens on the generated column: a filter on ``errs`` itself
    (written, or inferred by Catalyst from a plain ``explode``) would be
    pushed below the rule projections and evaluate every rule again."""
    return (validated
            .select(F.lit(tabla).alias("tabla"), F.col(index).cast("bigint").alias("indice"),
                    F.lit(etapa).alias("etapa"), F.explode_outer("errs").alias("e"))
            .where(F.col("e").isNotNull())
            .select("tabla", "indice", "etapa", "e.campo", "e.regla", "e.valor"))


def summary_counts(validated: DataFrame, tabla: str) -> DataFrame:
    """recibidos / validos for one table as a one-row DataFrame."""
    return validated.agg(F.lit(tabla).alias("tabla"),
                         F.count(F.lit(1)).alias("recibidos"),
                         F.count_if(is_valid()).alias("validos"))
