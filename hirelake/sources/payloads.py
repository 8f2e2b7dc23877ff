"""JSON batch payloads.

A payload is one JSON document, either a single group
``{"tabla": t, "registros": [...]}`` or several groups keyed by table
name.  Records arrive as raw JSON text (``array<string>`` keeps each
element verbatim), so validation can tell a number from a string and an
object from anything else.  Unknown keys are ignored by the schema.

``payload_records`` turns any number of payload files into one long
DataFrame (payload, orden, tabla, indice, raw) with ``posexplode``; ``orden`` is
the payload's place in the order of arrival (file time, path, place in
the file).  Payload-level
problems (a group that is not a list, a group outside 1..1000 records, no
known group) reject the whole payload, as the service does before writing
anything.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hirelake.spec import GROUP_MAX_ROWS, GROUP_MIN_ROWS, TABLE_ORDER

CORRUPT = "_corrupt"
PAYLOAD_SCHEMA = ("tabla string, registros array<string>, "
                  + ", ".join(f"{t} array<string>" for t in TABLE_ORDER)
                  + f", {CORRUPT} string")


@dataclass
class Payloads:
    records: DataFrame   # payload, orden, tabla, indice, raw  (accepted payloads only)
    rejected: DataFrame  # payload, motivo


GROUPS = ["tabla", "registros", *TABLE_ORDER, CORRUPT]


def with_source(df: DataFrame) -> DataFrame:
    """Add what tells the order of arrival of file payloads."""
    return df.withColumns({"_time": F.col("_metadata.file_modification_time"), "_path": F.col("_metadata.file_path"),
                           "_block": F.col("_metadata.file_block_start")})


def with_order(df: DataFrame, multi_line: bool) -> DataFrame:
    """Add ``payload`` (the document's name: its file, plus a content hash for
    JSON Lines) and ``orden`` to payloads with their source."""
    name = F.col("_path") if multi_line else F.concat_ws("#", "_path", F.xxhash64(*GROUPS).cast("string"))
    # Rows of one split keep the file's order, and splits of a file that of their offsets.
    order = F.struct(F.col("_time").alias("t"), F.col("_path").alias("f"), F.col("_block").alias("b"),
                     F.monotonically_increasing_id().alias("i"))
    return df.withColumns({"payload": name, "orden": order}).drop("_time", "_path", "_block")


def read_payloads(spark: SparkSession, path, multi_line: bool = True) -> DataFrame:
    """One row per payload: one document per file (``multi_line``), or one
    document per line (JSON Lines, the scalable layout for many payloads)."""
    df = (spark.read.schema(PAYLOAD_SCHEMA).option("multiLine", multi_line)
          .option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT)
          .json(path))
    return with_order(with_source(df), multi_line)


def _groups(df: DataFrame) -> Column:
    """array<struct<tabla, registros>> of the groups a payload carries, in
    the processing order (single-group form wins, as in the service)."""
    single = F.col("tabla").isNotNull() & (F.col("registros").isNotNull()
                                          | F.col(CORRUPT).isNotNull())
    multi = F.array_compact(F.array(*[
        F.when(F.col(t).isNotNull(), F.struct(F.lit(t).alias("tabla"), F.col(t).alias("registros")))
        for t in TABLE_ORDER]))
    one = F.array(F.struct(F.col("tabla"), F.col("registros")))
    return F.when(single, one).otherwise(multi)


def payload_records(payloads: DataFrame, max_rows: int | None = GROUP_MAX_ROWS) -> Payloads:
    """Explode payloads into records, rejecting malformed payloads whole."""
    g = payloads.withColumn("_groups", _groups(payloads))
    sizes = F.transform("_groups", lambda x: F.size(x["registros"]))
    reason = (F.when(F.col(CORRUPT).isNotNull() & (F.col("tabla").isNull()
                                                   | F.col("registros").isNull()),
                     F.lit("group is not a list or document is not valid JSON"))
              .when(F.size("_groups") == 0, F.lit("no known table group"))
              .when(F.exists("_groups", lambda x: ~x["tabla"].isin(*TABLE_ORDER)),
                    F.lit("unknown table"))
              .when(F.exists(sizes, lambda n: n < GROUP_MIN_ROWS), F.lit("group too small")))
    if max_rows is not None:
        reason = reason.when(F.exists(sizes, lambda n: n > max_rows), F.lit("group too large"))
    checked = g.withColumn("_motivo", reason)
    rejected = checked.where(F.col("_motivo").isNotNull()).select("payload", F.col("_motivo").alias("motivo"))
    records = (checked.where(F.col("_motivo").isNull())
               .select("payload", "orden", F.explode("_groups").alias("g"))
               .select("payload", "orden", F.col("g.tabla").alias("tabla"),
                       F.posexplode("g.registros").alias("indice", "raw"))
               .withColumn("indice", F.col("indice").cast("bigint")))
    return Payloads(records, rejected)
