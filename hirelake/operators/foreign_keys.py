"""Foreign-key checks (V2, V3, J6, A7) as set-based joins.

A check asks which ids are missing, not which rows are right: the distinct values
of all FK columns (combined map-side, one narrow pass over the batch) are
matched against the keys of their dimensions by an anti join, and only the
missing ids are joined back to the rows.  The wide batch itself is not shuffled,
so a department that holds a third of the hires costs no more than another.
Missing ids are sent to all tasks only when their measured number allows;
otherwise the join back is left to Spark, with AQE splitting hot ids.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hirelake.operators.validate import _err, collect_errors
from hirelake.session import materialize
from hirelake.spec import FK_MESSAGE_SUFFIX, TableSpec

#: Most missing ids that are sent to every task (an id and a column name each).
SEND_MAX = 500_000


def missing_keys(rows: DataFrame, spec: TableSpec, dims: dict[str, DataFrame], dim_key: str = "id") -> DataFrame:
    """(campo, valor): distinct non-NULL FK values without a row in their dimension."""
    pairs = F.array(*[F.struct(F.lit(f.name).alias("campo"), F.col(f.name).cast("bigint").alias("valor"))
                      for f in spec.foreign_keys])
    used = rows.select(F.explode(pairs).alias("p")).select("p.*").where(F.col("valor").isNotNull()).distinct()
    keys = reduce(DataFrame.unionAll, [
        dims[f.references].select(F.lit(f.name).alias("campo"), F.col(dim_key).cast("bigint").alias("valor"))
        for f in spec.foreign_keys])
    return used.join(keys, ["campo", "valor"], "left_anti")


def check_foreign_keys(rows: DataFrame, spec: TableSpec, dims: dict[str, DataFrame],
                       dim_key: str = "id") -> DataFrame:
    """Add ``fk_errs`` (array of campo/regla/valor) to ``rows``, one entry
    per FK column whose non-NULL value has no row in its dimension.

    ``rows`` is read twice (its FK columns first), so a batch that is costly to
    make should be written out before."""
    missing = materialize(missing_keys(rows, spec, dims, dim_key), f"fk-missing-{spec.name}")
    send = missing.count() <= SEND_MAX
    out, errs = rows, []
    for f in spec.foreign_keys:
        gone = missing.where(F.col("campo") == f.name).select(F.col("valor").alias(f"_fk_{f.name}"))
        out = out.join(F.broadcast(gone) if send else gone, F.col(f.name).cast("bigint") == F.col(f"_fk_{f.name}"), "left")
        errs.append((F.col(f"_fk_{f.name}").isNotNull(), _err(f.name, F.lit("fk_missing"), F.col(f.name))))
    return out.withColumn("fk_errs", collect_errors(errs)).drop(*[f"_fk_{f.name}" for f in spec.foreign_keys])


def fk_detail(campo, valor):
    """Message text of an FK error, as the reference words it."""
    return F.concat_ws(" ", campo, valor, F.lit(FK_MESSAGE_SUFFIX))


def distinct_foreign_keys(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Distinct non-NULL values per FK column as (campo, valor)."""
    parts = [rows.where(F.col(c).isNotNull())
             .select(F.lit(c).alias("campo"), F.col(c).cast("bigint").alias("valor")).distinct()
             for c in columns]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def referenced_rows(fact: DataFrame, fk: str, dim: DataFrame, dim_key: str = "id") -> DataFrame:
    """V6: dimension rows some fact row still points to (semi join)."""
    used = fact.where(F.col(fk).isNotNull()).select(F.col(fk).alias("_ref")).distinct()
    return dim.join(used, dim[dim_key] == F.col("_ref"), "left_semi")
