"""CSV intake.

Two files, two rules, as the historical loader has them:

* dimension files (departments, jobs): no header, comma separated, a row
  is kept only when every field is non-blank; values are not trimmed
  (the id is, as the integer column would).
* the hires file: the first line is always a header; every field is
  trimmed and blank becomes NULL; a row needs an id; a bad date becomes
  NULL but keeps the row, while a bad integer or a short row drops it.

Dropped rows are not lost: they come back as error rows (``etapa`` =
"csv") next to the loaded rows, with their position in the load.

Quoted fields may hold commas, quotes and line breaks, and a file is still read
by many tasks.  Whether a split begins inside a quoted field depends on all
text before it, so files are read in two passes over the same splits:

1. every split tells, for both ways it could begin (outside or inside a
   quoted field), how it ends and how many records begin in it;
2. the driver composes these small functions in file order (one row per
   split, as many as the scan itself lists), which gives the true beginning
   of each split and the number of its first record;
3. every split is parsed from its first record on.  A record that runs over
   the end of a split comes out as pieces, which are joined by number.

Lines end with ``\\n``, ``\\r\\n`` or ``\\r``; inside a quoted field they are read
as ``\\n``, and one that ends the file within such a field is not part of it.  Quotes count as in Python's ``csv`` module, the loader's parser: one
inside an unquoted field is a character like any other.
"""

from __future__ import annotations

import csv
import re
from collections.abc import Iterator
from dataclasses import dataclass
from typing import NamedTuple

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hirelake.functions.scalar import blank_to_null, csv_int, csv_timestamp, is_blank
from hirelake.operators.validate import ERROR_COLUMNS
from hirelake.session import materialize
from hirelake.spec import TableSpec

#: Records a batch, and characters a batch, at most.
BATCH_ROWS, BATCH_CHARS = 8192, 1 << 22
_RECORDS = "indice bigint, fields array<string>"
#: What a quoted field holds, up to its closing quote.
_QUOTED = re.compile(r'[^"]*+(?:""[^"]*+)*+')


@dataclass
class CsvLoad:
    numbered: DataFrame  # indice, and typed rows in the spec's columns
    errors: DataFrame    # tabla, indice, etapa, campo, regla, valor

    @property
    def rows(self) -> DataFrame:
        return self.numbered.drop("indice")


def ends_inside(line: str, inside: bool) -> bool:
    """Whether a quoted field is open behind ``line``, if one was (``inside``) or
    wasn't open before it."""
    at = 0
    while True:
        if inside or line.startswith('"', at):
            at = _QUOTED.match(line, at if inside else at + 1).end()
            if at == len(line):
                return True
            inside, at = False, line.find(",", at)
            if at < 0:
                return False
            at += 1
        else:
            at = line.find(',"', at) + 1
            if not at:
                return False


class Split(NamedTuple):
    """How a split begins: inside a quoted field or not, the number of the first
    record that begins in it, and how many have begun in its file before."""

    inside: bool
    first: int
    before: int
    open: bool  # how it ends


def _lines(spark: SparkSession, path) -> DataFrame:
    return spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"),
                                        F.col("_metadata.file_block_start").alias("start"))


def _by_split(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, pa.Array]]:
    """((file, start), lines) in order; a split may come in several parts."""
    for batch in batches:
        at = 0
        while at < batch.num_rows:
            key = (batch.column(1)[at].as_py(), batch.column(2)[at].as_py())
            rest = batch.slice(at)
            other = pc.invert(pc.and_(pc.equal(rest.column(1), key[0]), pc.equal(rest.column(2), key[1])))
            to = pc.index(other, True).as_py()
            n = rest.num_rows if to < 0 else to
            yield key, rest.column(0).slice(0, n)
            at += n


def _survey(batches: Iterator[pa.RecordBatch]):
    """Per split (and part of one): for both beginnings, how it ends and how many
    records begin in it."""
    order = 0
    for key, lines in _by_split(batches):
        quoted = [int(i) for i in pc.indices_nonzero(pc.match_substring(lines, '"'))]
        state, count, last = [False, True], [0, 0], 0
        for i in quoted:
            line = lines[i].as_py()
            for k in (0, 1):
                if not state[k]:
                    count[k] += i - last + 1
                state[k] = ends_inside(line, state[k])
            last = i + 1
        for k in (0, 1):
            if not state[k]:
                count[k] += len(lines) - last
        order += 1
        yield pa.RecordBatch.from_arrays(
            [pa.array([v], t) for v, t in ((key[0], pa.string()), (key[1], pa.int64()), (order, pa.int64()),
                                           (state[0], pa.bool_()), (state[1], pa.bool_()), (count[0], pa.int64()),
                                           (count[1], pa.int64()))],
            ["file", "start", "part", "out_open", "in_open", "out_n", "in_n"])


def _plan(parts: list, header: bool) -> dict[tuple, Split]:
    """Compose the splits' functions, file by file."""
    splits: dict[tuple, Split] = {}
    file, inside, first, before = None, False, 0, 0
    for p in sorted(parts, key=lambda r: (r["file"], r["start"], r["part"])):
        if p["file"] != file:
            # A record left open by the last file ends there.
            file, inside, before = p["file"], False, 0
        n, end = (p["in_n"], p["in_open"]) if inside else (p["out_n"], p["out_open"])
        key = (p["file"], p["start"])
        known = splits.get(key)
        splits[key] = known._replace(open=end) if known else Split(inside, first, before, end)
        first += n - int(header and n > 0 and before == 0)
        before, inside = before + n, end
    return splits


def _rows(lines: Iterator[str]) -> Iterator[list[str]]:
    csv.field_size_limit(2**31 - 1)
    return csv.reader(lines)


def _parse(splits: dict[tuple, Split], header: bool):
    """Records of each split: (indice, fields), or pieces of records that run over
    its ends: (indice, start, raw)."""

    def run(batches: Iterator[pa.RecordBatch]):
        parts = _by_split(batches)
        part = next(parts, None)
        while part is not None:
            key, split = part[0], splits[part[0]]
            pending: list[str] = []  # lines of the record that is being read

            def lines():
                nonlocal part
                while part is not None and part[0] == key:
                    for line in part[1].to_pylist():
                        pending.append(line)
                        yield line
                    part = next(parts, None)

            source = lines()
            number, drop = split.first, header and split.before == 0
            out, chars = ([], [], [], []), 0

            def add(indice, fields, raw=None):
                for column, v in zip(out, (indice, fields, raw, key[1]), strict=True):
                    column.append(v)

            def flush():
                return pa.RecordBatch.from_arrays(
                    [pa.array(out[0], pa.int64()), pa.array(out[1], pa.list_(pa.string())), pa.array(out[2], pa.string()),
                     pa.array(out[3], pa.int64())], ["indice", "fields", "raw", "start"])

            if split.inside:
                for line in source:
                    if not ends_inside(line, True):
                        break
                if not header or split.before > 1:
                    add(number - 1, None, "\n".join(pending))
                pending.clear()
            for fields in _rows(line + "\n" for line in source):
                if part is None or part[0] != key:
                    break  # the lines ended within this record: it goes on in the next split
                chars += sum(map(len, fields))
                if drop:
                    drop = False
                else:
                    add(number, fields)
                    number += 1
                pending.clear()
                if len(out[0]) >= BATCH_ROWS or chars >= BATCH_CHARS:
                    yield flush()
                    out, chars = ([], [], [], []), 0
            if pending and not drop:
                add(number, None, "\n".join(pending))
            if out[0]:
                yield flush()

    return run


def _join_pieces(batches: Iterator[pa.RecordBatch]):
    for batch in batches:
        fields = [next(_rows(iter(re.findall(r"[^\n]*\n|[^\n]+", raw))), []) for raw in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fields, pa.list_(pa.string()))], ["indice", "fields"])


def read_records(spark: SparkSession, path, header: bool = False) -> DataFrame:
    """``(indice, fields)`` of all records of the CSV files under ``path``: the position
    in the load (files by name, headers not counted) and the fields as text.

    A line without any character is a record without fields."""
    lines = _lines(spark, path)
    splits = _plan(lines.mapInArrow(
        _survey, "file string, start bigint, part bigint, out_open boolean, in_open boolean, out_n bigint, in_n bigint").collect(),
        header)
    parsed = lines.mapInArrow(_parse(splits, header), f"{_RECORDS}, raw string, start bigint")
    if not any(s.open for s in splits.values()):
        return parsed.select("indice", "fields")
    # Read twice below, so parsed once.
    parsed = materialize(parsed, "csv-records")
    whole = parsed.where("raw is null").select("indice", "fields")
    texts = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("start", "raw"))), lambda x: x["raw"]), "\n")
    joined = (parsed.where("raw is not null").groupBy("indice").agg(texts.alias("raw")).mapInArrow(_join_pieces, _RECORDS))
    return whole.unionAll(joined)


def _raw(spark: SparkSession, path, spec: TableSpec, header: bool) -> DataFrame:
    """The first fields as text columns; ``_n`` fields in all, and the row as
    read (``_line``), for error reports.  Empty lines are left out."""
    records = read_records(spark, path, header).where(F.size("fields") > 0)
    return records.select("indice", "fields", F.size("fields").alias("_n"), F.array_join("fields", ",").alias("_line"),
                          *[F.get("fields", F.lit(i)).alias(c) for i, c in enumerate(spec.columns)])


def _errors(df: DataFrame, spec: TableSpec, campo, regla, valor) -> DataFrame:
    as_col = lambda v: v if not isinstance(v, str) else F.lit(v)
    return df.select(F.lit(spec.name).alias("tabla"), "indice",
                     F.lit("csv").alias("etapa"), as_col(campo).alias("campo"),
                     as_col(regla).alias("regla"), valor.cast("string").alias("valor"))


def read_dimension_csv(spark: SparkSession, path, spec: TableSpec) -> CsvLoad:
    """S1 + F3 + P3 for a two-column dimension file."""
    key, name = spec.columns[0], spec.columns[1]
    raw = _raw(spark, path, spec, header=False)
    short = F.col("_n") < len(spec.columns)
    # Every field must be non-blank, a long row's extra fields included.
    blank = F.exists("fields", is_blank)
    typed = raw.withColumn("_id", csv_int(key))
    keep = ~short & ~blank
    rows = (typed.where(keep & F.col("_id").isNotNull())
            .select("indice", F.col("_id").alias(key), F.col(name)))
    # One pass for both kinds of bad row.
    wrong = (F.when(short & ~is_blank(key), "short_row").when(keep & F.col("_id").isNull(), "int_parsing"))
    errs = _errors(typed.withColumn("_rule", wrong).where(F.col("_rule").isNotNull()), spec,
                   F.when(F.col("_rule") == "short_row", "__root__").otherwise(key), F.col("_rule"), F.col("_line"))
    return CsvLoad(rows, errs.select(*ERROR_COLUMNS))


def read_hires_csv(spark: SparkSession, path, spec: TableSpec) -> CsvLoad:
    """S2 + F4 + P3/P4/P11 for the hires file (five columns, header line)."""
    cols = spec.columns
    raw = _raw(spark, path, spec, header=True).withColumn("_short", F.col("_n") < len(cols))
    trimmed = raw.withColumns({c: blank_to_null(c) for c in cols})
    present = trimmed.where(F.col(cols[0]).isNotNull())
    ints = [f.name for f in spec.fields if f.kind == "int"]
    parsed = present.withColumns({f"_i_{c}": csv_int(c) for c in ints})
    broken = {c: F.col(c).isNotNull() & F.col(f"_i_{c}").isNull() for c in ints}
    short = F.col("_short")
    bad_ints = F.array_compact(F.array(*[F.when(b, F.lit(c)) for c, b in broken.items()]))
    out = {}
    for f in spec.fields:
        if f.kind == "int":
            out[f.name] = F.col(f"_i_{f.name}")
        elif f.kind == "datetime":
            out[f.name] = csv_timestamp(f.name)
        else:
            out[f.name] = F.col(f.name)
    rows = parsed.where(~short & (F.size(bad_ints) == 0)).select("indice", *[out[c].alias(c) for c in cols])
    # One error per bad field; a short row is one error.
    fields = F.when(short, F.array(F.lit("__root__"))).otherwise(bad_ints)
    errs = parsed.select("indice", "_line", "_short", F.explode(fields).alias("_campo"))
    errs = _errors(errs, spec, F.col("_campo"), F.when(short, F.lit("short_row")).otherwise(F.lit("int_parsing")),
                   F.col("_line"))
    return CsvLoad(rows, errs)


def write_csv(df: DataFrame, path: str, header: bool) -> None:
    """Write rows as CSV in the intake's format (used to round-trip tables)."""
    (df.write.mode("errorifexists").option("header", header)
     .option("quote", '"').option("escape", '"').option("nullValue", "")
     .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
     .option("emptyValue", "").csv(path))
