import csv
import datetime as dt
import io
import json
import os
import random

import pytest

from hirelake.sources.csv_files import ends_inside, read_dimension_csv, read_hires_csv, read_records
from hirelake.sources.payloads import payload_records, read_payloads
from hirelake.spec import DEPARTMENTS, HIRES, table_spec


def write(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)


def test_dimension_csv_rules(spark, tmp):
    write(f"{tmp}/d/departments.csv",
          '1,Supply Chain\n2, \n3,"Legal, Tax"\n\n x4 ,Bad\n5\n6,Ok,extra\n7,Ok,\n 8 ,  Sales  ')
    load = read_dimension_csv(spark, f"{tmp}/d", table_spec(DEPARTMENTS))
    rows = {r.id: r.departamento for r in load.rows.collect()}
    # blank name dropped; quoted comma kept; long row cut; long row with a
    # blank extra field dropped; names not trimmed, ids are.
    assert rows == {1: "Supply Chain", 3: "Legal, Tax", 6: "Ok", 8: "  Sales  "}
    errs = {(r.campo, r.regla) for r in load.errors.collect()}
    assert ("id", "int_parsing") in errs and ("__root__", "short_row") in errs


def test_hires_csv_rules(spark, tmp):
    write(f"{tmp}/h/hired_employees.csv",
          "id,name,datetime,department_id,job_id\n"
          "1, Ana ,2021-07-27T16:02:08Z,1,2\n"
          "2,Bob,2021-07-27T16:02:08.000Z,1,\n"
          "3,  ,2021-7-2 1:2:3,,\n"
          "4,Eve,2021-02-30 10:00:00,x,1\n"
          ",NoId,2021-01-01 00:00:00,1,1\n"
          "6,Short,2021-01-01 00:00:00\n"
          "7,Long,2021-01-01 00:00:00,1,2,9\n"
          "abc,BadId,,,\n")
    load = read_hires_csv(spark, f"{tmp}/h", table_spec(HIRES))
    rows = {r.id: r for r in load.rows.collect()}
    assert set(rows) == {1, 2, 3, 7}
    assert rows[1].nombre == "Ana" and rows[1].fecha_hora is None          # Z without fraction
    assert rows[2].fecha_hora == dt.datetime(2021, 7, 27, 16, 2, 8) and rows[2].id_trabajo is None
    assert rows[3].nombre is None and rows[3].fecha_hora == dt.datetime(2021, 7, 2, 1, 2, 3)
    assert rows[7].id_trabajo == 2
    regl = sorted((r.campo, r.regla) for r in load.errors.collect())
    assert regl == [("__root__", "short_row"), ("id", "int_parsing"), ("id_departamento", "int_parsing")]


def _payloads(spark, tmp, docs):
    for i, d in enumerate(docs):
        write(f"{tmp}/p/{i:03d}.json", d if isinstance(d, str) else json.dumps(d))
    return payload_records(read_payloads(spark, f"{tmp}/p"))


def test_payload_forms_and_rejections(spark, tmp):
    docs = [
        {"departamentos": [{"id": 16, "departamento": "X"}], "trabajos": [{"id": 999, "trabajo": "Y"}],
         "empleados_contratados": [{"id": 501, "fecha_hora": "2020-01-01T00:00:00",
                                    "id_departamento": 16, "id_trabajo": 999}], "otro": [1]},
        {"tabla": "trabajos", "registros": [{"id": 1, "trabajo": "a"}, {"id": 2, "trabajo": "b"}]},
        {"tabla": "trabajos", "registros": {"id": 1}},                 # not a list
        {"tabla": "nope", "registros": [{"id": 1}]},                   # unknown table
        {"departamentos": []},                                         # 0 rows
        {"departamentos": [{"id": i, "departamento": "d"} for i in range(1, 1002)]},  # 1001 rows
        {"otro": [1]},                                                 # no known group
    ]
    p = _payloads(spark, tmp, docs)
    recs = sorted((os.path.basename(r.payload), r.tabla, r.indice) for r in p.records.collect())
    assert recs == [("000.json", "departamentos", 0), ("000.json", "empleados_contratados", 0),
                    ("000.json", "trabajos", 0), ("001.json", "trabajos", 0), ("001.json", "trabajos", 1)]
    rejected = {os.path.basename(r.payload) for r in p.rejected.collect()}
    assert rejected == {"002.json", "003.json", "004.json", "005.json", "006.json"}


def test_quoted_line_breaks_and_commas(spark, tmp):
    write(f"{tmp}/d/departments.csv", '1,"Ana\nMaria"\n2,"Legal, , Tax",x\n3,"a ""b"", c"\n4,ok, \n')
    rows = {r.id: r.departamento for r in read_dimension_csv(spark, f"{tmp}/d", table_spec(DEPARTMENTS)).rows.collect()}
    assert rows == {1: "Ana\nMaria", 2: "Legal, , Tax", 3: 'a "b", c'}
    write(f"{tmp}/h/hires.csv", 'id,name,datetime,department_id,job_id\n1,"Ana\nMaria",2021-01-01 00:00:00,1,2\n2,x,,a,b\n')
    load = read_hires_csv(spark, f"{tmp}/h", table_spec(HIRES))
    assert [(r.id, r.nombre) for r in load.rows.collect()] == [(1, "Ana\nMaria")]
    # both bad fields are reported, with the row
    assert sorted((r.campo, r.valor) for r in load.errors.collect()) == [
        ("id_departamento", "2,x,,a,b"), ("id_trabajo", "2,x,,a,b")]


@pytest.fixture
def split_bytes(spark):
    """Sets the size of a split; restored afterwards."""
    name = "spark.sql.files.maxPartitionBytes"
    old = spark.conf.get(name)
    yield lambda n: spark.conf.set(name, str(n))
    spark.conf.set(name, old)


def random_csv(rng, records):
    """Well-formed and odd quoting: line breaks, quotes, commas and stray quotes."""
    def field():
        kind = rng.random()
        text = "".join(rng.choice(["a", "é", " ", ",", '"', "\n", "\r\n", "bc"]) for _ in range(rng.randint(0, 12)))
        if kind < 0.5:
            return '"' + text.replace('"', '""') + '"'
        plain = "".join(c for c in text if c not in ',\r\n').lstrip('"')
        return plain if kind < 0.9 else '"x"' + plain.replace('"', "") + ('"' if kind < 0.95 else "")
    return "\n".join(",".join(field() for _ in range(rng.randint(1, 5))) for _ in range(records))


def single_pass(path, header):
    """The historical loader's parser.  A line break that ends a file within a quoted
    field is left out."""
    with open(path, encoding="utf-8") as f:
        text = f.read()
    rows, inside = list(csv.reader(io.StringIO(text))), False
    for line in text.split("\n"):
        inside = ends_inside(line, inside)
    if inside and text.endswith("\n"):
        rows[-1][-1] = rows[-1][-1].removesuffix("\n")
    return rows[1:] if header else rows


@pytest.mark.parametrize("seed,size,header", [(1, 37, False), (2, 300, True), (3, 5000, True)])
def test_parallel_records_equal_a_single_pass(spark, tmp, split_bytes, seed, size, header):
    rng = random.Random(seed)
    paths = []
    for i, n in enumerate((60, 0, 1, 90)):
        paths.append(f"{tmp}/r/f{i}.csv")
        write(paths[-1], random_csv(rng, n) + ("\n" if i else ""))
    # One record over many splits; the last file ends within a quoted field.
    write(f"{tmp}/r/f8.csv", '"head\n' + "er" * 200 + '",b\n1,"' + "x,\n" * 500 + '"\nlast,2\n')
    write(f"{tmp}/r/f9.csv", 'h\na,"open\n\nend')
    paths += [f"{tmp}/r/f8.csv", f"{tmp}/r/f9.csv"]
    split_bytes(size)
    want = [row for p in paths for row in single_pass(p, header)]
    got = {r.indice: r.fields for r in read_records(spark, f"{tmp}/r", header).collect()}
    assert [got[i] for i in range(len(got))] == want


def test_one_large_file_is_many_tasks(spark, tmp, split_bytes):
    rng = random.Random(9)
    rows = [f'{i},"name {i}\n""{"q" * rng.randint(0, 90)}"", z"' for i in range(30_000)]
    write(f"{tmp}/big/departments.csv", "\n".join(rows))
    split_bytes(200_000)
    load = read_dimension_csv(spark, f"{tmp}/big", table_spec(DEPARTMENTS))
    lines = spark.read.text(f"{tmp}/big")
    assert lines.rdd.getNumPartitions() >= 8
    rows = load.numbered.collect()
    assert sorted(r.indice for r in rows) == list(range(30_000)) and all(r.id == r.indice for r in rows)
    assert all(r.departamento.startswith(f'name {r.id}\n"q') or r.departamento == f'name {r.id}\n"", z' for r in rows)


def test_a_hundred_thousand_quotes(spark, tmp):
    quotes = '"' * 100_000
    write(f"{tmp}/d/departments.csv", f'1,"{quotes * 2}"\n2,"{quotes * 2}",x\nz,"{quotes * 2}"\n4,ok\n')
    load = read_dimension_csv(spark, f"{tmp}/d", table_spec(DEPARTMENTS))
    assert {r.id: r.departamento for r in load.rows.collect()} == {1: quotes, 2: quotes, 4: "ok"}
    assert [(r.indice, r.regla) for r in load.errors.collect()] == [(2, "int_parsing")]


def test_positions_of_bad_rows(spark, tmp):
    write(f"{tmp}/h/a.csv", 'id,name,datetime,department_id,job_id\n1,"A\nB",,1,2\n2,x,,a,1\n\n3,short\n')
    write(f"{tmp}/h/b.csv", "id,name,datetime,department_id,job_id\n4,y,,1,1\n5,z,,1,b\n")
    load = read_hires_csv(spark, f"{tmp}/h", table_spec(HIRES))
    assert sorted((r.indice, r.campo) for r in load.errors.collect()) == [
        (1, "id_departamento"), (3, "__root__"), (5, "id_trabajo")]
    assert sorted((r.indice, r.id) for r in load.numbered.collect()) == [(0, 1), (4, 4)]


def test_no_files_and_empty_files(spark, tmp):
    write(f"{tmp}/e/departments.csv", "")
    load = read_dimension_csv(spark, f"{tmp}/e", table_spec(DEPARTMENTS))
    assert load.rows.collect() == [] and load.errors.collect() == []


@pytest.mark.parametrize("line,outside,inside", [
    ("a,b", False, True), ('"a', True, False), ('a"b,c', False, False), ('a,"b', True, False), ('"a"",b', True, False),
    ('"a""",b', False, False), ('x",y', False, False), ("", False, True), ('""', False, True), ('"a"b"c,"', True, True)])
def test_open_quotes_of_a_line(line, outside, inside):
    assert (ends_inside(line, False), ends_inside(line, True)) == (outside, inside)
    for before, start in (("", False), ('"', True)):
        rows = list(csv.reader([before + line + "\n", "sentinel\n"]))
        assert ends_inside(line, start) == (rows[-1] != ["sentinel"])
