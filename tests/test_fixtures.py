"""The documented sample payloads and CSV edge rows (FIXTURES.md §3, §6)."""

import json
import os

from hirelake.plans import jobs
from hirelake.sinks.table_store import TableStore
from hirelake.sources.csv_files import read_hires_csv
from hirelake.sources.payloads import read_payloads
from hirelake.spec import HIRES, SPECS


def ingest(spark, tmp, doc):
    os.makedirs(f"{tmp}/p")
    with open(f"{tmp}/p/payload.json", "w") as f:
        json.dump(doc, f)
    store = TableStore(spark, f"{tmp}/t", default_buckets=2)
    res = jobs.ingest_payloads(store, read_payloads(spark, f"{tmp}/p"))
    return store, {r.tabla: (r.recibidos, r.validos, r.upsert) for r in res.summary.collect()}


def test_one_record_of_each_table(spark, tmp):
    doc = {"empleados_contratados": [{"id": 77, "nombre": "Iria", "fecha_hora": "2023-05-06T07:08:09.5",
                                      "id_departamento": 4, "id_trabajo": 31}],
           "trabajos": [{"id": 31, "trabajo": "Welder"}], "departamentos": [{"id": 4, "departamento": "Yard"}]}
    _, summary = ingest(spark, tmp, doc)
    assert summary == {"departamentos": (1, 1, 1), "trabajos": (1, 1, 1),
                       "empleados_contratados": (1, 1, 1)}


def test_foreign_keys_may_be_absent_or_null(spark, tmp):
    """Every combination of a given, a null and an absent key."""
    forms = {"given": {"id_departamento": 3, "id_trabajo": 8}, "null": {"id_departamento": None, "id_trabajo": None}, "absent": {}}
    doc = {"departamentos": [{"id": 3, "departamento": "Docks"}], "trabajos": [{"id": 8, "trabajo": "Pilot"}],
           "empleados_contratados": []}
    want = {}
    for d in forms:
        for j in forms:
            n = 900 + len(want)
            hire = {"id": n, "nombre": f"{d}-{j}"}
            hire |= {k: v for k, v in forms[d].items() if k == "id_departamento"}
            hire |= {k: v for k, v in forms[j].items() if k == "id_trabajo"}
            doc["empleados_contratados"].append(hire)
            want[n] = (3 if d == "given" else None, 8 if j == "given" else None)
    store, summary = ingest(spark, tmp, doc)
    assert summary["empleados_contratados"] == (9, 9, 9)
    assert {r.id: (r.id_departamento, r.id_trabajo) for r in store.read(SPECS[HIRES]).collect()} == want


def test_csv_ids_follow_int_not_the_json_rules(spark, tmp):
    os.makedirs(f"{tmp}/h")
    with open(f"{tmp}/h/hired_employees.csv", "w") as f:
        f.write("id,name,datetime,department_id,job_id\n"
                "0,Zero,,,\n-1,Minus,,,\n,Blank,,,\nabc,Abc,,,\n5.0,Float,,,\n 7 ,Spaces,,,\n")
    load = read_hires_csv(spark, f"{tmp}/h", SPECS[HIRES])
    assert sorted(r.id for r in load.rows.collect()) == [-1, 0, 7]     # no positivity on CSV
    assert sorted(r.valor for r in load.errors.collect()) == ["5.0,Float,,,", "abc,Abc,,,"]
