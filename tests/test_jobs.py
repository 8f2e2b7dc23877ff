import datetime as dt
import json
import os

import pytest

from hirelake.operators.keys import DuplicateKeyError
from hirelake.plans import jobs
from hirelake.sinks.table_store import TableStore
from hirelake.sources.backups import list_backups
from hirelake.sources.payloads import read_payloads
from hirelake.spec import DEPARTMENTS, HIRES, JOBS, SPECS

DEP, JOB, HIRE = SPECS[DEPARTMENTS], SPECS[JOBS], SPECS[HIRES]


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def hires(spark, data):
    return spark.createDataFrame(data, HIRE.schema)


def test_upsert_replaces_inserts_and_is_idempotent(spark, tmp):
    store = TableStore(spark, f"{tmp}/t", default_buckets=4)
    t0 = dt.datetime(2021, 1, 1)
    store.append(HIRE, hires(spark, [(1, "a", t0, 1, 1), (2, "b", t0, 2, 2), (3, "c", t0, 3, 3)]))
    batch = hires(spark, [(2, None, None, None, None), (4, "d", t0, 4, 4)])
    assert store.upsert(HIRE, batch) == 2
    once = rows(store.read(HIRE))
    store.upsert(HIRE, batch)
    assert rows(store.read(HIRE)) == once
    assert once == [(1, "a", t0, 1, 1), (2, None, None, None, None), (3, "c", t0, 3, 3),
                    (4, "d", t0, 4, 4)]  # NULLs overwrite values


def test_duplicate_policy(spark, tmp):
    store = TableStore(spark, f"{tmp}/t", default_buckets=2)
    dup = spark.createDataFrame([(1, "x", 0), (1, "y", 1)], "id int, departamento string, pos int")
    with pytest.raises(DuplicateKeyError):
        store.upsert(DEP, dup.drop("pos"))
    assert store.upsert(DEP, dup, on_duplicate="last", order="pos") == 1
    assert rows(store.read(DEP)) == [(1, "y")]
    with pytest.raises(ValueError):
        store.append(DEP, spark.createDataFrame([(1, "z")], "id int, departamento string"))


def test_ingest_reports_each_missing_key(spark, tmp):
    doc = {"departamentos": [{"id": 7, "departamento": "Lab"}], "trabajos": [{"id": 70, "trabajo": "Chemist"}],
           "empleados_contratados": [{"id": -7}, {"id": 51, "id_departamento": 8, "id_trabajo": 80},
                                     {"id": 52, "id_departamento": 7, "id_trabajo": 80},
                                     {"id": 53, "id_departamento": 7, "id_trabajo": 70}]}
    store = TableStore(spark, f"{tmp}/t", default_buckets=2)
    res = jobs.ingest_payloads(store, read_payloads(spark, _write_docs(tmp, "p", [doc])))
    summary = {r.tabla: (r.recibidos, r.validos, r.upsert) for r in res.summary.collect()}
    assert summary == {"departamentos": (1, 1, 1), "trabajos": (1, 1, 1), "empleados_contratados": (4, 1, 1)}
    errs = sorted((r.indice, r.etapa, r.campo, r.regla) for r in res.errors.collect())
    assert errs == [(0, "modelo", "id", "greater_than"), (1, "calidad", "id_departamento", "fk_missing"),
                    (1, "calidad", "id_trabajo", "fk_missing"), (2, "calidad", "id_trabajo", "fk_missing")]
    assert rows(store.read(HIRE)) == [(53, None, None, 7, 70)]


def test_backup_wipe_restore_roundtrip(spark, tmp):
    store = TableStore(spark, f"{tmp}/t", default_buckets=2)
    t = dt.datetime(2021, 3, 4, 5, 6, 7, 890)
    store.append(DEP, spark.createDataFrame([(1, "A"), (2, "B")], DEP.schema))
    store.append(HIRE, hires(spark, [(1, "a", t, 1, None), (2, None, None, None, None)]))
    before = rows(store.read(HIRE))
    clock = dt.datetime(2024, 1, 1, 0, 0, 0)
    made = jobs.backup_tables(store, "parquet", f"{tmp}/bk", now=clock)
    assert {(r.tabla, r.registros) for r in made.collect()} == {
        ("departamentos", 2), ("trabajos", 0), ("empleados_contratados", 2)}
    with pytest.raises(jobs.GuardError):        # still referenced by a hire
        jobs.wipe_table(store, DEPARTMENTS, f"{tmp}/bk", today=clock.date())
    with pytest.raises(jobs.GuardError):        # no backup of that day
        jobs.wipe_table(store, HIRES, f"{tmp}/bk", today=dt.date(2024, 1, 2))
    wiped = jobs.wipe_table(store, HIRES, f"{tmp}/bk", today=clock.date()).first()
    assert wiped.borrados == 2 and store.read(HIRE).count() == 0
    path = [r.ruta for r in made.collect() if r.tabla == HIRES][0]
    res = jobs.restore_table(store, HIRES, path, "parquet")
    assert rows(store.read(HIRE)) == before
    assert res.summary.first().restaurados == 2
    with pytest.raises(Exception):              # same second: never overwritten
        jobs.backup_tables(store, "parquet", f"{tmp}/bk", [HIRES], now=clock)


def test_backup_catalog_names(spark, tmp):
    d = f"{tmp}/bk"
    for name in ["trabajos_20240101_000000.parquet", "trabajos_20240102_101010.parquet",
                 "trabajos_20240101_000000.csv", "trabajos_2024_1.avro", "departamentos_20240101_000000.avro"]:
        os.makedirs(f"{d}/{name}")
        with open(f"{d}/{name}/part-0", "w") as f:
            f.write("x")
    got = [(r.archivo, r.fecha, r.formato) for r in list_backups(spark, d, "trabajos").collect()]
    assert got == [("trabajos_20240102_101010.parquet", "20240102", "parquet"),
                   ("trabajos_20240101_000000.parquet", "20240101", "parquet")]
    assert list_backups(spark, d, "trabajos", day="20240101").count() == 1
    assert list_backups(spark, f"{tmp}/missing", "trabajos").count() == 0
    with pytest.raises(ValueError):
        list_backups(spark, d, "nope")


def test_full_load_and_counts(spark, tmp):
    os.makedirs(f"{tmp}/csv")
    with open(f"{tmp}/csv/departments.csv", "w") as f:
        f.write("1,Staff\n2,Supply Chain")
    with open(f"{tmp}/csv/jobs.csv", "w") as f:
        f.write("1,Recruiter\n2,Manager\n")
    with open(f"{tmp}/csv/hired_employees.csv", "w") as f:
        f.write("id,name,datetime,department_id,job_id\n1,A,2021-01-01T00:00:00Z,1,1\n2,B,2021-05-01 00:00:00,2,2\n")
    store = TableStore(spark, f"{tmp}/t", default_buckets=2)
    res = jobs.full_load(store, f"{tmp}/csv/departments.csv", f"{tmp}/csv/jobs.csv",
                         f"{tmp}/csv/hired_employees.csv")
    assert {r.tabla: r.registros for r in res.counts.collect()} == {
        "departamentos": 2, "trabajos": 2, "empleados_contratados": 2}
    assert res.preview.count() == 2


def test_avro_is_capability_checked(spark, tmp):
    from hirelake.sources import backups as bk
    store = TableStore(spark, f"{tmp}/t", default_buckets=2)
    store.append(DEP, spark.createDataFrame([(1, "A")], DEP.schema))
    if bk.avro_available(spark):
        made = jobs.backup_tables(store, "avro", f"{tmp}/bk", [DEPARTMENTS]).first()
        assert rows(bk.read_backup(spark, made.ruta, DEP, "avro")) == [(1, "A")]
    else:
        with pytest.raises(bk.AvroUnavailable):
            jobs.backup_tables(store, "avro", f"{tmp}/bk", [DEPARTMENTS])
    with pytest.raises(ValueError):
        jobs.backup_tables(store, "csv", f"{tmp}/bk")
    with pytest.raises(ValueError):                      # names checked before any write
        jobs.backup_tables(store, "parquet", f"{tmp}/bk2", [DEPARTMENTS, "nope"])
    assert bk.list_backups(spark, f"{tmp}/bk2", DEPARTMENTS).count() == 0


def _write_docs(tmp, name, docs):
    os.makedirs(f"{tmp}/{name}")
    for i, d in enumerate(docs):
        with open(f"{tmp}/{name}/{i:02d}.json", "w") as f:
            json.dump(d, f)
    return f"{tmp}/{name}"


def test_repeated_ids_fail_their_group_alone(spark, tmp):
    docs = [{"departamentos": [{"id": 1, "departamento": "A"}, {"id": 2, "departamento": "B"}]},
            {"departamentos": [{"id": 1, "departamento": "A2"}]},
            {"departamentos": [{"id": 2, "departamento": "X"}, {"id": 3, "departamento": "C"}, {"id": 2, "departamento": "Y"}]},
            {"tabla": "departamentos", "registros": []}]
    path = _write_docs(tmp, "p", docs)
    store = TableStore(spark, f"{tmp}/t", default_buckets=2)
    res = jobs.ingest_payloads(store, read_payloads(spark, path))
    assert [tuple(r) for r in res.summary.collect()] == [("departamentos", 6, 6, 2)]
    assert rows(store.read(DEP)) == [(1, "A2"), (2, "B")]   # the later payload wins, the third fails
    assert [tuple(r) for r in res.errors.collect()] == [("departamentos", 2, "carga", "id", "duplicate_key", "2")]
    assert [os.path.basename(r.payload) for r in res.rejected.collect()] == ["03.json"]
    jobs.ingest_payloads(store, read_payloads(spark, path), on_duplicate="last")
    assert rows(store.read(DEP)) == [(1, "A2"), (2, "Y"), (3, "C")]


def test_later_file_wins_whatever_its_name(spark, tmp):
    path = _write_docs(tmp, "p", [{"departamentos": [{"id": i, "departamento": f"d{k}"}]} for k in range(3) for i in (1,)])
    for k, t in ((0, 300), (1, 100), (2, 200)):
        os.utime(f"{path}/{k:02d}.json", (1_700_000_000 + t, 1_700_000_000 + t))
    store = TableStore(spark, f"{tmp}/t", default_buckets=2)
    jobs.ingest_payloads(store, read_payloads(spark, path))
    assert rows(store.read(DEP)) == [(1, "d0")]


def test_later_line_wins(spark, tmp):
    os.makedirs(f"{tmp}/lines")
    with open(f"{tmp}/lines/all.jsonl", "w") as f:
        for wave in ("old", "new"):
            for i in range(1, 9):
                f.write(json.dumps({"departamentos": [{"id": i, "departamento": f"{wave}{i}"}]}) + "\n")
    store = TableStore(spark, f"{tmp}/t", default_buckets=2)
    jobs.ingest_payloads(store, read_payloads(spark, f"{tmp}/lines", multi_line=False))
    assert rows(store.read(DEP)) == [(i, f"new{i}") for i in range(1, 9)]


def test_ingest_later_tables_see_earlier_dimensions(spark, tmp):
    store = TableStore(spark, f"{tmp}/t", default_buckets=2)
    docs = [{"empleados_contratados": [{"id": 1, "id_departamento": 5}],
             "departamentos": [{"id": 5, "departamento": "X"}]}]
    res = jobs.ingest_payloads(store, read_payloads(spark, _write_docs(tmp, "p", docs)))
    summary = {r.tabla: r.validos for r in res.summary.collect()}
    assert summary == {"departamentos": 1, "empleados_contratados": 1}


def test_reopened_store_keeps_its_bucket_count(spark, tmp):
    first = TableStore(spark, f"{tmp}/t", default_buckets=2)
    first.append(DEP, spark.createDataFrame([(i, f"d{i}") for i in range(1, 21)], DEP.schema))
    again = TableStore(spark, f"{tmp}/t", default_buckets=7)
    again.upsert(DEP, spark.createDataFrame([(i, "new") for i in range(1, 21, 3)], DEP.schema))
    got = dict(rows(again.read(DEP)))
    assert len(got) == 20 and again.buckets(DEP) == 2
    assert all(got[i] == "new" for i in range(1, 21, 3))


def test_three_stores_of_different_bucket_counts(spark, tmp):
    dep = lambda name: spark.createDataFrame([(i, name) for i in range(1, 21)], DEP.schema)
    TableStore(spark, f"{tmp}/t", default_buckets=4).create_if_missing(DEP)
    TableStore(spark, f"{tmp}/t", default_buckets=8).upsert(DEP, dep("a"))
    last = TableStore(spark, f"{tmp}/t", default_buckets=5)
    last.upsert(DEP, dep("b"))
    assert rows(last.read(DEP)) == [(i, "b") for i in range(1, 21)]
    assert last.buckets(DEP) == 4
    assert last.truncate(DEP) == 20 and TableStore(spark, f"{tmp}/t", default_buckets=3).buckets(DEP) == 4


def test_killed_write_leaves_the_old_table(spark, tmp, monkeypatch):
    store = TableStore(spark, f"{tmp}/t", default_buckets=3)
    store.append(DEP, spark.createDataFrame([(i, "old") for i in range(1, 21)], DEP.schema))
    batch = spark.createDataFrame([(i, "new") for i in range(10, 31)], DEP.schema)

    def killed(*args):
        raise KeyboardInterrupt

    for method in ("_switch", "_write"):
        with monkeypatch.context() as m:
            m.setattr(TableStore, method, killed)
            with pytest.raises(KeyboardInterrupt):
                store.upsert(DEP, batch)
        assert rows(store.read(DEP)) == [(i, "old") for i in range(1, 21)]
    store.upsert(DEP, batch)
    want = [(i, "old" if i < 10 else "new") for i in range(1, 31)]
    assert rows(store.read(DEP)) == want
    assert store.vacuum(DEP) > 0 and rows(store.read(DEP)) == want


def test_failed_append_adds_nothing(spark, tmp):
    store = TableStore(spark, f"{tmp}/t", default_buckets=3)
    store.append(DEP, spark.createDataFrame([(1, "a"), (2, "b")], DEP.schema))
    with pytest.raises(ValueError):
        store.append(DEP, spark.createDataFrame([(2, "x"), (3, "c")], DEP.schema))
    with pytest.raises(DuplicateKeyError):
        store.append(DEP, spark.createDataFrame([(4, "x"), (4, "y")], DEP.schema))
    assert rows(store.read(DEP)) == [(1, "a"), (2, "b")]


def test_rebucket(spark, tmp):
    store = TableStore(spark, f"{tmp}/t", default_buckets=2)
    store.append(DEP, spark.createDataFrame([(i, f"d{i}") for i in range(1, 21)], DEP.schema))
    store.rebucket(DEP, 7)
    store.upsert(DEP, spark.createDataFrame([(5, "five")], DEP.schema))
    assert store.buckets(DEP) == 7 and dict(rows(store.read(DEP))) == {**{i: f"d{i}" for i in range(1, 21)}, 5: "five"}


def test_files_without_a_state_are_refused(spark, tmp):
    os.makedirs(f"{tmp}/t/departamentos/b=0")
    with pytest.raises(ValueError):
        TableStore(spark, f"{tmp}/t").upsert(DEP, spark.createDataFrame([(1, "a")], DEP.schema))


def test_full_load_refuses_what_the_schema_forbids(spark, tmp):
    os.makedirs(f"{tmp}/csv")
    texts = {"d": "1,Staff\n2," + "x" * 51 + "\n", "j": "1,Clerk\n2," + "y" * 201 + "\n",
             "h": "id,name,datetime,department_id,job_id\n1,A,,1,1\n2,B,,99,1\n3,C,,1,77\n4," + "n" * 101 + ",,,\n-5,E,,,\n"}
    for name, text in texts.items():
        with open(f"{tmp}/csv/{name}.csv", "w") as f:
            f.write(text)
    store = TableStore(spark, f"{tmp}/t", default_buckets=2)
    res = jobs.full_load(store, *(f"{tmp}/csv/{n}.csv" for n in "djh"))
    assert {r.tabla: r.registros for r in res.counts.collect()} == {
        "departamentos": 1, "trabajos": 1, "empleados_contratados": 2}
    assert sorted(r.id for r in store.read(HIRE).collect()) == [-5, 1]
    errs = sorted((r.tabla, r.etapa, r.campo, r.regla, r.valor.split(",")[0]) for r in res.errors.collect())
    assert errs == [("departamentos", "modelo", "departamento", "string_too_long", "2"),
                    ("empleados_contratados", "calidad", "id_departamento", "fk_missing", "2"),
                    ("empleados_contratados", "calidad", "id_trabajo", "fk_missing", "3"),
                    ("empleados_contratados", "modelo", "nombre", "string_too_long", "4"),
                    ("trabajos", "modelo", "trabajo", "string_too_long", "2")]


def test_restore_reports_positions_and_keeps_the_last(spark, tmp):
    store = TableStore(spark, f"{tmp}/t", default_buckets=2)
    data = [(9, "first", None, None, None), (-1, "bad", None, None, None), (9, "second", None, None, None)]
    spark.createDataFrame(data, HIRE.backup_schema).coalesce(1).write.parquet(f"{tmp}/bk")
    res = jobs.restore_table(store, HIRES, f"{tmp}/bk", "parquet")
    assert [(r.indice, r.regla) for r in res.errors.collect()] == [(1, "greater_than")]
    assert rows(store.read(HIRE)) == [(9, "second", None, None, None)]


def test_wipe_reports_the_backups(spark, tmp):
    from hirelake.sources.backups import backup_totals
    store = TableStore(spark, f"{tmp}/t", default_buckets=2)
    store.append(DEP, spark.createDataFrame([(1, "a")], DEP.schema))
    for second in (1, 2):
        jobs.backup_tables(store, "parquet", f"{tmp}/bk", [DEPARTMENTS], now=dt.datetime(2024, 1, 1, 0, 0, second))
    r = jobs.wipe_table(store, DEPARTMENTS, f"{tmp}/bk", today=dt.date(2024, 1, 1)).first()
    assert tuple(r) == ("departamentos", 1, 2, "departamentos_20240101_000002.parquet,departamentos_20240101_000001.parquet")
    assert tuple(backup_totals(list_backups(spark, f"{tmp}/bk", DEPARTMENTS)).first()) == (True, 2)
    assert tuple(backup_totals(list_backups(spark, f"{tmp}/none", DEPARTMENTS)).first()) == (False, 0)
