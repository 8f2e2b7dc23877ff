import json
import os

import pytest

from hirelake.plans import jobs
from hirelake.sinks.table_store import TableStore
from hirelake.sources.payloads import read_payloads
from hirelake.spec import HIRES, SPECS
from hirelake.streaming.intake import intake_summary, start_intake


def test_stream_intake_equals_batch_intake(spark, tmp):
    docs = [{"departamentos": [{"id": i, "departamento": f"d{i}"} for i in range(1, 6)]},
            {"trabajos": [{"id": 1, "trabajo": "j"}, {"id": -2, "trabajo": "k"}]},
            {"empleados_contratados": [{"id": i, "id_departamento": (i % 7) or None, "id_trabajo": 1}
                                       for i in range(1, 30)]}]
    os.makedirs(f"{tmp}/in")
    for i, d in enumerate(docs):
        with open(f"{tmp}/in/{i}.json", "w") as f:
            json.dump(d, f)
    batch_store = TableStore(spark, f"{tmp}/batch", default_buckets=2)
    b = jobs.ingest_payloads(batch_store, read_payloads(spark, f"{tmp}/in"))
    stream_store = TableStore(spark, f"{tmp}/stream", default_buckets=2)
    q = start_intake(spark, f"{tmp}/in", stream_store, f"{tmp}/chk")
    q.awaitTermination()
    s = intake_summary(spark, f"{tmp}/chk")
    as_set = lambda df: {tuple(r) for r in df.select("tabla", "recibidos", "validos", "upsert").collect()}
    assert as_set(s) == as_set(b.summary)
    rows = lambda st: sorted(tuple(r) for r in st.read(SPECS[HIRES]).collect())
    assert rows(stream_store) == rows(batch_store)
    # a second run finds nothing new and changes nothing
    q = start_intake(spark, f"{tmp}/in", stream_store, f"{tmp}/chk")
    q.awaitTermination()
    assert as_set(intake_summary(spark, f"{tmp}/chk")) == as_set(b.summary)


def test_stream_intake_one_file_per_micro_batch(spark, tmp):
    docs = [{"departamentos": [{"id": 1, "departamento": "d1"}, {"id": 2, "departamento": "d2"}]},
            {"empleados_contratados": [{"id": 10, "id_departamento": 1}, {"id": 11, "id_departamento": 3}]},
            {"empleados_contratados": [{"id": 10, "nombre": "again", "id_departamento": 2}]}]
    os.makedirs(f"{tmp}/in")
    for i, d in enumerate(docs):                      # arrival order = file order
        with open(f"{tmp}/in/{i}.json", "w") as f:
            json.dump(d, f)
        os.utime(f"{tmp}/in/{i}.json", (1_700_000_000 + i, 1_700_000_000 + i))
    store = TableStore(spark, f"{tmp}/t", default_buckets=2)
    q = start_intake(spark, f"{tmp}/in", store, f"{tmp}/chk", max_files_per_trigger=1)
    q.awaitTermination()
    s = {r.tabla: (r.recibidos, r.validos, r.upsert) for r in intake_summary(spark, f"{tmp}/chk").collect()}
    assert s == {"departamentos": (2, 2, 2), "empleados_contratados": (3, 2, 2)}
    rows = {r.id: (r.nombre, r.id_departamento) for r in store.read(SPECS[HIRES]).collect()}
    assert rows == {10: ("again", 2)}                 # later micro-batch upserted over the earlier one
    assert spark.read.parquet(f"{tmp}/chk/summary").select("batch_id").distinct().count() == 3


@pytest.mark.parametrize("dies_after", [1, 2, 3])
def test_a_replayed_micro_batch_is_exactly_once(spark, tmp, monkeypatch, dies_after):
    """The run dies after the given commit; a new one replays the micro-batch."""
    docs = [{"departamentos": [{"id": i, "departamento": f"d{i}"} for i in range(1, 5)],
             "trabajos": [{"id": 1, "trabajo": "j"}, {"id": -2, "trabajo": "k"}],
             "empleados_contratados": [{"id": i, "id_departamento": i, "id_trabajo": 1} for i in range(1, 8)]}]
    os.makedirs(f"{tmp}/in")
    with open(f"{tmp}/in/0.json", "w") as f:
        json.dump(docs[0], f)
    result = lambda base, store: (
        sorted(tuple(r) for r in intake_summary(spark, base).collect()),
        sorted(tuple(r) for r in spark.read.parquet(f"{base}/errors").select("tabla", "indice", "campo", "regla").collect()),
        [sorted(tuple(r) for r in store.read(s).collect()) for s in SPECS.values()])
    plain = TableStore(spark, f"{tmp}/plain", default_buckets=2)
    start_intake(spark, f"{tmp}/in", plain, f"{tmp}/chk-plain").awaitTermination()

    store = TableStore(spark, f"{tmp}/t", default_buckets=2)
    original, commits = TableStore._add, []

    def dying(self, *args, **kwargs):
        original(self, *args, **kwargs)
        commits.append(args[0].name)
        if len(commits) == dies_after:
            raise RuntimeError("died")

    with monkeypatch.context() as m:
        m.setattr(TableStore, "_add", dying)
        with pytest.raises(Exception):
            start_intake(spark, f"{tmp}/in", store, f"{tmp}/chk").awaitTermination()
    states = {s.name: store.snapshot(s) for s in SPECS.values()}
    start_intake(spark, f"{tmp}/in", store, f"{tmp}/chk").awaitTermination()
    assert result(f"{tmp}/chk", store) == result(f"{tmp}/chk-plain", plain)
    # Tables that had committed were not written again.
    assert all(store.snapshot(SPECS[name]) == states[name] for name in commits[:dies_after])
