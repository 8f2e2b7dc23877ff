"""Merge on read, data skipping, two writers, replayed batches, pinned backups."""

import datetime as dt
import glob
import os

import pytest

from hirelake.operators.keys import DuplicateKeyError
from hirelake.plans import jobs
from hirelake.sinks import table_store
from hirelake.sinks.table_store import ConflictError, TableStore
from hirelake.spec import DEPARTMENTS, HIRES, SPECS

DEP, HIRE = SPECS[DEPARTMENTS], SPECS[HIRES]


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def dep(spark, ids, name):
    return spark.createDataFrame([(i, name if isinstance(name, str) else name(i)) for i in ids], DEP.schema)


def hire(spark, data):
    return spark.createDataFrame([(i, "n", t, None, None) for i, t in data], HIRE.schema)


def data_bytes(tmp):
    return sum(os.path.getsize(f) for f in glob.glob(f"{tmp}/t/*/w-*/b=*/part-*"))


def opened(df):
    """Folders that a read would open."""
    return {f.split("/w-")[1].split("/")[0] for f in df.inputFiles()}


def test_small_upsert_writes_in_proportion_to_its_batch(spark, tmp):
    store = TableStore(spark, f"{tmp}/t", default_buckets=2)
    store.append(DEP, dep(spark, range(20_000), lambda i: f"department {i * 7919 % 100_003}"))
    table = data_bytes(tmp)
    store.upsert(DEP, dep(spark, [5, 6, 30_001], "new"))
    assert data_bytes(tmp) - table < table / 20
    got = dict(rows(store.read(DEP)))
    assert len(got) == 20_001 and got[5] == got[6] == got[30_001] == "new" and got[7] == f"department {7 * 7919 % 100_003}"
    assert store.count(DEP) == 20_001


def test_many_deltas_newest_wins_before_and_after_compaction(spark, tmp):
    store = TableStore(spark, f"{tmp}/t", default_buckets=3, max_parts=100)
    store.append(DEP, dep(spark, range(60), "old"))
    want = {i: "old" for i in range(60)}
    for k in range(4):
        ids = range(k, 90, 7 + k)
        assert store.upsert(DEP, dep(spark, ids, f"delta{k}")) == len(ids)
        want |= {i: f"delta{k}" for i in ids}
    parts = [len(p) for p in store._state(DEP)["parts"].values()]
    assert max(parts) >= 4
    assert rows(store.read(DEP)) == sorted(want.items()) and store.count(DEP) == len(want)
    with pytest.raises(ValueError):
        store.append(DEP, dep(spark, [200, 89], "clash"))  # 89 is in a delta alone
    assert store.compact(DEP) == 3
    assert [len(p) for p in store._state(DEP)["parts"].values()] == [1, 1, 1]
    assert rows(store.read(DEP)) == sorted(want.items()) and store.count(DEP) == len(want)
    assert store.compact(DEP) == 0
    assert store.vacuum(DEP) > 0 and rows(store.read(DEP)) == sorted(want.items())


def test_crash_between_the_steps_of_a_compaction(spark, tmp, monkeypatch):
    store = TableStore(spark, f"{tmp}/t", default_buckets=2)
    store.append(DEP, dep(spark, range(20), "old"))
    store.upsert(DEP, dep(spark, range(5), "new"))
    want = rows(store.read(DEP))

    def killed(*args, **kwargs):
        raise KeyboardInterrupt

    for method in ("_write", "_measure", "_switch"):
        with monkeypatch.context() as m:
            m.setattr(TableStore, method, killed)
            with pytest.raises(KeyboardInterrupt):
                store.compact(DEP)
        assert rows(store.read(DEP)) == want
    store.compact(DEP)
    assert rows(store.read(DEP)) == want


def test_a_bucket_compacts_itself(spark, tmp):
    store = TableStore(spark, f"{tmp}/t", default_buckets=1, max_parts=4)
    store.append(DEP, dep(spark, range(50), "old"))
    for k in range(9):
        store.upsert(DEP, dep(spark, [k], f"v{k}"))
        assert len(store._state(DEP)["parts"][0]) <= 5
    assert dict(rows(store.read(DEP))) == {i: f"v{i}" if i < 9 else "old" for i in range(50)}


def test_appends_of_new_keys_read_nothing(spark, tmp, monkeypatch):
    store = TableStore(spark, f"{tmp}/t", default_buckets=2)
    store.append(DEP, dep(spark, range(100), "a"))
    monkeypatch.setattr(TableStore, "_files", lambda *a, **k: pytest.fail("read stored rows"))
    store.append(DEP, dep(spark, range(100, 200), "b"))


def test_counts_come_from_the_state(spark, tmp, monkeypatch):
    store = TableStore(spark, f"{tmp}/t", default_buckets=2)
    store.append(HIRE, hire(spark, [(i, None) for i in range(30)]))
    store.append(HIRE, hire(spark, [(i, None) for i in range(30, 45)]))
    monkeypatch.setattr(TableStore, "_files", lambda *a, **k: pytest.fail("read stored rows"))
    assert store.count(HIRE) == 45
    assert {r.tabla: r.registros for r in jobs.verify_counts(store).collect()}[HIRES] == 45


def test_time_range_opens_matching_parts_only(spark, tmp):
    store = TableStore(spark, f"{tmp}/t", default_buckets=2)
    day = lambda y, d: dt.datetime(y, 1, 1) + dt.timedelta(days=d)
    for y in (2019, 2020, 2021):
        store.append(HIRE, hire(spark, [(y * 100 + d, day(y, d * 3)) for d in range(60)]))
    store.append(HIRE, hire(spark, [(1, None)]))
    folders = {y: p["folder"][2:] for ps in store._state(HIRE)["parts"].values() for p in ps
               for y in (2019, 2020, 2021) if p["time"][0] and p["time"][0].startswith(str(y))}
    year = (dt.datetime(2020, 1, 1), dt.datetime(2021, 1, 1))
    full = [r for r in rows(store.read(HIRE).where("nombre is not null")) if r[2] and year[0] <= r[2] < year[1]]
    assert opened(store.read(HIRE, *year)) == {folders[2020]} and rows(store.read(HIRE, *year)) == full
    # A correction moves one hire out of the year and one into it.
    store.upsert(HIRE, hire(spark, [(202000, day(2019, 5)), (201900, day(2020, 5))]))
    got = {r[0] for r in rows(store.read(HIRE, *year))}
    assert got == {r[0] for r in full} - {202000} | {201900}
    assert folders[2021] not in opened(store.read(HIRE, *year))
    assert rows(store.read(HIRE, None, dt.datetime(2000, 1, 1))) == []
    with pytest.raises(ValueError):
        store.read(DEP, *year)


def interleave(monkeypatch, store, other):
    """Runs ``other`` once, just before the store's next commit."""
    original = TableStore._switch
    pending = [other]

    def switch(self, spec, old, state):
        if self is store and pending:
            pending.pop()()
        return original(self, spec, old, state)

    monkeypatch.setattr(TableStore, "_switch", switch)


def test_two_writers_keep_both_results(spark, tmp, monkeypatch):
    one, two = (TableStore(spark, f"{tmp}/t", default_buckets=2) for _ in range(2))
    one.append(DEP, dep(spark, range(20), "old"))
    interleave(monkeypatch, one, lambda: two.upsert(DEP, dep(spark, [3, 4, 50], "two")))
    one.upsert(DEP, dep(spark, [4, 5, 60], "one"))
    got = dict(rows(one.read(DEP)))
    assert (got[3], got[4], got[5], got[50], got[60]) == ("two", "one", "one", "two", "one") and len(got) == 22
    interleave(monkeypatch, one, lambda: two.append(DEP, dep(spark, [70], "two")))
    one.append(DEP, dep(spark, [71], "one"))
    assert {70, 71} <= dict(rows(one.read(DEP))).keys()


def test_a_clash_with_the_faster_writer_is_found(spark, tmp, monkeypatch):
    one, two = (TableStore(spark, f"{tmp}/t", default_buckets=2) for _ in range(2))
    one.append(DEP, dep(spark, range(5), "old"))
    interleave(monkeypatch, one, lambda: two.append(DEP, dep(spark, [70], "two")))
    folders = len(os.listdir(f"{tmp}/t/departamentos"))
    with pytest.raises(ValueError):
        one.append(DEP, dep(spark, [70, 71], "one"))
    got = dict(rows(one.read(DEP)))
    assert got[70] == "two" and 71 not in got
    left = {n for n in os.listdir(f"{tmp}/t/departamentos") if n.startswith("w-")}
    assert left == {p["folder"] for ps in one._state(DEP)["parts"].values() for p in ps} and folders


def test_compaction_keeps_what_is_added_meanwhile(spark, tmp, monkeypatch):
    one, two = (TableStore(spark, f"{tmp}/t", default_buckets=2) for _ in range(2))
    one.append(DEP, dep(spark, range(20), "old"))
    one.upsert(DEP, dep(spark, range(6), "first"))
    interleave(monkeypatch, one, lambda: two.upsert(DEP, dep(spark, [1, 30], "late")))
    one.compact(DEP)
    got = dict(rows(one.read(DEP)))
    assert got == {i: "late" if i in (1, 30) else "first" if i < 6 else "old" for i in [*range(20), 30]}


def test_a_replaced_table_refuses_the_slower_writer(spark, tmp, monkeypatch):
    one, two = (TableStore(spark, f"{tmp}/t", default_buckets=2) for _ in range(2))
    one.append(DEP, dep(spark, range(5), "old"))
    interleave(monkeypatch, one, lambda: two.recreate(DEP))
    with pytest.raises(ConflictError):
        one.upsert(DEP, dep(spark, [1], "one"))
    assert rows(one.read(DEP)) == []


def test_replayed_batches_are_recognised(spark, tmp):
    store = TableStore(spark, f"{tmp}/t", default_buckets=2)
    assert store.upsert(DEP, dep(spark, [1, 2], "a"), batch=("s", 0)) == 2
    assert store.upsert(DEP, dep(spark, [1], "b"), batch=("s", 1)) == 1
    n = store.snapshot(DEP)
    assert store.upsert(DEP, dep(spark, [1], "b"), batch=("s", 1)) == 1
    assert store.snapshot(DEP) == n
    assert store.upsert(DEP, dep(spark, [1], "c"), batch=("other", 0)) == 1
    assert rows(store.read(DEP)) == [(1, "c"), (2, "a")]
    with pytest.raises(DuplicateKeyError):
        store.upsert(DEP, dep(spark, [9, 9], "x"), batch=("s", 2))


def test_a_backup_is_of_one_moment(spark, tmp, monkeypatch):
    """A writer adds a department and a hire in it between two tables' backups."""
    store = TableStore(spark, f"{tmp}/t", default_buckets=2)
    store.append(DEP, dep(spark, [1], "a"))
    store.append(HIRE, spark.createDataFrame([(1, "x", None, 1, None)], HIRE.schema))
    original, calls = jobs.to_backup_rows, []

    def writing(df, spec):
        if calls:
            store.append(DEP, dep(spark, [1 + len(calls)], "late"))
            store.append(HIRE, spark.createDataFrame([(1 + len(calls), "y", None, 1 + len(calls), None)], HIRE.schema))
        calls.append(spec.name)
        return original(df, spec)

    monkeypatch.setattr(jobs, "to_backup_rows", writing)
    made = {r.tabla: r for r in jobs.backup_tables(store, "parquet", f"{tmp}/bk").collect()}
    hired = {r.id_departamento for r in spark.read.parquet(made[HIRES].ruta).collect()}
    assert hired <= {r.id for r in spark.read.parquet(made[DEPARTMENTS].ruta).collect()}
    assert made[HIRES].registros == 1 and store.count(HIRE) == 3


def test_key_filters_tell_parts_apart():
    part = lambda low, high, word: {"key": [low, high], "seen": [word] + [0] * 7}
    assert table_store._may_share(part(1, 9, 6), part(5, 20, 2))
    assert not table_store._may_share(part(1, 9, 6), part(5, 20, 1))
    assert not table_store._may_share(part(1, 4, 6), part(5, 20, 6))
