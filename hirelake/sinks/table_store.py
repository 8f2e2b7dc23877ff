"""Bucketed Parquet tables with keyed upsert (W4-W12, J7, SURVEY 4.2).

Layout: ``<root>/<table>/<write>/b=<pmod(hash(key), B)>/part-*.parquet``,
one folder per write, and small state files ``_STATE_<n>.json``.  The state
with the greatest number is the table.  It names the bucket count and, per
bucket, its parts in the order in which they were written: the folder, whether
it is a delta, its row count, the least and greatest key and time, and a filter
of its keys.

* An append adds a part to every bucket it has rows for, after testing that no
  key is stored yet.  Only parts that may hold one of its keys are read for
  that test: ranges that overlap and filters that meet.
* An upsert is merged on read: it writes its batch as a delta, and reads
  nothing that is stored.  Its cost follows the batch.
* A read takes the newest row of every key in a bucket's deltas, and the
  rows of its other parts whose keys no delta has (``left_anti``).  Buckets
  without deltas, and parts that share no key with a delta, are read plainly.
  ``since`` / ``until`` skip parts whose times lie outside.
* ``compact`` rewrites buckets with deltas or many parts; a bucket is compacted
  on its own when it has more than ``MAX_PARTS``, or when its deltas
  hold as many rows as the rest.  A row is thus rewritten once in a while, not
  with each batch that touches its bucket.

A state is written last and renamed into place: that is the commit.  A run
that fails at any point leaves the old table untouched, and re-running the
batch gives the same table.  When another writer's state came first, the change is
made again on top of it (``_commit``): parts of other writers stay, an append tests
the keys it hasn't seen, a compaction keeps the parts that were added meanwhile.  With
``batch=(name, id)`` the state also records the last batch of a stream, so that a batch
that is replayed after its commit is recognised and not written again.

Folders that no state names are left over from failed runs or replaced by
compaction; ``vacuum`` deletes them once no reader needs them.  The bucket
count is chosen when a table is created and kept in its state; ``rebucket``
changes it for a table that has outgrown it.
"""

from __future__ import annotations

import datetime as dt
import json
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hirelake.operators.keys import DuplicateKeyError, keep_last
from hirelake.session import delete_path, list_names, materialize, read_text, write_text
from hirelake.spec import TableSpec

BUCKET = "b"
STATE = "_STATE_"
#: Parts of a bucket beyond which it is compacted.
MAX_PARTS = 16
#: A key filter has 8 words of 63 bits; a key sets one bit.
_WORDS, _BITS = 8, 63


class ConflictError(RuntimeError):
    """Another writer changed what this change relies on."""


def _time(value: dt.datetime | None) -> str | None:
    return value.isoformat(sep=" ", timespec="microseconds") if value is not None else None


def _may_share(a: dict, b: dict) -> bool:
    """Whether two parts may hold a common key."""
    return (a["key"][0] <= b["key"][1] and b["key"][0] <= a["key"][1]
            and any(x & y for x, y in zip(a["seen"], b["seen"], strict=True)))


class TableStore:
    def __init__(self, spark: SparkSession, root: str, buckets: dict[str, int] | None = None,
                 default_buckets: int | None = None, max_parts: int = MAX_PARTS):
        self.spark = spark
        self.root = root.rstrip("/")
        self.max_parts = max_parts
        self._wanted = dict(buckets or {})
        self._default = default_buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))

    # -- state ----------------------------------------------------------
    def path(self, spec: TableSpec) -> str:
        return f"{self.root}/{spec.name}"

    def _state(self, spec: TableSpec) -> dict | None:
        """The table's current state; ``None`` when it was never created.
        Always read from storage: another store may have written."""
        names = list_names(self.spark, self.path(spec))
        numbers = [int(n[len(STATE):-len(".json")]) for n in names or []
                   if n.startswith(STATE) and n.endswith(".json")]
        if not numbers:
            if names:
                raise ValueError(f"{self.path(spec)} holds files but no table state")
            return None
        return self._state_at(spec, max(numbers))

    def _state_at(self, spec: TableSpec, n: int) -> dict:
        body = json.loads(read_text(self.spark, f"{self.path(spec)}/{STATE}{n}.json"))
        return {"number": n, **body, "parts": {int(b): p for b, p in body["parts"].items()}}

    def _switch(self, spec: TableSpec, old: dict | None, state: dict) -> None:
        """Make a new state current.  The rename is the commit; it fails when
        another writer's state has that number already."""
        n = old["number"] + 1 if old else 1
        body = {k: state[k] for k in ("buckets", "epoch", "batches")}
        body["parts"] = {str(b): p for b, p in sorted(state["parts"].items()) if p}
        write_text(self.spark, f"{self.path(spec)}/{STATE}{n}.json", json.dumps(body))

    def _commit(self, spec: TableSpec, change: Callable[[dict], dict]) -> dict:
        """Apply ``change`` to the current state, again and again until no other
        writer is faster.  ``change`` gets a state and returns the new one."""
        while True:
            old = self._created(spec)
            new = change({**old, "parts": {b: list(p) for b, p in old["parts"].items()}, "batches": dict(old["batches"])})
            try:
                self._switch(spec, old, new)
                return new
            except FileExistsError:
                continue

    def snapshot(self, spec: TableSpec) -> int | None:
        """The number of the current state, to read the table as it is now."""
        state = self._state(spec)
        return state["number"] if state else None

    def buckets(self, spec: TableSpec) -> int:
        """Bucket count: a created table's own, whatever this store was given."""
        state = self._state(spec)
        return state["buckets"] if state else self._wanted.get(spec.name, self._default)

    def bucket_of(self, spec: TableSpec, buckets: int):
        return F.pmod(F.hash(F.col(spec.key)), F.lit(buckets))

    # -- DDL ------------------------------------------------------------
    def create_if_missing(self, spec: TableSpec) -> None:
        """An empty table when none exists yet."""
        if self._state(spec) is None:
            try:
                self._switch(spec, None, {"buckets": self.buckets(spec), "epoch": 0, "batches": {}, "parts": {}})
            except FileExistsError:
                pass  # another writer created it

    def recreate(self, spec: TableSpec) -> None:
        """W12 / delete-all: replace the table by an empty one, which keeps
        the bucket count of a table that existed."""
        if self._state(spec) is None:
            self.create_if_missing(spec)
            return
        self._commit(spec, lambda s: {**s, "epoch": s["epoch"] + 1, "parts": {}})

    def _created(self, spec: TableSpec) -> dict:
        self.create_if_missing(spec)
        return self._state(spec)

    # -- reads ----------------------------------------------------------
    def _files(self, spec: TableSpec, parts: dict[int, list[dict]], columns: list[str] | None = None) -> DataFrame:
        """Rows of parts, one after the other."""
        schema = T.StructType([spec.schema[c] for c in columns]) if columns else spec.schema
        paths = [f"{self.path(spec)}/{p['folder']}/{BUCKET}={b}" for b, ps in sorted(parts.items()) for p in ps]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _newest(self, spec: TableSpec, deltas: dict[int, list[dict]]) -> DataFrame:
        """The newest row of each key in the deltas."""
        by_folder: dict[tuple[int, str], dict[int, list[dict]]] = {}
        for b, ps in deltas.items():
            for p in ps:
                by_folder.setdefault((p["seq"], p["folder"]), {})[b] = [p]
        if len(by_folder) == 1:
            return self._files(spec, deltas)
        frames = [self._files(spec, parts).withColumn("_seq", F.lit(seq)) for (seq, _), parts in sorted(by_folder.items())]
        return keep_last(reduce(DataFrame.unionAll, frames), spec.key, "_seq").select(*spec.columns)

    def _resolve(self, spec: TableSpec, parts: dict[int, list[dict]], since: dt.datetime | None = None,
                 until: dt.datetime | None = None) -> DataFrame:
        """The rows that ``parts`` make; with a time range, those within it."""
        deltas = {b: [p for p in ps if p["delta"]] for b, ps in parts.items()}
        deltas = {b: ps for b, ps in deltas.items() if ps}
        ranged = since is not None or until is not None
        within = _in_range(spec, since, until) if ranged else None
        plain: dict[int, list[dict]] = {}
        covered: dict[int, list[dict]] = {}
        for b, ps in parts.items():
            for p in ps:
                if p["delta"] or (ranged and not _within(p, since, until)):
                    continue
                hit = any(_may_share(p, d) for d in deltas.get(b, []))
                (covered if hit else plain).setdefault(b, []).append(p)
        frames = [self._files(spec, plain)] if plain else []
        if deltas:
            newest = self._newest(spec, deltas)
            frames.append(newest)
            if covered:
                # A key that a delta has is old here, wherever the new row's time lies.
                keys = self._files(spec, deltas, [spec.key])
                frames.append(self._files(spec, covered).join(keys, spec.key, "left_anti").select(*spec.columns))
        if not frames:
            return self.spark.createDataFrame([], spec.schema)
        rows = reduce(DataFrame.unionAll, frames)
        return rows.where(within) if ranged else rows

    def read(self, spec: TableSpec, since: dt.datetime | None = None, until: dt.datetime | None = None,
             at: int | None = None) -> DataFrame:
        """S3: the whole table with the spec's schema (an empty table
        reads fine; nothing is inferred).  A table never created reads as
        empty, as the service's tables always exist.

        ``since`` (inclusive) and ``until`` (exclusive) keep rows whose time lies
        within, and open only the parts that may hold one; ``at`` reads an earlier
        state (see ``snapshot``)."""
        state = self._state(spec) if at is None else self._state_at(spec, at)
        return self._resolve(spec, state["parts"] if state else {}, since, until)

    def count(self, spec: TableSpec, at: int | None = None) -> int:
        """A5, J4p: COUNT(*), from the state alone; only buckets whose deltas may
        replace stored rows are read."""
        state = self._state(spec) if at is None else self._state_at(spec, at)
        n, mixed = 0, {}
        for b, ps in (state["parts"] if state else {}).items():
            pairs = ((p, d) for i, d in enumerate(ps) if d["delta"] for p in ps[:i])
            if any(_may_share(p, d) for p, d in pairs):
                mixed[b] = ps
            else:
                n += sum(p["rows"] for p in ps)
        return n + (self._resolve(spec, mixed).count() if mixed else 0)

    # -- writes ---------------------------------------------------------
    def _write(self, spec: TableSpec, df: DataFrame, buckets: int) -> tuple[str, DataFrame]:
        """Write rows by bucket into a new folder; AQE splits a bucket that
        is too large for one task.  Returns the folder and its rows."""
        folder = f"w-{uuid.uuid4().hex[:12]}"
        path = f"{self.path(spec)}/{folder}"
        (df.select(*spec.columns).withColumn(BUCKET, self.bucket_of(spec, buckets)).hint("rebalance", BUCKET)
         .write.partitionBy(BUCKET).parquet(path))
        schema = T.StructType([*spec.schema.fields, T.StructField(BUCKET, T.IntegerType())])
        return folder, self.spark.read.schema(schema).parquet(path)

    def _measure(self, spec: TableSpec, folder: str, written: DataFrame, delta: bool) -> tuple[dict[int, dict], bool]:
        """The parts of a written folder by bucket (at most ``B`` rows come back to
        the driver), and whether a key repeats."""
        place = F.pmod(F.xxhash64(spec.key), F.lit(_WORDS * _BITS))
        bit = lambda w: F.expr(f"IF(_place DIV {_BITS} = {w}, shiftleft(1L, CAST(_place % {_BITS} AS INT)), 0L)")
        times = [f.name for f in spec.fields if f.kind == "datetime"][:1]
        rows = (written.withColumn("_place", place).groupBy(BUCKET).agg(
            F.count(F.lit(1)).alias("n"), F.count_distinct(spec.key).alias("keys"),
            F.min(spec.key).alias("low"), F.max(spec.key).alias("high"),
            *[f(c).alias(a) for c in times for f, a in ((F.min, "first"), (F.max, "last"))],
            *[F.bit_or(bit(w)).alias(f"seen{w}") for w in range(_WORDS)]).collect())
        parts = {r[BUCKET]: {"folder": folder, "delta": delta, "rows": r["n"], "key": [r["low"], r["high"]],
                             "time": [_time(r["first"]), _time(r["last"])] if times else None,
                             "seen": [r[f"seen{w}"] for w in range(_WORDS)]} for r in rows}
        return parts, any(r["n"] != r["keys"] for r in rows)

    def _discard(self, spec: TableSpec, folder: str) -> None:
        delete_path(self.spark, f"{self.path(spec)}/{folder}")

    def _done(self, spec: TableSpec, batch: tuple[str, int] | None) -> int | None:
        """Rows of a stream's batch that is committed already, else ``None``."""
        if batch is None:
            return None
        known = self._created(spec)["batches"].get(batch[0])
        return known["rows"] if known and known["id"] >= batch[1] else None

    def _add(self, spec: TableSpec, folder: str, parts: dict[int, dict], buckets: int, epoch: int,
             batch: tuple[str, int] | None = None, check: Callable[[dict], None] | None = None) -> None:
        """Commit written parts on top of whatever the table is by then."""

        def change(state: dict) -> dict:
            if (state["buckets"], state["epoch"]) != (buckets, epoch):
                raise ConflictError(f"{spec.name} was replaced or rebucketed meanwhile")
            if check:
                check(state)
            if batch is not None:
                known = state["batches"].get(batch[0])
                if known and known["id"] >= batch[1]:
                    raise ConflictError(f"batch {batch} is committed")
                state["batches"][batch[0]] = {"id": batch[1], "rows": sum(p["rows"] for p in parts.values())}
            for b, p in parts.items():
                mine = state["parts"].setdefault(b, [])
                # The first write of a bucket replaces nothing.
                mine.append({**p, "delta": p["delta"] and bool(mine), "seq": state["number"] + 1})
            return state

        try:
            state = self._commit(spec, change)
        except (ConflictError, ValueError):
            self._discard(spec, folder)
            raise
        self._tidy(spec, state, set(parts))

    def append(self, spec: TableSpec, rows: DataFrame) -> int:
        """Add rows whose keys are new; a key already stored or
        repeated in ``rows`` fails the whole batch, as a primary-key clash
        aborts COPY.  ``rows`` is evaluated once: it is written first and
        tested as written, and only then becomes part of the table."""
        state = self._created(spec)
        folder, written = self._write(spec, rows, state["buckets"])
        parts, repeats = self._measure(spec, folder, written, delta=False)
        if repeats:
            self._discard(spec, folder)
            raise DuplicateKeyError(f"{spec.name}: duplicate values of {spec.key!r} in batch")
        tested: set[str] = set()

        def check(now: dict) -> None:
            """Only parts that were not tested before, and may hold one of the keys."""
            stored = {b: [p for p in now["parts"].get(b, []) if p["folder"] not in tested and _may_share(p, mine)]
                      for b, mine in parts.items()}
            if any(stored.values()):
                clash = self._files(spec, stored, [spec.key]).join(written.select(spec.key), spec.key, "left_semi")
                if not clash.isEmpty():
                    raise ValueError(f"{spec.name}: keys already present")
            tested.update(p["folder"] for b in parts for p in now["parts"].get(b, []))

        self._add(spec, folder, parts, state["buckets"], state["epoch"], check=check)
        return sum(p["rows"] for p in parts.values())

    def upsert(self, spec: TableSpec, rows: DataFrame, on_duplicate: str = "error",
               order: str | None = None, materialized: bool = False, batch: tuple[str, int] | None = None) -> int:
        """Insert new keys, replace matched rows (every non-key column,
        NULLs included); returns the number of rows written from the batch.

        ``order`` tells which of several rows of a key is the last.
        ``materialized=True`` tells that ``rows`` is already written out (reading
        it twice gives the same rows); otherwise a batch that may repeat keys is
        written once to the checkpoint folder here.  ``batch`` names a stream and
        its batch number: a batch that is committed already is not written again."""
        if on_duplicate not in ("error", "last"):
            raise ValueError(f"unknown duplicate policy {on_duplicate!r}")
        done = self._done(spec, batch)
        if done is not None:
            return done
        state = self._created(spec)
        if on_duplicate == "last":
            rows = rows.select(*spec.columns, order)
            rows = rows if materialized else materialize(rows, f"upsert-{spec.name}")
        folder, written = self._write(spec, rows, state["buckets"])
        parts, repeats = self._measure(spec, folder, written, delta=True)
        if repeats:
            self._discard(spec, folder)
            if on_duplicate == "error":
                raise DuplicateKeyError(f"{spec.name}: duplicate values of {spec.key!r} in batch")
            # Most batches have no repeats and need no pass that picks the last.
            folder, written = self._write(spec, keep_last(rows, spec.key, order), state["buckets"])
            parts, _ = self._measure(spec, folder, written, delta=True)
        if parts or batch is not None:
            self._add(spec, folder, parts, state["buckets"], state["epoch"], batch)
        return sum(p["rows"] for p in parts.values())

    def truncate(self, spec: TableSpec) -> int:
        """Delete every row; returns how many there were."""
        n = self.count(spec)
        self.recreate(spec)
        return n

    # -- maintenance ----------------------------------------------------
    def _tidy(self, spec: TableSpec, state: dict, touched: set[int]) -> None:
        """Compact touched buckets that have grown too many parts or deltas."""
        due = []
        for b in touched:
            ps = state["parts"][b]
            old = sum(p["rows"] for p in ps if not p["delta"])
            new = sum(p["rows"] for p in ps if p["delta"])
            if len(ps) > self.max_parts or (len(ps) > 2 and new > max(old, 1) and any(p["delta"] for p in ps)):
                due.append(b)
        if due:
            self.compact(spec, due)

    def compact(self, spec: TableSpec, buckets: list[int] | None = None) -> int:
        """Rewrite buckets (those with deltas or several parts, unless told) as one part
        each; returns how many.  Parts that another writer adds meanwhile stay."""
        state = self._created(spec)
        if buckets is None:
            buckets = [b for b, ps in state["parts"].items() if len(ps) > 1 or any(p["delta"] for p in ps)]
        old = {b: state["parts"][b] for b in buckets if state["parts"].get(b)}
        if not old:
            return 0
        folder, written = self._write(spec, self._resolve(spec, old), state["buckets"])
        parts, _ = self._measure(spec, folder, written, delta=False)

        def change(now: dict) -> dict:
            if (now["buckets"], now["epoch"]) != (state["buckets"], state["epoch"]):
                raise ConflictError(f"{spec.name} was replaced or rebucketed meanwhile")
            for b, ps in old.items():
                mine = now["parts"].get(b, [])
                # Compacted by another writer: leave its work.
                if mine[:len(ps)] == ps:
                    now["parts"][b] = [{**parts[b], "seq": ps[-1]["seq"]}, *mine[len(ps):]]
            return now

        try:
            self._commit(spec, change)
        except ConflictError:
            self._discard(spec, folder)
            return 0
        return len(old)

    def rebucket(self, spec: TableSpec, buckets: int) -> None:
        """Rewrite the table with another bucket count."""
        state = self._created(spec)
        folder, parts = None, {}
        if state["parts"]:
            folder, written = self._write(spec, self._resolve(spec, state["parts"]), buckets)
            parts, _ = self._measure(spec, folder, written, delta=False)

        def change(now: dict) -> dict:
            if now["number"] != state["number"]:
                raise ConflictError(f"{spec.name} was written meanwhile")
            return {**now, "buckets": buckets, "epoch": now["epoch"] + 1,
                    "parts": {b: [{**p, "seq": now["number"] + 1}] for b, p in parts.items()}}

        try:
            self._commit(spec, change)
        except ConflictError:
            if folder:
                self._discard(spec, folder)
            raise

    def vacuum(self, spec: TableSpec) -> int:
        """Delete folders and states that the current state doesn't need;
        call it when no reader or writer is at work.  Returns how many."""
        state = self._state(spec)
        if state is None:
            return 0
        keep = {f"{STATE}{state['number']}.json", *(p["folder"] for ps in state["parts"].values() for p in ps)}
        gone = [n for n in list_names(self.spark, self.path(spec)) or [] if n not in keep]
        for n in gone:
            delete_path(self.spark, f"{self.path(spec)}/{n}")
        return len(gone)


def _within(part: dict, since: dt.datetime | None, until: dt.datetime | None) -> bool:
    """Whether a part may hold a row of the time range (rows without a time lie
    in none)."""
    first, last = part["time"] or (None, None)
    if first is None:
        return False
    return not ((since is not None and last < _time(since)) or (until is not None and first >= _time(until)))


def _in_range(spec: TableSpec, since: dt.datetime | None, until: dt.datetime | None):
    column = next((F.col(f.name) for f in spec.fields if f.kind == "datetime"), None)
    if column is None:
        raise ValueError(f"{spec.name} has no time column")
    tests = [column >= F.lit(_time(since)).cast("timestamp_ntz")] if since is not None else []
    tests += [column < F.lit(_time(until)).cast("timestamp_ntz")] if until is not None else []
    return reduce(lambda a, b: a & b, tests)
