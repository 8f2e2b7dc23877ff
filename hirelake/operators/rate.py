"""Per-key event rates (T2, T3): the service's sliding-window request limit
re-aimed at an event log.

``trailing_count`` (T3) - events of the same key in ``[t - W, t]``: the number
of events up to ``t`` less the number before ``t - W``, both from running
counts over the (key, time) order.

``throttle_flags`` (T2) - the limiter itself: an event is accepted when
fewer than ``M`` *accepted* events of its key lie in ``[t - W, t]``;
rejected events do not count.  Because rejections feed back, the outcome
is order-dependent and no window function expresses it.  The exact split
points are events with no earlier event of their key inside the window
(the limiter's memory is empty there): a running maximum over the same order
tells every event the last of them.  Each (key, segment) is then replayed in time
order by a small pandas helper.  A key that stays above the limit without any gap
forms one segment; if that is long, it is cut into slices that are replayed in
parallel from a guessed state, and again where the guess was wrong, until nothing
changes.

Running counts and maxima (``_running``) are segmented over range partitions: the
(key, time) order is cut into even slices, each slice is summed up on its own, and
what a key carries from slice to slice is one row per (slice, key).  A burst of
one key, even inside a single window, is cut like anything else.

A NULL key is a key of its own, as in GROUP BY.  Events without a time lie
in no window of others: each counts the key's events without a time, and
the limiter accepts them.
"""

from __future__ import annotations

from collections import deque

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hirelake.session import materialize
from hirelake.spec import RATE_MAX_REQUESTS, RATE_WINDOW_SECONDS

US = 1_000_000
#: Stands for NULL among 64-bit values.
NONE = np.iinfo(np.int64).min


def epoch_micros(ts: str) -> Column:
    """Microseconds since 1970 of a zone-less timestamp (no session zone)."""
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', `{ts}`)")


def _key_text(key: str) -> Column:
    """A key as text that is never NULL and keeps NULL apart."""
    return F.when(F.col(key).isNull(), F.lit("n")).otherwise(F.concat(F.lit("v"), F.col(key).cast("string")))


def trailing_count(events: DataFrame, key: str, ts: str, window_seconds: float,
                   out: str = "n", method: str = "ranks", partitions: int | None = None) -> DataFrame:
    """Add ``out`` = number of events of the same key with timestamp in
    ``[ts - W, ts]`` (the event itself included).

    ``method="ranks"`` bounds each task by a range partition of the distinct (key,
    time) points, whatever the skew.  ``method="buckets"`` needs a single shuffle, but
    a task holds one window W of one key's events: for logs without bursts."""
    if method == "ranks":
        return trailing_count_by_ranks(events, key, ts, window_seconds, out, partitions)
    if method != "buckets":
        raise ValueError(f"unknown method {method!r}")
    w_us = int(window_seconds * US)
    base = events.withColumns({"_us": epoch_micros(ts)}).withColumn(
        "_bucket", F.floor(F.col("_us") / w_us))
    self_rows = base.withColumn("_self", F.lit(True))
    context = (base.where("_us is not null").select(key, "_us", (F.col("_bucket") + 1).alias("_bucket"))
               .withColumn("_self", F.lit(False)))
    both = self_rows.unionByName(context, allowMissingColumns=True)
    win = (Window.partitionBy(key, "_bucket").orderBy("_us").rangeBetween(-w_us, 0))
    counted = both.withColumn(out, F.count(F.lit(1)).over(win))
    # Only real rows are kept; the filter sits above the window.
    return counted.where(F.col("_self")).drop("_us", "_bucket", "_self")


def _local(key: str, value: str, kind: str):
    """mapInPandas body over rows sorted by (key, ...) inside a slice: the running sum or
    the latest of ``value`` per key, carried across Arrow batches.  "latest" takes
    values that grow within a key, ``NONE`` where a row has none."""
    def run(batches):
        last_key, carry = None, 0
        for pdf in batches:
            if pdf.empty:
                continue
            k = pdf[key].to_numpy()
            first = np.ones(len(pdf), dtype=bool)
            first[1:] = k[1:] != k[:-1]
            open_run = last_key is not None and k[0] == last_key
            starts = np.maximum.accumulate(np.where(first, np.arange(len(pdf)), 0))
            if kind == "sum":
                w = pdf[value].to_numpy(dtype=np.int64)
                total = np.cumsum(w)
                local = total - (total[starts] - w[starts])
                local[starts == 0] += carry if open_run else 0
            else:
                v = pdf[value].to_numpy(dtype=np.int64)
                at = np.maximum.accumulate(np.where(v != NONE, np.arange(len(pdf)), -1))
                local = np.where(at >= starts, v[np.maximum(at, 0)], NONE)
                if open_run:
                    local[(starts == 0) & (at < 0)] = carry
            last_key, carry = k[-1], int(local[-1])
            yield pdf.assign(_local=local)
    return run


def _running(rows: DataFrame, key: str, order: str, value: str, kind: str, out: str, label: str,
             partitions: int | None = None) -> DataFrame:
    """``rows`` (written out) with ``out`` in place of ``value``: the running "sum" of ``value`` within ``key`` by
    ``order``, or the "latest" value up to each row (NULL before the first).

    Without an explicit partition count AQE may merge neighbouring ranges, which
    keeps every slice contiguous."""
    ranged = (rows.withColumn("_value", F.coalesce(F.col(value).cast("bigint"), F.lit(NONE if kind == "latest" else 0)))
              .repartitionByRange(*([partitions] if partitions else []), key, order)
              .sortWithinPartitions(key, order).withColumn("_pid", F.spark_partition_id()))
    ranged = ranged.drop(value)
    schema = T.StructType([*ranged.schema.fields, T.StructField("_local", T.LongType())])
    local = materialize(ranged.mapInPandas(_local(key, "_value", kind), schema), label)
    # What a slice adds to its keys, and what earlier slices carry into it.
    fold = F.sum if kind == "sum" else F.max
    own = local.groupBy("_pid", key).agg(fold("_value").alias("_own"))
    before = Window.partitionBy(key).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    carried = own.select("_pid", key, fold("_own").over(before).alias("_carry"))
    joined = local.join(carried, ["_pid", key])
    if kind == "sum":
        total = F.col("_local") + F.coalesce("_carry", F.lit(0))
    else:
        total = F.nullif(F.greatest("_local", F.coalesce("_carry", F.lit(NONE))), F.lit(NONE))
    return joined.withColumn(out, total).drop("_pid", "_local", "_carry", "_value")


def _counted_points(points: DataFrame, w_us: int, out: str, partitions: int | None) -> DataFrame:
    """Distinct points ``(_k, _us, _m)`` (``_m``: events at that time) with ``out``, the
    events of their key in ``[_us - W, _us]``.

    Each point is an event (weight ``_m``) and a probe at ``_us - W`` (weight 0); a
    probe comes before an event at its place, so it counts events strictly before."""
    rows = (points.select("_k", F.col("_us").alias("_src"), (F.col("_us") * 2 + 1).alias("_c"), F.col("_m").alias("_w"), "_m")
            .unionByName(points.select("_k", F.col("_us").alias("_src"), ((F.col("_us") - w_us) * 2).alias("_c"),
                                       F.lit(0).cast("bigint").alias("_w"), "_m")))
    ranked = _running(rows, "_k", "_c", "_w", "sum", "_rank", "trailing-ranks", partitions)
    events = F.col("_c") % 2 == 1
    # Both counts of a point meet in one aggregate.
    return (ranked.groupBy("_k", F.col("_src").alias("_us")).agg(
        F.max("_m").alias("_m"), (F.max(F.when(events, F.col("_rank"))) - F.max(F.when(~events, F.col("_rank")))).alias(out)))


def _points(timed: DataFrame) -> DataFrame:
    return timed.groupBy("_k", "_us").agg(F.count(F.lit(1)).alias("_m"))      # map-side combined


def trailing_count_by_ranks(events: DataFrame, key: str, ts: str, window_seconds: float,
                            out: str = "n", partitions: int | None = None) -> DataFrame:
    """T3 through global ranks, with no task ever holding one key's window.

    An equi-join on (key, time) puts the counts of the points back on the events
    (AQE splits a hot join key)."""
    w_us = int(window_seconds * US)
    timed = events.withColumns({"_us": epoch_micros(ts), "_k": _key_text(key)})
    ev = timed.where("_us is not null")
    counts = _counted_points(_points(ev), w_us, out, partitions).drop("_m")
    untimed = timed.where("_us is null")
    alone = untimed.groupBy("_k").agg(F.count(F.lit(1)).alias(out))
    columns = [*events.columns, out]
    return (ev.join(counts, ["_k", "_us"]).select(*columns)
            .unionAll(untimed.join(alone, "_k").select(*columns)))


def _segments(events: DataFrame, key: str, ts: str, w_us: int, partitions: int | None = None) -> DataFrame:
    """Events with ``_n`` (trailing count) and ``_segment``, the time of the latest
    reset point at or before each (a reset point has no earlier event of its key
    within ``W``: all events in its window are of its own time)."""
    timed = events.withColumns({"_us": epoch_micros(ts), "_k": _key_text(key)})
    points = _counted_points(_points(timed), w_us, "_n", partitions).withColumn(
        "_reset", F.when(F.col("_n") == F.col("_m"), F.col("_us")))
    points = _running(points, "_k", "_us", "_reset", "latest", "_segment", "limiter-points", partitions)
    return timed.join(points.select("_k", "_us", "_n", "_segment"), ["_k", "_us"])


def replay_limiter(us: np.ndarray, window_us: int, max_accepted: int,
                   accepted: list[int] | None = None) -> tuple[np.ndarray, list[int]]:
    """Run the limiter over sorted times; returns the accept flags and the
    accepted times still inside the window (the state to carry on)."""
    keep: deque[int] = deque(accepted or [])
    ok = np.zeros(len(us), dtype=bool)
    for i, t in enumerate(us.tolist()):
        cutoff = t - window_us
        while keep and keep[0] < cutoff:
            keep.popleft()
        if len(keep) < max_accepted:
            keep.append(t)
            ok[i] = True
    return ok, list(keep)


def _decide(pdf: pd.DataFrame, w_us: int, max_accepted: int, group, keep: list[int]):
    """Accept flags of events sorted by (key, segment, time), given the open
    (key, segment) before them and its accepted times inside the window;
    also the group and times that are open after them."""
    k, seg, us = pdf["_k"].to_numpy(), pdf["_segment"].to_numpy(), pdf["_us"].to_numpy()
    # An event with at most M events (itself included) in its window
    # is accepted whatever happened before: no replay needed.
    ok = pdf["_n"].to_numpy() <= max_accepted
    change = np.ones(len(pdf), dtype=bool)
    change[1:] = (k[1:] != k[:-1]) | (seg[1:] != seg[:-1])
    starts = np.flatnonzero(change)
    ends = np.append(starts[1:], len(pdf))
    run_of = np.cumsum(change) - 1
    carried = keep if (k[0], seg[0]) == group else []
    last = len(starts) - 1
    last_keep = None
    # Replay only runs with a contended event, from that event on.
    for r in np.unique(run_of[~ok]).tolist():
        a, b = starts[r], ends[r]
        j = a + int(np.flatnonzero(~ok[a:b])[0])
        lo = us[j] - w_us
        before = us[a:j]
        init = [x for x in (carried if r == 0 else []) if x >= lo]
        init += before[before >= lo].tolist()
        ok[j:b], state = replay_limiter(us[j:b], w_us, max_accepted, init)
        if r == last:
            last_keep = state
    if last_keep is None:
        # The open run ends uncontended: its window holds only
        # accepted events (at most M of them).
        lo = us[-1] - w_us
        tail = us[starts[last]:]
        last_keep = [x for x in (carried if last == 0 else []) if x >= lo]
        last_keep += tail[tail >= lo].tolist()
    return ok, (k[-1], int(seg[-1])), [int(x) for x in last_keep]


def _replay_slices(rows: DataFrame, id_col: str, key: str, ts: str, w_us: int, max_accepted: int,
                   slices: int | None) -> DataFrame:
    """The limiter over segments too long for one task.

    The events are cut into even slices of the (key, segment, time) order by
    a range partitioning, and all slices are replayed at once, each as if
    nothing were open before it.  Then the slices whose predecessor left
    something else open are replayed again, until nothing changes: the result is
    that of one pass.  Per slice, its first and last group and at most ``M``
    times reach the driver."""
    spark = rows.sparkSession
    order = ["_k", "_segment", "_us", id_col]
    cut = materialize(rows.repartitionByRange(*([slices] if slices else []), *order)
                      .withColumn("_slice", F.spark_partition_id()), "limiter-slices")
    fields = [*rows.select(id_col, key, ts).schema.fields, T.StructField("ok", T.BooleanType())]
    schema = T.StructType([*fields, T.StructField("_slice", T.IntegerType()), T.StructField("_open", T.ArrayType(T.StringType()))])

    def replay(part: DataFrame, before: dict[int, tuple]) -> DataFrame:
        def run(batches):
            now, first, group, keep = None, None, None, []

            def state():
                # A row without an event: the slice's first and last group, then the times.
                words = [first[0], str(first[1]), group[0], str(group[1]), *map(str, keep)]
                return pd.DataFrame({id_col: [None], key: [None], ts: [pd.NaT], "ok": [None], "_slice": [now], "_open": [words]})

            for pdf in batches:
                for number, part_ in pdf.groupby("_slice", sort=True):
                    if number != now:
                        if now is not None:
                            yield state()
                        now, (group, keep) = int(number), before.get(int(number), (None, []))
                        first = (part_["_k"].iloc[0], int(part_["_segment"].iloc[0]))
                    ok, group, keep = _decide(part_, w_us, max_accepted, group, keep)
                    yield pd.DataFrame({id_col: part_[id_col], key: part_[key], ts: part_[ts], "ok": ok,
                                        "_slice": now, "_open": None})
            if now is not None:
                yield state()

        ordered = part.repartition("_slice").sortWithinPartitions("_slice", *order)
        return materialize(ordered.mapInPandas(run, schema), "limiter-flags")

    used: dict[int, tuple] = {}
    ends: dict[int, tuple] = {}
    done: list[tuple[DataFrame, set[int]]] = []
    part, todo = cut, None
    while todo is None or todo:
        flags = replay(part, used)
        for r in flags.where("_open is not null").select("_slice", "_open").collect():
            a, b, c, d, *times = r["_open"]
            ends[r["_slice"]] = ((a, int(b)), (c, int(d)), [int(t) for t in times])
        redone = set(ends) if todo is None else todo
        done = [(df, own - redone) for df, own in done] + [(flags, redone)]
        found, last = {}, None
        for number in sorted(ends):
            first, group, keep = ends[number]
            if last is not None and last[0] == first and last[1]:
                found[number] = last
            last = (group, keep)
        todo = {n for n in ends if found.get(n, (None, []))[1] != used.get(n, (None, []))[1]}
        used = found
        part = cut.where(F.col("_slice").isin(sorted(todo)))
    out = None
    for df, own in done:
        if own:
            kept = df.where(F.col("_open").isNull() & F.col("_slice").isin(sorted(own))).select(id_col, key, ts, "ok")
            out = kept if out is None else out.unionAll(kept)
    return out if out is not None else spark.createDataFrame([], T.StructType(fields))


def throttle_flags(events: DataFrame, key: str, ts: str, id_col: str,
                   window_seconds: float = RATE_WINDOW_SECONDS,
                   max_accepted: int = RATE_MAX_REQUESTS,
                   partitions: int | None = None, segment_rows: int = 1_000_000) -> DataFrame:
    """(id, key, ts, ok) with ``ok`` false for events the limiter
    rejects.  Events of a key are taken in (ts, id) order.

    Segments are hash-partitioned on (key, segment) and sorted inside each
    partition; a pandas pass over the partition's Arrow batches decides
    every uncontended event at once (at most ``M`` events in its window:
    accepted whatever came before) and replays the limiter only from the
    first contended event of a segment, carrying at most ``M`` accepted
    times from batch to batch.  No group is ever held whole in memory.
    Segments of more than ``segment_rows`` events are cut into slices (see
    :func:`_replay_slices`); the flags are the same either way."""
    w_us = int(window_seconds * US)
    rows = events.select(id_col, key, ts)
    seg = materialize(_segments(rows.where(F.col(ts).isNotNull()), key, ts, w_us, partitions), "limiter-segments")
    long = (seg.groupBy("_k", "_segment").agg(F.count(F.lit(1)).alias("_rows"))
            .where(F.col("_rows") > segment_rows).select("_k", "_segment"))
    cut = not long.isEmpty()
    short = seg.join(long, ["_k", "_segment"], "left_anti") if cut else seg
    ordered = (short.repartition(*([partitions] if partitions else []), "_k", "_segment")
               .sortWithinPartitions("_k", "_segment", "_us", id_col))
    out_schema = T.StructType([*rows.schema.fields, T.StructField("ok", T.BooleanType())])

    def run(batches):
        group, keep = None, []
        for pdf in batches:
            if not pdf.empty:
                ok, group, keep = _decide(pdf, w_us, max_accepted, group, keep)
                yield pd.DataFrame({id_col: pdf[id_col], key: pdf[key], ts: pdf[ts], "ok": ok})

    out = ordered.mapInPandas(run, out_schema)
    if cut:
        hot = seg.join(long, ["_k", "_segment"], "left_semi")
        out = out.unionByName(_replay_slices(hot, id_col, key, ts, w_us, max_accepted, partitions))
    return out.unionByName(rows.where(F.col(ts).isNull()).withColumn("ok", F.lit(True)))
