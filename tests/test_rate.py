import datetime as dt
import random

from pyspark.sql import functions as F

from hirelake.operators import rate
from hirelake.plans.queries_rate import throttle_stream_query
from hirelake.session import scratch_dir
from hirelake.streaming.throttle import throttle_stream


def events(spark, n=600, seed=7):
    rnd = random.Random(seed)
    base = dt.datetime(2024, 1, 1)
    rows = []
    for i in range(n):
        user = 1 if rnd.random() < 0.4 else rnd.randint(2, 6)   # user 1 is hot
        t = base + dt.timedelta(seconds=rnd.randint(0, 3 * 86400), microseconds=rnd.randint(0, 999999))
        rows.append((i, user, t))
    return rows, spark.createDataFrame(rows, "event_id bigint, user_id bigint, ts timestamp_ntz")


def brute_trailing(rows, w):
    out = {}
    for i, u, t in rows:
        out[i] = sum(1 for _, u2, t2 in rows if u2 == u and t - w <= t2 <= t)
    return out


def brute_throttle(rows, w, m):
    out = {}
    by_user = {}
    for i, u, t in sorted(rows, key=lambda r: (r[2], r[0])):
        acc = [x for x in by_user.get(u, []) if x >= t - w]
        out[i] = len(acc) < m
        if out[i]:
            acc.append(t)
        by_user[u] = acc
    return out


def test_trailing_count_matches_brute_force(spark):
    rows, df = events(spark)
    w = dt.timedelta(hours=1)
    got = {r.event_id: r.n for r in rate.trailing_count(df, "user_id", "ts", 3600).collect()}
    assert got == brute_trailing(rows, w)


def test_throttle_matches_brute_force(spark):
    rows, df = events(spark)
    for w_s, m in ((3600, 2), (6 * 3600, 3), (60, 1)):
        got = {r.event_id: r.ok for r in rate.throttle_flags(df, "user_id", "ts", "event_id", w_s, m).collect()}
        assert got == brute_throttle(rows, dt.timedelta(seconds=w_s), m), (w_s, m)


def run_stream(spark, files, w_s, m, lateness):
    """The stream over one file a micro-batch, then a heartbeat."""
    schema = "event_id bigint, user_id bigint, ts timestamp_ntz"
    src, out = scratch_dir(spark, "t-src"), scratch_dir(spark, "t-out")
    last = max(t for f in files for _, _, t in f if t)
    for rows in [*files, [(-1, None, last + dt.timedelta(days=30))]]:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
    q = (throttle_stream(stream, "user_id", "ts", "event_id", w_s, m, lateness=lateness)
         .writeStream.format("parquet").option("path", f"{out}/d").option("checkpointLocation", f"{out}/c")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    got = spark.read.parquet(f"{out}/d").where("event_id >= 0").collect()
    assert len({r.event_id for r in got}) == len(got)
    return {r.event_id: r.ok for r in got}


def test_throttle_stream_equals_batch_out_of_order(spark):
    rows, _ = events(spark, n=240, seed=3)
    rnd = random.Random(1)
    late = sorted(rows, key=lambda r: r[2] + dt.timedelta(seconds=rnd.randint(0, 5000)))
    files = [late[:80], late[80:160], late[160:]]
    got = run_stream(spark, files, 3600, 2, "5001 seconds")
    assert got == brute_throttle(rows, dt.timedelta(hours=1), 2)


def test_throttle_stream_query_over_events_in_many_files(spark, tmp):
    # Each delivery is written in several files; none of its events may be late for another.
    rows, df = events(spark, n=400, seed=5)
    df.repartition(8).write.option("parquet.block.size", 1024).parquet(f"{tmp}/events.parquet")
    got = {r.event_id: r.ok for r in throttle_stream_query(spark, tmp).collect()}
    assert got == brute_throttle(rows, dt.timedelta(hours=6), 2)


def test_stream_decides_a_late_event_first(spark):
    base = dt.datetime(2024, 1, 1)
    files = [[(1, 1, base + dt.timedelta(seconds=300))], [(2, 1, base + dt.timedelta(seconds=280)), (3, 1, None)]]
    assert run_stream(spark, files, 60, 1, "60 seconds") == {1: False, 2: True, 3: True}


def test_null_keys_and_times_are_kept(spark):
    t = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([(1, None, t), (2, None, t), (3, 7, None), (4, 7, None), (5, 7, t)],
                               "event_id bigint, user_id bigint, ts timestamp_ntz")
    for method in ("buckets", "ranks"):
        got = {r.event_id: r.n for r in rate.trailing_count(df, "user_id", "ts", 60, method=method).collect()}
        assert got == {1: 2, 2: 2, 3: 2, 4: 2, 5: 1}, method
    got = {r.event_id: r.ok for r in rate.throttle_flags(df, "user_id", "ts", "event_id", 60, 1).collect()}
    assert got == {1: True, 2: False, 3: True, 4: True, 5: True}


from hypothesis import given, settings, strategies as st  # noqa: E402


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 3), st.integers(0, 20_000)), min_size=1, max_size=60,
                unique_by=lambda x: x),
       st.integers(1, 3), st.sampled_from([10, 300, 3600]))
def test_throttle_property(spark, evs, m, w):
    base = dt.datetime(2024, 1, 1)
    rows = [(i, u, base + dt.timedelta(seconds=s)) for i, (u, s) in enumerate(evs)]
    df = spark.createDataFrame(rows, "event_id bigint, user_id bigint, ts timestamp_ntz")
    got = {r.event_id: r.ok for r in rate.throttle_flags(df, "user_id", "ts", "event_id", w, m).collect()}
    assert got == brute_throttle(rows, dt.timedelta(seconds=w), m)


def test_trailing_count_by_ranks_matches_brute_force(spark):
    rows, df = events(spark, n=500, seed=11)
    # duplicate timestamps of one key must count each other
    rows = rows + [(1000 + i, 1, rows[0][2]) for i in range(3)]
    df = spark.createDataFrame(rows, "event_id bigint, user_id bigint, ts timestamp_ntz")
    for w in (60, 3600, 86400):
        got = {r.event_id: r.n for r in rate.trailing_count(df, "user_id", "ts", w, method="ranks").collect()}
        assert got == brute_trailing(rows, dt.timedelta(seconds=w)), w


def test_throttle_state_carries_across_arrow_batches(spark):
    rows, df = events(spark, n=400, seed=5)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        for w_s, m in ((3600, 2), (6 * 3600, 3)):
            got = {r.event_id: r.ok
                   for r in rate.throttle_flags(df, "user_id", "ts", "event_id", w_s, m, partitions=2).collect()}
            assert got == brute_throttle(rows, dt.timedelta(seconds=w_s), m), (w_s, m)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_hot_segment_is_cut_into_slices(spark):
    """One key that never pauses, a third of all events: the flags are those of
    one pass, and no slice holds much more than its share."""
    base = dt.datetime(2024, 1, 1)
    rows = [(i, None if i % 3 == 1 else 5, base + dt.timedelta(seconds=i * 7 % 4001)) for i in range(900)]
    rows += [(2000 + i, 6, base + dt.timedelta(seconds=900 * i)) for i in range(300)]
    df = spark.createDataFrame(rows, "event_id bigint, user_id bigint, ts timestamp_ntz")
    for w_s, m in ((40, 1), (90, 4)):
        want = brute_throttle(rows, dt.timedelta(seconds=w_s), m)
        got = {r.event_id: r.ok for r in rate.throttle_flags(
            df, "user_id", "ts", "event_id", w_s, m, partitions=6, segment_rows=20).collect()}
        assert got == want
    seg = rate._segments(df, "user_id", "ts", 40_000_000)
    sizes = [r["count"] for r in seg.repartitionByRange(6, "_k", "_segment", "_us", "event_id")
             .groupBy(F.spark_partition_id()).count().collect()]
    assert max(sizes) < 2 * len(rows) / 6


def test_a_burst_inside_one_window_is_cut_into_even_tasks(spark, monkeypatch):
    """Half of all events are one key's within a minute: what is written of the running
    passes holds even slices, and flags and counts are those of the brute force."""
    base = dt.datetime(2024, 1, 1)
    rows = [(i, 9, base + dt.timedelta(microseconds=50_000 * i)) for i in range(1200)]
    rows += [(5000 + i, i % 7, base + dt.timedelta(seconds=40 * i)) for i in range(1200)]
    df = spark.createDataFrame(rows, "event_id bigint, user_id bigint, ts timestamp_ntz")
    written = {}
    original = rate.materialize

    def watching(frame, label, *args):
        out = original(frame, label, *args)
        written.setdefault(label, []).append(out)
        return out

    monkeypatch.setattr(rate, "materialize", watching)
    got = {r.event_id: r.n for r in rate.trailing_count(df, "user_id", "ts", 60, partitions=8).collect()}
    assert got == brute_trailing(rows, dt.timedelta(seconds=60))
    flags = {r.event_id: r.ok for r in rate.throttle_flags(df, "user_id", "ts", "event_id", 60, 5, partitions=8).collect()}
    assert flags == brute_throttle(rows, dt.timedelta(seconds=60), 5)
    for label in ("trailing-ranks", "limiter-points"):
        for frame in written[label]:
            sizes = [r["count"] for r in frame.groupBy("_pid").count().collect()]
            assert len(sizes) >= 6 and max(sizes) < 2 * sum(sizes) / 8, label


def test_latest_reset_carries_over_slices_and_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        rows = [(k, t, t if t % 17 == 5 else None) for k in ("a", "b", "c") for t in range(60)]
        df = spark.createDataFrame(rows, "_k string, _us bigint, _v bigint")
        for parts in (1, 7):
            got = {(r["_k"], r["_us"]): r["_s"] for r in
                   rate._running(df, "_k", "_us", "_v", "latest", "_s", "latest", parts).collect()}
            assert got == {(k, t): (t - 5) // 17 * 17 + 5 if t >= 5 else None for k, t, _ in rows}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
