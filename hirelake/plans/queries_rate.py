"""Event-rate and streaming queries on ``events`` and on
payloads built from the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hirelake.operators import rate
from hirelake.plans.queries_io import INGEST_SUMMARY_SQL, _store, write_payloads
from hirelake.plans.registry import register
from hirelake.plans.tables import table
from hirelake.session import scratch_dir
from hirelake.streaming.intake import intake_summary, start_intake
from hirelake.streaming.throttle import throttle_stream

TRAILING_SECONDS = 3600          # T3 window
THROTTLE_SECONDS = 6 * 3600      # T2 window
THROTTLE_MAX = 2                 # T2 accepted events per window

_W_US = THROTTLE_SECONDS * 1_000_000


TRAILING_SQL = f"""
SELECT event_id, user_id, ts,
       COUNT(*) OVER (PARTITION BY user_id ORDER BY ts
                      RANGE BETWEEN INTERVAL {TRAILING_SECONDS} SECOND PRECEDING AND CURRENT ROW) AS n
FROM events
"""


@register("trailing_rate", TRAILING_SQL)
def trailing_rate(spark, sf):
    ev = table(spark, sf, "events").select("event_id", "user_id", "ts")
    return rate.trailing_count(ev, "user_id", "ts", TRAILING_SECONDS)


@register("trailing_rate_ranks", TRAILING_SQL)
def trailing_rate_ranks(spark, sf):
    """T3 by global ranks: no task holds a key's window, however hot."""
    ev = table(spark, sf, "events").select("event_id", "user_id", "ts")
    return rate.trailing_count(ev, "user_id", "ts", TRAILING_SECONDS, method="ranks")


THROTTLE_SQL = f"""
WITH RECURSIVE e AS (
  SELECT event_id, user_id, epoch_us(ts) AS us,
         row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn
  FROM events),
r AS (
  SELECT event_id, user_id, rn, [us]::BIGINT[] AS acc, true AS ok FROM e WHERE rn = 1
  UNION ALL
  SELECT e.event_id, e.user_id, e.rn,
    CASE WHEN len(list_filter(r.acc, lambda x: x >= e.us - {_W_US})) < {THROTTLE_MAX}
         THEN list_append(list_filter(r.acc, lambda x: x >= e.us - {_W_US}), e.us)
         ELSE list_filter(r.acc, lambda x: x >= e.us - {_W_US}) END,
    len(list_filter(r.acc, lambda x: x >= e.us - {_W_US})) < {THROTTLE_MAX}
  FROM r JOIN e ON e.user_id = r.user_id AND e.rn = r.rn + 1)
SELECT event_id, ok FROM r
"""


@register("throttle_flags", THROTTLE_SQL)
def throttle_flags(spark, sf):
    ev = table(spark, sf, "events")
    return rate.throttle_flags(ev, "user_id", "ts", "event_id", THROTTLE_SECONDS,
                               THROTTLE_MAX).select("event_id", "ok")


_NULLS_SQL = """(SELECT event_id, CASE WHEN user_id % 10 <> 3 THEN user_id END AS user_id,
    CASE WHEN event_id % 7 <> 2 THEN ts END AS ts FROM events)"""
NULL_KEYS_SQL = f"""
SELECT event_id, COUNT(*) OVER (PARTITION BY user_id ORDER BY ts
                 RANGE BETWEEN INTERVAL {TRAILING_SECONDS} SECOND PRECEDING AND CURRENT ROW) AS n
FROM {_NULLS_SQL} e WHERE ts IS NOT NULL
UNION ALL
SELECT event_id, COUNT(*) OVER (PARTITION BY user_id) AS n FROM {_NULLS_SQL} e WHERE ts IS NULL
"""


def _with_nulls(spark, sf):
    """Events of which some have no user (one key) and some no time."""
    return table(spark, sf, "events").select(
        "event_id", F.when(F.col("user_id") % 10 != 3, F.col("user_id")).alias("user_id"),
        F.when(F.col("event_id") % 7 != 2, F.col("ts")).alias("ts"))


@register("trailing_rate_null_keys", NULL_KEYS_SQL)
def trailing_rate_null_keys(spark, sf):
    """T3 keeps rows without a key or a time, by windows ..."""
    return rate.trailing_count(_with_nulls(spark, sf), "user_id", "ts", TRAILING_SECONDS).select("event_id", "n")


@register("trailing_rate_ranks_null_keys", NULL_KEYS_SQL)
def trailing_rate_ranks_null_keys(spark, sf):
    """... and by ranks."""
    return rate.trailing_count(_with_nulls(spark, sf), "user_id", "ts", TRAILING_SECONDS,
                               method="ranks").select("event_id", "n")


STREAM_FILES = 5                 # micro-batches of the stream query
STREAM_DISORDER_SECONDS = 3600   # how far events of one time are spread over them


def event_log(spark, sf) -> list[DataFrame]:
    """``events`` as a log of ``STREAM_FILES`` deliveries by time, where every
    event is up to an hour late, and a heartbeat after them."""
    ev = table(spark, sf, "events").select("event_id", "user_id", "ts")
    us = rate.epoch_micros("ts")
    late = us + (F.col("event_id") * 7919 % STREAM_DISORDER_SECONDS) * 1_000_000
    span = ev.agg(F.min(us).alias("a"), F.max(us).alias("b")).first()
    width = (span["b"] - span["a"] + STREAM_DISORDER_SECONDS * 1_000_000) // STREAM_FILES + 1
    part = F.least(F.floor((late - span["a"]) / width), F.lit(STREAM_FILES - 1))
    beat = F.timestamp_micros(F.lit(span["b"] + 3 * _W_US)).cast("timestamp_ntz")
    last = spark.range(1).select(F.lit(-1).cast("long").alias("event_id"), F.lit(None).cast("long").alias("user_id"),
                                 beat.alias("ts"))
    return [*(ev.where(part == k) for k in range(STREAM_FILES)), last]


@register("throttle_stream", THROTTLE_SQL)
def throttle_stream_query(spark, sf):
    """T2 as a stream over a log whose events arrive out of order within an
    hour, drained into a Parquet sink after each delivery.

    A delivery is one micro-batch, whatever number of files it is written in: files of
    one time span taken one after the other would be late for each other, and the
    stream's state would be gone over once a file."""
    log = event_log(spark, sf)
    src = scratch_dir(spark, "events-src")
    log[0].write.parquet(src)  # the folder of a stream must exist
    out = scratch_dir(spark, "throttle-out")
    schema = table(spark, sf, "events").select("event_id", "user_id", "ts").schema
    stream = spark.readStream.schema(schema).parquet(src)
    flags = throttle_stream(stream, "user_id", "ts", "event_id", THROTTLE_SECONDS, THROTTLE_MAX,
                            lateness=f"{STREAM_DISORDER_SECONDS + 1} seconds")
    # The state store has one partition per shuffle partition, fixed when the
    # query first starts (the conf is read at start): size it to the cores.  What a
    # delivery's watermark decides comes out with the next one, and at the end.
    shuffle, idle = "spark.sql.shuffle.partitions", "spark.sql.streaming.noDataMicroBatches.enabled"
    before = {key: spark.conf.get(key) for key in (shuffle, idle)}
    for n, rows in enumerate(log):
        if n > 0:
            rows.write.mode("append").parquet(src)
        spark.conf.set(shuffle, str(spark.sparkContext.defaultParallelism))
        spark.conf.set(idle, str(n == len(log) - 1).lower())
        try:
            q = (flags.writeStream.format("parquet").option("path", f"{out}/data")
                 .option("checkpointLocation", f"{out}/chk").outputMode("append")
                 .trigger(availableNow=True).start())
        finally:
            for key, value in before.items():
                spark.conf.set(key, value)
        q.awaitTermination()
    return spark.read.parquet(f"{out}/data").where("event_id >= 0").select("event_id", "ok")


@register("stream_ingest", INGEST_SUMMARY_SQL)
def stream_ingest(spark, sf):
    """The payload files consumed as a stream (one availableNow run)."""
    source = write_payloads(spark, sf)
    store = _store(spark, "stream-store")
    chk = scratch_dir(spark, "stream-chk")
    q = start_intake(spark, source, store, chk, multi_line=False, on_duplicate="error")
    q.awaitTermination()
    return intake_summary(spark, chk)
