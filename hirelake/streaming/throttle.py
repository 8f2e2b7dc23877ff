"""T2 on a stream: the rate limiter as a stateful operator.

Rejected events do not count, so the outcome depends on the order of events,
and an event may arrive after later ones.  Events therefore wait in the key's state
until the watermark has passed them; they are then decided in (ts, id) order,
just as the batch operator decides them.  State per key is the accepted
times still inside the window (at most ``M``) and the events of the last
``lateness`` of stream time.  An event comes out once, one watermark after it came
in; the stream's last events come out when later ones (or a heartbeat of the
source) move the watermark on.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from hirelake.operators.rate import US, epoch_micros, replay_limiter
from hirelake.spec import RATE_MAX_REQUESTS, RATE_WINDOW_SECONDS


def throttle_stream(events: DataFrame, key: str, ts: str, id_col: str,
                    window_seconds: float = RATE_WINDOW_SECONDS,
                    max_accepted: int = RATE_MAX_REQUESTS,
                    lateness: str = "0 seconds") -> DataFrame:
    """Streaming twin of :func:`hirelake.operators.rate.throttle_flags`:
    emits (id, key, ts, ok) once per event (append mode).

    Events later than ``lateness`` behind the newest are dropped by the
    watermark.  A NULL key is a key of its own; events without a time are
    accepted as they come."""
    w_us = int(window_seconds * US)
    rows = events.select(id_col, key, ts)
    # Watermarks need TIMESTAMP; the zone-less time is read as UTC for it.
    src = (rows.where(F.col(ts).isNotNull()).withColumn("_us", epoch_micros(ts))
           .withColumn("_event_time", F.to_utc_timestamp(F.col(ts).cast("timestamp"), "UTC")))
    src = src.withWatermark("_event_time", lateness)
    id_type = rows.schema[id_col].dataType
    out_schema = T.StructType([*rows.schema.fields, T.StructField("ok", T.BooleanType())])
    state_schema = T.StructType([T.StructField("accepted", T.ArrayType(T.LongType())),
                                 T.StructField("us", T.ArrayType(T.LongType())),
                                 T.StructField("ids", T.ArrayType(id_type))])

    def run(k, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        accepted, us, ids = (list(x) for x in state.get) if state.exists else ([], [], [])
        for pdf in pdfs:
            us += pdf["_us"].tolist()
            ids += pdf[id_col].tolist()
        order = sorted(range(len(us)), key=lambda i: (us[i], ids[i]))
        passed = state.getCurrentWatermarkMs() * 1000
        ready = [i for i in order if us[i] <= passed]
        waiting = [i for i in order if us[i] > passed]
        times = np.array([us[i] for i in ready], np.int64)
        if len(ready):
            ok, accepted = replay_limiter(times, w_us, max_accepted, accepted)
            yield pd.DataFrame({id_col: [ids[i] for i in ready], key: [k[0]] * len(ready),
                                ts: pd.to_datetime(times, unit="us"), "ok": ok})
        accepted = [t for t in accepted if t + w_us > passed]
        if not waiting and not accepted:
            if state.exists:
                state.remove()
            return
        state.update((accepted, [us[i] for i in waiting], [ids[i] for i in waiting]))
        wake = us[waiting[0]] if waiting else accepted[-1] + w_us
        state.setTimeoutTimestamp(max(wake // 1000, passed // 1000) + 1)

    timed = src.groupBy(key).applyInPandasWithState(
        run, out_schema, state_schema, "append", GroupStateTimeout.EventTimeTimeout)
    return timed.unionByName(rows.where(F.col(ts).isNull()).withColumn("ok", F.lit(True)))
