"""Payloads arriving in a folder, ingested micro-batch by micro-batch.

``readStream`` over the payload folder feeds ``foreachBatch``, which runs
the same job as the batch intake (validate, FK-check, upsert, count).  Each
table's state records the micro-batch with its rows, in one commit: one that is
retried after a failure writes only the tables it had not reached, and overwrites
its own summary partition, so replays do not double count.  Offsets and the summary live
under the given checkpoint folder, which must be shared storage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hirelake.plans import jobs
from hirelake.session import scratch_scope
from hirelake.sinks.table_store import TableStore
from hirelake.sources.payloads import PAYLOAD_SCHEMA, payload_records, with_order, with_source
from hirelake.spec import GROUP_MAX_ROWS


def start_intake(spark: SparkSession, source: str, store: TableStore, checkpoint: str,
                 multi_line: bool = True, on_duplicate: str = "last",
                 available_now: bool = True, max_files_per_trigger: int | None = None,
                 max_rows: int | None = GROUP_MAX_ROWS):
    """Start the intake stream; returns the ``StreamingQuery``.  ``max_rows``
    is the largest group accepted (``None``: any)."""
    reader = (spark.readStream.schema(PAYLOAD_SCHEMA).option("multiLine", multi_line)
              .option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt"))
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    payloads = with_source(reader.json(source))
    out = checkpoint.rstrip("/")

    def one_batch(batch: DataFrame, batch_id: int) -> None:
        with scratch_scope(spark):
            p = payload_records(with_order(batch, multi_line), max_rows)
            result = jobs.ingest_records(store, p.records, on_duplicate=on_duplicate, batch=(out, batch_id))
            tag = F.lit(batch_id).cast("bigint").alias("batch_id")
            result.summary.select(tag, "*").write.mode("overwrite").parquet(f"{out}/summary/batch_id={batch_id}")
            result.errors.write.mode("overwrite").parquet(f"{out}/errors/batch_id={batch_id}")
            p.rejected.write.mode("overwrite").parquet(f"{out}/rejected/batch_id={batch_id}")

    writer = (payloads.writeStream.foreachBatch(one_batch)
              .option("checkpointLocation", f"{out}/offsets"))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")
    return writer.start()


def intake_summary(spark: SparkSession, checkpoint: str) -> DataFrame:
    """Per table totals over every committed micro-batch."""
    s = spark.read.schema("tabla string, recibidos bigint, validos bigint, upsert bigint, batch_id bigint") \
        .parquet(f"{checkpoint.rstrip('/')}/summary")
    return s.groupBy("tabla").agg(*[F.sum(c).alias(c) for c in ("recibidos", "validos", "upsert")])
