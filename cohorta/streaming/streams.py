"""Structured Streaming jobs: receipts -> sinks, dedup, activity.

Each stream reads Parquet files (a Kafka source can be swapped in with
``spark.readStream.format("kafka")``), keeps its progress in a checkpoint
under the shared folder, and writes with ``foreachBatch``.  A batch may run
again after a failure anywhere: subscriber deltas and api logs are merged by
key, and everything else is added only if the sink does not hold it.  No row
is dropped for being late.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohorta.plans.importer import canonical_activity
from cohorta.plans.launch import apply_receipt_batch
from cohorta.schema import RECEIPT
from cohorta.sources.warehouse import Warehouse

RECEIPT_SCHEMA = T.StructType([f for f in RECEIPT.fields if f.name != "dt"])


def _run(stream: DataFrame, work, checkpoint: str) -> None:
    q = stream.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint) \
              .trigger(availableNow=True).start()
    q.awaitTermination()


def run_receipt_stream(spark: SparkSession, wh: Warehouse, source_dir: str, checkpoint: str) -> dict:
    """Receipt files -> subscriber deltas, dlr events, api logs, rejects (X1/X2).

    However the files are cut into batches, and in which order, the tables hold
    the same; receipts that wait for their message are taken up by its launch."""
    stats = {"batches": 0}

    def batch(df: DataFrame, batch_id: int) -> None:
        apply_receipt_batch(wh, df)
        stats["batches"] += 1

    _run(spark.readStream.schema(RECEIPT_SCHEMA).parquet(source_dir), batch, checkpoint)
    return stats


def run_dedup_stream(spark: SparkSession, wh: Warehouse, source_dir: str, checkpoint: str) -> None:
    """Receipts delivered more than once (same content) are kept once (X3).

    A receipt is looked for among those already kept of its day, so one that
    comes late, by whatever time, is neither lost nor doubled."""

    def batch(df: DataFrame, batch_id: int) -> None:
        wh.append_new("receipt", df.withColumn("dt", F.to_date("received_at")), tuple(RECEIPT_SCHEMA.fieldNames()))

    _run(spark.readStream.schema(RECEIPT_SCHEMA).parquet(source_dir), batch, checkpoint)


def run_activity_stream(spark: SparkSession, wh: Warehouse, source_dir: str, schema: T.StructType,
                        checkpoint: str, dt: str, now) -> None:
    """Activity files -> canonical rows added by day, each row once (X4)."""

    def batch(df: DataFrame, batch_id: int) -> None:
        rows = canonical_activity(df, dt, now)
        wh.append_new("campaign_activity", rows, tuple(c for c in rows.columns if c != "dt"))

    _run(spark.readStream.schema(schema).parquet(source_dir), batch, checkpoint)
