"""Structured Streaming: incremental reference counts, user additions, event windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from proofweave.operators import references as R
from proofweave.sinks.files import upsert

COUNTS = "kind string, key string, refs long, existing long"


def merge_reference_counts(deltas: DataFrame, state: str, checkpoint: str) -> StreamingQuery:
    """Keep signed counts per key from a stream of deltas ``kind, key, refs, existing``.

    Every batch is summed first and written as a version of its own, so a batch that is run again replaces
    itself; the state of a key is the sum over the versions (:func:`reference_counts`).
    """

    def merge(batch: DataFrame, epoch: int) -> None:
        summed = batch.groupBy("kind", "key").agg(F.sum("refs").alias("refs"), F.sum("existing").alias("existing"))
        summed.write.mode("overwrite").parquet(f"{state}/epoch={epoch}")

    return deltas.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def reference_counts(spark: SparkSession, state: str) -> DataFrame:
    """The counts kept by :func:`merge_reference_counts`."""
    return spark.read.parquet(state).groupBy("kind", "key").agg(F.sum("refs").alias("refs"), F.sum("existing").alias("existing"))


def compact_reference_counts(spark: SparkSession, state: str, into: str) -> None:
    """Fold all versions into one, at another path."""
    reference_counts(spark, state).write.mode("overwrite").parquet(f"{into}/epoch=-1")


def current_orphans(spark: SparkSession, state: str) -> DataFrame:
    """Keys with references and no existence."""
    return R.orphan_state(reference_counts(spark, state))


def merge_additions(additions: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    """Keep the newest version of every user-added link ``prop_id, evidence_id, relation, confidence, ts``."""

    def merge(batch: DataFrame, _: int) -> None:
        upsert(batch.sparkSession, table, batch, ["prop_id", "evidence_id"], "ts")

    return additions.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_windows(events: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Events per type and window with a watermark; on a static table the same plan gives the batch result."""
    at = F.col("ts").cast("timestamp")
    held = events.withColumn("at", at)
    if events.isStreaming:
        held = held.withWatermark("at", late)
    rolled = held.groupBy(F.window("at", width), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return rolled.select(F.col("window.start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", F.round("total", 4).alias("total"))
