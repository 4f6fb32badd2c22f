"""Structured Streaming: telemetry to actions, heat from raw accesses, and deduplication of arriving chunks.

Event time and lateness are ours to define: accesses that are later than the watermark are dropped from the heat count. Actions are compiled in
micro-batches by the very code that compiles tables, so batch and stream agree.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.operators.scaling import agent_actions


def action_sink(path: str, policies: DataFrame, nodes: DataFrame, local_kind: str = "metro", local_zone: str = "local") -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: each batch overwrites its own folder, so a batch that is run again leaves the same result."""

    def write(batch: DataFrame, batch_id: int) -> None:
        agent_actions(batch, policies, nodes, local_kind, local_zone).write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return write


def heat(accesses: DataFrame, lateness: str = "10 minutes", window: str = "1 minute") -> DataFrame:
    """(window_start, capsule_id, accesses_per_min) of ``accesses(ts, capsule_id)``, for streams and tables."""
    timed = accesses.withWatermark("ts", lateness) if accesses.isStreaming else accesses
    return timed.groupBy(F.window("ts", window).alias("w"), "capsule_id").agg(F.count(F.lit(1)).alias("accesses_per_min")).select(F.col("w.start").alias("window_start"), "capsule_id", "accesses_per_min")


def new_chunks(chunks: DataFrame, lateness: str = "1 hour") -> DataFrame:
    """The first arrival of each hash. State is kept for hashes within the lateness only; older ones are found in the content store."""
    return chunks.withWatermark("ts", lateness).dropDuplicatesWithinWatermark(["content_hash"])
