"""Resolving records as they arrive against a fixed set of reference records.

Each query is decided alone, so micro-batches give what one batch would; features that look at all queries of a record are left out.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def matches(queries: DataFrame, refs: DataFrame, key: list[str], q_id: str = "q_id", s1_id: str = "s1_id") -> DataFrame:
    """Queries whose key exactly one reference record carries. refs may be static while queries stream: the owners are found on its side."""
    owners = refs.groupBy(*key).agg(F.count("*").alias("owners"), F.min(s1_id).alias(s1_id)).where("owners = 1").drop("owners")
    return queries.join(owners, key).select(q_id, s1_id)


def resolve_stream(queries: DataFrame, refs: DataFrame, key: list[str], path: str, checkpoint: str, then: Callable[[DataFrame], DataFrame] = lambda df: df) -> StreamingQuery:
    """Start a stream that appends each micro-batch's matches to path; a batch that runs twice overwrites its own folder."""

    def write(batch: DataFrame, number: int) -> None:
        then(matches(batch, refs, key)).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return queries.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def counts_by_window(events: DataFrame, time: str = "ts", late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Events and users by hour, for arrivals up to late behind the newest event."""
    return events.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.approx_count_distinct("user_id").alias("users")).select(F.col("w.start").alias("start"), "event_type", "n", "users")
