"""Streams into collections: micro-batches of changes, the newest of an id wins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.mutations import latest


def stream_upserts(changes: DataFrame, collection, checkpoint: str, order: str = "ts"):
    """Starts a query that upserts each micro-batch; `order` says which change of an id is the newest."""

    def apply(batch: DataFrame, _: int) -> None:
        newest = latest(batch, "id", order).drop(order)
        if newest.isEmpty():
            return
        if collection.manifest["records"]:
            collection.upsert(newest)
        else:
            collection.add(newest)

    return changes.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, ts: str = "ts", key: str = "event_type", width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts by key and window; events later than the watermark are dropped."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, width), key).agg(F.count(F.lit(1)).alias("n"))
