"""A stream of log rows into a keyed collection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessera.sources.sinks import Collection


def latest_of(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Of rows with one key the one with the greatest ``order``; null keys are left out."""
    every = F.struct(*(F.col(f"`{c}`") for c in rows.columns))
    return rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(every, F.col(order)).alias("row")).select("row.*")


def into_collection(stream: DataFrame, collection: Collection, order: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Starts a query that upserts each micro-batch of ``stream`` into a collection, the latest row of a key counting within a batch.
    A batch is an upsert named by its number: one that is replayed after a failure, whether it had been written or logged or not,
    changes nothing. ``once`` stops at the end of what there is."""

    def batch(rows: DataFrame, number: int) -> None:
        collection.upsert(latest_of(rows, collection.key, order), name=f"batch-{number:012d}")

    writer = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
