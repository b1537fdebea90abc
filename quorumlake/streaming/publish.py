"""Publication of a stream: objects first, roots last, each batch once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery


def publish_stream(events: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Writes (digest, chunk, bytes, manifest_bytes) rows as objects and roots, all that is there now.

    Each micro-batch overwrites folders of its own number, so a batch that is run again after a failure leaves
    what it left before; its roots become visible only after its objects.
    """

    return events.writeStream.foreachBatch(lambda batch, number: write_batch(batch, folder, number)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def write_batch(batch: DataFrame, folder: str, number: int) -> None:
    """One batch's objects, then its roots, in folders of its number."""
    batch.persist()
    batch.select("chunk", "bytes").distinct().write.mode("overwrite").parquet(f"{folder}/objects/batch={number}")
    batch.select("digest", "manifest_bytes").distinct().write.mode("overwrite").parquet(f"{folder}/roots/batch={number}")
    batch.unpersist()
