"""Streams into collections, each batch once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from skarn.collection import Collection


def stream_into(stream: DataFrame, collection: Collection, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Adds every micro-batch of a stream to a collection. A batch that is repeated after a failure is added once:
    the collection's manifest records the ids of its batches in the commit that adds them."""

    def add(batch: DataFrame, batch_id: int) -> None:
        collection.add_dataframe(batch, batch_id=f"{checkpoint}:{batch_id}")

    writer = stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
