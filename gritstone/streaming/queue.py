"""A stream of review proposals folded into the stored queue, batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.state import upsert_queue
from ..sources.store import fold


def follow(proposals: DataFrame, root: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Upsert each micro-batch of queue rows into the table under root. A batch that runs twice changes nothing the second time.

    The stored queue is bucketed by function address: a batch reads and rewrites the buckets of its own addresses only. Readers sort (state.sort_queue).
    """

    def merge(batch: DataFrame, epoch: int) -> None:
        fold(batch, root, "queue", "ea", upsert_queue)

    return proposals.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
