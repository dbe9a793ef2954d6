"""Rollups from a stream of spans.

A late span is never dropped: each micro-batch adds rows of its own for the windows it touches, and the questions add rows
up, so a window that is opened again just has one more row. Two clocks that differ between sources do no harm, as no watermark is needed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..store import DAY_US, ROLLED, Store


def start(spans: DataFrame, store: Store, checkpoint: str, once: bool = False, every: str = "1 second") -> StreamingQuery:
    """Writes spans, rollups, finish reasons and calls under way for each micro-batch. A batch that is done again after a failure replaces its own rows.

    After each batch the folders of its days are tidied, so a day never has many, and a row is seldom written again.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.persist()
        try:
            store.ingest(batch, number)
            days = {r[0] for r in batch.select(F.floor(F.col("request_us") / DAY_US)).distinct().collect()}
        finally:
            batch.unpersist()
        for table in ("spans", *ROLLED):
            store.tidy(table, days)

    writer = spans.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)).start()
