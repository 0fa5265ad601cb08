"""Bulk upserts from a stream: every micro-batch is one transaction of a store."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from recordloom.store import Store


def upsert_stream(store: Store, sheet: str, records: DataFrame, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Upsert a stream of records into a sheet.

    A commit carries the name of the stream and the number of its batch as a
    trailer, and a batch that was committed before is skipped, so that a restart
    after a failure writes nothing twice.  A batch with an invalid record stops
    the stream before anything of it is written.
    """

    def write(batch: DataFrame, number: int) -> None:
        mark = f"{sheet} {number}"
        store.refresh()
        if any(("Stream-Batch", mark) in c.trailers for c in store.log()):
            return
        with store.transact(f"Upsert {sheet}", trailers={"Stream-Batch": mark}) as tx:
            tx.upsert(sheet, batch)

    writer = records.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
