"""Continuous indexing: at every tick the folder is listed and the index brought up to date."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..index import Indexer
from ..sources.files import listed


def reconcile(spark: SparkSession, root: str, indexer: Indexer, checkpoint: str, every: str = "60 seconds", ignore: list[str] | None = None, report=None) -> StreamingQuery:
    """A query that lists root at every tick and indexes what differs from the last snapshot.

    File streams tell of new paths alone; edits and deletions show when snapshots are compared. Ticks never overlap, and one
    that finds nothing changed writes nothing and reads no contents. `report` gets each tick's numbers of files by decision.
    """
    ticks = spark.readStream.format("rate").option("rowsPerSecond", 1).load()

    def tick(_, number: int) -> None:
        counts = indexer.run(listed(spark, root, ignore, indexer.known()))
        if report is not None:
            report(number, counts)

    return ticks.writeStream.foreachBatch(tick).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()
