"""A feed of file versions applied to an index as they come."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..index import Indexer
from ..sources.files import versions


def apply_changes(feed: DataFrame, root: str, indexer: Indexer, checkpoint: str, report=None, **trigger) -> StreamingQuery:
    """A query that applies a stream of versions (see sources.files.versions) to the index, a commit for each batch that brings
    anything new.

    What a batch brought and the generations of its files are one commit. A query that is started again from its checkpoint may
    see its last batch a second time: its generations are known by then, and nothing happens. The same goes for versions that
    are overtaken on their way. `report` gets each batch's number and its numbers of files by decision.
    """

    def batch(rows: DataFrame, number: int) -> None:
        counts = indexer.apply(versions(rows, root))
        if report is not None:
            report(number, counts)

    return feed.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "10 seconds"})).start()
