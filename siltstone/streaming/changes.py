"""Extension: changes of a catalog that arrive as a stream of snapshot rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from siltstone.operators import sync


def follow(scans: DataFrame, entries: Callable[[], DataFrame], sink: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Each micro-batch of scanned files (relative_path, kind, size, mtime_ns, seen_at) is compared with the entries of that moment, and sink gets (relative_path, change).

    Of several rows of a path in a batch the one seen last holds. A batch says nothing about files it doesn't name, so none is
    reported as removed. A batch that is run again after a failure gives the same changes, so a sink that overwrites by batch
    number sees each once.
    """

    def batch(rows: DataFrame, number: int) -> None:
        last = rows.where("relative_path is not null").groupBy("relative_path").agg(F.max(F.struct("seen_at", "kind", "size", "mtime_ns")).alias("_r")).select("relative_path", "_r.kind", "_r.size", "_r.mtime_ns")
        known = entries().join(last.select("relative_path"), "relative_path", "left_semi")
        sink(sync.diff(last, known), number)

    return scans.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).start()
