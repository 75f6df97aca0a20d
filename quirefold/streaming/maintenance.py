"""Incremental index maintenance from a stream of changed paths."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from quirefold.operators.index import PostingIndex


def maintain(changes: DataFrame, folder: str, current: Callable[[], DataFrame], checkpoint: str, **trigger) -> StreamingQuery:
    """Reconciles the index in `folder`/<batch> with each micro-batch of changed paths (column `path`).

    A batch reads the index of the batch before it and writes its own, so one that runs again gives the same.
    `current` reads the records as they are now. The index to start from is in `folder`/base.
    """

    def apply(batch: DataFrame, number: int) -> None:
        before = f"{folder}/{number - 1}" if number else f"{folder}/base"
        PostingIndex.load(batch.sparkSession, before).reconcile(batch, current()).save(f"{folder}/{number}")

    return changes.select("path").writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
