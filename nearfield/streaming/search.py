"""A stream of queries against a fixed index: each micro-batch is one batched probe."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from nearfield.operators import ivf


def search_stream(queries: DataFrame, index: ivf.Index, k: int, nprobe: int, sink: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Queries (qid, embedding) as they come; sink gets (qid, rank, vec_id, value) and the batch's number."""

    def each(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty():
            sink(index.search(batch, k, nprobe), number)

    return queries.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
