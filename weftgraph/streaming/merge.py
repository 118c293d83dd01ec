"""Incremental merging of edge batches: the largest weight of each unordered pair, which is idempotent and commutative."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from weftgraph.functions import columns as C


def streaming_max(edges: DataFrame) -> DataFrame:
    """``edges(u, v, w)`` as a stream; use it with output mode ``update`` or ``complete``. NaN, self loops and weights of 0 or less are left out."""
    ok = edges.where("u <> v and w > 0").where(~F.isnan("w"))
    return ok.groupBy(C.smaller("u", "v").alias("u"), C.larger("u", "v").alias("v")).agg(F.max("w").alias("w"))


def windowed_counts(edges: DataFrame, time: str, *, width: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Edges by tumbling window of their time; rows later than ``late`` behind the newest are dropped from state."""
    return edges.withWatermark(time, late).groupBy(F.window(time, width)).agg(F.count(F.lit(1)).alias("n"), F.max("w").alias("max_w"))


def merge_into(edges: DataFrame, read: Callable[[], DataFrame | None], write: Callable[[DataFrame], None], checkpoint: str, **trigger) -> StreamingQuery:
    """Merge each micro-batch of a stream with the table that ``read`` gives and hand the result to ``write``; repeating a batch changes nothing."""

    def each(batch: DataFrame, _: int) -> None:
        old = read()
        both = batch.select("u", "v", "w") if old is None else batch.select("u", "v", "w").unionByName(old.select("u", "v", "w"))
        write(streaming_max(both))

    return edges.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
