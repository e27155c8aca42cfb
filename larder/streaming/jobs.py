"""Structured Streaming jobs: append logs, windowed KPIs and incremental embeddings."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from datetime import datetime, timedelta, timezone

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from larder.operators.logs import log_search

#: The state store that keyed state with timers needs.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def stream_search_log(responses: DataFrame, path: str, checkpoint: str, once_by: Sequence[str] = (), late: str = "1 day") -> StreamingQuery:
    """Appends one row per result of every response that arrives; exactly once by the checkpoint.

    The checkpoint does not help where the source delivers a response twice; ``once_by`` names the columns that tell
    responses apart, and a repeat within ``late`` of the first is dropped. Older ones are forgotten, so state is bounded.
    """
    once = responses.withWatermark("ts", late).dropDuplicatesWithinWatermark(list(once_by)) if once_by else responses
    return log_search(once).writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_kpi(log: DataFrame, ts: str = "search_timestamp", width: str = "1 day", slide: str | None = None, late: str = "1 hour", value: str = "minutes") -> DataFrame:
    """result_rows and average of ``value`` per window; on a stream, rows later than ``late`` are dropped."""
    marked = log.withWatermark(ts, late) if log.isStreaming else log
    got = marked.groupBy(F.window(ts, width, slide or width)).agg(F.count(F.lit(1)).alias("result_rows"), F.avg(value).alias(f"avg_{value}"))
    return got.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), "result_rows", f"avg_{value}")


def windowed_tags(log: DataFrame, tags: Column, ts: str = "search_timestamp", width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Count of every tag per window; rank them where the result is read."""
    marked = log.withWatermark(ts, late) if log.isStreaming else log
    got = marked.select(ts, F.explode(tags).alias("tag")).groupBy(F.window(ts, width), "tag").agg(F.count(F.lit(1)).alias("n"))
    return got.select(F.col("window.start").alias("window_start"), "tag", "n")


class TopTags(StatefulProcessor):
    """Counts of the tags of one window and shard; the k most frequent leave when the watermark passes the window's end."""

    def __init__(self, k: int, width: float):
        self.k, self.width = k, width

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.counts = handle.getMapState("counts", "tag string", "n bigint")
        self.open = handle.getValueState("open", "open boolean")

    def _end(self, key) -> int:
        """End of the window in milliseconds."""
        start = key[0] if isinstance(key[0], datetime) else pd.Timestamp(key[0]).to_pydatetime()
        start = start if start.tzinfo else start.replace(tzinfo=timezone.utc)
        return int((start + timedelta(seconds=self.width)).timestamp() * 1000)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        end = self._end(key)
        new: dict[str, int] = {}
        for part in rows:
            for tag, n in part.groupby("tag")["n"].sum().items():
                new[tag] = new.get(tag, 0) + int(n)
        if end > timerValues.getCurrentWatermarkInMs():  # what comes after its window's end is late
            for tag, n in new.items():
                had = self.counts.getValue((tag,))[0] if self.counts.containsKey((tag,)) else 0
                self.counts.updateValue((tag,), (had + n,))
            if not self.open.exists():
                self.open.update((True,))
                self.handle.registerTimer(end)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        best = sorted(((-v[0], k[0]) for k, v in self.counts.iterator()))[: self.k]
        self.counts.clear()
        self.open.clear()
        yield pd.DataFrame({"window_start": [key[0]] * len(best), "tag": [t for _, t in best], "n": [-n for n, _ in best]})

    def close(self) -> None:
        pass


def top_tags_stream(log: DataFrame, tags: Column, k: int = 5, ts: str = "search_timestamp", width: str = "1 day", late: str = "1 hour", shards: int = 16) -> DataFrame:
    """window_start, tag, n on a stream: the k most frequent tags of every closed window and shard; ``top_of_shards`` makes them the window's.

    A tag belongs to one shard of a window, so its count is whole there, and a window with very many rows is dealt over ``shards`` tasks.
    The session's state store must be that of ``STATE_STORE``.
    """
    start = F.window(ts, width)["start"]
    spread = log.withWatermark(ts, late).select(ts, start.alias("window_start"), F.explode(tags).alias("tag")).where("tag is not null")
    seconds = pd.Timedelta(width).total_seconds()
    keyed = spread.withColumns({"shard": F.pmod(F.xxhash64("tag"), F.lit(shards)).cast("int"), "n": F.lit(1).cast("long")}).groupBy("window_start", "shard")
    return keyed.transformWithStateInPandas(TopTags(k, seconds), "window_start timestamp, tag string, n bigint", "Append", "EventTime")


def top_of_shards(rows: DataFrame, k: int = 5) -> DataFrame:
    """window_start, tag, n, rank from what ``top_tags_stream`` has stored, k rows per window and shard."""
    order = Window.partitionBy("window_start").orderBy(F.desc("n"), "tag")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def write_windows(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    return df.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_embed(source: DataFrame, path: str, checkpoint: str, make: Callable[[DataFrame], DataFrame]) -> StreamingQuery:
    """Embeds each micro-batch; a batch that is run again overwrites its own folder, so each row is stored once."""

    def save(batch: DataFrame, batch_id: int) -> None:
        make(batch).write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return source.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
