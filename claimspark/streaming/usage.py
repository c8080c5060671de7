"""Streaming usage counters and adjudication (US6, US7, US12, IO15)."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.usage import with_cost
from .keyed_table import MOST_HISTORY, merge_stream


def usage_stream(stream: DataFrame, value: str, window: str = "1 hour", late: str = "10 minutes", keys: Sequence[str] = ()) -> DataFrame:
    """US6: requests and tokens in tumbling windows; rows later than the watermark are dropped. ts must be a timestamp
    (timestamp_ntz is cast)."""
    timed = stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    out = timed.groupBy(F.window("ts", window), *keys).agg(F.count(F.lit(1)).alias("requests"), F.sum(value).alias("tokens"))
    return out.select(F.col("window.start").alias("window_start"), *keys, "requests", "tokens")


def inflight_stream(events: DataFrame, key: str, idle: str = "10 minutes") -> DataFrame:
    """US7: pending requests per key after every micro-batch, never below 0; a key idle for so long in event time is
    forgotten. events(key, ts, kind). A batch's events of a key are taken in time order; what is kept is one number."""

    wait = int(pd.Timedelta(idle).total_seconds() * 1000)

    def update(k, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        pending = state.get[0] if state.exists else 0
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame({key: [k[0]], "pending": [0]})
            return
        for kind in pd.concat(list(frames)).sort_values(["ts", "kind"], ascending=[True, False])["kind"]:
            pending = max(0, pending + (1 if kind == "start" else -1))
        state.update((pending,))
        state.setTimeoutTimestamp(max(state.getCurrentWatermarkMs(), 0) + wait)
        yield pd.DataFrame({key: [k[0]], "pending": [pending]})

    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", idle)
    kind = dict(events.dtypes)[key]
    return timed.groupBy(key).applyInPandasWithState(update, f"{key} {kind}, pending long", "pending long", "update", GroupStateTimeout.EventTimeTimeout)


def append_usage(stream: DataFrame, prices: DataFrame, path: str, checkpoint: str):
    """IO15: the request log as Parquet, cost stamped as it is written. Returns the query."""
    return with_cost(stream, prices).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def keep_usage(stream: DataFrame, prices: DataFrame, path: str, checkpoint: str, key: str = "request_id", ts: str = "ts", keep: int = MOST_HISTORY):
    """IO15: the request log as a table of the newest ``keep`` requests, each once, cost stamped as it is merged. Returns
    the query; read with keyed_table.read_table, requests of the table's lifetime with keyed_table.state."""
    return merge_stream(stream, path, checkpoint, [key], [ts], lambda batch: with_cost(batch, prices), keep)


def adjudicate_stream(claims: DataFrame, decide, path: str, checkpoint: str):
    """US12: decisions for claims as their files arrive. decide: DataFrame -> DataFrame, applied to every micro-batch
    with batch operators, its dimensions being ordinary tables. A batch that is run again replaces its own output."""

    def each(batch: DataFrame, number: int) -> None:
        decide(batch).withColumn("batch_id", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(path)

    return claims.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
