"""Workers that report by heartbeat, and the vote log: the streaming counterparts of a serving controller's state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

EXPIRES_S = 30


def alive(beats: DataFrame, at: str | None = None, expires_s: int = EXPIRES_S) -> DataFrame:
    """Batch: (worker, last_beat, n_beats, is_alive) as of the latest beat of all."""
    last = beats.groupBy("worker").agg(F.max("ts").alias("last_beat"), F.count(F.lit(1)).alias("n_beats"))
    now = beats.agg(F.max("ts").alias("now"))
    return last.crossJoin(F.broadcast(now)).select("worker", "last_beat", "n_beats", (F.col("last_beat") >= F.col("now") - F.make_dt_interval(secs=F.lit(expires_s))).alias("is_alive"))


def sessions(beats: DataFrame, expires_s: int = EXPIRES_S, late: str = "1 hour") -> DataFrame:
    """Streaming or batch: each worker's spans of life, parted where no beat came for expires_s; beats later than the watermark
    are dropped by the stream."""
    marked = beats.withWatermark("ts", late) if beats.isStreaming else beats
    spans = marked.groupBy("worker", F.session_window("ts", f"{expires_s} seconds").alias("span")).agg(F.count(F.lit(1)).alias("n_beats"))
    return spans.select("worker", F.col("span.start").alias("up_at"), F.col("span.end").alias("down_at"), "n_beats")


def registry(beats: DataFrame, expires_s: int = EXPIRES_S) -> DataFrame:
    """Streaming: (worker, state, ts): a row when a worker registers, and one when event time passes its last beat by expires_s."""

    def update(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            last = state.get[0]
            state.remove()
            yield pd.DataFrame({"worker": [key[0]], "state": ["expired"], "ts": [pd.Timestamp(last, unit="ms")]})
            return
        stamps = [f["ts"].max() for f in frames]
        last = int(max(stamps).timestamp() * 1000)
        new = not state.exists
        last = last if new else max(last, state.get[0])
        state.update((last,))
        state.setTimeoutTimestamp(max(last + expires_s * 1000, state.getCurrentWatermarkMs() + 1))
        if new:
            yield pd.DataFrame({"worker": [key[0]], "state": ["registered"], "ts": [min(stamps)]})

    return beats.withWatermark("ts", "0 seconds").groupBy("worker").applyInPandasWithState(update, "worker long, state string, ts timestamp", "last long", "append", GroupStateTimeout.EventTimeTimeout)


def vote_windows(log: DataFrame, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Streaming or batch: (window_start, type, n, total) of the log's events in tumbling windows."""
    marked = log.withWatermark("ts", late) if log.isStreaming else log
    return marked.groupBy(F.window("ts", width).alias("w"), "type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("window_start"), "type", "n", "total")


def write_daily_log(log: DataFrame, path: str, checkpoint: str):
    """Streaming: the log as JSON lines, a folder a day."""
    return log.withColumn("date", F.date_format("ts", "yyyy-MM-dd")).writeStream.partitionBy("date").format("json").option("checkpointLocation", checkpoint).option("path", path).trigger(availableNow=True).start()
