"""Request metrics and token buckets on streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_metrics(events: DataFrame, window: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Per window and event type: count, mean, least and greatest value.  On a stream, rows later than delay are dropped and
    a window is emitted once it is past it; on a table all windows are returned."""
    if events.isStreaming:
        events = events.withWatermark("ts", delay)
    out = events.groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.min("value").alias("least"), F.max("value").alias("most"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "event_type", "n", "mean", "least", "most")


def closing(events: DataFrame, after: str = "1 day") -> DataFrame:
    """One row of nulls but for ts, `after` behind the last of a table: a stream that gets it closes all windows before."""
    last = events.agg((F.max("ts") + F.expr(f"INTERVAL {after}")).alias("ts")).where("ts is not null")
    return last.select(*(F.col("ts") if f.name == "ts" else F.lit(None).cast(f.dataType).alias(f.name) for f in events.schema))


def token_bucket(events: DataFrame, rate: float, burst: float, delay: str = "10 minutes") -> DataFrame:
    """Adds allowed to (user_id, ts): stateful over micro-batches, a bucket per user; a stream only.  Rows later than delay are
    dropped.  A bucket that must be full again by the watermark is forgotten, as a new one is full too, so state is kept for
    users of the last burst / rate seconds alone."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        tokens, last = state.get if state.exists else (burst, None)
        for rows in frames:
            rows, out = rows.sort_values("ts", kind="stable"), []
            for t in rows["ts"]:
                now = t.timestamp()
                tokens = min(burst, tokens + rate * max(0.0, now - last) if last is not None else burst)
                last = now if last is None else max(now, last)
                out.append(tokens >= 1)
                tokens -= tokens >= 1
            yield rows[["user_id", "ts"]].assign(allowed=out)
        state.update((float(tokens), float(last)))
        state.setTimeoutTimestamp(max(int((last + burst / rate) * 1000) + 1, state.getCurrentWatermarkMs() + 1))

    own = events.select("user_id", "ts").withWatermark("ts", delay)
    return own.groupBy("user_id").applyInPandasWithState(step, "user_id bigint, ts timestamp, allowed boolean", "tokens double, last double", "append", GroupStateTimeout.EventTimeTimeout)
