"""Streams of listings and requests."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def windowed_counts(events: DataFrame, time: str, width: str, late: str, *keys: str) -> DataFrame:
    """(window_start, keys, n) per tumbling window; state goes once the watermark has passed a window."""
    counted = events.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.col("w.start").alias("window_start"), *keys, "n")


def timely(listings: DataFrame, now: str | None, grace: str = "1 day") -> DataFrame:
    """Listings that hadn't ended a day before now; a watermark alone drops state, not rows."""
    end = F.coalesce("ends_at", "starts_at")
    reference = F.lit(now).cast("timestamp") if now else F.current_timestamp()
    return listings.withWatermark("starts_at", grace).filter(end >= reference - F.expr(f"INTERVAL {grace}"))


def deduplicated(listings: DataFrame, keys: list[str], time: str, within: str) -> DataFrame:
    """The first report of each key within the watermark."""
    return listings.withWatermark(time, within).dropDuplicatesWithinWatermark(keys)


def limited(requests: DataFrame, key: str, time: str, most: int, seconds: int) -> DataFrame:
    """(key, time, allowed): at most `most` allowed requests of a key in any `seconds`; denied ones aren't counted."""

    def step(name: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(frames)).sort_values(time)
        allowed = []
        for at in rows[time].astype("int64") // (1 if rows[time].dtype == "datetime64[us]" else 1_000):
            held = [h for h in held if h > at - seconds * 1_000_000]
            allowed.append(len(held) < most)
            if allowed[-1]:
                held.append(int(at))
        state.update((held,))
        yield pd.DataFrame({key: name[0], time: rows[time], "allowed": allowed})

    kind = dict(requests.dtypes)
    return requests.groupBy(key).applyInPandasWithState(step, f"{key} {kind[key]}, {time} timestamp, allowed boolean", "held array<long>", "append", GroupStateTimeout.NoTimeout)


def start_upserts(listings: DataFrame, checkpoint: str, upsert: Callable[[DataFrame, int], None], every: str | None = None) -> StreamingQuery:
    """Hand each micro-batch to upsert(batch, number), once per number; all at hand, or every interval."""
    writer = listings.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()
